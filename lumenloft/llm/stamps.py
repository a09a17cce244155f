"""Mixed timestamps as instants: distinct stamps are parsed once, sources vote on the order of day and month, and the
resolved dictionary is joined back.

  1. A key is (source, zone, stripped stamp); rows are counted by key with partial aggregation, so that a frequent key
     shuffles as one row for each task. Stamps too long for any form count as null here.
  2. Each key is parsed once: its date or dates, its time, its offset.
  3. Slashed stamps that are possible in one order only vote for it in their source, weighted by their count.
  4. Slashed keys with two different dates look up their source's votes: an order with over `MARGIN` times the other's
     votes wins (rule votes), else the month comes first (default).
  5. Rows look up their key. Lookups are null-safe: nulls are keys like others.

In both lookups a key that holds at least one in SHARE of the rows that look is heavy: its rows are dealt over SALTS
numbers, and what they find is copied to each. There are at most SHARE heavy keys, whatever the size of the table, and only
their 8-byte hashes are broadcast; everything else is shuffled.

Forms (all with two-digit fields and years from 2000 to 2099): ten digits as epoch seconds, thirteen as milliseconds;
y-m-d, ymd, d.m.y, d Mon y, d/m/y or m/d/y, then perhaps a T or a blank with h:m, seconds, AM or PM, and Z or an offset.
No time means midnight. Null, impossible or other stamps are bad and never vote. Dates without an offset are in `zone`;
where that is null or no zone's name they are bad. Wall times that the zone skips or repeats take the offset before the
change and are ambiguous, like rules votes and default.

Repeated rows give repeated results and vote each; an empty table gives an empty result; other columns are ignored, so
their names can't clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain

BLANK = " \t\n\x0b\x0c\r"
LONGEST = 64  # no form reaches so many characters
MARGIN = 3
SHARE, SALTS = 256, 64
DAY = 86_400_000_000
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
EPOCH = r"\A([0-9]{10}|[0-9]{13})\z"
_TWO, _YEAR = "([0-9]{2})", "(20[0-9]{2})"
DATES = [f"{_YEAR}-{_TWO}-{_TWO}", f"{_YEAR}{_TWO}{_TWO}", rf"{_TWO}\.{_TWO}\.{_YEAR}", f"{_TWO} ({'|'.join(MONTHS.split())}) {_YEAR}", f"{_TWO}/{_TWO}/{_YEAR}"]
TIME = rf"(?:[T ]{_TWO}:{_TWO}(?::{_TWO})?(?: ?([AP])M)?(?: ?(?:(Z)|([+-]){_TWO}:?{_TWO}))?)?"
FORM = rf"\A(?:{'|'.join(DATES)}){TIME}\z"
GROUPS = 3 * len(DATES) + 8
KEY = ["source", "zone", "stamp"]


def parsed(keys: DataFrame) -> DataFrame:
    """keys with `epoch_us`, or `wall_us` (day first), `swapped_us` (month first; slashed stamps only) and `offset_us`.

    A wall time is in microseconds as if it were UTC. What is impossible is null."""
    whole = F.split(F.regexp_replace("stamp", FORM, "|".join(f"${i + 1}" for i in range(GROUPS))), r"\|")
    # the generator keeps the parts from being parsed again in each expression over them
    df = keys.select(F.inline(F.array(F.struct(*keys.columns, F.when(F.col("stamp").rlike(FORM), whole).alias("p")))))
    part = [F.col("p")[i] for i in range(GROUPS)]
    # what a form leaves empty isn't cast: a failed cast costs more than all the rest
    number = [F.when(x != "", x.cast("int")) for x in part]

    def first(*which: int) -> Column:
        return F.coalesce(*[number[i] for i in which])

    named = F.when(part[10] != "", F.expr(f"(instr('{MONTHS}', p[10]) + 3) div 4").cast("int"))
    hour, minute, second = number[15], number[16], number[17]
    half, zulu, sign = part[18], part[19], part[20]
    clock = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    clock = F.when(part[15] == "", 0).otherwise(clock)
    at = [clock, F.coalesce(minute, F.lit(0)), F.when(F.coalesce(second, F.lit(0)) < 60, F.coalesce(second, F.lit(0)))]

    def wall(year: Column, month: Column, day: Column) -> Column:
        return F.unix_micros(F.try_make_timestamp(year, month, day, at[0], at[1], at[2].cast("decimal(16,6)"), F.lit("UTC")))

    year, day = first(0, 3, 8, 11, 14), first(2, 5, 6, 9, 12)
    month = F.coalesce(number[1], number[4], number[7], named, number[13])
    slashed = part[14] != ""
    off = F.when(zulu != "", F.lit(0)).when((number[21] <= 14) & (number[22] <= 59), (number[21] * 60 + number[22]) * F.when(sign == "-", -1).otherwise(1))
    good = (zulu == "") & (sign == "") | off.isNotNull()
    return df.select(
        *keys.columns,
        F.when(F.col("stamp").rlike(EPOCH), F.col("stamp").cast("long") * F.when(F.length("stamp") == 10, 1_000_000).otherwise(1000)).alias("epoch_us"),
        F.when(good, wall(year, month, day)).alias("wall_us"),
        F.when(good & slashed, wall(year, number[12], number[13])).alias("swapped_us"),
        (off.cast("long") * 60_000_000).alias("offset_us"),
        F.coalesce(slashed, F.lit(False)).alias("slashed"),
    )


def known_zone(zone: Column) -> Column:
    """Whether a zone's name is one; null where it is null."""
    return F.when(zone.isNotNull(), F.try_make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), zone).isNotNull())


def instant(wall_us: Column, offset_us: Column, zone: Column) -> tuple[Column, Column]:
    """The instant of a wall time, and whether its zone skips or repeats it. Without offset and zone both are null.

    The offsets a day before and a day after decide: where they differ, the zone changes between them, and the earlier one
    is right unless only the later one gives an instant at which it holds."""

    def offset(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us

    early, late = offset(wall_us - DAY), offset(wall_us + DAY)
    fits, fits_late = offset(wall_us - early) == early, offset(wall_us - late) == late
    at = F.when(offset_us.isNotNull(), wall_us - offset_us).otherwise(wall_us - F.when(~fits & fits_late, late).otherwise(early))
    return at, offset_us.isNull() & (early != late) & (fits == fits_late)


def looked_up(rows: DataFrame, keys: list[str], found: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows with found's other columns, by null-safe equality of keys, each of which `found` has once.

    heavy: the hashes of at most SHARE keys (column `hot`), whose rows are dealt over SALTS numbers."""
    hot = F.broadcast(heavy.select("hot").distinct())
    dealt = rows.withColumn("h", F.xxhash64(*keys)).join(hot, F.col("h") == F.col("hot"), "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("h", "hot")
    copies = found.withColumn("h", F.xxhash64(*keys)).join(hot, F.col("h") == F.col("hot"), "left")
    copies = copies.withColumn("salt2", F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("h", "hot")
    copies = copies.withColumnsRenamed({k: f"{k}_2" for k in keys}).hint("merge")
    on = F.col("salt") == F.col("salt2")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_2"))
    return dealt.join(copies, on, "left").drop("salt", "salt2", *[f"{k}_2" for k in keys])


def heaviest(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes of the keys with one in SHARE of all rows or more; counted: a row with `n` for each key (or part of one)."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    by = counted.groupBy(F.xxhash64(*keys).alias("hot")).agg(F.sum("n").alias("n"))
    return by.filter(F.col("n") * SHARE >= total).filter("n > 1").select("hot")


def keyed(df: DataFrame) -> DataFrame:
    stamp = F.btrim(F.col("raw"), F.lit(BLANK))
    return df.withColumn("stamp", F.when(F.length(stamp) < LONGEST, stamp)).drop("raw")


def dictionary(stamps: DataFrame) -> DataFrame:
    """A row for each (source, zone, stamp) with its count n and its parsed parts, written in the shared folder."""
    counted = keyed(stamps).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    zone = known_zone(F.col("zone"))
    df = parsed(counted)
    usable = F.col("offset_us").isNotNull() | F.coalesce(zone, F.lit(False))
    # parts are dropped where the zone that they need isn't known
    return materialize(df.withColumns({c: F.when(usable, F.col(c)) for c in ("wall_us", "swapped_us")}).withColumn("zone_ok", F.coalesce(zone, F.lit(False))), "stamps")


TWO_DATES = "slashed and wall_us is not null and swapped_us is not null and wall_us <> swapped_us"


def votes(keys: DataFrame) -> DataFrame:
    """source, day_first, month_first: how many stamps of a source are possible in that order only."""
    one = keys.filter("slashed and (wall_us is null) <> (swapped_us is null)")
    count = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0)).alias
    return one.groupBy("source").agg(count("wall_us")("day_first"), count("swapped_us")("month_first"))


def resolved(keys: DataFrame) -> DataFrame:
    """The dictionary's keys with utc_us, rule and ambiguous."""
    two = keys.filter(TWO_DATES)
    heavy = heaviest(two.select("source", F.lit(1).alias("n")), ["source"])
    two = looked_up(two, ["source"], votes(keys), heavy)
    d, m = F.coalesce("day_first", F.lit(0)), F.coalesce("month_first", F.lit(0))
    wins_d, wins_m = d > MARGIN * m, m > MARGIN * d
    two = two.withColumn("rule", F.when(wins_d | wins_m, "votes").otherwise("default")).withColumn("wall_us", F.when(wins_d, F.col("wall_us")).otherwise(F.col("swapped_us")))
    rest = keys.filter(f"not coalesce({TWO_DATES}, false)").withColumn("wall_us", F.coalesce("wall_us", "swapped_us"))
    rest = rest.withColumn("rule", F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("wall_us").isNotNull(), "plain").otherwise("bad"))
    both = two.select(*rest.columns).unionByName(rest)
    at, odd = instant(F.col("wall_us"), F.col("offset_us"), F.when(F.col("zone_ok"), F.col("zone")))
    return both.select(*KEY, F.coalesce("epoch_us", at).alias("utc_us"), "rule", (F.col("rule").isin("votes", "default") | F.coalesce(odd, F.lit(False))).alias("ambiguous"))


def normalised(stamps: DataFrame) -> DataFrame:
    """stamp_id, source, zone, raw -> stamp_id, utc_us, rule, ambiguous, for every row."""
    rows = plain(stamps, "stamp_id", "source", "zone", "raw")
    keys = dictionary(rows)
    heavy = heaviest(keys.select(*KEY, "n"), KEY)
    return looked_up(keyed(rows), KEY, resolved(keys), heavy).select("stamp_id", "utc_us", "rule", "ambiguous")


def op13_stamp_dictionary(stamps: DataFrame) -> DataFrame:
    return normalised(stamps)


def _off(us: str) -> str:
    """The zone's offset at an instant, in DuckDB."""
    return f"(epoch_us(timezone(zone, make_timestamptz({us}))) - ({us}))"


ORACLE = rf"""
with base as (
  select stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) s from stamps
), cut as (
  select *, regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}') epoch,
    coalesce(regexp_extract(s, '^(20[0-9][0-9]-?[0-9][0-9]-?[0-9][0-9]|[0-9][0-9][.][0-9][0-9][.]20[0-9][0-9]|[0-9][0-9] (?:{"|".join(MONTHS.split())}) 20[0-9][0-9]|[0-9][0-9]/[0-9][0-9]/20[0-9][0-9])', 1), '') d
  from base
), form as (
  select *, substr(s, length(d) + 1) t, case when regexp_full_match(d, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') then 'ymd' when regexp_full_match(d, '20[0-9]{{6}}') then 'y' when d like '__.%' then 'dmy' when d like '__ %' then 'dby' when d like '__/%' then 'x' end f
  from cut
), fields as (
  select *, regexp_full_match(t, '([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?( ?[AP]M)?( ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}}))?)?') and f is not null and not epoch fit,
    try_cast(case f when 'ymd' then d[1:4] when 'y' then d[1:4] when 'dby' then d[8:11] else d[7:10] end as int) yy,
    case f when 'ymd' then try_cast(d[6:7] as int) when 'y' then try_cast(d[5:6] as int) when 'dby' then (instr('{MONTHS}', d[4:6]) + 3) // 4 else try_cast(d[4:5] as int) end mm,
    try_cast(case f when 'ymd' then d[9:10] when 'y' then d[7:8] else d[1:2] end as int) dd,
    case when t = '' then 0 else try_cast(t[2:3] as int) end h0, case when t = '' then 0 else try_cast(t[5:6] as int) end mi,
    case when regexp_matches(t, '^.[0-9]{{2}}:[0-9]{{2}}:') then try_cast(t[8:9] as int) else 0 end se,
    regexp_extract(t, '([AP])M', 1) half, regexp_extract(t, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) o
  from form
), clock as (
  select *, case when half = '' then case when h0 <= 23 then h0 end when h0 between 1 and 12 then h0 % 12 + case half when 'P' then 12 else 0 end end hh,
    case when o = '' then null when o = 'Z' then 0 when try_cast(o[2:3] as int) <= 14 and try_cast(o[-2:] as int) <= 59 then (try_cast(o[2:3] as int) * 60 + try_cast(o[-2:] as int)) * case o[1] when '-' then -1 else 1 end * 60000000::bigint end off
  from fields
), walls as (
  select *, case when fit and hh is not null and mi <= 59 and se <= 59 and (o = '' or off is not null) then (hh * 3600 + mi * 60 + se) * 1000000::bigint end tod
  from clock
), dated as (
  select *, case when zone in (select name from pg_timezone_names()) or off is not null then 1 end ok,
    epoch_us(try_cast(printf('%04d-%02d-%02d', yy, mm, dd) as date)::timestamp) + tod a,
    case when f = 'x' then epoch_us(try_cast(printf('%04d-%02d-%02d', yy, dd, mm) as date)::timestamp) + tod end b
  from walls
), usable as (select * exclude (a, b), case when ok = 1 then a end a, case when ok = 1 then b end b from dated),
votes as (
  select source, count(*) filter (where a is not null) df, count(*) filter (where b is not null) mf
  from usable where f = 'x' and (a is null) <> (b is null) group by source
), ruled as (
  select u.*, coalesce(df, 0) df, coalesce(mf, 0) mf, case when epoch then 'epoch' when a <> b then case when coalesce(df, 0) > 3 * coalesce(mf, 0) or coalesce(mf, 0) > 3 * coalesce(df, 0) then 'votes' else 'default' end when coalesce(a, b) is not null then 'plain' else 'bad' end rule
  from usable u left join votes v on u.source is not distinct from v.source
), picked as (select *, case when a <> b and df <= 3 * mf then b else coalesce(a, b) end w from ruled),
offsets as (
  select *, case when off is null and w is not null then {_off(f"w - {DAY}")} end o1, case when off is null and w is not null then {_off(f"w + {DAY}")} end o2 from picked
), fitted as (select *, {_off("w - o1")} = o1 f1, {_off("w - o2")} = o2 f2 from offsets)
select stamp_id, case when epoch is true then try_cast(s as bigint) * case length(s) when 10 then 1000000 else 1000 end
    else w - coalesce(off, case when not f1 and f2 then o2 else o1 end) end utc_us,
  rule, rule in ('votes', 'default') or coalesce(o1 <> o2 and f1 = f2, false) as ambiguous
from fitted
"""
