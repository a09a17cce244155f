"""Quality rules by distribution divergence.

Each document's histogram of character classes and histogram of common words are compared with those of its language by
Jensen-Shannon distance (the square root of the divergence in bits, 0 to 1). A language's reference is the sum of the
histograms of all its documents that pass the base rules, taken anew without those far from it, so it covers the whole
corpus and needs no list of clean documents. Short documents scatter widely around any reference; each distance only counts from a minimum length on.

Everything is DataFrame functions; the histograms of all documents, a few dozen small integers each, are written once
and read twice.

Null texts count as empty; empty texts have no words and fail the base rules. A null language is a language of its own.
A language none of whose documents passes the base rules has no reference, and its documents are judged by the base rules
alone. A distance equal to its limit isn't over it. Repeated rows are judged alike, null ids like others. A very long text
is counted whole, in one row. An empty table gives an empty result. Other columns aren't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Frequent words of the languages at hand; the histogram has one class for each and one for all others.
COMMON = tuple(
    "the of and to in is that it for was "
    "der die und den von zu das mit nicht ist "
    "le la de et les des que un une pour "
    "el los y en del las por con se para".split()
)
#: Character classes as regular expressions; white space and all else (small letters, mostly) are the last two.
CLASSES = (r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]+", r"[0-9]+", r"[.,;:!?'\x22()\x{BF}\x{A1}-]+", r"[#*$%&|<>]+")
BASE_WORDS, CHAR_LENGTH, WORD_LENGTH = 50, 200, 80
#: A document is odd if both distances are over the first pair of limits, or one is over its limit of the second pair.
BOTH, EITHER = (0.16, 0.15), (0.35, 0.6)


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more, each word once. The windows are sorted only where two of
    them have one hash, which most texts rule out."""

    def marked(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, j)["w"] == F.get(s, k)["w"], F.lit(False))
        hits = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(s, k)["i"])), lambda i: i.isNotNull())
        state = lambda c, e: F.struct(c.cast("long").alias("c"), e.cast("int").alias("e"))
        return F.aggregate(F.sort_array(hits), state(F.lit(0), F.lit(0)), lambda a, p: state(a["c"] + p + 3 - F.greatest(p, a["e"]), p + 3), lambda a: a["c"])

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def counted(w: Column) -> Column:
        alike = let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(alike, let(F.sort_array(windows(w)), marked)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, counted)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    without = lambda r: F.length("text") - F.length(F.regexp_replace("text", r, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    common = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w.isin(*COMMON))
    rows = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("text").cast("long").alias("n_chars"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).alias("n_repeat_words"),
        F.array(*[without(r).cast("long") for r in CLASSES]).alias("classes"),
        let(common, lambda a: F.array(*[(F.size(a) - F.size(F.array_remove(a, w))).cast("long") for w in COMMON])).alias("common"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    white = F.col("n_chars") - F.col("word_chars")
    chars = F.concat("classes", F.array(white, F.greatest(F.lit(0).cast("long"), F.col("n_chars") - white - total(F.col("classes")))))
    words = F.concat("common", F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - total(F.col("common")))))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "lang", "n_words", "word_chars", F.col("classes")[3].alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("chars"), words.alias("words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def divergence(s: Column, t: Column) -> Column:
        bits = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return total(F.zip_with(p, q, lambda x, y: let(F.struct((x / s).alias("a"), (y / t).alias("b")), lambda c: 0.5 * bits(c["a"], (c["a"] + c["b"]) / 2) + 0.5 * bits(c["b"], (c["a"] + c["b"]) / 2))))

    both = F.struct(total(p).alias("s"), total(q).alias("t"))
    return let(both, lambda b: F.when((b["s"] > 0) & (b["t"] > 0), F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), divergence(b["s"], b["t"]))))))


def references(rows: DataFrame) -> DataFrame:
    """A row for each language: the summed histograms of its documents."""
    n_chars, n_words = len(CLASSES) + 2, len(COMMON) + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(n_words)]
    by = rows.groupBy(F.col("lang").alias("of")).agg(*sums)
    return by.select("of", F.array(*[F.col(f"c{i}") for i in range(n_chars)]).alias("ref_chars"), F.array(*[F.col(f"w{i}") for i in range(n_words)]).alias("ref_words"))


def judge(docs: DataFrame, both: tuple[float, float] = BOTH, either: tuple[float, float] = EITHER, char_length: int = CHAR_LENGTH, word_length: int = WORD_LENGTH, first: float = 1.5) -> DataFrame:
    """The base rules, then both distances from references that leave out what is far (by `first` times the limits) from
    those of all documents."""

    def apart(by: DataFrame, scale: float) -> DataFrame:
        out = rows.join(by, F.col("lang").eqNullSafe(F.col("of")), "left")
        out = out.select(*rows.columns, distance(F.col("chars"), F.col("ref_chars")).alias("char_distance"), distance(F.col("words"), F.col("ref_words")).alias("word_distance"))
        long, wordy = F.col("word_chars") >= char_length, F.col("n_words") >= word_length
        char = lambda most: F.coalesce(long & (F.col("char_distance") > most * scale), F.lit(False))
        word = lambda most: F.coalesce(wordy & (F.col("word_distance") > most * scale), F.lit(False))
        odd = (char(both[0]) & word(both[1])) | char(either[0]) | word(either[1])
        return out.select("*", (~F.col("base_failed") & ~odd).alias("kept"))

    rows = materialize(measures(docs), "quality-measures")
    plainer = apart(references(rows.filter("not base_failed")), first).filter("kept")
    judged = apart(references(plainer), 1.0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op2_divergence_rules(docs: DataFrame) -> DataFrame:
    return judge(docs)


def _oracle() -> str:
    """The same in SQL, over rows in place of arrays: a row for each word, each line, and each class of a histogram."""
    listed = ", ".join(f"'{w}'" for w in COMMON)
    count = lambda r: f"len(text) - len(regexp_replace(text, '{r.rstrip('+').replace(chr(39), chr(39) * 2)}', '', 'g'))"

    def apart(k: int, rows: str, scale: float) -> str:
        """References from `rows`, each document's distances from them, and whether it is odd."""
        far = lambda kind, length, most: f"coalesce({length} AND {kind}_distance > {most} * {scale}, false)"
        long, wordy = f"word_chars >= {CHAR_LENGTH}", f"n_words >= {WORD_LENGTH}"
        return f"""r{k} AS (SELECT h.lang, h.kind, h.i, sum(h.v) AS v FROM h JOIN {rows} x USING (rid) GROUP BY ALL), t{k} AS (SELECT lang, kind, sum(v) AS t FROM r{k} GROUP BY ALL),
    j{k} AS (SELECT h.rid, h.kind, sum(CASE WHEN h.v > 0 THEN 0.5 * (h.v / s.s) * log2((h.v / s.s) / ((h.v / s.s + r.v / t.t) / 2)) ELSE 0 END + CASE WHEN r.v > 0 THEN 0.5 * (r.v / t.t) * log2((r.v / t.t) / ((h.v / s.s + r.v / t.t) / 2)) ELSE 0 END) AS d
      FROM h JOIN s USING (rid, kind) JOIN r{k} r ON r.kind = h.kind AND r.i = h.i AND r.lang IS NOT DISTINCT FROM h.lang JOIN t{k} t ON t.kind = h.kind AND t.lang IS NOT DISTINCT FROM h.lang WHERE s.s > 0 AND t.t > 0 GROUP BY ALL),
    a{k} AS (SELECT b.*, (SELECT sqrt(least(1.0, greatest(0.0, d))) FROM j{k} j WHERE j.rid = b.rid AND j.kind = 'c') AS char_distance, (SELECT sqrt(least(1.0, greatest(0.0, d))) FROM j{k} j WHERE j.rid = b.rid AND j.kind = 'w') AS word_distance FROM b),
    k{k} AS (SELECT *, NOT base_failed AND NOT (({far('char', long, BOTH[0])} AND {far('word', wordy, BOTH[1])}) OR {far('char', long, EITHER[0])} OR {far('word', wordy, EITHER[1])}) AS kept FROM a{k})"""

    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS l FROM d)),
    g AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
    p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
    q AS (SELECT rid, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) x(k) GROUP BY 1),
    l AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY 1),
    n AS (SELECT rid, count(*) AS n, sum(len(w)) AS c FROM w GROUP BY 1),
    b AS (SELECT d.*, coalesce(n.n, 0) AS n_words, coalesce(n.c, 0) AS word_chars, {count(CLASSES[3])} AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, coalesce(n.n, 0) < {BASE_WORDS} OR 100 * coalesce(q.n, 0) > 50 * coalesce(n.n, 0) AS base_failed
      FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) LEFT JOIN q USING (rid)),
    c AS (SELECT rid, lang, [{', '.join(count(r) for r in CLASSES)}] AS c, len(text) - word_chars AS white, len(text) AS n FROM b),
    o AS (SELECT rid, lower(w) AS w, count(*) AS n FROM w WHERE lower(w) IN ({listed}) GROUP BY ALL),
    m AS (SELECT * FROM (SELECT unnest([{listed}]) AS w, generate_subscripts([{listed}], 1) AS i)),
    h AS (SELECT rid, lang, 'c' AS kind, unnest(list_concat(c, [white, greatest(0, n - white - list_sum(c))])) AS v, unnest(range(1, {len(CLASSES) + 3})) AS i FROM c
      UNION ALL SELECT b.rid, b.lang, 'w', coalesce(o.n, 0), m.i FROM b CROSS JOIN m LEFT JOIN o ON o.rid = b.rid AND o.w = m.w
      UNION ALL SELECT b.rid, b.lang, 'w', greatest(0, b.n_words - coalesce((SELECT sum(n) FROM o WHERE o.rid = b.rid), 0)), {len(COMMON) + 1} FROM b),
    s AS (SELECT rid, kind, sum(v) AS s FROM h GROUP BY ALL), f AS (SELECT rid FROM b WHERE NOT base_failed),
    {apart(1, 'f', 1.5)}, z AS (SELECT rid FROM k1 WHERE kept),
    {apart(2, 'z', 1.0)}
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM k2"""


ORACLE = _oracle()
