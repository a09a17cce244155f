"""Destinations of new files, planned for a whole batch at once.

Names are taken in order of relative path inside a directory: the planned name, name-<sum8>, name-<sum8>-2 and so on,
whichever isn't taken by a file on record or by an earlier file of the batch, where a taken name that holds the same
content is reused.

Read one after another that is sequential, but what a file gets depends on little. Files of one name and content (a claim)
share a destination. The first claim on a name that is free owns it; every other takes the first free name of its own
family, name-<sum8>[-n], past the records in it. All of that is aggregation and joins, spread by name. Only where a new
file's own name stands in the family of another's claim, or where two contents of one name share their sum8, does the order
matter; such names have one root once all suffixes are taken off, and the files of such a root are read in order, a root in
one task. Neither a directory nor a name has to fit into a task otherwise.

Names are long expressions over short rows, and many branches read them. So the rows are dealt to all tasks before names are
made of them (a table of short rows is scanned by few), and names, claims and clashing roots are written and read back."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloft.functions import hashing, paths
from lumenloft.plans.scratch import written

SCHEMA = "file string, kind string, destination_path string, checksum string"


def split_name(name: str) -> tuple[str, str]:
    stem, ext = os.path.splitext(name)
    return stem, ext


def _in_order(batches):
    """Rows in order of directory and root, those on record first, then by path: one root's taken names are held at a time."""
    here, taken = None, {}
    for b in batches:
        out = []
        for d, root, name, old, file, checksum, short, known in zip(*[b[c].to_pylist() for c in ("directory", "root", "name", "existing", "file", "checksum", "short", "verified")], strict=True):
            if (d, root) != here:
                here, taken = (d, root), {}
            if old:
                taken[name] = known
                continue
            stem, ext = split_name(name)
            turn, at = 0, name
            while at in taken and (taken[at] is None or taken[at] != checksum):
                turn += 1
                at = f"{stem}-{short}{ext}" if turn == 1 else f"{stem}-{short}-{turn}{ext}"
            out.append((file, "reuse" if at in taken else "new", f"{d}/{at}" if d else at, checksum))
            taken.setdefault(at, checksum)
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["file", "kind", "destination_path", "checksum"])


EXT = r"[^.](\.[^.]*)$"
TAIL = "-([0-9a-f]{8})(?:-([1-9][0-9]*))?"


def stem_of(name: Column) -> tuple[Column, Column]:
    ext = F.regexp_extract(name, EXT, 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext


def root_of(name: Column) -> Column:
    """A name without any suffixes: what may stand in one family has one root."""
    stem, ext = stem_of(name)
    return F.concat(F.regexp_replace(stem, f"(?:{TAIL})+$", ""), ext)


def members_of_families(names: DataFrame) -> DataFrame:
    """names(name, ...) -> a row for each family that a name may stand in: parent, family (sum8), k (1 without a counter)."""
    stem, ext = stem_of(F.col("name"))
    plain, counted = "^(.+)-([0-9a-f]{8})$", "^(.+)-([0-9a-f]{8})-([1-9][0-9]*)$"

    def read(form: str, k: Column) -> Column:
        return F.when(stem.rlike(form), F.struct(F.concat(F.regexp_extract(stem, form, 1), ext).alias("parent"), F.regexp_extract(stem, form, 2).alias("family"), k.alias("k")))

    two = F.array(read(plain, F.lit(1).cast("long")), read(counted, F.when(F.regexp_extract(stem, counted, 3) != "1", F.regexp_extract(stem, counted, 3).try_cast("long"))))
    out = names.withColumn("m", F.explode(F.filter(two, lambda m: m.isNotNull()))).select(*names.columns, "m.*")
    suffix = F.when(F.col("k") == 1, F.col("family")).otherwise(F.concat("family", F.lit("-"), F.col("k").cast("string")))
    return once(out).filter(paths.suffix_filename("parent", suffix) == F.col("name"))


def once(df: DataFrame) -> DataFrame:
    """df with its columns computed here and not again in each filter that is pushed down: names are long expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def clashing_roots(claims: DataFrame) -> DataFrame:
    """directory, root: where a new file's own name stands in the family of another's claim, or contents share a family."""
    families = claims.select("directory", F.col("name").alias("parent"), F.col("short").alias("family")).distinct()
    inside = members_of_families(claims.select("directory", "root", "name").distinct()).join(families, ["directory", "parent", "family"], "left_semi").select("directory", "root")
    shared = claims.groupBy("directory", "root", "name", "short").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("directory", "root")
    return inside.unionByName(shared).distinct()


def plan_destinations(files: DataFrame, existing: DataFrame, template: str = paths.DEFAULT_TEMPLATE, compat: str = "documented", unicode: bool = True) -> DataFrame:
    """files(file, relative_path, capture_day, label, nickname, original_filename, checksum) and
    existing(destination_path, verified_checksum) -> file, kind, destination_path, checksum.

    `documented` reuses a destination whose verified checksum is the file's. `composed-app` hands the planner the quick
    fingerprint, which never equals a checksum, so it always takes a new name. Files whose destination can't be compiled
    or that have no checksum come out with kind `invalid`. Where records repeat a path, the largest checksum counts."""
    dest = paths.compile_template(template, "capture_day", "label", "original_filename", "nickname", unicode=unicode)
    files = files.repartition("file", "relative_path")
    f = written(files.select("file", "relative_path", "checksum", hashing.short_checksum("checksum").alias("short"), dest.alias("dest")), "destinations")
    bad = F.col("dest").isNull() | F.coalesce(F.col("checksum") == "", F.lit(True))
    invalid = f.filter(bad).select("file", F.lit("invalid").alias("kind"), F.lit(None).cast("string").alias("destination_path"), "checksum")
    fresh = f.filter(~bad).select(paths.dirname("dest").alias("directory"), paths.basename("dest").alias("name"), "file", "relative_path", "checksum", "short")
    known = F.col("verified_checksum") if compat == "documented" else F.lit(None).cast("string")
    old = existing.select(paths.dirname("destination_path").alias("directory"), paths.basename("destination_path").alias("name"), known.alias("verified")).groupBy("directory", "name").agg(F.max("verified").alias("verified"))
    return plan_names(fresh, old).unionByName(invalid)


def plan_names(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """fresh(directory, name, file, relative_path, checksum, short) and old(directory, name, verified), with a row for each
    path on record -> file, kind, destination_path, checksum."""
    from pyspark.sql import Window as W

    place = F.struct("relative_path", "file")
    fresh, old = (written(df.withColumn("root", root_of(F.col("name"))), tag) for df, tag in ((fresh, "fresh"), (old, "taken")))
    claims = written(fresh.groupBy("directory", "root", "name", "checksum").agg(F.first("short").alias("short"), F.min(place).alias("first")), "claims")
    roots = written(clashing_roots(claims), "roots")

    # names that depend on the order of others; dealt by a hash of their own, as Spark takes a union of two joins for dealt by
    # their keys, which it isn't once one of the joins has become a broadcast
    none = F.lit(None).cast("string")
    mine = fresh.select("directory", "root", "name", F.lit(False).alias("existing"), "file", "relative_path", "checksum", "short", none.alias("verified"))
    theirs = old.select("directory", "root", "name", F.lit(True).alias("existing"), none.alias("file"), none.alias("relative_path"), none.alias("checksum"), none.alias("short"), "verified")
    rows = mine.unionByName(theirs).join(roots, ["directory", "root"], "left_semi")
    rows = rows.withColumn("at", F.xxhash64("directory", "root")).repartition("at").sortWithinPartitions("directory", "root", F.desc("existing"), "relative_path", "file")
    ordered = rows.mapInArrow(_in_order, SCHEMA)

    # all others
    free = claims.join(roots, ["directory", "root"], "left_anti")
    owners = free.groupBy("directory", "name").agg(F.min_by("checksum", "first").alias("owner"))
    at_name = old.select("directory", "name", F.col("verified").alias("there"), F.lit(True).alias("taken"))
    free = free.join(owners, ["directory", "name"]).join(at_name, ["directory", "name"], "left")
    same, owns = F.coalesce(F.col("there") == F.col("checksum"), F.lit(False)), F.col("taken").isNull() & (F.col("owner") == F.col("checksum"))
    held = free.filter(same | owns).select("directory", "name", "checksum", "first", F.col("name").alias("to"), same.alias("reused"))
    moved = free.filter(~(same | owns)).select("directory", "name", "checksum", "short", "first")
    # how far a family is taken without a gap, and whether a record before the gap has the content
    family = members_of_families(old).select("directory", F.col("parent").alias("name"), F.col("family").alias("short"), "k", "verified")
    family = moved.select("directory", "name", "checksum", "short").join(family, ["directory", "name", "short"])
    by = ["directory", "name", "checksum"]
    family = family.withColumn("unbroken", F.row_number().over(W.partitionBy(*by).orderBy("k")) == F.col("k"))
    family = family.groupBy(*by).agg(F.count_if("unbroken").alias("full"), F.min(F.when(F.col("unbroken") & (F.col("verified") == F.col("checksum")), F.col("k"))).alias("equal"))
    moved = moved.join(family, by, "left").withColumn("k", F.coalesce("equal", F.col("full") + 1, F.lit(1)))
    suffix = F.when(F.col("k") == 1, F.col("short")).otherwise(F.concat("short", F.lit("-"), F.col("k").cast("string")))
    moved = moved.select(*by, "first", paths.suffix_filename("name", suffix).alias("to"), F.col("equal").isNotNull().alias("reused"))
    found = fresh.join(held.unionByName(moved), by)
    kind = F.when(F.col("reused") | (place != F.col("first")), "reuse").otherwise("new")
    path = F.when(F.col("directory") == "", F.col("to")).otherwise(F.concat("directory", F.lit("/"), "to"))
    return found.select("file", kind.alias("kind"), path.alias("destination_path"), "checksum").unionByName(ordered)


def plan_by_window(files: DataFrame) -> DataFrame:
    """The same for a batch whose suffixed names can't clash with other names: a window over equal destinations. Fails
    where two files come out with one path."""
    from pyspark.sql import Window as W

    same = W.partitionBy("dest")
    turn = F.row_number().over(same.orderBy("relative_path", "file")) - 1
    short = hashing.short_checksum("checksum")
    suffix = F.when(turn == 1, short).when(turn > 1, F.concat(short, F.lit("-"), turn.cast("string")))
    name = F.when(turn == 0, paths.basename("dest")).otherwise(paths.suffix_filename(paths.basename("dest"), suffix))
    out = files.select("file", "checksum", paths.dirname("dest").alias("d"), name.alias("n"))
    out = out.select("file", F.lit("new").alias("kind"), F.concat_ws("/", F.nullif("d", F.lit("")), "n").alias("destination_path"), "checksum")
    clash = F.count(F.lit(1)).over(W.partitionBy("destination_path")) > 1
    return out.select("file", F.lit("new").alias("kind"), F.when(clash, F.raise_error(F.lit("two files plan one path"))).otherwise(F.col("destination_path")).alias("destination_path"), "checksum")


def keep_unique(plan: DataFrame) -> DataFrame:
    """Destinations that more than one file was given; none if the plan is sound."""
    return plan.filter("kind = 'new'").groupBy("destination_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def plan_total_matches(plan_total: int, files: DataFrame) -> DataFrame:
    return files.agg((F.count(F.lit(1)) == plan_total).alias("ok"))
