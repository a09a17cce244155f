"""Catalog tables as keyed delta logs.

A table is a folder of immutable data folders and a log. Each commit is one numbered log file:

  append   rows whose keys are new
  merge    rows by key, which replace those before them, or delete them (`_deleted`)
  compact  buckets written anew, for the deltas up to a version; the table's rows stay as they are
  replace  a whole new table

A base is bucketed by the hash of the key, a folder for each bucket, so that compaction writes only the buckets that deltas
touched and a lookup by key reads one. Readers merge base and deltas: the small side, the newest delta row of each key, is
joined to the base, which isn't shuffled as long as Spark finds the deltas small enough to broadcast by their size.

A commit creates its log file exclusively (a hard link on local file systems, a rename that fails where the target is there
on others), so of two writers one comes first, and the other looks at what came between: appends and disjoint merges follow
on, and a change that was made from rows that have changed since is made again from the new ones (`update`) or fails with
Conflict (`merge` with `parent`, `replace`). Readers keep the version that they began with; files go only in `vacuum`.

Leases are logs too. A lease's token is its version and only grows; a commit that names an older token than one that the
table's log has seen is refused, so a holder that was thought dead can't write after its successor did."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.plans.scratch import sound_unions

ROWS_OF_A_BUCKET, MOST_BUCKETS = 1_000_000, 4096


class Conflict(RuntimeError):
    """Someone else's commit changed what this one was made from."""


@dataclass
class State:
    version: int = 0
    n: int = 16  # buckets of the base
    base: dict[str, str] = field(default_factory=dict)  # bucket -> data folder
    deltas: list[list] = field(default_factory=list)  # [version, append or merge, data folder]
    fences: dict[str, int] = field(default_factory=dict)

    def then(self, version: int, entry: dict) -> State:
        fences = self.fences | {k: max(v, self.fences.get(k, 0)) for k, v in entry.get("fences", {}).items()}
        if "state" in entry:
            s = entry["state"]
            return State(version, s["n"], dict(s["base"]), list(s["deltas"]), fences | s.get("fences", {}))
        return replace(self, version=version, deltas=[*self.deltas, [version, entry["op"], entry["path"]]], fences=fences)

    def saved(self) -> dict:
        return {"n": self.n, "base": self.base, "deltas": self.deltas, "fences": self.fences}


class Store:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 24):
        self.spark, self.root, self.compact_after = sound_unions(spark), root.rstrip("/"), compact_after
        self._entries: dict[tuple[str, int], dict] = {}

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _names(self, folder: str) -> list[str]:
        fs, p, _ = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self, table: str) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/{table}/_log") if n.endswith(".json") and n[:-5].isdigit())

    def _log_file(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/_log/{version:012d}.json"

    def _entry(self, table: str, version: int) -> dict:
        if (table, version) not in self._entries:
            fs, p, jvm = self._fs(self._log_file(table, version))
            stream = fs.open(p)
            try:
                self._entries[table, version] = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._entries[table, version]

    def _commit(self, table: str, version: int, entry: dict) -> bool:
        """Whether this entry became the version; no other entry ever can where one did."""
        final = self._log_file(table, version)
        fs, p, jvm = self._fs(f"{self.root}/{table}/_log/.{uuid.uuid4().hex}.tmp")
        out = fs.create(p, False)
        out.write(json.dumps(entry).encode())
        out.close()
        if fs.getUri().getScheme() == "file":
            here, there = (urllib.parse.unquote(self._fs(x)[1].toUri().getPath()) for x in (str(p.toUri().getPath()), final))
            try:
                os.link(here, there)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(here)
                fs.delete(self._fs(f"{p.getParent().toString()}/.{p.getName()}.crc")[1], False)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(p, self._fs(final)[1], options)
            return True
        except Exception:
            if not fs.exists(self._fs(final)[1]):
                raise
            fs.delete(p, False)
            return False

    def state(self, table: str, version: int | None = None) -> State:
        have = [v for v in self.versions(table) if version is None or v <= version]
        entries = []
        for v in reversed(have):
            entries.append((v, self._entry(table, v)))
            if "state" in entries[-1][1]:
                break
        out = State()
        for v, e in reversed(entries):
            out = out.then(v, e)
        return out

    # rows

    def _fit(self, table: str, rows: DataFrame, *more: str) -> DataFrame:
        fitted = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[table]]
        return rows.select(*fitted, *more)

    def _write(self, table: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        # Spark sizes the files: a row's change is one file, and nothing is squeezed into one task
        rows.hint("rebalance").write.parquet(f"{self.root}/{table}/data/{name}")
        return name

    def _bucket(self, table: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*schemas.KEYS[table]), F.lit(n)).cast("int")

    def _write_base(self, table: str, rows: DataFrame, n: int) -> dict[str, str]:
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket(table, n)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{table}/data/{name}")
        return {k[8:]: f"{name}/{k}" for k in self._names(f"{self.root}/{table}/data/{name}") if k.startswith("_bucket=")}

    def _scan(self, table: str, paths: list[str], *more: str) -> DataFrame:
        schema = schemas.TABLES[table]
        for name in more:
            schema = type(schema)([*schema.fields]).add(name, "boolean")
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/data/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _same(self, keys: list[str]) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return on

    def _rows(self, table: str, s: State, buckets: list[str] | None = None) -> DataFrame:
        keys, columns = schemas.KEYS[table], schemas.TABLES[table].names
        inside = F.lit(True) if buckets is None else self._bucket(table, s.n).isin([int(b) for b in buckets])
        rows = self._scan(table, [p for b, p in s.base.items() if buckets is None or b in buckets]).withColumn("_v", F.lit(0))
        for v, kind, path in s.deltas:
            if kind == "append":
                rows = rows.unionByName(self._scan(table, [path]).filter(inside).withColumn("_v", F.lit(v)))
        merges = [self._scan(table, [path], "_deleted").filter(inside).withColumn("_v", F.lit(v)) for v, kind, path in s.deltas if kind == "merge"]
        if not merges:
            return rows.drop("_v")
        new = merges[0]
        for m in merges[1:]:
            new = new.unionByName(m)
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys], "_deleted"), "_v").alias("r"), F.max("_v").alias("_mv"))
        known = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_mv")
        kept = rows.join(known, self._same(keys), "left").filter("_mv is null or _v > _mv").select(*columns)
        return kept.unionByName(new.filter("not r._deleted").select(*keys, "r.*").select(*columns))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest); its files stay until they are vacuumed."""
        return self._rows(table, self.state(table, version))

    def get(self, table: str, *key) -> DataFrame:
        """The row of a key, from its own bucket and the deltas."""
        s, keys = self.state(table), schemas.KEYS[table]
        one = self.spark.createDataFrame([key], ", ".join(f"{k} {schemas.TABLES[table][k].dataType.simpleString()}" for k in keys))
        bucket = str(one.select(self._bucket(table, s.n)).first()[0])
        match = F.lit(True)
        for k, v in zip(keys, key, strict=True):
            match = match & F.col(k).eqNullSafe(F.lit(v))
        return self._rows(table, s, [bucket]).filter(match)

    # writes

    def _follow(self, table: str, version: int, entry: dict, meets: Callable[[int, dict], None] = lambda v, e: None) -> int:
        """Commit at the first version from `version` on that is free; `meets` may raise for what came between."""
        while True:
            fences = self.state(table, version - 1).fences
            for name, token in entry.get("fences", {}).items():
                if token < fences.get(name, 0):
                    raise Conflict(f"the lease {name} has a newer holder")
            if self._commit(table, version, entry):
                break
            meets(version, self._entry(table, version))
            version += 1
        if entry["op"] in ("append", "merge") and len(self.state(table, version).deltas) >= self.compact_after:
            self.compact(table)
        return version

    def append(self, table: str, rows: DataFrame, fences: dict[str, int] | None = None) -> int:
        path = self._write(table, self._fit(table, rows))
        return self._follow(table, self.state(table).version + 1, {"op": "append", "path": path, "fences": fences or {}})

    def merge(self, table: str, rows: DataFrame, parent: int | None = None, fences: dict[str, int] | None = None) -> int:
        """Rows by key; where `_deleted` is true the key's row goes. parent: the version that rows were made from; if one of
        their keys has changed since, Conflict."""
        gone = F.coalesce(F.col("_deleted"), F.lit(False)) if "_deleted" in rows.columns else F.lit(False)
        path = self._write(table, self._fit(table, rows, gone.alias("_deleted")))

        def meets(version: int, entry: dict) -> None:
            if parent is None or entry["op"] == "compact":
                return
            if entry["op"] == "replace" or self._meet(table, path, entry["path"]):
                self._drop(table, path)
                raise Conflict(f"{table} has changed since version {parent}")

        start = self.state(table).version if parent is None else parent
        return self._follow(table, start + 1, {"op": "merge", "path": path, "fences": fences or {}}, meets)

    def _meet(self, table: str, a: str, b: str) -> bool:
        keys = schemas.KEYS[table]
        theirs = self._scan(table, [b]).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        return not self._scan(table, [a]).join(theirs, self._same(keys), "left_semi").isEmpty()

    def update(self, table: str, make: Callable[[DataFrame], DataFrame], tries: int = 20, fences: dict[str, int] | None = None) -> int:
        """Merge make(table), made again from the newer table where one of its rows was changed meanwhile."""
        for _ in range(tries):
            s = self.state(table)
            try:
                return self.merge(table, make(self._rows(table, s)), s.version, fences)
            except Conflict as e:
                if "newer holder" in str(e):
                    raise
        raise Conflict(f"{table} changed {tries} times meanwhile")

    def replace(self, table: str, rows: DataFrame) -> int:
        """A whole new table, unless someone else commits meanwhile."""
        s = self.state(table)
        n = self._size(rows)
        new = State(s.version + 1, n, self._write_base(table, self._fit(table, rows), n), [], s.fences)
        if not self._commit(table, new.version, {"op": "replace", "state": new.saved()}):
            raise Conflict(f"{table} has changed since version {s.version}")
        return new.version

    @staticmethod
    def _size(rows: DataFrame) -> int:
        return min(MOST_BUCKETS, max(16, -(-rows.count() // ROWS_OF_A_BUCKET)))

    def compact(self, table: str) -> int | None:
        """Write the buckets anew that deltas touch. Commits that come meanwhile stay deltas of the new base."""
        s = self.state(table)
        if not s.deltas:
            return None
        if s.base:
            keys = schemas.KEYS[table]
            touched = self._scan(table, [p for _, _, p in s.deltas]).select(*keys).select(self._bucket(table, s.n).alias("b")).distinct()
            buckets, n = [str(r["b"]) for r in touched.collect()], s.n  # at most as many as there are buckets
        else:
            buckets, n = None, self._size(self._rows(table, s))
        base = self._write_base(table, self._rows(table, s, buckets), n)
        kept = {b: p for b, p in s.base.items() if buckets is not None and b not in buckets}
        version = s.version + 1
        while True:
            now = self.state(table, version - 1)
            later = [d for d in now.deltas if d[0] > s.version]
            new = State(version, n, kept | base, later, now.fences)
            if self._commit(table, version, {"op": "compact", "state": new.saved()}):
                return version
            if self._entry(table, version)["op"] in ("compact", "replace"):
                return None  # someone else did it
            version += 1

    def vacuum(self, table: str, keep: int = 10, older_than_s: float = 86_400) -> int:
        """Delete data that none of the last `keep` versions reads and that is older than a writer can take."""
        used = set()
        for v in self.versions(table)[-keep:]:
            s = self.state(table, v)
            used |= {p.split("/")[0] for p in s.base.values()} | {d[2] for d in s.deltas}
        fs, p, _ = self._fs(f"{self.root}/{table}/data")
        old = [x.getPath() for x in (fs.listStatus(p) if fs.exists(p) else []) if x.getPath().getName() not in used and x.getModificationTime() / 1000 < time.time() - older_than_s]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _drop(self, table: str, path: str) -> None:
        fs, p, _ = self._fs(f"{self.root}/{table}/data/{path}")
        fs.delete(p, True)

    # leases

    def acquire(self, name: str, holder: str, ttl_ms: int, now_ms: int | None = None) -> int | None:
        """The token of a lease that is free, expired or one's own already; None while another holds it."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        log = f"_leases/{name}"
        last = max(self.versions(log), default=0)
        held = self._entry(log, last) if last else {"holder": None, "until": 0}
        if held["holder"] not in (None, holder) and held["until"] > now_ms:
            return None
        return last + 1 if self._commit(log, last + 1, {"holder": holder, "until": now_ms + ttl_ms}) else None

    def release(self, name: str, holder: str) -> None:
        """Give up one's own lease; another's stays."""
        log = f"_leases/{name}"
        last = max(self.versions(log), default=0)
        if last and self._entry(log, last)["holder"] == holder:
            self._commit(log, last + 1, {"holder": None, "until": 0})
