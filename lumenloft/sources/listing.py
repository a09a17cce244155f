"""Media scan as a Spark data source.

A scan of a root is dealt to many tasks. A first, shallow pass on the driver opens the largest folders until there are enough
subtrees; a task walks some of them, and a folder with very many entries is dealt in slices of its names. Filters on
relative_path (a prefix, exact paths) and extension are pushed into the source: a prefix starts the walk below it, exact
paths are looked up without any walk, and names with other extensions aren't stat'ed.

`walk` is the sequential form, which defines the result: entries in order of folded key, key and path, each one counted,
and nothing read beyond the bound. `scan_media` gives the same rows. Where the bound is passed, it finds the entry at the
bound by name only and cuts there, with an ENTRY_LIMIT_REACHED row; the bound is a stated limit, never a silent miss.
Where links are followed, what is seen first decides what is seen at all, so such a root is walked by one task.

Spark's own file sources would drop names that start with `_` or `.`, which cameras write."""

from __future__ import annotations

import datetime
import hashlib
import heapq
import os
import stat
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

from lumenloft import schemas

#: Extensions and folder names of a default scan, and its bounds.
EXTENSIONS = ".3gp .arw .avi .cr2 .cr3 .dng .heic .heif .jpeg .jpg .m2ts .m4v .mkv .mov .mp4 .mpeg .mpg .mts .nef .orf .pef .png .raf .raw .rw2 .srw .tif .tiff .webm".split()
EXCLUDED = (".fseventsd", ".spotlight-v100", ".temporaryitems", ".trashes", "$recycle.bin", "system volume information")
MAX_DEPTH, MAX_ENTRIES = 64, 100_000


def fold(name: str) -> str:
    return unicodedata.normalize("NFC", name).lower()


def _iso(seconds: float) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{int(seconds * 1000) % 1000:03d}Z"


def walk(root: str, extensions=EXTENSIONS, excluded=EXCLUDED, hidden: bool = False, follow: bool = False, max_depth: int = MAX_DEPTH, max_entries: int = MAX_ENTRIES) -> Iterator[tuple]:
    """(type, file, error) rows in order of folded key, key and path. Entries that can't be read are error rows."""
    wanted = {("." + e.strip().lstrip(".")).lower() for e in extensions}
    banned = {fold(e) for e in excluded}
    top = os.path.realpath(root)
    heap: list[tuple[str, str, str, int]] = []
    seen: set[tuple[int, int]] = set()
    entries = 0

    def error(code, path, message):
        return ("error", None, (code, path, message))

    def open_folder(path: str, depth: int) -> Iterator[tuple]:
        nonlocal entries
        full = os.path.join(top, *path.split("/")) if path else top
        try:
            facts = os.stat(full)
            if (facts.st_dev, facts.st_ino) in seen:
                return
            seen.add((facts.st_dev, facts.st_ino))
            names = os.listdir(full)
        except OSError as e:
            yield error("DIRECTORY_UNREADABLE", path, type(e).__name__)
            return
        for name in names:
            at = f"{path}/{name}" if path else name
            key = "/".join(unicodedata.normalize("NFC", s) for s in at.split("/"))
            heapq.heappush(heap, (key.lower(), key, at, depth + 1))

    yield from open_folder("", 0)
    while heap:
        _, key, path, depth = heapq.heappop(heap)
        entries += 1
        if entries > max_entries:
            yield error("ENTRY_LIMIT_REACHED", path, f"more than {max_entries} entries")
            return
        name = path.rsplit("/", 1)[-1]
        if not hidden and name.startswith("."):
            continue
        full = os.path.join(top, *path.split("/"))
        try:
            facts = os.lstat(full)
            if stat.S_ISLNK(facts.st_mode):
                if fold(name) in banned or not follow:
                    continue
                target = os.path.realpath(full)
                if target != top and not target.startswith(top + os.sep):
                    yield error("SYMLINK_OUTSIDE_ROOT", path, "the link leaves the root")
                    continue
                facts = os.stat(full)
        except OSError as e:
            yield error("ENTRY_UNREADABLE", path, type(e).__name__)
            continue
        if stat.S_ISDIR(facts.st_mode):
            if fold(name) in banned:
                continue
            if depth > max_depth:
                yield error("DEPTH_LIMIT_REACHED", path, f"deeper than {max_depth} folders")
                continue
            yield from open_folder(path, depth)
        elif stat.S_ISREG(facts.st_mode):
            ext = os.path.splitext(name)[1].lower()
            if ext in wanted:
                yield ("file", (path, key, name, ext, facts.st_size, _iso(facts.st_mtime), f"{facts.st_dev}:{facts.st_ino}"), None)


FLAT = "root string, type string, relative_path string, canonical_path_key string, name string, extension string, size_bytes long, modified_at string, file_id string, code string, message string"
SLICE = 20_000  # a folder with more entries is dealt in slices


def path_key(path: str) -> str:
    return "/".join(unicodedata.normalize("NFC", s) for s in path.split("/"))


@dataclass
class Rules:
    """What a scan keeps, without its order and its bound."""

    wanted: frozenset[str]
    banned: frozenset[str]
    hidden: bool = False
    max_depth: int = MAX_DEPTH
    names_only: bool = False  # every entry by name, for counting

    @classmethod
    def of(cls, options) -> Rules:
        listed = lambda k, d: options[k].split(",") if options.get(k) else d
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        wanted = frozenset(("." + e.strip().lstrip(".")).lower() for e in listed("extensions", EXTENSIONS))
        return cls(wanted, frozenset(fold(e) for e in listed("excluded", EXCLUDED)), flag("hidden"), int(options.get("max_depth", MAX_DEPTH)), flag("names_only"))

    def enters(self, name: str) -> bool:
        return (self.hidden or not name.startswith(".")) and fold(name) not in self.banned

    def keeps(self, name: str) -> bool:
        return (self.hidden or not name.startswith(".")) and os.path.splitext(name)[1].lower() in self.wanted


@dataclass
class Unit:
    """Work of one task: a subtree, the direct entries of one folder (a slice of them), exact paths, or a whole root in order."""

    kind: str  # tree, folder, paths, walk
    root: str
    path: str = ""
    depth: int = 0
    slice: int = 0
    slices: int = 1
    paths: list[str] = field(default_factory=list)
    weight: int = 1


class _Part(InputPartition):
    def __init__(self, units: list[Unit]):
        super().__init__(0)
        self.units = units


def _full(root: str, path: str) -> str:
    return os.path.join(root, *path.split("/")) if path else root


def file_row(root: str, path: str, facts: os.stat_result) -> tuple:
    name = path.rsplit("/", 1)[-1]
    return (root, "file", path, path_key(path), name, os.path.splitext(name)[1].lower(), facts.st_size, _iso(facts.st_mtime), f"{facts.st_dev}:{facts.st_ino}", None, None)


def error_row(root: str, code: str, path: str, message: str) -> tuple:
    return (root, "error", path, path_key(path), None, None, None, None, None, code, message)


def name_row(root: str, path: str) -> tuple:
    return (root, "name", path, path_key(path), *[None] * 7)


def entries(unit: Unit, rules: Rules) -> Iterator[tuple]:
    """Rows of a subtree or of one folder, in no order. Links aren't followed."""
    todo = [(unit.path, unit.depth)]
    while todo:
        path, depth = todo.pop()
        try:
            with os.scandir(_full(unit.root, path)) as found:
                found = list(found)
        except OSError as e:
            if not rules.names_only and unit.slice == 0:
                yield error_row(unit.root, "DIRECTORY_UNREADABLE", path, type(e).__name__)
            continue
        for entry in found:
            if unit.slices > 1 and zlib.crc32(os.fsencode(entry.name)) % unit.slices != unit.slice:
                continue
            at = f"{path}/{entry.name}" if path else entry.name
            if rules.names_only:
                yield name_row(unit.root, at)
            if not rules.hidden and entry.name.startswith("."):
                continue
            try:
                if entry.is_symlink():
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if not rules.enters(entry.name):
                        continue
                    if depth + 1 > rules.max_depth:
                        if not rules.names_only:
                            yield error_row(unit.root, "DEPTH_LIMIT_REACHED", at, f"deeper than {rules.max_depth} folders")
                    elif unit.kind == "tree":
                        todo.append((at, depth + 1))
                elif not rules.names_only and rules.keeps(entry.name) and stat.S_ISREG((facts := entry.stat(follow_symlinks=False)).st_mode):
                    yield file_row(unit.root, at, facts)
            except OSError as e:
                if not rules.names_only:
                    yield error_row(unit.root, "ENTRY_UNREADABLE", at, type(e).__name__)


def looked_at(unit: Unit, rules: Rules) -> Iterator[tuple]:
    """Rows of exact paths, if a walk would have met them."""
    open_: dict[str, bool] = {"": True}

    def folder(path: str) -> bool:
        if path not in open_:
            above, _, name = path.rpartition("/")
            try:
                open_[path] = folder(above) and rules.enters(name) and stat.S_ISDIR(os.lstat(_full(unit.root, path)).st_mode)
            except OSError:
                open_[path] = False
        return open_[path]

    for path in unit.paths:
        above, _, name = path.rpartition("/")
        parts = path.split("/")
        if "" in parts or "." in parts or ".." in parts or len(parts) > rules.max_depth + 1 or not rules.keeps(name) or not folder(above):
            continue
        try:
            facts = os.lstat(_full(unit.root, path))
        except FileNotFoundError:
            continue
        except OSError as e:
            yield error_row(unit.root, "ENTRY_UNREADABLE", path, type(e).__name__)
            continue
        if stat.S_ISREG(facts.st_mode):
            yield file_row(unit.root, path, facts)


def units_of(root: str, rules: Rules, parts: int, below: str = "") -> list[Unit]:
    """The shallow pass: at most about 4 * parts folders are opened, the ones with most folders in them first."""
    out: list[Unit] = []

    def look(path: str, depth: int) -> tuple[int, int, str, int, list[str]]:
        try:
            with os.scandir(_full(root, path)) as found:
                names = [(e.name, e.is_dir(follow_symlinks=False)) for e in found]
        except OSError:
            return 0, 1, path, depth, []
        inside = [n for n, is_dir in names if is_dir and rules.enters(n)] if depth < rules.max_depth else []
        return -len(inside), len(names), path, depth, inside

    heap = [look(below, below.count("/") + 1 if below else 0)]
    for _ in range(4 * parts):
        if len(heap) >= 4 * parts or not heap or not heap[0][4]:
            break
        _, n, path, depth, inside = heapq.heappop(heap)
        slices = max(1, -(-n // SLICE))
        out += [Unit("folder", root, path, depth, i, slices, weight=-(-n // slices)) for i in range(slices)]
        for name in inside:
            heapq.heappush(heap, look(f"{path}/{name}" if path else name, depth + 1))
    for _, n, path, depth, inside in heap:
        slices = 1 if inside else max(1, -(-n // SLICE))  # what lies below isn't known, so a subtree weighs its folders too
        out += [Unit("folder" if not inside else "tree", root, path, depth, i, slices, weight=-(-n // slices) * (1 + len(inside))) for i in range(slices)]
    return out


def packed(units: list[Unit], parts: int) -> list[list[Unit]]:
    """Units to at most `parts` lots, the heaviest first, each to the lightest lot."""
    lots: list[tuple[int, int, list[Unit]]] = [(0, i, []) for i in range(max(1, min(parts, len(units))))]
    for u in sorted(units, key=lambda u: -u.weight):
        weight, i, held = heapq.heappop(lots)
        heapq.heappush(lots, (weight + u.weight + 1, i, [*held, u]))
    return [held for _, _, held in lots if held]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.paths, self.prefix, self.extensions = options, None, "", None

    def pushFilters(self, filters):
        """All are handed back as well: what is pushed spares work, Spark decides on the rows."""
        for f in filters:
            values = {EqualTo: lambda f: {f.value}, In: lambda f: set(f.value)}.get(type(f), lambda f: None)(f)
            if f.attribute == ("relative_path",) and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif f.attribute == ("relative_path",) and isinstance(f, StringStartsWith):
                self.prefix = max(self.prefix, f.value, key=len)
            elif f.attribute == ("extension",) and values is not None:
                self.extensions = values if self.extensions is None else self.extensions & values
            yield f

    def rules(self) -> Rules:
        rules = Rules.of(self.options)
        if self.extensions is not None:
            rules.wanted &= frozenset(self.extensions)
        return rules

    def partitions(self):
        rules, parts = self.rules(), int(self.options.get("parts", 64))
        units: list[Unit] = []
        for root in self.options["path"].split(os.pathsep):
            top = os.path.realpath(root)
            if str(self.options.get("follow", "false")).lower() == "true":
                units.append(Unit("walk", top))
            elif self.paths is not None:
                found = sorted(p for p in self.paths if p is not None)
                lots = max(1, min(parts, len(found) // 100))
                units += [Unit("paths", top, paths=found[i::lots], weight=len(found[i::lots])) for i in range(lots)]
            else:
                below = self.prefix.rpartition("/")[0]
                inside = not below or all(rules.enters(n) and n not in ("", ".", "..") for n in below.split("/"))
                if inside and os.path.realpath(_full(top, below)) == _full(top, below) and below.count("/") + bool(below) <= rules.max_depth:
                    units += units_of(top, rules, parts, below)
        return [_Part(lot) for lot in packed(units, parts)] if units else [_Part([])]

    def read(self, partition):
        rules = self.rules()
        for unit in partition.units:
            if unit.kind == "walk":
                yield from self._walk(unit, rules)
            else:
                yield from looked_at(unit, rules) if unit.kind == "paths" else entries(unit, rules)

    def _walk(self, unit: Unit, rules: Rules):
        for kind, file, error in walk(unit.root, rules.wanted, rules.banned, rules.hidden, True, rules.max_depth, int(self.options.get("max_entries", MAX_ENTRIES))):
            if kind == "file":
                yield (unit.root, kind, *file, None, None)
            else:
                code, path, message = error
                yield error_row(unit.root, code, path, message)


class MediaListing(DataSource):
    """spark.read.format("media_listing").load(path): flat rows of files and errors, without a bound."""

    @classmethod
    def name(cls):
        return "media_listing"

    def schema(self):
        return FLAT

    def reader(self, schema):
        return _Reader(self.options)


def list_media(spark: SparkSession, *roots: str, **options) -> DataFrame:
    """The flat rows, in no order and without a bound; filters on relative_path and extension reach the walk."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaListing)
    r = spark.read.format("media_listing")
    for k, v in options.items():
        r = r.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v))
    return r.load(os.pathsep.join(roots))


def _place() -> list:
    return [F.lower("canonical_path_key").alias("folded"), F.col("canonical_path_key"), F.col("relative_path")]


def bounded(spark: SparkSession, rows: DataFrame, roots: tuple[str, ...], max_entries: int, **options) -> DataFrame:
    """rows up to the entry bound of each root in the order of the walk, and a row for each root that is cut.

    The names are counted first. Only where they pass the bound is the entry at the bound looked for, by a top-k whose size
    is the bound."""
    names = list_media(spark, *roots, **options, names_only="true")
    over = [r["root"] for r in names.groupBy("root").count().filter(F.col("count") > max_entries).collect()]
    for root in over:
        cut = names.filter(F.col("root") == root).select(*_place()).orderBy("folded", "canonical_path_key", "relative_path").offset(max_entries).limit(1).first()
        before = F.struct(*_place()) < F.struct(*[F.lit(v).alias(k) for k, v in cut.asDict().items()])
        told = spark.createDataFrame([error_row(root, "ENTRY_LIMIT_REACHED", cut["relative_path"], f"more than {max_entries} entries")], FLAT)
        rows = rows.filter((F.col("root") != root) | before).unionByName(told)
    return rows


def scan_media(spark: SparkSession, *roots: str, max_entries: int = MAX_ENTRIES, ordered: bool = True, **options) -> DataFrame:
    """type, file, error of the entries of the roots in the order of the walk; options as for `walk`, lists comma-separated.

    max_entries: the bound of each root, 0 for none. Errors name the entry that they are about."""
    follow = str(options.get("follow", "false")).lower() == "true"
    more = {"max_entries": max_entries or 1 << 62} if follow else {}
    rows = list_media(spark, *roots, **options, **more)
    if max_entries and not follow:
        rows = bounded(spark, rows, roots, max_entries, **options)
    if ordered:
        rows = rows.orderBy("root", F.lower("canonical_path_key"), "canonical_path_key", "relative_path")
    fields = [f.name for f in schemas.SCAN_FILE]
    file = F.when(F.col("type") == "file", F.struct(*[F.col(n) for n in fields])).cast(schemas.SCAN_FILE)
    error = F.when(F.col("type") == "error", F.struct("code", "relative_path", "message")).cast(schemas.SCAN_ERROR)
    return rows.select("type", file.alias("file"), error.alias("error"))


def files_of(scan: DataFrame) -> DataFrame:
    return scan.filter("type = 'file'").select("file.*")


def errors_of(scan: DataFrame) -> DataFrame:
    return scan.filter("type = 'error'").select("error.*")


def filter_listing(listing: DataFrame, extensions=EXTENSIONS, excluded=EXCLUDED, hidden: bool = False) -> DataFrame:
    """The same filters over a listing that is already a table (relative_path, extension)."""
    parts = F.split("relative_path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ok = F.lower("extension").isin([e.lower() for e in extensions]) & ~F.exists(folders, lambda s: F.lower(s).isin([fold(e) for e in excluded]))
    return listing.filter(ok if hidden else ok & ~F.exists(parts, lambda s: s.startswith(".")))


def read_contents(spark: SparkSession, root: str, paths: DataFrame, chunk: int = 256 * 1024) -> DataFrame:
    """relative_path, offset, content of the named files in pieces, so that no file must fit in a row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p in b["relative_path"].to_pylist():
                with open(os.path.join(root, *p.split("/")), "rb") as f:
                    at = 0
                    while piece := f.read(chunk):
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([at], pa.int64()), pa.array([piece], pa.binary())], ["relative_path", "offset", "content"])
                        at += len(piece)

    return paths.select("relative_path").mapInArrow(run, "relative_path string, offset long, content binary")


def hash_files(spark: SparkSession, root: str, paths: DataFrame, chunk: int = 256 * 1024) -> DataFrame:
    """relative_path, sha256, size_bytes, read once in pieces; only for files that need a full checksum."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            names, sums, sizes = b["relative_path"].to_pylist(), [], []
            for p in names:
                h, n = hashlib.sha256(), 0
                with open(os.path.join(root, *p.split("/")), "rb") as f:
                    while piece := f.read(chunk):
                        h.update(piece)
                        n += len(piece)
                sums.append(h.hexdigest())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], ["relative_path", "sha256", "size_bytes"])

    return paths.select("relative_path").mapInArrow(run, "relative_path string, sha256 string, size_bytes long")


LOOKED_UP = "relative_path string, state string, size_bytes long, sha256 string"


def owned_file(root: str, path: str) -> tuple[str, os.stat_result | None]:
    """state and facts of a path below a root: `file`, `missing`, or `refused` where it leaves the root, a link stands in the
    way or it isn't a regular file."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        return "refused", None
    full = root
    for i, name in enumerate(parts):
        full = os.path.join(full, name)
        try:
            facts = os.lstat(full)
        except (FileNotFoundError, NotADirectoryError):
            return "missing", None
        if stat.S_ISDIR(facts.st_mode) if i < len(parts) - 1 else stat.S_ISREG(facts.st_mode):
            continue
        return "refused", None
    return "file", facts


def lookup_files(spark: SparkSession, root: str, paths: DataFrame, chunk: int = 256 * 1024) -> DataFrame:
    """paths(relative_path, hash_if_size) -> relative_path, state (file, missing, refused), size_bytes, sha256 (of files that
    have the size given, else null).

    Only these paths are looked at, in tasks, whatever their extension and however much else the root holds."""
    top = os.path.realpath(root)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for path, size in zip(b["relative_path"].to_pylist(), b["hash_if_size"].to_pylist(), strict=True):
                state, facts = owned_file(top, path)
                digest = None
                if facts is not None and size == facts.st_size:
                    with open(os.path.join(top, *path.split("/")), "rb") as f:
                        h = hashlib.sha256()
                        while piece := f.read(chunk):
                            h.update(piece)
                    digest = h.hexdigest()
                out.append((path, state, facts and facts.st_size, digest))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["relative_path", "state", "size_bytes", "sha256"])

    dealt = paths.select("relative_path", F.col("hash_if_size").cast("long")).repartition("relative_path")
    return dealt.mapInArrow(run, LOOKED_UP)
