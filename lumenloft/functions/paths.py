"""Path and naming functions. Each takes and returns Columns unless it says otherwise.

Unicode normalisation has no JVM function, so the NFC forms are Arrow-batched pandas UDFs; `nfc` skips nothing but costs a
Python hop, so callers whose paths are ASCII pass `unicode=False`."""

from __future__ import annotations

import datetime
import posixpath
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloft.functions.core import col

#: Tokens of naming templates.
TOKENS = ("YYYY", "YYYY-MM-DD", "sourceLabelOrCamera", "nickname", "originalFilename")
DEFAULT_TEMPLATE = "{YYYY}/{YYYY-MM-DD}/{sourceLabelOrCamera}/{originalFilename}"
MAX_OUTPUT, MAX_SEGMENT = 1024, 255
TOKEN = re.compile(r"\{([^{}]+)\}")
#: Device names that no file may have; ports have a number from 1 to 9.
DEVICES, PORTS = ("con", "prn", "aux", "nul"), ("com", "lpt")
RESERVED = "(?i)^((?:" + "|".join([*DEVICES, *[p + "[1-9]" for p in PORTS]]) + r")(?:\.|\z))"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _relative(value: str, flavor: str) -> str | None:
    if not value or "\0" in value:
        return None
    p = value.replace("\\", "/") if flavor == "windows" else value
    if p.startswith("/") or (flavor == "windows" and re.match(r"[A-Za-z]:", p)):
        return None
    out = posixpath.normpath(p)
    if p.endswith("/") and out != ".":
        out += "/"
    return None if out in ("..", "../") or out.startswith("../") or out == "." else out


def normalize_relative_path(path, flavor: str = "canonical") -> Column:
    """A source-relative path in POSIX form; null where it is absolute, empty or leaves its root. `windows` reads
    backslashes as separators, other flavors keep them as characters."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _relative(x, flavor), na_action="ignore")

    return run(col(path))


def canonical_path_key(path, flavor: str = "canonical") -> Column:
    """The normalised path with every segment in NFC."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if (p := _relative(x, flavor)) is None else "/".join(unicodedata.normalize("NFC", g) for g in p.split("/")), na_action="ignore")

    return run(col(path))


def segments(path) -> Column:
    return F.split(col(path), "/")


def join_segments(parts) -> Column:
    return F.array_join(col(parts), "/")


def basename(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def dirname(path) -> Column:
    return F.regexp_replace(col(path), "/?[^/]*$", "")


def extname(name) -> Column:
    """Lower-case extension with its dot; names that start with their only dot have none."""
    return F.lower(F.regexp_extract(basename(name), r"[^.](\.[^.]*)$", 1))


def stem(name) -> Column:
    base = basename(name)
    return F.substring(base, 1, F.length(base) - F.length(extname(base)))


def sanitize_segment(value, platform: str = "win32", unicode: bool = True) -> Column:
    """A file or folder name that the platform accepts; never empty, a dot name or a reserved name."""
    v = nfc(col(value)) if unicode else col(value)
    v = F.regexp_replace(v, r'[/\x00-\x1F<>:"|?*\\]' if platform == "win32" else r"[/\x00]", "_")
    if platform == "win32":
        v = F.regexp_replace(v, r"[. ]+$", "")
    # replacements in place of CASE: the value stands in the expression once, so plans stay small
    v = F.regexp_replace(v, r"^\.{0,2}\z", "_")
    return F.regexp_replace(v, RESERVED, "_$1") if platform == "win32" else v


def suffix_filename(name, suffix) -> Column:
    """name-suffix.ext, with the extension's case kept."""
    n = col(name)
    ext = F.regexp_extract(n, r"[^.](\.[^.]*)$", 1)
    return F.concat(F.substring(n, F.lit(1), F.length(n) - F.length(ext)), F.lit("-"), col(suffix), ext)


def is_safe_relative(path) -> Column:
    """Relative, without traversal, NUL or empty name."""
    p = col(path)
    return p.isNotNull() & (p != "") & ~p.rlike(r"^(?:[/\\]|[A-Za-z]:[/\\])|\x00") & ~F.exists(F.split(p, r"[/\\]"), lambda s: s == "..")


def under_root(path, root) -> Column:
    p, r = col(path), F.regexp_replace(col(root), "/+$", "")
    return (p == r) | (p.startswith(F.concat(r, F.lit("/"))) & ~F.exists(F.split(p, "/"), lambda s: s == ".."))


def temp_path(destination, session, copy) -> Column:
    """.<name>.<session>.<copy>.tmp beside the destination."""
    d = dirname(destination)
    name = F.concat(F.lit("."), basename(destination), F.lit("."), col(session), F.lit("."), col(copy), F.lit(".tmp"))
    return F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))


def normalize_extension(value) -> Column:
    """.ext in lower case; null where it isn't a plain extension."""
    v = F.concat(F.lit("."), F.lower(F.regexp_replace(F.trim(col(value)), r"^\.", "")))
    return F.when(v.rlike(r"^\.[a-z0-9]+$"), v)


def normalize_exclusion(value) -> Column:
    """A trimmed exclusion of 1 to 512 characters; null where it is absolute or traverses."""
    v = F.trim(col(value))
    bad = v.rlike(r"^(?:[\\/]|[A-Za-z]:[\\/])") | F.exists(F.split(v, r"[\\/]"), lambda s: s.isin("..", "."))
    return F.when(F.length(v).between(1, 512) & ~bad, v)


# templates are parameters, so they are checked and compiled on the driver


def parse_template(template: str) -> list[list[tuple[str, str]]]:
    """A template's segments, each a list of (kind, text): `token`, `text`, or `stray` for a brace that makes no token."""
    out: list[list[tuple[str, str]]] = [[]]
    at = 0
    while at < len(template):
        if template[at] == "/":
            out.append([])
            at += 1
        elif m := TOKEN.match(template, at):
            out[-1].append(("token", m[1]))
            at = m.end()
        elif template[at] in "{}":
            out[-1].append(("stray", template[at]))
            at += 1
        else:
            end = next((i for i in range(at, len(template)) if template[i] in "/{}"), len(template))
            out[-1].append(("text", template[at:end]))
            at = end
    return out


#: What may be wrong: of a whole template (its text and its segments), of one of its segments, of one of their parts.
WHOLE = {
    "empty template": lambda text, parsed: not text.strip(),
    "template is absolute": lambda text, parsed: text[:1] in ("/", "\\") or text[:1].isalpha() and text[1:3] in (":/", ":\\"),
    "template needs originalFilename exactly once": lambda text, parsed: sum(p == ("token", "originalFilename") for part in parsed for p in part) != 1,
}
SEGMENT = {"empty path segment": lambda part: all(kind == "text" and not text.strip() for kind, text in part), "traversal segment": lambda part: part in ([("text", ".")], [("text", "..")])}
PART = {"template uses backslashes": lambda kind, text: "\\" in text, "unknown token {}": lambda kind, text: kind == "token" and text not in TOKENS, "broken token expression": lambda kind, text: kind == "stray"}


def validate_template(template: str) -> list[str]:
    """Problems of a template, each once; none if it is valid."""
    parsed = parse_template(template)
    found = [name for name, wrong in WHOLE.items() if wrong(template, parsed)]
    for part in parsed:
        found += [name for name, wrong in SEGMENT.items() if wrong(part)]
        found += [name.format(text) for kind, text in part for name, wrong in PART.items() if wrong(kind, text)]
    return list(dict.fromkeys(found))


def compile_template(template: str, capture_day, label, filename, nickname=None, platform: str = "win32", unicode: bool = True) -> Column:
    """The relative destination of a template as one Column; null where the day isn't a calendar day, a segment has over
    255 bytes or the whole over 1,024 UTF-16 units. The nickname falls back to the label."""
    if problems := validate_template(template):
        raise ValueError("; ".join(problems))
    day = col(capture_day)
    values = {"YYYY": F.substring(day, 1, 4), "YYYY-MM-DD": day, "sourceLabelOrCamera": col(label), "nickname": F.coalesce(col(nickname), col(label)) if nickname is not None else col(label), "originalFilename": col(filename)}
    parts = []
    for part in parse_template(template):
        parts.append(sanitize_segment(F.concat(*[values[text] if kind == "token" else F.lit(text) for kind, text in part]), platform, unicode))
    out = F.concat_ws("/", *parts)
    units = F.length(out) + F.length(F.regexp_replace(out, r"[\x{0}-\x{FFFF}]+", ""))
    ok = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False)) & (units <= MAX_OUTPUT)
    for p in parts:
        ok &= F.coalesce(F.octet_length(p) <= MAX_SEGMENT, F.lit(False))
    return F.when(ok, out)


def valid_day(day: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", day)) and bool(datetime.date.fromisoformat(day))
    except ValueError:
        return False
