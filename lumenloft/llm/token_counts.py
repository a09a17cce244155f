"""Token counts by offset-mapped attribution.

A whole document is encoded once. Byte-level BPE tokens are byte strings whose concatenation is the document, so their
running lengths are their spans. Spans are interval-joined with the sections (or fields) of the document by binary
search, and a token that crosses a boundary is allocated by a named rule:

  start     to the section that holds its first byte (the default)
  end       to the section that holds its last byte
  majority  to the section that holds most of its bytes, the first of them on a tie
  split     in shares of its bytes to each

Sections of a text are its lines with their line breaks; empty ones at the end aren't sections. Null texts count as empty
and have no sections; null ids stay null. Empty fields take no tokens. Texts of any length are encoded whole. Repeated
rows and other columns change nothing; an empty table gives an empty result."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

RULES = ("start", "end", "majority", "split")
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The ranks file's bytes and the pattern that splits texts; read on the driver and shipped to the executors."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(raw: bytes, pattern: str):
    """The encoding and each token's length in bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    length[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length


def attribute(stops: np.ndarray, ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary. stops, ends: where tokens and sections end, in bytes."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    first = np.searchsorted(ends, starts, side="right")
    last = np.searchsorted(ends, np.maximum(stops - 1, starts), side="right")
    crossing = np.flatnonzero(last != first)
    n = len(ends)
    if rule == "start":
        return np.bincount(first, minlength=n), len(crossing)
    if rule == "end":
        return np.bincount(last, minlength=n), len(crossing)
    whole = np.ones(len(stops), bool)
    whole[crossing] = False
    out = np.bincount(first[whole], minlength=n).astype(float)
    for t in crossing.tolist():  # a token is a few bytes, so it crosses few boundaries
        parts = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[parts], stops[t]) - np.maximum(np.concatenate([[0], ends])[parts], starts[t])
        if rule == "split":
            out[parts] += share / share.sum()
        else:
            out[parts[share.argmax()]] += 1
    return (out if rule == "split" else out.astype(np.int64)), len(crossing)


def encode(text: str, tool) -> np.ndarray:
    """Where each token ends, in bytes of the text."""
    enc, length = tool
    return np.cumsum(length[enc.encode_to_numpy(text, disallowed_special=())]) if text else np.zeros(0, np.int64)


def section_tokens(docs: DataFrame, rule: str = "start", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, and arrays of the sections' ends (code points) and tokens."""
    raw, pattern = vocabulary(path)
    kind = pa.float64() if rule == "split" else pa.int64()
    names = ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_ends", "section_tokens"]

    def run(batches):
        tool = encoder(raw, pattern)
        for b in batches:
            for c in pieces(b, "text", 8 << 20):
                rows = []
                for t in c["text"].to_pylist():
                    data = np.frombuffer((t or "").encode(), np.uint8)
                    stops = encode(t or "", tool)
                    ends = np.flatnonzero(data == 10) + 1
                    if len(data) and (not len(ends) or ends[-1] != len(data)):
                        ends = np.append(ends, len(data))
                    counts, crossing = attribute(stops, ends, rule)
                    chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1] if len(ends) else ends
                    rows.append((len(stops), len(ends), crossing, chars, counts))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([c["doc_id"], *[pa.array(v, pa.int64()) for v in cols[:3]], pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(kind))], names)

    df = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return df.mapInArrow(run, f"doc_id long, n_tokens long, n_sections long, n_crossing long, section_ends array<long>, section_tokens array<{'double' if rule == 'split' else 'long'}>")


def field_tokens(df: DataFrame, id_column: str, fields: list[str], separator: str = "\n\n", rule: str = "start", path: str | None = None) -> DataFrame:
    """The fields of a row joined by a separator and encoded once: id, n_tokens, and one column of tokens for each field.
    A separator counts to the field before it."""
    raw, pattern = vocabulary(path)
    number = "double" if rule == "split" else "long"
    names = [id_column, "n_tokens", *[f"{f}_tokens" for f in fields]]

    def run(batches):
        tool = encoder(raw, pattern)
        for b in batches:
            rows = []
            for i, *texts in zip(*[b[c].to_pylist() for c in [id_column, *fields]], strict=True):
                parts = [(t or "") + (separator if k < len(fields) - 1 else "") for k, t in enumerate(texts)]
                stops = encode("".join(parts), tool)
                ends = np.cumsum([len(p.encode()) for p in parts])
                rows.append((i, len(stops), *attribute(stops, ends, rule)[0].tolist()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b[id_column].type), pa.array(cols[1], pa.int64()), *[pa.array(v, pa.float64() if rule == "split" else pa.int64()) for v in cols[2:]]], names)

    rows = df.select(F.col(f"`{id_column}`"), *[F.col(f"`{f}`").cast("string") for f in fields])
    return rows.mapInArrow(run, f"`{id_column}` {rows.dtypes[0][1]}, n_tokens long, " + ", ".join(f"`{f}_tokens` {number}" for f in fields))


def op10_section_tokens(docs: DataFrame) -> DataFrame:
    return section_tokens(docs)
