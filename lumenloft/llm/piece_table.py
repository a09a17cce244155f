"""SentencePiece encoding through a table of distinct chunks.

In the models served here no piece has a whitespace marker behind another character, and none holds a line break, so no
merge crosses the places in front of a marker or around a line break: a text's ids are those of its chunks, one after
the other. The model is checked for that, and for an identity normaliser, before anything runs.

Documents are taken in blocks. A block sends each of its distinct chunks once to the chunk's bucket; a bucket segments
each distinct chunk once and answers each block; and the block's documents, kept as positions in the block's list of
chunks, are put together from the answers. So a frequent chunk travels once for each block, not for each use, and both
sides stream: a bucket's cache and a block's list have fixed bounds (a cache that is full starts anew).

Both passes over the documents must see the same rows in the same order, which holds for files; anything else is written
to the shared folder first, unless the caller says that it is `stable`.

Null texts count as empty; an empty text has no ids; null ids stay null. Repeated rows each get their result. Texts of any
length are whole, one in a block where it is long. Ties in the library's merges are the library's own, as each chunk is
segmented by it. Other columns aren't read; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, replayable

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
BLOCK_BYTES, BLOCK_CHUNKS, CACHE = 16 << 20, 400_000, 1_000_000


def model_bytes(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(model: bytes) -> bool:
    """Whether ids of chunks, one after the other, are the ids of a text."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(model)
    spec = m.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    usual = all(p.type in (1, 2, 3, 6) for p in m.pieces) and not m.trainer_spec.treat_whitespace_as_suffix
    return plain and usual and not any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in m.pieces if p.type == 1)


def chunks(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, some: list[str]) -> list[list[int]]:
    """Ids of chunks. A line break in front stands between the chunk and the marker that the library puts first."""
    return [ids[2:] for ids in sp.encode(["\n" + c for c in some], num_threads=1)]


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of uint32 and bytes, compressed; each array is laid out byte plane by byte plane."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    body = b"".join(np.ascontiguousarray(a, dtype=np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + body + tail)


def unpack(data: bytes, n: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4 * n, []
    for size in np.frombuffer(raw, np.uint32, n).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, -1).T).view(np.uint32).ravel())
        at += 4 * size
    return out, raw[at:]


def blocks(batches, ask: bool, buckets: int):
    """A block's questions to the buckets (ask), or its documents. A block is named by a hash of all its rows, so both
    passes name it alike; blocks of equal rows get equal answers."""
    place: defaultdict = defaultdict()
    place.default_factory = place.__len__
    held, name, parts = 0, hashlib.blake2b(digest_size=8), []

    def finish():
        block = int.from_bytes(name.digest(), "little", signed=True)
        if not ask:
            return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), pa.array([1] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["block", "kind", "data"])
        words = [c.encode() for c in place]
        bucket = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        to, data = [], []
        for k in range(buckets):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                mine = [words[i] for i in at.tolist()]
                to.append(k)
                data.append(pack(at, np.array([len(w) for w in mine]), tail=b"".join(mine)))
        return pa.RecordBatch.from_arrays([pa.array([block] * len(to), pa.int64()), pa.array(to, pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])

    for b in batches:
        for c in pieces(b, "text", 1 << 20):
            lists = []
            for i, t in zip(c["doc_id"].to_pylist(), c["text"].to_pylist(), strict=True):
                held += len(t or "")
                name.update(f"{i}:{len(t or '')}:{t or ''}".encode())
                lists.append(list(map(place.__getitem__, chunks(t or ""))))
            if not ask:
                sizes = np.array([len(x) for x in lists], np.uint32)
                flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
                ids = np.array(c["doc_id"].fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                null = np.array(c["doc_id"].is_null().to_numpy(zero_copy_only=False), np.uint32)
                parts.append(pack(sizes, flat, null, tail=ids.tobytes()))
            if held >= BLOCK_BYTES or len(place) >= BLOCK_CHUNKS:
                yield finish()
                place.clear()
                held, name, parts = 0, hashlib.blake2b(digest_size=8), []
    if ask and place or parts:
        yield finish()


def answers(batches, model: bytes):
    """Each distinct chunk of the task's buckets is segmented once."""
    sp, known = processor(model), {}
    for b in batches:
        for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist(), strict=True):
            (at, sizes), tail = unpack(data, 2)
            stops = np.cumsum(sizes, dtype=np.int64).tolist()
            words = [tail[s:e] for s, e in zip([0, *stops], stops, strict=False)]
            if len(known) > CACHE:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            known.update(zip(new, (np.array(x, np.uint32) for x in segment(sp, [w.decode() for w in new])), strict=True))
            ids = [known[w] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([pack(at, np.array([len(x) for x in ids]), np.concatenate(ids))], pa.binary())], ["block", "kind", "data"])


def together(batches, model: bytes, make):
    """Blocks' answers (first) and documents; `make` gets doc_id, is null, ids for each document."""
    block, flat, start, size, parts = None, None, None, None, []
    for b in batches:
        for k, kind, data in zip(b["block"].to_pylist(), b["kind"].to_pylist(), b["data"].to_pylist(), strict=True):
            if k != block:
                block, parts, flat = k, [], None
            if kind == 0:
                parts.append(unpack(data, 3)[0])
                continue
            if flat is None:
                flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
                at = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
                n = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
                start, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                start[at], size[at] = np.cumsum(n) - n, n
                parts = []
            (sizes, words, null), tail = unpack(data, 3)
            n = size[words]
            ids = flat[np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
            yield make(np.frombuffer(tail, np.int64).tolist(), null, [ids[s:e].tolist() for s, e in zip(cuts, cuts[1:], strict=False)])


def encode_with(docs: DataFrame, make, schema: str, path: str | None = None, buckets: int | None = None, stable: bool | None = None) -> DataFrame:
    spark, model = docs.sparkSession, model_bytes(path)
    if not separable(model):
        raise ValueError("pieces of this model may cross whitespace markers; chunks can't be encoded alone")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows if (replayable(rows) if stable is None else stable) else materialize(rows, "pieces-docs")
    asked = rows.mapInArrow(lambda it: blocks(it, True, n), "block long, bucket int, data binary").repartition(n, "bucket")
    told = asked.mapInArrow(lambda it: answers(it, model), "block long, kind int, data binary")
    held = rows.mapInArrow(lambda it: blocks(it, False, n), "block long, kind int, data binary")
    both = told.unionByName(held).repartition(n, "block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(lambda it: together(it, model, make), schema)


def encode(docs: DataFrame, path: str | None = None, **more) -> DataFrame:
    """doc_id, ids of every text."""

    def make(doc_ids, null, lists):
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encode_with(docs, make, "doc_id long, ids array<int>", path, **more)


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False, **more) -> DataFrame:
    """doc_id, number and digest of the ids, digest of the text that they decode to; and the ids, if asked for."""
    model, numbers = model_bytes(path), [str(i) for i in range(1 << 16)]

    def make(doc_ids, null, lists):
        sp = processor(model)
        text = [",".join(map(numbers.__getitem__, x)) if not x or max(x) < 1 << 16 else ",".join(map(str, x)) for x in lists]
        decoded = [sp.decode(x) for x in lists]
        sha = lambda rows: pa.array([hashlib.sha256(r.encode()).hexdigest() for r in rows], pa.string())
        ids = [pa.array(lists, pa.list_(pa.int32()))] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null.astype(bool)), pa.array([len(x) for x in lists], pa.int64()), sha(text), sha(decoded), *ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return encode_with(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, path, **more)


def op1_piece_table(docs: DataFrame) -> DataFrame:
    return digests(docs)
