"""Vectorised text blocks: Arrow rows to word and byte fingerprints, and the chunked two-way exchange.

Documents are dealt to *chunks* of a few megabytes by a hash of their id, so that a chunk is small whatever a source or
a group of copies holds. A chunk sends what it knows to hash-partitioned index buckets as packed arrays (one row for each
chunk and bucket, repeats within the chunk folded first), and a bucket answers each chunk in the same form. A key that
every document shares therefore reaches its bucket once a chunk, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from souklens.plans.lineage import settled  # noqa: F401



def hidden(df: DataFrame, *names: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """df whose columns that begin with _, as helper columns do, have other names meanwhile; what `names` are called meanwhile; and
    the names to give back. A table without such columns stays as it is."""
    taken, moved = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.startswith("_"):
            moved[c] = "u" + c
            while moved[c].lower() in taken:
                moved[c] = "u" + moved[c]
            taken.add(moved[c].lower())
    return df.withColumnsRenamed(moved), [moved.get(x, x) for x in names], {new: c for c, new in moved.items()}


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NULL_ID = np.iinfo(np.int64).max
BLOCK = 1 << 19
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0x5851F42D4C957F2D)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_pows: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pows or len(_pows["p"]) < n + 1:
        size = max(n + 1, BLOCK + 1)
        p, q = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        p[0] = q[0] = 1
        _pows["p"], _pows["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pows["p"], _pows["q"]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial fingerprint of values[s:e] for each pair; values are uint64."""
    p, q = _powers(len(values))
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=h[1:])
    return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(values))
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=h[1:])
    return mix((h[k:] - h[:-k]) * q[:n])


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """For each run of w keys the position of the least (by its top 40 bits), the leftmost among equals."""
    n = len(keys) - w + 1
    low = np.uint64((1 << 24) - 1)
    m = (keys & ~low) | (np.arange(len(keys), dtype=np.uint64) & low)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    at = np.arange(n, dtype=np.uint64)
    return (at + (((m[:n] & low) - at) & low)).astype(np.int64)


def texts_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as int64; null becomes NULL_ID, which sorts last."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy()


def block_ranges(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of documents, and the first word of each document (one more than documents)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    sp = SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, sp[:-1]
    after[-1], after[:-1] = True, sp[1:]
    before[offs[:-1][offs[:-1] < n]] = True
    after[offs[1:][offs[1:] > 0] - 1] = True
    word = ~sp
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK) -> np.ndarray:
    """A 64-bit fingerprint of each word, in pieces of about limit bytes cut between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        base = starts[i]
        out[i:j] = spans_hash(_BYTE[buf[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def in_sorted(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Which needles are in the sorted array hay."""
    if not len(hay):
        return np.zeros(len(needles), bool)
    at = np.searchsorted(hay, needles)
    at[at == len(hay)] = 0
    return hay[at] == needles


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def sized(docs: DataFrame, text: str = "text", chunk_mb: float = 8, bucket_mb: float = 16) -> tuple[int, int]:
    """How many chunks of documents and how many index buckets fit this input: both grow with its bytes."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))).alias("n")).first()["n"] or 0
    return max(1, -(-total // int(chunk_mb * 1e6))), max(8, -(-total // int(bucket_mb * 1e6)))


def chunked(docs: DataFrame, chunks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the column _chunk, a hash of the id (and of the text's hash where there is no id)."""
    key = F.xxhash64(F.lit(7), F.col(f"`{doc_id}`").cast("long"))
    key = F.when(F.col(f"`{doc_id}`").isNull(), F.xxhash64(F.lit(7), F.col(f"`{text}`"))).otherwise(key)
    return docs.withColumn("_chunk", F.pmod(key, F.lit(chunks)).cast("long"))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of keys by bucket, then value; the buckets that occur and where each begins in that order."""
    b = bucket_of(keys, buckets)
    order = np.lexsort((keys, b))
    found, at = np.unique(b[order], return_index=True)
    return order, found, np.append(at, len(keys))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys ^ _GOLD) % np.uint64(buckets)).astype(np.int64)


def one(f, **known):
    """f of a group's table, with its parameters bound."""
    return lambda table: f(table, **known)


def two(f, **known):
    """f of a group's two tables, with its parameters bound."""
    return lambda left, right: f(left, right, **known)
