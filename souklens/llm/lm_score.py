"""Language-model scores from Elias-Fano n-gram tries.

Bigrams are dealt to shards by their context, in packed blocks: every occurrence (context, word, document) of a block of
documents goes out once. A shard counts the bigrams of the training documents, builds its part of the trie and scores all
occurrences with it, so that no executor holds the whole model. Of a shard's trie, the contexts' pointers are a monotone
sequence; successors are made one by adding the context's base; both are in Elias-Fano form, with a code of 8 bits for each
smoothed probability, in memory-mapped files that go with the task. A word is looked up relative to its context's base: the
high part selects a short run, the low parts in it are compared.

Probabilities: absolute discounting; a bigram that training has not seen takes its context's back-off weight times the
word's add-one unigram probability, which the shard that owns the word adds in a second, smaller exchange. The unigram sums
(base_score) come from the same counts, unquantised.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .blocks import NULL_ID, block_ranges, bucket_of, ids_of, lower_ascii, one, pack, settled, sized, texts_of, word_hashes, word_spans
from .substring_rlz import _rows

START, END = np.uint64(0x1234567890ABCDEF), np.uint64(0x0FEDCBA987654321)
W40 = np.uint64(24)
SENT = "shard long, block long, kind long, a binary, b binary, c binary, d binary, e binary"
TOKENS, HEAD, UNSEEN, COUNTS, SUMS, TOTALS = range(6)
SUM_TYPES = (np.float64, np.uint32, np.float32, np.uint8)


class Stored:
    """Arrays in one memory-mapped file that is gone when closed."""

    def __init__(self) -> None:
        self.file, self.end = tempfile.TemporaryFile(), 0

    def put(self, a: np.ndarray) -> np.ndarray:
        if not a.size:
            return a
        at = -(-self.end // 4096) * 4096
        out = np.memmap(self.file, a.dtype, "w+", at, a.shape)
        out[:] = a
        self.end = at + a.nbytes
        return out


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th set bits; before: set bits before each 64-bit word."""
    at = np.searchsorted(before, k, "right") - 1
    rest, word = k - before[at], words[at]
    place = np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = rest >= n
        rest = np.where(up, rest - n, rest)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), low)
    return at * 64 + place


class EliasFano:
    """A monotone sequence: low bits as they are, high parts in unary."""

    def __init__(self, values: np.ndarray, store: Stored):
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        self.low = store.put(low.astype(np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        bits = np.zeros((top >> self.low_bits) + n + 2, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.frombuffer(np.pad(np.packbits(bits, bitorder="little"), (0, -(-len(bits) // 8) % 8 and 8 - -(-len(bits) // 8) % 8)).tobytes(), np.uint64)
        self.size = len(bits)
        self.ones, self.zeros = store.put(words), store.put(~words)
        count = np.bitwise_count(words).astype(np.int64)
        self.ones_before = np.cumsum(count) - count
        self.zeros_before = np.cumsum(64 - count) - (64 - count)
        self.highs = top >> self.low_bits

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.ones, self.ones_before, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low[i].astype(np.uint64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in the sequence (values are distinct), or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        ok = np.flatnonzero(high <= self.highs)
        high, want = high[ok], x[ok] & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, _select(self.zeros, self.zeros_before, np.maximum(high - 1, 0)) - high + 1, 0)
        end = _select(self.zeros, self.zeros_before, high) - high
        for _ in range(64):  # halve the run; low parts ascend in it
            open_ = begin < end
            if not open_.any():
                break
            mid = (begin + end) // 2
            got = self.low[np.minimum(mid, self.n - 1)].astype(np.uint64)
            less = got < want
            begin = np.where(open_ & less, mid + 1, begin)
            end = np.where(open_ & ~less, mid, end)
        at = np.minimum(begin, self.n - 1)
        hit = (self.low[at].astype(np.uint64) == want) & (self.get(at) == x[ok])
        out[ok[hit]] = at[hit]
        return out


def quantised(x: np.ndarray, store: Stored) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and the code book: 256 even steps between the least and the greatest value."""
    if not len(x):
        return store.put(np.zeros(0, np.uint8)), np.zeros(256)
    lo, hi = float(x.min()), float(x.max())
    book = np.linspace(lo, hi, 256)
    return store.put(np.rint((x - lo) / max(hi - lo, 1e-12) * 255).astype(np.uint8)), book


class Trie:
    """Contexts -> successors of one shard. counts: of distinct keys context << 40 | word, ascending."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: int, store: Stored):
        of = (keys >> np.uint64(40)).astype(np.int64)
        total = np.bincount(of, counts, contexts)
        kinds = np.bincount(of, minlength=contexts)
        n1, n2 = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64), store)
        self.successors = EliasFano(keys, store)
        self.codes, self.book = quantised(np.log10((counts - d) / total[of]), store)
        seen = total > 0
        back = np.zeros(contexts)
        back[seen] = np.log10(d * kinds[seen] / total[seen])
        self.back_codes, self.back_book = quantised(back, store)

    def score(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each bigram's discounted probability or else of its back-off weight, and whether it was seen."""
        begin, end = (self.pointers.get(context + k).astype(np.int64) for k in (0, 1))
        at = self.successors.find((context.astype(np.uint64) << np.uint64(40)) | word)
        seen = (at >= begin) & (at < end)
        return np.where(seen, self.book[self.codes[np.where(seen, at, 0)]] if self.successors.n else 0.0, self.back_book[self.back_codes[context]]), seen


def _blocks(batches: Iterator[pa.RecordBatch], doc_id: str, text: str, shards: int, held: int, folds: int) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for batch in batches:
        all_ids = ids_of(batch.column(doc_id))
        buf, offs = texts_of(batch.column(text))
        for i, j in ((x, y) for i, j in block_ranges(offs, 1 << 22) for x in range(i, j, 32767) for y in (min(j, x + 32767),)):
            ids = all_ids[i:j]
            b, o = lower_ascii(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
            starts, ends, first = word_spans(b, o)
            n = np.diff(first)
            words = _framed(word_hashes(b, starts, ends), n)
            train = np.array([zlib.crc32(b"" if x == NULL_ID else str(x).encode()) % folds != held for x in ids.tolist()], bool)
            doc = np.repeat(np.arange(j - i), n + 1)
            at = np.arange(len(doc)) + doc
            context, word = words[at], words[at + 1] >> W40
            mark = (doc + (train[doc].astype(np.int64) << 15)).astype(np.uint16)
            shard = bucket_of(context >> W40, shards)
            order = np.lexsort((word, context, shard))
            context, word, mark, shard = context[order], word[order], mark[order], shard[order]
            found, cut = np.unique(shard, return_index=True)
            rows = [(int(number % shards), number, HEAD, pack(ids), pack(train), pack(n + 1), None, None)]
            for s, x, y in zip(found, cut, [*cut[1:], len(shard)], strict=False):
                c, k = np.unique(context[x:y], return_counts=True)
                rows.append((int(s), number, TOKENS, pack(c), pack(k.astype(np.uint32)), pack((word[x:y] >> np.uint64(8)).astype(np.uint32)), pack((word[x:y] & np.uint64(255)).astype(np.uint8)), pack(mark[x:y])))
            yield _rows(SENT, rows).combine_chunks().to_batches()[0]
            number += 1


def _framed(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """START, the words and END of each document in a row."""
    out = np.empty(len(words) + 2 * len(n), np.uint64)
    begin = np.cumsum(n + 2) - (n + 2)
    out[begin], out[begin + n + 1] = START, END
    inside = np.ones(len(out), bool)
    inside[begin] = inside[begin + n + 1] = False
    out[inside] = words
    return out


def _arrays(table: pa.Table, kind: int, kinds: dict[str, type]) -> tuple[list[int], dict[str, list[np.ndarray]]]:
    rows = table.filter(pa.compute.equal(table.column("kind"), kind))
    return rows.column("block").to_pylist(), {c: [np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in kinds.items()}


def _shard(table: pa.Table, *, shards: int) -> pa.Table:
    """Counts, trie and scores of one shard: sums for its documents, unseen words for their owners, counts of its words."""
    blocks, got = _arrays(table, TOKENS, {"a": np.uint64, "b": np.uint32, "c": np.uint32, "d": np.uint8, "e": np.uint16})
    heads = table.filter(pa.compute.equal(table.column("kind"), HEAD))
    out = [tuple(r.values()) for r in heads.select(["shard", "block", "kind", "a", "b", "c", "d", "e"]).to_pylist()]
    mine = table.column("shard")[0].as_py()
    if not blocks:
        return _rows(SENT, out)
    lengths = [len(x) for x in got["e"]]
    known, context = np.unique(np.concatenate(got["a"]), return_inverse=True)
    context = np.repeat(context.astype(np.int32), np.concatenate(got["b"]))
    word = (np.concatenate(got["c"]).astype(np.uint64) << np.uint64(8)) | np.concatenate(got["d"])
    mark = np.concatenate(got["e"])
    if len(known) >= 1 << 24:
        raise ValueError("too many contexts in a shard: take more shards")
    train, doc = mark >> 15 == 1, mark & np.uint16(0x7FFF)
    del got, mark, table
    key = (context.astype(np.uint64) << np.uint64(40)) | word
    uniq, inverse = np.unique(key, return_inverse=True)
    inverse = inverse.astype(np.int32)
    del key, word
    counts = np.bincount(inverse[train], minlength=len(uniq))
    store = Stored()
    trie = Trie(uniq[counts > 0], counts[counts > 0], len(known), store)
    total = np.bincount(context[train], minlength=len(known))
    score, seen = trie.score((uniq >> np.uint64(40)).astype(np.int64), uniq & np.uint64((1 << 40) - 1))
    ends = (uniq & np.uint64((1 << 40) - 1)) == END >> W40
    real = known != START
    base = np.where(real, np.log10(total + 1.0), 0.0)
    out.append((mine, -1, COUNTS, pack(known[(total > 0) & real] >> W40), pack(total[(total > 0) & real]), None, None, None))
    out.append((mine, -1, TOTALS, pack(np.array([np.count_nonzero((total > 0) & real), total[real].sum()])), None, None, None, None))
    edge, gone = np.cumsum([0, *lengths]), []
    for block, x, y in zip(blocks, edge, edge[1:], strict=False):
        d, c, u = doc[x:y], context[x:y], inverse[x:y]
        n = int(d.max()) + 1
        new = ~seen[u]
        sums = [np.bincount(d, w, n) for w in (base[c], (total[c] > 0) & real[c], score[u], new & ends[u])]
        here = np.flatnonzero(np.bincount(d, minlength=n))
        out.append((mine, block, SUMS, pack(here.astype(np.uint16)), *(pack(s[here].astype(t)) for s, t in zip(sums, SUM_TYPES, strict=True))))
        far = np.flatnonzero(new & ~ends[u])
        if len(far):
            gone.append((uniq[u[far]] & np.uint64((1 << 40) - 1), d[far], np.full(len(far), block, np.int64)))
    if gone:  # one row to each shard, whatever the number of blocks
        w, d, b = (np.concatenate(x) for x in zip(*gone, strict=True))
        to = bucket_of(w, shards)
        o = np.argsort(to, kind="stable")
        found, cut = np.unique(to[o], return_index=True)
        out += [(int(s), -1, UNSEEN, pack(w[o[p:q]]), pack(d[o[p:q]]), pack(b[o[p:q]]), None, None) for s, p, q in zip(found, cut, [*cut[1:], len(o)], strict=False)]
    return _rows(SENT, out)


def _unseen(table: pa.Table) -> pa.Table:
    """Unigram sums of the words that training has not seen behind their context, by the shard that owns the words."""
    _, counts = _arrays(table, COUNTS, {"a": np.uint64, "b": np.int64})
    word = np.concatenate(counts["a"]) if counts["a"] else np.zeros(0, np.uint64)
    number = np.concatenate(counts["b"]) if counts["b"] else np.zeros(0, np.int64)
    o = np.argsort(word, kind="stable")
    word, number = word[o], number[o]
    _, got = _arrays(table, UNSEEN, {"a": np.uint64, "b": np.uint16, "c": np.int64})
    out: list[tuple] = []
    if not got["a"]:
        return _rows(SENT, out)
    words, docs, block_of = (np.concatenate(got[c]) for c in "abc")
    o = np.argsort(block_of, kind="stable")
    words, docs, block_of = words[o], docs[o], block_of[o]
    blocks, cut = np.unique(block_of, return_index=True)
    for block, x, y in zip(blocks.tolist(), cut, [*cut[1:], len(words)], strict=True):
        w, d = words[x:y], docs[x:y]
        at = np.searchsorted(word, w)
        at[at == len(word)] = 0
        c = np.where(word[at] == w, number[at], 0) if len(word) else np.zeros(len(w), np.int64)
        n = np.bincount(d)
        here = np.flatnonzero(n)
        out.append((0, block, UNSEEN, pack(here.astype(np.uint16)), pack(np.bincount(d, np.log10(c + 1.0))[here]), pack(n[here].astype(float)), None, None))
    return _rows(SENT, out)


def _summed(table: pa.Table, *, names: tuple[str, ...]) -> pa.Table:
    """The documents of one block with their sums."""
    _, head = _arrays(table, HEAD, {"a": np.int64, "b": bool, "c": np.int64})
    ids, train, n = (head[c][0] for c in "abc")
    base, known, score, ends, far, extra = (np.zeros(len(ids)) for _ in range(6))
    _, got = _arrays(table, SUMS, {"a": np.uint16, **dict(zip("bcde", SUM_TYPES, strict=True))})
    for k, here in enumerate(got["a"]):
        for to, c in ((base, "b"), (known, "c"), (score, "d"), (ends, "e")):
            to[here] += got[c][k]
    _, got = _arrays(table, UNSEEN, {"a": np.uint16, "b": float, "c": float})
    for k, here in enumerate(got["a"]):
        extra[here] += got["b"][k]
        far[here] += got["c"][k]
    cols = [pa.array(ids, mask=ids == NULL_ID), pa.array(~train), pa.array(n), pa.array(known.astype(np.int64)), *(pa.array(x) for x in (base, score + extra, ends, far))]
    return pa.table(cols, names=list(names))


def lm_scores(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held: int = 2, shard_mb: float = 14) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id as text) mod folds is `held` are left out of training; a null id counts as an empty text
    there and comes back null. Tokens: words (A-Z lower-cased) and one end. Defined cases: a null or empty text is its end
    alone; without training documents all counts are 0; repeated ids are documents of their own; an empty table gives an
    empty table; other columns are not read.
    """
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    _, shards = sized(d, bucket_mb=shard_mb)
    sent = d.mapInArrow(lambda it: _blocks(it, "doc_id", "text", shards, held, folds), SENT)
    scored = settled(sent.groupBy("shard").applyInArrow(one(_shard, shards=shards), SENT))
    extra = scored.where(F.col("kind").isin(UNSEEN, COUNTS)).groupBy("shard").applyInArrow(one(_unseen), SENT)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base", "sum", "ends", "far")
    rows = scored.where(F.col("kind").isin(SUMS, HEAD)).unionByName(extra).groupBy("block").applyInArrow(one(_summed, names=names), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, sum double, ends double, far double")
    # two numbers of each shard, and the number of training documents: sums of a few rows
    totals = scored.where(F.col("kind") == TOTALS).agg(F.sum(_long("a", 0)).alias("v"), F.sum(_long("a", 1)).alias("n")).first()
    ends = scored.where(F.col("kind") == HEAD).agg(F.sum(F.length(F.regexp_replace(F.hex("b"), "00", "")) / 2)).first()[0] or 0
    ends = int(ends)
    n, v = int(totals["n"] or 0) + ends, int(totals["v"] or 0) + (ends > 0)
    size, end = math.log10(n + v + 1), math.log10(ends + 1)
    base = F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(size)
    score = F.col("sum") + F.col("ends") * F.lit(end - size) - F.col("far") * F.lit(size)
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def _long(column: str, k: int):
    """The k-th little-endian 64-bit number of a binary column."""
    hexed = F.hex(F.substring(F.col(column), 8 * k + 1, 8))
    turned = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, 10).cast("long")
