"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference. Its documents are dealt to reference blocks (chunks of a few MB), and each block is
indexed by *seeds*: of the 13 eight-word grams in a 20-word window, the one with the least fingerprint. Equal windows have
equal seeds at equal places, so whichever block holds an earlier copy of a window is found through the seed alone; the
seed index is hash-partitioned, and every block's seeds are in it. Three exchanges, each of packed arrays:

1. each block sends its distinct seeds, counted, to the index; the index tells each block which of them occur again anywhere,
   and which are so common that their windows must be dealt by window: only equal windows have to meet;
2. around those seeds, each block sends the fingerprints of the windows with their place (the first place in the block);
   the index answers with the earliest place in the whole corpus, runs of consecutive places folded into one;
3. each document is parsed greedily from left to right: a factor begins at the first window with an earlier place and is
   extended while the next window's earliest place is the next one of the same reference; else a factor boundary is set
   and the window across it is looked up for itself. Words under factors are removed.

Windows are compared by seed and window fingerprint together (128 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import NULL_ID, block_ranges, bucket_of, by_bucket, chunked, hidden, ids_of, in_sorted, mix, one, pack, rolling, sized, sliding_argmin, texts_of, two, word_hashes, word_spans

SEND = "bucket long, _chunk long, a binary, b binary, c binary, d binary"
ANSWER = "_chunk long, a binary, b binary, c binary, d binary, e binary"
FACTOR = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ref_doc", T.LongType()), T.StructField("ref_start", T.IntegerType())]))


def _windows(table: pa.Table, text: str, doc_id: str, width: int, gram: int):
    """For each block of documents: doc range, word hashes, first words, and its windows' starts, ids, documents, seeds' places and seeds."""
    buf, offs = texts_of(table.column(text))
    ids = ids_of(table.column(doc_id))
    for i, j in block_ranges(offs):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(b, o)
        words = word_hashes(b, starts, ends)
        n = len(words)
        if n < width:
            yield i, j, words, first, *(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64)
            continue
        doc = np.repeat(np.arange(i, j), np.diff(first))
        grams = rolling(words, gram)
        seed = sliding_argmin(grams, width - gram + 1)
        whole = doc[: n - width + 1] == doc[width - 1 :]
        at = np.flatnonzero(whole)
        yield i, j, words, first, at, ids[doc[at]], doc[at], seed[at], grams[seed[at]]


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = [pa.int64() if k == "long" else pa.binary() for k in kinds]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _send_seeds(table: pa.Table, *, text: str, doc_id: str, width: int, gram: int, buckets: int) -> pa.Table:
    seeds = []
    for *_, at, _, _, place, seed in _windows(table, text, doc_id, width, gram):
        new = np.ones(len(at), bool)
        new[1:] = place[1:] != place[:-1]
        seeds.append(seed[new])
    seeds, n = np.unique(np.concatenate(seeds) if seeds else np.zeros(0, np.uint64), return_counts=True)
    order, found, at = by_bucket(seeds, buckets)
    chunk = table.column("_chunk")[0].as_py()
    return _rows(SEND, [(int(k), chunk, pack(seeds[order[x:y]]), pack(n[order[x:y]].astype(np.uint32)), None, None) for k, x, y in zip(found, at, at[1:], strict=False)])


def _index_seeds(table: pa.Table) -> pa.Table:
    chunks = table.column("_chunk").to_pylist()
    seeds = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    again = [np.frombuffer(x, bool) for x in table.column("b").to_pylist()]
    every, n = np.unique(np.concatenate(seeds), return_counts=True)
    repeated = np.union1d(every[n > 1], np.concatenate([s[x] for s, x in zip(seeds, again, strict=True)]))
    return _rows(ANSWER, [(c, pack(x), None, None, None, None) for c, s in zip(chunks, seeds, strict=True) if len(x := s[in_sorted(s, repeated)])])


def _index_counted(table: pa.Table, *, common: int) -> pa.Table:
    """As _index_seeds, of counted seeds; and those of them that stand at more than common places."""
    chunks = table.column("_chunk").to_pylist()
    seeds = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("b").to_pylist()])
    every, at = np.unique(np.concatenate(seeds), return_inverse=True)
    total = np.bincount(at, counts, len(every))
    repeated, hot = every[total > 1], every[total > common]
    return _rows(ANSWER, [(c, pack(x), None, None, None, pack(x[in_sorted(x, hot)])) for c, s in zip(chunks, seeds, strict=True) if len(x := s[in_sorted(s, repeated)])])


def _repeated(table: pa.Table, facts: pa.Table) -> np.ndarray:
    return _seeds(facts, "a")


def _seeds(facts: pa.Table, column: str) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in facts.column(column).to_pylist()] or [np.zeros(0, np.uint64)]))


def _candidates(table: pa.Table, repeated: np.ndarray, **at) -> dict[str, np.ndarray]:
    """All windows around repeated seeds: seed, fingerprint, id, row and start within the document."""
    out = [[] for _ in range(5)]
    for i, _, words, first, start, ids, doc, _, seed in _windows(table, **at):
        hit = in_sorted(seed, repeated)
        if hit.any():
            prints = rolling(words, at["width"])[start[hit]]
            for o, x in zip(out, (seed[hit], prints, ids[hit], doc[hit], start[hit] - first[doc[hit] - i]), strict=True):
                o.append(x)
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return {k: np.concatenate(o) if o else np.zeros(0, t) for k, o, t in zip(("seed", "print", "id", "row", "pos"), out, kinds, strict=True)}


def _first_of(seed: np.ndarray, prints: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window, then place; and for each window in that order the index (in it) of the window's first place."""
    order = np.lexsort((pos, ids, prints, seed))
    new = np.ones(len(order), bool)
    new[1:] = (seed[order][1:] != seed[order][:-1]) | (prints[order][1:] != prints[order][:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _send_windows(table: pa.Table, facts: pa.Table, *, buckets: int, **at) -> pa.Table:
    if not table.num_rows:
        return _rows(SEND, [])
    w = _candidates(table, _repeated(table, facts), **at)
    order, first = _first_of(w["seed"], w["print"], w["id"], w["pos"])
    own = order[first == np.arange(len(order))]
    seed, prints = w["seed"][own], w["print"][own]
    to = bucket_of(np.where(in_sorted(seed, _seeds(facts, "e")), mix(seed ^ mix(prints)), seed), buckets)
    order = np.argsort(to, kind="stable")
    own = own[order]
    found, cut = np.unique(to[order], return_index=True)
    chunk = table.column("_chunk")[0].as_py()
    return _rows(SEND, [(int(k), chunk, pack(w["seed"][p]), pack(w["print"][p]), pack(w["id"][p]), pack(w["pos"][p].astype(np.int32))) for k, x, y in zip(found, cut, [*cut[1:], len(own)], strict=False) if len(p := own[x:y])])


def _index_windows(table: pa.Table) -> pa.Table:
    chunks = table.column("_chunk").to_pylist()
    parts = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int64), ("d", np.int32))]
    chunk = np.repeat(np.arange(len(chunks)), [len(x) for x in parts[0]])
    seed, prints, ids, pos = (np.concatenate(p) for p in parts)
    order, first = _first_of(seed, prints, ids, pos)
    ref = np.empty(len(order), np.int64)
    ref[order] = order[first]
    later = np.flatnonzero((ids[ref] != ids) | (pos[ref] != pos))
    later = later[np.lexsort((pos[later], ids[later], chunk[later]))]
    c, i, p, ri, rp = chunk[later], ids[later], pos[later], ids[ref[later]], pos[ref[later]]
    new = np.ones(len(later), bool)
    new[1:] = (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1) | (ri[1:] != ri[:-1]) | (rp[1:] != rp[:-1] + 1)
    head = np.flatnonzero(new)
    length = np.diff(np.append(head, len(later))).astype(np.int32)
    found, cut = np.unique(c[head], return_index=True)
    cut = [*cut, len(head)]
    return _rows(ANSWER, [(chunks[k], pack(i[head[x:y]]), pack(p[head[x:y]]), pack(length[x:y]), pack(ri[head[x:y]]), pack(rp[head[x:y]])) for k, x, y in zip(found, cut, cut[1:], strict=False)])


def _places(table: pa.Table, facts: pa.Table, **at) -> tuple[np.ndarray, ...]:
    """Rows, starts and reference places of all windows of a block that stand earlier, in order."""
    seeds = facts.filter(pa.compute.is_null(facts.column("b")))
    runs = facts.filter(pa.compute.is_valid(facts.column("b")))
    w = _candidates(table, _repeated(table, seeds), **at)
    got = [np.concatenate([np.frombuffer(x, t) for x in runs.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in (("a", np.int64), ("b", np.int32), ("c", np.int32), ("d", np.int64), ("e", np.int32))]
    step = np.arange(got[2].sum()) - np.repeat(np.cumsum(got[2]) - got[2], got[2])
    ids, pos, ri, rp = (np.repeat(got[k], got[2]).astype(np.int64) for k in (0, 1, 3, 4))
    pos, rp = pos + step, rp + step
    # an earlier place in the same block, unless the index knows a still earlier one for that place
    order, first = _first_of(w["seed"], w["print"], w["id"], w["pos"])
    head = order[first]
    o = np.lexsort((pos, ids))
    ids, pos, ri, rp = ids[o], pos[o], ri[o], rp[o]
    key = _place_key(ids, pos)
    order_k = np.argsort(key, kind="stable")
    at_k = np.searchsorted(key[order_k], _place_key(w["id"][head], w["pos"][head]))
    at_k[at_k == len(key)] = 0
    known = np.zeros(len(head), bool)
    if len(key):
        hit = order_k[at_k]
        known = (ids[hit] == w["id"][head]) & (pos[hit] == w["pos"][head])
    rdoc = np.where(known, ri[hit] if len(key) else 0, w["id"][head])
    rpos = np.where(known, rp[hit] if len(key) else 0, w["pos"][head])
    dup = known | (w["id"][order] != w["id"][head]) | (w["pos"][order] != w["pos"][head])
    at_, rdoc, rpos = order[dup], rdoc[dup], rpos[dup]
    o = np.lexsort((w["pos"][at_], w["row"][at_]))
    return w["row"][at_][o], w["pos"][at_][o], rdoc[o], rpos[o]


def _place_key(ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)


def parse(rows: np.ndarray, pos: np.ndarray, rdoc: np.ndarray, rpos: np.ndarray, width: int):
    """Greedy factors (row, start, length in words, reference document, reference start) of windows in order."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1] + 1) | (rdoc[1:] != rdoc[:-1]) | (rpos[1:] != rpos[:-1] + 1)
    head = np.flatnonzero(new)
    return rows[head], pos[head], np.diff(np.append(head, len(rows))) + width - 1, rdoc[head], rpos[head]


def _parse_blocks(table: pa.Table, facts: pa.Table, *, names: list[str], **at) -> pa.Table:
    rows, start, length, rdoc, rpos = parse(*_places(table, facts, **at), at["width"])
    buf, offs = texts_of(table.column(at["text"]))
    cut = np.searchsorted(rows, np.arange(table.num_rows + 1))
    n_words, n_removed, kept, factors = [], [], [], []
    for k in range(table.num_rows):
        words = buf[offs[k] : offs[k + 1]].tobytes().split()
        n = len(words)
        own = slice(cut[k], cut[k + 1])
        if cut[k + 1] > cut[k]:
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, start[own], 1)
            np.add.at(edge, start[own] + length[own], -1)
            free = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            words = [words[x] for x in free.tolist()]
        n_words.append(n)
        n_removed.append(n - len(words))
        kept.append(b" ".join(words))
        factors.append([{"start": int(a), "length": int(b), "ref_doc": None if c == NULL_ID else int(c), "ref_start": int(d)} for a, b, c, d in zip(start[own], length[own], rdoc[own], rpos[own], strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
    out = {c: table.column(c) for c in names} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "factors": pa.array(factors, kind)}
    return pa.table(out)


def rlz_dedup(docs: DataFrame, *, width: int = 20, gram: int = 8, text: str = "text", doc_id: str = "doc_id", chunk_mb: float = 8, bucket_mb: float = 16, common: int = 4096) -> DataFrame:
    """docs with n_words, n_removed, kept_text and factors (start, length, ref_doc, ref_start, in words).

    A word goes if a window of `width` words over it also starts earlier: in a document of smaller id, or earlier in its
    own. Windows are judged on the input. Defined cases: a null text is empty; a null id sorts last; rows of one id are one
    place, so neither is earlier than the other; texts shorter than a window stay whole; an empty table gives an empty
    table; other columns pass through, but for columns of the names that are added, in any case, which are replaced. Kept words are
    joined by one space. Windows around a seed that stands at more than `common` places are dealt over all buckets.
    """
    docs, (text, doc_id), back = hidden(docs, text, doc_id)
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept_text", "factors")]
    chunks, buckets = sized(docs, text, chunk_mb, bucket_mb)
    at = {"text": text, "doc_id": doc_id, "width": width, "gram": gram}
    dealt = chunked(docs.select(*(f"`{c}`" for c in names)), chunks, doc_id, text).groupBy("_chunk")
    seeds = dealt.applyInArrow(one(_send_seeds, buckets=buckets, **at), SEND).groupBy("bucket").applyInArrow(one(_index_counted, common=common), ANSWER)
    windows = dealt.cogroup(seeds.groupBy("_chunk")).applyInArrow(two(_send_windows, buckets=buckets, **at), SEND)
    places = windows.groupBy("bucket").applyInArrow(one(_index_windows), ANSWER)
    kinds = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("factors", FACTOR)])
    return dealt.cogroup(seeds.unionByName(places).groupBy("_chunk")).applyInArrow(two(_parse_blocks, names=names, **at), kinds).withColumnsRenamed(back)

