"""Byte-exact substring deduplication by column-wise construction of a collection's Burrows-Wheeler transform.

Which strings of `width` bytes start at more than one place? Seeds (the least of the 24-byte grams of each 200-byte
window, so that equal windows have equal seeds at equal places) find the places that can hold a repeat. Around every seed
that occurs twice or more, the stretch of text whose windows have that seed is one *string* of a collection; equal strings
are folded to one with a mark. The strings of one seed are lined up at the seed, and the transform of the collection is
built from the last column to the first: each round inserts one symbol of every string in front of its suffix, which is a
stable sort of the rows by that symbol, and updates the common prefixes of neighbours with a range minimum. The columns
lie in a memory-mapped file that each round reads on, one column at a time; only the row order and the common prefixes
stay in memory. A window is repeated if its row's common prefix with a neighbour has reached `width`, or if its whole
string was marked.

Because the strings are lined up, suffixes of unequal length never need to be compared: only the newest row of each string
is kept, where the general construction keeps all. That makes the work strings x columns, not its square.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from .blocks import block_ranges, bucket_of, by_bucket, byte_values, chunked, hidden, in_sorted, one, pack, rolling, sized, sliding_argmin, spans_hash, texts_of, two
from .substring_rlz import ANSWER, _index_seeds, _rows

STRINGS = "bucket long, _chunk long, a binary, b binary, c binary, d binary, e binary, f binary"


def _blocks(table: pa.Table, text: str, width: int, gram: int):
    """For each block of documents: first document, bytes, and its runs of windows: document start, first window, number, seed place, seed."""
    buf, offs = texts_of(table.column(text))
    for i, j in block_ranges(offs, 1 << 18):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = len(b) - width + 1
        if n <= 0:
            continue
        values = byte_values(b)
        grams = rolling(values, gram)
        place = sliding_argmin(grams, width - gram + 1)
        doc = np.repeat(np.arange(j - i), np.diff(o))
        whole = doc[:n] == doc[width - 1 :]
        new = whole.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        head = np.flatnonzero(new)
        count = np.add.reduceat(whole.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        yield i, b, values, o[doc[head]], doc[head], head, count, place[head], grams[place[head]]


def _send_seeds(table: pa.Table, *, text: str, width: int, gram: int, buckets: int) -> pa.Table:
    seeds, n = np.unique(np.concatenate([x[-1] for x in _blocks(table, text, width, gram)] or [np.zeros(0, np.uint64)]), return_counts=True)
    order, found, at = by_bucket(seeds, buckets)
    chunk = table.column("_chunk")[0].as_py()
    from .substring_rlz import SEND

    return _rows(SEND, [(int(k), chunk, pack(seeds[order[x:y]]), pack(n[order[x:y]] > 1), None, None) for k, x, y in zip(found, at, at[1:], strict=False)])


def _repeated(facts: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in facts.column("a").to_pylist()] or [np.zeros(0, np.uint64)]))


def _strings(table: pa.Table, repeated: np.ndarray, text: str, width: int, gram: int):
    """The strings around repeated seeds: document, start, windows, seed, name, seed's offset; and the bytes of a block."""
    for i, b, values, base, doc, head, count, place, seed in _blocks(table, text, width, gram):
        hit = np.flatnonzero(in_sorted(seed, repeated))
        if len(hit):
            h, c, p = head[hit], count[hit], place[hit]
            name = spans_hash(values, h, h + c + width - 1) + seed[hit] + (p - h).astype(np.uint64)
            yield b, doc[hit] + i, h - base[hit], h, c, seed[hit], name, p - h


def _send_strings(table: pa.Table, facts: pa.Table, *, text: str, width: int, gram: int, buckets: int) -> pa.Table:
    if not table.num_rows:
        return _rows(STRINGS, [])
    got = [[] for _ in range(6)]
    buf, base = [], 0
    for b, _, _, h, c, seed, name, off in _strings(table, _repeated(facts), text, width, gram):
        for g, x in zip(got, (seed, name, off, c, h + base), strict=False):
            g.append(x)
        buf.append(b)
        base += len(b)
    if not buf:
        return _rows(STRINGS, [])
    seed, name, off, count, start = (np.concatenate(g) for g in got[:5])
    buf = np.concatenate(buf)
    o = np.lexsort((name, seed, bucket_of(seed, buckets)))
    new = np.ones(len(o), bool)
    new[1:] = (name[o][1:] != name[o][:-1]) | (seed[o][1:] != seed[o][:-1])
    many = np.diff(np.append(np.flatnonzero(new), len(o))) > 1
    own = o[new]
    found, cut = np.unique(bucket_of(seed[own], buckets), return_index=True)
    chunk, rows = table.column("_chunk")[0].as_py(), []
    for k, x, y in zip(found, cut, [*cut[1:], len(own)], strict=False):
        p = own[x:y]
        length = count[p] + width - 1
        at = np.repeat(start[p] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        rows.append((int(k), chunk, pack(seed[p]), pack(name[p]), pack(off[p].astype(np.int16)), pack(count[p].astype(np.int16)), pack(many[x:y]), buf[at].tobytes()))
    return _rows(STRINGS, rows)


def repeated_windows(group: np.ndarray, off: np.ndarray, count: np.ndarray, data: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """For strings in order of group: which windows (row, window) are equal to one of another string of the group.

    One round per column, last to first. rows: the strings in order of their suffix from this column on, within a group;
    common: each row's common prefix with the row before.
    """
    m, most = len(group), int(count.max())
    out = np.zeros((m, most), bool)
    left, right = -off, count + width - 1 - off
    lo, hi = int(left.min()), int(right.max())
    with tempfile.TemporaryFile() as f:
        columns = np.memmap(f, np.int16, "w+", shape=(hi - lo, m))
        for j in range(hi - 1, lo - 1, -1):
            has = (left <= j) & (j < right)
            columns[hi - 1 - j] = np.where(has, data[np.where(has, begin + j - left, 0)], -1)
        rows, common = np.arange(m), np.zeros(m + 1, np.int16)
        base = group.astype(np.int64) * 512
        for j in range(hi - 1, lo - 1, -1):
            symbol = columns[hi - 1 - j]
            key = base[rows] + symbol[rows] + 1
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            same = np.zeros(m, bool)
            same[1:] = (key[1:] == key[:-1]) & (key[1:] % 512 > 0)
            at = np.flatnonzero(same)
            update = np.zeros(m + 1, np.int16)
            if len(at):
                pair = np.empty(2 * len(at), np.int64)
                pair[::2], pair[1::2] = order[at - 1] + 1, order[at] + 1
                update[at] = np.minimum.reduceat(common, pair)[::2] + 1
            common = update
            long = common[:m] >= width
            if long.any():
                either = long.copy()
                either[:-1] |= long[1:]
                r = rows[either]
                x = j - left[r]
                ok = (x >= 0) & (x < count[r])
                out[r[ok], x[ok]] = True
        del columns
    return out


def _index_strings(table: pa.Table, *, width: int) -> pa.Table:
    chunks = table.column("_chunk").to_pylist()
    seed, name, off, count, many = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int16), ("d", np.int16), ("e", bool)))
    chunk = np.repeat(np.arange(len(chunks)), [len(x) for x in table.column("e").to_pylist()])
    data = np.frombuffer(b"".join(table.column("f").to_pylist()), np.uint8)
    off, count = off.astype(np.int64), count.astype(np.int64)
    length = count + width - 1
    begin = np.cumsum(length) - length
    order = np.lexsort((name, seed))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (seed[order][1:] != seed[order][:-1])
    head = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)  # of each entry: its distinct string
    which[order] = np.cumsum(new) - 1
    own = order[head]
    marked = (np.add.reduceat(many[order].astype(np.int64), head) > 0) | (np.diff(np.append(head, len(order))) > 1)
    span = [(0, int(c)) if k else None for k, c in zip(marked, count[own], strict=True)]
    _, group, size = np.unique(seed[own], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((size[group] > 1) & (np.add.reduceat((~marked).astype(np.int64), np.append(0, np.cumsum(size)[:-1])) > 0)[group])
    spans: dict[int, list[tuple[int, int]]] = {k: [s] for k, s in enumerate(span) if s}
    if len(open_):
        p = own[open_]
        found = repeated_windows(group[open_], off[p], count[p], data, begin[p], width)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for (r, x), (_, y) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True):
            k = int(open_[r])
            if not marked[k]:
                spans.setdefault(k, []).append((int(x), int(y - x)))
    rows = []
    for c in range(len(chunks)):
        e = np.flatnonzero(chunk == c)
        flat = [(int(n), x, y) for n, k in zip(name[e], which[e], strict=True) for x, y in spans.get(int(k), ())]
        if flat:
            n, x, y = zip(*flat, strict=True)
            rows.append((chunks[c], None, pack(np.array(n, np.uint64)), pack(np.array(x, np.int16)), pack(np.array(y, np.int16)), None))
    return _rows(ANSWER, rows)


def _cut(table: pa.Table, facts: pa.Table, *, names: list[str], text: str, width: int, gram: int) -> pa.Table:
    seeds = facts.filter(pc.is_valid(facts.column("a")))
    runs = facts.filter(pc.is_valid(facts.column("b")))
    name, first, number = (np.concatenate([np.frombuffer(x, t) for x in runs.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in (("b", np.uint64), ("c", np.int16), ("d", np.int16)))
    o = np.argsort(name, kind="stable")
    name, first, number = name[o], first[o].astype(np.int64), number[o].astype(np.int64)
    buf, offs = texts_of(table.column(text))
    edge = np.zeros(len(buf) + 1, np.int32)
    for _, doc, start, _, _, _, own, _ in _strings(table, _repeated(seeds), text, width, gram):
        a, b = np.searchsorted(name, own, "left"), np.searchsorted(name, own, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = np.repeat(offs[doc] + start, n) + first[at]
        np.add.at(edge, x, 1)
        np.add.at(edge, x + number[at] + width - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for k in range(table.num_rows):
        g, b = gone[offs[k] : offs[k + 1]], buf[offs[k] : offs[k + 1]]
        some = g.any()
        n_bytes.append(len(b))
        n_removed.append(int(g.sum()) if some else 0)
        n_spans.append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if some else 0)
        kept.append(b[~g].tobytes() if some else b.tobytes())
    out = {c: table.column(c) for c in names}
    return pa.table(out | {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_bytes": pa.array(kept, pa.binary())})


def bwt_dedup(docs: DataFrame, *, width: int = 200, gram: int = 24, text: str = "text", doc_id: str = "doc_id", chunk_mb: float = 8, bucket_mb: float = 16) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes.

    A byte goes if a string of `width` bytes over it also starts anywhere else, in its own document too; every copy goes,
    the first included. Strings never cross documents and are judged on the input. Defined cases: a null text is empty;
    null and repeated ids are documents like others; shorter texts stay whole; an empty table gives an empty table; other
    columns pass through, but for columns of the names that are added, in any case, which are replaced. What is kept may cut a UTF-8
    character in two, hence bytes.
    """
    new = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_bytes": T.BinaryType()}
    docs, (text, doc_id), back = hidden(docs, text, doc_id)
    names = [c for c in docs.columns if c.lower() not in new]
    chunks, buckets = sized(docs, text, chunk_mb, bucket_mb)
    at = {"text": text, "width": width, "gram": gram}
    dealt = chunked(docs.select(*(f"`{c}`" for c in names)), chunks, doc_id, text).groupBy("_chunk")
    from .substring_rlz import SEND

    seeds = dealt.applyInArrow(one(_send_seeds, buckets=buckets, **at), SEND).groupBy("bucket").applyInArrow(one(_index_seeds), ANSWER)
    strings = dealt.cogroup(seeds.groupBy("_chunk")).applyInArrow(two(_send_strings, buckets=buckets, **at), STRINGS)
    places = strings.groupBy("bucket").applyInArrow(one(_index_strings, width=width), ANSWER)
    kinds = T.StructType([docs.schema[c] for c in names] + [T.StructField(k, v) for k, v in new.items()])
    return dealt.cogroup(seeds.unionByName(places).groupBy("_chunk")).applyInArrow(two(_cut, names=names, **at), kinds).withColumnsRenamed(back)
