"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification, banded buckets, star edges.

Texts with the same set of shingles are one class from the start. Each class gets a signature from one hash of each
shingle: its bin and the least value in each bin; an empty bin borrows from the first full bin in an order of bins of its
own. Bands of the signature are bucket keys. In a bucket no pairs are made: members get edges to a *centre*, the member
that meets most others over all its buckets. Edges are confirmed on the full sets of shingles.

A bucket whose members are then still in several components holds pairs that the star left out. Those members are dealt to
*tiles* of bounded size (the largest such bucket of each member, salted), and two tiles meet in one task if a bucket has
members of both: the smaller one visits the larger one. A task compares its members on their full sets at once, by counting
common shingles, and returns a spanning forest of the links that it finds: at most one row for each member, whatever the
number of pairs. Every pair that shares a bucket is thus either in one component by the stars or tested. Edges and
components are Spark tables; each step's are written to the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import block_ranges, ids_of, lower_ascii, mix, one, rolling, settled, texts_of, word_hashes, word_spans

SHINGLE, BINS, ROWS = 5, 240, 6
#: A tile holds about so many members, and about so many shingles, whichever is reached first.
TILE, TILE_SHINGLES = 256, 1 << 19


def shingle_sets(column, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of texts: first and last text, the sorted distinct shingle fingerprints of all its texts in a row, and where each text's begin."""
    buf, offs = texts_of(column)
    for i, j in block_ranges(offs):
        b, o = lower_ascii(buf[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        starts, ends, first = word_spans(b, o)
        words = mix(word_hashes(b, starts, ends))
        n = np.diff(first)
        grams = rolling(words, size)
        doc = np.repeat(np.arange(j - i), n)
        at = np.flatnonzero(doc[: len(grams)] == doc[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
        doc_of, value = [doc[at]], [grams[at]]
        short = np.flatnonzero((n > 0) & (n < size))
        for k in range(1, size):  # a text of fewer words is one shingle
            s = short[n[short] == k]
            if len(s):
                doc_of.append(s)
                value.append(rolling(words, k)[first[s]] + np.uint64(k))
        doc_of, value = np.concatenate(doc_of), np.concatenate(value)
        order = np.lexsort((value, doc_of))
        doc_of, value = doc_of[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc_of[1:] != doc_of[:-1])
        doc_of, value = doc_of[new], value[new]
        yield i, j, value, np.searchsorted(doc_of, np.arange(j - i + 1))


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its own order of all bins, and the place of each bin in that order."""
    cell = np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mix(cell).reshape(bins, bins), axis=1)
    return order, np.argsort(order, axis=1)


def signatures(value: np.ndarray, first: np.ndarray, bins: int = BINS, draws: int = 12) -> np.ndarray:
    """One row of bins per set (sets must not be empty). An empty bin takes the value of the full bin that comes first in
    the bin's own order; the first `draws` places are tried for all sets together, the rest for each set by itself."""
    n = len(first) - 1
    h = mix(value ^ np.uint64(0xD6E8FEB86659FD93))
    key = np.repeat(np.arange(n), np.diff(first)) * bins + (h % np.uint64(bins)).astype(np.int64)
    sig = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    order = np.lexsort((h, key))
    key, h = key[order], h[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    sig[key[head]] = h[head]
    sig = sig.reshape(n, bins)
    full = np.zeros((n, bins), bool)
    full.reshape(-1)[key[head]] = True
    row, col = np.nonzero(~full)
    if not len(row):
        return sig
    order, place = _orders(bins)
    for step in range(draws):
        source = order[col, step]
        ok = full[row, source]
        sig[row[ok], col[ok]] = sig[row[ok], source[ok]]
        row, col = row[~ok], col[~ok]
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    for x, y in zip(cut, np.append(cut, len(row))[1:], strict=True):
        r, empty = row[x], col[x:y]
        some = np.flatnonzero(full[r])
        sig[r, empty] = sig[r, some[np.argmin(place[empty][:, some], axis=1)]]
    return sig


def _signed(batches: Iterator[pa.RecordBatch], doc_id: str, text: str, rows: int, bins: int) -> Iterator[pa.RecordBatch]:
    """(_id, doc, n_shingles, set_a, set_b, bands): a 128-bit name of each set, and its bucket keys (none for an empty set)."""
    count = bins // rows
    for batch in batches:
        ids = ids_of(batch.column(doc_id))
        for i, j, value, first in shingle_sets(batch.column(text)):
            n = np.diff(first)
            some = np.flatnonzero(n > 0)
            bands = np.zeros((len(some), count), np.uint64)
            for k in range(0, len(some), 512):
                own = some[k : k + 512]
                at = np.repeat(first[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(n[own].sum())
                sig = signatures(value[at], np.concatenate([[0], np.cumsum(n[own])]), bins)
                band = np.zeros((len(own), count), np.uint64)
                for c in range(rows):
                    band = mix(band * np.uint64(31) + sig[:, c::rows])
                bands[k : k + 512] = mix(band + np.arange(count, dtype=np.uint64))
            a = np.concatenate([[np.uint64(0)], np.cumsum(mix(value))])
            b = np.concatenate([[np.uint64(0)], np.cumsum(mix(value * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)))])
            names = [pa.array((x[first[1:]] - x[first[:-1]]).view(np.int64)) for x in (a, b)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * count)]).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), batch.column("doc").slice(i, j - i), pa.array(n), *names, lists], names=["_id", "doc", "n_shingles", "set_a", "set_b", "bands"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the rows (a, b, text_a, text_b) whose sets have 100 * intersection >= percent * union."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            sets = []
            for c in ("text_a", "text_b"):
                own = []
                for i, j, value, first in shingle_sets(b.column(c)):
                    own += [value[first[k] : first[k + 1]] for k in range(j - i)]
                sets.append(own)
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)])
            n = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)])
            ok = 100 * same >= percent * (n - same)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "linked"])


def _common(sets: list[np.ndarray], own: int, dense: int = 24) -> np.ndarray:
    """How many shingles each of the first `own` sets shares with each set. Shingles of many sets are counted by a product of
    0/1 matrices, a slab of shingles at a time; those of few sets pair by pair."""
    n = len(sets)
    who = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, who = value[order], who[order]
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(value)))
    same = np.zeros((own, n), np.float32)
    many = np.flatnonzero(size > dense)
    for k in range(0, len(many), 4096):
        slab = many[k : k + 4096]
        at = np.repeat(head[slab] - (np.cumsum(size[slab]) - size[slab]), size[slab]) + np.arange(size[slab].sum())
        has = np.zeros((n, len(slab)), np.float32)
        has[who[at], np.repeat(np.arange(len(slab)), size[slab])] = 1
        same += has[:own] @ has.T
    flat = same.reshape(-1)
    for c in np.unique(size[(size > 1) & (size <= dense)]):
        members = who[head[size == c][:, None] + np.arange(c)]  # ascending in each row
        for i in range(c):
            for j in range(c):
                if i != j:
                    hit = members[:, i] < own
                    flat += np.bincount(members[hit, i].astype(np.int64) * n + members[hit, j], minlength=own * n).astype(np.float32)
    return same


def _linked_in_tile(table: pa.Table, *, percent: int) -> pa.Table:
    """A spanning forest (a, b) of the links between the members of a tile, and between them and its visitors, that stand in
    different components so far."""
    table = table.take(pa.compute.sort_indices(table.column("guest")))
    own = int(pa.compute.sum(pa.compute.invert(table.column("guest"))).as_py() or 0)
    ids, component = table.column("_id").to_numpy(), table.column("component").to_numpy()
    sets = []
    for i, j, value, first in shingle_sets(table.column("text")):
        sets += [value[first[k] : first[k + 1]] for k in range(j - i)]
    n = np.array([len(x) for x in sets], np.int64)
    same = _common(sets, own)
    a, b = np.nonzero((100 * same >= percent * (n[:own, None] + n[None, :] - same)) & (component[:own, None] != component[None, :]))
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[tied]), "b": pa.array(ids[root[tied]])})


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids in links (a, b): large-star and small-star steps until every id but the roots has one
    edge, to its root."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        up = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
        down = edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
        ends = up.unionByName(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up = 1 and root = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def node_of(doc_id: str = "doc_id", text: str = "text"):
    """The key of a row among the links: rows of the same id (or of none) and text have the same. It has 64 bits: among n
    different rows two meet with odds of about n * n / 2**65."""
    number = F.col(f"`{doc_id}`").cast("long")
    return F.xxhash64(F.lit(3), number.isNull(), F.coalesce(number, F.lit(0)), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _memberships(classes: DataFrame) -> DataFrame:
    """(bucket, _id, n, degree) of the buckets with two members or more. Buckets of the same members say the same: one of
    them stays; degree, how many members a class meets, counts them all."""
    members = classes.select(F.col("rep").alias("_id"), "n", F.explode("bands").alias("bucket")).repartition("bucket")
    print_of = [F.bit_xor(F.xxhash64("_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *print_of).where("size > 1")
    shared = shared.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times"))
    members = settled(members.join(shared.select("bucket", (F.col("size") * F.col("times")).alias("weight")), "bucket"))
    return settled(members.join(members.groupBy("_id").agg(F.sum("weight").alias("degree")), "_id").drop("weight"))


def _star_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the confirmed edges between the members of each bucket and its centre."""
    centre = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("_id")).alias("m"), "n")).alias("c"))
    centre = centre.select("bucket", (-F.col("c.m")).alias("y"), F.col("c.n").alias("ny"))
    edges = members.join(centre, "bucket").where(f"_id <> y and 100 * least(n, ny) >= {percent} * greatest(n, ny)")
    edges = edges.select(F.least("_id", "y").alias("a"), F.greatest("_id", "y").alias("b")).distinct()
    pairs = edges.join(texts.select(F.col("_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("_id").alias("b"), F.col("text").alias("text_b")), "b")
    found = pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirm(it, percent), "a long, b long, linked boolean")
    return settled(found.where("linked").select("a", "b"))


def _tile_links(members: DataFrame, label: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of a spanning forest of the links among the members of buckets that still hold several components."""
    where = members.join(label, members["_id"] == label["id"], "left").select("bucket", "_id", "n", F.coalesce("component", "_id").alias("component"))
    mixed = where.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    active = settled(where.join(mixed.select("bucket", "size"), "bucket"))
    home = active.groupBy("_id").agg(F.max(F.struct("size", "bucket"))["bucket"].alias("home"), F.first("n").alias("n"), F.first("component").alias("component"))
    salts = home.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).alias("salts"))
    tile = F.xxhash64("home", F.pmod(F.xxhash64("_id"), F.col("salts")))
    tiled = settled(home.join(salts, "home").select("_id", "n", "component", tile.alias("tile")))
    size = tiled.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    tiles_of = active.select("bucket", "_id").join(tiled.select("_id", "tile"), "_id").select("bucket", "tile").distinct().join(size.select("tile", "size"), "tile")
    visits = tiles_of.select("bucket", F.struct("size", "tile").alias("guest")).join(tiles_of.select("bucket", F.struct("size", "tile").alias("host")), "bucket").where("guest < host")
    visits = settled(visits.select(F.col("guest.tile").alias("tile"), F.col("host.tile").alias("host")).distinct())
    guests = visits.join(tiled, "tile").select("host", "_id", "n", "component")
    shares = guests.groupBy("host").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).alias("shares"))
    guests = guests.join(shares, "host").select(F.col("host").alias("tile"), F.pmod(F.xxhash64(F.lit(5), "_id"), "shares").alias("share"), F.lit(True).alias("guest"), "_id", "component")
    hosts = tiled.join(shares.withColumnRenamed("host", "tile"), "tile", "left").join(size.select("tile", "size"), "tile").where("size > 1 or shares is not null")
    hosts = hosts.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1).cast("long")) - 1)).alias("share"), F.lit(False).alias("guest"), "_id", "component")
    rows = hosts.unionByName(guests).join(texts, "_id")
    return settled(rows.groupBy("tile", "share").applyInArrow(one(_linked_in_tile, percent=percent), "a long, b long"))


def near_duplicates(docs: DataFrame, *, percent: int = 80, bins: int = BINS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links reach) and kept (doc_id is it).

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the five-word shingles, or the whole
    sequence of a shorter text. Each id and text is a node of its own: texts that share an id (or have none) are linked only by
    likeness. Defined cases: null and blank texts are empty sets, linked with nothing; a null id comes back as null and is never
    the smallest; a component without ids keeps the rows of one node; repeated rows are one node and each comes back; an empty
    table gives an empty table; other columns are not read.
    """
    return near_groups(docs, percent=percent, bins=bins, rows=rows, text=text, doc_id=doc_id).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame, *, percent: int = 80, bins: int = BINS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """near_duplicates with node (see node_of), component (the key of its group; its own for a row linked with nothing) and
    first (of the rows of its group, those of one node; all rows of empty sets)."""
    d = docs.select(node_of(doc_id, text).alias("_id"), F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    signed = settled(d.mapInArrow(lambda it: _signed(it, "_id", "text", rows, bins), "_id long, doc long, n_shingles long, set_a long, set_b long, bands array<long>"))
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("set_a", "set_b").agg(F.min("_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("bands", "_id").alias("bands"))
    members = _memberships(classes)
    texts = settled(d.select("_id", "text").join(members.select("_id").distinct(), "_id", "left_semi").dropDuplicates(["_id"]))
    same = full.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    label = components(_star_links(members, texts, percent).unionByName(same))
    more = _tile_links(members, label, texts, percent)
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    names = signed.select("_id", "doc").distinct().join(label, F.col("_id") == F.col("id")).select("_id", "doc", "component")
    least = names.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "_id")).alias("least"))
    found = names.join(least, "component").select("_id", "component", F.col("least.doc").alias("least"), F.col("least._id").alias("least_id"))
    out = signed.select("_id", "doc", "n_shingles").join(found, "_id", "left")
    alone = F.col("component").isNull()
    first = alone | (F.col("_id") == F.col("least_id"))
    kept = F.when(alone | F.col("least").isNull(), first).otherwise(F.coalesce(F.col("doc") == F.col("least"), F.lit(False)))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.when(alone, F.col("doc")).otherwise(F.col("least")).alias("component_id"), kept.alias("kept"), F.col("_id").alias("node"), F.coalesce("component", "_id").alias("component"), first.alias("first"))
