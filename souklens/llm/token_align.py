"""Alignment of two tokenizers on the same bytes, and how many documents of the corpus link each pair of ids.

Within a task everything is on Arrow columns of a batch of documents: flattened lists with their parents, sums within each
document for the bytes at which tokens end, and a full join of both sides on (document, end). Sorted, the join's rows are the
stretches in which one token of either side lies, so each row is a link; rows that have both sides close a group. A batch is
one row of a table: its documents, its distinct pairs and the documents that hold each. Spark sums these partial counts over
the corpus, and each batch gets back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from souklens.plans.lineage import shared_folder

from .media_tiff import _bounded
from .pieces import default_model
from .token_counts import default_file
from .word_table import WordTable, byte_level

_loaded: dict[tuple, tuple] = {}
#: Ids are below 2 ** 31 and a batch has fewer documents, so two fit a long.
HIGH = 32


def _piece_bytes(name: str) -> bytes:
    return bytes([int(name[3:5], 16)]) if len(name) == 6 and name.startswith("<0x") else name.replace("▁", " ").encode()


def _load(file: str | None, model: str | None) -> tuple:
    """The word table of both encoders, and for each the bytes, sizes and decimal strings of its ids."""
    key = (file or default_file(), model or default_model())
    if key not in _loaded:
        import sentencepiece

        a, bytes_a, _ = byte_level(key[0], special=False)
        b = sentencepiece.SentencePieceProcessor(model_file=key[1])
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or b.encode("\n") != b.encode("\n\n")[:2]:
            raise ValueError("pieces of this model cross white space")
        encoders = [lambda words: [e.ids for e in a.encode_batch_fast(words, add_special_tokens=False)], lambda words: [ids[2:] for ids in b.encode(["\n" + w for w in words], num_threads=1)]]
        sides = [(data, pa.array([len(d) for d in data], pa.int64()), pa.array([str(k) for k in range(len(data))])) for data in (bytes_a, [_piece_bytes(p) for p in pieces])]
        bytes_b = [data for data, *_ in sides][1]
        kept = lambda word, ids_a, ids_b: b"".join(map(bytes_a.__getitem__, ids_a)) == b"".join(map(bytes_b.__getitem__, ids_b)) == word.encode()
        _loaded[key] = WordTable(encoders, check=kept), sides
    return _loaded[key]


def _ends(ids: pa.ListArray, size: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All ids of a list for each document, and (document, end) of each as one long; ends count from the document's start."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    n = pc.take(size, flat)
    total = pc.cumulative_sum(n)
    before = pc.subtract(total, n)
    first = pc.take(before, pc.cast(ids.offsets.slice(0, len(ids)), pa.int64()).filter(pc.greater(pc.list_value_length(ids), 0))) if len(flat) else before
    runs = pc.list_value_length(ids).filter(pc.greater(pc.list_value_length(ids), 0)).to_numpy()
    start = pc.take(first, pa.array(np.repeat(np.arange(len(runs)), runs)))
    return flat, pc.bit_wise_or(pc.shift_left(pc.cast(doc, pa.int64()), pa.scalar(HIGH, pa.int64())), pc.subtract(total, start))


def _lists(counts, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def align(a: pa.ListArray, b: pa.ListArray, sides: list) -> dict[str, pa.Array]:
    """Two lists of ids for each document, of the same bytes: n_groups, n_links, groups (text), and the distinct linked pairs of each
    document as doc, pair (A's id high) and times, by document and pair."""
    docs = len(a)
    flat_a, key_a = _ends(a, sides[0][1])
    flat_b, key_b = _ends(b, sides[1][1])
    left = pa.table({"key": key_a, "a": pa.array(np.arange(len(flat_a)))})
    right = pa.table({"key": key_b, "b": pa.array(np.arange(len(flat_b)))})
    rows = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    rows = rows.take(pc.sort_indices(rows["key"])).combine_chunks()
    key, at_a, at_b = (rows[c].chunk(0) if len(rows) else pa.array([], pa.int64()) for c in ("key", "a", "b"))
    doc = pc.shift_right(key, pa.scalar(HIGH, pa.int64()))
    shut = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(pc.take(flat_a, pc.fill_null_backward(at_a)), pa.int64()), pa.scalar(HIGH, pa.int64())), pc.cast(pc.take(flat_b, pc.fill_null_backward(at_b)), pa.int64()))
    n_links = np.bincount(doc.to_numpy(), minlength=docs)
    n_groups = np.bincount(doc.filter(shut).to_numpy(), minlength=docs)
    texts = []
    for flat, at, side in ((flat_a, at_a, sides[0]), (flat_b, at_b, sides[1])):
        edges = np.concatenate([[-1], at.filter(shut).to_numpy()])
        texts.append(pc.binary_join(_lists(np.diff(edges), pc.take(side[2], flat)), ","))
    groups = pc.binary_join(_lists(n_groups, pc.binary_join_element_wise(*texts, "|")), ";")
    found = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    found = found.take(pc.sort_indices(found, [("doc", "ascending"), ("pair", "ascending")])).combine_chunks()
    found = {c: found[n].chunk(0) if len(found) else pa.array([], pa.int64()) for c, n in (("doc", "doc"), ("pair", "pair"), ("times", "count_all"))}
    return {"n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "groups": groups} | found


DOC = "id:{id},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups:string,pairs:array<int>,times:array<int>"
BATCH = f"batch long, docs array<struct<{DOC}>>, pairs array<struct<pair:bigint,n:bigint>>"


def _batches(df: DataFrame, file: str | None, model: str | None, digest: bool, limit: int) -> DataFrame:
    """One row for each batch of documents."""
    schema = T._parse_datatype_string(BATCH.format(id=dict(df.dtypes)["id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sides = _load(file, model)
        for no, batch in enumerate(_bounded(batches, "text", limit)):
            docs, own = _aligned(batch, table, sides, digest)
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + no], pa.int64()), _lists([len(docs)], docs), _lists([len(own)], own)], names=["batch", "docs", "pairs"])

    return df.mapInArrow(run, schema)


#: Bytes of text that are encoded and joined at once, one document at least.
STEP = 1 << 19


def _aligned(batch: pa.RecordBatch, table: WordTable, sides: list, digest: bool, step: int = STEP) -> tuple[pa.Array, pa.Array]:
    """The documents of a batch, and its distinct pairs with the documents that hold each. Documents are aligned a few at a time, so
    that only their results, not their words, tokens and joins, are held for the whole batch."""
    parts: list[list] = []
    for few in _bounded([batch], "text", step):
        texts = [x or "" for x in few.column("text").to_pylist()]
        (ids_a, len_a), (ids_b, len_b) = table.encode([" " + x if x else "" for x in texts])
        sure = table.sure
        lists = [_lists(len_a, pa.array(ids_a, pa.int32())), _lists(len_b, pa.array(ids_b, pa.int32()))]
        same = np.array([bool(x) and (bool(k) or _same(x, lists[0][i], lists[1][i], sides)) for i, (x, k) in enumerate(zip(texts, sure, strict=True))], bool)
        if not same.all():
            lists = [_lists(np.where(same, n, 0), pa.array(ids[np.repeat(same, n)], pa.int32())) for ids, n in ((ids_a, len_a), (ids_b, len_b))]
        got = align(*lists, sides)
        groups = got["groups"]
        if digest:
            groups = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()], pa.string())
        held = pa.array(np.bincount(got["doc"].to_numpy(), minlength=len(texts)), pa.int64())
        parts.append([*[pc.cast(pc.list_value_length(x), pa.int64()) for x in lists], got["n_groups"], got["n_links"], groups, held, got["pair"], pc.cast(got["times"], pa.int32())])
    *cols, held, pair, times = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
    counts = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair").combine_chunks()
    pairs = counts["pair"].combine_chunks()
    held = held.to_numpy()
    docs = pa.StructArray.from_arrays([batch.column("id"), *cols, _lists(held, pc.cast(pc.index_in(pair, pairs), pa.int32())), _lists(held, times)], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
    return docs, pa.StructArray.from_arrays([pairs, pc.cast(counts["count_all"].combine_chunks(), pa.int64())], names=["pair", "n"])


def _same(text: str, a: pa.ListScalar, b: pa.ListScalar, sides: list) -> bool:
    """Whether both sides' joined bytes are a blank and the text."""
    want = b" " + text.encode()
    return bool(text) and all(b"".join(map(side[0].__getitem__, ids.values.to_numpy().tolist())) == want for ids, side in ((a, sides[0]), (b, sides[1])))


def align_tokens(df: DataFrame, id: str = "doc_id", column: str = "text", file: str | None = None, model: str | None = None, digest: bool = False, limit: int = 1 << 22) -> DataFrame:
    """One row for each of df's: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A encodes a blank and the text by a byte-level file, B the text by a piece model; added tokens' strings are plain text for both.
    groups: ids between common ends, as `a1,a2|b1;a3|b2,b3`, or its hex SHA-256 with digest. A pair's count is how many documents
    hold it linked; n_best: links whose count is their A id's highest; count_sum: the counts of all links. limit: bytes of text a batch,
    one document at least; a document is aligned in one task, with some hundred bytes of memory for each of its tokens.

    Null or empty texts, and those whose bytes a side doesn't keep, have zeros and empty groups, and count for no pair. Repeated rows
    and equal or null ids are documents of their own; an empty table has no rows; df's other columns are dropped, so none can clash.

    The batches' table is written to the shared folder, where the result reads it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(column).alias("text"))
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    _batches(rows, file, model, digest, limit).write.parquet(path)
    table = spark.read.schema(BATCH.format(id=dict(rows.dtypes)["id"])).parquet(path)
    own = table.select("batch", F.posexplode("pairs").alias("pos", "p")).select("batch", "pos", F.col("p.pair").alias("pair"), F.col("p.n").alias("n"))
    counts = own.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", HIGH))
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    answers = own.join(counts, "pair").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pos", "count", "best"))).alias("answers"))
    joined = table.select("batch", "docs").join(answers, "batch", "left").select("docs", F.col("answers.count").alias("counts"), F.col("answers.best").alias("bests"))
    out = T.StructType([T.StructField(id, rows.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups", T.StringType())])
    return joined.mapInArrow(lambda batches: _summed(batches, id), out)


def _summed(batches: Iterator[pa.RecordBatch], id: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            docs = row.column("docs").flatten()
            f = dict(zip(docs.type.names, docs.flatten(), strict=True)) if hasattr(docs.type, "names") else {docs.type.field(i).name: c for i, c in enumerate(docs.flatten())}
            at, times, doc = pc.list_flatten(f["pairs"]), pc.cast(pc.list_flatten(f["times"]), pa.int64()), pc.list_parent_indices(f["pairs"])
            counts, bests = row.column("counts").flatten(), row.column("bests").flatten()
            sums = []
            for value in (pc.if_else(pc.take(bests, at), times, 0), pc.multiply(pc.take(counts, at), times)):
                edge = np.concatenate([[0], np.cumsum(value.to_numpy(zero_copy_only=False))])
                stop = np.cumsum(np.bincount(doc.to_numpy(), minlength=len(docs)))
                sums.append(pa.array(edge[stop] - edge[np.concatenate([[0], stop[:-1]])], pa.int64()))
            yield pa.RecordBatch.from_arrays([f["id"], f["n_a"], f["n_b"], f["n_groups"], f["n_links"], *sums, f["groups"]], names=[id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
