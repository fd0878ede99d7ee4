"""Token counts of texts of any length, as the tokenizers library counts them.

Huge texts are cut into chunks that overlap and are encoded on their own, all over the cluster. The library's pattern looks
for a token's end from where the token before ended, and back no further; so once a chunk that is in step has an edge
between two of the pattern's matches at a byte, and the next chunk has one at the same byte, the next is in step from
there. Edges close to a chunk's end are not believed, since more text could move them. Two chunks are spliced at the last edge that both have in
their overlap. Where there is none, the overlap is widened, and in the end the chunks become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from souklens.plans.lineage import settled

from .media_tiff import _bounded
from .word_table import WordTable, byte_level

_loaded: dict[str, tuple] = {}


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _load(path: str | None) -> tuple:
    """The tokenizer, the length of each id in bytes, the strings of added tokens, how near an end an edge isn't believed, and the word table."""
    path = path or default_file()
    if path not in _loaded:
        t, data, added = byte_level(path, special=True)
        table = WordTable([lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]])
        _loaded[path] = t, np.array([len(d) for d in data], np.int64), added, 8 + max([0, *(len(a.encode()) for a in added)]), table
    return _loaded[path]


SLICED = "row long, id {id}, n_bytes long, n_tokens long, no long, start long, head string, core string"
MARKS = "row long, no long, total long, heads array<struct<at:long,before:long>>, tails array<struct<at:long,before:long>>"
_MARK = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))


def _sliced(df: DataFrame, model: str | None, step: int, overlap: int) -> DataFrame:
    """Short texts with their counts; of each other one, a row for each chunk: its own part (core) and the end of the part before (head)."""
    kind = dict(df.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, added, _, table = _load(model)
        t = _load(model)[0]
        for batch in _bounded(batches, "text", 1 << 21):
            rows, ids, texts = batch.column("row").to_pylist(), batch.column("id"), [x or "" for x in batch.column("text").to_pylist()]
            plain = [k for k, x in enumerate(texts) if len(x) <= step and not any(a in x for a in added)]
            count: dict[int, int] = dict(zip(plain, table.encode([texts[k] for k in plain])[0][1].tolist(), strict=True)) if plain else {}
            at, out = [], []
            for k, x in enumerate(texts):
                n = len(x.encode())
                if k in count or len(x) <= step:
                    at.append(k)
                    out.append((rows[k], n, count[k] if k in count else len(t.encode(x, add_special_tokens=False).ids), None, None, None, None))
                    continue
                begun = 0
                for no, i in enumerate(range(0, len(x), step)):
                    head, core = x[max(0, i - overlap) : i], x[i : i + step]
                    at.append(k)
                    out.append((rows[k], n, None, no, begun, head, core))
                    begun += len(core.encode())
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([cols[0], ids.take(pa.array(at)), *cols[1:]], names=["row", "id", "n_bytes", "n_tokens", "no", "start", "head", "core"])

    return df.mapInArrow(run, SLICED.format(id=kind))


def _marked(chunks: DataFrame, model: str | None, overlap: int) -> DataFrame:
    """Of each chunk: its tokens, and the edges of its matches within both overlaps, as a place in the text and the tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, size, _, near, _ = _load(model)
        for batch in _bounded(batches, "core", 1 << 20):
            out = []
            for row, no, start, head, core in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "start", "head", "core")), strict=True):
                e = t.encode(head + core, add_special_tokens=False)
                begin = start - len(head.encode())
                end = begin + np.concatenate([[0], np.cumsum(size[np.array(e.ids, np.int64)])])
                word = np.array(e.word_ids, np.int64)
                edges = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1]) if len(word) else np.zeros(0, np.int64)
                place = end[edges]
                marks = [{"at": a, "before": b} for a, b in zip(place.tolist(), edges.tolist(), strict=True)]
                low = np.searchsorted(place, start, "right")
                late = slice(max(low, np.searchsorted(place, end[-1] - 4 * overlap)), np.searchsorted(place, end[-1] - near, "right"))
                out.append((row, no, len(e.ids), marks[:low] if head else [], marks[late]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), _MARK, _MARK), strict=True)], names=["row", "no", "total", "heads", "tails"])

    return chunks.select("row", "no", "start", "head", "core").repartition("row", "no").mapInArrow(run, MARKS)


def _cuts(marks: DataFrame) -> DataFrame:
    """For each chunk with one before it: the last common edge, as tokens before it in either chunk (null if they have none)."""
    left = marks.select("row", (F.col("no") + 1).alias("no"), F.col("total").alias("left_total"), F.explode("tails").alias("m")).select("row", "no", "left_total", F.col("m.at").alias("at"), F.col("m.before").alias("left"))
    right = marks.select("row", "no", F.explode("heads").alias("m")).select("row", "no", F.col("m.at").alias("at"), F.col("m.before").alias("right"))
    last = left.join(right, ["row", "no", "at"]).groupBy("row", "no").agg(F.max_by(F.struct("left_total", "left", "right"), "at").alias("cut"))
    return marks.where("no > 0").select("row", "no").join(last, ["row", "no"], "left")


def _widened(chunks: DataFrame, failed: DataFrame, overlap: int, step: int) -> DataFrame:
    """Chunks where each failed one has a longer overlap, or, once a chunk before would be all overlap, is one with it."""
    f = failed.select("row", "no", F.lit(1).alias("bad"))
    if overlap < step:
        before = chunks.select("row", (F.col("no") + 1).alias("no"), F.expr(f"right(core, {overlap})").alias("more")).join(f, ["row", "no"])
        return chunks.join(before.drop("bad"), ["row", "no"], "left").withColumn("head", F.coalesce("more", "head")).drop("more")
    order = W.partitionBy("row").orderBy("no")
    runs = chunks.select("row", "no").join(f, ["row", "no"], "left").select("row", "no", (F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0)).over(order) - 1).alias("run"))
    part = F.struct("no", "start", "head", "core")
    whole = chunks.join(runs, ["row", "no"]).groupBy("row", "run").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("row", F.col("run").alias("no"), F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["head"].alias("head"), F.array_join("parts.core", "").alias("core"))


def token_counts(df: DataFrame, id: str = "doc_id", column: str = "text", model: str | None = None, step: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """One row for each of df's: the id column, n_bytes (UTF-8) and n_tokens, exactly the library's for the whole text.

    model: a byte-level file of the tokenizers library, at the same path on every executor; by default the installed package's. Strings
    of added tokens within texts count as the library takes them by default. step: characters from which a text is cut; overlap: of
    two chunks, at first. Texts up to step are counted by words, each distinct word encoded once a worker; those that hold an added
    token's string, by the library whole.

    A null or empty text has no tokens. Repeated rows, null ids and equal ids are rows of their own; an empty table has no rows;
    other columns of df are dropped, so none can clash. A text without edges (one match longer than many chunks) ends as one
    chunk in one task, since no edge in it could be proven.
    """
    rows = df.select(F.col(id).alias("id"), F.col(column).alias("text")).withColumn("row", F.monotonically_increasing_id())
    sliced = settled(_sliced(rows, model, step, overlap))
    done = [sliced.where("no is null").select("id", "n_bytes", "n_tokens")]
    chunks = sliced.where("no is not null").select("row", "no", "start", "head", "core")
    while not chunks.isEmpty():
        marks = settled(_marked(chunks, model, overlap))
        cuts = settled(_cuts(marks))
        failed = cuts.where("cut is null")
        bad = settled(failed.select("row").distinct())
        total = marks.select("row", F.col("total").alias("n")).unionByName(cuts.select("row", (F.col("cut.left") - F.col("cut.left_total") - F.col("cut.right")).alias("n")))
        counts = total.join(bad, "row", "left_anti").groupBy("row").agg(F.sum("n").alias("n_tokens"))
        texts = sliced.where("no = 0").select("row", "id", "n_bytes")
        done.append(texts.join(counts, "row").select("id", "n_bytes", "n_tokens"))
        if bad.isEmpty():
            break
        overlap *= 8
        chunks = settled(_widened(chunks.join(bad, "row", "left_semi"), failed, overlap, step))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id", id)
