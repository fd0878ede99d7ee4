"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model none of whose pieces has the white space marker after another character, no merge crosses the place where a run
of markers begins; nor does any merge touch a character that is in no piece. A text is therefore cut before each run of
blanks and around each line feed, each distinct chunk is segmented once by the library, and its ids are joined back by the
chunk's position. The table is kept from block to block and emptied when it has grown past its bound, which only costs
segmenting a chunk again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .media_tiff import _bounded, _plus, _schema

CHUNK = regex.compile(r" *[^ \n]+| +|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """chunk -> number; ids of all chunks in one array. The model file is read once in each Python worker."""

    def __init__(self, model: str, bound: int = 300_000):
        import sentencepiece

        self.model, self.bound = sentencepiece.SentencePieceProcessor(model_file=model), bound
        sizes = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in sizes]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.model.encode("\n") != self.model.encode("\n\n")[:2]:
            raise ValueError("pieces of this model cross white space")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.length: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, chunks: list[str]) -> None:
        """Segments new chunks. Behind a line feed the library adds no marker of its own to a chunk."""
        got = self.model.encode(["\n" + c for c in chunks], num_threads=1)
        self.text += [t[1:] for t in self.model.decode(got, num_threads=1)]
        self.ids.append(np.fromiter((i for g in got for i in g[2:]), np.int32))
        self.length.append(np.fromiter((len(g) - 2 for g in got), np.int64, len(got)))
        n = len(self.number)
        self.number.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, the number of ids of each, and the decoded texts."""
        chunks = [CHUNK.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        if len(self.number) > self.bound:
            self.clear()
        new = list(set().union(*chunks).difference(self.number))
        if new:
            self.add(sorted(new))
        number, text = self.number.__getitem__, self.text.__getitem__
        at = [list(map(number, c)) for c in chunks]
        decoded = ["".join(map(text, a))[1:] for a in at]
        self.ids, self.length = [np.concatenate(self.ids)], [np.concatenate(self.length)]
        flat = np.fromiter((k for a in at for k in a), np.int64)
        length = self.length[0]
        start = np.cumsum(length) - length
        n = length[flat]
        ids = self.ids[0][np.repeat(start[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        edge = np.cumsum([0, *map(len, at)])
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[edge[1:]] - total[edge[:-1]], decoded


_tables: dict[str, ChunkTable] = {}


def encode_pieces(df: DataFrame, column: str = "text", model: str | None = None, bound: int = 300_000) -> DataFrame:
    """df with ids (array of int, no begin or end ids) and decoded.

    Exactly what the library's encode and decode give for the whole text. A null text is empty: no ids, an empty decoded
    text. Columns of the added names are replaced; others pass through. model: the file's path on every executor; by
    default each worker asks the installed package of public tokenizers for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model or default_model()
        table = _tables.get(path) or _tables.setdefault(path, ChunkTable(path, bound))
        for batch in _bounded(batches, column, 1 << 21):
            ids, n, decoded = table.encode([t or "" for t in batch.column(column).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield _plus(batch, {"ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), "decoded": pa.array(decoded, pa.string())})

    return df.mapInArrow(run, _schema(df, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}))


def digests(encoded: DataFrame) -> list:
    """n_tokens, ids_sha256 and decoded_sha256 as columns of an encoded table."""
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
