import hashlib
import pathlib
import random
import subprocess
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from souklens.llm.queries import QUERIES
from souklens.llm.token_align import _aligned, _load, _piece_bytes, align_tokens
from souklens.llm.word_table import byte_level

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_, BYTES_A, _ = byte_level(public_tokenizers.path("byte_bpe_50k.json"), special=False)
ODD = [None, "", " ", "\n", "▁", "a ▁ b", "<|endoftext|> hi", "<s> <unk> </s>", "don't  stop\n\n now", "\t\t x \t y", "é漢字🙂 ok", "x" * 3000, "a\x00b", "　 ideographic　 space ", "a\x85 b\x1c c", "​ ﻿ z", "word " * 400]


def tokens(text):
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    ends = []
    for ids, name in ((a, BYTES_A.__getitem__), (b, lambda i: _piece_bytes(B.id_to_piece(i)))):
        data = [name(i) for i in ids]
        if not text or b"".join(data) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i, d in zip(ids, data, strict=True):
            side.append((i, at, at + len(d)))
            at += len(d)
        ends.append(side)
    return ends


def brute(rows):
    held, docs = Counter(), []
    for i, text in rows:
        a, b = tokens(text or "")
        cut = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ";".join("|".join(",".join(str(x[0]) for x in side if lo < x[2] <= hi) for side in (a, b)) for lo, hi in zip([0, *cut], cut, strict=False))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        held.update(set(links))
        docs.append((i, len(a), len(b), len(cut), links, groups))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(i, a, b, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), s) for i, a, b, g, links, s in docs]


def texts():
    r = random.Random(8)
    return ODD + ["".join(r.choice(["the ", "cat", " ", "  ", "\n", "é", "12", "'s", "Über", ",", "\t", "🙂", "ing "]) for _ in range(r.randint(1, 60))) for _ in range(250)]


def test_equals_brute_force(spark):
    rows = [(k % 200 or None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, groups string, batch int").repartition(4)
    for limit in (1 << 22, 500):
        got = align_tokens(df, limit=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows), key=repr)
    assert align_tokens(df.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in align_tokens(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_query(spark, tmp_path):
    rows = list(enumerate(texts()[:60]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_align"](spark, str(tmp_path))
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows)]
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


MEMORY = """
import random, sys
import pyarrow as pa
from souklens.llm import token_align as ta
r = random.Random(3)
rows = [" ".join(r.choice(["the", "cat,", "straightforwardly", "and"]) + str(r.randint(0, 3000)) for _ in range(300)) for _ in range(1500)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["id", "text"])
ta.TaskContext = type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())})
df = type("Rows", (), {"dtypes": [("id", "bigint")], "mapInArrow": lambda self, run, schema: run})()
ta.T = type("Types", (), {"_parse_datatype_string": staticmethod(lambda s: None)})
out = list(ta._batches(df, None, None, True, 1 << 22)(iter([batch])))
print(pa.default_memory_pool().max_memory() / batch.nbytes)
"""


def test_memory_of_a_batch():
    """Beside its results a batch of documents holds the words, tokens and joins of a few of them only."""
    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, cwd=pathlib.Path(__file__).parents[2])
    assert float(done.stdout) < 24


def test_steps_of_a_batch():
    table, sides = _load(None, None)
    rows = texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], names=["id", "text"])
    whole, *others = (_aligned(batch, table, sides, True, step) for step in (1 << 30, 1, 300))
    assert all(a.equals(b) for other in others for a, b in zip(whole, other, strict=True))


def test_words_that_lose_bytes():
    """A text all of whose words keep their bytes is known by them; others are compared whole."""
    table, sides = _load(None, None)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3], pa.int64()), pa.array(["a b", "a ▁ b", "", "a　 b"])], names=["id", "text"])
    docs, _ = _aligned(batch, table, sides, False)
    assert docs.field(1).to_pylist() == [len(tokens(t)[0]) for t in batch.column("text").to_pylist()]
