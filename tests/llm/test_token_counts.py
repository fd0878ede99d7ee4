import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from souklens.llm.queries import QUERIES
from souklens.llm.token_counts import _cuts, _marked, _sliced, token_counts

ENDS = ["<|endoftext|>", "<|endof", "text|>", "'re", "'", "re", "   ", " ", "\n", "\t", "　", "\x1c", "\x85", "é", "漢字", "🙂", "a", "the ", "12", "!!", "​", "\x00", "don't "]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def made(r, n):
    return "".join(r.choice(ENDS) for _ in range(n))


def texts():
    r = random.Random(4)
    some = [made(r, r.randint(1, 30)) for _ in range(300)] + [made(r, 900) for _ in range(25)]
    plain = ["word " * 3000, "a" * 5000, " " * 4000, "x" * 700 + " ok " + "y" * 900, "<|endoftext|>" * 400, "the cat " * 100 + "z" * 600 + " the cat" * 100, "\n" * 999, "'ll" * 900]
    return [None, "", *ENDS, *some, *plain]


@pytest.mark.parametrize(("step", "overlap"), [(64, 20), (200, 24), (1000, 8), (1 << 15, 256)])
def test_equals_library(spark, step, overlap):
    rows = [(k % 300 or None, t, "n", 5) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row int").repartition(3)
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows]
    assert sorted(map(tuple, token_counts(df, step=step, overlap=overlap).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts(df.limit(0), step=step).collect() == []


def test_chunks_are_spliced_and_failures_seen(spark):
    df = spark.createDataFrame([(1, "some words in a row " * 50, 1), (2, "a" * 900, 2)], "id long, text string, row long")
    marks = _marked(_sliced(df, None, 200, 40), None, 40)
    cuts = {(r.row, r.no): r.cut for r in _cuts(marks).collect()}
    assert len(cuts) == 4 + 4 and all((v is None) == (k[0] == 2) for k, v in cuts.items())


def test_query(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(["a b c", None, "word " * 40000, "x" * 70000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()}
    for k, t in rows:
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len(t or ""), n, n > 1024)
