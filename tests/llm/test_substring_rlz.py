import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from souklens.llm import substring_rlz as z
from souklens.llm.blocks import rolling, word_hashes, word_spans
from souklens.llm.substring_rlz import rlz_dedup

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, width=20):
    first, out = {}, {}
    words = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["é", " x", "the"]
    shared = [[r.choice(vocab) for _ in range(r.randint(15, 60))] for _ in range(4)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choice(shared)[r.randint(0, 6) :] if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(1, 40))]
        rows.append((d * 3 % 61, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, "a " * 90), (101, "a " * 19), (102, ""), (103, None), (104, rows[5][1]), (105, "x" * 5000 + " y" * 50)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "own") for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in rlz_dedup(df, chunk_mb=0.002, bucket_mb=0.003).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()}
    assert got == brute(rows)


def test_factors_point_at_equal_words(spark):
    rows = corpus(9)
    words = {d: (t or "").split() for d, t in rows}
    n = 0
    for r in rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk_mb=0.002).collect():
        for f in r.factors:
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]
            assert (f.ref_doc, f.ref_start) < (r.doc_id, f.start)
            n += 1
    assert n > 20


def test_odd_rows(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (None, None), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in rlz_dedup(df).collect())
    assert got == [(5, 30, 0), (5, 30, 0), (9, 30, 30), (99, 0, 0), (99, 30, 30)]
    assert rlz_dedup(df.limit(0)).count() == 0


def test_windows_of_a_common_seed_are_spread(spark):
    """A phrase that stands in every document, between different words: its windows don't meet in one bucket."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    while True:  # a phrase that is the seed of all windows over it
        phrase = " ".join(word() for _ in range(8))
        b = np.frombuffer(phrase.encode(), np.uint8)
        starts, ends, _ = word_spans(b, np.array([0, len(b)]))
        if rolling(word_hashes(b, starts, ends), 8)[0] >> np.uint64(54) == 0:
            break
    rows = [(k, " ".join(word() for _ in range(30)) + f" {phrase} " + " ".join(word() for _ in range(30))) for k in range(300)]
    at = {"text": "text", "doc_id": "doc_id", "width": 20, "gram": 8}
    table = pa.table({"doc_id": [k for k, _ in rows], "text": [x for _, x in rows], "_chunk": [0] * len(rows)})
    sent = z._send_seeds(table, buckets=8, **at)
    for common, most in ((100, 0.25), (10**6, 1.0)):
        facts = pa.concat_tables([z._index_counted(sent.slice(k, 1), common=common) for k in range(sent.num_rows)])
        size = [len(x) for x in z._send_windows(table, facts, buckets=8, **at).column("a").to_pylist()]
        assert sum(size) > 8 * 3000 and max(size) / sum(size) <= most
    rows += [(1000 + k, x) for k, x in rows[:9]]
    got = rlz_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk_mb=0.002, bucket_mb=0.003, common=20).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert {x.doc_id: (x.n_words, x.n_removed, x.h) for x in got.collect()} == brute(rows)


def test_clashing_names_pass_through(spark):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(1, text, 5, "u", 7), (2, text, 6, "v", 8), (None, None, 7, "w", 9)], "`_id` long, `_text` string, `_chunk` long, u_chunk string, Factors long")
    out = rlz_dedup(df, text="_text", doc_id="_id")
    assert out.columns == ["_id", "_text", "_chunk", "u_chunk", "n_words", "n_removed", "kept_text", "factors"]
    assert sorted(tuple(r)[2:6] for r in out.collect()) == [(5, "u", 25, 0), (6, "v", 25, 25), (7, "w", 0, 0)]
