import random
from collections import Counter

import numpy as np
import pytest

from souklens.llm.substring_bwt import bwt_dedup, repeated_windows


def brute(rows, width):
    n = Counter(b[i : i + width] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if d is None else d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdé ñ") for _ in range(n))
    shared = [line(r.randint(40, 150)) for _ in range(4)]
    rows = []
    for d in range(50):
        t = ""
        for _ in range(r.randint(0, 4)):
            t += r.choice(shared)[r.randint(0, 9) :] if r.random() < 0.5 else line(r.randint(1, 120))
        rows.append((d, t))
    return rows + [(90, "ab" * 70), (91, "z" * 41), (92, "q" * 40), (93, None), (94, ""), (None, rows[7][1]), (7, rows[7][1]), (95, "x" * 39)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_bytes string").repartition(3)
    got = bwt_dedup(df, width=40, gram=12, chunk_mb=0.002, bucket_mb=0.002).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got) == brute(rows, 40)


def test_empty_table(spark):
    assert bwt_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_in_rounds():
    a, b, c = b"xxHELLOWORLDyy", b"zzzHELLOWORLDq", b"HELLOWORLDyyabc"
    data = np.frombuffer(a + b + c, np.uint8)
    off = np.array([5, 6, 3])
    count = np.array([len(x) - 6 + 1 for x in (a, b, c)])
    got = repeated_windows(np.zeros(3, int), off, count, data, np.array([0, 14, 28]), 6)
    for k, s in enumerate((a, b, c)):
        for x in range(count[k]):
            w = s[x : x + 6]
            assert got[k, x] == any(t[x - off[k] + o :][:6] == w and x - off[k] + o >= 0 for t, o in zip((a, b, c), off) if t is not s)


def test_clashing_names_pass_through(spark):
    rows = [(1, "x" * 50, 5, "u", 7, None), (None, None, 6, "v", 8, "w")]
    df = spark.createDataFrame(rows, "`_id` long, `_text` string, `_chunk` long, u_chunk string, N_Bytes long, bucket string")
    out = bwt_dedup(df, width=40, gram=12, text="_text", doc_id="_id")
    assert out.columns == ["_id", "_text", "_chunk", "u_chunk", "bucket", "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    assert sorted(tuple(r)[2:8] for r in out.collect()) == [(5, "u", None, 50, 50, 1), (6, "v", "w", 0, 0, 0)]
