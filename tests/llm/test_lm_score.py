import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from souklens.llm.lm_score import EliasFano, Stored, lm_scores


def low(t):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in (t or "").encode().split()] + ["end"]


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def corpus(seed, n=300):
    r = random.Random(seed)
    follow = {w: [f"w{r.randrange(40)}" for _ in range(3)] for w in [f"w{k}" for k in range(40)]}
    rows = []
    for d in range(n):
        w = ["w1"]
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(follow[w[-1]]) if r.random() < 0.9 else f"w{r.randrange(40)}")
        rows.append((d, " ".join(w).upper() if d % 3 else "\n".join(w)))
    return rows + [(900, None), (901, ""), (None, "w1 w2"), (5, "é rare"), (902, "x" * 9000)]


def test_base_equals_brute_force_and_model_beats_it(spark):
    rows = corpus(1)
    c = Counter(w for d, t in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append((held(d), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 6)))
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got, base, score = {}, 0, 0
    for r in lm_scores(df, shard_mb=0.002).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
        if r.held_out and r.n_tokens > 2:
            base, score = base + r.base_score, score + r.score
        assert r.score < 0
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert score > 0.75 * base  # both are negative
    assert lm_scores(df.limit(0)).count() == 0


def test_score_equals_plain_model(spark):
    """The same smoothing over plain dictionaries; the codes of 8 bits leave a small error."""
    rows = corpus(2, 80)
    c = Counter(w for d, t in rows if not held(d) for w in low(t))
    n, v = sum(c.values()), len(c)
    two = Counter(p for d, t in rows if not held(d) for p in zip(["start"] + low(t), low(t)))
    n1, n2 = (sum(k == x for k in two.values()) for x in (1, 2))
    disc, ctx, kinds = n1 / (n1 + 2 * n2), Counter(), Counter()
    for (a, _), k in two.items():
        ctx[a] += k
        kinds[a] += 1

    def p(a, b):
        if two[a, b]:
            return math.log10((two[a, b] - disc) / ctx[a])
        return (math.log10(disc * kinds[a] / ctx[a]) if ctx[a] else 0) + math.log10((c[b] + 1) / (n + v + 1))

    want = sorted(sum(p(a, b) for a, b in zip(["start"] + low(t), low(t))) for _, t in rows)
    got = sorted(r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), shard_mb=1000).collect())
    tokens = sum(len(low(t)) for _, t in rows)
    assert abs(sum(got) - sum(want)) < 0.05 * tokens


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_elias_fano(n):
    r = np.random.default_rng(n)
    for top in (2000, 1 << 30, 1 << 62):
        x = np.unique(r.integers(0, top, n).astype(np.uint64))
        e = EliasFano(x, Stored())
        if len(x):
            assert (e.get(np.arange(len(x))) == x).all()
        assert (e.find(x) == np.arange(len(x))).all()
        other = np.setdiff1d(r.integers(0, top, 500).astype(np.uint64), x)
        assert (e.find(other) == -1).all()
