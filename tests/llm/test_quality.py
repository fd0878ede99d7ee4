import random
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from souklens.llm.oracles import op9
from souklens.llm.quality import binomial_cdf, quality_verdicts, risk_controlled_cutoffs, text_signals


def brute(t):
    t = t or ""
    w = t.encode().split()
    w = [x.decode() for x in w]
    lines = [x for x in t.split("\n") if x.encode().split()]
    n, seen = {}, set()
    for i in range(len(w) - 4):
        n.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in n.values():
        if len(at) > 1:
            seen.update(k for i in at for k in range(i, i + 5))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(seen)


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \n\t ", "a " * 40, "a b c d e", "a b c d e f a b c d e", "x\n\nx\nx \n\x0b\n", "##| <é> ñ", "w" * 4000]
    for _ in range(80):
        v = [r.choice("abcdeé") * r.randint(1, 3) for _ in range(r.randint(1, 12))]
        out.append("".join(r.choice(v) + r.choice([" ", " ", "\n", "\t ", " | "]) for _ in range(r.randint(0, 60))))
    return out


def test_signals_equal_brute_force(spark):
    rows = [(k, t, "own") for k, t in enumerate(texts(1))] + [(None, "a", None), (3, "b", None)]
    got = text_signals(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text


def test_binomial(spark):
    rows = [(k, n) for n in (1, 5, 40, 300) for k in range(min(n, 30) + 1)]
    got = spark.createDataFrame(rows, "k long, n long").withColumn("p", binomial_cdf(F.col("k"), F.col("n"), 0.03)).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, i) * 0.03**i * 0.97 ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)


def test_cutoffs_keep_the_promise(spark):
    r = random.Random(5)
    rows = [(k, "en", r.random() ** 6) for k in range(6000)] + [(k, None, 0.0) for k in range(6000, 6100)]
    s = spark.createDataFrame(rows, "doc_id long, lang string, x double")
    labels = s.selectExpr("doc_id", "1 as quality").unionByName(spark.createDataFrame([(1, 0), (None, 1), (2, None), (99999, 1)], "doc_id long, quality int"))
    got = {x["_stratum"]: x["_cut_x"] for x in risk_controlled_cutoffs(s, labels, grid={"x": (0.1, 0.5, 0.9, 0.95, 0.99)}).collect()}
    worst = sum(v > got["en"] for _, l, v in rows if l == "en") / 6000
    assert got["en"] is not None and worst <= 0.02 and got[""] is None


def test_query_equals_sql(spark):
    r = random.Random(2)
    rows = [(k, t, r.choice(["en", "de", None])) for k, t in enumerate(texts(3) * 12)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(k % 9 > 0)) for k in range(900)], "doc_id long, quality int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    key = lambda x: tuple(map(str, x))
    want = sorted((tuple(x) for x in con.sql(op9()).fetchall()), key=key)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(x) for x in quality_verdicts(docs.repartition(4), labels).select(*cols).collect()), key=key) == want
    assert quality_verdicts(docs.limit(0), labels.limit(0), keep_text=False).count() == 0


def test_more_strata_than_any_bound(spark):
    """1,200 strata: each has its tests, and an error of its share."""
    d = spark.range(1200 * 60).selectExpr("id as doc_id", "concat('s', id % 1200) as lang", "double(0) as x")
    labels = d.selectExpr("doc_id", "1 as quality")
    got = risk_controlled_cutoffs(d, labels, grid={"x": (0.5,)}, risk=0.3).collect()
    assert len(got) == 1200 and all(r["_cut_x"] == 0.5 for r in got)
