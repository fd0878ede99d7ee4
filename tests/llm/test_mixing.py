import duckdb
import pytest

from souklens.llm.mixing import mix_sources
from souklens.llm.oracles import OP8


def fill(sizes, weights, share=1.5, cap=2.0):
    """Share by weight; cap; reshare the excess among the others; until none is above."""
    left, out, budget = dict(zip(sizes, weights)), {}, share * sum(sizes.values())
    while left:
        level = budget / sum(left.values())
        over = [s for s, w in left.items() if level * w > cap * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in left.items()}
        for s in over:
            out[s] = cap * sizes[s]
            budget -= out[s]
            del left[s]
    return out


def test_targets_and_cuts(spark):
    rows = [(k, "a " * (k % 17 + 1), ["hot", "b", "c", "d", None][0 if k % 3 else k % 5]) for k in range(400)]
    rows += [(None, "x y", "b"), (7, None, "c"), (7, "  ", "c"), (8, "w " * 3000, "é"), (7, "a b", "zero")]
    df = spark.createDataFrame([(a, b, c, "own") for a, b, c in rows], "doc_id long, text string, source string, size string").repartition(7)
    got = mix_sources(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill({s: sizes[s] for s in order}, [(5, 2, 1)[k % 3] for k in range(len(order))])
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1
    key = lambda r: tuple(str(x) for x in r)
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(got, key=key) == sorted(again, key=key)


def test_equals_sql(spark, tmp_path):
    rows = [(k, "a " * (k % 11), f"s{k % 7}" if k % 7 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents.astype({"source": object}))
    want = sorted(con.sql(OP8).fetchall())
    got = sorted(tuple(r) for r in mix_sources(df).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == [tuple(r) for r in want]
    assert mix_sources(df.limit(0)).count() == 0
