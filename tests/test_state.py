"""Streams with keyed state: what they emit after each run, and that a rerun goes on from where the last one ended."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from souklens.operators import reports as R
from souklens.streaming import state as S

RESPONSES = "scan_id string, seq long, url string, n_products int, block string"


@pytest.fixture(scope="module")
def own(spark):
    return S.stream_session(spark, 2)


def steps(own, schema, *parts):
    return [own.createDataFrame(p, schema) for p in parts]


def seen(own, at):
    return own.read.parquet(f"{at}/out")


def test_rows_after_a_block_in_a_later_file_are_gone(own, tmp_path):
    a = [("a", 1, "u1", 0, None), ("a", 3, "u3", 0, "captcha"), ("a", 4, "u4", 0, None), ("b", 1, "u", 0, None), (None, 1, "n", 0, None)]
    b = [("a", 5, "u5", 0, None), ("a", 2, "u2", 0, None), ("b", 2, "v", 0, None), ("b", None, "w", 0, None), ("c", 1, "x", 0, "forbidden")]
    parts = steps(own, RESPONSES, a, b)
    S.landed_in_steps(parts, str(tmp_path), own, S.stream_block_latch, mode="append")
    got = sorted((r.scan_id or "", r.seq) for r in seen(own, tmp_path).collect())
    assert got == [("", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    both = parts[0].unionByName(parts[1]).where("scan_id is not null and seq is not null")
    assert sorted((r.scan_id, r.seq) for r in R.block_latch(both).collect()) == [x for x in got if x[0]]
    S.run_batches(S.stream_block_latch(own.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in/step=*")), f"{tmp_path}/out", f"{tmp_path}/state", mode="append")
    assert seen(own, tmp_path).count() == 5


def test_scans_go_on_and_blocked_ones_do_not(own, tmp_path):
    a = [("a", 1, "u", 2, None), ("a", 2, "v", 3, None), ("b", 1, "u", 1, None), ("b", 2, "x", 0, "captcha"), ("b", 3, "y", 9, None)]
    b = [("a", 3, "u", 5, None), ("a", 4, "w", 1, None), ("b", 4, "z", 1, None), ("c", 9, None, None, None)]
    S.landed_in_steps(steps(own, RESPONSES, a, b), str(tmp_path), own, S.stream_scans, mode="update")
    got = sorted((r.batch, r.scan_id, r.pages, r.repeats, r.products, r.last_seq, r.status) for r in seen(own, tmp_path).collect())
    assert got == [(0, "a", 2, 0, 5, 2, "running"), (0, "b", 1, 0, 1, 2, "blocked"), (1, "a", 3, 1, 6, 4, "running"), (1, "c", 1, 0, 0, 9, "running")]


def test_products_are_emitted_when_they_change(own, tmp_path):
    schema = "k string, seq long, name string, name_conf double, price double, price_conf double"
    a = [("p", 5, "five", 0.5, None, None), ("p", 7, "seven", 0.5, 1.0, 0.2), ("q", 1, " ", 0.9, 0.0, None)]
    b = [("p", 9, "nine", 0.5, 2.0, 0.1), ("q", 3, "q", 0.1, 3.0, None)]
    c = [("p", 2, "two", 0.5, None, None), ("q", 4, "late", 0.1, None, None)]
    S.landed_in_steps(steps(own, schema, a, b, c), str(tmp_path), own, lambda d: S.stream_products(d, ["name", "price"], key="k", seq="seq"), mode="update")
    got = sorted((r.batch, r.k, r.name, r.price, r.first_seq, r.n) for r in seen(own, tmp_path).collect())
    assert got == [(0, "p", "five", "1.0", 5, 2), (0, "q", None, "0.0", 1, 1), (1, "q", "q", "0.0", 1, 2), (2, "p", "two", "1.0", 2, 4)]


def test_foreign_state_is_refused(own, tmp_path):
    (a,) = steps(own, RESPONSES, [("a", 1, "u", 2, None)])
    S.landed_in_steps([a], str(tmp_path), own, S.stream_scans, mode="update")
    with pytest.raises(StreamingQueryException, match="version 1"):
        S.landed_in_steps([a, a.withColumn("seq", F.lit(2).cast("long"))], str(tmp_path), own, lambda d: S.stream_scans(d, version=2), mode="update")
