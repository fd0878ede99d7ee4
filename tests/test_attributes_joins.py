"""What variations have is never broadcast, however little Spark guesses it to be; parents and meanings are only if they are small."""

import random

import pytest
from pyspark.sql import functions as F
from test_attributes import brute, run

from souklens.operators import attributes as A
from souklens.plans.lineage import join_hint

ATTRIBUTES = "array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"


@pytest.mark.parametrize("repair", [True, False])
def test_variations_are_not_broadcast(spark, repair):
    own = spark.createDataFrame([("p", [("a0", ["S"], True)])], f"parent string, attributes {ATTRIBUTES}")
    each = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.struct(F.concat(F.lit("a"), k.cast("string")).alias("name"), F.array(F.lit("s")).alias("values"), F.lit(True).alias("is_variation_axis")))
    kids = spark.range(2000).select(F.lit("p").alias("parent"), F.col("id").alias("seq"), each.alias("attributes"))  # guessed below 1 MB, 120,000 rows when exploded
    _, values, issues = A.align_variations(own, kids, repair=repair)
    for d in (values, issues):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and plan.count("BuildRight") == 1
    assert values.count() == 2000 and issues.where("code = 'variation-value-normalized'").count() == 2000


def test_hint_is_by_count(spark):
    d = spark.range(1000).select(F.expr("repeat('x', 1000)").alias("t"))
    assert [join_hint(d), join_hint(d, most=500_000), join_hint(d.where("t is null"))] == ["broadcast", "merge", "broadcast"]


@pytest.mark.parametrize("repair", [True, False])
def test_merged_as_well(spark, monkeypatch, repair):
    monkeypatch.setattr(A, "join_hint", lambda df: "merge")
    r = random.Random(3)
    attribute = lambda: (r.choice(["Size", "size", "Tint", None]), [r.choice(["S", "s", "M", " m", "XL", ""])], None)
    some = lambda: [attribute() for _ in range(r.randint(0, 3))]
    parents = [(f"P{k}", some()) for k in range(10)]
    kids = [(r.choice([*(f"P{k}" for k in range(10)), "gone", None]), k, some()) for k in range(60)]
    assert run(spark, parents, kids, repair) == brute(parents, kids, repair)
