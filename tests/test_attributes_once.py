"""Attributes are cleaned and folded once, before slots, values and issues are made of them."""

from souklens.operators.attributes import align_variations

ATTRIBUTES = "array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"


def test_results_do_not_clean_texts_again(spark):
    own = spark.createDataFrame([("p", [("Size", ["S", " M "], True)])], f"parent string, attributes {ATTRIBUTES}")
    kids = spark.createDataFrame([("p", 1, [("size", ["s"], None)]), ("p", 2, [("Size", ["L"], None)])], f"parent string, seq long, attributes {ATTRIBUTES}")
    slots, values, issues = align_variations(own, kids)
    for d in (slots, values, issues):
        assert "regexp_replace" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert [s["values"] for s in slots.first()["slots"]] == [["S", "M", "L"]]
    assert sorted((r.seq, r["values"]) for r in values.collect()) == [(1, ["S"]), (2, ["L"])]
