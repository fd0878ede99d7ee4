"""What a plan must not hold: the same costly step twice, or all rows in a few tasks."""

from pyspark.sql import functions as F

from souklens.functions import numbers as N, text as T


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_price_is_folded_once(spark):
    d = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit(" EUR")).alias("t")).repartition(1)
    m = d.select(N.parse_money(F.col("t")).alias("m")).select("m.*")
    assert plan(m).count("regexp_replace(") <= 8
    assert [(r.amount, r.currency) for r in m.collect()] == [(0.0, "EUR"), (1.0, "EUR"), (2.0, "EUR")]


def test_small_files_are_dealt_to_all_cores(spark):
    from souklens.plans.lineage import spread

    d = spread(spark.range(1000).coalesce(1), rows=10)
    assert d.rdd.getNumPartitions() == 100
    assert sorted(r.id for r in d.collect()) == list(range(1000))
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_addresses_are_read_once(spark):
    d = spark.createDataFrame([(" HTTP://A.example:80/p/?b=1&utm_source=x&a=2 ",), ("x",), (None,)], "u string").select(T.canonical_url(F.regexp_replace("u", "qqq", "")).alias("u"))
    assert plan(d).count("qqq") == 1
    assert [r.u for r in d.collect()] == ["http://a.example/p?a=2&b=1", "x", None]


def test_no_filter_computes_what_is_exploded_again(spark):
    from souklens.sources import embedded as E

    states = spark.createDataFrame([(1, "https://s.example/", None, [("x", "collection", '{"title":"T","variants":[{"price":"1"}]}')])], E.STATES).repartition(1)
    d = E.read_embedded_state(states)
    assert not [x for x in plan(d).splitlines() if "Filter (" in x and "size(" in x[:400]]
    assert [(r.name, r.regular.amount, r.row) for r in d.collect()] == [("T", 1.0, 0)]


def test_items_are_found_without_a_join_a_level(spark):
    from souklens.sources import markup as M

    deep = "<i itemprop='a'>" + "<div itemscope itemtype='T'>" + "<p><b>" * 40 + "<i itemprop='x y'>v</i>"
    d = M.microdata_properties(M.dom_nodes(spark.createDataFrame([(1, deep), (2, None)], "page_id long, html string")))
    assert plan(d).count("Join Inner") == 1
    assert sorted((r.page_id, r.type, r.prop, r.value) for r in d.collect()) == [(1, "T", "x", "v"), (1, "T", "y", "v")]
