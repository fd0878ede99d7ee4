"""Attributes of variations brought to those of their parent, and the slots that a parent and its variations share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions.text import clean_text, fold_for_compare
from souklens.plans.lineage import join_hint, settled

_AT = "parent", "key", "fold"


def clean_attributes(attributes: str | Column) -> Column:
    """Attributes (name, values, is_variation_axis) with clean names and values, without blank values; key: the name to compare by."""
    blank = F.array().cast("array<string>")
    values = lambda a: F.filter(F.transform(F.coalesce(a["values"], blank), lambda v: clean_text(v)), lambda v: F.coalesce(v != "", F.lit(False)))
    name = lambda a: F.coalesce(a["name"], F.lit(""))
    each = lambda a: F.struct(clean_text(name(a)).alias("name"), values(a).alias("values"), F.coalesce(a["is_variation_axis"], F.lit(False)).alias("is_variation_axis"), fold_for_compare(name(a)).alias("key"))
    some = F.filter(F.col(attributes) if isinstance(attributes, str) else attributes, lambda a: a.isNotNull())
    return F.coalesce(F.transform(some, each), F.array().cast("array<struct<name:string,values:array<string>,is_variation_axis:boolean,key:string>>"))


def _meanings(own: DataFrame, used: DataFrame, repair: bool, hint: str) -> DataFrame:
    """What each distinct value that variations have means to its parent: (parent, key, fold, slot, sname, opens, kept, target, first).
    slot: its place, null without one; opens: the first use of a slot that the parent lacks; kept: spellings that the parent has;
    target: the last of them; first: where it was seen first. Values are folded to distinct ones before anything meets. hint: how
    what is made of `own` is joined."""
    seen = used.groupBy(*_AT).agg(F.min(F.struct("seq", "pos", "value", "name")).alias("first"))
    slots = own.select("parent", F.size("slots").alias("_n"), F.posexplode_outer("slots").alias("i", "s"))
    known = slots.where("s is not null").groupBy("parent", F.col("s.key").alias("key")).agg(F.min(F.struct("i", "s.name", "s.values")).alias("k"))
    spelled = known.select("parent", "key", F.posexplode("k.values").alias("vpos", "v")).groupBy("parent", "key", fold_for_compare(F.col("v")).alias("fold"))
    spelled = spelled.agg(F.collect_set("v").alias("kept"), F.max_by("v", "vpos").alias("target"))
    d = seen.join(known.select("parent", "key", F.col("k.i").alias("_i"), F.col("k.name").alias("_name")).hint(hint), ["parent", "key"], "left").join(spelled.hint(hint), list(_AT), "left")
    fresh = d.where("_i is null").groupBy("parent", "key").agg(F.min("first").alias("opens"))
    if repair:
        n = own.select("parent", F.size("slots").alias("_n"))
        fresh = fresh.join(n.hint(hint), "parent").withColumn("_new", F.col("_n") + F.row_number().over(W.partitionBy("parent").orderBy("opens")) - 1).drop("_n")
    else:
        fresh = fresh.withColumn("_new", F.lit(None).cast("int"))
    d = d.join(fresh, ["parent", "key"], "left")
    return d.select(*_AT, F.coalesce("_i", "_new").alias("slot"), F.coalesce("_name", "opens.name").alias("sname"), "opens", "kept", "target", "first")


def align_variations(parents: DataFrame, variations: DataFrame, *, repair: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slots, values, issues) of parents (parent, attributes), one row each, and variations (parent, seq, attributes), no two of one seq.

    slots: (parent, slots): the parent's own attributes in order; with repair also those that only variations have, and behind the
    own values of a slot those that only variations have, as first seen; what a variation has is an axis. values: (seq, values): of each
    slot the value of the variation, null without one, to the last slot that it has. A value that the parent has stays; one that is
    equal to it but for case and marks takes the parent's spelling (the last of equals), or without one the first seen. Of a
    variation's values of one attribute the first counts, of its attributes of one name the last. issues: (parent, seq, code,
    attribute, value) with what was changed, added or, without repair, left as it can't work.

    Rows without a parent, or of one that isn't there, have no values. Null attributes, names and values are empty. Attributes
    are cleaned once, read from there to fold their distinct values and again to take what these mean; none of a parent's meet in one task.
    Parents and meanings are broadcast if they are small, by count; variations never are."""
    own = settled(parents.where("parent is not null").select("parent", clean_attributes("attributes").alias("slots")))  # read five times below
    hint = join_hint(own)
    kids = variations.join(own.select("parent").hint(hint), "parent", "left_semi")
    worn = kids.select("parent", "seq", F.posexplode(clean_attributes("attributes")).alias("pos", "a")).select("parent", "seq", "pos", "a.key", "a.name", F.size("a.values").alias("n"), F.try_element_at("a.values", F.lit(1)).alias("value"))
    used = settled(worn.where("value is not null").withColumn("fold", fold_for_compare(F.col("value"))))  # texts are cleaned and folded once
    means = settled(_meanings(own, used, repair, hint))  # slots, values and issues are made of it

    value, first = F.col("value"), F.col("first")
    is_first = (first["seq"] == F.col("seq")) & (first["pos"] == F.col("pos"))
    opening = (F.col("opens.seq") == F.col("seq")) & (F.col("opens.pos") == F.col("pos")) if repair else F.col("opens").isNotNull()
    kept = F.coalesce(F.array_contains("kept", value), F.lit(False))
    alike = F.coalesce(F.col("target"), first["value"]) if repair else F.coalesce(F.col("target"), value)
    missing = F.when(F.col("target").isNull(), F.when(is_first, "variation-value-added-to-parent") if repair else F.lit("variation-value-not-on-parent"))
    code = F.when(F.col("slot").isNull() | kept, None).otherwise(F.coalesce(missing, F.when(alike != value, "variation-value-normalized")))
    d = used.join(means.hint(join_hint(means)), list(_AT)).withColumns({"cell": F.when(F.col("slot").isNotNull(), F.when(kept, value).otherwise(alike)), "code": code, "opening": opening})
    codes = F.array_compact(F.array(F.when(F.col("n") > 1, "variation-multiple-values"), F.when(F.coalesce("opening", F.lit(False)), "variation-attribute-not-on-parent"), F.col("code")))
    issues = d.select("parent", "seq", F.explode(codes).alias("code"), F.col("name").alias("attribute"), "value")

    cells = F.array_sort(F.collect_list(F.struct("slot", (-F.col("pos")).alias("late"), "cell")))
    of = lambda i: F.try_element_at(F.filter("c", lambda x: x["slot"] == i), F.lit(1))["cell"]
    values = d.where("slot is not null").groupBy("seq").agg(cells.alias("c")).select("seq", F.transform(F.sequence(F.lit(0), F.element_at("c", -1)["slot"]), of).alias("values"))

    more = F.array_sort(F.collect_list(F.when(F.col("target").isNull() & F.lit(repair), F.struct(first["seq"].alias("seq"), first["pos"].alias("pos"), first["value"].alias("value")))))
    per_slot = means.where("slot is not null").groupBy("parent", "slot").agg(F.min("sname").alias("name"), F.max(F.col("opens").isNotNull()).alias("fresh"), F.transform(more, lambda x: x["value"]).alias("more"))
    added = per_slot.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("slot", "name", "fresh", "more"))).alias("x"))
    hit = lambda i: F.try_element_at(F.filter("x", lambda e: (e["slot"] == i) & ~e["fresh"]), F.lit(1))
    none = F.array().cast("array<string>")
    old = F.transform("slots", lambda s, i: F.struct(s["name"].alias("name"), F.concat(s["values"], F.coalesce(hit(i)["more"], none)).alias("values"), (s["is_variation_axis"] | hit(i).isNotNull()).alias("is_variation_axis")))
    new = F.transform(F.filter("x", lambda e: e["fresh"]), lambda e: F.struct(e["name"].alias("name"), e["more"].alias("values"), F.lit(True).alias("is_variation_axis")))
    slots = own.join(added, "parent", "left").select("parent", F.when(F.col("x").isNull(), old).otherwise(F.concat(old, new)).alias("slots"))
    return slots, values, issues
