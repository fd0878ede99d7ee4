"""Attributes of variations against a plain walk over each parent's, one after the other."""

import random

import pytest

from souklens.operators.attributes import align_variations

ATTRIBUTES = "attributes array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"


def brute(parents, kids, repair):
    """One parent at a time, one variation after the other; what is added counts at once."""
    slots, values, issues = {}, {}, []
    fold, clean = (lambda s: " ".join(s.split()).lower()), lambda s: " ".join(s.split())
    for p, own in parents:
        at = [[clean(n or ""), [clean(v) for v in vs or [] if v and clean(v)], bool(x), fold(n or "")] for n, vs, x in own or []]
        by = [{fold(v): v for v in s[1]} for s in at]
        for q, seq, worn in sorted(kids, key=lambda r: r[1]):
            if q != p:
                continue
            row = {}
            for name, vs, _ in worn or []:
                name, vs = name or "", [clean(v) for v in vs or [] if v and clean(v)]
                tell = lambda code: issues.append((p, seq, code, clean(name), vs[0]))  # noqa: B023, E731
                if len(vs) > 1:
                    tell("variation-multiple-values")
                if not vs:
                    continue
                k = next((k for k, s in enumerate(at) if s[3] == fold(name)), None)
                if k is None:
                    tell("variation-attribute-not-on-parent")
                    if not repair:
                        continue
                    k = len(at)
                    at.append([clean(name), [], True, fold(name)])
                    by.append({})
                at[k][2], v = True, vs[0]
                if v in at[k][1]:
                    row[k] = v
                elif fold(v) in by[k]:
                    row[k] = by[k][fold(v)]
                    tell("variation-value-normalized")
                elif repair:
                    at[k][1].append(v)
                    by[k][fold(v)] = row[k] = v
                    tell("variation-value-added-to-parent")
                else:
                    row[k] = v
                    tell("variation-value-not-on-parent")
            if row:
                values[seq] = [row.get(k) for k in range(max(row) + 1)]
        slots[p] = [tuple(s[:3]) for s in at]
    return slots, values, sorted(issues)


def run(spark, parents, kids, repair):
    s, v, i = align_variations(spark.createDataFrame(parents, f"parent string, {ATTRIBUTES}"), spark.createDataFrame(kids, f"parent string, seq long, {ATTRIBUTES}"), repair=repair)
    slots = {r.parent: [(x.name, x["values"], x.is_variation_axis) for x in r.slots] for r in s.collect()}
    return slots, {r.seq: r["values"] for r in v.collect()}, sorted(tuple(r) for r in i.select("parent", "seq", "code", "attribute", "value").collect())


@pytest.mark.parametrize("repair", [True, False])
def test_equal_to_a_walk(spark, repair):
    r = random.Random(7)
    value = lambda: r.choice(["S", "s", " S ", "M", "m", "XL", "xL", "", None, "a  b", "A b"])
    attribute = lambda: (r.choice(["Size", "size", " SIZE", "Tint", "tint", "Fit", None]), r.choice([None, [], [value()], [value()], [value(), value(), value()]]), r.choice([True, False, None]))
    some = lambda most: r.choice([None, [attribute() for _ in range(r.randint(0, most))]])
    parents = [(f"P{k}", some(4)) for k in range(40)]
    kids = [(r.choice([*(f"P{k}" for k in range(40)), "gone", None]), k, some(4)) for k in range(400)]
    assert run(spark, parents, kids, repair) == brute(parents, kids, repair)


def test_worked_example(spark):
    parents = [("A", [("Size", ["S", "M"], False), ("Care", ["cold"], False)]), ("B", None)]
    kids = [("A", 1, [("size", ["s"], None), ("Tint", ["red", "blue"], None)]), ("A", 2, [("Size", ["XL"], None)]), ("A", 3, [("Size", ["xl"], None), ("tint", ["Red"], None)]), (None, 4, [("Size", ["S"], None)])]
    slots, values, issues = run(spark, parents, kids, True)
    assert slots == {"A": [("Size", ["S", "M", "XL"], True), ("Care", ["cold"], False), ("Tint", ["red"], True)], "B": []}
    assert values == {1: ["S", None, "red"], 2: ["XL"], 3: ["XL", None, "red"]}
    assert [x[1:3] for x in issues] == [(1, "variation-attribute-not-on-parent"), (1, "variation-multiple-values"), (1, "variation-value-added-to-parent"), (1, "variation-value-normalized"), (2, "variation-value-added-to-parent"), (3, "variation-value-normalized"), (3, "variation-value-normalized")]


def test_empty(spark):
    assert run(spark, [], [], True) == ({}, {}, [])
