"""License scans by ordered signature rules, in DataFrame functions only.

Texts are put in one form (words of a-z, 0-9 and all that isn't ASCII, one blank between). Most texts have none of a few
keywords and go no further. For the others, the rules of each keyword that occurs are looked at; those of which a plain piece
occurs are matched as regular expressions, and the matches become intervals of words. The pieces of a rule are taken from its
pattern so that each match holds one of them, whichever alternatives it takes; each piece belongs to a keyword that it contains.
Names that mean other things too (php 3, elastic 2) count with a version only where the text speaks of a license somewhere. Rules overlap on purpose; an interval is dropped when another one contains it, the
longer before the shorter and, of equal ones, that of the rule which comes first.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import hidden
from .license_signatures import signatures

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, ways to name it, versions (each a regular expression over words in canonical form).
FAMILIES = (
    ("mit", ("mit", "expat", "massachusetts institute of technology"), ()),
    ("apache", ("apache", "apache software foundation", "asl"), ("1 0", "1 1", "2 0", "2")),
    ("gpl", ("gnu general public", "gnu gpl", "gpl", "general public"), ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("lgpl", ("gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public", "affero general public", "gnu agpl", "agpl"), ("1 0", "3", "3 0")),
    ("gfdl", ("gnu free documentation", "gfdl"), ("1 1", "1 2", "1 3")),
    ("bsd", ("bsd", "berkeley software distribution", "new bsd", "simplified bsd", "modified bsd"), ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("mpl", ("mozilla public", "mpl"), ("1 0", "1 1", "2 0", "2")),
    ("epl", ("eclipse public", "epl"), ("1 0", "2 0")),
    ("edl", ("eclipse distribution", "edl"), ("1 0",)),
    ("cddl", ("common development and distribution", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public", "ibm public"), ("1 0",)),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "zlib libpng", "libpng"), ("2 0",)),
    ("boost", ("boost software", "bsl"), ("1 0",)),
    ("unlicense", ("unlicense",), ()),
    ("cc0", ("cc0", "creative commons zero", "creative commons cc0"), ("1 0",)),
    ("cc-by", ("creative commons attribution", "cc by"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution share ?alike", "cc by sa"), ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution non ?commercial", "cc by nc"), ("2 0", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution no ?deriv(?:ative)?s", "cc by nd"), ("3 0", "4 0")),
    ("artistic", ("artistic", "perl artistic", "clarified artistic"), ("1 0", "2 0")),
    ("python", ("python software foundation", "psf"), ("2", "2 0")),
    ("php", ("php",), ("3 0", "3 01")),
    ("ruby", ("ruby",), ()),
    ("postgresql", ("postgresql",), ()),
    ("openssl", ("openssl", "ssleay"), ()),
    ("ofl", ("sil open font", "open font", "ofl"), ("1 0", "1 1")),
    ("eupl", ("european union public", "eupl"), ("1 0", "1 1", "1 2")),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ()),
    ("osl", ("open software", "osl"), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free", "afl"), ("1 2", "2 0", "2 1", "3 0")),
    ("upl", ("universal permissive", "upl"), ("1 0",)),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public"), ("2",)),
    ("ncsa", ("university of illinois ncsa(?: open source)?", "ncsa"), ()),
    ("sleepycat", ("sleepycat",), ()),
    ("w3c", ("w3c software",), ()),
    ("odbl", ("open database", "odbl"), ("1 0",)),
    ("sspl", ("server side public", "sspl"), ("1",)),
    ("elastic", ("elastic",), ("2 0",)),
    ("vim", ("vim",), ()),
    ("lppl", ("latex project public", "lppl"), ("1 0", "1 2", "1 3c?")),
    ("beerware", ("beer ?ware",), ("42",)),
    ("x11", ("x11", "x consortium"), ()),
    ("proprietary", ("proprietary", "commercial"), ()),
)

#: Names that mean a license wherever they stand with a version.
PLAIN = frozenset((
    "gnu general public", "gnu gpl", "gpl", "gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl", "gnu affero general public", "gnu agpl", "agpl",
    "gnu free documentation", "gfdl", "apache software foundation", "mozilla public", "eclipse public", "cddl", "eupl", "lppl",
))

#: Keywords of the plain pieces. A piece with none of them is led by its longest word (leads).
KEYWORDS = (
    "licen", "permission", "permit", "warrant", "redistribut", "distribut", "unencumbered", "domain", "reserved", "spdx", "copyright", "copyleft",
    "liable", "damage", "software", "apache", "combined", "runtime", "skeleton", "font", "gpl", "derivative", "prominently", "invariant",
    "misrepresented", "irrevocabl", "copied", "php", "fuck", "functionality", "service", "lppl", "retain", "beer", "unicode", "legend", "nasa", "gemma",
    "contribution", "mozilla", "eclipse", "ofl", "confidential", "proprietary", "reproduced", "unauthori", "government", "gnu", "gfdl", "cddl", "eupl",
)


def rules() -> list[tuple[int, str, str, str, float]]:
    """(order, label, needs, pattern, weight): signatures first, then names with versions, identifiers and bare names. needs: what the
    text must hold somewhere besides the match; empty for most."""
    out = [(label, "", pattern, weight) for label, pattern, weight in signatures()]
    lic = "licen[cs]e"
    for label, names, versions in FAMILIES:
        for name in names:
            for v in versions:
                out.append((label, "" if name in PLAIN else "licen", f"{name} (?:{lic} )?(?:version |v )?{v}(?: {lic})?(?: or (?:any )?later(?: version)?)?", 0.9))
            out.append((label, "", f"spdx {lic} identifier {name}(?: \\d+)*(?: only| or later)?", 1.0))
            out.append((label, "", f"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?{name} {lic}", 0.95))
            out.append((label, "", f"(?:the )?{name} {lic}", 0.8))
            out.append((label, "", f"licensed under (?:the )?{name}", 0.7))
    return [(k, label, keyword, pattern, weight) for k, (label, keyword, pattern, weight) in enumerate(out)]


def _keyword(piece: str) -> str:
    return max((k for k in KEYWORDS if k in piece), key=len, default="")


def pieces(pattern: str) -> frozenset[str]:
    """Plain pieces of which every match of a pattern holds one: of the parts that aren't optional, the one whose pieces all have a
    keyword, then whose shortest piece is longest. A choice has the pieces of all its alternatives."""

    def rank(found: frozenset[str]) -> tuple:
        return (all(_keyword(p) for p in found), min(map(len, found)))

    def best(parts) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in [*parts, (None, None)]:
            if str(op) == "LITERAL":
                run += chr(arg)
                continue
            if run.strip():
                found.append(frozenset([run]))
            run, inner = "", None
            if str(op) == "SUBPATTERN":
                inner = best(arg[-1])
            elif str(op) == "BRANCH":
                ways = [best(way) for way in arg[1]]
                inner = None if None in ways else frozenset().union(*ways)
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                inner = best(arg[2])
            if inner:
                found.append(inner)
        return max(found, key=rank, default=None)

    found = best(re._parser.parse(pattern))
    if found is None:
        raise ValueError(f"a rule without a plain piece: {pattern}")
    return found


def lead(piece: str) -> str:
    """The keyword that texts are asked for before a piece: one that it contains, else its longest word."""
    return _keyword(piece) or max(piece.split(), key=len)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTER = r"[0-9A-Za-z[^\x00-\x7F]]+"


def _spans(words: Column, pattern: Column) -> Column:
    """(start, words) of all matches of a pattern in words (' a b c '), whole words only; matches may share a blank."""
    at = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    parts, found = F.split(words, at, -1), F.regexp_extract_all(words, at, 0)
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<s:int,n:int>>").alias("out"))
    step = lambda a, x: F.struct((a["n"] + count(x["p"]) + count(x["f"])).cast("int").alias("n"), F.concat(a["out"], F.array(F.struct((a["n"] + count(x["p"]) - 1).cast("int").alias("s"), (count(x["f"]) + 1).cast("int").alias("n")))).alias("out"))
    return F.reduce(F.zip_with(parts, found, lambda p, f: F.struct(p.alias("p"), f.alias("f"))), empty, lambda a, x: F.when(x["f"].isNull(), a).otherwise(step(a, x)), lambda a: a["out"])


def _suppressed(spans: Column) -> Column:
    """Spans that no other contains, by start, then the longest, then the order of the rules: one pass with the farthest end so far."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["n"]).alias("m"), x["r"].alias("r"), x["l"].alias("l"), x["w"].alias("w"))))
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,length:int,label:string,weight:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        keep = F.struct((x["s"] - x["m"]).cast("int").alias("end"), F.concat(a["out"], F.array(F.struct(x["s"].alias("start"), (-x["m"]).cast("int").alias("length"), x["l"].alias("label"), x["w"].alias("weight")))).alias("out"))
        return F.when(x["s"] - x["m"] > a["end"], keep).otherwise(a)

    return F.reduce(order, empty, step, lambda a: a["out"])


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (places of the base phrases), detections (start, length, label, weight), labels and score.

    Only A-Z are lower-cased. labels: those of the base phrases and of the detections, distinct and sorted. score: the
    greatest weight of what was found, 1 for a base phrase, 0 for nothing. A null text is empty: nothing is found. Columns
    of the added names are replaced, others pass through.
    """
    new = ("n_words", "base", "detections", "labels", "score")
    docs, (text,), back = hidden(docs, text)
    gates: dict[str, dict[str, list]] = {}
    for k, label, needs, pattern, weight in rules():
        for piece in sorted(pieces(pattern)):
            gates.setdefault(needs or lead(piece), {}).setdefault(piece, []).append({"r": k, "l": label, "k": needs, "p": pattern, "w": weight})
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new), F.regexp_count(t, F.lit(_LETTER)).cast("long").alias("n_words"), t.alias("_t"), F.lower(t).alias("_low"))
    d = d.withColumn("_hit", F.when(reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(k)) for k in sorted({*gates, "licen"})]), F.col("_t")))
    d = d.withColumn("_hit", F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("_hit", _UPPER, _UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" ")))
    # one literal: the optimizer folds it once
    tree = [{"gate": gate, "groups": [{"name": name, "rules": own} for name, own in groups.items()]} for gate, groups in gates.items()]
    rule = "array<struct<r:int,l:string,k:string,p:string,w:double>>"
    table = F.from_json(F.lit(json.dumps(tree)), f"array<struct<gate:string,groups:array<struct<name:string,rules:{rule}>>>>")
    phrases = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(label).alias("l")) for p, label in BASE])
    hit = F.col("_hit")
    open_ = F.flatten(F.transform(F.filter(table, lambda g: F.contains(hit, g["gate"])), lambda g: g["groups"]))
    named = F.array_distinct(F.flatten(F.transform(F.filter(open_, lambda g: F.contains(hit, g["name"])), lambda g: g["rules"])))
    fired = F.filter(named, lambda r: F.contains(hit, r["k"]) & F.regexp_like(hit, F.concat(F.lit(" (?:"), r["p"], F.lit(") "))))
    spans = F.flatten(F.transform(fired, lambda r: F.transform(_spans(hit, r["p"]), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), r["r"].alias("r"), r["l"].alias("l"), r["w"].alias("w")))))
    base = F.flatten(F.transform(F.filter(phrases, lambda r: F.contains(hit, r["p"])), lambda r: F.transform(_spans(hit, r["p"]), lambda x: F.struct(x["s"].alias("start"), r["l"].alias("label")))))
    d = d.withColumns({"base": F.coalesce(F.when(hit.isNotNull(), base), F.array().cast("array<struct<start:int,label:string>>")), "_spans": F.when(hit.isNotNull(), spans)})
    d = d.withColumn("detections", F.coalesce(_suppressed(F.col("_spans")), F.array().cast("array<struct<start:int,length:int,label:string,weight:double>>")))
    labels = F.array_sort(F.array_union(F.col("base.label"), F.col("detections.label")))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)))
    return d.withColumns({"labels": labels, "score": score}).drop("_hit", "_spans", "_t", "_low").withColumnsRenamed(back)
