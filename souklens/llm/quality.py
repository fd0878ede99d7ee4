"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Signals of each text are compared with cutoffs of its stratum (language). A cutoff is taken from a fixed grid, the lowest
at which an exact binomial test on labelled good documents rules out that more than `risk` of the good ones are rejected.
The tests of all strata, signals and grid values share the error `delta` (Bonferroni), and the signals share the risk, so
that with probability 1 - delta no stratum loses more than `risk` of its good documents to all cutoffs together.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import hidden, settled

WS = r"[\x20\x09-\x0D]+"
SIGNALS = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "lone_share")
#: Cutoffs tried for each signal; a document above its cutoff is rejected.
GRID = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "repeat_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2),
    "mean_word": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
    "lone_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7),
}


def _repeat_words(words: str, n: int) -> list[tuple[str, Column]]:
    """Columns, one on another, that end with the number of words in n-word windows found twice or more."""
    w, h, s, p = F.col(words), F.col("_h"), F.col("_s"), F.col("_p")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    some = F.size(F.array_distinct(h)) < F.size(h)
    covered = F.reduce(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)
    return [
        ("_h", F.when(F.size(w) > n, windows)),
        ("_s", F.when(some, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))),
        ("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce((x["h"] == F.get(s, i + 1)["h"]), F.lit(False)) | ((i > 0) & F.coalesce(x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"], F.lit(False)))), lambda x: x["i"]))),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
    ]


def text_signals(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares in SIGNALS.

    A null text has no words and zero everywhere. Columns of the added names are replaced.
    """
    t, w = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("_w")
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *SIGNALS]
    d = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumns({"_w": F.array_remove(F.split(t, WS, -1), ""), "_l": lines, "word_chars": (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long"), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    d = d.withColumns({"n_words": F.size(w).cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "_lone": F.size(F.filter(w, lambda x: F.length(x) == 1))})
    for name, column in _repeat_words("_w", window):
        d = d.withColumn(name, column)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    d = d.withColumns({"symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_l"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / words, "mean_word": F.col("word_chars") / words, "lone_share": F.col("_lone") / words})
    return d.drop("_w", "_l", "_h", "_s", "_p", "_lone")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials, by the recursion of its terms in logarithms."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.cast("double").alias("t"), F.exp(first.cast("double")).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.reduce(terms, start, step, lambda a: F.least(a["s"], F.lit(1.0)))


def risk_controlled_cutoffs(signals: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", stratum: str = "lang", grid: dict = GRID, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """_stratum, then one cutoff column per signal (null: none is safe), for strata with labelled good documents.

    signals: a row per document with its id, its stratum and its signals. labels (doc_id, quality): a document labelled
    more than once counts as good only if every label says so; null labels and labels of no document count nothing.
    """
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1")
    g = signals.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{stratum}`"), F.lit("")).alias("_stratum"), *grid).join(good, "_id", "left_semi")
    tried = [(name, float(cut)) for name, cuts in grid.items() for cut in cuts]
    rejected = F.array(*[F.struct(F.lit(name).alias("signal"), F.lit(cut).alias("cut"), F.sum((F.col(name) > cut).cast("long")).alias("k")) for name, cut in tried])
    counts = g.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"), rejected.alias("_tried"))
    counts = settled(counts)
    counts = counts.join(counts.agg(F.count(F.lit(1)).alias("_strata")), F.lit(True)).withColumn("_error", F.lit(float(delta)) / (F.col("_strata") * len(tried))).drop("_strata")
    tests = counts.select("_stratum", "_n", "_error", F.explode("_tried").alias("_t")).select("_stratum", "_t.*", (binomial_cdf(F.col("_t.k"), F.col("_n"), risk / len(grid)) <= F.col("_error")).alias("safe"))
    return tests.groupBy("_stratum").agg(*[F.min(F.when((F.col("signal") == name) & F.col("safe"), F.col("cut"))).alias(f"_cut_{name}") for name in grid])


def with_verdicts(signals: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang", min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """signals with base_failed (fewer than min_words words, or more than max_repeat percent of them in repeated windows)
    and kept (not base_failed, and no signal above its stratum's cutoff). A stratum without a cutoff rejects nothing more."""
    d = signals.withColumn("_stratum", F.coalesce(F.col(f"`{stratum}`"), F.lit(""))).join(cutoffs, "_stratum", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    above = reduce(lambda a, b: a | b, [F.coalesce(F.col(s) > F.col(f"_cut_{s}"), F.lit(False)) for s in SIGNALS])
    return d.withColumns({"base_failed": failed, "kept": ~failed & ~above}).drop("_stratum", *(f"_cut_{s}" for s in SIGNALS))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, keep_text: bool = True) -> DataFrame:
    """docs with its signals, base_failed and kept; without the text if keep_text is false.

    The signals alone (a few numbers a document) are written to the checkpoint folder, and cutoffs are made from them; if
    the text is to stay, verdicts are joined back to it by id, language and the text's hash. Defined
    cases: null texts have no words and fail; null strata are one stratum; null ids carry no label; repeated ids are
    documents of their own and share labels; columns of the added names are replaced; empty tables give empty tables.
    """
    docs, (text, doc_id, stratum), back = hidden(docs, text, doc_id, stratum)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("base_failed", "kept")))
    key = [doc_id, stratum, "_th"]
    small = docs.select(*{doc_id: 0, stratum: 0, text: 0}, F.xxhash64(F.col(f"`{text}`")).alias("_th")) if keep_text else docs
    signals = settled(text_signals(small, text).drop(text))
    cutoffs = risk_controlled_cutoffs(signals, labels, doc_id=doc_id, stratum=stratum, risk=risk, delta=delta)
    verdicts = with_verdicts(signals, cutoffs, stratum=stratum)
    if not keep_text:
        return verdicts.withColumnsRenamed(back)
    v = verdicts.dropDuplicates(key).withColumnsRenamed({c: f"_v{k}" for k, c in enumerate(key)})
    new = [c for c in verdicts.columns if c not in key]
    d = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new)).withColumn("_th", F.xxhash64(F.col(f"`{text}`")))
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_v{k}")) for k, c in enumerate(key)])
    return d.join(v, same).drop("_th", *(f"_v{k}" for k in range(len(key)))).withColumnsRenamed(back)
