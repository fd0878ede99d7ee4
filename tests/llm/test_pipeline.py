import random

import sentencepiece

import corpus_pipeline as p
from souklens.llm.pieces import default_model


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(k, text(60), "en", f"s{k % 4}") for k in range(60)]
    rows += [(100 + k, f"{text(30)} {shared} {text(30)}", "en", "s0") for k in range(5)]
    rows += [(200 + k, rows[k][1] + " " + word(), "en", "s1") for k in range(5)]  # near copies
    rows += [(300, "too short", "de", "s2"), (301, None, None, None), (302, "x y z v w " * 40, "en", "s0")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    out = {}
    for name, f in p.STAGES:
        f(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        out[name] = at.collect()
        assert at.columns == p.COLUMNS or f is p.STAGES[-1][1]
    ids = {n: {x.doc_id for x in v} for n, v in out.items()}
    assert ids["quality rules"] == {x[0] for x in rows} - {300, 301, 302}
    assert ids["near-dedup"] == ids["quality rules"] - set(range(200, 205))
    texts = {x.doc_id: x.text for x in out["substring dedup"]}
    assert shared in texts[100] and all(shared.split()[30] not in texts[100 + k].split() and len(texts[100 + k].split()) == 60 for k in range(1, 5))
    size = {s: sum(len(x.text.split()) for x in out["substring dedup"] if x.source == s) for s in ("s0", "s1", "s2", "s3")}
    took = {s: sum(len(x.text.split()) for x in out["mixing"] if x.source == s) for s in size}
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) < 4 and all(took[s] <= 2 * size[s] for s in size)
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    assert sum(x.n_tokens for x in out["sentencepiece"]) == sum(len(sp.encode(x.text)) for x in out["mixing"])


def test_near_dedup_from_80_percent(spark, tmp_path):
    """Pairs of similarities between 0.75 and 0.9 against brute force: one of those from 0.8 on goes."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want, between = [], set(), 0
    for k in range(120):
        a = [word() for _ in range(60 + k)]
        n = r.randint(4, 16)
        b = a[:-n] + [word() for _ in range(n)]
        share = 100 * len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        between += 80 <= share < 85
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k} if share >= 80 else {2 * k, 2 * k + 1}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert between > 10 and {x.doc_id for x in p.near_dedup(spark, docs, str(tmp_path)).collect()} == want


def test_near_dedup_rows_without_id(spark, tmp_path):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven", "clean and different words stand here", "a fourth text of its own")
    rows = [(4, a), (4, a), (None, a), (7, b), (None, b), (None, c), (None, c), (None, d), (4, d + " more words than that here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((99 if x.doc_id is None else x.doc_id), x.text) for x in p.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got == sorted([(4, a), (7, b), (99, c), (99, d), (4, d + " more words than that here")])
