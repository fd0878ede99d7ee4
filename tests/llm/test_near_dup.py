import random

import numpy as np
from souklens.llm.near_dup import components, near_duplicates, signatures


def sets(t):
    w = [bytes(x).lower() if x.isascii() else x for x in (t or "").encode().split()]
    w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in w]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    s = {d: sets(t) for d, t in rows}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s[d]), find(d), find(d) == d) for d in ids)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("ABCDEFG") + r.choice("éabcdefghij") + r.choice("xyz")
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 8, 30, 80, 200]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w) if r.random() < 0.7 else "\n".join(w).lower())
    rows += [None, "", " \n", "a", "A", "a b c d", "a b c d e", "É x", "é x"] + [" ".join(word() for _ in range(3000))]
    r.shuffle(rows)
    return [(k * 2, t) for k, t in enumerate(rows)]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "own") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(4)
        assert sorted(tuple(r) for r in near_duplicates(df, percent=85).collect()) == brute(rows)


def test_odd_rows(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (4, "other words stand here now"), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else 99), r.n_shingles, r.component_id if r.component_id is not None else 99, r.kept) for r in near_duplicates(df).collect())
    # a null text is linked with nothing, with an id or without
    assert got == [(4, 1, 4, True), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (99, 0, 99, True), (99, 2, 4, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (200, 201)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200, 201: 200}


def test_densified_bins_match_as_often_as_the_sets():
    r = np.random.default_rng(1)
    same, own = r.integers(0, 2**63, (40, 90)).astype(np.uint64), r.integers(0, 2**63, (80, 10)).astype(np.uint64)
    hits = []
    for k in range(40):
        a, b = np.sort(np.concatenate([same[k], own[2 * k]])), np.sort(np.concatenate([same[k], own[2 * k + 1]]))
        s = signatures(np.concatenate([a, b]), np.array([0, 100, 200]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - 90 / 110) < 0.03


def test_rows_without_id_are_told_apart(spark):
    t, u, v = "one two three four five six", "seven eight nine ten eleven", "words of a third text stand here"
    rows = [(None, t), (4, t), (4, t), (7, u), (None, u), (None, "clean and different words stand here"), (None, v), (None, v), (9, None), (None, None), (2, v + " now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((99 if r.doc_id is None else r.doc_id), r.n_shingles, (99 if r.component_id is None else r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == [(2, 4, 2, True), (4, 2, 4, True), (4, 2, 4, True), (7, 1, 7, True), (9, 0, 9, True), (99, 0, 99, True), (99, 1, 7, False), (99, 2, 4, False), (99, 2, 99, True), (99, 3, 99, True), (99, 3, 99, True)]
    for seed in (1, 2):
        rows = corpus(seed)
        assert sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_pairs_that_the_stars_leave_out(spark, monkeypatch):
    """A group whose copies drift: most pairs are too far apart, links run from neighbour to neighbour, over many tiles."""
    from souklens.llm import near_dup

    monkeypatch.setattr(near_dup, "TILE", 7)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for group in range(3):
        base = [word() for _ in range(90)]
        for k in range(40):
            w = base[:]
            for _ in range(r.choice([1, 2, 3, 4])):
                w[r.randrange(90)] = word()
            rows.append(" ".join(w))
            if k % 5 == 0:
                base = w
    rows = [(k, t) for k, t in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=85)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_every_likeness_of_85_percent_is_found(spark):
    """Recall: pairs at about 0.85 to 0.87, sets of 7 to 500 shingles."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, want = [], set()
    for size in (7, 14, 20, 60, 150, 500):
        for k in range(60):
            w = [word() for _ in range(size + 4)]
            cut = int(size * 0.15 / 1.85)
            rows += [(len(rows), " ".join(w[: size + 4])), (len(rows) + 1, " ".join(w[: size + 4 - cut] + [word() for _ in range(cut)]))]
            if 100 * (size - cut) >= 85 * (size + cut):
                want.add(len(rows) - 1)
    got = {x.doc_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect() if not x.kept}
    assert len(want) > 300 and got == want
