import random
import re

from souklens.llm.license_signatures import signatures
from souklens.llm.licenses import BASE, KEYWORDS, lead, pieces, rules, scan_licenses


def words_of(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(t):
    w = words_of(t)
    s = " " + " ".join(w) + " "
    base = sorted((i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    spans = []
    for k, label, keyword, pattern, weight in rules():
        if keyword not in s:
            continue
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", s):
            spans.append((s[: m.start()].count(" ") - 1, m[0].count(" ") + 1, k, label, weight))
    kept = []
    for a in spans:
        inside = [b for b in spans if b is not a and b[0] <= a[0] and b[0] + b[1] >= a[0] + a[1] and (b[1] > a[1] or b[2] < a[2] or (b[2] == a[2] and spans.index(b) < spans.index(a)))]
        if not inside:
            kept.append((a[0], a[1], a[3]))
    return len(w), base, sorted(kept)


def test_equals_brute_force(spark):
    r = random.Random(1)
    vocab = "MIT|License|license|Apache|GNU|General|Public|the|under|Licensed|licensed|version|2.0|v2|2|or|later|é|Lesser|Affero|BSD|3-Clause|released|all rights reserved|public domain|SPDX-License-Identifier:|x".split("|")
    texts = [None, "", "MIT License MIT License", "mit license mit\nlicense!", "mit-LICENSE", "ĸmit license", "İ mit license", "Licensed under the Apache License, Version 2.0", "see the GNU General Public License version 3 or any later version"]
    texts += [r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.randint(1, 25))) for _ in range(150)] + ["x " * 20000 + "MIT license"]
    rows = [(k, t, "own") for k, t in enumerate(texts)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(4)
    n = 0
    for x in scan_licenses(df).collect():
        words, base, kept = brute(x.text)
        assert x.n_words == words and sorted((b.start, b.label) for b in x.base) == base, x.text
        assert sorted((d.start, d.length, d.label) for d in x.detections) == kept, x.text
        assert x.labels == sorted({b[1] for b in base} | {k[2] for k in kept}) and 0 <= x.score <= 1
        n += len(kept)
    assert n > 100 and len(rules()) > 300
    assert scan_licenses(df.limit(0)).count() == 0


def sample(pattern):
    """A shortest text that a signature matches: optional parts left out, the first of alternatives, one word for any word."""
    t = re.sub(r"\(\?:\[\^ \]\+ \)\{(\d+),\d+\}", lambda m: "w " * int(m[1]), pattern)
    t = re.sub(r"\[\^ \]\+", "w", t)
    t = re.sub(r"\[([^]])[^]]*\]", r"\1", t)
    while (m := re.search(r"\(\?:([^()]*)\)([?*]?)", t)) is not None:
        t = t[: m.start()] + ("" if m[2] else m[1].partition("|")[0]) + t[m.end() :]
    return re.sub(r".\?", "", t)


def test_each_signature_is_found(spark):
    """Each hand-written signature fires on a text of its own, or a longer or earlier one covers the place."""
    rows = [(k, f"Intro. {sample(p).upper().replace(' ', ', ')} end", label) for k, (label, p, _) in enumerate(signatures())]
    bare = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, want string").repartition(4)).collect()}
    assert len(bare) == len(rows) > 200
    for k, (label, p, _) in enumerate(signatures()):
        s = sample(p)
        assert re.fullmatch(p, s), (p, s)
        assert any(w in s for w in KEYWORDS), p
        words, _, kept = brute(bare[k].text)
        assert bare[k].n_words == words and sorted((d.start, d.length, d.label) for d in bare[k].detections) == kept
        assert any(start <= 1 and start + n >= words - 1 for start, n, _ in kept), p
    assert sum(label in bare[k].labels for k, (label, _, _) in enumerate(signatures())) > 0.95 * len(rows)


def member(members):
    """A character of a set, s before others."""
    ops = [(str(op), v) for op, v in members]
    if ops[0][0] == "NEGATE":
        return "w"
    return max((chr(v) if op == "LITERAL" else chr(v[0]) if op == "RANGE" else "3" for op, v in ops), key=lambda c: (c == "s", c))


def ways(parts):
    """Texts that a parsed pattern matches: every alternative once, optional parts left out and put in."""
    out = [""]
    for op, arg in parts:
        if str(op) == "LITERAL":
            own = [chr(arg)]
        elif str(op) == "SUBPATTERN":
            own = ways(arg[-1])
        elif str(op) == "BRANCH":
            own = [w for way in arg[1] for w in ways(way)]
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
            own = [w * max(arg[0], 1) for w in ways(arg[2])] + ([""] if arg[0] == 0 else [])
        else:
            own = [member(arg)] if str(op) == "IN" else ["w"]
        n = max(len(out), len(own))
        out = [out[k % len(out)] + own[k % len(own)] for k in range(n)] if len(out) * len(own) > 4096 else [a + b for a in out for b in own]
    return out


def test_no_alternative_is_hidden_by_its_pieces():
    """Whatever alternatives a match takes, it holds a piece of its rule, and the keyword of that piece."""
    n = 0
    for _, _, _, pattern, _ in rules():
        found = pieces(pattern)
        for w in ways(re._parser.parse(pattern)):
            assert re.fullmatch(pattern, w), (pattern, w)
            assert any(p in f" {w} " and lead(p) in w for p in found), (pattern, w, found)
            n += 1
    assert n > 3 * len(rules())


def test_lost_alternatives_and_helper_names(spark):
    texts = {"GPL version 3 or any later version": "gpl", "Apache Software Foundation version 2.0": "apache", "unless required by applicable law or agreed to in writing the work": None, "php 3.0 is out": ""}
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in enumerate(texts)], "doc_id long, text string, _t int, _low int, _hit int, _spans int")
    got = scan_licenses(df)
    assert got.columns[:6] == df.columns
    for r in got.collect():
        want = list(texts.values())[r.doc_id]
        assert (r["_t"], r["_low"], r["_hit"], r["_spans"]) == (1, 2, 3, 4)
        assert (r.labels == []) if want == "" else (want in r.labels if want else r.labels), r.text
