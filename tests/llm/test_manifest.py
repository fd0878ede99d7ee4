import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from souklens.llm import queries
from souklens.llm.manifest import folded, manifest, proof_digest
from souklens.llm.oracles import ORACLES

KIND = "doc_id long, text string, lang string, source string, n_chars long, rank long, proof string, leaf int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root, and each node's siblings by level."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            beside[k].append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], beside


def brute(rows):
    made = []
    for r in rows:
        d = dict(zip([x.split()[0] for x in KIND.split(", ")], r, strict=True))
        leaf = H(*(field(d[f]) for f in FIELDS))
        said = dict(d)
        if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None:
            said["text"] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"])
        made.append((d["lang"], d["doc_id"], leaf, H(*(field(said[f]) for f in FIELDS))))
    first = lambda v: (v is not None, v if isinstance(v, int | None) else v.encode())
    langs = sorted({m[0] for m in made}, key=first)
    trees = {x: sorted((m for m in made if m[0] == x), key=lambda m: (first(m[1]), m[2])) for x in langs}
    up = {x: climb([m[2] for m in trees[x]]) for x in langs}
    root, top = climb([up[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, over in zip(langs, top, strict=True):
        sub, beside = up[x]
        for m, own in zip(trees[x], beside, strict=True):
            node = m[3]
            for left, right in own + over:
                node = H(*left, node, *right)
            out.append((m[1], m[2], sub, root, H(*(s for pair in own + over for side in pair for s in side)), node, node == root))
    return sorted(out, key=repr)


def result(df):
    own = manifest(df, FIELDS, "lang", "doc_id", {"text": queries.tampered()})
    again = own.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), folded(F.col("claimed"), F.col("proof")).alias("f"))
    return sorted((tuple(r) for r in again.withColumn("ok", F.col("f") == F.col("root")).collect()), key=repr)


def rows_of(n, langs, seed):
    r = random.Random(seed)
    return [(r.choice([k, k, r.randrange(n), None]), r.choice(["Some Text", "low", "", None, "Ünïcode " * r.randrange(40)]), r.choice(langs), r.choice(["a", None]), r.choice([None, 5]), 1, "x", 2) for k in range(n)]


@pytest.mark.parametrize(("n", "langs"), [(0, ["en"]), (1, [None]), (9, ["en"]), (700, ["en"] * 9 + [None, "de", ""]), (1300, [f"l{k}" for k in range(600)]), (4700, ["en"] * 5 + ["de"])])
def test_equals_brute_force(spark, n, langs):
    rows = rows_of(n, langs, n)
    assert result(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = [(7, "A" * 3_000_000, "en", None, 3, 0, "", 0)] * 3 + [(7, "b", "en", None, 3, 0, "", 0)] * 600 + [(None,) * 8] * 20
    assert result(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_query_equals_sql(spark, tmp_path):
    rows = rows_of(1500, ["en"] * 6 + ["de", "fr", None], 5)
    df = spark.createDataFrame(rows, KIND).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES["op13_merkle_manifest"])
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr) == brute([r[:5] + (0, "", 0) for r in rows])
    assert os.path.isdir(tmp_path)
