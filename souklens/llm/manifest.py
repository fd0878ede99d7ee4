"""Merkle manifest of a table: leaves, a tree for each group, a tree over the groups' roots, and proofs.

A group's nodes are numbered in order and cut into aligned blocks of `FAN ** STEPS`. A block keeps each of its levels as
one string of hex digests laid end to end, so that a parent is the hash of a substring of fixed width, and what a node's
proof needs at a level is the two substrings beside it in its run. The blocks' roots are the nodes of the next round, until
each group has one. Proofs are then handed down from the last round to the first, a block at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.plans.lineage import settled

FAN, STEPS, HEX = 8, 3, 64
RUN, BLOCK = FAN * HEX, FAN**STEPS
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf takes it: `-` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.reduce(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(nodes: DataFrame) -> DataFrame:
    """nodes (grp, key, digest, ...) with rank, from 0 in each grp by key and digest, and size, the grp's rows.

    Rows are dealt to ranges, so that neither a large group nor a repeated row meets in one task; what is summed for each group
    is one count a range.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("tie")]
    rows = nodes.withColumn("tie", F.monotonically_increasing_id())
    rows = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.col("grp").alias("g"), F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    group = W.partitionBy("g")
    parts = parts.select("g", "part", (F.sum("n").over(group.orderBy("part")) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(group).alias("size"))
    found = rows.join(parts, F.col("grp").eqNullSafe(F.col("g")) & (F.shiftright("at", 33) == F.col("part")))
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("g", "part", "shift", "at")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of each run."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * RUN + 1, F.lit(RUN)).cast("binary"), 256)), "")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of numbered nodes: grp, block, size, members by rank, the levels as strings, root."""
    member = F.struct("rank", *[c for c in nodes.columns if c not in ("grp", "rank", "size")])
    rows = nodes.groupBy("grp", F.shiftright("rank", 3 * STEPS).alias("block")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("s0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for k in range(STEPS):
        rows = rows.withColumn(f"s{k + 1}", F.when(F.col("size") > FAN**k, _parents(F.col(f"s{k}"))))
    return rows.withColumn("root", F.coalesce(*[F.col(f"s{k}") for k in range(STEPS, -1, -1)]))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of each round; in the last, each group has one, whose root is the group's."""
    out = [settled(_blocks(nodes))]
    most = out[0].agg(F.max("size")).first()[0] or 0
    while most > BLOCK:
        up = out[-1].select("grp", F.col("block").alias("rank"), F.col("root").alias("digest"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"))
        out.append(settled(_blocks(up)))
        most = -(-most // BLOCK)
    return out


def _beside(at: Column) -> Column:
    """The siblings of the node at a place within its block, at each level of the block that has a parent."""

    def level(k: int) -> Column:
        s, i = F.col(f"s{k}"), F.shiftright(at, 3 * k).cast("int")
        run = F.shiftright(i, 3) * RUN
        left = F.substr(s, run + 1, i * HEX - run)
        right = F.substr(s, i * HEX + HEX + 1, run + RUN - i * HEX - HEX)
        return F.when(F.col("size") > FAN**k, F.struct(left.alias("left"), right.alias("right")))

    return F.array_compact(F.array(*[level(k) for k in range(STEPS)]))


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Members of the first round with grp, proof, subroot and root. above: grp, proof and root of each group's own root."""
    last = rounds[-1].select("grp", "block", F.col("root").alias("subroot"))
    a = above.select(F.col("grp").alias("g"), "proof", "root")
    down = last.join(a, F.col("grp").eqNullSafe(F.col("g"))).drop("g")
    for blocks in reversed(rounds):
        d = down.select(F.col("grp").alias("g"), F.col("block").alias("b"), F.col("proof").alias("upper"), "subroot", F.col("root").alias("top"))
        rows = blocks.join(d, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).withColumn("m", F.explode("members"))
        proof = F.concat(_beside(F.col("m.rank") - F.col("block") * BLOCK), "upper")
        down = rows.select("grp", F.col("m.rank").alias("block"), "m", proof.alias("proof"), "subroot", F.col("top").alias("root"))
    return down


def manifest(df: DataFrame, fields: tuple[str, ...], group: str, key: str, claims: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of df's: key, leaf, claimed, subroot, root, proof.

    fields: columns that a leaf hashes, in this order. group: a tree of its own for each value; the trees' roots, by group with
    null first, make the last tree. key: the order of leaves; ties go by leaf. claims: what a holder says that fields are;
    claimed is the leaf of those values. proof has the siblings of each level, of the group's tree and then of the last one.

    Nulls are leaves, keys and groups like others (null first); repeated rows are leaves of their own; texts of any length are
    hashed whole; an empty table has no rows. Columns of df that aren't named are dropped, so none can clash.
    """
    own = digest(*[field(F.col(f)) for f in fields])
    said = digest(*[field((claims or {}).get(f, F.col(f))) for f in fields])
    rows = df.select(F.col(group).alias("grp"), F.col(key).alias("key"), own.alias("digest"), said.alias("claimed"))
    rounds = _rounds(numbered(rows))
    roots = rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("root").alias("digest"))
    tops = _rounds(numbered(roots))
    whole = tops[-1].select("grp", F.lit(None).cast(PROOF).alias("none"), "root").select("grp", F.coalesce("none", F.array().cast(PROOF)).alias("proof"), "root")
    above = settled(_proofs(tops, whole).select(F.col("m.key").alias("grp"), "proof", "root"))
    out = _proofs(rounds, above)
    return out.select(F.col("m.key").alias(key), F.col("m.digest").alias("leaf"), F.col("m.claimed").alias("claimed"), "subroot", "root", "proof")
