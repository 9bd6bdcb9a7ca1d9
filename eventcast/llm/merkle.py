"""Merkle manifest of a dataset: a tree per group of rows, their roots under one root, a proof for every row.

Rows of a group are ordered by a key and cut into aligned chunks of ``FANOUT ** LOCAL_LEVELS`` leaves. Each chunk
hashes its own subtree. Then the chunks run a butterfly: in round r, chunks of one aligned group of
``FANOUT ** (r + 1)`` send the root of the subtree they share with ``FANOUT ** r`` chunks to the chunks of the
sibling subtrees, and every receiver hashes the same ancestor for itself. So after the last round each chunk holds
the group's root and the upper part of the proof of its rows; nothing is passed down again. Where a last subtree
is not full, its chunks share the receivers between them.

Digests are lowercase hex sha256, inputs concatenated as text. A null field enters a leaf as ``-``, any other as its
UTF-8 byte count, ``:`` and its value, so an empty text differs from a null. Null groups and null keys come first;
rows of equal key are ordered by their leaf, and equal leaves are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventcast.operators.attach import attach
from eventcast.operators.rank import global_rank
from eventcast.session import stage, stage_table

FANOUT = 8
LOCAL_LEVELS = 3
CHUNK = FANOUT**LOCAL_LEVELS
PROOF = "array<struct<at:int,others:array<string>>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field with its length, so that no two rows share an input."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(digest: Column, level: Column) -> Column:
        before = F.slice(level["others"], F.lit(1), level["at"])
        after = F.slice(level["others"], level["at"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level from the leaf to the root, left to right."""
    return node_digest(F.flatten(F.transform(proof, lambda level: level["others"])))


def _next_level(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: node_digest(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))))


def _round(state: DataFrame, span: int) -> DataFrame:
    """One exchange: subtrees of ``span`` nodes meet their siblings.

    ``state``: (tree, at, n, digest, proof), one row per node, with the root of its subtree of ``span`` nodes.
    """
    at, n = F.col("at"), F.col("n")
    below = F.pmod(at, F.lit(span))
    own = F.pmod(F.floor(at / span), F.lit(FANOUT)).cast("int")
    first = at - F.pmod(at, F.lit(span * FANOUT))
    size = F.least(F.lit(span).cast("long"), n - (at - below))
    open_ = n > span

    def receivers(j: Column) -> Column:
        start = first + j * span
        end = F.least(start + span, n)
        reached = F.when(start + below < end, F.sequence(start + below, end - 1, size))
        return F.when(open_ & (j != own), F.coalesce(reached, F.array().cast("array<bigint>"))).otherwise(
            F.array().cast("array<bigint>"))

    targets = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), receivers))
    sent = state.select("tree", "n", own.alias("own"), "digest", "proof", at.alias("from"),
                        F.explode(F.concat(F.array(at), targets)).alias("at"))
    mine = F.col("from") == F.col("at")
    met = sent.groupBy("tree", "at").agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("own", "digest"))).alias("run"),
        F.max(F.when(mine, F.col("own"))).alias("own"),
        F.first(F.when(mine, F.col("proof")), ignorenulls=True).alias("proof"),
        F.max(F.when(mine, F.col("digest"))).alias("digest"),
    )
    others = F.transform(F.filter("run", lambda x: x["own"] != F.col("own")), lambda x: x["digest"])
    level = F.array(F.struct(F.col("own").alias("at"), others.alias("others")))
    return met.select(
        "tree", "at", "n",
        F.when(open_, node_digest(F.transform("run", lambda x: x["digest"]))).otherwise(F.col("digest")).alias("digest"),
        F.when(open_, F.concat("proof", level)).otherwise(F.col("proof")).cast(PROOF).alias("proof"),
    )


def butterfly(nodes: DataFrame) -> DataFrame:
    """(tree, at, digest: root of the tree, proof) from staged nodes (tree, at, n, digest).

    ``at`` counts the ``n`` nodes of each tree from 0. One shuffle per level, of rows of a few hundred bytes.
    """
    state = nodes.select("tree", "at", "n", "digest", F.array().cast(PROOF).alias("proof"))
    most, span = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0], 1
    while span < most:
        state, span = _round(state, span), span * FANOUT
    return state.drop("n")


def _chunks(leaves: DataFrame, carried: Sequence[str]) -> DataFrame:
    """One row per chunk: its rows and leaves in order, its inner levels and the root of its subtree."""
    ranked = global_rank(leaves, ["_key", "_leaf"], ["tree"], out="_place")
    row = F.struct(F.pmod("_place", F.lit(CHUNK)).alias("at"), F.col("_leaf").alias("leaf"), *carried)
    chunks = stage_table(ranked.groupBy("tree", F.floor(F.col("_place") / CHUNK).alias("at")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")))
    sizes = chunks.groupBy("tree").agg((F.max("at") + 1).alias("n"))
    chunks = attach(chunks, sizes, "tree").withColumn("level0", F.transform("rows", lambda x: x["leaf"]))
    for k in range(LOCAL_LEVELS):
        nodes = F.col(f"level{k}")
        grows = (F.col("n") > 1) | (F.size(nodes) > 1)
        chunks = chunks.withColumn(f"level{k + 1}", F.when(grows, _next_level(nodes)).otherwise(nodes))
    digest = F.element_at(f"level{LOCAL_LEVELS}", 1)
    rest = F.transform("rows", lambda x: F.struct(x["at"].alias("at"), *[x[c].alias(c) for c in carried]))
    return stage_table(chunks.withColumn("digest", digest).withColumn("rows", rest).drop(f"level{LOCAL_LEVELS}"))


def _without(run: Column, at: Column) -> Column:
    return F.filter(run, lambda x, i: i != at)


def _local_proof(place: Column) -> Column:
    levels = []
    for k in range(LOCAL_LEVELS):
        nodes = F.col(f"level{k}")
        node = F.floor(place / FANOUT**k).cast("int")
        at = F.pmod(node, F.lit(FANOUT))
        run = F.slice(nodes, node - at + 1, F.lit(FANOUT))
        level = F.struct(at.cast("int").alias("at"), _without(run, at).alias("others"))
        levels.append(F.when((F.col("n") > 1) | (F.size(nodes) > 1), level))
    return F.filter(F.array(*levels), lambda level: level.isNotNull())


def manifest(rows: DataFrame, fields: Sequence[str], group: str, key: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, carried columns): one row per row of the table.

    ``fields`` make a leaf, ``group`` names the subtree and ``key`` orders it. ``carry`` are further short columns of
    each row, computed where the row is read. ``proof`` lists, from the leaf up to the root, the place in the run and the
    other digests of the run.
    """
    carry = {key: F.col(key), **(carry or {})}
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(group).cast("string")))
    leaves = rows.select(tree.alias("tree"), F.col(key).alias("_key"), leaf_digest([F.col(c) for c in fields]).alias("_leaf"),
                         *[column.alias(f"_c_{name}") for name, column in carry.items()])
    chunks = _chunks(leaves, [f"_c_{name}" for name in carry])
    upper = stage(butterfly(chunks))
    trees = upper.filter(F.col("at") == 0).select("tree", "digest")
    count = trees.count()
    top = global_rank(trees, ["tree"], out="at").select(
        F.lit("").alias("tree"), "at", F.lit(count).cast("long").alias("n"), "digest", F.col("tree").alias("name"))
    top = stage(top)
    roots = attach(top.select("at", "name"), butterfly(top).select("at", F.col("digest").alias("root"), F.col("proof").alias("_top")), "at")
    upper = attach(upper.withColumnRenamed("digest", "subroot"), roots.select(F.col("name").alias("tree"), "root", "_top"), "tree")
    upper = upper.select("tree", "at", "subroot", "root", F.concat("proof", "_top").alias("_upper"))

    found = attach(chunks, upper, ["tree", "at"])
    proved = F.transform("rows", lambda x: F.struct(
        *[x[f"_c_{name}"].alias(name) for name in carry], F.get("level0", x["at"].cast("int")).alias("leaf"),
        _local_proof(x["at"]).alias("_local")))
    found = found.select("subroot", "root", "_upper", F.inline(proved))
    return found.select(key, "leaf", "subroot", "root", F.concat("_local", "_upper").alias("proof"),
                        *[name for name in carry if name != key])
