"""Merkle manifest of a table: a root, and for every record the proof that leads to it.

A record's leaf is the SHA-256 of its columns.  The leaves of a group, in order, form a tree
of ``fanout`` children a node; the roots of the groups form a second tree by the same rule.
A tree ends where one node remains, and a last run may have fewer children, even one.

Trees are cut into aligned blocks of ``fanout ** depth`` consecutive leaves.  A block builds its
own part and then takes its upper proof from a butterfly exchange: in round r, blocks that
differ only in digit r (in base ``fanout``) of their number swap the roots of
their subtrees.  Each of them hashes the same ancestor, so after the last round every block
knows the path to the root and nothing has to be sent down.  Where the last subtree has
fewer blocks than the others, its blocks speak for the missing ones in turn, so every
block still meets one of each sibling subtree.  A round is one exchange of a row per block
(two at most), in groups of ``fanout`` rows; no task sees a tree, and the number of rounds
is logarithmic.  Each round is written to the shared folder.

Defined results: null columns enter a leaf as ``-``, so a null and an empty text differ; records
are ordered by identifier (null first) and then by leaf, so rows repeated as a whole are
interchangeable and each has a place; null is a group of its own, before all others; a
group with one record has its leaf as root; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.storage import numbered, stored


def node_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record_leaf(*columns: Column) -> Column:
    """Digest of values, each with its length in bytes, so that none runs into the next."""
    parts = []
    for column in columns:
        value = column.cast("string")
        sized = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(sized, F.lit("-")))
    return node_hash(F.concat(*parts))


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings along ``path`` lead to."""
    return F.aggregate(
        path, leaf, lambda node, step: node_hash(F.concat(step["before"], node, step["after"]))
    )


def proof_text(path: Column) -> Column:
    """All siblings from the leaf upwards, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _parents(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda run: node_hash(F.array_join(F.slice(nodes, run * fanout + 1, fanout), "")))


def _step(nodes: Column, place: Column, fanout: int) -> Column:
    """Siblings of the node at ``place`` (from 0) of a block's level."""
    child = F.pmod(place, F.lit(fanout))
    before = F.slice(nodes, place - child + 1, child)
    after = F.slice(nodes, place + 2, fanout - 1 - child)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def _exchange(state: DataFrame, fanout: int, depth: int, turn: int) -> DataFrame:
    """One round of the butterfly over rows (group, n, block, root, path)."""
    span = fanout**turn
    number = F.col("block")
    # Blocks of the subtree that this block is in; ``span`` in all but the last one.
    blocks = F.ceil(F.col("n") / float(fanout**depth)).cast("long")
    there = F.least(F.lit(span), blocks - F.floor(number / span) * span)
    own = F.pmod(number, F.lit(span))
    lists = Window.partitionBy("group", "run", "role")
    sent = state.select(
        "*",
        F.floor(number / (span * fanout)).alias("run"),
        F.pmod(F.floor(number / span), F.lit(fanout)).cast("int").alias("digit"),
        own.alias("own"),
        F.explode(F.sequence(own, F.lit(span - 1).cast("long"), there)).alias("role"),
    )
    met = sent.withColumn(
        "met", F.sort_array(F.collect_list(F.struct("digit", "root")).over(lists))
    ).where("role = own")

    def roots(condition=None) -> Column:
        chosen = F.filter("met", condition) if condition else F.col("met")
        return F.array_join(F.transform(chosen, lambda m: m["root"]), "")

    step = F.struct(
        roots(lambda m: m["digit"] < F.col("digit")).alias("before"),
        roots(lambda m: m["digit"] > F.col("digit")).alias("after"),
    )
    open_ = F.col("n") > F.lit(fanout ** (depth + turn))
    return met.select(
        "group", "n", "block",
        F.when(open_, node_hash(roots())).otherwise(F.col("root")).alias("root"),
        F.when(open_, F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"),
    )


def merkle_paths(leaves: DataFrame, order: str, fanout: int = 8, depth: int = 3) -> DataFrame:
    """Trees over stored ``leaves(group, <order>, leaf, ...)``, one for each group.

    Returns the rows with ``position`` in the group, ``subroot`` and ``path``, an array of
    (before, after): hex digests of the siblings on both sides, level by level.
    """
    if fanout < 2 or depth < 1:
        raise ValueError("a tree needs a fanout of 2 and a depth of 1 at least")
    carried = [c for c in leaves.columns if c != "group"]
    rows = numbered(leaves, "group", order, "leaf")
    groups = stored(
        rows.groupBy(F.col("group").alias("_group")).agg(
            F.min("number").alias("_first"), F.count("*").alias("n")
        )
    )
    position = F.col("number") - F.col("_first")
    placed = rows.join(groups, F.col("group").eqNullSafe(F.col("_group"))).select(
        "group", "n", F.floor(position / fanout**depth).alias("block"),
        F.struct(position.alias("position"), *carried).alias("member"),
    )
    # At most fanout ** depth rows a block.
    blocks = placed.groupBy("group", "n", "block").agg(F.sort_array(F.collect_list("member")).alias("members"))
    levels = blocks.withColumn("_0", F.transform("members", lambda m: m["leaf"]))
    for k in range(depth):
        grown = F.when(F.col("n") > fanout**k, _parents(F.col(f"_{k}"), fanout)).otherwise(F.col(f"_{k}"))
        levels = levels.withColumn(f"_{k + 1}", grown)
    levels = stored(levels.withColumn("root", F.element_at(f"_{depth}", 1)).drop(f"_{depth}"))

    nothing = F.array().cast("array<struct<before:string,after:string>>")
    state = stored(levels.select("group", "n", "block", "root").withColumn("path", nothing))
    most, turn = groups.agg(F.max("n")).first()[0] or 0, 0
    while most > fanout ** (depth + turn):
        state = stored(_exchange(state, fanout, depth, turn))
        turn += 1

    def inner(m: Column) -> Column:
        place = F.pmod(m["position"], F.lit(fanout**depth)).cast("int")
        steps = [
            F.when(F.col("n") > fanout**k, _step(F.col(f"_{k}"), F.floor(place / fanout**k).cast("int"), fanout))
            for k in range(depth)
        ]
        return F.filter(F.array(*steps), lambda step: step.isNotNull())

    upper = state.select(
        F.col("group").alias("_group"), F.col("block").alias("_block"),
        F.col("root").alias("subroot"), F.col("path").alias("_upper"),
    )
    same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
    return levels.join(upper, same).select(
        "group", "subroot", "_upper",
        F.explode(F.transform("members", lambda m: F.struct(m.alias("m"), inner(m).alias("inner")))).alias("leaf"),
    ).select(
        "group", "subroot", F.col("leaf.m.position").alias("position"),
        *[F.col(f"leaf.m.{c}").alias(c) for c in carried],
        F.concat("leaf.inner", "_upper").alias("path"),
    )


def manifest(
    records: DataFrame, columns: list[str], group_col: str, id_col: str,
    fanout: int = 8, depth: int = 3, **carried: Column,
) -> DataFrame:
    """One row per record: id, group, position, leaf, subroot, root, path and ``carried`` columns.

    ``path`` leads from the leaf by way of the group's subroot to the root of all groups.
    """
    leaves = stored(
        records.select(
            F.col(group_col).cast("string").alias("group"),
            F.col(id_col).alias("id"),
            record_leaf(*[F.col(c) for c in columns]).alias("leaf"),
            *[value.alias(name) for name, value in carried.items()],
        )
    )
    trees = stored(merkle_paths(leaves, "id", fanout, depth))
    tops = trees.where("position = 0").select(
        F.lit("").alias("group"), F.col("group").alias("of"), F.col("subroot").alias("leaf")
    )
    top = stored(merkle_paths(stored(tops), "of", fanout, depth)).select(
        F.col("of").alias("_of"), F.col("subroot").alias("root"), F.col("path").alias("_above")
    )
    return trees.join(top, F.col("group").eqNullSafe(F.col("_of"))).select(
        F.col("id").alias(id_col), "group", "position", "leaf", "subroot", "root",
        F.concat("path", "_above").alias("path"), *carried,
    )
