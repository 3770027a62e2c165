"""Components of the verified links inside buckets, without all pairs of a bucket.

In each round some members of a bucket are its leaders, and only pairs of a leader with
members of other components are verified.  A bucket is done when all its members are
in one component, or when every member outside its largest component has been a leader;
then each pair of its members is either verified or known to be connected.  A bucket of
near copies is done after one leader, that is after as many pairs as it has members.
The first leader is the member that meets most others in all its buckets, which the
common origin of near copies does.  The first round looks at a part of the buckets only;
after it most others have all their members in one component and cost nothing.  Then
the number of leaders grows 64-fold by round, so buckets of unrelated members also end
after few rounds.  There is no cap: every bucket is worked on until it is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.llm.graph import components
from diffloom.storage import remove, stored, tracked

Verify = Callable[[DataFrame, DataFrame], DataFrame]
#: Leaders of a bucket that are in one list, about.
LIST = 512


def with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return members.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def shared_buckets(keys: DataFrame, parts: int) -> DataFrame:
    """bucket, node, first, weight of the keys(key, node) that at least two nodes have.

    Keys with the same nodes are one bucket.  ``first`` marks the buckets of the first
    round, about one in ``parts``.  The weight of a node counts the nodes it meets in its
    buckets, repeatedly.  Keys and nodes are long, so the rows of this exchange are small.
    """
    same = Window.partitionBy("key")
    # Dealt out first, so that the exchange carries keys and nodes and not the hashes below.
    seen = keys.select("key", "node").repartition(F.col("key")).select(
        "node",
        (F.pmod("key", F.lit(parts)) == 0).alias("first"),
        F.count("*").over(same).alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(same).alias("_a"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).over(same).alias("_b"),
    ).where("n > 1")
    members = stored(
        seen.groupBy(F.xxhash64("n", "_a", "_b").alias("bucket"), "node")
        .agg(F.max("first").alias("first"), F.max("n").alias("n"))
    )
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    return members.drop("n").join(weights, "node")


def overlap_bound(size: Column, own: Column, other: Column) -> Column:
    """At most so many elements of a set of ``size`` elements are in another one.

    Sketches are arrays of 64-bit words in which the hash of each element sets a bit.  Each bit that
    only the own sketch has is there for an element that the other set lacks.  Null where a sketch is.
    """
    alone = F.zip_with(own, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return size - F.aggregate(alone, F.lit(0), lambda total, n: total + n)


def kept_table(paths: list[str], table: DataFrame) -> DataFrame:
    """Store ``table`` and note its path among those to stay."""
    with tracked() as own:
        table = stored(table)
    paths += own
    return table


def _round(
    members: DataFrame, labels, leaders: int, verify: Verify, similarity: float, sketches: DataFrame | None
):
    """One round: (members of open buckets with new ``tried``, links found, path of the members).

    None when done.  All other tables of the round are removed.
    """
    kept: list[str] = []
    with tracked() as made:
        done = _worked_round(members, labels, leaders, verify, similarity, sketches, kept)
    remove(members.sparkSession, [path for path in made if path not in kept])
    return done


def _worked_round(
    members: DataFrame, labels, leaders: int, verify: Verify, similarity: float,
    sketches: DataFrame | None, kept: list[str],
):
    tagged = with_components(members, labels)
    classes = tagged.groupBy("bucket", "component").agg(
        F.count("*").alias("n"), F.count(F.when(~F.col("tried"), 1)).alias("untried")
    )
    # The largest component of a bucket needs no leaders: the others' have met it.
    largest = F.struct("n", "component")
    state = classes.groupBy("bucket").agg(
        F.count("*").alias("classes"),
        F.max("n").alias("most"),
        F.max_by("component", largest).alias("main"),
        F.max_by("untried", largest).alias("_main_untried"),
        F.sum("untried").alias("_untried"),
    ).select("bucket", "main", "most", "classes", (F.col("_untried") - F.col("_main_untried")).alias("open"))
    state = stored(state.where("classes > 1 and open > 0"))
    if state.isEmpty():
        return None
    members = stored(tagged.join(state, "bucket"))
    # Where no two members are connected yet, any of them may lead.
    is_open = ~F.col("tried") & ((F.col("component") != F.col("main")) | (F.col("most") == 1))
    chance = F.pmod(F.xxhash64("node", F.lit(leaders)), F.lit(1 << 20)) * F.col("open")
    central = stored(
        members.where(is_open).groupBy("bucket").agg(
            F.max_by("node", F.struct("weight", "node")).alias("central")
        )
    )
    marked = kept_table(
        kept, members.join(central, "bucket", "left").withColumn(
            "leads",
            is_open
            & (
                (F.col("node") == F.col("central"))
                | (F.lit(leaders > 1) & (chance < F.lit(leaders << 20)))
            ),
        ).select("bucket", "node", "size", "weight", "component", "tried", "leads", "open")
    )
    # Leaders travel in lists of bounded length, so a pair is not a row of the join.  A bucket
    # has as many lists as its own leaders fill, however many this round would allow.
    chunks = F.ceil(F.least(F.lit(leaders), F.col("open")) / LIST)
    heads, others = marked.where("leads"), marked
    if sketches is not None:
        heads, others = (rows.join(sketches, "node") for rows in (heads, others))
    told = [c for c in ("node", "size", "component", "sketch") if c in heads.columns]
    lists = stored(
        heads.groupBy("bucket", F.pmod(F.xxhash64("node", F.lit(1)), chunks).alias("chunk"))
        .agg(F.collect_list(F.struct(*told)).alias("led_by"))
    )

    def fits(leader):
        near = (
            (leader["component"] != F.col("component"))
            & (F.col("size") >= F.lit(similarity) * leader["size"])
            & (leader["size"] >= F.lit(similarity) * F.col("size"))
        )
        if sketches is None:
            return near
        both = overlap_bound(F.col("size"), F.col("sketch"), leader["sketch"])
        # both / (sizes - both) >= similarity; a little less, so that rounding rejects no pair.
        enough = both * (1 + similarity) >= (similarity - 1e-9) * (F.col("size") + leader["size"])
        return near & F.coalesce(enough, F.lit(True))

    met = others.join(lists, "bucket").select(
        "node", F.transform(F.filter("led_by", fits), lambda leader: leader["node"]).alias("leaders")
    )
    candidates = met.where(F.size("leaders") > 0).groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("leaders"))).alias("leaders")
    )
    found = kept_table(kept, verify(candidates, marked.where("leads").select("node").distinct()))
    rest = marked.select(
        "bucket", "node", "size", "weight", (F.col("tried") | F.col("leads")).alias("tried")
    )
    return rest, found, kept[0]


def bucket_components(
    buckets: DataFrame, verify: Verify, similarity: float, growth: int = 64,
    sketches: DataFrame | None = None,
) -> DataFrame | None:
    """node, component for the nodes that have a link; None without a link.

    ``buckets`` is stored already and has bucket, node (any orderable type), size of the
    node's set, first and weight; sizes further apart than ``similarity`` allows are no
    links.  With ``sketches(node, sketch)``, pairs whose overlap cannot be enough
    (:func:`overlap_bound`) are not verified either; null sketches reject nothing.
    """
    spark = buckets.sparkSession
    labels, links, old_labels = None, None, []
    members = buckets.withColumn("tried", F.lit(False))
    for wave in (members.where("first"), members):
        rest, leaders, old_members = wave.drop("first"), 1, []
        while (done := _round(rest, labels, leaders, verify, similarity, sketches)) is not None:
            # What the round was worked out from is stored with it.
            remove(spark, old_members)
            rest, found, members_path = done
            old_members = [members_path]
            leaders *= growth
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                with tracked() as made:
                    joined, own = components(links), []
                    labels = kept_table(own, joined)
                remove(spark, old_labels + [path for path in made if path not in own])
                old_labels = own
            if wave is not members:
                break
        remove(spark, old_members)
    return labels
