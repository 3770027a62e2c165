import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from diffloom.llm.sharding import (
    expected_shares,
    moved_share,
    rendezvous,
    shard_table,
    write_shards,
)


def brute(key, weights):
    """Shard of a key, worked out from the published digest."""
    best = None
    for shard, weight in sorted(weights.items()):
        name = str(shard) if key is None else f"{shard}:{key}"
        number = int(hashlib.md5(name.encode()).hexdigest()[:13], 16)
        score = weight / -math.log((number + 0.5) / 16**13)
        if best is None or score > best[0]:
            best = (score, shard)
    return best[1]


def test_equals_brute_force_with_slots_and_sizes(docs):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, "a"), (None, None), (7, "text 7"), (9, ""), (9, "é")]
    weights = {i: 1.0 for i in range(16)}
    got = shard_table(docs(rows), [1.0] * 16, grown=[1.0] * 17).collect()
    assert len(got) == len(rows)
    expected = Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute(i, weights), brute(i, {**weights, 16: 1.0}))
        for i, t in rows
    )
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == expected
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r)
    for members in by_shard.values():
        members.sort(key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in members]
        assert ids == sorted(ids)


def test_one_more_shard_takes_records_only_into_itself(spark):
    weights = [1.0, 2.0, 1.0, 0.5]
    moves = moved_share(
        spark.range(20_000).select(
            rendezvous(F.col("id"), weights).alias("shard"),
            rendezvous(F.col("id"), weights + [1.5]).alias("grown_shard"),
        )
    ).collect()
    assert {r.grown_shard for r in moves if r.grown_shard != r.shard} == {4}
    shares = Counter()
    for r in moves:
        shares[r.shard] += r["rows"]
    for shard, share in expected_shares(weights).items():
        assert abs(shares[shard] / 20_000 - share) < 0.015
    taken = sum(r["rows"] for r in moves if r.grown_shard == 4) / 20_000
    assert abs(taken - expected_shares(weights + [1.5])[4]) < 0.015


def test_a_shard_that_goes_gives_up_only_its_own(spark):
    full, less = {0: 1.0, 1: 1.0, 2: 3.0}, {0: 1.0, 2: 3.0}
    both = spark.range(3000).select(rendezvous(F.col("id"), full).alias("a"), rendezvous(F.col("id"), less).alias("b"))
    assert both.where("a != 1 and a != b").isEmpty()


def test_hot_key_and_long_text(docs):
    long = "y" * 2_000_000
    got = shard_table(docs([(5, "same")] * 400 + [(i, "x") for i in range(100, 140)] + [(1, long)]), [1.0] * 4).collect()
    hot = [r for r in got if r.doc_id == 5]
    assert len(hot) == 400 and len({r.shard for r in hot}) == 1 and all(r.grown_shard is None for r in got)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    assert [r.size for r in got if r.doc_id == 1] == [len(long) + 1]


def test_empty_table_one_shard_and_bad_weights(docs):
    assert shard_table(docs([]), [1.0] * 3).collect() == []
    assert {r.shard for r in shard_table(docs([(1, "a"), (None, None)]), [2.0]).collect()} == {0}
    for bad in ([], [0.0], [1.0, -1.0], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            rendezvous(F.lit(1), bad)


def test_written_shards_hold_whole_records(spark, docs, tmp_path):
    rows = [(i, f"t{i}") for i in range(200)] + [(None, "n"), (3, "t3")]
    table = docs(rows).withColumn("shard", F.lit("clash"))
    write_shards(table, [1.0, 1.0, 2.0], str(tmp_path / "out"), files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted(table.columns)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(rows, key=key)
    assert back.where(F.col("shard") != rendezvous(F.col("doc_id"), [1.0, 1.0, 2.0])).isEmpty()
    assert len(list((tmp_path / "out" / "shard=2").glob("*.parquet"))) <= 3
