import itertools
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from diffloom.llm.candidates import bucket_components
from diffloom.llm.graph import components
from diffloom.llm.minhash_dedup import near_duplicates, shingle_set, words_of
from diffloom.storage import stored


def brute(rows, n, similarity=Fraction(4, 5)):
    sets = [(i, shingle_set(words_of(t), n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and len(x & y) >= similarity * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in sets}


def edited(text, at, by="changed"):
    parts = text.split(" ")
    parts[at] = by
    return " ".join(parts)


@pytest.mark.parametrize("n", [2, 5])
def test_equals_brute_force(docs, words, n):
    base = [words(120) for _ in range(6)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(i, edited(edited(base[i % 3], i, f"u{i}"), 60 + i % 7)) for i in range(30)]
    # A chain: neighbours are alike, its ends are not.
    chain = base[5]
    for i in range(8):
        chain = edited(chain, 9 * i + 2, f"c{i}")
        rows.append((200 + i, chain))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two")]
    got = {r[0]: r for r in near_duplicates(docs(rows), words=n).collect()}
    want = brute(rows, n)
    assert {i: (r[1], r[2]) for i, r in got.items()} == want
    assert all(r[3] == (r[0] == r[2]) for r in got.values())


def test_rows_with_null_or_repeated_ids(docs, words):
    text = words(50)
    got = near_duplicates(docs([(None, text), (4, text), (4, text), (2, text)])).collect()
    assert sorted((r[0] or -1, r[2]) for r in got) == [(-1, 2), (2, 2), (4, 2), (4, 2)]


def test_very_long_text(docs, words):
    text = words(60_000, 50_000)
    got = near_duplicates(docs([(1, text), (2, edited(text, 77)), (3, words(10))])).collect()
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 3}


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_components_of_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(7, i) for i in range(300, 330)]
    cycle = [(500 + i, 500 + (i * 7 + 1) % 13) for i in range(13)]
    links = spark.createDataFrame(chain + star + cycle + [(9, 9), (8, 5), (5, 8)], "a long, b long")
    got = dict(tuple(r) for r in components(links).collect())
    assert all(got[i] == 100 for i in range(100, 181))
    assert all(got[i] == 7 for i in range(300, 330)) and got[7] == 7
    assert got[8] == got[5] == 5 and 9 not in got


def test_bucket_of_bridged_groups_needs_no_pairs_of_one_group(spark):
    """Two groups in one bucket that only the pair (19, 20) links."""
    nodes = list(range(40))
    rows = [(1, i, 1, True, 40) for i in nodes]
    schema = "bucket long, node long, size int, first boolean, weight long"
    buckets = stored(spark.createDataFrame(rows, schema))
    asked = []

    def verify(candidates, leaders):
        pairs = candidates.select("node", F.explode("leaders").alias("leader")).select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
        ).distinct()
        assert {r.leader for r in candidates.select(F.explode("leaders").alias("leader")).collect()} <= {
            r.node for r in leaders.collect()
        }
        asked.extend((r.a, r.b) for r in pairs.collect())
        same = (F.col("a") < 20) == (F.col("b") < 20)
        return pairs.where(same | ((F.col("a") == 19) & (F.col("b") == 20)))

    got = dict(tuple(r) for r in bucket_components(buckets, verify, 0.8).collect())
    assert set(got.values()) == {0} and len(got) == 40
    assert len(set(asked)) < len(nodes) * (len(nodes) - 1) / 2


def test_overlap_bound_rejects_no_link(spark):
    """The bound is at least the overlap, and close to it where sketches are sparse."""
    import random

    from pyspark.sql import functions as F

    from diffloom.llm.candidates import overlap_bound

    rng = random.Random(6)
    rows = []
    for _ in range(200):
        common = rng.sample(range(10**9), rng.randint(0, 60))
        a, b = ({*common, *rng.sample(range(10**9), rng.randint(1, 60))} for _ in range(2))
        words = []
        for own in (a, b):
            value = sum({1 << (x % 1024): 0 for x in own})
            parts = [value >> (64 * i) & (2**64 - 1) for i in range(16)]
            words.append([x - 2**64 if x >= 2**63 else x for x in parts])
        rows.append((len(a), len(a & b), *words))
    rows.append((5, 5, rows[0][2], None))
    table = spark.createDataFrame(rows, "size int, both int, a array<long>, b array<long>")
    got = table.select("size", "both", overlap_bound(F.col("size"), F.col("a"), F.col("b")).alias("most")).collect()
    assert got[-1].most is None
    assert all(r.both <= r.most <= r.size for r in got[:-1])
    assert sum(r.most - r.both for r in got[:-1]) < 0.2 * sum(r.size for r in got[:-1])


def test_rows_that_share_an_identifier_are_linked_by_their_greatest_text(docs, words):
    own = words(40)
    rows = [(1, "a " + words(30)), (1, "z " + own), (2, "z " + own), (3, "z " + own + " more"), (4, words(35))]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs(rows)).collect()}
    assert {(2, 1), (3, 1), (4, 4)} <= got


def test_bucket_of_unlinked_members_ends_after_few_rounds(spark):
    """One list of leaders a bucket, however many lead; all pairs are asked all the same."""
    rows = [(1, i, 1, True, 300) for i in range(300)]
    buckets = stored(spark.createDataFrame(rows, "bucket long, node long, size int, first boolean, weight long"))
    rounds = []

    def verify(candidates, leaders):
        pairs = candidates.select("node", F.explode("leaders").alias("leader")).select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
        ).distinct()
        rounds.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.where("a < 0")

    assert bucket_components(buckets, verify, 0.8) is None
    assert set().union(*rounds) == set(itertools.combinations(range(300), 2))
    assert len(rounds) <= 4
