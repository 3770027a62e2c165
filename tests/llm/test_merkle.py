import hashlib

import pytest
from pyspark.sql import functions as F

from diffloom.llm.merkle import folded, manifest, merkle_paths, proof_text, record_leaf
from diffloom.storage import stored


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(leaves, fanout):
    """Root and, for each leaf, its siblings as (before, after) by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // fanout * fanout
            run = nodes[first : first + fanout]
            paths[i].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [place // fanout for place in at]
    return nodes[0], paths


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize(
    ("fanout", "depth", "sizes"),
    [(2, 1, (1, 2, 3, 23)), (3, 1, (28, 10, 9)), (3, 2, (91, 1)), (8, 1, (8, 65)), (8, 3, (9, 70)), (2, 3, (17, 50))],
)
def test_trees_of_any_size_equal_brute_force(spark, fanout, depth, sizes):
    rows = [(f"g{g}", i, h(f"{g}/{i}")) for g, n in enumerate(sizes) for i in range(n)]
    table = stored(spark.createDataFrame(rows, "group string, at long, leaf string").repartition(4))
    got = merkle_paths(table, "at", fanout, depth).collect()
    assert len(got) == len(rows)
    for g, n in enumerate(sizes):
        own = sorted((r for r in got if r.group == f"g{g}"), key=lambda r: r["at"])
        root, paths = brute([h(f"{g}/{i}") for i in range(n)], fanout)
        assert [r.position for r in own] == list(range(n))
        assert {r.subroot for r in own} == {root}
        assert [[tuple(step) for step in r.path] for r in own] == paths


ROWS = [(i, f"Text {i}", ["en", "de", None, "É", "e", ""][i % 6]) for i in range(150)] + [
    (None, "no id", "en"), (None, None, "en"), (4, "", "x"), (4, None, "x"), (5, "again", "y"), (5, "again", "y"), (6, "Z" * 400_000, "z"),
]


def make(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for clash in ("path", "root", "group", "id", "position", "number", "leaf", "_of"):
        docs = docs.withColumn(clash, F.lit("clash"))
    return docs


def test_manifest_with_nulls_ties_and_repeated_rows(spark):
    found = manifest(make(spark, ROWS), ["doc_id", "lang", "text"], "lang", "doc_id", depth=1)
    got = found.withColumn("proof", proof_text(F.col("path"))).withColumn("folded", folded(F.col("leaf"), F.col("path")))
    groups = {}
    for i, text, lang in ROWS:
        groups.setdefault(lang, []).append((-1 if i is None else i, leaf(i, lang, text)))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: brute([x for _, x in sorted(groups[lang])], 8) for lang in order}
    root, tops = brute([trees[lang][0] for lang in order], 8)
    expected = []
    for lang, top in zip(order, tops):
        for (i, own), path in zip(sorted(groups[lang]), trees[lang][1]):
            expected.append((i, lang or "?", own, trees[lang][0], root, "".join(a + b for a, b in path + top), root))
    assert sorted(
        (-1 if r.doc_id is None else r.doc_id, r.group or "?", r.leaf, r.subroot, r.root, r.proof, r.folded)
        for r in got.collect()
    ) == sorted(expected)


def test_a_changed_record_does_not_lead_to_the_root(spark):
    docs = make(spark, ROWS[:60])
    changed = F.when(F.col("doc_id") == 7, record_leaf(F.col("doc_id"), F.lit("else")))
    found = manifest(docs, ["doc_id", "text"], "lang", "doc_id", changed=changed)
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    assert [r.doc_id for r in found.where(root != F.col("root")).collect()] == [7]


def test_null_is_not_the_empty_text_and_lengths_part_values(spark):
    row = spark.createDataFrame([("", None, "1:a", "é")], "a string, b string, c string, d string")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = row.select(record_leaf(a, b), record_leaf(b, a), record_leaf(c), record_leaf(d, F.lit(12))).first()
    assert list(got) == [h("0:-"), h("-0:"), h("3:1:a"), h("2:é2:12")]


def test_empty_table_one_record_and_bad_options(spark):
    assert manifest(make(spark, []), ["doc_id"], "lang", "doc_id").collect() == []
    only = manifest(make(spark, [(3, "x", None)]), ["doc_id"], "lang", "doc_id").collect()[0]
    assert only.leaf == only.subroot == only.root == h("1:3") and only.path == []
    with pytest.raises(ValueError):
        merkle_paths(make(spark, []), "id", fanout=1)
