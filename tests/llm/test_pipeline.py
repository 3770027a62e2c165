import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from diffloom.llm.packing import MODEL
from diffloom.llm.minhash_dedup import shingle_set, words_of
from diffloom.storage import shared_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(n))

    rows, labels = [], []
    for i in range(300):
        lines = [prose(rng.randint(5, 40)) for _ in range(3)]
        toxic = i % 6 == 0
        if toxic:
            lines[1] += " vermin filth"
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(toxic)))
    copy = rows[1][1].replace("\n", " \n ").split(" ")
    copy[3] = "edited"
    rows += [(400, " ".join(copy)), (401, rows[2][1]), (402, None), (403, ""), (404, prose(4000)), (None, prose(9))]
    whole = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    folder = shared_folder(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(whole, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, tables):
    folder, rows = tables
    assert [f for f in map(callable, (f for _, f in corpus_pipeline.STAGES))] == [True] * 4
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        results.append(docs)
    toxic_out, lines_out, near_out, packed = results
    assert all(r.columns == COLUMNS for r in results[:3])

    kept = {r.doc_id: r.text for r in toxic_out.collect()}
    assert set(kept) == {i for i, _ in rows} - {i for i in range(300) if i % 6 == 0}

    lined = {r.doc_id: r for r in lines_out.collect()}
    assert set(lined) == set(kept) and lined[402].text is None and lined[401].text == ""
    assert lined[1].text == kept[1] and len(lined[400].text) < len(kept[400]) / 2
    assert lined[1].n_chars == len(kept[1])

    left = {r.doc_id: r.text for r in near_out.collect()}
    sets = {i: shingle_set(words_of(t), 5) for i, t in left.items()}
    ids = [i for i in left if sets[i]]
    assert all(
        len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for n, i in enumerate(ids) for j in ids[:n]
    )
    assert {402, 403, None} <= set(left)

    exact = Tokenizer.from_file(MODEL)
    total = sum(len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for t in left.values())
    pieces = packed.toPandas()
    assert pieces.length.sum() == total
    sequences = pieces.groupby("sequence_id").length.sum()
    assert sequences.max() <= 2048 and len(sequences) == -(-total // 2048)
    assert np.isfinite(pieces.ids_crc32).all()


def test_run_gives_the_last_stage(spark, tables):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 250


def test_near_copies_go_when_lines_stay(spark):
    """The third stage on its own input: copies whose lines differ everywhere."""
    rng = random.Random(1)
    base = ["".join(rng.choices("aeioulnrst", k=6)) for _ in range(300)]
    rows = [(i, " ".join(base[:150] + [f"x{i}"] + base[150:])) for i in range(5, 0, -1)] + [(9, "other text")]
    whole = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs = spark.createDataFrame(whole, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 9}
