import pytest

from diffloom.llm.chat_format import perspectives, rendered
from diffloom.llm.license_scan import NOTICES, license_scan

TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé\nyou"), (1, 3, "ann", None),
    (2, 5, None, "x"), (2, None, "ann", "first"), (None, 1, "cy", "no id"), (3, 1, "system", "alone"),
    (4, 1, "dd", "again"), (4, 1, "dd", "again"), (4, 1, "", "no name"),
]


def turns(spark, rows):
    full = [(*r, "clash", 1) for r in rows]
    schema = "conv_id long, turn long, role string, text string, speaker string, position int"
    return spark.createDataFrame(full, schema).repartition(3)


def test_every_participant_is_the_assistant_once(spark):
    views = perspectives(turns(spark, TURNS))
    texts = {(r.conv_id, r.speaker): r for r in rendered(views).collect()}
    assert set(texts) == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "ann"), (None, "cy"), (4, "dd"), (4, "")}
    bob = texts[1, "bob"]
    assert bob.text == (
        "<|system|>\nBe brief.<|end|>\n<|user name=ann|>\nHi<|end|>\n<|assistant|>\nHé\nyou<|end|>\n"
        "<|user name=ann|>\n<|end|>\n"
    )
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["Hé\nyou<|end|>\n"]
    assert [texts[1, "ann"].text[m.start : m.end] for m in texts[1, "ann"].masks] == [
        "Hi<|end|>\n", "<|end|>\n"
    ]
    assert texts[2, "ann"].text.startswith("<|assistant|>\nfirst")
    assert len(texts[4, "dd"].masks) == 2


def test_places_follow_each_other(spark):
    rows = [(1, i // 3, "ab"[i % 2], "t" * (i % 11)) for i in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = sorted(perspectives(turns(spark, rows)).collect(), key=lambda r: (r.speaker, r.position))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 1000
    for a, b in zip(got, got[1:]):
        if a.speaker == b.speaker:
            assert (b.position, b.start) == (a.position + 1, a.end)


def test_no_python_on_the_main_path(spark):
    plan = perspectives(turns(spark, TURNS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("rows", [[], TURNS[7:8]])
def test_no_views(spark, rows):
    assert perspectives(turns(spark, rows)).collect() == []


def test_license_texts_and_lines(spark, docs):
    known = spark.createDataFrame(
        NOTICES + [("Own-1", "Own License\nCopyright (c) X\n\nYou may use it; keep the licence.")],
        "license_id string, text string",
    )
    rows = [
        (1, "OWN LICENCE.\ncopyright 2020 someone\nYou may use it - keep the license!"),
        (2, "text\nReleased under the MIT licence.\nmore\r\nLicensed under CC BY-NC 4.0\n"),
        (3, None), (4, ""), (5, "!!!"), (6, "plain"), (6, "plain"), (None, "Released under the MIT License."),
    ]
    got = license_scan(docs(rows), known).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].license_id == "Own-1" and by_id[1].notices == []
    assert by_id[2].license_id is None and by_id[2].notices == ["CC-BY-NC-4.0", "MIT"]
    assert by_id[None].license_id == "MIT" and by_id[None].notices == ["MIT"]
    assert by_id[3].digest == by_id[4].digest == by_id[5].digest and by_id[3].license_id is None
    assert by_id[6].notices == []
    assert license_scan(docs([]), known).collect() == []


def test_rows_that_share_an_identifier_have_their_own_notices(spark, docs):
    known = spark.createDataFrame(NOTICES, "license_id string, text string")
    rows = [(1, "x\nLicensed under the MIT License."), (1, "no notice"), (None, "SPDX-License-Identifier: MPL-2.0\ny"), (None, "z")]
    got = sorted((r.doc_id or 0, r.notices) for r in license_scan(docs(rows), known).collect())
    assert got == [(0, []), (0, ["MPL-2.0"]), (1, []), (1, ["MIT"])]
