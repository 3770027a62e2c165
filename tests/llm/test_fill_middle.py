import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from diffloom.llm.fill_middle import LINE, Cutter, Markers, fill_in_middle, restored


def brute(i, text):
    """n, form, lengths and output without the regex library."""
    text = text or ""
    units = text.split("\n")
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [
    *[(i, "\n".join(f"line {k} é😀" for k in range(i % 9))) for i in range(80)],
    *[(i, "a\r\n\n\n b c\n" * (i % 4)) for i in range(80, 120)],
    (None, "x\ny"), (None, None), (1, None), (2, ""), (3, "\n"), (4, "no end"), (5, "has <S> in\nit"), (6, "<P"),
    (7, "<\n<\nP>\nS>\nM>\n<"), (8, "twice\n"), (8, "twice\n"),
]


def test_equals_brute_force_and_is_restored(docs):
    made = fill_in_middle(docs(ROWS)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.collect()]
    expected = [(i, *brute(i, text), text or "") for i, text in ROWS]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_very_long_texts(docs):
    rows = [(1, "x" * 3_000_000), (2, "ab\n" * 400_000), (3, "\n" * 300_000)]
    made = fill_in_middle(docs(rows)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = {r.doc_id: r for r in made.collect()}
    for i, text in rows:
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == brute(i, text)
        assert got[i].back == text
    assert [got[i].n for i in (1, 2, 3)] == [1, 400_000, 300_000]


def test_rates_units_and_markers(docs):
    rows = [(i, "one two  three four") for i in range(400)]
    options = {"unit": r"\s*\S+", "rate": 40, "spm_rate": 0, "markers": Markers("[p]", "[s]", "[m]")}
    made = fill_in_middle(docs(rows), **options)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"), options["markers"])).collect()
    assert {r.n for r in got} == {4} and all(r.back == "one two  three four" for r in got)
    assert {r.form for r in got} == {"plain", "psm"}
    assert 110 < sum(r.form == "psm" for r in got) < 210
    # A space at the end is in no unit, so nothing is cut.
    left = fill_in_middle(docs([(1, "one two ")]), unit=r"\s*\S+").collect()[0]
    assert (left.n, left.form, left.output) == (0, "plain", "one two ")


def test_empty_table(docs):
    assert fill_in_middle(docs([])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.text(alphabet="ab\n<>PSM\r é", max_size=60))
def test_single_texts(i, text):
    assert Cutter(LINE, 7, 100, 50, Markers()).cut(i, text) == brute(i, text)
