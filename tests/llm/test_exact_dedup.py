import hashlib

from diffloom.llm.exact_dedup import exact_duplicates


def result(spark, path):
    return [tuple(r) for r in exact_duplicates(spark, path).collect()]


def test_largest_id_stays_and_every_row_is_returned(spark, table_path):
    rows = [(1, "Aa É"), (7, "aA É"), (3, "aa é"), (4, None), (5, ""), (None, "solo"), (None, "AA É")]
    got = result(spark, table_path(rows))
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert by_id[1][1:4] == (7, 3, False) and by_id[7][1:4] == (7, 3, True)
    # Only A-Z are lower-cased, so e-acute stays apart from its capital.
    assert by_id[3][1:4] == (3, 1, True)
    assert by_id[4][1:4] == (5, 2, False) and by_id[5][1:4] == (5, 2, True)
    assert by_id[1][4] == hashlib.sha256("aa É".encode()).hexdigest()
    nulls = sorted((r[1] or -1, r[2], r[3]) for r in got if r[0] is None)
    assert nulls == [(-1, 1, True), (7, 3, False)]


def test_repeated_rows_and_long_texts(spark, table_path):
    long = "ab " * 200_000
    got = result(spark, table_path([(1, long), (1, long), (2, long.upper()), (9, "x")]))
    assert sorted(r[:4] for r in got) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (9, 9, 1, True)]


def test_several_batches_give_the_same_state(spark, table_path):
    path = table_path([(i, f"text {i % 7}") for i in range(40)])
    small = exact_duplicates(spark, path, bytes_per_batch=1)
    assert sorted(small.collect()) == sorted(exact_duplicates(spark, path).collect())


def test_empty_table(spark, table_path):
    assert result(spark, table_path([])) == []
