import numpy as np
import pytest

from diffloom.llm.vector_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, None, "c") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, similarity):
    good = {}
    for place, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[place] = x / np.linalg.norm(x)
    links = {p: set() for p in range(len(rows))}
    for p, x in good.items():
        for q, y in good.items():
            if p != q and len(x) == len(y) and x @ y >= similarity:
                links[p].add(q)
    out = []
    for p, (i, _) in enumerate(rows):
        seen, todo = {p}, [p]
        while todo:
            for q in links[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        component = i if i is None else min(rows[q][0] for q in seen)
        out.append((i, len(links[p]), component, component == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("pivots, block_rows", [(None, 4096), (7, 5), (1, 16)])
def test_equals_brute_force(spark, pivots, block_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(150):
        v = centres[i % 6] + rng.normal(size=8) * (0.25 if i % 2 else 0.9)
        rows.append((i, [float(x) for x in v]))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, [2 * x for x in rows[3][1]]), (3, rows[3][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None, 1.0])]
    rows += [(305, [float("inf")] * 8), (306, [1.0, 0.0]), (307, [1.0, 0.01]), (None, rows[3][1])]
    found = near_vectors(table(spark, rows), similarity=0.95, pivots=pivots, block_rows=block_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 0.95)


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.05]) for i in range(1500)]
    got = near_vectors(table(spark, rows), block_rows=200).collect()
    assert {r.component_id for r in got} == {0}
    assert min(r.n_links for r in got) > 1000


def test_empty_table(spark):
    assert near_vectors(table(spark, [])).collect() == []
