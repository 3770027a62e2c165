"""Near-duplicate vectors by an exact metric range join on the unit sphere.

Cosine >= s means a distance of unit vectors of at most ``r = sqrt(2 - 2 s)``.  Pivots
partition the vectors: a vector is native to the cell of its nearest pivot.  A native of
cell q has all its partners in cell q when x is also sent there as a member unless

- ``d(x, q) > radius(q) + r`` (triangle inequality with the cell's covering radius), or
- ``d(x, q)^2 - d(x, p)^2 > 2 r d(p, q)`` for its own pivot p (x is further than r from
  the half space that is nearer to q than to p).

Cells are joined independently: members stream past the natives, so a task holds at most
``block_rows`` natives.  Cells with more natives are split into blocks that each see all
members.  Every vector counts its links in the one block where it is native.  Of the
links of a block only a spanning forest leaves the task.  Equal vectors are one row of
the join with a weight.

The pruning depends on the data.  Vectors in clusters go to few cells; for directions
without structure in many dimensions no metric partition can prune, and members reach
most cells.  The number of pivots is sqrt(n) / 16 unless given, so what the driver sees
of the data stays small.

Defined results: null vectors, empty ones, zero vectors and vectors with null or
non-finite components link with nothing; so do vectors of different length; a row with a
null identifier links with nothing (component null, kept); repeated rows count as vectors
of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.graph import components
from diffloom.storage import stored

SLACK = 1e-9
#: Members per product, which bounds the matrix of similarities.
STRIDE = 1024


def comparable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of unit vectors) for each vector length of a list column."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    found = []
    for width in np.unique(lengths):
        rows = np.flatnonzero(lengths == width)
        part = values[starts[rows][:, None] + np.arange(width)]
        part = part / np.abs(part).max(axis=1, keepdims=True)
        found.append((rows, part / np.linalg.norm(part, axis=1, keepdims=True)))
    return found


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


class Cells:
    """Pivots by vector length; cell numbers are places in the list of all pivots."""

    def __init__(self, pivots: list[list[float]]) -> None:
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for rows, matrix in unit(pa.array(pivots, pa.list_(pa.float64()))):
            self.by_width[matrix.shape[1]] = (rows, matrix)

    def nearest(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its pivot, distances to all pivots of this length."""
        width = matrix.shape[1]
        if width not in self.by_width:  # vectors of a length without pivots are a cell
            zeros = np.zeros(len(matrix))
            return np.full(len(matrix), -width), zeros, zeros[:, None]
        numbers, pivots = self.by_width[width]
        away = distance(matrix @ pivots.T)
        best = away.argmin(axis=1)
        return numbers[best], away[np.arange(len(best)), best], away


def _assigned(classes: DataFrame, cells: Cells) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for rows, matrix in unit(batch.column("vector")):
                cell[rows], near[rows], _ = cells.nearest(matrix)
            yield pa.record_batch(
                [*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"]
            )

    return classes.mapInArrow(
        assign, "node long, weight long, vector array<double>, cell long, near double"
    )


def _dealt(assigned: DataFrame, cells: Cells, stats: dict[int, tuple[int, float]], reach: float):
    """Rows by (cell, block): natives (side 0) and members (side 1)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cell").to_numpy()
            picks, into, blocks, sides = [], [], [], []

            def send(rows, cell, block, side):
                picks.append(rows)
                into.append(np.full(len(rows), cell))
                blocks.append(np.broadcast_to(block, len(rows)))
                sides.append(np.full(len(rows), side, np.int32))

            nodes = batch.column("node").to_numpy()
            spread = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for cell in np.unique(own):
                rows = np.flatnonzero(own == cell)
                send(rows, cell, (spread[rows] % np.uint64(stats[int(cell)][0])).astype(np.int64), 0)
            for rows, matrix in unit(batch.column("vector")):
                width = matrix.shape[1]
                if width not in cells.by_width:
                    for block in range(stats[-width][0]):
                        send(rows, -width, block, 1)
                    continue
                numbers, pivots = cells.by_width[width]
                mine, near, away = cells.nearest(matrix)
                at = np.searchsorted(numbers, mine)
                apart = distance(pivots @ pivots.T)
                for q, cell in enumerate(numbers):
                    if int(cell) not in stats:
                        continue
                    count, radius = stats[int(cell)]
                    into_q = (away[:, q] <= radius + reach + SLACK) & (
                        away[:, q] ** 2 - near**2 <= 2 * reach * apart[at, q] + SLACK
                    )
                    chosen = rows[into_q | (mine == cell)]
                    for block in range(count):
                        send(chosen, cell, block, 1)
            order, into, blocks, sides = map(np.concatenate, (picks, into, blocks, sides))
            taken = batch.select(["node", "weight", "vector"])
            for start in range(0, len(order), 8192):
                cut = slice(start, start + 8192)
                part = taken.take(pa.array(order[cut]))
                yield pa.record_batch(
                    [
                        pa.array(into[cut], pa.int64()),
                        pa.array(blocks[cut], pa.int64()),
                        pa.array(sides[cut], pa.int32()),
                        *part.columns,
                    ],
                    ["cell", "block", "side", "node", "weight", "vector"],
                )

    return assigned.mapInArrow(
        deal, "cell long, block long, side int, node long, weight long, vector array<double>"
    )


class _Block:
    """Natives of a block and what members have added to them."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.nodes = np.zeros(0, np.int64)
        self.matrix = np.zeros((0, 0))
        self.links = np.zeros(0, np.int64)
        self.label = np.zeros(0, np.int64)

    def add_natives(self, nodes: np.ndarray, matrix: np.ndarray) -> None:
        first = len(self.nodes)
        self.nodes = np.concatenate([self.nodes, nodes])
        self.matrix = matrix if first == 0 else np.concatenate([self.matrix, matrix])
        self.links = np.concatenate([self.links, np.zeros(len(nodes), np.int64)])
        self.label = np.concatenate([self.label, np.arange(first, first + len(nodes))])

    def add_members(self, nodes, weights, matrix) -> tuple[np.ndarray, np.ndarray]:
        """Links of members, one per linked member: (member, native)."""
        row, native = np.nonzero(matrix @ self.matrix.T >= self.similarity)
        other = nodes[row] != self.nodes[native]
        row, native = row[other], native[other]
        if not len(row):
            return row, native
        np.add.at(self.links, native, weights[row])
        same = np.flatnonzero(row[1:] == row[:-1])
        a, b = self.label[native[same]], self.label[native[same + 1]]
        merges = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        if len(merges):
            self._merge(merges.tolist())
        heads = np.concatenate([[True], row[1:] != row[:-1]])
        return nodes[row[heads]], self.nodes[native[heads]]

    def _merge(self, pairs: list[list[int]]) -> None:
        root = np.arange(len(self.label))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        heads = np.array([find(x) for x in range(len(root))])
        self.label = heads[self.label]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if len(self.nodes):
            yield _out(np.zeros(len(self.nodes), np.int32), self.nodes, self.links)
            inner = np.flatnonzero(self.label != np.arange(len(self.label)))
            yield _out(np.ones(len(inner), np.int32), self.nodes[inner], self.nodes[self.label[inner]])


def _out(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def _joined(dealt: DataFrame, similarity: float) -> DataFrame:
    """kind 0: (native, its links); kind 1: a forest of links (a, b)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block(similarity)
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(batch)]):
                cell, number, side = keys[begin]
                if (cell, number) != key:
                    yield from block.rows()
                    key, block = (cell, number), _Block(similarity)
                for start in range(begin, end, STRIDE):
                    part = batch.slice(start, min(STRIDE, end - start))
                    nodes = part.column("node").to_numpy()
                    matrix = unit(part.column("vector"))[0][1]
                    if side == 0:
                        block.add_natives(nodes, matrix)
                    else:
                        a, b = block.add_members(nodes, part.column("weight").to_numpy(), matrix)
                        if len(a):
                            yield _out(np.ones(len(a), np.int32), a, b)
        yield from block.rows()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(n, "cell", "block").sortWithinPartitions("cell", "block", "side")
    return ordered.mapInArrow(join, "kind int, a long, b long")


def near_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    similarity: float = 0.95, pivots: int | None = None, block_rows: int = 4096,
) -> DataFrame:
    """One row per row: id, n_links, component_id (smallest id reachable), kept."""
    own = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    usable = comparable(F.col("vector")) & F.col("id").isNotNull()
    classes = stored(
        own.where(usable).groupBy("vector").agg(
            F.min("id").alias("node"), F.count("*").alias("weight")
        ).select("node", "weight", "vector")
    )
    n = classes.count()
    wanted = pivots or max(1, math.ceil(math.sqrt(n) / 16))
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("vector").collect()
    cells = Cells([row.vector for row in chosen])
    assigned = stored(_assigned(classes, cells))
    stats = {
        row.cell: (math.ceil(row.n / block_rows), row.radius)
        for row in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("near").alias("radius")).collect()
    }
    reach = math.sqrt(2.0 - 2.0 * similarity)
    found = stored(_joined(_dealt(assigned, cells, stats, reach), similarity))
    labels = components(found.where("kind = 1").select("a", "b"))
    counts = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("links"))
    of_class = stored(
        classes.join(counts, "node").join(labels, "node", "left").select(
            "vector",
            (F.col("links") + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    key = F.when(usable, F.col("vector"))
    component = F.coalesce("component_id", "id")
    return own.withColumn("vector", key).join(of_class, "vector", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
