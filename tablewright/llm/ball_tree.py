"""Exact search for the largest inner products with a ball tree per shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import c
from tablewright.llm.vectors import matrices, usable
from tablewright.workspace import written

TOP = 5
EVERY = 50
SCALE = 256
#: Vectors in a shard, about; a task holds one shard at a time.
SHARD_ROWS = 8192
LEAF_ROWS = 128
#: Groups of vectors that lie together, at most, and those a query searches first.
GROUPS = 256
FIRST_GROUPS = 4
#: Vectors that the groups' centres are the means of, and rounds in which these settle.
SAMPLE_ROWS = 8192
SETTLING = 5
#: Queries that go down a tree together.
BLOCK = 256

_NONE = np.iinfo(np.int64).min


@dataclass
class _Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    below: tuple[_Node, ...] = ()


class BallTree:
    """Vectors of integers in nested balls.

    A ball with centre m and radius r holds no vector whose inner product with q is over
    q.m + |q| r.  Products are taken in doubles while these are exact, and otherwise with Python's
    integers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.real = vectors.astype(float)
        self.most = float(np.sqrt((self.real**2).sum(1)).max(initial=0))
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> _Node:
        own = self.real[rows]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        radius = float(away.max(initial=0)) * (1 + 1e-9)
        if len(rows) <= LEAF_ROWS or radius == 0:
            return _Node(centre, radius, rows)
        # Split between the vector farthest from the centre and the one farthest from that.
        first = own[away.argmax()]
        second = own[((own - first) ** 2).sum(1).argmax()]
        side = (own - (first + second) / 2) @ (second - first)
        cut = side > np.median(side)
        if cut.all() or not cut.any():
            cut = np.arange(len(rows)) % 2 == 0
        return _Node(centre, radius, None, (self._build(rows[~cut]), self._build(rows[cut])))

    def products(self, own: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Products of queries with some rows; those with a query's own id count as none."""
        real = queries.astype(float)
        if self.most * float(np.sqrt((real**2).sum(1)).max(initial=0)) < 2.0**52:
            out = real @ self.real[rows].T
        else:
            out = queries.astype(object) @ self.vectors[rows].astype(object).T
        out[self.ids[rows][None, :] == own[:, None]] = 0
        out = out.astype(np.int64)
        out[self.ids[rows][None, :] == own[:, None]] = _NONE
        return out

    def search(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, ids)`` of the best of this shard for each query, best first.

        ``own`` are the queries' ids, whose rows are passed over; ``least`` are scores that another
        shard's k-th result has already, below which nothing matters.  Nodes are visited in the
        order of their bounds, and a query goes into a node only if its bound reaches the query's
        current k-th score.
        """
        real = queries.astype(float)
        norms = np.sqrt((real**2).sum(1))
        scores = np.full((len(own), top), _NONE, np.int64)
        found = np.full((len(own), top), np.iinfo(np.int64).max, np.int64)
        floor = least.copy()

        def bounds(node: _Node) -> np.ndarray:
            exact = real @ node.centre + norms * node.radius
            return exact + 1e-6 + 1e-9 * np.abs(exact) + 1e-9 * norms * self.most

        waiting = [(bounds(self.root), self.root)] if len(self.ids) else []
        while waiting:
            bound, node = waiting.pop()
            live = np.flatnonzero(bound >= floor)
            if not len(live):
                continue
            if node.rows is None:
                below = [(bounds(n), n) for n in node.below]
                # The better of the two is popped first.
                waiting += sorted(below, key=lambda x: float(np.maximum(x[0][live], floor[live]).sum()))
                continue
            got = self.products(own[live], queries[live], node.rows)
            ids = self.ids[node.rows]
            better = np.flatnonzero(got.max(1) >= floor[live])
            live, got = live[better], got[better]
            all_scores = np.concatenate([scores[live], got], axis=1)
            all_ids = np.concatenate([found[live], np.broadcast_to(ids, got.shape)], axis=1)
            order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :top]
            scores[live] = np.take_along_axis(all_scores, order, 1)
            found[live] = np.take_along_axis(all_ids, order, 1)
            floor[live] = np.maximum(floor[live], scores[live, -1])
        return scores, found


def _searcher(top: int):
    """Rows of a shard come with its vectors first and the queries for it after them."""

    def search(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept, trees = None, [], {}
        for table in tables:
            shards = table.column(0).to_numpy()
            is_query = table.column(1).to_numpy()
            borders = np.flatnonzero((np.diff(shards) != 0) | (np.diff(is_query) != 0)) + 1
            for start, end in zip([0, *borders.tolist()], [*borders.tolist(), len(shards)], strict=True):
                if start == end:
                    continue
                part = table.slice(start, end - start)
                if shard != shards[start]:
                    shard, kept, trees = shards[start], [], {}
                if not is_query[start]:
                    kept.append((part.column(2).to_numpy(), part.column(3)))
                    continue
                if kept:
                    trees, kept = _trees(kept), []
                yield from _answers(part, trees, top)

    return search


def _trees(kept: list[tuple[np.ndarray, pa.Array]]) -> dict[int, BallTree]:
    by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for ids, column in kept:
        for rows, matrix in matrices(column):
            by_size.setdefault(matrix.shape[1], []).append((ids[rows], matrix))
    return {
        n: BallTree(np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts]))
        for n, parts in by_size.items()
    }


def _answers(part: pa.RecordBatch, trees: dict[int, BallTree], top: int) -> Iterator[pa.RecordBatch]:
    ids, least = part.column(2).to_numpy(), part.column(4).to_numpy()
    for rows, matrix in matrices(part.column(3)):
        tree = trees.get(matrix.shape[1])
        for at in range(0, len(rows) if tree else 0, BLOCK):
            own = rows[at : at + BLOCK]
            scores, found = tree.search(ids[own], matrix[at : at + BLOCK], least[own], top)
            keep = (scores > _NONE) & (scores >= least[own, None])
            query = np.broadcast_to(ids[own, None], scores.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (query, found, scores)], ["query_id", "vec_id", "score"]
            )


@dataclass(frozen=True)
class _Space:
    """Centres of groups of vectors, for each length of vector, and the group that the first of them names."""

    centres: dict[int, np.ndarray]
    first: dict[int, int]


def _space(rows: DataFrame, groups: int) -> _Space:
    """About ``groups`` centres, the means that ``SAMPLE_ROWS`` rows settle around.

    The rows are those whose ids have the least hashes.  Which centres these are decides how much of
    the table a query can pass over, and nothing else.
    """
    taken = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE_ROWS).collect() if groups > 1 else []
    by_size: dict[int, list] = {}
    for r in taken:
        by_size.setdefault(len(r.vector), []).append(r.vector)
    centres, first, number = {}, {}, 0
    for size, vectors in sorted(by_size.items()):
        held = np.array(vectors, dtype=float).reshape(len(vectors), size)
        own = held[: max(1, min(len(held), groups * len(held) // len(taken)))]
        for _ in range(SETTLING):
            nearest = _nearest(held, own)
            sums = np.zeros_like(own)
            np.add.at(sums, nearest, held)
            counts = np.bincount(nearest, minlength=len(own))[:, None]
            own = np.where(counts > 0, sums / np.maximum(counts, 1), own)
        centres[size], first[size] = own, number
        number += len(own)
    return _Space(centres, first)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * (vectors @ centres.T)).argmin(1)


def _grouper(space: _Space):
    """``(id, vector, group, away)``: the nearest centre and how far it is; a length without centres is group -1."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, away = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for rows, matrix in matrices(batch.column(1)):
                centres = space.centres.get(matrix.shape[1])
                if centres is not None:
                    real = matrix.astype(float)
                    nearest = _nearest(real, centres)
                    groups[rows] = space.first[matrix.shape[1]] + nearest
                    away[rows] = np.sqrt(((real - centres[nearest]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(groups), pa.array(away)], ["id", "vector", "group", "away"]
            )

    return group


def _router(space: _Space, radius: dict[int, float], start: int, end: int | None):
    """Each query with the groups whose balls can reach its k-th score, of its ``start`` to ``end`` best ones."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(2).to_numpy()
            for rows, matrix in matrices(batch.column(1)):
                centres = space.centres.get(matrix.shape[1])
                for at in range(0, len(rows), BLOCK):
                    own = rows[at : at + BLOCK]
                    if centres is None:  # nothing is known of them
                        lines, groups = (own, np.full(len(own), -1)) if start == 0 else (own[:0], own[:0])
                    else:
                        real = matrix[at : at + BLOCK].astype(float)
                        norms = np.sqrt((real**2).sum(1))[:, None]
                        first = space.first[matrix.shape[1]]
                        radii = np.array([radius.get(first + k, -1.0) for k in range(len(centres))])
                        exact = real @ centres.T + norms * radii
                        size = np.sqrt((centres**2).sum(1)) + np.maximum(radii, 0)
                        bound = np.where(radii < 0, -np.inf, exact + 1e-6 + 1e-9 * (np.abs(exact) + norms * size))
                        order = np.argsort(-bound, axis=1, kind="stable")[:, start:end]
                        reaches = np.take_along_axis(bound, order, 1) >= least[own][:, None]
                        lines, groups = own[np.nonzero(reaches)[0]], first + order[reaches]
                    chosen = batch.take(pa.array(lines))
                    yield pa.RecordBatch.from_arrays(
                        [*chosen.columns, pa.array(groups, pa.int32())], ["id", "vector", "least", "home", "group"]
                    )

    return route


def _asked(queries: DataFrame, space: _Space, radius: dict[int, float], layout: DataFrame, start: int, end: int | None) -> DataFrame:
    """A wave: queries, repeated for each shard of the groups they go to but their home."""
    schema = "id long, vector array<long>, least long, home int, group int"
    return (
        queries.mapInArrow(_router(space, radius, start, end), schema)
        .join(F.broadcast(layout), "group")
        .withColumn("shard", F.explode(F.expr("sequence(first, first + shards - 1)")))
        .filter("shard <> home")
        .select("shard", "id", "vector", "least")
    )


def top_products(
    vectors: DataFrame,
    *,
    every: int = EVERY,
    top: int = TOP,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``top`` largest inner products.

    Components become floor(``scale`` * x) in double precision, and a score is an exact integer.
    Queries are the rows whose id is divisible by ``every``; their candidates are all rows with
    another id and a vector of the same length; a score that is no long fails the query.  Equal scores go to the smaller id; a query with
    fewer candidates has fewer rows.  Null vectors and those that hold null or a number that is not
    finite take no part, nor do null ids.  Of rows that repeat an id and a vector one takes part;
    rows that repeat an id with other vectors each take part.  Other columns are not read, and an
    empty table gives no rows.

    Vectors are grouped around up to ``GROUPS`` centres, and a group is split into shards of about
    ``shard_rows``.  Each query first searches the shard it lies in, then the ``FIRST_GROUPS`` groups with
    the highest bounds, then all others.  Each wave takes the k-th score so far along: a query goes only to
    groups whose ball can reach it, and there into balls that can.  A task holds one shard and streams
    the queries past it.  What passes the driver is ``SAMPLE_ROWS`` vectors and a line for each group.
    """
    whole = F.transform(c(vector), lambda x: F.floor(x.cast("double") * scale))
    rows = (
        vectors.filter(usable(c(vector)) & c(vec_id).isNotNull())
        .select(c(vec_id).cast("long").alias("id"), whole.alias("vector"))
        .distinct()
    )
    rows = written(rows, "integer-vectors")
    space = _space(rows, min(GROUPS, -(-rows.count() // shard_rows)))
    grouped = written(rows.mapInArrow(_grouper(space), "id long, vector array<long>, group int, away double"), "grouped-vectors")
    balls = grouped.groupBy("group").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("group").collect()
    radius = {b.group: b.radius * (1 + 1e-9) for b in balls}
    layout, total = [], 0
    for ball in balls:
        shards = -(-ball.n // shard_rows)
        layout.append((ball.group, total, shards))
        total += shards
    layout = rows.sparkSession.createDataFrame(layout, "group int, first int, shards int")
    none = F.lit(_NONE).cast("long")
    placed = grouped.join(F.broadcast(layout), "group").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards"))).cast("int").alias("shard"), "id", "vector"
    )
    held = placed.select("shard", F.lit(0).alias("is_query"), "id", "vector", none.alias("least"))
    queries = placed.filter(F.col("id") % every == 0)

    def searched(asked: DataFrame) -> DataFrame:
        found = (
            held.unionByName(asked.select("shard", F.lit(1).alias("is_query"), "id", "vector", "least"))
            .repartitionById(max(total, 1), "shard")
            .sortWithinPartitions("shard", "is_query")
            .mapInArrow(_searcher(top), "query_id long, vec_id long, score long")
        )
        return written(found, "found")

    # Several rows of one id ask for themselves; what they find together is ranked.
    def ranked(found: DataFrame) -> DataFrame:
        return (
            found.groupBy("query_id", "vec_id")
            .agg(F.max("score").alias("score"))
            .withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
            .filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score")
        )

    found = searched(queries.withColumn("least", none))
    for start, end in ((0, FIRST_GROUPS), (FIRST_GROUPS, None)) if total > 1 else ():
        if start and len(balls) <= start:
            break
        kth = ranked(found).filter(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        going = queries.join(kth, "id", "left").select(
            "id", "vector", F.coalesce("kth", none).alias("least"), F.col("shard").alias("home")
        )
        found = found.unionByName(searched(_asked(going, space, radius, layout, start, end)))
    return ranked(found)
