"""Near-duplicate vectors by hashing to E8 lattice cells.

Each table projects a vector to some times eight random directions and takes the nearest points of
the E8 lattice; a vector is looked up in its own cell and in the neighbouring cells closest to it.
How fine the cells are and how many tables there are follows the table.  To do no
work that grows with the square of a dense group, vectors are first gathered in clumps around a
centre, so narrow that any two of a clump must be linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.lattice import SIZE, nearest, neighbours
from tablewright.llm.shared import c
from tablewright.llm.vectors import cosine, matrices, usable
from tablewright.workspace import written

COSINE = 0.93
#: Shapes of cells to choose from: lattices combined in a table, cells a unit vector spans in each of
#: them (more is more selective), and neighbouring cells looked up.
SHAPES = (
    (1, 2.5, 4), (1, 3.0, 4), (2, 1.5, 8), (2, 1.75, 8), (2, 2.0, 12), (3, 1.25, 8), (3, 1.5, 12), (3, 1.75, 16),
    (4, 1.25, 16), (4, 1.5, 16),
)
#: The chance to miss a pair just at the threshold; closer ones are missed less.
MISSED = 2e-4
#: Vectors that the shape is chosen by; all rows are hashed and compared whatever it is.
SAMPLE_ROWS = 1024
#: Rounds in which clumps are gathered, each with the cells of another table.
CLUMP_ROUNDS = 4
#: What angles may be off by through rounding.
_SLACK = 1e-6

#: What comparing a pair costs, in keys.
_PAIR_COST = 4
#: Pairs drawn to tell how often a shape of cells finds a pair.
_PAIRS_DRAWN = 4000
#: Vectors hashed together.
_BATCH = 2048
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Cells:
    """How vectors are hashed: each table combines the cells of ``lattices`` E8 lattices, which a unit
    vector spans ``span`` cells of; ``probes`` neighbouring cells are looked up beside the own one."""

    lattices: int
    span: float
    probes: int
    tables: int


def _directions(size: int, cells: Cells) -> np.ndarray:
    """Random directions of all tables for vectors of a length, the same everywhere."""
    drawn = np.random.default_rng(size).normal(size=(size, cells.tables * cells.lattices * SIZE))
    return drawn * (cells.span / math.sqrt(SIZE))


def _mixed(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    keys = (keys ^ part) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def _cell_keys(y: np.ndarray, labels: np.ndarray, table: int, cells: Cells) -> np.ndarray:
    """64-bit keys of projections, one row each: the own cell first and then the nearest others.

    A cell is one point of each lattice, told apart by table and label.  The other cells are those
    that change some of the points to close neighbours and add least to the squared distance.
    """
    hashes, costs = [], []
    near = max(2, cells.probes // cells.lattices)
    for k in range(cells.lattices):
        z = y[:, k * SIZE : (k + 1) * SIZE]
        own = nearest(z)
        points = np.concatenate([own[:, None], neighbours(z, own, near)], axis=1)
        away = ((z[:, None] - points) ** 2).sum(2)
        costs.append(away - away[:, :1])
        seed = ((table * cells.lattices + k + 1) * _GOLDEN) & (1 << 64) - 1
        hashed = np.full(points.shape[:2], seed, np.uint64)
        # Doubled, the numbers of lattice points are integers.
        for j in range(SIZE):
            hashed = _mixed(hashed, np.rint(2 * points[..., j]).astype(np.int64).view(np.uint64))
        hashes.append(hashed)
    choices = np.array(list(product(range(near + 1), repeat=cells.lattices)))
    cost = sum(costs[k][:, choices[:, k]] for k in range(cells.lattices))
    cost[:, 0] = np.inf
    best = np.argpartition(cost, cells.probes - 1, axis=1)[:, : cells.probes]
    best = np.concatenate([np.zeros((len(y), 1), np.int64), best], axis=1)
    out = np.broadcast_to(labels.astype(np.int64).view(np.uint64)[:, None], best.shape)
    for k in range(cells.lattices):
        out = _mixed(out, np.take_along_axis(hashes[k], choices[:, k][best], 1))
    return out.view(np.int64)


@lru_cache(maxsize=64)
def _tables_for(lattices: int, span: float, probes: int, threshold: float) -> int:
    """Tables after which a pair of unit vectors just at the threshold is missed with probability ``MISSED``.

    Random directions see such a pair as two Gaussian points of a known correlation, whatever the
    vectors are, so how often a table finds it is drawn once for a shape.
    """
    rng = np.random.default_rng(41)
    x, z = rng.normal(size=(2, _PAIRS_DRAWN, lattices * SIZE)) * (span / math.sqrt(SIZE))
    shape = Cells(lattices, span, probes, 1)
    labels = np.zeros(_PAIRS_DRAWN, np.int64)
    a = _cell_keys(x, labels, 0, shape)
    b = _cell_keys(threshold * x + math.sqrt(1 - threshold**2) * z, labels, 0, shape)
    met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    found = min(max(float(met.mean()), 1e-3), 0.999)
    return max(CLUMP_ROUNDS, math.ceil(math.log(MISSED) / math.log(1 - found)))


def fitted_cells(sample: np.ndarray, labels: np.ndarray, rows: int, threshold: float) -> Cells:
    """The shape of cells that costs a table of ``rows`` vectors least, of those in ``SHAPES``.

    Every shape has as many tables as keep the chance to miss a pair at the threshold the same.  What
    they cost is the keys of all rows plus the pairs that meet without being linked, whose share is
    counted in the sample; these grow with the square of the rows, so larger tables get finer cells.
    """
    unit = sample / np.sqrt((sample**2).sum(1))[:, None]
    linked = unit @ unit.T >= threshold
    best = None
    for lattices, span, probes in SHAPES:
        tables = _tables_for(lattices, span, probes, threshold)
        tried = Cells(lattices, span, probes, min(tables, 4))
        projected = unit @ _directions(unit.shape[1], tried)
        width = lattices * SIZE
        # One meeting more than seen: none in a sample does not mean none.
        met = 1 / tried.tables
        for t in range(tried.tables):
            keys = _cell_keys(projected[:, t * width : (t + 1) * width], labels, t, tried)
            for k in range(probes + 1):
                met += float(((keys[:, k][:, None] == keys[:, 0][None]) & ~linked).sum()) / tried.tables
        share = met / max(len(unit) * (len(unit) - 1), 1)
        cost = tables * (rows * (probes + 1) + _PAIR_COST * share * float(rows) ** 2)
        if best is None or cost < best[0]:
            best = (cost, Cells(lattices, span, probes, tables))
    return best[1]


def _celler(cells: Cells):
    tables, probes, width = cells.tables, cells.probes, cells.lattices * SIZE

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, _BATCH) for at in range(0, len(whole), _BATCH)):
                ids, labels = batch.column(0), batch.column(1).to_numpy()
                for rows, matrix in matrices(batch.column(2)):
                    unit = matrix.astype(float)
                    unit /= np.sqrt((unit**2).sum(1))[:, None]
                    projected = unit @ _directions(matrix.shape[1], cells)
                    keys = np.empty((len(rows), tables, probes + 1), np.int64)
                    for t in range(tables):
                        keys[:, t] = _cell_keys(projected[:, t * width : (t + 1) * width], labels[rows], t, cells)
                    home, near = np.ascontiguousarray(keys[..., 0]), np.ascontiguousarray(keys[..., 1:])
                    ends = np.arange(len(rows) + 1, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(rows)),
                            pa.ListArray.from_arrays(pa.array(ends * tables), pa.array(home.reshape(-1))),
                            pa.ListArray.from_arrays(pa.array(ends * (tables * probes)), pa.array(near.reshape(-1))),
                        ],
                        ["id", "home", "near"],
                    )

    return keyed


def _fit(used: DataFrame, rows: int, threshold: float) -> Cells:
    """Cells for a table, from ``SAMPLE_ROWS`` of its vectors, those whose ids have the least hashes."""
    taken = used.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
    by_size: dict[int, list] = {}
    for r in taken:
        by_size.setdefault(len(r.vector), []).append(r)
    most = max(by_size.values(), key=len, default=[])
    sample = np.array([r.vector for r in most], dtype=float).reshape(len(most), len(most[0].vector) if most else 1)
    return fitted_cells(sample, np.array([r.label for r in most], dtype=np.int64), rows, threshold)


def near_vectors(
    vectors: DataFrame,
    *,
    threshold: float = COSINE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cells: Cells | None = None,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per id.

    Two vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is at least ``threshold`` (over 0).  ``n_links`` counts a vector's links,
    ``component_id`` is the smallest id that links lead to, and ``kept`` marks that one.

    Vectors that are null, zero or of length zero, that hold null or a number that is not finite,
    or whose label is null link with nothing; vectors of different lengths do not either.  Of rows
    with the same id the one with the smallest label and vector counts.  Rows with a null id link
    with nothing, and are returned each for itself, with no component.  Other columns are not read;
    an empty table gives no rows.

    A clump holds vectors within half the threshold's angle of its centre, so all of them are
    linked with each other by the triangle inequality.  Clumps that share a cell are compared: each
    vector of the larger one with the centre of the other, which by the same inequality settles
    most of them at once, and one by one where it does not.  No list of all pairs of a group is
    made; only links between clumps that the inequality cannot settle are looked at singly.

    ``cells`` is fitted to the table where it is not given (see ``fitted_cells``).
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    reach = math.acos(threshold)
    rows = vectors.select(
        c(vec_id).cast("long").alias("id"), c(label).cast("long").alias("label"), c(vector).cast("array<double>").alias("vector")
    )
    one = (
        rows.filter("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("id", "row.label", "row.vector")
    )
    one = written(one, "vectors")
    sound = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    used = one.filter(sound).select("id", "label", _scaled("vector"))
    shape = cells or _fit(used, used.count(), threshold)
    cells = written(used.mapInArrow(_celler(shape), "id long, home array<long>, near array<long>"), "cells")
    place = used.select("id", "label", "vector")

    members = _clumps(used.select("id", F.col("id").alias("centre")), cells, place, reach / 2 - _SLACK)
    measured = members.join(place.select("id", F.col("vector").alias("v")), "id").join(
        place.select(F.col("id").alias("centre"), F.col("vector").alias("w")), "centre"
    )
    angle = F.when(F.col("id") == F.col("centre"), 0.0).otherwise(F.acos(F.least(cosine("v", "w"), F.lit(1.0))))
    clumps = written(
        measured.select("centre", angle.alias("angle"))
        .groupBy("centre")
        .agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius")),
        "clumps",
    )

    # A clump appears once in each cell that any of its vectors lies in, or looks into.
    inside = cells.join(members, "id")
    home = inside.select("centre", F.explode("home").alias("key")).distinct()
    near = inside.select("centre", F.explode(F.concat("home", "near")).alias("key")).distinct()
    pairs = (
        home.join(near.withColumnRenamed("centre", "other"), "key")
        .filter("centre <> other")
        .select(F.least("centre", "other").alias("a"), F.greatest("centre", "other").alias("b"))
        .distinct()
    )
    sizes = clumps.select(F.col("centre").alias("a"), F.col("size").alias("size_a"))
    pairs = (
        pairs.join(sizes, "a")
        .join(clumps.withColumnsRenamed({"centre": "b", "size": "size_b"}).select("b", "size_b"), "b")
        .select(
            F.expr("if(size_a >= size_b, a, b)").alias("a"),
            F.expr("if(size_a >= size_b, b, a)").alias("b"),
        )
    )
    # Each vector of the larger clump against the centre of the smaller.
    against = (
        pairs.join(members.select(F.col("centre").alias("a"), "id"), "a")
        .join(place.select("id", "label", F.col("vector").alias("v")), "id")
        .join(place.select(F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("vector").alias("w")), "b")
        .filter("label = label_b")
        .select("a", "b", "id", cosine("v", "w").alias("cosine"))
        .filter("cosine IS NOT NULL")
        .join(clumps.select(F.col("centre").alias("b"), "size", "radius"), "b")
        .withColumn("angle", F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))))
        .withColumn(
            "verdict",
            F.when((F.col("radius") == 0) & (F.col("size") == 1), F.when(F.col("cosine") >= threshold, "all").otherwise("none"))
            .when(F.col("angle") + F.col("radius") + _SLACK <= reach, "all")
            .when(F.col("angle") - F.col("radius") - _SLACK > reach, "none")
            .otherwise("some"),
        )
        .filter("verdict <> 'none'")
        .select("a", "b", "id", "size", "verdict")
    )
    against = written(against, "against")
    whole = against.filter("verdict = 'all'")
    single = (
        against.filter("verdict = 'some'")
        .join(members.select(F.col("centre").alias("b"), F.col("id").alias("other")), "b")
        .join(place.select("id", F.col("vector").alias("v")), "id")
        .join(place.select(F.col("id").alias("other"), F.col("vector").alias("w")), "other")
        .select("a", "b", "id", "other", cosine("v", "w").alias("cosine"))
        .filter(F.col("cosine") >= threshold)
        .select("a", "b", "id", "other")
    )
    single = written(single, "single-links")
    counts = (
        members.join(clumps, "centre")
        .select("id", (F.col("size") - 1).alias("n"))
        .unionByName(whole.select("id", F.col("size").alias("n")))
        .unionByName(
            whole.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(members.withColumnRenamed("centre", "b"), "b").select("id", "n")
        )
        .unionByName(single.select("id", F.lit(1).cast("long").alias("n")))
        .unionByName(single.select(F.col("other").alias("id"), F.lit(1).cast("long").alias("n")))
        .groupBy("id")
        .agg(F.sum("n").alias("n_links"))
    )
    roots = components(against.filter("verdict = 'all'").select("a", "b").unionByName(single.select("a", "b")))
    # The least id of a component is found among clumps; what is joined by component are clumps too.
    firsts = members.groupBy("centre").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    grouped = written(
        firsts.join(roots.withColumnRenamed("id", "centre"), "centre", "left").select(
            "centre", "least", "rows", F.coalesce("root", "centre").alias("group")
        ),
        "groups",
    )
    of_group = grouped.groupBy("group").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_centre = written(
        _looked_up(grouped.select("centre", "rows", "group"), of_group, "group").select(
            "centre", "component_id", F.col("rows").alias("n")
        ),
        "components",
    )
    found = _looked_up(members, of_centre, "centre").select("id", "component_id").join(counts, "id")
    component = F.coalesce("component_id", "id")
    listed = one.select("id").join(found, "id", "left").unionByName(rows.filter("id IS NULL").select("id"), allowMissingColumns=True)
    return listed.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _looked_up(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``values`` holds for their ``key``; its column ``n`` counts the rows of a key.

    Keys with over a thousandth of all rows, fewer than a thousand, are broadcast, so that their rows
    stay where they are; the others are joined.
    """
    many = rows.count() // 1000
    values = written(values, "values")
    hot = values.filter(F.col("n") > many)
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.filter(F.col("n") <= many), key))
        .drop("n")
    )


def _scaled(name: str):
    """A vector divided by its largest component, so that squares neither vanish nor overflow."""
    most = F.aggregate(name, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    extreme = (most < 1e-100) | (most > 1e100)
    return F.when(extreme, F.transform(name, lambda x: x / most)).otherwise(F.col(name)).alias("vector")


def _clumps(members: DataFrame, cells: DataFrame, place: DataFrame, radius: float) -> DataFrame:
    """``(id, centre)``: vectors moved to the largest clump that has a centre in their centre's cell.

    A vector only ever belongs to a centre within ``radius``; those too far from the new centre
    stay where they are.
    """
    members = written(members, "members")
    for round_ in range(CLUMP_ROUNDS):
        sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("size"))
        keyed = sizes.join(cells.select(F.col("id").alias("centre"), F.col("home")[round_].alias("key")), "centre")
        order = F.struct("size", (-F.col("centre")).alias("minus"), "centre")
        best = keyed.groupBy("key").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        moves = keyed.join(best, "key").select("centre", F.col("best.centre").alias("to")).filter("centre <> to")
        near = (
            members.join(moves, "centre")
            .join(place.select("id", "label", F.col("vector").alias("v")), "id")
            .join(place.select(F.col("id").alias("to"), F.col("label").alias("label_to"), F.col("vector").alias("w")), "to")
            .filter("label = label_to")
            .select("id", "to", cosine("v", "w").alias("cosine"))
            .filter(F.col("cosine") >= math.cos(radius))
            .select("id", "to")
        )
        members = written(members.join(near, "id", "left").select("id", F.coalesce("to", "centre").alias("centre")), "members")
    return members
