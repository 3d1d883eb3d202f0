"""Top inner products, near-duplicate vectors and documents, components, the pipeline."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import ball_tree, lattice, lattice_dedup, shared
from tablewright.llm import prob_minhash as pm
from tablewright.llm.components import components
from tablewright.llm.queries import REGISTRY
from tablewright_queries.registry import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _importable(spark):
    shared.importable(spark)


def _roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)]
    links += [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)] + [(5, 5)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.id: r.root for r in found.collect()} == _roots(nodes, links := [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- documents ---------------------------------------------------------------------------------


def _weights(text, words=5):
    own = re.findall(r"\w+", (text or "").lower())
    if not own:
        return {}
    grams = [tuple(own[i : i + words]) for i in range(max(len(own) - words + 1, 1))]
    return {g: 1 + math.log(grams.count(g)) for g in set(grams)}


def _similarity(x, y):
    a, b = sum(x.values()), sum(y.values())
    x, y = {k: v / a for k, v in x.items()}, {k: v / b for k, v in y.items()}
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)


def _corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            changed = list(base)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append((", " if rng.random() < 0.3 else " ").join(changed).upper() if rng.random() < 0.3 else " ".join(changed))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(40):  # a large group whose members drift apart
        texts.append(" ".join([*base[:i], *[f"n{i}x{k}" for k in range(2)], *base[i + 2 :]]))
    return [*texts, "", None, "...", "one two", "One, two!", "one three", "same line\n" * 50, "same line\n" * 51]


def test_near_duplicates_agree_with_all_pairs(spark):
    texts = _corpus()
    weights = [_weights(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if weights[i] and weights[j] and _similarity(weights[i], weights[j]) >= 0.8
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "one two"), (0, texts[0])], "doc_id long, text string")
    found = pm.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in found} == _roots(range(len(texts)), links)
    assert len(found) == len(texts) and all(r.kept == (r.doc_id == r.class_id) for r in found)
    kept = pm.keep_one(df.withColumn("kept_id", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "kept_id"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(r.doc_id for r in found if r.kept)
    assert kept.filter("doc_id IS NULL").count() == 1
    assert pm.near_duplicates(df.limit(0)).collect() == []


def test_groups_that_a_star_does_not_join(spark, monkeypatch):
    """Texts of a chain, each like the next only: the last step compares what is left."""
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words[4 * i : 4 * i + 60]) for i in range(12)]
    weights = [_weights(t) for t in texts]
    links = [(i, j) for i in range(12) for j in range(i) if _similarity(weights[i], weights[j]) >= 0.8]
    monkeypatch.setattr(pm, "STAR_ROUNDS", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in pm.near_duplicates(df).collect()} == _roots(range(12), links)


def test_registers_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(8)
    errors = []
    for _ in range(40):
        n = rng.integers(5, 200)
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: rng.integers(1, n + 1)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        wx, wy = (1 + np.log(rng.integers(1, 6, len(z))) for z in (x, y))
        held = pm.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.concatenate([wx, wy]), 2)
        exact = pm.probability_jaccard((x, wx), (y, wy))
        plain = _similarity(dict(zip(x.tolist(), wx.tolist(), strict=True)), dict(zip(y.tolist(), wy.tolist(), strict=True)))
        assert abs(exact - plain) < 1e-9
        errors.append((held[0] == held[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


# --- vectors -----------------------------------------------------------------------------------------


def test_lattice_points_are_nearest():
    y = np.random.default_rng(9).normal(size=(1000, 8)) * 2
    x = lattice.nearest(y)
    around = x[:, None] + lattice.ROOTS[None]
    assert (((y - x) ** 2).sum(1) <= ((y[:, None] - around) ** 2).sum(2).min(1) + 1e-9).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)
    near = lattice.neighbours(y, x, 3)
    assert np.allclose(np.sort(((near - y[:, None]) ** 2).sum(2), 1)[:, 0], ((y[:, None] - around) ** 2).sum(2).min(1))


def _vectors():
    rng = np.random.default_rng(10)
    rows = []
    for g in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((centre + rng.normal(size=16) * 0.08, g % 3))
    centre = rng.normal(size=16)
    rows += [(centre + rng.normal(size=16) * 0.12, 1) for _ in range(120)]
    rows += [(centre * 2, 1), (centre, 1), (centre, 1), (centre, None), (centre, 0)]
    out = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(out)
    return [
        *out, (n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1),
        (n + 4, [], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [float("inf")] * 16, 1),
        (n + 8, [1e-200, 2e-200], 1), (n + 9, [1e200, 2e200], 1),
    ]


def test_near_vectors_agree_with_all_pairs(spark):
    rows = _vectors()
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            x_, y_ = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
            if la == lb and len(x) == len(y) and x_ @ y_ / np.sqrt(x_ @ x_) / np.sqrt(y_ @ y_) >= 0.93:
                links.append((a, b))
    df = spark.createDataFrame([*rows, rows[0], (None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    found = lattice_dedup.near_vectors(df).collect()
    by_id = {r.vec_id: r for r in found}
    assert len(found) == len(rows) + 1 and by_id[None].n_links == 0 and by_id[None].component_id is None
    roots = _roots([r[0] for r in rows], links)
    assert {i: r.component_id for i, r in by_id.items() if i is not None} == roots
    assert {i: r.n_links for i, r in by_id.items() if i is not None} == {i: sum(i in x for x in links) for i in roots}
    assert all(r.kept == (i == roots[i]) for i, r in by_id.items() if i is not None)
    assert lattice_dedup.near_vectors(df.limit(0)).collect() == []


def test_cells_follow_the_table(spark):
    rng = np.random.default_rng(12)
    sample, labels = rng.normal(size=(600, 32)), rng.integers(0, 3, 600)
    shapes = [lattice_dedup.fitted_cells(sample, labels, n, 0.93) for n in (10**3, 10**6, 10**9)]
    assert shapes[0].lattices < shapes[-1].lattices and shapes[0].tables < shapes[-1].tables
    # Pairs just at the threshold are found by every shape, and far ones meet less in finer ones.
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (x * z).sum(1)[:, None] * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    met = []
    for shape in shapes:
        width, far = shape.lattices * lattice.SIZE, 0
        found = np.zeros(len(x), bool)
        towards = lattice_dedup._directions(32, shape)
        for t in range(shape.tables):
            part = towards[:, t * width : (t + 1) * width]
            a, b = (lattice_dedup._cell_keys(v @ part, np.zeros(len(x)), t, shape) for v in (x, y))
            found |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
            far += (a[:, :, None] == np.roll(b[:, 0], 1)[:, None, None]).sum()
        assert found.mean() > 0.998
        met.append(far / shape.tables)
    assert met[0] >= met[1] >= met[2] and met[0] > met[2]


@pytest.mark.parametrize("shape", [(1, 2.5, 4, 14), (2, 1.5, 8, 12), (3, 1.25, 8, 19)])
def test_near_vectors_do_not_depend_on_the_cells(spark, shape):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>, label int")
    fitted, given = (
        sorted(map(tuple, lattice_dedup.near_vectors(df, cells=cells).collect()))
        for cells in (None, lattice_dedup.Cells(*shape))
    )
    assert fitted == given


def _best(rows, every, top):
    whole = {}
    for i, v, *_ in rows:
        if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in (q for q in whole if q % every == 0):
        scores: dict[int, int] = {}
        for mine in whole[q]:
            for i, others in whole.items():
                for other in others:
                    if i != q and len(other) == len(mine):
                        score = sum(a * b for a, b in zip(mine, other, strict=True))
                        scores[i] = max(score, scores.get(i, score))
        ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]
        out += [(q, k, i, s) for k, (i, s) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [7, 10**6])
def test_top_products_agree_with_all_pairs(spark, shard_rows):
    rows = [r for r in _vectors() if r[1] is None or not any(x and abs(x) > 1e100 for x in r[1] if x)]
    rows += [(400 + i, [1.0, 1.0], 1) for i in range(9)] + [(500, [2.0**27, 2.0**20], 1), (501, [2.0**18, 2.0**18], 0)]
    df = spark.createDataFrame([*rows, rows[0], (None, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    found = ball_tree.top_products(df, every=10, shard_rows=shard_rows).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == _best(rows, 10, 5)
    assert ball_tree.top_products(df.limit(0)).collect() == []


def test_a_tree_passes_balls_over():
    rng = np.random.default_rng(11)
    centres = rng.integers(-4000, 4000, (20, 8))
    vectors = (centres[:, None] + rng.integers(-5, 5, (20, 300, 8))).reshape(-1, 8)
    tree = ball_tree.BallTree(np.arange(len(vectors)), vectors)
    looked = []
    products = tree.products
    tree.products = lambda own, q, rows: looked.append(len(rows)) or products(own, q, rows)
    tree.search(np.array([-1]), centres[:1], np.array([np.iinfo(np.int64).min]), 5)
    assert sum(looked) < len(vectors) / 4


def test_queries_go_to_few_groups(spark, monkeypatch):
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(24, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 24] + rng.normal(size=16) * 0.05]) for i in range(1200)]
    rows += [(1200 + i, [1.0 + i, 2.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    waves, asked = [], ball_tree._asked
    monkeypatch.setattr(ball_tree, "_asked", lambda *x: waves.append(asked(*x)) or waves[-1])
    found = ball_tree.top_products(df, every=10, shard_rows=30)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == _best(rows, 10, 5)
    shards = 1 + max(r.shard for w in waves for r in w.select("shard").distinct().collect())
    sent = sum(w.count() for w in waves)
    assert len(waves) == 2 and shards >= 30 and sent < 120 * shards / 4
    # The second wave starts with the k-th score of the first.
    assert waves[1].filter(F.col("least") == -(2**63)).filter("size(vector) > 2").isEmpty()


# --- registered queries ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_queries_equal_their_sql(spark, duck, name):
    found = REGISTRY[name].run(spark, FOLDER)
    columns = sorted(found.columns)
    result = duck.execute(REGISTRY[name].sql)
    place = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(place) == columns
    assert sorted(repr(tuple(r[n] for n in columns)) for r in found.collect()) == sorted(
        repr(tuple(r[place[n]] for n in columns)) for r in result.fetchall()
    )


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_the_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "new", 0)], docs.schema)
    docs = docs.unionByName(extra).withColumn("slot", F.lit(1))
    columns, ids = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == columns, name
        assert out.count() <= docs.count() and (name == "near_dedup" or name == "quality" or out.count() == docs.count())
        assert out.join(docs, "doc_id", "left_anti").filter("doc_id IS NOT NULL").isEmpty()
        docs = out
    assert docs.count() > ids / 2
    packed = corpus_pipeline.packing(spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    scored = REGISTRY["op4_quality"].run(spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 40 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
