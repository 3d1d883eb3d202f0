"""The whole pipeline against a plain version of it, over the smallest given tables."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import _cleaned, _reference_ids
from test_vector_operators import _roots, _similarity, _weights

import corpus_pipeline
from tablewright.llm import additive_quality as aq
from tablewright.llm import binary_packing as bp
from tablewright.llm import pfair, shared

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")


def _plain_quality(rows, labels):
    used = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5]
    texts = dict((r["doc_id"], r["text"] or "") for r in rows)
    examples = sorted((i, q) for i, q in used if i in texts)
    model = aq.fit(np.array([aq.features(texts[i]) for i, _ in examples]), np.array([q for _, q in examples], float))
    scores = model.score(np.array([aq.features(r["text"] or "") for r in rows]))
    return [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]


def _plain_lines(rows):
    texts = {i: t for i, t, *_ in _cleaned([(r["doc_id"], r["text"]) for r in rows], 40, 5)}
    return [{**r, "text": texts[r["doc_id"]], "n_chars": len(texts[r["doc_id"]])} for r in rows]


def _plain_near(rows):
    weights = {r["doc_id"]: _weights(r["text"]) for r in rows}
    ids = sorted(i for i in weights if weights[i])
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if not weights[a].keys().isdisjoint(weights[b]) and _similarity(weights[a], weights[b]) >= 0.8
    ]
    roots = _roots(list(weights), links)
    return [r for r in rows if roots[r["doc_id"]] == r["doc_id"]]


def _plain_mix(rows):
    """Slot by slot: of the classes whose next block is released, the one due first; the others in turns."""
    names = [*sorted(pfair.WEIGHTS), None]
    shares = [*[pfair.WEIGHTS[n] for n in names[:-1]], pfair.OTHER_WEIGHT]
    total = sum(shares)
    queues: dict = {}
    for r in sorted(rows, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"])):
        queues.setdefault(r["source"], []).append(r)
    others = sorted((n for n in queues if n not in names[:-1]), key=lambda n: (n is not None, n or ""))
    out, done, slot = [], [0] * len(names), 0
    while len(out) < len(rows):
        ready = [k for k, w in enumerate(shares) if done[k] * total // w <= slot]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * total // shares[k]), k))
        if names[k] is not None:
            source, b = names[k], done[k]
        else:
            b, turn = divmod(done[k], len(others))
            source = others[turn]
        out += queues.get(source, [])[b * pfair.BLOCK : (b + 1) * pfair.BLOCK]
        done[k], slot = done[k] + 1, slot + 1
    return out


def test_the_pipeline_agrees_with_a_plain_one(spark):
    shared.importable(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    plain = [lambda x: _plain_quality(x, labels), _plain_lines, _plain_near, _plain_mix]
    for (name, stage), simple in zip(corpus_pipeline.STAGES, plain, strict=False):
        docs = stage(spark, docs, FOLDER)
        rows = simple(rows)
        got = [r.asDict() for r in docs.collect()]
        if name != "mixing":
            got, rows = (sorted(x, key=lambda r: r["doc_id"]) for x in (got, rows))
        assert got == rows, name
        docs = spark.createDataFrame(got, docs.schema)
    ids = _reference_ids([r["text"] or "" for r in rows])
    expected = {
        (r["doc_id"], start, n, zlib.crc32(np.asarray(own[start : start + n], "<u4").tobytes()), len(own))
        for r, own in zip(rows, ids, strict=True)
        for start, n in bp.binary_pieces(len(own), 2048)
    }
    packed = corpus_pipeline.packing(spark, docs, FOLDER).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed} == expected
    assert len(packed) == len(expected)


def test_sequences_of_a_run_come_in_the_order_of_the_mixture(spark):
    folder = "/root/testdata/sf0.01"
    packed = corpus_pipeline.run(spark, folder).select("doc_id", "start", "sequence_id").collect()
    packed.sort(key=lambda r: r.sequence_id)
    assert len({r.sequence_id for r in packed}) == len(packed)
    order = [r.doc_id for r in packed if r.start == 0]
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    plain = _plain_mix([{"doc_id": i, "source": source[i]} for i in order])
    assert order == [r["doc_id"] for r in plain]
    starts: dict = {}
    for r in packed:
        assert r.start >= starts.setdefault(r.doc_id, 0)
        starts[r.doc_id] = r.start
    # The shares hold from the first sequence on, to within a block, until a source has run out.
    kinds = Counter(source[i] for i in order)
    others = [n for n in kinds if n not in pfair.WEIGHTS]
    weights = {**pfair.WEIGHTS, **{n: pfair.OTHER_WEIGHT / len(others) for n in others}}
    total = sum(weights.values())
    whole = int(min(kinds[n] // pfair.BLOCK * total / w for n, w in weights.items()))
    assert whole >= 10 and len(kinds) == 20
    so_far: Counter = Counter()
    for end in range(whole):
        assert all(abs(so_far[n] - end * pfair.BLOCK * w / total) < pfair.BLOCK for n, w in weights.items())
        so_far.update(source[i] for i in order[end * pfair.BLOCK : (end + 1) * pfair.BLOCK])
