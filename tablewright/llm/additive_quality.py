"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature after the other, and summed into one lookup table per
feature; then trees over pairs of features likewise.  Scoring bins the features and adds what the
tables hold.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import c, free_name, whole_text

FEATURES = (
    "log_chars",
    "log_words",
    "word_length",
    "distinct_words",
    "distinct_pairs",
    "adjacent_repeats",
    "top_word",
    "upper",
    "digits",
    "spaces",
    "symbols",
    "exclaims",
    "pipes",
    "stops",
    "other_marks",
    "beyond_ascii",
    "symbol_words",
    "distinct_lines",
    "line_length",
)

#: Labelled rows the model is fitted on at most: those with the least hashes of their ids.
TRAINING_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
RATE = 0.1
PRIOR = 1.0
CUTOFF = 0.3

_CLASSES = ("upper", "lower", "digit", "space", "symbol", "exclaim", "pipe", "stop", "mark", "beyond")


def _byte_classes() -> np.ndarray:
    table = np.full(256, _CLASSES.index("mark"), np.int64)
    for name, members in (
        ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("lower", "abcdefghijklmnopqrstuvwxyz"),
        ("digit", "0123456789"),
        ("space", " \t\n\x0b\x0c\r"),
        ("symbol", "#$%&*@^~=+<>\\_{}[]"),
        ("exclaim", "!?"),
        ("pipe", "|"),
        ("stop", ".,;:"),
    ):
        table[list(members.encode())] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("beyond")
    return table


_BYTE_CLASS = _byte_classes()


def features(text: str) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    words = text.split()
    n, k = max(len(raw), 1), max(len(words), 1)
    count = dict(zip(_CLASSES, np.bincount(_BYTE_CLASS[raw], minlength=len(_CLASSES)).tolist(), strict=True))
    times = Counter(words)
    pairs = max(len(words) - 1, 1)
    lines = text.split("\n")
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        (n - count["space"]) / k,
        len(times) / k,
        len(set(pairwise(words))) / pairs,
        sum(map(str.__eq__, words, words[1:])) / pairs,
        max(times.values(), default=0) / k,
        count["upper"] / max(count["upper"] + count["lower"], 1),
        count["digit"] / n,
        count["space"] / n,
        count["symbol"] / n,
        count["exclaim"] / n,
        count["pipe"] / n,
        count["stop"] / n,
        count["mark"] / n,
        count["beyond"] / n,
        sum(times[w] for w in times if not w[-1].isalnum() and w[-1] not in ".,;:") / k,
        len(set(lines)) / len(lines),
        math.log1p(len(raw) / len(lines)),
    ]


@dataclass
class AdditiveModel:
    """Tables that are added: one per feature, one per chosen pair of features."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The likelihood of label 1 for rows of features."""
        total = np.full(len(rows), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], rows[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            at = [np.searchsorted(self.pair_edges[k], rows[:, k], "right") for k in (a, b)]
            total += table[at[0], at[1]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a range of bins, and the bin it is before."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + PRIOR) + (all_g - left_g) ** 2 / (all_h - left_h + PRIOR)
    at = int(np.argmax(gain))
    return float(gain[at] - all_g**2 / (all_h + PRIOR)), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for every bin from a tree of depth two over gradients and curvatures of the bins."""
    gain, cut = _best_cut(g, h)
    borders = {0, len(g)}
    if gain > 1e-9:
        borders.add(cut)
        for a, b in ((0, cut), (cut, len(g))):
            gain, inner = _best_cut(g[a:b], h[a:b])
            if gain > 1e-9:
                borders.add(a + inner)
    out = np.zeros(len(g))
    for a, b in pairwise(sorted(borders)):
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + PRIOR)
    return out


def _square(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain of the best cut of a grid into four quarters, and the steps of its cells."""
    sum_g, sum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarters(s: np.ndarray) -> list[np.ndarray]:
        low = s[:-1, :-1]
        top, side = s[:-1, -1:] - low, s[-1:, :-1] - low
        return [low, top, side, s[-1, -1] - low - top - side]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = list(zip(quarters(sum_g), quarters(sum_h), strict=True))
    gain = sum(a**2 / (b + PRIOR) for a, b in parts)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty(g.shape)
    for (a, b), rows, cols in zip(
        parts, (slice(i + 1), slice(i + 1), slice(i + 1, None), slice(i + 1, None)),
        (slice(j + 1), slice(j + 1, None), slice(j + 1), slice(j + 1, None)), strict=True,
    ):
        out[rows, cols] = RATE * a[i, j] / (b[i, j] + PRIOR)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + PRIOR)), out


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Fit the tables.  Without rows, or with one label only, the score is a constant."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = AdditiveModel(math.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        return model
    count = rows.shape[1]
    model.edges = [_edges(rows[:, k], BINS) for k in range(count)]
    model.pair_edges = [_edges(rows[:, k], PAIR_BINS) for k in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, rows[:, k], "right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, rows[:, k], "right") for k, e in enumerate(model.pair_edges)]
    total = np.full(len(rows), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return [np.bincount(cell, x, shape[0] * shape[1]).reshape(shape) for x in (g, h)]

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = _tree(*(np.bincount(binned[k], x, len(table)) for x in (g, h)))
            table += step
            total += step[binned[k]]
    # The pairs that explain most of what the single features leave.
    g, h = slopes()
    gains = {(a, b): _square(*grid(a, b, g, h))[0] for a, b in combinations(range(count), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    model.pair_tables = [np.zeros([len(model.pair_edges[k]) + 1 for k in p]) for p in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = _square(*grid(a, b, *slopes()))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id):
    """Whether a row is kept for testing: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _feature_rows(texts: pa.Array) -> pa.Array:
    values = [x for t in texts for x in features(t.as_py())]
    ends = np.arange(0, len(values) + 1, len(FEATURES), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float64()))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    rows: int = TRAINING_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents that are not held out.

    Those with the least hashes of their ids are taken, so the choice does not hang on the order
    of rows.  Only their features reach the driver: ``rows`` times as many numbers as FEATURES has.
    Labels other than 0 and 1, null ids and labels without a document are left out; a document
    with several labels counts with each of them.  Of rows that share an id one counts, that
    with the least digest of its text.
    """
    chosen = (
        labels.select(c(doc_id).alias("doc"), c(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc").isNotNull() & ~held_out(F.col("doc")))
        .distinct()
        .orderBy(F.xxhash64("doc"), "doc", "label")
        .limit(rows)
    )
    own = docs.select(c(doc_id).alias("doc"), whole_text(text).alias("text"))
    # At most ``rows`` ids and labels, a bound that does not grow with the data.
    found = own.join(F.broadcast(chosen), "doc").select(
        "doc", "label", F.md5("text").alias("digest"), F.arrow_udf(_feature_rows, "array<double>")("text").alias("features")
    )
    # Rows that share an id are one: that of the least digest of the text.
    found = found.groupBy("doc", "label").agg(F.min_by("features", "digest").alias("features"))
    kept = sorted(found.collect())
    return fit(
        np.array([r["features"] for r in kept], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in kept], float)
    )


def score_quality(
    docs: DataFrame, model: AdditiveModel, *, doc_id: str = "doc_id", text: str = "text", cutoff: float = CUTOFF
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (of label 1) and ``predicted`` (score >= cutoff).

    The score depends on the text alone; null counts as empty, whose features are all zero.  Rows
    with the same text have the same score.  Columns named like the new ones are replaced, and an
    empty table gives an empty one.  One pass, no shuffle; the model is a few kilobytes.
    """

    def score(texts: pa.Array) -> pa.Array:
        rows = np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
        return pa.array(model.score(rows))

    new = ("held_out", "score", "predicted")
    out = free_name(docs, "quality_score")
    return docs.withColumn(out, F.arrow_udf(score, "double")(whole_text(text))).select(
        *[c(n) for n in docs.columns if n.lower() not in new],
        held_out(c(doc_id)).alias("held_out"),
        c(out).alias("score"),
        F.when(c(out) >= cutoff, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel, *, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    whole = F.struct(*[c(n) for n in docs.columns]).alias("row")
    rows = docs.select(whole, whole_text(text).alias("text"), F.lit(None).cast("long").alias("doc_id"))
    kept = score_quality(rows, model, cutoff=cutoff).filter("predicted = 1")
    return kept.select(*[F.col("row")[n].alias(n) for n in docs.columns])
