"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document's shingles send exponential arrivals to the registers of its signature, the faster the
more a shingle weighs; a register keeps the shingle that arrives first.  Two documents agree in a
register with the probability Jaccard similarity of their normalised weights.  Bands of registers
find candidates, which are then verified exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.components import components
from tablewright.llm.shared import c, free_name, text_batches, whole_text
from tablewright.workspace import written

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 128  # a power of two
BANDS = 25
ROWS = 5
#: After the first comparison with one document of each group, rounds until all is compared: in all
#: but the last, groups still in several classes meet another of their own documents.
STAR_ROUNDS = 2
#: Documents that meet one copy of the text they are compared with.
CHUNK = 256
#: Texts of a group in one block, in the last comparison.
BLOCK = 256
#: Bytes of text whose shingles a task holds at a time.
SLICE = 4 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_NO_WORD = r"[^\p{L}\p{N}\p{M}_]+"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each.

    Words are runs of letters, digits, marks and low lines, lowered.
    """
    split = pc.split_pattern_regex(pc.utf8_lower(texts), _NO_WORD)
    coded = split.values.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False)).astype(np.uint64)
    real = np.asarray(pc.binary_length(coded.dictionary)) > 0
    index = coded.indices.to_numpy()
    used = real[index] if len(index) else np.zeros(0, bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(used)])[split.offsets.to_numpy()])
    return (known[index[used]] if len(index) else np.zeros(0, np.uint64)), counts


def weighted_shingles(hashes: np.ndarray, counts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """``(text, shingle, weight)`` of the distinct shingles of all texts, sorted by text and shingle.

    A shingle that comes n times weighs 1 + ln n.  Texts of fewer words are one shingle of all of
    them; texts without words have none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    last = np.repeat(ends, n)
    shingle = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for k in range(words):
        own = np.where(at + k < last, padded[at + k], np.uint64(k + 1))
        shingle = _mix(shingle * np.uint64(0x100000001B3) + own + _GOLDEN)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate([first, [len(text)]]))
    return text[first], shingle[first], 1.0 + np.log(times)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures: ``texts`` rows of ``size`` shingles.

    Every shingle visits the registers of its text one after the other, in an order of its own,
    with exponential gaps that make the arrival at any register exponential with its weight.  It
    stops once it is later than what every register of its text already has; all shingles of all
    texts take their next step at once.
    """
    best = np.full(texts * size, np.inf)
    held = np.zeros(texts * size, np.uint64)
    seed = _mix(shingle ^ np.uint64(0x5851F42D4C957F2D))
    start, stride = seed & np.uint64(size - 1), (seed >> np.uint64(20)) | np.uint64(1)
    time = np.zeros(len(text))
    live = np.arange(len(text))
    for k in range(size):
        draw = _mix(shingle[live] + np.uint64((k + 1) * int(_GOLDEN) & (1 << 64) - 1))
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = time[live] - np.log(unit) * (size / (size - k)) / weight[live]
        time[live] = now
        place = text[live] * size + ((start[live] + np.uint64(k) * stride[live]) & np.uint64(size - 1)).astype(np.int64)
        np.minimum.at(best, place, now)
        won = best[place] == now
        held[place[won]] = shingle[live[won]]
        own = np.unique(text[live])
        latest = np.zeros(texts)
        latest[own] = best.reshape(texts, size)[own].max(1)
        live = live[now < latest[text[live]]]
        if not len(live):
            break
    return held.reshape(texts, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two texts given as sorted shingles and their weights.

    The sum over common shingles d of 1 / sum over all e of max(x_e / x_d, y_e / y_d).
    """
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1] / a[1].sum(), b[1] / b[1].sum()
    if np.ptp(a[1]) == 0 and np.ptp(b[1]) == 0:  # all shingles weigh the same: plain Jaccard
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    p, q = x[at], y[bt]
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    # Shingles of one text alone always give that text's side of the maximum.
    alone_x, alone_y = x.sum() - p.sum(), y.sum() - q.sum()
    above = np.cumsum(p[::-1])[::-1]
    below = np.cumsum(q) - q
    first = np.searchsorted(ratio, ratio, "left")
    return float((1 / ((above[first] + alone_x) / p + (below[first] + alone_y) / q)).sum())


def _sketch(words: int):
    weights = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)

    def sketch(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(tables, most=SLICE):
            hashes, counts = word_hashes(table.column(1))
            text, shingle, weight = weighted_shingles(hashes, counts, words)
            held = signatures(text, shingle, weight, len(counts))[:, : BANDS * ROWS] * weights
            bands = _mix(held.reshape(len(counts), BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=np.uint64) * _GOLDEN)
            ends = np.cumsum(counts)
            # Texts with the same words in the same order are the same, whatever divides the words.
            content = [_content(hashes[e - n : e]) if n else None for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([table.column(0), pa.array(content, pa.binary()), lists], ["id", "content", "bands"])

    return sketch


def _content(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest()


def _shingles(texts: pa.Array, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    text, shingle, weight = weighted_shingles(*word_hashes(texts), words)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(shingle[a:b], weight[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _verifier(words: int, similarity: float):
    """Compares texts with the leader that comes before them in the rows of a chunk."""

    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own, fresh = None, [], False  # fresh: no text has been compared with it yet
        for table in text_batches(tables, column=3, most=SLICE):
            a, b = [], []
            rows = zip(table.column(0).to_pylist(), table.column(2).to_pylist(), _shingles(table.column(3), words), strict=True)
            for lead, member, found in rows:
                if member is None:
                    own = [*own, found] if leader == lead and fresh else [found]
                    leader, fresh = lead, True
                    continue
                if leader != lead:
                    raise RuntimeError("a chunk without its leader")
                fresh = False
                if any(probability_jaccard(one, found) >= similarity for one in own):
                    a.append(lead)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are similar.

    A chunk is a leader and up to about CHUNK texts to compare with it; the leader's text is sent
    once to each chunk, so one that meets a third of all documents is spread over many tasks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    leaders = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = (
        leaders.join(texts.withColumnRenamed("id", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    ).unionByName(dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "chunk", "b", "text"))
    return (
        rows.repartition("a", "chunk")
        .sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
        .mapInArrow(_verifier(words, similarity), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, class_id, kept)``, one row per id.

    Documents are linked when their probability Jaccard similarity over shingles of ``words`` words
    is at least ``similarity``; a class is what links connect, ``class_id`` its smallest id, and
    ``kept`` marks that document.

    Candidates share a band of the signature.  Texts with the same words in the same order are
    compared as one.  Of every group that shares a band, all texts are first compared with one of
    them.  Texts of groups that are then in several classes, but have over 1 - ``similarity`` of
    their weight in shingles that no other such text has, can have no link and leave.  The others
    are compared with another one drawn at random, and where a group is still in several classes
    after that, each two of its texts from different classes are compared.  So no link between
    classes is left out, and a group of thousands of alike texts costs comparisons in proportion
    to its size unless its texts share most of their shingles without being linked.

    Texts without words, null among them, have no link; texts with fewer words than a shingle are
    one shingle.  Rows with the same id are one document, linked by any of its texts.  Null ids
    take no part and have no row.  Other columns are not read.  An empty table gives no rows.

    The whole texts are shuffled once, to pick those that are candidates; later rounds move only
    these.  Everything else is ids and hashes, written to the shared folder between steps.
    """
    rows = docs.select(c(doc_id).cast("long").alias("id"), whole_text(text).alias("text")).filter("id IS NOT NULL")
    sketches = written(rows.mapInArrow(_sketch(words), "id long, content binary, bands array<long>"), "sketches")
    worded = sketches.filter("content IS NOT NULL")
    # The bands are the same whichever of the texts gave them.
    heads = written(
        worded.groupBy("content").agg(F.min("id").alias("head"), F.first("bands").alias("bands")), "heads"
    )
    own = sketches.select("id", "content").join(heads.select("content", "head"), "content", "left")
    own = written(own.select("id", F.coalesce("head", "id").alias("head")).distinct(), "own-heads")
    several = own.groupBy("id").agg(F.min("head").alias("a"), F.max("head").alias("b")).filter("a <> b")
    links = own.join(several.select("id", "a"), "id").select("a", F.col("head").alias("b"))

    spread = heads.select(F.col("head").alias("id"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    members = written(spread.join(shared.select("key", "low"), "key").select("key", "low", "id"), "members")
    texts = written(rows.join(members.select("id").distinct(), "id", "left_semi"), "texts")
    pairs = members.filter("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    tested = pairs
    links = written(links.unionByName(_verified(pairs, texts, words, similarity)), "links")
    roots = components(links)
    for round_ in range(1, STAR_ROUNDS + 1):
        open_groups = _open_groups(members, roots)
        if open_groups.isEmpty():
            break
        if round_ == 1:
            lone = _without_partner(open_groups, texts, words, similarity)
            members = written(open_groups.select("key", "id").join(lone, "id", "left_anti"), "members")
            open_groups = _open_groups(members, roots)
        if round_ < STAR_ROUNDS:
            drawn = F.min(F.struct(F.xxhash64("id", F.lit(round_)), F.col("id").alias("id"), F.col("root").alias("root")))
            leads = open_groups.groupBy("key").agg(drawn.alias("lead"))
            pairs = (
                open_groups.join(leads, "key")
                .filter("root <> lead.root")
                .select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
                .distinct()
            )
            pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            found = _verified(pairs, texts, words, similarity)
        else:
            found = _between_classes(open_groups, heads, texts, words, similarity)
        links = written(links.unionByName(found), "links")
        roots = components(links)
    named = own.groupBy("id").agg(F.min("head").alias("head")).join(
        roots.withColumnRenamed("id", "head"), "head", "left"
    )
    class_id = F.coalesce("root", "head")
    return named.select(
        F.col("id").alias("doc_id"), class_id.alias("class_id"), (F.col("id") == class_id).alias("kept")
    )


def _open_groups(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(key, id, root)`` of the groups whose members are in more than one class."""
    named = members.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return written(named.join(several.select("key"), "key"), "open-groups")


def _without_partner(groups: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(id)`` of texts that can be similar to no other text of the groups.

    A probability Jaccard similarity is at most the share of a text's weight that the other text
    has too.  Shingles are counted with a combine in the task.  An id with k texts has no partner
    if its lone shares sum to more than what one text may have and all the others can.
    """
    own = texts.join(groups.select("id").distinct(), "id", "left_semi").select("id", "text")
    shares = own.mapInArrow(_shares(words), "id long, shingle long, share double")
    lone = (
        shares.groupBy("shingle")
        .agg(F.min("id").alias("id"), F.max("id").alias("other"), F.sum("share").alias("share"))
        .filter("id = other")
        .groupBy("id")
        .agg(F.sum("share").alias("share"))
    )
    rows = own.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return lone.join(rows, "id").filter(F.col("share") > F.col("k") - similarity + 1e-9).select("id")


def _shares(words: int):
    def shares(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(tables, most=SLICE):
            text, shingle, weight = weighted_shingles(*word_hashes(table.column(1)), words)
            total = np.bincount(text, weight, table.num_rows)
            ids = table.column(0).take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(shingle.view(np.int64)), pa.array(weight / total[text])], ["id", "shingle", "share"]
            )

    return shares


def _between_classes(groups: DataFrame, heads: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links between texts of a group that are in different classes.

    A group is dealt into blocks of about BLOCK texts, and each two of its blocks meet in one task,
    where all pairs are compared and only links come out: a text is sent once for each block of
    its groups.  A pair is compared in the first group that has it.
    """
    sizes = groups.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        groups.join(sizes, "key")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root")
    )
    rows = (
        dealt.join(heads.groupBy(F.col("head").alias("id")).agg(F.collect_list("bands").alias("bands")), "id")
        .join(texts.select("id", "text"), "id")
        .select("key", "i", "j", "own", "id", "root", F.flatten("bands").alias("bands"), "text")
    )
    return (
        rows.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_block_verifier(words, similarity), "a long, b long")
    )


def _block_verifier(words: int, similarity: float):
    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for table in text_batches(tables, column=7, most=SLICE):
            place = list(zip(*(table.column(k).to_pylist() for k in range(3)), strict=True))
            more = zip(*(table.column(k).to_pylist() for k in (3, 4, 5, 6)), _shingles(table.column(7), words), strict=True)
            for own, row in zip(place, more, strict=True):
                if own != at:
                    yield _pairs_of(at, held, similarity)
                    at, held = own, []
                held.append(row)
        yield _pairs_of(at, held, similarity)

    return verify


def _pairs_of(at: tuple[int, int, int] | None, held: list[tuple], similarity: float) -> pa.RecordBatch:
    """The links of one pair of blocks, whose rows are (block, id, class, bands, shingles)."""
    a, b = [], []
    if len({row[2] for row in held}) > 1:
        key, i, j = at
        blocks, ids, roots = (np.array([row[k] for row in held]) for k in range(3))
        size = max(len(row[3]) for row in held)
        bands = np.array([row[3] + row[3][:1] * (size - len(row[3])) for row in held])
        for x in range(len(held)):
            others = (ids > ids[x]) & (roots != roots[x])
            if i != j:
                others &= blocks != blocks[x]
            if size == BANDS:  # in the first group they share
                same = bands == bands[x]
                others &= np.where(same.any(1), bands[x][same.argmax(1)], 0) == key
            for y in np.flatnonzero(others).tolist():
                if probability_jaccard(held[x][4], held[y][4]) >= similarity:
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id.

    Of several rows with that id the one whose text sorts first stays.  Rows with a null id, which
    belong to no class, all stay.
    """
    kept = near_duplicates(docs, doc_id=doc_id, text=text).filter("kept").select("doc_id")
    mine, number = free_name(docs, "kept_id"), free_name(docs, "kept_number")
    known = docs.filter(c(doc_id).isNotNull()).withColumn(mine, c(doc_id).cast("long"))
    numbered = known.join(kept.withColumnRenamed("doc_id", mine), mine, "left_semi").withColumn(
        number, F.expr(f"row_number() OVER (PARTITION BY {quoted(mine)} ORDER BY {quoted(text)})")
    )
    columns = [c(n) for n in docs.columns]
    return numbered.filter(c(number) == 1).select(*columns).unionByName(docs.filter(c(doc_id).isNull()).select(*columns))
