"""Aligning the tokens of two tokenizers, all texts of a batch in lockstep."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.binary_packing import WordIds
from tablewright.llm.shared import c, text_slices
from tablewright.workspace import written

#: Bytes of text in a batch (one text at least).
BATCH = 1 << 20
#: Tokens after which a long text goes on in a lane of its own, from the next common end on.
LANE = 256
#: Links of a group from which its equal tokens are put together before pairs are made.
_MANY = 1 << 16
#: Links that are written out at once, besides those of a last group.
_AT_ONCE = 1 << 20
_A_BITS = 32

_WORKER: dict[tuple[str, str, str], TwoTokenizers] = {}


class TwoTokenizers:
    """Ids and bytes of the tokens of a byte-level vocabulary (A) and a sentencepiece model (B)."""

    def __init__(self, ranks: str, pattern: str, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._a = WordIds.of(ranks, pattern)
        with open(ranks, "rb") as lines:
            own = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self.bytes_a = [own.get(i, b"") for i in range(max(own) + 1)]
        self._b = SentencePieceProcessor(model_file=model)
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        sizes = lambda table: np.fromiter(map(len, table), np.int64, len(table))
        self.sizes_a, self.sizes_b = sizes(self.bytes_a), sizes(self.bytes_b)
        self._spelled_a, self._spelled_b = (pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))

    @staticmethod
    def of(*paths: str) -> TwoTokenizers:
        if paths not in _WORKER:
            _WORKER[paths] = TwoTokenizers(*paths)
        return _WORKER[paths]

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text in A and in B; none for texts that either does not give back."""
        filled = texts.fill_null("")
        plain, whole = filled.to_pylist(), pc.binary_join_element_wise("", filled, " ")
        out_a = [np.frombuffer(a, "<u4").astype(np.int64) for a in self._a(whole)]
        out_b = [np.asarray(b, np.int64) for b in self._b.encode(plain, out_type=int, num_threads=1)]
        whole = whole.cast(pa.large_binary())
        same = pc.and_(pc.equal(_joined(self._spelled_a, out_a), whole), pc.equal(_joined(self._spelled_b, out_b), whole))
        good = [bool(text) and x for text, x in zip(plain, same.to_pylist(), strict=True)]
        return tuple([x if g else x[:0] for x, g in zip(out, good, strict=True)] for out in (out_a, out_b))


def _joined(spelled: pa.LargeBinaryArray, ids: list[np.ndarray]) -> pa.LargeBinaryArray:
    """The bytes of each text's tokens, one after the other."""
    offsets, data = _taken(spelled, np.concatenate([np.empty(0, np.int64), *ids]))
    borders = offsets[np.cumsum([0, *map(len, ids)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(borders), data])


def _taken(words: pa.LargeBinaryArray, index: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """Words put together: where each begins, with the end of all, and the bytes."""
    found = words.take(pa.array(index))
    data = found.buffers()[2]
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(index) + 1) if len(index) else np.zeros(1, np.int64)
    return offsets, pa.py_buffer(b"") if data is None else data


class Batch:
    """The tokens of several texts, one text after the other, with the byte at which each ends."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> None:
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (ids_a, ids_b))
        self.starts_a, self.starts_b = (np.cumsum([0, *map(len, x)]) for x in (ids_a, ids_b))
        # A text has as many bytes in A as in B, so ends are comparable over the whole batch.
        self.ends_a, self.ends_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        self._top_a, self._top_b = len(sizes_a), len(sizes_b)

    def lanes(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Where lanes begin in A and in B: at every text, and within texts at common ends, ``lane`` tokens apart or more."""
        wish = [np.arange(a + lane, b, lane) for a, b in zip(self.starts_a, self.starts_a[1:], strict=False)]
        at = np.concatenate([np.empty(0, np.int64), *wish]) - 1
        found = []
        while len(at):
            place = np.searchsorted(self.ends_b, self.ends_a[at])
            good = self.ends_b[place] == self.ends_a[at]
            found.append(at[good] + 1)
            at = np.unique(at[~good] + 1)  # ends of texts are common ends: none runs over
        starts = np.unique(np.concatenate([self.starts_a[:-1], *found])).astype(np.int64)
        starts = starts[starts < len(self.a)]
        ends = np.where(starts > 0, self.ends_a[starts - 1], 0)
        return starts, np.where(starts > 0, np.searchsorted(self.ends_b, ends) + 1, 0)

    def cuts(self, lane: int = LANE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Step by step the groups that end there: where each begins and ends in A and in B.

        One pointer into A and one into B for every lane: the one whose token ends first moves on,
        both where the ends are the same, which closes a group.  Lanes at their end leave.
        """
        i, j = self.lanes(lane)
        last = np.append(i[1:], len(self.a))
        from_a, from_b = i.copy(), j.copy()
        while len(i):
            end_a, end_b = self.ends_a[i], self.ends_b[j]
            cut = np.flatnonzero(end_a == end_b)
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
            if len(cut):
                yield from_a[cut], i[cut], from_b[cut], j[cut]
                from_a[cut], from_b[cut] = i[cut], j[cut]
                if (i[cut] == last[cut]).any():
                    on = i < last
                    i, j, last, from_a, from_b = i[on], j[on], last[on], from_a[on], from_b[on]

    def _links(self, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys of the distinct links of groups, some at a time, and how often each comes."""
        first = np.searchsorted(self.starts_a, groups[:, 0], "right") - 1
        a0, a1, b0, b1 = groups.T
        many = (a1 - a0) * (b1 - b0) > _MANY
        for k in np.flatnonzero(many):
            own_a, times_a = np.unique(self.a[a0[k] : a1[k]], return_counts=True)
            own_b, times_b = np.unique(self.b[b0[k] : b1[k]], return_counts=True)
            yield self._key(first[k], own_a[:, None], own_b[None, :]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()
        a0, a1, b0, b1, first = (x[~many] for x in (a0, a1, b0, b1, first))
        wide = b1 - b0
        size = (a1 - a0) * wide
        part = (np.cumsum(size) - size) // _AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            group = np.repeat(np.arange(start, end), size[start:end])
            within = np.arange(len(group)) - np.repeat(np.cumsum(size[start:end]) - size[start:end], size[start:end])
            at_a, at_b = np.divmod(within, wide[group])
            yield np.unique(self._key(first[group], self.a[at_a + a0[group]], self.b[at_b + b0[group]]), return_counts=True)

    def _key(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each link of a text, in the order of texts, then ids of A, then ids of B."""
        return (text * self._top_a + a) * self._top_b + b

    def aligned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups as columns from and to in A, from and to in B, in order; and the distinct links of each text."""
        steps = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*self.cuts(), strict=True)] or [np.empty(0, np.int64)] * 4
        place = np.full(len(self.a), -1)
        place[steps[0]] = np.arange(len(steps[0]))  # no two groups begin at the same token
        groups = np.stack(steps, 1)[place[place >= 0]]
        found = list(self._links(groups))
        key, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True))
        if len(found) > 1:
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            key, times = key[starts], np.add.reduceat(times[order], starts) if len(starts) else times
        text, link = np.divmod(key, self._top_a * self._top_b)
        links = np.unique(link)
        number = np.searchsorted(links, link)
        a, b = np.divmod(links, self._top_b)
        return groups, a << _A_BITS | b, np.stack([text, number], 1), times


def _group_digests(batch: Batch, groups: np.ndarray, words: pa.LargeBinaryArray) -> list[str]:
    """For each text the SHA-256 of its groups as ``a1,a2|b1;a3|b2,b3``; '' if it has none.

    ``words`` holds every id followed by a comma, then every id followed by a bar, then by a semicolon.
    """
    # Tokens of A and B in the order of writing: a token's place is its own number and that of all before it.
    sizes_a, sizes_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    before_b = np.repeat(groups[:, 2], sizes_a)
    before_a = np.repeat(groups[:, 1], sizes_b)
    top = len(words) // 3
    written_a, written_b = batch.a.copy(), batch.b.copy()
    written_a[groups[:, 1] - 1] += top
    written_b[groups[:, 3] - 1] += 2 * top
    out = np.empty(len(batch.a) + len(batch.b), np.int64)
    out[np.arange(len(batch.a)) + before_b] = written_a
    out[np.arange(len(batch.b)) + before_a] = written_b
    offsets, data = _taken(words, out)
    borders = offsets[batch.starts_a + batch.starts_b].tolist()
    flat = memoryview(data)
    return [hashlib.sha256(flat[a : b - 1]).hexdigest() if a < b else "" for a, b in zip(borders, borders[1:], strict=False)]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SHEET = (
    "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<int>, times array<long>, pairs array<long>, holders array<long>"
)


def _lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, kind))


def _batches(tables: Iterator[pa.RecordBatch], paths: tuple[str, str, str]) -> Iterator[tuple[pa.Array, Batch]]:
    """The ids of documents and their tokens, a batch at a time."""
    both = TwoTokenizers.of(*paths)
    for table in tables:
        for start, end in text_slices(table.column(1), BATCH):
            ids = both(table.column(1).slice(start, end - start))
            yield table.column(0).slice(start, end - start), Batch(*ids, both.sizes_a, both.sizes_b)


def _aligner(paths: tuple[str, str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def align(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers.of(*paths)
        top = max(len(both.bytes_a), len(both.bytes_b))
        words = pa.array([b"%d%c" % (i, mark) for mark in b",|;" for i in range(top)], pa.large_binary())
        number = TaskContext.get().partitionId() << 33
        for docs, batch in _batches(tables, paths):
            groups, pairs, links, times = batch.aligned()
            n = len(docs)
            of_text = np.searchsorted(groups[:, 0], batch.starts_a)
            sizes = (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2])
            counts = [
                np.diff(batch.starts_a),
                np.diff(batch.starts_b),
                np.diff(of_text),
                np.diff(np.concatenate([[0], np.cumsum(sizes)])[of_text]),
            ]
            digests = _group_digests(batch, groups, words)
            borders = np.searchsorted(links[:, 0], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)),
                    docs,
                    *[pa.array(x, pa.int64()) for x in counts],
                    pa.array(digests, pa.string()),
                    _lists(links[:, 1], borders, pa.int32()),
                    _lists(times, borders, pa.int64()),
                    pa.nulls(n, pa.list_(pa.int64())),
                    pa.nulls(n, pa.list_(pa.int64())),
                ],
                _NAMES,
            )
            holders = np.bincount(links[:, 1], minlength=len(pairs))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    *[pa.nulls(1, pa.int64())] * 5,
                    pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.list_(pa.int32())),
                    pa.nulls(1, pa.list_(pa.int64())),
                    *[_lists(x, np.array([0, len(pairs)]), pa.int64()) for x in (pairs, holders)],
                ],
                _NAMES,
            )
            number += 1

    return align


_NAMES = [part.split()[0] for part in _SHEET.split(", ")]


def _weigh(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Sums over the links of a batch's documents, with the counts of the batch's pairs, which come in order."""
    counts = known.column("counts").combine_chunks().flatten().flatten()
    n, best = counts[1].to_numpy(), counts[2].to_numpy(zero_copy_only=False).astype(np.int64)
    links = docs.column("links").combine_chunks()
    times = docs.column("times").combine_chunks().flatten().to_numpy()
    index = links.flatten().to_numpy()
    borders = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(times * x[index])]) for x in (best, n)]
    kept = docs.select(["doc_id", *_COUNTS])
    for name, total in zip(("n_best", "count_sum"), sums, strict=True):
        kept = kept.append_column(name, pa.array(np.diff(total[borders]), pa.int64()))
    return kept.append_column("groups_sha256", docs.column("groups_sha256"))


def align_tokens(
    docs: DataFrame, ranks: str, pattern: str, model: str, *, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What each document's alignment is, and how many documents hold each linked pair of ids.

    A encodes a space and the text with the byte-level vocabulary at ``ranks``, cut by ``pattern``; B encodes
    the text with the sentencepiece model at ``model``, which puts the space there itself.  Both paths
    must be on every executor.  Strings of special tokens are ordinary text.  Byte offsets at which
    tokens of both end cut a text into groups; within a group every token of A is linked with every one of B.

    The first table has a row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links
    whose pair no other pair with that id of A outnumbers), ``count_sum`` (documents that hold the pair,
    summed over links) and ``groups_sha256`` of the groups written as ``a1,a2|b1;a3|b2,b3``.  The second has
    ``id_a``, ``id_b`` and ``n_docs``.  ``token_groups`` gives the groups themselves.

    Null and empty texts, and those that one of the two does not give back byte by byte, have no
    tokens: zeros and the empty digest.  Repeated rows are documents of their own; null ids stay
    null; other columns are not read, whatever their names.  Empty tables give empty ones.

    Texts are encoded once.  Each batch of texts names its distinct pairs once, and its documents refer
    to them by number, so what is shuffled for counting is the pairs of batches, not the links of documents;
    nothing is broadcast.  A batch gets the counts of its own pairs back, in one group whose
    size the batch bounds.
    """
    paths = (ranks, pattern, model)
    rows = docs.select(c(doc_id).cast("long").alias("doc_id"), c(text).cast("string").alias("text"))
    sheet = written(rows.mapInArrow(_aligner(paths), _SHEET), "alignment")
    pairs = sheet.filter(F.col("pairs").isNotNull())
    counts = (
        pairs.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.holders").alias("n"))
    )
    counts = written(counts, "pair-counts")
    id_a = F.shiftright("pair", _A_BITS).cast("int")
    highest = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("highest"))
    judged = (
        counts.withColumn("id_a", id_a)
        .join(highest, "id_a")
        .select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    )
    known = (
        pairs.select("batch", F.posexplode("pairs").alias("at", "pair"))
        .join(judged, "pair")
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("counts"))
    )
    of_docs = sheet.filter(F.col("n_a").isNotNull()).select(
        F.col("batch").alias("lot"), "doc_id", *_COUNTS, "groups_sha256", "links", "times"
    )
    out = ", ".join(f"{n} long" for n in ("doc_id", *_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    # Batches without any link have nothing to look up.
    everything = pairs.select("batch").join(known, "batch", "left")
    everything = everything.select(
        "batch", F.coalesce("counts", F.array().cast("array<struct<at: int, n: bigint, best: boolean>>")).alias("counts")
    )
    found = of_docs.groupBy("lot").cogroup(everything.groupBy("batch")).applyInArrow(_weigh, out)
    listed = counts.select(id_a.alias("id_a"), F.col("pair").bitwiseAND((1 << _A_BITS) - 1).cast("int").alias("id_b"), F.col("n").alias("n_docs"))
    return found, listed


def token_groups(
    docs: DataFrame, ranks: str, pattern: str, model: str, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, groups)``: the groups of each document in order, as ids of A, ids of B and the byte at which they end.

    Bytes are counted from the space before the text.  Takes the parameters of ``align_tokens`` and treats
    odd texts as it does: they have no groups.  No shuffle.
    """
    paths = (ranks, pattern, model)

    def groups_of(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _batches(tables, paths):
            groups = batch.aligned()[0]
            before = np.concatenate([[0], batch.ends_a])
            text_of = np.searchsorted(batch.starts_a, groups[:, 0], "right") - 1
            ends = before[groups[:, 1]] - before[batch.starts_a[text_of]]
            fields = [
                _lists(batch.a, np.append(groups[:, 0], len(batch.a)), pa.int32()),
                _lists(batch.b, np.append(groups[:, 2], len(batch.b)), pa.int32()),
                pa.array(ends, pa.int64()),
            ]
            borders = pa.array(np.searchsorted(groups[:, 0], batch.starts_a), pa.int32())
            struct = pa.StructArray.from_arrays(fields, ["a", "b", "end"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(borders, struct)], ["doc_id", "groups"])

    rows = docs.select(c(doc_id).cast("long").alias("doc_id"), c(text).cast("string").alias("text"))
    return rows.mapInArrow(groups_of, "doc_id long, groups array<struct<a: array<int>, b: array<int>, end: long>>")
