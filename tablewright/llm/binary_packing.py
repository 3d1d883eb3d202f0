"""Packing by powers of two: no sequence crosses documents, few are padded."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import c, text_batches, whole_text

SEQUENCE = 2048
END_ID = 1
#: Special tokens of the vocabulary, which are no ranks.
SPECIAL: Mapping[str, int] = {"<|endoftext|>": 50256}
#: Words whose ids a worker remembers; the memory this takes is the only thing it bounds.
CACHED = 300_000
_LONG_WORD = 64
#: Bits for the number of a piece within its document: more than a text of 2 GB can have.
_PIECE_BITS = 21

# A space before a character that is not white space always begins a new pre-token, so a text may
# be cut there without changing its ids.  Texts with other spaces are tokenised in one go.
_OTHER_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"

_WORKER: dict[tuple[str, str], WordIds] = {}


class WordIds:
    """Ids of many texts at once: every distinct word of them is tokenised once."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as lines:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self._line_end = np.uint32(own[b"\n"])
        self._known: dict[str, bytes] = {}

    @staticmethod
    def of(ranks: str, pattern: str) -> WordIds:
        if (ranks, pattern) not in _WORKER:
            _WORKER[ranks, pattern] = WordIds(ranks, pattern)
        return _WORKER[ranks, pattern]

    def _one(self, text: str) -> np.ndarray:
        return np.asarray(self._encoding.encode_ordinary(text), "<u4")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that a space precedes, and where each word's begin and how many they are."""
        known = self._known
        if len(known) > CACHED:
            known.clear()
        lacking = [w for w in words if w not in known]
        plain = [w for w in lacking if "\n" not in w]
        for at in range(0, len(plain), 50_000):
            # A line end before a space is an id of its own, which no word without one contains.
            some = plain[at : at + 50_000]
            joined = "\n ".join(["", *some])
            if len(joined.split()) != len(some):  # other white space in a word: each by itself
                known.update((w, self._one(" " + w).tobytes()) for w in some)
                continue
            ids = self._one(joined)
            ends = [*(4 * np.flatnonzero(ids == self._line_end)).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            known.update((w, raw[a + 4 : b]) for w, a, b in zip(some, ends, ends[1:], strict=False))
        known.update((w, self._one(" " + w).tobytes()) for w in lacking if "\n" in w)
        parts = [known[w] for w in words]
        for word in lacking:
            if len(word) > _LONG_WORD:
                del known[word]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(lengths) - lengths, lengths

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = pc.match_substring_regex(texts, _OTHER_SPACE)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        first = coded.dictionary.take(pa.array(index[starts[:-1]])).to_pylist()
        # What begins a text has no space before it; it is tokenised for itself, as are odd texts.
        whole = [t if o else f for t, o, f in zip(texts.to_pylist(), odd.to_pylist(), first, strict=True)]
        used, wanted = np.ones(len(index), bool), np.zeros(len(coded.dictionary), bool)
        used[starts[:-1]] = False
        wanted[index[used]] = True
        after = np.flatnonzero(wanted)
        index = (np.cumsum(wanted) - 1)[index]
        index[starts[:-1]] = len(after) + np.arange(len(texts))
        values, begins, lengths = self._words(coded.dictionary.take(pa.array(after)).to_pylist())
        alone = [self._one(t) for t in whole]
        more = np.fromiter(map(len, alone), np.int64, len(alone))
        begins = np.concatenate([begins, len(values) + np.cumsum(more) - more])
        lengths = np.concatenate([lengths, more])
        values = np.concatenate([values, *alone])
        own = lengths[index]
        ends = np.cumsum(own)
        ids = values[np.repeat(begins[index] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        borders = np.concatenate([[0], ends])[starts].tolist()
        return [ids[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]


def ids_with_special(encode: WordIds, texts: pa.Array, special: Mapping[str, int]) -> list[bytes]:
    """Ids of texts in which strings of special tokens are these tokens, of the strings at one place the longest."""
    pattern = "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))
    odd = pc.match_substring_regex(texts, pattern).to_pylist() if special else [False] * len(texts)
    if not any(odd):
        return encode(texts)
    parts, counts = [], []
    for text, has in zip(texts.to_pylist(), odd, strict=True):
        own = re.split(f"({pattern})", text) if has else [text]
        parts += own
        counts.append(len(own))
    ids = iter(encode(pa.array(["" if p in special else p for p in parts], pa.string())))
    marks = (np.asarray([special[p]], "<u4").tobytes() if p in special else None for p in parts)
    found = [plain if mark is None else mark for plain, mark in zip(ids, marks, strict=True)]
    ends = np.cumsum([0, *counts]).tolist()
    return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def binary_pieces(tokens: int, sequence: int) -> Iterator[tuple[int, int]]:
    """``(start, length)``: whole sequences, then the binary digits of the rest, largest first."""
    start = 0
    while tokens - start >= sequence:
        yield start, sequence
        start += sequence
    rest = tokens - start
    while rest:
        length = 1 << (rest.bit_length() - 1)
        yield start, length
        start, rest = start + length, rest - length


def _packer(ranks: str, pattern: str, special: Mapping[str, int], sequence: int, end_id: int, with_ids: bool, placed: bool):
    def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordIds.of(ranks, pattern)
        end = np.asarray([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 33
        for table in text_batches(tables):
            rows: list[tuple] = []
            docs, places = table.column(0).to_pylist(), table.column(2).to_pylist()
            for doc, ids, place in zip(docs, ids_with_special(encode, table.column(1), special), places, strict=True):
                if placed:
                    next_id = place << _PIECE_BITS
                ids += end
                tokens = len(ids) // 4
                for start, length in binary_pieces(tokens, sequence):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(own), tokens, next_id, own if with_ids else None))
                    next_id += 1
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*rows, strict=True)] or [[]] * 7
        doc, start, length, crc, tokens, sequence_id, own = columns
        arrays = [
            pa.array(doc, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array(sequence_id, pa.int64()),
            pa.array([0] * len(doc), pa.int64()),
            pa.array([n.bit_length() - 1 for n in length], pa.int32()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
        if with_ids:
            values = pa.array(np.frombuffer(b"".join(own), "<u4").astype("int32"))
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), values))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    return pack


def pack_documents(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    special: Mapping[str, int] = SPECIAL,
    with_ids: bool = True,
    place: str | None = None,
) -> DataFrame:
    """One row per piece of a document, each a sequence of its own.

    A document's ids, ``end_id`` last, are cut into as many whole sequences as they fill and the
    binary digits of what is left: at most log2(``sequence``) further pieces, each as long as a
    power of two, hence none padded.  ``bucket`` is the logarithm of a piece's length; batches are
    made of pieces of one bucket.  ``sequence`` must be a power of two, ``ranks`` the path of
    a byte-level vocabulary (one token in base 64 and its rank a line) that every executor has, and
    ``pattern`` what divides texts before it.  Strings of ``special`` tokens in a text have these ids.

    Null and empty texts are the one id ``end_id``.  Null ids and repeated ones are kept: every row
    is packed for itself.  Other columns are not read.  An empty table gives no rows.

    Documents are independent, so there is no shuffle; memory is one batch of rows and the worker's
    bounded store of ids.  Sequence ids are unique: a task's number, then a count.  With ``place``,
    a column of whole numbers from 0 that no two rows share, they rise with it, then within the
    document, however the rows are dealt over tasks.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
    ) + (", ids array<int>" if with_ids else "")
    at = F.lit(0) if place is None else c(place)
    return docs.select(c(doc_id).cast("long"), whole_text(text), at.cast("long").alias("place")).mapInArrow(
        _packer(ranks, pattern, special, sequence, end_id, with_ids, place is not None), schema
    )


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write packed pieces with one folder per length, the form in which batches are drawn."""
    pieces.write.partitionBy("bucket").parquet(folder)
