"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import c, free_name, text_slices, whole_text
from tablewright.workspace import written

#: Letters of the longest n-gram; up to 3 fit one number each.
LONGEST = 3
#: N-grams in the profile of a language and of a document.
RANKS = 400
#: Languages a model may have; more are refused, not left out.
LANGUAGES = 2_000
#: Prediction for texts without letters.
UNKNOWN = "und"
#: Distinct n-grams a task counts between two reports: this bounds its memory and changes no count.
HELD = 1_000_000
#: Longer texts, in words, are counted word by distinct word.
_LONG = 50_000

_BITS = 21
_LAST = np.int64((1 << 32) - 1)
_NO_LETTERS = r"[^\p{L}]+"


def word_grams(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words, one word's after the other's, and how many each has.

    Words have a space at either end, which is part of their n-grams but no n-gram by itself.  An
    n-gram is the code points of its letters, 21 bits each, the first highest: numbers are ordered like the
    n-grams themselves.
    """
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.flatnonzero(letters != 32)
    last = np.cumsum(sizes)
    shapes = [letters << 2 * _BITS]
    if longest > 1:
        # At a letter stands the pair that it ends; the pair of the last letter and the space comes on top.
        shapes.append(np.concatenate([[0], letters[:-1] << 2 * _BITS | letters[1:] << _BITS]))
    if longest > 2:
        shapes.append(np.concatenate([[0], letters[:-2] << 2 * _BITS | letters[1:-1] << _BITS | letters[2:], [0]]))
    more = (sizes > 0).astype(np.int64) if longest > 1 else np.zeros(len(sizes), np.int64)
    lengths = longest * sizes + more
    out = np.empty(int(lengths.sum()), np.int64)
    begins = np.arange(len(at)) * longest + np.repeat(np.cumsum(more) - more, sizes)
    for k, shape in enumerate(shapes):
        out[begins + k] = shape[at]
    if longest > 1:
        ends = last[sizes > 0] - 1
        out[begins[ends] + longest] = letters[at[ends]] << 2 * _BITS | 32 << _BITS
    return out, lengths


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each text's words begin and end, the number of each word, and the distinct words."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), _NO_LETTERS, " ")
    split = pc.split_pattern(letters, " ")
    coded = split.values.dictionary_encode()
    return split.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each of ``index`` its own values, one after the other."""
    own = lengths[index]
    ends = np.cumsum(own)
    return values[np.repeat(starts[index] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]


class Slice:
    """The n-grams of some texts: ``kinds``, sorted, and each text's as numbers of kinds."""

    def __init__(self, texts: pa.Array, longest: int) -> None:
        self._borders, self._index, dictionary = _words(texts)
        grams, self._lengths = word_grams(dictionary.to_pylist(), longest)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self.kinds, number = np.unique(grams, return_inverse=True)
        self._number = number.astype(np.int32)

    def counts(self, text: int) -> tuple[np.ndarray, np.ndarray]:
        """The kinds in a text, ascending, and how often each comes."""
        words = self._index[self._borders[text] : self._borders[text + 1]]
        if len(words) <= _LONG:
            numbers = _spread(self._number, self._starts, self._lengths, words)
            if len(self.kinds) > 8 * len(numbers):
                return np.unique(numbers, return_counts=True)
            total = np.bincount(numbers, minlength=len(self.kinds))
            found = np.flatnonzero(total)
            return found, total[found]
        words, times = np.unique(words, return_counts=True)
        total = np.zeros(len(self.kinds), np.int64)
        for at in range(0, len(words), _LONG):
            own = words[at : at + _LONG]
            weights = np.repeat(times[at : at + _LONG], self._lengths[own])
            np.add.at(total, _spread(self._number, self._starts, self._lengths, own), weights)
        found = np.flatnonzero(total)
        return found, total[found]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by n-gram."""
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    kinds, number = np.unique(grams, return_inverse=True)
    return kinds, np.bincount(number, counts, len(kinds)).astype(np.int64)


def _counter(longest: int):
    """Counts of n-grams by language, summed over as many texts as memory for them allows."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for table in tables:
            for start, end in text_slices(table.column(1), 2 << 20):
                own = Slice(table.column(1).slice(start, end - start), longest)
                for text, lang in enumerate(table.column(0).slice(start, end - start).to_pylist()):
                    kinds, counts = own.counts(text)
                    held.setdefault(lang, []).append((own.kinds[kinds], counts))
                    size += len(kinds)
                    if size > HELD:
                        held = {k: [_merged(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD // 2:
                            yield from _rows(held)
                            held, size = {}, 0
        yield from _rows({k: [_merged(v)] for k, v in held.items()})

    return count


def _rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, [(grams, counts)] in held.items():
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(grams), np.int32)), [lang]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs, pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])


@dataclass(frozen=True)
class RankProfiles:
    """The most frequent n-grams of each language, by rank from 0."""

    languages: tuple[str, ...]
    #: For each n-gram in ``grams``, ascending: the languages that rank it, from ``starts`` on.
    grams: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    ranks: np.ndarray
    longest: int
    length: int

    def distances(self, own: Slice, text: int) -> tuple[np.ndarray, int]:
        """Out-of-place distances to all languages, and the greatest they can be.

        A document's most frequent n-grams, of equal counts the least first, are compared with
        each profile: an n-gram is as far off as its ranks differ, and one that a profile lacks
        as far as the profile is long.
        """
        kinds, counts = own.counts(text)
        score = counts << 32 | (_LAST - kinds)
        if len(score) > self.length:
            score = score[np.argpartition(score, -self.length)[-self.length :]]
        score = np.sort(score)[::-1]
        grams = own.kinds[_LAST - (score & _LAST)]
        worst = len(grams) * self.length
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        rank = np.arange(len(grams))
        if len(self.grams):
            known = self.grams[at] == grams
            at, rank = at[known], rank[known]
        else:
            at, rank = at[:0], rank[:0]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        hits = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        nearer = self.length - np.abs(self.ranks[hits] - np.repeat(rank, lengths))
        return worst - np.bincount(self.owners[hits], nearer, len(self.languages)).astype(np.int64), worst

    def predict(self, own: Slice, text: int) -> tuple[str, float]:
        """The nearest language (of equally near ones the first by name), and how much nearer it is than the next."""
        distances, worst = self.distances(own, text)
        if not worst or not len(distances):
            return UNKNOWN, 0.0
        best = int(np.argmin(distances))
        least = distances[best]
        others = np.delete(distances, best)
        second = others.min() if len(others) else worst
        return self.languages[best], float((second - least) / second) if second else 0.0


def fit_languages(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    length: int = RANKS,
    languages: int = LANGUAGES,
) -> RankProfiles:
    """Profiles of the languages that ``docs`` name: their most frequent n-grams of letters.

    Texts are lower-cased; words are runs of letters with a space at either end.  All documents with a
    language count, whole, and long ones for more than short ones; ties go to the lesser n-gram.
    Repeated rows count each.  Null languages and null or empty texts are left out.

    N-grams are counted in tasks and summed by language and n-gram; each task then names its most
    frequent ones.  What comes to the driver is ``length`` rows for each of at most ``languages``
    languages; more are an error.
    """
    if length < 1:
        raise ValueError("a profile has one n-gram at least")
    if not 1 <= longest <= 3:
        raise ValueError("n-grams have one to three letters")
    rows = docs.select(c(lang).cast("string").alias("lang"), c(text).cast("string").alias("text"))
    counted = (
        rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(_counter(longest), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = written(
        counted.withColumn("rank", F.row_number().over(by_count) - 1).filter(F.col("rank") < length), "profiles"
    )
    found = top.select("lang").distinct().count()
    if found > languages:
        raise ValueError(f"{found} languages are more than the {languages} that a model may have")
    own = top.select("lang", "gram", "rank").collect()
    names = sorted({r["lang"] for r in own})
    number = {n: k for k, n in enumerate(names)}
    table = np.array([(r["gram"], number[r["lang"]], r["rank"]) for r in own], np.int64).reshape(-1, 3)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    grams, first = np.unique(table[:, 0], return_index=True)
    return RankProfiles(
        tuple(names), grams, np.append(first, len(table)).astype(np.int64), table[:, 1], table[:, 2], longest, length
    )


def _predictor(model: RankProfiles):
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for start, end in text_slices(texts, 2 << 20):
            own = Slice(texts.slice(start, end - start), model.longest)
            for text in range(end - start):
                lang, score = model.predict(own, text)
                langs.append(lang)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(predict, "lang string, score double")


def identify_languages(docs: DataFrame, model: RankProfiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    A document's ``length`` most frequent n-grams are ranked and compared with every profile; the
    language with the least out-of-place distance is predicted.  ``score`` is by what share of its
    distance the next language is farther off: 0 for a tie, 1 for a perfect match.

    Null texts, texts without letters and all texts under a model of no language are ``und`` with
    score 0.  Columns named like the new ones are replaced; repeated rows are judged alike; an empty
    table gives an empty one.  No shuffle; the model goes to every task and has at most ``length``
    entries for each of a bounded number of languages.
    """
    new = ("lang_pred", "score")
    found = free_name(docs, "language")
    return docs.withColumn(found, _predictor(model)(whole_text(text))).select(
        *[c(n) for n in docs.columns if n.lower() not in new],
        F.col(f"`{found}`.lang").alias(new[0]),
        F.col(f"`{found}`.score").alias(new[1]),
    )


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether the CRC-32 of an id's decimal text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder
