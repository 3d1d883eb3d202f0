"""Token counts under a unigram model, sharing work between words through a trie."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import c, free_name, text_slices, whole_text

#: What marks the start of a word in the vocabulary.
MARK = "▁"
#: Words whose counts a worker keeps; this bounds its memory and changes no count.
WORDS = 500_000
#: Longer words are counted without being kept.
_LONG_WORD = 64
_TOKENS = (1 << 40) - 1

_WORKER: dict[str, WordTrie] = {}


def unigram_costs(model: str) -> dict[str, int]:
    """Costs of a vocabulary's pieces from their ranks: 1000 ln(rank + 1), Zipf's law.

    ``model`` is the path of a sentencepiece file; its control, unknown and byte pieces are no
    pieces of words.  Costs are integers, so that sums are the same in any order.
    """
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=model)
    special = lambda i: pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i)
    own = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size()) if not special(i)]
    return {p: round(1000 * math.log(rank + 1)) for rank, p in enumerate(own, 1)}


class Vocabulary:
    """The pieces as an automaton: from the letters read so far to the pieces that end there.

    States are the prefixes of pieces.  ``ends[state]`` lists ``(length, cost)`` of all pieces that
    are suffixes of what was read, so no suffix that is no piece is looked at.
    """

    def __init__(self, costs: Mapping[str, int]) -> None:
        self.longest = max(map(len, costs), default=1)
        self._byte = _score(round(1000 * math.log(len(costs) + 2)), 1)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self._fall = [0]
        self._fallback: dict[str, int] = {}
        for piece, cost in costs.items():
            state = 0
            for letter in piece:
                state = self.next[state].setdefault(letter, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.ends.append(())
                    self._fall.append(0)
            self.ends[state] = ((-len(piece), _score(cost, 1)),)
        queue = list(self.next[0].values())
        for state in queue:  # grows while it is read: breadth first
            for letter, below in self.next[state].items():
                self._fall[below] = self._after(self._fall[state], letter)
                queue.append(below)
            self.ends[state] += self.ends[self._fall[state]]

    def _after(self, state: int, letter: str) -> int:
        while True:
            found = self.next[state].get(letter)
            if found is not None:
                return found
            if not state:
                return 0
            state = self._fall[state]

    def fallback(self, letter: str) -> int:
        """What a letter costs as single bytes."""
        found = self._fallback.get(letter)
        if found is None:
            found = self._byte * len(letter.encode("utf-8", "replace"))
            if len(self._fallback) < 100_000:
                self._fallback[letter] = found
        return found

    def extend(self, states: list[int], scores: list[int], letters: str) -> None:
        """Go down one path: append the state and the forward score after each letter."""
        state, after, ends, fallback = states[-1], self._after, self.ends, self.fallback
        for letter in letters:
            state = after(state, letter)
            best = scores[-1] + fallback(letter)
            for back, own in ends[state]:
                found = scores[back] + own
                if found < best:
                    best = found
            states.append(state)
            scores.append(best)


def _score(cost: int, tokens: int) -> int:
    """Cost first, tokens second, in one number, so that scores are added and compared as such."""
    return cost << 40 | tokens


class WordTrie:
    """Forward scores of words, computed once for every prefix that words share.

    The distinct words form a trie whose nodes are prefixes.  A node's score is the least cost of
    its prefix, with the fewest tokens that reach it, and follows from the nodes above it.  The
    trie is walked depth first, which is the order of the sorted words, so only the path to the
    current node is held.  Terminal counts are kept for words that come again.  A character outside
    the vocabulary costs one token per byte, each dearer than any piece.
    """

    def __init__(self, costs: Mapping[str, int], most: int = WORDS) -> None:
        self.vocabulary = Vocabulary(costs)
        self.most = most
        self.nodes = 0
        self.counts: dict[str, int] = {}

    @staticmethod
    def of(model: str) -> WordTrie:
        if model not in _WORKER:
            _WORKER[model] = WordTrie(unigram_costs(model))
        return _WORKER[model]

    def count(self, words: Sequence[str]) -> list[int]:
        """Tokens of the cheapest split of each word (of those, the fewest); none for no word."""
        if len(self.counts) > self.most:
            self.counts = {}
        found, extend = self.counts, self.vocabulary.extend
        states, scores, last = [0], [0], MARK
        extend(states, scores, MARK)
        long = {}
        for word in sorted(w for w in words if w not in found):
            if len(word) > _LONG_WORD:
                long[word] = self._count_long(word)
                continue
            shared = 0
            for a, b in zip(word, last[1:]):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del states[shared + 2 :], scores[shared + 2 :]
            extend(states, scores, word[shared:])
            self.nodes += len(word) - shared
            found[word] = scores[-1] & _TOKENS
            last = MARK + word
        found[""] = 0
        return [found[w] if w in found else long[w] for w in words]

    def _count_long(self, word: str) -> int:
        """By the same recurrence, with no more scores than pieces reach back."""
        states, scores = [0], [0]
        for at in range(0, len(word) + 1, 1000):
            self.vocabulary.extend(states, scores, (MARK + word)[at : at + 1000])
            del states[:-1], scores[: -self.vocabulary.longest - 1]
        return scores[-1] & _TOKENS


def _counter(model: str):
    def count(texts: pa.Array) -> pa.Array:
        trie = WordTrie.of(model)
        words, tokens = [], []
        for start, end in text_slices(texts):
            split = pc.utf8_split_whitespace(texts.slice(start, end - start))
            coded = split.values.dictionary_encode()
            own = np.asarray(trie.count(coded.dictionary.to_pylist()), np.int64)
            known = np.concatenate([[0], np.cumsum(own[coded.indices.to_numpy()])])
            real = np.concatenate([[0], np.cumsum((own > 0)[coded.indices.to_numpy()])])
            borders = split.offsets.to_numpy()
            tokens.append(np.diff(known[borders]))
            words.append(np.diff(real[borders]))
        arrays = [pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (words, tokens)]
        return pa.StructArray.from_arrays(arrays, ["n_words", "n_tokens"])

    return F.arrow_udf(count, "n_words long, n_tokens long")


def count_tokens(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``.

    Pre-tokens are what white space divides, each with a mark before it.  A pre-token has as many
    tokens as its cheapest split into pieces of the vocabulary at ``model``, a path that every
    executor has; among splits of equal cost the one with the fewest.  Distinct pre-tokens go into
    the worker's trie, which is begun anew when it is full.

    Null, empty and blank texts have no words and no tokens.  Columns named like the new ones are
    replaced; repeated rows are counted alike; an empty table gives an empty one.  No shuffle.
    """
    new = ("n_words", "n_tokens")
    counted = free_name(docs, "token_counts")
    return docs.withColumn(counted, _counter(model)(whole_text(text))).select(
        *[c(n) for n in docs.columns if n.lower() not in new],
        *[F.col(f"`{counted}`.{n}").alias(n) for n in new],
    )
