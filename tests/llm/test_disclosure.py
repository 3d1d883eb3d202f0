"""Telling words against a plain count of documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tablewright.llm import disclosure as di
from tablewright.llm import shared


@pytest.fixture(autouse=True)
def _importable(spark):
    shared.importable(spark)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _plain(rows, smoothing=di.SMOOTHING, generalise_at=di.GENERALISE_AT, remove_at=di.REMOVE_AT):
    """For each row its added spans; rows that repeat are one document."""
    docs = {(i, t or "") for i, t in rows}
    words, entities = {}, {}
    for doc in docs:
        text = doc[1]
        spans = di.personal_spans(text)
        entities[doc] = set(di._entities(text, spans))
        covered = {x for a, _, b in spans for x in range(a, b)}
        found = [m for m in re.finditer(r"\w+", text)]
        own = [m for m in found if not covered & set(range(*m.span()))]
        words[doc] = ({m.group().lower() for m in found}, own)
    total = len(docs)
    of_term = Counter(w for all_of, _ in words.values() for w in all_of)
    of_entity = Counter(e for own in entities.values() for e in own)
    both = Counter((e, w) for doc in docs for e in entities[doc] for w in {m.group().lower() for m in words[doc][1]})
    out = []
    for i, t in rows:
        doc, kinds = (i, t or ""), {}
        for entity in entities[doc]:
            for word in {m.group().lower() for m in words[doc][1]}:
                n, t_all = of_entity[entity], of_term[word] / total
                if n == total:
                    continue
                told = math.log((both[entity, word] + smoothing * t_all) / (n + smoothing) / t_all) / math.log(total / n)
                if told >= generalise_at:
                    kinds[word] = max(kinds.get(word, ""), di.ADDED[told >= remove_at])
        out.append((i, t or "", [(m.start(), kinds[w], m.end()) for m in words[doc][1] if (w := m.group().lower()) in kinds]))
    return sorted(out, key=repr)


def _found(spark, rows, **options):
    texts = {}
    for i, t in rows:
        texts[shared_key(i, t)] = t or ""
    found = di.find_personal(_frame(spark, rows), **options).collect()
    return sorted(((r.id, [(s.start, s.kind, s.end) for s in r.added]) for r in found), key=repr)


def shared_key(i, t):
    return i, t or ""


def test_added_spans_agree_with_the_plain_count(spark):
    rng = random.Random(5)
    pool = [f"word{k}" for k in range(60)] + ["Kim", "zyxwv", "the", "of"]
    people = [f"p{k}@mail.example.com" for k in range(12)] + ["10.0.0.7", "+49 30 1234567890"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(pool) if rng.random() < 0.9 else f"own{i}x{rng.randint(0, 2)}" for _ in range(rng.randint(0, 25)))
        if rng.random() < 0.4:
            text += " ".join(["", *rng.sample(people, rng.randint(1, 4))]) + " " + rng.choice(pool)
        rows.append((i, text))
    rows += [rows[3]] * 20 + [(None, "null id a@b.example.org hidden")] * 3 + [(500, None), (501, "")]
    for at in (0.8, 0.4):
        got = _found(spark, rows, generalise_at=at)
        assert got == sorted(((i, own) for i, _, own in _plain(rows, generalise_at=at)), key=repr)
    assert any(own for _, own in got)


def test_repeated_rows_are_one_document(spark):
    plain = [(k, f"filler text number{k}") for k in range(60)]
    secret = (99, "secret zyxwv wrote from ann.lee@mail.example.com")
    once = dict((i, own) for i, own in _found(spark, [secret, *plain]))[99]
    often = [own for i, own in _found(spark, [secret] * 20 + plain) if i == 99]
    assert once and often == [once] * 20


def test_a_document_of_many_entities_and_words_makes_no_pairs_of_all(spark, monkeypatch):
    text = " ".join(f"own{k}word p{k}@mail.example.com" for k in range(2_000))
    counted = {}
    keep = di.written
    monkeypatch.setattr(di, "written", lambda df, name: counted.setdefault(name, keep(df, name)))
    found = di.find_personal(_frame(spark, [(0, text), *[(k, f"filler number{k}") for k in range(1, 100)]])).collect()
    assert counted["personal-classes"].count() == 1
    assert counted["personal-pairs"].count() == 2_000
    assert len(next(r for r in found if r.id == 0).added) == 2_000


def test_long_parts_of_addresses():
    text = "1.2.3." + "0" * 5_000 + "1 and 1.2.3." + "9" * 5_000
    assert di.personal_spans(text) == [(0, "ip", 5_007)]
