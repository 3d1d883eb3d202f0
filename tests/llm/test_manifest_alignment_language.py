"""Manifest, token alignment and language identification against plain versions."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tablewright.llm import lockstep_alignment as la
from tablewright.llm import merkle_strings as ms
from tablewright.llm import queries, shared
from tablewright.llm import rank_profiles as rp

GIVEN = "/root/testdata/sf0.01"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
given = pytest.mark.skipif(not os.path.exists(GIVEN), reason="no test tables")


@pytest.fixture(autouse=True)
def _importable(spark):
    shared.importable(spark)


# --- manifest ----------------------------------------------------------------------------------------


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes, arity=8):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            j, run = at[i] % arity, nodes[at[i] // arity * arity :][:arity]
            path.append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[i] //= arity
        nodes = [_h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def _plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for key in keys:
        own = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((own, *_tree([_leaf(r) for r in own])))
    root, higher = _tree([sub for _, sub, _ in trees])
    out = []
    for (own, sub, paths), above in zip(trees, higher, strict=True):
        for row, path in zip(own, paths, strict=True):
            folded = leaf = _leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                folded = _leaf((*row[:4], "".join(x.lower() if "A" <= x <= "Z" else x for x in row[4])))
            for left, right in path + above:
                folded = _h(left + folded + right)
            proof = _h("".join(a + b for a, b in path + above))
            out.append((row[0], leaf, sub, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_manifest_agrees_with_the_plain_one(spark):
    langs = ["a", None, "b", "é", "Z", ""]
    rows = [(i if i % 7 else None, "s", langs[min(i % 40, 5)], i, f"Text {i % 50}" if i % 3 else None) for i in range(900)]
    rows += [(5, "s", "a", 1, "Same")] * 20 + [(5, "s", "a", 1, ""), (-3, None, "a", None, "x" * 200_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit("clash")).withColumn("tree", F.lit(1))
    assert sorted((tuple(r) for r in ms.tamper_check(docs).collect()), key=repr) == _plain_manifest(rows)


def test_manifest_of_many_small_trees_and_of_none(spark):
    rows = [(i, "s", f"lang{i % 70}", 1, "t") for i in range(140)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((tuple(r) for r in ms.tamper_check(docs).collect()), key=repr) == _plain_manifest(rows)
    assert ms.tamper_check(docs.limit(0)).collect() == []
    small = ms.merkle_manifest(docs, arity=2, levels=2).select("leaf", "root", ms.fold(F.col("leaf"), F.col("path")).alias("f"))
    assert all(r.f == r.root for r in small.collect())


# --- alignment -----------------------------------------------------------------------------------------


def _byte_letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    out.update({chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in keep)})
    return out


def _plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of, letters = SentencePieceProcessor(model_file=queries.PIECE_MODEL), _byte_letters()
    piece = lambda i: b_of.id_to_piece(i)
    aligned, counts = [], Counter()
    for i, text in rows:
        ids_a, ids_b, groups = [], [], []
        if text:
            ids_a, ids_b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        bytes_a = [bytes(letters[x] for x in a_of.id_to_token(t)) for t in ids_a]
        bytes_b = [bytes([int(piece(t)[1:-1], 16)]) if b_of.is_byte(t) else piece(t).replace("▁", " ").encode() for t in ids_b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = [sum(map(len, bytes_a[: k + 1])) for k in range(len(ids_a))] if len(ids_a) < 300 else _ends(bytes_a)
        ends_b = _ends(bytes_b)
        at_a = at_b = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            groups.append((ids_a[at_a:to_a], ids_b[at_b:to_b], end))
            at_a, at_b = to_a, to_b
        aligned.append((i, ids_a, ids_b, groups))
        counts.update({(p, q) for a, b, _ in groups for p in a for q in b})
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for i, ids_a, ids_b, groups in aligned:
        links = [(p, q) for a, b, _ in groups for p in a for q in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        sums = sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), *sums, _h(text) if groups else ""))
    return sorted(out, key=repr), counts, aligned


def _ends(parts):
    out, at = [], 0
    for part in parts:
        at += len(part)
        out.append(at)
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "x<|endoftext|>y <s> <0x41>"), (6, "  two  spaces \n\t\r\n tabs "),
    (None, "😀é 漢字 " * 500), (7, "é\u200d  z"), (7, "1234567890" * 300), (7, "same"), (7, "same"), (8, "a" * 7_000),
    (9, "\x00\x01"), (10, "word " * 6_000), (11, "▁"),
]


def _align(docs):
    return la.align_tokens(docs, queries.BYTE_RANKS, queries.BYTE_PATTERN, queries.PIECE_MODEL)


def test_alignment_of_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("batch", F.lit("x"))
    wanted, counts, aligned = _plain_alignment(ODD)
    found, listed = _align(docs)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == wanted
    assert {(r.id_a, r.id_b): r.n_docs for r in listed.collect()} == dict(counts)
    groups = la.token_groups(docs, queries.BYTE_RANKS, queries.BYTE_PATTERN, queries.PIECE_MODEL).collect()
    plain = [(i, [(a, b, end) for a, b, end in own]) for i, _, _, own in aligned]
    assert sorted(((r.doc_id, [(g.a, g.b, g.end) for g in r.groups]) for r in groups), key=repr) == sorted(plain, key=repr)
    assert all(t.count() == 0 for t in _align(docs.limit(0)))


def test_many_links_in_a_group_are_counted_by_distinct_ids():
    import numpy as np

    ids_a, ids_b = np.arange(400) % 3, np.arange(399) % 2
    sizes_a, sizes_b = np.array([2, 2, 2]), np.array([2, 2])
    batch = la.Batch([np.append(ids_a, 0)], [np.append(ids_b, [0, 0])], sizes_a, sizes_b)
    batch.ends_a, batch.ends_b = np.arange(401) * 2 + 1, np.arange(401) * 2
    batch.ends_a[-1] = batch.ends_b[-1]
    groups, pairs, links, times = batch.aligned()
    assert len(groups) == 1 and times.sum() == 401 * 401 > la._MANY and len(pairs) == 6


@pytest.mark.parametrize("at_once, many", [(1, 1 << 16), (5, 4), (1 << 20, 0)])
def test_links_written_out_in_parts_are_those_of_plain_loops(monkeypatch, at_once, many):
    import numpy as np

    monkeypatch.setattr(la, "_AT_ONCE", at_once)
    monkeypatch.setattr(la, "_MANY", many)
    sizes_a, sizes_b = np.array([1, 2, 3, 1]), np.array([2, 1, 4])
    ids_a = [np.array(x, np.int64) for x in ([0, 1, 2, 3, 3, 1], [], [2, 2, 2, 0, 3, 0], [1])]
    ids_b = [np.array(x, np.int64) for x in ([1, 0, 2, 1, 0], [], [2, 2, 0, 0], [1, 1])]
    batch = la.Batch(ids_a, ids_b, sizes_a, sizes_b)
    groups, pairs, links, times = batch.aligned()
    wanted = Counter()
    for a0, a1, b0, b1 in groups.tolist():
        text = int(np.searchsorted(batch.starts_a, a0, "right")) - 1
        wanted.update((text, a, b) for a in batch.a[a0:a1].tolist() for b in batch.b[b0:b1].tolist())
    assert (np.diff(pairs) > 0).all() and groups[:, 0].tolist() == [0, *groups[:-1, 1].tolist()]
    found = [(t, int(pairs[n] >> 32), int(pairs[n] & 0xFFFFFFFF)) for t, n in links.tolist()]
    assert found == sorted(wanted) and dict(zip(found, times.tolist(), strict=True)) == wanted


@given
def test_alignment_of_a_given_table(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text")
    wanted, _, _ = _plain_alignment([tuple(r) for r in docs.collect()])
    assert sorted((tuple(r) for r in _align(docs)[0].collect()), key=repr) == wanted


# --- languages ------------------------------------------------------------------------------------------


def _grams(text):
    out = Counter()
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        word = f" {word} "
        out.update(word[1:-1])
        out.update(word[i : i + 2] for i in range(len(word) - 1))
        out.update(word[i : i + 3] for i in range(len(word) - 2))
    return out


def _plain_languages(learned, texts, length):
    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:length]]
    totals = {}
    for lang, text in learned:
        if lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(_grams(text))
    profiles = {k: {g: i for i, g in enumerate(top(v))} for k, v in sorted(totals.items()) if v}
    out = []
    for text in texts:
        own = top(_grams(text))
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        far = {k: sum(abs(i - p[g]) if g in p else length for i, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        second = min([far[k] for k in far if k != best], default=len(own) * length)
        out.append((best, (second - far[best]) / second if second else 0.0))
    return out


def test_languages_agree_with_the_plain_distances(spark, monkeypatch):
    monkeypatch.setattr(rp, "HELD", 40)
    learned = [
        ("en", "the cat and the dog THE end"), ("de", "der Hund und die Katze, ende"), ("xx", "ÄÖ äö 漢字 漢"), (None, "zzz"),
        ("en", None), ("yy", "12 .. 3"), ("", "q q q"),
    ]
    texts = ["the hound", "die Hunde", None, "", " 12 _²Ⅷ", "漢字", "zzz qq", "a", "the hound", "é " * 60_000 + "the", "ẞİ x"]
    schema = "lang string, text string, score int"
    model = rp.fit_languages(spark.createDataFrame([(*r, 1) for r in learned], schema), length=20)
    docs = spark.createDataFrame([("no", t, 1) for t in texts], schema)
    for length in (20,):
        found = rp.identify_languages(docs, model).collect()
        assert [(r.lang_pred, r.score) for r in found] == _plain_languages(learned, texts, length)
    assert model.languages == ("", "de", "en", "xx")
    none = rp.fit_languages(docs.limit(0))
    assert [(r.lang_pred, r.score) for r in rp.identify_languages(docs, none).collect()] == [("und", 0.0)] * len(texts)
    with pytest.raises(ValueError, match="languages"):
        rp.fit_languages(spark.createDataFrame([(*r, 1) for r in learned], schema), languages=2)


@given
def test_held_out_documents_of_a_given_table(spark):
    rows = queries.REGISTRY["op13_language_id"].run(spark, GIVEN).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang").collect()}
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in own) > 0.98 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)
