"""Line dedup, personal data, packing, quality, token counts, URLs and mixing."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import additive_quality as aq
from tablewright.llm import binary_packing as bp
from tablewright.llm import disclosure as di
from tablewright.llm import line_dedup as ld
from tablewright.llm import pfair, queries, shared
from tablewright.llm import trie_counts as tc
from tablewright.llm import url_terms as ut

GIVEN = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _importable(spark):
    shared.importable(spark)


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOCS)


# --- lines -------------------------------------------------------------------------------------


def _cleaned(rows, min_length=5, min_docs=3):
    """The rule for lines, plainly."""
    key = lambda line: line.strip(" \t\n\v\f\r").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    holders: dict[str, set] = {}
    order = lambda i: -(2**63) if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_length:
                holders.setdefault(key(line), set()).add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == order(i)
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_agree_with_the_plain_rule(spark):
    rng = random.Random(1)
    pool = ["Common line", " common LINE\t", "other thing", "ÉÉÉÉÉ", "ééééé", "tiny", "", "\x1fodd line", "x" * 5000]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", str(i)]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(None, "common line\nalone"), (3, "common line\nnew"), (3, "common line\nnew"), (41, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_keys", F.lit(1))
    found = ld.drop_repeated_lines(df, min_length=5, min_docs=3, batches=3, fan_in=2)
    assert found.columns == ["doc_id", "text", "line_keys", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=repr)
    assert got == _cleaned(rows)


def test_lines_of_an_empty_table(spark):
    assert ld.drop_repeated_lines(_docs(spark, []), counts=False).collect() == []


def test_runs_are_compacted_and_hold_each_key_once(spark):
    runs = ld.LineRuns(spark, fan_in=2)
    for batch in range(5):
        rows = [(bytes([k]), batch * 10 + d) for k in range(batch, batch + 3) for d in range(2)]
        runs.add(spark.createDataFrame(rows, "key binary, doc_id long"))
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) > 1
    held = [bytes(r.key) for name in runs.runs() for r in spark.table(name).collect()]
    assert len(held) == len(set(held)) == 7
    repeated = {bytes(r.key): r.last_doc for r in runs.repeated(6).collect()}
    assert repeated == {bytes([2]): 21, bytes([3]): 31, bytes([4]): 41}
    joined = spark.table(runs.runs()[0]).join(spark.table(runs.runs()[-1]).select("key"), "key", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    runs.drop()


# --- personal data ---------------------------------------------------------------------------------


def _plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(x) for x in m.group() if x in "0123456789"][::-1]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(x in "0123456789" for x in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, di.KINDS[k], b) for a, k, b in sorted(out)]


def test_patterns_agree_with_the_plain_ones():
    rng = random.Random(2)
    for letters in ("a.@1 2-+(9)5é", "0123456789 -", "a.b@c", "+1 ()23.4-"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            assert di.personal_spans(text) == _plain_spans(text), text


def test_patterns_are_linear_on_long_texts():
    for text in ("a" * 300_000, "9" * 300_000, "1." * 150_000, "@a" * 100_000, "+1" + "(" * 300_000):
        di.personal_spans(text)


def test_revealing_words_are_found_near_their_entity_only(spark):
    secret = "secret zyxwv wrote from ann.lee@mail.example.com about something"
    texts = [secret] * 4 + [f"nothing here but something and about number{i}" for i in range(30)] + ["zyxwv", None, ""]
    found = di.find_personal(_docs(spark, texts)).collect()
    added = {r.id: {texts[r.id][s.start : s.end]: s.kind for s in r.added} for r in found if r.id < 34}
    assert added[0]["wrote"] == "remove" and added[0]["zyxwv"] == "generalise" and "something" not in added[0]
    assert all(not x for i, x in added.items() if i >= 4)
    first = next(r for r in found if r.id == 0)
    assert [(s.kind, texts[0][s.start : s.end]) for s in first.spans] == [("email", "ann.lee@mail.example.com")]
    assert len(found) == len(texts) and all(not r.spans for r in found if r.id >= 4)
    safe = di.sanitise(_docs(spark, texts)).orderBy("doc_id").collect()
    assert "ann.lee" not in safe[0].text and "zyxwv" not in safe[0].text and "[email]" in safe[0].text
    assert safe[10].text == texts[10] and safe[35].text == "" and safe[0].lang == "en"


def test_words_of_a_single_document_are_evidence(spark):
    texts = ["mail zyxwv about it: ann.lee@mail.example.com"] + [f"mail about number{i}" for i in range(200)]
    found = {r.id: r for r in di.find_personal(_docs(spark, texts)).collect()}
    assert {texts[0][s.start : s.end]: s.kind for s in found[0].added}.get("zyxwv") in di.ADDED
    assert not any(texts[0][s.start : s.end] in ("mail", "about") for s in found[0].added)
    # The same word tells less of an entity when fewer documents show it.
    total, term = 1000, 5
    often, once = [
        di.told(F.lit(n), F.lit(n), F.lit(max(n, term)), total, di.SMOOTHING) * F.log(F.lit(total / n)) for n in (5, 1)
    ]
    row = spark.range(1).select(often.alias("often"), once.alias("once"), F.log(F.lit(total / term)).alias("most")).first()
    assert row.once < row.often < row.most


def test_words_anywhere_in_the_documents_of_an_entity_are_evidence(spark):
    filler = " ".join(f"common{k}" for k in range(30))
    secret = f"Kim 金明 zyxwv {filler} ann.lee@mail.example.com {filler} Zyxwv"
    texts = [secret] * 2 + [filler] * 60
    found = {r.id: r for r in di.find_personal(_docs(spark, texts)).collect()}
    for i in (0, 1):
        assert [texts[i][s.start : s.end] for s in found[i].added] == ["Kim", "金明", "zyxwv", "Zyxwv"]
    assert all(not found[i].added for i in range(2, 62))
    assert sorted(di._places("a 1.2.3.4 b a+1", [(2, "ip", 9)]).items()) == [
        ("1", ([14], [15])), ("a", ([0, 12], [1, 13])), ("b", ([10], [11])),
    ]


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="no test tables")
def test_words_are_added_on_a_given_table(spark):
    rows = queries.REGISTRY["op2_personal_data"].run(spark, GIVEN).collect()
    personal = [r for r in rows if r.n_email + r.n_ip + r.n_card + r.n_phone]
    assert sum(r.n_added > 0 for r in personal) > len(personal) / 2
    assert all(r.n_added == 0 for r in rows if r not in personal)
    assert all(sum(x.split(":")[0] in di.ADDED for x in r.spans.split(",") if x) == r.n_added for r in rows)


def test_personal_data_of_an_empty_table(spark):
    assert di.find_personal(_docs(spark, [])).collect() == []


# --- packing -----------------------------------------------------------------------------------------


def _reference_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


ODD_TEXTS = [
    "", "a", "  a b", "a  b \n c", "x\n\ny z ", "tab\t x \tq", "n\n 1", "é  z  w", "hi<|endoftext|> there",
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n<|endoftext", "  <|endoftext|>  x <|endoftext|>",
    "a \x85b \x1cz \x0bq", " lead", "trail ", "\n", " \n x", "don't  it's 'll", "the cat " * 900, "日本 語　x", "a\r\nb \r\n c",
]


def test_pieces_hold_the_ids_of_the_tokenizer(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = _docs(spark, ODD_TEXTS).union(spark.createDataFrame([(99, None, None, None, None)], DOCS))
    rows = bp.pack_documents(df, ranks, public_tokenizers.PATTERN).collect()
    expected = dict(enumerate(_reference_ids(ODD_TEXTS))) | {99: [1]}
    by_doc: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.length == 2**r.bucket <= 2048 and r.offset == 0 and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        assert r.start == len(by_doc.setdefault(r.doc_id, [])) and r.doc_tokens == len(expected[r.doc_id])
        by_doc[r.doc_id] += r.ids
    assert by_doc == expected
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert bp.pack_documents(df.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_binary_pieces_are_few():
    for tokens in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        pieces = list(bp.binary_pieces(tokens, 256))
        assert sum(n for _, n in pieces) == tokens and len(pieces) == tokens // 256 + (tokens % 256).bit_count()


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(bp, "CACHED", 3)
    own = bp.WordIds(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in own(pa.array(ODD_TEXTS))]
        assert got == [ids[:-1] for ids in _reference_ids(ODD_TEXTS)]


# --- token counts -----------------------------------------------------------------------------------


def _cheapest(word, costs):
    """All splits of a word, tried one by one."""
    byte = round(1000 * np.log(len(costs) + 2))
    best = None
    for cuts in product((0, 1), repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
        options = []
        for p in parts:
            forms = [(costs[p], 1)] if p in costs else []
            if len(p) == 1:
                forms.append((byte * len(p.encode()), len(p.encode())))
            options.append(min(forms, default=None))
        if None not in options:
            best = min(filter(None, [best, tuple(map(sum, zip(*options, strict=True)))]))
    return best[1]


def test_counts_agree_with_all_splits(spark):
    rng = random.Random(3)
    costs = {p: rng.randint(1, 40) for p in {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 4))) for _ in range(40)}}
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    for most in (5, 10**6):
        trie = tc.WordTrie(costs, most=most)
        for _ in range(2):
            assert trie.count([*words, ""]) == [*(_cheapest("▁" + w, costs) for w in words), 0]
    long = "ab" * 2000 + "é"
    small = tc.WordTrie(costs).count([long])[0]
    whole = tc.Vocabulary(costs)
    states, scores = [0], [0]
    whole.extend(states, scores, "▁" + long)
    assert small == scores[-1] & ((1 << 40) - 1)


def test_a_trie_walks_shared_prefixes_once():
    trie = tc.WordTrie({"a": 1, "▁": 1})
    trie.count(["aaaa", "aaab", "aaac", "aaaa"])
    assert trie.nodes == 6


def test_token_counts_of_texts(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat", None, "", " \n ", "the cat the cat", "x" * 3000]
    df = _docs(spark, texts).withColumn("n_words", F.lit("old"))
    rows = tc.count_tokens(df, model).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [2, 0, 0, 0, 4, 1]
    assert rows[4].n_tokens == 2 * rows[0].n_tokens > 0 == rows[1].n_tokens
    assert tc.count_tokens(df.limit(0), model).collect() == []


# --- quality --------------------------------------------------------------------------------------------


def test_the_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.random((3000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = aq.fit(rows[:2000], labels[:2000], rounds=60, pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.95


def test_scores_add_what_the_tables_hold():
    rng = np.random.default_rng(1)
    rows = rng.random((400, 2))
    model = aq.fit(rows, (rows[:, 0] > 0.3).astype(float), rounds=10, pairs=1)
    one = rows[7]
    total = model.base + sum(t[np.searchsorted(e, x, "right")] for t, e, x in zip(model.tables, model.edges, one, strict=True))
    a, b = model.pairs[0]
    total += model.pair_tables[0][tuple(np.searchsorted(model.pair_edges[k], one[k], "right") for k in (a, b))]
    assert abs(model.score(rows[7:8])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_of_odd_tables(spark):
    df = _docs(spark, ["Some words here.", None, "", "word " * 5000]).withColumn("score", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = aq.fit_quality(df, none)
    rows = aq.score_quality(df, model).collect()
    assert {r.score for r in rows} == {0.5} and all(r.predicted == 1 for r in rows)
    assert aq.keep_good(df, model).columns == df.columns and aq.keep_good(df, model).count() == 4
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    assert aq.keep_good(df.limit(0), model).collect() == []
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(None, 1), (9, None)], "doc_id long, quality int")
    assert len(aq.score_quality(df, aq.fit_quality(df, labels)).collect()) == 4


def test_held_out_rows_teach_nothing(spark):
    texts = [f"word{i} !! ## " * (i % 7) + "plain words " * 5 for i in range(60)]
    df = _docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(aq.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [[r.score for r in aq.score_quality(df, aq.fit_quality(df, x)).orderBy("doc_id").collect()] for x in (labels, flipped)]
    assert scores[0] == scores[1]


# --- mixing -----------------------------------------------------------------------------------------------


def test_every_prefix_of_the_period_is_fair():
    rng = random.Random(4)
    for _ in range(60):
        weights = [rng.randint(1, 30) for _ in range(rng.randint(1, 7))]
        slots, total = pfair.period(weights), sum(weights)
        assert sorted(s for own in slots for s in own) == list(range(total))
        for own, w in zip(slots, weights, strict=True):
            for i, s in enumerate(own):
                assert i * total // w <= s < -(-(i + 1) * total // w)
            assert all(abs(sum(s < t for s in own) - t * w / total) < 1 for t in range(total + 1))


def test_mixture_keeps_all_and_follows_the_shares(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(3000)] + [(7, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("old"))
    mixed = pfair.mix_sources(df, {"a": 2, "b": 1}, other=1, block=4).collect()
    assert sorted(r.position for r in mixed) == list(range(3002))
    assert Counter((r.doc_id, r.source) for r in mixed) == Counter(rows)
    assert all(r.release <= r.slot < r.deadline for r in mixed)
    per_class = {name: [r for r in mixed if (r.source or "other") == name] for name in ("a", "b", "other")}
    end = min(len(own) // 4 * 4 / share for own, share in ((per_class["b"], 1), (per_class["other"], 1)))
    for t in range(int(end)):
        for name, share in (("a", 0.5), ("b", 0.25), ("other", 0.25)):
            blocks = len({r.slot for r in per_class[name] if r.slot < t})
            assert abs(blocks - share * t) < 1
    ordered = pfair.in_order(pfair.mix_sources(df, {"a": 2, "b": 1}, other=1, block=4), ["doc_id", "position"], 3002)
    assert [r.position for r in ordered.collect()] == list(range(3002))
    assert pfair.mix_sources(df.limit(0)).collect() == []


def _fair(mixed, shares, block, end):
    """That before every slot up to ``end`` each source has had its share to within less than one block."""
    slots = {name: sorted({r.slot for r in mixed if r.source == name}) for name in shares}
    for t in range(end):
        assert all(abs(sum(s < t for s in slots[n]) - share * t) < 1 for n, share in shares.items()), t


def test_every_source_has_its_own_share(spark):
    rng = random.Random(12)
    others = [f"o{k}" for k in range(9)]
    rows = [(i, rng.choice(["a", "a", "b", None, *others])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    mixed = pfair.mix_sources(df, {"a": 3, "b": 2}, other=5, block=4).collect()
    shares = {"a": 0.3, "b": 0.2, **{n: 0.05 for n in (None, *others)}}
    assert {r.source: round(r.share, 9) for r in mixed} == shares
    assert all(r.release <= r.slot < r.deadline for r in mixed)
    sizes = Counter(s for _, s in rows)
    out = min(int(-(-sizes[n] // 4) / share) for n, share in shares.items())
    assert out > 100
    _fair(mixed, shares, 4, out)
    assert sorted(r.position for r in mixed) == list(range(4000))


def test_what_happens_when_a_source_runs_out(spark):
    rows = [(i, "a" if i < 300 else "b" if i < 340 else f"o{i % 3}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    mix = lambda how, weights: pfair.mix_sources(df, weights, other=2, block=4, when_out=how).collect()
    shares = {"a": 0.25, "b": 0.25, **{f"o{k}": 0.5 / 3 for k in range(3)}}
    whole, stopped, again = (mix(how, {"a": 1, "b": 1}) for how in ("go_on", "stop", "repeat"))
    end = max(r.slot for r in stopped) + 1
    assert {r.slot for r in stopped} == set(range(end)) and end >= 40
    key = lambda r: (r.doc_id, r.slot, r.position)
    assert {key(r) for r in stopped} == {key(r) for r in whole if r.slot < end}
    last = max(r.slot for r in whole) + 1
    assert {r.slot for r in again} == set(range(last)) and sorted(r.position for r in again) == list(range(4 * last))
    _fair(again, shares, 4, last)
    assert {(r.doc_id, r.slot) for r in whole} >= {(r.doc_id, r.slot) for r in again if r.copy == 0 and r.source != "b"}
    assert len({(r.doc_id, r.copy) for r in again}) == len(again) and {r.doc_id for r in again} == {i for i, _ in rows}
    assert mix("stop", {"a": 1, "gone": 1})[-1].slot < 2
    assert len(mix("repeat", {"a": 1, "gone": 1})) >= 1000
    with pytest.raises(ValueError, match="when_out"):
        mix("end", {"a": 1})


def test_ids_that_repeat_are_many_groups(spark, monkeypatch):
    parts = []
    keep = pfair.written
    monkeypatch.setattr(pfair, "written", lambda df, name: parts.append((name, keep(df, name))) or parts[-1][1])
    df = spark.range(40_000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("src0").alias("source"))
    mixed = pfair.mix_sources(df)
    assert mixed.agg(F.countDistinct("position"), F.max("position")).first() == (40_000, 39_999)
    groups = dict(parts)["mix-groups"].collect()
    assert len(groups) > 16 and max(r.n for r in groups) < 4_000


# --- URLs ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://x.org/casino/porn", "x.org", "/casino/porn", "org/", "allow"),
        ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("https://notorg/", "notorg", "/", None, "allow"),
        ("https://x.org", "x.org", "", None, "allow"),
        ("https://a.net/porn", "a.net", "/porn", None, "block"),
        ("https://a.net/popcorn-pornstar", "a.net", "/popcorn-pornstar", None, "allow"),
        ("https://a.net/free-time", "a.net", "/free-time", None, "allow"),
        ("https://a.net/free/free/FREE", "a.net", "/free/free/FREE", None, "allow"),
        ("https://a.net/free?poker", "a.net", "/free", None, "block"),
        ("casino poker", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://ÀB.net?" + "a" * 50_000, "Àb.net", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "mine")], "page_id long, url string, host string")
    row = ut.judge_urls(df).collect()[0]
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_url_terms_agree_with_expressions(spark):
    rng = random.Random(5)
    bits = [*ut.STRICT, *ut.SOFT, "-", "/", ".", "a", "9", "é", "_"]
    urls = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(500)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for row in ut.judge_urls(df).collect():
        hits = [[t for t in terms if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", row.url)] for terms in (ut.STRICT, ut.SOFT)]
        assert (row.n_strict, row.n_soft) == tuple(map(len, hits))
    assert ut.judge_urls(df.limit(0)).collect() == []


def test_sha_of_kept_lines(spark):
    kept = ld.drop_repeated_lines(_docs(spark, ["a\nb", None])).select(F.sha2("text", 256).alias("h")).collect()
    assert sorted(r.h for r in kept) == sorted(hashlib.sha256(x).hexdigest() for x in (b"a\nb", b""))


def test_a_vocabulary_from_a_table(spark, monkeypatch):
    terms = [(" Bad-Site ", 1.0), ("promo", 0.5), ("promo", 0.2), ("Deal", 0.9), ("deal", 3.0), ("win", 0.4),
             (None, 1.0), ("", 1.0), ("x", None), ("y", 0.0), ("z", float("nan"))]
    table = spark.createDataFrame(terms, "term string, weight double")
    strict, soft = ut.vocabulary(table)
    assert strict == ("bad-site", "deal") and soft == ("promo", "win")
    urls = ["http://a/BAD-SITE", "http://a/promo", "http://a/promo/win", "http://a/promo/promo", "http://a/ideal", "http://a/x", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    found = {r.page_id: r.verdict for r in ut.judge_urls(df, strict=strict, soft=soft).collect()}
    assert [i for i, v in found.items() if v == "block"] == [0, 2]
    assert ut.vocabulary(table.limit(0)) == ((), ())
    assert {r.n_soft for r in ut.judge_urls(df, strict=(), soft=()).collect()} == {0}
    monkeypatch.setattr(ut, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        ut.vocabulary(table)


def test_automata_are_built_once():
    ut._automaton.cache_clear()
    for _ in range(3):
        ut._automaton(ut.STRICT, ut.SOFT)
    assert ut._automaton.cache_info().misses == 1
