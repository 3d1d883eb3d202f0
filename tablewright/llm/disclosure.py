"""Personal data and the terms that give it away.

Patterns find personal data.  Each distinct value is a protected entity, and the corpus tells how
strongly the words of its documents reveal it: the pointwise mutual information of word and entity,
as a share of the entity's own information.  Words over a threshold are generalised, those over a
higher one removed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import c, free_name, row_key, text_batches, whole_text
from tablewright.workspace import written

# The kinds of personal data, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: The kinds of terms that give an entity away.
ADDED = ("generalise", "remove")

#: Documents in which an entity is thought to have been seen besides its own, with the words of the
#: whole corpus: what few documents show is trusted less.
SMOOTHING = 0.5
#: Shares of an entity's information from which a word is generalised, and removed.
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: Bits of the filter that tells which words need counting: its size is fixed.
FILTER_BITS = 1 << 22
#: Distinct words a task counts between two reports: this bounds its memory and changes no count.
HELD = 500_000

_WORD = re.compile(r"\w+")
# The part of an address from the sign on; what precedes it is found going backwards, so that no
# character is looked at once for every place where an address might begin.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + at % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            last = found.end()


def personal_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of all personal data, by start and then kind."""
    spans: list[tuple[int, int, int]] = []
    if "@" in text:
        spans += [(a, 0, b) for a, b in _emails(text)]
    for found in _IP.finditer(text):
        parts = [p.lstrip("0") for p in found.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            spans.append((found.start(), 1, found.end()))
    for found in _CARD.finditer(text):
        digits = _digits(found.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((found.start(), 2, found.end()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= len(_digits(found.group())) <= 15:
                spans.append((found.start(), 3, found.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(spans)]


def _entities(text: str, spans: list[tuple[int, str, int]]) -> list[bytes]:
    """The distinct entities among the personal data of a text."""
    out = set()
    for start, kind, end in spans:
        value = text[start:end].lower() if kind == "email" else _digits(text[start:end]) if kind != "ip" else text[start:end]
        out.add(hashlib.md5(f"{kind}:{value}".encode("utf-8", "replace"), usedforsecurity=False).digest())
    return sorted(out)


def _places(text: str, spans: list[tuple[int, str, int]]) -> dict[str, tuple[list[int], list[int]]]:
    """Where each word of a text begins and ends that is no part of personal data."""
    out: dict[str, tuple[list[int], list[int]]] = {}
    covered, at = sorted((a, b) for a, _, b in spans), 0
    last = 0  # where the spans that begin before the end of the word end
    for found in _WORD.finditer(text):
        start, end = found.span()
        while at < len(covered) and covered[at][0] < end:
            last = max(last, covered[at][1])
            at += 1
        if last <= start:
            starts, ends = out.setdefault(found.group().lower(), ([], []))
            starts.append(start)
            ends.append(end)
    return out


_SPAN = "struct<start: long, kind: string, end: long>"
_TERM = "struct<term: string, starts: array<long>, ends: array<long>>"


def _base_scanner(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
    places = pa.list_(pa.int64())
    term = pa.struct([("term", pa.string()), ("starts", places), ("ends", places)])
    for table in text_batches(tables, column=2, most=2 << 20):
        spans, entities, terms = [], [], []
        for text in table.column(2):
            text = text.as_py()
            own = personal_spans(text)
            spans.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in own])
            entities.append(_entities(text, own))
            found = _places(text, own) if own else {}
            terms.append([{"term": t, "starts": a, "ends": b} for t, (a, b) in found.items()])
        yield pa.RecordBatch.from_arrays(
            [
                table.column(0),
                table.column(1),
                pa.array(spans, pa.list_(span)),
                pa.array(entities, pa.list_(pa.binary())),
                pa.array(terms, pa.list_(term)),
            ],
            ["id", "row", "spans", "entities", "terms"],
        )


def _term_counter(term_bits: bytes, row_bits: bytes):
    """Counts texts that hold a term which the filter of terms lets through.

    Rows that the filter of rows lets through, which may repeat, come out one by one with their terms.
    """

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").tobytes()
        wanted, repeated = bits(term_bits), bits(row_bits)
        place = lambda x: zlib.crc32(x.encode()) & (FILTER_BITS - 1)
        found: Counter[str] = Counter()
        seen: set[str] = set()
        for table in text_batches(tables):
            single: list[tuple[str, list[str]]] = []
            for row, text in zip(table.column(0).to_pylist(), table.column(1), strict=True):
                words = {w.lower() for w in set(_WORD.findall(text.as_py()))}
                words = [w for w in words if wanted[place(w)]]
                if repeated[place(row)]:
                    if row not in seen:
                        single.append((row, words))
                        seen.add(row)
                else:
                    found.update(words)
            yield _counted([r for r, _ in single], [w for _, w in single], [1] * len(single))
            if len(found) > HELD:
                yield _counted([None] * len(found), [[w] for w in found], list(found.values()))
                found.clear()
            if len(seen) > HELD:
                seen.clear()
        yield _counted([None] * len(found), [[w] for w in found], list(found.values()))

    return count


def _counted(rows: list[str | None], terms: list[list[str]], counts: list[int]) -> pa.RecordBatch:
    arrays = [pa.array(rows, pa.string()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["row", "terms", "n"])


def _filter_bits(values: DataFrame) -> bytes:
    """A bit for each hash that a value of the one column has: FILTER_BITS / 8 bytes, however many there are."""
    # Buckets of 32,768 bits are numbered from 1, for the numbers from 1 on.
    bit = F.crc32(F.col(values.columns[0]).cast("binary")).bitwiseAND(FILTER_BITS - 1) + 1
    parts = (
        values.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in parts:
        start = (part["bucket"] - 1) * 4096
        own = np.frombuffer(bytes(part["bits"]), np.uint8)
        out[start : start + len(own)] = own
    return out.tobytes()


def told(both: Column, of_entity: Column, of_term: Column, total: int, smoothing: float) -> Column:
    """The share of an entity's information that a word tells, from counts of documents."""
    of_all = of_term / F.lit(float(total))
    of_own = (both + smoothing * of_all) / (of_entity + smoothing)
    return F.log(of_own / of_all) / F.log(F.lit(float(total)) / of_entity)


def find_personal(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    smoothing: float = SMOOTHING,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
) -> DataFrame:
    """``(id, row, spans, added)``, one row per row of ``docs``, without its text.

    ``spans`` are the personal data that patterns find in the whole text, as ``start``, ``kind`` and
    ``end`` in code points, by start and then kind; ``added`` are words that reveal them.  ``row``
    is ``row_key`` of the id and the text.

    Every distinct value found is a protected entity c, with the information IC(c) = -log p(c), p
    being shares of documents.  For a word t anywhere in a document of it,
    log(p(t | c) / p(t)) is what t tells of c.  p(t | c) is smoothed: to the n(c) documents of c
    come ``smoothing`` documents with the words of the whole corpus, so p(t | c) is
    (n(c, t) + smoothing p(t)) / (n(c) + smoothing), and words of an entity that one document holds
    need to be rarer than those of one that many hold.  From ``generalise_at`` times IC(c) on, t is
    added with the kind ``generalise``, from ``remove_at`` times with ``remove``:
    wherever it stands in the documents of c, so documents without personal data are left as they
    are.  Words are of any length and compared in lower case; those that touch personal data are
    not looked at.

    Null and empty texts have no spans.  Rows that repeat an id and a text are one document in every
    count, and each gets the same spans.  Ids may be null; an empty table gives an empty one.

    Texts are read twice and never shuffled.  What a word can tell of an entity is bounded by how many
    documents hold the word, so the words of a document are counted first and those that cannot reach
    ``generalise_at`` for any of its entities go before pairs are made; the bound is exact.  Entities
    with the same documents tell the same and are one class.  Filters of a fixed size say which words are
    to be counted and which rows may repeat (both let a few others through, which changes no count).
    Pairs are counted with a combine in the task.
    """
    ident, whole = c(doc_id).cast("long"), whole_text(text)
    keyed = docs.select(ident.alias("id"), row_key(ident, whole).alias("row"), whole.alias("text"))
    base = written(
        keyed.mapInArrow(
            _base_scanner,
            f"id long, row string, spans array<{_SPAN}>, entities array<binary>, terms array<{_TERM}>",
        ).withColumn("at", F.monotonically_increasing_id()),
        "personal",
    )
    holders = base.filter(F.size("entities") > 0)
    rows = written(base.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")), "personal-rows")
    total = rows.count()
    repeated = rows.filter(F.col("n") > 1).select("row")
    own = written(
        holders.select("at", "entities", F.col("terms.term").alias("terms")).join(rows.select("at"), "at", "left_semi"),
        "personal-documents",
    )

    # Classes of entities: those whose documents are the same ones, by number and two sums of hashes.
    entity = own.select("at", F.explode("entities").alias("entity"))
    sums = [F.sum(F.xxhash64("at", F.lit(seed)).cast("decimal(20)")).cast("string") for seed in (1, 2)]
    classes = entity.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"), F.sha2(F.concat_ws(":", *sums), 256).alias("class"))
    classes = written(classes.filter(F.col("of_entity") < total), "personal-entities")
    member = written(entity.join(classes, "entity").select("at", "class", "of_entity").distinct(), "personal-classes")

    counted = keyed.select("row", "text").mapInArrow(
        _term_counter(_filter_bits(own.select(F.explode("terms").alias("term"))), _filter_bits(repeated)),
        "row string, terms array<string>, n long",
    )
    counted = written(counted, "personal-terms")
    once = counted.filter(F.col("row").isNotNull()).groupBy("row").agg(F.first("terms").alias("terms"), F.lit(1).cast("long").alias("n"))
    terms = (
        counted.filter(F.col("row").isNull()).select("terms", "n").union(once.select("terms", "n"))
        .select(F.explode("terms").alias("term"), "n")
        .groupBy("term")
        .agg(F.sum("n").alias("of_term"))
    )
    bound = lambda of_entity: _most_documents(of_entity, total, generalise_at)
    most = member.agg(F.max("of_entity")).first()[0] or 0
    terms = written(terms.filter(F.col("of_term") <= bound(F.lit(most))), "personal-words")
    widest = member.groupBy("at").agg(F.max("of_entity").alias("widest"))
    rare = (
        own.select("at", F.explode("terms").alias("term"))
        .join(terms, "term")
        .join(widest, "at")
        .filter(F.col("of_term") <= bound(F.col("widest")))
        .select("at", "term", "of_term")
    )
    pairs = (
        written(rare, "personal-rare")
        .join(member, "at")
        .filter(F.col("of_term") <= bound(F.col("of_entity")))
        .select("at", "class", "term", "of_entity", "of_term")
    )
    pairs = written(pairs, "personal-pairs")
    share = told(F.col("both"), F.col("of_entity"), F.col("of_term"), total, smoothing)
    telling = (
        pairs.groupBy("class", "term", "of_entity", "of_term")
        .agg(F.count(F.lit(1)).alias("both"))
        .withColumn("share", share)
        .filter(F.col("share") >= generalise_at)
        .select("class", "term", (F.col("share") >= remove_at).alias("remove"))
    )
    telling = written(telling, "personal-telling")
    of_document = (
        pairs.select("at", "class", "term")
        .join(telling, ["class", "term"])
        .groupBy("at", "term")
        .agg(F.max("remove").alias("remove"))
        .groupBy("at")
        .agg(F.collect_list(F.struct("term", "remove")).alias("telling"))
        .join(rows.select("at", "row"), "at")
        .select("row", "telling")
    )
    added = F.when(F.col("telling").isNotNull(), F.arrow_udf(_added, f"array<{_SPAN}>")("terms", "telling"))
    none = F.array().cast(f"array<{_SPAN}>")
    marked = holders.join(of_document, "row", "left").select("id", "row", "spans", F.coalesce(added, none).alias("added"))
    return base.filter(F.size("entities") == 0).select("id", "row", "spans", none.alias("added")).unionAll(marked)


def _most_documents(of_entity: Column, total: int, share: float) -> Column:
    """Documents that may hold a word which tells ``share`` of an entity's information, at most.

    p(t | c) is 1 at most, so t tells log(1 / p(t)) at most: p(t) must not exceed p(c) to the power of
    ``share``.  Half a document more, so that no pair is lost by rounding.
    """
    return F.pow(of_entity / F.lit(float(max(total, 1))), F.lit(share)) * total + 0.5


def _added(terms: pa.Array, telling: pa.Array) -> pa.Array:
    """The places of a document's telling words."""
    out = []
    for own, told_of in zip(terms.to_pylist(), telling.to_pylist(), strict=True):
        kinds = {t["term"]: ADDED[t["remove"]] for t in told_of or ()}
        spans = [
            {"start": a, "kind": kinds[t["term"]], "end": b}
            for t in (own or ()) if t["term"] in kinds
            for a, b in zip(t["starts"], t["ends"], strict=True)
        ]
        out.append(sorted(spans, key=lambda s: s["start"]))
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))


def joined_spans(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(spans: Column, added: Column) -> Column:
    """Both kinds of spans by start, then kind in the order of KINDS and ADDED."""
    order = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    place = lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("at"), s["kind"], s["end"])
    return F.array_sort(F.transform(F.concat(spans, added), place))


def _shape(word: str) -> str:
    return "[number]" if any(x.isdigit() for x in word) else "[name]" if word[:1].isupper() else "[word]"


def _redact(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        parts, last = [], 0
        for span in own or ():
            start, end = max(span["start"], last), span["end"]
            if start >= end:
                continue  # inside a span that began before it
            kind = span["kind"]
            parts += [text[last:start], "" if kind == "remove" else _shape(text[start:end]) if kind == "generalise" else f"[{kind}]"]
            last = end
        out.append("".join([*parts, text[last:]]))
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with personal data named by kind, telling words generalised to their shape or removed.

    Takes the options of ``find_personal``.  Null texts come back empty; other columns stay.
    """
    key, spans = free_name(docs, "personal_row"), free_name(docs, "personal_spans")
    found = find_personal(docs, doc_id=doc_id, text=text, **options)
    found = found.select(F.col("row").alias(key), all_spans(F.col("spans"), F.col("added")).alias(spans))
    found = found.filter(F.size(spans) > 0).dropDuplicates([key])
    ident, whole = c(doc_id).cast("long"), whole_text(text)
    return (
        docs.withColumn(key, row_key(ident, whole))
        .join(found, key, "left")
        .withColumn(text, F.arrow_udf(_redact, "string")(whole, c(spans)))
        .select(*[c(n) for n in docs.columns])
    )
