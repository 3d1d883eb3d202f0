"""Mixing sources to target weights by a proportionally fair schedule of blocks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.shared import c, free_name
from tablewright.operators.paging import numbered
from tablewright.workspace import written

#: Shares of the mixture: named sources, and what all others have together.
WEIGHTS: Mapping[str, int] = {"src0": 20, "src1": 10, "src2": 10, "src3": 5, "src4": 5}
OTHER_WEIGHT = 50
#: Documents in a block.
BLOCK = 16
#: Slots that are counted together; a row for each of these stretches is sorted in one task.
_STRETCH = 1 << 16


def written_row(docs: DataFrame) -> Column:
    """A number for every row of files read as they are: the same whenever and however they are read."""
    meta = docs.metadataColumn("_metadata")
    place = F.concat_ws(":", meta.getField("row_index").cast("string"), meta.getField("file_path"))
    return F.md5(place.cast("binary"))


def period(weights: list[int]) -> list[list[int]]:
    """For each class, the slots of its blocks in one period of ``sum(weights)`` slots.

    Block i of a class with share w of W is released at slot floor(i W / w) and due before slot
    ceil((i + 1) W / w).  Each slot goes to the released block that is due first (of several, the
    first class).  All blocks of a period fit between its ends, so the schedule repeats.
    """
    total = sum(weights)
    done, slots = [0] * len(weights), [[] for _ in weights]
    for slot in range(total):
        ready = [k for k, w in enumerate(weights) if done[k] < w and done[k] * total // w <= slot]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * total // weights[k]), k))
        slots[k].append(slot)
        done[k] += 1
    return slots


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, int] = WEIGHTS,
    other: int = OTHER_WEIGHT,
    block: int = BLOCK,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    when_out: str = "go_on",
    tie: Column | None = None,
) -> DataFrame:
    """``docs`` with ``share``, ``block``, ``release``, ``deadline``, ``slot`` and ``position``.

    Every source is a class of its own, null among them.  Those named in ``weights`` have their weight; the
    others have equal parts of ``other``.  A class's documents come in the order of a hash of their
    ids and are cut into blocks.  Block i of a class with share s is released at slot floor(i / s) and due
    before slot ceil((i + 1) / s), and slots go to released blocks, earliest deadline first: in one schedule
    of the named classes and the others taken as one, and in that one's slots among the others, which
    with equal shares take turns.  The first is off by less than one block before any slot; the
    turns are off by less than (m - 1) / m of one for m others, to which the first adds less than 1 / m.  So
    each source has had its share of the slots to within less than one block as long as none has run out.

    ``when_out`` says what happens then: ``go_on`` leaves its slots empty, the rest goes on in its proportions and
    no document is left out or repeated; ``stop`` ends before the first slot that would be empty;
    ``repeat`` takes the class from its start again, until the last class has had all its documents, and
    tells with ``copy`` which time it is.  ``position`` counts documents in the order of the mixture, from 0 without
    gaps; ``share`` is a class's part of all slots.

    Repeated and null ids are placed each for itself: ``tie``, a value that no two rows share and that is the same
    whenever they are read, orders them.  Without it the rows are written once with their numbers.
    Columns named like the new ones are replaced.  An empty table gives an empty one.

    Only ids, sources and ties are sorted, in parts of the hash's range and, where ids repeat, parts of the tie's;
    the documents are moved once.  The schedule of the named weights has as many slots as they sum to,
    whatever the number of sources.  One number passes through the driver.
    """
    if block < 1 or other < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights and the size of a block must be positive")
    if when_out not in ("go_on", "stop", "repeat"):
        raise ValueError("when_out is go_on, stop or repeat")
    key = free_name(docs, "mix_key")
    if tie is None:
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    else:
        docs = docs.withColumn(key, tie)
    placed = _places(docs.select(c(doc_id).cast("string").alias("id"), c(source).cast("string").alias("source"), c(key).alias("key")), weights, other, block, when_out)
    new = ["share", "block", "release", "deadline", "slot", "position", *(["copy"] if when_out == "repeat" else [])]
    kept = [n for n in docs.columns if n != key and n.lower() not in new]
    joined = docs.alias("d").join(placed.alias("p"), F.col(f"d.{key}") == F.col("p.key"))
    return joined.select(*[F.col(f"d.{quoted(n)}") for n in kept], *[F.col(f"p.{n}") for n in new])


def _places(rows: DataFrame, weights: Mapping[str, int], other: int, block: int, when_out: str) -> DataFrame:
    """Where the documents go, by ``key``; ``rows`` have ``id``, ``source`` and ``key``."""
    names = sorted(weights)
    shares = [*[weights[n] for n in names], other]
    total = sum(shares)
    slots = period(shares)
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    kind = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    hashed = F.md5(F.coalesce("id", F.lit("")).cast("binary"))
    rows = rows.select(kind.alias("kind"), hashed.alias("h"), F.pmod(F.xxhash64("key"), F.lit(parts)).alias("salt"), "key")
    groups = rows.groupBy("kind", "h", "salt").agg(F.count(F.lit(1)).alias("n"))
    # The first 32 bits of the hash, scaled to the number of parts, keep its order.
    part = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * parts, 32)
    groups = written(groups.withColumn("part", part), "mix-groups")

    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    of_parts = groups.groupBy("kind", "part").agg(F.sum("n").alias("n"))
    of_parts = of_parts.select("kind", "part", before(earlier("kind").orderBy("part")).alias("ahead"))
    starts = groups.withColumn("start", before(earlier("kind", "part").orderBy("h", "salt"))).join(of_parts, ["kind", "part"])
    starts = starts.select("kind", "h", "salt", (F.col("start") + F.col("ahead")).alias("start"))
    within = Window.partitionBy("kind", "h", "salt").orderBy("key")
    numbers = (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["kind", "h", "salt"])
        .select("kind", "key", (F.col("start") + F.col("at")).alias("number"))
    )

    # One row for each source: its size, its place in the schedule and, among the others, its turn.
    classes = groups.groupBy("kind").agg(F.sum("n").alias("size"))
    top = F.lit(len(names))
    for k, name in enumerate(names):
        top = F.when(F.col("kind") == f"={name}", k).otherwise(top)
    classes = written(classes.withColumn("top", top.cast("int")), "mix-classes")
    rest = classes.filter(F.col("top") == len(names))
    turns = numbered(rest.select("kind"), [F.col("kind")], "turn")
    others = rest.count()
    classes = classes.join(turns, "kind", "left")
    alone = F.col("top") < len(names)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("top") + 1)
    classes = classes.select(
        "kind",
        "size",
        "top",
        F.when(alone, 0).otherwise(F.col("turn")).alias("turn"),
        F.when(alone, 1).otherwise(others).cast("long").alias("members"),
    )
    classes = written(classes, "mix-turns")

    def slot_of(number: Column) -> Column:
        """The slot of a class's block: in the period of its place in the schedule, or in its turn there."""
        at, share = number * F.col("members") + F.col("turn"), pick(shares)
        table = F.element_at(F.array(*[F.array(*[F.lit(s) for s in own]) for own in slots]), F.col("top") + 1)
        return F.floor(at / share) * total + F.element_at(table, (F.pmod(at, share) + 1).cast("int"))

    blocks_of = F.ceil(F.col("size") / block)
    if when_out == "stop":
        lacking = [slots[k][0] for k in _absent(classes, names)]
        out = classes.agg(F.min(slot_of(blocks_of))).first()[0]
        end = min([x for x in (out, *lacking) if x is not None], default=0)
    if when_out == "repeat":
        end = (classes.agg(F.max(slot_of(blocks_of - 1))).first()[0] or 0) + 1
        # Blocks of a class before the end: those of whole periods, and those of the one that ends there.
        done = F.array(*[F.array(*[F.lit(sum(s < t for s in own)) for t in range(total)]) for own in slots])
        of_top = F.lit(end // total) * pick(shares) + F.element_at(F.element_at(done, F.col("top") + 1), end % total + 1)
        needed = F.floor((of_top - F.col("turn") + F.col("members") - 1) / F.col("members")) * block
        classes = classes.withColumn("needed", needed)

    found = numbers.join(classes, "kind")
    length = F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block)
    if when_out == "repeat":
        copies = F.sequence(F.lit(0).cast("long"), F.floor((F.col("needed") - 1 - F.col("number")) / F.col("size")))
        found = found.filter(F.col("number") < F.col("needed")).withColumn("copy", F.explode(copies))
        found = found.withColumn("number", F.col("number") + F.col("copy") * F.col("size"))
        length = F.lit(block).cast("long")
    found = found.withColumn("block", F.floor(F.col("number") / block))
    found = found.withColumns({"slot": slot_of(F.col("block")), "length": length})
    if when_out == "stop":
        found = found.filter(F.col("slot") < end)
    found = written(found, "mix-numbers")

    # Documents before a slot: those of the stretches of slots before its own, and those before it there.
    firsts = found.filter(F.col("number") % block == 0).select("slot", F.col("length").alias("n"))
    firsts = firsts.withColumn("stretch", F.floor(F.col("slot") / _STRETCH))
    stretches = firsts.groupBy("stretch").agg(F.sum("n").alias("n"))
    stretches = stretches.select("stretch", before(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    ahead = firsts.withColumn("start", before(earlier("stretch").orderBy("slot"))).join(stretches, "stretch")
    found = found.join(ahead.select("slot", (F.col("start") + F.col("ahead")).alias("start")), "slot")
    weight, b = pick(shares).cast("long"), F.col("block")
    per = F.lit(total).cast("long") * F.col("members")
    return found.select(
        "key",
        (pick([w / total for w in shares]) / F.col("members")).alias("share"),
        "block",
        F.floor(b * per / weight).alias("release"),
        F.ceil((b + 1) * per / weight).alias("deadline"),
        "slot",
        (F.col("start") + F.pmod("number", F.lit(block))).cast("long").alias("position"),
        *(["copy"] if when_out == "repeat" else []),
    )


def _absent(classes: DataFrame, names: list[str]) -> list[int]:
    """The named sources that have no document."""
    found = {r["top"] for r in classes.filter(F.col("top") < len(names)).select("top").collect()}
    return [k for k in range(len(names)) if k not in found]


def in_order(mixed: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The ``rows`` mixed documents in the order of the mixture, partition after partition."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        mixed.repartitionById(parts, F.floor(c("position") * parts / max(rows, 1)).cast("int"))
        .sortWithinPartitions("position")
        .select(*[c(n) for n in columns])
    )


def with_written_place(docs: DataFrame, name: str) -> DataFrame:
    """Rows read from the files that ``in_order`` was written to, with ``name``: their place in it, from 0.

    A reader packs files into partitions by their sizes, so the order is taken from the files: by
    the number of the task that wrote each, its files in their order, and the row within a file.
    That is Spark's name for a file, ``part-`` and the task's number; other names come first, as they sort.  Only
    the sizes of files are brought together, one row for each, and sorted in one task.
    """
    meta = docs.metadataColumn("_metadata")
    file, row, count, before = (free_name(docs, x) for x in ("mix_file", "mix_row", "mix_rows", "mix_before"))
    path = meta.getField("file_path")
    files = docs.select(path.alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias(count))
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("int")
    earlier = Window.orderBy(number(r"/part-(\d+)[^/]*$"), number(r"-c(\d+)\.[^/]*$"), file)
    files = files.select(
        file, (F.sum(count).over(earlier.rowsBetween(Window.unboundedPreceding, 0)) - c(count)).alias(before)
    )
    return (
        docs.select("*", path.alias(file), meta.getField("row_index").alias(row))
        .join(files, file)
        .select(*[c(n) for n in docs.columns], (c(before) + c(row)).alias(name))
    )
