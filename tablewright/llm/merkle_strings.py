"""Merkle manifest of a dataset, kept as strings of concatenated levels.

The rows of a group are the leaves of a tree.  An aligned block of leaves keeps each of its levels
as one string of hexadecimal digests; parents are the digests of substrings of a fixed width, and
what flanks a node's place in its run is its sibling segment.  The roots of the blocks are the leaves
of the next round, until one node is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import ascii_lower, c
from tablewright.workspace import written

#: Children of a node.
ARITY = 8
#: Levels that a block keeps: it has ARITY ** LEVELS leaves at most.
LEVELS = 3
#: Hexadecimal digits of a digest.
DIGEST = 64
# The columns of a document in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    """H: lowercase hexadecimal SHA-256 of a text."""
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``length in bytes:value``, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    part = lambda t: F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    return digest(F.concat(*[part(t) for t in texts]))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path give."""
    return F.aggregate(path, node, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up, those of a run from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0 within each ``tree`` by ``order``, and ``total``, the tree's rows.

    Rows are dealt by ranges of the whole order, so a tree that holds most rows is many parts; rows
    that are equal in all of it are dealt by where they were read.
    """
    tie = F.monotonically_increasing_id()
    parts = rows.withColumn("tie", tie)
    parts = parts.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    parts = written(parts.withColumn("place", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("place", 33)
    runs = parts.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    runs = runs.select(
        "tree",
        "part",
        (F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(tree).alias("total"),
    )
    return (
        parts.withColumn("part", part)
        .join(runs, ["tree", "part"])
        .withColumn("pos", F.col("place") + F.col("shift"))
        .drop("part", "place", "shift")
    )


def _parents(level: Column, arity: int) -> Column:
    """The digests of the runs of a level, as the string of the next one."""
    width = DIGEST * arity
    last = F.floor((F.length(level) - 1) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.substring(level, i * width + 1, width))), "")


def _blocks(nodes: DataFrame, arity: int, levels: int, carried: Sequence[str] = ()) -> DataFrame:
    """One row per aligned block: its levels ``l0`` to ``l{levels}``, and what its leaves carry.

    ``l{levels}`` is the block's root.  A level of a tree that has one node there stays as it is.
    """
    size = arity**levels
    row = F.struct(F.col("pos"), F.col("node"), *[F.col(n) for n in carried])
    out = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(row)).alias("rows")
    )
    kept = F.transform("rows", lambda r: F.struct(*[r[n].alias(n) for n in carried])) if carried else F.lit(None)
    out = out.select("tree", "block", "total", F.array_join("rows.node", "").alias("l0"), kept.alias("rows"))
    for j in range(levels):
        own = F.col(f"l{j}")
        out = out.withColumn(
            f"l{j + 1}", F.when(_nodes_at("total", arity, j) > 1, _parents(own, arity)).otherwise(own)
        )
    return written(out, "merkle-blocks")


def _nodes_at(total: str, arity: int, level: int) -> Column:
    """How many nodes a tree of ``total`` leaves has at a level."""
    return F.ceil(F.col(total) / arity**level)


def _above(blocks: DataFrame, arity: int, levels: int) -> DataFrame:
    """The roots of blocks, as the leaves of the next round."""
    return blocks.select(
        "tree",
        F.col("block").alias("pos"),
        F.col(f"l{levels}").alias("node"),
        _nodes_at("total", arity, levels).alias("total"),
    )


def _below(blocks: DataFrame, parents: DataFrame, arity: int, levels: int) -> DataFrame:
    """The leaves of blocks with ``pos``, ``node``, ``path`` and what they and their blocks' parents carry.

    ``parents`` has a row for each block: ``tree``, ``block``, ``path`` from the block's root on.
    """
    width = DIGEST * arity
    segment = lambda level, at: F.substring(F.col(f"l{level}"), at * width + 1, width)

    def step(seg: Column, at: Column) -> Column:
        left = F.substring(seg, F.lit(1), at * DIGEST)
        right = F.substring(seg, (at + 1) * DIGEST + 1, F.lit(width))
        return F.struct(left.alias("left"), right.alias("right"))

    last = F.floor((F.length("l0") - 1) / width).cast("int")
    up = [n for n in parents.columns if n not in ("tree", "block", "path")]
    runs = blocks.join(parents, ["tree", "block"]).select("*", F.explode(F.sequence(F.lit(0), last)).alias("run"))
    steps = [
        F.when(
            _nodes_at("total", arity, j) > 1,
            F.array(step(segment(j, F.floor(F.col("run") / arity**j).cast("int")), F.pmod(F.floor(F.col("run") / arity ** (j - 1)), F.lit(arity)).cast("int"))),
        ).otherwise(F.array().cast(_PATH))
        for j in range(1, levels)
    ]
    runs = runs.select(
        "tree",
        "block",
        "run",
        "total",
        *up,
        segment(0, F.col("run")).alias("segment"),
        F.slice("rows", F.col("run") * arity + 1, F.lit(arity)).alias("rows"),
        F.concat(*steps, F.col("path")).alias("above"),
    )
    ends = F.floor(F.length("segment") / DIGEST).cast("int") - 1
    leaves = runs.select("*", F.explode(F.sequence(F.lit(0), ends)).alias("at"))
    own = F.when(F.col("total") > 1, F.array(step(F.col("segment"), F.col("at")))).otherwise(F.array().cast(_PATH))
    return leaves.select(
        "tree",
        (F.col("block") * arity**levels + F.col("run") * arity + F.col("at")).alias("pos"),
        F.substring(F.col("segment"), F.col("at") * DIGEST + 1, F.lit(DIGEST)).alias("node"),
        *up,
        F.get("rows", F.col("at")).alias("row"),
        F.concat(own, "above").alias("path"),
    )


def _rounds(first: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The blocks of every round above ``first``, until each tree is one block."""
    rounds = [first]
    size = arity**levels
    largest = first.agg(F.max("total")).first()[0] or 0
    while largest > size:
        rounds.append(_blocks(_above(rounds[-1], arity, levels), arity, levels))
        largest = -(-largest // size)
    return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame, arity: int, levels: int) -> DataFrame:
    """The leaves of the first round with their paths; ``tops`` has one row for each tree."""
    parents = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        up = [n for n in tops.columns if n not in ("tree", "path")]
        parents = _below(blocks, parents, arity, levels).select("tree", F.col("pos").alias("block"), "path", *up)
    return _below(rounds[0], parents, arity, levels)


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    *,
    doc_id: str = "doc_id",
    group: str = "lang",
    carry: Mapping[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """``(id, tree, pos, leaf, path, subroot, root)`` and what ``carry`` names, a row for each of ``docs``.

    A leaf is ``leaf_of`` the ``fields``.  The leaves of a ``group`` ascend by id; every ``arity``
    consecutive nodes, the last ones being fewer or even one, become the digest of their texts, until
    one node is left, the ``subroot``.  The subroots, by group (null first, then by bytes), likewise
    give ``root``.  ``path`` lists what stands left and right of a row's node in its run, from the
    leaf to the root; ``fold`` and ``proof_digest`` read it.  ``tree`` is the group, after ``=``, and empty
    for null.  ``carry`` names further expressions over ``docs``, which come back as they are.

    Null ids come first.  Rows with equal ids come by leaf; rows equal in both are nodes of their
    own, in any order.  Null and empty texts differ.  Long texts are hashed where they are read and
    not moved.  Other columns are not read, whatever their names.  An empty table gives an empty one.

    Leaves are dealt over tasks by ranges of group, id, leaf and place of reading, so no group, however
    large, is one task; a block holds at most ``arity ** levels`` leaves, whose strings are a
    few dozen kilobytes.  Each round has that many times fewer rows, so the number of rounds is logarithmic;
    one number per round passes through the driver.
    """
    if arity < 2 or levels < 1:
        raise ValueError("a node needs two children and a block one level at least")
    carry = dict(carry or {})
    names = [f"carried_{k}" for k in range(len(carry))]
    tree = F.coalesce(F.concat(F.lit("="), c(group).cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"),
        c(doc_id).alias("id"),
        leaf_of([c(n) for n in fields]).alias("node"),
        *[v.alias(n) for n, v in zip(names, carry.values(), strict=True)],
    )
    # Finding the ranges reads its input once more: that is to be the leaves, not the texts.
    ordered = _numbered(written(leaves, "merkle-leaves"), ["id", "node"])
    rounds = _rounds(_blocks(ordered, arity, levels, ["id", *names]), arity, levels)
    tops = rounds[-1].select("tree", F.col(f"l{levels}").alias("node"))

    # The trees themselves are the leaves of one more.
    listed = _numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node"), ["own"])
    forest = _rounds(_blocks(listed, arity, levels, ["own"]), arity, levels)
    root = forest[-1].select("tree", F.array().cast(_PATH).alias("path"), F.col(f"l{levels}").alias("root"))
    found = _descend(forest, root, arity, levels)
    found = written(
        found.select(F.col("row.own").alias("tree"), F.col("node").alias("subroot"), "root", "path"), "merkle-trees"
    )
    return _descend(rounds, found, arity, levels).select(
        F.col("row.id").alias("id"),
        "tree",
        "pos",
        F.col("node").alias("leaf"),
        "path",
        "subroot",
        "root",
        *[F.col(f"row.{n}").alias(wish) for n, wish in zip(names, carry, strict=True)],
    )


def tamper_check(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every: int = 3) -> DataFrame:
    """The manifest of ``docs``, folded again for every row with the leaf it has now.

    Rows whose id's CRC-32 (of its decimal text) is a multiple of ``every`` have A-Z of their text
    lowered before their leaf is taken again; rows with a null id or text stay as they are.  Returns
    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.
    """
    chosen = F.crc32(c(doc_id).cast("string").cast("binary")) % every == 0
    changed = leaf_of([ascii_lower(c(n)) if n == text else c(n) for n in FIELDS])
    found = merkle_manifest(docs, doc_id=doc_id, carry={"changed": F.when(chosen, changed)})
    found = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
