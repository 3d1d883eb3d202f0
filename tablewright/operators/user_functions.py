"""Functions of the user's own as steps: table functions, and aggregates that combine in the tasks.

Both become step kinds, so that pipelines hold them beside the built-in steps and are replayed with
them.  Rows travel between Spark and Python in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.errors import RequestError
from tablewright.functions.columns import require, select_all, visible
from tablewright.operators.cleaning import Params, register_step
from tablewright.workspace import workers_find_library

#: States an aggregate's task holds before it passes them on, and the parts into which the states of
#: one key are spread on their way.
HELD_STATES, SPREAD = 10_000, 16


# --- table functions ------------------------------------------------------------------------


def register_table_function(name: str, handler: type, validate: Callable[[Params], None] = lambda p: None) -> None:
    """Add a table function as a step.

    ``handler`` has ``eval(row, **args)``, which yields rows, perhaps ``terminate()``, and a static
    ``analyze(table, **args)``, which tells the columns of the result from those of the table and
    the arguments.  The step's parameters are ``args`` (a mapping), ``partition_by`` and
    ``order_by`` (lists of columns).  Rows of one partition come one by one to one instance, so a
    large partition needs time but no memory; without ``partition_by`` every task takes its own rows
    and nothing is shuffled.
    """
    if not callable(getattr(handler, "analyze", None)) or not callable(getattr(handler, "eval", None)):
        raise RequestError("a table function needs eval and analyze", code="bad_table_function")
    function = F.udtf(handler, useArrow=True)

    def apply(df: DataFrame, params: Params) -> DataFrame:
        return table_function(df, function, params.get("args") or {}, params.get("partition_by") or (), params.get("order_by") or ())

    register_step(name, apply, validate)


def table_function(
    df: DataFrame, function: Any, args: Mapping[str, Any], partition_by: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The rows a table function makes of ``df``; the hidden ordinal is not shown to it."""
    require(df, [*partition_by, *order_by])
    if order_by and not partition_by:
        raise RequestError("an order needs partitions to order within", code="no_partition")
    workers_find_library(df.sparkSession)
    table = df.select(*select_all(visible(df))).asTable()
    if partition_by:
        table = table.partitionBy(*select_all(partition_by))
    if order_by:
        table = table.orderBy(*select_all(order_by))
    return function(table, **{n: F.lit(value) for n, value in args.items()})


# --- aggregates -------------------------------------------------------------------------------


@dataclass(frozen=True)
class UserAggregate:
    """An aggregate by its states: rows become a state, two states one, and a state the result.

    ``partial`` takes a record batch with the chosen columns and gives a state, a mapping of the
    fields in ``state`` (DDL).  ``merge`` must not care for order or grouping.  ``finish`` gives the
    result, of the type ``returns``.
    """

    state: str
    returns: str
    partial: Callable[[pa.RecordBatch], Mapping[str, Any]]
    merge: Callable[[Mapping[str, Any], Mapping[str, Any]], Mapping[str, Any]]
    finish: Callable[[Mapping[str, Any]], Any]


def register_aggregate(name: str, aggregate: UserAggregate) -> None:
    """Add an aggregate as a step with the parameters ``columns``, ``by`` and ``as``."""

    def validate(params: Params) -> None:
        if not params.get("columns") or not params.get("as"):
            raise RequestError("missing parameter: columns, as", code="no_parameter")

    def apply(df: DataFrame, params: Params) -> DataFrame:
        return aggregated(df, aggregate, list(params["columns"]), list(params.get("by") or []), str(params["as"]))

    register_step(name, apply, validate)


def aggregated(df: DataFrame, aggregate: UserAggregate, columns: list[str], by: list[str], result: str) -> DataFrame:
    """One row per combination of ``by`` (NULL is a value) with the aggregate as ``result``.

    Each task makes one state per key of its rows and hands on no more.  States of a key then meet in
    SPREAD parts before they meet in one, sorted by key, so that a task holds one state at a time and
    a hot key is never gathered.  Without ``by`` there is one row, and none if the table has no rows.
    """
    require(df, [*columns, *by])
    if result in by:
        raise RequestError(f"column already exists: {result}", code="duplicate_column")
    workers_find_library(df.sparkSession)
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(
        *[c.alias(k) for k, c in zip(keys, select_all(by), strict=True)],
        *[c.alias(f"v{i}") for i, c in enumerate(select_all(columns))],
    )
    of_keys = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    if any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) for f in of_keys):
        raise RequestError("nested values cannot be keys of an aggregate", code="not_comparable")
    state = T.StructType.fromDDL(aggregate.state)
    states = T.StructType([*of_keys, T.StructField("part", T.IntegerType()), T.StructField("state", state)])
    ended = T.StructType([*of_keys, *T.StructType.fromDDL(f"result {aggregate.returns}").fields])
    task = _Task(aggregate, keys, columns, to_arrow_type(state), to_arrow_type(ended["result"].dataType))
    order = [F.col(k) for k in keys]
    once = rows.mapInArrow(task.first, states)
    spread = once.repartition(*order, F.col("part")).sortWithinPartitions(*order, "part")
    twice = spread.mapInArrow(task.merged, states)
    met = twice.repartition(*order).sortWithinPartitions(*order) if keys else twice.coalesce(1)
    return met.mapInArrow(task.finished, ended).select(
        *[F.col(k).alias(n) for k, n in zip(keys, by, strict=True)], F.col("result").alias(result)
    )


Keyed = tuple[tuple, Mapping[str, Any]]


@dataclass(frozen=True)
class _Task:
    """What tasks do to the batches of rows and states."""

    aggregate: UserAggregate
    keys: list[str]
    columns: list[str]
    state_type: pa.DataType
    result_type: pa.DataType

    def first(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state per key, in runs of HELD_STATES keys."""
        held: dict[tuple, Keyed] = {}
        turn, types = TaskContext.get().partitionId(), None
        for batch in batches:
            types = [batch.schema.field(k).type for k in self.keys]
            values = batch.select([f"v{i}" for i in range(len(self.columns))]).rename_columns(self.columns)
            for key, places in self._places(batch):
                self._add(held, key, self.aggregate.partial(values.take(places)))
            if len(held) > HELD_STATES:
                yield self._batch(list(held.values()), types, turn)
                held, turn = {}, turn + 1
        if held:
            yield self._batch(list(held.values()), types, turn)

    def merged(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours with the same key as one state."""
        for found, types in self._runs(batches):
            yield self._batch(found, types, 0)

    def finished(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, types in self._runs(batches):
            results = pa.array([self.aggregate.finish(state) for _, state in found], self.result_type)
            yield pa.RecordBatch.from_arrays([*self._key_arrays(found, types), results], [*self.keys, "result"])

    def _places(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array]]:
        """The keys of a batch with the numbers of their rows."""
        numbers = pa.array(range(batch.num_rows), pa.int64())
        if not self.keys:
            yield (), numbers
            return
        table = pa.table([*[batch.column(k) for k in self.keys], numbers], [*self.keys, "row"])
        groups = table.group_by(self.keys, use_threads=False).aggregate([("row", "list")])
        rows = groups.column("row_list").combine_chunks()
        for i, key in enumerate(zip(*[groups.column(k).to_pylist() for k in self.keys], strict=True)):
            yield key, rows[i].values

    def _add(self, held: dict[tuple, Keyed], key: tuple, state: Mapping[str, Any]) -> None:
        mark = _comparable(key)
        held[mark] = (key, self.aggregate.merge(held[mark][1], state) if mark in held else state)

    def _runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Keyed], list[pa.DataType]]]:
        """States in the order of their keys, merged; what is complete after each batch."""
        held: dict[tuple, Keyed] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in self.keys]
            lists = [batch.column(k).to_pylist() for k in self.keys]
            keys = zip(*lists, strict=True) if lists else [()] * batch.num_rows
            for key, state in zip(keys, batch.column("state").to_pylist(), strict=True):
                self._add(held, key, state)
            # The last key may go on in the next batch.
            *complete, last = held.items()
            if complete:
                yield [found for _, found in complete], types
            held = dict([last])
        if held:
            yield list(held.values()), types

    def _batch(self, found: list[Keyed], types: list[pa.DataType], turn: int) -> pa.RecordBatch:
        parts = pa.array([turn % SPREAD] * len(found), pa.int32())
        states = pa.array([dict(state) for _, state in found], self.state_type)
        return pa.RecordBatch.from_arrays(
            [*self._key_arrays(found, types), parts, states], [*self.keys, "part", "state"]
        )

    def _key_arrays(self, found: list[Keyed], types: list[pa.DataType]) -> list[pa.Array]:
        return [pa.array([key[i] for key, _ in found], kind) for i, kind in enumerate(types)]


def _comparable(key: tuple) -> tuple:
    """``key`` in a form in which NaN equals NaN."""
    return tuple("NaN" if isinstance(x, float) and x != x else x for x in key)
