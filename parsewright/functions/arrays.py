"""Columns that are made from columns by functions of Arrow arrays, inside the row and piece by piece."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a batch that are held as Python values at once.
PIECE = 256


def in_pieces(rows: pa.Array, make: Callable, values: bool = True) -> pa.Array:
    """``make`` of pieces of an Arrow array, as one array; pieces come as lists of Python values, or as Arrow arrays."""
    cut = [rows.slice(k, PIECE) for k in range(0, max(len(rows), 1), PIECE)]
    return pa.concat_arrays([make(x.to_pylist() if values else x) for x in cut])


def listed(valid: list[bool], ends: list[int] | np.ndarray, items: pa.Array) -> pa.Array:
    """A list a row of consecutive items; row k has those from ``ends[k]`` to ``ends[k + 1]``, null where it is not valid."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([not x for x in valid], pa.bool_()))


def arrow_column(run: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A function of columns that runs on Arrow arrays. Marked so that the optimizer neither repeats it in a filter below nor above."""
    return F.arrow_udf(run, kind).asNondeterministic()


#: Items of a running fold that are worked on together.
CHUNK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named. Its result is copied: keep that small in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)`` for every item, with the state after ``step(state, item)``; ``kind`` is the type of a result.

    Spark copies what a fold carries at each of its steps, so none may carry all results. The items are cut into chunks: a
    fold over chunks finds the state at the start of each, and each chunk's own fold carries the results of that chunk.
    """

    def within(chunk: Column, state: Column) -> Column:
        # A result is made one item later, from the state that then stands as a value; the first, of the start, is dropped.
        first = F.struct(F.struct(state.alias("state"), F.get(chunk, F.lit(-1)).alias("item")).alias("cur"), F.array().cast(f"array<{kind}>").alias("made"))
        more = lambda acc: F.concat(acc["made"], F.array(out(acc["cur"]["state"], acc["cur"]["item"]).cast(kind)))
        one = lambda acc, item: F.struct(F.struct(step(acc["cur"]["state"], item).alias("state"), item.alias("item")).alias("cur"), more(acc).alias("made"))
        return F.aggregate(chunk, first, one, lambda acc: F.slice(more(acc), F.lit(2), F.size(chunk)))

    def fold(chunks: Column) -> Column:
        before = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))
        states = F.aggregate(before, F.array(start), lambda seen, chunk: F.concat(seen, F.array(F.aggregate(chunk, F.element_at(seen, -1), step))))
        return F.flatten(F.zip_with(chunks, states, lambda chunk, state: within(chunk, state)))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / CHUNK).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK)))
    return let(let(items, lambda x: F.when(x.isNotNull(), cut(x))), fold)
