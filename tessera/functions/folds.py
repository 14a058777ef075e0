"""Folds over long arrays in a row's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Items of a chunk of a fold.
CHUNK = 1024


def fold_chunks(items: Column, state, zero: dict, step, done: str) -> Column:
    """The state after folding ``items`` with ``step``.

    The state is ``state(**fields)``, its field ``done`` an array that only grows. It
    is empty at the start of each chunk and joins the finished ones at its end, so a
    step never copies more than a chunk's results."""
    def chunk(all_items: Column):
        def run(acc: Column, k: Column) -> Column:
            own = F.slice(all_items, k * CHUNK + 1, F.lit(CHUNK))
            fresh = state(**{f: none_of(done) if f == "done" else acc[f] for f in zero})
            return let(F.aggregate(own, fresh, step), lambda now: state(**{f: F.concat(acc["done"], now["done"]) if f == "done" else now[f] for f in zero}))
        return run

    last = lambda a: F.greatest(F.floor((F.size(a) - 1) / CHUNK).cast("int"), F.lit(0))
    return let(items, lambda a: F.aggregate(F.sequence(F.lit(0), last(a)), state(**zero), chunk(a)))


def none_of(element: str) -> Column:
    return F.array().cast(f"array<{element}>")
