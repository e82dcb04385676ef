"""Column helpers for the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Array of (start, end, value, before, after) of all leftmost matches.

    Positions count code points, the end is exclusive; ``before`` and ``after``
    are up to ``context`` characters between this match and its neighbours.
    Starts are running sums, taken over chunks so that the cost stays near
    linear in the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    kind = "struct<start: int, end: int, value: string, before: string, after: string>"

    def chunk(both: Column, at: Column, number: Column) -> Column:
        part = F.slice(both["z"], number * _CHUNK + 1, _CHUNK)

        def step(acc: Column, z: Column) -> Column:
            start = acc["at"] + F.length(z["gap"])
            end = start + F.length(z["value"])
            span = F.struct(
                start.alias("start"), end.alias("end"), z["value"].alias("value"), F.right(z["gap"], F.lit(context)).alias("before"), F.left(z["after"], F.lit(context)).alias("after")
            )
            return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("spans")), step)

    def collect(both: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(both["z"]) - 1) / _CHUNK).cast("int"))
        start = F.array().cast(f"array<struct<at: int, spans: array<{kind}>>>")
        chunks = F.aggregate(numbers, start, lambda acc, n: F.array_append(acc, chunk(both, F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0)), n)))
        return F.flatten(F.transform(chunks, lambda c: c["spans"]))

    zipped = let(
        F.struct(found.alias("found"), gaps.alias("gaps")),
        lambda p: F.struct(
            F.zip_with(
                p["found"],
                F.arrays_zip(F.slice(p["gaps"], F.lit(1), F.size(p["found"])).alias("gap"), F.slice(p["gaps"], F.lit(2), F.greatest(F.size(p["found"]), F.lit(1))).alias("after")),
                lambda v, g: F.struct(v.alias("value"), g["gap"].alias("gap"), g["after"].alias("after")),
            ).alias("z")
        ),
    )
    none = F.array().cast(f"array<{kind}>")
    return let(zipped, lambda both: F.when(F.size(both["z"]) > 0, collect(both)).otherwise(none))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], state: str, emitted: str) -> Column:
    """Array of what ``step(state, item)`` emits for each item in turn, next to the new state.

    Taken over chunks, so that the cost stays near linear in the number of
    items.  ``state`` and ``emitted`` are types.
    """
    none = F.array().cast(f"array<{emitted}>")

    def fold(acc: Column, item: Column) -> Column:
        new, out = step(acc["state"], item)
        return F.struct(new.cast(state).alias("state"), F.array_append(acc["out"], out.cast(emitted)).alias("out"))

    def chunk(every: Column, at: Column, number: Column) -> Column:
        return F.aggregate(F.slice(every, number * _CHUNK + 1, _CHUNK), F.struct(at.cast(state).alias("state"), none.alias("out")), fold)

    def collect(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / _CHUNK).cast("int"))
        start = F.array().cast(f"array<struct<state: {state}, out: array<{emitted}>>>")
        chunks = F.aggregate(numbers, start, lambda acc, n: F.array_append(acc, chunk(every, F.coalesce(F.try_element_at(acc, F.lit(-1))["state"], zero.cast(state)), n)))
        return F.flatten(F.transform(chunks, lambda c: c["out"]))

    return let(items, lambda every: F.when(F.size(every) > 0, collect(every)).otherwise(none))


_PIECE = 4096


def pieces(text: Column) -> Column:
    """The text cut into pieces of 4096 characters, from which ``cut`` takes parts without going through the whole."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}+"), 0)


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end, exclusive, of the text that was cut into ``parts``."""

    def join(at: Column) -> Column:
        i, j = at["i"], at["j"]
        head = F.substring(F.get(parts, i), at["a"] % _PIECE + 1, F.lit(_PIECE))
        tail = F.substring(F.get(parts, j), F.lit(1), (at["b"] - 1) % _PIECE + 1)
        inside = F.substring(F.get(parts, i), at["a"] % _PIECE + 1, at["b"] - at["a"])
        return F.when(at["b"] <= at["a"], "").when(i == j, inside).otherwise(F.concat(head, F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), tail))

    number = lambda c: F.floor(c / _PIECE).cast("int")
    return let(F.struct(start.alias("a"), end.alias("b"), number(start).alias("i"), number(end - 1).alias("j")), join)
