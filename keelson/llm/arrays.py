"""Expressions over the array of one row: running states, and where a pattern's matches stand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of one piece of a text that spans are cut from.
PIECE = 4096


def bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x worked out once, however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """What ``step(state, item)``, a struct<state, out>, puts out for each item in order: array<out_type>.

    Appending to an array copies it, so items are worked through in sqrt(n) chunks, which makes the
    copies n^1.5 references instead of n^2.
    """
    none, nones = (F.expr(f"cast(array() as array<{t}>)") for t in (out_type, f"array<{out_type}>"))

    def one(acc: Column, x: Column) -> Column:
        return bind(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def chunk(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("outs")), one)
        return bind(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")))

    def whole(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda i: F.slice(xs, i * width + 1, width))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(chunks, F.struct(zero.alias("state"), nones.alias("outs")), chunk, lambda acc: acc["outs"]))).otherwise(none)

    return bind(items, whole)


def places(text: Column, pattern: Column, measure: Callable[[Column], Column], context: int = 0) -> Column:
    """Matches of a pattern in order: array<struct<start: bigint, end: bigint, hit: string, before: string, after: string>>.

    ``measure`` gives the length of a piece of text; the text between matches tells where they begin.
    ``before`` are the last ``context`` code points between a match and the one before it, ``after`` is
    the code point behind it, unless the next match begins there.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array(F.lit(None).cast("string"))
    zipped = bind(gaps, lambda g: F.arrays_zip(g.alias("gap"), F.concat(hits, none).alias("hit"), F.concat(F.slice(g, F.lit(2), F.size(g)), none).alias("next")))

    def step(at: Column, x: Column) -> Column:
        def found(start: Column) -> Column:
            end = start + F.coalesce(measure(x["hit"]), F.lit(0)).cast("bigint")
            before = F.substring(x["gap"], -context, context) if context else F.lit("")
            return F.struct(end.alias("state"), F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), before.alias("before"), F.substring(x["next"], 1, 1).alias("after")).alias("out"))

        return bind(at + measure(x["gap"]).cast("bigint"), found)

    every = scan(zipped, F.lit(0).cast("bigint"), step, "struct<start:bigint,end:bigint,hit:string,before:string,after:string>")
    return F.filter(every, lambda x: x["hit"].isNotNull())


def pieces(text: Column) -> Column:
    """A text as an array of PIECE code points each."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points start..end of a text given by ``pieces``; costs their number and two pieces, not the text before."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor((end - 1) / PIECE).cast("int") - first + 1
    some = F.substring(F.array_join(F.slice(parts, first + 1, count), ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, some).otherwise(F.lit(""))
