"""Line vectors: a document's lines as short strings of codes, and how far two of them overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Code -> what it stands for, and its weight.
START, TEXT, SINGLE, DOUBLE, TRIPLE, END = "012345"
WEIGHTS = {START: 3, TEXT: 1, SINGLE: 3, DOUBLE: 6, TRIPLE: 10, END: 3}


def code(kind: Column, number: Column, last: Column, marked: Column, fresh: Column) -> Column:
    """A line's codes: a text line's range, after the start code if it opens a run unmarked; a ruling's; the end's; else none."""
    begun = F.when(fresh & ~marked, START).otherwise("")
    ruling = F.when(number == 1, SINGLE).when(number == 2, DOUBLE).when(number == 3, TRIPLE).otherwise("")
    text = F.concat(begun, F.repeat(F.lit(TEXT), (last - number + 1).cast("int")))
    return F.coalesce(F.when(kind == "text", text).when(kind == "ruling", ruling).when(kind == "end", END), F.lit(""))


def vectors(lines: Column) -> Column:
    """array<string>: the codes of each run of lines; a run ends where a text line's number is not above the last one.

    lines: array of structs (kind: text, ruling, end or another; number; last: a range's last number, or the number; marked: a
    prime or a prefix stands at the number). A run that opens with an unmarked text line has the start code, a range has
    its code once for each line. If the first run has no codes there are no vectors. A null array gives null.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(True).alias("fresh"), F.lit(-1).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        text, last = x["kind"] == "text", x["last"].cast("long")
        opens = text & (s["at"] >= last)
        now = code(x["kind"], x["number"], last, x["marked"], s["fresh"] | opens)
        return F.struct(
            F.when(opens, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(opens, now).otherwise(F.concat(s["now"], now)).alias("now"),
            F.lit(False).alias("fresh"),
            F.when(text, last).otherwise(s["at"]).alias("at"),
        )

    def finish(s: Column) -> Column:
        every = F.concat(s["done"], F.array(s["now"]))
        return F.when(F.get(every, F.lit(0)) == "", F.array().cast("array<string>")).otherwise(every)

    return F.aggregate(lines, state, step, finish)


def weight(codes: Column) -> Column:
    return sum((F.length(codes) - F.length(F.replace(codes, F.lit(c), F.lit("")))) * w for c, w in WEIGHTS.items())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column) -> Column:
    """The longest suffix of the shorter string that begins the longer one, or all of it if it lies within; else empty."""

    def find(x: Column) -> Column:
        part = lambda i: F.right(x["short"], i)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(x["short"]), F.lit(1))), lambda i: F.startswith(x["long"], part(i)))
        return F.when(F.contains(x["long"], x["short"]), x["short"]).otherwise(part(F.coalesce(F.array_max(ends), F.lit(0))))

    swap = F.length(a) > F.length(b)
    return _let(F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long")), find)


def overlap(a: Column, b: Column) -> Column:
    """struct (score, weighted) of two vectors: the longest overlap, read forwards or backwards, by length and by weight."""
    both = F.struct(_common(a, b).alias("there"), _common(F.reverse(a), F.reverse(b)).alias("back"))
    return _let(both, lambda x: F.struct(F.greatest(F.length(x["there"]), F.length(x["back"])).alias("score"), F.greatest(weight(x["there"]), weight(x["back"])).alias("weighted")))
