"""Spans of regular expression matches as DataFrame columns, in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A noncharacter that marks the ends of matches; texts that hold it get another one there.
MARK, OTHER = "￿", "￾"
#: Offsets are summed within blocks of this many pieces and then over blocks, so that a text with n matches costs far less than n * n.
BLOCK = 256

EMPTY = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def clean(text: Column) -> Column:
    """The text with the mark replaced; its length in code points stays."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)


def with_matches(df: DataFrame, text: str, name: str, pattern: str, guard: Column | None = None, around: tuple[int, int] = (40, 20)) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches of a Java pattern in column ``text`` (see ``clean``).

    Each match has start and end (exclusive) in code points, its value, and some
    text before and after it. ``guard`` says which rows need looking at.
    """
    pieces, lengths, starts = f"_{name}_p", f"_{name}_l", f"_{name}_s"
    cut = F.split(F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    df = df.withColumn(pieces, cut if guard is None else F.when(guard, cut))
    df = df.withColumn(lengths, F.when(F.size(pieces) > 1, F.transform(pieces, lambda x: F.length(x))))
    df = df.withColumn(
        starts,
        F.expr(f"""
        flatten(transform(
          aggregate(
            transform(sequence(0, (size({lengths}) - 1) div {BLOCK}), b -> aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x)),
            named_struct('at', 0, 'all', cast(array() as array<int>)),
            (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at))),
            s -> s.all),
          (first, b) -> aggregate(
            slice({lengths}, b * {BLOCK} + 1, {BLOCK}),
            named_struct('at', first, 'all', cast(array() as array<int>)),
            (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at))),
            s -> s.all)))"""),
    )
    found = F.expr(f"""
        transform(sequence(1, size({pieces}) div 2), k -> named_struct(
          'start', {starts}[2 * k - 1], 'end', {starts}[2 * k - 1] + {lengths}[2 * k - 1], 'value', {pieces}[2 * k - 1],
          'before', right({pieces}[2 * k - 2], {around[0]}), 'after', left({pieces}[2 * k], {around[1]})))""")
    return df.withColumn(name, F.when(F.size(lengths) > 1, found).otherwise(F.array().cast(EMPTY))).drop(pieces, lengths, starts)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
