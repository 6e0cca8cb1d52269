"""Ordered windows over a whole frame or over large groups, without one task that holds all their rows.

A sort deals the rows to blocks by ranges of their groups and order, so a group may span many blocks and
a block hold many groups. What a row needs of the blocks before its own is one row for each block of its
group, so only as many rows as the sort has partitions are added up in one place.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dtypes import name_of

HIDDEN = "__sedge_"
RID, BLOCK, POS = HIDDEN + "rid", HIDDEN + "block", HIDDEN + "pos"
GROUP = HIDDEN + "group"  # the sorted id of the group's first row: never null, unlike the keys
INDEX_BITS = 33  # monotonically_increasing_id() is the partition, then this many bits of the row's index in it


def _aside(keys: Sequence[str], mark: str) -> dict[str, str]:
    """Hidden names for the keys on the other side of a join."""
    return {k: f"{HIDDEN}{mark}{i}" for i, k in enumerate(keys)}


def _same(other: dict[str, str]) -> list[Column]:
    return [name_of(k).eqNullSafe(F.col(h)) for k, h in other.items()]


def _bounded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each block may be broadcast; with groups there may be many more, and Spark chooses by their size."""
    return df if keys else F.broadcast(df)


def beside(df: DataFrame, keys: Sequence[str], aggregates: list[Column]) -> DataFrame:
    """df with the aggregates of each row's group beside it: they are partly added up before any shuffle, then joined."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))
    there = _aside(keys, "g")
    made = df.groupBy(*[name_of(k).alias(h) for k, h in there.items()]).agg(*aggregates)
    return df.join(made, _same(there)).drop(*there.values())


def place(df: DataFrame, order: list[Column], keys: Sequence[str] = ()) -> DataFrame:
    """df with the group and block of each row and its position in the group, from 1, in the given order.

    Without keys RID follows that order, too. The sorted rows are written to the shared folder: a sort samples
    its ranges, and one that ran twice could deal the rows otherwise.
    """
    from ..sources.io import checkpointed

    row, offset, there = HIDDEN + "row" if keys else RID, HIDDEN + "offset", _aside(keys, "g")
    df = checkpointed(df.orderBy(*map(name_of, keys), *order).withColumn(row, F.monotonically_increasing_id()))
    df = df.withColumn(BLOCK, F.shiftright(row, INDEX_BITS))
    index = lambda c: F.col(c).bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    pieces = df.groupBy(F.col(BLOCK).alias("block"), *[name_of(k).alias(h) for k, h in there.items()])
    pieces = pieces.agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("head"))
    own = Window.partitionBy(*there.values())
    before = F.coalesce(F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("block", *there.values(), F.min("head").over(own).alias(GROUP), (before - index("head")).alias(offset))
    df = df.join(_bounded(pieces, keys), [F.col(BLOCK) == F.col("block"), *_same(there)])
    return df.withColumn(POS, F.col(offset) + index(row) + 1).drop(offset, "block", *there.values())


@dataclass(eq=False)
class Shift:
    """A column of x, k rows before each row of its group (after it, if k is negative), or the default where there is none."""

    name: str
    x: Column
    k: int
    default: Column | None


@dataclass(eq=False)
class Total:
    """A column of the running total of x up to each row, null where x is: total within chunks, joined to that of the chunks before."""

    name: str
    x: Column
    total: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]


#: Rows of a group that one window takes; groups are cut into chunks of so many.
CHUNK = 1 << 18
AT, OWN = HIDDEN + "chunk", HIDDEN + "own"


def windowed(df: DataFrame, keys: Sequence[str], steps: Sequence[Shift | Total]) -> DataFrame:
    """The columns of all steps by one window over chunks of the groups.

    A chunk holds copies of the rows around it, as many as the farthest shift reaches; what it needs of the chunks before
    for totals is one row for each. Shifts beyond a chunk's size are joins by position.
    """
    for far in (s for s in steps if isinstance(s, Shift) and abs(s.k) > CHUNK):
        df = _joined(df, far)
    shifts = [s for s in steps if isinstance(s, Shift) and abs(s.k) <= CHUNK]
    totals = [s for s in steps if isinstance(s, Total)]
    if not shifts and not totals:
        return df
    df = df.withColumns({s.name: s.x for s in (*shifts, *totals)})
    chunk, index = F.floor((F.col(POS) - 1) / CHUNK), (F.col(POS) - 1) % CHUNK
    reach = max([abs(s.k) for s in shifts], default=0)
    copies = [F.struct(chunk.alias(AT), F.lit(True).alias(OWN))]
    if reach:
        copies += [F.when(edge, F.struct((chunk + by).alias(AT), F.lit(False).alias(OWN))) for edge, by in (((index < reach) & (chunk > 0), -1), (index >= CHUNK - reach, 1))]
    made = df.withColumn(AT, F.explode(F.array_compact(F.array(*copies)))).withColumns({OWN: F.col(AT + "." + OWN), AT: F.col(AT + "." + AT)})
    w = Window.partitionBy(GROUP, AT).orderBy(POS)
    out = {}
    for s in shifts:
        moved, there = (F.lag(c, s.k).over(w) if s.k >= 0 else F.lead(c, -s.k).over(w) for c in (F.col(s.name), F.lit(True)))
        out[s.name] = moved if s.default is None else F.when(there, moved).otherwise(s.default)
    if totals:
        carry = lambda s: s.name + "_carry"
        chunks = df.groupBy(GROUP, chunk.alias(AT)).agg(*[s.total(F.col(s.name)).alias(s.name) for s in totals])
        before = Window.partitionBy(GROUP).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.select(GROUP, AT, *[s.total(F.col(s.name)).over(before).alias(carry(s)) for s in totals])
        made = made.join(_bounded(chunks, keys), [GROUP, AT], "left")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for s in totals:
            own = s.total(F.when(F.col(OWN), F.col(s.name))).over(upto)
            out[s.name] = F.when(F.col(s.name).isNotNull(), F.when(F.col(carry(s)).isNull(), own).otherwise(s.join(own, F.col(carry(s)))))
    # under names of their own first, as each is made of the columns before it
    done = made.withColumns({name + "_w": c for name, c in out.items()}).where(F.col(OWN))
    return done.select(*[F.col(c + "_w").alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def _joined(df: DataFrame, s: Shift) -> DataFrame:
    there = s.name + "_there"
    df = df.withColumn(s.name, s.x)
    other = df.select(GROUP, (F.col(POS) + s.k).alias(POS), F.col(s.name).alias(s.name + "_x"), F.lit(True).alias(there))
    moved = F.col(s.name + "_x") if s.default is None else F.when(F.col(there), F.col(s.name + "_x")).otherwise(s.default)
    return df.join(other, [GROUP, POS], "left").withColumn(s.name, moved).drop(s.name + "_x", there)


def counted(df: DataFrame, name: str, keys: Sequence[str], x: Column) -> DataFrame:
    """A column of the number of rows of the group whose x isn't null."""
    return beside(df, keys, [F.count(x).alias(name)])


def ranked(df: DataFrame, name: str, keys: Sequence[str], x: Column, down: bool, dense: bool) -> DataFrame:
    """A column of the rank of x among the rows of its group, null for null: the distinct values are counted, placed and joined back."""
    df = df.withColumn(name, x)
    value, rank, there = name + "_v", name + "_r", _aside(keys, "k")
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(value), *[name_of(k).alias(h) for k, h in there.items()])
    values = place(values.agg(F.count(F.lit(1)).alias(HIDDEN + "k")), [F.desc(value) if down else F.asc(value)], tuple(there.values()))
    if dense:
        values = values.withColumn(rank, F.col(POS))
    else:
        values = windowed(values, keys, [Total(HIDDEN + "upto", F.col(HIDDEN + "k"), F.sum, operator.add)])
        values = values.withColumn(rank, F.col(HIDDEN + "upto") - F.col(HIDDEN + "k") + 1)
    values = values.select(value, rank, *there.values())
    return df.join(values, [F.col(name) == F.col(value), *_same(there)], "left").withColumn(name, F.col(rank)).drop(value, rank, *there.values())
