"""Listing order, grouped headings and row layout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalox.operators.index import numbered

GUTTER, HEADING = 4, 45
#: Places of an order that one window covers.
BLOCK = 100_000


def neighbours(df: DataFrame, key: str, position: str = "position", block: int = BLOCK) -> DataFrame:
    """``df`` with the keys before and after each row in an order numbered from 0.

    Windows run over blocks of positions; a block also gets the rows that adjoin it.
    """
    own = F.floor(F.col(position) / block)
    edge = F.array_distinct(F.array(own, F.floor((F.col(position) - 1) / block), F.floor((F.col(position) + 1) / block)))
    dealt = df.withColumn("block", F.explode(edge))
    w = Window.partitionBy("block").orderBy(position)
    return dealt.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w)}).filter(F.col("block") == own).drop("block")


def islands(df: DataFrame, group: Sequence[str], position: str = "position", block: int = BLOCK) -> DataFrame:
    """Runs of equal groups in a numbered order: group columns, from, to, n. Null groups are equal.

    A run begins where the group before differs and ends before the next one begins,
    so windows run over blocks of numbers, however long a run or large a group is.
    """
    rows = neighbours(df.select(*group, position, F.struct(*group).alias("own_group")), "own_group", position, block)
    begins = numbered(rows.filter("not (own_group <=> previous)").select(*group, F.col(position).alias("from")), [F.col("from")], "run")
    last = df.agg(F.max(position)).first()[0]
    runs = neighbours(begins, "from", "run", block).withColumn("to", F.coalesce(F.col("next") - 1, F.lit(last)))
    return runs.select(*group, "from", "to", (F.col("to") - F.col("from") + 1).alias("n"))


def select_range(df: DataFrame, key: str, one, two, position: str = "position") -> DataFrame:
    """Rows from one key to the other in a numbered order, both included, whichever comes first."""
    first, last = df.filter(F.col(key).isin(one, two)).agg(F.min(position), F.max(position)).first()
    return df.filter(F.col(position).between(F.lit(first), F.lit(last)))


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def recent_unique(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The ``n`` keys seen last, newest first."""
    return df.groupBy(key).agg(F.max(time).alias("last")).orderBy(F.desc("last"), key).limit(n)


def row_packing(items: DataFrame, group: str, order: Sequence[Column], key: str, width: str = "width", height: str = "height", gallery: float = 1200.0, row_height: float = 200.0) -> DataFrame:
    """Justified rows: key, group, row (from 0 within its group), row_height, thumb_width.

    A row takes items of the standard height while they fit the gallery's width and
    breaks where the group changes. All rows of a group but its last are then scaled
    so that items and gutters fill the width exactly. Items without a positive size
    count as square. Rows of a group stream through one task, which holds one row.
    """
    aspect = F.when((F.col(width) > 0) & (F.col(height) > 0), F.col(width) / F.col(height)).otherwise(1.0)
    sized = items.select(F.col(key).alias("key"), F.col(group).alias("group"), aspect.alias("aspect"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, used, open_, out = None, 0, 0.0, [], []

        def finish(last: bool) -> None:
            if open_:
                tall = row_height if last else (gallery - GUTTER * (len(open_) - 1)) / sum(a for _, a in open_)
                out.extend((k, now, number, tall, tall * a) for k, a in open_)

        for batch in batches:
            for k, g, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = row_height * a
                if open_ and (g != now or used + wide > gallery):
                    finish(g != now)
                    number, used, open_ = (number + 1 if g == now else 0), 0.0, []
                now = g
                open_.append((k, a))
                used += wide + GUTTER
            yield _packed(out)
            out = []
        finish(True)
        yield _packed(out)

    kind = items.schema[key].dataType.simpleString()
    dealt = sized.repartition("group").sortWithinPartitions("group", "o").select("key", "group", "aspect")
    return dealt.mapInArrow(run, f"key {kind}, group string, row int, row_height double, thumb_width double").withColumnRenamed("key", key)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (None, pa.string(), pa.int32(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) if k or c else pa.array(c, pa.int64()) for c, k in zip(columns, kinds, strict=True)], names=["key", "group", "row", "row_height", "thumb_width"])


def row_offsets(packed: DataFrame, group_order: Sequence[Column], group: str = "group") -> DataFrame:
    """Vertical places of headings and rows: group, row (-1 for the heading), height, offset."""
    rows = packed.groupBy(group, "row").agg((F.max("row_height") + GUTTER).alias("height"))
    heads = rows.select(group).distinct().select(group, F.lit(-1).alias("row"), F.lit(float(HEADING + GUTTER)).alias("height"))
    every = rows.unionByName(heads)
    totals = every.groupBy(group).agg(F.sum("height").alias("total"))
    before = F.sum("total").over(Window.orderBy(*group_order).rowsBetween(Window.unboundedPreceding, -1))  # one row per group
    starts = totals.select(group, F.coalesce(before, F.lit(0.0)).alias("start"))
    within = F.sum("height").over(Window.partitionBy(group).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return every.join(starts, group).select(group, "row", "height", (F.col("start") + F.coalesce(within, F.lit(0.0))).alias("offset"))
