"""Ranking idioms that stay distributed when one group holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str], names: list[str] | None = None) -> DataFrame:
    """One row per key: the least under `order` (all ascending, NULL-free or struct-safe).

    An aggregate of one struct, so every map task folds its rows before the shuffle and a hot
    key costs one row per task instead of one oversized window partition. The order columns are
    kept as well where `names` says under which names, so that none has to travel twice.
    """
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in keep])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best._o{i}").alias(n) for i, n in enumerate(names or [])], *[F.col(f"_best.{c}").alias(c) for c in keep])


def descending(col: Column) -> Column:
    """Ascending-sort stand-in for a descending number; NULL sorts last."""
    return F.coalesce(-col, F.lit(float("inf")))


def _in_ranges(df: DataFrame, order: list[Column | tuple[Column, bool]], keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """Rows stored by ranges of the whole sort key with their range number, and the order within a range."""
    given = [o if isinstance(o, tuple) else (o, False) for o in order]
    sort = {f"_o{i}": c for i, (c, _) in enumerate(given)}
    by = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(sort, given)]
    ranged = df.withColumns(sort).repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id())
    return materialize(ranged, "ranked"), by


def _carried(tagged: DataFrame, local: Column, amount: Column, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    """`local` results of each range, shifted by the amounts of the earlier ranges of the same key."""
    sums = tagged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = tagged.withColumn("_local", local).join(offsets, [*keys, "_range"])
    return joined.select(*columns, (F.col("_offset") + F.col("_local")).alias(name))


def spread_rank(df: DataFrame, order: list[Column | tuple[Column, bool]], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Exact 1-based position of each row under `order` (NULL-free, ending in a unique column), within `keys`.

    A column sorts ascending, or by `(column, descending)`.

    Rows are range-partitioned by the whole sort key and stored with their range number; then each
    range ranks its own rows, shifted by the count of earlier rows of the same key. The result is
    that of `row_number()`, whatever ranges Spark picked, but no task sorts a whole key, so one key
    (or the whole table) may hold any share of the rows.
    """
    keys = keys or []
    tagged, by = _in_ranges(df, order, keys)
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*by))
    return _carried(tagged, local, F.lit(1), keys, name, df.columns)


def _numbered(keys: list[str], columns: list[str], name: str):
    """Rows of a sorted range with their place in the run of their key, and whether that is the range's first run."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, count, head = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in keys:
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            start = tuple(batch.column(c)[0].as_py() for c in keys)
            if last is not None and start != last:
                change[0] = True
            at = np.arange(batch.num_rows)
            opened = np.maximum.accumulate(np.where(change, at, -1))
            place = np.where(opened < 0, at + count + 1, at - opened + 1)
            first = (opened < 0) & head
            last, count, head = tuple(batch.column(c)[-1].as_py() for c in keys), int(place[-1]), bool(first[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(place, pa.int64()), pa.array(first)], names=[*columns, name, "_head"])

    return run


def run_rank(df: DataFrame, order: list[Column], keys: list[str], name: str, keep: list[str]) -> DataFrame:
    """`spread_rank` of ascending `order` where rows are many: `keys`, `keep` and the position, moved once.

    A range numbers its rows as they are stored, and only the columns asked for are. A key goes on into a range only as
    that range's first one, so what earlier ranges hold is counted for these few keys, one to a range.
    """
    sort = {f"_o{i}": c for i, c in enumerate(order)}
    columns = [*keys, *keep, "_range"]
    ranged = df.select(*keys, *keep, *[c.alias(n) for n, c in sort.items()]).repartitionByRange(*keys, *sort)
    sorted_ = ranged.withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*keys, *sort)
    schema = sorted_.select(*columns).schema.add(name, "long").add("_head", "boolean")
    rows = materialize(sorted_.mapInArrow(_numbered(keys, columns, name), schema), "ranked", "zstd")
    heads = materialize(rows.filter("_head").select(*keys).distinct(), "heads")
    same = lambda a, b, names: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in names])
    counts = rows.join(heads, same(rows, heads, keys), "left_semi").groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = materialize(counts.select(*keys, "_range", before.alias("_offset")).filter("_offset > 0"), "offsets")
    carried = rows.join(offsets, same(rows, offsets, [*keys, "_range"]), "left")
    return carried.select(*[rows[c] for c in (*keys, *keep)], (F.col(name) + F.coalesce("_offset", F.lit(0))).alias(name))


def spread_sum(df: DataFrame, amount: str, order: list[Column | tuple[Column, bool]], keys: list[str], name: str) -> DataFrame:
    """Exact running sum of the whole-number column `amount` up to and with each row, within `keys`.

    Two levels like `spread_rank`: a sum inside each range of the sort key, and the totals of the
    earlier ranges carried in. `order` is NULL-free and tells all rows of a key apart.
    """
    tagged, by = _in_ranges(df, order, keys)
    local = F.sum(amount).over(W.partitionBy(*keys, "_range").orderBy(*by).rowsBetween(W.unboundedPreceding, 0))
    return _carried(tagged, local, F.col(amount), keys, name, df.columns)
