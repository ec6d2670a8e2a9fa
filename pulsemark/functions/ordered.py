"""Ordered (window-like) work that stays balanced when one key holds most rows.

``with_order`` gives running sums, previous/next values and previous/next
non-null values in a key's order.  Keys of ordinary size use one shuffle and one
Spark window.  Keys above ``spark.pulsemark.hotRows`` rows are range-partitioned
on (keys, order), so that their rows spread over many tasks; each task works on
its own stretch and a carry table, of at most two rows per partition, links the
stretches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsemark.session import hot_rows, partitions, settle

ALL = "_all"
_PART = "_part"
GROUP_LIMIT = 1000  # Spark's default threshold for the window group limit
Exprs = Mapping[str, Column]


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    One map-side combined count; the answer has at most rows/limit rows.
    """
    bound = hot_rows(df.sparkSession) if limit is None else limit
    found = df.groupBy(*keys).count().where(F.col("count") > bound).select(*keys)
    return None if found.isEmpty() else settle(found)


def with_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    prefix: Exprs | None = None,
    prev: Exprs | None = None,
    nxt: Exprs | None = None,
    prev_valid: Exprs | None = None,
    next_valid: Exprs | None = None,
    total: Exprs | None = None,
    hot: DataFrame | None | str = "auto",
) -> DataFrame:
    """Add ordered columns; ``order`` must be unique within ``keys`` to be deterministic.

    ``prefix`` are exclusive running sums (0 at the start), ``prev``/``nxt`` the
    neighbouring row's value, ``prev_valid``/``next_valid`` the nearest non-null
    value strictly before/after the row, ``total`` whole-key sums.  ``hot`` is a table of hot keys, None
    when the caller knows there are none, or "auto" to look for them.
    """
    groups = {
        "prefix": dict(prefix or {}),
        "prev": dict(prev or {}),
        "nxt": dict(nxt or {}),
        "prev_valid": dict(prev_valid or {}),
        "next_valid": dict(next_valid or {}),
        "total": dict(total or {}),
    }
    keys = list(keys)
    order = list(order)
    if not keys:
        out = _split(df.withColumn(ALL, F.lit(0)), [ALL], order, groups)
        return out.drop(ALL)
    if isinstance(hot, str):
        hot = hot_keys(df, keys)
    if hot is None:
        return _plain(df, keys, order, groups)
    spread = _split(df.join(F.broadcast(hot), keys, "left_semi"), keys, order, groups)
    rest = _plain(df.join(F.broadcast(hot), keys, "left_anti"), keys, order, groups)
    return rest.unionByName(spread)


def _local(df: DataFrame, keys: list[str], order: list[str], groups) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # the next non-null is the last one before the row in reverse order: one more sort, still linear
    # (a frame that ends at unboundedFollowing is re-read for every row)
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    behind = back.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(e).over(before), F.lit(0)).alias(n) for n, e in groups["prefix"].items()]
    cols += [F.lag(e).over(w).alias(n) for n, e in groups["prev"].items()]
    cols += [F.lead(e).over(w).alias(n) for n, e in groups["nxt"].items()]
    cols += [F.last(e, ignorenulls=True).over(before).alias(n) for n, e in groups["prev_valid"].items()]
    cols += [F.last(e, ignorenulls=True).over(behind).alias(n) for n, e in groups["next_valid"].items()]
    cols += [F.sum(e).over(Window.partitionBy(*keys)).alias(n) for n, e in groups["total"].items()]
    return df.select("*", *cols)


def _plain(df: DataFrame, keys: list[str], order: list[str], groups) -> DataFrame:
    return _local(df, keys, order, groups)


def _split(df: DataFrame, keys: list[str], order: list[str], groups) -> DataFrame:
    columns = df.columns
    for group in groups.values():
        for name, expr in group.items():
            df = df.withColumn("_e_" + name, expr)
    base = settle(
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn(
            _PART, F.spark_partition_id()
        )
    )
    values = {kind: {n: F.col("_e_" + n) for n in group} for kind, group in groups.items()}
    # positions inside a stretch: the first/last row decides where a carry applies
    stretch = _local(
        base,
        [_PART, *keys],
        order,
        {
            **values,
            "prev": {**values["prev"], "_has_prev": F.lit(1)},
            "nxt": {**values["nxt"], "_has_next": F.lit(1)},
            "total": {},
        },
    )
    at = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for n, e in [*values["prefix"].items(), *values["total"].items()]:
        aggs.append(F.sum(e).alias("_s_" + n))
    for n, e in values["prev"].items():
        aggs.append(F.max_by(e, at).alias("_s_" + n))
    for n, e in values["nxt"].items():
        aggs.append(F.min_by(e, at).alias("_s_" + n))
    for n, e in values["prev_valid"].items():
        aggs.append(F.max_by(e, F.when(e.isNotNull(), at)).alias("_s_" + n))
    for n, e in values["next_valid"].items():
        aggs.append(F.min_by(e, F.when(e.isNotNull(), at)).alias("_s_" + n))
    edges = base.groupBy(_PART, *keys).agg(*aggs)
    w = Window.partitionBy(*keys).orderBy(_PART)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col(_PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_stretches")]
    for n in values["prefix"]:
        carry.append(F.sum("_s_" + n).over(before).alias("_c_" + n))
    for n in values["prev"]:
        carry.append(F.lag("_s_" + n).over(w).alias("_c_" + n))
    for n in values["nxt"]:
        carry.append(F.lead("_s_" + n).over(w).alias("_c_" + n))
    for n in values["prev_valid"]:
        carry.append(F.last("_s_" + n, ignorenulls=True).over(before).alias("_c_" + n))
    for n in values["next_valid"]:
        carry.append(F.last("_s_" + n, ignorenulls=True).over(behind).alias("_c_" + n))
    # only a partition's first and last key can continue elsewhere: <= 2 rows per partition
    carries = edges.select(_PART, *keys, *carry).where("_stretches > 1").drop("_stretches")
    renamed = carries.select(
        F.col(_PART).alias("_cp"), *[F.col(k).alias("_ck_" + k) for k in keys], *[c for c in carries.columns if c.startswith("_c_")]
    )
    on = F.col(_PART) == F.col("_cp")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_ck_" + k))
    joined = stretch.join(F.broadcast(renamed), on, "left")
    if values["total"]:
        # one row per split key, at most rows / hotRows of them
        whole = edges.groupBy(*[F.col(k).alias("_tk_" + k) for k in keys]).agg(
            *[F.sum("_s_" + n).alias(n) for n in values["total"]]
        )
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("_tk_" + k))
        joined = joined.join(F.broadcast(whole), same)
    cols = []
    for n in values["prefix"]:
        cols.append((F.col(n) + F.coalesce(F.col("_c_" + n), F.lit(0))).alias(n))
    for n in values["prev"]:
        cols.append(F.when(F.col("_has_prev").isNull(), F.col("_c_" + n)).otherwise(F.col(n)).alias(n))
    for n in values["nxt"]:
        cols.append(F.when(F.col("_has_next").isNull(), F.col("_c_" + n)).otherwise(F.col(n)).alias(n))
    for kind in ("prev_valid", "next_valid"):
        for n in values[kind]:
            cols.append(F.coalesce(F.col(n), F.col("_c_" + n)).alias(n))
    return joined.select(*columns, *cols, *values["total"])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot: DataFrame | None | str = "auto"
) -> DataFrame:
    """0-based dense position of each row within ``keys`` (all rows when empty)."""
    out = with_order(df, keys, order, prefix={name: F.lit(1)}, hot=hot)
    return out.withColumn(name, F.col(name).cast("long"))


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, hot: DataFrame | None | str = "auto"
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``.

    For a small ``k`` Spark cuts every group to k rows per input task before the
    shuffle (window group limit), so a hot group needs no splitting.
    """
    if keys and k <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_pos", rank).where(F.col("_pos") <= k).drop("_pos")
    return with_position(df, keys, order, "_pos", hot).where(F.col("_pos") < k).drop("_pos")


def with_neighbours(
    df: DataFrame, keys: Sequence[str], index: str, lags: Mapping[str, tuple[str, int]], chunk: int = 1 << 16
) -> DataFrame:
    """Add ``name`` = value of column ``c`` at ``index - k`` for ``lags[name] = (c, k)``.

    ``index`` is a dense position, so a key is cut into fixed stretches of
    ``chunk`` positions with a halo of the longest lag: one shuffle on
    (keys, stretch), no group above chunk + halo rows, whatever the key's size.
    """
    reach = max(k for _, k in lags.values())
    start = F.floor(F.col(index) / chunk).cast("long")
    near_end = F.col(index) % chunk >= chunk - reach
    spread = df.withColumn(
        "_stretch", F.explode(F.when(near_end, F.array(start, start + 1)).otherwise(F.array(start)))
    )
    w = Window.partitionBy(*keys, "_stretch").orderBy(index)
    cols = []
    for name, (column, k) in lags.items():
        same = F.lag(index, k).over(w) == F.col(index) - k
        cols.append(F.when(same, F.lag(column, k).over(w)).alias(name))
    out = spread.select("*", *cols).where(F.col("_stretch") == start)
    return out.drop("_stretch")
