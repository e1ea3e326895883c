"""Running values over long ordered groups, computed in chunks.

A window over a group holding a third of all rows is one task. Here a group is
cut into chunks; chunk totals are cheap partial aggregates, their running sum is
a window over chunks only, and rows meet it again within their own chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums per group in ``order``.

    ``chunk`` must not decrease along ``order`` and must put rows that tie in
    ``order`` into one chunk. Key columns must not be null.
    """
    cut = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, [*keys, "_chunk"])
    summed = joined.withColumns(
        {n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) + F.col(f"_o_{n}") for n in values}
    )
    return summed.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def previous_value(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the value of the row before in the group; the last value of a chunk is carried to the next."""
    cut = df.withColumns({"_chunk": chunk, "_value": value})
    lasts = cut.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))
    offsets = lasts.select(*keys, "_chunk", carried.alias("_carried"))
    along = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    first = F.row_number().over(along) == 1
    joined = cut.join(offsets, [*keys, "_chunk"])
    return joined.withColumn(
        name, F.when(first, F.col("_carried")).otherwise(F.lag("_value").over(along))
    ).drop("_chunk", "_value", "_carried")


def previous_within(
    df: DataFrame, keys: list[str], time: str, order: list[str], fields: list[str], reach_s: float, chunk_s: float = 3600
) -> DataFrame:
    """Add ``previous``, the row before in the group if it is at most ``reach_s`` older.

    Groups are cut into chunks of time. Only rows within reach of a chunk's end
    can be someone's previous in the next one, so those few are carried over.
    """
    chunk = F.floor(F.col(time) / chunk_s)
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("carried"))
    carry = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("carried"))
    late = F.col(time) >= (chunk + 1) * chunk_s - reach_s
    placed = df.withColumn("_place", F.explode(F.when(late, F.array(own, carry)).otherwise(F.array(own))))
    along = Window.partitionBy(*keys, "_place.chunk").orderBy(time, *order)
    before = F.lag(F.struct(F.col(time).alias("_time"), *fields)).over(along)
    found = placed.withColumn("previous", before).where("NOT _place.carried").drop("_place")
    near = F.col(time) - F.col("previous._time") <= reach_s
    return found.withColumn("previous", F.when(near, F.col("previous")))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles of a positive column per group.

    Groups are cut by the value's binary order of magnitude in 1/256 steps; the
    chunk counts say which chunks hold the wanted ranks, and only of those equal
    values are counted and ordered. No task sees a whole group.
    """
    if not keys:
        one = exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, points)
        return one.drop("_all")
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    chunked = known.withColumn("_chunk", F.floor(F.log2(F.col(value)) * 256).cast("int"))
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    by_group = Window.partitionBy(*keys)
    placed = sizes.withColumns(
        {
            "_total": F.sum("_size").over(by_group),
            "_upto": F.sum("_size").over(by_group.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).withColumn("_from", F.col("_upto") - F.col("_size"))

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    ranks = [fn(position(p)).cast("bigint") for p in points.values() for fn in (F.floor, F.ceil)]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((rank >= F.col("_from")) & (rank < F.col("_upto")))
    targets = placed.where(wanted).select(
        *[F.col(k).alias(f"_key_{k}") for k in [*keys, "_chunk"]], "_total", "_from"
    )
    near = chunked.join(targets, same_keys([*keys, "_chunk"])).groupBy(*keys, "_chunk", value, "_total", "_from").agg(
        F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_end", F.col("_from") + F.sum("_n").over(along))

    def at(rank: Column) -> Column:
        held = (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))
        return F.max(F.when(held, F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(position(p)).cast("bigint")).alias(f"_lo_{n}") for n, p in points.items()],
        *[at(F.ceil(position(p)).cast("bigint")).alias(f"_hi_{n}") for n, p in points.items()],
    )
    blend = {
        n: F.col(f"_lo_{n}")
        + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (position(p) - F.floor(position(p)))
        for n, p in points.items()
    }
    return picked.select(*keys, *[c.alias(n) for n, c in blend.items()])


def same_keys(keys: list[str], prefix: str = "_key_") -> Column:
    """Null-safe equality of keys with their prefixed copies on the other side."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(prefix + key))
    return condition
