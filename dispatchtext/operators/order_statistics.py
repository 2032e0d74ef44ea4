"""Exact percentiles of any number of rows by distributed selection.

A group's values are never gathered. Its range is cut into BUCKETS parts and counted; prefix sums tell the part that holds
a wanted rank; that part is cut again, until it holds one value or at most GATHER rows. All that moves is counts, at most
BUCKETS a group, rank and task, so a group with nearly all rows is work for all tasks. Ties are counts like any other.

Null values do not count. A group without values gives null. NaN is above all numbers, as everywhere in Spark. Group keys may be null.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Parts that a range is cut into, rows of a part that are sorted in one place.
BUCKETS = 1024
GATHER = 10_000
#: Fixed value: the largest double; infinities are cut off there where widths are computed.
LARGEST = 1.7976931348623157e308


def _bucket(v: Column, low: Column, high: Column) -> Column:
    """Part of [low, high] that v lies in. It never falls as v rises; the two ends have parts of their own, so every cut gets on."""
    a, b, x = (F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST)) / 2 for c in (low, high, v))
    inner = 1 + F.floor((x - a) / (b - a) * (BUCKETS - 2)).cast("int")
    return F.when(v == low, 0).when(v == high, BUCKETS - 1).when(a == b, 1).otherwise(F.least(F.greatest(inner, F.lit(1)), F.lit(BUCKETS - 2)))


def _same(keys: list[str]) -> Column:
    """Group keys equal to those of a renamed side; nulls are equal."""
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))


def _aside(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def ends(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n (values that are not null), low and high of each group, written: one row a group."""
    v = _value(value)
    return written(rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")), "ends")


def _value(value: str) -> Column:
    return F.col(value).cast("double") + F.lit(0.0)  # one zero


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """keys, k, value: the k-th smallest value of each group. ranks: keys, k (from 0, below n), n, low and high of the group."""
    values = rows.select(*keys, _value(value).alias("v")).filter("v is not null")
    open_ = ranks.select(*keys, "k", F.col("k").alias("rest"), "n", "low", "high").distinct()
    done = []
    while True:
        one, few = F.col("low") == F.col("high"), F.col("n") <= GATHER
        done.append(open_.filter(one).select(*keys, "k", F.col("low").alias("value")))
        left = open_.filter(~one).agg(F.count_if(few), F.count_if(~few)).first()
        if left[0]:
            held = _inside(values, open_.filter(~one & few), keys).groupBy(*keys, "k", "rest").agg(F.sort_array(F.collect_list("v")).alias("all"))
            done.append(held.select(*keys, "k", F.element_at("all", (F.col("rest") + 1).cast("int")).alias("value")))
        if not left[1]:
            return reduce(DataFrame.unionByName, done)
        counted = _inside(values, open_.filter(~one & ~few), keys).groupBy(*keys, "k", "rest", _bucket(F.col("v"), F.col("low"), F.col("high")).alias("part"))
        counted = counted.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "k", "rest").orderBy("part"))  # BUCKETS rows at most
        counted = counted.withColumn("before", upto - F.col("n")).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        open_ = written(counted.select(*keys, "k", (F.col("rest") - F.col("before")).alias("rest"), "n", "low", "high"), "ranks")


def _inside(values: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the parts of their group that hold them: one for each wanted rank of a group at most."""
    own = values.select(*_aside(keys), "v")
    same = _same(keys)
    return own.join(parts, same & F.col("v").between(F.col("low"), F.col("high"))).select(*keys, "k", "rest", "low", "high", "v")


def percentiles(rows: DataFrame, keys: list[str], value: str, nearest: dict[str, float] | None = None, interpolated: dict[str, float] | None = None) -> DataFrame:
    """keys and a column for each fraction: nearest rank (the value at ceil(p * n)), or interpolated between neighbours."""
    nearest, interpolated = nearest or {}, interpolated or {}
    groups = ends(rows, keys, value)
    at = {name: F.greatest(F.ceil(F.lit(p) * F.col("n")).cast("long") - 1, F.lit(0)) for name, p in nearest.items()}
    for name, p in interpolated.items():
        place = F.lit(p) * (F.col("n") - 1)
        at |= {f"{name}<": F.floor(place).cast("long"), f"{name}>": F.ceil(place).cast("long")}
    wide = F.explode(F.array(*[F.struct(F.lit(x).alias("name"), c.alias("k")) for x, c in at.items()]))
    named = groups.filter("n > 0").select(*keys, "n", "low", "high", wide.alias("w")).select(*keys, "w.name", "w.k", "n", "low", "high")
    found = order_statistics(rows, keys, value, named)
    found = found.select(*_aside(keys), F.col("k").alias("_at"), "value")
    by_name = named.join(found, _same(keys) & (F.col("k") == F.col("_at")))
    back = by_name.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(f"_v{i}") for i, x in enumerate(at)])
    got = {x: F.col(f"_v{i}") for i, x in enumerate(at)}
    columns = [got[name].alias(name) for name in nearest]
    for name, p in interpolated.items():
        place = F.lit(p) * (F.col("_n") - 1)
        columns.append((got[f"{name}<"] + (got[f"{name}>"] - got[f"{name}<"]) * (place - F.floor(place))).alias(name))
    sizes = groups.select(*_aside(keys), F.col("n").alias("_n"))
    whole = sizes.join(back, _same(keys), "left")
    return whole.select(*[F.col(f"_{k}").alias(k) for k in keys], *columns)


def with_percentiles(summary: DataFrame, rows: DataFrame, keys: list[str], value: str, nearest: dict[str, float] | None = None, interpolated: dict[str, float] | None = None) -> DataFrame:
    """A summary by keys with the percentile columns of its groups."""
    found = percentiles(rows, keys, value, nearest, interpolated)
    found = found.select(*_aside(keys), *[c for c in found.columns if c not in keys])
    same = _same(keys)
    return summary.join(found, same, "left").drop(*[f"_{k}" for k in keys])
