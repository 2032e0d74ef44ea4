"""Minimum-cost-flow resharding: old shards to new capacities with the fewest bytes moved.

Rows of an old shard stand in blocks; block totals give every row a byte position in its old shard. A
minimum-cost flow (staying costs 0, a moved byte 1) says how many bytes of each old shard go to each new
shard. The flows cut every old shard into byte ranges, and a row goes where the middle of its bytes lies.
Only one total for each old shard and the flow reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path
from .common import materialize, table

OLD_SHARDS, NEW_SHARDS = 6, 8
ROWS_PER_BLOCK = 100_000


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """flow[i][j] from old shard i to new shard j; i = j is free, other moves cost 1 a byte.

    Successive shortest augmenting paths (Bellman-Ford on the residual network of shards).
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("the new shards are too small")
    cost = [[int(i != j) for j in range(m)] for i in range(n)]
    while any(left):
        far = float("inf")
        dist = [0 if left[i] else far for i in range(n)] + [far] * m
        prev: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], prev[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], prev[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        end = min((n + j for j in range(m) if room[j]), key=lambda x: dist[x])
        path = [end]
        while prev[path[-1]] is not None:
            path.append(prev[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[b][a - n] for a, b in zip(path, path[1:]) if a >= n))
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def plan(old_bytes: list[int], new_shards: int) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): what stays comes first in each old shard."""
    total = sum(old_bytes)
    capacity = [(j + 1) * total // new_shards - j * total // new_shards for j in range(new_shards)]
    out = []
    for i, row in enumerate(min_cost_flow(old_bytes, capacity)):
        at = 0
        for j in sorted(range(new_shards), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def reshard(docs: DataFrame, old: str | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for every row of docs (doc_id, text).

    `old` names an int column with the present shard (0 to old_shards-1); without it the present layout is
    the hash of key and text. New shards hold nearly equal bytes: each bound is off by half a row at most.
    A null text has no bytes (size 1). Null and repeated keys, empty texts and repeated rows are placed
    like any other row; an empty table gives no rows. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    present = F.col(old).cast("int") if old else F.pmod(F.xxhash64("doc_id", "text"), F.lit(old_shards)).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        present.alias("old_shard"), F.xxhash64(F.lit(1), "doc_id", "text").alias("h"),
    )
    rows = materialize(rows, "reshard-rows")
    blocks = max(1, -(-rows.count() // (old_shards * rows_per_block)) * 4)
    rows = rows.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    order = [F.col(c) for c in ("h", "doc_id", "text_crc32", "size")]
    w = Window.partitionBy("old_shard", "block").orderBy(*order)
    totals = materialize(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("n")), "reshard-blocks")
    old_bytes = [0] * old_shards
    for r in totals.groupBy("old_shard").agg(F.sum("n").alias("n")).collect():
        old_bytes[r["old_shard"]] = r["n"]
    earlier = F.sum("n").over(Window.partitionBy("old_shard").orderBy("block")) - F.col("n")  # over blocks, not rows
    base = totals.select("old_shard", "block", earlier.alias("base"))
    middle = F.col("base") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.floor((F.col("size") + 1) / 2)
    placed = rows.join(base, ["old_shard", "block"]).withColumn("middle", middle)
    shard = F.lit(None).cast("int")
    for i, low, high, j in plan(old_bytes, new_shards):
        shard = F.when((F.col("old_shard") == i) & (F.col("middle") >= low) & (F.col("middle") < high), j).otherwise(shard)
    placed = placed.withColumn("shard", shard).withColumn("rank", F.row_number().over(w))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "rank"), "reshard-placed")
    runs = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("shard", "old_shard", "block", (before - F.col("first_rank")).alias("shift"))
    return placed.join(runs, ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot")
    )


def _sized(docs: DataFrame, size: str, crc: str) -> DataFrame:
    """docs with the size and the checksum of each text, in columns of these names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumns({size: (F.octet_length(text) + 1).cast("long"), crc: F.crc32(text)})


def rewrite(docs: DataFrame | None, placed: DataFrame, old_path: str, new_path_: str) -> list[int]:
    """Write the rows of every affected shard under new_path_/shard=N; returns the shards that were written.

    A shard is affected when a row entered or left it; the files of all others at old_path stay valid. docs
    holds the rows that were placed (None: those of the files at old_path); files get its columns and slot, each file
    in slot order. Rows are found by key, size and checksum and counted off among equals, so null and repeated
    keys are written once for each row.
    """
    spark = placed.sparkSession
    docs = spark.read.parquet(old_path) if docs is None else docs
    changed = placed.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in changed.collect())
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    keys = ["_none", "_id", "_size", "_crc"]

    def keyed(rows: DataFrame, order: list[str]) -> DataFrame:
        own = F.col("doc_id").cast("long")
        rows = rows.select("*", own.isNull().alias("_none"), F.coalesce(own, F.lit(0)).alias("_id"))
        return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    sized = keyed(_sized(docs.select(*columns), "_size", "_crc"), keys).select(*columns, *keys, "_nth")
    targets = keyed(placed.withColumnsRenamed({"size": "_size", "text_crc32": "_crc"}), ["shard", "slot"]).select(*keys, "_nth", "shard", "slot")
    setting = "spark.sql.requireAllClusterKeysForCoPartition"  # both sides are already split by `keys`: no second shuffle of texts
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows = sized.join(targets.hint("shuffle_merge"), [*keys, "_nth"]).filter(F.col("shard").isin(affected)).select(*columns, "shard", "slot")
        rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(new_path_)
    finally:
        spark.conf.set(setting, before)
    return affected


def read_shards(docs: DataFrame, placed: DataFrame, new_path_: str, affected: list[int]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: of affected shards from the files at new_path_, of others as placed."""
    out = ["doc_id", "size", "text_crc32", "shard", "slot"]
    kept = placed.filter(~F.col("shard").isin(affected)).select(*out)
    if not affected:
        return kept
    schema = T.StructType([*(f for f in docs.schema if f.name not in ("shard", "slot")), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    files = docs.sparkSession.read.schema(schema).parquet(new_path_)
    return _sized(files, "size", "text_crc32").select(F.col("doc_id").cast("long").alias("doc_id"), *out[1:]).unionByName(kept)


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place the documents, write the affected shards and read the result off the files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = materialize(reshard(docs), "reshard-plan")
    path = new_path(spark, "reshard-shards")
    rows = read_shards(docs, placed, path, rewrite(docs, placed, "", path))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
