"""Joins of spans within an example over long tables: containment and overlap, without listing pairs.

The in-row forms (functions.spans.bio_label, overlaps) serve rows that hold their spans as arrays. Here spans are rows, and one
example may have any number of them: its rows are dealt out by place, so several tasks share it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import tasks_for

#: Places that overlap tests put in one part of an example.
STRETCH = 4096
#: Places (a power of two) of the smallest cells of containment; what a sweep returns.
CELL_BITS = 12
ANSWER = ("example_id", "unit", "start", "end", "ord", "label")


def label_units(units: DataFrame, entities: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """units (example_id, unit, start, end) with `label`: B- or I- and the label of the first entity that contains the unit, else O.

    entities: example_id, ord, start, end, label; the least ord counts. Lengths are sorted into a few levels of cells, of 2**bits
    places and of 16 times as many from level to level. An entity lies on the first level whose cells are as long as it, where it
    touches two cells at most; a unit looks at its own cell on every level in use. A cell is swept in order of starts, so however many
    entities hold a unit, no pair is listed. Entities of no length contain units of no length at their place. Rows that are
    equal come once.
    """
    entities = entities.filter("start <= end and example_id is not null and ord is not null")
    length, sizes = F.col("end").cast("long") - F.col("start"), range(bits, 62, 4)
    level = F.lit(62)
    for size in reversed(sizes):
        level = F.when(length <= 1 << size, F.lit(size)).otherwise(level)
    entities = entities.withColumn("level", level)
    held = {r["level"]: r["count"] for r in entities.groupBy("level").count().collect()}  # a place has 31 bits, so six levels at most
    levels = sorted(held) or [bits]
    first, last = (F.expr(f"shiftright(cast({c} as bigint), level)") for c in ("start", "end"))
    none = {c: F.lit(None).cast(t) for c, t in (*[(c, entities.schema[c].dataType) for c in ("ord", "label")], ("unit", units.schema["unit"].dataType))}
    places = [F.col(c) for c in ("example_id", "level", "cell", "start", "end")]
    placed = entities.withColumn("cell", F.explode(F.sequence(first, last))).select(*places, F.lit(False).alias("asks"), none["unit"].alias("unit"), "ord", "label")
    probes = units.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("cell", first)
    probes = probes.select(*places, F.lit(True).alias("asks"), "unit", none["ord"].alias("ord"), none["label"].alias("label"))
    rows = probes.unionByName(placed)
    tasks = tasks_for(units.sparkSession, units.count() * len(levels) + 2 * sum(held.values()))
    rows = rows.repartition(tasks, "example_id", "level", "cell").sortWithinPartitions("example_id", "level", "cell", "start", "asks", "end", "unit")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    found = rows.mapInArrow(_sweep, T.StructType([T.StructField(c, kinds[c]) for c in ANSWER]))
    if len(levels) > 1:
        found = found.groupBy("example_id", "unit", "start", "end").agg(F.min_by("label", "ord").alias("label"))
    return found.select("example_id", "unit", "start", "end", F.coalesce("label", F.lit("O")).alias("label"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unit rows of sorted cells with the first entity (ord, label with its mark) that holds them; equal units come once.

    Of the entities that have started, only those stay that a later unit may get: none with a smaller ord reaches as far. So
    ends and ords both rise, and the first entity that reaches a unit's end has the least ord.
    """
    cell = unit = None
    ends, ords, held = [], [], []
    for batch in batches:
        keep, found, labels = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("example_id", "level", "cell", "start", "end", "asks", "unit", "ord", "label")]
        for at, (example, level, number, start, end, asks, name, ord_, label) in enumerate(zip(*columns)):
            if (example, level, number) != cell:
                cell, unit = (example, level, number), None
                ends, ords, held = [], [], []
            if asks:
                if (start, end, name) == unit:
                    continue
                unit = (start, end, name)
                i = len(ends) if start is None or end is None else bisect_left(ends, end)
                hit = i < len(ends)
                keep.append(at)
                found.append(ords[i] if hit else None)
                labels.append(("B-" if held[i][0] == start else "I-") + held[i][1] if hit and held[i][1] is not None else None)
                continue
            i = bisect_left(ends, end)
            if i < len(ends) and ords[i] <= ord_:
                continue
            low, high = bisect_left(ords, ord_, 0, i), i + (i < len(ends) and ends[i] == end)
            ends[low:high], ords[low:high], held[low:high] = [end], [ord_], [(start, label)]
        part = batch.take(pa.array(keep, pa.int64()))
        columns = [part.column(c) for c in ANSWER[:4]] + [pa.array(found, part.schema.field("ord").type), pa.array(labels, part.schema.field("label").type)]
        yield pa.RecordBatch.from_arrays(columns, list(ANSWER))


def mark_overlaps(rows: DataFrame, others: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """rows (example_id, start, end, ...) with `overlapped`: whether any of others (example_id, start, end) shares a place with the row.

    Of all others that start before a row ends, the one that reaches farthest decides. Starts of others and ends of rows are put in
    one order, and the farthest reach so far is carried along it: within a stretch of places by a window, from
    stretch to stretch by the reach of each. Spans without a place overlap nothing.
    """
    own = [c for c in rows.columns]
    asked = rows.select("example_id", F.struct(*own).alias("row"), F.col("end").alias("place"), F.lit(None).cast("long").alias("reach"))
    starts = others.filter("start < end").select("example_id", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.col("start").alias("place"), F.col("end").cast("long").alias("reach"))
    both = asked.unionByName(starts).withColumn("part", F.floor(F.col("place") / stretch))
    before = Window.partitionBy("example_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("example_id", "part").agg(F.max("reach").alias("part_reach")).select(F.col("example_id").alias("c_example"), F.col("part").alias("c_part"), F.max("part_reach").over(before).alias("carried"))
    both = both.join(carried, F.col("example_id").eqNullSafe(F.col("c_example")) & (F.col("part") == F.col("c_part")))
    # A row's end comes before an other that starts there: they share no place.
    upto = Window.partitionBy("example_id", "part").orderBy("place", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.greatest(F.max("reach").over(upto), F.col("carried"))
    out = both.select("row", reach.alias("reach")).filter("row is not null")
    hit = (F.col("row.start") < F.col("row.end")) & (F.col("reach") > F.col("row.start"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.coalesce(hit, F.lit(False)).alias("overlapped"))


def drop_overlapping(rows: DataFrame, others: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Rows that share no place with any of others: masks and blocks against candidates, addresses against notes."""
    return mark_overlaps(rows, others, stretch).filter("not overlapped").drop("overlapped")
