"""The divergence audit against its SQL, over tables with every odd case, and the tournament against its rules."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dispatchtext.llm import divergence


def sql(rows):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, lang varchar, source varchar, text varchar)")
    if rows:
        db.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return sorted(db.execute(divergence.OP12_SQL).fetchall())


def corpus():
    r, rows = random.Random(4), []
    words = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}" for i in range(30)] + ["Über", "ÜBER", "naïve", "中文", "X-ray", "a1b2"]
    for lang, n_sources in (("en", 9), ("de", 4), ("fr", 1), (None, 2)):
        for s in range(n_sources):
            for _ in range(r.randint(3, 14)):
                rows.append((len(rows), lang, f"src{s}", " ".join(r.choices(words[s:], k=r.randint(0, 40)))))
    rows += [(None, "en", None, "wax WAX\twax"), (0, "en", "silent", None), (0, "en", "silent", None), (1, "xx", "rare", "one two"), (2, "xx", "other", ""), (3, None, None, None)]
    return rows


@pytest.mark.parametrize("block, tile", [(1024, 4), (4, 1), (5, 2)])
def test_against_sql(spark, block, tile):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("value", F.lit("clash")).withColumn("tile", F.lit(1))
    got = divergence.audit(docs, block=block, tile=tile)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sql(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).collect() == []


def test_giant_text_and_small_buffers(spark, monkeypatch):
    text = "alpha beta " * 3000 + "gamma" * 4000
    monkeypatch.setattr(divergence, "PIECE_BYTES", 100)
    words = [w for part in divergence._terms(text.encode()) for w in part]
    assert words == text.encode().split()


def test_shares_are_exact():
    for count, total, size in ((0, 0, 1), (5, 9, 3), (10**12 + 7, 3 * 10**12 + 1, 10**6), (4 * 10**15, 9 * 10**15, 10**9)):
        assert divergence.shares([count], total, size)[0] == 1 + 10**9 * (count + 2) // (total + 2 * size)


@pytest.mark.parametrize("n", range(1, 12))
def test_every_two_tiles_meet_once(spark, n):
    rows = spark.range(n).select(F.col("id").cast("int").alias("tile"), F.lit(n).alias("n")).select("tile", divergence.journeys(F.col("tile"), F.col("n")).alias("to")).collect()
    meetings = sorted(tuple(sorted((r["tile"], t))) for r in rows for t in r["to"])
    assert meetings == sorted((a, b) for a in range(n) for b in range(a, n))
    trips = [len(r["to"]) - 1 for r in rows]
    assert max(trips) - min(trips) <= 1  # each travels to about half of its meetings
