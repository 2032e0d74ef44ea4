"""Importance resampling against its SQL, longer runs of words against plain counting, ranks against plain sorting."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from dispatchtext.llm import resampling as rs

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def rows_of(seed=8, n=400):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(80)] + ["Crème", "BRÛLÉE", "漢字", "x_y", "3,5"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(n)]
    rows += [(7, rows[7][1])] * 3 + [(8, "a b " * 20), (8, "b a " * 20), (None, "word1 " * 30), (None, None), (1000, None), (1001, ""), (1002, "word2 " * 5000)]
    return rows, [(0, "word1 word2 word3 " * 20), (1, None), (2, "")]


def sql(docs, target):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.execute("create table benchmark (item_id bigint, text varchar)")
    for name, rows in (("documents", docs), ("benchmark", target)):
        if rows:
            db.executemany(f"insert into {name} values (?, ?)", rows)
    return sorted(db.execute(rs.OP13_SQL).fetchall(), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "item_id long, text string")


@pytest.mark.parametrize("with_target", [True, False])
def test_against_sql(spark, with_target):
    docs, target = rows_of()
    target = target if with_target else []
    d, t = frames(spark, docs, target)
    got = rs.resample(d.withColumns({"score": F.lit("clash"), "buckets": F.lit(1), "n": F.lit(2)}), t).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sql(docs, target)


def test_empty_and_tiny_tables(spark):
    for docs in ([], [(1, "few words")], [(1, "one " * 25)]):
        d, t = frames(spark, docs, [(0, "one two")])
        assert sorted(map(tuple, rs.resample(d, t).select(*COLUMNS).collect()), key=repr) == sql(docs, [(0, "one two")])


def test_runs_of_two_words(spark):
    docs, target = rows_of(2, 60)
    d, t = frames(spark, docs, target)
    got = rs.resample(d, t, ngrams=2, buckets=500).collect()

    def features(text):
        words = (text or "").encode().translate(rs._LETTERS).split()
        return [zlib.crc32(f) % 500 for f in words + [b" ".join(p) for p in zip(words, words[1:])]]

    s, q = (Counter(b for _, text in rows for b in features(text)) for rows in (docs, target))
    gain = {b: math.floor(1000 * math.log((q[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (q.total() + 500)))) for b in range(500)}
    want = sorted(((i, len(features(x)), sum(gain[b] for b in features(x))) for i, x in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"]) for r in got), key=repr) == want


def test_ranks_with_many_ties(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 40), r.choice([5, 20, 30]), r.randint(-3, 3)) for _ in range(500)] + [(None, 20, 3), (None, 20, 3), (4, None, 3)]
    got = rs.ranked(spark.createDataFrame(rows, "doc_id long, n_words long, score long"), 35, 20)
    order = sorted((x for x in rows if (x[1] or 0) >= 20), key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1]))
    want = [(*x, i + 1 if i < len(order) * 35 // 100 else None) for i, x in enumerate(order)] + [(*x, None) for x in rows if (x[1] or 0) < 20]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
