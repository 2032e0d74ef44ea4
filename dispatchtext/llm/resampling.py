"""Target-distribution importance resampling: draw the documents that look most like a target collection.

A document's features (runs of words) fall into hashed buckets. A bucket's gain is the scaled logarithm of its share
in the target over its share in the documents; a document's weight is the sum of the gains of its features, looked up
as an array. A Gumbel number made from doc_id is added, so that the highest scores are a draw without replacement by
weight. Scores are whole numbers: a histogram of them, summed from the top, gives every score its first rank, the score
at which the draw ends, and so the few scores whose rows have to be put in order at all.

Nulls: a text without value has no words; a null doc_id hashes as the empty string and comes last among ties. Rows that
are equal in doc_id and numbers share a block of ranks. Empty tables give empty results, an empty target gives gains from
the documents alone. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, table, tidy

NGRAMS = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Words whose bucket a task remembers.
CACHE = 500_000

#: ASCII letters in lower case and digits stay, every other ASCII character ends a word; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Buckets(dict):
    """Bucket of a feature, from the checksum of its bytes; forgets everything when it holds CACHE features."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.n
        return out


def features(rows: DataFrame, keep: list[str], ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The columns of `keep`, n_words, and `buckets`: one entry for each run of 1 to `ngrams` words of `text`."""
    known = _Buckets(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            counts, out = [], []
            for text in piece.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").translate(_LETTERS).split()
                runs = [b" ".join(words[i : i + n]) for n in range(2, ngrams + 1) for i in range(len(words) - n + 1)]
                counts.append(len(words))
                out.append(np.fromiter(map(known.__getitem__, words + runs), np.int32, len(words) + len(runs)))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(counts, pa.int64()), lists], [*keep, "n_words", "buckets"])

    schema = T.StructType([*rows.select(*keep).schema.fields, *T.StructType.fromDDL("n_words long, buckets array<int>").fields])
    return rows.select(*keep, "text").mapInArrow(tidy(run, known.clear), schema)


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows. A task sends at most one row a bucket, the driver gets `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(buckets, object)
    for bucket, n in featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the documents."""
    buckets, all_own, all_target = len(own), float(sum(own)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_own + buckets) / ((s + 1.0) * (all_target + buckets)))) for s, t in zip(own, target)], np.int64)


def weigh(featured: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """Replaces `buckets` by n_features and weight, the sum of the gains of the features."""
    keep = [c for c in featured.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate(([0], np.cumsum(by_bucket[lists.flatten().to_numpy()])))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            numbers = [pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *numbers], [*keep, "n_features", "weight"])

    return featured.mapInArrow(run, T.StructType([*(featured.schema[c] for c in keep), *T.StructType.fromDDL("n_features long, weight long").fields]))


def with_score(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight and a Gumbel number in thousandths, made from doc_id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank to rows with doc_id, n_words and score: 1, 2, 3 ... over the drawn ones, highest score and then least doc_id first.

    Of the N rows with `least_words` words, percent * N / 100 are drawn, rounded down. The histogram of scores is dealt
    out in ranges; sums of whole ranges and sums within a range give each score the number of rows above it, so no task
    holds all scores. Only rows at or above the last drawn score are sorted, score by score, equal rows as one with a count.
    """
    may = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    scores = scored.filter(may).groupBy("score").agg(F.count("*").alias("n"))
    scores = materialize(scores.repartitionByRange(F.col("score").desc()).withColumn("part", F.spark_partition_id()), "score-histogram")
    parts = scores.groupBy("part").agg(F.sum("n").alias("n_part"))
    drawn = (parts.agg(F.sum("n_part")).first()[0] or 0) * percent // 100
    before = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))  # one row a partition
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(F.col("score").desc())) - F.col("n")
    offsets = scores.withColumn("inside", inside).join(before, "part").select("score", "n", (F.col("before") + F.col("inside")).alias("above"))
    last = offsets.filter((F.col("above") < drawn) & (F.col("above") + F.col("n") >= drawn)).select("score").first()
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    taken = may & (F.col("score") >= last[0])
    alike = scored.filter(taken).groupBy(*scored.columns).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in scored.columns if c not in ("doc_id", "score")])
    placed = alike.join(offsets.select("score", "above"), "score").withColumn("first", F.col("above") + F.sum("copies").over(order) - F.col("copies"))
    rank = placed.select(*scored.columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("rank"))
    rank = rank.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.filter(~taken).withColumn("rank", F.lit(None).cast("long")).unionByName(rank)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, ngrams: int = NGRAMS, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of docs; target holds texts."""
    featured = materialize(features(docs, ["doc_id"], ngrams, buckets), "features")
    by_bucket = gains(bucket_counts(featured, buckets), bucket_counts(features(target, [], ngrams, buckets), buckets))
    return ranked(materialize(with_score(weigh(featured, by_bucket), seed), "scores"), percent, least_words)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same rows in SQL: the checksum is a fold over a word's bytes with the usual table of 256 remainders.
OP13_SQL = rf"""with remainders as materialized (
  select list(list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i) r),
own as materialized (select row_number() over () as pos, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as words from documents),
aim as materialized (select regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as words from benchmark),
every as materialized (select distinct w from (select unnest(words) as w from own union all select unnest(words) from aim) x),
hashed as materialized (select w, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda b: ('0x' || b)::ubigint)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) % {BUCKETS} as bucket from every, remainders),
own_words as materialized (select pos, bucket from (select pos, unnest(words) as w from own) o join hashed using (w)),
s as (select bucket, count(*) as n from own_words group by bucket), t as (select bucket, count(*) as n from (select unnest(words) as w from aim) o join hashed using (w) group by bucket),
gains as materialized (select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + {BUCKETS})::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + {BUCKETS})::double)))::bigint as gain
  from (select unnest(range({BUCKETS})) as bucket) b left join s on s.bucket = b.bucket left join t on t.bucket = b.bucket),
weights as (select pos, sum(gain)::bigint as weight from own_words join gains using (bucket) group by pos),
scored as materialized (select own.pos, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::ubigint::double + 0.5) / 4294967296)))::bigint as score from own left join weights on weights.pos = own.pos),
numbered as (select pos, row_number() over (order by score desc, doc_id asc nulls last, n_features) as r from scored where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when r <= (select count(*) from numbered) * {PERCENT} // 100 then r end as rank from scored left join numbered using (pos)"""
