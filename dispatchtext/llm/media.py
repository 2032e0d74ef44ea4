"""Media columns: texts as losslessly compressed 8-bit audio (FLAC), decoded PCM blocks with sample offsets, features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove
from . import flac
from .common import slices, table

SLICE = 1 << 20
#: Documents of one batch whose PCM is held at a time.
ROWS = 256
#: Parts of the documents whose streams are stored at a time.
PARTS = 4


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream) of every whole text.

    The payload is the text's UTF-8 and bytes 255 up to a positive multiple of 576. A null text counts as
    empty. Null or repeated doc_ids stay as they are. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            padded = [t + b"\xff" * (max(1, -(-len(t) // flac.BLOCK)) * flac.BLOCK - len(t)) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(flac.encode(padded), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square and rate of sign changes of signed samples, in thousandths."""
    x = samples.astype(np.int64)
    changes = int(np.count_nonzero(np.signbit(samples[1:]) != np.signbit(samples[:-1])))
    return f"mean={1000 * int(x.sum()) // len(x)};rms={int(1000 * np.sqrt(int((x * x).sum()) / len(x)))};zcr={1000 * changes // len(x)}"


PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:long,pcm:binary>>"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """PCM of each stream (doc_id, n_bytes, media): blocks in order, each with the offset of its first sample, and digests of the stream.

    Frame checksums and the stream's MD5 are verified; a stream that is not whole stops the job.
    """
    block = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", SLICE):
            streams = part.column("media").to_pylist()
            blocks = [[{"sample_offset": i, "pcm": p[i : i + flac.BLOCK]} for i in range(0, len(p), flac.BLOCK)] for p in flac.decode(streams)]
            sizes, digests = pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams])
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), sizes, digests, pa.array(blocks, block)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.mapInArrow(run, PCM)


def samples(pcm: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id and the bytes [first, first + count) of each document's samples: only the blocks that hold them are joined."""
    held = F.filter("blocks", lambda b: (b["sample_offset"] + flac.BLOCK > first) & (b["sample_offset"] < first + count))
    joined = F.aggregate(held, F.lit(b""), lambda acc, b: F.concat(acc, b["pcm"]))
    skip = first - F.coalesce(F.get(held, 0)["sample_offset"], F.lit(first))
    return pcm.select("doc_id", F.substring(joined, skip.cast("int") + 1, F.lit(count)).alias("pcm"))


def media_digests(pcm: DataFrame) -> DataFrame:
    """Digests and features of PCM tables, one row per document."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                rows = []
                for blocks in part.column("blocks").to_pylist():
                    p = b"".join(b["pcm"] for b in blocks)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature((np.frombuffer(p, np.uint8) ^ np.uint8(flac.MIDDLE)).view(np.int8))))
                own = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string()))]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("n_bytes"), *own[:3], part.column("media_bytes"), part.column("media_sha256"), own[3]], names=[c.split()[0] for c in schema.split(", ")]
                )

    return pcm.mapInArrow(run, schema)


def store_pcm(docs: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """Write PCM of every text at path by way of stored streams, and read it: streams are written, read and decoded in turn.

    Each of `parts` parts of docs (by a hash of the row) is decoded before the next is stored, and its streams are
    removed then, so that scratch space holds one part of them. Keep encode_media()'s table to keep the streams.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    for i in range(parts):
        media = new_path(spark, "media")
        encode_media(docs.filter(part == i)).write.option("compression", "none").parquet(media)
        pcm_blocks(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(media)).write.mode("append").option("compression", "zstd").parquet(path)
        remove(spark, media)
    return spark.read.schema(PCM).parquet(path)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams are written and read, decoded into PCM blocks that are written and read, and those are digested."""
    return media_digests(store_pcm(table(spark, sf_dir, "documents"), new_path(spark, "media-pcm")))
