"""Token-id files with a minimal perfect hash index.

A store is a Parquet table of shards, in ascending key order. Each shard row holds raw little-endian id
payload, the offset of each document in it, the document keys in payload order, and an index: a minimal
perfect hash (hash and displace) from key to document ordinal with a stored 16-bit fingerprint per slot.
A lookup computes two hashes, reads one displacement, one fingerprint and two offsets.

Parquet is the container so that tasks write through Spark's commit protocol to any store Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import slices, table, tidy
from .tokens import coder

END_ID = 0
#: A shard is closed once it holds this many ids or documents; one larger document makes a shard of its own.
SHARD_IDS, SHARD_DOCS = 4 << 20, 1 << 16
TEXT_SLICE = 4 << 20

STORE = (
    "part int, seq int, before long, n_docs int, n_ids long, width int, min_key long, max_key long, "
    "keys binary, starts binary, displace binary, prints binary, slots binary, payload binary"
)


def _mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """splitmix64 finaliser of key and seed."""
    x = keys.astype(np.uint64) + (np.atleast_1d(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements, fingerprints by slot, ordinal by slot) for distinct int64 keys, ordinal = position in keys."""
    n = len(keys)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.uint16), np.empty(0, np.int32)
    keys = keys.view(np.uint64)
    buckets = max(1, n // 3)
    bucket = (_mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    displace, slots = np.zeros(buckets, np.int32), np.full(n, -1, np.int32)
    by_size = np.argsort(-sizes, kind="stable")
    tries = np.arange(1, 65)
    for b in by_size:
        if sizes[b] < 2:
            break
        members = order[begin[b] : begin[b + 1]]
        base = 0
        while True:  # 64 displacements at a time
            spots = (_mix(keys[members][None, :], (base + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            spots_sorted = np.sort(spots, axis=1)
            good = (slots[spots] < 0).all(1) & (spots_sorted[:, 1:] != spots_sorted[:, :-1]).all(1)
            if good.any():
                i = int(np.argmax(good))
                displace[b], slots[spots[i]] = base + tries[i], members
                break
            base += 64
    single = by_size[sizes[by_size] == 1]
    free = np.flatnonzero(slots < 0)
    displace[single] = -free[: len(single)] - 1  # a bucket of one key names its slot
    slots[free[: len(single)]] = order[begin[single]]
    return displace, (_mix(keys[slots], 1 << 20) >> np.uint64(48)).astype(np.uint16), slots


def find(keys: np.ndarray, displace: np.ndarray, prints: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Ordinal of each key, -1 where the stored fingerprint says that the key is not in the shard."""
    n = len(slots)
    if not n:
        return np.full(len(keys), -1, np.int64)
    keys = keys.view(np.uint64)
    d = displace[(_mix(keys, 0) % np.uint64(len(displace))).astype(np.int64)].astype(np.int64)
    slot = np.where(d < 0, -d - 1, (_mix(keys, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64))
    hit = prints[slot] == (_mix(keys, 1 << 20) >> np.uint64(48)).astype(np.uint16)
    return np.where(hit, slots[slot], -1)


def _shard(part: int, seq: int, before: int, keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, width: int) -> dict:
    known = np.array([k is not None for k in keys], bool)
    values = np.array([k or 0 for k in keys], np.int64)
    at = np.flatnonzero(known)
    _, first = np.unique(values[at], return_index=True)  # the index leads to the first row of a repeated key
    first = np.sort(at[first])
    displace, prints, slots = build_index(values[first])
    slots = first[slots].astype(np.int32) if len(first) else slots
    starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    return {
        "part": part, "seq": seq, "before": before, "n_docs": len(keys), "n_ids": int(starts[-1]), "width": width,
        "min_key": int(values[at].min()) if len(at) else None, "max_key": int(values[at].max()) if len(at) else None,
        "keys": np.where(known, values, 0).astype("<i8").tobytes() + np.packbits(known).tobytes(),
        "starts": starts.tobytes(), "displace": displace.astype("<i4").tobytes(), "prints": prints.astype("<u2").tobytes(),
        "slots": slots.astype("<i4").tobytes(), "payload": ids.astype(f"<u{width}").tobytes(),
    }


def write_store(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write the store at path; returns the store as a table.

    Null texts count as empty and hold the end id only. Rows without a key come first and are reached by
    scans only; of repeated keys the index reaches the first. Other columns of docs are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    parts = parts or max(1, docs.rdd.getNumPartitions())
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("min_key", pa.int64()), ("max_key", pa.int64())] + [(c, pa.binary()) for c in ("keys", "starts", "displace", "prints", "slots", "payload")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(tokenizer, False)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, before
            row = _shard(part, seq, before, keys, np.concatenate(sizes), np.concatenate(ids), width)
            seq, before = seq + 1, before + row["n_ids"]
            keys.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for piece in slices(batches, "text", TEXT_SLICE):
            flat, n = enc.encode_array(piece.column("text"))
            own = np.insert(flat, np.cumsum(n), END_ID).astype(f"<u{width}")
            n, start, last = n + 1, 0, 0
            ends = np.cumsum(n)
            names = piece.column("key").to_pylist()
            while start < len(n):  # whole documents up to the shard's size
                room = SHARD_IDS - sum(map(len, ids))
                stop = max(start + (not keys), int(np.searchsorted(ends, last + room, "right")))
                stop = min(stop, len(n), start + SHARD_DOCS - len(keys))
                if stop > start:
                    keys += names[start:stop]
                    sizes.append(n[start:stop])
                    ids.append(own[last : ends[stop - 1]])
                    start, last = stop, int(ends[stop - 1])
                if start < len(n) and keys:
                    yield close()
        if keys:
            yield close()

    ordered = docs.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    ordered.mapInArrow(tidy(run, lambda: coder(tokenizer, False).clear()), STORE).write.option("compression", "zstd").parquet(path)
    return open_store(docs.sparkSession, path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], d) for c, d in (("displace", "<i4"), ("prints", "<u2"), ("slots", "<i4"), ("starts", "<u8"), ("payload", f"<u{row['width']}")))


def read_digests(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the store through its index.

    One total per range partition is summed up in one place; there are as many as the store has partitions.
    """
    totals = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n = row["n_docs"]
                keys = np.frombuffer(row["keys"][: 8 * n], "<i8")
                known = np.unpackbits(np.frombuffer(row["keys"][8 * n :], np.uint8))[:n].astype(bool)
                displace, prints, slots, starts, payload = _arrays(row)
                ordinal = np.arange(n)
                hit = find(keys[known], displace, prints, slots)
                back = keys[hit]
                if (hit < 0).any() or (back != keys[known]).any():
                    raise ValueError(f"shard {row['part']}.{row['seq']}: the index does not lead to its keys")
                first = np.zeros(n, bool)
                first[hit] = True
                ordinal[known] = np.where(first[known], hit, ordinal[known])
                begin, end = starts[ordinal].astype(np.int64), starts[ordinal + 1].astype(np.int64)
                crc = [zlib.crc32(payload[a:b].astype("<u4").tobytes()) for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.record_batch(
                    [pa.array([int(k) if ok else None for k, ok in zip(keys, known)], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(begin + row["before"]), pa.array(end - begin), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
                )

    rows = store.mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(store: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id and ids of the named keys (a list that the caller holds): only shards whose key range fits are read."""
    wanted = sorted(set(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                displace, prints, slots, starts, payload = _arrays(row)
                own = np.array([k for k in wanted if row["min_key"] <= k <= row["max_key"]], np.int64)
                hit = find(own, displace, prints, slots)
                stored = np.frombuffer(row["keys"][: 8 * row["n_docs"]], "<i8")
                got = [(int(k), payload[int(starts[h]) : int(starts[h + 1])].tolist()) for k, h in zip(own, hit) if h >= 0 and stored[h] == k]
                yield pa.record_batch([pa.array([k for k, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for k in wanted:
        near = near | ((F.col("min_key") <= k) & (F.col("max_key") >= k))
    return store.filter(near).mapInArrow(run, "doc_id long, ids array<long>")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    return read_digests(write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")))
