"""Best-two-fit packing of token pieces into sequences of bounded length.

Each sequence is filled greedily (the longest piece, then again and again the longest that fits). If a gap
is left, its smallest piece may be swapped for two unpacked pieces that fill the widened gap more tightly.
Pieces are dealt by hash into groups of about GROUP_PIECES; each group is packed by one task, so the work
splits freely and at most about one sequence per group stays partly empty.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy
from .tokens import coder

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 50_000
TEXT_SLICE = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are 1 to capacity; equal lengths are interchangeable."""
    values, counts = np.unique(lengths, return_counts=True)
    present, left = values.tolist(), dict(zip(values.tolist(), counts.tolist()))

    def take(v: int) -> int:
        left[v] -= 1
        if not left[v]:
            del present[bisect_right(present, v) - 1]
        return v

    placed: list[tuple[int, int, int]] = []  # length, bin, offset
    number = 0
    while present:
        own = [take(present[-1])]
        gap = capacity - own[0]
        while gap and present and present[0] <= gap:
            own.append(take(present[bisect_right(present, gap) - 1]))
            gap -= own[-1]
        if gap and present:
            small, room = own[-1], gap + own[-1]
            best, pair = small, None
            i, j = 0, bisect_right(present, room - present[0]) - 1
            while i <= j:
                total = present[i] + present[j]
                if total > room or (i == j and left[present[i]] < 2):
                    j -= 1
                    continue
                if total > best:
                    best, pair = total, (present[i], present[j])
                    if total == room:
                        break
                i += 1
            if pair:
                own.pop()
                own += [take(pair[1]), take(pair[0])]
                if not left[small]:
                    insort(present, small)
                left[small] += 1
        offset = 0
        for v in own:
            placed.append((v, number, offset))
            offset += v
        number += 1
    by_length = np.array(placed, np.int64).reshape(-1, 3)
    by_length = by_length[np.argsort(by_length[:, 0], kind="stable")]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    bins[order], offsets[order] = by_length[:, 1], by_length[:, 2]
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document (PIECES and a row number in its task): ids and an end id, cut only if longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = coder(tokenizer, True), 0
        for part in slices(batches, "text", TEXT_SLICE):
            flat, n = enc.encode_array(part.column("text"))
            ids = np.insert(flat, np.cumsum(n), END_ID).astype("<u4")
            n = n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            at = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(at.tolist(), length.tolist())]
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(row, row + len(doc)))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )
            row += len(doc)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: coder(tokenizer, True).clear()), f"{PIECES}, row long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PIECES with sequence_id and offset. `pieces` is a written table (it is counted first) with cut_pieces' columns."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        bins, offsets = best_two_fit(group["length"].to_numpy(), capacity)
        number = (np.int64(group["g"][0].as_py()) << np.int64(40)) + bins
        return group.drop_columns(["g", "row"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece with the end id alone. Rows with a null or repeated doc_id are
    packed like any other. An empty table gives no rows. Other columns of docs are not read.
    """
    return pack(materialize(cut_pieces(docs, tokenizer, capacity), "pieces"), capacity, group_pieces)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
