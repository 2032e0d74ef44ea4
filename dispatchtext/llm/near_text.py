"""Near-duplicate texts by Jaccard similarity of their word shingles: the pipeline's stage beside the SimHash operator.

A text is the set of its shingles of WORDS words. HASHES minima over that set agree between two texts about as often as
their Jaccard similarity says. Two bits of each minimum are a sketch of 64 bytes; BANDS groups of ROWS whole minima are bucket
keys: a pair of similarity 0.8 shares a key with probability 0.985, one of 0.5 with 0.2. Pairs that share a key are
linked if their sketches agree as at a similarity of SIMILARITY or more (standard deviation of a sketch at 0.8: 0.03;
SIMILARITY lies a little below 0.8, so that few pairs at 0.8 are missed and few at 0.7 are linked).

Work is on distinct signatures. A bucket is linked by one task into a spanning forest of its close pairs, not into all pairs.
A bucket of more than MAX_BUCKET signatures is dealt into pieces, and every two pieces meet in a task of their own, so nothing is
capped and no task holds more than two pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, slices, tidy
from .components import components
from .words import hashed_words

WORDS = 5
HASHES = 256
ROWS, BANDS = 6, 14
SIMILARITY = 0.765
MAX_BUCKET = 16_384
SEED = 7

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIELDS = np.uint64(0x5555555555555555)  # one bit of every two


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed]).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


_ORDERS = _odd(HASHES, 2).astype(np.uint32)  # the low halves, odd too


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, from those of its words; of fewer words, of the whole sequence."""
    factors, m = _odd(size, 1), max(len(words) - size + 1, 1)
    out = np.zeros(m, np.uint64)
    for i, f in enumerate(factors[: len(words)]):
        out += words[i : i + m] * f
    return _mix(out + np.uint64(min(len(words), size)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of shingle hashes, each under another order of 32-bit numbers; one value for the empty set."""
    h, out, room = (hashes >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32), np.empty((256, HASHES), np.uint32)
    for i in range(0, len(h), 256):  # stays within the cache
        part = h[i : i + 256, None]
        product = np.multiply(part, _ORDERS, out=room[: len(part)])
        np.minimum(out, product.min(0), out=out)
    return _mix(out.astype(np.uint64) + np.uint64(1))


def signature(words: np.ndarray) -> tuple[bytes, list[int], int]:
    """(sketch, band keys, hash of all minima) of a text's word hashes."""
    least = minima(shingles(words) if len(words) else np.zeros(0, np.uint64))
    bits = (least & np.uint64(3)).reshape(-1, 32) << (2 * np.arange(32, dtype=np.uint64))
    bands = [xxhash.xxh3_64_intdigest(b) for b in least[: ROWS * BANDS].reshape(BANDS, ROWS)]
    return np.bitwise_or.reduce(bits, 1).tobytes(), bands, xxhash.xxh3_64_intdigest(least)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), sketch, bands and sig of every row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [signature(hashed_words((t or b"").translate(_LOWER))) for t in part.column("text").cast(pa.binary()).to_pylist()]
            sketch, bands, sig = zip(*found)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(np.array(bands, np.uint64).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            columns = [part.column("doc_id"), part.column("row"), pa.array(sketch, pa.binary()), keys, pa.array(np.array(sig, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "sketch", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, hashed_words.clear), "doc_id long, row long, sketch binary, bands array<long>, sig long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima on which sketches (rows of 8 words) disagree as far as two bits tell."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _FIELDS).sum(-1)


def most_differing(similarity: float) -> int:
    return int(HASHES * (1 - similarity) * 0.75)


def forest(sketches: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest (places) of the pairs that disagree on `limit` minima at most, breadth first."""
    edges, rest = [], np.arange(len(sketches))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = differing(sketches[rest], sketches[at]) <= limit
            found, rest = rest[near], rest[~near]
            edges += [(at, x) for x in found]
            queue += list(found)
    return edges


def _link(limit: int):
    """Step over rows ordered by bucket: the edges of each bucket's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch:
            ids = np.stack([rows.column(c).to_numpy() for c in ("tab", "key", "meeting")], 1)
            node = rows.column("node").to_numpy()
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, HASHES // 32)
            cuts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]))
            edges = [(node[a + x], node[a + y]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1 for x, y in forest(sketches[a:b], limit)]
            ends = np.unique(np.sort(np.array(edges, np.int64).reshape(-1, 2), 1), axis=0)
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            ids = np.stack([rows.column(c).to_numpy() for c in ("tab", "key", "meeting")], 1)
            other = np.flatnonzero((ids != ids[-1]).any(1))
            done = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on in the next batch
            if done:
                yield solve(rows.slice(0, done))
            held = rows.slice(done).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def close_links(distinct: DataFrame, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (src, dst) that connect the nodes reachable over close pairs of one bucket. distinct: node, sketch, bands."""
    keyed = distinct.select("node", F.posexplode("bands").alias("tab", "key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, ["tab", "key"]), "near-buckets")
    pieces = F.ceil(F.col("n") / (max_bucket / 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), pieces).cast("int")
    pair = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.least(own, j).cast("long") * pieces + F.greatest(own, j))
    meetings = F.when(F.col("n") > max_bucket, pair).otherwise(F.array(F.lit(0).cast("long")))
    rows = shared.select("tab", "key", "node", F.explode(meetings).alias("meeting")).join(distinct.select("node", "sketch"), "node")
    rows = rows.repartition("tab", "key", "meeting").sortWithinPartitions("tab", "key", "meeting", "node")
    return rows.mapInArrow(tidy(_link(most_differing(similarity))), "src long, dst long")


def groups(sigs: DataFrame, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """sketch, sig, first_id (least doc_id) and comp (its group) of every distinct signature.

    Where sigs hold SimHash fingerprints (fp0, fp1), they belong to the signature, and close fingerprints are links too.
    """
    keys = _keys(sigs)
    distinct = sigs.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.min("bands").alias("bands"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "near-distinct")  # written, so ids stay
    links = close_links(distinct, similarity, max_bucket)
    if "fp0" in keys:
        links = links.unionByName(simhash.close_links(distinct.select("node", "fp0", "fp1"), simhash.RADIUS, simhash.NEAR_LIMIT))
    linked = components(links).withColumnRenamed("node", "linked")
    joined = distinct.join(linked, distinct.node == linked.linked, "left")
    return materialize(joined.select(*keys, "first_id", F.coalesce("component", "node").alias("comp")), "near-groups")


def _keys(sigs: DataFrame) -> list[str]:
    return [c for c in ("sketch", "sig", "fp0", "fp1") if c in sigs.columns]


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET, fingerprints: bool = False) -> DataFrame:
    """The rows of docs (all columns) that stay: of each group of near-duplicates the one with the smallest doc_id.

    Null and wordless texts are one group. A null doc_id loses against any other; of rows equal in doc_id and text one
    stays. An empty table stays empty; columns of any other name pass through. fingerprints: texts whose SimHash fingerprints
    (128 bits over the same shingles) differ in simhash.NEAR_LIMIT bits at most, and in RADIUS of either 64, are linked too.
    """
    sigs = signatures(docs)
    if fingerprints:  # made apart, met by row
        marks = simhash.fingerprints(docs, WORDS, wide=True).select("row", "fp0", "fp1").dropDuplicates(["row"])
        sigs = sigs.join(marks, "row")
    sigs = materialize(sigs, "near-signatures")
    keys = _keys(sigs)
    found = groups(sigs.drop("row"), similarity, max_bucket)
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", *keys)).alias("best"))
    winners = best.select("best.first_id", *[f"best.{c}" for c in keys])
    # The winner's rows: of the same id and signature, the least row hash.
    named = sigs.select("doc_id", "row", *keys).join(winners, keys).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    named = named.groupBy(*keys).agg(F.min("row").alias("_row"), F.first("doc_id", True).alias("_id"))
    own_keys = [F.col("_row"), F.coalesce("_id", F.lit(0)).alias("_key"), F.col("_id").isNull().alias("_none")]
    own = F.col("doc_id").cast("long")
    marked = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("_row"), F.coalesce(own, F.lit(0)).alias("_key"), own.isNull().alias("_none"))
    # Join and removal of equal rows share one exchange of the texts.
    kept = marked.join(named.select(*own_keys).hint("shuffle_merge"), ["_row", "_key", "_none"], "left_semi")
    return kept.dropDuplicates(["_row", "_key", "_none"]).select("doc.*")
