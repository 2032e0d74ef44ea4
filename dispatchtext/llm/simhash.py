"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: bit b is set when more than half of the text's shingle hashes have it set; 64 bits, or 128 bits in two
words. Covering masks: every bit position i of a word gets a random non-zero label m(i) of radius+1 bits; for each
non-zero v of radius+1 bits, table v keys a fingerprint by the bits of the word whose label has odd overlap with v.
Two fingerprints that differ in at most `radius` positions of the word give at most `radius` labels, which cannot
span radius+1 dimensions, so some v is orthogonal to all of them: the pair shares its key in that table. No pair
within the radius in any word is missed. Pairs that share a key are links if they differ in at most `limit` bits of
the whole fingerprint.

Work is on distinct fingerprints. A bucket of up to max_bucket of them is linked by one task into a spanning forest
of its close pairs, not into all pairs. Larger buckets are split again by covering masks over the bits that their
key leaves free, twice if need be; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy
from .components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
MAX_BUCKET = 2048
BITS = 64
#: deduplicate(): shingles of five words; 128 bits, where a Jaccard similarity of 0.8 is an angle that parts 19.4 bits
#: (128 / pi * acos(2 * 0.8 / 1.8)); the radius of each 64-bit word trades recall for tables (2 * 63 of them).
NEAR_WORDS, NEAR_RADIUS, NEAR_LIMIT, NEAR_BUCKET = 5, 5, 19, 32_768

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, wide: bool = False) -> tuple[int, ...]:
    """The 64-bit words of one text's fingerprint; all 0 without words. Wide ones take XXH3 of 128 bits, others XXH64."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n, size = len(parts), 2 if wide else 1
    if not n:
        return (0,) * size
    digest = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    joined = b" ".join(parts)
    if n <= words:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view = memoryview(joined)
        m = n - words + 1
        hashes = b"".join([digest(view[s:e], SEED) for s, e in zip(starts[:m].tolist(), ends[words - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8 * size)[:, ::-1]  # digests are big-endian
    ones = np.zeros(BITS * size, np.int64)
    for i in range(0, len(rows), 1 << 15):  # bounded memory for giant texts
        ones += np.unpackbits(np.ascontiguousarray(rows[i : i + (1 << 15)]), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(rows)).astype(np.uint8)
    return tuple(np.packbits(bits, bitorder="little").view("<u8").tolist())


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, wide: bool = False) -> DataFrame:
    """doc_id, row (a hash of id and text) and the fingerprint as signed longs (fp0, and fp1 if wide). Null texts count as empty."""
    names = ["fp0", "fp1"] if wide else ["fp0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, words, wide) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), part.column("row"), *(pa.array(fps[:, i]) for i in range(len(names)))], names=["doc_id", "row", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, row long" + "".join(f", {n} long" for n in names))


def covering_masks(free: int = (1 << BITS) - 1, radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """2**(radius+1)-1 masks over the positions in `free` that together cover every set of `radius` of them."""
    rng = np.random.default_rng([seed, free & 0xFFFFFFFF, free >> 32])
    positions = [i for i in range(BITS) if free >> i & 1]
    labels = list(range(1, 1 << (radius + 1)))
    spread = [labels[i % len(labels)] for i in range(len(positions))]  # even use of labels: masks of equal weight
    rng.shuffle(spread)
    return [
        sum(1 << p for p, m in zip(positions, spread) if bin(m & v).count("1") % 2) for v in range(1, 1 << (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table_masks(level: int, radius: int, words: int) -> list[tuple[int, int, int]]:
    """(table of the level before, word, mask of all fixed bits) of each table of a level; level 0 has words * (2**(radius+1)-1)."""
    full = (1 << BITS) - 1
    out = [(w, w, 0) for w in range(words)]
    for _ in range(level + 1):
        out = [(old, w, fixed | m) for old, (_, w, fixed) in enumerate(out) for m in covering_masks(full & ~fixed, radius)]
    return out


def _forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest (places) of the pairs within the limit among fingerprints (rows of words), breadth first."""
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            cur = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[cur]).sum(1) <= limit
            if near.any():
                found = rest[near]
                edges += [(cur, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _link(limit: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["tab", "key", "node", *names]
        held = np.empty((0, len(columns)), np.int64)

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
            node, fps = rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)  # signed numbers are counted without their sign
            two = starts[ends - starts == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1) <= limit]
            pairs = [np.stack([near, near + 1], 1)]
            more = ends - starts > 2
            for s, e in zip(starts[more].tolist(), ends[more].tolist()):
                found = _forest(fps[s:e], limit)
                if found:
                    pairs.append(np.array(found) + s)
            at = np.concatenate(pairs)
            links = np.unique(np.stack([node[at].min(1), node[at].max(1)], 1), axis=0)
            return pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["src", "dst"])

        for batch in batches:
            rows = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in columns], 1)))
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1)) if len(rows) else ()
            done = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if done:
                yield emit(rows[:done])
            held = rows[done:]
        if len(held):
            yield emit(held)

    return run


def close_links(distinct: DataFrame, radius: int = RADIUS, limit: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (src, dst) between nodes. `distinct` holds one row per fingerprint: node, fp0 and, if wide, fp1.

    The links connect all nodes that are reachable over pairs within `limit` bits (None: the radius) of which some
    word differs in `radius` bits at most. Pairs of one bucket may be represented by a path.
    """
    spark = distinct.sparkSession
    names = [c for c in ("fp0", "fp1") if c in distinct.columns]
    run = _link(radius if limit is None else limit, names)
    words = F.array(*names)
    links = None
    rows = distinct.select("node", *names)
    for level in range(3):
        masks = _table_masks(level, radius, len(names))
        if level == 0:
            tab = rows.select("node", *names, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"))
            word, mask = (F.element_at(F.array(*map(F.lit, x)), F.col("t") + 1) for x in ([w for _, w, _ in masks], [_signed(m) for *_, m in masks]))
            key = F.element_at(words, word + 1).bitwiseAND(mask)
            keyed = tab.select(F.col("t").cast("long").alias("tab"), key.alias("key"), "node", *names)
        else:
            sub = spark.createDataFrame([(old, i, w, _signed(m)) for i, (old, w, m) in enumerate(masks)], "old long, tab long, word int, mask long")
            keyed = (
                rows.withColumnRenamed("tab", "old").join(F.broadcast(sub), "old")  # words * (2**(radius+1)-1)**(level+1) rows, whatever the data
                .select("tab", F.element_at(words, F.col("word") + 1).bitwiseAND(F.col("mask")).alias("key"), "node", *names)
            )
        sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = materialize(keyed.join(sizes, ["tab", "key"]), f"simhash-buckets{level}")
        last = level == 2
        small = sized if last else sized.filter(F.col("n") <= max_bucket)
        found = small.select("tab", "key", "node", *names).repartition("tab", "key").sortWithinPartitions("tab", "key", "node").mapInArrow(tidy(run), "src long, dst long")
        links = found if links is None else links.unionByName(found)
        if last or not sized.filter(F.col("n") > max_bucket).limit(1).count():
            break
        rows = sized.filter(F.col("n") > max_bucket).select("tab", "node", *names)
    return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints at most `radius` bits apart. Null and
    wordless texts have fingerprint zero and are linked like any other; repeated rows stay and share their
    component; a null doc_id stays null and never names a component (a component of such rows only has a
    null component_id). An empty table gives an empty result. Other columns of docs are not read.
    """
    fps = materialize(fingerprints(docs), "simhash-fps")
    groups = _groups(fps, radius, None, max_bucket)
    firsts = groups.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    by_fp = groups.join(firsts, "comp").select("fp0", "component_id")
    return fps.join(by_fp, "fp0").select(
        "doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _groups(fps: DataFrame, radius: int, limit: int | None, max_bucket: int) -> DataFrame:
    """fp0 (and fp1), first_id and comp by distinct fingerprint; comp is the least node of a component."""
    names = [c for c in ("fp0", "fp1") if c in fps.columns]
    node = F.col("fp0") if len(names) == 1 else F.monotonically_increasing_id()  # written, so it stays
    distinct = materialize(fps.groupBy(*names).agg(F.min("doc_id").alias("first_id")).withColumn("node", node), "simhash-distinct")
    linked = components(close_links(distinct, radius, limit, max_bucket)).withColumnRenamed("node", "linked")  # linked fingerprints only
    groups = distinct.join(linked, distinct.node == linked.linked, "left").select(*names, "first_id", F.coalesce("component", "node").alias("comp"))
    return materialize(groups, "simhash-components")


def deduplicate(docs: DataFrame, words: int = NEAR_WORDS, radius: int = NEAR_RADIUS, limit: int = NEAR_LIMIT, max_bucket: int = NEAR_BUCKET) -> DataFrame:
    """The rows of docs (all columns) that stay: of each component the one with the smallest doc_id.

    Documents link where wide fingerprints over shingles of `words` words differ in at most `limit` of 128 bits, a
    similarity of 0.8 or more as the fingerprint measures it, and in at most `radius` bits of either 64. Null and
    wordless texts are one group. A null doc_id loses against any other; of rows equal in doc_id and text one stays.
    An empty table stays empty; columns of any other name pass through.
    """
    fps = materialize(fingerprints(docs, words, wide=True), "simhash-fps")
    groups = _groups(fps, radius, limit, max_bucket)
    best = groups.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp0", "fp1")).alias("best"))
    winners = best.select("best.first_id", "best.fp0", "best.fp1")
    # The winner's rows: of the same id and fingerprint, the least row hash.
    named = fps.join(winners, ["fp0", "fp1"]).filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("fp0", "fp1").agg(F.min("row").alias("_row"), F.first("doc_id", True).alias("_id"))
    keys = [F.col("_row"), F.coalesce("_id", F.lit(0)).alias("_key"), F.col("_id").isNull().alias("_none")]
    own = F.col("doc_id").cast("long")
    marked = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("_row"), F.coalesce(own, F.lit(0)).alias("_key"), own.isNull().alias("_none"))
    # Join and removal of equal rows share one exchange of the texts.
    kept = marked.join(named.select(*keys).hint("shuffle_merge"), ["_row", "_key", "_none"], "left_semi")
    return kept.dropDuplicates(["_row", "_key", "_none"]).select("doc.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
