"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else goes.

A suffix array of the corpus would need every suffix beside its neighbours. Only the part of it that can hold a repeat is
built, in pieces that need no other piece:

1. Each window of LENGTH bytes has an anchor, the least hash of the stretches of ANCHOR bytes in it. Equal windows have
   equal anchors at equal places. Neighbouring windows share anchors; the bytes of all windows of one anchor are its
   context (about 270 bytes for every 60 of text).
2. Anchors and contexts are counted by hash. A context that occurs twice is repeated as a whole, a context whose anchor
   occurs once holds no repeat. What is left are contexts that share an anchor and differ.
3. Only those are cut from the texts, one for each distinct context, and dealt out by anchor. Each task puts them, whole
   anchors at a time, into buffers and sorts the suffixes in two stages: suffixes smaller than their successors directly,
   the rest by scans over the buckets of first bytes. Adjacent windows with a common prefix of LENGTH bytes are repeated.
4. An anchor with more than HOT contexts (a line that very many documents share) is not gathered: its windows are
   compared by their own 128-bit digests, which spreads them over all tasks.

Every anchor, context, window and text is looked at; nothing is capped. Contexts are held equal by two independent 64-bit hashes.
Tables that are needed no more are deleted, and Spark drops the shuffle files of each written table.

A null text is empty; texts below LENGTH bytes keep all. Rows that are equal in doc_id and text are copies of each other and
lose everything from LENGTH bytes on. A null doc_id is a value like any other. Empty tables give no rows; columns besides doc_id
and text are not read. Giant texts are anchored in pieces that overlap by one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, remove
from .common import slices, table, tidy

LENGTH = 200
ANCHOR = 64
#: Distinct contexts of an anchor that one task sorts; beyond them windows go by digest.
HOT = 4096
#: Bytes of texts that are hashed at a time, of contexts that are sorted at a time.
HASH_BYTES = 1 << 20
SORT_BYTES = 1 << 20
#: Contexts that are cut at a time.
CUTS = 20_000
#: Parameters of the rolling hash: seed of its byte values, and an odd multiplier.
HASH_SEED = 11
MULTIPLIER = 0x9E3779B97F4A7C15

_PLACE_BITS = 24  # a place within a hashed buffer
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Anchors:
    """Finds the anchors of all windows in a buffer of whole texts."""

    def __init__(self, length: int, anchor: int) -> None:
        self.length, self.anchor = length, anchor
        self.values = np.random.default_rng(HASH_SEED).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", MULTIPLIER), ("inverse", pow(MULTIPLIER, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, buffer: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, number of windows) of every run of windows with one anchor.

        last: for each byte, the last place a window may start at without leaving its text.
        """
        n, k, wide = len(buffer), self.anchor, self.length - self.anchor + 1
        if n < self.length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._grow(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[buffer] * self.powers[:n])))
        h = (total[k:] - total[:-k]) * self.inverse[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        order = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the least hash, the first place among equals
        rows = np.concatenate((order, np.full(-len(order) % wide, 2**64 - 1, np.uint64))).reshape(-1, wide)
        ahead, behind = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        windows = len(h) - wide + 1
        place = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & low).astype(np.int64)
        place[np.arange(windows) > last[:windows]] = -1  # over the end of a text
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.concatenate((first, [windows])))
        good = place[first] >= 0
        return h[place[first[good]]], first[good], count[good]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in groups of about HASH_BYTES; a longer text is cut into pieces that share length - 1 bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(len(text) - length + 1, 0), HASH_BYTES):
            piece = text[start : start + HASH_BYTES + length - 1]
            group.append((i, start, piece))
            size += len(piece)
            if size >= HASH_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchored(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, mark, anchors (h, c, at, width, n) and own (start, end) of each text.

    A context that a text holds twice comes once, with its number n; its windows are repeated for certain: `own`.
    """
    kind = pa.struct([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int32()), ("width", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, anchor)
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [[np.zeros(0, np.int64)] * 5]
            for group in _pieces(texts, length):
                sizes = np.array([len(b) for _, _, b in group])
                starts = np.concatenate(([0], np.cumsum(sizes)))
                data = b"".join(b for _, _, b in group)
                h, first, width = find(np.frombuffer(data, np.uint8), np.repeat(starts[1:] - length, sizes))
                c = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + w + length - 1]) for a, w in zip(first.tolist(), width.tolist())), np.uint64, len(first))
                which = np.searchsorted(starts, first, "right") - 1
                at = first - starts[which] + np.array([offset for _, offset, _ in group])[which]
                found.append([np.array([i for i, _, _ in group])[which], h.view(np.int64), c.view(np.int64), at, width])
            text, h, c, at, width = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, c, h, text))
            text, h, c, at, width = (x[order] for x in (text, h, c, at, width))
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            n = np.bincount(np.cumsum(new) - 1, minlength=new.sum())
            twice = np.repeat(n > 1, n)
            numbers = [pa.array(h[new]), pa.array(c[new]), pa.array(at[new].astype(np.int32)), pa.array(width[new].astype(np.int32)), pa.array(n.astype(np.int32))]
            order = np.lexsort((at[twice], text[twice]))
            in_text, start, end = (x[twice][order] for x in (text, at, at + width + length - 1))
            opens = np.ones(len(start), bool)
            opens[1:] = (in_text[1:] != in_text[:-1]) | (start[1:] > end[:-1])
            closes = np.concatenate((opens[1:], np.ones(min(len(start), 1), bool)))
            own = [pa.array(start[opens].astype(np.int32)), pa.array(end[closes].astype(np.int32))]
            ends = np.arange(len(texts) + 1)
            anchors = pa.ListArray.from_arrays(np.searchsorted(text[new], ends).astype(np.int32), pa.StructArray.from_arrays(numbers, fields=list(kind)))
            spans = pa.ListArray.from_arrays(np.searchsorted(in_text[opens], ends).astype(np.int32), pa.StructArray.from_arrays(own, ["start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), anchors, spans], ["doc_id", "mark", "anchors", "own"])

    kinds = "mark long, anchors array<struct<h:long,c:long,at:int,width:int,n:int>>, own array<struct<start:int,end:int>>"
    return docs.filter(F.octet_length("text") >= length).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def two_stage_sort(text: bytes, depth: int) -> np.ndarray:
    """Places of all suffixes of text, in the order of their first `depth` bytes at least. The text ends with its only least byte, or any.

    Suffixes smaller than their successors are sorted directly, within buckets of their first two bytes. Any other suffix
    follows its successor in the order, so it is placed when its successor is: bucket by bucket, first what earlier
    buckets placed here and what that brings in by the same byte, then the sorted suffixes; all of them place their predecessors.
    """
    t = np.frombuffer(text, np.uint8).astype(np.int16)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    step = np.flatnonzero(t[1:] != t[:-1])  # where the next byte differs
    at = np.searchsorted(step, np.arange(n))  # a run of equal bytes has the kind of its last byte
    rising = np.zeros(n, bool)
    inside = at < len(step)
    rising[inside] = t[step[at[inside]] + 1] > t[step[at[inside]]]

    places = np.flatnonzero(rising)
    pair = t[places].astype(np.int32) * 256 + t[places + 1]
    order = np.argsort(pair, kind="stable")
    places, pair = places[order], pair[order]
    direct: dict[int, list[np.ndarray]] = {}
    cuts = np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)])) if len(pair) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        group = places[a:b]
        if b - a > 1:
            keys = [text[p + 2 : p + depth] for p in group.tolist()]
            group = group[sorted(range(b - a), key=keys.__getitem__)]
        direct.setdefault(int(pair[a]) >> 8, []).append(group)

    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    placed[t[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for byte in range(256):
        front = np.concatenate(placed[byte]) if placed[byte] else np.zeros(0, np.int64)
        grown, new = [front], front
        while len(new):
            new = new[new > 0] - 1
            new = new[t[new] == byte]
            grown.append(new)
        bucket = np.concatenate(grown + direct.get(byte, []))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > byte]
        if len(before):
            to = t[before]
            order = np.argsort(to, kind="stable")
            before, to = before[order], to[order]
            ends = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                placed[to[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at neighbouring places, `depth` at most; text goes on for 8 bytes after the last compared one."""
    padded = text + bytes(depth + 8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.zeros(max(len(places) - 1, 0), np.int64)
    alive = np.arange(len(out))
    for step in range(0, depth, 8):
        differs = words[places[alive] + step] ^ words[places[alive + 1] + step]
        same = differs == 0
        lowest = differs[~same] & (~differs[~same] + np.uint64(1))
        out[alive[~same]] = step + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
        alive = alive[same]
    out[alive] = depth
    return np.minimum(out, depth)


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) of the runs of windows that occur twice or more in these contexts.

    The contexts are joined with a byte below all of theirs between them: UTF-8 has no byte 255, so all are moved up by one.
    """
    text = b"".join(c.translate(_UP) + b"\0" for c in contexts)
    sizes = np.array([len(c) + 1 for c in contexts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    is_window = np.arange(len(text)) < np.repeat(starts[1:] - length, sizes)
    places = two_stage_sort(text, length)
    places = places[is_window[places]]
    alike = common_prefixes(text, places, length) >= length
    marked = np.zeros(len(text) + 1, bool)
    marked[places[1:][alike]] = True
    marked[places[:-1][alike]] = True
    edges = np.flatnonzero(marked[1:] != marked[:-1]) + 1
    if marked[0]:
        edges = np.concatenate(([0], edges))
    first, end = edges[::2], edges[1::2]
    which = np.searchsorted(starts, first, "right") - 1
    return which, first - starts[which], end - 1 - starts[which]


_UP = bytes((c + 1) & 255 for c in range(256))


def _sort_contexts(length: int):
    """Step over contexts ordered by h: spans (doc_id, mark, start, end) of repeats in contexts that occur once."""

    def solve(rows: list[dict]) -> Iterator[dict]:
        which, first, last = repeated_windows([r["context"] for r in rows], length)
        for i, a, b in zip(which.tolist(), first.tolist(), last.tolist()):
            r = rows[i]
            if not r["repeated"]:
                yield {"doc_id": r["doc_id"], "mark": r["mark"], "start": r["at"] + a, "end": r["at"] + b + length}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, size, last = None, [], 0, (None, None)
        for batch in slices(batches, "context"):
            schema = pa.schema([batch.schema.field("doc_id"), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
            for row in batch.to_pylist():
                if (row["h"], row["c"]) == last:  # the same context, from a row that is equal to another
                    continue
                if size > SORT_BYTES and row["h"] != last[0]:
                    yield pa.RecordBatch.from_pylist(list(solve(held)), schema)
                    held, size = [], 0
                held.append(row)
                size += len(row["context"])
                last = (row["h"], row["c"])
        if held:
            yield pa.RecordBatch.from_pylist(list(solve(held)), schema)

    return run


def _cut(length: int):
    """Step over texts with their needs: the bytes of each needed context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts, of, needs = batch.column("text").cast(pa.binary()), pc.list_parent_indices(batch.column("needs")), batch.column("needs").flatten()
            for low in range(0, len(needs), CUTS):
                part, row = needs.slice(low, CUTS), of.slice(low, CUTS)
                fields = {x: part.field(i) for i, x in enumerate(("h", "c", "at", "width", "repeated", "hot"))}
                held = {i: texts[i].as_py() for i in row.unique().to_pylist()}
                context = [held[i][a : a + w + length - 1] for i, a, w in zip(row.to_pylist(), fields["at"].to_pylist(), fields["width"].to_pylist())]
                columns = {x: batch.column(x).take(row) for x in ("doc_id", "mark")} | fields | {"context": pa.array(context, pa.binary())}
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


def _digests(length: int):
    """Step over contexts of hot anchors: a row with a digest for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context", 1 << 18):
            rows = batch.to_pylist()
            digests = [xxhash.xxh3_128_digest(r["context"][i : i + length]) for r in rows for i in range(r["width"])]
            width = np.array([r["width"] for r in rows])
            each = pa.array(np.repeat(np.arange(len(rows)), width))
            start = np.concatenate([r["at"] + np.arange(r["width"]) for r in rows]).astype(np.int32)
            columns = [batch.column(c).take(each) for c in ("doc_id", "mark", "h", "c", "repeated")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(start), pa.array(digests, pa.binary())], ["doc_id", "mark", "h", "c", "repeated", "start", "digest"])

    return run


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of what is written meanwhile as soon as it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where it lies."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def repeated_spans(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, mark, start, end: byte spans, overlapping ones too, that cover what repeats in texts with a doc_id and a mark."""
    spark, key = keyed.sparkSession, keyed.schema["doc_id"].dataType.simpleString()
    anchors, anchors_path = _stage(anchored(keyed, length, anchor), "anchors")
    contexts, contexts_path = _stage(anchors.select(F.inline("anchors")).groupBy("h", "c").agg(F.sum("n").alias("n")), "contexts")
    mixed = contexts.groupBy("h").agg(F.count("*").alias("d"), F.min("n").alias("least")).filter("d > 1 and least = 1").select("h", (F.col("d") > hot).alias("hot"))
    verdicts = contexts.join(mixed, "h", "left").filter("n > 1 or hot is not null").select("h", "c", (F.col("n") > 1).alias("repeated"), "hot")
    verdicts, verdicts_path = _stage(verdicts, "verdicts")
    remove(spark, contexts_path)

    seen = anchors.select("doc_id", "mark", F.inline("anchors")).drop("n").join(verdicts, ["h", "c"])
    sure = F.col("hot").isNull()  # nothing but a repeat: its hashes are needed no more
    seen, seen_path = _stage(seen.select("doc_id", "mark", "at", "width", "repeated", "hot", *[F.when(~sure, F.col(x)).alias(x) for x in ("h", "c")]), "seen")
    found = seen.filter("repeated").select("doc_id", "mark", F.col("at").alias("start"), (F.col("at") + F.col("width") + (length - 1)).alias("end"))
    found = found.unionByName(anchors.select("doc_id", "mark", F.inline("own")))

    needs = seen.filter("hot is not null").groupBy("h", "c", "repeated", "hot").agg(F.min(F.struct("doc_id", "mark", "at", "width")).alias("r")).select("r.*", "h", "c", "repeated", "hot")
    needs = needs.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "c", "at", "width", "repeated", "hot")).alias("needs"))
    texts = keyed.join(needs.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc_id", "mark", "text", "needs")
    cut = texts.mapInArrow(tidy(_cut(length)), f"doc_id {key}, mark long, h long, c long, at int, width int, repeated boolean, hot boolean, context binary")
    cut, cut_path = _stage(cut, "cut")
    remove(spark, verdicts_path)

    near = cut.filter("not hot").drop("hot", "width").repartition("h").sortWithinPartitions("h", "c")
    near = near.mapInArrow(tidy(_sort_contexts(length)), f"doc_id {key}, mark long, start int, end int")
    windows = cut.filter("hot").dropDuplicates(["h", "c"]).mapInArrow(tidy(_digests(length)), f"doc_id {key}, mark long, h long, c long, repeated boolean, start int, digest binary")
    more = windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    far = windows.filter("not repeated").join(more, "digest").select("doc_id", "mark", "start", (F.col("start") + length).alias("end"))
    spans, _ = _stage(found.unionByName(near).unionByName(far).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    for path in (anchors_path, seen_path, cut_path):
        remove(spark, path)
    return spans


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes left, of every row of docs."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    spans = repeated_spans(keyed, length, anchor, hot).withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    rows = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                kept, at, runs = [], 0, 0
                for span in sorted(spans or [], key=lambda s: s["start"]):
                    if span["start"] > at or not runs:
                        kept.append(text[at : span["start"]])
                        runs += 1
                    at = max(at, span["end"])
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), runs, left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as slices of hexadecimal text, two digits a byte.
OP11_SQL = f"""with d as materialized (select row_number() over () as pos, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as materialized (select pos, p, md5_number(substr(x, 2 * p + 1, {2 * LENGTH})) as k from (select pos, x, unnest(range(length(x) // 2 - {LENGTH} + 1)) as p from d where length(x) >= {2 * LENGTH}) y),
r as (select pos, p, case when p <= lag(p) over (partition by pos order by p) + {LENGTH} then 0 else 1 end as opens from w semi join (select k from w group by k having count(*) > 1) m using (k)),
s as (select pos, run, min(p) as a, max(p) + {LENGTH} as b from (select *, sum(opens) over (partition by pos order by p) as run from r) z group by pos, run),
g as (select pos, a, b, coalesce(lag(b) over (partition by pos order by a), 0) as before from s),
kept as (select d.pos, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as left_over
  from g join d on d.pos = g.pos group by d.pos)
select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_over, x))) as kept_sha256 from d left join kept using (pos)"""
