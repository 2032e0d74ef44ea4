"""Divergence audit of sources: how far the word use of each source lies from that of every other source of its language.

Terms are counted in the scan. Each language keeps the terms of at least LEAST_DOCS documents and deals them out in
blocks of about BLOCK terms, so that no row holds a whole vocabulary. Within a block, a source is a vector of smoothed
shares in billionths. Sources sit in tiles of TILE; a tile stays where it is, and its compressed vectors travel to the
other tiles by the rounds of a round-robin tournament, in which every two tiles meet once and each travels to about half
of its meetings. A meeting gives the values of both directions; sums over blocks and ranks follow. The most telling terms
of a source come from a heap per source and block.

All numbers are whole and exact. Null text, lang and source count as empty strings. Sources without kept terms take part
(all their shares are the smoothing alone); a language without kept terms gives value 0 for every pair and no terms. Equal
values are ranked by the item's bytes. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table, tidy

LEAST_DOCS = 10
TOP_TERMS = 10
#: Terms of a block, sources of a tile.
BLOCK = 1024
TILE = 4
SCALE = 1_000_000_000
#: Terms that a task holds before it passes their counts on, bytes of a text that are split at a time, pairs that it sums up.
HELD_TERMS = 200_000
PIECE_BYTES = 4 << 20
HELD_PAIRS = 100_000
#: Languages up to which their sizes are broadcast.
MAX_BROADCAST = 10_000

#: ASCII letters in lower case stay, every other ASCII character ends a term; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, piece by piece, so that a giant text is never held as a list of words."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        piece = text[start : start + PIECE_BYTES].translate(_LETTERS)
        cut = piece.rfind(b" ") + 1
        if not cut:  # one term over a whole piece
            break
        yield piece[:cut].split()
        start += cut
    yield text[start:].translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (documents that hold it); a row with term '' stands for each source itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n_docs = defaultdict(Counter), defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(*key, t, c, n_docs[key][t]) for key, counter in n.items() for t, c in counter.items()]
            n.clear(), n_docs.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            columns[2] = columns[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "n_docs"])

        for piece in slices(batches, "text"):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            for key, text in zip(zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist()), texts):
                seen: set[bytes] = set()
                for words in _terms(text):
                    n[key].update(words)
                    seen.update(words)
                n_docs[key].update(seen)
                n[key][b""] += 1
            if sum(map(len, n.values())) > HELD_TERMS:
                yield flush()
        yield flush()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(tidy(run), "lang string, source string, term string, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)) without overflow: SCALE is taken in three steps of a thousand."""
    rest, out, below = np.asarray(count, np.int64) + 2, np.zeros(len(count), np.int64), max(total + 2 * size, 1)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _broadcast_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _residents(counts: DataFrame, least_docs: int, block: int, tile: int, top: int) -> DataFrame:
    """A row for each source and block: lang, block, n_tiles, tile, source, vector (compressed shares of the block's terms), best terms."""
    held = counts.filter("term <> ''")
    vocabulary = materialize(held.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("df")).filter(F.col("df") >= least_docs).drop("df"), "vocabulary")
    groups = counts.filter("term = ''").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(vocabulary.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total")), "lang", "left")
    sizes = sizes.fillna(0, ["size", "lang_total"]).withColumn("n_blocks", F.greatest(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    sizes = _broadcast_small(materialize(sizes.withColumn("n_tiles", F.ceil(F.col("n_sources") / tile).cast("int")), "vocabulary-sizes"))

    dealt = vocabulary.join(sizes.select("lang", "n_blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int"))
    blocks = materialize(dealt.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("term", "total"))).alias("terms")), "blocks")
    places = blocks.select("lang", "block", F.posexplode("terms").alias("idx", "t")).select("lang", "block", "idx", "t.term", "t.total")
    entries = held.drop("n_docs").join(places, ["lang", "term"])
    sparse = materialize(entries.groupBy("lang", "source", "block").agg(F.sum("n").alias("n"), F.collect_list(F.struct("idx", "n", "total", "term")).alias("entries")), "sparse")
    own_total = sparse.groupBy("lang", "source").agg(F.sum("n").alias("own_total"))

    seats = groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / tile).cast("int"))
    seats = seats.join(own_total, ["lang", "source"], "left").join(sizes, "lang")
    seats = seats.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    widths = blocks.select("lang", "block", F.size("terms").alias("width"))
    rows = seats.join(widths, ["lang", "block"], "left").join(sparse.drop("n"), ["lang", "source", "block"], "left")
    rows = rows.select("lang", "block", "n_tiles", "tile", "source", "size", "lang_total", F.coalesce("own_total", F.lit(0)).alias("own_total"), F.coalesce("width", F.lit(0)).alias("width"), "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            vectors, best = [], []
            for row in batch.select(["size", "lang_total", "own_total", "width", "entries"]).to_pylist():
                entries = row["entries"] or []
                count = np.zeros(row["width"], np.int64)
                count[[e["idx"] for e in entries]] = [e["n"] for e in entries]
                p = shares(count, row["own_total"], row["size"])
                vectors.append(press.compress(p.astype(np.uint32).tobytes()))
                q = shares(np.array([e["total"] for e in entries], np.int64), row["lang_total"], row["size"])
                own = p[[e["idx"] for e in entries]]
                more = [(-int(f), e["term"].encode(), e["term"]) for f, e, a, b in zip(distances(own, q), entries, own, q) if a > b]
                best.append([{"item": term, "value": -f} for f, _, term in heapq.nsmallest(top, more)])
            kept = ["lang", "block", "n_tiles", "tile", "source"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(vectors, pa.binary()), pa.array(best, pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))], [*kept, "vector", "best"]
            )

    return rows.mapInArrow(tidy(run), "lang string, block int, n_tiles int, tile int, source string, vector binary, best array<struct<item:string,value:long>>")


def journeys(tile: Column, n_tiles: Column) -> Column:
    """Tiles that this one travels to, round by round: the circle method over an even number of seats, one of them empty if need be.

    In round r, seats t and u below the last one meet if t + u = 2r modulo their number, and seat r meets the last seat.
    The seat that comes first going round from r is at home; the last seat is at home in even rounds. The tile itself is
    added: its own sources meet at home.
    """
    last = F.when(n_tiles % 2 == 0, n_tiles - 1).otherwise(n_tiles)  # the last seat, and the number of rounds

    def host(r: Column) -> Column:
        other = F.pmod(2 * r - tile, last)
        at_last = F.when(r % 2 == 1, r)  # where the last seat travels to
        moves = F.when(other == tile, F.when(r % 2 == 0, last)).when(F.pmod(tile - r, last) > F.floor(last / 2), other)
        return F.when(tile == last, at_last).otherwise(moves).cast("int")

    hosts = F.when(last > 0, F.filter(F.transform(F.sequence(F.lit(0), last - 1), host), lambda h: h.isNotNull() & (h < n_tiles))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(tile), hosts)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of all pairs of a host's and a guest's sources, summed within the task, in both directions."""
    opened, sums = zstandard.ZstdDecompressor(), defaultdict(int)

    def flush() -> pa.RecordBatch:
        rows = [(lang, *ends, v) for (lang, a, b), v in sums.items() for ends in ((a, b), (b, a))]
        sums.clear()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["lang", "source", "item", "value"])

    def vectors(side: list[dict]) -> list[tuple[str, np.ndarray]]:
        return [(s["source"], np.frombuffer(opened.decompress(s["vector"]), np.uint32).astype(np.int64)) for s in side]

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            host, home = vectors(row["host"]), row["tile"] == row["guest_tile"]
            guest = host if home else vectors(row["guest"])
            for k, (a, p) in enumerate(host):
                for b, q in guest[k + 1 :] if home else guest:
                    sums[row["lang"], min(a, b), max(a, b)] += int(distances(p, q).sum())
        if len(sums) > HELD_PAIRS:
            yield flush()
    yield flush()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` against every other source of the language, `term` the `top` terms that stand out."""
    residents = materialize(_residents(materialize(term_counts(docs), "term-counts"), least_docs, block, tile, top), "residents")
    tiles = residents.groupBy("lang", "block", "n_tiles", "tile").agg(F.collect_list(F.struct("source", "vector")).alias("host"))
    guests = tiles.select("lang", "block", F.col("tile").alias("guest_tile"), F.col("host").alias("guest"), F.explode(journeys(F.col("tile"), F.col("n_tiles"))).alias("tile"))
    meetings = tiles.drop("n_tiles").join(guests, ["lang", "block", "tile"])
    pairs = meetings.mapInArrow(tidy(_meet), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = residents.select("lang", "source", F.explode("best").alias("b")).select("lang", "source", "b.item", "b.value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = pairs.withColumns({"part": F.lit("pair"), "rank": place}).select(*columns)
    return pairs.unionByName(terms.withColumns({"part": F.lit("term"), "rank": place}).filter(F.col("rank") <= top).select(*columns))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""with d as materialized (select row_number() over () as pos, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as materialized (select lang, source, pos, t, count(*) as n from (select lang, source, pos, unnest(words) as t from d) x group by lang, source, pos, t),
kept as materialized (select lang, t, sum(n) as total from w group by lang, t having count(*) >= {LEAST_DOCS}),
g as materialized (select lang, source, coalesce(v, 0) as v from (select distinct lang, source from d) x left join (select lang, count(*) as v from kept group by lang) y using (lang)),
own as materialized (select lang, source, t, sum(n) as n from w join kept using (lang, t) group by lang, source, t),
cells as materialized (select lang, source, t, coalesce(n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(n, 0) + 2)) // (coalesce(all_n, 0) + 2 * v) as p
  from g join kept using (lang) left join own using (lang, source, t) left join (select lang, source, sum(n) as all_n from own group by lang, source) z using (lang, source)),
whole as (select lang, t, 1 + ({SCALE}::hugeint * (total + 2)) // (sum(total) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from kept),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from cells a join cells b on b.lang = a.lang and b.t = a.t and b.source <> a.source group by 1, 2, 3),
parts as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on b.lang = a.lang and b.source <> a.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', t, ((p - q) * (p - q) // (p + q))::bigint from cells join whole using (lang, t) where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts) r where part = 'pair' or rank <= {TOP_TERMS}"""
