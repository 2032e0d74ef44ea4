"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The scan is over the semiring (max, +) with weights 0 (allowed) and minus infinity: a sequence of pieces is
the encoding of a text exactly if every two neighbours are the encoding of their joint text. A document
longer than CHUNK_CHARS is cut into chunks at fixed places. The state at a cut is the piece that holds the
last character before it. Each chunk gives a transfer matrix from the states at its left end to those at
its right end; matrices combine associatively, the best path picks one state per cut, and every chunk is
then encoded alone between its two states.

Pieces never hold a space after another character, so inside a chunk only the ends before the first and after the last
start of a word depend on the states. A chunk without words is encoded by the library as a whole, and by itself around either end for
each state there: where two encodings have two neighbouring pieces in common, the one goes on as the other. What
is allowed this way is allowed; should no path be found (encodings that never meet, as of one letter repeated), the
text's pairs of states are tried one by one. Between its two states, a chunk is encoded by the library at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import materialize, slices, table

CHUNK_CHARS = 32_768
#: Bytes of text that one Python step encodes at a time; a list of ids takes about ten times as much.
TEXT_SLICE = 1 << 20
#: Characters around a cut within which encodings of different states run into each other.
END = 256
#: Chunks that one step of cutting yields at a time.
CHUNKS_AT_ONCE = 32
NEVER = float("-inf")
DIGEST = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"

Span = tuple[int, int]


class Pieces:
    """The library on texts whose leading mark is already there."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.longest = max(len(p.piece) for p in proto.pieces)
        self.ids = lru_cache(1 << 18)(lambda s: tuple(self.bare.encode(s)))
        self.vocabulary = frozenset(x.piece for x in proto.pieces)

    def piece(self, s: str) -> bool:
        """One piece, or one character that falls back to bytes."""
        return len(s) == 1 or s.replace(" ", "▁") in self.vocabulary and len(self.ids(s)) == 1


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _blank(c: str) -> bool:
    return c == " " or c == "▁"


def word_start(text: str, at: int) -> bool:
    """No piece spans this place, and pieces on either side of it never merge."""
    return 0 < at < len(text) and _blank(text[at]) and not _blank(text[at - 1])


def states(p: Pieces, text: str, at: int) -> list[Span]:
    """Spans of the pieces that may hold the character before `at`; at the text's start the empty span."""
    if at == 0:
        return [(0, 0)]
    out = []
    for s in range(max(0, at - p.longest), at):
        for e in range(at, min(len(text), s + p.longest) + 1):
            if not any(word_start(text, i) for i in range(s + 1, e)) and p.piece(text[s:e]):
                out.append((s, e))
    return out


def first_word(text: str, a: int, b: int) -> int | None:
    return next((i for i in range(a, b) if word_start(text, i)), None)


def last_word(text: str, a: int, b: int) -> int | None:
    return next((i for i in range(b - 1, a - 1, -1) if word_start(text, i)), None)


def spans(p: Pieces, text: str, a: int, b: int) -> list[Span]:
    """Spans of the pieces that the library makes of text[a:b]; bytes of one character are one span."""
    ends = sorted({a, *(a + end for _, end in p.bare.encode(text[a:b], return_type="offset_mapping")["offsets"])})
    return list(zip(ends, ends[1:]))


def meet(x: list[Span], pairs: set[tuple[Span, Span]], a: int, b: int) -> bool:
    """Whether two neighbours of x that begin in [a, b) are among the pairs."""
    return any(a <= u[0] < b and (u, v) in pairs for u, v in zip(x, x[1:]))


def transfer_unspaced(p: Pieces, text: str, a: int, b: int, ins: list[Span], outs: list[Span]) -> np.ndarray:
    """Weights over a chunk without words that is longer than 6 * END: allowed where both ends run into the chunk's own encoding."""
    whole = spans(p, text, a, b)
    pairs = set(zip(whole, whole[1:]))
    left = [(x := spans(p, text, s, a + 3 * END))[0] == (s, e) and meet(x, pairs, a + END, a + 2 * END) if e > s else a == 0 for s, e in ins]
    right = [(x := spans(p, text, b - 3 * END, e))[-1] == (s, e) and meet(x, pairs, b - 2 * END, b - END) for s, e in outs]
    return np.where(np.outer(left, right), 0.0, NEVER)


def transfer(p: Pieces, text: str, a: int, b: int, full: bool = False) -> np.ndarray:
    """Weights from the states at a to those at b; `text` holds the chunk [a, b) and its surroundings. full: every pair of states is tried."""
    ins, outs = states(p, text, a), states(p, text, b)
    first = first_word(text, a, b)
    if first is None and not full and b - a > 6 * END:
        return transfer_unspaced(p, text, a, b, ins, outs)
    if first is None:
        allowed = [[connected(p, text, i, o) for o in outs] for i in ins]
    else:  # the word at either end: pieces never reach over the start of a word
        last = last_word(text, a, b)
        left = [s == e or e <= first and spans(p, text, s, first)[0] == (s, e) for s, e in ins]
        right = [s >= last and spans(p, text, last, e)[-1] == (s, e) for s, e in outs]
        allowed = np.outer(left, right)
    return np.where(np.array(allowed, bool).reshape(len(ins), len(outs)), 0.0, NEVER)


def connected(p: Pieces, text: str, start: Span, end: Span) -> bool:
    """Whether allowed neighbours lead from one piece to the other: the encoding of all that they enclose begins and ends with them."""
    if start == end:
        return True
    if start[0] == start[1]:
        return spans(p, text, start[1], end[1])[-1] == end
    whole = spans(p, text, start[0], end[1]) if start[1] <= end[0] else [end]
    return whole[0] == start and whole[-1] == end


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (x[:, :, None] + y[None, :, :]).max(1) if x.shape[1] else np.full((x.shape[0], y.shape[1]), NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairs (the parallel form of the associative scan)."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = scan([combine(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else combine(pairs[i // 2 - 1], matrices[i]))
    return out


def choose(matrices: list[np.ndarray]) -> list[int] | None:
    """The state at every cut of the best path; state 0 before the text. None if no path is allowed."""
    prefixes = scan(matrices)
    at = int(np.argmax(prefixes[-1][0]))
    if prefixes[-1][0][at] == NEVER:
        return None
    path = [at]
    for i in range(len(matrices) - 1, 0, -1):
        path.append(int(np.argmax(prefixes[i - 1][0] + matrices[i][:, path[-1]])))
    return [0, *path[::-1]]


def encode_chunk(p: Pieces, text: str, a: int, b: int, state_in: int, state_out: int) -> list[int]:
    """ids of the pieces from the state at a, without it, to the state at b: between two places of a whole text's encoding the library makes the same pieces."""
    start, end = states(p, text, a)[state_in], states(p, text, b)[state_out]
    return p.bare.encode(text[start[1] : end[1]]) if end[1] > start[1] else []


def encode_by_scan(p: Pieces, text: str, chunk: int) -> list[int]:
    """One text in one place, the way the job does it over tasks."""
    if not text:
        return []
    full = " " + text
    cuts = [*range(0, len(full), chunk), len(full)]
    bounds = list(zip(cuts, cuts[1:]))
    path = choose([transfer(p, full, a, b) for a, b in bounds]) or choose([transfer(p, full, a, b, full=True) for a, b in bounds])
    if path is None:
        raise ValueError("no allowed sequence of pieces")
    return [i for (a, b), s, t in zip(bounds, path, path[1:]) for i in encode_chunk(p, full, a, b, s, t)]


CHUNK = "uid long, n int, a int, b int, part string"


def _chunks(giants: DataFrame, chunk: int, margin: int) -> DataFrame:
    """uid, n, a, b (places inside `part`), part: the chunk and `margin` characters on either side. Each text is cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_SLICE):
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                full = " " + text
                starts = range(0, len(full), chunk)
                for i in range(0, len(starts), CHUNKS_AT_ONCE):
                    own = starts[i : i + CHUNKS_AT_ONCE]
                    begins = [max(0, s - margin) for s in own]
                    cols = [
                        pa.array([uid] * len(own), pa.int64()), pa.array(range(i, i + len(own)), pa.int32()), pa.array([s - g for s, g in zip(own, begins)], pa.int32()),
                        pa.array([min(len(full), s + chunk) - g for s, g in zip(own, begins)], pa.int32()), pa.array([full[g : s + chunk + margin] for s, g in zip(own, begins)], pa.string()),
                    ]
                    yield pa.record_batch(cols, names=["uid", "n", "a", "b", "part"])

    return giants.select("uid", "text").mapInArrow(run, CHUNK)


def _rows(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of the documents of one chunk, and of the giant ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.filter(F.length("text") <= chunk), rows.filter(F.length("text") > chunk)


def _encode_small(small: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """doc_id, text, ids of documents of one chunk, or at once their DIGEST (no second Python step holds the batch again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for part in slices(batches, "text", TEXT_SLICE):
            ids = [np.array(x, "<u4").tobytes() for x in p.plain.encode(part.column("text").to_pylist(), num_threads=1)]
            if digest:
                yield _digest(p, part.column("doc_id"), part.column("text"), ids)
            else:
                yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return small.mapInArrow(run, DIGEST if digest else "doc_id long, text string, ids binary")


def _encode_giant(giant: DataFrame, model: str, chunk: int) -> DataFrame:
    """doc_id, text, ids of giant documents by the scan over their chunks."""
    giants = materialize(giant.withColumn("uid", F.monotonically_increasing_id()), "giant-texts")
    margin = 2 * pieces(model).longest
    chunks = materialize(_chunks(giants, chunk, margin).repartition("uid", "n"), "giant-chunks")

    def matrices(batches: Iterator[pa.RecordBatch], full: bool = False) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in slices(batches, "part", TEXT_SLICE):
            made = [transfer(p, t, a, b, full) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b")))]
            yield pa.record_batch(
                [batch.column("uid"), batch.column("n"), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([np.packbits(m == 0).tobytes() for m in made], pa.binary())],
                names=["uid", "n", "ins", "outs", "allowed"],
            )

    def paths(group: pa.Table) -> pa.Table:
        rows_ = sorted(group.to_pylist(), key=lambda r: r["n"])
        made = []
        for r in rows_:
            bits = np.unpackbits(np.frombuffer(r["allowed"], np.uint8))[: r["ins"] * r["outs"]].reshape(r["ins"], r["outs"])
            made.append(np.where(bits, 0.0, NEVER))
        path = choose(made) or [-1] * (len(made) + 1)
        return pa.table({"uid": [r["uid"] for r in rows_], "n": [r["n"] for r in rows_], "s": path[:-1], "t": path[1:]}, schema=pa.schema([("uid", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("t", pa.int32())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in slices(batches, "part", TEXT_SLICE):
            made = [np.array(encode_chunk(p, *x), "<u4").tobytes() for x in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "s", "t")))]
            yield pa.record_batch([batch.column("uid"), batch.column("n"), pa.array(made, pa.binary())], names=["uid", "n", "ids"])

    # One row per chunk of one text meets per document; a text's chunks are bounded by the largest text.
    def best(own: DataFrame, step) -> DataFrame:
        made = own.mapInArrow(step, "uid long, n int, ins int, outs int, allowed binary").groupBy("uid").applyInArrow(paths, "uid long, n int, s int, t int")
        return materialize(made, "giant-paths")

    states_ = best(chunks, matrices)
    lost = states_.filter("s < 0").select("uid").distinct()
    if lost.limit(1).count():
        states_ = states_.filter("s >= 0").unionByName(best(chunks.join(lost, "uid", "left_semi"), lambda batches: matrices(batches, full=True)))
        if states_.filter("s < 0").limit(1).count():
            raise ValueError("no allowed sequence of pieces")
    encoded = chunks.join(states_, ["uid", "n"]).select("uid", "n", "part", "a", "b", "s", "t").mapInArrow(finish, "uid long, n int, ids binary")
    joined = giants.join(encoded.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("parts")), "uid")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_SLICE):
            ids = [b"".join(x["ids"] for x in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return joined.select("doc_id", "text", "parts").mapInArrow(join, "doc_id long, text string, ids binary")


def encode_documents(docs: DataFrame, model: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, text and ids (32-bit little-endian, binary) of every row of docs.

    Null texts count as empty and give no ids. Null and repeated doc_ids stay as rows. An empty table gives
    no rows. Other columns of docs are not read.
    """
    small, giant = _rows(docs, chunk)
    return _encode_small(small, model).unionByName(_encode_giant(giant, model, chunk))


def _digest(p: Pieces, doc_ids: pa.Array, texts: pa.Array, raw: list[bytes]) -> pa.RecordBatch:
    ids = [np.frombuffer(x, "<u4").tolist() for x in raw]
    same = [d == t.replace("▁", " ") for d, t in zip(p.plain.decode(ids) if ids else [], texts.to_pylist())]
    counts, crcs = pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64())
    return pa.record_batch([doc_ids, counts, crcs, pa.array(same, pa.bool_())], names=[c.split()[0] for c in DIGEST.split(", ")])


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding the ids gives the text back (spaces for the space mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for part in slices(batches, "text", TEXT_SLICE):
            yield _digest(p, part.column("doc_id"), part.column("text"), part.column("ids").to_pylist())

    return encoded.mapInArrow(run, DIGEST)


def document_digests(docs: DataFrame, model: str, chunk: int = CHUNK_CHARS) -> DataFrame:
    """digests() of encode_documents(), with one Python step for documents of one chunk."""
    small, giant = _rows(docs, chunk)
    return _encode_small(small, model, digest=True).unionByName(digests(_encode_giant(giant, model, chunk), model))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
