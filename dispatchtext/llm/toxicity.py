"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, window lengths compared.

Training documents fall into clusters of similar text (languages, mostly); labels only say which clusters hold too few
documents of a class and join the most similar one. In each cluster both classes are dealt into FOLDS parts, and on each part zstandard trains a dictionary of its own from the whole texts.
A window is one word between its spaces, every byte stretched to two, so that a match of a short word outweighs the
cost of coding it. A word's distance is the number of bytes that the toxic dictionary saves on the window over the
ordinary one, the least over the FOLDS pairs: what toxic text has in common shows in every pair, what a dictionary
holds by chance in one. A document's distances (the largest, how many reach each of STEPS, how many words there are)
give a score by a logistic calibration on labelled documents that no dictionary has seen.

Training takes at most max_train documents per class, the first by a hash of the key; texts over MAX_TRAIN_CHARS are
not trained on. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, table, tidy
from .words import batch_words

MAX_TRAIN, MAX_TRAIN_CHARS = 3500, 20_000
#: Clusters of the training documents at first, and parts of each class in a cluster; a cluster with fewer than MIN_DOCS a
#: class and part joins the most similar one.
CLUSTERS, FOLDS, MIN_DOCS = 16, 3, 3
#: Every CALIBRATE-th document is kept for the calibration.
CALIBRATE = 4
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 32 << 10
#: Distances that words are counted by; below the first a word counts for nothing.
STEPS = (2, 3, 4, 5, 6, 8)
#: Words whose distances are kept while a task runs; the cache starts anew beyond that (results do not change).
MAX_KNOWN = 200_000
THRESHOLD = 0.3
HELD_OUT_MOD, HELD_OUT = 4, 2

PAIR_BINS = 1024
_OTHER = bytes(b ^ 0x55 for b in range(256))


def stretch(data: bytes) -> bytes:
    """Each byte followed by another that depends on it."""
    out = bytearray(2 * len(data))
    out[::2], out[1::2] = data, data.translate(_OTHER)
    return bytes(out)


def distinct_words(text: str) -> list[str]:
    return list(dict.fromkeys(text.lower().split()))


def profiles(texts: pa.Array) -> np.ndarray:
    """Roots of the counts of hashed pairs of bytes of each lower-cased text, of length one (all 0 for texts under two bytes)."""
    lower = pc.utf8_lower(texts.fill_null(""))
    lengths = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), PAIR_BINS), np.float32)
    if not lengths.sum():
        return out
    data = np.frombuffer(b"".join(lower.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint32)
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
        if b - a > 1:
            pairs = ((data[a : b - 1] * np.uint32(257) + data[a + 1 : b]) * np.uint32(2654435761)) >> np.uint32(22)
            out[i] = np.sqrt(np.bincount(pairs, minlength=PAIR_BINS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def centres(x: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means, farthest first."""
    found = [x[(x @ x.mean(0)).argmax()]]
    near = x @ found[0]
    while len(found) < min(k, len(x)):
        found.append(x[near.argmin()])
        near = np.maximum(near, x @ found[-1])
    c = np.stack(found)
    for _ in range(20):
        of = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (of == j).any():
                mean = x[of == j].mean(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-9)
    return c


def merged(sides: list[np.ndarray], c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centres, cluster of each document of both classes): clusters short of either class join the most similar one."""
    of = [(x @ c.T).argmax(1) for x in sides]
    names = list(range(len(c)))
    while len(names) > 1:
        counts = [min(int((own == j).sum()) for own in of) for j in names]
        if min(counts) >= MIN_DOCS * FOLDS:
            break
        j = names[int(np.argmin(counts))]
        to = max((i for i in names if i != j), key=lambda i: c[i] @ c[j])
        for own in of:
            own[own == j] = to
        mean = np.concatenate([x[own == to] for x, own in zip(sides, of)]).sum(0)
        c[to] = mean / max(np.linalg.norm(mean), 1e-9)
        names.remove(j)
    return c[names], [np.searchsorted(names, own) for own in of]


def dictionary(docs: list[list[str]], size: int) -> bytes:
    """A zstandard dictionary trained on documents; of samples too few or too small to train on, their text itself."""
    samples = [stretch(f" {' '.join(words)} ".encode()) for words in docs if words]
    if sum(map(len, samples)) > 2 * size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # the trainer wants more samples
    return b"".join(samples)[-size:]


@dataclass
class Model:
    """centres of the clusters; per cluster FOLDS pairs (ordinary, toxic); weights of the calibration."""

    centres: np.ndarray
    pairs: list[list[tuple[bytes, bytes]]]
    weights: tuple[float, ...] = ()
    press: list = field(default_factory=list)
    known: list[dict[str, int]] = field(default_factory=list)

    def clear(self) -> None:
        self.press, self.known = [], []

    def prepare(self) -> None:
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )

        def compressor(content: bytes):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress

        self.press = [[(compressor(o), compressor(t)) for o, t in pairs] for pairs in self.pairs]
        self.known = [{} for _ in self.pairs]

    def distance(self, cluster: int, word: str) -> int:
        """Bytes that toxic dictionaries save on the word's window over ordinary ones, the least of all pairs, as far as it matters."""
        known = self.known[cluster]
        got = known.get(word)
        if got is None:
            window, got = stretch(f" {word} ".encode()), 1 << 30
            for ordinary, toxic in self.press[cluster]:
                got = min(got, len(ordinary(window)) - len(toxic(window)))
                if got < STEPS[0]:  # the least can only fall
                    got = 0
                    break
            if len(known) > MAX_KNOWN:
                known.clear()
            known[word] = got
        return got

    def features(self, texts: pa.Array) -> np.ndarray:
        """Largest distance, logarithms of the numbers of distinct words that reach each of STEPS, and of all distinct words, by text."""
        out = np.zeros((len(texts), 2 + len(STEPS)))
        if not self.pairs or not len(texts):
            return out
        words, index, bounds = batch_words(texts)
        if not words or not len(index):
            return out
        cluster = (profiles(texts) @ self.centres.T).argmax(1)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        doc, word = np.divmod(np.unique(doc * np.int64(len(words)) + index), len(words))
        pair, place = np.unique(cluster[doc] * np.int64(len(words)) + word, return_inverse=True)
        at, of = np.divmod(pair, len(words))
        gain = np.fromiter((self.distance(c, words[w]) for c, w in zip(at.tolist(), of.tolist())), np.int64, len(pair))[place]
        np.maximum.at(out[:, 0], doc, gain)
        for i, step in enumerate(STEPS):
            out[:, 1 + i] = np.log1p(np.bincount(doc[gain >= step], minlength=len(texts)))
        out[:, -1] = np.log1p(np.bincount(doc, minlength=len(texts)))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        z = np.column_stack([np.ones(len(features)), features]) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights (intercept first) by Newton steps with a small ridge; classes count as they occur."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def distinct_texts(texts: list[str], bands: int = 10, rows: int = 6) -> list[str]:
    """Drop near copies (min-hash bands over the word sets): words that only copies share say nothing of a class."""
    rng = np.random.default_rng(7)
    mult, add = (rng.integers(1, 1 << 62, (bands * rows, 1), np.uint64) | np.uint64(1) for _ in range(2))
    seen: set[tuple] = set()
    out = []
    for text in texts:
        words = distinct_words(text)
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        least = (h[None, :] * mult + add).min(1).reshape(bands, rows) if len(h) else np.zeros((bands, rows))
        keys = [(i, *b) for i, b in enumerate(least.tolist())]
        if seen.isdisjoint(keys):
            out.append(text)
        seen.update(keys)
    return out


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """A model from labelled texts. Both classes count by their share in what is given, after near copies are dropped."""
    sides = [distinct_texts(toxic), distinct_texts(ordinary)]
    model = Model(np.zeros((0, PAIR_BINS), np.float32), [])
    kept = [[t for i, t in enumerate(side) if i % CALIBRATE] for side in sides]
    held = [side[::CALIBRATE] for side in sides]
    if not all(kept):
        return model
    x = [profiles(pa.array(side, pa.string())) for side in kept]
    model.centres, of = merged(x, centres(np.concatenate(x)))
    for j in range(len(model.centres)):
        parts = [[distinct_words(t) for t, a in zip(side, own) if a == j] for side, own in zip(kept, of)]
        model.pairs.append([(dictionary(parts[1][i::FOLDS], ORDINARY_BYTES), dictionary(parts[0][i::FOLDS], TOXIC_BYTES)) for i in range(FOLDS)])
    model.prepare()
    features = np.concatenate([model.features(pa.array(side, pa.string())) for side in held])
    model.weights = _calibrate(features, np.repeat([1.0, 0.0], [len(held[0]), len(held[1])]))
    model.clear()
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod 4 is not 2, at most max_train per class."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter((crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT) & F.col("toxic").isin(0, 1)).distinct()
    held = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= MAX_TRAIN_CHARS)
    parts = []
    for label in (1, 0):
        # The least hashes are below a threshold that lets twice as many through: tasks send few keys, however many they are.
        most = min(1.0, 2.0 * max_train / max(held.get(label, 0), 1))
        own = marked.filter((F.col("toxic") == label) & (F.xxhash64("doc_id") <= int((2 * most - 1) * (1 << 63)) - (most == 1.0)))
        kept = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id")
        rows = texts.join(F.broadcast(kept), "doc_id").limit(max_train)  # at most max_train keys
        parts.append([r["text"] for r in sorted(rows.select("doc_id", "text").collect())])
    return fit(*parts)


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    model.prepare()
    for part in slices(batches, "text"):
        yield part, model.scores(model.features(part.column("text")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null, empty and wordless texts are scored as texts without words. Null and repeated doc_ids stay as rows
    (a null counts as remainder 0). An empty table gives no rows. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(model, batches):
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, model.clear), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all columns) that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(model, batches):
            yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidy(run, model.clear), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
