"""Language identification: script ranges, per-word letter scores, Viterbi with a switching penalty.

Every word scores each learned language by its letter groups. The script of the word narrows the candidates
to languages that were seen in that script. Viterbi with a cost per change of language labels spans; the
language of most letters is the document's. Training takes about max_train documents per language, by a hash of
the key, and counts letter groups on Spark; texts over MAX_TRAIN_CHARS are not trained on. There is no bound on the
number of languages. Prediction reads whole texts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, table, tidy
from .words import batch_words

MAX_TRAIN, MAX_TRAIN_CHARS = 1000, 200_000
#: Bytes of word scores kept while a task runs; the cache starts anew beyond that (results do not change).
CACHE_BYTES = 64 << 20
GRAM, MIN_COUNT = 3, 2
SWITCH = 12.0
CLIP = 8.0
OUT_OF_SCRIPT = -20.0
HELD_OUT_MOD = 5

#: First code points of script ranges, in order; "" ends a range.
SCRIPTS = (
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, ""), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""),
)
_FROM = [x for x, _ in SCRIPTS]
_LETTER = regex.compile(r"\p{L}")


def script(word: str) -> str | None:
    """Script of the first letter, None without letters."""
    if word[:1].isascii() and word[:1].isalpha():
        return "latin"
    found = _LETTER.search(word)
    if not found:
        return None
    at = bisect_right(_FROM, ord(found[0])) - 1
    return SCRIPTS[at][1] if at >= 0 else ""


def _grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1)]


@dataclass
class Model:
    langs: list[str]
    grams: dict[str, int]
    logs: np.ndarray  # gram, language; the last row is for unknown groups
    scripts: dict[str, list[bool]] = field(default_factory=dict)

    def prepare(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(self.langs)), np.float32)
        self.letters = np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w and w not in self.rows]
        if not new:
            return
        if len(self.rows) * (120 + 4 * len(self.langs)) > CACHE_BYTES:
            self.prepare()
            new = [w for w in words if w]
        unknown, known = len(self.logs) - 1, self.grams
        scripts = [script(w) for w in new]
        groups = [_grams(w) for w in new]
        flat = np.fromiter((known.get(g, unknown) for gs in groups for g in gs), np.int64)
        at = np.cumsum([0, *map(len, groups)])[:-1]
        score = np.add.reduceat(self.logs[flat], at, axis=0)
        score -= score.max(1, keepdims=True)
        score = np.maximum(score, -CLIP)
        allowed = np.array([self.scripts.get(s, [True] * len(self.langs)) for s in scripts])
        score[~allowed] = OUT_OF_SCRIPT
        score[[s is None for s in scripts]] = 0
        base = len(self.table)
        self.rows.update(zip(new, range(base, base + len(new))))
        self.table = np.concatenate((self.table, score.astype(np.float32)))
        self.letters = np.concatenate((self.letters, np.array([len(w) if w.isalpha() else len(_LETTER.findall(w)) for w in new], np.int32)))

    def word_scores(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores by word and language, letters by word) of each text."""
        if not self.langs:  # nothing was learned
            yield from [(np.zeros((0, 0)), np.zeros(0))] * len(texts)
            return
        words, index, bounds = batch_words(texts)
        self._learn(words)
        rows = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))[index] if words else np.empty(0, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield self.table[rows[a:b]], self.letters[rows[a:b]]


    def label(self, score: np.ndarray, letters: np.ndarray, switch: float = SWITCH) -> tuple[str, float, np.ndarray]:
        """(language, score from 0 to 1, language index of each word); no path for `und`."""
        if not self.langs or not letters.sum():
            return "und", 0.0, np.empty(0, np.int64)
        path = viterbi(score, switch)
        mass = np.bincount(path, weights=letters, minlength=len(self.langs))
        best = int(np.argmax(mass))
        total = score[path == best].sum(0, dtype=np.float64)  # how clear the winner is on its own words
        gap = total[best] - np.delete(total, best).max() if len(total) > 1 else 40.0
        return self.langs[best], float(mass[best] / mass.sum() / (1 + np.exp(-np.clip(gap, -40, 40)))), path


def viterbi(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; a change of language costs `switch`. Ties go to the first language.

    Shortcut without loss: if no stretch of words prefers another language to the text's best by more than
    half a change, no path with changes can win.
    """
    n, k = score.shape
    total = score.sum(0, dtype=np.float64)
    best = int(np.argmax(total))
    if n < 2 or k < 2:
        return np.full(n, best)
    lead = np.cumsum(np.vstack([np.zeros(k), score - score[:, best : best + 1]]), axis=0, dtype=np.float64)
    if (lead - np.minimum.accumulate(lead, axis=0)).max() <= switch / 2:
        return np.full(n, best)
    cur, back = score[0].astype(float).tolist(), []
    for row in score[1:].tolist():
        top = max(cur)
        at = cur.index(top)
        came = [i if cur[i] >= top - switch else at for i in range(k)]
        cur = [(cur[i] if cur[i] >= top - switch else top - switch) + row[i] for i in range(k)]
        back.append(came)
    path = [cur.index(max(cur))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


GRAMS, SCRIPT = 0, 1
COUNTS = "lang string, kind int, item string, n long"


def count_items(lang: str, word: str, n: int) -> list[tuple[str, int, str, int]]:
    """COUNTS of one word that occurs n times: its letter groups and its script; none without letters."""
    s = script(word)
    return [] if s is None else [(lang, SCRIPT, s, n), *((lang, GRAMS, g, n) for g in _grams(word))]


def fit_counts(counts: list[tuple[str, int, str, int]], langs: list[str]) -> Model:
    """A model from COUNTS, each language and item once."""
    langs = sorted(langs)
    at = {lang: i for i, lang in enumerate(langs)}
    held: tuple[dict[str, np.ndarray], dict[str, np.ndarray]] = ({}, {})
    for lang, kind, item, n in counts:
        held[kind].setdefault(item, np.zeros(len(langs), np.float32))[at[lang]] += n
    grams, scripts = held
    kept = sorted(g for g, c in grams.items() if c.sum() >= MIN_COUNT)
    table_ = np.array([grams[g] for g in kept] + [np.zeros(len(langs))]).reshape(-1, max(len(langs), 1)) + 0.5
    logs = np.log(table_ / table_.sum(0))
    total = sum(scripts.values()) if scripts else np.zeros(len(langs))
    allowed = {s: [bool(x) for x in c > 0.01 * total] for s, c in scripts.items()}
    return Model(langs, {g: i for i, g in enumerate(kept)}, logs, {s: a for s, a in allowed.items() if any(a)})


def fit(samples: list[tuple[str, str]]) -> Model:
    """A model from (language, text) pairs, in one place."""
    words = Counter((lang, w) for lang, text in samples for w in text.lower().split())
    total: Counter = Counter()
    for (lang, w), n in words.items():
        for *item, k in count_items(lang, w, n):
            total[tuple(item)] += k
    return fit_counts([(*item, n) for item, n in total.items()], list({lang for lang, _ in samples}))


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0.

    One scan counts documents per language, a second takes those below a hash threshold that lets about max_train
    of a language through. What reaches the driver is one count per language and letter group.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        (crc_mod("doc_id", HELD_OUT_MOD) != 0) & F.col("lang").isNotNull() & (F.length("text") <= MAX_TRAIN_CHARS)
    )
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not found:
        return fit([])
    most = docs.sparkSession.createDataFrame([(lang, min(1.0, max_train / n)) for lang, n in found.items()], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(most), "lang").filter(place < F.col("rate"))  # one row a language
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''").groupBy("lang", "word").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "count"))):
                for *item, k in count_items(lang, word, n):
                    total[tuple(item)] += k
            cols = list(zip(*((*item, n) for item, n in total.items()))) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "kind", "item", "n"])

    counts = words.mapInArrow(run, COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    return fit_counts([tuple(r) for r in counts.collect()], list(found))


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (lang:words, in order) for every row of docs.

    Text that is null or has no letter is `und` with score 0, and so is all text if nothing was learned.
    Null and repeated doc_ids stay as rows (a null counts as remainder 0). An empty table gives no rows.
    Other columns of docs are not read. Ties go to the first language in alphabetical order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for part in slices(batches, "text"):
            langs, scores, spans = [], [], []
            for score, letters in model.word_scores(part.column("text")):
                lang, value, path = model.label(score, letters, switch)
                langs.append(lang), scores.append(value)
                cut = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)])) if len(path) else [0]
                spans.append(" ".join(f"{model.langs[path[a]]}:{b - a}" for a, b in zip(cut[:-1], cut[1:])))
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", HELD_OUT_MOD) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, model.prepare), "doc_id long, held_out boolean, lang_pred string, score double, spans string")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs (all columns) whose text is in a learned language with at least this score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepare()
        for part in slices(batches, "text"):
            yield part.filter(pa.array([model.label(s, n)[1] >= least for s, n in model.word_scores(part.column("text"))], pa.bool_()))

    return docs.mapInArrow(tidy(run, model.prepare), docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
