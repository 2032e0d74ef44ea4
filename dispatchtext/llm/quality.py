"""Weakly supervised quality: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Every document gets votes (+ good, - bad, 0 abstain). Documents with equal votes are one pattern, so EM runs on
pattern counts of the whole corpus: at most 3**len(RULES) of them, in practice a few hundred, whatever the corpus size.
A rule has two accuracies, the chance that it votes good on a good document and bad on a bad one, given that it
votes; an abstention says nothing. Most faults break several rules, so EM learns which rules agree: a bad vote that
no other rule bears out is mostly overruled, where an all-must-pass filter would drop the document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

WINDOW = 8
KEEP_AT = 0.5
#: EM's start: the posterior of a document with no bad vote (one minus it with any).
START = 0.9
#: Each rule's prior: PRIOR_WEIGHT documents of either kind on which it was right at PRIOR_GOOD and PRIOR_BAD.
PRIOR_GOOD, PRIOR_BAD, PRIOR_WEIGHT = 0.98, 0.3, 10.0
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
#: name, statistic, (good from, good to), (bad below, bad from); from one to the other the rule abstains. Rules are eager:
#: nearly all vote bad where good ends, and the posterior tells a lone vote from a fault. Repeated lines are repeated
#: words too, so that rule abstains until it is sure.
RULES = (
    ("word_length", "mean_word", (3.0, 9.0), (3.0, 9.0)),
    ("symbols", "symbol_share", (0.0, 0.05), (0.0, 0.05)),
    ("bare_symbols", "bare_share", (0.0, 0.1), (0.0, 0.1)),
    ("marked_words", "marked_share", (0.0, 0.05), (0.0, 0.05)),
    ("letters", "letter_share", (0.8, 1.01), (0.8, 2.0)),
    ("commonest", "top_share", (0.0, 0.15), (0.0, 0.15)),
    ("variety", "distinct_share", (0.3, 1.01), (0.3, 2.0)),
    ("stutter", "stutter_share", (0.0, 0.05), (0.0, 0.05)),
    ("duplicate_lines", "dup_line_share", (0.0, 0.2), (0.0, 0.4)),
    ("repeats", "repeat_share", (0.0, 0.1), (0.0, 0.1)),
    ("capitals", "upper_share", (0.0, 0.2), (0.0, 0.2)),
    ("shouting", "bang_share", (0.0, 0.1), (0.0, 0.1)),
    ("length", "n_words", (50.0, float("inf")), (50.0, float("inf"))),
)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more; exact, by ranking windows of doubled width."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width = 1
    while width < window:
        pair = code[:-width] * (int(code.max()) + 1) + code[width:]
        code, width = np.unique(pair, return_inverse=True)[1], 2 * width
    hit = np.bincount(code)[code] > 1
    if not hit.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:n]))


def statistics(text: str | None) -> dict[str, float]:
    """Base counts and the rules' statistics of one whole text; null counts as no words."""
    text = text or ""
    words = _WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    symbols = len(_SYMBOL.findall(text))
    out = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words)}
    letters = upper = bare = marked = 0
    times = Counter(words)
    for w, k in times.items():
        own = len(w) if w.isalpha() else sum(map(str.isalpha, w))
        letters += own * k
        if not w.islower():
            upper += sum(map(str.isupper, w)) * k
        if own < len(w):
            bare += k * (not own and not any(map(str.isdigit, w)))
            marked += k * (own > 0 and _SYMBOL.search(w) is not None)
    some = max(n, 1)
    return out | {
        "mean_word": chars / some, "symbol_share": symbols / some, "bare_share": bare / some, "marked_share": marked / some,
        "letter_share": letters / max(chars, 1), "top_share": max(times.values(), default=0) / some, "distinct_share": len(times) / some,
        "stutter_share": sum(map(eq, words, words[1:])) / some, "dup_line_share": out["n_dup_lines"] / max(len(lines), 1),
        "repeat_share": out["n_repeat_words"] / some, "upper_share": upper / max(letters, 1), "bang_share": text.count("!") / some,
    }


def vote(stats: dict[str, float]) -> list[int]:
    out = []
    for _, name, (low, high), (bad_below, bad_from) in RULES:
        v = stats[name]
        out.append(1 if low <= v <= high else -1 if v < bad_below or v >= bad_from else 0)
    return out


def document_votes(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and votes (a string of + - 0) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BASE.split(", ")]
        for part in slices(batches, "text"):
            stats = [statistics(t) for t in part.column("text").to_pylist()]
            votes = ["".join("-0+"[v + 1] for v in vote(s)) for s in stats]
            yield pa.record_batch([part.column("doc_id"), *(pa.array([s[c] for s in stats], pa.int64()) for c in names), pa.array(votes, pa.string())], names=["doc_id", *names, "votes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {BASE}, votes string")


def fit(patterns: list[str], counts: list[int], rounds: int = 500, tolerance: float = 1e-9) -> tuple[dict[str, float], list[tuple[str, float, float]]]:
    """(posterior probability of good by pattern, (rule, accuracy on good, accuracy on bad)) by EM on pattern counts.

    A pattern without votes keeps the share of good documents as its posterior.
    """
    names = [r[0] for r in RULES]
    if not patterns:
        return {}, []
    good_vote = np.array([[c == "+" for c in p] for p in patterns], float)
    bad_vote = np.array([[c == "-" for c in p] for p in patterns], float)
    n = np.array(counts, float)
    post = np.where(bad_vote.any(1), 1 - START, START)

    def accuracy(weight: np.ndarray, right: np.ndarray, wrong: np.ndarray, prior: float) -> np.ndarray:
        hits, misses = weight @ right + PRIOR_WEIGHT * prior, weight @ wrong + PRIOR_WEIGHT * (1 - prior)
        return hits / (hits + misses)

    on_good = on_bad = np.empty(0)
    for _ in range(rounds):
        share = ((n * post).sum() + 1) / (n.sum() + 2)
        on_good, on_bad = accuracy(n * post, good_vote, bad_vote, PRIOR_GOOD), accuracy(n * (1 - post), bad_vote, good_vote, PRIOR_BAD)
        gap = np.log(share / (1 - share)) + good_vote @ np.log(on_good / (1 - on_bad)) + bad_vote @ np.log((1 - on_good) / on_bad)
        new = 1 / (1 + np.exp(-np.clip(gap, -60, 60)))
        done, post = np.abs(new - post).max() < tolerance, new
        if done:
            break
    return dict(zip(patterns, post.tolist())), list(zip(names, on_good.tolist(), on_bad.tolist()))


def quality(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, BASE, base_failed, kept, votes and the posterior of every row of docs.

    kept: the base holds and the posterior probability of good is keep_at or more.
    Null and empty texts have no words and fail the base. Repeated rows and null doc_ids are kept as rows.
    An empty table gives no rows. Other columns of docs are not read.
    """
    voted = materialize(document_votes(docs), "quality-votes")
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()  # 3 ** len(RULES) rows at most, a hundred in practice
    fitted, _ = fit([r["votes"] for r in patterns], [r["count"] for r in patterns])
    posterior = docs.sparkSession.createDataFrame(list(fitted.items()), "votes string, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.join(F.broadcast(posterior), "votes")  # a row a pattern
    return out.select("doc_id", *[c.split()[0] for c in BASE.split(", ")], failed.alias("base_failed"), (~failed & (F.col("posterior") >= keep_at)).alias("kept"), "votes", "posterior")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
