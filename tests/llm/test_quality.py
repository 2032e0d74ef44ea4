"""Quality rules: base counts and votes against brute force, EM against a plain version, verdicts against labels."""

import math
import random
import re

import pytest

from dispatchtext.llm import quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def brute_em(patterns, counts):
    """The same model document by document, in plain loops."""
    good = [1 - quality.START if "-" in p else quality.START for p in patterns]
    for _ in range(500):
        share = (sum(n * g for n, g in zip(counts, good)) + 1) / (sum(counts) + 2)
        acc = []
        for r in range(len(patterns[0])):
            hit = [quality.PRIOR_WEIGHT * quality.PRIOR_GOOD, quality.PRIOR_WEIGHT * quality.PRIOR_BAD]
            miss = [quality.PRIOR_WEIGHT * (1 - quality.PRIOR_GOOD), quality.PRIOR_WEIGHT * (1 - quality.PRIOR_BAD)]
            for p, n, g in zip(patterns, counts, good):
                if p[r] == "+":
                    hit[0] += n * g
                    miss[1] += n * (1 - g)
                elif p[r] == "-":
                    miss[0] += n * g
                    hit[1] += n * (1 - g)
            acc.append([h / (h + m) for h, m in zip(hit, miss)])
        new = []
        for p in patterns:
            a, b = math.log(share), math.log(1 - share)
            for c, (g, w) in zip(p, acc):
                a += {"+": math.log(g), "-": math.log(1 - g), "0": 0}[c]
                b += {"+": math.log(1 - w), "-": math.log(w), "0": 0}[c]
            new.append(1 / (1 + math.exp(min(60, max(-60, b - a)))))
        done = max(abs(x - y) for x, y in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    return good


TEXTS = [
    None, "", "  \n\t", "one", "a b\na b\na b\n\n", " ".join("abcdefghij") * 3, "x " * 40, "# $ % & | < > *" * 4, "Über straße ÉTÉ " * 9, "l1 w\nl2 w\nl1 w\n l1 w", "\x1c a\xa0b \x85",
    "HELLO WORLD! " * 12, "q" * 30000,
]


def test_base_counts(spark):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice("ab #\n") for _ in range(rnd.randrange(200))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality(rows).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"]) and len(r["votes"]) == len(quality.RULES)


def test_em_is_the_plain_em():
    rnd = random.Random(9)
    patterns = sorted({"".join(rnd.choice("+++0-") for _ in quality.RULES) for _ in range(40)} | {"0" * len(quality.RULES)})
    counts = [rnd.randrange(1, 200) for _ in patterns]
    got, accuracies = quality.fit(patterns, counts)
    assert [got[p] for p in patterns] == pytest.approx(brute_em(patterns, counts), abs=1e-6)
    assert [a for a, *_ in accuracies] == [r[0] for r in quality.RULES] and all(0 < g < 1 and 0 < b < 1 for _, g, b in accuracies)
    assert quality.fit([], []) == ({}, [])


def test_agreeing_rules_reject_and_a_lone_vote_is_overruled():
    n = len(quality.RULES)
    pair, lone, fine = "--" + "+" * (n - 2), "+" * (n - 1) + "-", "+" * n
    got, _ = quality.fit([pair, lone, fine], [300, 30, 5000])
    assert got[pair] < 0.01 and got[lone] > 0.5 and got[fine] > 0.99


def test_verdicts_on_labels(spark):
    """Bad documents that pass the base go, good ones stay, and better than by dropping all with a bad vote: the labels are never an input."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    voted = quality.quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("not base_failed")
    rows = voted.join(labels, "doc_id", "left").select("kept", "votes", "quality").collect()
    bad, good = ([r for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(bad) > 100 and sum(r["kept"] for r in bad) <= 0.02 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.995 * len(good) > sum("-" not in r["votes"] for r in good)
    kept = [r["votes"].count("-") for r in rows if r["kept"]]
    gone = [r["votes"].count("-") for r in rows if not r["kept"]]
    assert sum(n > 0 for n in kept) > 50 and min(gone) <= 2  # overruled votes, and documents that two votes were enough for
