"""The near-duplicate stage against brute force over all pairs of sf0.1, and its odd cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from dispatchtext.llm import near_text as nt

SF = "/root/testdata/sf0.1"
BANDS = ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0))


def shingles_of(text):
    words = (text or "").encode().translate(nt._LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def similar_pairs(sets, least):
    """(similarity, i, j) of all pairs of `least` or more, over the shingles that not very many texts share."""
    holders, common = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for held in holders.values():
        if len(held) <= 60:
            for a in range(len(held)):
                for b in held[a + 1 :]:
                    common[held[a], b] += 1
    out = []
    for (a, b), n in common.items():
        if n > 0.3 * min(len(sets[a]), len(sets[b])):
            both = len(sets[a] & sets[b])
            out.append((both / (len(sets[a]) + len(sets[b]) - both), a, b))
    return [x for x in out if x[0] >= least]


def test_recall_by_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = list(dict.fromkeys(r["text"] for r in docs.select("text").collect() if r["text"]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = nt.materialize(nt.signatures(rows), "sigs")
    group = {r["doc_id"]: r["comp"] for r in sigs.join(nt.groups(sigs), ["sketch", "sig"]).select("doc_id", "comp").collect()}
    pairs = similar_pairs([shingles_of(t) for t in texts], 0.5)
    for low, high in BANDS:
        held = [(a, b) for s, a, b in pairs if low <= s < high]
        assert held and sum(group[a] == group[b] for a, b in held) >= 0.9 * len(held), (low, high)
    # Direct links of pairs far below 0.8 are rare; a chain over a third copy may still put such a pair in one group.
    sketch = {r["doc_id"]: np.frombuffer(r["sketch"], np.uint64) for r in sigs.select("doc_id", "sketch").collect()}
    far = [(a, b) for s, a, b in pairs if s < 0.7]
    linked = sum(bool(nt.differing(sketch[a], sketch[b]) <= nt.most_differing(nt.SIMILARITY)) for a, b in far)
    assert len(far) > 300 and linked <= 0.01 * len(far)


@pytest.mark.parametrize("max_bucket", [nt.MAX_BUCKET, 6])
def test_groups_of_edited_copies(spark, max_bucket):
    """Groups of near copies, one large: one document of each stays, whichever way buckets are dealt; other texts all stay."""
    r = random.Random(3)
    rows, heads = [], []
    for g, size in enumerate((40, 5, 2)):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        heads.append(len(rows))
        for _ in range(size):
            copy = list(words)
            for _ in range(2):
                copy[r.randrange(300)] = f"edit{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    others = range(len(rows), len(rows) + 30)
    rows += [(i, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(1, 200)))) for i in others]
    r.shuffle(rows)
    got = nt.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), max_bucket=max_bucket).collect()
    assert sorted(x["doc_id"] for x in got) == sorted([*heads, *others])


def test_odd_rows(spark):
    rows = [(None, None, 1), (5, "", 1), (4, " \t", 2), (3, "short text", 3), (2, "Short TEXT", 4), (None, "short text", 5), (9, "a b c d e f", 6), (9, "a b c d e f", 6), (9, "other words here", 7), (None, "only without id", 8)]
    got = nt.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, sketch int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(4, " \t", 2), (2, "Short TEXT", 4), (9, "a b c d e f", 6), (9, "other words here", 7), (None, "only without id", 8)], key=repr)
    assert nt.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_giant_text():
    words = np.arange(2_000_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sketch, bands, _ = nt.signature(words)
    assert len(sketch) == 64 and len(bands) == nt.BANDS
    changed = words.copy()
    changed[1000:1010] = 7
    other, more, _ = nt.signature(changed)
    assert nt.differing(np.frombuffer(sketch, np.uint64), np.frombuffer(other, np.uint64)) <= 2 and set(bands) & set(more)
