"""Repeated passages against a table of all windows, and the two-stage sort against plain sorting."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from dispatchtext.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of what is left) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def dedup(spark, rows, schema="doc_id long, text string", **how):
    got = sd.without_repeats(spark.createDataFrame(rows, schema), **how).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)


def expected(rows, length):
    return sorted((r[0] is None, r[0] or 0, *b) for r, b in zip(rows, brute([r[1] for r in rows], length)))


def corpus(seed=3):
    r = random.Random(seed)
    words = ["delta", "Ångström", "xin chào", "quick", "brown", "fox", "中文字", "of", "the"] + [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(60), text(8)
    rows = [(i, text(r.randint(1, 120))) for i in range(30)]
    rows += [(100 + i, f"{text(40)} {passage} {text(40)}") for i in range(6)]  # one passage, many surroundings
    rows += [(200 + i, f"{text(30)}\n{line}\n{text(30)}") for i in range(12)]  # a common line, too short alone
    near = text(150).split()
    for i in range(8):
        copy = list(near)
        copy[r.randrange(150)] = "edit"
        rows.append((300 + i, " ".join(copy)))
    exact = text(80)
    rows += [(400 + i, exact) for i in range(5)] + [(500, exact), (500, exact), (500, text(90))]
    rows += [(600, "a" * 3000), (601, "ab" * 1500), (602, passage + passage), (603, None), (604, ""), (None, exact), (None, None), (None, text(70))]
    return rows


@pytest.mark.parametrize("length, anchor, hot", [(200, 64, 4096), (200, 64, 1), (60, 20, 3)])
def test_against_all_windows(spark, length, anchor, hot):
    rows = corpus()
    assert dedup(spark, rows, length=length, anchor=anchor, hot=hot) == expected(rows, length)


def test_small_alphabet(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(60)]
    assert dedup(spark, rows, length=12, anchor=4) == expected(rows, 12)


def test_giant_text_goes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "HASH_BYTES", 500)
    monkeypatch.setattr(sd, "SORT_BYTES", 2000)
    monkeypatch.setattr(sd, "CUTS", 7)
    rows = corpus(9)
    find, texts = sd.Anchors(200, 64), [t.encode() for _, t in rows if t and len(t) > 300]
    whole = {}
    for size in (1 << 20, 500):
        monkeypatch.setattr(sd, "HASH_BYTES", size)
        whole[size] = {}
        for group in sd._pieces(texts, 200):
            for i, offset, piece in group:
                h, first, width = find(np.frombuffer(piece, np.uint8), np.full(len(piece), len(piece) - 200))
                whole[size].update({(i, offset + a + k): x for x, a, n in zip(h.tolist(), first.tolist(), width.tolist()) for k in range(n)})
    assert whole[500] == whole[1 << 20]  # every window has one anchor, wherever the text is cut
    assert dedup(spark, rows) == expected(rows, 200)


def test_extra_columns_and_empty_table(spark):
    rows = [(1, "x" * 250, 1, "s"), (2, "x" * 250, 2, "t"), (3, "short", 3, None)]
    got = dedup(spark, rows, "doc_id long, text string, mark int, spans string")
    assert got == expected([r[:2] for r in rows], 200)
    assert dedup(spark, []) == []


def test_two_stage_sort():
    r = random.Random(1)
    for _ in range(200):
        text = bytes(r.choice(b"\1\2\3") for _ in range(r.randint(0, 60))) + r.choice([b"\0", b""])
        assert sd.two_stage_sort(text, 200).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_common_prefixes():
    r = random.Random(2)
    for _ in range(50):
        text = bytes(r.choice(b"\1\2") for _ in range(80)) + b"\0"
        places = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
        want = []
        for a, b in zip(places, places[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            want.append(n)
        assert sd.common_prefixes(text, places, 20).tolist() == want


def test_query_against_sql(spark):
    got = sd.op11_suffix_dedup(spark, SF)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = db.execute(sd.OP11_SQL)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
