"""Operators for long tables and odd input against plain Python: percentiles, interval joins, payloads, folds, files, scorer, stream."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from dispatchtext.functions import phones, spans
from dispatchtext.functions import text as tx
from dispatchtext.functions.payload import decode_payload
from dispatchtext.jobs import messages as msg
from dispatchtext.jobs.parse import known_entities, parse, prepare, score_tokens, telemetry
from dispatchtext.operators import intervals, metrics, order_statistics
from dispatchtext.sources import annotated
from dispatchtext.streaming.parse_stream import parse_stream, read_parsed

SF = "/root/testdata/sf0.001"


# Exact percentiles.


def nearest(values, p):
    return sorted(values)[max(math.ceil(p * len(values)) - 1, 0)] if values else None


@pytest.mark.parametrize("gather", [10_000, 5])
def test_percentiles(spark, monkeypatch, gather):
    monkeypatch.setattr(order_statistics, "GATHER", gather)
    monkeypatch.setattr(order_statistics, "BUCKETS", 1024 if gather > 5 else 8)
    r = random.Random(6)
    groups = {
        "hot": [r.gauss(0, 1) * 10 ** r.randint(-3, 6) for _ in range(3000)], "ties": [5.0] * 400 + [7.0] * 3, "one": [1.5], None: [float(x) for x in range(100)],
        "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-300, -1e-300, float("inf"), float("-inf")] * 3, "few": [3.0, 1.0, 2.0, 2.0], "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(g, None) for g in groups]
    r.shuffle(rows)
    ps = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0, "f": 0.07}
    inner = {"m": 0.5, "q": 0.95}
    got = {x["g"]: x for x in order_statistics.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ps, inner).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in ps.items():
            assert got[g][name] == nearest(vs, p), (g, name)
        for name, p in inner.items():
            if g == "wide":
                continue
            at = p * (len(vs) - 1)
            want = None if not vs else sorted(vs)[math.floor(at)] + (sorted(vs)[math.ceil(at)] - sorted(vs)[math.floor(at)]) * (at - math.floor(at))
            assert got[g][name] == (want if want is None else pytest.approx(want)), (g, name)


def test_percentiles_without_groups_and_rows(spark):
    frame = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double")
    assert order_statistics.percentiles(frame, [], "v", {"a": 0.5, "b": 0.99}).collect() == [(30.0, 50.0)]
    assert order_statistics.percentiles(frame.filter("v < 0").withColumn("g", F.lit("x")), ["g"], "v", {"a": 0.5}).collect() == []
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert order_statistics.percentiles(nan, [], "v", {"a": 0.5}).collect() == [(2.0,)]


def test_hot_group_is_counted_in_many_tasks(spark):
    """No step gathers the values of a group: the rows that reach one place are counts of parts, or a part of GATHER rows."""
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    got = order_statistics.percentiles(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99}).first()
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert (got["p50"], got["p99"]) == (values[99_999], values[197_999])


# Interval joins.


def interval_rows(seed, n, span, longest):
    r = random.Random(seed)
    return [(e, i, s, s + r.choice([0, 1, 2, 3, r.randint(0, longest)])) for i in range(n) for e, s in [(r.choice([0, 0, 0, 1, 2]), r.randint(0, span))]]


def test_containment_join_is_the_in_row_form(spark):
    units, entities = interval_rows(1, 300, 400, 6), [(*x, random.Random(i).choice(spans.TYPES)) for i, x in enumerate(interval_rows(2, 80, 400, 300))]
    u = spark.createDataFrame(units, "example_id int, unit int, start int, end int")
    e = spark.createDataFrame(entities, "example_id int, ord int, start int, end int, label string")
    got = {(r["example_id"], r["unit"]): r["label"] for r in intervals.label_units(u, e).collect()}
    held = e.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "label"))).alias("entities"))
    rows = u.join(held, "example_id", "left").withColumn("entities", F.coalesce("entities", F.expr("cast(array() as array<struct<ord:int,start:int,end:int,label:string>>)")))
    want = {(r["example_id"], r["unit"]): r["l"] for r in rows.select("example_id", "unit", spans.bio_label(F.struct("start", "end"), F.col("entities")).alias("l")).collect()}
    assert got == want and set(got.values()) > {"O"}
    none = intervals.label_units(u, e.filter("false")).collect()
    assert len(none) == len(units) and {r["label"] for r in none} == {"O"}


@pytest.mark.parametrize("stretch", [4096, 7])
def test_overlap_marks_are_the_in_row_form(spark, stretch):
    rows, others = interval_rows(3, 300, 600, 40), interval_rows(4, 60, 600, 30)
    a = spark.createDataFrame([(*x, "kept") for x in rows], "example_id int, unit int, start int, end int, reach string")
    b = spark.createDataFrame(others, "example_id int, ord int, start int, end int")
    got = {r["unit"]: r["overlapped"] for r in intervals.mark_overlaps(a, b, stretch).collect()}
    want = {i: any(e == oe and max(s, os) < min(t, ot) for oe, _, os, ot in others) for e, i, s, t in rows}
    assert got == want and len(set(got.values())) == 2
    kept = intervals.drop_overlapping(a, b, stretch)
    assert kept.columns == a.columns and {r["unit"] for r in kept.collect()} == {i for i, o in want.items() if not o}
    assert intervals.drop_overlapping(a, b.filter("false")).count() == len(rows)


def test_hot_example_is_shared_by_tasks(spark):
    """One example with 100,000 units: the rows of the join are dealt out by place."""
    units = spark.range(100_000).select(F.lit(1).alias("example_id"), F.col("id").alias("unit"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 3).cast("int").alias("end"))
    entities = spark.range(0, 100_000, 4).select(F.lit(1).alias("example_id"), F.col("id").alias("ord"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 8).cast("int").alias("end"), F.lit("PER").alias("label"))
    out = intervals.label_units(units, entities)
    counts = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {"B-PER": 25_000, "I-PER": 25_000, "O": 50_000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_units_held_by_thousands_of_entities(spark):
    """Every unit lies in 2,000 entities: the join lists no pair, and the least ord wins on every level of lengths."""
    r = random.Random(5)
    spans_ = [(1, i, s, s + n, r.choice(spans.TYPES)) for i in range(4000) for s in [r.randint(0, 500)] for n in [r.choice([800, 5000, 70_000])]]
    units = [(1, i, s, s + r.randint(0, 400)) for i in range(400) for s in [r.randint(-5, 1000)]] + [(1, 7, None, 3), (None, 8, 1, 2)]
    u = spark.createDataFrame(units + units[:50], "example_id int, unit int, start int, end int")
    e = spark.createDataFrame([*r.sample(spans_, 4000), (None, 1, 0, 9, "PER")], "example_id int, ord int, start int, end int, label string")
    out = intervals.label_units(u, e)

    def want(example, start, end):
        first = next((x for x in spans_ if example and start is not None and x[2] <= start and end <= x[3]), None)
        return "O" if first is None else ("B-" if first[2] == start else "I-") + first[4]

    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((*x, want(x[0], *x[2:])) for x in set(units)), key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan


# Chunks within a row.


def test_chunk_sets_are_the_long_form(spark):
    r = random.Random(11)
    labels = ["O", "O", "B-PER", "I-PER", "B-ADDR", "I-ADDR", "I-NOTE"]
    rows = [(e, 3 * i, r.choice(labels), r.choice(labels)) for e in range(60) for i in range(r.randint(0, 25))]
    tokens = spark.createDataFrame(rows, "example_id int, tok_idx int, gold string, pred string")
    sides = tokens.withColumns({"start": F.col("tok_idx"), "end": F.col("tok_idx")})
    held = tokens.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "gold", "pred"))).alias("tokens"))
    chunks = {}
    for side in ("gold", "pred"):
        got = {(x[0], *x[1]) for x in held.select("example_id", F.explode(spans.chunk_set(F.col("tokens"), side))).collect()}
        chunks[side] = got
        assert got == {tuple(x) for x in spans.strict_chunks(sides, side).collect()}
    scores = {x["type"]: x for x in metrics.entity_scores(tokens).collect()}
    for kind in spans.TYPES:
        gold, pred = ({c for c in chunks[s] if c[1] == kind} for s in ("gold", "pred"))
        assert (scores[kind]["tp"], scores[kind]["n_gold"], scores[kind]["n_pred"]) == (len(gold & pred), len(gold), len(pred))
    assert scores["micro"]["tp"] == len(chunks["gold"] & chunks["pred"])
    nothing = {x["type"]: (x["tp"], x["f1"]) for x in metrics.entity_scores(tokens.filter("false")).collect()}
    assert nothing == {t: (0, 0.0) for t in (*spans.TYPES, "micro", "macro")}


# Payloads.

PAYLOADS = [
    ('{"text":"a"}', ("a", False)), (' {"text":"\\u0111","debug":true}\n', ("đ", True)), ('{"text":"a","debug":1}', ("a", True)), ('{"text":"a","debug":0.0}', ("a", False)), ('{"text":"a","debug":"Yes"}', ("a", True)),
    ('{"text":"a","debug":"off"}', ("a", False)), ('{"text":""}', ("", False)), ('{"text":"a","text":"b"}', ("b", False)), ('{"text":"a","debug":"x","debug":false}', ("a", False)), ('{"debug":"T","text":"2024-01-01"}', ("2024-01-01", True)),
    *[(p, None) for p in (
        '{"text":5}', '{"text":["a"]}', '{"text":{"a":"b"}}', '{"text":null}', '{"text":true}', '{"text":1.5}', "{}", "", " ", "null", "[1]", '"a"', "5", '{"text":"a"} junk', '{"text":"a"}{"text":"b"}', '{"text":"a"',
        '{"text":"a","debug":null}', '{"text":"a","debug":2}', '{"text":"a","debug":0.5}', '{"text":"a","debug":" yes"}', '{"text":"a","debug":[]}', '{"text":"a","x":1}', "{'text':'a'}", '{"text":"a",}', '{text:"a"}',
        '{"text":"a"},"body":{"text":"b"}', '{"text":"a"},"seal":1} x', '{"text":"a"}}', '{"Text":"a"}', '{"text":"a\tb"}',
    )], (None, None),
]


def test_payloads(spark):
    text, debug, error = decode_payload(F.col("p"))
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string").select("i", text, debug, error).collect()
    for i, *got in rows:
        payload, want = PAYLOADS[i]
        assert got == ([*want, None] if want else [None, None, "invalid_input"]), payload


# Places.


def label(rows):
    return rows.withColumn("tokens", spans.label_units(F.col("masked"), known_entities(F.col("masked"), {"PER": F.col("name"), "ADDR": F.col("addr"), "NOTE": F.col("note")})))


def test_telemetry_gives_raw_places_after_the_drop_rules(spark):
    text = "<b>x</b><script>q</script>0912345678 giao 12 Lê Lợi, Lan ơi, gọi trước"
    rows = spark.createDataFrame([(1, text, "Lan", "12 Lê Lợi", "gọi trước"), (2, text, "An", "12 Lê Lợi", "Lê Lợi")], "message_id long, text string, name string, addr string, note string")
    got = {r["message_id"]: [tuple(s) for s in r["spans"]] for r in telemetry(label(prepare(rows))).collect()}

    def at(what):
        return text.index(what), text.index(what) + len(what)

    assert got[1] == [("ADDR", *at("12 Lê Lợi")), ("NOTE", *at("gọi trước"))]  # a name that is called is none
    assert got[2] == [("ADDR", *at("12 Lê Lợi"))]  # a note on an address is none


def test_places_map_there_and_back(spark):
    """The span of a mask is [PHONE]; a place of the masked text, mapped through masks and removals, holds the same character in the raw text."""
    rows = prepare(msg.messages(spark, SF).filter("v in (1, 4, 9, 10)").limit(60)).filter("raw is not null")
    rows = rows.select("*", *[s.alias(f"s{i}") for i, s in enumerate(tx.removal_steps(F.col("raw")))], phones.masked_spans(F.col("candidates")).alias("masks"))

    def back(p):
        return tx.to_raw(phones.unmask_position(p, F.col("candidates"), F.length("sanitized"), F.length("masked")), [F.col(f"s{i}") for i in range(3)], F.length("sanitized"))

    places = F.transform(F.sequence(F.lit(0), F.length("masked") - 1), back)
    checked = 0
    for r in rows.select("raw", "masked", "masks", places.alias("places")).collect():
        inside = set()
        for m in r["masks"]:
            assert r["masked"][m["start"] : m["end"]] == "[PHONE]"
            inside.update(range(m["start"], m["end"]))
        for i, c in enumerate(r["masked"]):
            if i not in inside:
                assert r["raw"][r["places"][i]] == c
                checked += 1
    assert checked > 1000


def walk(raw, segmented):
    """The positions rule in words: see segmented_map."""
    at, out = 0, []
    for c in segmented:
        if at >= len(raw):
            out.append(len(raw))
        elif c == "_":
            at = len(raw) - len(raw[at:].lstrip())
            out.append(max(at - 1, 0))
        elif c.isspace():
            out.append(at)
            at += raw[at].isspace()
        else:
            out.append(raw.find(c, at) if raw.find(c, at) >= 0 else at)
            at = out[-1] + 1
    return out


def test_segmented_maps(spark):
    r = random.Random(13)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(r.randint(0, n)))
    rows = [(i, pick("ab đ\u00a0 \t😀", 40), pick("ab_đ _x😀", 40)) for i in range(150)] + [(900, None, "a_b"), (901, "a b", None), (902, "xin  chào " * 60, "xin_chào " * 60), (903, "", "a")]
    got = spark.createDataFrame(rows, "i int, raw string, seg string").select("i", tx.segmented_map(F.col("raw"), F.col("seg"))).collect()
    by_id = {i: (raw or "", seg or "") for i, raw, seg in rows}
    for i, positions in got:
        assert positions == walk(*by_id[i]), by_id[i]


def window_search(c, s, at):
    want = tx._fold_py(s)
    return next((i for i in range(at, len(c) - len(s) + 1) if tx._fold_py(c[i : i + len(s)]) == want), None)


def test_accent_free_search_with_a_map():
    r = random.Random(17)
    letters = ["a", "á", "A", "a\u0301", "\u0301", "đ", "Đ", "ð", "각", "Σ", "σ", "ς", " ", "ﬁ", "İ"]
    for _ in range(3000):
        c, s = ("".join(r.choice(letters) for _ in range(r.randint(0, n))) for n in (25, 3))
        if c and s:
            at = r.randint(0, 3)
            want = window_search(c, s, at)
            assert tx._locate_folded(c, s, at) == want, (c, s, at)
    long = "tiếng việt " * 10_000
    assert tx._locate_folded(long + "ĐÍCH ĐẾN", "dich den", 0) == len(long)  # 110,000 characters


# Scorer, files, stream.


def test_scorer_batches_by_length_and_cuts(spark):
    def load():
        def score(texts):
            return [[{"start": i, "end": i + 1, "token": f"{len(texts)}", "label": "O"} for i, _ in enumerate(t)] for t in texts]

        return score

    texts = ["x" * n for n in (5, 700, 1, 510, 511, 2)] + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, masked string").coalesce(1)
    got = score_tokens(rows, load, batch=4).collect()
    assert [r["i"] for r in got] == list(range(8))  # the order of rows is kept
    assert [len(r["tokens"]) for r in got] == [5, 510, 1, 510, 510, 2, 0, 0]
    assert [r["tokens"][0]["token"] for r in got[:6]] == ["4", "2", "4", "4", "2", "4"]  # four short ones together, then two long ones


def test_scorer_holds_few_tokens_at_a_time(spark):
    """Ten megabytes of text in one Arrow batch: the tokens of about one megabyte are held together, and no row is lost."""
    def load():
        held = []

        def score(texts):
            held.append(sum(map(len, texts)))
            return [[{"start": 0, "end": 1, "token": str(len(held)), "label": "O"}] for _ in texts]

        return score

    rows = spark.range(0, 1000, 1, 1).select("id", F.expr("if(id % 10 > 0, repeat('ab ', 3500), null)").alias("masked"))
    got = score_tokens(rows, load, batch=10_000).collect()
    calls = {r["tokens"][0]["token"] for r in got if r["tokens"]}
    assert sorted(r["id"] for r in got) == list(range(1000)) and sum(bool(r["tokens"]) for r in got) == 900 and len(calls) >= 9


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """Messages and tokens are dealt out by count, and windows over examples shuffle no tokens."""
    from dispatchtext.jobs import queries

    monkeypatch.setattr(msg, "TASK_MESSAGES", 100)
    monkeypatch.setattr(queries, "TASK_EXAMPLES", 100)
    assert msg.messages(spark, SF).rdd.getNumPartitions() == queries.tokens(spark, SF).rdd.getNumPartitions() == 15
    plan = queries.n8_assemble(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_malformed_lines(spark, tmp_path):
    lines = ["\ufeff" + json.dumps({"id": "1", "text": "a"}), "", json.dumps({"id": "2", "text": "b", "entities": [{"start": 0, "end": 1, "label": "PER"}]}), '{"id":"3"', "[1]", json.dumps({"id": "4"}) + " x"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    path = str(tmp_path / "x.jsonl")
    assert [(r["id"], r["text"]) for r in annotated.read_examples(spark, path, malformed="drop").collect()] == [("1", "a"), ("2", "b")]
    assert [r["line"] for r in annotated.rejected_lines(spark, path).collect()] == lines[3:]
    with pytest.raises(Exception, match="malformed line"):
        annotated.read_examples(spark, path).collect()
    assert annotated.read_examples(spark, str(tmp_path / "none")).collect() == []


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "generated")
    rows = spark.createDataFrame([("r1", 0, "x"), ("r1", 1, "y"), ("r2", 0, "x")], "response_id string, ordinal int, text string")
    made = annotated.with_provenance(rows, "p", "m").drop("response_id", "ordinal")
    for part in (made.filter("text = 'y'"), made, made, made.union(made)):
        annotated.append_examples(part, path)
    got = annotated.read_examples(spark, path)
    assert got.count() == 3 and sorted(r["text"] for r in got.collect()) == ["x", "x", "y"]


def test_append_keeps_rows_that_share_id_and_text(spark, tmp_path):
    """Two generated rows whose digests begin alike and whose texts are equal are two rows, however often they are appended."""
    path = str(tmp_path / "generated")
    numbers = spark.range(300_000).select((F.col("id") * 7).alias("response_id"), F.lit(0).alias("ordinal"), F.lit("same").alias("text"))
    made = annotated.with_provenance(numbers, "p", "m", "2026-01-02T03:04:05+00:00")
    twins = made.groupBy("id").agg(F.collect_list("response_id").alias("of")).filter(F.size("of") > 1).select(F.explode("of").alias("response_id"))
    rows = made.join(twins, "response_id").drop("response_id", "ordinal").cache()
    assert rows.count() == 2 * rows.select("id").distinct().count() > 0
    for _ in range(2):
        annotated.append_examples(rows, path)
    assert annotated.read_examples(spark, path).count() == rows.count()


def test_stream_restart_in_the_middle_of_a_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    messages = msg.messages(spark, SF).limit(300).repartition(3)
    messages.write.parquet(source)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    parse_stream(stream, label, out, state).awaitTermination(120)
    # The last batch was written but not noted as done: its commit is taken back, and a part of what it wrote stays.
    commits = sorted(p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    commits[-1].unlink()
    (tmp_path / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    before = read_parsed(spark, out).count()
    parse_stream(stream, label, out, state).awaitTermination(120)
    got = read_parsed(spark, out)
    assert before == got.count() == got.select("message_id").distinct().count() == 300
    want = {r["message_id"]: r["error_code"] for r in parse(label(prepare(spark.read.parquet(source)))).collect()}
    assert {r["message_id"]: r["error_code"] for r in got.collect()} == want
    assert read_parsed(spark, out, "results").count() == sum(e is None for e in want.values())


def test_promoted_notes_are_notes_no_more(spark):
    text = "gọi trước, số 5 ngõ 3"
    rows = label(prepare(spark.createDataFrame([(1, text, "?", "?", "số 5 ngõ 3"), (2, text, "?", "?", "gọi trước")], "message_id long, text string, name string, addr string, note string")))
    got = {r["message_id"]: (r["address_raw"], r["note"], r["error_code"]) for r in parse(rows, promote=True).collect()}
    assert got == {1: ("số 5 ngõ 3", None, None), 2: (None, None, "address_not_found")}
