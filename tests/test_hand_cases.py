"""Hand cases: phones, spans, resolution, sanitizing, segmentation, the whole parser, requests."""

import re
import time

import pytest
from pyspark.sql import functions as F

from dispatchtext.functions import phones, resolve, spans
from dispatchtext.functions import text as tx
from dispatchtext.jobs.parse import known_entities, parse, phone_columns, prepare
from dispatchtext.operators import dataset, metrics

PHONES = [
    ("Nguyễn Văn A 0912 345 678", "0912345678", 1, "Nguyễn Văn A [PHONE]", None),
    ("0912-345-678", "0912345678", 1, "[PHONE]", None),
    ("+84912345678", "0912345678", 1, "[PHONE]", None),
    ("84912345678", "0912345678", 1, "[PHONE]", None),
    ("Gọi (0912) 345.678", "0912345678", 1, "Gọi [PHONE]", None),
    ("Số 091234567", None, 0, None, "invalid_length"),
    ("Số 09123456789", None, 0, None, "invalid_length"),
    ("02438222222", None, 0, None, "unsupported_non_mobile"),
    ("0123456789", None, 0, None, "legacy_prefix"),
    ("nha so 0987654321", None, 0, None, "context_house_number"),
    ("nhà số 0987654321, giao buổi chiều", None, 0, None, "context_house_number"),
    ("ma don 0912345678", None, 0, None, "context_order_id"),
    ("mã đơn: 0912345678", None, 0, None, "context_order_id"),
    ("Lan 0901234567, lien he shop 0987654321", "0901234567", 2, "Lan [PHONE], lien he shop [PHONE]", None),
    ("0901234567 0987654321", "0901234567", 2, "[PHONE] [PHONE]", None),
    ("Hello World", None, 0, "Hello World", None),
    ("Nguyễn Thị Hoa\n0934567890\n15 Lý Thường Kiệt, P.14, Q.10", "0934567890", 1, "Nguyễn Thị Hoa\n[PHONE]\n15 Lý Thường Kiệt, P.14, Q.10", None),
]


def test_phones(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHONES)], "message_id long, text string")
    found = phone_columns(prepare(rows)).select("*", F.get("candidates", 0)["reject_reason"].alias("first"), phones.masked_spans(F.col("candidates")).alias("spans")).collect()
    for r in found:
        text, number, count, masked, reason = PHONES[r["message_id"]]
        assert (r["phone_number"], r["phone_count"], r["masked"], r["first"]) == (number, count, masked or text, reason), text
    assert [tuple(s) for s in next(r["spans"] for r in found if r["text"].startswith("Nguyễn Thị"))] == [(15, 22)]


SPANS = [
    ("Nguyễn Văn A Số 1", [(0, 6, "B-PER"), (7, 10, "I-PER"), (11, 12, "I-PER"), (12, 13, "O"), (13, 15, "B-ADDR"), (16, 17, "I-ADDR")], [], [], (["Nguyễn Văn A"], ["Số 1"], [])),
    ("[PHONE]", [(0, 7, "B-ADDR")], [(0, 7)], [], ([], [], [])),
    ("Lan", [(0, 3, "B-PER")], [], [(0, 3)], ([], [], [])),
    ("Lan ơi", [(0, 6, "B-PER")], [], [], ([], [], [])),
    ("Lan ơi", [(0, 3, "B-PER")], [], [], ([], [], [])),
    ("xanh", [(0, 4, "I-ADDR")], [], [], ([], [], [])),
    ("nhà xanh", [(0, 8, "I-ADDR")], [], [], ([], ["nhà xanh"], [])),
    ("xanh", [(0, 4, "B-ADDR")], [], [], ([], ["xanh"], [])),
    ("Số 1 HN", [(0, 7, "B-ADDR"), (0, 7, "B-NOTE")], [], [], ([], ["Số 1 HN"], [])),
    (" A  b ", [(0, 6, "B-NOTE"), (3, 3, "B-PER"), (2, 9, "B-PER")], [], [], ([], [], ["A  b"])),
]


def test_spans(spark):
    schema = "i int, raw string, tokens array<struct<start:int,end:int,token:string,label:string>>, masks array<struct<start:int,end:int>>, blocks array<struct<start:int,end:int>>"
    data = [(i, raw, [(a, b, raw[a:b], label) for a, b, label in toks], masks, blocks) for i, (raw, toks, masks, blocks, _) in enumerate(SPANS)]
    rows = spark.createDataFrame(data, schema).withColumn("pieces", spans.assemble(F.col("tokens")))
    found = spans.candidates(F.col("pieces"), F.col("raw"), lambda p: p, F.col("masks"), F.col("blocks"))
    rows = rows.select("i", *[c.alias(n) for n, c in found.items()]).withColumn("note", spans.drop_notes_on_addresses(F.col("note"), F.col("addr")))
    for r in rows.collect():
        assert tuple([c["text"] for c in r[k]] for k in ("per", "addr", "note")) == SPANS[r["i"]][4], SPANS[r["i"]]


def _c(text, start=0):
    return (start, start + len(text), text)


def test_resolution(spark):
    """Addresses: the first counts, blank or none gives none. Names after a pickup cue do not count. Notes are cleaned."""
    schema = "i int, per array<struct<start:int,end:int,text:string>>, addr array<struct<start:int,end:int,text:string>>, note array<struct<start:int,end:int,text:string>>, raw string"
    cases = [
        ([], ["45 Lê Lợi Q1 HCM"], [], "", (None, "45 Lê Lợi Q1 HCM", None)),
        ([], ["12 Lý Thái Tổ", "88 Nguyễn Du"], [], "", (None, "12 Lý Thái Tổ", None)),
        ([], ["A", "B", "C"], [], "", (None, "A", None)),
        ([], [], [], "", (None, None, None)),
        ([], ["   ", "B"], [], "", (None, None, None)),
        ([], ["  45 Lê Lợi Q1  "], [], "", (None, "45 Lê Lợi Q1", None)),
        ([_c("Minh Tú", 11)], ["22 Ngô Quyền"], [], "lấy hàng ở Minh Tú, giao tới 22 Ngô Quyền", (None, "22 Ngô Quyền", None)),
        ([_c(" "), _c("Nguyễn Văn A")], ["22 Ngô Quyền"], [], "Nguyễn Văn A, giao tới 22 Ngô Quyền", ("Nguyễn Văn A", "22 Ngô Quyền", None)),
        ([], ["22 Ngô Quyền"], ["Ngô Quyền", "ở 22 Ngô Quyền nhé", ' nhớ ghi "hàng dễ vỡ" lên '], "", (None, "22 Ngô Quyền", "hàng dễ vỡ")),
        ([], ["A"], ["ghi 'nhẹ tay'"], "", (None, "A", "nhẹ tay")),
        ([], ["1"], ["Ghi chú: - giao sớm |, "], "", (None, "1", "giao sớm")),
        ([], ["1"], ["NOTE gọi trước"], "", (None, "1", "gọi trước")),
        ([], ["1"], ["ghi chú: ", "gọi"], "", (None, "1", "ghi chú:")),
    ]
    rows = spark.createDataFrame([(i, per, [_c(a) for a in addr], [_c(n) for n in note], raw) for i, (per, addr, note, raw, _) in enumerate(cases)], schema)
    address = resolve.address(F.col("addr"))
    got = rows.select("i", resolve.recipient(F.col("per"), F.col("raw")).alias("name"), address.alias("address"), resolve.note(F.col("note"), address).alias("note")).collect()
    for r in got:
        assert (r["name"], r["address"], r["note"]) == cases[r["i"]][4], cases[r["i"]]


def test_sanitized_ends(spark):
    for text in ("22 Hai Bà Trưng", "<script>alert('xss')</script> ship tới 45 Lê Lợi Q1"):
        row = spark.createDataFrame([(text,)], "t string").select(tx.sanitize(F.col("t")).alias("s"), *[s.alias(f"s{i}") for i, s in enumerate(tx.removal_steps(F.col("t")))])
        end = row.select(tx.to_raw(F.length("s"), [F.col(f"s{i}") for i in range(3)], F.length("s")).alias("e")).first()["e"]
        assert end == len(text)


SEGMENTED = [
    ("Hà Nội", "Hà Nội", [0, 1, 2, 3, 4, 5]), ("Hà Nội", "Hà_Nội", [0, 1, 2, 3, 4, 5]), ("", "", []), ("a\nb c", "a b c", [0, 1, 2, 3, 4]), ("ab", "ab cd", [0, 1, 2, 2, 2]),
    ("a,b", "a , b", [0, 1, 1, 2, 2]), ("a  b", "a_b", [0, 2, 3]), ("axb", "ayb", [0, 1, 2]), ("", "x y", [0, 0, 0]), ("_a", "_a", [0, 1]), ("a b", "_a_b", [0, 0, 1, 2]),
]


def test_segmented_positions(spark):
    rows = spark.createDataFrame([(r, s) for r, s, _ in SEGMENTED], "r string, s string").select("r", "s", tx.segmented_map(F.col("r"), F.col("s")).alias("m")).collect()
    assert {(r["r"], r["s"]): r["m"] for r in rows} == {(r, s): m for r, s, m in SEGMENTED}
    cases = [(0, 6, [0, 1, 2, 3, 4, 5], 6, (0, 6)), (0, 3, [], 10, (0, 3)), (2, 10, [0, 1, 2, 3], 4, (2, 4)), (5, 7, [0, 1], 2, (5, 7)), (1, 3, [0, 2, 2], 2, (2, 2)), (0, 0, [0, 1], 2, (0, 0))]
    rows = spark.createDataFrame([c[:4] for c in cases], "a int, b int, m array<int>, n int").select(tx.segmented_span(F.col("a"), F.col("b"), F.col("m"), F.col("n")).alias("s")).collect()
    assert [tuple(r["s"]) for r in rows] == [c[4] for c in cases]


def test_log_marks_and_locating(spark):
    assert spark.range(1).select(tx.clean_log(F.lit("\x1b[1mA═─↵✗│┌\x1b[0m")).alias("x")).first()["x"] == "A=-\\nX│┌"
    cases = [("é Ðặng", "é", 0, 0), ("é. Ðé", "Ðé", 0, 3), ("thuỷ tinh", "thủy", 0, 0), ("a b a", "a", 1, 4), ("abc", "x", 0, None), ("abc", "", 0, None), (None, "a", 0, None), ("Ðặng", "Đặng", 0, 0)]
    rows = spark.createDataFrame([c[:3] for c in cases], "c string, s string, at int").select(tx.locate_tolerant(F.col("c"), F.col("s"), F.col("at")).alias("x")).collect()
    assert [r["x"] for r in rows] == [c[3] for c in cases]


def test_offsets_of_pieces(spark):
    cases = [("ab cd ef", ["<s>", "▁ab", "x@@", "ef", "▁", "</s>"], [(0, 0), (0, 2), (3, 4), (6, 8), (0, 0), (0, 0)]), ("ab", ["ab", "long"], [(0, 2), (2, 2)]), ("  a", ["zzzzz", "a"], [(2, 3), (3, 3)]), ("", ["a"], [(0, 0)])]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, p array<string>").select(spans.token_offsets(F.col("t"), F.col("p")).alias("o")).collect()
    assert [[tuple(x) for x in r["o"]] for r in rows] == [c[2] for c in cases]
    own = spark.createDataFrame([("a b", ["[X]", "a", "b"])], "t string, p array<string>").select(spans.token_offsets(F.col("t"), F.col("p"), ("[X]",)).alias("o")).first()["o"]
    assert [tuple(x) for x in own] == [(0, 0), (0, 1), (2, 3)]


def test_parser(spark):
    def ask(text, promote=False, **surfaces):
        rows = prepare(spark.createDataFrame([(1, text)], "message_id long, text string"))
        held = {k: F.lit(v) for k, v in surfaces.items()} or {"PER": F.lit("-none-")}
        rows = rows.withColumn("tokens", spans.label_units(F.col("masked"), known_entities(F.col("masked"), held)))
        return parse(rows, promote=promote).first()

    assert ask("   ")["error_code"] == "invalid_input" and ask("a" * 5001)["error_code"] == "input_too_long" and ask("a" * 5000)["error_code"] == "address_not_found"
    bad_phone = ask("091234567, 12 Lê Lợi", ADDR="12 Lê Lợi")
    assert (bad_phone["status_code"], bad_phone["phone_number"], bad_phone["address_raw"]) == (200, None, "12 Lê Lợi")
    after = ask("Lan 0912 345 678 giao 12 Lê Lợi", PER="Lan", ADDR="12 Lê Lợi")
    assert (after["recipient_name"], after["phone_number"], after["address_raw"]) == ("Lan", "0912345678", "12 Lê Lợi")
    assert ask("giao 12 Lê Lợi", promote=True, NOTE="12 Lê Lợi")["address_raw"] == "12 Lê Lợi" and ask("giao 12 Lê Lợi", NOTE="12 Lê Lợi")["status_code"] == 422


def test_responses(spark):
    cases = [
        ('```json\n{"examples":[{"text":"An ở Q1","entities":[{"substring":"An","label":"PER"}]}]}\n```', [None]),
        ('sure: {"examples":[]} ok', []),
        ('{"examples":[]} trailing {', []),
        ("{}", []),
        ("sorry", None),
        ("[1]", None),
        (None, None),
        ('{"examples":[{"text":"a","entities":[]},{"entities":[]}]}', None),
        ('{"examples":[{"text":"a","entities":[{"substring":"a"}]}]}', None),
        ('{"examples":[{"text":"a","entities":[{"substring":"x","label":"PER"},{"substring":"a"}]}]}', ["substring not found"]),
        ('{"examples":[{"text":"a b","entities":[{"substring":"a","label":"PER"},{"substring":"a b","label":"ADDR"}]},{"text":"c","entities":[]}]}', ["overlap", None]),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string").select("i", dataset.response_examples(F.col("r")).alias("x")).collect()
    for r in rows:
        assert (None if r["x"] is None else [e["reason"] for e in r["x"]]) == cases[r["i"]][1], cases[r["i"]]


def test_requests(spark):
    records = spark.createDataFrame([("a", 200, 100.0, None), ("b", 500, 250.0, None), ("c", None, 300.0, "ReadTimeout")], "case_id string, status_code int, elapsed_ms double, error string")
    out = metrics.latency_summary(records.withColumn("mode", F.lit("m")), 1.0, ["mode"]).first()
    assert (out["total"], out["success"], out["failed"], out["p99"]) == (3, 1, 2, 250.0)
    five = spark.createDataFrame([(str(s), s, 1.0, "Timeout" if s is None else None) for s in (200, 400, 422, 500, None)], records.schema)
    got = metrics.feedback_summary(five).first()
    assert (got["success"], got["input_error"], got["server_error"], got["exception"]) == (1, 2, 1, 1)
    assert [r["case_id"] for r in metrics.feedback_listing(five, "server_error", "exception").collect()] == ["500", "None"]


@pytest.mark.parametrize("pattern", [tx.WORD, tx.CONTROLS])
def test_match_spans_equal_finditer(spark, pattern):
    texts = ["", None, "a", " a b ", "ab\x00c\x01\x02 d" * 300, "é " * 1000, "\n".join("x" * (i % 7) for i in range(700))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.match_spans(F.col("t"), pattern).alias("m")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert (None if r["m"] is None else [tuple(x) for x in r["m"]]) == (None if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)])


def test_match_spans_grow_with_the_text(spark):
    """Four times the words take far less than sixteen times as long."""
    def seconds(n):
        rows = spark.range(0, 8, 1, 1).select(F.repeat(F.lit("word "), n).alias("t"), "id")
        run = rows.select(F.size(tx.match_spans(F.concat("t", F.col("id").cast("string")), tx.WORD)).alias("n")).agg(F.sum("n"))
        run.collect()
        began = time.time()
        assert run.first()[0] == 8 * (n + 1)
        return time.time() - began

    assert seconds(16_000) < 8 * max(seconds(4_000), 0.2)
