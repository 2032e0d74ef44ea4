"""The parser on a stream and with a plugged-in scorer; spellings of segmented words."""

from itertools import product

from pyspark.sql import functions as F

from dispatchtext.functions import spans
from dispatchtext.functions import text as tx
from dispatchtext.jobs import messages as msg
from dispatchtext.jobs.parse import known_entities, parse, prepare, score_tokens
from dispatchtext.jobs.queries import r5_parse_messages
from dispatchtext.streaming.parse_stream import parse_stream, read_parsed

SF = "/root/testdata/sf0.001"


def label(rows):
    surfaces = {"PER": F.col("name"), "ADDR": F.col("addr"), "NOTE": F.col("note")}
    return rows.withColumn("tokens", spans.label_units(F.col("masked"), known_entities(F.col("masked"), surfaces)))


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    messages = msg.messages(spark, SF)
    messages.write.parquet(source)
    stream = spark.readStream.schema(messages.schema).parquet(source)
    parse_stream(stream, label, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = r5_parse_messages(spark, SF)
    got = read_parsed(spark, str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_scorer(spark):
    def load():
        def score(texts):
            out = []
            for t in texts:
                at = t.find("12 Lê Lợi")
                out.append([{"start": at, "end": at + 9, "token": "12 Lê Lợi", "label": "B-ADDR"}] if at >= 0 else [])
            return out

        return score

    rows = spark.createDataFrame([(1, "0912345678, 12 Lê Lợi"), (2, "nothing here"), (3, "   "), (4, None)], "message_id long, text string")
    got = {r["message_id"]: (r["phone_number"], r["address_raw"], r["error_code"]) for r in parse(score_tokens(prepare(rows), load)).collect()}
    assert got == {1: ("0912345678", "12 Lê Lợi", None), 2: (None, None, "address_not_found"), 3: (None, None, "invalid_input"), 4: (None, None, "invalid_input")}


def test_surfaces_in_order(spark):
    def brute(w):
        out = [w, w.replace("_", " "), w.replace("_", "")]
        parts = w.split("_")
        out += ["".join(x for pair in zip(parts, (*seps, "")) for x in pair) for seps in product((" ", ""), repeat=len(parts) - 1)]
        return [x for x in dict.fromkeys(out) if x]

    words = ["a", "a_b", "9A-11_A_Dương", "a_b_c_d", "", "_", "a_b_c_d_e_f_g_h_i"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.surfaces(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == [brute(w) for w in words]
