"""Queries over strict payloads, raw places, exact percentiles, long span tables, scored and streamed messages. Importing this module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as tx
from ..functions.payload import decode_payload
from ..operators import intervals
from ..operators.order_statistics import percentiles
from ..sources import annotated
from ..sources.shared import new_path
from ..streaming.parse_stream import parse_stream, read_parsed
from . import messages as msg
from .parse import known_entities, score_tokens, telemetry, validate
from .queries import TRUE_ERROR, M, _islands, _t, labelled, query, tokens

# Strict payloads: the same texts are read by Spark's variants and by the JSON functions of the SQL.

_DEBUG = ("true", "false", "null", "0", "1", "2", "1.0", "0.5", '"yes"', '"OFF"', '"maybe"', "[true]")
_SHAPES = (
    '{"text":"@"}', '{"text":5}', '{"text":["@"]}', '{"text":null}', '{"text":"@"} junk', '{"text":{"a":"@"}}', '["@"]', '"@"', '{"text":"@","x":1}', '{"text":"@"', "", ' { "text" : "@" } ', '{"text":true}',
    *(f'{{"text":"@","debug":{d}}}' for d in _DEBUG),
)
PAYLOAD = "case " + " ".join(f"when event_id % {len(_SHAPES)} = {i} then replace('{s}', '@', event_type)" for i, s in enumerate(_SHAPES)) + " end"


@query(f"""with p as (select event_id, case when json_valid(payload) then payload end as b from (select event_id, {PAYLOAD} as payload from events) x),
  q as (select event_id, case when json_type(b) = 'OBJECT' and json_type(b, '$.text') = 'VARCHAR' and len(list_filter(json_keys(b), lambda k: k not in ('text', 'debug'))) = 0 then b end as b from p),
  r as (select event_id, b, json_type(b, '$.debug') as kind, lower(json_extract_string(b, '$.debug')) as word from q),
  s as (select event_id, b, case when b is null then null when kind is null then false when kind = 'BOOLEAN' then word = 'true'
    when kind in ('UBIGINT', 'BIGINT', 'DOUBLE') then case cast(word as double) when 1 then true when 0 then false end
    when kind = 'VARCHAR' then case when word in ('1', 'on', 't', 'true', 'y', 'yes') then true when word in ('0', 'off', 'f', 'false', 'n', 'no') then false end end as debug from r)
  select event_id, case when debug is not null then json_extract_string(b, '$.text') end as text, debug, case when debug is null then 'invalid_input' end as error_code from s""")  # fmt: skip
def v2_strict_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, arrays, nulls and objects as text, junk after the object, other keys, and flags of every kind."""
    text, debug, error = decode_payload(F.col("payload"))
    events = _t(spark, sf_dir, "events").select("event_id", F.expr(PAYLOAD).alias("payload"))
    return events.select("event_id", text.alias("text"), debug.alias("debug"), error.alias("error_code"))


@query("""select event_id, case when blank then 'invalid_input' when event_id % 3 = 0 then 'debug_not_allowed' end as guarded, case when blank then 'invalid_input' else 'model_not_ready' end as unready,
  case when blank then 'invalid_input' when event_id % 3 = 0 then 'debug_not_allowed' else 'model_not_ready' end as neither from (select event_id, event_id % 4 = 1 as blank from events) x""")  # fmt: skip
def v1_debug_and_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on debug requests and on a scorer that is not ready, after those on the text."""
    text, debug = F.when(F.col("event_id") % 4 != 1, F.col("event_type")).otherwise(F.lit(" \n")), F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 0)
    codes = {"guarded": validate(text, debug, debug_allowed=False), "unready": validate(text, debug, scorer_ready=False), "neither": validate(text, debug, debug_allowed=False, scorer_ready=False)}
    return _t(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in codes.items()])


# Places of candidates in the raw text.

_SEEN = {"PER": ("name", "v in (0, 1, 2, 3, 4, 5, 7, 9, 11)"), "ADDR": ("addr", "v <> 11"), "NOTE": ("note", "v in (0, 1)")}


@query(" union all ".join(f"""select message_id, '{label}' as label, cast(position({what} in text) - 1 as int) as start, cast(position({what} in text) - 1 + length({what}) as int) as "end" from {M} where k % 97 <> 0 and k % 89 <> 0 and {there}""" for label, (what, there) in _SEEN.items()))
def r6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the telemetry, behind removed script blocks too."""
    found = telemetry(labelled(spark, sf_dir)).select("message_id", F.explode_outer("spans").alias("s")).filter("s is not null")
    return found.select("message_id", "s.label", "s.start", "s.end")


# Look-alike letters.

_LOOKALIKES = "case when k % 2 = 0 then replace(name, 'Đ', 'Ð') else name end || ' ðÐđĐd ' || addr"


@query(f"select message_id, replace(replace({_LOOKALIKES}, 'Ð', 'Đ'), 'ð', 'đ') as folded from {M}")
def t7_confusables_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which some names are spelt with the look-alike letter and others are not."""
    return msg.messages(spark, sf_dir).select("message_id", tx.fold_confusables(F.expr(_LOOKALIKES)).alias("folded"))


# Exact percentiles: one group holds 99 of 100 rows.

_FRACTIONS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)
_SKEWED = "case when l_orderkey % 100 = 0 then l_returnflag when l_orderkey % 100 = 1 then null else 'all' end"


@query(f"select g, {', '.join(f'quantile_disc(v, {p}) as d{i}, round(quantile_cont(v, {p}), 6) as c{i}' for i, p in enumerate(_FRACTIONS))} from (select {_SKEWED} as g, case when l_linenumber = 7 then null else l_extendedprice end as v from lineitem) x group by g")
def e8_skewed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(F.expr(_SKEWED).alias("g"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("v"))
    got = percentiles(rows, ["g"], "v", {f"d{i}": p for i, p in enumerate(_FRACTIONS)}, {f"c{i}": p for i, p in enumerate(_FRACTIONS)})
    return got.withColumns({f"c{i}": F.round(f"c{i}", 6) for i in range(len(_FRACTIONS))})


# Long span tables: one example holds seven of ten rows.

_HOT = "case when {0} % 10 < 7 then 0 else {0} % 9 end"
UNITS = f"select {_HOT.format('l_orderkey')} as example_id, l_orderkey * 10 + l_linenumber as unit, cast((l_orderkey * 7919 + l_linenumber * 104729) % 500000 as int) as start, cast((l_orderkey * 7919 + l_linenumber * 104729) % 500000 + l_partkey % 6 as int) as \"end\" from lineitem"
ENTITIES = f"""select {_HOT.format('o_orderkey')} as example_id, o_orderkey as ord, cast((o_orderkey * 104723) % 500000 as int) as start, cast((o_orderkey * 104723) % 500000 + (o_custkey % 97) * (case when o_orderkey % 50 = 0 then 40 else 1 end) as int) as \"end\",
  case o_orderkey % 3 when 0 then 'PER' when 1 then 'ADDR' else 'NOTE' end as label from orders"""


def _spans(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace('"end"', "`end`").replace(f"from {name}", "from {t}"), t=_t(spark, sf_dir, name))


@query(f"""select u.example_id, unit, u.start, u."end", coalesce(arg_min(case when u.start = e.start then 'B-' else 'I-' end || label, ord), 'O') as label
  from ({UNITS}) u left join ({ENTITIES}) e on e.example_id = u.example_id and u.start >= e.start and u."end" <= e."end" group by 1, 2, 3, 4""")  # fmt: skip
def n5_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of units by the first entity that contains them, both as tables."""
    return intervals.label_units(_spans(spark, sf_dir, UNITS, "lineitem"), _spans(spark, sf_dir, ENTITIES, "orders"))


@query(f"""select example_id, unit from ({UNITS}) u where not exists (select 1 from ({ENTITIES}) e where e.example_id = u.example_id and greatest(u.start, e.start) < least(u."end", e."end"))""")
def n11_overlap_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that touch none of the others of their example, both as tables."""
    return intervals.drop_overlapping(_spans(spark, sf_dir, UNITS, "lineitem"), _spans(spark, sf_dir, ENTITIES, "orders")).select("example_id", "unit")


@query(f"select example_id, type, cast(first_tok as bigint) as first, cast(last_tok as bigint) as last from {_islands('pred')} i where has_b")
def e1_in_row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict chunks folded within the row of an example."""
    rows = tokens(spark, sf_dir).groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("tok_idx", "pred"))).alias("tokens"))
    return rows.select("example_id", F.explode(spans.chunk_set(F.col("tokens"), "pred")).alias("c")).select("example_id", "c.*")


# Scored texts.


def word_scorer() -> Callable[[list[str]], list[list[dict]]]:
    """A stand-in for a model: every word is a token, labelled by its length."""

    def score(texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            at, found = 0, []
            for word in text.split(" "):
                if word:
                    found.append({"start": at, "end": at + len(word), "token": word, "label": spans.LABELS[len(word) % len(spans.LABELS)]})
                at += len(word) + 1
            out.append(found)
        return out

    return score


_WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(f"""select doc_id, cast(least(len({_WORDS}), 510) as int) as n_tokens, cast(len(list_filter(list_slice({_WORDS}, 1, 510), lambda w: length(w) % 7 = 0)) as int) as n_outside, list_extract({_WORDS}, least(len({_WORDS}), 510)) as last from documents""")
def n1_scored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents by a plugged-in scorer, cut where a model's window ends."""
    rows = score_tokens(_t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("masked")), word_scorer)
    outside = F.filter("tokens", lambda t: t["label"] == "O")
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(outside).alias("n_outside"), F.try_element_at("tokens", F.lit(-1))["token"].alias("last"))


# Files and streams.

_LINES = ('{"id":"#","text":"@"}', "", '{"id":"#","text":"@"', '{"id":"#","text":"@"} x', "  ", '[{"id":"#"}]', '\ufeff{"id":"#","text":"@"}')


@query(f"""select cast(event_id as varchar) as id, case when event_id % 7 in (0, 6) then event_type end as text, event_id % 7 in (0, 6) as good from events where event_id % 7 not in (1, 4)""")
def s1_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank and malformed ones: the examples, and what was rejected (its id read from the line; none for an array)."""
    line = "case " + " ".join(f"when event_id % {len(_LINES)} = {i} then replace(replace('{x}', '#', cast(event_id as string)), '@', event_type)" for i, x in enumerate(_LINES)) + " end"
    path = new_path(spark, "lines")
    _t(spark, sf_dir, "events").select(F.expr(line).alias("value")).write.text(path)
    good = annotated.read_examples(spark, path, malformed="drop").select("id", "text", F.lit(True).alias("good"))
    bad = annotated.rejected_lines(spark, path).select(F.regexp_extract("line", '"id":"([0-9]+)"', 1).alias("id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("good"))
    return good.unionByName(bad)


@query(f"select 'synth-' || substr(sha256(cast(k as varchar) || '|0|' || name), 1, 8) as id, name as text from ({msg.PARTS}) p")
def s3_appended_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same generated rows appended by two runs of a job, and a part of them by a third."""
    path = new_path(spark, "generated")
    rows = msg.messages(spark, sf_dir).select(F.col("k").alias("response_id"), F.lit(0).alias("ordinal"), F.col("name").alias("text"))
    made = annotated.with_provenance(rows, "p", "m", "2026-01-02T03:04:05+00:00").drop("response_id", "ordinal")
    for part in (made, made, made.filter("text like 'N%'")):
        annotated.append_examples(part, path)
    return annotated.read_examples(spark, path).select("id", "text")


@query(f"select message_id, kind, error_code from (select message_id, case when error is null then 'results' else 'rejects' end as kind, error as error_code from (select *, {TRUE_ERROR} as error from {M}) x) y")
def st1_stream_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages parsed as a stream of files, results and rejects in one pass."""
    source, out, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    messages = msg.messages(spark, sf_dir)
    messages.write.parquet(source)

    def label(rows: DataFrame) -> DataFrame:
        known = known_entities(F.col("masked"), {"PER": F.col("name"), "ADDR": F.col("addr"), "NOTE": F.col("note")})
        return rows.withColumn("tokens", spans.label_units(F.col("masked"), known))

    together = 4 * spark.sparkContext.defaultParallelism  # a batch of a few files would leave cores idle
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", together).parquet(source)
    parse_stream(stream, label, out, state).awaitTermination()
    return read_parsed(spark, out).select("message_id", "kind", "error_code")
