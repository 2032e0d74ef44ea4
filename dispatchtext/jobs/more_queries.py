"""Further queries: files, golden cases, drop rules, dataset accounts. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phones, resolve, spans
from ..functions import text as tx
from ..operators import dataset, metrics
from ..sources import annotated
from ..sources.shared import new_path
from . import messages as msg
from .parse import known_entities, parse, prepare, presence, telemetry
from .queries import _COST, _LAB, REQUESTS, SPLIT, TRUE_ERROR, TRUE_PHONE, M, _examples, _responses, _t, labelled, query, requests, tokens

P = f"({msg.PARTS}) p"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.messages(spark, sf_dir).drop("text")


# Files.

_EXAMPLE = "'e' || cast(k as varchar(20)) as id, name || ', ' || addr as text, case when k % 4 = 0 then 'seed' else 'synth' end as source, case k % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split"


def annotated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = F.expr("array(named_struct('start', 0, 'end', length(name), 'label', 'PER'), named_struct('start', length(name) + 2, 'end', length(name) + 2 + length(addr), 'label', 'ADDR'))")
    return parts(spark, sf_dir).select("k", *[F.expr(x) for x in ("'e' || cast(k as varchar(20)) as id", "name || ', ' || addr as text", "case when k % 4 = 0 then 'seed' else 'synth' end as source", "case k % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split")], entities.alias("entities"))


@query(f"select {_EXAMPLE}, cast(2 as int) as n_entities, addr as last_entity from {P}")
def s1_s2_files_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written as one folder of JSON lines per split and read again."""
    path = new_path(spark, "splits")
    annotated.write_splits(annotated_parts(spark, sf_dir).drop("k"), path)
    split = F.regexp_extract(F.input_file_name(), "split=([a-z]+)", 1).alias("split")
    last = F.element_at("entities", -1)
    return annotated.read_examples(spark, path).select("id", "text", "source", split, F.size("entities").alias("n_entities"), F.substring(F.col("text"), last["start"] + 1, last["end"] - last["start"]).alias("last_entity"))


@query(f"""select 'synth-' || substr(sha256(cast(k as varchar) || '|0|' || name), 1, 8) as id, name as text, 'p_synth' as source, 'm' as model, cast(k % 12 as varchar) as variation, '2026-01-02T03:04:05+00:00' as created_at from {P}""")
def s3_generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows with provenance, appended in two turns."""
    path = new_path(spark, "generated")
    rows = parts(spark, sf_dir).select(F.col("k").alias("response_id"), F.lit(0).alias("ordinal"), F.col("name").alias("text"), (F.col("k") % 12).alias("variation"))
    made = annotated.with_provenance(rows, "p", "m", "2026-01-02T03:04:05+00:00").drop("response_id", "ordinal")
    for odd in (0, 1):
        annotated.append_examples(made.filter(F.pmod(F.col("variation").cast("int"), F.lit(2)) == odd), path)
    return annotated.read_examples(spark, path).select("id", "text", "source", "model", "variation", "created_at")


_CASE_LAYER = "case event_id % 5 when 0 then 'api' when 1 then 'performance' when 2 then 'privacy' when 3 then 'phone' end"
_CASE_TEXT = "case when event_id % 7 = 0 then repeat('a', cast(event_id % 9 as int)) when event_id % 7 = 1 then '  ' when event_id % 7 = 2 then null else event_type end"


@query(f"""select cast(event_id as varchar) as id, layer, text, text is not null and trim(text) <> '' as runnable from (select event_id, {_CASE_LAYER} as layer, case when event_id % 6 = 0 then 'future' when event_id % 6 = 1 then 'now' end as scope,
  {_CASE_TEXT} as text from events) x where coalesce(scope, '') <> 'future' and coalesce(layer, '') not in ('performance', 'privacy')""")  # fmt: skip
def s4_v6_v7_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases read from JSON lines: some leave, texts come from a factory, blank ones cannot run."""
    path = new_path(spark, "cases")
    made = F.when(F.col("event_id") % 7 == 1, "  ").when(~(F.col("event_id") % 7).isin(0, 2), F.col("event_type"))
    factory = F.when(F.col("event_id") % 7 == 0, F.struct(F.lit("a").alias("character"), (F.col("event_id") % 9).cast("int").alias("count")))
    rows = _t(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.expr(_CASE_LAYER).alias("layer"), F.when(F.col("event_id") % 6 == 0, "future").when(F.col("event_id") % 6 == 1, "now").alias("scope"),
        F.struct(made.alias("text"), F.lit(False).alias("debug"), factory.alias("text_factory")).alias("input"),
    )
    rows.write.json(path)
    cases = annotated.read_cases(spark, path)
    can_run = annotated.runnable(cases).select("id", F.lit(True).alias("runnable"))
    return cases.select("id", "layer", "text").join(can_run, "id", "left").withColumn("runnable", F.coalesce("runnable", F.lit(False)))


@query(f"select part, mode, count(*) as total from {REQUESTS} r, (select unnest(['by_mode', 'combined']) as part) s group by 1, 2")
def s5_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service reports, one folder per mode and one of all, read again."""
    path = new_path(spark, "reports")
    annotated.write_reports(metrics.latency_summary(requests(spark, sf_dir), 60.0, ["mode"]), path)
    read = [spark.read.schema("mode string, total long").json(f"{path}/{p}").select(F.lit(p).alias("part"), "mode", "total") for p in ("by_mode", "combined")]
    return read[0].unionByName(read[1])


_TOK = f"(select {_LAB.format('(k * 31 + i * i * 17 + i)')} as gold from (select o_orderkey as k, unnest(generate_series(1, 5 + o_orderkey % 7)) as i from orders) u)"


@query(f"select cast(list_position(['O','B-PER','I-PER','B-ADDR','I-ADDR','B-NOTE','I-NOTE'], gold) - 1 as int) as label_id, count(*) as n from {_TOK} t group by 1")
def s6_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the id of their label: a join with the label map."""
    ids = annotated.label_map(spark).withColumnRenamed("label", "gold")
    return tokens(spark, sf_dir).join(F.broadcast(ids), "gold").groupBy("label_id").agg(F.count("*").alias("n"))  # seven rows


@query(f"select source, count(*) as n, count(variation) as with_variation from (select 'a' as source, cast(o_orderkey % 12 as varchar) as variation from orders union all select 'b', null from customer) x group by source")
def b9_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources with different columns."""
    a = _t(spark, sf_dir, "orders").select(F.lit("a").alias("source"), (F.col("o_orderkey") % 12).cast("string").alias("variation"))
    b = _t(spark, sf_dir, "customer").select(F.lit("b").alias("source"), "c_custkey")
    return annotated.concat_examples(a, b).groupBy("source").agg(F.count("*").alias("n"), F.count("variation").alias("with_variation"))


# Validation and text.


@query(f"""select error as error_code, case error when 'address_not_found' then 422 when 'invalid_input' then 400 when 'input_too_long' then 400 else 200 end as status_code,
  case error when 'address_not_found' then '{resolve.MESSAGES["address_not_found"]}' when 'invalid_input' then '{resolve.MESSAGES["invalid_input"]}' when 'input_too_long' then '{resolve.MESSAGES["input_too_long"]}' end as error_message,
  count(*) as n from (select {TRUE_ERROR} as error from {M}) x group by 1, 2, 3""")  # fmt: skip
def v3_error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(labelled(spark, sf_dir)).groupBy("error_code", "status_code", "error_message").agg(F.count("*").alias("n"))


@query("""select l_returnflag, count(case when valid then 1 end) as kept, count(case when not valid then 1 end) as dropped from (select l_returnflag, case when l_linenumber = 7 then true when l_linenumber = 6 then false
  else 0 <= a and a < b and b <= 40 and l_partkey % 11 <> 0 end as valid from (select *, l_partkey % 31 - 1 as a, l_partkey % 31 + l_suppkey % 5 as b from lineitem) x) y group by l_returnflag""")  # fmt: skip
def v5_keep_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples whose entities or text are missing, whose numbers come as text and whose spans or labels are wrong."""
    entities = F.expr("array(named_struct('start', cast(l_partkey % 31 - 1 as string), 'end', cast(l_partkey % 31 + l_suppkey % 5 as string), 'label', if(l_partkey % 11 = 0, 'CITY', 'PER')))")
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 6, "x" * 40).alias("text"), F.when(F.col("l_linenumber") != 7, entities).alias("entities"))
    return dataset.keep_drop_counts(dataset.mark_valid(rows), "l_returnflag")


@query("select event_id, event_type as trimmed from events")
def t13_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", tx.trim(F.concat(F.lit(" \t\x1f 　"), "event_type", F.lit(" \n\x85 "))).alias("trimmed"))


@query(f"select message_id, array_to_string(generate_series(0, length(name) - 1), ',') || ',' || cast(length(name) as varchar) || ',' || cast(length(name) as varchar) || ',' || cast(length(name) as varchar) as positions from {M}")
def t10_segmented_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newline that became a space, an underscore, and characters after the raw text's end."""
    word = [F.substring_index("name", " ", 1), F.substring_index(F.substring_index("name", " ", 2), " ", -1), F.substring_index("name", " ", -1)]
    raw, seg = F.concat(word[0], F.lit("\n"), word[1], F.lit(" "), word[2]), F.concat(word[0], F.lit(" "), word[1], F.lit("_"), word[2], F.lit(" ??"))
    return msg.messages(spark, sf_dir).select("message_id", F.array_join(tx.segmented_map(raw, seg).cast("array<string>"), ",").alias("positions"))


@query(f"select message_id, case when k % 2 = 0 then 3 else 2 end as found from {M}")
def t8_locate_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decomposed and confusable spellings: composed text comes before confusables, and gives places in composed text."""
    chunk, surface = F.when(F.col("k") % 2 == 0, "é. Ðé").otherwise("a Ðặng"), F.when(F.col("k") % 2 == 0, "Ðé").otherwise("Đặng")
    return msg.messages(spark, sf_dir).select("message_id", tx.locate_tolerant(chunk, surface, F.lit(0)).alias("found"))


# Phones.


@query(f"""select message_id, ordinal, case when ordinal = 1 then 'shop_context_downrank,positive_phone_context' when v in (1, 11) then 'recipient_associated,positive_phone_context,first_valid_candidate' else 'recipient_associated,first_valid_candidate' end as reasons,
  ordinal = 0 as selected from {M}, (select unnest([0, 1]) as ordinal) o where k % 97 <> 0 and k % 89 <> 0 and v not in (6, 7, 8, 10) and (ordinal = 0 or v = 9)""")  # fmt: skip
def p4_rank_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why accepted phones stand where they do."""
    rows = telemetry(labelled(spark, sf_dir)).select("message_id", F.posexplode_outer("phones").alias("ordinal", "p")).filter("p.accepted")  # outer: no filter that finds phones again
    return rows.select("message_id", "ordinal", F.array_join("p.rank_reasons", ",").alias("reasons"), "p.selected")


def _phone_result(rows: DataFrame) -> DataFrame:
    chosen = phones.selected(F.col("candidates"))
    facts = F.transform("candidates", lambda c: F.struct(c["reject_reason"].isNull().alias("accepted"), c["normalized"].alias("normalized"), c["reject_reason"].alias("reject_reason"), (c["reject_reason"].isNull() & (c["start"] == chosen["start"])).alias("selected")))
    return rows.select(F.col("message_id").alias("id"), F.size(phones.accepted(F.col("candidates"))).alias("phone_count"), chosen["normalized"].alias("phone_number"), F.col("masked").alias("masked_text"), facts.alias("candidates"))


_CASES = "k % 97 <> 0 and k % 89 <> 0 and v in (0, 1, 2, 3, 6, 7, 8)"
_FAULT = "case when k % 10 = 1 then 'phone_count' when k % 10 = 2 then 'candidates' when k % 10 = 3 then 'candidate 0 reject_reason' when k % 10 = 5 then 'phone_number,candidate 0 normalized' else '' end"


@query(f"""select message_id as id, 'layer' || cast(v as varchar) as layer, case when k % 10 = 4 then 'error' when {_FAULT} = '' then 'pass' else 'fail' end as outcome, case when k % 10 = 4 then '' else {_FAULT} end as failures from {M} where {_CASES}""")
def e5_golden_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden phone cases, some with a wrong count, number, candidate list or reason, some without a result."""
    rows = prepare(msg.messages(spark, sf_dir)).filter(_CASES)
    reason = F.when(F.col("k") % 10 == 3, "another").when(F.col("v") == 6, "invalid_length").when(F.col("v") == 7, "legacy_prefix").when(F.col("v") == 8, "context_order_id")
    number = F.when(~F.col("v").isin(6, 7, 8), F.col("phone"))
    good = number.isNotNull()
    one = F.struct(good.alias("accepted"), F.when(F.col("k") % 10 == 5, "0000").otherwise(number).alias("normalized"), reason.alias("reject_reason"), good.alias("selected"))
    expected = rows.select(
        F.col("message_id").alias("id"), F.concat(F.lit("layer"), F.col("v").cast("string")).alias("layer"), (good.cast("int") + (F.col("k") % 10 == 1).cast("int")).alias("phone_count"),
        F.when(F.col("k") % 10 == 5, "0000").otherwise(number).alias("phone_number"), F.when(F.col("v") == 0, F.expr("name || ', [PHONE], ' || addr || ', ' || note")).alias("masked_text"), F.when(F.col("k") % 10 != 2, F.array(one)).alias("candidates"),
    )
    results = metrics.compare_phones(expected, _phone_result(rows.filter("k % 10 <> 4")))
    return results.withColumn("failures", F.array_join("failures", ","))


# Labels and spans.


@query(f"""select message_id, '0-0,0-' || cast(a as varchar) || ',' || cast(a + 1 as varchar) || '-' || cast(a + 3 as varchar) || ',' || cast(a + b + 2 as varchar) || '-' || cast(length(name) as varchar) || ',0-0,0-0' as offsets
  from (select *, length(split_part(name, ' ', 1)) as a, length(split_part(name, ' ', 2)) as b from {M}) x""")  # fmt: skip
def n3_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece marks, a piece that is not in the text, an empty one and special ones."""
    pieces = F.array(F.lit("<s>"), F.concat(F.lit("▁"), F.substring_index("name", " ", 1)), F.lit("zz"), F.concat(F.substring_index("name", " ", -1), F.lit("@@")), F.lit("▁"), F.lit("</s>"))
    found = spans.token_offsets(F.col("name"), pieces)
    return msg.messages(spark, sf_dir).select("message_id", F.array_join(F.transform(found, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offsets"))


@query("select o_orderkey as example_id, '-100,1,2,3,4' || repeat(',0', cast(least(5 + o_orderkey % 7, 6) - 4 as int)) || ',-100' as ids from orders")
def n5_n6_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of units between two special ones, at most eight of them."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    none = "named_struct('start', 0, 'end', 0)"
    units = F.expr(f"concat(array({none}), transform(sequence(1, cast(5 + k % 7 as int)), i -> named_struct('start', 4 * i, 'end', 4 * i + 3)), array({none}))")
    entities = F.expr("array(named_struct('start', 4, 'end', 11, 'label', 'PER'), named_struct('start', 12, 'end', 19, 'label', 'ADDR'), named_struct('start', 4, 'end', 40, 'label', 'NOTE'))")
    outer = F.filter(entities, lambda e: e["label"] != "NOTE")
    return rows.select(F.col("k").alias("example_id"), F.array_join(spans.label_ids(units, outer, 8).cast("array<string>"), ",").alias("ids"))


_REPAIRED = """(select k, i, case when gold like 'I-%' and (coalesce(lag(gold) over w, 'O') = 'O' or substr(lag(gold) over w, 3) <> substr(gold, 3)) then 'B-' || substr(gold, 3) else gold end as label from (
  select k, i, {} as gold from (select o_orderkey as k, unnest(generate_series(1, 5 + o_orderkey % 7)) as i from orders) u) t window w as (partition by k order by i))""".format(_LAB.format("(k * 31 + i * i * 17 + i)"))
_KEPT = f"(select * from {_REPAIRED} r where (k + i) % 4 <> 0)"


@query(f"""select k as example_id, substr(min(label), 3) as type, min(4 * i) as start, max(4 * i + 3) as "end" from (select *, sum(o) over (partition by k order by i) as g from (
  select *, case when label <> 'O' and (label like 'B-%' or coalesce(lag(label) over w, 'O') = 'O' or substr(lag(label) over w, 3) <> substr(label, 3)) then 1 else 0 end as o from {_KEPT} q window w as (partition by k order by i)) a) b
  where label <> 'O' group by k, g""")  # fmt: skip
def n9_tokens_without_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are repaired over all tokens, then tokens without a span are skipped: they do not close an entity."""
    gone = (F.col("example_id") + F.col("tok_idx")) % 4 == 0
    rows = tokens(spark, sf_dir).withColumns({"start": F.when(~gone, F.col("start")), "end": F.when(~gone, F.col("end"))})
    return spans.offline_entities(rows, "gold")


#: Messages whose labels meet the drop rules, one kind each: a name that is called, a stray address word without and with
#: evidence, a sender's name, a note that repeats the address, a quoted note, a note that is the address, a name across a
#: removed block, an address across a phone.
DROPS = f"""select *, case w when 0 then name || ' ơi, giao tới ' || addr when 1 then 'giao tới xanh' when 2 then 'giao tới nhà xanh' when 3 then 'lấy hàng ở ' || name || ', giao ' || addr
  when 4 then name || ', ' || addr || ', ghi chú: ' || addr when 5 then name || ', ' || addr || ', nhớ ghi "' || note || '"' when 6 then 'liên hệ ' || phone || ', ' || addr
  when 7 then split_part(name, ' ', 1) || '<script>x</script> ' || split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 3) || ', ' || addr else 'giao số 5 ' || phone || ' Q1' end as text
  from (select *, cast(k % 9 as int) as w from ({msg.PARTS}) x) y"""


@query(f"""select message_id, case when w in (4, 5) then name end as recipient_name, case when w = 6 then phone end as phone_number, case when w = 2 then 'nhà xanh' when w not in (1, 8) then addr end as address_raw,
  case when w = 5 then note end as note, case when w in (1, 8) then 'address_not_found' end as error_code from ({DROPS}) d""")  # fmt: skip
def n11_r4_drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that drops or promotes a span, and every rule that leaves a field empty."""
    rows = prepare(spark.sql(DROPS.replace("from orders", "from {orders}"), orders=msg.dealt_keys(spark, sf_dir, msg.TASK_MESSAGES)))
    quote = F.when(F.col("w") == 4, F.concat(F.lit("ghi chú: "), "addr")).when(F.col("w") == 5, F.concat(F.lit('nhớ ghi "'), "note", F.lit('"'))).when(F.col("w") == 6, F.col("addr")).otherwise("-none-")
    place = F.when(F.col("w") == 1, "xanh").when(F.col("w") == 2, "nhà xanh").when(F.col("w") == 8, "số 5 [PHONE] Q1").when(F.col("w") == 6, "-none-").otherwise(F.col("addr"))
    found = spans.label_units(F.col("masked"), known_entities(F.col("masked"), {"PER": F.col("name"), "ADDR": place, "NOTE": quote}))
    stray = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), F.regexp_replace(t["label"], "^B-", "I-").alias("label")))
    rows = rows.withColumn("tokens", F.when(F.col("w").isin(1, 2), stray).otherwise(found))
    return parse(rows, promote=True).select("message_id", "recipient_name", "phone_number", "address_raw", "note", "error_code")


@query(f"""select message_id, error is null and v in (0, 1, 2, 3, 4, 5, 7, 9) as recipient_name_present, error is null and {TRUE_PHONE} is not null as phone_number_present, error is null as address_raw_present,
  error is null and v in (0, 1) as note_present from (select *, {TRUE_ERROR} as error from {M}) x""")  # fmt: skip
def r6_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(parse(labelled(spark, sf_dir)))


# Dataset accounts.


def _keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of b1_b2_responses; every 11th lacks the label of its last entity."""
    return _responses(spark, sf_dir).withColumn("response_text", F.when(F.col("response_id") % 11 == 0, F.regexp_replace("response_text", ',"label":"ADDR"', "")).otherwise(F.col("response_text")))


_GOOD = "o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0"
_REASON = "case when o_orderkey % 5 = 0 then 'substring not found' when o_orderkey % 3 = 0 then 'overlap' end"


@query(f"select o_orderkey as response_id, {_REASON} as reason from orders where {_GOOD}")
def b1_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example that lacks a key drops its whole answer."""
    return dataset.examples_from_responses(_keyless(spark, sf_dir)).select("response_id", "reason")


_REPORT = f"""count(*) as answers, count(case when {_GOOD} then 1 end) as parsed, cast(sum(case when {_GOOD} and {_REASON} is null then 1 else 0 end) as bigint) as valid,
  cast(sum(case when {_GOOD} and {_REASON} is not null then 1 else 0 end) as bigint) as rejected, cast(sum(o_orderkey % 900) as bigint) as input_tokens, cast(sum(o_orderkey % 700) as bigint) as output_tokens,
  round(sum(case when {_GOOD} and {_REASON} is not null then 1 else 0 end) / sum(case when {_GOOD} then 1 else 0 end), 9) as reject_rate, {_COST} as cost from orders"""


@query(f"select o_orderkey % 12 as variation, {_REPORT} group by 1 union all select null, {_REPORT}")
def b3_generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.generation_report(_keyless(spark, sf_dir))
    return out.select("variation", "answers", "parsed", "valid", "rejected", "input_tokens", "output_tokens", F.round("reject_rate", 9).alias("reject_rate"), F.round("cost", 9).alias("cost"))


@query(f"select event_id, split_part('{'|'.join(dataset.VARIATIONS)}', '|', cast(event_id % 12 as int) + 1) as variation from events")
def b4_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", dataset.variation(F.col("event_id")).alias("variation"))


@query(f"""select k as line_no, '{{"text":"' || name || ', ' || addr || '","entities":[{{"substring":"' || name || '","label":"PER"}},{{"substring":"' || addr || '","label":"ADDR"}}]}}' as example from {P} order by k limit 12""")
def b5_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve examples, as a prompt shows them."""
    return dataset.few_shot(annotated_parts(spark, sf_dir).withColumnRenamed("k", "line_no"))


_VALID_SPLIT = SPLIT.replace("from documents) d)", "from documents where doc_id % 13 <> 0) d)")


@query(f"""select * from (select count(case when s then 1 end) as seed_total, count(case when not s then 1 end) as synth_total, count(case when s and v then 1 end) as seed_valid, count(case when not s and v then 1 end) as synth_valid,
  count(case when s and not v then 1 end) as seed_dropped, count(case when not s and not v then 1 end) as synth_dropped from (select doc_id in (select doc_id from labels) as s, doc_id % 13 <> 0 as v from documents) x) a,
  (select count(case when split = 'train' then 1 end) as train, count(case when split = 'val' then 1 end) as val, count(case when split = 'test' then 1 end) as test, count(case when split = 'val' and is_seed then 1 end) as val_seed,
  count(case when split = 'test' and is_seed then 1 end) as test_seed, count(case when split = 'val' and not is_seed then 1 end) as val_synth, count(case when split = 'test' and not is_seed then 1 end) as test_synth from {_VALID_SPLIT} s) b""")  # fmt: skip
def b7_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _examples(spark, sf_dir).withColumn("valid", F.col("id") % 13 != 0)
    return dataset.split_report(marked, dataset.split(marked.filter("valid"), 7))


@query(f"select split, count(case when is_seed then 1 end) as seed, count(case when not is_seed then 1 end) as synth from {SPLIT} s group by split")
def b7_split_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_pivot(dataset.split(_examples(spark, sf_dir), 7))


# Golden cases and service runs.

_OUTCOME = "case k % 8 when 0 then 'skip' when 1 then 'error' when 2 then 'error' when 7 then 'pass' else 'fail' end"


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden cases and answers by arithmetic: a case without text, a broken request, no answer, and each kind of failure."""
    k = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    expected = k.selectExpr(
        "k as id", "'layer' || cast(k % 3 as string) as layer", "if(k % 8 = 0, null, 'x') as text", "if(k % 16 = 15, null, 200) as http_status", "if(k % 8 = 3, 'not_there', null) as error_code", "map('note', null, 'address_raw', 'a') as response",
        "k % 8 = 5 as forbidden_empty_strings", "if(k % 8 = 6, array('debug', 'other'), null) as forbidden_response_fields",
    )
    actual = k.filter("k % 8 <> 2").selectExpr(
        "k as id", "if(k % 8 = 1, null, if(k % 8 = 3, 500, 200)) as status_code", "if(k % 8 = 3, 'internal_error', null) as error_code", "if(k % 8 = 1, 'ReadTimeout', null) as error",
        "map('note', null, 'address_raw', if(k % 8 = 4, 'b', 'a'), 'phone_number', if(k % 8 in (5, 7), '', '1'), if(k % 8 = 6, 'debug', 'free'), 'd') as body",
    )
    return metrics.compare_api(expected, actual)


@query(f"""select k as id, 'layer' || cast(k % 3 as varchar) as layer, {_OUTCOME} as outcome, case k % 8 when 3 then 'status,error code' when 4 then 'field address_raw' when 5 then 'empty phone_number' when 6 then 'forbidden debug' else '' end as failures
  from (select o_orderkey as k from orders) x where k % 8 > 2 or k % 8 = 0
  union all select k, 'layer' || cast(k % 3 as varchar), 'error', 'status' from (select o_orderkey as k from orders) x where k % 8 in (1, 2)""")  # fmt: skip
def e4_golden_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(spark, sf_dir).withColumn("failures", F.array_join("failures", ","))


_TOTALS = ", ".join(f"count(case when {_OUTCOME} = '{o}' then 1 end) as n_{o}" for o in ("pass", "fail", "skip", "error"))


@query(f"select 'layer' || cast(k % 3 as varchar) as layer, count(*) as total, {_TOTALS} from (select o_orderkey as k from orders) x group by 1 union all select null, count(*), {_TOTALS} from (select o_orderkey as k from orders) x")
def e6_outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.outcome_totals(_golden(spark, sf_dir))


@query(f"select k as id, {_OUTCOME} as outcome from (select o_orderkey as k from orders) x where k % 8 not in (0, 7)")
def e6_failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.failed_cases(_golden(spark, sf_dir))


_KIND = "case when error is not null or status_code is null then 'exception' when status_code between 400 and 499 then 'input_error' when status_code >= 500 then 'server_error' else 'success' end"
_MS = "case when error is null and status_code is not null then elapsed_ms end"


@query(f"""select count(*) as total, {", ".join(f"count(case when {_KIND} = '{k}' then 1 end) as {k}" for k in ("success", "input_error", "server_error", "exception"))}, min({_MS}) as min_ms, round(avg({_MS}), 6) as mean_ms,
  quantile_disc({_MS}, 0.5) as p50, quantile_disc({_MS}, 0.95) as p95, quantile_disc({_MS}, 0.99) as p99, max({_MS}) as max_ms from {REQUESTS} r""")  # fmt: skip
def e11_feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_summary(requests(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 6))


def _listing(kinds: str) -> str:
    return f"select event_id as case_id, status_code, error from {REQUESTS} r where {_KIND} in ({kinds})"


@query(_listing("'input_error'"))
def e11_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_listing(requests(spark, sf_dir).withColumnRenamed("event_id", "case_id"), "input_error").select("case_id", "status_code", "error")


@query(_listing("'server_error', 'exception'"))
def e11_server_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_listing(requests(spark, sf_dir).withColumnRenamed("event_id", "case_id"), "server_error", "exception").select("case_id", "status_code", "error")
