"""The library's operators as queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phones, spans
from ..functions import text as tx
from ..operators import dataset, metrics
from . import messages as msg
from .parse import decode_payload, known_entities, parse, phone_columns, prepare, telemetry, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


M = f"({msg.MESSAGES}) m"
#: What the composed values say about phone and error of a message.
TRUE_PHONE = "case when k % 97 = 0 or k % 89 = 0 or v in (6, 7, 8, 10) then null else phone end"
TRUE_ERROR = "case when k % 97 = 0 then 'invalid_input' when k % 89 = 0 then 'input_too_long' when v = 11 then 'address_not_found' end"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(msg.messages(spark, sf_dir))
    return rows.withColumn("tokens", spans.label_units(F.col("masked"), known_entities(F.col("masked"), {"PER": F.col("name"), "ADDR": F.col("addr"), "NOTE": F.col("note")})))


@query(f"""select message_id, case when error is null and v not in (0, 1, 2, 3, 4, 5, 7, 9) then null when error is null then name end as recipient_name,
  case when error is null then {TRUE_PHONE} end as phone_number, case when error is null then addr end as address_raw,
  case when error is null and v in (0, 1) then note end as note, case error when 'address_not_found' then 422 when 'invalid_input' then 400 when 'input_too_long' then 400 else 200 end as status_code,
  error as error_code from (select *, {TRUE_ERROR} as error from {M}) x""")  # fmt: skip
def r5_parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(labelled(spark, sf_dir)).drop("error_message")


@query(f"""select count(*) as n, avg(case when e is null and v in (0,1,2,3,4,5,7,9) then 1.0 else 0.0 end) as name_rate, avg(case when e is null and {TRUE_PHONE} is not null then 1.0 else 0.0 end) as phone_rate,
  avg(case when e is null then 1.0 else 0.0 end) as address_rate, avg(case when e is null and v in (0, 1) then 1.0 else 0.0 end) as note_rate from (select *, {TRUE_ERROR} as e from {M}) x""")  # fmt: skip
def r7_field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (("name_rate", "recipient_name"), ("phone_rate", "phone_number"), ("address_rate", "address_raw"), ("note_rate", "note"))
    return parse(labelled(spark, sf_dir)).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(n) for n, c in pairs])


@query(f"""select message_id, {TRUE_PHONE} as phone_number, case when k % 97 = 0 or k % 89 = 0 then null when v = 9 then 2 when {TRUE_PHONE} is null then 0 else 1 end as phone_count,
  case when k % 97 = 0 or k % 89 = 0 then null when v = 0 then name || ', [PHONE], ' || addr || ', ' || note when v = 1 then 'Tên: ' || name || ' | ĐT: [PHONE] | Địa chỉ: ' || addr || ' | Ghi chú: ' || note
  when v = 2 then name || chr(10) || '[PHONE]' || chr(10) || addr when v in (3, 4) then name || ', [PHONE], ' || addr when v = 5 then name || ', [PHONE], ' || addr
  when v = 9 then name || ' [PHONE], liên hệ shop [PHONE], giao tới ' || addr when v = 10 then ' ship tới ' || addr when v = 11 then 'tên ' || name || ', sdt [PHONE]' else text end as masked_text from {M}""")  # fmt: skip
def p1_p6_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phone_columns(prepare(msg.messages(spark, sf_dir)))
    return rows.select("message_id", "phone_number", F.when(F.col("raw").isNotNull(), F.col("phone_count")).alias("phone_count"), F.col("masked").alias("masked_text"))


@query(f"""select reason, cast(sum(n) as bigint) as n from (select case v when 6 then 'invalid_length' when 7 then 'legacy_prefix' when 8 then 'context_order_id' else 'accepted' end as reason,
  case when v = 9 then 2 when v = 10 then 0 else 1 end as n from {M} where k % 97 <> 0 and k % 89 <> 0) x group by reason""")  # fmt: skip
def p9_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(msg.messages(spark, sf_dir)).select(F.explode_outer("candidates").alias("c")).filter("c is not null")  # no filter that finds candidates again
    return rows.groupBy(F.coalesce("c.reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select message_id, regexp_replace(text, '(\\+?84|0)[\\s.()\\-]*[3-9]([\\s.()\\-]*[0-9]){{8}}', '[PHONE]', 'g') as masked from {M}")
def p8_generator_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.messages(spark, sf_dir).select("message_id", phones.mask_generated(F.col("text")).alias("masked"))


@query(f"""select message_id, length(text) as n_chars, case when v = 2 and k % 97 <> 0 and k % 89 <> 0 then 3 else 1 end as n_lines,
  case when k % 97 = 0 or k % 89 = 0 then null when v = 10 then 'strip_script,strip_control_chars' else '' end as actions, case when k % 97 = 0 or k % 89 = 0 then null when v = 10 then 26 else 0 end as removed_count from {M}""")  # fmt: skip
def r6_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(labelled(spark, sf_dir))
    return t.select("message_id", "n_chars", "n_lines", F.when(F.col("removed_count").isNotNull(), F.array_join("actions", ",")).alias("actions"), "removed_count")


@query("""select error_code, count(*) as n from (select case when text is null or trim(text) = '' then 'invalid_input' when length(text) > 5000 then 'input_too_long' else 'ok' end as error_code from documents) x group by 1""")
def v1_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy(F.coalesce(validate(F.col("text")), F.lit("ok")).alias("error_code")).agg(F.count("*").alias("n"))


@query("""select event_id, case when event_id % 4 in (1, 2) then null else event_type end as text, case when event_id % 4 in (1, 2) then null else event_id % 4 = 3 end as debug,
  case when event_id % 4 in (1, 2) then 'invalid_input' end as error_code from events""")  # fmt: skip
def v2_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """case event_id % 4 when 0 then '{"text":"' || event_type || '"}' when 1 then '{"debug":true}' when 2 then '{"text":"' || event_type || '","x":1}' else '{"text":"' || event_type || '","debug":true}' end"""
    text, debug, error = decode_payload(F.col("payload"))
    return _t(spark, sf_dir, "events").select("event_id", F.expr(body).alias("payload")).select("event_id", text.alias("text"), debug.alias("debug"), error.alias("error_code"))


@query("""select page_id, length(s) as n_chars, md5(s) as digest, length(html) - length(s) as removed_count from (select page_id, html,
  regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') as s from pages) x""")  # fmt: skip
def t1_t3_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.sanitize(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", F.length(s).alias("n_chars"), F.md5(s).alias("digest"), (F.length("html") - F.length(s)).alias("removed_count"))


@query("""select page_id, position(regexp_extract(html, '(?is)<script[^>]*>.*?</script>') in html) - 1 as start, position(regexp_extract(html, '(?is)<script[^>]*>.*?</script>') in html) - 1 + length(regexp_extract(html, '(?is)<script[^>]*>.*?</script>')) as "end"
  from pages where html like '%<script%'""")  # fmt: skip
def t4_block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.get(tx.match_spans(F.col("html"), tx.SCRIPT), 0)
    return _t(spark, sf_dir, "pages").filter("html like '%<script%'").select("page_id", found["start"].alias("start"), found["end"].alias("end"))


def block_spans(pages: DataFrame) -> DataFrame:
    """page_id, kind, ordinal (from 0 by kind), start and end in html of every removed script and style block."""
    rows = pages.select("page_id", *[s.alias(f"s{i}") for i, s in enumerate(tx.removal_steps(F.col("html")))])
    rows = rows.select("page_id", F.size("s0").alias("scripts"), F.posexplode_outer(tx.raw_blocks([F.col(f"s{i}") for i in range(3)])).alias("at", "block"))
    style = F.col("at") >= F.col("scripts")
    return rows.filter("block is not null").select(  # outer: no filter that finds the blocks again
        "page_id", F.when(style, "style").otherwise("script").alias("kind"), (F.col("at") - F.when(style, F.col("scripts")).otherwise(0)).alias("ordinal"),
        F.col("block.start").alias("start"), F.col("block.end").alias("end"),
    )


def _cut(source: str, tag: str) -> str:
    """Matches f of a block pattern in html of source, the stretches g between them, and what is left as html."""
    pattern = f"'(?is)<{tag}[^>]*>.*?</{tag}>'"
    return f"(select *, array_to_string(g, '') as rest from (select *, regexp_extract_all(html, {pattern}) as f, string_split_regex(html, {pattern}) as g from {source}) x)"


def _blocks(source: str) -> str:
    """One row per match: ordinal, place a and size in the text that was matched, place kept in what is left."""
    return f"""(select *, cast(i - 1 as int) as ordinal, kept + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as a, length(f[i]) as size from (
      select *, list_sum(list_transform(g[1:i], lambda x: length(x))) as kept from (select *, unnest(generate_series(1, len(f))) as i from {source}) u) v)"""


_SCRIPTS = _blocks(_cut("pages", "script"))
_STYLES = _blocks(_cut(f"(select page_id, rest as html from {_cut('pages', 'script')} y)", "style"))
_RAW = "{} + coalesce((select sum(scripts.size) from scripts where scripts.page_id = styles.page_id and scripts.kept <= {}), 0)"


@query(f"""with scripts as (select page_id, ordinal, kept, a, size from {_SCRIPTS} w), styles as (select page_id, ordinal, a, size from {_STYLES} w)
  select page_id, 'script' as kind, ordinal, cast(a as int) as start, cast(a + size as int) as "end" from scripts
  union all select page_id, 'style', ordinal, cast({_RAW.format("styles.a", "styles.a")} as int), cast({_RAW.format("styles.a + styles.size - 1", "styles.a + styles.size - 1")} + 1 as int) from styles""")  # fmt: skip
def t4_all_block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_spans(_t(spark, sf_dir, "pages"))


@query(f"""select message_id, length(addr) as n_chars, cast(case when seen then position(addr in text) - 1 end as int) as raw_start, cast(case when seen then position(addr in text) - 1 + length(addr) end as int) as raw_end
  from (select *, k % 97 <> 0 and k % 89 <> 0 and v <> 11 as seen from {M}) x""")  # fmt: skip
def t5_p7_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare(msg.messages(spark, sf_dir))
    rows = rows.select("*", *[s.alias(f"s{i}") for i, s in enumerate(tx.removal_steps(F.col("raw")))])
    at = F.call_function("locate", F.col("addr"), F.col("masked")) - 1

    def back(p):
        inner = phones.unmask_position(p, F.col("candidates"), F.length("sanitized"), F.length("masked"))
        return F.when(at >= 0, tx.to_raw(inner, [F.col(f"s{i}") for i in range(3)], F.length("sanitized")))

    return rows.select("message_id", F.length("addr").alias("n_chars"), back(at).alias("raw_start"), back(at + F.length("addr")).alias("raw_end"))


@query(f"select message_id, replace(replace(strip_accents(name || ' ' || addr), 'đ', 'd'), 'Đ', 'D') as folded from {M}")
def t6_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.messages(spark, sf_dir).select("message_id", tx.fold_accents(F.concat_ws(" ", "name", "addr")).alias("folded"))


@query(f"select message_id, name as folded from {M}")
def t7_fold_confusables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.messages(spark, sf_dir).select("message_id", tx.fold_confusables(F.translate("name", "Đđ", "Ðð")).alias("folded"))


@query(f"select message_id, cast(case when k % 97 = 0 or k % 89 = 0 then null when v in (0, 2, 3, 4, 5, 7, 9) then 0 when v = 1 then 5 when v = 11 then 4 end as int) as found from {M}")
def t8_locate_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without accents and case in the messages."""
    plain = F.lower(tx.fold_accents(F.col("name")))
    return msg.messages(spark, sf_dir).select("message_id", tx.locate_tolerant(F.col("text"), plain, F.lit(0)).alias("found"))


@query(f"""select message_id, replace(name, ' ', '_') || '|' || name || '|' || replace(name, ' ', '') || '|' || split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) || split_part(name, ' ', 3)
  || '|' || split_part(name, ' ', 1) || split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 3) as surfaces from {M}""")  # fmt: skip
def t9_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msg.messages(spark, sf_dir).select("message_id", F.array_join(tx.surfaces(F.translate("name", " ", "_")), "|").alias("surfaces"))


@query(f"""select message_id, cast(length(split_part(name, ' ', 1)) + length(split_part(name, ' ', 2)) + 4 as int) as start, cast(length(name) + 2 as int) as "end" from {M}""")
def t10_t11_segmented_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of segmented names in raw names with doubled spaces."""
    rows = msg.messages(spark, sf_dir).select("message_id", F.replace("name", F.lit(" "), F.lit("  ")).alias("raw"), F.translate("name", " ", "_").alias("seg"))
    rows = rows.withColumn("positions", tx.segmented_map(F.col("raw"), F.col("seg")))
    start = F.length("seg") - F.length(F.substring_index("seg", "_", -1))
    return rows.select("message_id", tx.segmented_span(start, F.length("seg"), F.col("positions"), F.length("raw")).alias("s")).select("message_id", "s.start", "s.end")


@query("select event_id, event_type || '-│┌=X' || '\\n' || cast(event_id as varchar) as line from events")
def t12_clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m─│┌═✗↵"), F.col("event_id").cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", tx.clean_log(styled).alias("line"))


@query("select doc_id, cast(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as int) as n_units from documents")
def n4_word_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(spans.word_units(F.col("text"))).alias("n_units"))


@query("""select vec_id, ['O','B-PER','I-PER','B-ADDR','I-ADDR','B-NOTE','I-NOTE'][list_position(e, list_max(e))] as label from (select vec_id, embedding[1:7] as e from embeddings) x""")
def n2_decode_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", spans.decode_logits(F.slice("embedding", 1, 7)).alias("label"))


_LAB = "split_part('O|B-PER|I-PER|B-ADDR|I-ADDR|B-NOTE|I-NOTE', '|', cast({} % 7 as int) + 1)"
_GOLD_AT = "(k * 31 + i * i * 17 + i)"
_PRED_AT = "(k * 31 + i * i * 17 + i + case when (k + i) % 5 = 0 then 1 else 0 end)"
_GOLD, _PRED = _LAB.format(_GOLD_AT), _LAB.format(_PRED_AT)
TOKENS = f"(select k as example_id, i as tok_idx, {_GOLD} as gold, {_PRED} as pred from (select o_orderkey as k, unnest(generate_series(1, 5 + o_orderkey % 7)) as i from orders) u)"


#: Examples (of 8 tokens on average) that one task holds.
TASK_EXAMPLES = 50_000


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, tok_idx, start, end, gold, pred: label sequences from arithmetic on order keys."""
    def label(at: str) -> Column:
        return F.element_at(F.array(*map(F.lit, spans.LABELS)), F.expr(f"cast({at} % {len(spans.LABELS)} as int)") + 1)

    # Keys are dealt out first: a small file is one split. The tokens of an example stay in its task, so windows over examples move none.
    keys = msg.dealt_keys(spark, sf_dir, TASK_EXAMPLES, "o_orderkey").select(F.col("o_orderkey").alias("k"))
    rows = keys.select("k", F.explode(F.sequence(F.lit(1).cast("long"), 5 + F.col("k") % 7)).alias("i"))
    return rows.select(F.col("k").alias("example_id"), F.col("i").alias("tok_idx"), (4 * F.col("i")).alias("start"), (4 * F.col("i") + 3).alias("end"), label(_GOLD_AT).alias("gold"), label(_PRED_AT).alias("pred"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same label sequences with the tokens of an example in one row: example_id, tokens (tok_idx, gold, pred)."""
    k, names = F.col("example_id"), F.array(*map(F.lit, spans.LABELS))

    def token(i: Column) -> Column:
        at = k * 31 + i * i * 17 + i
        gold, pred = (F.element_at(names, (x % len(spans.LABELS) + 1).cast("int")) for x in (at, at + F.when((k + i) % 5 == 0, 1).otherwise(0)))
        return F.struct(i.alias("tok_idx"), gold.alias("gold"), pred.alias("pred"))

    keys = msg.dealt_keys(spark, sf_dir, TASK_EXAMPLES).select(F.col("o_orderkey").alias("example_id"))
    return keys.select("example_id", F.transform(F.sequence(F.lit(1).cast("long"), 5 + k % 7), token).alias("tokens"))


def _islands(label: str) -> str:
    return f"""(select example_id, substr({label}, 3) as type, min(tok_idx) as first_tok, max(tok_idx) as last_tok, bool_or(tok_idx = f and {label} like 'B-%') as has_b from (select *, min(tok_idx) over (partition by example_id, g) as f from (
      select *, sum(o) over (partition by example_id order by tok_idx) as g from (select *, case when {label} <> 'O' and ({label} like 'B-%' or coalesce(lag({label}) over w, 'O') = 'O' or substr(lag({label}) over w, 3) <> substr({label}, 3)) then 1 else 0 end as o
      from {TOKENS} t window w as (partition by example_id order by tok_idx)) a) b where {label} <> 'O') c group by example_id, g, substr({label}, 3))"""


@query(f"""select example_id, tok_idx, case when gold like 'I-%' and (coalesce(lag(gold) over w, 'O') = 'O' or substr(lag(gold) over w, 3) <> substr(gold, 3)) then 'B-' || substr(gold, 3) else gold end as label
  from {TOKENS} t window w as (partition by example_id order by tok_idx)""")  # fmt: skip
def n7_repair_iob2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repair_iob2(tokens(spark, sf_dir), "gold").select("example_id", "tok_idx", F.col("gold").alias("label"))


@query(f'select example_id, type, 4 * first_tok as start, 4 * last_tok + 3 as "end", has_b from {_islands("gold")} i')
def n8_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.islands(tokens(spark, sf_dir), "gold").select("example_id", "type", "start", "end", "has_b")


@query(f'select example_id, type, 4 * first_tok as start, 4 * last_tok + 3 as "end" from {_islands("gold")} i')
def n9_offline_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.offline_entities(tokens(spark, sf_dir), "gold")


@query(f"select example_id, type, first_tok, last_tok from {_islands('pred')} i where has_b")
def e1_strict_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.strict_chunks(tokens(spark, sf_dir), "pred")


_GP = f"(select coalesce(g.type, p.type) as type, g.type as gt, p.type as pt from (select * from {_islands('gold')} i where has_b) g full join (select * from {_islands('pred')} i where has_b) p on p.example_id = g.example_id and p.type = g.type and p.first_tok = g.first_tok and p.last_tok = g.last_tok)"
_PER = f"(select type, count(case when gt is not null and pt is not null then 1 end) as tp, count(gt) as n_gold, count(pt) as n_pred from {_GP} x group by type)"
_ALL = f"(select * from {_PER} a union all select 'micro', cast(sum(tp) as bigint), cast(sum(n_gold) as bigint), cast(sum(n_pred) as bigint) from {_PER} b)"
_SCORED = f"(select *, 2 * precision * recall / (precision + recall) as f1 from (select *, tp / n_pred as precision, tp / n_gold as recall from {_ALL} c) d)"


E2 = f"""select type, cast(tp as bigint) as tp, n_gold, n_pred, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1 from {_SCORED} s
  union all select 'macro', cast(sum(tp) as bigint), cast(sum(n_gold) as bigint), cast(sum(n_pred) as bigint), round(avg(precision), 9), round(avg(recall), 9), round(avg(2 * precision * recall / (precision + recall)), 9) from {_SCORED} s where type <> 'micro'"""


@query(E2)
def e2_entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of examples that hold their tokens: no shuffle but that of the sums."""
    scores = metrics.score_table(metrics.scored_examples(token_rows(spark, sf_dir)))
    return scores.select("type", "tp", "n_gold", "n_pred", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(E2)
def e2_scores_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of tokens that are rows: they meet once, by example."""
    return metrics.entity_scores(tokens(spark, sf_dir)).select("type", "tp", "n_gold", "n_pred", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"select count(*) as n, round(avg(case when gold = pred then 1.0 else 0.0 end), 9) as accuracy from {TOKENS} t")
def e3_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_accuracy(tokens(spark, sf_dir)).select("n", F.round("accuracy", 9).alias("accuracy"))


REQUESTS = """(select event_id, case event_type when 'error' then 500 when 'signup' then null when 'view' then 400 else 200 end as status_code, value as elapsed_ms,
  case when event_type = 'signup' then 'ReadTimeout' end as error, 'mode' || cast(user_id % 4 as varchar(9)) as mode from events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"select * from {REQUESTS.replace('from events', 'from {e}')} r", e=_t(spark, sf_dir, "events"))


_DONE = "case when error is null and status_code is not null then elapsed_ms end"


@query(f"""select mode, count(*) as total, count({_DONE}) as completed, count(case when error is null and status_code between 200 and 299 then 1 end) as success,
  count(case when error is not null or status_code is null or status_code >= 300 then 1 end) as failed, round(count(*) / 60.0, 6) as rps, min({_DONE}) as min_ms, round(avg({_DONE}), 6) as mean_ms,
  quantile_disc({_DONE}, 0.5) as p50, quantile_disc({_DONE}, 0.9) as p90, quantile_disc({_DONE}, 0.95) as p95, quantile_disc({_DONE}, 0.99) as p99, max({_DONE}) as max_ms from {REQUESTS} r group by mode""")  # fmt: skip
def e7_e8_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_summary(requests(spark, sf_dir), 60.0, ["mode"]).withColumns({"rps": F.round("rps", 6), "mean_ms": F.round("mean_ms", 6)})


@query(f"select coalesce(cast(status_code as varchar), 'error') as status, count(*) as n from {REQUESTS} r group by 1")
def e9_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_histogram(requests(spark, sf_dir))


@query(f"""select category, count(*) as n, quantile_disc({_DONE}, 0.95) as p95_ms, count({_DONE}) as completed from (select *, case when error is not null or status_code is null then 'exception' when status_code between 400 and 499 then 'input_error'
  when status_code >= 500 then 'server_error' else 'success' end as category from {REQUESTS} r) x group by category""")  # fmt: skip
def e10_e11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_audit(requests(spark, sf_dir))


@query(f"select v, count(*) as n_passed, 0 as n_failed from {M} group by v union all select null, count(*), 0 from {M}")
def e4_e6_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    truth = rows.select(F.col("message_id").alias("id"), "v", F.expr(TRUE_ERROR).alias("error_code"), "name", F.expr(TRUE_PHONE).alias("phone_number"), F.col("addr").alias("address_raw"))
    truth = truth.withColumn("status_code", F.when(F.col("error_code").isNull(), 200).when(F.col("error_code") == "address_not_found", 422).otherwise(400))
    results = metrics.compare_results(truth, parse(rows).withColumnRenamed("message_id", "id"), ["phone_number", "address_raw"])
    return metrics.pass_totals(results.join(truth.select("id", "v"), "id"), "v").withColumn("n_failed", F.col("n_failed").cast("int"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return _t(spark, sf_dir, "documents").join(seeds, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", F.coalesce("hit", F.lit(False)).alias("is_seed"))


SPLIT = """(select id, text, is_seed, case when is_seed and r < n_test then 'test' when r - case when is_seed then n_test else 0 end < n_val then 'val' else 'train' end as split from (
  select *, row_number() over (partition by is_seed order by md5(cast(id as varchar) || '|7'), id) - 1 as r, greatest(cast(floor((count(case when is_seed then 1 end) over ()) * 0.2) as bigint), 1) as n_test,
  greatest(cast(floor((count(*) over ()) * 0.1 / 2) as bigint), 1) as n_val from (select doc_id as id, text, doc_id in (select doc_id from labels) as is_seed from documents) d) e)"""


@query(f"select id, is_seed, split from {SPLIT} s")
def b6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(_examples(spark, sf_dir), 7).select("id", "is_seed", "split")


@query(f"select split, is_seed, count(*) as n from {SPLIT} s group by 1, 2")
def b7_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(_examples(spark, sf_dir), 7).groupBy("split", "is_seed").agg(F.count("*").alias("n"))


@query(f"""select split, count(*) as n, round(avg(length(text)), 6) as mean_chars, round(quantile_cont(cast(length(text) as double), 0.95), 6) as p95_chars,
  sum(case when length(text) > 0 then 1 else 0 end) as n_per, 0 as n_addr, sum(case when length(text) > 1 then 1 else 0 end) as n_note from {SPLIT} s group by split""")  # fmt: skip
def b8_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = F.expr("filter(array(named_struct('start', 0, 'end', 1, 'label', 'PER'), named_struct('start', 1, 'end', 2, 'label', 'NOTE')), e -> e.end <= length(text))")
    stats = dataset.dataset_stats(dataset.split(_examples(spark, sf_dir), 7).withColumn("entities", entities))
    return stats.withColumns({"mean_chars": F.round("mean_chars", 6), "p95_chars": F.round("p95_chars", 6)})


@query("""select l_orderkey, l_linenumber, l_partkey, case when a < 0 or a >= b or b > 40 or c < 0 or c >= d or d > 40 or greatest(a, c) < least(b, d) or (a = c) then false else l_partkey % 11 <> 0 end as valid
  from (select l_orderkey, l_linenumber, l_partkey, l_partkey % 31 - 1 as a, l_partkey % 31 + l_suppkey % 5 as b, l_suppkey % 37 as c, l_suppkey % 37 + l_partkey % 6 as d from lineitem) x""")  # fmt: skip
def v4_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = F.expr("""array(named_struct('start', cast(l_partkey % 31 - 1 as int), 'end', cast(l_partkey % 31 + l_suppkey % 5 as int), 'label', if(l_partkey % 11 = 0, 'CITY', 'PER')),
      named_struct('start', cast(l_suppkey % 37 as int), 'end', cast(l_suppkey % 37 + l_partkey % 6 as int), 'label', 'ADDR'))""")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("x" * 40).alias("text"), entities.alias("entities"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", dataset.is_valid(F.col("text"), F.col("entities")).alias("valid"))


@query("""select o_orderkey as response_id, cast(0 as int) as ordinal, o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 as valid, case when o_orderkey % 5 = 0 then 'substring not found' when o_orderkey % 3 = 0 then 'overlap' end as reason from orders where o_orderkey % 7 <> 0""")
def b1_b2_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.examples_from_responses(_responses(spark, sf_dir)).select("response_id", "ordinal", "valid", "reason")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers by arithmetic: every 7th broken, every 5th with a substring that is not there, every 3rd with a repeated one."""
    second = "if(o_orderkey % 5 = 0, 'Cara', if(o_orderkey % 3 = 0, 'An', 'Q1'))"
    body = f"""'```json\\n{{"examples":[{{"text":"An 0912345678 Q1","entities":[{{"substring":"An","label":"PER"}},{{"substring":"' || {second} || '","label":"ADDR"}}]}}]}}\\n```'"""
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey as response_id", f"if(o_orderkey % 7 = 0, 'sorry', {body}) as response_text", "o_orderkey % 12 as variation", "o_orderkey % 900 as input_tokens", "o_orderkey % 700 as output_tokens", "o_orderkey % 50 as cache_read", "o_orderkey % 20 as cache_write")
    return rows


_COST = "round(sum((o_orderkey % 900 + 1.25 * (o_orderkey % 20) + 0.1 * (o_orderkey % 50)) + (o_orderkey % 700) * 5.0) / 1e6, 9)"


@query(f"select o_orderkey % 12 as variation, count(*) as n, {_COST} as cost from orders group by 1 union all select null, count(*), {_COST} from orders")
def b3_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.sum(dataset.generation_cost(*[F.col(c).cast("double") for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")]))
    return _responses(spark, sf_dir).rollup("variation").agg(F.count("*").alias("n"), F.round(cost, 9).alias("cost"))
