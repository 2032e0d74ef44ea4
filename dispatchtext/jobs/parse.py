"""Parse messages in bulk: validate, sanitize, find phones, label, assemble, resolve. No shuffle.

Every step is an in-row column, so the same functions run on batch tables and streams. Labels come as an
array of tokens over the masked text (or are made from known entities); a scorer plugs in by score_tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import phones, resolve, spans
from ..functions import text as tx
from ..functions.payload import decode_payload  # noqa: F401  (a step of the same job)

MAX_CHARS = 5000
#: Tokens that a model sees of a text, its two marks included; texts scored at a time.
POSITIONS = 512
SCORED_TOGETHER = 32
#: Bytes of text whose tokens are held at a time, as Python objects some 100 times as large.
SCORED_BYTES = 1 << 20


def validate(text: Column, debug: Column | None = None, debug_allowed: bool = True, scorer_ready: bool = True, max_chars: int = MAX_CHARS) -> Column:
    """Error code of a message, null if it is good; the first failing rule wins. The length is that of the raw text."""
    out = F.when(text.isNull() | (F.length(tx.trim(text)) == 0), "invalid_input").when(F.length(text) > max_chars, "input_too_long")
    if debug is not None and not debug_allowed:
        out = out.when(F.coalesce(debug, F.lit(False)), "debug_not_allowed")
    return out if scorer_ready else out.when(F.lit(True), "model_not_ready")


def prepare(messages: DataFrame) -> DataFrame:
    """Adds error_code, sanitized, phone candidates and masked text; rejected rows are not sanitized (the length bounds the patterns)."""
    rows = messages.withColumn("error_code", validate(F.col("text")))
    rows = rows.withColumn("raw", F.when(F.col("error_code").isNull(), F.col("text")))
    rows = rows.withColumn("sanitized", tx.sanitize(F.col("raw"))).withColumn("candidates", phones.candidates(F.col("sanitized")))
    return rows.withColumn("masked", phones.mask(F.col("sanitized"), F.col("candidates")))


def phone_columns(rows: DataFrame) -> DataFrame:
    chosen = phones.selected(F.col("candidates"))
    return rows.withColumn("phone_number", chosen["normalized"]).withColumn("phone_count", F.size(phones.accepted(F.col("candidates"))))


def known_entities(masked: Column, surfaces: dict[str, Column]) -> Column:
    """Entities of known surfaces by label, where they occur (the first place counts)."""
    found = [F.struct((F.call_function("locate", s, masked) - 1).alias("start"), (F.call_function("locate", s, masked) - 1 + F.length(s)).alias("end"), F.lit(n).alias("label")) for n, s in surfaces.items()]
    return F.filter(F.array(*found), lambda e: e["start"] >= 0)


PRESENT = ("recipient_name", "phone_number", "address_raw", "note")


def presence(results: DataFrame) -> DataFrame:
    """message_id and whether each field of a result is there; of telemetry, so no text."""
    return results.select("message_id", *[F.col(c).isNotNull().alias(f"{c}_present") for c in PRESENT])


def located(rows: DataFrame, *keep: str) -> DataFrame:
    """prepare()'s rows with `tokens` to the candidates that no rule drops, per, addr and notes, in places of the raw text."""
    steps = tx.removal_steps(F.col("raw"))
    rows = rows.select("message_id", "raw", "sanitized", "candidates", "masked", "tokens", "error_code", *keep, *[s.alias(f"step{i}") for i, s in enumerate(steps)])
    steps = [F.col(f"step{i}") for i in range(3)]
    rows = phone_columns(rows).withColumn("pieces", spans.assemble(F.col("tokens"))).withColumn("masks", phones.masked_spans(F.col("candidates")))
    rows = rows.withColumn("blocks", tx.raw_blocks(steps))

    def back(pos: Column) -> Column:
        sanitized = phones.unmask_position(pos, F.col("candidates"), F.length("sanitized"), F.length("masked"))
        return tx.to_raw(sanitized, steps, F.length("sanitized"))

    rows = rows.withColumn("placed", spans.placed(F.col("pieces"), F.col("raw"), back, F.col("masks"), F.col("blocks")))
    rows = rows.select("*", *[c.alias(n) for n, c in spans.by_type(F.col("placed"), F.col("raw")).items()])
    return rows.withColumn("notes", spans.drop_notes_on_addresses(F.col("note"), F.col("addr")))


def parse(rows: DataFrame, promote: bool = False) -> DataFrame:
    """prepare()'s rows with `tokens` to one result each: message_id, four fields, phone_count, status_code, error_code, error_message.

    An invalid phone never fails a message. promote: where no address was labelled, notes that look like one count.
    """
    rows = located(rows)
    if promote:
        rows = rows.withColumns({"addr": spans.promote_notes(F.col("addr"), F.col("notes")), "notes": spans.unpromoted_notes(F.col("addr"), F.col("notes"))})
    rows = rows.withColumn("address", resolve.address(F.col("addr")))
    rows = rows.withColumn("error_code", F.coalesce("error_code", F.when(F.col("address").isNull(), "address_not_found")))
    good = F.col("error_code").isNull()
    return rows.select(
        "message_id",
        F.when(good, resolve.recipient(F.col("per"), F.col("raw"))).alias("recipient_name"), F.when(good, F.col("phone_number")).alias("phone_number"),
        F.when(good, F.col("address")).alias("address_raw"), F.when(good, resolve.note(F.col("notes"), F.col("address"))).alias("note"),
        resolve.status(F.col("error_code")).alias("status_code"), "error_code", resolve.error_message(F.col("error_code")).alias("error_message"),
    )


def telemetry(rows: DataFrame) -> DataFrame:
    """Counts and offsets of prepared rows with `tokens`, no text: message_id, n_chars, n_lines, actions, removed_count, phone_count, phones, spans.

    spans: label, start and end in the raw text of the candidates that no rule drops, names first, then addresses, then notes.
    """
    rows = located(rows, "text")
    chosen = phones.selected(F.col("candidates"))["start"]

    def facts(at: Column) -> Column:
        return F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["reject_reason"].isNull().alias("accepted"), F.coalesce(c["start"] == at, F.lit(False)).alias("selected"), c["reject_reason"].alias("reject_reason"), phones.rank_reasons(c, at).alias("rank_reasons")))

    def places(label: str, found: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end")))

    return rows.select(
        "message_id", F.length("text").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        tx.sanitize_actions(F.col("raw")).alias("actions"), (F.length("raw") - F.length("sanitized")).alias("removed_count"),
        F.size(phones.accepted(F.col("candidates"))).alias("phone_count"), tx.let(chosen, facts).alias("phones"),
        F.concat(places("PER", "per"), places("ADDR", "addr"), places("NOTE", "notes")).alias("spans"),
    )


def _slices(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about `limit` bytes of masked text, one row at least."""
    limit, start, held = limit or SCORED_BYTES, 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("masked")), 0).to_pylist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def score_tokens(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], positions: int = POSITIONS, batch: int = SCORED_TOGETHER) -> DataFrame:
    """Adds `tokens` by a scorer: load() runs once per Python worker and returns texts -> token rows (start, end, token, label).

    Rows without masked text (rejected ones) get no tokens and never reach the scorer. Within a slice of about
    SCORED_BYTES, texts go to the scorer in order of length, `batch` at a time, so that little is padding; rows keep their order. A model sees `positions`
    tokens, two of them its own marks: tokens beyond are dropped.
    """
    kind, held = T.ArrayType(T.StructType.fromDDL(spans.TOKEN[7:-1])), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in _slices(b)):
            texts = piece.column("masked").to_pylist()
            order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
            tokens: list[list[dict]] = [[] for _ in texts]
            if order and not held:
                held.append(load())
            for low in range(0, len(order), batch):
                together = order[low : low + batch]
                for i, found in zip(together, held[0]([texts[i] for i in together])):
                    tokens[i] = found[: positions - 2]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(tokens, to_arrow_type(kind))], [*piece.schema.names, "tokens"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("tokens", kind)]))
