"""Token labels to spans. In-row array forms for serving; window forms over long tables for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import UNIT, WORD, empty, leading_blanks, let, match_spans, trim

#: The label set by id, the id of positions that do not count, special tokens, and the words that are
#: evidence of an address.
IGNORE = -100
SPECIALS = ("<s>", "</s>", "<pad>", "<unk>", "[CLS]", "[SEP]", "[PAD]")
LABELS = ("O", "B-PER", "I-PER", "B-ADDR", "I-ADDR", "B-NOTE", "I-NOTE")
TYPES = ("PER", "ADDR", "NOTE")
ADDRESS_WORDS = (
    "số", "nhà", "ngõ", "ngách", "hẻm", "đường", "phố", "thôn", "xóm", "ấp", "xã", "phường", "quận", "huyện", "tỉnh", "thành phố",
    "tp", "q1", "q2", "q3", "chung cư", "tòa", "lô",
)
TOKEN = "struct<start:int,end:int,token:string,label:string>"
PIECE = "struct<label:string,start:int,end:int,has_b:boolean>"
CANDIDATE = "struct<start:int,end:int,text:string>"


def decode_logits(logits: Column) -> Column:
    """Label of the largest logit, the first on ties; ids beyond the label set give O."""
    best = F.array_position(logits, F.array_max(logits)).cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, LABELS)), F.when(best > 0, best)), F.lit("O"))


def bio_label(unit: Column, entities: Column) -> Column:
    """Label of a unit (start, end) by containment in entities (array of start, end, label); the first entity that holds it wins."""
    held = F.filter(entities, lambda e: (unit["start"] >= e["start"]) & (unit["end"] <= e["end"]))
    return let(F.get(held, 0), lambda e: F.when(e.isNull(), "O").otherwise(F.concat(F.when(unit["start"] == e["start"], "B-").otherwise("I-"), e["label"])))


def label_units(text: Column, entities: Column) -> Column:
    """Words and marks of text as tokens with their labels."""
    def label(held: Column) -> Column:  # entities are found once a row, not once a unit
        return F.transform(match_spans(text, UNIT), lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("token"), bio_label(u, held).alias("label")))

    return let(entities, label)


def word_units(text: Column) -> Column:
    """Spans of runs without white space."""
    return match_spans(text, WORD)


def label_ids(units: Column, entities: Column, most: int = 256) -> Column:
    """Ids of the labels of units (array of start, end), IGNORE for units without width; of more than `most` units the first ones and the last stay."""
    cut = F.when(F.size(units) > most, F.concat(F.slice(units, 1, most - 1), F.slice(units, -1, 1))).otherwise(units)
    return F.transform(cut, lambda u: F.when(u["start"] == u["end"], F.lit(IGNORE)).otherwise(F.array_position(F.array(*map(F.lit, LABELS)), bio_label(u, entities)).cast("int") - 1))


def token_offsets(text: Column, tokens: Column, specials: tuple[str, ...] = SPECIALS) -> Column:
    """start, end of tokens that come without offsets: piece marks dropped, white space skipped; special and empty pieces have none.

    A piece that is not found takes the next characters, as many as it has.
    """
    def step(acc: Column, t: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(t, "^▁", ""), "@@$", "")
        none = t.isin(*specials) | (word == "")
        at = acc["pos"] + leading_blanks(F.substring(text, acc["pos"] + 1, F.length(text)))
        found = F.call_function("locate", word, text, at + 1) - 1
        start = F.when(found >= 0, found).otherwise(F.least(at, F.length(text)))
        end = F.least(start + F.length(word), F.length(text))
        span = F.when(none, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(F.when(none, acc["pos"]).otherwise(end).alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), empty("struct<start:int,end:int>").alias("out"))
    return F.aggregate(tokens, zero, step, lambda acc: acc["out"])


def assemble(tokens: Column) -> Column:
    """Serving rule: O closes, B opens, I of the same type extends, any other I opens a span without a B."""
    zero = F.struct(F.lit(None).cast(PIECE).alias("cur"), empty(PIECE).alias("out"))

    def flush(acc: Column) -> Column:
        return F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))

    def step(acc: Column, t: Column) -> Column:
        kind, prefix = F.substring(t["label"], 3, 100), F.substring(t["label"], 1, 2)
        extends = (prefix == "I-") & F.coalesce(acc["cur"]["label"] == kind, F.lit(False))
        opened = F.struct(kind.alias("label"), t["start"].alias("start"), t["end"].alias("end"), (prefix == "B-").alias("has_b"))
        longer = F.struct(acc["cur"]["label"].alias("label"), acc["cur"]["start"].alias("start"), t["end"].alias("end"), acc["cur"]["has_b"].alias("has_b"))
        cur = F.when(t["label"] == "O", F.lit(None).cast(PIECE)).when(extends, longer).otherwise(opened)
        return F.struct(cur.cast(PIECE).alias("cur"), F.when(extends, acc["out"]).otherwise(flush(acc)).cast(f"array<{PIECE}>").alias("out"))

    return F.aggregate(tokens, zero, step, flush)


def chunk_set(tokens: Column, label: str = "label") -> Column:
    """Strict chunks (type, first, last) of an array of tokens with tok_idx and a label, in order, folded within the row.

    The rule of strict_chunks: a B label opens a chunk, I labels of its type extend it; what opens without a B is none.
    """
    kind = "struct<type:string,first:bigint,last:bigint>"
    zero = F.struct(F.lit(None).cast("string").alias("type"), F.lit(False).alias("strict"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), empty(kind).alias("out"))

    def closed(acc: Column) -> Column:
        chunk = F.struct(acc["type"].alias("type"), acc["first"].alias("first"), acc["last"].alias("last"))
        return F.when(acc["strict"], F.concat(acc["out"], F.array(chunk))).otherwise(acc["out"])

    def step(acc: Column, t: Column) -> Column:
        own, at = F.when(t[label] != "O", F.substring(t[label], 3, 100)), t["tok_idx"].cast("bigint")
        on = F.coalesce(~t[label].startswith("B-") & (acc["type"] == own), F.lit(False))
        return F.struct(
            own.alias("type"), F.when(on, acc["strict"]).otherwise(F.coalesce(t[label].startswith("B-"), F.lit(False))).alias("strict"),
            F.when(on, acc["first"]).otherwise(at).alias("first"), at.alias("last"), F.when(on, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    return F.aggregate(tokens, zero, step, closed)


def overlaps(start: Column, end: Column, others: Column) -> Column:
    return F.exists(others, lambda o: F.greatest(start, o["start"]) < F.least(end, o["end"]))


def address_evidence(text: Column) -> Column:
    return F.lower(text).rlike("(?U)\\d|" + "|".join(ADDRESS_WORDS))


def vocative(text: Column, raw: Column, end: Column) -> Column:
    after = F.lower(F.substring(raw, end + 1, 10))
    return F.lower(text).endswith(" ơi") | after.startswith(" ơi") | after.startswith("oi")


def candidates(pieces: Column, raw: Column, to_raw, masks: Column, blocks: Column) -> dict[str, Column]:
    """Candidates by type from assembled spans: mapped to raw text, bounded, trimmed, drop rules applied."""
    return by_type(placed(pieces, raw, to_raw, masks, blocks), raw)


def placed(pieces: Column, raw: Column, to_raw, masks: Column, blocks: Column) -> Column:
    """Assembled spans mapped to raw text, bounded and trimmed, without those that masks or blocks touch: label, has_b, start, end, text."""
    # Positions and cuts are fields of their own arrays: each is evaluated once a span.
    def bound(p: Column) -> Column:
        return F.struct(p["label"].alias("label"), p["has_b"].alias("has_b"), overlaps(p["start"], p["end"], masks).alias("masked"), to_raw(p["start"]).alias("low"), to_raw(p["end"]).alias("high"))

    def cut(p: Column) -> Column:
        inside = (p["low"] >= 0) & (p["high"] <= F.length(raw)) & (p["low"] < p["high"]) & ~p["masked"]
        return F.struct(p["label"].alias("label"), p["has_b"].alias("has_b"), inside.alias("inside"), p["low"].alias("low"), F.substring(raw, p["low"] + 1, p["high"] - p["low"]).alias("cut"))

    def place(p: Column) -> Column:
        return F.struct(p["label"].alias("label"), p["has_b"].alias("has_b"), p["inside"].alias("inside"), (p["low"] + leading_blanks(p["cut"])).alias("start"), trim(p["cut"]).alias("text"))

    def close(p: Column) -> Column:
        good = p["inside"] & (F.length(p["text"]) > 0)
        return F.struct(p["label"].alias("label"), p["has_b"].alias("has_b"), good.alias("good"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text"))

    out = pieces
    for step in (bound, cut, place, close):
        out = F.transform(out, step)
    return F.filter(out, lambda c: c["good"] & ~overlaps(c["start"], c["end"], blocks))


def by_type(placed: Column, raw: Column) -> dict[str, Column]:
    """per, addr and note of placed spans. Each reads `placed`, which is therefore best a column of its own."""
    def plain(found: Column) -> Column:
        return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))

    per = plain(F.filter(placed, lambda c: (c["label"] == "PER") & ~vocative(c["text"], raw, c["end"])))
    addr = plain(F.filter(placed, lambda c: (c["label"] == "ADDR") & (c["has_b"] | address_evidence(c["text"]))))
    note = plain(F.filter(placed, lambda c: c["label"] == "NOTE"))
    return {"per": per, "addr": addr, "note": note}


def drop_notes_on_addresses(note: Column, addr: Column) -> Column:
    return F.filter(note, lambda n: ~overlaps(n["start"], n["end"], addr))


def promote_notes(addr: Column, note: Column) -> Column:
    """Addresses, or where there is none the notes with address evidence."""
    return F.when(F.size(addr) > 0, addr).otherwise(F.filter(note, lambda n: address_evidence(n["text"])))


def unpromoted_notes(addr: Column, note: Column) -> Column:
    """Notes that are left when those with address evidence became addresses."""
    return F.when(F.size(addr) > 0, note).otherwise(F.filter(note, lambda n: ~address_evidence(n["text"])))


# Long form: example_id, tok_idx, start, end, label.


def repair_iob2(tokens: DataFrame, label: str = "label") -> DataFrame:
    """I-X after O, the start or another type becomes B-X. Repair keeps types, so the neighbour's type is enough."""
    w = Window.partitionBy("example_id").orderBy("tok_idx")
    kind = F.when(F.col(label) != "O", F.substring(label, 3, 100))
    before = F.lag(kind).over(w)
    fixed = F.when(F.col(label).startswith("I-") & ~F.coalesce(before == kind, F.lit(False)), F.concat(F.lit("B-"), kind)).otherwise(F.col(label))
    return tokens.withColumn(label, fixed)


def islands(tokens: DataFrame, label: str = "label") -> DataFrame:
    """example_id, type, start, end, first_tok, last_tok, has_b by the serving rule: gaps and islands on one window."""
    w = Window.partitionBy("example_id").orderBy("tok_idx")
    kind = F.when(F.col(label) != "O", F.substring(label, 3, 100))
    opens = F.when(kind.isNotNull() & (F.col(label).startswith("B-") | ~F.coalesce(F.lag(kind).over(w) == kind, F.lit(False))), 1).otherwise(0)
    marked = tokens.withColumn("type", kind).withColumn("opens", opens)
    numbered = marked.withColumn("island", F.sum("opens").over(w)).filter("type is not null")
    return numbered.groupBy("example_id", "island", "type").agg(
        F.min_by("start", "tok_idx").alias("start"), F.max_by("end", "tok_idx").alias("end"), F.max("end").alias("reach"),
        F.min("tok_idx").alias("first_tok"), F.max("tok_idx").alias("last_tok"), F.min_by(F.col(label).startswith("B-"), "tok_idx").alias("has_b"),
    )


def offline_entities(tokens: DataFrame, label: str = "label") -> DataFrame:
    """Offline rule: labels repaired over all tokens, tokens without a span skipped, the end is the largest end."""
    kept = repair_iob2(tokens, label).filter("start is not null and end is not null")
    return islands(kept, label).select("example_id", "type", "start", F.col("reach").alias("end"))


def strict_chunks(tokens: DataFrame, label: str = "label") -> DataFrame:
    """Evaluation rule: only spans that begin with a B label."""
    return islands(tokens, label).filter("has_b").select("example_id", "type", "first_tok", "last_tok")
