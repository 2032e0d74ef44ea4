"""Phone numbers in messages: find, judge, rank, mask, map positions. All in-row arrays, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty, fold_accents, match_spans

#: The candidate pattern, the looser pattern of generated texts, mask, prefixes and cue words.
CANDIDATE = r"(?U)(?<!\d)\(?(?:\+?84|0)(?:[ \t\-.()]*\d){7,11}(?!\d)\)?"
GENERATED = r"(?U)(?<!\d)(?:\+?84|0)[\s.\-()]*[3-9](?:[\s.\-()]*\d){8}(?!\d)"
MASK = "[PHONE]"
MOBILE = ("03", "05", "07", "08", "09")
HOUSE, ORDER = ("nha so", "so nha"), ("ma don", "ma van don")
SHOP, POSITIVE = "shop", ("sdt", "dt", "phone", "lien he")
JUDGE_WINDOW, RANK_WINDOW = 20, 25


def _window(text: Column, start: Column, size: int) -> Column:
    before = F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size)))
    return fold_accents(F.lower(before))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def normalize(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"(?U)\D", ""), "^84", "0")


def candidates(text: Column) -> Column:
    """array of start, end, raw_text, normalized, reject_reason (null: accepted), is_shop, positive."""
    def read(c: Column) -> Column:  # number and windows are looked at several times, and made once
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), normalize(c["text"]).alias("number"),
            _window(text, c["start"], JUDGE_WINDOW).alias("near"), _window(text, c["start"], RANK_WINDOW).alias("wide"),
        )

    def judge(c: Column) -> Column:
        number, near, wide = c["number"], c["near"], c["wide"]
        reason = (
            F.when(number.startswith("012"), "legacy_prefix")
            .when(~F.substring(number, 1, 2).isin(*MOBILE), "unsupported_non_mobile")
            .when(F.length(number) != 10, "invalid_length")
            .when(_any(near, HOUSE), "context_house_number")
            .when(_any(near, ORDER), "context_order_id")
        )
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("raw_text"), number.alias("normalized"), reason.alias("reject_reason"),
            F.contains(wide, F.lit(SHOP)).alias("is_shop"), _any(wide, POSITIVE).alias("positive"),
        )

    return F.transform(F.transform(match_spans(text, CANDIDATE), read), judge)


def accepted(cands: Column) -> Column:
    return F.filter(cands, lambda c: c["reject_reason"].isNull())


def selected(cands: Column) -> Column:
    """The accepted candidate without a shop before it, then the earliest; null if none."""
    return F.array_min(F.transform(accepted(cands), lambda c: F.struct(c["is_shop"].alias("is_shop"), c["start"].alias("start"), c["normalized"].alias("normalized"))))


def rank_reasons(c: Column, chosen_start: Column) -> Column:
    """Why an accepted candidate stands where it does, in order; empty for rejected ones."""
    names = F.array_compact(
        F.array(
            F.when(c["is_shop"], "shop_context_downrank").otherwise("recipient_associated"), F.when(c["positive"], F.lit("positive_phone_context")), F.when(c["start"] == chosen_start, F.lit("first_valid_candidate"))
        )
    )
    return F.when(c["reject_reason"].isNull(), names).otherwise(empty("string"))


def mask(text: Column, cands: Column) -> Column:
    """Text with every accepted span replaced by the mask."""
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, c["start"] - acc["pos"])
        return F.struct(c["end"].alias("pos"), F.concat(acc["out"], kept, F.lit(MASK)).alias("out"))

    return F.aggregate(accepted(cands), zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def masked_spans(cands: Column) -> Column:
    """Where the masks stand in the masked text."""
    zero = F.struct(F.lit(0).alias("shift"), empty("struct<start:int,end:int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        start = c["start"] + acc["shift"]
        span = F.struct(start.alias("start"), (start + len(MASK)).alias("end"))
        return F.struct((acc["shift"] + len(MASK) - (c["end"] - c["start"])).alias("shift"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(accepted(cands), zero, step, lambda acc: acc["out"])


def unmask_position(pos: Column, cands: Column, size: Column, masked_size: Column) -> Column:
    """Masked position to sanitized position; inside a mask, spread over the phone's characters."""
    zero = F.struct(F.lit(0).alias("grown"), F.lit(None).cast("int").alias("hit"))

    def inner(p: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            begin = c["start"] - acc["grown"]
            length = c["end"] - c["start"]
            inside = (p >= begin) & (p < begin + len(MASK))
            hit = F.when(acc["hit"].isNotNull(), acc["hit"]).when(inside, c["start"] + F.floor((p - begin) * (length - 1) / (len(MASK) - 1)).cast("int"))
            grown = F.when(p >= begin + len(MASK), acc["grown"] + length - len(MASK)).otherwise(acc["grown"])
            return F.struct(grown.cast("int").alias("grown"), hit.cast("int").alias("hit"))

        return F.aggregate(accepted(cands), zero, step, lambda acc: F.coalesce(acc["hit"], p + acc["grown"]))

    return F.when(masked_size == 0, pos).when(pos < 0, F.lit(0)).when(pos >= masked_size, inner(masked_size - 1) + 1).otherwise(inner(pos))


def mask_generated(text: Column) -> Column:
    """The looser rule for generated texts: no context, separators may hold newlines."""
    return F.regexp_replace(text, GENERATED, MASK)
