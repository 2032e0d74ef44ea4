"""Fields of one message from its candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Cues of a sender, the window they count in, prefixes of notes in order of trial.
PICKUP = ("lấy hàng ở", "shop ở", "kho ở", "bên gửi", "người gửi", "lấy tại", "lấy ở")
WINDOW = 40
NOTE_PREFIXES = ("nhớ ghi ", "ghi chú: ", "ghi chú ", "ghi: ", "note: ", "note ", "chú ý: ", "chú ý ")
STATUS = {"invalid_input": 400, "input_too_long": 400, "debug_not_allowed": 403, "address_not_found": 422, "model_not_ready": 503, "internal_error": 500}
MESSAGES = {
    "invalid_input": "text must not be empty", "input_too_long": "text is too long", "debug_not_allowed": "debug output is disabled",
    "address_not_found": "no address was found", "model_not_ready": "no scorer is loaded", "internal_error": "internal error",
}


def status(code: Column) -> Column:
    out = F.when(code.isNull(), 200)
    for name, value in STATUS.items():
        out = out.when(code == name, value)
    return out


def error_message(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        out = F.when(code == name, text).otherwise(out)
    return out


def address(addr: Column) -> Column:
    """The first candidate; null if there is none or it is blank."""
    return F.nullif(trim(F.get(addr, 0)["text"]), F.lit(""))


def recipient(per: Column, raw: Column) -> Column:
    def good(c: Column) -> Column:
        near = F.lower(F.substring(raw, F.greatest(c["start"] - WINDOW, F.lit(0)) + 1, F.least(c["start"], F.lit(WINDOW))))
        return (F.length(trim(c["text"])) > 0) & ~near.rlike("|".join(PICKUP))

    return trim(F.get(F.filter(per, good), 0)["text"])


def clean_note(text: Column) -> Column:
    """First double-quoted, else single-quoted content, else the text without a leading prefix; trimmed."""
    plain = trim(text)
    double, single = F.regexp_extract(plain, '"([^"]+)"', 1), F.regexp_extract(plain, "'([^']+)'", 1)
    cut = plain
    for prefix in reversed(NOTE_PREFIXES):
        rest = F.regexp_replace(F.substring(plain, len(prefix) + 1, 1 << 30), r"^[ \-:|,]+|[ \-:|,]+$", "")
        cut = F.when(F.lower(plain).startswith(prefix), rest).otherwise(cut)
    return F.when(double != "", trim(double)).when(single != "", trim(single)).otherwise(cut)


def note(notes: Column, addr: Column) -> Column:
    """The first cleaned note that is not empty and neither holds nor is held by the address."""
    good = F.filter(F.transform(notes, lambda n: clean_note(n["text"])), lambda t: (F.length(t) > 0) & ~F.contains(addr, t) & ~F.contains(t, addr))
    return F.get(good, 0)
