"""Annotated examples: validity, offsets from model responses, merge and split, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phones import mask_generated
from ..functions.spans import TYPES
from ..functions.text import let, trim
from .order_statistics import with_percentiles

ENTITY = "struct<start:int,end:int,label:string>"
RESPONSE = "examples array<struct<text:string,entities:array<struct<substring:string,label:string>>>>"
#: The order in which generation variations take turns, and prices per million tokens.
VARIATIONS = (
    "labels_explicit", "separator_only", "conversational", "multiline_simple", "messy_lowercase", "quoted_note",
    "address_only", "name_phone_only", "with_product_info", "landmark_address", "sender_vs_recipient", "multi_phone",
)
PRICE_IN, PRICE_OUT, CACHE_WRITE, CACHE_READ = 1.0, 5.0, 1.25, 0.1


def normalize_example(text: Column, entities: Column) -> tuple[Column, Column]:
    """Missing text to empty, missing entities to none, numbers and labels coerced."""
    kept = F.transform(entities, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["label"].cast("string").alias("label")))
    return F.coalesce(text, F.lit("")), F.coalesce(kept, F.expr(f"cast(array() as array<{ENTITY}>)"))


def no_overlap(ordered: Column) -> Column:
    """Neighbours in a sorted array of spans do not overlap; touching is fine."""
    later = F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1)))
    return F.forall(F.arrays_zip(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))).alias("a"), later.alias("b")), lambda z: z["b"]["start"] >= z["a"]["end"])


def is_valid(text: Column, entities: Column) -> Column:
    """Bounds, known labels and no overlap; no entities is valid."""
    good = F.forall(entities, lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)) & e["label"].isin(*TYPES))
    return F.coalesce(good & no_overlap(F.array_sort(entities)), F.lit(False))


def mark_valid(examples: DataFrame) -> DataFrame:
    """examples with text and entities normalised and a column `valid`."""
    text, entities = normalize_example(F.col("text"), F.col("entities"))
    return examples.withColumns({"text": text, "entities": entities}).withColumn("valid", is_valid(F.col("text"), F.col("entities")))


def keep_drop_counts(marked: DataFrame, *keys: str) -> DataFrame:
    """kept and dropped by key; the good rows themselves are marked.filter("valid")."""
    return marked.groupBy(*keys).agg(F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("dropped"))


def variation(batch: Column) -> Column:
    """The generation variation of a batch number: they take turns."""
    return F.element_at(F.array(*map(F.lit, VARIATIONS)), F.pmod(batch, F.lit(len(VARIATIONS))).cast("int") + 1)


def few_shot(examples: DataFrame, n: int = 12) -> DataFrame:
    """line_no and `example` (JSON of the text and each entity's substring and label) of the first n examples by line_no."""
    pairs = F.transform("entities", lambda e: F.struct(F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]).alias("substring"), e["label"].alias("label")))
    first = examples.select("line_no", "text", "entities").orderBy("line_no").limit(n)
    return first.select("line_no", F.to_json(F.struct("text", pairs.alias("entities"))).alias("example"))


def response_json(response: Column) -> Column:
    """The JSON object in a model's answer: fences around the whole answer dropped, else from the first to the last brace."""
    plain = trim(response)
    bare = F.when(plain.startswith("```"), F.regexp_replace(F.regexp_replace(plain, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(plain)
    held = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(bare.startswith("{") | (held == ""), bare).otherwise(held)


def response_examples(response: Column) -> Column:
    """Array of text (masked), entities (start, end, label, by place) and reason (null: valid) of a model's answer.

    Null if the answer is no JSON object or an example lacks a key: such an answer counts for nothing. No examples
    give an empty array. The first occurrence of each substring counts, so repeated substrings overlap. An entity
    that is not found rejects its example before later entities are looked at.
    """

    def place(e: Column, text: Column) -> Column:
        start = F.call_function("locate", e["substring"], text) - 1
        return F.struct(start.alias("start"), (start + F.length(e["substring"])).alias("end"), e["label"].alias("label"))

    def judge(x: Column) -> Column:
        places = F.array_sort(F.transform(x["entities"], lambda e: place(e, x["text"])))
        lost = F.exists(places, lambda e: e["start"] < 0)
        reason = F.when(lost, "substring not found").when(~no_overlap(places), "overlap")
        return F.struct(x["text"].alias("text"), places.alias("entities"), reason.alias("reason"))

    def lacks_key(x: Column) -> Column:
        no_key = lambda e: e.isNull() | e["substring"].isNull() | e["label"].isNull()
        decides = F.filter(x["entities"], lambda e: no_key(e) | (F.call_function("locate", e["substring"], x["text"]) == 0))
        return x.isNull() | x["text"].isNull() | x["entities"].isNull() | F.coalesce(let(F.get(decides, 0), lambda e: F.when(F.size(decides) > 0, no_key(e))), F.lit(False))

    def judged(body: Column) -> Column:
        found = F.coalesce(body["examples"], F.expr("cast(array() as array<struct<text:string,entities:array<struct<substring:string,label:string>>>>)"))
        masked = F.transform(found, lambda x: F.struct(mask_generated(x["text"]).alias("text"), x["entities"].alias("entities")))
        return let(masked, lambda m: F.when(~F.exists(m, lacks_key), F.transform(m, judge)))

    text = response_json(response)
    body = F.when(text.startswith("{"), F.from_json(text, RESPONSE))
    return let(body, lambda b: F.when(b.isNotNull() & F.json_object_keys(text).isNotNull(), judged(b)))


def examples_from_responses(responses: DataFrame) -> DataFrame:
    """response_id, ordinal, text (masked), entities, reason, valid: one row per example; an answer that does not parse has none."""
    rows = responses.select("response_id", F.posexplode_outer(response_examples(F.col("response_text"))).alias("ordinal", "x")).filter("x is not null")  # outer: no filter that reads answers again
    return rows.select("response_id", "ordinal", "x.text", "x.entities", "x.reason", F.col("x.reason").isNull().alias("valid"))


def generation_cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column) -> Column:
    return ((tokens_in + CACHE_WRITE * cache_write + CACHE_READ * cache_read) * PRICE_IN + tokens_out * PRICE_OUT) / 1e6


def generation_report(responses: DataFrame, key: str = "variation") -> DataFrame:
    """By key and in all (key null): answers, answers that parsed, valid and rejected examples, reject rate, token sums, cost.

    The cost takes in answers that do not parse.
    """
    usage = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    rows = responses.select(key, *usage, response_examples(F.col("response_text")).alias("x"))
    rows = rows.select(key, *usage, F.col("x").isNotNull().alias("good"), F.size(F.filter("x", lambda e: e["reason"].isNull())).alias("v"), F.size(F.filter("x", lambda e: e["reason"].isNotNull())).alias("r"))
    sums = rows.rollup(key).agg(
        F.count("*").alias("answers"), F.count_if("good").alias("parsed"), F.sum(F.when(F.col("good"), F.col("v")).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("good"), F.col("r")).otherwise(0)).alias("rejected"), *[F.sum(c).alias(c) for c in usage],
    )
    tried = F.col("valid") + F.col("rejected")
    cost = generation_cost(*[F.col(c).cast("double") for c in usage])
    return sums.withColumn("reject_rate", F.when(tried > 0, F.col("rejected") / tried).otherwise(0.0)).withColumn("cost", cost)


def split(examples: DataFrame, seed: int, test_ratio: float = 0.2, val_ratio: float = 0.1) -> DataFrame:
    """Adds `split` to rows with id and is_seed: exact sizes, order by md5 of id and seed.

    The test set comes from seed rows only. Ranks are exact without a window over a whole source: a bucket
    per leading four hex digits, prefix sums over at most 65536 buckets a source, ranks inside a bucket.
    """
    hashed = examples.withColumn("_h", F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}")))).withColumn("_b", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("is_seed", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("is_seed").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy(F.lit(0))  # of at most 2 * 65536 bucket sizes
    n_seed, n_all = F.sum(F.when(F.col("is_seed"), F.col("_n")).otherwise(0)).over(everything), F.sum("_n").over(everything)
    n_test, n_val = (F.greatest(F.floor(x), F.lit(1)) for x in (n_seed * test_ratio, n_all * val_ratio / 2))
    sizes = sizes.select("is_seed", "_b", before.alias("_base"), n_test.alias("_test"), n_val.alias("_val"))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy("is_seed", "_b").orderBy("_h", "id")) - 1
    ranked = hashed.join(sizes, ["is_seed", "_b"]).withColumn("_rank", rank)
    skip = F.when(F.col("is_seed"), F.col("_test")).otherwise(0)
    part = F.when(F.col("is_seed") & (F.col("_rank") < F.col("_test")), "test").when(F.col("_rank") - skip < F.col("_val"), "val").otherwise("train")
    return ranked.withColumn("split", part).drop("_h", "_b", "_base", "_rank", "_test", "_val")


def split_report(marked: DataFrame, parted: DataFrame) -> DataFrame:
    """One row: total, valid and dropped of seed and synthetic rows (marked: is_seed, valid), and sizes of the parts (parted: is_seed, split)."""
    sources = marked.agg(
        *[F.count_if(who).alias(f"{n}_total") for n, who in (("seed", F.col("is_seed")), ("synth", ~F.col("is_seed")))],
        *[F.count_if(who & F.col("valid")).alias(f"{n}_valid") for n, who in (("seed", F.col("is_seed")), ("synth", ~F.col("is_seed")))],
        *[F.count_if(who & ~F.col("valid")).alias(f"{n}_dropped") for n, who in (("seed", F.col("is_seed")), ("synth", ~F.col("is_seed")))],
    )
    parts = parted.agg(
        *[F.count_if(F.col("split") == p).alias(p) for p in ("train", "val", "test")],
        *[F.count_if((F.col("split") == p) & F.col("is_seed")).alias(f"{p}_seed") for p in ("val", "test")],
        *[F.count_if((F.col("split") == p) & ~F.col("is_seed")).alias(f"{p}_synth") for p in ("val", "test")],
    )
    one = F.lit(1).alias("_one")
    return sources.select(one, "*").join(parts.select(one, "*"), "_one").drop("_one")  # one row each


def split_pivot(parted: DataFrame) -> DataFrame:
    """Rows of each part by source: split, seed, synth."""
    return parted.groupBy("split").agg(F.count_if("is_seed").alias("seed"), F.count_if(~F.col("is_seed")).alias("synth"))


def dataset_stats(examples: DataFrame) -> DataFrame:
    """Per split: n, mean and 95th percentile (interpolated) of characters, entities per label."""
    def count(kind: str) -> Column:
        return F.sum(F.size(F.filter("entities", lambda e: e["label"] == kind))).alias(f"n_{kind.lower()}")

    per_label = [count(t) for t in TYPES]
    rows = examples.withColumn("n_chars", F.length("text"))
    counts = rows.groupBy("split").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"), *per_label)
    return with_percentiles(counts, rows, ["split"], "n_chars", interpolated={"p95_chars": 0.95})
