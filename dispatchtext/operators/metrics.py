"""Evaluation and service metrics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import TYPES, chunk_set
from .order_statistics import with_percentiles


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def scored_examples(examples: DataFrame) -> DataFrame:
    """One row of counts from examples with `tokens`, arrays of tok_idx, gold and pred in order: for each type, chunks that both sides have, and those of each.

    Each example is folded where it lies; nothing but sums leaves a task.
    """
    rows = examples.select(*[chunk_set(F.col("tokens"), side).alias(side) for side in ("gold", "pred")])
    rows = rows.select("gold", "pred", F.array_intersect("gold", "pred").alias("both"))
    sides = (("both", "tp"), ("gold", "n_gold"), ("pred", "n_pred"))

    def total(side: str, kind: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(side, lambda c: c["type"] == kind))), F.lit(0))

    return rows.agg(*[total(side, t).alias(f"{t}_{name}") for t in TYPES for side, name in sides])


def entity_scores(tokens: DataFrame) -> DataFrame:
    """type (PER, ADDR, NOTE, micro, macro), tp, n_gold, n_pred, precision, recall, f1 from tokens with `gold` and `pred`.

    Strict chunks match on example, type, first and last token. A zero division gives 0; macro is the plain
    mean over the three types, present or not. Tokens meet once, by example; the rest is folds within a row.
    """
    token = F.struct("tok_idx", "gold", "pred")
    return score_table(scored_examples(tokens.groupBy("example_id").agg(F.sort_array(F.collect_list(token)).alias("tokens"))))


def score_table(counts: DataFrame) -> DataFrame:
    """The rows of entity_scores from the one row of scored_examples."""
    names = ("tp", "n_gold", "n_pred")

    def line(kind: str, *types: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), *[reduce(add, [F.col(f"{t}_{n}") for t in types]).alias(n) for n in names])

    lines = F.array(*[line(t, t) for t in TYPES], line("micro", *TYPES))
    f = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    scored = counts.select(F.explode(lines).alias("l")).select("l.*")
    scored = scored.withColumns({"precision": _ratio(F.col("tp"), F.col("n_pred")), "recall": _ratio(F.col("tp"), F.col("n_gold"))}).withColumn("f1", f)
    macro = scored.filter("type <> 'micro'").agg(F.lit("macro").alias("type"), *[F.sum(c).alias(c) for c in names], *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return scored.unionByName(macro)


def token_accuracy(tokens: DataFrame) -> DataFrame:
    return tokens.filter("gold is not null").agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"))


def category(status: Column, error: Column) -> Column:
    """Outcome of one request; everything that is no exception, 4xx or 5xx counts as success."""
    return F.when(error.isNotNull() | status.isNull(), "exception").when(status.between(400, 499), "input_error").when(status >= 500, "server_error").otherwise("success")


def _completed(records: DataFrame) -> DataFrame:
    """records with `ms`, the elapsed time of those that got an answer."""
    done = F.col("error").isNull() & F.col("status_code").isNotNull()
    return records.withColumns({"done": done, "ms": F.when(done, F.col("elapsed_ms"))})


def latency_summary(records: DataFrame, elapsed_s: float, keys: list[str]) -> DataFrame:
    """Counts over all records, percentiles (nearest rank) over completed ones; failed: an error, no status, or 300 and above."""
    rows = _completed(records)
    done = F.col("done")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(done & F.col("status_code").between(200, 299)).alias("success"),
        F.count_if(~done | (F.col("status_code") >= 300)).alias("failed"), (F.count("*") / F.lit(elapsed_s)).alias("rps"),
        F.min("ms").alias("min_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"),
    )
    return with_percentiles(counts, rows, keys, "ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def status_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce(F.col("status_code").cast("string"), F.lit("error")).alias("status")).agg(F.count("*").alias("n"))


def feedback_audit(records: DataFrame) -> DataFrame:
    rows = _completed(records).withColumn("category", category(F.col("status_code"), F.col("error")))
    counts = rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("done").alias("completed"))
    return with_percentiles(counts, rows, ["category"], "ms", {"p95_ms": 0.95})


def feedback_summary(records: DataFrame) -> DataFrame:
    """One row: counts in all and by category, and min, mean, p50, p95, p99 and max over completed requests."""
    rows = _completed(records).withColumn("kind", category(F.col("status_code"), F.col("error")))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("success", "input_error", "server_error", "exception")]
    summary = rows.agg(F.count("*").alias("total"), *counts, F.min("ms").alias("min_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
    return with_percentiles(summary, rows, [], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def feedback_listing(records: DataFrame, *kinds: str) -> DataFrame:
    """The requests of these categories, with status first and unanswered ones last, by status and case."""
    own = records.filter(category(F.col("status_code"), F.col("error")).isin(*kinds))
    return own.orderBy(F.col("status_code").asc_nulls_last(), "case_id")


def compare_results(expected: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """id, passed, failures: expected rows against actual rows by id. Fields count only where 200 is expected and met; null expects null."""
    a = actual.select("id", *[F.col(c).alias(f"a_{c}") for c in ("status_code", "error_code", *fields)])
    rows = expected.join(a, "id", "left")
    ok = (F.col("status_code") == 200) & (F.col("a_status_code") == 200)
    tests = [
        F.when(F.col("a_status_code").isNull(), F.lit("missing")),
        F.when(~F.col("status_code").eqNullSafe(F.col("a_status_code")), F.lit("status_code")),
        F.when(~F.col("error_code").eqNullSafe(F.col("a_error_code")), F.lit("error_code")),
        *[F.when(ok & ~F.col(c).eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in fields],
        *[F.when(F.col(f"a_{c}") == "", F.lit(f"empty {c}")) for c in fields],
    ]
    failures = F.array_compact(F.array(*tests))
    return rows.select("id", (F.size(failures) == 0).alias("passed"), F.array_join(failures, ",").alias("failures"))


def compare_api(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id, layer, outcome (pass, fail, skip, error) and failures of golden cases against answers by id.

    expected: id, layer, text, http_status (null: 200), error_code (null: not tested), response (map, null: not tested),
    forbidden_empty_strings, forbidden_response_fields. actual: id, status_code, error_code, body (map of fields), error.
    A case without text is skipped; a request that failed, or has no answer, is an error. Fields and empty strings count on 200 only.
    """
    got = actual.select("id", *[F.col(c).alias(f"a_{c}") for c in ("status_code", "error_code", "body", "error")])
    rows = expected.join(got, "id", "left")
    ok = F.coalesce(F.col("a_status_code") == 200, F.lit(False))
    wrong = F.map_keys(F.map_filter("response", lambda k, v: ~v.eqNullSafe(F.try_element_at("a_body", k))))
    blank = F.map_keys(F.map_filter("a_body", lambda k, v: F.coalesce(v == "", F.lit(False))))
    held = F.array_intersect("forbidden_response_fields", F.map_keys("a_body"))

    def named(what: str, fields: Column) -> Column:
        return F.coalesce(F.transform(F.array_sort(fields), lambda f: F.concat(F.lit(f"{what} "), f)), F.array().cast("array<string>"))

    def one(test: Column, what: str) -> Column:
        return F.when(test, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))

    failures = F.concat(
        one(~F.col("a_status_code").eqNullSafe(F.coalesce("http_status", F.lit(200))), "status"), one(F.col("error_code").isNotNull() & ~F.col("error_code").eqNullSafe(F.col("a_error_code")), "error code"),
        F.when(ok, named("field", wrong)).otherwise(F.array().cast("array<string>")), F.when(ok & F.coalesce("forbidden_empty_strings", F.lit(False)), named("empty", blank)).otherwise(F.array().cast("array<string>")), named("forbidden", held),
    )
    outcome = F.when(F.col("text").isNull(), "skip").when(F.col("a_error").isNotNull() | F.col("a_status_code").isNull(), "error").when(F.size("failures") == 0, "pass").otherwise("fail")
    return rows.withColumn("failures", failures).select("id", "layer", outcome.alias("outcome"), "failures")


def compare_phones(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id, layer, outcome (pass, fail, error) and failures of golden phone cases by id.

    expected: id, layer, phone_count (null: 0), phone_number, masked_text (null or empty: not tested), candidates (accepted,
    normalized, reject_reason, selected; null: none). actual: the same columns. Candidates are compared by position as far as both
    go; a null normalized or selected is not tested.
    """
    fields = ("phone_count", "phone_number", "masked_text", "candidates")
    got = actual.select("id", F.lit(True).alias("found"), *[F.col(c).alias(f"a_{c}") for c in fields])
    rows = expected.join(got, "id", "left")
    none = F.array().cast("array<string>")
    own, other = F.coalesce("candidates", F.expr("slice(a_candidates, 1, 0)")), F.col("a_candidates")

    def pair(z: Column, i: Column) -> Column:
        e, a = z["e"], z["a"]
        tests = [
            F.when(~e["accepted"].eqNullSafe(a["accepted"]), F.lit("accepted")), F.when(e["normalized"].isNotNull() & ~e["normalized"].eqNullSafe(a["normalized"]), F.lit("normalized")),
            F.when(~e["reject_reason"].eqNullSafe(a["reject_reason"]), F.lit("reject_reason")), F.when(e["selected"].isNotNull() & ~e["selected"].eqNullSafe(a["selected"]), F.lit("selected")),
        ]
        return F.transform(F.array_compact(F.array(*tests)), lambda t: F.concat(F.lit("candidate "), i.cast("string"), F.lit(" "), t))

    n = F.least(F.size(own), F.size(other))
    zipped = F.arrays_zip(F.slice(own, 1, n).alias("e"), F.slice(other, 1, n).alias("a"))
    whole = F.array_compact(
        F.array(
            F.when(~F.coalesce("phone_count", F.lit(0)).eqNullSafe(F.col("a_phone_count")), F.lit("phone_count")), F.when(~F.col("phone_number").eqNullSafe(F.col("a_phone_number")), F.lit("phone_number")),
            F.when((F.coalesce("masked_text", F.lit("")) != "") & ~F.col("masked_text").eqNullSafe(F.col("a_masked_text")), F.lit("masked_text")), F.when(F.size(own) != F.size(other), F.lit("candidates")),
        )
    )
    failures = F.when(F.col("found"), F.concat(whole, F.flatten(F.transform(zipped, pair)))).otherwise(none)
    outcome = F.when(F.col("found").isNull(), "error").when(F.size("failures") == 0, "pass").otherwise("fail")
    return rows.withColumn("failures", failures).select("id", "layer", outcome.alias("outcome"), "failures")


def outcome_totals(results: DataFrame, key: str = "layer") -> DataFrame:
    """Passed, failed, skipped and broken cases by key, and in all (key null)."""
    return results.rollup(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("pass", "fail", "skip", "error")])


def failed_cases(results: DataFrame) -> DataFrame:
    """id and outcome of the cases that failed or broke, by id."""
    return results.filter(F.col("outcome").isin("fail", "error")).select("id", "outcome").orderBy("id")


def pass_totals(results: DataFrame, key: str) -> DataFrame:
    """Passed and failed by key, and in all (key null)."""
    return results.rollup(key).agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
