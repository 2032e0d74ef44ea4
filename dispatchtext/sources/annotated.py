"""Files of annotated examples, test cases, reports and the label map."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import json_whole
from ..functions.spans import LABELS
from ..functions.text import trim

EXAMPLE = "id string, text string, entities array<struct<start:int,end:int,label:string>>, source string, variation string, model string, created_at string, digest string"
CASE = (
    "id string, layer string, scope string, tags array<string>, input struct<text:string,debug:boolean,text_factory:struct<character:string,count:int>>, "
    "expected struct<http_status:int,error_code:string,response:map<string,string>,forbidden_empty_strings:boolean,forbidden_response_fields:array<string>>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, example (null where the line is not one JSON object) and file of JSON lines; a byte-order mark and blank lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.input_file_name().alias("file"))
    return lines.filter(F.length(trim(F.col("line"))) > 0).select("line", json_whole(F.col("line"), f"struct<{_fields(EXAMPLE)}>").alias("example"), "file")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields)


def read_examples(spark: SparkSession, path: str, malformed: str = "stop") -> DataFrame:
    """Examples of JSON lines; a missing path gives no rows. A malformed line stops the job, or is left out (`drop`): see rejected_lines."""
    try:
        lines = read_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EXAMPLE)
    good = F.col("example").isNotNull()
    if malformed == "stop":
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), F.substring("line", 1, 80))).cast("boolean"))
    return lines.filter(good).select("example.*")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and line of what is not one JSON object."""
    return read_lines(spark, path).filter("example is null").select("file", "line")


def concat_examples(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_splits(examples: DataFrame, path: str) -> None:
    examples.write.partitionBy("split").json(path)


def with_provenance(examples: DataFrame, provider: str, model: str, created_at: str | None = None) -> DataFrame:
    """id, source, model, variation (kept where there is one), created_at (an ISO time, null: now) and digest of generated examples.

    Ids and digests come from response, ordinal and text, so that retries write the same rows. An id is the digest's first 32 bits.
    """
    digest = F.sha2(F.concat_ws("|", F.col("response_id").cast("string"), F.col("ordinal").cast("string"), "text"), 256)
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    kind = F.col("variation").cast("string") if "variation" in examples.columns else F.lit(None).cast("string")
    return examples.withColumns(
        {"id": F.concat(F.lit("synth-"), F.substring(digest, 1, 8)), "source": F.lit(f"{provider}_synth"), "model": F.lit(model), "variation": kind, "created_at": F.lit(created_at) if created_at else now, "digest": digest}
    )


def append_examples(examples: DataFrame, path: str) -> None:
    """Add the examples that path does not hold yet, by id, text and digest: the same job run twice leaves each row once.

    Ids have 32 bits and texts repeat, so of many rows some share both; the digest of generated examples parts them. Rows that
    come twice within examples are added once.
    """
    if "digest" not in examples.columns:
        examples = examples.withColumn("digest", F.lit(None).cast("string"))
    keys = ["id", "text", "digest"]
    held = read_examples(examples.sparkSession, path).select(*[F.col(c).alias(f"held_{c}") for c in keys])
    same = F.coalesce(F.col("digest") == F.col("held_digest"), F.lit(True))  # rows without one are known by id and text
    for c in ("id", "text"):
        same = same & F.col(c).eqNullSafe(F.col(f"held_{c}"))
    examples.dropDuplicates(keys).join(held, same, "left_anti").write.mode("append").json(path)


def read_cases(spark: SparkSession, path: str, array: bool = False, layer: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Test cases; scope future and layers performance and privacy are left out, a null scope or layer stays. Adds `text` from the factory."""
    cases = spark.read.schema(CASE).option("multiLine", array).json(path)
    cases = cases.filter(~F.coalesce(F.col("scope") == "future", F.lit(False)) & ~F.coalesce(F.col("layer").isin("performance", "privacy"), F.lit(False)))
    if layer:
        cases = cases.filter(F.col("layer") == layer)
    if ids:
        cases = cases.filter(F.col("id").isin(ids))
    return cases.withColumn("text", case_text(F.col("input.text"), F.col("input.text_factory.character"), F.col("input.text_factory.count")))


def case_text(text: Column, character: Column, count: Column) -> Column:
    """The text of a case, or a character so many times where it has none."""
    return F.coalesce(text, F.call_function("repeat", character, count))


def runnable(cases: DataFrame) -> DataFrame:
    """Cases whose text is not blank."""
    return cases.filter(F.length(trim(F.col("text"))) > 0)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON folder per mode below path/by_mode, and all modes together in path/combined."""
    reports.write.partitionBy("mode").json(f"{path}/by_mode")
    reports.write.json(f"{path}/combined")


def label_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")
