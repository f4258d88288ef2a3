"""Evaluation corpora: long texts in chunks, public conversation sets, JSONL cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunks(rows: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """(id, chunk, text): texts in pieces of ``size`` characters; an empty text is one empty chunk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.greatest(F.lit(0), F.ceil(F.char_length(text) / size) - 1)
    # cut before the rows are multiplied, so that a long text is not copied for each of its chunks
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.substr(text, (i * size + 1).cast("int"), F.lit(size)))
    return rows.select("id", F.posexplode(pieces).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


MESSAGE = T.StructType([T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("dia_id", T.StringType())])
QA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("category", T.IntegerType()),
    ]
)


def dialogue_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, cases) of samples whose conversation maps session names to messages; other values of the map are skipped."""
    schema = T.StructType(
        [
            T.StructField("sample_id", T.StringType()),
            T.StructField("conversation", T.MapType(T.StringType(), T.StringType())),
            T.StructField("qa", T.ArrayType(QA)),
        ]
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    sessions = rows.select("sample_id", F.explode("conversation").alias("session", "body")).where(F.col("session").rlike("^session_[0-9]+$"))
    said = sessions.select("sample_id", "session", F.posexplode(F.from_json("body", T.ArrayType(MESSAGE))).alias("turn", "m"))
    records = said.select(
        F.concat_ws(":", "sample_id", "m.dia_id").alias("id"), "sample_id", "session", "turn", F.concat_ws(": ", "m.speaker", "m.text").alias("content")
    )
    cases = rows.select("sample_id", F.posexplode("qa").alias("n", "q")).select(
        F.concat_ws("-", "sample_id", F.col("n").cast("string")).alias("query_id"), "sample_id", F.col("q.question").alias("query"), "q.evidence", "q.category"
    )
    return records, cases


HAYSTACK = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))),
        T.StructField("haystack_dates", T.ArrayType(T.StringType())),
        T.StructField("haystack_session_ids", T.ArrayType(T.StringType())),
        T.StructField("answer_session_ids", T.ArrayType(T.StringType())),
    ]
)


def source_date(text: str):
    """`2023/05/20 (Sat) 02:21` as a timestamp."""
    return F.to_timestamp(F.regexp_replace(text, r"\s*\([^)]*\)", ""), "yyyy/MM/dd HH:mm")


def haystacks(spark: SparkSession, path: str, size: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(chunks of sessions, cases); questions whose id ends in _abs have no answer."""
    rows = spark.read.schema(HAYSTACK).option("multiLine", True).json(path)
    own = rows.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions", "haystack_dates")).alias("n", "s"))
    text = F.array_join(F.transform("s.haystack_sessions", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    sessions = own.select(
        F.concat_ws("|", "question_id", "s.haystack_session_ids").alias("id"), source_date("s.haystack_dates").alias("created_at"), text.alias("text")
    )
    parts = chunks(sessions, size).join(sessions.select("id", "created_at"), "id")
    cases = rows.select(
        F.col("question_id").alias("query_id"), F.col("question_type").alias("category"), F.col("question").alias("query"),
        F.col("answer_session_ids").alias("expected"), F.col("question_id").endswith("_abs").alias("abstain"),
    )
    return parts, cases


def cases_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): lines that do not parse, lack the key or repeat it are rejected with a reason."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    times = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    met = rows.join(times, key, "left")
    why = F.when(F.col("_corrupt").isNotNull(), "unparsed").when(F.col(key).isNull(), "no_key").when(F.col("__n") > 1, "repeated_key")
    met = met.withColumn("reason", why)
    return met.where("reason is null").select(schema.names), met.where("reason is not null").select(key, "reason")
