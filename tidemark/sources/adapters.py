"""Relations of the knowledge model, read from tables that stand in for them.

Each adapter is a projection: filters and column choices made on top of it reach the Parquet scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import composite_identifiers

#: The moment that lifecycle queries look at the relations from; logic never asks for the current time.
AS_OF = "2024-04-30 00:00:00"
#: A text's first sentence.
TITLE = r"^[^.!?\n]*"
#: Longer queries are refused, never cut.
MAX_QUERY = 500


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's texts (doc_id, id, title, search_terms, content, ...), without what labels tell: what an index reads.

    A document has neither a title nor search terms of its own: its first sentence is the one, the composite identifiers of
    its whole text are the other.
    """
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.col("doc_id").alias("id"),
        F.regexp_extract("text", TITLE, 0).alias("title"),
        F.array_join(F.array_sort(composite_identifiers(F.col("text"))), " ").alias("search_terms"),
        F.col("text").alias("content"),
        F.col("source").alias("project_key"),
        F.col("lang").alias("source_agent"),
    )


def knowledge_records(spark: SparkSession, sf_dir: str, **made: Column) -> DataFrame:
    """The corpus: whole documents with their labels as review outcomes.

    What is read of a text is worked out before labels are met, so that the join exchanges whole texts only for those who ask for them.
    ``made``: more columns of that kind, from ``title``, ``search_terms`` and ``content``.
    """
    d = record_texts(spark, sf_dir).withColumns(made).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kinds = ("fact", "preference", "procedure", "decision")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 4 + 1).cast("int"))
    status = (
        F.when(F.col("quality").isNull(), "candidate")
        .when(F.col("toxic") == 1, "quarantined")
        .when(F.col("quality") == 0, "archived")
        .when(F.col("doc_id") % 7 == 0, "stale")
        .otherwise("active")
    )
    created = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 137 % 2880) * 3600)
    return d.select(
        *("id", "title", "search_terms", "content", "project_key", "source_agent"),
        F.when(F.col("doc_id") % 10 == 0, "user").otherwise("project").alias("scope"),
        kind.alias("knowledge_type"),
        status.alias("status"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("long").alias("verified_count"),
        F.coalesce(F.col("toxic"), F.lit(0)).cast("long").alias("rejected_count"),
        (F.col("doc_id") % 7).alias("hit_count"),
        (F.col("doc_id") % 3).alias("adopted_count"),
        created.alias("created_at"),
        (created + F.make_interval(hours=(F.col("doc_id") % 50).cast("int"))).alias("updated_at"),
        *made,
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review outcomes, one row each: verified where quality is 1, rejected where toxic is 1."""
    rows = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("knowledge_id"),
        F.explode(F.filter(F.array(F.when(F.col("quality") == 1, F.lit("verified")), F.when(F.col("toxic") == 1, F.lit("rejected"))), lambda x: x.isNotNull())).alias("outcome"),
    )
    kind = F.when(F.col("knowledge_id") % 3 == 0, "user_approval").when(F.col("knowledge_id") % 3 == 1, "test").otherwise("observation")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("knowledge_id") * 137 % 2880 + F.when(F.col("outcome") == "verified", 24).otherwise(48)) * 3600)
    agent = F.concat(F.lit("agent"), (F.col("knowledge_id") % 5).cast("string"))
    return rows.select("knowledge_id", "outcome", kind.alias("evidence_kind"), agent.alias("agent_id"), at.alias("created_at"))


def search_requests(spark: SparkSession, sf_dir: str, project: str = "src0") -> DataFrame:
    own = read(spark, sf_dir, "benchmark").where(F.char_length("text") <= MAX_QUERY)
    return own.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(project).alias("project_key"))


def snapshot_name(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """A name for the content of tables, by the paths, sizes and times of their files: what was derived from them is found by it."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in [f for t in tables for f in read(spark, sf_dir, t).inputFiles()]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log; success is unknown (null) unless the event says so."""
    success = F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "purchase", True)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").alias("session_id"),
        "event_type",
        success.alias("success"),
        "value",
        F.col("props").alias("payload"),
        F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def recall_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = agent_events(spark, sf_dir).where("event_type = 'view'")
    return e.select(
        "id",
        "agent_id",
        "session_id",
        "created_at",
        F.col("value").alias("latency_ms"),
        (F.col("k") % 2 == 0).alias("hit"),
        F.when(F.col("id") % 3 == 0, F.col("k") % 2 == 0).alias("successful_validation"),
    )


def learning_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("agent"), (F.col("o_custkey") % 7).cast("string")).alias("agent_id"),
        status.alias("status"),
        F.col("o_totalprice").alias("latency_ms"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderkey") % 4).alias("proposal_count"),
        F.when(status == "completed", F.col("o_orderkey") % 3).otherwise(0).cast("long").alias("promoted_count"),
        F.col("o_orderpriority").alias("proposal_outcome"),
    )


def compilation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("knowledge_id"),
        F.when(F.col("l_returnflag") == "R", "deduplicated").otherwise("produced").alias("relation"),
        F.col("l_suppkey").alias("agent_key"),
    )


def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("knowledge_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("slot"), F.col("p_type").alias("value"), "p_size", "p_retailprice"
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("agent_key"), F.col("s_name").alias("agent_name"), (F.col("s_acctbal") >= 0).alias("enabled"))


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired arms: on and off by line status, paired by order and line parity."""
    i = read(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("experiment"),
        (F.col("l_linenumber") % 2).cast("long").alias("pair"),
        F.when(F.col("l_linestatus") == "O", "on").otherwise("off").alias("mode"),
        F.col("l_extendedprice").alias("ttft_ms"),
        F.col("l_quantity").alias("total_ms"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


TURN_TOOL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("input_summary", T.StringType()),
        T.StructField("output_summary", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("objective_kind", T.StringType()),
    ]
)
