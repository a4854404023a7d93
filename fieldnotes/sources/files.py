"""File sources and sinks: URL lists, rule files, front-matter Markdown, replay, idempotent writes."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE = T.StructType([T.StructField(n, k) for n, k in (("name", T.StringType()), ("category", T.StringType()), ("kind", T.StringType()), ("header", T.StringType()), ("regex", T.StringType()), ("weight", T.DoubleType()))])
EVENT = "id string, tenant_id string, type string, version int, correlation_id string, causation_id string, company_id string, occurred_at timestamp, payload string"
#: Weight of a signal for which a rule file gives none.
DEFAULT_WEIGHT = 0.6


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) from a CSV with a header, or a JSON array of strings or of objects with a ``url``."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, schema="url string").filter("url IS NOT NULL")
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    return whole.select(F.coalesce(F.get_json_object("item", "$.url"), F.col("item")).alias("url")).filter("url IS NOT NULL")


def submit_url(spark: SparkSession, url: str, at: str) -> DataFrame:
    """One company with its ``url.submitted`` event; ids derive from the URL."""
    row = spark.createDataFrame([(url, at)], "url string, at string")
    return row.select("url", F.sha2("url", 256).alias("company_id"), F.lit("url.submitted").alias("type"), F.to_timestamp("at").alias("occurred_at"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """A YAML rule file, a row per signal; a signal is one of header, html, meta_generator, script_src, json_ld."""
    rows = []
    for rule in yaml.safe_load(Path(path).read_text()) or []:
        for signal in rule.get("signals") or []:
            kind = next(k for k in ("header", "html", "meta_generator", "script_src", "json_ld") if k in signal)
            header = signal[kind].lower() if kind == "header" else None
            rows.append((rule["name"], rule["category"], kind, header, signal.get("regex") if header else signal[kind], float(signal.get("weight", DEFAULT_WEIGHT))))
    return spark.createDataFrame(rows, RULE)


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(name, version, model, body, body_sha256) of the Markdown files with front matter in a folder."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    parts = F.split("value", r"(?m)^---[ \t]*\r?$", 3)
    value = lambda key: F.trim(F.regexp_extract(F.get(parts, 1), rf"(?m)^{key}:[ \t]*(.*)$", 1))
    body = F.trim(F.regexp_replace(F.get(parts, 2), r"^\s+|\s+$", ""))
    return text.filter(F.size(parts) == 3).select(value("name").alias("name"), value("version").cast("int").alias("version"), value("model").alias("model"), body.alias("body"), F.sha2(body, 256).alias("body_sha256"))


def event_stream(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """The event log as a stream of JSON files; ``types`` narrows it."""
    log = spark.readStream.schema(EVENT).json(path)
    return log.filter(F.col("type").isin(types)) if types else log


def replay(spark: SparkSession, path: str, after: str = "", types: list[str] | None = None) -> DataFrame:
    """The same log as a batch, from an event id (ids sort by time) on."""
    log = spark.read.schema(EVENT).json(path).filter(F.col("id") > after)
    return log.filter(F.col("type").isin(types)) if types else log


def write_batch(path: str, key: str = "batch_id"):
    """A sink for ``foreachBatch`` that may see a batch twice: its rows land in its own partition,
    which a repeat overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(key, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    return write


def write_with_event(path: str, events: str, type_: str, key: str = "batch_id"):
    """A sink for ``foreachBatch`` of (artifact_id, company_id, ...): a batch's artifacts, then an event of a
    type for each.  Both land in the batch's own partition, so a repeat changes nothing, and an event never
    comes before its artifact."""
    artifacts, log = write_batch(path, key), write_batch(events, key)

    def write(batch: DataFrame, batch_id: int) -> None:
        artifacts(batch, batch_id)
        done = batch.sparkSession.read.parquet(path).filter(F.col(key) == batch_id)
        log(done.select(F.sha2(F.concat_ws("|", F.lit(type_), F.col("artifact_id").cast("string")), 256).alias("id"), F.lit(type_).alias("type"), "artifact_id", "company_id"), batch_id)

    return write
