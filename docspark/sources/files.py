"""Documents in and out as JSON lines; attachments from a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, body of JSON lines. A line without an id gets the hash of its text; reserved _ keys stay queryable by nobody.

    Lines that are not JSON objects are dropped to a NULL body, which no query matches.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    body = F.try_parse_json("value")
    own = F.coalesce(F.try_variant_get(body, "$.id", "string"), F.substring(F.sha2("value", 256), 1, 32))
    return lines.select(own.alias("id"), body.alias("body"))


def write_documents(df: DataFrame, path: str, body: str = "body") -> None:
    """One JSON document per line, with its id."""
    text = F.to_json(F.col(body))
    df.select(text.alias("value")).write.text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines; absent values leave their key out."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.text(path)


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """id, name, length, digest, data of files kept as <id>/<name>; unread columns are not loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("name"), "length", F.sha2("content", 256).alias("digest"), F.col("content").alias("data"))
