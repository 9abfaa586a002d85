"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; columns that records lack are null."""
    return spark.read.schema(schema).json(path)


def optional_column(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind).alias(name)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def nested_postings(postings: DataFrame, block: Column) -> DataFrame:
    """term, block, documents and postings array, for export: a term has a row for each block of documents.

    A frequent term stands in most documents; the block (a range or hash of document_id) bounds its arrays.
    """
    out = postings.groupBy("term", block.alias("block")).agg(F.count("*").alias("documents"), F.array_sort(F.collect_list(F.struct("document_id", "tf"))).alias("postings"))
    return out.select("term", "block", "documents", "postings")


def read_pages(spark: SparkSession, metadata: str, bodies: str, schema: str) -> DataFrame:
    """Saved crawl metadata with the HTML of its raw_html_path: joined by file name, and the whole relative path must fit."""
    meta = spark.read.schema(schema).json(metadata).filter("fetch_status = 'saved'").withColumn("_f", F.element_at(F.split("raw_html_path", "/"), -1))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(bodies).select(F.url_decode(F.input_file_name()).alias("_p"), F.col("value").alias("html")).withColumn("_g", F.element_at(F.split("_p", "/"), -1))
    return meta.join(files, (F.col("_f") == F.col("_g")) & F.endswith("_p", F.concat(F.lit("/"), F.col("raw_html_path"))), "left").drop("_f", "_g", "_p")
