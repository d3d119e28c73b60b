"""Files as tables: binary files with their hashes, pages from a pluggable decoder, cases in JSON lines, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "struct<entity:string,attribute:string,value:string,unit:string,period:string,scope:string,qualifiers:map<string,string>,evidence_quote:string,confidence:double>"
CASES = f"id string, description string, fact_a {CLAIM}, fact_b {CLAIM}, expected_relation string, expected_route string, expected_review_reason string, must_not_be array<string>, notes string"


def binary_files(spark: SparkSession, folder: str, ending: str = ".pdf") -> DataFrame:
    """(path, filename, content_hash, length, content) of the files of a folder and its subfolders with an ending in any case; the hash is of the bytes."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("content_hash"), "length", "content")


def decode_pages(files: DataFrame, decoder: Callable[[bytes], list[str]], max_pages: int = 0) -> DataFrame:
    """(content_hash, page_number, page_text, error) of each file; ``decoder`` gives the texts of its pages.

    A file that cannot be decoded has one row without a page that says why, one without pages a row without an error.
    With ``max_pages`` over 0 only the first pages come out. Equal contents are decoded once.
    """
    once = files.select("content_hash", "content").dropDuplicates(["content_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    pages, error = decoder(content), None
                except Exception as e:  # a decoder may raise anything; the row says what
                    pages, error = [], f"{type(e).__name__}: {e}"
                out += [(key, k, t, None) for k, t in enumerate(pages[:max_pages] if max_pages > 0 else pages, 1)] or [(key, None, None, error)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["content_hash", "page_number", "page_text", "error"])

    return once.mapInArrow(run, "content_hash string, page_number int, page_text string, error string")


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs in JSON lines, blank lines skipped, with the defaults of absent fields.

    ``malformed`` holds a line that is no such case, with nulls beside it.
    """
    cases = spark.read.schema(f"{CASES}, malformed string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(path).where("id is not null or malformed is not null")
    for side in ("fact_a", "fact_b"):
        c = F.col(side)
        cases = cases.withColumn(side, c.withField("qualifiers", F.coalesce(c["qualifiers"], F.create_map().cast("map<string,string>"))).withField("evidence_quote", F.coalesce(c["evidence_quote"], F.lit(""))).withField("confidence", F.coalesce(c["confidence"], F.lit(0.95))))
    return cases


def fill_hashes(uploads: DataFrame, files: DataFrame) -> DataFrame:
    """Uploads with missing hashes filled from their files, unless another upload already has that hash."""
    held = files.select(F.col("path").alias("file_path"), F.col("content_hash").alias("_found")).dropDuplicates(["file_path"])
    taken = uploads.where("content_hash is not null").select(F.col("content_hash").alias("_found"), F.lit(True).alias("_taken")).distinct()
    joined = uploads.join(held, "file_path", "left").join(taken, "_found", "left")
    filled = F.when(F.col("content_hash").isNull() & F.col("_taken").isNull(), F.col("_found")).otherwise(F.col("content_hash"))
    return joined.withColumn("content_hash", filled).select(*uploads.columns)


def ensure_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty Parquet table of the schema where there is none yet; one that is there stays as it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows added to a Parquet table; a failed job leaves nothing that a reader sees."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_evolving(spark: SparkSession, path: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A Parquet table whose files may lack later columns, with defaults for what is missing."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def write_json(metrics: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
