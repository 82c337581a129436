"""File sources: raw artifacts, suites and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T


RAW = "source_path string, file_name string, extension string, file_size_bytes long, modified_at string, content binary, text string, doc_key string"


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """:func:`raw_artifacts` of single files (no patterns) with ``error``: ``missing`` or ``folder`` in a row of its own, null for a file.

    The file system is asked once for each folder that the paths lie in, not for each path.
    """
    errors, sound, held_in = [], [], {}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        parent = place.getParent()
        folder = parent.toString() if parent is not None else path
        if folder not in held_in:
            fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
            there = parent is not None and fs.exists(parent) and fs.getFileStatus(parent).isDirectory()
            held_in[folder] = {f.getPath().getName(): f.isDirectory() for f in fs.listStatus(parent)} if there else {}
        is_folder = held_in[folder].get(place.getName()) if parent is not None else True
        if is_folder is None:
            errors.append((path, "missing"))
        elif is_folder:
            errors.append((path, "folder"))
        else:
            sound.append(path)
    held = raw_artifacts(spark, sound) if sound else spark.createDataFrame([], RAW)
    failed = spark.createDataFrame(errors, "source_path string, error string")
    return held.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def raw_artifacts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_path, file_name, extension, file_size_bytes, modified_at, content, text, doc_key`` of files under a path or pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    key = T.document_key(F.col("path"), T.fingerprint(F.col("content")))
    return files.select(
        F.col("path").alias("source_path"),
        name.alias("file_name"),
        F.lower(F.regexp_extract(name, "(\\.[^.]+)$", 1)).alias("extension"),
        F.col("length").alias("file_size_bytes"),
        F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"),
        "content",
        decoded(F.col("content")).alias("text"),
        key.alias("doc_key"),
    )


def decoded(content: Column) -> Column:
    """UTF-8 text, broken bytes as replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def artifact_text(content_text: Column, content_bytes: Column) -> Column:
    return F.coalesce(content_text, decoded(content_bytes))


def suite(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON array or JSON lines file, by its suffix."""
    return spark.read.json(path, multiLine=not path.endswith((".jsonl", ".ndjson")))


def beir(spark: SparkSession, folder: str, split: str = "test") -> dict[str, DataFrame]:
    """Corpus (one chunk a document, title before text), queries and positive judgements of a BEIR folder."""
    corpus = spark.read.json(f"{folder}/corpus.jsonl")
    text = F.trim(F.concat_ws(" ", "title", "text"))
    judged = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)
    return {
        "chunks": corpus.select(F.col("_id").alias("chunk_id"), text.alias("stable_text"), F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")).alias("token_count")),
        "queries": spark.read.json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query")),
        "qrels": judged.where(F.col("score").cast("int") > 0).select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("chunk_id")),
    }


def merge_settings(base: dict, override: dict) -> dict:
    """``override`` over ``base``; dictionaries are merged all the way down."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merge_settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
