"""Reading and writing the files of the pipeline as DataFrames, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "repo string, sha string, file string, lang string, source string, tool string, commit_date string, added_ranges array<array<int>>, size long, local_path string, ingested_at timestamp"
COMMENTS = (
    "id string, source string, tool string, repo string, sha string, file string, lang string, commit_date string, kind string, form string, start_line int, end_line int, text string, code string, "
    "target_type string, attached boolean, exclude string"
)
FILE_STATS = "source string, tool string, repo string, sha string, file string, lang string, added_lines int, added_nonblank int, comments int, comment_lines int, by_kind map<string,int>"
LABELS = "id string, lang string, comment string, code string, label string, note string"
KEY = "id string, source string, overlap double, cue int, cls string, file string, line int"
SOURCE_FILES = r"(?i)\.(?:py|js|jsx|ts|tsx|java|go|rs|c|h|cpp|cc)$"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a line that is none gives a row of nulls, missing fields are null."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header by which columns are found, with or without a byte order mark; cells may hold line ends. Columns that the schema lacks are ignored, missing ones are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    fields = spark.createDataFrame([], schema).schema.fields
    return raw.select(*(F.col(f"`{names[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the lines of a text file without outer blanks, byte order mark, empty lines and lines that begin with a number sign."""
    word = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(word.alias("word")).where("word != '' AND NOT startswith(word, '#')")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    """The columns given (all if none), with a header and quotes doubled."""
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, spark: SparkSession, path: str, *key: str) -> DataFrame:
    """Appends the rows of `df` whose key is not yet in the Parquet folder, each key once, and gives back the folder's rows. Runs may be repeated. Null keys are values."""
    fresh = df.dropDuplicates(list(key))
    try:
        known = spark.read.parquet(path).select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
        fresh = fresh.join(known, F.expr(" AND ".join(f"{k} <=> _{k}" for k in key)), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def usable(files: DataFrame, skip: str, most_bytes: int = 512 * 1024) -> DataFrame:
    """Files that are source by their extension, whose path does not match `skip`, not too large and valid UTF-8; a byte order mark is cut off. `content` is binary or text."""
    raw = F.col("content").cast("binary")
    kept = files.where(F.col("file").rlike(SOURCE_FILES) & ~F.replace("file", F.lit("\\"), F.lit("/")).rlike(skip) & (F.octet_length(raw) <= most_bytes) & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.withColumn("content", F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
