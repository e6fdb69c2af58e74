"""From source lines and added ranges to comments and file statistics: grouping of line comments, exclusion, attribution counts, patches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import features
from glosswork.operators.pool import FILE, attribution, merged


def lines_of(files: DataFrame) -> DataFrame:
    """repo, sha, file, line (from 1), text: the lines of each file; a line end at the end of the text begins no line. Null contents give none."""
    body = F.regexp_replace(F.regexp_replace(F.col("content"), r"\r\n?", "\n"), r"\n\z", "")
    return files.where("content IS NOT NULL AND content != ''").select(*FILE, F.posexplode(F.split(body, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def line_comments(files: DataFrame) -> DataFrame:
    """repo, sha, file, start_line, end_line, is_doc, text: comments that stand alone on their lines, neighbours joined.

    Lines join where they follow each other and are of one kind (documentation or not); a shebang joins nothing.
    The islands of a file come from the distance of the line number to its rank, so the window holds one file's
    comment lines. Repeated rows of a file are read as one.
    """
    mark = F.when(F.col("lang").isin("python"), r"^\s*#").otherwise(r"^\s*//")
    rows = lines_of(files).join(files.select(*(F.col(k).alias(f"_{k}") for k in FILE), "lang").distinct(), F.expr(" AND ".join(f"{k} <=> _{k}" for k in FILE)))
    marked = rows.where(F.regexp_like("text", mark)).select(*FILE, "line", F.rtrim("text").alias("text")).distinct()
    bang = F.col("text").startswith("#!")
    w = Window.partitionBy(*FILE).orderBy("line")
    kinds = marked.withColumns({"is_doc": features.is_doc(F.col("text")), "_bang": bang})
    flagged = kinds.withColumn("_new", F.coalesce((F.col("line") != F.lag("line").over(w) + 1) | (F.col("is_doc") != F.lag("is_doc").over(w)) | F.col("_bang") | F.lag("_bang").over(w), F.lit(True)))
    islands = flagged.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("line", features.clean_line(F.col("text")).alias("t"))))
    return islands.groupBy(*FILE, "_island").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.first("is_doc").alias("is_doc"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text")
    ).drop("_island")


def reasons(comments: DataFrame) -> DataFrame:
    """exclude (as delivered), computed (as the rules say) and n; for every pair that occurs."""
    return comments.groupBy("exclude", features.exclusion_reason(F.col("text"), F.col("start_line")).alias("computed")).agg(F.count("*").alias("n"))


def counters(comments: DataFrame, manifest: DataFrame) -> DataFrame:
    """By source: observed comments by kind (raw_<kind>), dropped_mixed, dropped_not_added and kept ones. Files that the manifest does not list are not added."""
    origin = F.coalesce(F.col("origin"), F.lit("none"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"raw_{k}") for k in ("inline", "leading", "block", "detached", "doc")]
    return attribution(comments, manifest).groupBy("source").agg(
        *kinds, F.count_if(origin == "mixed").alias("dropped_mixed"), F.count_if(origin == "none").alias("dropped_not_added"), F.count_if(origin == "all").alias("kept")
    )


def added_lines(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """repo, sha, file, source, added_lines, added_nonblank of each file that the manifest lists: lines inside its ranges, cut to the file; no ranges mean the whole file."""
    newest = manifest.groupBy(*FILE).agg(F.max_by("added_ranges", "ingested_at").alias("ranges"), F.min("source").alias("source")).select(*(F.col(k).alias(f"_{k}") for k in FILE), "source", merged(F.col("ranges")).alias("ranges"))
    on = F.expr(" AND ".join(f"{k} <=> _{k}" for k in FILE))
    body = F.regexp_replace(F.regexp_replace(F.col("content"), r"\r\n?", "\n"), r"\n\z", "")
    lines = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    joined = files.select(*FILE, lines.alias("lines")).join(newest, on)
    spans = F.when(F.col("ranges").isNull(), F.array(F.array(F.lit(1), F.size("lines")))).otherwise(F.col("ranges"))
    cut = F.filter(F.transform(spans, lambda r: F.array(F.greatest(r[0], F.lit(1)), F.least(r[1], F.size("lines")))), lambda r: r[0] <= r[1])
    parts = joined.withColumn("spans", cut).withColumn("parts", F.transform("spans", lambda r: F.slice("lines", r[0], r[1] - r[0] + 1)))
    count = F.aggregate("spans", F.lit(0), lambda a, r: a + r[1] - r[0] + 1)
    full = F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(F.filter(p, lambda x: x.rlike(r"\S"))))
    return parts.select(*FILE, "source", count.alias("added_lines"), full.alias("added_nonblank"))


def file_rows(files: DataFrame, manifest: DataFrame, comments: DataFrame) -> DataFrame:
    """Statistics of each listed file, those without comments too: added lines, comments that are not excluded, their lines, and counts by kind (null without any).

    A comment that was delivered again counts once (by id).
    """
    base = added_lines(files, manifest)
    once = comments.where("exclude IS NULL").groupBy(*FILE, "id").agg(F.max_by(F.struct("kind", "start_line", "end_line"), F.struct("ingested_at", "comment_id")).alias("c")).select(*FILE, "c.*")
    kinds = once.groupBy(*FILE, "kind").agg(F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("l"))
    sums = kinds.groupBy(*FILE).agg(F.sum("n").alias("comments"), F.sum("l").alias("comment_lines"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    theirs = sums.select(*(F.col(k).alias(f"_{k}") for k in FILE), "comments", "comment_lines", "by_kind")
    return base.join(theirs, F.expr(" AND ".join(f"{k} <=> _{k}" for k in FILE)), "left").drop(*(f"_{k}" for k in FILE)).na.fill(0, ["comments", "comment_lines"])


_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _ranges(patch: str) -> Iterator[tuple[str, list[list[int]]]]:
    found: dict[str, list[list[int]]] = {}
    path, old, new = None, 0, 0
    for line in patch.split("\n"):
        if old > 0 or new > 0:  # inside a hunk: its header says how many lines follow
            old -= line[:1] in ("-", " ", "")
            new -= line[:1] in ("+", " ", "")
            continue
        if line.startswith("+++ "):
            name = line[4:].rstrip("\r").split("\t")[0]
            path = None if name == "/dev/null" else name.removeprefix("b/")
            if path is not None:
                found.setdefault(path, [])
        elif (m := _HUNK.match(line)) and path is not None:
            old, start, new = int(m[1] if m[1] is not None else 1), int(m[2]), int(m[3] if m[3] is not None else 1)
            if new:
                found[path].append([start, start + new - 1])
    yield from found.items()


def patch_ranges(patches: DataFrame, keys: tuple[str, ...] = ("repo", "sha")) -> DataFrame:
    """The columns `keys`, file and added_ranges for each file of each patch (column `patch`): closed ranges of new lines, none for a pure deletion."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(*row[:-1], path, ranges) for row in zip(*(c.to_pylist() for c in b.columns)) for path, ranges in _ranges(row[-1])]
            columns = list(zip(*out)) if out else [()] * (len(keys) + 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.list_(pa.list_(pa.int32())))], names=[*keys, "file", "added_ranges"])

    schema = ", ".join([*(f"{k} string" for k in keys), "file string", "added_ranges array<array<int>>"])
    return patches.where("patch IS NOT NULL").select(*(F.col(k).cast("string") for k in keys), "patch").mapInArrow(f, schema)
