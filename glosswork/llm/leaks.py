"""Evaluation passages inside a corpus: shared runs of n normalised words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.plans.common import bounded

N = 13
MOST_GRAMS = 2_000_000
NOT_WORD = re.compile(r"[^\w\s]|_")
WORD = re.compile(r"\S+")
HITS = "id long, item_id long, start_char int, end_char int, words int"


def words(text: str) -> list[str]:
    """Strings between white space, as lower-case letters and digits; those without any are dropped."""
    return NOT_WORD.sub("", text.lower()).split()


def placed(text: str) -> list[tuple[str, int, int]]:
    """The same words with their offsets."""
    found = ((NOT_WORD.sub("", m.group().lower()), m.start(), m.end()) for m in WORD.finditer(text))
    return [x for x in found if x[0]]


def digest(run: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(run)) - (1 << 63)


def grams(items: DataFrame, n: int = N) -> DataFrame:
    """One row for each window of n words: first word, digest, item, position and the item's words."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["item_id"], frame["text"]):
                w = words(text)
                out += [(w[k], digest(w[k : k + n]), i, k, " ".join(w[k : k + n])) for k in range(len(w) - n + 1)]
            yield pd.DataFrame(out, columns=["first", "h", "item_id", "at", "gram"])

    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    return rows.mapInPandas(f, "first string, h long, item_id long, at int, gram string")


def _runs(text: str, table: dict[int, list[tuple[int, str]]], n: int) -> list[tuple[int, int, int, int]]:
    """Maximal runs (item, start, end, words) of a text that has a hit; each window is compared word by word."""
    tokens = placed(text)
    open_: dict[int, list[int]] = {}
    done: list[tuple[int, int, int, int]] = []
    for k in range(len(tokens) - n + 1):
        run = " ".join(t[0] for t in tokens[k : k + n])
        for item in {i for i, gram in table.get(xxhash.xxh3_64_intdigest(run) - (1 << 63), ()) if gram == run}:
            if item in open_ and open_[item][1] >= k:
                open_[item][1] = k + n
            else:
                if item in open_:
                    a, b = open_[item]
                    done.append((item, tokens[a][1], tokens[b - 1][2], b - a))
                open_[item] = [k, k + n]
    return done + [(item, tokens[a][1], tokens[b - 1][2], b - a) for item, (a, b) in open_.items()]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, most: int = MOST_GRAMS) -> DataFrame:
    """(id, item_id, start_char, end_char, words): maximal passages of n or more words that a document shares with an item.

    Offsets are code points, end exclusive. Null ids and texts give no rows; an item shorter than n words cannot
    leak; repeated rows give repeated hits. The set of item windows is broadcast if it has `most` rows or fewer;
    beyond that, document windows are joined with it by digest in a shuffle, and only documents with a hit are
    verified. Both ways give the same rows.
    """
    table = grams(items, n)
    corpus = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = bounded(table, most)
    if rows is None:
        return _leaks_by_join(corpus, table, n)
    spark = docs.sparkSession
    index: dict[int, list[tuple[int, str]]] = {}
    for r in rows:
        index.setdefault(r.h, []).append((r.item_id, r.gram))
    shared = spark.sparkContext.broadcast((index, {r["first"] for r in rows}))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, starts = shared.value
        for frame in frames:
            out = []
            for i, text in zip(frame["id"], frame["text"]):
                w = words(text)
                for k in range(len(w) - n + 1):
                    if w[k] in starts and digest(w[k : k + n]) in hashes:
                        out += [(i, *x) for x in _runs(text, hashes, n)]
                        break
            yield pd.DataFrame(out, columns=["id", "item_id", "start_char", "end_char", "words"])

    return corpus.mapInPandas(scan, HITS)


def _leaks_by_join(corpus: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """The way for item sets too large to broadcast."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["id"], frame["text"]):
                w = words(text)
                out += [(i, h) for h in {digest(w[k : k + n]) for k in range(len(w) - n + 1)}]
            yield pd.DataFrame(out, columns=["id", "h"])

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text, hits in zip(frame["id"], frame["text"], frame["hits"]):
                index: dict[int, list[tuple[int, str]]] = {}
                for x in hits:
                    index.setdefault(x["h"], []).append((x["item_id"], x["gram"]))
                out += [(i, *x) for x in _runs(text, index, n)]
            yield pd.DataFrame(out, columns=["id", "item_id", "start_char", "end_char", "words"])

    hits = corpus.mapInPandas(windows, "id long, h long").join(table, "h").groupBy("id").agg(F.collect_set(F.struct("h", "item_id", "gram")).alias("hits"))
    return corpus.join(hits, "id").mapInPandas(verify, HITS)


def without_leaks(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_share: float = 0.5) -> DataFrame:
    """The corpus with leaked passages cut out; a document that leaks to `drop_share` of its characters or more is removed.

    Columns are those of `docs` plus `removed_chars`. Documents without hits are kept as they are, null texts too.
    """
    spans = hits.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("_spans"))
    joined = docs.join(spans, F.col(id_col) == F.col("_id"), "left")
    start = F.struct(F.lit("").alias("kept"), F.lit(1).alias("at"))
    cut = F.aggregate(
        "_spans",
        start,
        lambda a, s: F.struct(
            F.concat(a.kept, F.substring(F.col(text_col), a["at"], F.greatest(F.lit(0), s.start_char + 1 - a["at"]))).alias("kept"),
            F.greatest(a["at"], s.end_char + 1).alias("at"),
        ),
        lambda a: F.concat(a.kept, F.substring(F.col(text_col), a["at"], F.length(F.col(text_col)))),
    )
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut)
    removed = F.coalesce(F.length(F.col(text_col)) - F.length(text), F.lit(0))
    cleaned = joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], removed.alias("removed_chars"), F.length(F.col(text_col)).alias("_n"))
    return cleaned.where((F.col("removed_chars") == 0) | (F.col("removed_chars") < drop_share * F.col("_n"))).drop("_n")
