"""Mixing sources to target shares of the total size: balanced sampling by the cube method."""

from __future__ import annotations

import base64
import random
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.plans.common import settle

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 4096


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document. Null texts have no tokens; rows with a null id are left out."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode_ordinary
        for frame in frames:
            frame["tokens"] = [0 if t is None else len(encode(t)) for t in frame["text"]]
            yield frame[["doc_id", "source", "tokens"]]

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInPandas(f, "doc_id long, source string, tokens long")


def quotas(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target source: docs, size, target, most (size x max_repeats), goal, and `rate` = copies wanted of each document.

    The total is the size of all documents taken once, those of other sources too.
    """
    by = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("size"), F.max("tokens").alias("largest"))
    total = by.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    q = t.join(by, "source", "left").crossJoin(total).fillna(0, ["docs", "size", "largest"])
    q = q.withColumns({"target": F.col("share") * F.col("total"), "most": F.col("size") * F.col("max_repeats")})
    q = q.withColumn("goal", F.least("target", F.col("most").cast("double")))
    return q.withColumn("rate", F.when(F.col("size") > 0, F.col("goal") / F.col("size")).otherwise(0.0))


def flight(tokens: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Moves inclusion probabilities to 0 or 1 along null vectors of the constraints (count, tokens).

    Three units at a time have such a vector; it ends with two fractional units or fewer (more steps are not
    possible), and keeps the sum of p and of p x tokens.
    """
    p = list(p)
    active: list[int] = []
    for k in [*range(len(p)), None, None]:
        if k is not None:
            if not 1e-9 < p[k] < 1 - 1e-9:
                p[k] = float(round(p[k]))
                continue
            active.append(k)
        while len(active) >= 3 or (len(active) == 2 and tokens[active[0]] == tokens[active[1]]):
            if len(active) == 2 or tokens[active[0]] == tokens[active[1]] == tokens[active[2]]:
                use, u = active[:2], (1.0, -1.0)
            else:
                use = active[:3]
                a, b, c = (tokens[i] for i in use)
                u = (float(b - c), float(c - a), float(a - b))
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(use, u) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(use, u) if v)
            step = up if rng.random() * (up + down) < down else -down
            for i, v in zip(use, u):
                p[i] += step * v
                if p[i] < 1e-9 or p[i] > 1 - 1e-9:
                    p[i] = float(round(p[i]))
            active = [i for i in active if 0 < p[i] < 1]
    return p


def landing(tokens: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Settles the last units: first the token constraint is given up, then the count."""
    p = list(p)
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    while len(left) >= 2:
        i, j = left[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() * (up + down) < down else -down
        p[i], p[j] = p[i] + step, p[j] - step
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = float(round(p[k]))
        left = [i for i in left if 0 < p[i] < 1]
    for i in left:
        p[i] = 1.0 if rng.random() < p[i] else 0.0
    return p


def _flier(seed: int, taken: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The flight of one block in round `taken`, with the landing in the last round."""

    def fly(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(f"{seed}:{taken}:{key[0]}:{key[1]}")
        frame = frame.sort_values(["doc_id", "tokens"], kind="stable", ignore_index=True)
        p = flight(frame["tokens"].tolist(), frame["p"].tolist(), rng)
        frame["p"] = landing(frame["tokens"].tolist(), p, rng) if last else p
        return frame[["doc_id", "source", "tokens", "whole", "p", "docs"]]

    return fly


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(plan, report). plan: doc_id, source, tokens, copies of the documents that are used; report: one row for each target source; `short`
    tells that what was drawn stays below the target by more than the two documents that the landing may leave out.

    Each document of a source is wanted `rate` times: its whole part is given to all, the fraction is an inclusion
    probability that the cube method settles. The flight runs in blocks of at most about `block` documents of one
    source; what stays fractional (two units a block) goes to the next, smaller round, until one block holds all of
    a source and lands. A repeated document id counts as many documents. Sources that are missing or empty reach 0.
    """
    sized = settle(sizes(docs, tokenizer=tokenizer))
    quota = settle(quotas(sized, targets))
    joined = sized.join(F.broadcast(quota.select("source", "rate", "docs")), "source")
    state = joined.select(
        "doc_id", "source", "tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), "docs"
    )
    most = quota.agg(F.coalesce(F.max("docs"), F.lit(0)).alias("m")).head().m
    blocks, parts, taken = -(-most // block), [], 0
    while True:
        last = blocks <= 1
        size = F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("int")
        placed = state.where("p > 0 AND p < 1").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(taken)), size))
        flown = placed.groupBy("source", "block").applyInPandas(_flier(seed, taken, last), "doc_id long, source string, tokens long, whole int, p double, docs long")
        parts.append(state.where("NOT (p > 0 AND p < 1)"))
        if last:
            parts.append(flown)
            break
        # Two units a block stay: the next round has that many documents.
        state = settle(flown).withColumn("docs", 2 * F.ceil(F.col("docs") / block))
        blocks, taken = -(-2 * blocks // block), taken + 1
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    plan = all_.select("doc_id", "source", "tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies")).where("copies > 0")
    plan = settle(plan)
    reached = plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most_copies"))
    whole = reached.agg(F.coalesce(F.sum("reached"), F.lit(0)).alias("reached_total"))
    report = quota.join(reached, "source", "left").crossJoin(whole).fillna(0, ["reached", "most_copies"])
    report = report.select(
        "source", "share", "max_repeats", "docs", "size", "target", "most", "reached", "most_copies",
        (F.col("reached") + 2 * F.col("largest") < F.col("target")).alias("short"),
        F.when(F.col("total") > 0, F.col("reached") / F.col("total")).alias("share_of_input"),
        F.when(F.col("reached_total") > 0, F.col("reached") / F.col("reached_total")).alias("share_reached"),
    )
    return plan, report


def expand(plan: DataFrame) -> DataFrame:
    """The plan with one row for each copy: doc_id, source, tokens, copy (from 0)."""
    return plan.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
