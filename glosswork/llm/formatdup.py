"""Duplicates hidden by formatting: radix partitioning on canonical bytes, counting in tries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.plans.common import settle

FIELD = r"(?U)(?:^|[\s;])(?:@[\w.-]+\s+\S|[\w.-]+=\S)"
PIECES = r"\R|;|(?=@)"
STEP = 8
SHARED = (8, 64, 512, 4096)
FRONTIER = 2000
FLUSH = 400_000
FLUSH_BYTES = 64_000_000


def letters(text: Column) -> Column:
    """Lower-cased letters and digits (Unicode L and N) of a text."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical(text: Column) -> Column:
    """The canonical form: letters and digits in order; for a text with fields its non-empty pieces in sorted order."""
    pieces = F.array_join(F.array_sort(F.filter(F.transform(F.split(text, PIECES), letters), lambda p: p != "")), "\x01")
    return F.when(text.rlike(FIELD), pieces).otherwise(letters(text))


def radix_buckets(keys: DataFrame, cap: int) -> tuple[list[tuple[int, list[bytes]]], int]:
    """The oversized prefixes by level, and the length at which the last of them are cut.

    At each level buckets of more than max(cap, rows / FRONTIER) rows are split by STEP further bytes; bytes that all
    keys of every such bucket share are passed over at once. `keys` has the binary column `key`. These levels only
    spread the rows: a level can hold FRONTIER oversized prefixes at the most, so what reaches the driver is bounded.
    What is still above `cap` is split further where it is counted (see `_count_buckets`). A bucket that holds copies
    of one key is not split: the counters take it.
    """
    total = keys.count()
    most = max(cap, -(-total // FRONTIER))
    levels: list[tuple[int, list[bytes]]] = []
    depth, rows, whole = STEP, keys, F.xxhash64("key")
    while True:
        prefix = F.substring("key", 1, depth).alias("p")
        over = rows.groupBy(prefix).agg(F.count("*").alias("n"), F.min(whole).alias("low"), F.max(whole).alias("high")).where((F.col("n") > most) & (F.col("low") != F.col("high")))
        found = [bytes(r.p) for r in over.select("p").collect()]
        if not found:
            return levels, depth
        levels.append((depth, found))
        table = keys.sparkSession.createDataFrame([(bytearray(p),) for p in found], "_p binary")
        rows = rows.join(F.broadcast(table), F.substring("key", 1, depth) == F.col("_p"), "left_semi")
        further = [F.xxhash64(F.substring("key", depth + 1, n)) for n in SHARED]
        shared = rows.groupBy(prefix).agg(*(F.min(h).eqNullSafe(F.max(h)).alias(str(n)) for h, n in zip(further, SHARED))).agg(*(F.bool_and(str(n)).alias(str(n)) for n in SHARED)).head()
        depth += STEP + max((n for n in SHARED if shared[str(n)]), default=0)


def bucket_of(key: Column, levels: list[tuple[int, list[bytes]]], deepest: int) -> Column:
    """The bucket of a key: its shortest prefix that is not oversized."""
    bucket = F.substring(key, 1, deepest)
    for depth, over in reversed(levels):
        prefix = F.substring(key, 1, depth)
        bucket = F.when(prefix.isin([F.lit(bytearray(p)) for p in over]), bucket).otherwise(prefix)
    return bucket


class Trie:
    """Canonical keys, STEP bytes an edge. A key that shares no further edge is one leaf: [rest of it, copies, smallest id]."""

    __slots__ = ("root", "size", "bytes")

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = self.bytes = 0

    def add(self, key: bytes, n: int, least: int) -> None:
        node, at = self.root, 0
        while True:
            part = key[at : at + STEP]
            at += STEP
            found = node.get(part)
            if found is None:
                node[part] = [key[at:], n, least]
                self.size += 1
                self.bytes += len(key)
                return
            if type(found) is dict:
                node = found
                continue
            rest = found[0]
            if rest == key[at:]:
                found[1] += n
                if least < found[2]:
                    found[2] = least
                return
            found[0] = rest[STEP:]
            node[part] = node = {rest[:STEP]: found}

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for part, below in node.items():
                if type(below) is dict:
                    stack.append((path + part, below))
                else:
                    yield path + part + below[0], below[1], below[2]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, n, least = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], ["key", "n", "keep_id"])


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation before the shuffle; the trie is given out whenever it holds FLUSH keys or FLUSH_BYTES of them."""
    trie = Trie()
    for b in batches:
        for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.add(key, 1, i)
        if trie.size > FLUSH or trie.bytes > FLUSH_BYTES:
            yield _batch(list(trie.items()))
            trie = Trie()
    yield _batch(list(trie.items()))


def _bucket_counter(cap: int, least_copies: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts the keys of one bucket after another. Rows come ordered by bucket and key, so that a bucket of more than `cap` keys is split by the bytes at which it is full: all rows of a key stand together."""
        at = last = None
        trie = Trie()
        for b in batches:
            for bucket, key, n, least in zip(*(b.column(i).to_pylist() for i in range(4))):
                if bucket != at or key != last and (trie.size >= cap or trie.bytes > FLUSH_BYTES):
                    if trie.size:
                        yield _batch([x for x in trie.items() if x[1] >= least_copies])
                    at, trie = bucket, Trie()
                trie.add(key, n, least)
                last = key
        yield _batch([x for x in trie.items() if x[1] >= least_copies])

    return count


def _counted(df: DataFrame, id_col: str, group_col: str, text_col: str, cap: int, least_copies: int) -> tuple[DataFrame, DataFrame]:
    """(keys, counts): the key and copy_id of every row that has one, written once; key, n and keep_id of each key with so many copies.

    A key is a hash of the group, which spreads the first bytes, the canonical text, and the group itself.
    """
    canon = canonical(F.col(text_col))
    source = df.where(F.col(id_col).isNotNull() & F.col(group_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("copy_id"), F.col(group_col).alias("g"), canon.alias("c")
    )
    key = F.concat(F.substring(F.unhex(F.md5(F.col("g").cast("string"))), 1, 8), F.concat(F.col("c"), F.lit("\x00"), F.col("g")).cast("binary"))
    keys = settle(source.where("c != ''").select(key.alias("key"), "copy_id"))
    levels, deepest = radix_buckets(keys, cap)
    partial = keys.mapInArrow(_count_partition, "key binary, n long, keep_id long")
    placed = partial.select(bucket_of(F.col("key"), levels, deepest).alias("bucket"), "key", "n", "keep_id")
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "key")
    return keys, ordered.mapInArrow(_bucket_counter(cap, least_copies), "key binary, n long, keep_id long")


def copies(df: DataFrame, id_col: str = "comment_id", group_col: str = "repo", text_col: str = "text", cap: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(sets, members) of rows of one group whose texts differ in formatting only.

    sets: key digest, keep_id (the smallest id), n (copies). members: keep_id, copy_id, one row for each member
    but the kept one. Rows with a null id, group or text, and texts without letters and digits, are left out. Empty
    input gives empty results.

    The canonical keys are written once and read by every later pass. Identical keys are counted in tries inside each input partition first, so one key that holds a third of all
    rows reaches its bucket as one row for each partition. In the join that names the members such a key is salted:
    keys with more rows than a thousandth of the total (a thousand keys at the most) spread over several tasks.
    """
    keys, counted = _counted(df, id_col, group_col, text_col, cap, 2)
    sets = settle(counted.select(F.md5("key").alias("digest"), "n", "keep_id"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).head().s
    part = max(20_000, -(-total // 1000))
    hot = sets.where(F.col("n") > part).select("digest", F.ceil(F.col("n") / part).alias("salts"))
    spread = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > part, F.ceil(F.col("n") / part) - 1).otherwise(0).cast("int"))))
    members = (
        keys.select(F.md5("key").alias("digest"), "copy_id")
        .join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("copy_id"), F.col("salts"))).cast("int"))
        .join(spread.select("digest", "salt", "keep_id"), ["digest", "salt"])
        .where(F.col("copy_id") != F.col("keep_id"))
        .select("keep_id", "copy_id")
    )
    return sets, members


def collapse(df: DataFrame, id_col: str = "comment_id", group_col: str = "repo", text_col: str = "text", cap: int = 50_000) -> DataFrame:
    """One row for each set of copies and each single record: keep_id, n (its number of copies, 1 for a single one).

    Records that `copies` leaves out are not part of the result.
    """
    return _counted(df, id_col, group_col, text_col, cap, 1)[1].select("keep_id", "n")
