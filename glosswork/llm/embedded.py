"""Natural language in comments and in string literals of code: extraction, languages, shares of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.lang import SAMPLE, UND, Model, fitted, stretches, stretches_of, tokens
from glosswork.plans.common import settle

_DOUBLE = r'"""(?P<a>.*?)(?:"""|\Z)|"(?P<b>(?:[^"\\\n]|\\.)*)(?:"|(?=\n)|\Z)'
_SINGLE = r"'''(?P<c>.*?)(?:'''|\Z)|'(?P<d>(?:[^'\\\n]|\\.)*)(?:'|(?=\n)|\Z)"
_CHAR = r"'(?:\\.[^']{0,8}|[^'\\\n])'"
_TICK = r"`(?P<e>(?:[^`\\]|\\.)*)(?:`|\Z)"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
LITERALS = {
    "python": re.compile(rf"{_DOUBLE}|{_SINGLE}|\#[^\n]*", re.S),
    "script": re.compile(rf"{_DOUBLE}|{_SINGLE}|{_TICK}|{_SLASHES}", re.S),
    "go": re.compile(rf"{_DOUBLE}|{_TICK}|{_CHAR}|{_SLASHES}", re.S),
    "other": re.compile(rf"{_DOUBLE}|{_CHAR}|{_SLASHES}", re.S),
}
FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "go": "go"}
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(.))", re.S)
SINGLE = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\n": ""}
QUERY = re.compile(r"\s*(?:(?i:select)\b.*\b(?i:from)\b|(?i:insert)\s+(?i:into)\b|(?i:update)\s+\S+\s+(?i:set)\b|(?i:delete)\s+(?i:from)\b|(?i:create|alter|drop)\s+(?i:table|index|view)\b)", re.S)
MACHINE = re.compile(r"\s*(?:<[/!?a-zA-Z][^<>]*>|[\[{].*[\]}]\s*$|--?\w[\w-]*=|\^|/\^)", re.S)
SPACED = re.compile(r"\S*[^\W\d_]\S*")
UNSPACED = {"zh", "ja", "th"}
SENTENCE = re.compile(r"[。！？｡．]")


def literals(code: str, lang: str | None) -> Iterator[str]:
    """The decoded string literals of a piece of code; one that the piece cuts off is taken up to its end."""
    for m in LITERALS[FAMILY.get((lang or "").strip().lower(), "other")].finditer(code):
        if m.lastgroup:
            body = m.group(m.lastgroup)
            yield decoded(body) if "\\" in body else body


def decoded(body: str) -> str:
    def one(m: re.Match[str]) -> str:
        digits = m[1] or m[2] or m[3] or m[4]
        if digits:
            n = int(digits, 16)
            return chr(n) if n <= 0x10FFFF else ""
        return SINGLE.get(m[5], m[5])

    text = ESCAPE.sub(one, body)
    try:
        return text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeError:
        return text


def prose(text: str, model: Model, words: int = 4) -> list[tuple[str, int, int]]:
    """(lang, start, end) of the prose of a literal: `words` words or more, or a sentence where words are not spaced.

    Queries, paths, patterns, markup, keys and the like are none: of their words, fewer than half are words of a language.
    """
    if len(text) < 4 or QUERY.match(text) or MACHINE.match(text):
        return []
    toks = list(tokens(text))
    out = []
    for lang, _, first, end in stretches(toks, model):
        part = toks[first:end]
        a, b = part[0][2], part[-1][3]
        known = [t for t in part if model.score(t[0], t[1])]
        if lang in UNSPACED:
            letters = sum(len(t[1]) for t in known)
            if letters >= 6 or letters >= 4 and SENTENCE.search(text, b):
                out.append((lang, a, b))
        elif len(known) >= 2 and 2 * len(known) >= len(part):
            spaced = len(SPACED.findall(text, a, b))
            if spaced >= words and 2 * len(part) >= spaced:
                out.append((lang, a, b))
    return out


def embedded(df: DataFrame, model: Model | None = None, most: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each comment, place and language: comment_id, the columns `keep`, place (`text` or `literal`), lang, bytes (UTF-8 of its segments).

    `df` has comment_id, text, text_lang, exclude, repo, code and lang. A null id gives no rows; a null text or code
    has nothing in it. Rows that repeat an id give rows of their own.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fitted(df, most))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out: list[tuple] = []
            for i, text, exclude, code, lang, *more in zip(*(c.to_pylist() for c in b.columns)):
                sums: dict[tuple[str, str], int] = {}
                for l, _, a, e in stretches_of(text, exclude, m):
                    if l == UND:
                        continue
                    sums["text", l] = sums.get(("text", l), 0) + len(text[a:e].encode("utf-8", "replace"))
                if code:
                    for body in literals(code, lang):
                        for l, a, e in prose(body, m):
                            sums["literal", l] = sums.get(("literal", l), 0) + len(body[a:e].encode("utf-8", "replace"))
                out += [(i, *more, place, l, n) for (place, l), n in sums.items()]
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=["comment_id", *keep, "place", "lang", "bytes"])

    types = [pa.int64(), *(pa.string() for _ in keep), pa.string(), pa.string(), pa.int64()]
    rows = df.where("comment_id IS NOT NULL").select(F.col("comment_id").cast("long"), "text", "exclude", "code", F.col("lang").alias("code_lang"), *(F.col(k).cast("string").alias(f"keep_{k}") for k in keep))
    return rows.mapInArrow(f, "comment_id long, " + "".join(f"{k} string, " for k in keep) + "place string, lang string, bytes long")


def file_literals(files: DataFrame, model: Model) -> DataFrame:
    """repo, sha, file, lang, bytes: natural language in the string literals of whole files, each literal once; and `total`, the bytes of the file. A file without any has one row with a null lang."""
    shared = files.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out: list[tuple] = []
            for repo, sha, file, code_lang, content in zip(*(c.to_pylist() for c in b.columns)):
                sums: dict[str | None, int] = {}
                for body in literals(content, code_lang):
                    for l, a, e in prose(body, m):
                        sums[l] = sums.get(l, 0) + len(body[a:e].encode("utf-8", "replace"))
                total = len(content.encode("utf-8", "replace"))
                out += [(repo, sha, file, l, n, total) for l, n in (sums or {None: 0}).items()]
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=["repo", "sha", "file", "lang", "bytes", "total"])

    types = [pa.string()] * 4 + [pa.int64()] * 2
    return files.where("content IS NOT NULL").select("repo", "sha", "file", F.col("lang").alias("code_lang"), "content").mapInArrow(f, "repo string, sha string, file string, lang string, bytes long, total long")


def shares(df: DataFrame, files: DataFrame, model: Model | None = None) -> DataFrame:
    """By file, kind of comment, place and language: bytes of natural language and their share of the file's bytes.

    Texts come from the comments (one that was delivered again counts once, by id), literals from the files, where
    each stands once; their kind is null. Files that are not given have a null share.
    """
    key = ["repo", "sha", "file"]
    model = model or fitted(df)
    once = df.groupBy("id").agg(F.max_by(F.struct("comment_id", "text", "text_lang", "exclude", "lang", *key, "kind"), F.struct("ingested_at", "comment_id")).alias("c")).select("c.*", F.lit(None).cast("string").alias("code"))
    texts = embedded(once, model, keep=(*key, "kind")).groupBy(*key, "kind", "lang").agg(F.sum("bytes").alias("bytes")).withColumn("place", F.lit("text"))
    found = settle(file_literals(files, model))
    inside = found.where("lang IS NOT NULL").groupBy(*key, "lang").agg(F.sum("bytes").alias("bytes")).select(*key, F.lit(None).cast("string").alias("kind"), "lang", "bytes", F.lit("literal").alias("place"))
    totals = found.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.max("total").alias("total"))
    joined = texts.unionByName(inside).join(totals, F.expr(" AND ".join(f"{k} <=> _{k}" for k in key)), "left")
    return joined.select(*key, "kind", "place", "lang", "bytes", F.round(F.try_divide("bytes", "total"), 6).alias("share"))
