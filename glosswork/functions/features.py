"""Features of comments as column expressions: markers, idioms, verb form, surface flags, classes, exclusion reasons, cleaning."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions import lexicon
from glosswork.functions import text as T


def form(phrase: str) -> str:
    """A phrase in the form that `text.match_view` gives texts."""
    return re.sub(r"\s+", " ", phrase.lower().replace("&", " and ").replace("-", " ")).strip()


def phrases(forms: str) -> str:
    """One pattern for phrases that are separated by `|`: the longest first, bounded by what is no letter, digit, quote or slash."""
    ordered = sorted({form(f) for f in forms.split("|") if f.strip()}, key=lambda f: (-len(f), f))
    return rf"(?<![a-z0-9'/])({'|'.join(map(re.escape, ordered))})(?![a-z0-9'/])".replace(r"\ ", " ")


def marker_counts(text: Column, markers: Mapping[str, str] = lexicon.MARKERS) -> dict[str, Column]:
    """Hits of each category. `I` counts as first person only as a capital; BUG, OPTIMIZE, REVIEW and HACK are tags only in capitals."""
    view = T.match_view(T.strip_refs(text))
    out = {}
    for category, forms in markers.items():
        if category == "first_person":
            forms = "|".join(f for f in forms.split("|") if form(f) != "i")
        n = F.regexp_count(view, F.lit(phrases(forms)))
        if category == "first_person":
            n = n + F.regexp_count(T.normalize(text), F.lit(r"(?<![A-Za-z0-9/])I(?![A-Za-z0-9/'])"))
        if category == "tag":
            n = n + F.regexp_count(text, F.lit(r"(?<![A-Za-z])(?:BUG|OPTIMI[SZ]E|REVIEW|HACK)(?![A-Za-z])"))
        out[category] = n
    return out


def has_cue(text: Column, markers: Mapping[str, str] = lexicon.MARKERS, explanatory: Sequence[str] = lexicon.EXPLANATORY) -> Column:
    """Whether the comment has a marker of an explanatory category: one pattern for all of them. False for null."""
    view = T.match_view(T.strip_refs(text))
    both = view.rlike(phrases("|".join(markers[c] for c in explanatory)))
    tags = text.rlike(r"(?<![A-Za-z])(?:BUG|OPTIMI[SZ]E|REVIEW|HACK)(?![A-Za-z])") if "tag" in explanatory else F.lit(False)
    return F.coalesce(both | tags, F.lit(False))


def idioms(text: Column, known: Sequence[tuple[str, str, str, str]] = lexicon.IDIOMS) -> Column:
    """Names of the idioms of a comment, each once, in the order of the text; where forms overlap the longest counts."""
    names: dict[str, str] = {}
    for name, _, _, forms in known:
        for f in forms.split("|"):
            names.setdefault(form(f), name)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    hits = F.regexp_extract_all(T.match_view(T.strip_refs(text)), F.lit(phrases("|".join(names))), 1)
    return F.array_distinct(F.transform(hits, lambda h: table[h]))


def verb_form(text: Column, verbs: Sequence[str] = tuple(lexicon.CODE_VERBS)) -> Column:
    """imperative, third_person or gerund by the first word of the comment, else null."""
    word = F.lower(F.regexp_extract(T.normalize(text), r"^[^A-Za-z0-9_]*([A-Za-z]+)", 1))

    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))

    doubled = word.rlike(r"([a-z])\1ing$") & (F.length(word) > 5)
    gerund = word.endswith("ing") & (cut(3).isin(*verbs) | F.concat(cut(3), F.lit("e")).isin(*verbs) | doubled & cut(4).isin(*verbs))
    third = word.endswith("ies") & F.concat(cut(3), F.lit("y")).isin(*verbs) | word.endswith("es") & cut(2).isin(*verbs) | word.endswith("s") & cut(1).isin(*verbs)
    return F.when(word.isin(*verbs), "imperative").when(third, "third_person").when(gerund, "gerund")


def flags(text: Column) -> dict[str, Column]:
    """Surface features: words, question, closing period, capital at the start, URL, issue reference."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.substring(bare, 1, 1)
    return {
        "n_words": F.size(T.comment_words(text)), "is_question": bare.endswith("?"), "ends_with_period": bare.endswith("."), "starts_upper": (first != F.lower(first)),
        "has_url": text.rlike(r"https?://\S|www\.\S"), "has_issue_ref": text.rlike(r"(?<![\w&])#\d{1,7}\b|\b[A-Z][A-Z0-9]+-\d+\b|\b(?:gh|GH)-\d+\b"),
    }


def classify(overlap: Column, cue: Column, theta: float = 0.5) -> Column:
    """explanatory where there is a cue; else null without an overlap; else referential from `theta` on, and other."""
    return F.when(cue, "explanatory").when(overlap.isNull(), None).when(overlap >= theta, "referential").otherwise("other")


def rule_label(overlap: Column, cue: Column, theta: float | Column = 0.5) -> Column:
    """The label of the rule for rows that people labelled: like `classify` with a margin of 1e-12, and never null."""
    return F.when(cue, "explanatory").when(overlap >= F.lit(theta) - 1e-12, "referential").otherwise("other")


# What people write for a label.
ALIASES = {"r": "referential", "ref": "referential", "referential": "referential", "e": "explanatory", "exp": "explanatory", "explanatory": "explanatory", "o": "other", "other": "other"}


def label_of(written: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    """The label that is meant, in any case and with outer blanks; null for others."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(written)))


def steps(value: Column, names: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first bound, from the highest on, that the size of a value reaches."""
    out = F.lit(below)
    for bound, name in sorted(names):
        out = F.when(F.abs(value) >= bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def kappa_word(value: Column) -> Column:
    return F.when(value < 0, "poor").otherwise(steps(value, [(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair")], "slight"))


def delta_word(value: Column) -> Column:
    return steps(value, [(0.474, "large"), (0.33, "medium"), (0.147, "small")], "negligible")


# Cleaning of comments as they stand in source files.


def is_doc(raw: Column) -> Column:
    """Whether the marks of a comment make it documentation: /** /*! /// //!, but neither /**/ nor ////."""
    return raw.rlike(r"^\s*(?:/\*[*!](?!/)|//[/!])") & ~raw.rlike(r"^\s*////")


def clean_line(raw: Column) -> Column:
    """A line comment without its mark."""
    return F.trim(F.regexp_replace(raw, r"^\s*(?:#+|//+!?|;+)", ""))


def clean_block(raw: Column) -> Column:
    """A block comment without its marks and the stars that begin its lines."""
    body = F.regexp_replace(raw, r"^\s*/\*+!?|\*+/\s*$", "")
    return F.trim(F.regexp_replace(body, r"(?m)^[ \t]*\*+[ \t]?", ""), F.lit(" \n\r\t"))


def language_of(ext: Column, content: Column) -> Column:
    """The programming language by extension; a `.h` with classes, namespaces, templates or `std::` is C++."""
    names = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    header = F.when(content.rlike(r"\b(?:class|namespace|template)\b|std::"), "cpp").otherwise("c")
    return F.when(F.lower(ext) == ".h", header).otherwise(F.try_element_at(table, F.lower(ext)))


# Comments that speak to tools.
DIRECTIVE = (
    r"(?i)^(?:!/|-\*-.*-\*-|(?:type|noqa|pylint|flake8|isort|fmt|mypy|pragma|ruff|pyright|nosec|pytype)\b\s*[:\s]|(?:region|endregion)\b|eslint[- ](?:disable|enable)"
    r"|@ts-(?:ignore|expect-error|nocheck|check)|prettier-ignore|istanbul\s+ignore|@(?:flow|jsx|license|preserve|vitest-environment|jest-environment)\b"
    r"|go:(?:build|generate|embed|noinline)|\+build|nolint|lint:|clang-format\s+(?:on|off)|noinspection|NOPMD|CHECKSTYLE|NOSONAR|<reference\s)"
)
LICENSE = r"(?i)SPDX-License-Identifier|copyright\s*(?:\(c\)|©|\d{4})"
LICENSE_WORDS = r"(?i)licen[cs]e|all rights reserved|permission is hereby granted|without warranty|apache license|mit license|gnu (?:general )?public"
# Lines that read as code: an end mark, an assignment, a call, a keyword with a block, a bare statement.
CODE_LINE = (
    r"[;{}]\s*$|^[\w.\[\]\"']+\s*[-+*/|&]?=(?:[^=\s]|\s+\S)|^[\w.]+\([^)]*\)\s*;?$"
    r"|^(?:if|for|while|def|class|return|import|from|elif|else|try|except|catch|switch|case|var|let|const|function|fmt\.|console\.|print|self\.)\b.*[:{(;]\s*$"
    r"|^(?:return|break|continue|pass|raise|throw|else|try|finally)\s*;?$"
)
SKIP_PATHS = (
    r"(?:^|/)(?:node_modules|vendors?|third[_-]?party|dist|build|\.venv|site-packages|generated)/|\.min\.(?:js|css)$|\.bundle\.js$|_pb2(?:_grpc)?\.py$|\.pb\.go$|(?:^|/)package-lock\.json$|\.generated\."
)


def looks_like_code(text: Column, share: float = 0.6) -> Column:
    """Whether 60 % or more of the lines that are not blank read as code. False without such lines."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE)))
    return F.coalesce((F.size(lines) > 0) & (hits >= share * F.size(lines)), F.lit(False))


def exclusion_reason(text: Column, line: Column, head: int = 40) -> Column:
    """empty, directive, license or code, the first that holds, else null. Words of licences count in the first `head` lines of a file."""
    licence = text.rlike(LICENSE) | (line <= head) & text.rlike(LICENSE_WORDS)
    return F.when(text.isNull() | ~text.rlike("[A-Za-z0-9]"), "empty").when(F.ltrim(text).rlike(DIRECTIVE), "directive").when(licence, "license").when(looks_like_code(text), "code")


def observation_id(*parts: str) -> Column:
    """Twelve hexadecimal digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 12)


def safe_path(path: Column, most: int = 240) -> Column:
    """A path without characters that file systems refuse; a longer one becomes the start of its SHA-1 and its end."""
    plain = F.regexp_replace(path, r'[<>:"|?*\x00-\x1f]', "_")
    return F.when(F.length(plain) > most, F.concat(F.substring(F.sha1(path), 1, 16), F.lit("_"), F.substring(plain, -100, 100))).otherwise(plain)


def chunks(text: Column, code: Column, paraphrases: Mapping[str, str] = lexicon.PARAPHRASES) -> Column:
    """The comment cut at white space, each part with a state: 1 has a word of the code, 2 one that paraphrases it, 3 a new one, 0 none."""
    table = F.create_map(*[x for k, v in paraphrases.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    theirs = F.array_distinct(T.identifier_words(code))
    said = F.flatten(F.filter(F.transform(theirs, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()))

    def state(part: Column) -> Column:
        own = F.array_except(F.array_distinct(T.identifier_words(T.normalize(part))), F.array(*map(F.lit, T.STOPWORDS)))
        return F.when(F.arrays_overlap(own, theirs), 1).when(F.arrays_overlap(own, said), 2).when(F.size(own) > 0, 3).otherwise(0)

    return F.transform(F.filter(F.split(text, r"\s+"), lambda p: p != ""), lambda p: F.struct(p.alias("part"), state(p).alias("state")))
