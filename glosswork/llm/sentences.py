"""Sentence units of texts in any script and layout, as code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.lang import SEEDS

# Abbreviations by how a full stop after them reads. The languages that a word belongs to stand in front.
NEVER_LAST = {
    "en": "dr mr mrs ms prof st vs cf i.e e.g approx viz",
    "de": "dr prof hr fr z.b d.h bzw ca vgl ggf evtl sog",
    "fr": "dr m mm mme mlle p.ex c.-à-d env cf",
    "es": "sr sra srta dr dra d p.ej aprox vid",
    "pt": "sr sra dr dra p.ex aprox",
    "it": "sig dott prof es p.es ca cfr",
    "ru": "см т.е ок напр г-н гр проф",
    "uk": "див напр проф бл",
    "pl": "zob np dr prof m.in ok tzn tj",
    "tr": "örn dr prof bkz yakl",
}
BEFORE_NUMBER = {
    "en": "no nos fig figs sec ch vol p pp eq art ver",
    "de": "nr abb s kap bd art abs tab",
    "fr": "n no fig p pp art chap l'art",
    "es": "núm n fig pág págs p art cap",
    "pt": "n núm fig pág p art cap",
    "it": "n fig pag p art cap",
    "ru": "стр с рис гл п ст им",
    "uk": "с стор мал рис гл п ст",
    "pl": "s str rys nr rozdz poz",
    "tr": "s no şek böl",
}
MAY_BE_LAST = {
    "en": "etc sec min hr hrs al inc ltd co a.m p.m",
    "de": "usw usf etc u.a min std",
    "fr": "etc min",
    "es": "etc min",
    "pt": "etc min",
    "it": "ecc etc min",
    "ru": "т.д т.п др мин сек руб тыс",
    "uk": "т.д т.п ін хв сек тис",
    "pl": "itd itp min godz",
    "tr": "vb vs dk",
}
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"



def _class(pattern: str) -> str:
    """The characters of a Unicode property, as the `regex` library knows them, escaped for a class of `re`."""
    return "".join(map(re.escape, regex.findall(pattern, _EVERY)))


# Character properties: the classes of the sentence break rules that decide here.
_EVERY = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
STERM = _class(r"\p{Sentence_Break=STerm}")
ATERM = _class(r"\p{Sentence_Break=ATerm}")
CLOSE = _class(r"(?=[\p{Pe}\p{Pf}\"'])\p{Sentence_Break=Close}")
GO_ON = frozenset(regex.findall(r"\p{Sentence_Break=SContinue}", _EVERY)) - frozenset("-–—") | frozenset(";；)]}»›）」』")
del _EVERY
# Marks after which a blank is usual; with all others the sentence ends where they stand. The dots of an ellipsis and the strokes of Tibetan end
# sentences too, though the property does not list them.
SPACED = "!?‼⁇⁈⁉؟۔"
WIDE = frozenset(re.sub(r"\\(.)", r"\1", STERM)) - frozenset(SPACED) | frozenset("．།༎")
_WIDE = "".join(map(re.escape, sorted(WIDE)))
END = re.compile(rf"([{_WIDE}]+|[{ATERM}{re.escape(SPACED)}…‥]+)((?:[{CLOSE}*]|(?<=[.!?])“|[\u00a0\u202f\u2009]»)*)(\s*)")


def _tail(words: dict[str, str]) -> dict[str, re.Pattern[str]]:
    """For each language a pattern for a text that ends with one of its abbreviations and the full stop; inner stops may be followed by a blank. `any` has them all."""

    def pattern(forms: set[str]) -> re.Pattern[str]:
        body = "|".join(r"\.\s?".join(map(re.escape, w.split("."))) for w in sorted(forms, key=lambda w: (-len(w), w)))
        return re.compile(rf"(?:^|[^\w'-])(?:{body})\.$", re.I)

    return {"any": pattern({w for line in words.values() for w in line.split()}), **{lang: pattern(set(line.split())) for lang, line in words.items()}}


NEVER, NUMBER, MAYBE = map(_tail, (NEVER_LAST, BEFORE_NUMBER, MAY_BE_LAST))
WORDS = re.compile(r"[^\W\d_]+")
# Function words with their languages; a word that several have counts for each in part, one of a single letter for none.
COMMON: dict[str, list[str]] = {}
for _lang, _line in SEEDS.items():
    for _word in _line.split():
        if len(_word) > 1:
            COMMON.setdefault(_word, []).append(_lang)


def _language(text: str, start: int, at: int, end: int) -> str:
    """The language around an abbreviation that ends at `at`, among those of its script, by the function words of what stands before it in its sentence and after it up to the next mark; `any` where they do not tell clearly."""
    after = STOP.search(text, at, end)
    end = after.start() if after else end
    cyrillic = text[at - 2] >= "\u0400"
    counts = dict.fromkeys(("ru", "uk") if cyrillic else [x for x in SEEDS if x not in ("ru", "uk")], 0.0)
    for w in WORDS.findall(text, max(start, at - 100), min(end, at + 60)):
        langs = COMMON.get(w.lower(), ())
        for lang in langs:
            if lang in counts:
                counts[lang] += 1 / len(langs)
    first, second, *_ = sorted(counts.values(), reverse=True)
    return max(counts, key=counts.__getitem__) if first >= 1.5 and first >= 2 * second else "any"


STOP = re.compile(rf"[{STERM}{ATERM}]")
INITIAL = re.compile(r"(?:^|[^\w.])[^\W\d_]\.$")
ORDINAL = re.compile(r"\d\.$")
MONTH = re.compile(rf"\s*(?:{'|'.join(MONTHS.split())})\b")
LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ]|$)")
QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]+")
BULLET = re.compile(r"[ \t]*[-*+•‣◦▪·–][ \t]+(?=\S)")
NUMBERED = re.compile(r"[ \t]*(?:\(?(\d{1,4})[.)]|[a-z]\))[ \t]+(?=\S)")
UNDERLINE = re.compile(r"\s*(?:={3,}|-{3,}|~{3,})\s*$")
THAI = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
THAI_ANY = re.compile(r"[฀-๿]")
IDENTIFIER = re.compile(r"\w+_\w+|[a-z]+[A-Z]\w*|\w+(?=\.\w+\(|\(\))")
PART = re.compile(r"[^\W_]{3,}")
WORD = re.compile(r"\w+")
LAST = re.compile(rf"[{STERM}{ATERM}…‥།༎][{CLOSE}“*\s]*$")
QUOTES = re.compile(r"[“‘「『«”’」』»]")
PAIRS = {"”": "“", "’": "‘", "」": "「", "』": "『", "»": "«"}
OPENERS = "\"'“”‘„«‹(¿¡「『（【[*"


class Names:
    """Identifiers of a text: words with an underscore or inner capital, and the parts of such words."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.parts: set[str] | None = None

    def at(self, text: str, at: int) -> bool:
        """Whether the word at `at` is an identifier."""
        if IDENTIFIER.match(text, at):
            return True
        if self.parts is None:
            self.parts = {p.lower() for w in IDENTIFIER.findall(self.text) for p in PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", w))} - {"get", "set", "the"}
        m = WORD.match(text, at)
        return bool(m) and m.group().lower() in self.parts


def _unbroken(before: str, mark: str, closers: str, gap: str, text: str, at: int, names: Names, told: bool, stretch: tuple[int, int]) -> bool:
    """Whether the sentence goes on at `at`, after an end mark, its closers and a gap; abbreviations are those of the language of the stretch. `told` is whether a colon introduces the quotation that is open."""
    after = text[at]
    if mark[-1] in WIDE and mark[-1] not in ".!?":
        if not closers or gap:
            return False
        return not told
    if after in GO_ON or (after in "—–-" and closers):
        return True
    lower = after.islower()
    dots = "…" in mark or mark.endswith("..")
    if not gap:
        if dots and not after.isupper():
            return True
        if after in OPENERS:
            return not (after in "¿¡„«「“" or (closers and after != '"'))
        if not after.isalpha():
            return True
        prior = before[-2:]
        if after.isupper():
            return not (closers or len(prior) == 2 and (prior.islower() and not prior[0].isspace() or prior[-1].isdigit() or not prior[-1].isascii() or mark[-1] in "!?"))
        return lower or not (closers or prior[-1:].isalpha() and not prior[-1:].isascii())
    lower = lower and not names.at(text, at)
    if closers and lower:
        return True
    if mark == ".":
        head = before[-16:] + "."
        never, number, maybe = NEVER["any"].search(head), NUMBER["any"].search(head), MAYBE["any"].search(head)
        if never or number or maybe:
            lang = _language(text, stretch[0], at - len(closers) - len(gap), stretch[1])
            if never and NEVER.get(lang, NEVER["any"]).search(head):
                return True
            if number and (after.isdigit() or lower) and NUMBER.get(lang, NUMBER["any"]).search(head):
                return True
            if maybe and lower and MAYBE.get(lang, MAYBE["any"]).search(head):
                return True
        if INITIAL.search(head) and not head[-2].isdigit() and (after.isalpha() and len(re.match(r"\w*", text[at : at + 4]).group()) <= 2 or lower and not closers and len(head.rstrip(".").split()[-1]) == 1 and head[-2].islower() and head[-2].isascii()):
            return True
        if ORDINAL.search(head) and MONTH.match(text, at):
            return True
        return False
    return lower and dots


def _cut(text: str, start: int, end: int, names: Names) -> Iterator[tuple[int, int]]:
    """The units of one block whose inner line breaks are blanks already."""
    begin = seen = start
    cuts: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in END.finditer(text, start, end):
        if m.end() >= end:
            continue
        mark, closers, gap = m.groups()
        for q in QUOTES.finditer(text, seen, m.start()):
            if q.group() not in PAIRS:
                opened.append(q.start())
            elif opened and text[opened[-1]] == PAIRS[q.group()]:
                opened.pop()
        seen = m.start()
        told = bool(opened) and opened[-1] > start and text[opened[-1] - 1] in ":："
        if not _unbroken(text[max(start, m.start() - 120) : m.start()], mark, closers, gap, text, m.end(), names, told, (cuts[-1][1] if cuts else start, end)):
            cuts.append((m.end() - len(gap), m.end()))
    if THAI_ANY.search(text, start, end):
        cuts += [(m.start(), m.end()) for m in THAI.finditer(text, start, end)]
        cuts = sorted(set(cuts))
    for stop, next_ in cuts:
        if stop > begin:
            yield begin, stop
        begin = max(begin, next_)
    if begin < end:
        yield begin, end


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text; end marks and closers belong to a unit, layout marks before it do not."""
    lines = []  # (kind, start, end) of the content; kind: blank, head, item, quote depth and text
    number, before = 0, "blank"
    for m in LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        end = a + len(m.group().rstrip())
        depth, kind = "", "text"
        if q := QUOTE.match(text, a, end):
            a, depth = q.end(), text[q.start() : q.end()].replace(" ", "").replace("\t", "")
        if text[a:end].strip() == "":
            kind, number = "blank", 0
        elif UNDERLINE.match(text, a, end) and end - a >= 3:
            kind = "rule"
        elif h := HEADING.match(text, a, end):
            a, kind = h.end(), "head"
        elif h := BULLET.match(text, a, end):
            a, kind = h.end(), "item"
        elif (h := NUMBERED.match(text, a, end)) and (h.group(1) is None or before in ("blank", "head") or int(h.group(1)) == number + 1):
            a, kind, number = h.end(), "item", int(h.group(1) or 0)
        while a < end and text[a].isspace():
            a += 1
        lines.append((kind, depth, a, end))
        before = kind
    names = Names(text)
    return [u for block in _blocks(text, lines, names) for u in _trimmed(block, names)]


def _trimmed(block: tuple[str, int, int], names: Names) -> Iterator[tuple[int, int]]:
    work, start, end = block
    for a, b in _cut(work, start, end, names):
        while a < b and work[a].isspace():
            a += 1
        while b > a and work[b - 1].isspace():
            b -= 1
        if any(c.isalnum() for c in work[a:b]):
            yield a, b


def _blocks(text: str, lines: list[tuple[str, str, int, int]], names: Names) -> Iterator[tuple[str, int, int]]:
    """(working text, start, end) of each block; the working text has blanks for line breaks and marks inside a block."""
    groups: list[list[tuple[int, int]]] = []
    before = ("blank", "")
    for kind, depth, a, end in lines:
        if kind in ("blank", "rule"):
            before = ("blank", depth)
            continue
        joins = kind == "text" and before[0] in ("text", "item") and before[1] == depth
        if joins and groups:
            groups[-1].append((a, end))
        else:
            groups.append([(a, end)])
        before = (kind, depth)
    wrapped = not _by_line(text, groups, names)
    for group in groups:
        run = [group[0]]
        for a, end in group[1:]:
            p, q = run[-1]
            if wrapped or LAST.search(text, p, q):
                run.append((a, end))
            else:
                yield _joined(text, run)
                run = [(a, end)]
        yield _joined(text, run)


def _by_line(text: str, groups: list[list[tuple[int, int]]], names: Names) -> bool:
    """Whether a text is written in lines: no line of a longer block holds an inner boundary, and most lines start like a sentence."""
    starts = lower = 0
    for group in groups:
        if len(group) < 2:
            continue
        for k, (a, end) in enumerate(group):
            if sum(1 for _ in _cut(text, a, end, names)) > 1:
                return False
            if k:
                starts += 1
                lower += text[a].islower() and not names.at(text, a)
    return starts > 0 and lower <= 0.2 * starts


def _joined(text: str, run: list[tuple[int, int]]) -> tuple[str, int, int]:
    start, end = run[0][0], run[-1][1]
    if len(run) == 1:
        return text, start, end
    parts, at = [text[:start]], start
    for a, b in run:
        parts += [" " * (a - at), text[a:b]]
        at = b
    return "".join(parts), start, end


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence unit of every document, offsets in code points, end exclusive.

    Null ids and null or blank texts give no rows; a row that is repeated gives its units again. A line break is
    taken as white space inside a sentence unless the text is written in lines without end marks; headings and list
    entries are units of their own. Each document is worked on alone, so nothing is shuffled.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for a, e in units(text):
                    ids.append(i)
                    starts.append(a)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_char", "end_char"])

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(f, "doc_id long, start_char int, end_char int")
