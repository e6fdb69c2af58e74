"""Source files that are not valid in their language: packrat parsing of whole files, with place and cause."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.grammars import BOUNDS, TEXTS
from glosswork.llm.peg import BASE, BROKEN, CONFLICT, Grammar

DEPTH = 100_000
LEXEMES_MOST = 200_000
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_SINGLE, _DOUBLE = r"'(?:[^'\\\n]|\\(?s:.))*'", r'"(?:[^"\\\n]|\\(?s:.))*"'
_FSTRING = r"""(?i:r?fr?)(?:"(?:[^"\\\n{}]|\\(?s:.)|\{\{|\}\}|\{[^{}\n]*\})*"|'(?:[^'\\\n{}]|\\(?s:.)|\{\{|\}\}|\{[^{}\n]*\})*')"""
_SLASHES = r"[^\S\n]*+(?:(?://[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)[^\S\n]*+)*+"
_ALL_BLANK = r"\s*+(?:(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)\s*+)*+"
_LINES = ("newline", r"\n\s*")
_COMMENT = ("comment", _BLOCK)
# Lexemes of each language: what is passed over before one, then the kinds; `open` begins what never ends, and takes all that is left.
_PARTS = {
    "python": (
        r"[ \t\f]*+(?:\\\r?\n[ \t\f]*+)*+", ("newline", r"(?:\#[^\n]*)?(?:\r?\n[ \t\f]*(?:\#[^\n]*)?)+|\#[^\n]*"),
        ("str", r"(?i:[rbuft]{0,3})(?:'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\")|" + _FSTRING + "|(?i:[rbuft]{0,3})(?:" + _SINGLE + "|" + _DOUBLE + ")"),
        ("open", r"(?i:[rbuft]{0,3})(?:'''|\"\"\"|['\"])"),
    ),
    "javascript": (_SLASHES, _LINES, _COMMENT, ("str", rf"{_SINGLE}|{_DOUBLE}|`(?:[^`\\$]|\\(?s:.)|\$(?!\{{))*`"), ("open", r"/\*|['\"`]")),
    "java": (_ALL_BLANK, ("str", r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*"""|' + _DOUBLE), ("chr", _SINGLE), ("open", r"/\*|['\"]")),
    "go": (_SLASHES, _LINES, _COMMENT, ("str", rf"`[^`]*`|{_DOUBLE}"), ("chr", _SINGLE), ("open", r"/\*|['\"`]")),
    "c": (
        r"[^\S\n]*+(?:(?:\\\r?\n|//(?:[^\n\\]|\\(?s:.))*|/\*(?:[^*\n]|\*(?!/))*\*/)[^\S\n]*+)*+", _LINES, _COMMENT, ("directive", r"\#(?:[^\n\\/]|\\(?s:.)|" + _BLOCK + r"|//[^\n]*|/(?![*/]))*"),
        ("open", r'(?:u8|[uUL])?R"[^()\\\s"]{0,16}\('), ("str", "(?:u8|[uUL])?" + _DOUBLE), ("chr", f"(?:u8|[uUL])?{_SINGLE}"), ("open", r"/\*|['\"]"),
    ),
    "rust": (
        r"\s*+(?:(?://[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)\s*+)*+", ("str", "|".join(rf'[bc]?r{"#" * n}"(?s:.*?)"{"#" * n}' for n in range(4)) + r'|[bc]?"(?:[^"\\]|\\(?s:.))*"'),
        ("chr", r"b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'|'[A-Za-z_]\w*(?!')"), ("open", r'/\*|[bc]?r?\#*"|[bc]?r\#+"'),
    ),
}
_PARTS |= {"typescript": _PARTS["javascript"], "cpp": _PARTS["c"]}
_NUMBER = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?\w*|0[bBoO][\d_]+\w*|(?:\d[\d_]*(?:\.(?!\.|[A-Za-z_])[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?\w*"
_MARK = r"^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}\r?$"
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\(?s:.)|`|\$\{")
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
_WORDS = re.compile(r"\#[ \t]*(\w*)(.*)", re.S)
# Words after which a slash in JavaScript begins a regular expression, and words of Go after which a line end ends the statement.
_BEFORE_REGEX = "return typeof case in of new delete void throw instanceof else do yield await".split()
_GO_ENDS = ["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"]
_LINE, _IF, _OFF, _ELIF, _ELSE, _ENDIF, _HASH = "\n\x10\x11\x12\x13\x14\x15"
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")


class Known(dict):
    """Codes by lexeme, found when they are first asked for; emptied when it holds LEXEMES_MOST entries. Long lexemes are not kept."""

    def __init__(self, code) -> None:
        self.code = code

    def __missing__(self, lexeme: str) -> str:
        found = self.code(lexeme)
        if len(lexeme) <= 40:
            if len(self) >= LEXEMES_MOST:
                self.clear()
            self[lexeme] = found
        return found


class Parser:
    """Lexer and grammar of one language. `check(text)` gives None for a valid text, else (cause, offset)."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.grammar = g = Grammar(TEXTS[lang], *BOUNDS[lang])
        self.is_c, self.is_script, self.python, self.go = lang in ("c", "cpp"), lang in ("javascript", "typescript"), lang == "python", lang == "go"
        skip, *kinds = _PARTS[lang]
        # The frequent cases come first: words and signs that begin nothing longer.
        slash = r"|\s*/" if self.is_script else ""
        alone = "".join(w for w in g.sign_list if len(w) == 1 and not any(len(v) > 1 and v[0] == w for v in g.sign_list) and w not in ".#'\"")
        first = [("word", rf"[^\W\d]\w*+(?![\"'\#]{slash})"), ("sign", rf"[{re.escape(alone)}](?!\s*/)" if slash else f"[{re.escape(alone)}]"), *[x for x in kinds if x[0] == "newline"], ("conflict", _MARK)]
        if self.is_script:
            before = [w for w in g.sign_list if w not in (")", "]", "}", "++", "--", "/", "/=")]
            first.append(("regex", rf"(?:{_tree(before)}|\b(?:{'|'.join(_BEFORE_REGEX)})\b)\s*{_REGEX}|\A{_REGEX}"))
        kinds = [*first, *[x for x in kinds if x[0] != "newline"], ("num", _NUMBER), ("word", r"[^\W\d]\w*"), ("sign", _tree(g.sign_list)), ("other", "(?s:.)")]
        self.kinds = re.compile("|".join(f"(?P<{k}{n}>{r})" for n, (k, r) in enumerate(kinds)), re.M)
        self.lexemes = re.compile(skip + "(" + "|".join(r if k != "open" else f"(?:{r})(?s:.*)" for k, r in kinds) + r"|\Z)", re.M)
        self.known = Known(self._code)
        self.ends = {*"insct", *(g.codes[w] for w in _GO_ENDS if w in g.codes)} if self.go else set()

    def _code(self, lexeme: str) -> str:
        """The codes of one lexeme."""
        m = self.kinds.match(lexeme)
        kind = m.lastgroup.rstrip("0123456789") if m else "other"
        codes = self.grammar.codes
        if kind == "word":
            return codes[lexeme] if lexeme in self.grammar.words else "i"
        if kind == "sign":
            return codes[lexeme]
        if kind in ("str", "chr", "num"):
            return BASE[kind.upper()]
        if kind == "regex":
            word = lexeme[: lexeme.index("/")].rstrip()
            return (codes[word] if word in codes else "i" if word else "") + "n"
        if kind == "newline" or kind == "comment":
            return _LINE if "\n" in lexeme or self.python else ""
        if kind == "directive":
            return self._directive(lexeme)
        return "" if lexeme.isspace() else CONFLICT if kind == "conflict" else BROKEN

    def _directive(self, lexeme: str) -> str:
        word, rest = _WORDS.match(lexeme).groups()
        if word in ("if", "ifdef", "ifndef"):
            plus = "__cplusplus" in rest and (word == "ifndef" or "!" in rest)
            off = word == "if" and rest.strip() == "0" or "__cplusplus" in rest and plus == (self.lang == "cpp")
            return _OFF if off else _IF
        return {"else": _ELSE, "elif": _ELIF, "elifdef": _ELIF, "elifndef": _ELIF, "endif": _ENDIF}.get(word, _HASH)

    def lex(self, text: str, pos: int = 0) -> tuple[list[str], list[str], list[tuple[int, int]]]:
        """(lexemes, codes of each, [(first lexeme, its place in the text)]): pieces that the pattern cut in one go."""
        lexemes: list[str] = []
        codes: list[str] = []
        pieces = []
        while True:
            pieces.append((len(codes), pos))
            found = self.lexemes.findall(text, pos)
            while found and not found[-1]:
                found.pop()
            lexemes += found
            codes += map(self.known.__getitem__, found)
            if not found or codes[-1] != BROKEN or len(found[-1]) < 2:
                return lexemes, codes, pieces
            code, end = self._opened(text, len(text) - len(found[-1]))
            if end < 0:
                return lexemes, codes, pieces
            codes[-1], pos = code, end

    def _opened(self, text: str, start: int) -> tuple[str, int]:
        """(codes, end) of a construct that the pattern does not follow: template with expressions, nested comment, raw string. End -1 if it does not close."""
        if self.is_script and text[start] == "`":
            return self._template(text, start + 1)
        if self.lang == "rust" and text.startswith("/*", start):
            level, pos = 1, start + 2
            while level and (m := _NESTED.search(text, pos)):
                level, pos = level + (1 if m.group() == "/*" else -1), m.end()
            return "", -1 if level else pos
        if m := re.compile(r'(?:u8|[uUL])?R"([^()\\\s"]{0,16})\(|[bc]?r(\#+)"').match(text, start):
            close = f'){m[1]}"' if m[1] is not None else f'"{m[2]}'
            end = text.find(close, m.end())
            return BASE["STR"], end if end < 0 else end + len(close)
        return BROKEN, -1

    def _template(self, text: str, pos: int) -> tuple[str, int]:
        """(codes, end) of the template whose inside begins at pos. The inserted expressions are cut into codes like all others."""
        out, word = [], BASE["TH"]
        m = _TEMPLATE.search(text, pos)
        while m:
            pos = m.end()
            if m.group() == "`":
                return "".join(out) + BASE["TT"], pos
            if m.group() == "${":
                depth, begin = 1, pos
                while depth:
                    t = self.lexemes.match(text, pos)
                    if not t:
                        return BROKEN, -1
                    pos = t.end()
                    if t[1] == "}" or t[1] == "{":
                        depth += 1 if t[1] == "{" else -1
                    elif pos == len(text) and t[1][0] == "`" and len(t[1]) > 1:
                        _, pos = self._template(text, t.start(1) + 1)
                        if pos < 0:
                            return BROKEN, -1
                out += [word, *self.lex(text[begin : pos - 1])[1]]
                word = BASE["TM"]
            m = _TEMPLATE.search(text, pos)
        return BROKEN, -1

    def _indented(self, codes: list[str], lexemes: list[str]) -> None:
        """Line ends of Python as NEWLINE, INDENT and DEDENT, or nothing inside brackets and before the first statement."""
        depth, indents, some = 0, [0], -1
        for k, c in enumerate(codes):
            if c == _LINE:
                line = lexemes[k]
                tail = line[line.rfind("\n") + 1 :]
                codes[k] = ""
                if depth or "\n" not in line or "#" in tail or k == len(codes) - 1:
                    continue
                width = len(tail)
                if "\t" in tail or "\f" in tail:
                    width = 0
                    for x in tail:
                        width = (width // 8 + 1) * 8 if x == "\t" else 0 if x == "\f" else width + 1
                code = BASE["NEWLINE"] if some >= 0 else ""
                if width > indents[-1]:
                    indents.append(width)
                    code += BASE["INDENT"]
                while width < indents[-1]:
                    indents.pop()
                    code += BASE["DEDENT"] if width <= indents[-1] else BROKEN
                codes[k] = code
                continue
            if c in _OPENS:
                depth += 1
            elif c in _CLOSES:
                depth = max(0, depth - 1)
            some = k
        if some >= 0 and not depth:
            codes.append(BASE["NEWLINE"] + BASE["DEDENT"] * (len(indents) - 1))

    def _branches(self, codes: list[str]) -> Iterator[list[str]]:
        """The codes of C with the first branch of each conditional, with the second, and so on; one that has fewer gives its last. `#if 0` gives none."""
        lines = [k for k, c in enumerate(codes) if c in (_IF, _OFF, _ELIF, _ELSE, _ENDIF, _HASH)]
        for k in lines:  # a number sign begins a directive only at the start of a line
            before = k - 1
            while before >= 0 and codes[before] == "":
                before -= 1
            if before >= 0 and codes[before] != _LINE and codes[before] not in (_IF, _OFF, _ELIF, _ELSE, _ENDIF, _HASH):
                codes[k] = BROKEN
        count: dict[int, int] = {}
        stack: list[int] = []
        for k in lines:
            if codes[k] in (_IF, _OFF):
                stack.append(k)
                count[k] = 1
            elif codes[k] in (_ELIF, _ELSE) and stack:
                count[stack[-1]] += 1
            elif codes[k] == _ENDIF and stack:
                stack.pop()
            elif codes[k] in (_ELIF, _ELSE, _ENDIF):
                codes[k] = BROKEN
        if stack:
            codes.append(BROKEN)
        for turn in range(max(count.values(), default=1)):
            out, open_ = [], []  # [kept outside, branch, branch that is taken, kept]
            for k, c in enumerate(codes):
                if c == _IF or c == _OFF:
                    outer = open_[-1][3] if open_ else True
                    take = min(turn, count[k] - 1) if c == _IF else 1 if count[k] == 1 else max(1, min(turn, count[k] - 1))
                    open_.append([outer, 0, take, outer and take == 0])
                elif c == _ELIF or c == _ELSE:
                    top = open_[-1]
                    top[1] += 1
                    top[3] = top[0] and top[1] == top[2]
                elif c == _ENDIF:
                    open_.pop()
                elif c != _LINE and c != _HASH and (not open_ or open_[-1][3] or c == BROKEN):
                    out.append(c)
                    continue
                out.append("")
            yield out

    def check(self, text: str) -> tuple[str, int] | None:
        """A cause `nesting` tells that the text is nested deeper than the parser follows: it is then not known to be valid or not."""
        text = text.removeprefix("\ufeff")
        if self.is_script and text.startswith("#!"):
            text = "//" + text[2:]
        if self.python:
            text = "\n" + text
        lexemes, codes, pieces = self.lex(text)
        if CONFLICT in codes:
            return "conflict", self._offset(text, pieces, codes.index(CONFLICT)) - self.python
        if self.python:
            self._indented(codes, lexemes)
        if self.go:
            last = ""
            for k, c in enumerate(codes):
                if c == _LINE:
                    codes[k] = last = ";" if last in self.ends else ""
                elif c:
                    last = c[-1]
            if last in self.ends:
                codes.append(";")
        for kept in self._branches(codes) if self.is_c else (codes,):
            try:
                found = self._parsed(text, kept, pieces)
            except RecursionError:
                return "nesting", 0
            if found:
                return found[0], max(0, found[1] - self.python)
        return None

    def _parsed(self, text: str, codes: list[str], pieces: list[tuple[int, int]]) -> tuple[str, int] | None:
        nl, keys = b"", None
        whole = "".join(codes)
        if self.is_script:
            parts = whole.split(_LINE)
            whole = "".join(parts)
            nl = bytearray(len(whole) + 1)
            at = len(parts[0])
            for part in parts[1:]:
                nl[at] = 1
                at += len(part)
            # Codes that show whether a line end stands before them: those get another character.
            keys = parts[0] + "".join([chr(ord(x[0]) + 0x10000) + x[1:] for x in parts[1:] if x])
        if BROKEN not in whole and self.grammar.valid(whole, nl, keys):
            return None
        far = self.grammar.furthest(whole, nl)
        if BROKEN in whole:
            far = min(far, whole.index(BROKEN))
        stop, place = len(text.rstrip()), len(text)
        seen = 0
        for k, c in enumerate(codes):
            seen += len(c) - c.count(_LINE)
            if seen > far:
                place = self._offset(text, pieces, k)
                break
        last = BROKEN in whole and whole.index(BROKEN) == len(whole) - 1 and far == len(whole) - 1
        return ("truncated" if last or place >= stop else "syntax"), min(place, stop if place >= stop else place)

    def _offset(self, text: str, pieces: list[tuple[int, int]], lexeme: int) -> int:
        """Where a lexeme begins in the text."""
        first, pos = max(p for p in pieces if p[0] <= lexeme)
        for k, m in enumerate(self.lexemes.finditer(text, pos), first):
            if k == lexeme:
                return m.start(1)
        return len(text)


def _tree(signs: list[str]) -> str:
    """A regular expression for the longest of the signs, by their first characters."""
    heads: dict[str, list[str]] = {}
    for w in signs:
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(re.escape(c) + (f"(?:{'|'.join(map(re.escape, sorted(filter(None, rest), key=len, reverse=True)))}){'?' if '' in rest else ''}" if any(rest) else "") for c, rest in heads.items())


@lru_cache(maxsize=16)
def parser(lang: str) -> Parser:
    return Parser(lang)


def parse(files: DataFrame, id_col: str = "file_id", lang_col: str = "lang", text_col: str = "content", keys: tuple[str, ...] = ("repo", "sha", "file")) -> DataFrame:
    """One row per file: file_id, the columns `keys`, lang, valid, cause, line, col.

    Each file is parsed whole by the packrat grammar of its language and must be used up to its end. `cause` is
    `conflict` (a merge marker outside strings and comments), `truncated` (the text ends where more must follow),
    `syntax` (anything else) or `nesting` (deeper than the parser follows, which gives no verdict); `line` and `col`
    (from 1) are the furthest place where the grammar found no way on. Those of `keys` that `files` lacks are left out. In C every branch of a conditional is parsed,
    but for `#if 0`. Null texts and languages without a grammar have a null `valid`. Repeated rows stay.
    """
    keys = tuple(k for k in keys if k in files.columns)
    width = len(keys)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        for batch in batches:
            valid, cause, line, col = [], [], [], []
            for lang, text in zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()):
                lang = (lang or "").strip().lower()
                known = text is not None and lang in TEXTS
                found = parser(lang).check(text) if known else None
                deep = found is not None and found[0] == "nesting"
                valid.append(found is None if known and not deep else None)
                cause.append(found and found[0])
                place = found and not deep
                line.append(text.count("\n", 0, found[1]) + 1 if place else None)
                col.append(found[1] - (text.rfind("\n", 0, found[1]) + 1) + 1 if place else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(width + 2)), pa.array(valid, pa.bool_()), pa.array(cause, pa.string()), pa.array(line, pa.int32()), pa.array(col, pa.int32())],
                names=["file_id", *keys, "lang", "valid", "cause", "line", "col"],
            )

    rows = files.select(F.col(id_col).cast("long").alias("file_id"), *(F.col(k).cast("string").alias(k) for k in keys), F.col(lang_col).alias("lang"), F.col(text_col).alias("content"))
    return rows.mapInArrow(f, ", ".join(["file_id long", *(f"{k} string" for k in keys), "lang string, valid boolean, cause string, line int, col int"]))


def rates(parsed: DataFrame, *by: str) -> DataFrame:
    """By repo and lang (or the columns `by`): files with a verdict, parse_error, rate, the errors by cause, and `nesting`: files without a verdict for their depth.

    Nulls form groups of their own; files in languages without a grammar do not count.
    """
    bad = F.col("valid") == F.lit(False)
    return parsed.where("valid IS NOT NULL OR cause IS NOT NULL").groupBy(*(by or ("repo", "lang"))).agg(
        F.count("valid").alias("files"), F.count_if(bad).alias("parse_error"), F.round(F.try_divide(F.count_if(bad), F.count("valid")), 6).alias("rate"),
        *(F.count_if(F.col("cause") == c).alias(c) for c in ("conflict", "truncated", "syntax", "nesting")),
    )


def filled(stats: DataFrame, parsed: DataFrame, manifest: DataFrame) -> DataFrame:
    """The newest row of `stats` for each source, repo and lang, with parse_error and its rate as parsed; null where no file of the group was parsed.

    The source of a file is that of its manifest rows, by repo, sha and file. Null keys are values.
    """
    key = ("repo", "sha", "file")
    owners = manifest.groupBy(*key).agg(F.min("source").alias("source")).select("source", *(F.col(k).alias(f"_{k}") for k in key))
    owned = parsed.join(owners, F.expr(" AND ".join(f"{k} <=> _{k}" for k in key)), "left")
    group = ("source", "repo", "lang")
    newest = stats.groupBy(*group).agg(F.max_by("files", "run_at").alias("listed_files"))
    counts = rates(owned, *group).select(*(F.col(g).alias(f"_{g}") for g in group), "files", "parse_error", "rate")
    return newest.join(counts, F.expr(" AND ".join(f"{g} <=> _{g}" for g in group)), "left").select(*group, "listed_files", "files", "parse_error", "rate")
