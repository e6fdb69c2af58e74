"""Packrat parsing of expression grammars over token codes.

A grammar is text: `rule <- expression` by line. Expressions know sequence, ordered choice `/`, `*`, `+`, `?`, `&`,
`!`, brackets, names of rules, the terminals ID, NUM, STR, CHR, NEWLINE, INDENT, DEDENT and TH, TM, TT (head, middle
and tail of a template), the predicate NL (a line end stands before the token), and literal lexemes in quotes
(`~'x'` is a word that may also be an identifier). A source is cut into tokens, each token is one character of a code
string, and the grammar runs over that string. Each rule becomes one Python function: once without any bookkeeping,
to recognise valid texts, and once with every terminal on its own, to tell the furthest token where one failed.
"""

from __future__ import annotations

import re

BASE = {"ID": "i", "NUM": "n", "STR": "s", "CHR": "c", "NEWLINE": "L", "INDENT": "I", "DEDENT": "D", "TH": "h", "TM": "m", "TT": "t"}
BROKEN = "\x01"
CONFLICT = "\x02"
END = "\x00"
_NOTATION = re.compile(r"\s*(?:(~?'[^']+')|([A-Za-z_]\w*)|([()/*+?&!.]))")
_OPEN = 0xE000
SEEN_MOST = 200_000


class Grammar:
    """A compiled grammar. `valid(codes, nl)` tells whether the start rule holds; `furthest(codes, nl)` gives the furthest token that no terminal took."""

    def __init__(self, text: str, rules: str = "", stop: str = "", without: str = "") -> None:
        """`rules` names rules that look no further than the code `stop` where none of the lexemes `without` stands before it.

        Their results depend on the codes up to there alone, so they are kept over files, in tables that are emptied
        when they hold SEEN_MOST entries.
        """
        self.codes: dict[str, str] = {}
        self.soft: list[str] = []
        parts = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).splitlines():
            if line.strip() and not line.startswith("#"):
                name, body = line.split("<-", 1)
                parts[name.strip()] = self._parse(body)
        self.rules = parts
        self.start = next(iter(parts))
        self.words = {w for w in self.codes if w[0].isalpha() or w[0] == "_"}
        signs = sorted((w for w in self.codes if w not in self.words), key=len, reverse=True)
        self.sign_list = signs
        self.signs = "|".join(map(re.escape, signs))
        self.ids = "i" + "".join(self.soft)
        self._first = self._firsts()
        self._flat = self._flat_rules()
        self._leaf: dict[str, str | None] = {}
        uses = [n for r in parts.values() for n in self._mentions(r)]
        self._kept = {r for r in parts if uses.count(r) > 1 and r not in self._flat}
        self._bounded = rules.split()
        self._shape = f"[^{re.escape(stop + ''.join(self.codes.get(w, '') for w in without.split()))}\x00]+{stop}"
        self._fast = self._compile(False)
        self._slow = self._compile(True)

    # Reading the notation.

    def _parse(self, body: str):
        items, at = [], 0
        while body[at:].strip():
            m = _NOTATION.match(body, at)
            if not m:
                raise ValueError(f"cannot read {body[at:]!r}")
            items.append(m.group().strip())
            at = m.end()
        node, rest = self._choice(items)
        if rest:
            raise ValueError(f"left over: {rest}")
        return node

    def _choice(self, items: list[str]):
        options = []
        while True:
            node, items = self._sequence(items)
            options.append(node)
            if not items or items[0] != "/":
                return (options[0] if len(options) == 1 else ("choice", options)), items
            items = items[1:]

    def _sequence(self, items: list[str]):
        out = []
        while items and items[0] not in ")/":
            sign = None
            if items[0] in "&!":
                sign, items = items[0], items[1:]
            t, items = items[0], items[1:]
            if t == "(":
                node, items = self._choice(items)
                items = items[1:]
            elif t == ".":
                node = ("any",)
            elif t[0] in "~'":
                node = ("code", self._code(t))
            elif t in BASE:
                node = ("id",) if t == "ID" else ("code", BASE[t])
            elif t == "NL":
                node = ("nl",)
            else:
                node = ("rule", t)
            while items and items[0] in "*+?":
                node, items = (items[0], node), items[1:]
            out.append((sign, node) if sign else node)
        return (out[0] if len(out) == 1 else ("seq", out)), items

    def _code(self, quoted: str) -> str:
        word = quoted.strip("~").strip("'")
        if word not in self.codes:
            self.codes[word] = word if len(word) == 1 and not word.isalnum() and word != "_" else chr(_OPEN + len(self.codes))
            if quoted[0] == "~":
                self.soft.append(self.codes[word])
        return self.codes[word]

    # First codes of each expression; None stands for any.

    def _firsts(self) -> dict[str, tuple[frozenset | None, bool]]:
        known: dict[str, tuple[frozenset | None, bool]] = {r: (frozenset(), False) for r in self.rules}
        while True:
            fresh = {r: self._first_of(n, known) for r, n in self.rules.items()}
            if fresh == known:
                return known
            known = fresh

    def _first_of(self, node, known) -> tuple[frozenset | None, bool]:
        kind = node[0]
        if kind == "code":
            return frozenset(node[1]), False
        if kind == "id":
            return frozenset(self.ids), False
        if kind == "any":
            return None, False
        if kind in ("&", "!", "nl"):
            return frozenset(), True
        if kind == "rule":
            return known[node[1]]
        if kind in "*?":
            return self._first_of(node[1], known)[0], True
        if kind == "+":
            return self._first_of(node[1], known)
        parts = [self._first_of(n, known) for n in node[1]]
        if kind == "choice":
            return (None if any(p[0] is None for p in parts) else frozenset().union(*(p[0] for p in parts))), any(p[1] for p in parts)
        out: frozenset | None = frozenset()
        for first, empty in parts:
            out = None if out is None or first is None else out | first
            if not empty:
                return out, False
        return out, True

    # Expressions without recursion become one regular expression with atomic groups, which is what PEG means by them.

    def _mentions(self, node) -> list[str]:
        if node[0] == "rule":
            return [node[1]]
        return [m for n in (node[1] if node[0] in ("seq", "choice") else node[1:]) if isinstance(n, tuple) for m in self._mentions(n)]

    def _flat_rules(self) -> set[str]:
        """Rules that reach no rule which reaches itself."""
        direct = {r: set(self._mentions(n)) for r, n in self.rules.items()}
        flat: set[str] = set()
        while fresh := {r for r, uses in direct.items() if r not in flat and uses <= flat}:
            flat |= fresh
        return flat

    def _as_regex(self, node) -> str | None:
        kind = node[0]
        if kind == "code":
            return re.escape(node[1])
        if kind == "id":
            return f"[{re.escape(self.ids)}]"
        if kind == "any":
            return "[^\x00]"
        if kind == "nl":
            return None
        if kind == "rule":
            name = node[1]
            if name not in self._leaf:
                self._leaf[name] = self._as_regex(self.rules[name]) if name in self._flat else None
            return self._leaf[name]
        if kind in ("&", "!"):
            r = self._as_regex(node[1])
            return r and f"(?{'=' if kind == '&' else '!'}{r})"
        if kind in "*+?":
            r = self._as_regex(node[1])
            return r and f"(?:{r}){kind}+"
        parts = []
        for n in node[1]:
            parts.append(self._as_regex(n))
            if parts[-1] is None:
                return None
        return "".join(parts) if kind == "seq" else f"(?>{'|'.join(parts)})"

    # Writing functions: position in, end or -1 out.

    def _compile(self, track: bool) -> dict:
        space: dict = {"T": "", "NL": b"", "far": 0}
        memos = sorted(self._kept)
        lines = []
        self._space, self._track, self._names_used = space, track, 0
        for name in memos:
            space[f"M_{name}"] = {}
        for name, node in self.rules.items():
            if not track and self._as_regex(("rule", name)) is not None:
                continue
            body: list[str] = []
            self._emit(node, "p", "q", "    ", body, False)
            inner = f"r_{name}"
            if name in self._bounded and not track:
                space["SHAPE"], space[f"S_{name}"] = re.compile(self._shape).match, {}
                inner, seen = f"whole_{name}", f"S_{name}"
                lines += [
                    f"def r_{name}(p):", "    m = SHAPE(T, p)", "    if m is None:", f"        return {inner}(p)", "    key = KEYS[p:m.end()]", f"    n = {seen}.get(key)",
                    "    if n is None:", f"        q = {inner}(p)", f"        if len({seen}) > {SEEN_MOST}:", f"            {seen}.clear()", f"        {seen}[key] = q - p if q >= 0 else -1", "        return q",
                    "    return p + n if n >= 0 else -1",
                ]
            lines.append(f"def {inner}(p):")
            if track:
                lines.append("    global far")
            if name in self._kept:
                lines += [f"    q = M_{name}.get(p)", "    if q is not None:", "        return q", *body, f"    M_{name}[p] = q", "    return q"]
            else:
                lines += [*body, "    return q"]
        exec("\n".join(lines), space)
        space["memos"] = [space[f"M_{name}"] for name in memos]
        return space

    def _new(self) -> str:
        self._names_used += 1
        return f"v{self._names_used}"

    def _emit(self, node, src: str, dst: str, pad: str, out: list[str], quiet: bool) -> None:
        """Lines that set `dst` to the end of `node` from `src`, or to -1. `quiet`: inside a predicate, where failures tell nothing."""
        kind = node[0]
        failed = self._track and not quiet
        test = {"code": lambda: f"T[{src}] == {node[1]!r}" if node[0] == "code" else "", "id": lambda: f"T[{src}] in {self.ids!r}", "any": lambda: f"T[{src}] != '\\x00'"}
        if kind in test:
            if failed:
                out += [f"{pad}if {test[kind]()}:", f"{pad}    {dst} = {src} + 1", f"{pad}else:", f"{pad}    if {src} > far:", f"{pad}        far = {src}", f"{pad}    {dst} = -1"]
            else:
                out.append(f"{pad}{dst} = {src} + 1 if {test[kind]()} else -1")
            return
        if kind == "nl":
            out.append(f"{pad}{dst} = {src} if NL[{src}] else -1")
            return
        if not self._track and kind != "rule" or not self._track and node[1] in self._flat:
            regex = self._as_regex(node)
            if regex is not None:
                name = self._new().upper()
                self._space[name] = re.compile(regex).match
                first, empty = self._first_of(node, self._first)
                call = f"m.end() if (m := {name}(T, {src})) else -1"
                if kind == "?" or kind == "*":
                    call = f"m.end() if (m := {name}(T, {src})) else {src}"
                if first is not None and not empty:
                    call = f"(m.end() if (m := {name}(T, {src})) else -1) if T[{src}] in {''.join(sorted(first))!r} else -1"
                elif kind in "?*" and (first := self._first_of(node[1], self._first))[0] is not None and not first[1]:
                    call = f"({call}) if T[{src}] in {''.join(sorted(first[0]))!r} else {src}"
                out.append(f"{pad}{dst} = {call}")
                return
        if kind == "rule":
            first, empty = self._first[node[1]]
            call = f"r_{node[1]}({src})"
            if not self._track and first is not None and not empty:
                call = f"{call} if T[{src}] in {''.join(sorted(first))!r} else -1"
            if self._track and quiet:
                keep = self._new()
                out += [f"{pad}{keep} = far", f"{pad}{dst} = {call}", f"{pad}far = {keep}"]
            else:
                out.append(f"{pad}{dst} = {call}")
            return
        if kind in "*+":
            step = self._new()
            if kind == "+":
                self._emit(node[1], src, dst, pad, out, quiet)
                out.append(f"{pad}while {dst} >= 0:")
            else:
                if src != dst:
                    out.append(f"{pad}{dst} = {src}")
                out.append(f"{pad}while True:")
            self._emit(node[1], dst, step, pad + "    ", out, quiet)
            out += [f"{pad}    if {step} <= {dst}:", f"{pad}        break", f"{pad}    {dst} = {step}"]
            return
        if kind in "?&!":
            step = self._new()
            self._emit(node[1], src, step, pad, out, quiet or kind in "&!")
            good, bad = {"?": (step, src), "&": (src, "-1"), "!": ("-1", src)}[kind]
            out.append(f"{pad}{dst} = {good} if {step} >= 0 else {bad}")
            return
        if kind == "seq":
            parts = list(node[1])
            if not self._track:  # neighbours without recursion are matched together
                parts, run = [], []
                for n in [*node[1], None]:
                    if n is not None and self._as_regex(n) is not None:
                        run.append(n)
                        continue
                    if run:
                        parts.append(run[0] if len(run) == 1 else ("seq", run))
                    parts += [n] if n is not None else []
                    run = []
                if len(parts) == 1:
                    self._emit(parts[0], src, dst, pad, out, quiet)
                    return
            at = src
            for k, n in enumerate(parts):
                self._emit(n, at, dst, pad, out, quiet)
                at = dst
                if k < len(parts) - 1:
                    out.append(f"{pad}if {dst} >= 0:")
                    pad += "    "
            return
        start, c = self._new(), self._new()
        out += [f"{pad}{start} = {src}", f"{pad}{c} = T[{start}]"]
        if failed:
            out += [f"{pad}if {start} > far:", f"{pad}    far = {start}"]
        options = [(*self._first_of(n, self._first), n) for n in node[1]]
        always = [k for k, (first, empty, _) in enumerate(options) if first is None or empty]
        groups: dict[tuple, set] = {}
        for code in frozenset().union(*(f for f, _, _ in options if f is not None)):
            groups.setdefault(tuple(k for k, (f, e, _) in enumerate(options) if f is None or e or code in f), set()).add(code)
        word = "if"
        for chosen, codes in sorted(groups.items(), key=lambda x: ("i" not in x[1], "s" not in x[1], x[0])):
            out.append(f"{pad}{word} {c} in {''.join(sorted(codes))!r}:")
            self._options([options[k][2] for k in chosen], start, dst, pad + "    ", out, quiet)
            word = "elif"
        out.append(f"{pad}else:" if word == "elif" else f"{pad}if True:")
        self._options([options[k][2] for k in always], start, dst, pad + "    ", out, quiet)

    def _options(self, nodes: list, src: str, dst: str, pad: str, out: list[str], quiet: bool) -> None:
        if not nodes:
            out.append(f"{pad}{dst} = -1")
            return
        for k, n in enumerate(nodes):
            if k:
                out.append(f"{pad}if {dst} < 0:")
                pad += "    "
            self._emit(n, src, dst, pad, out, quiet)

    def _run(self, space: dict, codes: str, nl: bytes | bytearray, keys: str | None) -> int:
        for memo in space["memos"]:
            memo.clear()
        space["T"], space["NL"], space["far"], space["KEYS"] = codes + END, nl, 0, keys if keys is not None else codes
        return space[f"r_{self.start}"](0)

    def valid(self, codes: str, nl: bytes | bytearray = b"", keys: str | None = None) -> bool:
        """Whether the start rule takes all codes. `keys`: the codes in a form that shows line ends too, where the grammar asks for them."""
        return self._run(self._fast, codes, nl, keys) == len(codes)

    def furthest(self, codes: str, nl: bytes | bytearray = b"") -> int:
        """The furthest place where a terminal failed; failures inside predicates do not count."""
        end = self._run(self._slow, codes, nl, None)
        return max(self._slow["far"], end)
