"""Generated, minified, vendored and blob files: clusters of identifier-masked token shingles, by bands of hashes that part no similar pair."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.classes import components
from glosswork.plans.common import settle

SHINGLE = 5
SIMILAR, NEAR = 0.8, 1e-9
# Two sets of this similarity differ in a ninth of their sizes together at the most: (1 - 0.8) / (1 + 0.8).
APART, BITS = 9, 256
# Sizes at which levels of units begin (see `band_keys`). In the levels from LARGE on units have more keys than their codes should be sent with.
LEVELS = [1, *accumulate(range(48), lambda x, _: x * 3 // 2 + 1, initial=5)]
LARGE = 364
# A bucket of more units than this is cut into parts, each two of which meet in a task; buckets are counted by so many hashes of their keys.
PART, COARSE = 150_000, 65_536
# Rows of buckets that are taken at once, ids whose classes a task remembers, units whose shingles it keeps, and rows of a bucket that is met together with others.
CHUNK, HELD, KEPT, FEW = 50_000, 400_000, 10_000, 32
# Units of about the same size that are compared with one another when near ones are gathered, and units whose codes a task remembers to have given.
PIECE, SEEN = 2_000, 200_000
# A unit ends at the end of a block or statement, at a definition, or after so many tokens of data.
RUN = 32
DENSE = 0.3
# A program writes a block again and again: so many members in the repository, and so many a file.
FAMILY, A_FILE = 6, 4
# Named units below so many tokens are alike by chance and show no copying.
NAMED = 24
SHARE = {"blob": 0.6, "minified": 0.5, "generated": 0.7, "copied": 0.8}
LITERAL = 0.4
# Less data than so many characters in literals is no bulk.
BULK = 150
LONG_LINES = 110

# Words that stay unmasked, since they carry the shape of code in one of the languages.
KEYWORDS = (
    "and as auto await break case catch class const continue def default defer do elif else enum except export extends extern false final finally fn for from "
    "func function go goto if impl import in int interface is let long loop match mod module mut namespace new nil none not null or package pass private protected "
    "pub public raise range return self static struct super switch template this throw throws trait true try type typedef typeof union unsafe use using var void where while with yield"
).split()
NAME, NUMBER, TEXT, CUT = 1, 2, 3, 4
_CODES = {w: 20 + k for k, w in enumerate(KEYWORDS)}
_STRINGS = r'"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"(?:[^"\\\n]|\\.)*"?|`(?:[^`\\]|\\.)*`?|\'(?:[^\'\\\n]|\\.)*\'?'
_TOKEN = rf"[A-Za-z_$][\w$]*|\d[\w.]*|{_STRINGS}|[^\s\w]|\Z"
TOKENS = {
    True: re.compile(rf"(?:[ \t\r\f]+|\#[^\n]*|\n(?![ \t]*(?:def|class|async|@)\b))*+(\n[ \t]*|{_TOKEN})", re.S),
    False: re.compile(rf"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*+({_TOKEN})", re.S),
}
CODE_LINE = re.compile(r"^[ \t]*(?!//|/?\*|\#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|else|endif))|[ \t\r]|$)\S", re.M)
HEAD = re.compile(r"\s*(?:#![^\n]*\n\s*)?((?:(?://|\#(?!\s*(?:include|define|pragma|if|ifdef|ifndef))|/\*|\*)[^\n]*\n?\s*)+)")

# Folders that hold third-party code by convention. In the words that tell where a file is from, each of them is one and the same masked word.
VENDOR_DIRS = "vendor vendored _vendored third_party third-party thirdparty 3rdparty external externals node_modules bower_components jspm_packages site-packages deps Pods Carthage"
PLACE = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, VENDOR_DIRS.split()))})/([^/]+?)(?:[-@]v?\d[\w.]*)?/", re.I)
# A paragraph of a head that names something and its version: the name is masked as an identifier, the version as a number.
VERSION = re.compile(r"\b([A-Za-z][\w-]*)(?:,? (?:release|version))? v?\d+(?:\.\d+){1,3}\b")
WORDS = re.compile(r"\w+")

UNITS = "file_id long, repo long, view int, unit long, n int, chars int, literal int, a_line double, name string, codes binary"


class _Masks(dict):
    """Codes by token: keywords and signs are themselves, names, numbers and strings are masked. Emptied when it holds many tokens."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c.isalpha() or c in "_$":
            code = _CODES.get(token, NAME)
        elif c.isdigit():
            code = NUMBER
        elif c in "\"'`":
            code = TEXT
        elif c == "\n":
            code = CUT
        else:
            code = 200 + ord(c) % 60_000
        if len(token) <= 40:
            if len(self) > 200_000:
                self.clear()
            self[token] = code
        return code


_MASKS = _Masks()
_OPEN, _CLOSE, _END = 200 + ord("{"), 200 + ord("}"), 200 + ord(";")
_IS_STOP, _IS_DATA = (np.isin(np.arange(1 << 16), x) for x in ((_OPEN, _CLOSE, _END, CUT), (NUMBER, TEXT)))


def units(content: str, lang: str | None) -> Iterator[tuple[bytes, list[str], int, int, bool]]:
    """(masked codes of two bytes, tokens, characters, characters in literals, whether literals are DENSE among the tokens) of each unit of a file; comments are left out.

    A unit is a block of the first or second level with what stands before it, a statement of the first level, a
    Python definition, or RUN tokens or more of which a third are data.
    """
    tokens = TOKENS[(lang or "").strip().lower() == "python"].findall(content)
    while tokens and not tokens[-1]:
        tokens.pop()
    known = np.fromiter(map(_MASKS.__getitem__, tokens), np.uint16, len(tokens))
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = _IS_DATA[known]
    chars, some, literal = ([0, *x.cumsum().tolist()] for x in (size, data, size * data))
    ends, depth = [], 0
    stops = np.flatnonzero(_IS_STOP[known])
    for k, c in zip(stops.tolist(), known[stops].tolist()):
        if c == _OPEN:
            depth += 1
        elif c == _CLOSE:
            depth = max(0, depth - 1)
            if depth <= 1:
                ends.append((k + 1, k + 1))
        elif c == CUT:
            ends.append((k, k + 1))
        elif not depth:
            ends.append((k + 1, k + 1))
    ends.append((len(tokens), len(tokens)))
    codes, start = known.tobytes(), 0
    for end, after in ends:
        stop = start + RUN
        while stop <= end:
            if 3 * (some[stop] - some[start]) >= stop - start:
                yield codes[2 * start : 2 * stop], tokens[start:stop], chars[stop] - chars[start], literal[stop] - literal[start], some[stop] - some[start] >= DENSE * (stop - start)
                start, stop = stop, stop + RUN
            else:
                stop += 8
        if start < end:
            yield codes[2 * start : 2 * end], tokens[start:end], chars[end] - chars[start], literal[end] - literal[start], some[end] - some[start] >= DENSE * (end - start)
        start = after


def origins(file: str | None, content: str) -> Iterator[tuple[str, list[str]]]:
    """(name, words) of what tells that a file is part of something named: its place in a folder for foreign code, and paragraphs of its head that give a name with a version.

    The name is masked in the words as an identifier, so are numbers and the folder.
    """
    place = PLACE.search((file or "").replace("\\", "/"))
    if place:
        yield place[1].lower(), ["\x01place", "\x01name"]
    head = HEAD.match(content)
    for part in re.split(r"\n\s*\n", head[1]) if head else ():
        found = VERSION.search(part)
        if found:
            name = found[1].lower()
            yield name, ["\x01name" if w == name else "\x01number" if w[0].isdigit() or re.fullmatch(r"v\d+", w) else w for w in WORDS.findall(part.lower())]


def _profile(i: int, repo: int, file: str | None, lang: str | None, content: str) -> Iterator[tuple]:
    """The rows of a file: view 0 for each different masked unit, 1 for each origin, 2 for each different unit with its names (n tells whether the file has an origin)."""
    shapes: dict[bytes, list[int]] = {}
    named: dict[int, int] = {}
    total = text = 0
    for codes, words, chars, literal, dense in units(content, lang):
        got = shapes.setdefault(codes, [0, 0, 0])
        got[0] += 1
        got[1] += chars
        got[2] += literal if dense else 0  # long messages among code are not data
        total += chars
        text += literal
        if len(words) >= NAMED and literal < LITERAL * chars:
            key = xxhash.xxh3_64_intdigest("\x00".join(words)) - (1 << 63)
            named[key] = named.get(key, 0) + chars
    a_line = (total - text) / (len(CODE_LINE.findall(content)) or 1)
    if not shapes:
        yield i, repo, 0, 0, 0, 0, 0, 0.0, None, None
    for codes, (n, chars, literal) in shapes.items():
        yield i, repo, 0, xxhash.xxh3_64_intdigest(codes) - (1 << 63), n, chars, literal, a_line, None, codes
    told = list(origins(file, content))
    for name, words in told:
        codes = np.array([xxhash.xxh32_intdigest(w) & 0xFFFF for w in words], np.uint16).tobytes()
        yield i, repo, 1, xxhash.xxh3_64_intdigest(codes, 1) - (1 << 63), 1, 0, 0, 0.0, name, codes
    for key, chars in named.items():
        yield i, repo, 2, key, int(bool(told)), chars, 0, 0.0, None, None


def profiles(files: DataFrame) -> DataFrame:
    """The rows of all files (see `_profile`). `files` has file_id, repo, file, lang and content; null ids and contents give none. Codes that a task has just given for a unit are null in its next rows."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in UNITS.split(", ")]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def once(unit: int, codes: bytes | None) -> bytes | None:
            if codes is None or unit in seen:
                return None
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(unit)
            return codes

        for b in batches:
            out = [x for row in zip(*(b.column(k).to_pylist() for k in range(5))) for x in _profile(*row)]
            columns = list(zip(*out)) if out else [()] * len(types)
            columns[-1] = map(once, columns[3], columns[-1])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], names=names)

    rows = files.where("file_id IS NOT NULL AND content IS NOT NULL").select(F.col("file_id").cast("long"), F.xxhash64("repo").alias("repo"), "file", "lang", "content")
    return rows.mapInArrow(f, UNITS)


WIDTH = 2 * SHINGLE


def shingles(codes: bytes) -> frozenset[bytes]:
    """The different shingles of a unit, two bytes a token. One of fewer than SHINGLE tokens has one shingle."""
    if len(codes) <= WIDTH:
        return frozenset([codes])
    return frozenset(np.ndarray((len(codes) - WIDTH) // 2 + 1, f"V{WIDTH}", codes, 0, 2).tolist())


def _hashed(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different shingles of all units, the unit of each, how many each unit has)."""
    padded = [c.ljust(WIDTH, b"\0") for c in units]
    tokens = np.frombuffer(b"".join(padded), np.uint16).astype(np.uint64)
    counts = np.array([len(c) // 2 - SHINGLE + 1 for c in padded])
    owner = np.repeat(np.arange(len(units)), counts)
    places = np.arange(len(owner)) + owner * (SHINGLE - 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(places), np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[places + k]
        h = _mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new], np.bincount(owner[new], minlength=len(units))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def band_keys(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether of LARGE units, units, band keys): two units of similarity SIMILAR or more share a key.

    `h`, `owner` and `size` are as of `_hashed`. A pair belongs to the level of its larger unit; a unit keys its own
    level and those in which it may be the smaller one. The hashes of a level are cut into more bands than two of its
    units can have different shingles, so that some band is the same in both; its key is the hash of all its shingles.
    Bands beyond these let each unit leave out as many of its bands, those of the fewest shingles first: of the bands
    that two units share, neither leaves out the last in this order.
    """
    for level, (low, high) in enumerate(zip(LEVELS, LEVELS[1:])):
        most = np.minimum(high - 1, (size / SIMILAR + NEAR).astype(np.int64))  # the largest partner
        mine = (most >= low) & (size < high)
        n = int(mine.sum())
        if not n:
            continue
        bands = 2 * (high - 1) // APART + 1
        if low >= LARGE:
            bands += bands // 5
        taken = mine[owner]
        at = (np.cumsum(mine) - 1)[owner[taken]] * bands + ((h[taken] >> np.uint64(32)) * np.uint64(bands) >> np.uint64(32)).astype(np.int64)
        keys = np.zeros(n * bands, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(keys, at, _mixed(h[taken]))
            keys = _mixed(keys.reshape(n, bands) + (np.arange(bands, dtype=np.uint64) + np.uint64(level << 32)) * np.uint64(0x9E3779B97F4A7C15))
        held = np.bincount(at, minlength=n * bands).reshape(n, bands)
        order = np.lexsort((keys, -held), axis=1)
        kept = np.arange(bands) <= ((size[mine] + most[mine]) // APART)[:, None]
        units = np.broadcast_to(np.flatnonzero(mine)[:, None], (n, bands))
        yield low >= LARGE, units[kept], np.take_along_axis(keys, order, 1)[kept].view(np.int64)


def bitmaps(h: np.ndarray, owner: np.ndarray, units: int) -> np.ndarray:
    """For each unit BITS bits: those of the places that hold a shingle, then those of the places that hold two or more."""
    places = BITS // 2
    held = np.bincount(owner * places + (h % np.uint64(places)).astype(np.int64), minlength=units * places).reshape(units, places)
    return np.packbits(np.concatenate([held > 0, held > 1], 1), axis=1).view(np.uint64)


def _bits(h: np.ndarray, owner: np.ndarray, units: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(BITS // 8), units, [None, pa.py_buffer(bitmaps(h, owner, units).tobytes())]).cast(pa.binary())


def banded(shapes: DataFrame, large: bool) -> DataFrame:
    """(band, unit, near, size, bits, codes): each unit with each of its band keys in the levels of LARGE units or in the others; size is the number of its different shingles. LARGE units come without bits and codes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                h, owner, size = _hashed(part.column(1).to_pylist())
                bits = _bits(h, owner, part.num_rows)
                for is_large, units, keys in band_keys(h, owner, size):
                    if is_large == large:
                        rows = pa.array(units)
                        none = pa.nulls(len(units), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), part.column(0).take(rows), part.column(2).take(rows), pa.array(size[units].astype(np.int32)), none if large else bits.take(rows), none if large else part.column(1).take(rows)],
                            names=["band", "unit", "near", "size", "bits", "codes"],
                        )

    return shapes.select("unit", "codes", "near").mapInArrow(f, "band long, unit long, near long, size int, bits binary, codes binary")


def similar(a: frozenset[bytes], b: frozenset[bytes]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both) - NEAR


class _Classes(dict):
    """The classes of linked ids, each id under another one of its class, and pairs that are known not to be similar."""

    def __init__(self):
        super().__init__()
        self.unlike: set[tuple[int, int]] = set()

    def top(self, x: int) -> int:
        while (y := self.get(x, x)) != x:
            self[x] = x = self.get(y, y)
        return x

    def relieve(self) -> None:
        """Forgets what has become too much; links were given out, so that only work is done again."""
        if len(self) > HELD:
            self.clear()
        if len(self.unlike) > HELD // 4:
            self.unlike.clear()


class _Bucketed:
    """Whole buckets of units, ordered by bucket and size, and the links that are found among them. Units that are near the same one are of one class."""

    def __init__(self, rows: pa.Table, classes: _Classes):
        band, salt, self.unit, self.near, self.size = (rows.column(k).to_numpy() for k in range(5))
        first = np.ones(len(band), bool)
        first[1:] = (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])
        self.starts = np.flatnonzero(first)
        self.counts = np.diff(self.starts, append=len(band))
        self.bits = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint64).reshape(len(band), -1)
        self.codes, self.classes = rows.column(6), classes
        ids, who = np.unique(self.near, return_inverse=True)
        tops, at = np.unique(np.array([classes.top(x) for x in ids.tolist()], np.int64), return_inverse=True)
        self.at = {x: k for k, x in enumerate(tops.tolist())}
        self.root, self.under = at[who].astype(np.int32), np.arange(len(tops), dtype=np.int32)
        self.sets: dict[int, frozenset[bytes]] = {}
        self.out: list[tuple[int, int]] = []

    def _shingles(self, unit: int, row: int) -> frozenset[bytes]:
        if unit not in self.sets:
            if len(self.sets) > KEPT:
                self.sets.clear()
            self.sets[unit] = shingles(self.codes[row].as_py())
        return self.sets[unit]

    def _link(self, x: int, y: int) -> bool:
        """Links two rows that are similar and of different classes."""
        t, w = self.classes.top(int(self.near[x])), self.classes.top(int(self.near[y]))
        if t == w:
            return False
        u, v = int(self.unit[x]), int(self.unit[y])
        pair = (u, v) if u < v else (v, u)
        if pair in self.classes.unlike:
            return False
        if not similar(self._shingles(u, x), self._shingles(v, y)):
            self.classes.unlike.add(pair)
            return False
        t, w = min(t, w), max(t, w)
        self.classes[w] = t
        self.under[self.at[w]] = self.at[t]
        self.out.append((u, v))
        return True

    def _roots(self, rows: slice) -> np.ndarray:
        """The classes of rows as they are now."""
        root = self.under[self.root[rows]]
        while ((up := self.under[root]) != root).any():
            root = up
        self.root[rows] = root
        return root

    def small(self) -> None:
        """All pairs of the buckets of FEW rows or less, at once for all that stand in distance 1, 2, ... of one another."""
        place = np.arange(len(self.near)) - np.repeat(self.starts, self.counts)
        root = self._roots(slice(None))
        mixed = np.logical_or.reduceat(root != np.repeat(root[self.starts], self.counts), self.starts)
        here, d = np.flatnonzero(np.repeat(mixed & (self.counts <= FEW), self.counts) & (place > 0)), 1
        while len(here):
            here = here[self.size[here - d] >= SIMILAR * self.size[here] - NEAR]
            root = self._roots(slice(None))
            x = here[root[here] != root[here - d]]
            x = x[APART * np.bitwise_count(self.bits[x] ^ self.bits[x - d]).sum(1, dtype=np.int64) <= self.size[x] + self.size[x - d]]
            for i in x.tolist():
                self._link(i, i - d)
            d += 1
            here = here[place[here] >= d]

    def large(self, start: int, end: int) -> None:
        """All pairs of a bucket but those of its largest class: some of the rows outside of that class against all rows of sizes around theirs."""
        size, words = self.size[start:end], np.ascontiguousarray(self.bits[start:end].T)
        root = self._roots(slice(start, end))
        outside = root != np.bincount(root).argmax()
        rows, step = np.flatnonzero(outside), max(1, 65_536 // len(size))
        for at in range(0, len(rows), step):
            root, own = self._roots(slice(start, end)), rows[at : at + step]
            if (root == root[0]).all():
                return
            low, high = int(np.searchsorted(size, SIMILAR * int(size[own[0]]) - NEAR)), int(np.searchsorted(size, int(size[own[-1]]) / SIMILAR + NEAR, "right"))
            apart = np.zeros((len(own), high - low), np.uint8)  # one sum beyond 255 begins at 0 again, which only lets a pair through
            for w in words:
                apart += np.bitwise_count(w[own, None] ^ w[None, low:high])
            near = apart <= np.minimum((size[own] / SIMILAR + size[own] + NEAR) // APART, 255).astype(np.uint8)[:, None]
            near &= root[own, None] != root[None, low:high]
            row, other = np.nonzero(near)
            apart, row, other = apart[row, other].astype(np.int32), own[row], other + low
            fits = ((other < row) | ~outside[other]) & (APART * apart <= size[row] + size[other])
            row, other = row[fits], other[fits]
            while len(row):
                first = np.ones(len(row), bool)
                first[1:] = row[1:] != row[:-1]
                if any([self._link(start + x, start + y) for x, y in zip(row[first].tolist(), other[first].tolist())]):
                    root = self._roots(slice(start, end))
                    first |= root[row] == root[other]
                row, other = row[~first], other[~first]


def _met(rows: pa.Table, classes: _Classes) -> list[tuple[int, int]]:
    """Links between the units of each bucket of whole buckets. Rows come ordered by bucket and size.

    All pairs of a bucket are met, but for those of one class already and those whose sizes or bits differ too much: a
    bit that only one of two units has stands for a shingle that only this one has. The rest are compared by their
    shingles.
    """
    buckets = _Bucketed(rows, classes)
    buckets.small()
    for k in np.flatnonzero(buckets.counts > FEW).tolist():
        buckets.large(int(buckets.starts[k]), int(buckets.starts[k] + buckets.counts[k]))
    return buckets.out


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that make the classes of the units of all buckets, by the Jaccard index of their shingles. Rows come ordered by bucket and size; of each bucket all pairs are decided."""
    classes, held = _Classes(), []

    def links(rows: pa.Table) -> pa.RecordBatch:
        classes.relieve()
        out = _met(rows, classes) if rows.num_rows else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["unit", "other"])

    for b in batches:
        held.append(b)
        if b.num_rows and sum(x.num_rows for x in held) >= CHUNK:
            rows = pa.Table.from_batches(held).combine_chunks()
            band, salt = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            last = np.flatnonzero((band != band[-1]) | (salt != salt[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield links(rows.slice(0, end))
                held = rows.slice(end).to_batches()
    if held:
        yield links(pa.Table.from_batches(held).combine_chunks())


def _leading(rows: DataFrame) -> DataFrame:
    ordered = rows.select("band", "salt", "unit", "near", "size", "bits", "codes").repartition("band", "salt").sortWithinPartitions("band", "salt", "size", "unit")
    return ordered.mapInArrow(_led, "unit long, other long")


def gathered(shapes: DataFrame) -> DataFrame:
    """(unit, near, codes): each unit once, and the smallest unit of those that it reaches over links found here, else itself. The links are (unit, near) without codes.

    Units of the same smallest hash (and four bits of another) come together, and those of about the same size are
    compared. This leaves links out, but what is found here, `links` need not find again in each bucket.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                h, owner, size = _hashed(part.column(1).to_pylist())
                starts = np.cumsum(size) - size
                with np.errstate(over="ignore"):
                    key = _mixed(h[starts]) + (np.minimum.reduceat(_mixed(h + np.uint64(1)), starts) & np.uint64(15))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0), pa.array(size.astype(np.int32)), _bits(h, owner, part.num_rows), part.column(1)], names=["key", "unit", "size", "bits", "codes"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def together() -> pa.RecordBatch:
            nonlocal last, held
            rows = pa.Table.from_batches(held).combine_chunks()
            key, unit = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
            new[0] = unit[0] != last
            last, held = unit[-1], []
            rows, key = rows.filter(pa.array(new)).combine_chunks(), key[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            starts, at = np.flatnonzero(first), np.arange(len(key))
            piece = (at - starts[np.cumsum(first) - 1]) // PIECE
            classes, links = _Classes(), []
            if len(key):
                links = _met(rows.add_column(1, "salt", pa.array(piece)).add_column(3, "near", rows.column(1)), classes)
            units = rows.column(1).to_pylist()
            columns = [*units, *(u for u, _ in links)], [*map(classes.top, units), *(v for _, v in links)], [*rows.column(4).to_pylist(), *(None for _ in links)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["unit", "near", "codes"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield together()
        if held:
            yield together()

    keys = shapes.where("codes IS NOT NULL").select("unit", "codes").mapInArrow(keyed, "key long, unit long, size int, bits binary, codes binary")
    return keys.repartition("key").sortWithinPartitions("key", "size", "unit").mapInArrow(near, "unit long, near long, codes binary")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yes = [similar(shingles(x), shingles(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.select([0, 1]).filter(pa.array(yes, pa.bool_()))


def links(shapes: DataFrame) -> DataFrame:
    """(unit, other): verified links between different units, which make the same classes as all pairs of similarity SIMILAR or more.

    The units of a bucket are compared with one another. Buckets are counted by COARSE hashes of their keys, which
    pre-aggregation keeps small; where such a group has more than PART units, its buckets are cut into salted parts, and
    each two parts meet in a task of their own. So no task takes a hot bucket whole, and no pairs of a bucket are
    written out. Units that meet in levels of LARGE ones have many keys; there the keys go without the codes, and the
    pairs that share one are joined with them. Units that are `gathered` are of one class from the start.
    """
    if "near" not in shapes.columns:
        shapes = settle(gathered(shapes))
    linked, shapes = shapes.where("codes IS NULL"), shapes.where("codes IS NOT NULL")
    keys = banded(shapes, False)
    if shapes.limit(PART + 1).count() <= PART:  # no bucket can hold more
        found = _leading(keys.withColumn("salt", F.lit(0)))
    else:
        group = F.pmod("band", F.lit(COARSE))
        hot = settle(keys.groupBy(group.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > PART).select("g", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
        salted = keys.join(F.broadcast(hot), group == F.col("g"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # COARSE rows at the most
        own = F.pmod(F.hash("unit"), F.col("parts"))
        meetings = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(own, k) * F.col("parts") + F.greatest(own, k))
        found = _leading(salted.withColumn("salt", F.explode(meetings)))
    found = found.union(linked.select("unit", F.col("near").alias("other")))
    large = shapes.where(F.length("codes") >= 2 * LARGE * SIMILAR)
    if large.isEmpty():
        return found
    keys = settle(banded(large, True).select("band", "unit", "near", "size"))
    other = keys.select("band", F.col("unit").alias("other"), F.col("near").alias("near2"), F.col("size").alias("size2"))
    near = (F.col("unit") < F.col("other")) & (F.col("near") != F.col("near2")) & (F.col("size") >= SIMILAR * F.col("size2") - NEAR) & (F.col("size2") >= SIMILAR * F.col("size") - NEAR)
    pairs = keys.join(other, "band").where(near).select("unit", "other").distinct()
    whole = pairs.join(large.select("unit", "codes"), "unit").join(large.select(F.col("unit").alias("other"), F.col("codes").alias("codes2")), "other")
    return found.union(whole.select("unit", "other", "codes", "codes2").mapInArrow(_verified, "unit long, other long"))


def clustered(rows: DataFrame) -> DataFrame:
    """The rows of views 0 and 1 with `cluster`: the smallest unit of their class of linked units."""
    parts = rows.where("view < 2 AND n > 0")
    shapes = settle(gathered(parts))
    return parts.drop("codes").join(components(links(shapes), "unit", "other", "cluster", shapes.where("codes IS NOT NULL").count()), "unit", "left").withColumn("cluster", F.coalesce("cluster", "unit"))


def classified(files: DataFrame) -> DataFrame:
    """One row for each file: file_id, kind (blob, minified, generated, vendored or null), and the shares of its characters that stand in clusters of each sort.

    Files are cut into units (see `units`), and clusters of their masked shingles decide. Blob: most characters are in
    literal-only clusters, BULK or more of them in literals or in families of FAMILY units of the repository. Generated: most are in families within the repository, of FAMILY units or more and A_FILE a
    file. Minified: they are in clusters of any kind, and the file has far more code on a line than people write (literals left out).
    Vendored: what tells of its origin is in a cluster over several repositories, and so is the name it gives (the
    repository of that name has the original); or most characters are in units that stand in several repositories with
    all their names (the only repository whose file tells of no origin, while others do, has the original). A file without clustered units has no kind. Comments do not count.

    Null repositories count as one. Repeated ids add up to one file. Empty input gives an empty result.
    """
    rows = settle(profiles(files))
    marked = settle(clustered(rows))
    per = marked.where("view = 0").groupBy("file_id", "repo", "cluster").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("literal").alias("literal"))
    within = settle(per.groupBy("cluster", "repo").agg(F.sum("n").alias("members"), F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("literal").alias("literal")))
    over = within.groupBy("cluster").agg(F.sum("members").alias("all_members"), F.try_divide(F.sum("literal"), F.sum("chars")).alias("share"))
    sorts = within.join(over, "cluster").select(
        "cluster", "repo", (F.col("all_members") > 1).alias("any"), ((F.col("all_members") > 1) & (F.col("share") >= LITERAL)).alias("literal_only"),
        ((F.col("members") >= FAMILY) & (F.col("members") >= A_FILE * F.col("files"))).alias("family"), (F.col("members") >= FAMILY).alias("many"),
    )
    covered = per.drop("literal").join(sorts, ["cluster", "repo"]).groupBy("file_id").agg(
        *(F.sum(F.when(F.expr(c), F.col("chars")).otherwise(0)).alias(c) for c in ("any", "literal_only", "family")), F.sum(F.when(F.expr("literal_only AND many"), F.col("chars")).otherwise(0)).alias("literal_family")
    )
    several = F.min("repo") != F.max("repo")
    told = marked.where("view = 1").select("file_id", "repo", "cluster", "name")
    spread = told.groupBy("cluster").agg(several.alias("yes")).where("yes").select("cluster")
    claims = told.join(spread, "cluster")
    names = claims.groupBy("name").agg(several.alias("yes")).where("yes").select("name")
    home = files.where("repo IS NOT NULL").select(F.xxhash64("repo").alias("repo"), F.lower(F.substring_index("repo", "/", -1)).alias("name")).distinct().withColumn("home", F.lit(True))
    foreign = claims.join(names, "name").join(home, ["repo", "name"], "left").where("home IS NULL").select("file_id", F.lit(True).alias("foreign")).distinct()
    whole = rows.where("view = 2").select("file_id", "repo", "unit", "chars", "n")
    own = F.when(F.col("n") == 0, F.col("repo"))
    shared = whole.groupBy("unit").agg(several.alias("yes"), F.when((F.min(own) == F.max(own)) & (F.max("n") == 1), F.min(own)).alias("source")).where("yes").select("unit", "source")
    copied = whole.join(shared, "unit").where("source IS NULL OR source != repo").groupBy("file_id").agg(F.sum("chars").alias("copied"))
    total = rows.where("view = 0").groupBy("file_id").agg(F.sum("chars").alias("total"), F.sum("literal").alias("data"), F.max("a_line").alias("a_line"))
    joined = total.join(covered, "file_id", "left").join(copied, "file_id", "left").join(foreign, "file_id", "left")
    part = {c: F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0)) for c in ("any", "literal_only", "literal_family", "family", "copied")}
    bulk = (F.col("data") >= BULK) | (part["literal_family"] >= SHARE["blob"])
    kind = (
        F.when(F.col("foreign") | (part["copied"] >= SHARE["copied"]), "vendored").when((part["literal_only"] >= SHARE["blob"]) & bulk, "blob")
        .when((part["any"] >= SHARE["minified"]) & (F.col("a_line") >= LONG_LINES), "minified").when(part["family"] >= SHARE["generated"], "generated")
    )
    return joined.select("file_id", kind.alias("kind"), *(F.round(part[c], 4).alias(f"in_{c}") for c in ("any", "literal_only", "family", "copied")), F.round("a_line", 2).alias("chars_a_line"))
