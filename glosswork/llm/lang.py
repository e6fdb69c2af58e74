"""Languages of documents and of the stretches inside mixed texts: script ranges, word scores, Viterbi."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages that share a script.
SEEDS = {
    "en": "the of and to in is it that for was on are with as be at this have from or by not but what all were when we there can an your which their if do will each about how up out then them these so some would has",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum kann wenn oder ich",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son mais comme nous cette être fait dont aux on si leur ses elle",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando esta ser son dos también fue hay",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso",
    "it": "di e il la che in un a per è una con del della non le si da i dei al lo gli come più alla ma nel o su sono se anche questo ha delle cui quando essere ogni tra loro due questa",
    "pl": "w i na z się do nie że jest to o od za przez po jak dla jego ale co przy są tym tego lub być już ze oraz może które który czy ma tylko przed bez gdy tak jako aby nad",
    "tr": "ve bir bu da de için ile olarak çok daha en ne gibi olan kadar sonra her o ama mi ya değil var ki önce ancak veya bütün bunu onun olur ise şey göre iki çünkü diye",
    "ru": "и в не на я что он с как это по но они мы из у за то все так же от бы для вы о его к когда если или только до ещё нет ни быть был при чтобы уже этот где она может каждый",
    "uk": "і в не на що я з як це по але вони ми із у за то все так же від б для ви про його до коли якщо або тільки ще ні бути був при щоб вже цей де вона може та є й кожен",
}
LANGS = ("en", "de", "fr", "es", "pt", "it", "pl", "tr", "ru", "uk", "zh", "ja", "ko", "hi", "th", "ar")
BY_SCRIPT = {"latin": ("en", "de", "fr", "es", "pt", "it", "pl", "tr"), "cyrillic": ("ru", "uk")}
# Names of the languages as labels write them, three-letter codes first.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french", "es": "spa spanish", "pt": "por portuguese", "it": "ita italian",
    "ru": "rus russian", "uk": "ukr ukrainian", "pl": "pol polish", "tr": "tur turkish", "zh": "zho chi chinese cmn", "ja": "jpn japanese",
    "ko": "kor korean", "hi": "hin hindi", "th": "tha thai", "ar": "ara arabic",
}
LABELS = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}
UNKNOWN = ("", "und", "unknown")

TOKEN = re.compile(
    r"(?P<skip>(?:https?|ftp)://\S+|[\w.-]*@[\w.-]+\.\w+|%[-\w.]*[a-zA-Z](?![a-z])|\\[nrt\"']|[A-Za-z0-9]*_[A-Za-z0-9_]*|[A-Za-z]*[0-9][A-Za-z0-9_]*|[a-z]{2,}(?:[A-Z][a-z0-9]+)+[A-Za-z0-9_]*)"
    r"|(?P<latin>[A-Za-zÀ-ɏḀ-ỿ]+̇?[A-Za-zÀ-ɏ]*)"
    r"|(?P<cyrillic>[Ѐ-ӿ]+(?:['’][Ѐ-ӿ]+)?)"
    r"|(?P<cjk>[々〆぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]+)"
    r"|(?P<ko>[ᄀ-ᇿ가-힯]+)|(?P<th>[฀-๿]+)|(?P<hi>[ऀ-ॣ॰-ॿ]+)|(?P<ar>[؀-ۿݐ-ݿ]+)"
    r"|(?P<other>[^\W\d_]+)"
)
# First and last letters of scripts that one language has to itself; any other script is `und`.
ALONE = {"el": "Ͱ-Ͽ", "he": "֐-׿", "hy": "Ա-֏", "ka": "Ⴀ-ჿ", "bn": "ঀ-৿", "pa": "਀-੿", "gu": "઀-૿", "ta": "஀-௿", "te": "ఀ-౿", "kn": "ಀ-೿", "ml": "ഀ-ൿ", "si": "඀-෿", "lo": "຀-໿", "my": "က-႟", "am": "ሀ-፿", "km": "ក-៿", "bo": "ༀ-࿿"}
UND = "und"
# A stretch of so many words of which fewer than this share are known is in no language of the model.
FIT_WORDS, FIT_SHARE = 6, 0.34
KANA = re.compile(r"[぀-ゟァ-ヺー]")
DEEP = 6.0
SWITCH = 10.0
SAMPLE, OWN_PARTS = 40_000, 200


def label(value: str | None) -> str | None:
    """The language that a label names: its two-letter code, the label itself if it is another one, None if it says nothing."""
    if value is None or value.strip().lower() in UNKNOWN:
        return None
    first = re.split(r"[-_]", value.strip().lower())[0]
    return LABELS.get(first, first)


def plain(word: str) -> str:
    """A word without diacritics, as texts that lost them write it."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("ı", "i").replace("ł", "l").replace("ß", "ss")) if not unicodedata.combining(c))


def tokens(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, lower-case word, start, end); identifiers, numbers and addresses belong to no language and are left out."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind != "skip":
            yield kind, m.group().lower(), m.start(), m.end()


class Model:
    """Scores of words by language: 0 for the likeliest, below for the others, -DEEP at the least. Unknown words score nothing."""

    def __init__(self, words: dict[str, dict[str, tuple[float, ...]]], prior: dict[str, float] | None = None) -> None:
        self.words = words
        self.prior = prior or {}

    def score(self, kind: str, word: str) -> tuple[float, dict[str, float]] | None:
        """(weight of the token against languages that are not named, scores of the named ones), or None for a neutral token."""
        if kind == "latin" or kind == "cyrillic":
            known = self.words[kind]
            found = known.get(word)
            if found is None and not word.isascii():
                found = known.get(plain(word))
            return (DEEP, dict(zip(BY_SCRIPT[kind], found))) if found else None
        if kind == "other":
            return (DEEP, {next((l for l, span in ALONE.items() if span[0] <= word[0] <= span[2]), UND): 0.0})
        if kind == "cjk":
            if KANA.search(word):
                return (2 * DEEP, {"ja": 0.0, "zh": -DEEP})
            return (min(2 * DEEP, 2.0 * len(word)), {"zh": 0.0, "ja": -min(DEEP, 1.5 * max(0, len(word) - 1))})
        return (2 * DEEP if len(word) > 2 else DEEP, {kind: 0.0})


def _counted(rows: Iterable[tuple[str, Counter]], kind: str) -> dict[str, tuple[float, ...]]:
    langs = BY_SCRIPT[kind]
    count: dict[str, Counter] = {l: Counter() for l in langs}
    for l, words in rows:
        count[l].update(words)
    total = {l: sum(c.values()) + 1.0 for l, c in count.items()}
    out = {}
    for word in set().union(*count.values()):
        logs = [math.log((count[l][word] + 0.02 * (count[l][word] == 0)) / total[l] + 1e-6) for l in langs]
        top = max(logs)
        out[word] = tuple(max(-DEEP, x - top) for x in logs)
    return out


def seeded() -> Model:
    words: dict[str, dict[str, tuple[float, ...]]] = {}
    for kind, langs in BY_SCRIPT.items():
        words[kind] = {}
        for word in {w for l in langs for w in SEEDS[l].split()}:
            has = [word in SEEDS[l].split() for l in langs]
            words[kind][word] = words[kind][plain(word)] = tuple(0.0 if h else -4.0 for h in has)
    return Model(words)


def fit(texts: Iterable[tuple[str | None, str | None, str, float]], rounds: int = 3) -> Model:
    """A model from (label, group, text, weight) of a bounded sample; the weight is how many rows a sampled one stands for.

    Seeds and labels segment the sample; its words are counted by the language of their segment, and so again with
    the new scores. A word must occur in three groups (repositories) or more, which keeps names of one project out.
    """
    model = seeded()
    sample = [(label(l), g, list(tokens(t)), w) for l, g, t, w in texts if t]
    for turn in range(rounds):
        counts: dict[str, dict[str, Counter]] = {k: defaultdict(Counter) for k in BY_SCRIPT}
        groups: dict[str, set] = defaultdict(set)
        seen: Counter = Counter()
        for lab, group, toks, weight in sample:
            for lang, _, a, b in stretches(toks, model, hint=lab if turn < 2 else None):
                seen[lang] += weight
                for kind, word, _, _ in toks[a:b]:
                    if kind in BY_SCRIPT and lang in BY_SCRIPT[kind]:
                        counts[kind][lang][word] += weight
                        if len(groups[word]) < 3:
                            groups[word].add(group)
        words = {}
        for kind, by in counts.items():
            kept = [(l, Counter({w: n for w, n in c.items() if len(groups[w]) >= 3 and n >= 2})) for l, c in by.items()]
            kept += [(l, Counter({w: 1 for w in SEEDS[l].split()})) for l in BY_SCRIPT[kind]]
            table = _counted(kept, kind)
            bare: dict[str, Counter] = {}
            for l, c in kept:
                bare[l] = bare.get(l, Counter())
                for w, n in c.items():
                    if plain(w) != w:
                        bare[l][plain(w)] += n
                    else:
                        bare[l][w] += n
            for w, scores in _counted(bare.items(), kind).items():
                table.setdefault(w, scores)
            words[kind] = table
        most = max(seen.values(), default=1.0)
        model = Model(words, {l: max(-DEEP, math.log((seen[l] + 0.01) / most)) for l in LANGS})
    return model


def stretches(toks: list[tuple[str, str, int, int]], model: Model, hint: str | None = None, switch: float = SWITCH) -> list[tuple[str, float, int, int]]:
    """(lang, confidence, first token, end token) of the longest one-language runs, by Viterbi with a switching penalty.

    Where the best single language loses less than `switch` against the sum of the best scores of all words, no
    path with a switch can win, so that it is the result. A text without known words has no stretch, unless a label
    hints at a language of its script.
    """
    emitted = []  # (token index, weight, scores)
    for k, (kind, word, _, _) in enumerate(toks):
        s = model.score(kind, word)
        if s:
            emitted.append((k, *s))
    if not emitted:
        kinds = {t[0] for t in toks}
        for kind in kinds:
            if hint in BY_SCRIPT.get(kind, ()):
                return [(hint, 0.5, 0, len(toks))]
        return []
    total: dict[str, float] = {}
    every = 0.0
    for _, weight, scores in emitted:
        every += weight
        for l, s in scores.items():
            total[l] = total.get(l, 0.0) + weight + s
    for l in total:
        total[l] += model.prior.get(l, 0.0) + (l == hint)
    ranked = sorted(total.items(), key=lambda x: (-x[1], LANGS.index(x[0]) if x[0] in LANGS else len(LANGS), x[0]))
    best, gained = ranked[0]
    if every - gained < switch:
        second = ranked[1][1] if len(ranked) > 1 else 0.0
        return [(best, _confidence(gained - second), 0, len(toks))]
    names = [l for l, _ in ranked if any(s.get(l) == 0.0 for _, _, s in emitted)] or [best]
    path = [model.prior.get(l, 0.0) for l in names]
    back: list[list[int]] = []
    for k, (_, weight, scores) in enumerate(emitted):
        top = max(range(len(names)), key=path.__getitem__)
        came, now = [], []
        for j, l in enumerate(names):
            stay, jump = path[j], path[top] - switch
            came.append(j if stay >= jump else top)
            now.append(max(stay, jump) + scores.get(l, -weight))
        back.append(came)
        path = now
    j = max(range(len(names)), key=path.__getitem__)
    states = [0] * len(emitted)
    for k in range(len(emitted) - 1, -1, -1):
        states[k] = j
        j = back[k][j]
    out: list[tuple[str, float, int, int]] = []
    first = 0
    for k in range(1, len(states) + 1):
        if k == len(states) or states[k] != states[first]:
            lang = names[states[first]]
            margin = min((sum(s.get(lang, -w) - s.get(o, -w) for _, w, s in emitted[first:k]) for o in names if o != lang), default=DEEP)
            out.append((lang, _confidence(margin), 0 if not out else emitted[first][0], len(toks) if k == len(states) else emitted[k][0]))
            first = k
    return out


def _confidence(margin: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, margin))))


def segments(text: str | None, model: Model) -> list[tuple[str, float, int, int]]:
    """(lang, confidence, start, end) of the stretches of a text, offsets in code points."""
    if not text:
        return []
    toks = list(tokens(text))
    return [(l, c, toks[a][2], toks[b - 1][3]) for l, c, a, b in stretches(toks, model)]


def sample(df: DataFrame, text_col: str = "text", label_col: str = "text_lang", group_col: str = "repo", id_col: str = "comment_id", most: int = SAMPLE, labels: int = OWN_PARTS) -> list[tuple[str | None, str | None, str, float]]:
    """A bounded sample of labelled rows, as even over the labels as they allow; rows are taken by the hash of their id.

    Labels are counted on their column alone. They are served from the rarest on, each with an equal part of what is
    left, so that rare ones come whole and the frequent share the rest; never more than twice `most` rows. The `labels`
    most frequent ones have parts of their own, all others together have one more.
    """
    name = F.coalesce(F.lower(F.trim(F.col(label_col))), F.lit(""))
    counts = df.groupBy(name.alias("label")).count()
    sizes = counts.orderBy(F.desc("count"), "label").limit(labels).collect()
    if not sizes:
        return []
    rest = counts.agg(F.sum("count")).head()[0] - sum(r["count"] for r in sizes)
    scale = 1_000_000
    share, left = {}, most
    for k, r in enumerate(reversed(sizes)):
        part = min(r["count"], left // (len(sizes) - k))
        share[r.label] = max(1, part) / r["count"]
        left -= part
    other = min(1.0, most / labels / rest) if rest else 0.0
    even = F.create_map(*[x for l, s in share.items() for x in (F.lit(l), F.lit(max(1, int(s * scale))))])
    rows = df.where(F.col(text_col).isNotNull()).select(name.alias("label"), F.col(group_col).alias("g"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h"))
    taken = rows.where(F.pmod("h", F.lit(scale)) < F.coalesce(F.try_element_at(even, F.col("label")), F.lit(int(other * scale)))).drop("h")
    return [(r.label or None, r.g, r.t, 1 / share.get(r.label, other)) for r in taken.limit(2 * most).collect()]


CODE_LINE = re.compile(
    r"""\s*(?:
      (?:(?:auto|int|let|const|var|final|static|mut|long|char|bool|boolean|double|float|String|unsigned)\s+)*[A-Za-z_][\w.\[\]]*(?:\s*:\s*[\w<>\[\]]+)?\s*(?::=|[-+*/]?=)(?!=)\s*\S.*
    | (?:\}\s*)?(?:if|for|while|switch|else\ if|elif|catch)\b.*[{:]
    | (?:\}\s*)?(?:else|try|finally|do)\s*[{:]
    | [\w.]+\(.*\)\s*[;{:]?
    | (?:return|throw|raise|break|continue|yield|del|goto)\b\s*[\w.()\[\]"'-]*\s*;?
    | (?:return|throw|raise)\b.*;
    | (?:import|from|\#include|package|using|use)\s+[\w.{}*<>"'/:, ]+;
    | (?:def|class|func|fn|function|public|private|protected|struct|enum|interface|impl)\s+.*[({:]
    | [\]})]+\s*[;,]?
    | [<>=]{7}.*
    )\s*""",
    re.X,
)


def is_code(text: str) -> bool:
    """Whether most lines of a comment are statements that were commented out."""
    lines = [x for x in text.splitlines() if x.strip()]
    return bool(lines) and sum(1 for x in lines if CODE_LINE.fullmatch(x)) >= 0.6 * len(lines)


NOT_LANGUAGE = ("directive", "code", "empty")


def stretches_of(text: str | None, exclude: str | None, model: Model) -> list[tuple[str, float, int, int]]:
    """The stretches of a comment; none for directives, code and empty comments.

    A text in words of which none is known, or too few for its length, is one stretch in `und` with a low confidence.
    """
    if not text or exclude in NOT_LANGUAGE or is_code(text):
        return []
    toks = list(tokens(text))
    if not toks:
        return []
    found = stretches(toks, model)
    if not found:
        return [(UND, 0.1, toks[0][2], toks[-1][3])]
    out = []
    for l, c, a, b in found:
        n = b - a
        if n >= FIT_WORDS and toks[a][0] in BY_SCRIPT:
            fit = sum(1 for kind, word, _, _ in toks[a:b] if model.score(kind, word)) / n
            if fit < FIT_SHARE:
                l, c = UND, min(c, fit)
        out.append((l, c, toks[a][2], toks[b - 1][3]))
    return out


def fitted(df: DataFrame, most: int = SAMPLE) -> Model:
    """The model for a table of comments, fitted on a bounded sample of its labelled rows."""
    return fit(sample(df, most=most))


def languages(df: DataFrame, model: Model | None = None, most: int = SAMPLE) -> DataFrame:
    """One row for each one-language stretch of a comment: comment_id, seg_no, lang, confidence, start_char, end_char, label, mended.

    `df` has comment_id, text, text_lang, exclude and repo. `label` is the language that text_lang names; `mended`
    tells whether the label is missing or wrong, or the text has several languages. `und` is a text in words that the
    model does not know. Rows with a null id or text, and
    those not in natural language, give none. Each row is worked on alone; the model is broadcast (its size is
    bounded by the sample).
    """
    model = model or fitted(df, most)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out: list[tuple] = []
            for i, text, lab, exclude in zip(*(b.column(k).to_pylist() for k in range(4))):
                found = stretches_of(text, exclude, m)
                if found:
                    named = label(lab)
                    mended = len(found) > 1 or named != found[0][0]
                    out += [(i, k, l, c, a, e, named, mended) for k, (l, c, a, e) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [()] * 8, types)], names=columns)

    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    columns = ["comment_id", "seg_no", "lang", "confidence", "start_char", "end_char", "label", "mended"]
    rows = df.where("comment_id IS NOT NULL AND text IS NOT NULL").select(F.col("comment_id").cast("long"), "text", "text_lang", "exclude")
    return rows.mapInArrow(f, "comment_id long, seg_no int, lang string, confidence double, start_char int, end_char int, label string, mended boolean")
