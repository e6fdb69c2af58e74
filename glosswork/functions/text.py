"""Text functions of comments and code as column expressions, without Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words without content of their own.
STOPWORDS = """
a about above after again against all also am an and any are aren't as at be because been before being below between both but by can can't
cannot could couldn't did didn't do does doesn't doing don't down during each either else etc few for from further had hadn't has hasn't have
haven't having he her here hers herself him himself his how i i'd i'll i'm i've if in into is isn't it it's its itself just let's may me might
more most mustn't my myself neither no nor not of off on once only or other ought our ours ourselves out over own per same shan't she should
shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
those though through thus to too under until up very via was wasn't we we'd we'll we're we've were weren't what when where whether which while
who whom whose why will with won't would wouldn't yet you you'd you'll you're you've your yours yourself yourselves across along among around
beyond inside outside onto upon throughout toward towards within without using
""".split()


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


def norm_key(text: Column) -> Column:
    """Lower-cased text with every run of other characters than letters, digits and `_` as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def normalize(text: Column) -> Column:
    """Curly quotes as plain ones; dashes stay as they are."""
    return F.translate(text, "‘’“”", "''\"\"")


def strip_refs(text: Column) -> Column:
    """URLs, then issue references (#1 to #9999999, ABC-12, gh-7) replaced by a space."""
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")
    return F.regexp_replace(text, r"(?<![\w&])#\d{1,7}\b|\b[A-Z][A-Z0-9]+-\d+\b|\b(?:gh|GH)-\d+\b", " ")


def match_view(text: Column) -> Column:
    """The form in which phrases are looked for: lower case, `&` as `and`, hyphens and runs of white space as one space."""
    plain = F.replace(F.replace(F.lower(normalize(text)), F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(" "))
    return F.regexp_replace(plain, r"\s+", " ")


def comment_words(text: Column) -> Column:
    """Words of a comment in order: ASCII, lower case, without references, a closing `'s` and single letters. Null for null."""
    plain = F.regexp_replace(F.lower(normalize(strip_refs(text))), "'s(?![a-z0-9'])", " ")
    return F.regexp_extract_all(plain, F.lit(r"([a-z][a-z0-9']+)"), 1)


def identifier_words(text: Column) -> Column:
    """Parts of identifiers in order: split at `_` and at changes of case, lower case, two characters or more, not all digits.

    Digits before an identifier belong to none. All by three patterns over the whole text, so nothing runs for each part.
    """
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_])[0-9]+", "")
    text = F.regexp_replace(text, "([a-z0-9])(?=[A-Z])|([A-Z])(?=[A-Z][a-z])", "$1$2_")
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+|[0-9]+[a-z][a-z0-9]*"), 0)


def content_words(text: Column) -> Column:
    """Distinct parts of identifiers and words of a comment without stop words."""
    return F.array_except(F.array_distinct(identifier_words(normalize(strip_refs(text)))), F.array(*map(F.lit, STOPWORDS)))


def overlap(text: Column, code: Column, least: int = 3) -> Column:
    """Share of a comment's content words that its code has. Null below `least` content words, or without words in the code."""
    ours, theirs = content_words(text), F.array_distinct(identifier_words(code))
    return F.when((F.size(ours) >= least) & (F.size(theirs) > 0), F.size(F.array_intersect(ours, theirs)) / F.size(ours))


def is_english(text: Column, share: float = 0.12) -> Column:
    """Nine letters of ten are ASCII and, from six words on, the share of stop words is `share` at least. False without letters or for null."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    ascii_ones = F.regexp_count(text, F.lit("[A-Za-z]"))
    words = comment_words(text)
    stops = F.size(F.filter(words, lambda w: is_stopword(w)))
    plain = (letters > 0) & (ascii_ones * 10 >= letters * 9)
    common = F.when(F.size(words) < 6, True).otherwise(stops >= share * F.size(words))
    return F.coalesce(F.when(plain, common).otherwise(False), F.lit(False))


def bin100(value: Column) -> Column:
    """The bin 0 to 99 of a share."""
    return F.least(F.floor(value * 100 + 1e-9).cast("int"), F.lit(99))
