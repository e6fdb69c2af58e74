"""Two corpora beside each other: presence of labels, exact tests with correction, bootstrap over repositories, style, agreement, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import features, lexicon, tails
from glosswork.functions import text as T
from glosswork.operators.aggregates import function_mix, share


def labelled(rows: DataFrame) -> DataFrame:
    """The rows with `labels`: the marker categories their text has, each once. The categories are known, so that nothing is joined."""
    counts = features.marker_counts(F.col("text"))
    return rows.withColumn("labels", F.filter(F.array(*(F.when(n > 0, c) for c, n in counts.items())), lambda x: x.isNotNull()))


def presence(rows: DataFrame, labels: Sequence[str], a: str = "ai", b: str = "human") -> DataFrame:
    """label, n_a, n_b, of_a, of_b: rows of each side that have a label (once a row), with all `labels` that no row has too, and the rows of each side."""
    s = F.col("source")
    sides = rows.where(s.isin(a, b))
    hits = sides.select("source", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count_if(s == a).alias("n_a"), F.count_if(s == b).alias("n_b"))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    totals = sides.agg(F.count_if(s == a).alias("of_a"), F.count_if(s == b).alias("of_b"))
    return every.join(hits, "label", "left").na.fill(0, ["n_a", "n_b"]).join(F.broadcast(totals))  # one row


def compared(counts: DataFrame) -> DataFrame:
    """The rows of `presence` with per_1k of each side, the odds ratio with 0.5 added to every cell (null without rows), Fisher's p and q.

    q is p corrected for all labels (Benjamini and Hochberg), rare ones too. There are as many rows as labels.
    """
    a, b, na, nb = (F.col(c) for c in ("n_a", "n_b", "of_a", "of_b"))
    odds = F.when(na + nb > 0, ((a + 0.5) * (nb - b + 0.5)) / ((na - a + 0.5) * (b + 0.5)))
    rows = counts.select("label", "n_a", "n_b", F.round(F.try_divide(1000.0 * a, na), 5).alias("a_per_1k"), F.round(F.try_divide(1000.0 * b, nb), 5).alias("b_per_1k"), F.round(odds, 5).alias("odds_ratio"), tails.fisher_p(a, na - a, b, nb - b).alias("p"))
    return corrected(rows).withColumns({"p": F.round("p", 9), "q": F.round("q", 9)})


def corrected(rows: DataFrame, p: str = "p") -> DataFrame:
    """The rows with `q`: the least p x m / rank of this and all higher ranks, 1 at the most. For tables of labels: one window over all."""
    order = Window.orderBy(p)
    ranked = rows.withColumns({"_rank": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy())})
    down = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def idiom_rates(rows: DataFrame, known: Sequence[tuple] = lexicon.IDIOMS) -> DataFrame:
    """source, category, connotation, comments, per_1k: comments with an idiom of the category and connotation, once each."""
    lemmas = rows.sparkSession.createDataFrame([k[:3] for k in known], "idiom string, category string, connotation string")
    hits = rows.select("source", "id", F.explode(features.idioms(F.col("text"), known)).alias("idiom")).join(F.broadcast(lemmas), "idiom")  # as many rows as idioms
    each = hits.select("source", "id", "category", "connotation").distinct().groupBy("source", "category", "connotation").agg(F.count("*").alias("comments"))
    totals = rows.groupBy("source").agg(F.count("*").alias("_n")).withColumnRenamed("source", "_s")
    return each.join(totals, F.col("source").eqNullSafe(F.col("_s"))).select("source", "category", "connotation", "comments", F.round(1000.0 * F.col("comments") / F.col("_n"), 5).alias("per_1k"))


def style(rows: DataFrame) -> DataFrame:
    """By source: n, mean words, and shares of questions, closing periods, capitals, URLs, issue references and verb forms."""
    f = features.flags(F.col("text"))
    flagged = rows.select("source", *(v.alias(k) for k, v in f.items()), features.verb_form(F.col("text")).alias("verb"))
    shares = [share(F.count_if(F.col(k)), F.count("*")).alias(k) for k in f if k != "n_words"]
    verbs = [share(F.count_if(F.col("verb") == v), F.count("*")).alias(v) for v in ("imperative", "third_person", "gerund")]
    return flagged.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"), *shares, *verbs)


def documentation(pool: DataFrame) -> DataFrame:
    """The class mix of documentation by source, with its mean overlap and the share of third-person beginnings."""
    docs = pool.where("kind = 'doc'")
    more = docs.groupBy("source").agg(F.round(F.avg("overlap"), 6).alias("mean_overlap"), share(F.count_if(features.verb_form(F.col("text")) == "third_person"), F.count("*")).alias("third_person"))
    return function_mix(docs, "source").join(more, "source")


def bootstrap(clusters: DataFrame, a: str = "ai", b: str = "human", iterations: int = 200, seed: int = 7, ratio: bool = False) -> DataFrame:
    """estimate, low, high: the difference (or ratio) of the sides' pooled shares, with the 95 % interval over resampled clusters.

    `clusters` has side, cluster, num and den: one row for each cluster, so all rows of a repository fall together. A
    draw is a hash of seed, iteration, side and slot, modulo the clusters of the side, so that a run can be repeated on
    any cluster; draws are joined by the number of the cluster and summed by iteration, without the driver. Clusters
    are numbered by their rank over the names, which pass one window. A side with fewer than two clusters leaves the
    interval null; a ratio with a zero in it is null.
    """
    s = F.col("side")
    known = clusters.where(s.isin(a, b)).select("side", "num", "den", (F.row_number().over(Window.partitionBy("side").orderBy("cluster")) - 1).alias("place"))
    sizes = known.groupBy("side").agg(F.count("*").alias("n"))
    slots = known.join(F.broadcast(sizes), "side").select("side", F.col("place").alias("slot"), "n").withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(iterations))))  # two rows
    code = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "turn", "side", "slot")), 1, 8)
    drawn = slots.select("turn", "side", F.pmod(F.conv(code, 16, 10).cast("long"), F.col("n")).alias("place"))
    sums = drawn.join(known, ["side", "place"]).groupBy("turn").agg(*_sums(s, a, b))
    point = known.agg(*_sums(s, a, b), F.count_if(s == a).alias("ka"), F.count_if(s == b).alias("kb"))
    value = _ratio() if ratio else _difference()
    spread = sums.select(value.alias("v")).agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))
    enough = (F.col("ka") >= 2) & (F.col("kb") >= 2)
    return point.join(spread).select(F.round(value, 6).alias("estimate"), *(F.round(F.when(enough, F.col(c)), 6).alias(c) for c in ("low", "high")), F.col("ka").alias("clusters_a"), F.col("kb").alias("clusters_b"))


def _sums(s: Column, a: str, b: str) -> list[Column]:
    return [F.sum(F.when(s == side, F.col(c))).alias(f"{c}_{k}") for c in ("num", "den") for k, side in (("a", a), ("b", b))]


def _difference() -> Column:
    return F.try_divide(F.col("num_a").cast("double"), F.col("den_a")) - F.try_divide(F.col("num_b").cast("double"), F.col("den_b"))


def _ratio() -> Column:
    return F.try_divide(F.try_divide(F.col("num_a").cast("double"), F.col("den_a")), F.try_divide(F.col("num_b").cast("double"), F.col("den_b")))


# Labels of people against those of the rule.


def confusion(rows: DataFrame) -> DataFrame:
    """truth, rule, n of rows with both."""
    return rows.where("truth IS NOT NULL AND rule IS NOT NULL").groupBy("truth", "rule").agg(F.count("*").alias("n"))


def scores(rows: DataFrame) -> DataFrame:
    """By class: n (of the truth), precision, recall, f1, and the accuracy over all. Null where nothing divides."""
    both = rows.where("truth IS NOT NULL AND rule IS NOT NULL")
    cells = both.groupBy("truth", "rule").agg(F.count("*").alias("n"))
    each = cells.select("n", F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("r")), F.struct(F.col("rule").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("r")))).alias("x"), (F.col("truth") == F.col("rule")).alias("same"))
    sums = each.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("n") * F.col("x.t")).alias("n"), F.sum(F.col("n") * F.col("x.r")).alias("named"), F.sum(F.when(F.col("same"), F.col("n") * F.col("x.t")).otherwise(0)).alias("hit"))
    total = cells.agg(share(F.sum(F.when(F.col("truth") == F.col("rule"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return sums.join(F.broadcast(total)).select("class", "n", share(F.col("hit"), F.col("named")).alias("precision"), share(F.col("hit"), F.col("n")).alias("recall"), share(2 * F.col("hit"), F.col("n") + F.col("named")).alias("f1"), "accuracy")  # one row


def theta_scan(rows: DataFrame, low: int = 20, high: int = 90, step: int = 2) -> DataFrame:
    """theta in hundredths, f1 of `referential`, and best (the highest f1, of equals the nearest to 50). Rows collapse to counts by overlap, cue and truth first."""
    counts = rows.where("truth IS NOT NULL").groupBy(F.round("overlap", 5).alias("overlap"), "cue", "truth").agg(F.count("*").alias("k"))
    each = counts.withColumn("theta", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    named = features.rule_label(F.col("overlap"), F.col("cue"), F.col("theta") / 100) == "referential"
    true = F.col("truth") == "referential"
    k = F.col("k")
    f1 = share(2 * F.sum(F.when(named & true, k).otherwise(0)), F.sum(F.when(named, k).otherwise(0)) + F.sum(F.when(true, k).otherwise(0)))
    curve = each.groupBy("theta").agg(f1.alias("f1"))
    w = Window.orderBy(F.desc_nulls_last("f1"), F.abs(F.col("theta") - 50), "theta")  # as many rows as thresholds
    return curve.withColumn("best", F.row_number().over(w) == 1)


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, kappa of two columns of labels and the word for it; null kappa without rows, 1 where chance alone agrees wholly."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("k"))
    n = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("k")).otherwise(0.0)).alias("same"))
    margins = cells.groupBy("x").agg(F.sum("k").alias("kx")).join(cells.groupBy(F.col("y").alias("x")).agg(F.sum("k").alias("ky")), "x").agg(F.coalesce(F.sum(F.col("kx") * F.col("ky")), F.lit(0.0)).alias("chance"))
    pe, po = F.col("chance") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    value = F.when(F.col("n") > 0, F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)))
    return n.join(F.broadcast(margins)).select(F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.round(value, 6).alias("kappa")).withColumn("word", features.kappa_word(F.col("kappa")))  # one row


# Curves over the threshold, from the dense histogram.


def referential_curve(histogram: DataFrame, classified: DataFrame) -> DataFrame:
    """source, theta (hundredths, 20 to 90), share of classified rows that are referential: the histogram without cues summed from its end."""
    down = Window.partitionBy("source").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.select("source", F.col("bin").alias("theta"), F.sum("n_nocue").over(down).alias("_k"))
    return sums.where("theta BETWEEN 20 AND 90").join(classified, "source").select("source", "theta", share(F.col("_k"), F.col("classified")).alias("share"))


def steps(curve: DataFrame, least: float = 0.1) -> DataFrame:
    """Thresholds at which the share falls by `least` or more to the next: source, theta, fall."""
    w = Window.partitionBy("source").orderBy("theta")
    fall = F.round(F.col("share") - F.lead("share").over(w), 6)
    return curve.withColumn("fall", fall).where(F.col("fall") >= least).select("source", "theta", "fall")


def crossings(curve: DataFrame, a: str = "ai", b: str = "human") -> DataFrame:
    """theta, gap (a less b) and whether the curves cross between the threshold before and this one."""
    both = curve.groupBy("theta").agg(F.max(F.when(F.col("source") == a, F.col("share"))).alias("x"), F.max(F.when(F.col("source") == b, F.col("share"))).alias("y"))
    gap = F.round(F.col("x") - F.col("y"), 6)
    w = Window.orderBy("theta")  # as many rows as thresholds
    return both.select("theta", gap.alias("gap")).withColumn("crosses", F.coalesce(F.signum("gap") * F.lag(F.signum("gap")).over(w) < 0, F.lit(False)))


def rebinned(histogram: DataFrame, width: int = 5) -> DataFrame:
    """The histogram in bins of `width` hundredths."""
    return histogram.groupBy("source", F.floor(F.col("bin") / width).cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.sum("n_nocue").alias("n_nocue"))


def small_groups(pool: DataFrame, repos: int = 30, rows: int = 300) -> DataFrame:
    """By source: rows, repositories, and whether either is fewer than is wanted."""
    return pool.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("repo").alias("repos")).withColumn("few", (F.col("n") < rows) | (F.col("repos") < repos))


def flagged(pool: DataFrame) -> DataFrame:
    """The comments that restate their code (class referential, no documentation), with the overlap to three places; what has no code or overlap is not judged."""
    return pool.where("kind != 'doc' AND code IS NOT NULL AND overlap IS NOT NULL AND cls = 'referential'").select("id", "repo", "file", "line", F.round("overlap", 3).alias("overlap"))


def full_overlap(rows: DataFrame, paraphrases=None, least: int = 3) -> DataFrame:
    """The rows with overlap, overlap_ext, jaccard, n_content, matched and novel, on stems.

    overlap is the share of the comment's content stems that the code has, overlap_ext the share that it has or
    paraphrases, jaccard that of the union. All null below `least` content stems and without words in the code.
    """
    from glosswork.functions.stem import stems

    table = F.create_map(*[x for k, v in (paraphrases or lexicon.PARAPHRASES).items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    code = F.array_distinct(T.identifier_words(F.col("code")))
    said = F.flatten(F.filter(F.transform(F.col("_words"), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()))
    step = rows.withColumn("_words", code).withColumns({"_ours": stems(T.content_words(F.col("text"))), "_theirs": stems(F.col("_words")), "_said": stems(said)})
    ours, theirs = F.col("_ours"), F.col("_theirs")
    matched, ext = F.array_intersect(ours, theirs), F.array_intersect(ours, F.array_union(theirs, F.col("_said")))
    fit = (F.size(ours) >= least) & (F.size(theirs) > 0)
    n = F.size(ours)
    columns = {
        "n_content": F.when(ours.isNotNull(), n), "overlap": F.when(fit, F.round(F.size(matched) / n, 6)), "overlap_ext": F.when(fit, F.round(F.size(ext) / n, 6)),
        "jaccard": F.when(fit, F.round(F.size(matched) / F.size(F.array_union(ours, theirs)), 6)), "matched": F.when(fit, F.sort_array(matched)), "novel": F.when(fit, F.sort_array(F.array_except(ours, theirs))),
    }
    return step.withColumns(columns).drop("_words", "_ours", "_theirs", "_said")
