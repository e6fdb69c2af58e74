"""Features, extraction, sampling and comparison: fixed values, and every query against its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from glosswork import sources
from glosswork.functions import features, tails
from glosswork.functions import text as T
from glosswork.functions.stem import stem
from glosswork.operators import comparison, extraction, sampling
from glosswork.plans import contrast


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).head().x


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(contrast.SQL))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("pool", "comments", "manifest", "source_files", "file_stats", "extract_stats", "repo_meta"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = contrast.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(contrast.SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect()) == want


def test_stems():
    want = {"initializes": "initi", "counters": "counter", "running": "run", "happily": "happili", "national": "nation", "flies": "fli", "dies": "die", "agreed": "agre", "caresses": "caress", "consistently": "consist", "queries": "queri"}
    assert {w: stem(w) for w in want} == want


def test_references_and_words(spark):
    assert one(spark, T.strip_refs(F.col("t")), t="see https://a.b/c #12 A1-23 gh-7 x#5 #12345678").split() == ["see", "x#5", "#12345678"]
    assert one(spark, T.identifier_words(F.col("t")), t="getUserName HTTPServer_v2 x + 1 9lives a_9b") == ["get", "user", "name", "http", "server", "v2", "lives", "9b"]


def test_full_overlap(spark):
    rows = [
        ("Return the user list", "def get_users():\n    return user_list"), ("Initializes counters and returns totals", "def initialize(counter): return total"),
        ("Loop over each item in the list", "for item in list:\n    pass"), ("two words", "x = two"), ("one two three words", None), ("one two three words", "{"), (None, "x"),
    ]
    got = comparison.full_overlap(spark.createDataFrame([(i, *r, "e") for i, r in enumerate(rows)], "i int, text string, code string, matched string").drop("matched")).orderBy("i").collect()
    assert [r.overlap for r in got[:2]] == [1.0, 1.0] and got[0].n_content == 3
    assert got[2].overlap < 1 and got[2].overlap_ext == 1.0
    assert [r.overlap for r in got[3:]] == [None] * 4
    assert got[1].novel == [] and got[1].matched == sorted(got[1].matched)


def test_markers_idioms_and_forms(spark):
    names = spark.createDataFrame([("Because it is so. I think TODO BUG",), ("review the diff, I/O buffers",), ("",), (None,)], "text string")
    got = [r.labels for r in comparison.labelled(names).collect()]
    assert {"cause", "tag", "hedge", "first_person"} <= set(got[0]) and not {"tag", "first_person"} & set(got[1]) and got[2:] == [[], []]
    assert one(spark, features.idioms(F.col("t")), t="This is quick & dirty, a real hack, such a hack; off-by-one") == ["quick and dirty", "hack", "off by one"]
    forms = [one(spark, features.verb_form(F.col("t")), t=t) for t in ("Return x", "Returns x", "Initializing x", "Stopping it", "Copies it", "The value is returned", "")]
    assert forms == ["imperative", "third_person", "gerund", "gerund", "third_person", None, None]
    classes = spark.createDataFrame([(0.6, False), (0.4, False), (None, False), (None, True)], "o double, c boolean").select(features.classify(F.col("o"), F.col("c")).alias("x"))
    assert [r.x for r in classes.collect()] == ["referential", "other", None, "explanatory"]
    assert one(spark, features.label_of(F.col("t")), t=" REF ") == "referential" and one(spark, features.label_of(F.col("t")), t="?") is None
    states = one(spark, features.chunks(F.col("t"), F.col("c")), t="Return the user quickly", c="return user")
    assert [s.state for s in states] == [1, 0, 1, 3]


def test_cleaning_and_exclusion(spark):
    assert one(spark, features.clean_block(F.col("t")), t="/**\n * Reads.\n * Ends.\n */") == "Reads.\nEnds."
    assert [one(spark, features.is_doc(F.col("t")), t=t) for t in ("/** a */", "/// a", "//! a", "/**/", "//// a", "// a")] == [True, True, True, False, False, False]
    reason = features.exclusion_reason(F.col("t"), F.lit(1))
    assert [one(spark, reason, t=t) for t in ("-----", "noqa: E501", "Copyright (c) 2020", "x = f(y)\ny = 2", "Reads it.")] == ["empty", "directive", "license", "code", None]
    assert len(one(spark, features.safe_path(F.col("t")), t="a" * 300)) < 130 and one(spark, features.safe_path(F.col("t")), t="a?b") == "a_b"


def test_patches(spark):
    patch = "--- a/f.py\n+++ b/f.py\n@@ -3,0 +4,2 @@\n+++ looks like a header\n+x\n@@ -9 +12 @@\n-a\n+b\n--- /dev/null\n+++ b/g.py\n@@ -0,0 +1,3 @@\n+a\n+b\n+c\n--- a/h.py\n+++ b/h.py\n@@ -1,2 +0,0 @@\n-a\n-b\n--- a/i.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"
    got = {r.file: r.added_ranges for r in extraction.patch_ranges(spark.createDataFrame([("r", "s", patch), ("r", "t", None)], "repo string, sha string, patch string")).collect()}
    assert got == {"f.py": [[4, 5], [12, 12]], "g.py": [[1, 3]], "h.py": []}


def test_added_lines_of_small_files(spark):
    files = spark.createDataFrame([("r", "s", str(k), "# a\nx = 1\n\ny = 2  # b\n") for k in range(3)] + [("r", "s", "e", "")], "repo string, sha string, file string, content string")
    ranges = [("0", [[1, 9]]), ("1", [[2, 3]]), ("2", None), ("e", None)]
    manifest = spark.createDataFrame([("r", "s", f, g, "ai", "2020-01-01") for f, g in ranges], "repo string, sha string, file string, added_ranges array<array<int>>, source string, ingested_at string")
    assert {r.file: (r.added_lines, r.added_nonblank) for r in extraction.added_lines(files, manifest).collect()} == {"0": (4, 3), "1": (2, 1), "2": (4, 3), "e": (0, 0)}


def test_tails():
    assert abs(tails.normal_tail(1.959963984540054) - 0.025) < 1e-12
    assert all(abs(tails.chi2_tail(x, k) - 0.05) < 1e-7 for x, k in ((3.8414588, 1), (5.9914645, 2), (18.3070381, 10)))
    assert abs(tails.fisher(3, 1, 1, 3) - 0.4857142857) < 1e-9 and abs(tails.fisher(1, 9, 11, 3) - 0.002759) < 1e-6 and tails.fisher(0, 0, 0, 0) == 1.0
    assert abs(tails.fisher(40_000, 60_000, 40_000, 60_000) - 1) < 1e-9


def test_correction_bootstrap_and_agreement(spark):
    q = [r.q for r in comparison.corrected(spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.03, 0.5)], "p double")).orderBy("p").collect()]
    assert [round(x, 6) for x in q] == [0.004, 0.04, 0.04, 0.5]
    sides = spark.createDataFrame([("ai", f"r{k}", 8, 10) for k in range(20)] + [("human", f"r{k}", 2, 10) for k in range(20)], "side string, cluster string, num int, den int")
    r = comparison.bootstrap(sides).head()
    assert (r.estimate, r.low, r.high) == (0.6, 0.6, 0.6)
    assert comparison.bootstrap(sides, ratio=True).head().estimate == 4.0
    r = comparison.bootstrap(sides.where("cluster = 'r1'")).head()
    assert r.estimate == 0.6 and r.low is None
    assert comparison.bootstrap(sides.limit(0)).head().estimate is None
    labels = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert comparison.kappa(labels([(1, 1), (1, 0), (0, 0), (0, 0)]), "a", "b").head().kappa == 0.5
    assert comparison.kappa(labels([(1, 1)]), "a", "b").head().kappa == 1.0 and comparison.kappa(labels([(1, None)]), "a", "b").head().kappa is None


def test_commits_and_windows(spark):
    rows = [("a", "2020-01-01", "x\nMade-with: Alpha"), ("b", "2020-01-01", "made-with: beta and made-with: ALPHA"), ("c", "2020-01-01", "plain"), ("d", "2021-01-01", None), ("e", "2020-01-01", None), ("f", "2020-01-01", "alpha-ish")]
    commits = spark.createDataFrame(rows, "sha string, date string, message string")
    tools = {"alpha": "made-with: alpha", "beta": "made-with: beta"}
    sure = sampling.commits_with(commits, tools)
    assert {r.sha: (r.tool, r.tools) for r in sure.collect()} == {"a": ("alpha", ["alpha"]), "b": ("alpha", ["alpha", "beta"])}
    assert {r.sha for r in sampling.commits_without(commits, tools, "2020-11-01").collect()} == {"c", "e", "f"}
    assert {r.sha for r in sampling.suspects(commits, ["alpha"], sure).collect()} == {"f"}
    spans = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS start, timestamp'2024-01-03 00:00:00' AS end")
    w = sampling.time_windows(spans, 6).orderBy("start").collect()
    assert len(w) == 8 and all((b.start - a.end).total_seconds() == 1 for a, b in zip(w, w[1:]))


def test_files_of_the_pipeline(spark, tmp_path):
    (tmp_path / "k.csv").write_text('﻿id,source,note\n1,ai,"a ""b""\nc"\n', encoding="utf-8")
    r = sources.read_csv(spark, str(tmp_path / "k.csv"), "id string, note string, cls string").head()
    assert (r.id, r.note, r.cls) == ("1", 'a "b"\nc', None)
    (tmp_path / "w.txt").write_text("﻿the\n\n# no\n a \n", encoding="utf-8")
    assert [r.word for r in sources.read_words(spark, str(tmp_path / "w.txt")).collect()] == ["the", "a"]
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "x", 3)], "repo string, sha string, n int")
    for _ in range(2):
        folder = sources.append_new(rows, spark, str(tmp_path / "out"), "repo", "sha")
    assert folder.count() == 2
    sources.write_jsonl(rows, str(tmp_path / "j"))
    assert sources.read_jsonl(spark, str(tmp_path / "j"), "repo string, n int").count() == 3
    sources.write_csv(rows, str(tmp_path / "c"), "repo", "n")
    files = spark.createDataFrame([("a.py", b"\xef\xbb\xbfx"), ("a.py", b"\xff"), ("vendor/a.py", b"x"), ("a.txt", b"x"), ("b.go", b"x" * 20)], "file string, content binary")
    assert [(r.file, r.content) for r in sources.usable(files, features.SKIP_PATHS, 10).collect()] == [("a.py", "x")]
