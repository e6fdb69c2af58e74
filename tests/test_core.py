import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators import aggregates, pool, stats
from glosswork.plans import registry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,words", [("getUserName", ["get", "user", "name"]), ("HTTPServer_v2", ["http", "server", "v2"]), ("x + 1", []), ("", []), (None, None)])
def test_identifier_words(spark, text, words):
    assert one(spark, text, T.identifier_words) == words


@pytest.mark.parametrize("text,yes", [
    ("Return the list of users that match the given name", True), ("Возвращает список пользователей", False), ("返回用户列表", False),
    ("Retourne la liste des utilisateurs pour cette page du site", False), ("", False), (None, False),
])
def test_is_english(spark, text, yes):
    assert one(spark, text, T.is_english) is yes


@pytest.mark.parametrize("text,code,value", [
    ("user list name", "def get_users(user): return user_list", 2 / 3), ("two words", "x", None), ("one two three", None, None), ("alpha beta gamma", "{", None),
])
def test_overlap(spark, text, code, value):
    got = spark.createDataFrame([(text, code)], "t string, c string").select(T.overlap(F.col("t"), F.col("c"))).first()[0]
    assert got == (value if value is None else pytest.approx(value))


def test_bins(spark):
    rows = spark.range(101).select("id", T.bin100(F.col("id") / 100).alias("b")).collect()
    assert all(r.b == min(r.id, 99) for r in rows)


def test_merged_ranges(spark):
    rows = spark.createDataFrame([([[5, 7], [1, 2], [3, 3], [10, 12], [11, 11]],), ([],), (None,)], "r array<array<int>>")
    assert [r[0] for r in rows.select(pool.merged(F.col("r"))).collect()] == [[[1, 3], [5, 7], [10, 12]], [], None]


def test_fates(spark):
    rows = [(1, "ai", "r", "py", "doc", None, "Return it"), (2, "ai", "r", "py", "inline", None, "return  it!"), (3, None, None, None, None, None, None), (4, "ai", "r", "py", "doc", "license", "x"), (5, "ai", "s", "py", "doc", None, "Return it")]
    got = pool.fates(spark.createDataFrame(rows, "comment_id long, source string, repo string, lang string, kind string, exclude string, text string"))
    assert {r.comment_id: r.fate for r in got.collect()} == {1: "kept", 2: "duplicate", 3: "non_english", 4: "excluded_license", 5: "kept"}


def test_rank_test(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(1, 6)] + [("b", float(x)) for x in range(6, 11)] + [("b", None)], "g string, v double")
    r = stats.mann_whitney(rows, "v", "g", "a", "b").first()
    assert (r.n1, r.n2, r.u, r.delta) == (5, 5, 0.0, -1.0)
    assert stats.mann_whitney(rows.limit(0), "v", "g", "a", "b").first().u is None


def test_chi2(spark):
    rows = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40 + [(None, "x")], "a string, b string")
    r = stats.chi2(rows, "a", "b").first()
    assert (r.n, r.df) == (100, 1) and r.chi2 == pytest.approx(0.79365, abs=1e-5)


def test_log_odds(spark):
    rows = [("a", "ensure", 60), ("b", "ensure", 10), ("a", "the", 1000), ("b", "the", 1000), ("b", "hack", 60), ("a", "hack", 10)]
    z = {r.word: r.z for r in stats.log_odds(spark.createDataFrame(rows, "source string, word string, k long"), "a", "b").collect()}
    assert z["ensure"] > 2 and z["hack"] < -2 and abs(z["the"]) < 0.5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "source string, overlap double, cue boolean, cls string")
    assert aggregates.function_mix(empty, "source").count() == aggregates.histogram(empty).count() == aggregates.sensitivity(empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), con.sql(registry.SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns

    def rows(df):
        return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(ours) == rows(theirs)
