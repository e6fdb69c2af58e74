"""The operators against brute force on small tables; nulls, empty and long texts, ties, repeated rows, clashing names."""

import random
from array import array
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glosswork.llm import classes, embedded, formatdup, handwritten, lang, leaks, mixing, queries, sampling, sentences

COMMENTS = "comment_id long, repo string, text string, text_lang string, exclude string, code string, lang string, key string, bucket string"


def comments(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], COMMENTS)


@pytest.fixture(scope="module")
def model(spark, data):
    return lang.fitted(spark.read.parquet(data + "/comments.parquet"))


# p1


def test_labels():
    assert [lang.label(x) for x in ("EN", "en-US", "zho", "German", " fr ", "pt_BR", "nl")] == ["en", "en", "zh", "de", "fr", "pt", "nl"]
    assert [lang.label(x) for x in (None, "", " ", "und", "Unknown")] == [None] * 5


def test_stretches_of_comments(spark, model):
    en, ru, zh = "This is the buffer that every caller reads before the lock is released.", "Если флаг не установлен, этот класс не может прочитать каждый файл.", "这个函数在提交期间不能修改索引。"
    rows = [
        (1, "r", en, None), (2, "r", en, "en-GB"), (3, "r", en, "ru"), (4, "r", f"{en} {ru}", "mul"), (5, "r", f"{ru}\n{en}\n{ru}", "ru"), (6, "r", zh, "ja"),
        (7, "r", None, None), (8, "r", "", None), (9, "r", en, None, "directive"), (10, "r", "x = f(y);", None), (None, "r", en, None), (3, "r", en, "ru"),
        (11, "r", en + " " + " ".join([en] * 3000), None), (12, "r", "get_user_name 42 http://a.b/c", None),
    ]
    found = lang.languages(comments(spark, rows), model)
    got = sorted((r.comment_id, r.seg_no, r.lang) for r in found.where("mended").collect())
    assert got == [(1, 0, "en"), (3, 0, "en"), (3, 0, "en"), (4, 0, "en"), (4, 1, "ru"), (5, 0, "ru"), (5, 1, "en"), (5, 2, "ru"), (6, 0, "zh"), (11, 0, "en")]
    assert found.where("confidence < 0.5 OR confidence > 1").count() == 0
    assert found.where("comment_id = 2").select("mended").collect()[0][0] is False
    assert lang.languages(comments(spark, []), model).count() == 0
    assert lang.languages(comments(spark, [])).count() == 0  # nothing to fit on


def test_right_labels_are_found_again(spark, data, model):
    """Held-out agreement: labels that are not missing are mostly right, so that most one-language comments agree."""
    found = lang.languages(spark.read.parquet(data + "/comments.parquet"), model).where("label IS NOT NULL")
    same, every = found.agg(F.count_if(F.col("lang") == F.col("label")), F.count("*")).head()
    assert same > 0.85 * every


# p2


def test_kinds_of_files(spark):
    def getters(name):
        return f"# {name}\n" + "".join(f"def get_{name}{k:03}(self_):\n    return self_._slots[{k}]\n" for k in range(60))

    hand = 'def load(path, limit):\n    """Reads the rows."""\n    with open(path) as f:\n        for line in f:\n            if line.strip() and limit > 0:\n                yield line.split(",")\n                limit -= 1\n\n\nBANNER = "Code generated. DO NOT EDIT."\n'
    table = "rows = [\n" + "".join("    " + ", ".join(str(k * j % 251) for j in range(12)) + ",\n" for k in range(40)) + "]\n"
    packed = "".join(f"for(var v=0;v<{k};v++)u[v]=i(v);var h{k}=function(w){{return w+{k}}};" for k in range(20))
    rows = [
        (1, "a/a", "s", "src/one.py", "python", getters("alpha")), (2, "a/a", "s", "src/two.py", "python", getters("beta")), (3, "a/a", "s", "src/hand.py", "python", hand),
        (4, "b/b", "s", "lib/data.py", "python", table), (5, "b/b", "s", "static/x.js", "javascript", packed), (6, "b/b", "s", "vendor/libx/a.py", "python", hand.replace("limit", "most")), (11, "c/c", "s", "pkg/third_party/libx-1.2/b.py", "python", "def only(a):\n    return a\n"), (12, "d/libx", "s", "vendor/libx/a.py", "python", "import this\n"), (13, "d/d", "s", "vendor_portal/liby/a.py", "python", "import that\n"),
        (7, "b/b", "s", "x.py", "python", ""), (8, None, None, None, None, "\n"), (9, "b/b", "s", "y.py", "python", None), (None, "b/b", "s", "z.py", "python", hand),
    ]
    files = spark.createDataFrame(rows, "file_id long, repo string, sha string, file string, lang string, content string").withColumn("cluster", F.lit("x"))
    got = {r.file_id: r.kind for r in handwritten.classified(files).collect()}
    assert got == {1: "generated", 2: "generated", 3: None, 4: "blob", 5: "minified", 6: "vendored", 7: None, 8: None, 11: "vendored", 12: None, 13: None}
    assert handwritten.classified(files.where("file_id < 0")).count() == 0


def test_kinds_by_ratio_and_family(spark):
    rng = random.Random(3)
    shapes = ["".join(rng.choice(["a(b)", "a[b]", "a.b", "a + b", "a * (b - c)", "a < b"]) + rng.choice([", ", "; ", " | "]) for _ in range(6)) + "\n" for _ in range(14)]
    long = "".join(s for _ in range(60) for s in shapes)
    table = "rows = [\n" + "".join(f"  [{k}, [{k}, '{k}'], {{{k}: '{k}'}}, ({k}, -{k}), f({k}), {k} * {k}, not {k}, {k} + {k}, x[{k}], y.z, {k} / {k}, {k} % {k}, {k} < {k}],\n" for k in range(200)) + "]\n"
    rows = [(1, "a/a", long), (2, "a/a", table), *((10 + k, "b/b", f"n_{k} = " + " ".join(f"'{k * j:x}'" for j in range(9 + k // 3)) + "\n") for k in range(6)), (20, "c/c", "x = f(a)\n")]
    files = spark.createDataFrame([(i, r, "s", f"src/{i}.py", "python", c) for i, r, c in rows], "file_id long, repo string, sha string, file string, lang string, content string")
    got = {r.file_id: r.kind for r in handwritten.classified(files).collect()}
    assert got == {1: "generated", 2: "blob", **{10 + k: "blob" for k in range(6)}, 20: None}


def test_copies_over_repositories(spark):
    def code(name, n):
        return "".join(f"def {name}{k}(rows, limit):\n    if limit > {k}:\n        return rows[{k}] + {name}_base\n    return {name}{k + 1}(rows)\n\n\n" for k in range(n))

    foreign = "import os\n" + code("pack", 6)
    rows = [
        (1, "a/a", "lib/x.py", foreign), (2, "b/b", "src/y.py", "# own notes\n" + foreign), (3, "c/c", "tools/z.py", foreign + "print(os)\n"),
        (4, "a/a", "src/u.py", code("first", 6)), (5, "b/b", "src/v.py", code("second", 6)),
        (6, "d/d", "core/w.py", code("own", 6)), (7, "e/e", "vendor/own/w.py", code("own", 6)), (8, "d/d", "core/w.py", code("own", 6)),
        (9, "a/a", "m.py", "main()\n"), (10, "b/b", "m.py", "main()\n"),
    ]
    files = spark.createDataFrame([(i, r, "s", f, "python", c) for i, r, f, c in rows], "file_id long, repo string, sha string, file string, lang string, content string")
    got = {r.file_id: r.kind for r in handwritten.classified(files).collect()}
    assert {i for i, k in got.items() if k == "vendored"} == {1, 2, 3, 7}


def test_components_of_a_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "file_id")
    edges = nodes.where("file_id % 10 < 9").select("file_id", (F.col("file_id") + 1).alias("other"))
    got = classes.components(edges.union(edges), "file_id", "other", "cluster").collect()
    assert {r.file_id: r.cluster for r in got} == {i: i // 10 * 10 for i in range(40)} and len(got) == 40
    assert classes.components(edges.limit(0), "file_id", "other", "cluster").count() == 0


@pytest.mark.parametrize("whole", [None, 10])
def test_components_of_few_links_meet_in_one_task(spark, monkeypatch, whole):
    if whole:
        monkeypatch.setattr(classes, "WHOLE", whole)
    edges = spark.range(0, 400, numPartitions=4).where("id % 50 < 49").select((F.col("id") * 7 % 400).alias("a"), ((F.col("id") + 1) * 7 % 400).alias("b"))
    spark.sparkContext.setJobGroup(f"components {whole}", "")
    got = {r.a: r.c for r in classes.components(edges, "a", "b", "c").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {whole}")
    spark.sparkContext.setJobGroup("", "")
    lowest = [min(j * 7 % 400 for j in range(i, i + 50)) for i in range(0, 400, 50)]
    assert got == {i * 7 % 400: lowest[i // 50] for i in range(400)}
    assert (len(jobs) < 10) == (whole is None), jobs


def test_links_of_units_against_all_pairs(spark, data):
    """Of the pairs of similarity 0.8 or more between the units that are divisible by 100 and all units, nine in ten or more share a class; none below is linked."""
    rows = handwritten.profiles(spark.read.parquet(data.replace("0.001", "0.01") + "/source_files.parquet")).where("view = 0 AND n > 0")
    shapes = rows.groupBy("unit").agg(F.min("codes").alias("codes"))
    sets = {r.unit: handwritten.shingles(bytes(r.codes)) for r in shapes.collect()}
    found = handwritten.links(shapes)
    links = [(r.unit, r.other) for r in found.collect()]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in links)
    label = {r.unit: r.cluster for r in classes.components(found, "unit", "other", "cluster").collect()}
    pairs = [(a, b) for a in sets if a % 100 < 10 for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    print(len(pairs))
    assert len(pairs) > 20 and sum(label.get(a, a) == label.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)


def test_hot_buckets_are_led_in_parts(spark, monkeypatch):
    monkeypatch.setattr(handwritten, "PART", 4)
    monkeypatch.setattr(handwritten, "COARSE", 64)
    codes = [array("H", [*range(k, k + 60), *range(1000, 1400)]).tobytes() for k in range(30)]
    shapes = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "unit long, codes binary")
    label = {r.unit: r.cluster for r in classes.components(handwritten.links(shapes), "unit", "other", "cluster").collect()}
    assert label == {k: 0 for k in range(30)}


@pytest.mark.parametrize("limits", [{}, {"FEW": 3, "CHUNK": 50, "HELD": 8}, {"LARGE": 20}, {"PART": 20, "COARSE": 4}])
def test_no_pair_is_left_out(spark, monkeypatch, limits):
    """Every pair of similarity 0.8 or more shares a class, also through units that are alike by a hair; none below is linked."""
    for name, value in limits.items():
        monkeypatch.setattr(handwritten, name, value)
    rng = random.Random(5)
    units = set()
    for _ in range(60):
        unit = [rng.randrange(1, 60) for _ in range(rng.randrange(4, 70))]
        for _ in range(6):
            units.add(array("H", unit).tobytes())
            for _ in range(rng.randrange(1, 3)):
                at = rng.choice([0, len(unit) - 1, rng.randrange(len(unit))])
                unit = unit[:at] + rng.choice([[rng.randrange(1, 60)], [], [unit[at], rng.randrange(1, 60)]]) + unit[at + 1 :] or [1]
    units = sorted(units)
    sets = [handwritten.shingles(c) for c in units]
    want = {(a, b) for b in range(len(units)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    found = handwritten.links(spark.createDataFrame(list(enumerate(units)), "unit long, codes binary"))
    assert {(min(r), max(r)) for r in found.collect()} <= want
    label = {r.unit: r.cluster for r in classes.components(found, "unit", "other", "cluster").collect()}
    assert len(want) > 150 and [(a, b) for a, b in want if label.get(a, a) != label.get(b, b)] == []


@pytest.mark.parametrize("limits", [{}, {"PIECE": 50, "CHUNK": 70, "FEW": 3}])
def test_gathered_units_are_not_linked_again_in_each_bucket(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(handwritten, name, value)
    codes = [array("H", [*range(1000 * f, 1000 * f + 30), 7 + k, *range(1000 * f + 500, 1000 * f + 530)]).tobytes() for f in range(1, 5) for k in range(100)]
    shapes = spark.createDataFrame([(k, c) for k, c in enumerate(codes)] * 2, "unit long, codes binary")
    met = handwritten.gathered(shapes).collect()
    assert sorted(r.unit for r in met if r.codes) == list(range(400)) and all(r.near // 100 == r.unit // 100 for r in met)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task has all buckets
    found = handwritten.links(shapes.distinct())
    some = found.count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert some < 1000
    label = {r.unit: r.cluster for r in classes.components(found, "unit", "other", "cluster").collect()}
    assert label == {k: k // 100 * 100 for k in range(400)}


def test_nothing_is_found_without_clusters(spark, monkeypatch, data):
    files = spark.read.parquet(data + "/source_files.parquet")
    assert handwritten.classified(files).where("kind IS NOT NULL").count() > 0
    single = handwritten.profiles(files.where("file_id = -1"))
    monkeypatch.setattr(handwritten, "profiles", lambda f: single)
    assert handwritten.classified(files).where("kind IS NOT NULL").count() == 0


# p4


def test_allocation_and_draw(spark):
    rng = random.Random(3)
    rows = [(f"i{k}", rng.choice(["ai", "human"]), rng.choice(["Go", " go", "c"]), rng.choice([None, 0.1, 0.25, 0.5])) for k in range(400)]
    rows += rows[:30] + [(None, "ai", "go", 0.1)]
    targets = [(s, l, b, 1 / 16, 2) for s in ("ai", "human") for l in ("go", "c") for b in ("none", "low", "mid", "high")]
    targets[0] = (*targets[0][:3], 0.9, 2)
    pool = spark.createDataFrame(rows, "id string, source string, lang string, overlap double")
    goal = spark.createDataFrame(targets, "source string, lang string, band string, target_share double, min_rows int")
    have = defaultdict(set)
    for i, s, l, o in rows:
        if i:
            have[s, l.strip().lower(), "none" if o is None else "low" if o < 0.25 else "mid" if o < 0.5 else "high"].add(i)
    got = {(r.source, r.lang, r.band): r for r in sampling.allocate(pool, goal).collect()}
    for s, l, b, share, least in targets:
        r = got[s, l, b]
        assert (r.available, r.need) == (len(have[s, l, b]), max(least, int(share * 80 + 0.5)))
        assert r.short == max(0, r.need - r.available)
        assert r.allocated <= r.available
    assert sum(r.allocated for r in got.values()) == sum(r.need for r in got.values())
    drawn = sampling.draw(pool, goal).collect()
    assert len({r.id for r in drawn}) == len(drawn) == sum(r.allocated for r in got.values())
    assert all(r.id in have[r.source, r.lang, r.band] for r in drawn)
    empty = sampling.allocate(pool.where("id = ''"), goal).collect()
    assert all((r.need, r.available, r.short) == (2, 0, 2) for r in empty)


# p5


def canonical(text):
    def letters(t):
        return "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LN")

    if re.search(r"(?:^|[\s;])(?:@[\w.-]+\s+\S|[\w.-]+=\S)", text):
        return "\1".join(sorted(p for p in map(letters, re.split(r"\r\n|[\n\r]|;|(?=@)", text)) if p))
    return letters(text)


@pytest.mark.parametrize("cap", [50_000, 20])
def test_format_copies(spark, cap):
    rng = random.Random(5)
    texts = ["Read the file.", "read  the FILE", "readthefile!", "@param x the name\n@return it", "@return it @param x the name", "a=1; b=2", "b=2;a=1", "Überprüft ÉTAT", "überprüft, état", "!!!", "", "这个函数", "这个 函数。", "x" * 70_000, "X " * 70_000]
    rows = [(k, rng.choice(["r1", "r1", "r2"]), rng.choice(texts)) for k in range(1, 300)] + [(k, "r1", "Read the file") for k in range(300, 500)] + [(500, "r1", None), (501, None, "a"), (None, "r1", "a b")]
    sets = defaultdict(list)
    for i, repo, text in rows:
        if i and repo and text and canonical(text):
            sets[repo, canonical(text)].append(i)
    want = sorted((min(v), i) for v in sets.values() for i in v if i != min(v))
    df = comments(spark, rows)
    _, members = formatdup.copies(df, cap=cap)
    assert sorted((r.keep_id, r.copy_id) for r in members.collect()) == want
    if cap == 20:
        assert sorted((r.keep_id, r.n) for r in formatdup.collapse(df).collect()) == sorted((min(v), len(v)) for v in sets.values())
    assert formatdup.copies(comments(spark, []), cap=cap)[1].count() == 0


def test_trie_counts_every_key():
    rng = random.Random(7)
    trie, want = formatdup.Trie(), defaultdict(lambda: [0, 10**9])
    for k in range(20_000):
        key = b"repo\0" + bytes(rng.choices(b"ab", k=rng.randint(0, 20)))
        trie.add(key, 1, k)
        want[key] = [want[key][0] + 1, min(want[key][1], k)]
    assert {k: [n, i] for k, n, i in trie.items()} == want and trie.size == len(want)


# p6


def test_literals():
    assert list(embedded.literals('x = "a \\"b\\"" # "no"\ny = \'\'\'long\none\'\'\'', "python")) == ['a "b"', "long\none"]
    assert list(embedded.literals("char c = 'x'; puts(\"\\u00e9t\\xe9\"); // \"no\"", "c")) == ["été"]
    assert list(embedded.literals('log("cut off', "go")) == ["cut off"]


def test_prose_of_comments_and_literals(spark, model):
    en, ru = "This is the buffer that every caller reads before the lock is released", "Если флаг не установлен, этот класс не может прочитать каждый файл"
    rows = [
        (1, "r", en, "en", None, f'log("{ru}")', "java"), (2, "r", None, None, None, f"x = '{en}'", "python"), (3, "r", en, "en", "license", None, None),
        (4, "r", "", None, None, 'q("SELECT a, b FROM the_table WHERE id = 1 ORDER BY a")', "java"), (5, "r", en, None, "code", 'p("/var/lib/the/file.txt")', "go"), (None, "r", en, None),
    ]
    found = embedded.embedded(comments(spark, rows), model)
    assert sorted((r.comment_id, r.place, r.lang) for r in found.collect()) == [(1, "literal", "ru"), (1, "text", "en"), (2, "literal", "en"), (3, "text", "en")]
    assert embedded.embedded(comments(spark, []), model).count() == 0


# p7


def brute_leaks(docs, items, n=13):
    def words(t):
        return [w for w in ("".join(c for c in x.lower() if c.isalnum()) for x in t.split()) if w]

    grams = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in items if t for w in [words(t)]}
    out = set()
    for d, t in docs:
        w = words(t or "")
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, g in grams.items() if g & own}
    return out


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_leaks(spark, most):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30])))) for k in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(200):
        w = rng.choices(vocabulary, k=rng.choice([0, 10, 40, 80]))
        if d % 3 == 0:
            part = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(part))
            w[len(w) // 2 : len(w) // 2] = part[a : a + rng.choice([12, 13, 20])]
        docs.append((d, " ".join(x.upper() + "," if rng.random() < 0.3 else x for x in w)))
    docs += [(200, None), (201, ""), (0, docs[0][1]), (202, " ".join(rng.choices(vocabulary, k=60_000)) + " " + items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    ev = spark.createDataFrame(items, "item_id long, text string")
    hits = leaks.leaks(df, ev, most=most)
    assert {(r.id, r.item_id) for r in hits.collect()} == brute_leaks(docs, items)
    kept = {r.doc_id: r for r in leaks.without_leaks(df, hits).collect()}
    assert all(brute_leaks([(r.doc_id, r.text)], items) <= set() or r.removed_chars for r in kept.values())
    assert leaks.leaks(df.where("doc_id < 0"), ev, most=most).count() == leaks.leaks(df, ev.where("item_id < 0"), most=most).count() == 0


# p8


@pytest.mark.parametrize("block", [4096, 64])
def test_mix_reaches_its_shares(spark, block):
    rng = random.Random(2)
    docs = [(k, "big" if k < 700 else "small" if k < 730 else "other", " ".join(["word"] * rng.randint(20, 80))) for k in range(1000)] + [(1000, "big", None), (None, "big", "a"), (1001, "big", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit("x"))
    goal = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    try:
        plan, report = mixing.mix(df, goal, block=block)
    except FileNotFoundError:
        pytest.skip("no tokenizer files")
    rows = {r.source: r for r in report.collect()}
    assert (rows["big"].short, rows["small"].short, rows["absent"].short) == (False, True, True)
    assert abs(rows["big"].reached - rows["big"].target) <= 0.01 * rows["big"].target
    assert rows["small"].reached == rows["small"].most and rows["absent"].reached == 0
    assert all(r.copies <= (2 if r.source == "big" else 3) for r in plan.collect())
    assert mixing.expand(plan).count() == plan.agg(F.sum("copies")).head()[0]
    assert mixing.mix(df.where("doc_id < 0"), goal)[1].where("reached > 0").count() == 0


# p9


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Dr. Low saw 3.5 rows. It failed!", ["Dr. Low saw 3.5 rows.", "It failed!"]),
        ('He said "no." Then it ran.', ['He said "no."', "Then it ran."]),
        ('"Is it safe?" asked the reviewer. Yes.', ['"Is it safe?" asked the reviewer.', "Yes."]),
        ("# A heading\n\nOne sentence wrapped\nover lines. Two.\n\n* first entry\n* second entry", ["A heading", "One sentence wrapped\nover lines.", "Two.", "first entry", "second entry"]),
        ("这个函数返回索引。它很快！", ["这个函数返回索引。", "它很快！"]),
        ("यह फ़ाइल है। यह सूची है।", ["यह फ़ाइल है।", "यह सूची है।"]),
        ("Der Wert sank am 3. Mai z. B. um 0,5. Gut.", ["Der Wert sank am 3. Mai z. B. um 0,5.", "Gut."]),
        ("هل هو آمن؟ نعم.", ["هل هو آمن؟", "نعم."]),
    ],
)
def test_sentences(spark, text, units):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [text[r.start_char : r.end_char] for r in sentences.sentences(docs).orderBy("start_char").collect()] == units


@pytest.mark.parametrize("n", [10, 119, 400])
def test_long_quotation_after_a_colon(n):
    text = "他说：“" + "很" * n + "。”这个函数返回索引。"
    assert [text[a:b] for a, b in sentences.units(text)] == ["他说：“" + "很" * n + "。”", "这个函数返回索引。"]


def test_sentences_of_all_documents(spark, data):
    docs = spark.read.parquet(data + "/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ends = defaultdict(int)
    for r in sentences.sentences(docs).orderBy("doc_id", "start_char").collect():
        unit = texts[r.doc_id][r.start_char : r.end_char]
        assert unit and unit == unit.strip() and r.start_char >= ends[r.doc_id]
        ends[r.doc_id] = r.end_char
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "A."), (4, "One two. " * 20_000)], "doc_id long, text string").withColumn("start_char", F.lit("x"))
    assert {r.doc_id: r["count"] for r in sentences.sentences(odd).groupBy("doc_id").count().collect()} == {4: 20_000}
    assert sentences.sentences(odd.where("doc_id < 0")).count() == 0


def test_found_columns(spark, data):
    want = {
        "p1_found": "comment_id bigint,seg_no int,lang string", "p2_found": "file_id bigint", "p3_found": "file_id bigint", "p4_found": "source string,lang string,band string", "p5_found": "keep_id bigint,copy_id bigint",
        "p6_found": "comment_id bigint,place string,lang string", "p7_found": "doc_id bigint,item_id bigint", "p8_found": "source string", "p9_found": "doc_id bigint,start_char int,end_char int",
    }
    for name, columns in want.items():
        assert ",".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, data).dtypes) == columns, name


# More of p1, p4, p5, p6, p9


def test_unknown_languages_are_und(spark, model):
    rows = [(1, "r", "Deze functie leest het bestand voordat de buffer wordt vrijgegeven, zodat niemand hoeft te wachten.", None), (2, "r", "Αυτή η συνάρτηση διαβάζει το αρχείο.", None), (3, "r", "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺ", None), (4, "r", "zzkx qqwv", None)]
    got = {r.comment_id: (r.lang, r.confidence) for r in lang.languages(comments(spark, rows), model).collect()}
    assert got[1][0] == "und" and got[1][1] < 0.5 and got[2][0] == "el" and got[3][0] == "und" and got[4] == ("und", 0.1)


def test_draw_takes_null_categories(spark):
    pool = spark.createDataFrame([(f"i{k}", None, "go", None) for k in range(20)], "id string, source string, lang string, overlap double")
    goal = spark.createDataFrame([(None, "go", "none", 1.0, 2), (None, "c", "none", 0.0, 3)], "source string, lang string, band string, target_share double, min_rows int")
    assert sampling.draw(pool, goal).count() == 7
    assert {r.lang: (r.short, r.unmet) for r in sampling.allocate(pool.limit(3), goal).collect()} == {"go": (0, 0), "c": (3, 2)}


def test_collapse_counts_every_set(spark):
    rows = [(k, "r", f"Text {k % 7}!", None, None) for k in range(40)] + [(90, "q", "text 1", None, None), (91, None, "text", None, None), (92, "r", "...", None, None)]
    df = comments(spark, rows)
    for cap in (1, 3, 50_000):
        got = {r.keep_id: r.n for r in formatdup.collapse(df, cap=cap).collect()}
        assert got == {**{k: len(range(k, 40, 7)) for k in range(7)}, 90: 1}
        assert formatdup.copies(df, cap=cap)[1].count() == 33


def test_shares_of_files(spark, model):
    code = 'x = "This message tells the caller that the file is missing."\ny = x\n'
    files = spark.createDataFrame([("r", "s", "f.py", "python", code), ("r", "s", "g.py", "python", "")], "repo string, sha string, file string, lang string, content string")
    rows = [(i, "a", "r", "s", "f.py", "inline", "This is the buffer that every caller reads.", "en", None, "python", day) for i, day in ((1, "2020"), (2, "2021"))]
    df = spark.createDataFrame(rows, "comment_id long, id string, repo string, sha string, file string, kind string, text string, text_lang string, exclude string, lang string, ingested_at string")
    got = {(r.place, r.lang): (r.bytes, r.share) for r in embedded.shares(df, files, model).collect()}
    assert set(got) == {("text", "en"), ("literal", "en")}
    n, share = got["literal", "en"]
    assert 50 < n < len(code) and share == round(n / len(code), 6)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Սա առաջինն է։ Սա երկրորդն է։", 2), ("ይህ ነው። ያ ነው።", 2), ("នេះ។ នោះ។", 2), ("ဒါ။ ဟို။", 2), ("བོད། སྐད།", 2), ("This looks ok. Then it ran.", 2), ("Ich sah es. Dann kam er.", 2),
        ("Choose option d. Then run it.", 2), ("Vgl. Abb. 3 und die Tabelle.", 1), ("Das gilt z.B. für alle, die am 3. März da sind. Ende.", 2), ("Use a shorter name, e.g. this one.", 1), ("He came at 3.5 p.m. to see it. Fine!", 2),
        ("यह पहला है। यह दूसरा है।", 2), ("这是第一句。这是第二句。", 2), ("هل هذا صحيح؟ نعم.", 2),
    ],
)
def test_sentence_counts(text, want):
    assert len(sentences.units(text)) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pool", "comments", "sample_targets", "documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))
