import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import snapping, integrity, jobs, reports, rules, sequences, spatial


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_numbers_keep_a_sentence_dot_unless_fixed(spark):
    said = F.lit("In 2021. it was 1,195,773 of 12.5")
    assert one(spark, fx.numbers(said)) == ["2021.", "1195773", "12.5"]
    assert one(spark, fx.numbers(said, fixed=True)) == ["2021", "1195773", "12.5"]
    assert one(spark, fx.gold_hit(F.lit("none"), said)) is None and one(spark, fx.gold_hit(F.lit("2021"), said)) is False


def test_text_helpers(spark):
    assert one(spark, fx.urls(F.lit("(https://a.b/c) and http://x.y]"))) == ["https://a.b/c", "http://x.y"]
    assert one(spark, fx.slug(F.lit("  Name of Ward (2) "))) == "name_of_ward_2" and one(spark, fx.slug(F.lit("--"))) == "field"
    assert one(spark, fx.clean_label(F.lit("<b>How many</b> ${x}? "))) == "How many"
    assert one(spark, fx.initials(F.array(F.lit("male"), F.lit("female")))) == ["M", "F"]
    assert one(spark, fx.initials(F.array(F.lit("male"), F.lit("many")))) == ["male", "many"]
    assert [one(spark, fx.clamp(F.lit(x), 4, 30, 12)) for x in ("2", "7", "99", "x")] == [4, 7, 30, 12]
    assert one(spark, fx.json_object(F.lit('so: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}' and one(spark, fx.json_object(F.lit("none"))) is None
    fields = one(spark, fx.csv_fields(F.lit('\n```a,"b,""c""",\nx'), 3))
    assert list(fields["values"]) == ["a", 'b,"c"', ""] and fields["shape_ok"]
    assert one(spark, fx.inline_markdown(F.lit("**a** `<b>` [c](d)"))) == '<strong>a</strong> <code>&lt;b&gt;</code> <a href="d">c</a>'
    assert one(spark, F.lit("Which ward do you mean?").rlike(fx.ASK_BACK)) and one(spark, F.lit("it could not find it").rlike(fx.NO_DATA))


def test_snap_needs_a_clear_winner(spark):
    df = spark.createDataFrame([("Harboor",), ("harb",), ("abc",), ("Riverside",), (None,), ("paral",)], "v string")
    options = spark.createDataFrame([(o,) for o in ["Harbour", "Riverside", "parallel a", "paralx", "paraly", None]], "o string")
    got = {r.v: r.snapped for r in snapping.snap(df, "v", options, "o").collect()}
    assert got == {"Harboor": "Harbour", "harb": None, "abc": None, "Riverside": "Riverside", None: None, "paral": None}
    assert snapping.snap(df.limit(0), "v", options, "o").count() == 0 and snapping.snap(df, "v", options.limit(0), "o").where("snapped is not null").count() == 0


def test_snap_matches_a_comparison_with_every_option(spark):
    import difflib

    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(120)]
    options = sorted({w for w in words[:60] if len(w) >= 4})
    texts = sorted({*words, *[w[:2] + rng.choice("abcxyz") + w[3:] for w in words], *[w + "q" for w in words]})
    want = {}
    for t in texts:
        close = difflib.get_close_matches(t, options, n=2, cutoff=0.78) if len(t) >= 4 else []
        if len(close) == 2:
            a, b = (difflib.SequenceMatcher(None, t, c).ratio() for c in close)
            close = close if a - b > 0.08 else []
        want[t] = close[0] if close else None
    rows = spark.createDataFrame([(t,) for t in texts * 2], "v string")
    found = snapping.snap(rows, "v", spark.createDataFrame([(o,) for o in options], "o string"), "o").collect()
    assert len(found) == 2 * len(texts) and {r.v: r.snapped for r in found} == want
    assert sum(v is not None for v in want.values()) > 60


def test_within_distance_matches_brute_force(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(200)] + [(200, None, 0.0), (201, 0.5, 0.5), (202, 1.0, 0.5)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    for limit in (0.25, 0.5):
        got = {r.id for r in spatial.within_distance(df, df.where("id % 9 = 3 or id = 201"), limit).collect()}
        near = [p for p in points if p[0] % 9 == 3 or p[0] == 201]
        want = {a for a, x, y in points if x is not None and any(u is not None and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= limit for _, u, v in near)}
        assert got == want


def test_farthest_pairs_match_brute_force_with_ties_and_single_points(spark):
    rng = random.Random(4)
    rows = [(g, i, float(rng.randint(-4, 4)), float(rng.randint(-4, 4))) for i, g in enumerate(rng.choices("abc", k=120))] + [("d", 500, 1.0, 1.0), ("e", 501, 0.0, 0.0), ("e", 502, 0.0, 0.0), ("e", 503, 0.0, 3.0)]
    got = {r.g: (r.id_a, r.id_b) for r in spatial.farthest_pairs(spark.createDataFrame(rows, "g string, id int, x double, y double").repartition(3), "g", "id").collect()}
    want = {}
    for g in "abcde":
        own = sorted((i, x, y) for h, i, x, y in rows if h == g)
        pairs = [(-((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), a[0], b[0]) for k, a in enumerate(own) for b in own[k + 1 :]]
        if pairs:
            want[g] = min(pairs)[1:]
    assert got == want


def test_haversine(spark):
    km = one(spark, spatial.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(13.0827), F.lit(80.2707)))
    assert km == pytest.approx(290.2, abs=0.5)


def test_sequences(spark):
    rows = [("a", i, v) for i, v in enumerate(["x", "x", None, None, "y", "x"])]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    assert [(r.v, r.n, r["first"], r["last"]) for r in sequences.islands(df, "g", ["i"], "v").orderBy("island").collect()] == [("x", 2, 0, 1), (None, 2, 2, 3), ("y", 1, 4, 4), ("x", 1, 5, 5)]
    steps = spark.createDataFrame([("a", i, s) for i, s in enumerate("ebbqeeebq")], "g string, i int, s string")
    begin, end = F.col("s") == "b", F.col("s") == "e"
    assert [r.depth for r in sequences.nesting(steps, "g", ["i"], begin, end).orderBy("i").collect()] == [0, 1, 2, 2, 1, 0, 0, 1, 1]
    assert [r.i for r in sequences.first_region(steps, "g", ["i"], begin, end).collect()] == [3]
    filled = sequences.nearest_fill(df, "g", ["i"], "v", "f").orderBy("i").collect()
    assert [r.f for r in filled] == ["x", "x", "x", "y", "y", "x"]
    keys = sequences.unique_keys(df.na.fill("x"), "v", ["i"]).orderBy("i").collect()
    assert [r.key for r in keys] == ["x", "x_", "x__", "x___", "y", "x____"]


def _events(n_groups=3, n=400):
    rng = random.Random(6)
    return [(g, i, rng.choice("abc"), rng.choice([None, None, 1.0, 2.0])) for g in range(n_groups) for i in range(n if g else 37)] + [(None, 1, "a", None), (None, 2, "b", 3.0)]


@pytest.mark.parametrize("most", [1_000_000, 20, 3])
def test_sequences_in_blocks_match_plain_walks(spark, most):
    rows = _events()
    df = spark.createDataFrame(rows, "g long, i long, v string, x double").repartition(3)
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        by.setdefault(r[0], []).append(r)
    begin, end = F.col("v") == "a", F.col("v") == "b"
    islands, depth, region, fill, keys = [], [], [], [], []
    counts = {}
    for g, own in by.items():
        deep, state, number = 0, 0, 0
        for k, (_, i, v, _) in enumerate(own):
            if k and own[k - 1][2] == v:
                islands[-1][3], islands[-1][5] = islands[-1][3] + 1, i
            else:
                number += 1
                islands.append([g, number, v, 1, i, i])
            deep = max(0, deep + (v == "a") - (v == "b"))
            depth.append((g, i, deep))
            state = 1 if v == "a" and state == 0 else 2 if v == "b" and state == 1 else state
            if state == 1 and v != "a":
                region.append((g, i))
            known = [(abs(j - k), j, r[3]) for j, r in enumerate(own) if r[3] is not None]
            fill.append((g, i, min(known)[2] if known else None))
    for g, i, v, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        keys.append((g, i, v + "_" * counts.get(v, 0)))
        counts[v] = counts.get(v, 0) + 1
    same = lambda found, want: sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert same(sequences.islands(df, "g", ["i"], "v", most), islands)
    assert same(sequences.nesting(df, "g", ["i"], begin, end, most).select("g", "i", "depth"), depth)
    assert same(sequences.first_region(df, "g", ["i"], begin, end).select("g", "i"), region)
    assert same(sequences.nearest_fill(df, "g", ["i"], "x", "f", most).select("g", "i", "f"), fill)
    assert same(sequences.unique_keys(df, "v", ["g", "i"], most=most).select("g", "i", "key"), keys)


def test_farthest_pairs_of_coinciding_and_round_groups(spark):
    import math

    rng = random.Random(9)
    rows = [("equal", i, 1.0, 2.0) for i in (5, 3, 9)] + [("one", 1, 0.0, 0.0)] + [("twice", i, float(i // 2), 0.0) for i in range(8)]
    rows += [("circle", i, math.cos(i / 50), math.sin(i / 50)) for i in range(314)] + [("cloud", i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    rows += [("square", 4 * a + b, float(a), float(b)) for a in range(4) for b in range(4)]
    got = {r.g: (r.id_a, r.id_b, r.dist) for r in spatial.farthest_pairs(spark.createDataFrame(rows, "g string, id long, x double, y double").repartition(5), "g", "id").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        pairs = [(-math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), a[1], b[1]) for a in own for b in own if a[1] < b[1]]
        if pairs:
            d, a, b = min(pairs)
            want[g] = a, b, round(-d, 6)
    assert got == want and "one" not in got


def test_edges_match_brute_force(spark):
    import math

    rng = random.Random(10)
    points = [(i, rng.uniform(50, 50.2), rng.uniform(7, 7.2)) for i in range(150)] + [(150, None, 7.0), (151, -33.0, 7.0)]
    edges = [tuple(v for _ in range(2) for v in (rng.uniform(50, 50.2), rng.uniform(7, 7.2))) for _ in range(6)] + [(50.1, 7.1, 50.1, 7.1), (None, 7.0, 50.0, 7.0)]
    found = spatial.within_km_of_edges(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(edges, "lat1 double, lon1 double, lat2 double, lon2 double"), 0.6)
    got = sorted(r.id for r in found.collect())

    def km(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(a))

    far = {}
    for i, lat, lon in points[:150]:
        far[i] = min(km((lat, lon), (a + (c - a) * t / 2000, b + (d - b) * t / 2000)) for a, b, c, d in edges[:-1] for t in range(2001))
    assert [i for i in got if far[i] > 0.601] == [] and [i for i, d in far.items() if d < 0.599 and i not in got] == [] and 10 < len(got) < 140


def test_jobs(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "form string")
    done = spark.createDataFrame([("a", None, 500), ("b", "failed", 900), ("c", None, 100)], "form string, error string, bytes int")
    names = lambda df: sorted(r.form for r in df.collect())
    assert names(jobs.remaining(todo, done, ["form"])) == []
    assert names(jobs.remaining(todo, done, ["form"], retry_errors=True)) == ["b"]
    assert names(jobs.remaining(todo, done, ["form"], min_bytes=200)) == ["c"]
    assert jobs.job_grid(todo, spark.range(2).withColumnRenamed("id", "rep")).count() == 6
    sample = jobs.balanced_sample(spark.range(100).selectExpr("id", "id % 3 as kind"), "kind", 4, "id")
    assert sample.count() == 12 and sorted(r.id for r in sample.collect()) == sorted(r.id for r in sample.collect())


def test_rules(spark):
    layout = lambda q, m, d, r: one(spark, rules.layout_class(F.lit(q), F.lit(m), F.lit(d), F.array(*[F.lit(x) for x in r]).cast("array<int>")))
    assert [layout(10, 0, 1, [5]), layout(10, 0, 1, [5, 6]), layout(30, 0, 1, [20]), layout(5, 0, 0, []), layout(2, 0, 0, []), layout(10, 6, 1, [5]), layout(10, 0, 2, [5])] == ["register", "multi_region", "register_wide", "card", "not_flattenable", "not_flattenable", "not_flattenable"]
    assert one(spark, rules.in_range(F.lit("12,5"), 0, 20)) and not one(spark, rules.in_range(F.lit("12,5"), 0, 20, whole=True)) and one(spark, rules.in_range(F.lit("")))
    assert one(spark, rules.in_domain(F.lit(" Y"), F.array(F.lit("y"), F.lit("n")))) and not one(spark, rules.in_domain(F.lit("x"), F.array(F.lit("y"))))
    assert one(spark, rules.echoes_labels(F.array(F.lit("Name"), F.lit("AGE "), F.lit("z")), F.array(F.lit("name"), F.lit("age"), F.lit("sex"))))
    assert one(spark, rules.align_to_inked(F.array(F.lit("a")), F.array(F.lit(1), F.lit(2)))) is None
    assert one(spark, rules.clean_cell(F.lit("NA"), F.lit(False))) == "" and one(spark, rules.clean_cell(F.lit("NA"), F.lit(True))) == "NA"
    assert one(spark, rules.agree(F.lit("12"), F.lit("13")))["disagree"] and one(spark, rules.agree(F.lit("12"), F.lit("")))["value"] == "12"
    assert len(one(spark, rules.template_errors(F.lit(" "), F.array(F.lit("")), F.array(F.lit("blob")), F.lit(99), F.lit("up")))) == 5
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0)], "form int, row int, col int")
    flags = spark.createDataFrame([(1, 0, 0, 5, "domain"), (1, 0, None, 2, "shape"), (1, 1, 0, 1, "disagree"), (1, 1, None, 3, "shape")], "form int, row int, col int, pos int, flag string")
    assert [r.flag for r in rules.first_flags(cells, flags).orderBy("row", "col").collect()] == ["shape", "shape", "disagree"]


def test_reports(spark):
    rows = spark.createDataFrame([("a", None, "detected", 0.9, 0.0), ("a", None, "review", 0.5, 4.0), ("a", "boom", None, None, None), ("b", None, "review", 0.4, 2.0)], "provider string, error string, verdict string, acc double, sec double")
    a, b = reports.run_report(rows, "provider", "acc", "verdict", "detected", "sec").orderBy("provider").collect()
    assert (a.n, a.n_error, a["mean"], a.bucket_mean, a.mean_latency) == (2, 1, 0.7, 0.9, 4.0) and b.bucket_mean is None
    assert [(r.verdict, r.n) for r in reports.histogram(rows, "verdict", ["detected", "review", "reject"]).collect()] == [("review", 2), ("detected", 1), ("reject", 0)]
    sweep = reports.threshold_sweep(spark.createDataFrame([(1.0, False), (2.0, False), (3.0, True), (4.0, True)], "v double, y boolean"), "v", F.col("y"), [1.0, 2.5, 2.7, 5.0])
    assert [r.threshold for r in sweep.where("best").collect()] == [2.5]


def test_summaries_cuts_and_reports(spark):
    rows = spark.createDataFrame([(1.0, None, "ok", 2.0), (0.5, None, None, 0.0), (None, "boom", "ok", 4.0)], "acc double, error string, verdict string, s double")
    got = reports.run_summary(rows, ["acc"], latency="s").first()
    assert (got.n, got.n_error, got.acc, got.verdicts, got.mean_latency) == (3, 1, 0.75, {"?": 1, "ok": 2}, 3.0)
    none = reports.run_summary(rows.limit(0), ["acc"]).first()
    assert (none.n, none.verdicts, none.acc) == (0, {}, None)
    values = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0), (None, 7.0)], "g string, v double")
    assert sorted(r.v for r in reports.iqr_cut(values, "g", "v").collect()) == [1, 2, 3, 4, 5, 7]
    lines = [r.line for r in reports.fixed_width(spark.createDataFrame([(1, "abc"), (22, None)], "n int, t string"), n=4, t=2).collect()]
    assert lines == ["   1 ab", "  22 - "]
    times = spark.createDataFrame([("a", 5), ("b", None), ("c", 9), ("d", 5)], "n string, created int")
    assert [r.n for r in jobs.newest_first(times, "created", "n").collect()] == ["c", "a", "d", "b"]


def test_names_templates_and_serials(spark):
    assert one(spark, fx.filled("{a} {{x}} {b}", a=F.lit("1"), b=F.lit(None))) == "1 {x} "
    assert one(spark, fx.form_id(F.lit("see PRAB2Z and PRQQQQ"))) == "PRAB2Z" and one(spark, fx.form_id(F.lit("PRab2z"))) is None
    assert one(spark, fx.all_urls(F.lit("http://a http://b"), F.lit("http://a"), F.lit(None).cast("string"))) == ["http://a", "http://b"]
    assert one(spark, fx.field_of_each(F.create_map(F.lit("k"), F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))), "b")) == {"k": 2}
    assert [one(spark, rules.serial_mismatch(F.lit(v), F.lit(2))) for v in ("3", " 3.0 ", "", "4", "l", None)] == [False, False, False, True, True, False]


def test_integrity(spark):
    files = spark.createDataFrame([("a.md", "x"), ("b.md", "y"), ("c.md", "z")], "name string, text string")
    there = spark.createDataFrame([("a.md", "x"), ("b.md", "changed")], "name string, text string")
    found = integrity.check_manifest(integrity.manifest(files, "name", "text"), integrity.manifest(there, "name", "text"))
    assert [r.status for r in found.orderBy("name").collect()] == ["ok", "changed", "missing"]
    assert [one(spark, integrity.safe_path(F.lit(p))) for p in ("a/b", "/a", "../a", "a/../b", "a..b")] == [True, False, False, False, True]
    assert one(spark, integrity.local_path(F.lit("a/b?x#y"))) == "a/b" and one(spark, integrity.local_path(F.lit("http://x"))) is None
    assert one(spark, integrity.entry_kind(F.lit("2024-05-01T0930-first-entry.md"))) == "stamped"
    assert one(spark, integrity.element_ids(F.lit('<p id="a"><b grid="c" id="d">'))) == ["a", "d"]


def test_snap_looks_at_few_pairs_of_many_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12))) for _ in range(3_000)]
    frame = spark.createDataFrame([(w,) for w in words], "form string").distinct()
    pairs = snapping.candidates(frame, frame, 0.78)
    n = pairs.count()
    assert pairs.distinct().count() == n and n < 0.02 * len(words) ** 2
    both = frame.select("form").withColumn("mark", F.explode(snapping._marks(F.col("form"))))
    often = both.groupBy("mark").agg(F.count(F.lit(1)).alias("often"))
    keyed = snapping._keys(snapping._rarest_first(frame, often), 0.78).groupBy("key", F.size("marks")).count()
    assert keyed.agg(F.max("count")).first()[0] < 0.05 * len(words)


def test_every_query_matches_its_sql(spark, sf):
    import math
    import os

    import duckdb

    from plumbline import queries

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")

    def plain(rows):
        flat = lambda v: round(v, 5) if isinstance(v, float) and not math.isnan(v) else v
        return sorted((tuple(flat(v) for v in r) for r in rows), key=repr)

    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns), name
        assert plain(df.select(*columns).collect()) == plain(want.fetchall()), name


def test_manifest_of_long_ids_and_null_texts(spark, tmp_path):
    import __spark_entry__

    ids = [1, 5, 7, 10, 11, 35, 99_999, 100_001, 100_009, 100_011, 1_000_005, 1_000_006]
    spark.createDataFrame([(i, None if i in (10, 11) else f"text {i}") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, __spark_entry__.queries()["manifest_integrity"](spark, str(tmp_path)).collect()))
    assert got == sorted((f"{i:05d}-page.md", "missing" if i % 7 == 0 else "changed" if i % 5 == 0 else "ok") for i in ids)
    assert (f"{1_000_005:05d}-page.md", "changed") in got


def test_unique_keys_shown_modulo_form_no_long_names(spark):
    n = 1_500_000  # whole names are 10^12 characters
    rows = spark.range(n).select("id", F.lit("k").alias("v"))
    found = sequences.unique_keys(rows, "v", ["id"], most=100_000, modulo=3).select("id", F.length("key").alias("n"))
    assert found.where((F.col("id") % 3 + 1) != F.col("n")).count() == 0 and found.count() == n


def test_blocks_of_many_cuts_follow_the_order(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("at"))
    found = sequences.blocked(rows, "g", ["at"], most=50).groupBy("g", "__sq_block").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n")).orderBy("g", "__sq_block").collect()
    assert len(found) > 300 and sum(r.n for r in found) == 20_000 and max(r.n for r in found) < 1000
    assert all(a.high < b.low for a, b in zip(found, found[1:], strict=False) if a.g == b.g)
