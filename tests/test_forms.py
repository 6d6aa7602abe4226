from plumbline.operators import citations, forms


def survey(spark, types, form=1):
    return spark.createDataFrame([(form, i, t, f"Label {i}", None, None, None) for i, t in enumerate(types)], "form int, pos int, type string, label string, relevant string, constraint string, choice_filter string")


def test_features_and_classes(spark):
    f = lambda *types: forms.form_features(survey(spark, types)).first()
    one = f("text", "begin repeat", "integer", "select_one x", "date", "end repeat", "note")
    assert (one.questions, one.select_one, one.repeats, one.max_depth, one.regions, one["class"]) == (4, 1, 1, 1, [3], "register")
    nested = f("begin_repeat", "text", "begin_repeat", "integer", "end_repeat", "text", "end_repeat")
    assert (nested.max_depth, nested.regions, nested["class"]) == (2, [2], "not_flattenable")
    assert f("begin repeat", "text", "text", "end repeat", "begin repeat", "text", "date", "end repeat")["class"] == "multi_region"
    assert f("end repeat", "text", "text", "select multiple y", "time")["class"] == "card"
    assert f("image", "geopoint", "audio", "text")["class"] == "not_flattenable"


def test_table_columns(spark):
    rows = survey(spark, ["text", "integer", "select_one sex", "select_one ok", "select_one gone", "note", "datetime"])
    choices = spark.createDataFrame([("sex", 0, "male"), ("sex", 1, "female"), ("ok", 0, "Yes"), ("ok", 1, "no")], "list_name string, pos int, name string")
    got = [(r.pos, r.type, r.domain) for r in forms.table_columns(rows, choices).orderBy("pos").collect()]
    assert got == [(0, "text", []), (1, "int", []), (2, "choice", ["M", "F"]), (3, "yn", ["Y", "N"]), (6, "date", [])]


def test_fetch_failures_are_results(spark):
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("http://a",), (None,)], "url string")

    def fetch(url):
        if url.endswith("b"):
            raise OSError("down")
        return "x" * 500_000

    got = {r.url: r.body for r in citations.fetched(urls, fetch).collect()}
    assert got["http://b"] == "__FETCH_FAIL__ down" and len(got["http://a"]) == 400_000 and len(got) == 2


def test_citations_and_digest(spark):
    pages = spark.createDataFrame([("http://a", "total 1,234 or 56"), ("http://b", "__FETCH_FAIL__ 1234")], "url string, body string")
    runs = spark.createDataFrame([("m", "q1", "1234 of 56 (http://a) http://b http://c http://a")], "model string, qid string, body string")
    got = [(r.pos, r.url, r.resolves, r.numbers) for r in citations.citations(runs, pages, ["model", "qid"]).orderBy("pos").collect()]
    assert got == [(0, "http://a", True, ["1234"]), (1, "http://b", False, []), (2, "http://c", True, []), (3, "http://a", True, ["1234"])]
    bank = spark.createDataFrame([("q1", "about 56")], "qid string, gold string")
    entry = citations.digest(citations.run_features(citations.with_question(runs, bank)), "model", "qid").first().entry
    assert entry.startswith("### m / q1\nauto: gold_num=true cites=4 ask=false nodata=false\n1234 of 56")


def test_citations_of_pages_that_share_a_link(spark):
    url = "http://a/123"
    runs = spark.createDataFrame([(i, f"1,123 and 456, see {url}") for i in (1, 2, 3)], "i int, body string")
    pages = spark.createDataFrame([(1, url, "1,123"), (2, url, "__FETCH_FAIL__"), (3, url, "456")], "i int, url string, body string")
    got = lambda **k: [tuple(r) for r in citations.citations(runs, pages, ["i"], **k).select("i", "resolves", "numbers").orderBy("i").collect()]
    assert got(by=["i"], linked=False) == [(1, True, ["1123"]), (2, False, []), (3, True, ["456"])]
    assert got(by=["i"]) == [(1, True, ["1123", "123"]), (2, False, []), (3, True, ["456"])]
    assert got() == [(i, True, ["1123", "123"]) for i in (1, 2, 3)]  # one page of a link, not one row for each


def test_citation_check_of_pages_with_one_url(spark, tmp_path):
    import duckdb

    import __spark_entry__

    spark.createDataFrame([(i, "http://a.example/en/100/") for i in range(1, 80)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(__spark_entry__.oracle_sql()["citation_check"]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()["citation_check"](spark, str(tmp_path)).collect())) == sorted(want)


def test_a_run_without_its_question_fails(spark):
    import pytest

    runs = spark.createDataFrame([("q9", "x")], "qid string, body string")
    with pytest.raises(Exception, match="no such question: q9"):
        citations.with_question(runs, spark.createDataFrame([("q1", "1")], "qid string, gold string")).collect()


def test_the_form_query_reads_every_event(spark, tmp_path):
    import datetime
    import random

    from plumbline import queries

    rng = random.Random(5)
    kinds = ["signup", "error", "click", "view", "purchase"]
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(seconds=rng.randint(0, 200)), rng.randint(1, 4), rng.choice(kinds)) for i in range(400)]
    events += [(1000 + 40 * i + 12, start, 9, "signup") for i in range(3)]  # a user with no event_id % 40 under 12
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id int, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.form: tuple(r)[1:] for r in queries.queries()["form_features"](spark, str(tmp_path)).select("form", "questions", "select_multiple", "media", "repeats", "max_depth", "regions").collect()}
    want = {}
    for user in {e[2] for e in events}:
        depth = deepest = inside = opened = 0
        regions, n = [], dict.fromkeys(kinds, 0)
        for _, _, _, kind in sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])):
            before, n[kind] = depth, n[kind] + 1
            depth = max(0, depth + {"signup": 1, "error": -1}.get(kind, 0))
            deepest = max(deepest, depth)
            inside += kind in ("click", "view") and depth >= 1
            opened = inside if kind == "signup" else opened
            if kind == "error" and before == 1:
                regions.append(str(inside - opened))
        want[user] = (n["click"] + n["view"], n["click"], n["purchase"], n["signup"], deepest, ";".join(regions))
    assert got == want


def test_documents_that_contain_whole_items(spark, tmp_path, monkeypatch):
    import random
    from collections import Counter

    from plumbline import queries

    rng = random.Random(8)
    words = ["a", "of", "the", "ward", "house", "ünïon", "incomprehensibilities", "x" * 70]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(n))
    docs = [(i, prose(rng.randint(0, 40))) for i in range(150)] + [(0, "the ward of a house"), (None, "of the ward of a house"), (None, "of the ward of a house"), (900, None), (901, ""), (902, " ")]
    cuts = [t for _, t in docs if t and len(t) > 30]
    items = []
    for i in range(120):
        t = rng.choice(cuts)
        k = rng.randint(0, len(t) - 3)
        items.append((i, t[k : k + rng.choice([1, 3, 8, 20, 60, 100, 200])]))
    long = max(cuts, key=len)
    items += [(200, long), (201, long[:80] + " other words than the document has"), (202, ""), (203, None), (204, "the ward of a house"), (204, "the ward of a house"), (None, "ward of a hou"), (205, " "), (206, "f the ward of a hou")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = Counter((d, i) for d, t in docs for i, p in items if t is not None and p is not None and p in t)
    for most in (2_000_000, 0):
        monkeypatch.setattr(citations, "BROADCAST", most, raising=False)
        got = Counter((r.doc_id, r.item_id) for r in queries.queries()["citation_contains"](spark, str(tmp_path)).collect())
        assert got == want


def test_failed_calls_are_made_again_and_recorded_answers_replayed(spark, tmp_path):
    mark = tmp_path / "tries"

    def flaky(url):
        with open(mark, "a") as f:
            f.write(url)
        if mark.read_text().count(url) < 3:
            raise OSError("busy")
        return "é" * 300_000

    urls = spark.createDataFrame([("u",)], "url string")
    got = citations.fetched(urls, flaky, retries=2, wait=0.01).first()
    assert got.body == "é" * 200_000  # 400,000 bytes
    assert citations.fetched(spark.createDataFrame([("v",)], "url string"), flaky).first().body.startswith(citations.FAILED)
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "q int, model string")
    told = citations.replayed(asked, spark.createDataFrame([(1, "a", "25")], "q int, model string, answer string"), ["q", "model"])
    assert sorted((r.q, r.answer, r.error) for r in told.collect()) == [(1, "25", None), (2, None, "not recorded")]


def test_media_languages_reasons_and_ids(spark):
    blank = [None] * 3
    rows = [("f", i, t, *blank) for i, t in enumerate(["file", "barcode", "image", "text", "begin repeat", "text", "begin repeat", "integer", "end repeat", "end repeat"])]
    rows += [("g", i, t, None, None, "x" if i == 1 else None) for i, t in enumerate(["text", "select_one a", "integer", "date"])]
    found = {r.form: r for r in forms.form_features(spark.createDataFrame(rows, "form string, pos int, type string, relevant string, constraint string, choice_filter string")).collect()}
    assert (found["f"].media, found["f"]["class"], found["f"].reasons) == (3, "not_flattenable", ["nested repeats", "media/geo-centric"])
    assert found["g"]["class"] == "card" and found["g"].reasons == ["1 cascading selects (domains become context-dependent)", "no repeat group — card layout needed"]
    sheets = spark.createDataFrame([("a", {"type": "text", "label::en": "x"}), ("a", {"label::fr": "y"}), ("b", {"label": "z"})], "path string, fields map<string,string>")
    assert {r.path: r.languages for r in forms.languages(forms.header_names(sheets)).collect()} == {"a": 2, "b": 0}
    ids = spark.createDataFrame([("s", "PRAB2Z"), ("t", "PRXY3Z"), ("s", "PRAB2Z")], "slug string, form_id string")
    assert [tuple(r) for r in forms.with_form_id(spark.createDataFrame([("s", 1), ("u", 2)], "slug string, n int"), ids).collect()] == [("s", 1, "PRAB2Z")]
