import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, quality, toxicity, url_filter, warc
from tests.llm.conftest import ODD

WORD = r"[^\x20\x09-\x0D]+"


def brute_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_match_brute_force(spark, sf, odd, nothing):
    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_report(docs, trusted).collect():
        assert tuple(r)[1:7] == brute_rules(text[r.doc_id])
    rows = quality.quality_report(odd, trusted).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:7]) for r in rows) == sorted((-1 if i is None else i, *brute_rules(t)) for i, t in ODD)
    assert quality.quality_report(nothing, trusted).count() == 0
    assert quality.keep_good(docs, trusted).columns == docs.columns


def test_quality_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    rows = [r for r in quality.quality_report(spark.read.parquet(f"{sf}/documents.parquet"), trusted).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = ([r for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.05
    none = quality.quality_report(spark.read.parquet(f"{sf}/documents.parquet"), trusted.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_ratios_match_brute_force(spark, odd):
    from pyspark.sql import functions as F

    trusted = spark.createDataFrame([(4,), (5,), (5,), (77,), (None,)], "doc_id long")
    table = quality.llr_table(odd, trusted, buckets=64)
    hashed = {}
    grams = sorted({g for _, t in ODD for w in [re.findall(WORD, t or "")] for g in [*[(x,) for x in w], *zip(w, w[1:], strict=False)]})
    for size in (1, 2):
        own = [g for g in grams if len(g) == size]
        frame = spark.createDataFrame(own, ", ".join(f"w{k} string" for k in range(size)))
        for r in frame.select("*", F.pmod(F.xxhash64(*frame.columns), F.lit(64)).alias("b")).collect():
            hashed[tuple(r)[:-1]] = r.b
    raw, good = np.zeros(64), np.zeros(64)
    for i, t in ODD:
        w = re.findall(WORD, t or "")
        for g in [*[(x,) for x in w], *zip(w, w[1:], strict=False)]:
            raw[hashed[g]] += 1
            good[hashed[g]] += i in (4, 5)
    want = np.log((good + 1) / (good.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    assert np.allclose(table, want)


def _brute_bits(samples, order, text):
    """Code length of text under PPM (escape C, no exclusion) of the samples, by plain dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for s in samples:
        s = b"\n\n\n" + s
        for i in range(3, len(s)):
            for k in range(order):
                counts[s[i - k : i]][s[i]] += 1
    text, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(text)):
        p = 1.0
        for k in range(order - 1, -1, -1):
            seen = counts.get(text[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if text[i] in seen:
                p *= seen[text[i]] / total
                break
            p *= len(seen) / total
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def test_code_lengths_match_brute_force(monkeypatch):
    samples = {"a": [b"abracadabra", b"abc"], "b": [b"the cat sat", b"on the mat", "é".encode()]}
    rows = []
    for number, lang in enumerate(sorted(samples)):
        for _, grams, _ in language.pieces(samples[lang]):
            for k in range(1, 5):
                values, n = np.unique(grams & np.uint32((1 << 8 * k) - 1), return_counts=True)
                rows += [(number, k, int(g), int(c)) for g, c in zip(values, n, strict=True)]
    model = language.PPM.fit(["a", "b"], *(np.array(c) for c in zip(*rows, strict=True)))
    texts = [b"abra the", b"", b"zzz", b"the mat on abc"]
    want = [[_brute_bits(samples[x], 4, t) for x in "ab"] for t in texts]
    assert np.allclose(model.bits(texts), want, rtol=1e-5)
    monkeypatch.setattr(language, "_PIECE", 3)
    assert np.allclose(model.bits(texts), want, rtol=1e-5)
    model._index(most=3)
    assert np.allclose(model.bits(texts), want, rtol=1e-5)


def test_language_of_held_out_documents(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language.language_report(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(rows[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = language.fit_languages(docs, sample_docs=50)
    found = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert {found[i].lang_pred for i in (0, 1, 2)} == {"und"} and found[0].score == 0 and found[5].lang_pred == "en"
    assert language.language_report(nothing).count() == 0
    assert language.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_toxicity_of_held_out_documents(spark, odd, nothing):
    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    rows = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held)
    assert np.mean([rows[r.doc_id].predicted for r in held if r.toxic]) > 0.85
    assert np.mean([rows[r.doc_id].predicted for r in held if not r.toxic]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    small = labels.where("doc_id < 1000")
    found = toxicity.toxicity_report(odd.join(spark.createDataFrame([("en",)], "lang string")), small.withColumn("doc_id", small.doc_id % 14)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity_report(nothing, labels).count() == 0
    assert toxicity.keep_clean(docs, labels.where("toxic = 0")).count() == docs.count()


def test_filters_see_the_whole_of_a_long_text():
    texts = [b"calm words here again"] * 20 + [b"calm vile words again"] * 20
    model = toxicity.train(texts, np.array([0] * 20 + [1] * 20), epochs=10)
    long = b"calm words " * (toxicity._WORDS + 10) + b"vile words " + b"again " * 10
    short, clean, whole = model.raw([b"calm vile words", b"calm words here", long], toxicity._Rows(model.row))
    assert short > clean and whole == pytest.approx(short, abs=0.2)


URLS = [None, "", "nourl", "http://Example.COM/en/7?x", "https://a.example.com/en/71", "http://com/en/", "http://xcom/en/", "ftp://b.net/de/8#f", "http://q.example.net/de/89/", "http://example.net/de", "a://org", "http://x.org/es/y://z/", "x://y.org/es/?a", "http://example.com/en/7"]


def test_url_rules_match_brute_force(spark, nothing):
    from plumbline.llm.queries import URL_RULES

    pages = spark.createDataFrame([(i, u, "u") for i, u in enumerate([*URLS, *URLS[3:5]])] + [(3, URLS[3], "u"), (None, URLS[4], "u")], "page_id long, url string, host string")
    for many in (URL_RULES, [*URL_RULES, *[(f"h{k}.io", f"/{k}", "block") for k in range(500)]], []):
        rules = spark.createDataFrame(many, "host string, path string, verdict string")
        got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
        want = collections.Counter()
        for r in pages.collect():
            rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = host.lower()
            fits = [(len(h + p), h + p, v) for h, p, v in many if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fits, default=(0, None, "allow"))
            want[r.page_id, host, path, best[1], best[2]] += 1
        assert got == want
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize("chunk_bytes", [7, 1 << 18])
def test_archives_round_trip(spark, tmp_path, chunk_bytes):
    long = "<p>" + "ab\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30 + "é" * 50
    payloads = [(5, long), (3, long), (9, long), (1, None), (2, ""), (4, "short"), (6, "short"), (7, "x" * 100), (8, "x" * 100), (10, "x" * 99), (11, "x" * 99), (12, "\r\n\r\n"), (13, "\n"), (3, long), (14, "WARC/1.1\r\n")]
    pages = spark.createDataFrame([(i, t, "r") for i, t in payloads], "page_id long, html string, record_type string").repartition(3)
    rows = warc.archive_round_trip(pages, str(tmp_path / "w"), chunk_bytes=chunk_bytes).collect()
    want = []
    for i, t in payloads:
        raw = (t or "").encode()
        first = min(j for j, u in payloads if (u or "") == (t or ""))
        again = len(raw) >= 100 and first != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    empty = warc.archive_round_trip(pages.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0


def test_archives_of_repeated_and_odd_ids(spark, tmp_path):
    a, b = "a" * 200, "b" * 300
    rows = [("3", a), ("3", b), ("5", a), ("5", "tiny"), ("a.x", b), ("a:y/ z~é%", a), ("~", "x"), ("null", "y"), ("", "z"), (None, a), (None, "w"), (None, "w"), ("3", b)]
    pages = spark.createDataFrame(rows, "page_id string, html string").repartition(3)
    got = collections.Counter(map(tuple, warc.archive_round_trip(pages, str(tmp_path / "w")).collect()))
    want = collections.Counter()
    for i, t in rows:
        first = min(j for j, u in rows if u == t and j is not None) if len(t) >= 100 else i
        sha = hashlib.sha256(t.encode()).hexdigest()
        want[i, len(t), sha, "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want


def test_archives_of_a_long_payload_in_default_chunks(spark, tmp_path):
    long = "".join(f"<p>{i} é WARC/1.1\r\n</p>" if i % 9000 == 0 else f"<p>{i}</p>" for i in range(120_000))
    pages = spark.createDataFrame([(1, long), (2, long), (3, "x" * (1 << 18)), (4, "x" * ((1 << 18) + 1))], "page_id long, html string")
    chunks = warc.chunk_rows(warc.record_types(pages)).collect()
    assert len([c for c in chunks if c.page_id == 1]) > 14 and len([c for c in chunks if c.page_id == 2]) == 1
    assert [len([c for c in chunks if c.page_id == i]) for i in (3, 4)] == [1, 2] and max(len(c.chunk) for c in chunks) == 1 << 18
    rows = {r.page_id: r for r in warc.archive_round_trip(pages, str(tmp_path / "w")).collect()}
    raw = long.encode()
    assert tuple(rows[1])[1:] == (len(raw), hashlib.sha256(raw).hexdigest(), "response", None)
    assert tuple(rows[2])[1:] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit", 1)


def test_archives_are_warc_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a" * 500), (2, "a" * 500), (3, "b" * 120)], "page_id long, html string").coalesce(1)
    warc.write_archives(warc.chunk_rows(warc.record_types(pages), 200), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    kinds, bodies = [], collections.defaultdict(bytes)
    while raw:  # a plain reader by Content-Length
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields["Content-Length"])
        kinds.append(fields["WARC-Type"])
        bodies[fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])] += rest[:n]
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw = rest[n + 4 :]
    assert collections.Counter(kinds) == {"response": 2, "continuation": 2, "revisit": 1}
    name = lambda i, raw: f"<urn:page:{i}:{hashlib.sha256(raw).hexdigest()}>"
    assert bodies[name(1, b"a" * 500)] == b"a" * 500 and bodies[name(3, b"b" * 120)] == b"b" * 120


def test_toxicity_learns_from_a_full_sample_of_labelled_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'calm'} words number {i}" * (1 + 2000 * (i > 110))) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")  # most are of no document
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, **k: (seen.append((len(texts), int(sum(y)))), train(texts, y, **k))[1])
    assert toxicity.fit_toxicity(docs, labels, lang_col=None) is not None
    assert toxicity.fit_toxicity(docs, labels, lang_col=None, min_positive=5) is not None  # a fifth sets the thresholds
    assert toxicity.fit_toxicity(docs, labels, lang_col=None, sample_docs=20) is not None
    assert seen[0] == (120, 60) and seen[1][0] == 96 and 20 < seen[2][0] < 60


def test_toxicity_sample_of_repeated_ids_and_long_texts(spark, monkeypatch):
    rows = [(i % 10, f"calm words {i % 10}") for i in range(20_000)] + [(None, "vile words")] * 500 + [(77, "vile text " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 0) for i in range(10)] + [(77, 0), (77, 1), (None, 1)], "doc_id long, toxic int")
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, **k: (seen.append(sorted(zip(texts, y.tolist(), strict=True))), train(texts, y, **k))[1])
    assert toxicity.fit_toxicity(docs, labels, lang_col=None, sample_docs=50, sample_bytes=5000) is not None
    # Copies are one text, and the one toxic text is taken whole though it is longer than the bytes of the sample.
    assert seen == [sorted([(f"calm words {i}".encode(), 0) for i in range(10)] + [(b"vile text " * 5000, 1)])]


def test_toxicity_learns_from_every_labelled_text_in_tasks(spark, monkeypatch):
    rows = [(i, f"{'vile' if i % 4 == 0 else 'calm'} words of number {i % 50} here", "en" if i % 3 else "de") for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, "vile", "en"), (9999, None, "en")], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2000)] + [(None, 1)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_LOCAL_DOCS", 100)
    monkeypatch.setattr(toxicity, "train", None)  # nothing is learnt by the driver
    counted, counts = [], toxicity._slot_counts
    monkeypatch.setattr(toxicity, "_slot_counts", lambda given: counted.append(given.count()) or counts(given))
    model = toxicity.fit_toxicity(docs, labels)
    judged = toxicity.sample_keys(docs).where("doc_id < 600 and pmod(sample_key, 5) = 0").count()
    assert counted == [600 - judged] and set(model.threshold) >= {-1} and model.languages.languages == ["de", "en"]
    bad, good = toxicity._slot_counts(docs.where("doc_id < 600").selectExpr("text", "cast(doc_id % 4 = 0 as int) as toxic"))
    a, b = (x % toxicity.TABLE for x in toxicity._buckets("vile"))
    assert (bad[a], good[a], bad[b], good[b]) == (150, 0, 150, 0)
    found = toxicity.score_texts(docs.where("doc_id < 600"), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in found)
    s, y = np.array([0.9, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0])
    at = (s * 1000).astype(int)
    assert toxicity._best_bin(np.bincount(at[y == 1], minlength=1000), np.bincount(at[y == 0], minlength=1000)) == pytest.approx(toxicity._threshold(s, y), abs=1e-3)


def test_labelled_texts_are_dealt_to_tasks_however_few_labels_there_are(spark, monkeypatch):
    rows = [(i, f"{'vile' if i < 300 else 'calm'} words of number {i % 50} here") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, "doc_id")  # one task has all toxic ones
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(1200)], "doc_id long, toxic int")
    met, fit = [], toxicity._fit_whole
    monkeypatch.setattr(toxicity, "_LOCAL_DOCS", 100)
    monkeypatch.setattr(toxicity, "_fit_whole", lambda given, *a: (met.extend(given.groupBy(F.spark_partition_id()).agg(F.avg("toxic"), F.count("toxic")).collect()), fit(given, *a))[1])
    model = toxicity.fit_toxicity(docs, labels, lang_col=None)
    assert sum(r[2] for r in met) == 1200 and all(0.1 < r[1] < 0.5 for r in met)
    assert all((r.score >= 0.5) == (r.doc_id < 300) for r in toxicity.score_texts(docs, model).collect())
    # Texts move once at any size, so that what lies on disk keeps its share of the input as labels grow in number.
    near = toxicity._labelled(toxicity.sample_keys(docs), labels.select(F.col("doc_id").alias("l_id"), "toxic"))
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _plain_score(model, text):
    """The network's answer by plain loops: embeddings, ramp of each filter at each place, largest, logistic."""
    vectors = [model.embedding[model.row.get(a, 0)].astype(float) + model.embedding[model.row.get(b, 0)] for a, b in map(toxicity._buckets, text.decode().split())]
    pooled = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(vectors)):
                value = float(model.bias[width][f])
                for j in range(width):
                    if at + j < len(vectors):
                        value += float(vectors[at + j] @ model.filters[width][j][:, f])
                best = max(best, value)
            pooled.append(best)
    return 1 / (1 + np.exp(-(float(np.array(pooled) @ model.head) + model.head_bias)))


def _small_model():
    rng = np.random.default_rng(2)
    words = ["calm", "vile", "words", "again", "here", "and", "there", "nothing"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))).encode() for _ in range(40)]
    labels = np.array([b"vile" in t for t in texts]).astype(int)
    return toxicity.train(texts, labels, epochs=3, min_docs=1), texts, labels


def test_scores_match_plain_loops_and_thresholds_move_to_a_half():
    model, texts, _ = _small_model()
    for piece in (texts, [b"", b"unseen", b"vile", b"a " * 5 + b"vile calm"]):
        assert np.allclose(model.raw(piece, toxicity._Rows(model.row)), [_plain_score(model, t) for t in piece], atol=1e-5)
    model.threshold = {-1: 0.3, 0: 0.3}
    raw, score = model.raw(texts, toxicity._Rows(model.row)), model.scores(texts, toxicity._Rows(model.row))
    assert ((raw >= 0.3) == (score >= 0.5)).all() and (np.argsort(raw, kind="stable") == np.argsort(score, kind="stable")).all()
    s, y = np.array([0.9, 0.8, 0.6, 0.4, 0.2]), np.array([1, 1, 0, 1, 0])
    best = max((2 * (y * (s >= t)).sum() / ((s >= t).sum() + y.sum()), t) for t in s)
    t = toxicity._threshold(s, y)
    assert 2 * (y * (s >= t)).sum() / ((s >= t).sum() + y.sum()) == pytest.approx(best[0])


def test_gradients_match_differences():
    model, texts, labels = _small_model()
    for array in toxicity.parameters(model):  # double, so that differences mean something
        array.flags.writeable = True
    model.embedding = model.embedding.astype(float)
    model.filters = {w: x.astype(float) for w, x in model.filters.items()}
    model.bias = {w: x.astype(float) for w, x in model.bias.items()}
    model.head = model.head.astype(float)
    coded = [np.array([[model.row.get(b, 0) for b in toxicity._buckets(w)] for w in t.decode().split()]).reshape(-1, 2) for t in texts]
    weight = np.linspace(0.5, 2, len(texts))
    _, grads, by_bias = toxicity.loss_and_gradients(model, coded, labels, weight)
    rng, step = np.random.default_rng(3), 1e-3  # convolved() works in single precision
    for array, grad in zip(toxicity.parameters(model), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            if array is model.embedding and at[0] == 0:
                continue
            held, losses = array[at], []
            for moved in (held - step, held + step):
                array[at] = moved
                losses.append(toxicity.loss_and_gradients(model, coded, labels, weight)[0])
            array[at] = held
            assert (losses[1] - losses[0]) / (2 * step) == pytest.approx(grad[at], abs=5e-3)
    losses = []
    for moved in (model.head_bias - step, model.head_bias + step):
        held, model.head_bias = model.head_bias, moved
        losses.append(toxicity.loss_and_gradients(model, coded, labels, weight)[0])
        model.head_bias = held
    assert (losses[1] - losses[0]) / (2 * step) == pytest.approx(by_bias, abs=5e-3)


def test_languages_with_long_texts_only_and_repeated_ids_are_learnt(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(30)] + [(1000, "der hund und die katze sind im garten " * 3000, "de")]
    rows += [(i % 10, f"le chat et le chien sont dans le jardin {i % 10}", "fr") for i in range(20_000)] + [(None, "el gato y el perro en la casa", "es")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit_languages(docs, sample_docs=8, sample_bytes=20_000)
    assert model.languages == ["de", "en", "es", "fr"]
    found = model.predict([b"die katze und der hund", b"the dog and the cat", b"le chien et le chat", b"el perro y el gato"])[0]
    assert found.tolist() == [0, 1, 3, 2]
    keyed = language.sample_keys(docs.where("lang = 'fr'").select("doc_id", "text", "lang"))
    taken = keyed.where(language.sample_rule(keyed, "lang", 8, 1 << 20)).dropDuplicates(["lang", "sample_key"]).count()
    assert 1 <= taken <= 10


def test_language_predictions_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = {r.doc_id: r for r in language.language_report(docs).collect()}  # few enough documents that all are learnt from
    texts = {r.doc_id: (language.as_bytes(r.text), r.lang) for r in docs.collect()}
    samples = collections.defaultdict(list)
    for i, (raw, lang) in texts.items():
        if raw and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            samples[lang].append(raw)
    names = sorted(samples)
    for i in sorted(texts, key=lambda i: len(texts[i][0]))[:12]:
        raw, _ = texts[i]
        if any(c.isalpha() for c in raw.decode()):
            bits = np.array([_brute_bits(samples[x], 4, raw) for x in names])
            assert rows[i].lang_pred == names[int(bits.argmin())]
            assert rows[i].score == pytest.approx(1 / np.exp2(bits.min() - bits).sum(), abs=1e-3)


def test_quality_scores_and_verdicts_match_brute_force(spark, odd):
    from pyspark.sql import functions as F

    trusted = spark.createDataFrame([(4,), (5,), (10,)], "doc_id long")
    ratios = [round(x, 12) for x in quality.llr_table(odd, trusted, buckets=64)]
    grams = sorted({g for _, t in ODD for w in [re.findall(WORD, t or "")] for g in [*[(x,) for x in w], *zip(w, w[1:], strict=False)]})
    hashed = {}
    for size in (1, 2):
        frame = spark.createDataFrame([g for g in grams if len(g) == size], ", ".join(f"w{k} string" for k in range(size)))
        hashed |= {tuple(r)[:-1]: r.b for r in frame.select("*", F.pmod(F.xxhash64(*frame.columns), F.lit(64)).alias("b")).collect()}
    want = []
    for i, t in ODD:
        w = re.findall(WORD, t or "")
        own = [ratios[hashed[g]] for g in [*[(x,) for x in w], *zip(w, w[1:], strict=False)]]
        score = sum(own) / len(own) if own else 0.0
        want.append((-1 if i is None else i, round(score, 4), not brute_rules(t)[-1] and score >= -0.1))
    got = [(-1 if r.doc_id is None else r.doc_id, round(r.score, 4), r.kept) for r in quality.quality_report(odd, trusted, buckets=64).collect()]
    assert sorted(got) == sorted(want)


def test_quality_verdicts_on_labels_that_were_not_learnt_from(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    known = labels.where("quality = 1 and crc32(cast(doc_id as string)) % 2 = 0").select("doc_id")
    held = {r.doc_id: r.quality for r in labels.where("crc32(cast(doc_id as string)) % 2 = 1").collect()}
    rows = [r for r in quality.quality_report(docs, known).collect() if r.doc_id in held and not r.base_failed]
    assert np.mean([r.kept for r in rows if held[r.doc_id] == 1]) > 0.97 and np.mean([r.kept for r in rows if held[r.doc_id] == 0]) < 0.1


def test_columns_with_dots_and_backticks_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as `a.b`", "2 as `c``d`")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert quality.keep_good(docs, labels.where("quality = 1").select("doc_id")).columns == docs.columns
    assert toxicity.keep_clean(docs, labels).columns == docs.columns


def test_many_rule_shapes_make_no_larger_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c.d.example.com/" + "x" * 50), (2, "http://q.org/" + "y" * 3)], "page_id long, url string")
    rules = spark.createDataFrame([(".".join(["h"] * k) + ".com", "/" + "x" * m, "block") for k in range(1, 30) for m in range(40)] + [("example.com", "/xx", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.judge_urls(pages, rules).collect()} == {1: "example.com/xx", 2: None}


def test_a_payload_of_many_version_marks_is_cut_in_one_pass(spark):
    """100,000 marks in one payload: cut inside each, and whole again after the round trip."""
    text = "WARC/1.1\r\nx" * 100_000
    pages = spark.createDataFrame([(1, text), (2, "plain"), (3, text + "!")], "page_id long, html string")
    records = warc.record_types(pages)
    chunks = warc.chunk_rows(records, chunk_bytes=1 << 12)
    assert chunks.where("instr(cast(chunk as string), 'WARC/1.1') > 0").count() == 0
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.archive_round_trip(pages, warc.archive_path(spark)).collect()}
    assert got == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in ((1, text), (2, "plain"), (3, text + "!"))}
