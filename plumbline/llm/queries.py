"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, language, lattice, merkle, packing, quality, secrets, simhash, toxicity, trie, url_filter, warc
from plumbline.llm.common import table

#: The rules of op10 (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _tokenizers():
    """Where the public tokenizer files are, and the pattern that splits text; only these queries name that package."""
    import public_tokenizers

    return public_tokenizers


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    ranks = files.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), ranks, files.PATTERN)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_report(table(spark, sf_dir, "documents"), _tokenizers().path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tokenizers()
    return packing.pack_documents(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_report(table(spark, sf_dir, "documents"), trusted)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), warc.archive_path(spark))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie_report(table(spark, sf_dir, "conversations"))


def op13_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_groups": op1_simhash_groups,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_language": op4_language,
        "op5_lattice_scores": op5_lattice_scores,
        "op6_packing": op6_packing,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_toxicity": op9_toxicity,
        "op10_url_rules": op10_url_rules,
        "op11_merkle_proofs": op11_merkle_proofs,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_secret_spans": op13_secret_spans,
    }


def _crc32_sql(value: str) -> str:
    """DuckDB's unsigned crc32 of a decimal number, bit by bit; null counts as the empty string."""
    codes = f"list_transform(string_split(coalesce(CAST({value} AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce([4294967295] || {codes}, lambda a, b: {bits}))"


def _merkle_sql(levels: int) -> str:
    """Trees of up to 3^levels leaves, level by level: nodes of the sources' trees (t = 0) and of the one above (t = 1)."""
    framed = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END"
    leaf = lambda text: f"sha256(concat({', '.join(framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"
    sql = f"""WITH c AS (SELECT *, CASE WHEN {_crc32_sql('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS claim FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g FROM d),
a0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS m FROM p)"""
    for k in range(1, levels + 1):
        sql += f",\na{k} AS (SELECT g, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(m) + 2) // 3 AS m FROM a{k - 1} WHERE m > 1 GROUP BY g, i // 3)"
    tops = " UNION ALL ".join(f"SELECT g AS i, h FROM a{k} WHERE m = 1" for k in range(levels + 1))
    sql += f",\nb0 AS (SELECT i, h, count(*) OVER () AS m FROM ({tops}))"
    for k in range(1, levels + 1):
        sql += f",\nb{k} AS (SELECT i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(m) + 2) // 3 AS m FROM b{k - 1} WHERE m > 1 GROUP BY i // 3)"
    root = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE m = 1" for k in range(levels + 1))
    # f0 has the claim; each level takes the others of the run to its left and right.
    sql += ",\nf0 AS (SELECT doc_id, leaf, claim AS cur, '' AS proof, g, i, g AS up FROM p)"
    step, side = 0, lambda t, on, sign: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM {t} s WHERE {on} AND s.i // 3 = n.i // 3 AND s.i {sign} n.i), '')"
    for t in ("a", "b"):
        for k in range(levels):
            on, key = ("s.g = f.g", "n.g = f.g AND n.i = f.i") if t == "a" else ("true", "n.i = f.up")
            left, right = side(f"{t}{k}", on.replace("f.g", "n.g"), "<"), side(f"{t}{k}", on.replace("f.g", "n.g"), ">")
            around = f"SELECT n.*, {left} AS l, {right} AS r FROM {t}{k} n WHERE m > 1"
            nxt = "f.i // 3 AS i, f.up" if t == "a" else "f.i, f.up // 3 AS up"
            sql += f",\nf{step + 1} AS (SELECT doc_id, leaf, CASE WHEN n.h IS NULL THEN cur ELSE sha256(concat(l, cur, r)) END AS cur, concat(proof, l, r) AS proof, f.g, {nxt} FROM f{step} f LEFT JOIN ({around}) n ON {key})"
            step += 1
    return sql + f"""
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified FROM f{step} f JOIN b0 s ON s.i = f.g CROSS JOIN ({root}) r"""


_TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32_sql('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, t.k, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, 1, t.k, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(x)) AS bytes, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(concat(length(r), ':', r, length(x), ':', x), '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)),
p AS (SELECT conv_id, depth, bytes, n, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM d UNION ALL SELECT c.conv_id, 0, 0, coalesce(max(d.n), 0), '', NULL FROM c LEFT JOIN d USING (conv_id) GROUP BY c.conv_id),
g AS (SELECT path, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT up, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
s AS (SELECT DISTINCT a.path AS top, e.path FROM p a JOIN p e ON a.conv_id = e.conv_id AND a.depth <= e.depth),
u AS (SELECT s.top, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved_tokens FROM s JOIN g ON g.path = s.path LEFT JOIN k ON k.up = s.path GROUP BY s.top)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN u ON u.top = g.path LEFT JOIN k ON k.up = g.path LEFT JOIN g m ON m.path = g.up"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: The queries that SQL can express; the others rest on hashes, vocabularies or classifiers that DuckDB lacks.
_SQL = {
    "op2_exact_dedup": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256 FROM n WINDOW w AS (PARTITION BY norm)""",
    "op8_warc_round_trip": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
f AS (SELECT *, CASE WHEN b >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op10_url_rules": f"""WITH r(r_host, r_path, r_verdict) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, lower(raw) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) + length(r_path) DESC) AS k
  FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op11_merkle_proofs": _merkle_sql(levels=8), "op12_prefix_trie": _TRIE_SQL}
