"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import op01_sharding, op02_toxicity, op03_quality, op04_html, op05_decontaminate, op06_simhash, op07_langid, op08_packing, op09_fingerprints, op10_secrets, op11_urls, op12_fim, op13_negatives
from quernstone.llm._common import scratch_path, table


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_langid.identify(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_packing.pack(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_fingerprints.compare(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_secrets.digest(table(spark, sf_dir, "documents"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_sharding.round_trip(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_html.extract(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return op11_urls.judge(pages, op11_urls.unwanted(pages))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_fim.digest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_negatives.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_secret_scan": op10_secret_scan,
    "op11_url_filter": op11_url_filter,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}


def _secrets_sql() -> str:
    """Positions come from the pieces between the matches; hex runs of 16 or more are the same as runs that are then found long enough."""
    parts = []
    for order, rule in enumerate(op10_secrets.RULES):
        pattern = (rule.pattern if rule.kind != "hex" else "[0-9a-f]{16,}").replace("\\x20", " ").replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.min_length} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d WHERE regexp_matches(t, '{pattern}')")
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in op10_secrets.BASE_RULES)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(parts)}),
        x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
        s AS (SELECT doc_id, kind, ord, least, len(g[i]) AS n, list_sum(list_transform(b[1:i], lambda z: len(z)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: len(z))), 0)::BIGINT AS a, len(m[i])::BIGINT AS k FROM x),
        f AS (SELECT doc_id, kind, ord, a, kind || ':' || a || ':' || (a + k) AS said FROM s WHERE n >= least),
        o AS (SELECT doc_id, {count}, string_agg(said, ',' ORDER BY a, ord) FILTER (ord < {len(op10_secrets.BASE_RULES)}) AS base, string_agg(said, ',' ORDER BY a, ord) AS spans FROM f GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
    """


def _urls_sql() -> str:
    rules = sorted(op11_urls.RULES, key=lambda r: (-len(r.text), r.text))
    fits = [f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')" for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules))
    parts = ", ".join(f"'{w}'" for w in op11_urls.UNWANTED)
    return rf"""
        WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{op11_urls.TRACKING}'))), '&') AS asked FROM r),
        c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)\z', '') AS name FROM h),
        k AS (SELECT page_id, host, path, CASE WHEN name <> '' THEN name || rtrim(path, '/') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS canonical FROM c),
        l AS (SELECT DISTINCT canonical AS on_list FROM k WHERE list_has_any(string_split_regex(host, '[.-]'), [{parts}]))
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN on_list IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, canonical, on_list IS NOT NULL AS listed
        FROM k LEFT JOIN l ON canonical = on_list
    """


def _fim_sql() -> str:
    p, s, m = op12_fim.PREFIX, op12_fim.SUFFIX, op12_fim.MIDDLE
    numbers = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{op12_fim.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, {numbers} FROM d),
        k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {op12_fim.TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {op12_fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || x || '{s}' || z || '{m}' || y ELSE '{s}' || z || '{p}' || x || '{m}' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM c
    """


ORACLES: dict[str, str] = {
    "op1_sharding": """
        SELECT doc_id, lang, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256,
            CAST(16 AS BIGINT) AS arrivals, true AS merged
        FROM documents
    """,
    "op10_secret_scan": _secrets_sql(),
    "op11_url_filter": _urls_sql(),
    "op12_fill_in_middle": _fim_sql(),
    "op13_hard_negatives": """
        WITH e AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT * FROM n WHERE rank <= 5
    """,
}
