"""The operators of this subpackage applied to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path
from recipeframe.llm.additive_quantisation import nearest
from recipeframe.llm.chat import SQL as CHAT_SQL
from recipeframe.llm.chat import rotate
from recipeframe.llm.context_mixing import score_texts
from recipeframe.llm.conversation_trie import SQL as TRIE_SQL
from recipeframe.llm.conversation_trie import conversation_trie
from recipeframe.llm.decontamination import find_contamination
from recipeframe.llm.licenses import scan as scan_licenses
from recipeframe.llm.mixing import TARGET_WEIGHTS, MixParameters, mix, with_domain
from recipeframe.llm.phrases import SQL as PHRASE_SQL
from recipeframe.llm.phrases import collocations
from recipeframe.llm.pii import report as report_pii
from recipeframe.llm.simhash import simhash_components
from recipeframe.llm.toxicity import fit as fit_toxicity
from recipeframe.llm.toxicity import score_texts as score_toxicity
from recipeframe.llm.toxicity import training_rows
from recipeframe.llm.url_filters import judge
from recipeframe.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    write_warc(pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload")), path)
    records = read_warc(spark, path)
    digest = F.coalesce(F.sha1("payload"), F.col("digest"))  # of the payload read; a revisit has its header's
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return records.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_pii(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(training_rows(docs, _table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages are the quality labels of the same ids: 0 is bad."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judge(_table(spark, sf_dir, "pages"), outcomes)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(_table(spark, sf_dir, "documents")), MixParameters(weights=TARGET_WEIGHTS))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_table(spark, sf_dir, "conversations"))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": op1_context_mixing,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_url_filters": op6_url_filters,
    "op7_mixing": op7_mixing,
    "op8_chat": op8_chat,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_licenses": op12_licenses,
    "op13_phrases": op13_phrases,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
        g AS (SELECT html, max(page_id) AS first, count(*) AS n FROM p WHERE b >= 1000 GROUP BY html)
        SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html AND p.b >= 1000
    """,
    "op8_chat": CHAT_SQL,
    "op11_conversation_trie": TRIE_SQL,
    "op13_phrases": PHRASE_SQL,
    "op6_url_filters": """
        WITH u AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), outcome AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
        h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
        h1 AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM h0),
        h2 AS (SELECT *, CASE WHEN len(l) >= 2 AND array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN 2 ELSE 1 END AS size FROM h1),
        h AS (SELECT host, n, k, array_to_string(l[-size:], '.') AS suffix, array_to_string(CASE WHEN len(l) <= size THEN l ELSE l[-size - 1:] END, '.') AS domain FROM h2),
        d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
        s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
        sums AS (
            SELECT level, CAST(sum(k) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n, count(*) AS g, CAST(sum(n * n) AS DOUBLE) AS nn, sum(CAST(k * k AS DOUBLE) / n) AS kk
            FROM (SELECT 'h' AS level, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s) WHERE n > 0 GROUP BY level
        ), r AS (SELECT *, k / n * (1 - k / n) AS noise, kk - n * (k / n) * (k / n) AS spread FROM sums),
        w AS (SELECT level, k, n, noise * (n - nn / n - (g - 1)) AS room, noise, spread, g FROM r),
        c AS (SELECT level, k, n, least(greatest(CASE WHEN room > 0 THEN (spread - (g - 1) * noise) / room ELSE 0.001 END, 0.001), 0.5) AS r FROM w),
        z AS (
            SELECT coalesce(max(CASE WHEN level = 's' THEN (1 - r) / r END), 1) AS ss, coalesce(max(CASE WHEN level = 'd' THEN (1 - r) / r END), 1) AS sd,
                   coalesce(max(CASE WHEN level = 'h' THEN (1 - r) / r END), 1) AS sh, (coalesce(max(k), 0) + 0.5) / (coalesce(max(n), 0) + 1) AS top FROM c
        ), sm AS (SELECT suffix, (k + ss * top) / (n + ss) AS m FROM s, z),
        dm AS (SELECT domain, (k + sd * m) / (n + sd) AS m FROM d JOIN sm USING (suffix), z),
        hm AS (SELECT host, (k + sh * m) / (n + sh) AS m, n + sh AS total FROM h JOIN dm USING (domain), z),
        ab AS (SELECT host, m * total AS a, total - m * total AS b FROM hm),
        -- the beta distribution below and above twice the rate of all pages: each integral is taken over a power of its variable, where it has no pole
        hb AS (
            SELECT host, list_sum(list_transform(range(4000), lambda i: pow(1 - pow((i + 0.5) / 4000 * pow(x, a), 1 / a), b - 1))) * pow(x, a) / a AS under,
                   list_sum(list_transform(range(4000), lambda i: pow(1 - pow((i + 0.5) / 4000 * pow(1 - x, b), 1 / b), a - 1))) * pow(1 - x, b) / b AS over, a, b, x
            FROM ab, (SELECT least(2 * top, 0.95) AS x FROM z)
        ),
        f AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM p
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN under <= 0.1 * (under + over) AND a >= x * (a + b) THEN 'block' ELSE 'allow' END AS verdict
        FROM f JOIN hb USING (host)
    """,
}
