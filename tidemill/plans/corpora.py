"""Queries over documents, benchmark and pages, each with its SQL where there is one; of our own scope like those in fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import contamination, copies, pages, private, quality
from tidemill.plans.fixtures import query
from tidemill.sources.tables import read

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
OVERLAPS = f"""WITH d AS (
    SELECT doc_id, {WORDS} AS ws FROM documents
), b AS (
    SELECT item_id, ws, least(8, len(ws)) AS size FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), entry AS (
    SELECT item_id, size, len(ws) AS words, pos, array_to_string(ws[pos + 1 : pos + size], ' ') AS gram FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS pos FROM b)
), held AS (
    SELECT DISTINCT doc_id, array_to_string(ws[pos + 1 : pos + size], ' ') AS gram
    FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS pos FROM d, (SELECT DISTINCT size FROM b) WHERE len(ws) >= size)
), known AS (
    SELECT doc_id, gram FROM held SEMI JOIN entry USING (gram)
), df AS (
    SELECT gram, count(*) AS df FROM known GROUP BY gram
), weighed AS (
    SELECT *, CAST(floor(1000.0::DOUBLE * ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE))) AS BIGINT) + 1 AS weight,
        row_number() OVER (PARTITION BY item_id, gram ORDER BY pos) = 1 AS fresh FROM entry LEFT JOIN df USING (gram)
), total AS (
    SELECT item_id, count(*) AS grams, sum(weight) AS total FROM weighed WHERE fresh GROUP BY item_id
), pair AS (
    SELECT doc_id, item_id, any_value(words) AS words, count(*) FILTER (fresh) AS hits, sum(weight) FILTER (fresh) AS weight,
        len(list_distinct(flatten(list(range(pos, pos + size))))) AS covered FROM known JOIN weighed USING (gram) GROUP BY ALL
)
SELECT doc_id, item_id, hits, grams, CAST(covered AS BIGINT) AS covered, CAST(words AS BIGINT) AS words,
    CAST(1000 * covered // words AS BIGINT) AS covered_milli, CAST(1000 * weight // total AS BIGINT) AS weight_milli FROM pair JOIN total USING (item_id)"""


@query(OVERLAPS)
def fx_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(f"""SELECT item_id, count(doc_id) AS n_docs, count(*) FILTER (covered_milli >= 500) AS n_contaminated, coalesce(max(covered_milli), 0) AS best_milli,
    min(doc_id) FILTER (covered_milli = best) AS first_doc
    FROM (SELECT item_id, o.*, max(covered_milli) OVER (PARTITION BY item_id) AS best FROM benchmark LEFT JOIN ({OVERLAPS}) o USING (item_id)) GROUP BY item_id""")
def fx_contaminated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.item_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, count(href) AS n_links, count(DISTINCT root || href) AS n_targets, count(href) FILTER (href LIKE '/%' AND href NOT LIKE '//%') AS n_internal FROM pages LEFT JOIN p USING (page_id) GROUP BY page_id""")
def fx_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.link_counts(read(spark, sf_dir, "pages"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS h, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)
    SELECT h AS from_host, h AS to_host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM p GROUP BY h""")
def fx_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.host_graph(read(spark, sf_dir, "pages"))


@query()
def fx_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.texts(read(spark, sf_dir, "pages"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def fx_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(read(spark, sf_dir, "documents"))


@query("SELECT d.* FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) USING (doc_id)")
def fx_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.first_of_each(read(spark, sf_dir, "documents"))


def _kind() -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{k}'" for k, p in private.PATTERNS.items()) + " END"


@query(f"""WITH m AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '{private.PATTERN}')) AS s FROM documents
), k AS (
    SELECT doc_id, s, {_kind()} AS kind, replace(replace(s, ' ', ''), '-', '') AS bare FROM m
), checked AS (
    SELECT doc_id, s, kind, CASE kind
        WHEN 'ip' THEN list_max([CAST(x AS INTEGER) FOR x IN string_split(s, '.')]) < 256
        WHEN 'card' THEN list_sum([CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) WHEN CAST(d AS INTEGER) > 4 THEN 2 * CAST(d AS INTEGER) - 9 ELSE 2 * CAST(d AS INTEGER) END
            FOR d, i IN list_reverse(string_split(bare, ''))]) % 10 = 0
        WHEN 'iban' THEN list_reduce(list_prepend(0, [CAST(CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END AS INTEGER) FOR c IN string_split(substr(bare, 5) || substr(bare, 1, 4), '')]),
            lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
        WHEN 'token' THEN regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')
            AND list_sum([-(len(list_filter(string_split(s, ''), lambda y: y = x)) / length(s)::DOUBLE) * log2(len(list_filter(string_split(s, ''), lambda y: y = x)) / length(s)::DOUBLE) FOR x IN list_distinct(string_split(s, ''))]) >= 3.0
        ELSE true END AS ok FROM k
)
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM checked WHERE ok GROUP BY doc_id, kind""")
def fx_private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.counts(read(spark, sf_dir, "documents"))


@query()
def fx_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
