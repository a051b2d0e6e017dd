"""Registered queries of this subpackage and the SQL some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import table
from flowloom.llm.decontamination import contaminated
from flowloom.llm.html_text import extract_text
from flowloom.llm.language_id import identify_languages, learn_languages
from flowloom.llm.lexical_search import search
from flowloom.llm.near_dedup import near_duplicates
from flowloom.llm.packing import pack_documents
from flowloom.llm.quality import fit_quality, score_quality
from flowloom.llm.source_mix import mix_sources
from flowloom.llm.token_counts import prefix_counts
from flowloom.llm.toxicity import fit_toxicity, grade_toxicity
from flowloom.llm.url_filter import judge_pages
from flowloom.llm.vector_codes import compress_vectors
from flowloom.llm.vector_neighbours import near_vectors
from flowloom.session import configure

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    def run(spark: SparkSession, root: str) -> DataFrame:
        configure(spark)
        return fn(spark, root)

    QUERIES[fn.__name__] = run
    return fn


@_register
def op4_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return judge_pages(table(spark, root, "pages"))


@_register
def op5_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(table(spark, root, "documents"))


@_register
def op9_embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_vectors(table(spark, root, "embeddings"))


@_register
def op2_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack_documents(table(spark, root, "documents"))


@_register
def op3_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return grade_toxicity(docs, fit_toxicity(docs, table(spark, root, "labels")))


@_register
def op7_token_counts(spark: SparkSession, root: str) -> DataFrame:
    return prefix_counts(table(spark, root, "documents"), keep_steps=False)


@_register
def op8_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, root, "labels")))


@_register
def op10_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return identify_languages(docs, learn_languages(docs))


@_register
def op1_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    return extract_text(table(spark, root, "pages"))


@_register
def op6_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))


@_register
def url_filter_planted_aliases(spark: SparkSession, root: str) -> DataFrame:
    """The pages with canonical links planted, as the tables have none: each page names the
    first of its seven as its canonical one, so that decisions spread over components."""
    pages = table(spark, root, "pages")
    first = pages.select(F.col("page_id").alias("_first"), F.col("url").alias("_url")).where("_first % 7 = 0")
    led = pages.join(first, F.col("page_id") - F.col("page_id") % 7 == F.col("_first"), "left")
    link = F.concat(F.lit('<link rel="canonical" href="'), "_url", F.lit('">'))
    return judge_pages(led.select("page_id", "url", F.concat(F.coalesce(link, F.lit("")), "html").alias("html")))


@_register
def op11_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(table(spark, root, "documents"))


@_register
def op12_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    return compress_vectors(table(spark, root, "embeddings"))


@_register
def op13_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    return search(table(spark, root, "documents"), table(spark, root, "benchmark"))


# --- SQL, where it can state the result ------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# smallest name reachable over edges(a, b) that hold both directions
_REACH = """reach(n, m) AS (SELECT a, b FROM edges UNION SELECT reach.n, edges.b FROM reach JOIN edges ON reach.m = edges.a)"""

ORACLES["op4_url_filter"] = rf"""WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags AS (SELECT page_id, url, regexp_extract(html, '(?is)<link[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS canon,
 regexp_extract(html, '(?is)<meta[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS meta FROM pages),
links AS (SELECT page_id, url, 0 AS kind, replace(regexp_extract(canon, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS link FROM tags
 UNION ALL SELECT page_id, url, 1, replace(regexp_extract(meta, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '&amp;', '&') FROM tags),
targets AS (SELECT url, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN concat(regexp_extract(url, '(?s)^(.*?)://', 1), ':', link)
  WHEN starts_with(link, '/') THEN concat(regexp_extract(url, '(?s)^(.*?)://[^/?#]*', 0), link) END AS target FROM links),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT DISTINCT target FROM targets),
parts AS (SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1) AS query FROM urls),
judged AS (SELECT url, host, path, CASE WHEN host <> '' THEN concat(host, CASE WHEN path = '' THEN '/' ELSE path END, query) END AS node,
 (SELECT concat(rh, rp) FROM rules WHERE (host = rh OR ends_with(host, concat('.', rh))) AND starts_with(path, rp) ORDER BY length(concat(rh, rp)) DESC LIMIT 1) AS rule,
 (SELECT v FROM rules WHERE (host = rh OR ends_with(host, concat('.', rh))) AND starts_with(path, rp) ORDER BY length(concat(rh, rp)) DESC LIMIT 1) AS v FROM parts),
pairs AS (SELECT a.node AS a, b.node AS b FROM targets t JOIN judged a ON t.url = a.url JOIN judged b ON t.target = b.url WHERE a.node <> b.node),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), {_REACH},
spread AS (SELECT n, bool_or(j.v = 'block') AND NOT coalesce(bool_or(j.v = 'allow'), FALSE) AS blocked FROM reach JOIN judged j ON m = j.node GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN judged ON pages.url = judged.url LEFT JOIN spread ON node = n"""

ORACLES["url_filter_planted_aliases"] = (
    ORACLES["op4_url_filter"]
    .replace("FROM pages", "FROM planted")
    .replace("pages.url", "planted.url")
    .replace(
        "tags AS (",
        """planted AS (SELECT p.page_id, p.url, concat(CASE WHEN f.url IS NULL THEN '' ELSE concat('<link rel="canonical" href="', f.url, '">') END, p.html) AS html
 FROM pages p LEFT JOIN (SELECT page_id AS fid, url FROM pages WHERE page_id % 7 = 0) f ON p.page_id - p.page_id % 7 = f.fid),
tags AS (""",
        1,
    )
)

ORACLES["op5_minhash_near_dedup"] = rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
kinds AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets) t WHERE len(s) > 0 GROUP BY s),
held AS (SELECT rep, len(s) AS size, unnest(s) AS x FROM kinds),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.size) + any_value(b.size) AS both_, count(*) AS inter FROM held a JOIN held b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep),
pairs AS (SELECT a, b FROM shared WHERE 100 * inter >= 75 * (both_ - inter)),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), {_REACH},
least_ AS (SELECT n, min(m) AS m FROM reach GROUP BY n),
named AS (SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(rep, s.doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets) s LEFT JOIN kinds ON s.s = kinds.s)
SELECT doc_id, n_shingles, least(rep, coalesce(m, rep)) AS component_id, doc_id = least(rep, coalesce(m, rep)) AS kept FROM named LEFT JOIN least_ ON rep = n"""

ORACLES["op9_embedding_near_dedup"] = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_REACH}, least_ AS (SELECT n, min(m) AS m FROM reach GROUP BY n), counted AS (SELECT a, count(*) AS links FROM edges GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least_ ON vec_id = n LEFT JOIN counted ON vec_id = a"""


def _assigned(round_: int) -> str:
    """Every part with the nearest entry of the codebooks of a round."""
    return f"""a{round_} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min({{'d': list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 'e': e}}) AS best
 FROM parts JOIN b{round_} USING (p) GROUP BY r, p)"""


def _averaged(round_: int) -> str:
    """Codebooks of the next round."""
    return f"""m{round_} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best.e AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS m
 FROM a{round_}, range(1, len(v) + 1) t(i) GROUP BY p, best.e, i) GROUP BY p, e),
b{round_ + 1} AS MATERIALIZED (SELECT b{round_}.p, b{round_}.e, coalesce(m{round_}.c, b{round_}.c) AS c FROM b{round_} LEFT JOIN m{round_} USING (p, e))"""


ORACLES["op12_vector_codes"] = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, q[1 + p * (len(q) // 16) : (p + 1) * (len(q) // 16)] AS v FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64),
{_assigned(0)}, {_averaged(0)}, {_assigned(1)}, {_averaged(1)}, {_assigned(2)},
coded AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM kept JOIN coded USING (r)"""

ORACLES["op13_lexical_search"] = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sizes AS (SELECT r, doc_id, len(ts) AS n_terms FROM d WHERE len(ts) > 0), held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
whole AS (SELECT count(*) AS docs, CAST(sum(n_terms) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), whole),
wanted AS (SELECT DISTINCT item_id, text, t FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)),
scored AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n_terms * docs) // terms))))) AS BIGINT) AS score
 FROM wanted JOIN weights USING (t) JOIN held USING (t) JOIN sizes USING (r), whole GROUP BY item_id, text, r, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 10"""
