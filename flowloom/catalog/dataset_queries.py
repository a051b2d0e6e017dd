"""Labels, class selection, joins, splits, merges and experiment assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.registry import big, flow_key_id, query, r6
from flowloom.functions import text as X
from flowloom.operators import corpus, flows, funnel, splits
from flowloom.operators import labels as L
from flowloom.operators.ranking import block_bucket, ranked
from flowloom.session import staged, staging_path
from flowloom.sources import captures as sources
from flowloom.sources import datasets
from flowloom.sources.commits import build_pending, completed_classes, read_committed, write_classes

S = ("samples",)


def _rows(df, *extra):
    return df.select("sample_id", *big("label_id"), *extra)


# --- captures and label joins ---


@query("g12_files_per_class", "SELECT label_id, count(*) AS n_files FROM captures GROUP BY label_id", ("captures",))
def _(q):
    return funnel.files_per_class(q.captures()).select(*big("label_id", "n_files"))


@query("s5_minimum_capture_size", "SELECT capture_id, length FROM captures WHERE length >= 20480", ("captures",))
def _(q):
    return sources.large_enough(q.captures(), 20480).select("capture_id", "length")


@query(
    "s4_page_types",
    """SELECT capture_id, regexp_extract(path, '/(batch|single)/([^/]+)/pcap/', 2) AS label,
 CASE WHEN path LIKE '%/batch/%' THEN 'aggregate' WHEN regexp_extract(path, '[^/]+$') LIKE '1\\_%' ESCAPE '\\' THEN 'homepage' ELSE 'subpage' END AS page_type
FROM captures""",
    ("captures",),
)
def _(q):
    return sources.with_page_types(q.captures()).select("capture_id", "label", "page_type")


@query(
    "s1_label_from_folder",
    "SELECT capture_id, split_part(path, '/', 3) AS label FROM captures WHERE lower(path) LIKE '%.pcap' OR lower(path) LIKE '%.pcapng'",
    ("captures",),
)
def _(q):
    files = q.captures().filter(X.is_capture_file(F.col("path")))
    return files.select("capture_id", X.first_level_label(F.col("path"), "/corpus").alias("label"))


@query(
    "s22_sample_tree_classes",
    """WITH parts AS (SELECT capture_id, split_part(path, '/', 4) AS split, split_part(path, '/', 5) AS label FROM captures)
SELECT p.*, c.label_id FROM parts p JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id
 FROM (SELECT DISTINCT label FROM parts) d) c ON p.label = c.label""",
    ("captures",),
)
def _(q):
    parsed = sources.parse_sample_paths(q.captures().drop("label_id"), ("pcap",))
    return parsed.select("capture_id", "split", "label", *big("label_id"))


@query(
    "p13_homepage_captures",
    "SELECT capture_id, split_part(path, '/', 6) LIKE '1$_%' ESCAPE '$' AS is_homepage FROM captures",
    ("captures",),
)
def _(q):
    return q.captures().select("capture_id", X.is_homepage(F.col("path")).alias("is_homepage"))


@query(
    "u6_all_sites",
    "SELECT DISTINCT regexp_extract(path, '/(batch|single)/([^/]+)/pcap/', 2) AS label FROM captures",
    ("captures",),
)
def _(q):
    return sources.all_sites(sources.with_page_types(q.captures()))


def _vocabulary(q):
    """Region names as class names from class 1 on; class 0 has none and takes the default."""
    return q.table("region").select((F.col("r_regionkey") + 1).alias("label_id"), F.col("r_name").alias("label"))


@query(
    "j1_captures_with_names",
    """SELECT capture_id, c.label_id, coalesce(r_name, concat('Unknown(', CAST(c.label_id AS VARCHAR), ')')) AS label
FROM captures c LEFT JOIN region ON c.label_id = r_regionkey + 1""",
    ("captures",),
)
def _(q):
    named = L.with_names(q.captures(), _vocabulary(q))
    return named.select("capture_id", *big("label_id"), "label")


@query(
    "j2_flows_with_labels",
    """SELECT flow_id, n, c.label_id FROM (SELECT flow_id, capture_id, count(*) AS n FROM flow_packets GROUP BY flow_id, capture_id) f
JOIN captures c ON f.capture_id = c.capture_id""",
    ("flow_packets", "captures"),
)
def _(q):
    sizes = flows.flow_sizes(q.keyed())
    labelled = sizes.join(q.captures().select("capture_id", "label_id"), "capture_id")
    return labelled.select(flow_key_id(), F.col("n_packets").alias("n"), *big("label_id"))


@query(
    "j7_captures_without_flows",
    """SELECT label_id, count(*) AS n_failed FROM captures
WHERE capture_id NOT IN (SELECT capture_id FROM flow_packets) GROUP BY label_id""",
    ("flow_packets", "captures"),
)
def _(q):
    failed = funnel.failed_per_class(q.captures(), flows.flow_sizes(q.keyed()))
    return failed.select(*big("label_id", "n_failed"))


@query(
    "t6_first_failed_captures",
    """SELECT capture_id, path FROM captures WHERE capture_id NOT IN (SELECT capture_id FROM flow_packets
 GROUP BY capture_id, flow_id HAVING count(*) >= 150) ORDER BY path LIMIT 5""",
    ("flow_packets", "captures"),
)
def _(q):
    return funnel.first_failures(q.captures(), flows.flow_sizes(q.keyed(), 150)).select("capture_id", "path")


@query(
    "j6_resume_without_completed",
    "SELECT sample_id, label FROM samples WHERE label NOT IN (SELECT label FROM samples GROUP BY label HAVING count(*) >= 15)",
    S,
)
def _(q):
    rows = q.samples()
    done = L.class_table(rows, ["label"]).filter("n >= 15")
    return L.not_completed(rows, done).select("sample_id", "label")


@query("j6_resume_after_interruption", "SELECT sample_id, label, n_chars FROM samples", S)
def _(q):
    """Built in three calls: one ends after two commits, one is lost before its manifest."""
    path, rows = staging_path(q.spark, "committed"), staged(q.samples(), "samples")
    build_pending(rows, lambda part: part, path, classes_per_commit=10, max_commits=2)
    left = L.not_completed(rows, completed_classes(q.spark, path))
    write_classes(L.first_labels(left, 5).withColumn("n_chars", F.lit(-1)), path)
    build_pending(rows, lambda part: part, path, classes_per_commit=25)
    return read_committed(q.spark, path).select("sample_id", "label", "n_chars")


# --- label text ---


@query("p16_safe_labels", "SELECT sample_id, replace(label, '/', '_') AS label FROM samples", S)
def _(q):
    return q.samples().select("sample_id", X.safe_label(F.col("label")).alias("label"))


@query(
    "p17_display_labels",
    """SELECT doc_id, CASE WHEN length(t) > 35 THEN concat(substr(t, 1, 32), '...') ELSE t END AS label
FROM (SELECT doc_id, concat(source, '/', repeat(lang, CAST(doc_id % 20 AS INT))) AS t FROM documents) d""",
)
def _(q):
    name = F.concat("source", F.lit("/"), F.repeat("lang", (F.col("doc_id") % 20).cast("int")))
    return q.table("documents").select("doc_id", X.display_label(name).alias("label"))


@query("p19_encoded_labels", "SELECT sample_id, label, label_id FROM samples", S)
def _(q):
    return q.samples().select("sample_id", "label", *big("label_id"))


def _defaults_sql():
    return """SELECT sample_id, concat('Unknown(', CAST(label_id AS VARCHAR), ')') AS unknown_name,
 concat('Class_', CAST(label_id AS VARCHAR)) AS class_name, CAST(label_id AS VARCHAR) AS id_name,
 concat('class_', CAST(label_id AS VARCHAR)) AS lower_name FROM samples"""


@query("p20_default_names", _defaults_sql(), S)
def _(q):
    missing = F.lit(None).cast("string")
    name = lambda style: X.label_or_default(missing, F.col("label_id"), style)
    return q.samples().select(
        "sample_id",
        name("Unknown({})").alias("unknown_name"),
        name("Class_{}").alias("class_name"),
        name("{}").alias("id_name"),
        name("class_{}").alias("lower_name"),
    )


@query(
    "p21_dataset_names",
    """SELECT doc_id, concat(regexp_replace(t, '(_unified_output_split|_output_split|_split)$', ''), '_top', CAST(doc_id % 7 AS VARCHAR), '_split') AS name
FROM (SELECT doc_id, concat(source, CASE doc_id % 4 WHEN 0 THEN '_unified_output_split' WHEN 1 THEN '_output_split' WHEN 2 THEN '_split' ELSE '' END) AS t FROM documents) d""",
)
def _(q):
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (*X.DATASET_SUFFIXES, "")]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    name = X.topk_dataset_name(F.concat("source", suffix), F.col("doc_id") % 7)
    return q.table("documents").select("doc_id", name.alias("name"))


# --- class tables ---


@query(
    "g13_class_distribution",
    "SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM samples GROUP BY label",
    S,
)
def _(q):
    d = L.distribution(q.samples(), ["label"])
    return d.select("label", *big("n"), r6("pct").alias("pct"))


@query(
    "p22_percent_of_total",
    "SELECT label_id, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM samples GROUP BY label_id",
    S,
)
def _(q):
    return L.distribution(q.samples()).select(*big("label_id"), r6("pct").alias("pct"))


@query("g42_number_of_classes", "SELECT max(label_id) + 1 AS num_classes FROM samples", S)
def _(q):
    return L.num_classes(q.samples()).select(*big("num_classes"))


_VALID = "SELECT label_id, row_number() OVER (ORDER BY label_id) - 1 AS new_id FROM (SELECT label_id FROM samples GROUP BY label_id HAVING count(*) >= {k}) v"


@query("w4_dense_ids", _VALID.format(k=10), S)
def _(q):
    return L.valid_classes(L.class_table(q.samples()), 10).select(*big("label_id", "new_id"))


@query(
    "w5_ids_by_size",
    "SELECT label_id, row_number() OVER (ORDER BY count(*) DESC, label_id) - 1 AS new_id FROM samples GROUP BY label_id",
    S,
)
def _(q):
    ranked = L.by_size(L.class_table(q.samples()))
    return ranked.select(*big("label_id"), (F.col("size_rank") - 1).cast("bigint").alias("new_id"))


@query(
    "j3_relabelled_samples",
    f"SELECT s.sample_id, v.new_id AS label_id FROM samples s JOIN ({_VALID.format(k=10)}) v ON s.label_id = v.label_id",
    S,
)
def _(q):
    return _rows(L.drop_small_classes(q.samples(), 10))


@query(
    "j5_samples_of_valid_classes",
    "SELECT sample_id, label_id FROM samples WHERE label_id IN (SELECT label_id FROM samples GROUP BY label_id HAVING count(*) >= 12)",
    S,
)
def _(q):
    rows = q.samples()
    return _rows(L.keep_valid(rows, L.class_table(rows), 12))


@query(
    "j5_removed_classes",
    "SELECT label_id, min(label) AS label FROM samples GROUP BY label_id HAVING count(*) < 12",
    S,
)
def _(q):
    rows = q.samples()
    classes = L.class_table(rows, ["label_id", "label"])
    return L.removed_classes(classes.select("label_id", "label"), classes, 12).select(*big("label_id"), "label")


_RANKED = "SELECT label_id, n, row_number() OVER (ORDER BY n DESC, label_id) AS r FROM (SELECT label_id, count(*) AS n FROM samples GROUP BY label_id HAVING count(*) >= {m}) c"


@query(
    "t1_top10_classes",
    f"SELECT s.sample_id, r - 1 AS label_id FROM samples s JOIN ({_RANKED.format(m=5)}) k ON s.label_id = k.label_id WHERE r <= 10",
    S,
)
def _(q):
    return _rows(L.top_k(q.samples(), 10, 5))


@query(
    "t3_top_many",
    f"""SELECT s.sample_id, r - 1 AS label_id, top_k FROM samples s JOIN ({_RANKED.format(m=0)}) k ON s.label_id = k.label_id,
 (SELECT CAST(unnest([10, 50, 100, 500, 1000]) AS BIGINT) AS top_k) ks WHERE r <= top_k""",
    S,
)
def _(q):
    return _rows(L.top_k_many(q.samples(), [10, 50, 100, 500, 1000]), *big("top_k"))


@query(
    "t4_first_labels",
    "SELECT sample_id, label FROM samples WHERE label IN (SELECT DISTINCT label FROM samples ORDER BY label LIMIT 25)",
    S,
)
def _(q):
    return L.first_labels(q.samples(), 25).select("sample_id", "label")


# --- splits ---

_ASSIGN = """CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"""


@query(
    "w6_position_in_class",
    "SELECT sample_id, row_number() OVER (PARTITION BY label_id ORDER BY sample_id) AS pos, count(*) OVER (PARTITION BY label_id) AS class_size FROM samples",
    S,
)
def _(q):
    numbered = ranked(q.samples(), ["label_id"], ["sample_id"], block_bucket("sample_id", 64), "pos", "class_size")
    return numbered.select("sample_id", *big("pos", "class_size"))


@query(
    "p24_valid_ratios",
    """SELECT l_returnflag, abs(0.9::DOUBLE + l_discount + l_tax - 1.0::DOUBLE) < 0.000001::DOUBLE AS valid, count(*) AS n
FROM (SELECT l_returnflag, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem) t GROUP BY ALL""",
)
def _(q):
    ratios = F.lit(0.9), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    checked = q.table("lineitem").select("l_returnflag", splits.valid_ratios(*ratios).alias("valid"))
    return checked.groupBy("l_returnflag", "valid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x1_global_split",
    f"SELECT sample_id, {_ASSIGN} AS split FROM (SELECT *, row_number() OVER (ORDER BY order_key, sample_id) AS rn, count(*) OVER () AS n FROM samples) t",
    S,
)
def _(q):
    return splits.split_global(q.samples()).select("sample_id", "split")


_X2 = f"""SELECT sample_id, new_id AS label_id, {_ASSIGN} AS split FROM (SELECT s.*, v.new_id, row_number() OVER (PARTITION BY s.label_id ORDER BY order_key, sample_id) AS rn,
 count(*) OVER (PARTITION BY s.label_id) AS n FROM samples s JOIN ({_VALID.format(k=10)}) v ON s.label_id = v.label_id) t"""


@query("x2_per_class_split", _X2, S)
def _(q):
    return _rows(splits.split_per_class(q.samples()), "split")


@query(
    "x3_per_class_split_seeded",
    f"""SELECT sample_id, label_id, {_ASSIGN} AS split FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5(concat(CAST(42 + label_id AS VARCHAR), ':', CAST(sample_id AS VARCHAR))), sample_id) AS rn,
 count(*) OVER (PARTITION BY label_id) AS n FROM samples) t WHERE n >= 10""",
    S,
)
def _(q):
    return _rows(splits.split_per_class_seeded(q.samples()), "split")


@query(
    "x4_sequential_split",
    f"SELECT sample_id, label_id, {_ASSIGN} AS split FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY sample_id) AS rn, count(*) OVER (PARTITION BY label_id) AS n FROM samples) t",
    S,
)
def _(q):
    return _rows(splits.split_sequential(q.samples()), "split")


_QUOTA = """WITH c AS (SELECT label_id, count(*) AS n FROM samples GROUP BY label_id),
h AS (SELECT *, ceil(round(sum(n) OVER () * (0.1::DOUBLE + 0.1::DOUBLE), 9)) AS held, sum(n) OVER () AS total FROM c),
a AS (SELECT *, CAST(n AS DOUBLE) / total * (total - held) AS share FROM h),
b AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label_id) AS place, total - held - sum(floor(share)) OVER () AS missing FROM a),
d AS (SELECT label_id, n, held, fl + CASE WHEN place <= missing THEN 1 ELSE 0 END AS n_train FROM b),
e AS (SELECT *, n - n_train AS rest, held - ceil(round(held * (1 - 0.1::DOUBLE / (0.1::DOUBLE + 0.1::DOUBLE)), 9)) AS val_total FROM d),
f AS (SELECT *, rest / sum(rest) OVER () * val_total AS share FROM e),
g AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, label_id) AS place, val_total - sum(floor(share)) OVER () AS missing FROM f),
quota AS (SELECT label_id, n, n_train, fl + CASE WHEN place <= missing THEN 1 ELSE 0 END AS n_val FROM g)
"""


@query(
    "x5_stratified_quotas",
    _QUOTA + "SELECT label_id, n, CAST(n_train AS BIGINT) AS n_train, CAST(n_val AS BIGINT) AS n_val FROM quota",
    S,
)
def _(q):
    quotas = splits.stratified_quotas(L.class_table(q.samples()), 0.1, 0.1)
    return quotas.select(*big("label_id", "n", "n_train", "n_val"))


@query(
    "x5_stratified_split",
    _QUOTA
    + """SELECT sample_id, s.label_id, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY order_key, sample_id) AS rn FROM samples) s JOIN quota k ON s.label_id = k.label_id""",
    S,
)
def _(q):
    return _rows(splits.split_stratified(q.samples()), "split")


@query(
    "x6_test_first_split",
    "SELECT sample_id, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY order_key, sample_id) AS rn, count(*) OVER () AS n FROM samples) t",
    S,
)
def _(q):
    return splits.split_test_first(q.samples()).select("sample_id", "split")


@query(
    "x10_discarded_tenth",
    f"""SELECT sample_id, label_id FROM (SELECT sample_id, label_id, {_ASSIGN} AS split FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY sample_id) AS rn, count(*) OVER (PARTITION BY label_id) AS n FROM samples) t) u
WHERE split <> 'test'""",
    S,
)
def _(q):
    return _rows(splits.split_sequential(q.samples()).filter("split <> 'test'"))


@query(
    "g39_split_statistics",
    f"SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM ({_X2}) x GROUP BY split",
    S,
)
def _(q):
    stats = splits.split_statistics(splits.split_per_class(q.samples()))
    return stats.select("split", *big("n"), r6("pct").alias("pct"))


@query(
    "t2_top_classes_by_val",
    f"""WITH sp AS (SELECT s.label, x.* FROM ({_X2}) x JOIN samples s ON x.sample_id = s.sample_id),
k AS (SELECT label_id, label, row_number() OVER (ORDER BY count(*) DESC, label_id) AS r FROM sp WHERE split = 'val' GROUP BY label_id, label),
m AS (SELECT label_id, row_number() OVER (ORDER BY label) - 1 AS new_id FROM k WHERE r <= 10)
SELECT sample_id, split, new_id AS label_id FROM sp JOIN m ON sp.label_id = m.label_id""",
    S,
)
def _(q):
    return _rows(L.top_k_by_split(splits.split_per_class(q.samples()), 10), "split")


# --- corpora ---

_A, _B = ("corpus_a",), ("corpus_b",)
_AB = ("corpus_a", "corpus_b")


@query("u1_all_pages", "SELECT sample_id, page_type FROM corpus_b WHERE page_type IN ('homepage', 'subpage')", _B)
def _(q):
    return corpus.all_pages(q.corpus("b")).select("sample_id", "page_type")


def _merge_sources(q):
    docs = q.table("documents").select(
        F.col("doc_id").alias("sample_id"), "lang", F.col("source").alias("label")
    )
    split = staged(splits.split_sequential(L.encode_labels(docs)).drop("label_id"), "split")
    half = F.col("sample_id") % 2
    return {
        "web": split.filter(half == 0).drop("lang"),
        "app": split.filter(half == 1).drop("lang"),
    }


_MERGED = f"""WITH base AS (SELECT sample_id, source AS label, {_ASSIGN} AS split FROM (SELECT doc_id AS sample_id, source,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) t),
parts AS (SELECT sample_id, split, CASE WHEN sample_id % 2 = 0 THEN 'web' ELSE 'app' END AS source_dataset, CASE WHEN sample_id % 2 = 0 THEN 0 ELSE 1 END AS pos, label AS source_label FROM base),
picked AS (SELECT *, concat(source_dataset, '_', source_label) AS label FROM parts WHERE {{condition}}),
ids AS (SELECT label, row_number() OVER (ORDER BY pos, source_label) - 1 AS label_id FROM (SELECT DISTINCT pos, source_label, label FROM picked) d)
"""
_MERGED_ROWS = "SELECT sample_id, p.label, label_id, source_dataset, source_label FROM picked p JOIN ids ON p.label = ids.label"


@query("u2_merged_datasets_train", _MERGED.format(condition="split = 'train'") + _MERGED_ROWS)
def _(q):
    merged = corpus.merge_datasets(_merge_sources(q))
    return _rows(merged, "label", "source_dataset", "source_label")


@query("u2_merged_datasets_full", _MERGED.format(condition="TRUE") + _MERGED_ROWS)
def _(q):
    merged = corpus.merge_datasets(_merge_sources(q), full=True)
    return _rows(merged, "label", "source_dataset", "source_label")


@query(
    "g38_merge_statistics",
    _MERGED.format(condition="split = 'train'")
    + """SELECT source_dataset, count(DISTINCT label) AS n_classes, count(*) AS n_samples,
 round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM picked GROUP BY source_dataset""",
)
def _(q):
    stats = corpus.merge_statistics(corpus.merge_datasets(_merge_sources(q)))
    return stats.select("source_dataset", *big("n_classes", "n_samples"), r6("pct").alias("pct"))


@query(
    "u3_label_union",
    "SELECT label FROM corpus_a UNION SELECT label FROM corpus_b",
    _AB,
)
def _(q):
    return corpus.label_union(q.corpus("a"), q.corpus("b"))


@query("u4_rejoined_splits", "SELECT sample_id, label_id FROM samples", S)
def _(q):
    split = staged(splits.split_sequential(q.samples()), "split")
    parts = {name: split.filter(F.col("split") == name).drop("split") for name in datasets.SPLITS}
    return _rows(datasets.combine_splits(parts))


@query(
    "u5_cross_domain_test_set",
    "SELECT sample_id, label, page_type FROM corpus_b WHERE page_type = 'subpage' UNION ALL SELECT sample_id, label, page_type FROM corpus_a",
    _AB,
)
def _(q):
    subpages = q.corpus("b").filter("page_type = 'subpage'")
    return corpus.union_all([subpages, q.corpus("a")]).select("sample_id", "label", "page_type")


_UNIFIED = "u AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT label FROM corpus_a UNION SELECT label FROM corpus_b) d)"


@query(
    "j4_aligned_labels",
    f"""WITH {_UNIFIED}
SELECT u.label, u.label_id AS unified_id, coalesce(b.label_id, -1) AS b_id, coalesce(a.label_id, -1) AS a_id FROM u
LEFT JOIN label_map_b b ON u.label = b.label LEFT JOIN label_map_a a ON u.label = a.label""",
    ("corpus_a", "corpus_b", "label_map_a", "label_map_b"),
)
def _(q):
    aligned = corpus.align_labels(q.label_map("b"), q.label_map("a"))
    return aligned.fillna({"a_id": -1, "b_id": -1}).select("label", *big("unified_id", "b_id", "a_id"))


def _experiment_sql(train_rows, order, test_rows):
    return f"""WITH {_UNIFIED},
train AS (SELECT sample_id, label, {_ASSIGN} AS split FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS rn,
 count(*) OVER (PARTITION BY label) AS n FROM corpus_b WHERE {train_rows}) t),
rows_ AS (SELECT * FROM train WHERE split <> 'test' UNION ALL SELECT sample_id, label, 'test' AS split FROM ({test_rows}) x)
SELECT sample_id, u.label_id, split FROM rows_ r JOIN u ON r.label = u.label"""


@query(
    "x7_homepage_experiment",
    _experiment_sql(
        "page_type = 'homepage'",
        "sample_id",
        "SELECT sample_id, label FROM corpus_b WHERE page_type = 'subpage' UNION ALL SELECT sample_id, label FROM corpus_a",
    ),
    _AB,
)
def _(q):
    return _rows(corpus.homepage_experiment(q.corpus("b"), q.corpus("a")), "split")


@query(
    "x8_all_pages_experiment",
    _experiment_sql(
        "TRUE",
        "CASE WHEN page_type = 'homepage' THEN 0 ELSE 1 END, sample_id",
        "SELECT sample_id, label FROM corpus_a",
    ),
    _AB,
)
def _(q):
    return _rows(corpus.all_pages_experiment(q.corpus("b"), q.corpus("a")), "split")


@query(
    "x9_aggregate_experiment",
    f"""WITH ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM corpus_a) d)
SELECT sample_id, label_id, {_ASSIGN} AS split FROM (SELECT c.*, label_id, row_number() OVER (PARTITION BY c.label ORDER BY sample_id) AS rn,
 count(*) OVER (PARTITION BY c.label) AS n FROM corpus_a c JOIN ids ON c.label = ids.label) t""",
    _A,
)
def _(q):
    return _rows(corpus.aggregate_experiment(q.corpus("a")), "split")


@query(
    "g43_page_type_counts",
    "SELECT page_type, count(*) AS n FROM (SELECT page_type FROM corpus_b UNION ALL SELECT page_type FROM corpus_a) t GROUP BY page_type",
    _AB,
)
def _(q):
    both = corpus.union_all([q.corpus("b"), q.corpus("a")])
    return corpus.page_type_counts(both).select("page_type", *big("n"))
