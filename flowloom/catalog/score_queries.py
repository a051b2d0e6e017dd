"""Prediction metrics, voting, training history and forests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.catalog.registry import big, query, r6
from flowloom.operators import forest, metrics
from flowloom.operators import labels as L
from flowloom.operators.splits import split_global
from flowloom.session import staged, staging_path

P = ("predictions",)
N = 12

_SCORES = f"""WITH ids AS (SELECT unnest(range(0, {N})) AS class_id),
counts AS (SELECT class_id, (SELECT count(*) FROM predictions WHERE label = class_id AND pred = class_id) AS tp,
 (SELECT count(*) FROM predictions WHERE label <> class_id AND pred = class_id) AS fp,
 (SELECT count(*) FROM predictions WHERE label = class_id AND pred <> class_id) AS fn,
 (SELECT count(*) FROM predictions WHERE label <> class_id AND pred <> class_id) AS tn FROM ids),
pr AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
 CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM counts),
scores AS (SELECT *, recall AS tpr, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1 FROM pr)
"""


def _scores(q, num_classes=N):
    return metrics.class_scores(metrics.confusion(q.predictions()), num_classes)


def _round(df, *columns):
    return [r6(c).alias(c) for c in columns]


def _sql_round(*columns):
    return ", ".join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in columns)


@query("p23_confident_flag", "SELECT sample_id, confidence >= 0.9 AS is_confident FROM predictions", P)
def _(q):
    return q.predictions().select("sample_id", metrics.is_confident(0.9).alias("is_confident"))


@query(
    "j10_zero_filled_counts",
    f"SELECT i AS label_id, (SELECT count(*) FROM predictions WHERE label = i) AS n FROM (SELECT unnest(range(0, {N})) AS i) t",
    P,
)
def _(q):
    rows = q.predictions().select(F.col("label").alias("label_id"))
    return L.zero_filled_counts(rows, N).select(*big("label_id", "n"))


@query(
    "g20_class_weights",
    f"""SELECT i AS label_id, round(CASE WHEN n > 0 THEN total / ({N} * n) ELSE 1.0 END, 6) AS weight FROM (SELECT i, (SELECT count(*) FROM predictions WHERE label = i) AS n,
 CAST((SELECT count(*) FROM predictions) AS DOUBLE) AS total FROM (SELECT unnest(range(0, {N})) AS i) t) u""",
    P,
)
def _(q):
    rows = q.predictions().select(F.col("label").alias("label_id"))
    return L.class_weights(rows, N).select(*big("label_id"), r6("weight").alias("weight"))


@query(
    "g21_confusion_matrix",
    f"""SELECT l.i AS label, p.i AS pred, (SELECT count(*) FROM predictions x WHERE x.label = l.i AND x.pred = p.i) AS n
FROM (SELECT unnest(range(0, {N})) AS i) l, (SELECT unnest(range(0, {N})) AS i) p""",
    P,
)
def _(q):
    dense = metrics.confusion_dense(metrics.confusion(q.predictions()), N)
    return dense.select(*big("label", "pred", "n"))


@query(
    "g21_confusion_matrix_wide",
    "SELECT i AS label, "
    + ", ".join(
        f"(SELECT count(*) FROM predictions x WHERE x.label = i AND x.pred = {c}) AS pred_{c}" for c in range(N)
    )
    + f" FROM (SELECT unnest(range(0, {N})) AS i) t",
    P,
)
def _(q):
    wide = metrics.confusion_wide(metrics.confusion(q.predictions()), N)
    return wide.select(*big("label", *[f"pred_{c}" for c in range(N)]))


@query(
    "g21_confusion_matrix_thousand_classes",
    """WITH n AS (SELECT label, pred, count(*) AS n FROM many_classes GROUP BY label, pred),
cells AS (SELECT l.i AS label, p.i AS pred, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 1000)) AS i) l CROSS JOIN (SELECT unnest(range(0, 1000)) AS i) p LEFT JOIN n ON n.label = l.i AND n.pred = p.i)
SELECT label, string_agg(CAST(n AS VARCHAR), ',' ORDER BY pred) AS counts FROM cells GROUP BY label""",
    ("many_classes",),
)
def _(q):
    rows = metrics.confusion_rows(metrics.confusion(q.view("many_classes")), 1000)
    return rows.select(*big("label"), F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


@query("g22_outcome_counts", _SCORES + "SELECT class_id, tp, fp, fn, tn FROM scores", P)
def _(q):
    return _scores(q).select(*big("class_id", "tp", "fp", "fn", "tn"))


@query(
    "g23_precision_recall_f1",
    _SCORES + f"SELECT class_id, {_sql_round('precision', 'recall', 'f1')} FROM scores",
    P,
)
def _(q):
    s = _scores(q)
    return s.select(*big("class_id"), *_round(s, "precision", "recall", "f1"))


@query(
    "g24_tpr_fpr_support",
    _SCORES + f"SELECT class_id, {_sql_round('tpr', 'fpr')}, support FROM scores",
    P,
)
def _(q):
    s = _scores(q)
    return s.select(*big("class_id", "support"), *_round(s, "tpr", "fpr"))


@query(
    "g25_class_accuracy",
    _SCORES + "SELECT class_id, round(tp / (support + 1e-10), 6) AS class_accuracy FROM scores",
    P,
)
def _(q):
    s = _scores(q)
    return s.select(*big("class_id"), *_round(s, "class_accuracy"))


@query(
    "g26_accuracy",
    "SELECT round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM predictions",
    P,
)
def _(q):
    return metrics.accuracy(metrics.confusion(q.predictions())).select(r6("accuracy").alias("accuracy"))


_WEIGHTED = ", ".join(
    f'round(sum("{c}" * support) / sum(support), 6) AS weighted_{c}' for c in ("precision", "recall", "f1")
)
_MACRO = ", ".join(f'round(avg("{c}"), 6) AS macro_{c}' for c in ("precision", "recall", "f1"))


def _all_rounded(df):
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query("g27_weighted_scores", _SCORES + f"SELECT {_WEIGHTED} FROM scores", P)
def _(q):
    return _all_rounded(metrics.weighted_scores(_scores(q)))


@query("g28_macro_over_all_classes", _SCORES + f"SELECT {_MACRO} FROM scores", P)
def _(q):
    return _all_rounded(metrics.macro_scores(_scores(q)))


@query("g29_macro_over_present_classes", _SCORES + f"SELECT {_MACRO} FROM scores WHERE tp + fp + fn > 0", P)
def _(q):
    return _all_rounded(metrics.macro_scores(_scores(q, None)))


@query(
    "g30_weighted_rates",
    _SCORES
    + "SELECT round(sum(tpr * support) / sum(support), 6) AS tpr_avg, round(sum(fpr * support) / sum(support), 6) AS fpr_avg FROM scores",
    P,
)
def _(q):
    return _all_rounded(metrics.weighted_rates(_scores(q)))


@query("g31_ftf", _SCORES + "SELECT round(sum(support * tpr / (1 + fpr)) / sum(support), 6) AS ftf FROM scores", P)
def _(q):
    return _all_rounded(metrics.ftf(_scores(q)))


@query("g32_plain_rates", _SCORES + "SELECT round(avg(tpr), 6) AS tpr_avg, round(avg(fpr), 6) AS fpr_avg FROM scores", P)
def _(q):
    return _all_rounded(metrics.plain_rates(_scores(q)))


@query(
    "g26_g31_summary",
    _SCORES
    + f"""SELECT round(sum(tp) / sum(support), 6) AS accuracy, {_WEIGHTED}, {_MACRO}, round(sum(tpr * support) / sum(support), 6) AS tpr_avg,
 round(sum(fpr * support) / sum(support), 6) AS fpr_avg, round(sum(support * tpr / (1 + fpr)) / sum(support), 6) AS ftf FROM scores""",
    P,
)
def _(q):
    return _all_rounded(metrics.summary(metrics.confusion(q.predictions()), N))


_CONFIDENT = """round(CASE WHEN count(*) FILTER (WHERE confidence >= {t}) > 0 THEN
 count(*) FILTER (WHERE confidence >= {t} AND label = pred) / count(*) FILTER (WHERE confidence >= {t}) ELSE 0 END, 6) AS confidence_accuracy,
 round(count(*) FILTER (WHERE confidence >= {t}) / count(*), 6) AS confidence_ratio"""


@query("g33_confident_scores", f"SELECT {_CONFIDENT.format(t=0.9)} FROM predictions", P)
def _(q):
    return _all_rounded(metrics.confident_scores(q.predictions(), 0.9))


@query("g33_confident_scores_none", f"SELECT {_CONFIDENT.format(t=1.5)} FROM predictions", P)
def _(q):
    return _all_rounded(metrics.confident_scores(q.predictions(), 1.5))


@query(
    "g34_classification_report",
    _SCORES
    + """, rows_ AS (SELECT concat('Class_', CAST(class_id AS VARCHAR)) AS row_name, "precision", recall, f1, support FROM scores
 UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM scores
 UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support) FROM scores
 UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM scores)
"""
    + f"SELECT row_name, {_sql_round('precision', 'recall', 'f1')}, CAST(support AS BIGINT) AS support FROM rows_",
    P,
)
def _(q):
    r = metrics.report(metrics.confusion(q.predictions()), N)
    return r.select("row_name", *_round(r, "precision", "recall", "f1"), *big("support"))


@query(
    "j9_named_class_scores",
    _SCORES
    + """SELECT class_id, coalesce(n_name, concat('Class_', CAST(class_id AS VARCHAR))) AS class_name, support FROM scores
LEFT JOIN nation ON class_id = n_nationkey + 2""",
    P,
)
def _(q):
    key = (F.col("n_nationkey") + 2).alias("label_id")  # the first two classes have no name
    label_map = q.table("nation").select(key, F.col("n_name").alias("label"))
    named = metrics.named_scores(_scores(q), label_map)
    return named.select(*big("class_id", "support"), "class_name")


@query(
    "u7_scores_per_split",
    f"""SELECT split, count(*) AS n, round(avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, {_CONFIDENT.format(t=0.9)}
FROM predictions GROUP BY split""",
    P,
)
def _(q):
    s = metrics.split_scores(q.predictions())
    return s.select("split", *big("n"), *_round(s, "accuracy", "confidence_accuracy", "confidence_ratio"))


# --- voting ---

_VOTE = """SELECT sample_id, class_id AS pred, p AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, class_id) AS r FROM ({}) m) t WHERE r = 1"""


@query(
    "g35_soft_vote",
    _VOTE.format("SELECT sample_id, class_id, round(sum(prob) / 10, 9) AS p FROM votes GROUP BY sample_id, class_id"),
    ("votes",),
)
def _(q):
    return forest.soft_vote(q.votes(), 10).select(*big("sample_id", "pred"), F.round("confidence", 9).alias("confidence"))


@query(
    "g36_weighted_ensemble",
    _VOTE.format(
        """SELECT sample_id, class_id, round(sum(prob * CASE WHEN tree < 5 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END / 5), 9) AS p
FROM votes GROUP BY sample_id, class_id"""
    ),
    ("votes",),
)
def _(q):
    votes = q.votes()
    halves = [votes.filter(F.col("tree") < 5), votes.filter(F.col("tree") >= 5)]
    tables = [
        half.groupBy("sample_id", "class_id").agg((F.sum("prob") / 5).alias("prob")) for half in halves
    ]
    return forest.weighted_vote(*tables, 0.6).select(*big("sample_id", "pred"), F.round("confidence", 9).alias("confidence"))


@query(
    "g35_soft_vote_thousand_classes",
    _VOTE.format("SELECT sample_id, class_id, round(sum(prob) / 100, 9) AS p FROM many_votes GROUP BY sample_id, class_id"),
    ("many_votes",),
)
def _(q):
    best = forest.soft_vote_vectors(q.many_votes(), 100)
    return best.select(*big("sample_id", "pred"), F.round("confidence", 9).alias("confidence"))


@query(
    "g36_weighted_ensemble_thousand_classes",
    _VOTE.format(
        """SELECT sample_id, class_id, round(sum(prob * CASE WHEN tree = 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END), 9) AS p
FROM many_votes WHERE tree < 2 GROUP BY sample_id, class_id"""
    ),
    ("many_votes",),
)
def _(q):
    first, second = [q.many_votes().filter(F.col("tree") == t) for t in (0, 1)]
    best = forest.weighted_vote_vectors(first, second, 0.6)
    return best.select(*big("sample_id", "pred"), F.round("confidence", 9).alias("confidence"))


@query(
    "g37_mean_importance",
    "SELECT class_id AS feature, round(avg(prob), 6) AS importance FROM votes GROUP BY class_id",
    ("votes",),
)
def _(q):
    per_tree = q.votes().select("tree", F.col("class_id").alias("feature"), F.col("prob").alias("importance"))
    return forest.mean_importance(per_tree).select(*big("feature"), r6("importance").alias("importance"))


# --- history ---


@query(
    "g41_best_epoch",
    """SELECT run, epoch AS best_epoch, metric AS best FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS r FROM history WHERE NOT isnan(metric)) t WHERE r = 1""",
    ("history",),
)
def _(q):
    best = metrics.best_epochs(q.history())
    return best.select("run", *big("best_epoch"), r6("best").alias("best"))


@query(
    "w7_running_best",
    """SELECT run, epoch, NOT isnan(metric) AND metric > greatest(0, coalesce(max(CASE WHEN isnan(metric) THEN NULL ELSE metric END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_best FROM history""",
    ("history",),
)
def _(q):
    return metrics.running_best(q.history()).select("run", *big("epoch"), "is_best")


# --- forests: on a table in which one column decides the label, SQL can state the result ---

_COLUMNS = ["f0", "f1", "f2", "f3", "f4"]
_DECIDED = """WITH ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM decided) d),
placed AS (SELECT d.*, label_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(sample_id AS VARCHAR))), sample_id) AS rn, count(*) OVER () AS n FROM decided d JOIN ids ON d.label = ids.label),
rows_ AS (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed)
"""
_ALL_RIGHT = "count(*) AS n, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS confidence_accuracy, 1.0::DOUBLE AS confidence_ratio"


def _labelled(q):
    # every fitting pass reads the rows again
    return staged(split_global(L.encode_labels(q.view("decided"))), "decided")


def _split_scores(scores, *keys):
    return scores.select(*keys, *big("n"), *_round(scores, "accuracy", "confidence_accuracy", "confidence_ratio"))


@query(
    "m1_m2_forest_predictions",
    _DECIDED + "SELECT sample_id, label_id AS label, label_id AS pred, TRUE AS is_confident FROM rows_ WHERE split = 'test'",
    ("decided",),
)
def _(q):
    rows = _labelled(q)
    model = forest.fit_forest(rows.filter("split = 'train'"), _COLUMNS)
    held_out = rows.filter("split = 'test'")
    predicted = forest.predict(model, held_out, _COLUMNS, threshold=0.5)
    return predicted.select("sample_id", *big("label", "pred"), "is_confident")


@query("m3_saved_forest_scores", _DECIDED + f"SELECT split, {_ALL_RIGHT} FROM rows_ WHERE split <> 'train' GROUP BY split", ("decided",))
def _(q):
    rows = _labelled(q)
    path = staging_path(q.spark, "forest")
    forest.fit_forest(rows.filter("split = 'train'"), _COLUMNS).write().save(path)
    return _split_scores(forest.evaluate_saved(path, rows, _COLUMNS, threshold=0.5), "split")


@query(
    "m4_forests_per_dataset",
    _DECIDED + f"SELECT concat('domain', CAST(domain AS VARCHAR)) AS dataset, split, {_ALL_RIGHT} FROM rows_ WHERE split <> 'train' GROUP BY domain, split",
    ("decided",),
)
def _(q):
    rows = _labelled(q)
    halves = {f"domain{d}": rows.filter(F.col("domain") == d) for d in (0, 1)}
    return _split_scores(forest.train_and_score(halves, _COLUMNS, threshold=0.5), "dataset", "split")


@query(
    "t5_top_features",
    "SELECT concat('g', CAST(i AS VARCHAR)) AS feature, TRUE AS in_order FROM (SELECT unnest(range(0, 10)) AS i) t WHERE (SELECT count(*) FROM graded) > 0",
    ("graded",),
)
def _(q):
    """The ten of thirteen columns that follow the label, by descending importance."""
    columns = [f"g{k}" for k in range(10)] + [f"h{k}" for k in range(3)]
    rows = staged(split_global(L.encode_labels(q.view("graded"))), "graded")
    model = forest.fit_forest(rows.filter("split = 'train'"), columns)
    top = forest.top_features(forest.feature_importance(q.spark, model, columns))
    after = F.lead("importance").over(Window.orderBy(F.desc("importance"), "feature"))
    return top.select("feature", F.coalesce(F.col("importance") >= after, F.lit(True)).alias("in_order"))


@query(
    "g37_forest_importance",
    "SELECT feature, TRUE AS as_in_model FROM (VALUES ('f0'), ('f1'), ('f2'), ('f3'), ('f4')) v(feature)",
)
def _(q):
    model = forest.fit_forest(_labelled(q).filter("split = 'train'"), _COLUMNS)
    mean = forest.mean_importance(forest.tree_importance(q.spark, model, _COLUMNS)).withColumnRenamed("importance", "mean")
    both = mean.join(forest.feature_importance(q.spark, model, _COLUMNS), "feature")
    return both.select("feature", (F.abs(F.col("mean") - F.col("importance")) < 1e-9).alias("as_in_model"))
