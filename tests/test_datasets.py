"""Splits, class selection, metrics and image round trips as properties."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowloom.catalog import registry
from flowloom.functions import images as I
from flowloom.functions import sequences as S
from flowloom.functions import text as X
from flowloom.operators import corpus, forest, metrics, scaling, splits
from flowloom.operators import labels as L
from flowloom.session import staged, staging_root
from flowloom.sources import commits, datasets, logs


@pytest.fixture(scope="module")
def samples(spark):
    """1000 samples; class 0 holds a third, class 9 only three."""
    ids = spark.range(1000).withColumnRenamed("id", "sample_id")
    label = (
        F.when(F.col("sample_id") < 3, 9)
        .when(F.col("sample_id") % 3 == 0, 0)
        .otherwise(F.col("sample_id") % 5 + 1)
    )
    return ids.withColumn("label_id", label.cast("bigint")).withColumn(
        "label", F.concat(F.lit("c"), F.col("label_id"))
    ).cache()


def sizes(df, *keys):
    return {tuple(r[k] for k in keys): r["count"] for r in df.groupBy(*keys).count().collect()}


@pytest.mark.parametrize(
    "split",
    [
        splits.split_global,
        splits.split_sequential,
        splits.split_stratified,
        splits.split_test_first,
        splits.split_per_class_seeded,
        splits.split_per_class,
    ],
)
def test_splits_are_disjoint_and_complete(samples, split):
    out = split(samples)
    ids = [r.sample_id for r in out.select("sample_id").collect()]
    assert len(ids) == len(set(ids))
    dropped = 3 if split in (splits.split_per_class, splits.split_per_class_seeded) else 0
    assert len(ids) == 1000 - dropped
    again = {r.sample_id: r.split for r in split(samples).collect()}
    assert again == {r.sample_id: r.split for r in out.collect()}


def test_split_sizes(samples):
    assert sizes(splits.split_global(samples), "split") == {("train",): 800, ("val",): 100, ("test",): 100}
    assert sizes(splits.split_test_first(samples), "split") == {("test",): 100, ("train",): 900}
    per_class = sizes(samples, "label_id")
    for (label, split), n in sizes(splits.split_sequential(samples), "label_id", "split").items():
        size = per_class[(label,)]
        parts = {"train": int(size * 0.8), "val": int(size * 0.1)}
        parts["test"] = size - parts["train"] - parts["val"]
        assert n == parts[split]
    stratified = sizes(splits.split_stratified(samples), "split")
    assert stratified == {("train",): 800, ("val",): 100, ("test",): 100}


def test_sequential_split_keeps_order(samples):
    out = splits.split_sequential(samples)
    ends = out.groupBy("label_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("sample_id"))).alias("train"),
        F.min(F.when(F.col("split") == "test", F.col("sample_id"))).alias("test"),
    )
    assert all(r.train is None or r.test is None or r.train < r.test for r in ends.collect())


def test_ratio_check():
    with pytest.raises(ValueError):
        splits.check_ratios(0.8, 0.1, 0.2)
    splits.check_ratios(0.8, 0.1, 0.1)
    assert splits.required_class_size(3, 0.8, 0.1, 0.1) == 30


def test_class_selection(samples):
    small_gone = L.drop_small_classes(samples, 10)
    assert sorted({r.label_id for r in small_gone.select("label_id").distinct().collect()}) == list(range(6))
    top = L.top_k(samples, 2)
    assert {(r.label, r.label_id) for r in top.select("label", "label_id").distinct().collect()} >= {("c0", 0)}
    removed = L.removed_classes(
        L.class_skeleton(samples.sparkSession, 11), L.class_table(samples), 10
    )
    assert sorted(r.label_id for r in removed.collect()) == [6, 7, 8, 9, 10]
    weights = {r.label_id: r.weight for r in L.class_weights(samples, 8).collect()}
    assert weights[7] == 1.0 and weights[9 - 3] == 1.0
    n0 = sizes(samples, "label_id")[(0,)]
    assert weights[0] == pytest.approx(997 / (8 * n0))


def test_merge_keeps_counts(samples):
    merged = corpus.merge_datasets({"x": samples, "y": samples.filter("label_id < 3")}, full=True)
    assert merged.count() == 1000 + samples.filter("label_id < 3").count()
    ids = {(r.label, r.label_id) for r in merged.select("label", "label_id").distinct().collect()}
    assert ("x_c0", 0) in ids and len(ids) == 7 + 3 and {i for _, i in ids} == set(range(10))


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 5, 400)
    pred = np.where(rng.random(400) < 0.7, label, rng.integers(0, 6, 400))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(label, pred)], "label bigint, pred bigint")
    counts = metrics.confusion(rows)
    assert counts.agg(F.sum("n")).first()[0] == 400
    got = {r.class_id: r for r in metrics.class_scores(counts, 7).collect()}
    ftf = 0.0
    for c in range(7):
        tp = int(((label == c) & (pred == c)).sum())
        fp = int(((label != c) & (pred == c)).sum())
        fn = int(((label == c) & (pred != c)).sum())
        tn = 400 - tp - fp - fn
        assert (got[c].tp, got[c].fp, got[c].fn, got[c].tn) == (tp, fp, fn, tn)
        tpr = tp / (tp + fn) if tp + fn else 0.0
        fpr = fp / (fp + tn) if fp + tn else 0.0
        ftf += (tp + fn) / 400 * tpr / (1 + fpr)
    one = metrics.summary(counts, 7).first()
    assert one.accuracy == pytest.approx((label == pred).mean())
    assert one.ftf == pytest.approx(ftf)
    assert metrics.confusion_dense(counts, 7).count() == 49


def test_vote_tie_goes_to_the_lower_class(spark):
    votes = spark.createDataFrame(
        [(1, 4, 0.5), (1, 2, 0.5), (1, 4, 0.25), (1, 2, 0.25)], "sample_id bigint, class_id bigint, prob double"
    )
    (row,) = forest.soft_vote(votes, 2).collect()
    assert (row.pred, row.confidence) == (2, 0.375)


def test_patches_round_trip(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, 1600, dtype=np.uint8)
    df = spark.createDataFrame([(1, bytearray(image.tobytes()))], "id bigint, image binary")
    row = df.select(
        I.patches(F.col("image")).alias("patches"),
        I.image_from_patches(I.patches(F.col("image"))).alias("back"),
        I.pixels(F.col("image")).alias("pixels"),
    ).first()
    assert bytes(row.back) == image.tobytes()
    assert row.pixels == image.tolist()
    square = image.reshape(40, 40)
    expected = square.reshape(20, 2, 20, 2).transpose(0, 2, 1, 3).reshape(400, 4)
    assert [list(p) for p in map(bytes, row.patches)] == expected.tolist()


@pytest.mark.parametrize("ratio,keep", [(0.9, 39), (0.75, 100), (0.5, 200)])
def test_patch_mask(spark, ratio, keep):
    assert I.kept_patches(ratio) == keep
    df = spark.range(3)
    ids = I.shuffled_patch_ids(F.col("id"), 1)
    row = df.select(ids.alias("ids"), I.restore_order(ids).alias("r")).withColumn(
        "mask", I.patch_mask(F.col("r"), ratio)
    ).collect()[2]
    assert sorted(row.ids) == list(range(400))
    assert [row.ids[p] for p in row.r] == list(range(400))
    assert {i for i, m in enumerate(row["mask"]) if m == 0} == set(row.ids[:keep])


def test_stripped_header_removes_payload_everywhere(spark):
    df = spark.createDataFrame([("aa11bb11", "11"), ("aabb", "")], "ip string, payload string")
    first, second = [r[0] for r in df.select(I.stripped_block_hex(F.col("ip"), F.col("payload"))).collect()]
    assert first[:160] == "aabb".ljust(160, "0") and first[160:162] == "11"
    assert second == "aabb".ljust(640, "0")


def test_tokens_and_padding(spark):
    df = spark.createDataFrame([([5, -3, 0, 1500, -1500],)], "s array<int>")
    s = F.col("s")
    row = df.select(
        S.shift_tokens(s).alias("a4"),
        S.shift_tokens_keep_zero(s).alias("a5"),
        S.unsigned_tokens(s, 1000, 7).alias("a6"),
        S.folded_tokens(s).alias("a7"),
        S.fixed_length(s, 3).alias("cut"),
        S.fixed_length(s, 7).alias("padded"),
        S.directions(s).alias("a10"),
    ).first()
    assert row.a4 == [1506, 1498, 1501, 3001, 1]
    assert row.a5 == [1506, 1498, 0, 3001, 1]
    assert row.a6 == [5, 3, 0, 1000, 1000, 0, 0]
    assert row.a7 == [1506, 3, 1501, 3001, 1500]
    assert row.cut == [5, -3, 0] and row.padded == [5, -3, 0, 1500, -1500, 0, 0]
    assert row.a10 == [1, -1, 0, 1, -1]


def test_text_helpers(spark):
    df = spark.createDataFrame([("novpn_unified_output_split",), ("x" * 40,), ("plain",)], "t string")
    t = F.col("t")
    rows = df.select(X.topk_dataset_name(t, 10).alias("n"), X.display_label(t).alias("d")).collect()
    assert [r.n for r in rows] == ["novpn_top10_split", "x" * 40 + "_top10_split", "plain_top10_split"]
    assert rows[1].d == "x" * 32 + "..." and rows[2].d == "plain"


def test_scaling_with_own_test_parameters(spark):
    rows = [(float(i), "train" if i < 6 else "val" if i < 8 else "test") for i in range(12)]
    df = spark.createDataFrame(rows, "f double, split string")
    train = np.arange(6.0)
    test = np.arange(8.0, 12.0)
    shared = [r.f for r in scaling.scale_splits(df, ["f"]).collect()]
    np.testing.assert_allclose(sorted(shared), (np.arange(12.0) - train.mean()) / train.std())
    got = [r.f for r in scaling.scale_splits(df, ["f"], own_test=True).filter("split = 'test'").collect()]
    np.testing.assert_allclose(sorted(got), (test - test.mean()) / test.std())
    val = [r.f for r in scaling.scale_splits(df, ["f"], own_test=True).filter("split = 'val'").collect()]
    np.testing.assert_allclose(sorted(val), (np.array([6.0, 7.0]) - train.mean()) / train.std())


def test_payload_column_and_skips(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", [1.0])] * 12 + [("b", [2.0])] * 3 + [("c", None)] * 20, "label string, features array<double>"
    )
    datasets.write_by_class(rows, str(tmp_path / "d"))
    label_map = spark.createDataFrame([(5, "a"), (6, "b"), (7, "c"), (8, "d")], "label_id bigint, label string")
    kept, skipped = datasets.read_classes(spark, str(tmp_path / "d"), label_map, "features", 10)
    assert {(r.label, r.label_id) for r in kept.collect()} == {("a", 0)} and kept.count() == 12
    assert {(r.label, r.n, r.reason) for r in skipped.collect()} == {
        ("b", 3, "too few samples"),
        ("c", 0, "no payload"),
        ("d", 0, "missing"),
    }
    _none, all_skipped = datasets.read_classes(spark, str(tmp_path / "d"), label_map, "images", 10)
    assert all_skipped.count() == 4
    with pytest.raises(ValueError):
        datasets.payload_column(spark.range(1))
    assert datasets.payload_column(spark.range(1).select(F.lit(1).alias("X"), F.lit(2).alias("flows"))) == "flows"


def test_one_split_reads_one_folder(spark, samples, tmp_path):
    datasets.write_by_class(splits.split_sequential(samples), str(tmp_path / "d"))
    rows = datasets.read_split(spark, str(tmp_path / "d"), "val")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert rows.count() == sum(int(n * 0.1) for n in sizes(samples, "label_id").values())


def test_logs(spark, tmp_path):
    (tmp_path / "run_a.log").write_text(
        "header\nEpoch   1 | Train Loss: 6.9102 | Train Acc: 0.0009 | Val Acc: 0.0005 | Val F1: 0.0000 *\n"
        "Epoch   2 | Train Loss: 2.9184 | Train Acc: 0.3747 | Val Acc: 0.4923 | Val F1: 0.3874\n"
        "Accuracy:  0.5\nAccuracy:  0.6\nF1 Score:  0.55\n"
    )
    (tmp_path / "run_b.log").write_text("nothing here\n")
    lines = logs.read_log_lines(spark, str(tmp_path))
    history = logs.epoch_history(lines).orderBy("epoch").collect()
    assert [(r.run, r.epoch, r.train_loss, r.val_f1, r.is_best) for r in history] == [
        ("run_a", 1, 6.9102, 0.0, True),
        ("run_a", 2, 2.9184, 0.3874, False),
    ]
    results = {r.run: (r.accuracy, r.f1, r.status) for r in logs.experiment_table(logs.run_results(lines)).collect()}
    assert results == {"run_a": (0.6, 0.55, "success"), "run_b": (None, None, "no metrics")}
    one = logs.experiment_summary(logs.run_results(lines)).first()
    assert (one.n_runs, one.n_success) == (2, 1)


def test_staging_is_shared_and_reread(spark):
    assert staging_root(spark)
    table = staged(spark.range(10), "t")
    assert "parquet" in table._jdf.queryExecution().executedPlan().toString().lower()
    assert table.count() == 10


def test_forest_learns(spark):
    rows = spark.range(400).select(
        F.col("id").alias("sample_id"),
        (F.col("id") % 2).alias("label_id"),
        (F.col("id") % 2 + F.rand(1) * 0.1).alias("a"),
        F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.rand(2)).alias("b"),
        F.when(F.col("id") < 300, "train").when(F.col("id") < 350, "val").otherwise("test").alias("split"),
    )
    model = forest.fit_forest(rows.filter("split = 'train'"), ["a", "b"], trees=5, depth=3)
    scored = forest.predict(model, rows, ["a", "b"])
    assert scored.filter("label <> pred").count() == 0
    top = forest.top_features(forest.feature_importance(spark, model, ["a", "b"]), 1).first()
    assert top.feature == "a"


def test_sequential_split_takes_any_id_and_null_groups(spark):
    rows = [(f"id-{i * 7919 % 1000:04d}", None if i % 3 == 0 else i % 3) for i in range(300)]
    samples = spark.createDataFrame(rows, "sample_id string, label_id int")
    out = splits.split_sequential(samples).collect()
    assert len(out) == 300
    for label in (None, 1, 2):
        ordered = [r.split for r in sorted(out, key=lambda r: r.sample_id) if r.label_id == label]
        assert ordered == ["train"] * 80 + ["val"] * 10 + ["test"] * 10


def test_merged_names_that_collide_stay_two_classes(spark):
    a = spark.createDataFrame([(1, "b_c"), (2, None)], "sample_id int, label string")
    b = spark.createDataFrame([(3, "c")], "sample_id int, label string")
    merged = corpus.merge_datasets({"a": a, "a_b": b}, full=True).collect()
    assert len(merged) == 3 and len({r.label_id for r in merged}) == 3


def test_diverged_epochs_never_win(spark):
    rows = [("r", 1, 0.2), ("r", 2, float("nan")), ("r", 3, 0.5), ("r", 4, None), ("s", 1, float("nan"))]
    history = spark.createDataFrame(rows, "run string, epoch int, metric double")
    assert [(r.run, r.best_epoch) for r in metrics.best_epochs(history).collect()] == [("r", 3)]
    best = {(r.run, r.epoch) for r in metrics.running_best(history).collect() if r.is_best}
    assert best == {("r", 1), ("r", 3)}


def test_class_ids_out_of_range_are_an_error(spark):
    counts = spark.createDataFrame([(0, 1, 5), (1, 3, 2)], "label long, pred long, n long")
    assert metrics.class_scores(counts, 4).count() == 4
    for run in (metrics.class_scores, metrics.confusion_dense, metrics.confusion_wide):
        with pytest.raises(Exception, match="not below 3"):
            run(counts, 3).collect()


# --- builds that are interrupted ---


def built(spark, path):
    return sorted(map(tuple, commits.read_committed(spark, path).select("label", "v").collect()))


@pytest.fixture
def classes(spark):
    rows = [(f"c/{i % 7:03d}", i) for i in range(100)] + [("007", 1), (None, 5)]
    return spark.createDataFrame(rows, "label string, v long")


@pytest.mark.parametrize("stop", ["before the rows", "between rows and manifest", "before the manifest is in place"])
def test_a_build_that_stops_loses_and_doubles_no_class(spark, classes, tmp_path, monkeypatch, stop):
    path, made = str(tmp_path / "set"), []

    def build(part):
        made.append(sorted(r.label for r in part.select("label").distinct().collect()))
        if len(made) == 2 and stop == "before the rows":
            raise RuntimeError("stopped")
        return part

    name = "_file_system" if stop == "before the manifest is in place" else "record_commit"
    real = getattr(commits, name)

    def stopping(*args):
        after_rename = name == "record_commit" or "/_commits/" in args[1]
        if len(made) == 2 and stop != "before the rows" and after_rename:
            raise RuntimeError("stopped")
        return real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(commits, name, stopping)
        with pytest.raises(RuntimeError, match="stopped"):
            commits.build_pending(classes, build, path, classes_per_commit=3)
    done = [r.label for r in commits.completed_classes(spark, path).collect()]
    assert sorted(done) == made[0] and {label for label, _ in built(spark, path)} == set(made[0])
    assert commits.build_pending(classes, build, path, classes_per_commit=3) == 2
    assert built(spark, path) == sorted(map(tuple, classes.where("label is not null").collect()))
    assert sorted(label for part in [made[0], *made[2:]] for label in part) == sorted({r.label for r in classes.collect() if r.label})
    assert commits.build_pending(classes, build, path) == 0


def test_classes_without_rows_are_done(spark, classes, tmp_path):
    path = str(tmp_path / "set")
    assert commits.build_pending(classes, lambda part: part.where("v < 0"), path) == 1
    assert {r.label: r.n for r in commits.completed_classes(spark, path).collect()} == {**{f"c/{i:03d}": 0 for i in range(7)}, "007": 0}
    assert commits.read_committed(spark, path, classes.schema).collect() == []
    assert commits.build_pending(classes, lambda part: part, path) == 0


def test_a_class_written_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "set")
    for value in (1, 2):
        commits.write_classes(spark.createDataFrame([("a", value), (f"only {value}", 0)], "label string, v long"), path)
    rows = spark.read.parquet(path).select("label", "v").collect()
    assert sorted(map(tuple, rows)) == [("a", 2), ("only 1", 0), ("only 2", 0)]


# --- many classes ---


def test_votes_as_vectors_equal_votes_as_rows(spark):
    rng = random.Random(9)
    rows = [(s, t, [round(rng.random(), 3) if rng.random() < 0.3 else 0.0 for _ in range(40)]) for s in range(12) for t in range(5)]
    rows += [(99, t, [0.25] * 40) for t in range(5)]  # equal everywhere: the lower id
    wide = spark.createDataFrame(rows, "sample_id long, tree int, probabilities array<double>").repartition(7)
    long = wide.select("sample_id", "tree", F.posexplode("probabilities").alias("class_id", "prob"))
    key = lambda df: sorted((r.sample_id, r.pred, round(r.confidence, 9)) for r in df.collect())
    assert key(forest.soft_vote_vectors(wide, 5)) == key(forest.soft_vote(long, 5))
    assert key(forest.soft_vote_vectors(wide.withColumn("probabilities", array_to_vector("probabilities")), 5)) == key(forest.soft_vote(long, 5))
    one, two = [wide.filter(F.col("tree") == t).filter(F.col("sample_id") != t) for t in (0, 1)]
    tables = [df.select("sample_id", F.posexplode("probabilities").alias("class_id", "prob")) for df in (one, two)]
    assert key(forest.weighted_vote_vectors(one, two, 0.6)) == key(forest.weighted_vote(*tables, 0.6))
    plan = forest.soft_vote_vectors(wide, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "partial_" in plan and "Generate" not in plan


def test_confusion_rows(spark):
    counts = metrics.confusion(spark.createDataFrame([(0, 1), (0, 1), (2, 2), (1, 0)], "label long, pred long"))
    assert {r.label: r.counts for r in metrics.confusion_rows(counts, 4).collect()} == {0: [0, 2, 0, 0], 1: [1, 0, 0, 0], 2: [0, 0, 1, 0], 3: [0] * 4}


# --- random order ---


@pytest.mark.parametrize("group", [[], ["label_id"]])
def test_crowded_slices_of_a_split_are_counted_again(spark, group):
    """Slices larger than the bound are refined; the result is that of a full sort."""
    rows = spark.range(9000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("label_id"))
    choose = splits._three_way(0.8, 0.1)
    got = {r.sample_id: r.split for r in splits._hash_split(rows, group, 42, "sample_id", choose, rows=1).collect()}
    order = Window.partitionBy(*group).orderBy(splits.hash_key(42, "sample_id"), "sample_id")
    whole = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    assert got == {r.sample_id: r.split for r in whole.select("sample_id", choose(F.col("_r"), F.col("_n")).alias("split")).collect()}


def test_batches_do_not_depend_on_the_bound(spark):
    rows = spark.range(5000).withColumnRenamed("id", "sample_id")
    assert sorted(splits.batch_ids(rows, 7, rows=1).collect()) == sorted(splits.batch_ids(rows, 7).collect())


def test_many_votes_are_made_by_many_tasks(spark, tmp_path):
    ids = [None, None, -5, 0, 58, 999, 1000, 12345]
    table = spark.createDataFrame([(i,) for i in ids], "s_suppkey bigint").coalesce(1)
    table.write.parquet(str(tmp_path / "supplier.parquet"))
    votes = registry.Inputs(spark, str(tmp_path)).many_votes().withColumn("_task", F.spark_partition_id())
    rows = votes.collect()
    assert len({r["_task"] for r in rows}) >= len(ids) // 2
    assert len(rows) == 100 * len(ids)
    for row in rows:
        wanted = [0.0] * 1000
        if row["sample_id"] is not None:
            i, t = row["sample_id"], row["tree"]
            a, p = (i * 17 + (i + t) % 3) % 1000, 0.25 + (i * 7 + t * 3) % 50 / 100
            wanted[a], wanted[(a + 1 + t % 2) % 1000] = p, 1 - p
        assert row["probabilities"] == wanted
