"""The pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
from flowloom.llm.common import stage
from flowloom.llm.decontamination import _WORD
from flowloom.llm.packing import END_ID, encoder
from tests.conftest import SMALL
from tests.llm.test_graph_operators import brute_documents


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "", "en", "s", 0), (900_002, None, None, None, None), (900_003, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    kept = []
    for name, step in C.STAGES:
        before = docs
        docs, _ = stage(step(spark, docs, SMALL), name)
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.exceptAll(before).count() == 0
        if name == "language_id":
            assert {r["doc_id"] for r in before.exceptAll(docs).collect()} >= {900_001, 900_002, 900_003}
        if name == "near_dedup":
            expected = {d for d, (_, _, first) in brute_documents([(r["doc_id"], r["text"]) for r in before.collect()]).items() if first}
            assert {r["doc_id"] for r in docs.collect()} == expected
        if name == "decontamination":
            items = [f" {' '.join(_WORD.findall(r['text'].lower()))} " for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            clean = {r["doc_id"] for r in before.collect() if not any(i in f" {' '.join(_WORD.findall(r['text'].lower()))} " for i in items)}
            assert {r["doc_id"] for r in docs.collect()} == clean
        if name == "packing":
            whole = encoder().whole
            lengths = {r["doc_id"]: len([*whole.encode(r["text"], add_special_tokens=False).ids, END_ID]) for r in before.collect()}
            got = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert got == lengths
    assert kept[0] >= kept[1] > kept[2] > kept[3] > 0


def test_run_gives_the_last_stage(spark):
    rows = C.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_rows_are_told_by_id_and_text(spark):
    """Rows that share an id, or have none, are judged each for itself."""
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"]
    near = words[0] + " more"
    rows = [
        (1, words[0]), (1, words[1]), (1, words[1]), (2, near), (None, near), (None, words[2]), (None, words[2]), (None, words[3]),
        (3, words[4]), (3, f"{words[5]} {item} end"), (None, f"{words[6]} {item} end"), (4, words[6]), (None, words[4] + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3)
    alone = C.near_dedup(spark, docs, SMALL)
    assert alone.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in alone.collect()), key=repr)
    groups = {words[0], near}  # of these one stays, named by the only row with an id of its own
    assert sum(t in groups for _, t in kept) == 1 and (2, near) in kept
    assert [(i, t) for i, t in kept if t == words[1]] == [(1, words[1])]
    assert [(i, t) for i, t in kept if t == words[2]] == [(None, words[2])] and (None, words[3]) in kept
    assert sum(t.startswith(words[4]) for _, t in kept) == 1
    clean = [(r["doc_id"], r["text"]) for r in C.decontamination(spark, docs, SMALL).collect()]
    assert Counter(clean) == Counter((i, t) for i, t in rows if item not in t)


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, step in C.STAGES:
        docs, _ = stage(step(spark, docs, SMALL), name)
        assert docs.count() == 0
