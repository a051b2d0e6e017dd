"""Language, quality, toxicity, token counts, packing and decontamination."""

from __future__ import annotations

import math
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from flowloom.llm import decontamination as D
from flowloom.llm import language_id as L
from flowloom.llm import packing as P
from flowloom.llm import quality as Q
from flowloom.llm import token_counts as K
from flowloom.llm import toxicity as X
from flowloom.llm.common import hash_limit
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = ["", " ", "\n", "a", "  two  spaces ", "tab\tand\nline\n\nends ", "日本 ﬁ 🙂 \x00 ▁x \x01", "it's 12 o'clock<|endoftext|>!", "x" * 3000, "word " * 5000, None]


def odd_docs(spark, texts=ODD):
    rows = [(i, t, "en", None, None, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (0, texts[0], "en", None, None, 1.0), (None, "a b c d e f", None, None, None, None)], DOCS)


def tables(spark, root):
    return (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))


# --- language -------------------------------------------------------------------


def plain_bits(samples: list[str], text: str, order: int = L.ORDER) -> float:
    """Code length by dictionaries, one byte after the other."""
    seen: dict[bytes, Counter] = {}
    pad = b"\n" * order
    for sample in samples:
        data = pad + sample.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen.setdefault(data[i - k : i], Counter())[data[i]] += 1
    bits, data = 0.0, pad + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            found = seen.get(data[i - k : i])
            if found is None:
                continue
            total = sum(found.values()) + len(found)
            if data[i] in found:
                bits -= math.log2(found[data[i]] / total)
                break
            bits -= math.log2(len(found) / total)
        else:
            bits += 8.0
    return bits


def test_code_lengths_equal_plain_trees():
    samples = {"a": ["the cat sat on the mat", "then the dog"], "b": ["der hund und die katze", "ä ö ü"]}
    trees = L.ContextTrees(samples)
    trees.index()
    texts = ["the hat", "und die", "xyz zzz", "ü", "the cat sat on the mat"]
    got = trees.code_lengths([t.encode() for t in texts])
    expected = [[plain_bits(samples[x], t) for x in ("a", "b")] for t in texts]
    assert np.allclose(got, expected)


def test_language_odd_rows_and_empty_table(spark):
    docs, _ = tables(spark, SMALL)
    trees = L.learn_languages(docs)
    rows = L.identify_languages(odd_docs(spark), trees).collect()
    assert len(rows) == len(ODD) + 2
    by_text = dict(zip([*ODD, ODD[0], "last"], rows, strict=True))
    assert all(by_text[t]["lang_pred"] == "und" and by_text[t]["score"] == 0 for t in ("", " ", "\n", None))
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = L.learn_languages(docs.limit(0))
    assert {r["lang_pred"] for r in L.identify_languages(docs.limit(5), nothing).collect()} == {"und"}
    assert L.identify_languages(docs.limit(0), trees).count() == 0


def test_language_held_out(spark):
    docs, _ = tables(spark, MIDDLE)
    found = L.identify_languages(docs, L.learn_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.98


# --- quality and toxicity -------------------------------------------------------


def test_quality_held_out(spark):
    docs, labels = tables(spark, MIDDLE)
    found = Q.score_quality(docs, Q.fit_quality(docs, labels)).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_shares_of_samples_at_any_size():
    assert hash_limit(1000, 10**13) > 0 and hash_limit(12_000, 10**10) / 2**63 == pytest.approx(1.2e-6)
    assert hash_limit(1000, 0) == hash_limit(1000, 999) == 2**63 - 1


@pytest.mark.parametrize("bound", [40, 10**6])
def test_labelled_samples_do_not_depend_on_partitions(spark, bound):
    """As many as the bound says, one row per id, the same in every run."""
    docs = spark.createDataFrame([(i % 300, f"text {i % 300} {i % 7}") for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 350, i % 2) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, quality int")
    samples = [
        sorted(map(tuple, Q.labelled_sample(docs.repartition(n), labels.repartition(m), "quality", bound).collect()))
        for n, m in ((1, 5), (9, 2))
    ]
    assert samples[0] == samples[1]
    ids = [int(text.split()[1]) for text, _ in samples[0]]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert len(ids) <= bound and (len(ids) > 25 if bound == 40 else len(ids) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(300)))


def test_language_samples_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, many = (L.identify_languages(docs, L.learn_languages(docs.repartition(n))) for n in (1, 6))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_quality_odd_rows(spark):
    docs, labels = tables(spark, SMALL)
    model = Q.fit_quality(docs, labels)
    rows = Q.score_quality(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for t, r in zip(ODD, rows, strict=False) if t in ("", None)}) == 1
    blank = Q.fit_quality(docs.limit(0), labels.limit(0))
    assert {round(r["score"], 6) for r in Q.score_quality(odd_docs(spark), blank).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), model).count() == 0


def test_pooling_equals_plain_means():
    vectors = np.random.default_rng(1).normal(size=(Q.BUCKETS, Q.WIDTH)).astype(np.float32)
    rows = vectors[Q.token_buckets("One two, THREE 4 two two")].astype(float)
    expected = np.concatenate([rows.mean(0), rows.std(0), (rows[1:] * rows[:-1]).mean(0)])
    assert np.allclose(Q.pooled(vectors, "One two, THREE 4 two two"), expected, atol=1e-5)


def test_toxicity_held_out(spark):
    docs, labels = tables(spark, MIDDLE)
    named = X.grade_toxicity(docs, X.fit_toxicity(docs, labels)).withColumnRenamed("toxic", "flag")
    found = named.join(labels, "doc_id").toPandas()
    assert found[found.toxic == 1].flag.mean() > 0.8
    assert found[found.toxic == 0].flag.mean() < 0.05
    assert found.severity.between(0, X.GRADES).all() and set(found.grade) <= set(range(X.GRADES + 1))


def test_toxicity_thresholds_are_ordered_and_shared(spark):
    features = [X.text_features(t) for t in ["good day"] * 6 + ["bad idiot day"] * 3 + ["bad idiot moron scum"] * 3]
    model = X.fit_ordinal(features, np.array([0.0] * 6 + [1.0] * 6))
    assert (np.diff(model.thresholds) >= 0).all()
    above = model.at_least(np.array([0.0, 3.0]))
    assert (np.diff(above, axis=1) <= 0).all() and (above[1] > above[0]).all()
    rows = X.grade_toxicity(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) + 2
    none = X.fit_ordinal(features, np.zeros(12))
    assert not any(r["toxic"] for r in X.grade_toxicity(odd_docs(spark), none).collect())


# --- token counts ---------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=K.model_path())


def test_every_prefix_has_its_exact_count(model):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "the", "\n", "é", "日", "▁", "!", "ing", "\t", " " * 17, "0", "\x01", "🙂", "th", "er", "zq"]
    counter = K.counter(K.model_path())
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        counts = np.cumsum(counter.tables([text])[0], dtype=int).tolist()
        assert counts == [len(x) for x in model.encode([text[: i + 1] for i in range(len(text))])], repr(text)


def test_counts_truncation_and_odd_rows(spark, model):
    docs = odd_docs(spark)
    rows = K.prefix_counts(docs, limit=100).withColumn("at_three", K.tokens_at("steps", K.F.lit(3))).withColumn("again", K.chars_within("steps", K.F.lit(100))).collect()
    texts = [*ODD, ODD[0], "a b c d e f"]
    for text, row in zip(texts, rows, strict=True):
        text = text or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
        assert row["over_limit"] == (row["n_tokens"] > 100)
        assert row["at_three"] == len(model.encode(text[:3])) and row["again"] == row["fit_chars"]
        fitting = [i for i in range(len(text) + 1) if i in (0, len(text)) or abs(i - row["fit_chars"]) < 3]
        assert row["fit_chars"] == max(i for i in fitting if len(model.encode(text[:i])) <= 100)
    assert K.prefix_counts(docs.limit(0)).count() == 0


def test_counts_of_whole_table(spark, model):
    docs, _ = tables(spark, SMALL)
    got = {r["doc_id"]: r["n_tokens"] for r in K.prefix_counts(docs, keep_steps=False).collect()}
    assert got == {r["doc_id"]: len(model.encode(r["text"])) for r in docs.collect()}


# --- packing --------------------------------------------------------------------


def check_packing(rows: pd.DataFrame, texts: list[str], capacity: int) -> None:
    whole = P.encoder().whole
    ids = sorted([*whole.encode(t or "", add_special_tokens=False).ids, P.END_ID] for t in texts)
    expected = sorted((s, n, zlib.crc32(array("I", i[s : s + n]).tobytes())) for i in ids for s, n in P.cut(len(i), capacity))
    assert sorted(zip(rows.start, rows.length, rows.ids_crc32, strict=True)) == expected
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *np.cumsum(one.length)[:-1]] and one.length.sum() <= capacity


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing_is_gapless_whole_and_tight(spark, capacity):
    docs, _ = tables(spark, SMALL)
    rows = P.pack_documents(docs, capacity=capacity).toPandas()
    check_packing(rows, [r["text"] for r in docs.collect()], capacity)
    assert rows.sequence_id.nunique() <= 1.02 * math.ceil(rows.length.sum() / capacity) + 1
    assert (rows.sort_values(["doc_id", "piece"]).groupby("doc_id").piece.agg(lambda p: p.tolist() == list(range(len(p))))).all()


def test_packing_odd_rows(spark):
    docs = odd_docs(spark)
    check_packing(P.pack_documents(docs, capacity=256).toPandas(), [*ODD, ODD[0], "a b c d e f"], 256)
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_plan_keeps_every_capacity():
    counts = {700: 3, 300: 10, 120: 40, 33: 200, 5: 1000, 1: 50}
    for rule in ("norm", "dot"):
        plan = P.plan_bins(counts, 1024, max_documents=6, max_cost=600_000, rule=rule)
        packed = Counter()
        for bins, items in plan:
            assert sum(n * k for n, k in items) <= 1024 and sum(k for _, k in items) <= 6
            assert sum(n * n * k for n, k in items) <= 600_000
            for n, k in items:
                packed[n] += bins * k
        assert packed == counts
    with pytest.raises(ValueError):
        P.plan_bins({1025: 1})


def test_units_encode_like_the_library():
    rng = random.Random(8)
    parts = ["a", " ", "  ", "the", "\n", "é", "日", "!", "ing", "\t", "0", "\x01", "🙂", "'s", "<|endoftext|>", "\xa0", "12", "'"]
    encoder = P.encoder()
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]
    assert encoder.encode_all(texts) == [array("I", encoder.whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


# --- decontamination ------------------------------------------------------------

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
SHORT = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_contaminated_rows(spark, bound):
    words = PASSAGE.split()
    replaced = list(words)
    replaced[4] = replaced[11] = "other"
    texts = [f"before {PASSAGE.upper()} after", "x " + " ".join(replaced), " ".join(words[:7]), "clean text only", "", None, f"so {SHORT} end", "alpha beta gamma"]
    docs = spark.createDataFrame([(i, t, "en", None, None, 0.0) for i, t in enumerate([*texts, texts[0]])], DOCS)
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, SHORT), (3, "too short"), (4, None), (5, ""), (None, PASSAGE)], "item_id long, text string")
    found = [(r["doc_id"], r["item_id"], r["equal_words"], r["run_words"], r["first_word"]) for r in D.contaminated(docs, items, broadcast_seeds=bound).collect()]
    found.sort(key=lambda r: (r[0], r[1] or 0))
    assert [r for r in found if r[1] is not None] == [(0, 1, 18, 18, 1), (1, 1, 16, 18, 1), (6, 2, 8, 8, 1), (8, 1, 18, 18, 1)]
    assert [(r[0], *r[2:]) for r in found if r[1] is None] == [(0, 18, 18, 1), (1, 16, 18, 1), (8, 18, 18, 1)]
    assert D.contaminated(docs.limit(0), items, broadcast_seeds=bound).count() == 0
    assert D.contaminated(docs, items.limit(0), broadcast_seeds=bound).count() == 0


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_contaminated_by_short_items(spark, bound):
    """Items of 1 to 14 words: whole ones in text from five words on, one replaced word from eight."""
    items, docs, expected = [], [], set()

    def add(words, *hits):
        docs.append((len(docs), " ".join(words), "en", None, None, 0.0))
        expected.update((len(docs) - 1, i) for i in hits)

    for n in range(1, 15):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        add(words, n)
        add(["so", *words, "end"], *([n] if n >= 5 else []))
        for k in range(n):
            one = [w if j != k else "other" for j, w in enumerate(words)]
            add(["so", *one, "end"], *([n] if n >= 8 else []))
        add(["so", *words[: n // 2]])
    spread = spark.createDataFrame(docs, DOCS).repartition(3)
    found = D.contaminated(spread, spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=bound)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_contaminated_by_every_text_of_an_id(spark, bound):
    first, second = PASSAGE, PASSAGE.replace("o", "u").upper()
    docs = spark.createDataFrame([(i, t, "en", None, None, 0.0) for i, t in enumerate([first, second, "clean words"])], DOCS)
    items = spark.createDataFrame([(7, first), (7, second), (7, first), (None, second)], "item_id long, text string")
    rows = D.contaminated(docs, items, broadcast_seeds=bound).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in rows if r["equal_words"] == 18) == {(0, 7): 1, (1, 7): 1, (1, None): 1}
    assert {r["doc_id"] for r in rows} == {0, 1}


def test_contaminated_finds_every_whole_item(spark):
    docs, _ = tables(spark, MIDDLE)
    items = spark.read.parquet(f"{MIDDLE}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()}
    norm = {r["item_id"]: f" {' '.join(D._WORD.findall(r['text'].lower()))} " for r in items.collect()}
    texts = {r["doc_id"]: f" {' '.join(D._WORD.findall((r['text'] or '').lower()))} " for r in docs.collect()}
    assert found == {(d, i) for d, t in texts.items() for i, n in norm.items() if n in t}


@pytest.mark.parametrize("bound", [D.BROADCAST_SEEDS, 0])
def test_contaminated_by_part_of_an_item_and_by_shifted_words(spark, bound):
    long, middle, brief = ([f"{c}{i}" for i in range(n)] for c, n in (("l", 400), ("m", 59), ("b", 20)))
    inserted = [*brief[:10], "new", *brief[10:]]
    thirds = [*middle[:6], "new", *middle[6:12], *middle[13:18]]
    texts = [["x", *long[100:299]], ["x", *middle[20:49]], ["x", *inserted], ["x", *brief[:10], *brief[11:]], thirds, long[:12], [*brief[:6], "x", "y", "z", *brief[6:11]]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", None, None, 0.0) for i, t in enumerate(texts)], DOCS)
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((long, middle, brief))], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["equal_words"], r["run_words"], r["first_word"]) for r in D.contaminated(docs, items, broadcast_seeds=bound).collect())
    assert found == [(0, 0, 199, 199, 1), (1, 1, 29, 29, 1), (2, 2, 20, 21, 1), (3, 2, 19, 19, 1), (4, 1, 17, 18, 0)]


def test_alignment_is_that_of_the_plain_recursion():
    draw = random.Random(5)
    for _ in range(200):
        document, item = ([draw.randrange(6) for _ in range(draw.randint(1, 25))] for _ in range(2))
        best = 0
        score = [[0] * (len(document) + 1) for _ in range(len(item) + 1)]
        for i, w in enumerate(item, 1):
            for j, v in enumerate(document, 1):
                score[i][j] = max(0, score[i - 1][j - 1] + (1 if v == w else -D.MISMATCH), score[i - 1][j] - D.MISMATCH, score[i][j - 1] - D.MISMATCH)
                best = max(best, score[i][j])
        equal, run, first = D.aligned(np.array(document, np.uint64), np.array(item, np.uint64))
        assert equal >= best and equal <= run + len(item) and first + run <= len(document)
