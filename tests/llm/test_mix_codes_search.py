"""Source mix, vector codes and ranked search against plain forms of their rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import lexical_search as S
from flowloom.llm.source_mix import LIMIT, SHARE, WEIGHTS, mix_sources, round_copies, source_targets
from flowloom.llm.vector_codes import compress_vectors, largest_component, nearest_entries
from tests.conftest import SMALL

DOCS = "doc_id long, text string, source string, size string, target int, score int"


# --- source mix -------------------------------------------------------------------


def shared(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets by cutting and resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    target, rest = dict.fromkeys(order, 0.0), SHARE * sum(sizes.values())
    while rest > 1e-9:
        free = [s for s in order if target[s] < LIMIT * sizes[s]]
        if not free:
            break
        whole, extra = sum(weight[s] for s in free), rest
        rest = 0.0
        for s in free:
            target[s] += extra * weight[s] / whole
            rest += max(0.0, target[s] - LIMIT * sizes[s])
            target[s] = min(target[s], LIMIT * sizes[s])
    return target


def corpus(rng: random.Random, rows: int) -> list[tuple]:
    docs = []
    for i in range(rows):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Z", "é", "", "\U0001f600", None])
        text = rng.choice([None, "", " \t\n"]) if i % 17 == 0 else " ".join(["word"] * int(rng.paretovariate(0.9)))
        docs.append((None if i % 19 == 0 else i % 400, text, source, "x", 1, 2))
    return docs


def test_targets_are_those_of_repeated_resharing(spark):
    rng = random.Random(1)
    for case in ({"a": 10, "b": 1000, "c": 10, None: 5}, {"x": 7}, {"a": 0, "b": 3}, {f"s{i}": rng.randrange(2000) for i in range(40)}):
        df = spark.createDataFrame(list(case.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got.keys() == case.keys()
        assert all(got[s] == pytest.approx(t) for s, t in shared(case).items())


def test_mix_keeps_targets_and_bounds(spark):
    docs = corpus(random.Random(2), 3000)
    rows = mix_sources(spark.createDataFrame(docs, DOCS)).collect()
    words = Counter((d[0], len((d[1] or "").split())) for d in docs)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == words
    sizes = defaultdict(int)
    for _, text, source, *_ in docs:
        sizes[source] += len((text or "").split())
    targets = shared(sizes)
    by_target = defaultdict(list)
    for r in rows:
        by_target[r["source_size"], round(r["target"], 6)].append(r)
    assert by_target.keys() == {(sizes[s], round(t, 6)) for s, t in targets.items()}
    for (size, target), group in by_target.items():
        base = math.floor(target / size) if size else 0
        assert all(r["size"] == 0 == r["taken"] or r["taken"] / r["size"] in (base, base + 1) for r in group)
        assert all(r["taken"] <= 2 * r["size"] for r in group)
        # a source's pairs lose no word; only the last draw is off, by one of its short documents
        # unless one document is too large for the others to make up for it
        longest = max(r["size"] for r in group)
        assert abs(sum(r["taken"] for r in group) - target) <= (3 if 4 * longest <= size else longest)


def test_mix_does_not_depend_on_partitions(spark):
    docs = corpus(random.Random(3), 1500)
    one = sorted(map(repr, mix_sources(spark.createDataFrame(docs, DOCS).coalesce(1)).collect()))
    random.Random(4).shuffle(docs)
    many = sorted(map(repr, mix_sources(spark.createDataFrame(docs, DOCS).repartition(7)).collect()))
    other = sorted(map(repr, mix_sources(spark.createDataFrame(docs, DOCS), seed=1).collect()))
    assert one == many != other


def test_tree_of_several_levels_keeps_words_and_expectation(spark):
    rng = random.Random(5)
    units = [(1, 0, 0.0, 0, i, i, s := rng.choice([3, 3, 3, 5, 900]), 0.3 * s) for i in range(400)]
    df = spark.createDataFrame(units, "source_no long, source_size long, target double, base long, key long, doc_id long, size long, owed double")
    owed = sum(u[-1] for u in units)
    taken = Counter()
    off, runs = [], 8
    for seed in range(runs):
        rows = round_copies(df, seed, group_rows=4, last_rows=40).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(400))
        assert {r["copy"] for r in rows} == {0, 1}
        off.append(abs(sum(r["copy"] * r["size"] for r in rows) - owed))
        taken.update({s: sum(r["copy"] for r in rows if r["size"] == s) for s in (3, 5, 900)})
    for s in (3, 5, 900):
        drawn = runs * sum(u[6] == s for u in units)
        assert abs(taken[s] / drawn - 0.3) < 4 * math.sqrt(0.21 / drawn) + 0.01
    # so few short documents held back may not make up for the last long one
    assert max(off) <= 900


def test_mix_of_nothing_and_without_words(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    rows = mix_sources(spark.createDataFrame([(1, None, None, "", 0, 0), (2, " ", "a", "", 0, 0)], DOCS)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in rows) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_of_many_equal_rows(spark):
    rows = mix_sources(spark.createDataFrame([(7, "two words", "a", "", 0, 0)] * 700 + [(8, "x", "b", "", 0, 0)] * 10, DOCS)).collect()
    # a, of weight 5, wants 1,322 words; b's share is at its limit
    assert Counter((r["doc_id"], r["taken"]) for r in rows if r["doc_id"] == 8) == {(8, 2): 10}
    assert abs(sum(r["taken"] for r in rows) - 1.5 * 1410) <= 2 and len(rows) == 710


def test_mix_runs_no_python_workers(spark):
    plan = mix_sources(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- vector codes -----------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_nearest_entries_with_ties(width):
    rng = np.random.default_rng(width)
    parts = rng.integers(-6, 7, (3000, width))
    for book in (rng.integers(-5, 6, (64, width)), rng.integers(-5, 6, (1, width)), np.zeros((5, width), np.int64)):
        distance = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        found, best = nearest_entries(parts, book)
        assert (found == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
    found, best = nearest_entries(np.full((1, width), 2**28 // width), np.full((2, width), -(2**28 // width)))
    assert (found[0], best[0]) == (0, width * (2 * (2**28 // width)) ** 2)


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[dict, str]:
    """Codes and errors by position among ``rows(id, integers)``, by full comparison."""
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for v in cut:
            for p in range(parts):
                held[p, nearest(p, v[p])[1]].append(v[p])
        for (p, e), vs in held.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [("".join(f"{e:02x}" for _, e in g), sum(d for d, _ in g)) for g in got], digest


def test_codes_of_odd_vectors(spark):
    rng = random.Random(6)
    whole = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(8)], rng.choice(["a", "b", None])) for i in range(200)]
    whole += [(5, [1.0] * 8, "b"), (5, [1.0] * 8, "b"), (300, [-0.0] * 8, "only")]
    dropped = [(1, None, "a"), (2, [None] * 8, "a"), (3, [float("nan")] * 8, "a"), (4, [float("-inf")] + [0.0] * 7, "b")]
    uncoded = [(0, [], "a"), (0, [1.0] * 7, "none"), (0, [1.0] * 12, "a"), (400, [1e9] + [0.0] * 7, "b"), (None, [3e38] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in [*whole, *dropped, *uncoded]], "vec_id long, embedding array<float>, label string, code string, error int")
    whole = sorted(((i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in whole), key=lambda r: r[:2])
    got = compress_vectors(df, parts=4, entries=16).collect()
    expected, digest = plain_codes([r[:2] for r in whole], 4, 16, 2)
    sums = Counter()
    for (_, _, label), (_, error) in zip(whole, expected, strict=True):
        sums[label] += error
    rows = [(i, *e, sums[lab]) for (i, _, lab), e in zip(whole, expected, strict=True)]
    rows += [(i, None, None, sums.get(lab)) for i, _, lab in uncoded]
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter(rows)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one = sorted(map(repr, compress_vectors(df.coalesce(1)).collect()))
    assert one == sorted(map(repr, compress_vectors(df.repartition(9)).collect()))


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress_vectors(spark.createDataFrame([], schema)).collect() == []
    (row,) = compress_vectors(spark.createDataFrame([(1, [], 2)], schema)).collect()
    assert row[:4] == (1, None, None, None) and row[4] == hashlib.sha256(b"").hexdigest()
    (row,) = compress_vectors(spark.createDataFrame([(1, [0.5] * 16, 2)], schema)).collect()
    assert row[:4] == (1, "00" * 16, 0, 0)
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([], schema), entries=257)


def test_largest_component_is_exact():
    for width in (16, 64, 1024, 8192):
        m, d = largest_component(width), width // 16
        assert (2 * d * m) ** 2 < 2**60 and width * (2 * m) ** 2 < 2**63 and d * d * (2 * m) ** 2 <= 2**60


# --- ranked search ----------------------------------------------------------------


def plain_search(docs: list[tuple], items: set[tuple], top: int = 10) -> Counter:
    def terms(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for ident, text in items:
        found = []
        for doc, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out.update((ident, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:top], 1))
    return out


ODD = ["", None, " - ", "É é É", "ONE one One", "naïve ﬁne", "\x00a\x7fb", "a_b", "\U0001f600 smile", "1 22 333"]


def some_texts(rng: random.Random, rows: int) -> list[str | None]:
    words = [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=int(3 * rng.paretovariate(0.8)) % 700 + 1)) for _ in range(rows)]
    return [*texts, *ODD, *[texts[0]] * 40, " ".join(rng.choices(words, k=30_000))]


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_search_against_full_scoring(spark, monkeypatch, blocks):
    rng = random.Random(7)
    docs = [(None if i % 50 == 0 else i % 260, t) for i, t in enumerate(some_texts(rng, 300))]
    items = [(i % 20, t) for i, t in enumerate(some_texts(rng, 25)[:-1])]
    items += [items[3], (None, "w1 w2 w3 one"), (None, "É"), (99, "absent words")]
    if blocks == "many":
        monkeypatch.setattr(S, "_DOCUMENTS", 7)
        monkeypatch.setattr(S, "_CELLS", 200)
    df = spark.createDataFrame([(i, t, "", "", 0, 0) for i, t in docs], DOCS.replace("target", "rank")).repartition(3)
    wanted = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, score int, n int")
    got = S.search(df, wanted, block_bytes=10**6 if blocks == "one" else 3000).collect()
    assert Counter(tuple(r) for r in got) == plain_search(docs, set(items))


def test_search_block_returns_all_that_may_count():
    rng = np.random.default_rng(8)
    for _ in range(60):
        impacts = (rng.integers(0, 4, (12, 40)) * rng.integers(0, 2, (12, 40))).astype(np.int32)
        block = S._Block(np.arange(0, 24, 2, dtype=np.int32), impacts)
        terms = np.sort(rng.choice(24, 9, replace=False)).astype(np.int32)
        weights = rng.integers(1, 5, 9)
        score = sum(w * impacts[t // 2].astype(int) for t, w in zip(terms, weights, strict=True) if t % 2 == 0)
        needed = int(rng.integers(0, score.max() + 2)) if np.ndim(score) else 0
        rows, scores = block.best(terms, weights, needed, 5)
        assert (np.asarray(score)[rows] == scores).all()
        order = np.sort(score[score > 0])[::-1]
        floor = max(needed, 1, order[4] if len(order) > 4 else 1)
        assert set(np.flatnonzero(score >= floor)) <= set(rows.tolist())


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert [tuple(r)[:3] for r in S.search(docs, items).collect()] == [("x", 1, 1)]
    more = docs.unionByName(spark.createDataFrame([(i, "c") for i in range(9)], docs.schema))
    assert [tuple(r)[:3] for r in S.search(more, items).collect()] == [("x", 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert S.search(d, i).collect() == []
    assert S.search(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items).collect() == []
