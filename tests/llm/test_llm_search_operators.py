"""Largest products, phrases and hard negatives against brute force, and on awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import collocations, hard_negatives, meetings, metric_tree

VECTORS = "vec_id long, embedding array<double>, label int"
TEXTS = "doc_id long, text string, lang string"


def clash(df):
    """Extra columns with the names that the operators use."""
    for name in ("id", "vec", "ids", "dim", "shard", "block", "page", "rank", "place", "cell", "score", "qno", "ano", "n", "a", "phrase", "words", "bit", "parts", "is_query"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def scaled(vec, factor):
    """The whole components of a vector that takes part, else None."""
    if vec is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * factor) for x in vec):
        return None
    return tuple(int(math.floor(x * factor)) for x in vec)


def taking_part(rows, factor):
    """Distinct (id, components, label)."""
    return {(i, scaled(v, factor), label) for i, v, label in rows if i is not None and scaled(v, factor) is not None}


def product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


# Largest inner products


def brute_products(rows, every, k):
    known = {(i, v) for i, v, _ in taking_part(rows, 1024)}
    out = []
    for own, q in known:
        if own % every == 0:
            found = sorted((-product(q, v), i) for i, v in known if i != own and len(v) == len(q))[:k]
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def products(spark, rows, every=10, k=4):
    df = metric_tree.largest_products_by_rule(clash(spark.createDataFrame(rows, VECTORS)), every, k)
    return sorted(tuple(r) for r in df.collect())


def random_vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim)) * 3
    vecs = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, dim)) * 0.1
    return [(i, [float(x) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(vecs)]


@pytest.mark.parametrize("small", [False, True])
def test_products_equal_brute_force(spark, monkeypatch, small):
    if small:
        # Many cells, cells of several shards, several blocks of queries.
        monkeypatch.setattr(metric_tree, "shard_count", lambda n, p: 7)
        monkeypatch.setattr(metric_tree, "SHARD_ROWS", 40)
        monkeypatch.setattr(metric_tree, "BLOCK_QUERIES", 15)
    rows = random_vectors(1, 400)
    assert products(spark, rows) == brute_products(rows, 10, 4)


def test_products_on_ties_and_scaled_copies(spark):
    vec = [0.5, -0.25, 0.125]
    rows = [(i, vec, 0) for i in range(1, 90)] + [(100 + i, [x * 2.0**i for x in vec], 0) for i in range(8)] + [(200 + i, [0.0, 0.0, 0.0], 0) for i in range(30)]
    # Different vectors with one product.
    rows += [(300 + i, [0.0, float(i), 2.0 * i], 0) for i in range(50)]
    random.Random(2).shuffle(rows)
    assert products(spark, rows) == brute_products(rows, 10, 4)


def test_products_on_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (0, [3.0, -1.0], 0), (None, [1.0, 1.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0),
        (4, [math.inf, 1.0], 0), (5, [1.0, 2.0, 3.0], 0), (10, [0.0, 0.0, 1.0], 0), (20, [], 0), (21, [], 0), (6, [1e300, -1e300], 0), (7, [1e17, 3.0], 0), (30, [-1e17, 5.0], 0),
        (8, [1e308, 0.0], 0), (9, [0.0004, -0.0004], 0), (11, [0.0004, -0.0004], 0), (12, [-0.0, 0.0], 0), (40, [1e9, 1e9], 0), (13, [1e9, 1e9 + 1], 0),
    ]
    assert products(spark, rows, k=30) == brute_products(rows, 10, 30)
    assert products(spark, []) == []


def test_tree_avoids_products_and_is_balanced():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 8)) * 1000
    vecs = np.unique(np.floor(np.repeat(centres, 100, 0) + rng.standard_normal((4000, 8)) * 5), axis=0)
    tree = metric_tree.bulk_load(vecs, [[i] for i in range(len(vecs))], page=16)
    assert np.diff(tree.starts).max() <= 16
    assert sorted(i for ids in tree.ids for i in ids) == list(range(len(vecs)))
    for q in vecs[::400]:
        want = sorted((-int(s), i) for i, s in enumerate(vecs @ q))[:5]
        assert tree.search(q, 5, -1) == [(-s, i) for s, i in want]
    searches = len(vecs[::400])
    assert tree.avoided > 0 and tree.computed < searches * len(vecs) / 4


def test_stored_bounds_hold():
    rng = np.random.default_rng(4)
    vecs = np.unique(np.floor(rng.standard_normal((900, 5)) * 300), axis=0)
    tree = metric_tree.bulk_load(vecs, [[i] for i in range(len(vecs))], page=8)
    points = metric_tree.lifted(tree.vecs, tree.largest)

    def below(page):
        rows = range(tree.starts[page], tree.starts[page + 1])
        return [r for row in rows for r in (below(tree.child[row]) if tree.child[row] >= 0 else [row])]

    for row in np.flatnonzero(tree.child >= 0):
        members = points[below(tree.child[row])]
        assert metric_tree.distances(members, points[row]).max() <= tree.radius[row] + 1e-6
        page = slice(tree.starts[tree.child[row]], tree.starts[tree.child[row] + 1])
        assert np.allclose(tree.above[page], metric_tree.distances(points[page], points[row]))


# Hard negatives


def brute_negatives(rows, anchor_ids, positives, negatives, lowest=30, highest=90):
    known = taking_part([r for r in rows if r[2] is not None], 256)
    out = []
    for own, q, label in known:
        if own not in anchor_ids:
            continue
        scored = sorted((-product(q, v), i, other) for i, v, other in known if len(v) == len(q))
        for minus, positive in [(m, i) for m, i, other in scored if other == label and i != own][:positives]:
            fits = [(m, i) for m, i, other in scored if other != label and lowest * -minus <= 100 * -m <= highest * -minus][:negatives]
            out += [(own, positive, rank, i, -minus, -m) for rank, (m, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchor_ids, positives=3, negatives=4):
    df = clash(spark.createDataFrame(rows, VECTORS))
    found = hard_negatives.hard_negatives(df, df.where(F.col("vec_id").isin(*anchor_ids)), positives, negatives)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(hard_negatives, "shard_count", lambda n, p: 5)
        monkeypatch.setattr(hard_negatives, "BLOCK_QUERIES", 4)
        monkeypatch.setattr(hard_negatives, "CHUNK", 16)
        monkeypatch.setattr(hard_negatives, "TOGETHER", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(11) + 0.5], int(rng.integers(0, 3))) for i in range(300)]
    want = brute_negatives(rows, {0, 30, 60, 90, 120, 150, 180, 210, 240}, 3, 4)
    assert len(want) > 50
    assert mined(spark, rows, {0, 30, 60, 90, 120, 150, 180, 210, 240}) == want


def test_negatives_on_ties_and_few_rows(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(40)] + [(100 + i, [0.5, 0.25], 1) for i in range(40)] + [(200 + i, [0.25 * i, 1.25 - 0.5 * i], 2) for i in range(6)]
    rows += [(300, [1.0, 2.0], 7), (301, [-1.0, 0.0], 8), (302, [-1.0, -1.0], 8), (303, [0.0, 0.0], 9), (304, [0.0, 0.0], 9)]
    random.Random(6).shuffle(rows)
    anchors = {5, 100, 300, 301, 303}
    assert mined(spark, rows, anchors) == brute_negatives(rows, anchors, 3, 4)


def test_negatives_on_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 2), (1, [1.0, 1.5], 1), (2, [0.7, 1.0], 2), (2, [0.7, 1.0], 2), (3, [0.5, 1.0], None), (None, [1.0, 1.0], 1), (4, None, 1),
        (5, [1.0, None], 1), (6, [math.nan, 1.0], 2), (7, [math.inf, 1.0], 2), (8, [1.0, 1.0, 1.0], 1), (9, [1e12, 1e12], 1), (10, [2e12, 1e11], 1), (11, [5e11, 2e11], 2), (12, [], 1), (13, [], 1), (14, [], 2),
    ]
    anchors = {0, 9, 8, 12}
    assert mined(spark, rows, anchors) == brute_negatives(rows, anchors, 3, 4)
    assert mined(spark, [], anchors) == []


def test_labels_of_ids_divisible_by_seven_move_on(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(9)], None if i == 13 else int(i % 10)) for i in range(350)]
    moved = [(i, v, None if label is None else (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine_embeddings(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == brute_negatives(moved, {0, 100, 200, 300}, 5, 10)


@pytest.mark.parametrize("size", [3.0, 1e5, 2.0**40, 2.0**70])
def test_bit_planes_give_exact_products(size):
    rng = np.random.default_rng(9)
    for dim in (1, 8, 13):
        rows = np.floor(rng.standard_normal((50, dim)) * size)
        anchors = np.floor(rng.standard_normal((4, dim)) * size)
        want = [[product([int(x) for x in r], [int(x) for x in a]) for a in anchors] for r in rows]
        assert [[int(x) for x in line] for line in hard_negatives.scores(hard_negatives.BitPlanes(rows), anchors)] == want


def test_subset_sums_are_those_of_the_bits():
    anchors = np.arange(1, 19).reshape(2, 9)
    table = hard_negatives.subset_sums(anchors)
    for group in range(2):
        for byte in (0, 1, 5, 77, 255):
            for i, anchor in enumerate(anchors):
                part = anchor[group * 8 : group * 8 + 8]
                assert table[group, byte, i] == sum(int(x) for bit, x in enumerate(part) if byte >> bit & 1)


# Phrases


def brute_phrases(rows, support, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        kept = []
        frequent = {p: a for p, a in f.items() if a >= support and len(p) >= 2}
        for p, a in frequent.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def phrases(spark, rows, support, top=None, **args):
    df = clash(spark.createDataFrame(rows, TEXTS)).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(df, support, top, **args).collect())


def varied_texts(seed, n):
    rng = random.Random(seed)
    words = ["Red", "sun", "rises", "été", "ΩMEGA", "x=1", "漢字", "the", "of", "a\x00b", "\xa0", "r\x1cs"]
    fixed = [["New", "York", "City"], ["the", "the", "the"], ["as", "soon", "as", "possible", "today"], ["one", "two", "three", "four", "five", "six"]]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(30)):
            out += rng.choice(fixed) if rng.random() < 0.5 else [rng.choice(words)]
            out.append(rng.choice([" "] * 12 + ["\t", "  ", ".", "\n", "\r\n", "!? ", ";", "\x0b"]))
            if rng.random() < 0.8 and out[-1].strip(" \t") == "":
                out[-1] = " "
        text = "".join(w if w.strip(" \t.,;:!?\n\r\x0b\x0c") == "" else f"{w} " for w in out)
        docs.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return docs


@pytest.mark.parametrize("shards,run_words,bits", [(10, 1 << 20, 1 << 20), (4, 60, 1 << 20), (50, 60, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, shards, run_words, bits):
    # Many shards lower the support to 1; a bitmap of 64 bits lets nearly everything through.
    monkeypatch.setattr(collocations, "BUFFER_CHARS", run_words * 4)
    monkeypatch.setattr(collocations, "BLOCK_HASHES", run_words)
    rows = varied_texts(1, 300)
    want = brute_phrases(rows, 12, None)
    assert len(want) > 30
    assert phrases(spark, rows, 12, shards=shards, run_words=run_words, bits=bits) == want


def test_only_the_first_phrases_of_a_language_are_returned(spark):
    rows = varied_texts(2, 200)
    got = phrases(spark, rows, 5, 7)
    assert got == brute_phrases(rows, 5, 7)
    assert Counter(r[0] for r in got) == {"en": 7, "de": 7, "und": 7}


def test_phrases_on_awkward_texts(spark):
    long = "one very long text " * 20_000
    rows = [(1, None, "en"), (2, "", None), (None, "Again and Again and again", None), (3, long, "en"), (3, long, "en"), (4, " \t\n.,;", "de"), (5, "a b" + "c" * 100_000, "de"), (6, "I ı İ K Å a b", "tr")]
    assert phrases(spark, rows, 2) == brute_phrases(rows, 2, None)
    assert phrases(spark, [], 2) == []


def test_scores_are_exact_beyond_64_bits(spark):
    # 1000 * a * n passes 64 bits: counts are given by the table instead of texts.
    frequent = spark.createDataFrame([("en", "x y", 2, 3_000_000_007), ("en", "x", 1, 3_000_000_011), ("en", "y", 1, 9_000_000_019)], "lang string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", 7_000_000_000_001)], "lang string, n long")
    row = collocations.scored_phrases(frequent, totals).collect()[0]
    assert row["score"] == 1000 * 3_000_000_007 * 7_000_000_000_001 // (3_000_000_011 * 9_000_000_019)


def test_equal_hashes_do_not_add_up(spark, monkeypatch):
    # All phrases have one hash: nothing is left out, and counts are still those of the words.
    monkeypatch.setattr(collocations, "bits_of", lambda hashes, bits, shard=None: np.zeros(len(hashes), np.uint64))
    rows = varied_texts(5, 60)
    assert phrases(spark, rows, 6) == brute_phrases(rows, 6, None)


def test_spelled_phrases_travel_in_blocks(spark):
    # A task sends a row per language, length and range, however many phrases it met.
    rows = [(i, " ".join(f"w{i * 50 + j}" for j in range(50)), "en") for i in range(40)]
    runs = collocations.word_runs(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("lang", F.col("text").cast("binary").alias("text")).repartition(2), 1, 1 << 20)
    every = spark.sparkContext.broadcast(np.full(8, 255, np.uint8))
    blocks = collocations._spelled(runs, every, 3, 64)
    assert blocks.count() <= 2 * 5 * 3
    counted = collocations._counted(blocks, 1, 3)
    assert counted.groupBy("words").count().orderBy("words").collect() == [(n, 40 * (51 - n)) for n in range(1, 6)]
    assert counted.filter("a <> 1").count() == 0


def test_runs_and_blocks_reach_tasks_a_few_at_a_time(spark, monkeypatch):
    # A run is a megabyte or more: Spark's own batches hold a whole partition of them.
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, cut = spark.conf.get(name), [], collocations.cut_lineage

    def noted(df, *args):
        seen.append(int(spark.conf.get(name)))
        return cut(df, *args)

    monkeypatch.setattr(collocations, "cut_lineage", noted)
    rows = varied_texts(3, 50)
    assert phrases(spark, rows, 4) == brute_phrases(rows, 4, None)
    assert len(seen) > 3 and set(seen) == {collocations.BYTES_AT_ONCE}
    assert spark.conf.get(name) == before

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with collocations.small_batches(spark, 1_000_000):
        met = spark.range(0, 20, 1, 1).select(F.expr("cast(repeat('x', 400000) as binary)").alias("b")).mapInArrow(sizes, "n long").collect()
    assert max(r["n"] for r in met) == 3 and sum(r["n"] for r in met) == 20


def test_phrases_are_sent_on_within_a_run(spark):
    # One run has more phrases than a task holds.
    held = collocations.SPELLED_HELD
    words = " ".join(f"w{j}" for j in range(held // 2))
    texts = spark.createDataFrame([(words, "en")], "text string, lang string").select("lang", F.col("text").cast("binary").alias("text"))
    blocks = collocations._spelled(collocations.word_runs(texts.repartition(1), 1, 1 << 20), spark.sparkContext.broadcast(np.full(8, 255, np.uint8)), 1, 64)
    sent = blocks.select((F.length("counts") / 8).cast("int").alias("n")).collect()
    assert max(r["n"] for r in sent) <= held
    assert len(sent) > 5
    assert collocations._counted(blocks, 1, 1).filter("a <> 1").count() == 0


# Rows and queries in tasks


def test_queries_without_rows_and_rows_without_queries(spark):
    rows = spark.createDataFrame([(1, 0, [1.0], 1), (1, 0, [2.0], 2), (2, 0, [3.0], 3)], "shard int, block int, vec array<double>, no int")
    asked = spark.createDataFrame([(1, 0, 7), (3, 0, 8)], "shard int, block int, qno int")

    def seen(batches):
        import pyarrow as pa

        for stored, queries in meetings.groups(batches, ["shard", "block"]):
            yield pa.RecordBatch.from_pydict({"stored": [sum(b.num_rows for b in stored)], "asked": [sum(b.num_rows for b in queries)]})

    met = meetings.meet(rows, asked, ["shard", "block"], ["no"]).mapInArrow(seen, "stored long, asked long")
    assert sorted(tuple(r) for r in met.collect()) == [(0, 1), (1, 0), (2, 1)]
