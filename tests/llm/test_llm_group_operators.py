"""Near copies, packing, transcripts, token files and neighbours against brute force, and on awkward tables."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chat, components, jaccard_join, mixing, neighbours, packing, token_files
from tablewright.llm.queries import word_tokenizer
from tablewright.llm.tokens import TextEncoder, encoder
from tablewright.session import scratch_path

SCHEMA = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    rows = [
        (1, "one two three four five six seven", "s"),
        (1, "one two three four five six seven", "s"),
        (None, "one two three four five six seven", None),
        (2, None, "s"),
        (3, "", None),
        (4, LONG, "t"),
        (None, None, None),
        (5, "ünïcödé 漢字 🙂\r\n\x1c\x85\xa0don't <|endoftext|>x", "t"),
    ]
    df = frame(spark, rows)
    for name in ("id", "h", "set", "start", "part", "conv", "leaf", "piece", "shard", "links", "group", "c0", "sequence_id", "rank"):
        df = df.withColumn(name, df.doc_id)
    return df


def empty(spark):
    return frame(spark, [])


# Near copies


def grams(text):
    words = [w for w in __import__("re").split("[ \t\n\f\r]+", (text or "").lower()) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(docs):
    """docs: list of (id, text) -> id: (class, links)."""
    sets = [(i, grams(t)) for i, t in docs]
    links = {i: set() for i, _ in sets}
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            common = len(x & y)
            if x and y and common >= 0.8 * (len(x) + len(y) - common):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


def varied(seed, n):
    """Families of texts that differ by word changes, a passage that all share, and loners."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    shared = [word() for _ in range(12)]
    docs = []
    for family in range(n):
        base = [word() for _ in range(rng.choice([3, 6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            docs.append((len(docs), " ".join(words + (shared if rng.random() < 0.7 else []))))
    return docs


@pytest.mark.parametrize("small,block", [(512, 512), (4, 8)])
def test_near_copies_equal_brute_force(spark, monkeypatch, small, block):
    # Small limits make buckets split again and be compared in blocks.
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = varied(3, 60)
    rows = jaccard_join.similar_documents(frame(spark, docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == brute_groups(docs)


def test_one_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(600):
        words = list(base)
        words[i % 200] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(600 + i, " ".join(base)) for i in range(400)]
    rows = jaccard_join.similar_documents(frame(spark, docs, "doc_id long, text string")).collect()
    assert {(r["class_id"], r["n_links"]) for r in rows} == {(0, 999)}
    kept = jaccard_join.one_of_each(frame(spark, docs, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_near_copies_on_awkward_tables(spark):
    df = awkward(spark)
    rows = jaccard_join.similar_documents(df).collect()
    assert len(rows) == 8
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] == 1] == [(1, 2), (1, 2)]
    assert sorted((r["class_id"] or 0, r["n_links"]) for r in rows if r["doc_id"] is None) == [(0, 0), (1, 2)]
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert jaccard_join.similar_documents(empty(spark)).count() == 0
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


def test_runs_grow_with_the_target():
    assert jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.999) < jaccard_join.runs_for(0.999999)


def test_shingle_hashes_follow_the_words():
    assert len(jaccard_join.shingles(" \n\t")) == 0
    assert (jaccard_join.shingles("A b  C\nd e F") == jaccard_join.shingles("a B c d E f ")).all()
    assert len(jaccard_join.shingles(LONG)) == len(grams(LONG))
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(50)]
    for a, b in zip(texts, texts[1:]):
        assert len(np.intersect1d(jaccard_join.shingles(a), jaccard_join.shingles(b))) == len(grams(a) & grams(b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(200, 200), (None, 3), (7, 7)]
    found = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# Packing and token files


def brute_best_fit(lengths, capacity, open_bins):
    bins, out = [], []  # bins: [free, number, opened]
    count = 0
    for length in lengths:
        fit = [b for b in bins if b[0] >= length]
        if fit:
            least = min(b[0] for b in fit)
            b = [b for b in fit if b[0] == least][-1]
            bins.remove(b)
        else:
            b = [capacity, count]
            count += 1
        out.append((b[1], capacity - b[0]))
        b[0] -= length
        if b[0]:
            bins.append(b)
            if len(bins) > open_bins:
                least = min(x[0] for x in bins)
                closing = [x for x in bins if x[0] == least]
                # The newcomer closes if no other is fuller; else the one that has waited longest.
                bins.remove(b if b[0] == least else closing[0])
    return out


@pytest.mark.parametrize("open_bins", [1, 2, 5, 1_000])
def test_best_fit_equals_brute_force(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.randint(1, 40) for _ in range(800)]
    assert list(packing.best_fit(lengths, 40, open_bins)) == brute_best_fit(lengths, 40, open_bins)


def check_sequences(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_keeps_every_token(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    tokenizer = TextEncoder(word_tokenizer()).tokenizer
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], piece] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    for in_order in (False, True):
        rows = packing.pack_documents(docs, word_tokenizer(), in_order=in_order).collect()
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
        n = check_sequences(rows, 2048)
        assert n <= sum(x[1] for x in want.values()) / 2048 * 1.03 + 5


def test_packing_on_awkward_tables(spark):
    rows = packing.pack_documents(awkward(spark), word_tokenizer()).collect()
    assert sum(r["piece"] == 0 for r in rows) == 8
    assert sorted(r["length"] for r in rows if r["doc_id"] in (2, 3)) == [1, 1]
    check_sequences(rows, 2048)
    assert packing.pack_documents(empty(spark), word_tokenizer()).count() == 0


TEXTS = [
    "", " ", "Hello, World!", "it's don't I'LL we've", "naïve café ÀÉÎ ß straße", "é café", "漢字 かな 한국어", "🙂🙃 a🙂b", "x\x1cy \x1d", "a\x85b\xa0c d e",
    "12345 3.14 a1b2", "<|endoftext|> x<|startoftext|>y", "...!!! ,,,a b...", "Σίσυφος ΣΑΣ", "ﬁne İstanbul", "tab\tnew\nline\r\n", "word" * 500, "a-b_c/d\\e", "АБВ где", "ÿ×÷", "&&&### $$$",
]


def test_cached_words_equal_the_library():
    fast = TextEncoder(word_tokenizer())
    assert fast.words is not None
    for text in [*TEXTS, " ".join(TEXTS)]:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == fast.tokenizer.encode(text, add_special_tokens=False).ids


def test_cache_of_words_is_bounded(monkeypatch):
    from tablewright.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_WORDS", 10)
    fast = TextEncoder(word_tokenizer())
    text = " ".join(f"w{chr(97 + i % 26)}{'x' * (i % 40)}." for i in range(400))
    assert np.frombuffer(fast.ids(text), "<u4").tolist() == fast.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(fast.words) <= 10


@pytest.mark.parametrize("width", [1, 3, 7, 15, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1_000):
        ids = rng.integers(0, 2**width, n, np.uint64)
        data = token_files.pack(ids, width)
        assert len(data) == -(-n // 64) * width * 8
        assert (token_files.unpack(data, width, n) == ids).all()


def test_random_access_reads_only_its_blocks():
    out = io.BytesIO()
    writer = token_files.BitWriter(out, 49_408, block_ids=128)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 49_408, n).astype("<u4") for n in (0, 5, 1_000, 127, 128, 129, 1)]
    for i, ids in enumerate(docs):
        writer.add(i or None, ids)
    writer.close()
    reader = token_files.BitReader(out)
    whole = np.concatenate(docs)
    assert reader.width == 16 and reader.n_ids == len(whole) and reader.doc_ids == [None, 1, 2, 3, 4, 5, 6]
    assert reader.lengths.tolist() == [len(d) for d in docs]
    for start, stop in ((0, 0), (0, len(whole)), (127, 129), (500, 501), (1_380, 5_000)):
        assert (reader.ids(start, stop) == whole[start:stop]).all()


def test_token_files_equal_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = TextEncoder(word_tokenizer()).tokenizer
    got = {r["doc_id"]: r for r in token_files.token_table(docs, word_tokenizer(), 1).collect()}
    start = 0
    for r in sorted(docs.collect()):
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_on_awkward_tables(spark, monkeypatch):
    rows = token_files.token_table(awkward(spark), word_tokenizer(), 1).collect()
    assert len(rows) == 8
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    manifest = token_files.write_token_files(empty(spark), scratch_path(spark, "none"), word_tokenizer(), 1)
    assert token_files.read_token_files(manifest).count() == 0


# Transcripts


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_transcripts_equal_whole_conversations(spark, uncoalesced):
    """Cut into many segments, the counts, paths and texts are those of each conversation in one go."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hot = spark.range(1_500).select(F.lit(3).alias("conv_id"), (F.col("id") + 100).alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Line "), F.col("id").cast("string")).alias("text"))
    raw = chat.raw_transcripts(turns.select("conv_id", "turn", "role", "text").unionByName(hot))
    placed = chat.place_parts(raw, "conv_id", "turn", "text")
    assert placed.where("conv = 3").select("segment").distinct().count() > 1
    counts, convs = chat.Counts(), {}
    for r in sorted(placed.collect(), key=lambda r: (r["conv"], r["part"])):
        convs.setdefault(r["conv"], []).append(r)
    for rows in convs.values():
        before = None
        for r in rows:
            if r["learn"]:
                seen = [chat.observe(x) for x in chat.lines_of(r["text"])]
                states = chat.known_states(r["role"], seen)
                counts.add(before, states, seen)
                before = states[-1]
    model = chat._model(np.array(counts.flat()))
    fitted = chat.fit_transcripts(placed)
    assert np.allclose(model.start, fitted.start) and np.allclose(model.step, fitted.step)
    assert all(np.allclose(a, b) for a, b in zip(model.emit, fitted.emit))
    got = {(r["conv"], r["part"]): (r["rendered"], r["parsed_role"]) for r in chat.parse_placed(placed, fitted).collect()}
    for conv, rows in convs.items():
        parts = [chat.lines_of(r["text"]) for r in rows]
        seen = [chat.observe(x) for lines in parts for x in lines]
        texts, roles, _ = chat.render(parts, seen, chat.viterbi(model.line_scores(seen), model), None, False)
        assert [got[conv, r["part"]] for r in rows] == list(zip(texts, roles))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    n = chat.N_STATES
    model = chat.TranscriptModel(rng.standard_normal(n), rng.standard_normal((n, n)), [])
    scores = rng.standard_normal((4, n))
    best = max(
        ((model.start[a] + scores[0, a] + model.step[a, b] + scores[1, b] + model.step[b, c] + scores[2, c] + model.step[c, d] + scores[3, d], [a, b, c, d]) for a in range(n) for b in range(n) for c in range(n) for d in range(n))
    )
    assert chat.viterbi(scores, model) == best[1]
    start, through = chat.reduce_piece(scores[:2], model)
    assert start.max() == pytest.approx(max((model.start[a] + scores[0, a] + model.step[a, b] + scores[1, b]) for a in range(n) for b in range(n)))
    assert through[5].max() == pytest.approx(max((model.step[5, a] + scores[0, a] + model.step[a, b] + scores[1, b]) for a in range(n) for b in range(n)))


def test_roles_of_held_out_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in turns.collect()}
    rows = chat.transcript_table(turns).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if zlib.crc32(str(r["conv_id"]).encode()) % 5 == 0]
    assert np.mean([r["parsed_role"] == truth[r["conv_id"], r["turn"]] for r in held]) > 0.93


def test_further_roles_are_learned(spark):
    """A role that has no words of its own is found by its name and by what follows what."""
    order = ["user", "tool", "assistant"]
    rows = [(c, t, order[t % 3], f"Some words of turn {t}.") for c in range(200) for t in range(9)] + [(500, 0, None, "No role.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    raw = chat.raw_transcripts(turns)
    assert chat.speakers_of(chat.place_parts(raw, "conv_id", "turn", "text")).names == ("system", "user", "assistant", "tool")
    got = [r for r in chat.transcript_table(turns).collect() if r["conv_id"] < 500 and zlib.crc32(str(r["conv_id"]).encode()) % 5 == 0]
    assert got and np.mean([r["parsed_role"] == order[r["turn"] % 3] for r in got]) > 0.95
    assert any("<|tool|>" in r["rendered"] for r in got)


def test_conversations_come_one_at_a_time():
    """A conversation is handed on when the next one begins, across batches and segments."""
    rows = [(0, 1), (0, 1), (0, 2), (1, 2), (1, None), (1, None), (2, 7)]
    taken = []

    def batches():
        for segment, conv in rows:
            taken.append((segment, conv))
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "conv": pa.array([conv], pa.int64())})

    found = chat._conversations(batches())
    assert [x for x in next(found)[:3]] == [0, 0, False] and len(taken) == 3
    assert [(s, at, last, len(parts)) for s, at, last, parts in found] == [(0, 1, True, 1), (1, 0, False, 1), (1, 1, True, 2), (2, 0, True, 1)]


def test_range_bounds_hold_no_texts(spark):
    """What is sampled to cut the order into ranges are ids and hashes; rows of one id and hash stay in order of text."""
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    seen = []
    cut, chat.cut_lineage = chat.cut_lineage, lambda df: seen.append(df) or df
    try:
        chat.place_parts(chat.raw_transcripts(turns), "conv_id", "turn", "text")
    finally:
        chat.cut_lineage = cut
    ranges = [x for x in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(ranges) == 1
    assert "text" not in ranges[0].replace("xxhash64(text", "")


def test_markers():
    assert chat.observe("  ")[0] == chat.BLANK
    for line, role, at in (("User: hi", "user", 6), ("### Response", "assistant", 12), ("<|assistant|> yes", "assistant", 14), ("**Human**: x", "user", 11), ("Note: x", "other", 0), ("plain words: x", "none", 0)):
        mark, *_, begin = chat.observe(line)
        assert (chat.MARKS[mark], begin) == (role, at), line


def test_transcripts_on_awkward_tables(spark):
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, None, "system", "be kind"), (None, 1, "user", None), (None, 2, None, ""), (2, 0, "robot", "x\n" * 5_000), (2, 1, "assistant", "ok")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("segment", F.lit(2)).withColumn("learn", F.lit(False))
    got = chat.transcript_table(turns).collect()
    assert len(got) == 6 and sum(r["copies"] for r in got) == 7
    assert [r["n_lines"] for r in got if r["conv_id"] is None and r["turn"] == 1] == [0]
    assert chat.transcript_table(turns.limit(0)).count() == 0


# Neighbours


def brute_neighbours(rows, k):
    out = {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for q in vectors:
        if q % 50 == 0:
            scores = [(-float((vectors[q] * v).sum() / (np.sqrt((vectors[q] ** 2).sum()) * np.sqrt((v**2).sum()))), i) for i, v in vectors.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_neighbours_reach_the_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = neighbours.nearest_by_rule(df).collect()
    want = brute_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 5)
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 8)).astype("float32").tolist()
    rows = [(i, base[i % 30] if i % 3 else base[0]) for i in range(400)]
    rows += [(1_000, None), (1_050, [0.0] * 8), (1_100, [float("nan")] * 8), (1_150, [None] * 8), (1_200, [1.0] * 3), (None, base[1]), (1_250, [float("inf")] * 8), (50, base[20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("vec", F.lit(2)).withColumn("rank", F.lit(3))
    good = [(i, v) for i, v in rows[:400]]
    want = brute_neighbours(good, 5)
    got = {}
    for r in neighbours.nearest_by_rule(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(want)
    for q, found in got.items():
        if q != 50 and q != 0:
            assert [i for _, i in sorted(found)] == [i for i, _ in want[q]]
    assert neighbours.nearest_by_rule(df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in neighbours.nearest_by_rule(two).collect()] == [(0, 7, 1)]


def test_all_ties_of_scaled_copies_are_seen(spark):
    # More vectors of one direction than any answer needs, with ids that do not follow the order of the vectors.
    ids = list(range(1, 60))
    random.Random(7).shuffle(ids)
    rows = [(0, [0.5, -1.5, 2.0])] + [(i, [x * 2.0**n for x in (0.5, -1.5, 2.0)]) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest_by_rule(df).collect()]
    assert sorted(r for r in got if r[0] == 0) == [(0, rank, rank) for rank in range(1, 6)]
    assert sorted(r[2] for r in got if r[0] == 50) == [0, 1, 2, 3, 4]


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(9)
    short, long = ([(i, v.tolist()) for i, v in zip(ids, rng.standard_normal((len(ids), dim)))] for ids, dim in ((range(0, 40), 3), (range(50, 151), 7)))
    df = spark.createDataFrame(short + long, "vec_id long, embedding array<double>")
    want = brute_neighbours(short, 5) | brute_neighbours(long, 5)
    got = {}
    for r in sorted(neighbours.nearest_by_rule(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in found] for q, found in want.items()} and set(got) == {0, 50, 100, 150}


def test_sequences_follow_the_mixing_schedule_after_a_reread(spark, uncoalesced, monkeypatch):
    """The longest texts come last, so readers, who take large files first, change the order of the files."""
    monkeypatch.setattr(packing, "STRETCH_TOKENS", 4_096)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(4 + i % 97 + i // 20)), rng.choice("aaab") if i < 1_500 else "ccd"[i % 3]) for i in range(3_000)]
    path = scratch_path(spark, "mixed")
    options = {"block_chars": 200, "weights": {"a": 6, "b": 3, "c": 0.2, "d": 0.1}}
    docs = frame(spark, rows)
    mixing.in_mixed_order(docs, **options).write.parquet(path)
    reread = spark.read.parquet(path)
    order = [r["doc_id"] for r in sorted(mixing.mix_sources(docs, **options).collect(), key=lambda r: (r["mix_slot"], r["mix_start"], r["doc_id"]))]
    assert len(reread.inputFiles()) > 1 and [r["doc_id"] for r in reread.collect()] != order

    packed = packing.pack_documents(reread, word_tokenizer(), in_order=True, lookahead=50).collect()
    check_sequences(packed, 2048)
    assert sorted((r["doc_id"], r["piece"]) for r in packed) == [(i, 0) for i in range(3_000)]
    rank = {i: n for n, i in enumerate(order)}
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append(r["doc_id"])
    assert all(max(map(rank.get, ids)) - min(map(rank.get, ids)) < 50 for ids in by_sequence.values())
    source, taken, due = {i: s for i, _, s in rows}, dict.fromkeys("abcd", 0), dict.fromkeys("abcd", 0)
    n = 0
    for _, ids in sorted(by_sequence.items()):
        for i in ids:
            taken[source[i]] += 1
            due[source[order[n]]] += 1
            n += 1
        assert all(abs(taken[s] - due[s]) < 50 for s in taken)
