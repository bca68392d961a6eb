"""The corpus pipeline, stage by stage, against brute force."""

import zlib

import numpy as np
import pytest
from test_llm_group_operators import brute_groups, check_sequences
from test_llm_text_operators import brute_dedup

import corpus_pipeline
from tablewright.llm import mixing, quality
from tablewright.llm.queries import word_tokenizer
from tablewright.llm.tokens import TextEncoder
from tablewright.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What every stage returned, from the documents on."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], sf_dir)))
    return out


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_those_asked_for(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "pack"]
    assert all(df.columns == COLUMNS for df in kept[:5])


def test_quality_keeps_what_the_operator_accepts(spark, sf_dir, kept):
    table = quality.quality_table(kept[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    accepted = {r["doc_id"] for r in table.collect() if r["predicted"] == 1}
    before, after = rows_of(kept[0]), rows_of(kept[1])
    assert set(after) == accepted and all(after[i] == before[i] for i in after)


def test_lines_equal_brute_force(kept):
    before, after = rows_of(kept[1]), rows_of(kept[2])
    want = brute_dedup(sorted((i, r["text"]) for i, r in before.items()))
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == before[i]["source"] for i, r in after.items())


def has_words(text):
    return (text or "").strip(" \t\n\f\r") != ""


def test_copies_that_lost_their_words_do_not_stay(spark):
    """The line stage empties later copies; at most one wordless document goes on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    emptied = cut_lineage(corpus_pipeline.lines(spark, docs, ""))
    assert sum(not has_words(r["text"]) for r in emptied.collect()) > 1
    assert sum(not has_words(r["text"]) for r in corpus_pipeline.near_copies(spark, emptied, "").collect()) == 1


def test_one_of_each_group_stays(kept):
    before, after = rows_of(kept[2]), rows_of(kept[3])
    groups = brute_groups(sorted((i, r["text"]) for i, r in before.items() if has_words(r["text"])))
    wordless = [i for i, r in before.items() if not has_words(r["text"])]
    assert set(after) == {i for i, (first, _) in groups.items() if first == i} | set(sorted(wordless)[:1])
    assert all(after[i] == before[i] for i in after)


def test_mix_is_the_schedule_of_the_same_rows(kept):
    assert rows_of(kept[4]) == rows_of(kept[3])
    order = sorted((r["mix_slot"], r["mix_start"], r["doc_id"]) for r in mixing.mix_sources(kept[3]).collect())
    assert [r["doc_id"] for r in mixing.in_mixed_order(kept[3]).collect()] == [i for _, _, i in order]


def test_pack_keeps_every_token(kept):
    tokenizer = TextEncoder(word_tokenizer()).tokenizer
    want = {}
    for r in kept[4].collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], piece] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    rows = kept[5].collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    check_sequences(rows, 2048)


def test_run_gives_the_last_stage(spark, sf_dir, kept):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*key).collect())) == sorted(map(tuple, kept[5].select(*key).collect()))


def test_awkward_documents_pass_every_stage(spark, sf_dir):
    rows = [
        (1, "a b c d e f g\nsecond line\nthird line", "en", "s", 10),
        (1, "a b c d e f g\nsecond line\nthird line", "en", "s", 10),
        (None, "a b c d e f g\nsecond line\nthird line", None, None, None),
        (2, None, "en", "s", None),
        (3, "", None, "t", 0),
        (4, "long " * 30_000, "en", "t", 150_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        out = given
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = cut_lineage(stage(spark, out, sf_dir))
        ids = {r["doc_id"] for r in out.collect()}
        # The copy without an id comes first, so it keeps the passage; of the texts without words the smallest id stays.
        assert ids == ({None, 1, 4} if given is docs else set())
    scored = corpus_pipeline.quality(spark, docs, sf_dir)
    assert scored.columns == COLUMNS and scored.count() <= 6
