"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text that reads
like the good ones shrinks more with the good dictionary; the difference of its two compressed
sizes, divided by its length, is the evidence. A logistic curve over that difference and the better
compressed share (repetition makes it tiny), fitted on labelled rows that
are not in the dictionaries, turns it into a calibrated probability of the good label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: documents and characters per class for a dictionary, documents for calibration.
#: Documents are taken whole until either bound is reached.
DICTIONARY_DOCS = 2_000
DICTIONARY_CHARS = 32_000_000
CALIBRATION_DOCS = 10_000
#: A text is given to the training of a dictionary in slices, all of them.
SLICE_CHARS = 1_024
DICTIONARY_BYTES = 262_144
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5
#: Of the folds 1 to 4, this one calibrates; the others feed the dictionaries.
CALIBRATION_FOLD = 4
RIDGE = 0.1


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id is in no fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


@dataclass
class QualityModel:
    """What the workers need: two dictionaries and the curve; ``prior`` alone where a class is missing."""

    good: bytes | None
    bad: bytes | None
    prior: float
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(evidence), self.prior)
        return _logistic(np.column_stack([np.ones(len(evidence)), (evidence - self.centre) / self.spread]) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Sizes:
    """Compressed sizes with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def evidence(self, texts: Iterator[bytes]) -> np.ndarray:
        good, bad = self.pair
        sizes = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], float).reshape(-1, 3)
        n = sizes[:, 2] + 1
        difference = (sizes[:, 1] - sizes[:, 0]) / n
        share = np.minimum(sizes[:, 0], sizes[:, 1]) / n
        return np.column_stack([difference, share, share * share, difference * share])


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit_curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method: centre, spread, weights."""
    centre, spread = evidence.mean(0), evidence.std(0) + 1e-9
    x = np.column_stack([np.ones(len(evidence)), (evidence - centre) / spread])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(x @ w)
        curvature = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, x.T @ (labels - p) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return centre, spread, w


def _sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Ids of the bounded sample with their label and use: 'dictionary' or 'calibration'.

    Chosen by a hash of the id, so the same whatever the partitions; at most ``DICTIONARY_DOCS``
    per class and ``CALIBRATION_DOCS`` in all.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    learnt = known.withColumn("fold", fold(F.col("id"))).where("fold <> 0")
    order = [F.xxhash64(F.col("id"), F.lit("quality")), F.col("id")]
    picked = [
        learnt.where((F.col("fold") != CALIBRATION_FOLD) & (F.col("label") == label)).orderBy(*order).limit(DICTIONARY_DOCS).select("id", "label", F.lit("dictionary").alias("use"))
        for label in (0, 1)
    ]
    picked.append(learnt.where(F.col("fold") == CALIBRATION_FOLD).orderBy(*order).limit(CALIBRATION_DOCS).select("id", "label", F.lit("calibration").alias("use")))
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


def _slices(text: str) -> list[bytes]:
    return [text[at : at + SLICE_CHARS].encode() for at in range(0, len(text), SLICE_CHARS)]


def _dictionary_texts(sampled: DataFrame) -> DataFrame:
    """id, label, text of the dictionaries' documents: in the order of the sample until ``DICTIONARY_CHARS`` are reached."""
    # At most DICTIONARY_DOCS ids per label.
    before = Window.partitionBy("label").orderBy(F.xxhash64(F.col("id"), F.lit("quality")), "id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    chosen = sampled.where("use = 'dictionary'").withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return chosen.where(F.col("before") < DICTIONARY_CHARS).select("id", "label", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a bounded sample of the labelled documents (bounds at the top of this module).

    Labels other than 0 and 1, null ids and labels of unknown documents are ignored; an id with
    both labels counts as 0. With one class only, or none, the model gives every text the share of
    label 1 (0.5 without labels).
    """
    spark = docs.sparkSession
    # At most 2 * DICTIONARY_DOCS + CALIBRATION_DOCS rows of an id, a label and a word.
    chosen = spark.createDataFrame(_sample(labels, id_col, label_col).collect(), "id long, label int, use string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sampled = rows.join(F.broadcast(chosen), "id")
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    for r in _dictionary_texts(sampled).orderBy("id", "text").toLocalIterator():
        by_label[r["label"]] += _slices(r["text"])
    counts = [len(by_label[0]), len(by_label[1])]
    known = chosen.groupBy("label").count().collect()
    total = sum(r["count"] for r in known)
    prior = sum(r["count"] for r in known if r["label"] == 1) / total if total else 0.5
    if not all(counts):
        return QualityModel(None, None, prior)
    good, bad = (build_dictionary(_shuffled(by_label[label])) for label in (1, 0))
    model = QualityModel(good, bad, prior)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            evidence = sizes.evidence(t.as_py().encode() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence.tolist(), pa.list_(pa.float64()))], ["label", "evidence"])

    measured = sampled.where("use = 'calibration'").select("label", "text").mapInArrow(measure, "label int, evidence array<double>").collect()
    measured.sort(key=lambda r: (r["label"], r["evidence"]))
    truth = np.array([r["label"] for r in measured], float)
    if len(set(truth.tolist())) == 2:
        model.centre, model.spread, model.weights = fit_curve(np.array([r["evidence"] for r in measured]), truth)
    return model


def _shuffled(samples: list[bytes]) -> list[bytes]:
    return [samples[i] for i in np.random.default_rng(5).permutation(len(samples))]


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with ``score_col`` added (0 to 1); replaces a column of that name.

    Every whole text is compressed; a null text counts as empty and gets the score of the empty
    text. Rows are scored one by one, so repeated rows get equal scores; an empty table stays empty.
    """
    # Two dictionaries of DICTIONARY_BYTES and a few numbers.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learnt = shared.value
        sizes = Sizes(learnt.good, learnt.bad) if learnt.weights is not None else None
        for texts in batches:
            # Texts leave the Arrow batch one by one, so a batch is held once.
            evidence = sizes.evidence(t.as_py().encode() for t in texts) if sizes else np.zeros((len(texts), 1))
            yield pa.array(learnt.scores(evidence))

    score_udf = F.arrow_udf(score, "double")
    return docs.withColumn(score_col, score_udf(F.coalesce(F.col(text_col), F.lit(""))))


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    scored = score_quality(rows, model)
    return scored.select(id_col, F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
