"""Removing passages that repeat across documents, with DataFrame functions only.

Every three consecutive lines (blank lines aside) form a window; windows overlap. A window that
occurs more than once anywhere keeps its first occurrence; every later one covers its three
lines, the covered positions of a document are merged, and those lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(id, h, key1, key2, at): each window's 128-bit key and the positions of its lines."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line")))
    kept = docs.select("id", "h", F.filter(lines, lambda x: x["line"] != "").alias("kept")).where(F.size("kept") >= size)
    hashed = kept.select(
        "id", "h", F.transform("kept", lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b"))).alias("kept")
    )
    count = F.size("kept") - (size - 1)
    shifted = F.arrays_zip(*[F.slice("kept", F.lit(k + 1), count).alias(f"l{k}") for k in range(size)])

    def window(w: Column) -> Column:
        parts = [w[f"l{k}"] for k in range(size)]
        return F.struct(
            F.xxhash64(*[p["a"] for p in parts]).alias("key1"), F.xxhash64(*[p["b"] for p in parts]).alias("key2"), F.array(*[p["at"] for p in parts]).alias("at")
        )

    return hashed.select("id", "h", F.inline(F.transform(shifted, window)))


def repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, h, gone): the positions of the lines that later occurrences cover, merged per document."""
    windows = _windows(docs, size)
    place = F.struct("id", "h", "at")
    repeated = windows.groupBy("key1", "key2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["key1", "key2"]).where(~place.eqNullSafe(F.col("first")))
    # Where a passage overlaps its own first occurrence, the lines of that occurrence stay.
    same_doc = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    covered = F.when(same_doc, F.array_except("at", "first.at")).otherwise(F.col("at"))
    return later.select("id", "h", F.explode(covered).alias("at")).groupBy("id", "h").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, report: bool = False) -> DataFrame:
    """The documents with repeated passages taken out of their texts; with ``report`` also n_lines and n_removed.

    Lines are compared without spaces around them; blank lines belong to no window and stay. The first
    occurrence is the one with the smallest id, then text hash, then position; null ids come first.
    Rows equal in id and text are one document: they stay, with the same result. Null texts stay null;
    texts of fewer than three lines that are not blank stay as they are; a text can become empty. All
    other columns are kept as they are. An empty table stays empty.
    """
    taken = set(docs.columns)
    key, hashed, gone, lines = (_free(name, taken) for name in ("line_key", "line_hash", "lines_gone", "lines"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text")).select("id", "h", "text")
    # Rows equal in id and text are one occurrence: they have equal places, and the smallest place stays.
    cover = repeated_lines(rows, size).withColumnsRenamed({"id": key, "h": hashed, "gone": gone})
    joined = docs.join(cover, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(hashed)), "left")
    # A column of its own, used several times below, so the text is split once per row.
    joined = joined.withColumn(lines, F.split(F.col(text_col), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda at: F.get(F.col(lines), at)), "\n")
    out = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)}
    if report:
        out |= {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.withColumns(out).drop(key, hashed, gone, lines)


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name
