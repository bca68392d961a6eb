"""Encoders fitted on the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.expressions import lookup_literal
from tablewright.operators.base import FittedOperator, step
from tablewright.operators.clean import MAX_CLASSES, class_list
from tablewright.plans.lookup import WEIGHT, FittedTable, attach

MAX_DUMMIES = 1_000

# Groups of carrier types.
CARRIER_GROUPS = {
    "1A. PRIVATE": "Private Insurance Carrier",
    "2A. SIF": "State Insurance Fund",
    "3A. SELF PUBLIC": "Self-insured Public Entity",
    "4A. SELF PRIVATE": "Self-insured Private Entity",
    "5A. SPECIAL FUND - CONS. COMM. (SECT. 25-A)": "Special Funds",
    "5C. SPECIAL FUND - POI CARRIER WCB MENANDS": "Special Funds",
    "5D. SPECIAL FUND - UNKNOWN": "Special Funds",
    "UNKNOWN": "Unknown",
}

# Groups of injury codes.
CAUSE_GROUPS = {
    "Burn_or_Scald": [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 14, 84],
    "Caught_In": [10, 12, 13, 20],
    "Cut_Puncture_Scrape": [15, 16, 17, 18, 19],
    "Fall_Slip_or_Trip": [25, 26, 27, 28, 29, 30, 31, 32, 33],
    "Motor_Vehicle": [40, 41, 45, 46, 47, 48, 50],
    "Strain_or_Injury": [52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 97],
    "Striking_Against_or_Stepping_On": [65, 66, 67, 68, 69, 70],
    "Struck_or_Injured_By": [74, 75, 76, 77, 78, 79, 80, 81, 85, 86],
    "Miscellaneous_Causes": [82, 83, 87, 88, 89, 90, 91, 93, 94, 95, 96, 98, 99],
    "Unknown": [100],
}
NATURE_GROUPS = {
    "Specific": [1, 2, 3, 4, 7, 10, 13, 16, 19, 22, 25, 28, 30, 31, 32, 34, 36, 37, 38, 40, 41, 42, 43, 46, 47, 49, 52, 53, 54, 55, 58, 59],
    "Occupational": [60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 80, 83],
    "Multiple": [90, 91],
    "Unknown": [100],
}
BODY_GROUPS = {
    "Head_and_Neck": [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26],
    "Upper_Extremities": [30, 31, 32, 33, 34, 35, 36, 37, 38, 39],
    "Trunk": [40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 60, 61, 62, 63],
    "Lower_Extremities": [50, 51, 52, 53, 54, 55, 56, 57, 58],
    "Multiple_Body Parts": [64, 65, 66, 90, 91, 99],
    "Unknown": [100],
}
CODE_GROUPS = {"cause": CAUSE_GROUPS, "nature": NATURE_GROUPS, "body": BODY_GROUPS}


class BinaryEncoder(FittedOperator):
    """Columns with exactly two training values become 0 (smaller) and 1 in ``<c>_binary``."""

    defaults = {"columns": []}

    def learn(self, train, args):
        # Smallest and largest value; any third value is caught by the second count.
        rows = train.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in args["columns"]]).first()
        other = train.agg(
            *[F.count_if(~F.col(c).isin(rows[c]["low"], rows[c]["high"])).alias(c) for c in args["columns"] if rows[c]["low"] is not None]
        ).first()
        for c in args["columns"]:
            if rows[c]["low"] is None or rows[c]["low"] == rows[c]["high"] or other[c]:
                raise ValueError(f"{c} does not have exactly two values")
        return {"values": {c: [rows[c]["low"], rows[c]["high"]] for c in args["columns"]}}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        return df.withColumns(
            {f"{c}_binary": F.when(F.col(c) == low, 0).when(F.col(c) == high, 1) for c, (low, high) in scalars["values"].items()}
        )


def _long_levels(df: DataFrame, columns: list[str], *extra: str) -> DataFrame:
    """(column_name, value) rows of several columns, so one shuffle counts them all."""
    text = df.select(*extra, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(extra), columns, "column_name", "value").filter("value is not null")


def _attach_levels(df: DataFrame, levels: FittedTable, column: str) -> DataFrame:
    """Add the fitted columns of one encoded column; ``levels`` holds those of all columns."""
    keyed = df.withColumn("encoded_text", F.col(column).cast("string"))
    return attach(keyed, levels.of_part(column), {"encoded_text": "value"}).drop("encoded_text")


class TargetEncoder(FittedOperator):
    """Smoothed share of every class within a category, one column per class.

    ``w = 1 / (1 + exp(-(n - k) / f))``; the value is ``w * share + (1 - w) * prior``. A
    category not seen in training, or null, gets the prior. All classes of all columns
    are counted in one aggregation. The new columns are ``<c>_encoded_<class>``, or
    ``<prefix><c>_<i>`` for class i of the sorted classes.
    """

    defaults = {"columns": [], "label": None, "k": 20.0, "f": 10.0, "prefix": None}

    def learn(self, train, args):
        cols, label = args["columns"], args["label"]
        rows = train.filter(F.col(label).isNotNull())
        sizes = rows.groupBy(label).agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()
        if len(sizes) > MAX_CLASSES:
            raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
        total = sum(r["n"] for r in sizes)
        shares = sorted((r[label], r["n"] / total) for r in sizes)
        hits = [F.count_if(F.col("cls") == v).alias(f"hits_{i}") for i, (v, _) in enumerate(shares)]
        named = rows.withColumn("cls", F.col(label))
        counts = _long_levels(named, cols, "cls").groupBy("column_name", "value").agg(F.count("*").alias("n"), *hits)
        weight = 1 / (1 + F.exp(-(F.col("n") - F.lit(args["k"])) / F.lit(args["f"])))
        encoded = counts.select(
            "column_name", "value", F.col("n").alias(WEIGHT), *[(weight * F.col(f"hits_{i}") / F.col("n") + (1 - weight) * F.lit(p)).alias(f"encoded_{i}") for i, (_, p) in enumerate(shares)]
        )
        return {"classes": [v for v, _ in shares], "priors": [p for _, p in shares]}, {"codes": FittedTable.of(encoded, "column_name")}

    @staticmethod
    def apply(df, args, scalars, tables):
        ids = range(len(scalars["classes"]))
        for c in args["columns"]:
            names = [f"{c}_encoded_{v}" if args["prefix"] is None else f"{args['prefix']}{c}_{i}" for i, v in enumerate(scalars["classes"])]
            df = _attach_levels(df, tables["codes"], c)
            df = df.withColumns({n: F.coalesce(F.col(f"encoded_{i}"), F.lit(scalars["priors"][i])) for i, n in zip(ids, names)})
            df = df.drop(*[f"encoded_{i}" for i in ids])
        return df


class FrequencyEncoder(FittedOperator):
    """Training count of the row's value in ``<c>_freq``; 0 for null or unseen.

    All columns are counted in one shuffle.
    """

    defaults = {"columns": []}

    def learn(self, train, args):
        counts = _long_levels(train, args["columns"]).groupBy("column_name", "value").agg(F.count("*").alias("fitted_n"))
        return {}, {"counts": FittedTable.of(counts.withColumn(WEIGHT, F.col("fitted_n")), "column_name")}

    @staticmethod
    def apply(df, args, scalars, tables):
        for c in args["columns"]:
            df = _attach_levels(df, tables["counts"], c).withColumn(f"{c}_freq", F.coalesce("fitted_n", F.lit(0))).drop("fitted_n")
        return df


class DummyEncoder(FittedOperator):
    """0/1 columns ``<c>_<value>`` for the sorted training values, the first left out.

    ``unseen='error'`` makes a row with an unknown value fail the job, ``'zero'``
    gives it zeros; null gives zeros.
    """

    defaults = {"column": None, "drop_first": True, "unseen": "error", "names": None}

    def learn(self, train, args):
        values = class_list(train, args["column"])
        if len(values) > MAX_DUMMIES:
            raise ValueError(f"{args['column']} has {len(values)} values; use a frequency or target encoding")
        return {"values": values}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        c, values = F.col(args["column"]), scalars["values"]
        kept = values[1:] if args["drop_first"] else values
        names = args["names"] or [f"{args['column']}_{v}" for v in kept]
        known = c.isin(*values)
        if args["unseen"] == "error":
            checked = F.when(known, c).when(c.isNull(), c).otherwise(F.raise_error(F.concat(F.lit("unseen value "), c.cast("string"))))
        else:
            checked = c
        return df.withColumns({n: F.coalesce((checked == F.lit(v)).cast("double"), F.lit(0.0)) for n, v in zip(names, kept)})


@step
def map_values(df: DataFrame, column: str, mapping: dict, replace: bool = True, default=None) -> DataFrame:
    """Dictionary map; without an entry the result is the default (null)."""
    mapped = lookup_literal(F.col(column), mapping)
    if default is not None:
        mapped = F.coalesce(mapped, F.lit(default))
    return df.withColumn(column if replace else f"{column}_mapped", mapped)


@step
def group_codes(df: DataFrame, column: str, kind: str, into: str) -> DataFrame:
    """Broad category of an injury code (``cause``, ``nature`` or ``body``)."""
    out = F.lit(None).cast("string")
    for name, codes in CODE_GROUPS[kind].items():
        out = F.when(F.col(column).isin(*codes), F.lit(name)).otherwise(out)
    return df.withColumn(into, out)


@step
def null_flags(df: DataFrame, columns: list[str], include_zero: list[str] | None = None, present: bool = False) -> DataFrame:
    """``<c>_nabinary``: 1 where null (or zero, for the listed columns); ``present`` turns it round."""
    out = {}
    for c in columns:
        absent = F.col(c).isNull()
        if c in (include_zero or []):
            absent = absent | F.coalesce(F.col(c) == 0, F.lit(False))
        out[f"{c}_nabinary"] = (~absent if present else absent).cast("int")
    return df.withColumns(out)


def one_hot_label(label: str, names: list[str] | None = None) -> DummyEncoder:
    """All levels of the label as 0/1 columns."""
    return DummyEncoder(column=label, drop_first=False, names=names)
