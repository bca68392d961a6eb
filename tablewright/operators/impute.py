"""Missing values. Fitted on the training rows, applied to all rows in pipeline order.

Statistics per group are aggregated (never windowed over the group) and joined back
with ``attach``, in one join whatever the size of the fitted table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.expressions import all_of, holds, micros
from tablewright.functions.hashing import hash_uniform_pair
from tablewright.operators.base import FittedOperator, step
from tablewright.plans.lookup import WEIGHT, FittedTable, attach
from tablewright.plans.prefix import running_sums
from tablewright.plans.quantiles import exact_quantiles
from tablewright.session import cut_lineage

# Fixed values.
UNKNOWN_CODE = 100
UNKNOWN_TEXT = "Unknown"

#: Distributions of up to so many values are laid out on the driver; the cells are the same either way.
SHORT_LIST = 10_000


@step
def fill_constant(df: DataFrame, column: str, value, into: str | None = None) -> DataFrame:
    """Fill nulls in place, or write the filled values into a new column."""
    return df.withColumn(into or column, F.coalesce(F.col(column), F.lit(value).cast(df.schema[column].dataType)))


@step
def derive_birth_year(df: DataFrame, birth_year: str, date: str, age: str) -> DataFrame:
    return df.withColumn(birth_year, F.coalesce(F.col(birth_year), F.year(date) - F.col(age)))


class BirthYearByMedians(FittedOperator):
    """Null birth year: year of the date less the median age, else the median birth year."""

    defaults = {"birth_year": "birth_year", "age": "age", "date": "accident_date"}

    def learn(self, train, args):
        q = exact_quantiles(train, {"age": (F.col(args["age"]), [0.5]), "birth": (F.col(args["birth_year"]), [0.5])})
        return {"age": q["age"][0], "birth_year": q["birth"][0]}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        b = args["birth_year"]
        derived = F.year(args["date"]) - F.lit(scalars["age"])
        return df.withColumn(b, F.coalesce(F.col(b).cast("double"), derived, F.lit(scalars["birth_year"])))


def _cells_on_driver(counts: list[tuple]) -> list[tuple]:
    """``alias_cells`` of a short list, in one sweep over light and heavy values side by side."""
    k, total = len(counts), sum(n for _, n in counts)
    light = [(v, n * k) for v, n in counts if n * k < total]
    heavy = [(v, n * k - total) for v, n in counts if n * k >= total]
    out, j, spare = [], 0, heavy[0][1] if heavy else 0
    for value, weight in light:
        # The heavy values that gave more than they had over are filled up by the next one.
        while spare < 0:
            out.append((len(light) + j, heavy[j][0], heavy[j + 1][0], (total + spare) / total))
            j, spare = j + 1, spare + heavy[j + 1][1]
        out.append((len(out) - j, value, heavy[j][0], weight / total))
        spare -= total - weight
    while j < len(heavy):
        over = min(spare, 0)
        out.append((len(light) + j, heavy[j][0], heavy[min(j + 1, len(heavy) - 1)][0], (total + over) / total))
        j += 1
        spare = over + heavy[j][1] if j < len(heavy) else 0
    return out


def _cells_by_ranges(counts: DataFrame, k: int, total: int) -> DataFrame:
    """``alias_cells`` of any number of values, from running sums.

    Let D be the running sum of what light values lack of a cell and S that of what heavy ones have over. A light
    value is filled up by the first heavy one whose S reaches the D before it; a heavy value lacks
    what the first D beyond its S is more than that S.
    """
    wide = "decimal(38,0)"
    weight = F.col("n").cast(wide) * F.lit(k).cast("decimal(18,0)")
    one = F.lit(total).cast(wide)
    sized = counts.withColumn("weight", weight.cast(wide)).withColumn("light", (F.col("weight") < one).cast("long"))
    lacks = F.when(F.col("light") == 1, one - F.col("weight")).otherwise(F.lit(0)).cast(wide)
    spare = F.when(F.col("light") == 0, F.col("weight") - one).otherwise(F.lit(0)).cast(wide)
    summed = running_sums(sized.withColumns({"lacks": lacks, "spare": spare, "heavy": 1 - F.col("light")}), [F.asc("value")], ["lacks", "spare", "light", "heavy"])
    is_light = F.col("light") == 1
    # Both running sums in one order; equal sums of light values first.
    placed = summed.select(
        "value", "weight", "light", F.when(is_light, F.col("light_upto")).otherwise(F.col("heavy_upto")).alias("no"), F.when(is_light, F.col("lacks_upto")).otherwise(F.col("spare_upto")).alias("sum"), (1 - F.col("light")).alias("heavy"),
    )
    met = cut_lineage(running_sums(placed, [F.asc("sum"), F.desc("light"), F.asc("no")], ["light", "heavy"]))
    lights, heavies = met.where("light = 1"), met.where("light = 0")
    n_light = lights.count()
    # The heavy values before the end of a light one tell which of them fills up the next light one.
    giver = lights.select((F.col("no") + 1).alias("no"), (F.col("heavy_upto") + 1).alias("giver"))
    named = heavies.select(F.col("no").alias("giver"), F.col("value").alias("other"))
    light_cells = lights.join(giver, "no", "left").withColumn("giver", F.coalesce("giver", F.lit(1))).join(named, "giver", "left")
    light_cells = light_cells.select((F.col("no") - 1).alias("cell"), "value", "other", (F.col("weight").cast("double") / total).alias("share"))
    beyond = lights.select((F.col("no") - 1).alias("light_upto"), F.col("sum").alias("beyond"))
    after = heavies.select((F.col("no") - 1).alias("no"), F.col("value").alias("after"))
    heavy_cells = heavies.join(beyond, "light_upto", "left").join(after, "no", "left")
    own = F.coalesce(one - (F.col("beyond") - F.col("sum")), one).cast("double") / total
    heavy_cells = heavy_cells.select((F.col("no") - 1 + n_light).alias("cell"), "value", F.coalesce("after", "value").alias("other"), own.alias("share"))
    return light_cells.unionByName(heavy_cells)


def alias_cells(counts: DataFrame) -> tuple[int, FittedTable]:
    """The distribution of ``value`` with counts ``n`` as equal cells, one per value: (number of cells, table).

    A cell has a value, another one, and the share of the cell that is the first one's. To draw, a cell is
    taken evenly and then one of its two values. Cells of light values come first; within the light and the heavy
    ones, values ascend. Up to ``SHORT_LIST`` values the cells are made on the driver; they are the same either way.
    """
    head = cut_lineage(counts)
    k, total = head.agg(F.count("*"), F.sum("n")).first()
    if not k:
        cells = head.select(F.lit(0).cast("long").alias("cell"), "value", F.col("value").alias("other"), F.lit(0.0).alias("share"))
    elif k <= SHORT_LIST:
        listed = _cells_on_driver([(r["value"], r["n"]) for r in head.orderBy("value").collect()])
        kind = head.schema["value"].dataType
        schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("value", kind), T.StructField("other", kind), T.StructField("share", T.DoubleType())])
        cells = head.sparkSession.createDataFrame(listed, schema).coalesce(1)
    else:
        cells = _cells_by_ranges(head, k, int(total))
    return k, FittedTable.of(cells.toDF("cell", "fitted_value", "fitted_other", "fitted_share"))


class ProportionalFill(FittedOperator):
    """Nulls are drawn from the distribution of the training values.

    The draw depends on the row key and a seed, so it can be repeated. It is an equality join to
    a table of equal cells and a comparison, whatever the number of values. ``top`` limits
    the distribution to the commonest values and rescales their shares; ``into``
    writes to a new column. Without a known training value nulls stay.
    """

    defaults = {"column": None, "key": "claim_id", "seed": 0, "top": None, "into": None}

    def learn(self, train, args):
        c = F.col(args["column"])
        counts = train.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
        if args["top"] is not None:
            counts = counts.orderBy(F.desc("n"), F.asc("value")).limit(args["top"])
        cells, table = alias_cells(counts)
        return {"cells": cells}, {"cells": table}

    @staticmethod
    def apply(df, args, scalars, tables):
        c = args["column"]
        place, part = hash_uniform_pair(F.col(args["key"]), f"{c}:{args['seed']}")
        # Known rows have no cell and meet nothing. Cells are drawn evenly, so none is hot.
        missing = F.col(c).isNull()
        drawn = df.withColumns({"drawn_cell": F.when(missing, F.floor(place * scalars["cells"])), "drawn_part": F.when(missing, part)})
        joined = attach(drawn, tables["cells"], {"drawn_cell": "cell"})
        value = F.when(F.col("drawn_part") < F.col("fitted_share"), F.col("fitted_value")).otherwise(F.col("fitted_other")).cast(df.schema[c].dataType)
        return joined.withColumn(args["into"] or c, F.coalesce(F.col(c), value)).drop("drawn_cell", "drawn_part", "fitted_value", "fitted_other", "fitted_share")


@step
def fill_block(df: DataFrame, codes: list[str], descriptions: list[str], code=UNKNOWN_CODE, text: str = UNKNOWN_TEXT) -> DataFrame:
    """Where every column of the set is null, set the codes and the descriptions."""
    empty = all_of([F.col(c).isNull() for c in codes + descriptions])
    fills = {c: F.when(empty, F.lit(code)).otherwise(F.col(c)) for c in codes}
    fills |= {c: F.when(empty, F.lit(text)).otherwise(F.col(c)) for c in descriptions}
    return df.withColumns(fills)


def group_modes(df: DataFrame, group: str, column: str) -> DataFrame:
    """Commonest value per group, the smallest on a tie; groups and values may not be null."""
    pairs = df.filter(F.col(group).isNotNull() & F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    return pairs.groupBy(group).agg(F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column))).alias("fitted_value"), F.sum("n").alias(WEIGHT))


def group_medians(df: DataFrame, group: str, column: str) -> DataFrame:
    """Exact median per group from value counts, without gathering a group in one task."""
    values = df.filter(F.col(group).isNotNull() & F.col(column).isNotNull())
    counts = values.groupBy(group, F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    summed = running_sums(counts, [F.asc(group), F.asc("value")], ["n"])
    sizes = FittedTable.of(
        summed.groupBy(group).agg(F.max("n_upto").alias("group_upto"), F.sum("n").alias("group_n"))
    )
    placed = attach(summed, sizes, {group: group}).withColumn("last", F.col("n_upto") - F.col("group_upto") + F.col("group_n"))
    lower, upper = F.floor((F.col("group_n") + 1) / 2), F.floor((F.col("group_n") + 2) / 2)
    first = F.col("last") - F.col("n")
    hit_lower, hit_upper = (first < lower) & (lower <= F.col("last")), (first < upper) & (upper <= F.col("last"))
    return placed.groupBy(group).agg(
        ((F.max(F.when(hit_lower, F.col("value"))) + F.max(F.when(hit_upper, F.col("value")))) / 2).alias("fitted_value"),
        F.sum("n").alias(WEIGHT),
    )


class GroupModeFill(FittedOperator):
    """Nulls take the commonest training value of the row's group; no group, no value."""

    defaults = {"group": None, "column": None, "into": None}

    def learn(self, train, args):
        return {}, {"modes": FittedTable.of(group_modes(train, args["group"], args["column"]))}

    @staticmethod
    def apply(df, args, scalars, tables):
        joined = attach(df, tables["modes"], {args["group"]: args["group"]})
        return joined.withColumn(args["into"] or args["column"], F.coalesce(F.col(args["column"]), "fitted_value")).drop("fitted_value")


class GroupStatisticFill(FittedOperator):
    """Mode, mean or median of the group, else of the whole column.

    Sentinels count as missing. Without ``group`` the overall statistic is used alone;
    with ``fallback=False`` rows of an unknown group stay null.
    """

    defaults = {"column": None, "group": None, "metric": "mode", "sentinels": [UNKNOWN_TEXT], "fallback": True}

    @staticmethod
    def _known(df, args) -> Column:
        c = F.col(args["column"])
        if isinstance(df.schema[args["column"]].dataType, T.StringType) and args["sentinels"]:
            return F.when(c.isin(*args["sentinels"]), F.lit(None)).otherwise(c)
        return c

    def learn(self, train, args):
        c, g, metric = args["column"], args["group"], args["metric"]
        known = train.withColumn(c, self._known(train, args))
        overall = None
        if args["fallback"] or g is None:
            if metric == "mode":
                counts = known.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
                top = counts.orderBy(F.desc("n"), F.asc(c)).first()
                overall = top and top[c]
            elif metric == "mean":
                overall = known.agg(F.avg(c)).first()[0]
            else:
                overall = exact_quantiles(known, {"x": (F.col(c), [0.5])})["x"][0]
        if g is None:
            return {"overall": overall}, {}
        if metric == "mode":
            stats = group_modes(known, g, c)
        elif metric == "mean":
            pairs = known.filter(F.col(g).isNotNull() & F.col(c).isNotNull())
            stats = pairs.groupBy(g).agg(F.avg(c).alias("fitted_value"), F.count("*").alias(WEIGHT))
        elif metric == "median":
            stats = group_medians(known, g, c)
        else:
            raise ValueError(f"metric {metric!r} is not mode, mean or median")
        return {"overall": overall}, {"stats": FittedTable.of(stats)}

    @staticmethod
    def apply(df, args, scalars, tables):
        c, g = args["column"], args["group"]
        kind = df.schema[c].dataType if args["metric"] == "mode" else T.DoubleType()
        choices = [GroupStatisticFill._known(df, args).cast(kind)]
        if g is not None:
            df = attach(df, tables["stats"], {g: g})
            choices.append(F.col("fitted_value").cast(kind))
        choices.append(F.lit(scalars["overall"]).cast(kind))
        return df.withColumn(c, F.coalesce(*choices)).drop("fitted_value")


class DescriptionFromCode(FittedOperator):
    """Null descriptions take the training description of the code.

    A code with several descriptions gives the one of the row with the largest key.
    """

    defaults = {"code": None, "description": None, "key": "claim_id"}

    def learn(self, train, args):
        code, text = args["code"], args["description"]
        pairs = train.filter(F.col(code).isNotNull() & F.col(text).isNotNull())
        return {}, {"texts": FittedTable.of(pairs.groupBy(code).agg(F.max_by(text, args["key"]).alias("fitted_value"), F.count("*").alias(WEIGHT)))}

    @staticmethod
    def apply(df, args, scalars, tables):
        joined = attach(df, tables["texts"], {args["code"]: args["code"]})
        return joined.withColumn(args["description"], F.coalesce(args["description"], "fitted_value")).drop("fitted_value")


class DateByMeanGap(FittedOperator):
    """Null target: the reference date plus the mean training gap, which may end inside a day."""

    defaults = {"target": "c2_date", "reference": "accident_date", "into": None}

    def learn(self, train, args):
        gap = micros(F.col(args["target"])) - micros(F.col(args["reference"]))
        # Decimal: the sum over all rows would overflow a long.
        total, n = train.agg(F.sum(gap.cast("decimal(20,0)")), F.count(gap)).first()
        return {"gap_micros": int(total) // n if n else None}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        shifted = F.timestamp_micros(micros(F.col(args["reference"])) + F.lit(scalars["gap_micros"])).cast("timestamp_ntz")
        filled = F.coalesce(F.col(args["target"]).cast("timestamp_ntz"), shifted)
        return df.withColumn(args["into"] or f"{args['target']}_imputed", filled)


class DateByMedianGap(FittedOperator):
    """Null target: the later date less the median training gap in whole days.

    Only rows with the later date strictly after the target enter the median.
    """

    defaults = {"target": "accident_date", "later": "assembly_date"}

    def learn(self, train, args):
        gap = F.floor((micros(F.col(args["later"])) - micros(F.col(args["target"]))) / F.lit(86_400_000_000))
        after = holds(F.col(args["later"]) > F.col(args["target"]))
        median = exact_quantiles(train, {"gap": (F.when(after, gap), [0.5])})["gap"][0]
        return {"gap_micros": None if median is None else int(median * 86_400_000_000)}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        shifted = F.timestamp_micros(micros(F.col(args["later"])) - F.lit(scalars["gap_micros"])).cast("timestamp_ntz")
        return df.withColumn(args["target"], F.coalesce(F.col(args["target"]).cast("timestamp_ntz"), shifted))


class RepairDateOrder(FittedOperator):
    """Where the condition date is after the target, the target becomes the reference
    date plus the median of the positive training differences, in whole days. Without a
    reference date, or a positive difference in training, the target stays as it is."""

    defaults = {"target": None, "reference": None, "condition": None}

    def learn(self, train, args):
        gap = F.datediff(args["target"], args["reference"])
        median = exact_quantiles(train, {"gap": (F.when(gap > 0, gap), [0.5])})["gap"][0]
        return {"days": None if median is None else int(median)}, {}

    @staticmethod
    def apply(df, args, scalars, tables):
        wrong = holds(F.col(args["condition"]) > F.col(args["target"]))
        if scalars["days"] is None:
            return df
        moved = F.date_add(args["reference"], F.lit(scalars["days"]))
        return df.withColumn(args["target"], F.when(wrong, F.coalesce(moved, F.col(args["target"]))).otherwise(F.col(args["target"])))


@step
def derive_age(df: DataFrame, age: str, birth_year: str, date: str, fallback_date: str | None = None) -> DataFrame:
    """Null age: year of the date less the birth year, else with the year of the fallback date."""
    choices = [F.col(age), F.year(date) - F.col(birth_year)]
    if fallback_date:
        choices.append(F.year(fallback_date) - F.col(birth_year))
    return df.withColumn(age, F.coalesce(*choices))


@step
def vector_to_columns(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Spread a vector or array over named columns."""
    from pyspark.ml.functions import vector_to_array

    values = F.col(vector) if isinstance(df.schema[vector].dataType, T.ArrayType) else vector_to_array(vector)
    return df.withColumns({n: values[i] for i, n in enumerate(names)}).drop(vector)


