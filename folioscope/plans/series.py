"""Series of one test: values by material and unit, on common scales, in order of date.

Input rows: observation_id, document_id, indicator_id, material, name, value, value_numeric, unit, reference,
date (nulls allowed), snippet.  All steps but the greedy joining of unit spellings are DataFrame
expressions; that step sees one row for each (test, material, unit), never the values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import quoted_dates
from ..functions.parsing import MOLAR_MASS, on_distinct, power_of, read_range, to_mmol, unit_key, unit_of_range
from ..functions.units import ends_agree, fits_range, onto_one_scale, same_size, with_groups
from ..operators.suspects import medians
from ..session import staged

KEYS = ["indicator_id", "material"]
RETELLING_DAYS = 45


def with_quoted_dates(rows: DataFrame) -> DataFrame:
    """Values whose own line names another day, a month or more away, move to that day; `quoted`."""
    read = rows.withColumn("_quoted", quoted_dates(F.col("snippet"), F.col("date")))
    out = read.withColumn("quoted", F.col("_quoted").isNotNull()).withColumn("date", F.coalesce("_quoted", "date"))
    return out.drop("_quoted")


def without_retellings(rows: DataFrame) -> DataFrame:
    """A quoted value that equals a measured one of its test, 45 days or less away, is a retelling and
    goes; `retold` counts them at the measured value nearest in time.

    Quoted values are few beside measured ones, so they are staged, and they go to three buckets."""
    from ..operators.joins import within_days

    told = staged(rows.where("quoted and value_numeric is not null").select(
        "indicator_id", "value_numeric", F.col("observation_id").alias("told_id"), F.col("date").alias("told_day"), F.col("material").alias("told_material")
    ))
    seen = rows.where("not quoted and value_numeric is not null and date is not null").select("indicator_id", "value_numeric", "observation_id", "date", "material")
    met = within_days(seen, told, ["indicator_id", "value_numeric"], "date", "told_day", RETELLING_DAYS)
    met = met.where("told_material is null or material is null or told_material = material")
    near = staged(met.groupBy("told_id").agg(F.min_by("observation_id", F.struct(F.abs(F.datediff("date", "told_day")), "observation_id")).alias("observation_id")))
    counts = near.groupBy("observation_id").agg(F.count(F.lit(1)).alias("retold"))
    kept = rows.join(near.select(F.col("told_id").alias("observation_id")), "observation_id", "left_anti")
    return kept.join(counts, "observation_id", "left").withColumn("retold", F.coalesce("retold", F.lit(0)))


def _scale(name: str | None, unit: str | None, reference: str | None) -> dict:
    """Everything that the printed name, unit and range say of a value's scale."""
    key = unit_key(unit)
    if key is None:
        key = unit_of_range(reference)
    analyte = next((a for a in MOLAR_MASS if a in (name or "").lower()), None)
    molar, power = to_mmol(analyte, key) if analyte else None, power_of(key)
    if molar:
        factor, scale = molar["factor"], "mmol/l"
    elif power is not None:  # counts are brought to 10^9 per litre
        factor, scale = 10.0 ** (power - 9), "10^9/l"
    else:
        factor, scale = 1.0, key or ""
    return {"key": key, "factor": factor, "scale": scale} | (read_range(reference) or {})


def with_scales(rows: DataFrame) -> DataFrame:
    """unit_key, scale, and number and range on that scale: molar units where the printed name says
    the analyte, and powers of ten per volume."""
    out = on_distinct(rows, ["name", "unit", "reference"], _scale, "key string, factor double, scale string, low double, high double", "unit_")
    for new, old in (("number", "value_numeric"), ("low", "unit_low"), ("high", "unit_high")):
        out = out.withColumn(new, F.col(old) * F.col("unit_factor"))
    return out.withColumnRenamed("unit_scale", "scale").drop("unit_factor", "unit_low", "unit_high")


def placed_by_numbers(rows: DataFrame, agreement: float = 2.0, least: int = 2) -> DataFrame:
    """Values without a unit join the only scale of their test and material that the evidence leaves;
    `by_numbers` marks them.  All numbers of a test are placed together, or none.

    The evidence comes in stages, each asked only where the one before says nothing.  A range printed
    beside them, at its widest, must fit the scale's numbers.  Without one, their spread must agree
    with the scale's at both ends (a single number must fit into it), or else each of them must be
    the size of the value nearest in time on that scale, before or after it.  Scales of fewer than
    `least` values are not joined, and where two are left nothing is.
    """
    numbers = rows.where("number is not null").withColumn("_bare", F.col("scale") == "")
    scales = numbers.where("not _bare").groupBy(*KEYS, F.col("scale").alias("to_scale")).agg(
        F.min("number").alias("least"), F.max("number").alias("most"), F.count(F.lit(1)).alias("n")
    )
    bare = rows.where("scale = ''").groupBy(*KEYS).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("number").alias("own_least"), F.max("number").alias("own_most")
    )
    met = _meeting(bare, scales.where(F.col("n") >= least))
    ranged = F.col("low").isNotNull() | F.col("high").isNotNull()
    by_range = fits_range(F.col("low"), F.col("high"), F.col("least"), F.col("most"), agreement)
    several = F.col("own_least") != F.col("own_most")
    by_ends = F.when(several, ends_agree(F.col("own_least"), F.col("own_most"), F.col("least"), F.col("most"), agreement)).otherwise(
        fits_range(F.col("least"), F.col("most"), F.col("own_least"), F.col("own_most"), agreement)
    )
    told = F.when(ranged, by_range).otherwise(F.coalesce(by_ends, F.lit(False)))
    met = staged(met.select(*KEYS, "to_scale", told.alias("fits"), (~ranged & ~told & F.col("own_least").isNotNull()).alias("open")))
    pairs = pairs_in_time_agree(numbers, met.where("open").select(*KEYS, "to_scale"), agreement)
    near = met.where("fits").select(*KEYS, "to_scale").unionByName(pairs)
    one = near.groupBy(*KEYS).agg(F.min("to_scale").alias("to_scale"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")
    one = staged(one.withColumnsRenamed({"indicator_id": "_i", "material": "_m"}))
    same = F.col("indicator_id").eqNullSafe(F.col("_i")) & F.col("material").eqNullSafe(F.col("_m")) & (F.col("scale") == "") & F.col("number").isNotNull()
    out = rows.join(one, same, "left").drop("_i", "_m")
    placed = F.col("to_scale").isNotNull()
    return out.withColumn("by_numbers", placed).withColumn("scale", F.coalesce("to_scale", "scale")).drop("to_scale")


def _meeting(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one test and material, null meeting null."""
    other = other.withColumnsRenamed({"indicator_id": "_i", "material": "_m"})
    return one.join(other, F.col("indicator_id").eqNullSafe(F.col("_i")) & F.col("material").eqNullSafe(F.col("_m"))).drop("_i", "_m")


def pairs_in_time_agree(numbers: DataFrame, asked: DataFrame, agreement: float) -> DataFrame:
    """Of asked(test, material, to_scale) those on which every dated value without a unit is the size of the
    nearest dated one, in either direction; at equal distance the smaller one is the nearest.

    numbers are rows with `_bare`.  A day is one row before anything is ordered: its least value on a
    scale, its least and greatest without a unit.  So no test has more rows in a window than the
    calendar has days, however often it was measured.
    """
    dated = numbers.where("date is not null")
    theirs = dated.where("not _bare").groupBy(*KEYS, F.col("scale").alias("to_scale"), "date").agg(F.min("number").alias("x"))
    ours = dated.where("_bare").groupBy(*KEYS, "date").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    none = F.lit(None).cast("double")
    ours = _meeting(ours, asked).select(*KEYS, "to_scale", "date", none.alias("x"), "lo", "hi")
    theirs = theirs.select(*KEYS, "to_scale", "date", "x", none.alias("lo"), none.alias("hi"))
    by = Window.partitionBy(*KEYS, "to_scale").orderBy("date", F.col("x").isNull())
    point = F.when(F.col("x").isNotNull(), F.struct("date", "x"))
    before = F.last(point, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    met = ours.unionByName(theirs).withColumns({"_before": before, "_after": after}).where("lo is not null")
    near = F.array_min(F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.abs(F.datediff(p["date"], "date")).alias("days"), p["x"].alias("x"))) for p in (F.col("_before"), F.col("_after"))])))["x"]
    agrees = F.coalesce(same_size(F.col("lo"), F.col("_near"), agreement) & same_size(F.col("hi"), F.col("_near"), agreement), F.lit(False))
    every = met.withColumn("_near", near).groupBy(*KEYS, "to_scale").agg(F.bool_and(agrees).alias("agree"))
    return every.where("agree").select(*KEYS, "to_scale")


def joined_spellings(rows: DataFrame, agreement: float = 2.0, least: int = 2) -> DataFrame:
    """Scales of one test whose medians agree are one series, named by the scale seen first.

    Greedy, in order of first date and name, over one row a scale.
    """
    since = rows.groupBy(*KEYS, "scale").agg(F.min("date").alias("since"))
    by = [*KEYS, "scale"]
    stat = with_groups(since, medians(rows, by, "number"), {k: f"_key_{k}" for k in by}).withColumn("n", F.coalesce("n", F.lit(0)))

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["since", "scale"], na_position="last")
        heads: list[tuple[str, float, int]] = []
        series = []
        for scale, median, n in zip(part["scale"], part["median"], part["n"]):
            to = scale
            for head, middle, many in heads:
                both = min(n, many) >= least and min(median, middle) > 0 and max(median, middle) <= agreement * min(median, middle)
                if both and head and scale:
                    to = head
                    break
            if to == scale:
                heads.append((scale, median, n))
            series.append(to)
        return part.assign(series=series)[[*KEYS, "scale", "series"]]

    names = stat.groupBy(*KEYS).applyInPandas(greedy, "indicator_id string, material string, scale string, series string")
    names = staged(names.withColumnsRenamed({"indicator_id": "_i", "material": "_m", "scale": "_s"}))
    same = F.col("indicator_id").eqNullSafe(F.col("_i")) & F.col("material").eqNullSafe(F.col("_m")) & (F.col("scale") == F.col("_s"))
    return rows.join(names, same).drop("_i", "_m", "_s")


def one_power(rows: DataFrame, least: int = 2) -> DataFrame:
    """Values and ranges of a series printed at several powers of ten, told by their ranges, move to the
    power that most are printed at; `moved` and `band_moved` say how many above it they were."""
    met = onto_one_scale(rows, [*KEYS, "series"], least=least)
    shift = {"number": "moved", "low": "band_moved", "high": "band_moved"}
    met = met.withColumns({c: F.col(c) * F.pow(F.lit(10.0), by) for c, by in shift.items()})
    return met.withColumns({by: -F.col(by) for by in ("moved", "band_moved")})


def charts(rows: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """All steps.  Adds series, number, low, high, quoted, retold, moved, why (null for drawn values)
    and place: 1, 2 ... in the series in order of date; undated values last.

    `without` names columns that the result need not have, such as printed text; they are left behind
    once they are parsed.
    """
    # Each step below reads its input several times, so the parsed and the placed rows are staged.
    read = staged(with_scales(with_quoted_dates(rows)).drop(*without))
    placed = staged(placed_by_numbers(without_retellings(read)))
    out = one_power(joined_spellings(placed))
    why = F.when(F.col("number").isNull(), "not_a_number").when(F.col("date").isNull(), "undated")
    return numbered(out.withColumn("why", why))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `place`: 1, 2 ... in the series in order of date, undated ones last; ties by document,
    observation and number.

    Days are counted first, and each goes on from those before it; rows are ordered within their day
    alone.  So a window has a day's rows, or one row a day, however long a series is.
    """
    keys = [*KEYS, "series", "date"]
    days = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*KEYS, "series").orderBy(F.col("date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    days = staged(days.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    within = Window.partitionBy(*keys).orderBy("document_id", "observation_id", "number", "low", "high")
    met = with_groups(rows.withColumn("_place", F.row_number().over(within)), days, {k: f"_key_{k}" for k in keys})
    return met.withColumn("place", F.col("_before") + F.col("_place")).drop("_before", "_place")


def bands(rows: DataFrame) -> DataFrame:
    """For each drawn point the stretch its range covers: half way to its neighbours in time."""
    drawn = rows.where("why is null").withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double"))
    w = Window.partitionBy(*KEYS, "series").orderBy("date", "document_id", "observation_id")
    before, after = F.lag("_day").over(w), F.lead("_day").over(w)
    left = (F.col("_day") - F.coalesce(before, F.col("_day") - (after - F.col("_day")), F.col("_day"))) / 2
    right = (F.coalesce(after, F.col("_day") + (F.col("_day") - before), F.col("_day")) - F.col("_day")) / 2
    return drawn.withColumn("from_day", F.col("_day") - left).withColumn("to_day", F.col("_day") + right).drop("_day")


def why_no_line(rows: DataFrame) -> DataFrame:
    """(indicator, material, series, why, values): what a series without enough points holds instead."""
    drawn = rows.groupBy(*KEYS, "series").agg(F.count_if(F.col("why").isNull()).alias("drawn")).where("drawn < 2")
    drawn = drawn.withColumnsRenamed({"indicator_id": "_i", "material": "_m", "series": "_s"})
    same = F.col("indicator_id").eqNullSafe(F.col("_i")) & F.col("material").eqNullSafe(F.col("_m")) & (F.col("series") == F.col("_s"))
    return rows.join(drawn, same).groupBy(*KEYS, "series", F.coalesce("why", F.lit("single")).alias("why")).agg(F.count(F.lit(1)).alias("values"))
