"""Budgets: what of a ranked list fits.  Lists are a query's few best candidates, folded inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import new_dir

FULL_FILES, SIGNATURE_FILES, MAP_FILES = 12, 30, 40
FULL_SHARE, FULL_RATIO, FULL_LEAST, CONFIDENT, TEST_SHARE = 0.70, 0.35, 0.35, 0.50, 0.34


def first_fit(candidates: DataFrame, group: str, order: list[Column], key: str, cost: str, budget: int, most: int = FULL_FILES) -> DataFrame:
    """(group, ord, key, cost) of what greedy first fit takes, in the ascending ``order``: what does not fit is passed over.

    Each step takes each group's first candidate behind the last one taken whose cost the rest of the budget allows.  So a group's
    list is never gathered in one row, however long it is; candidates are written once and read ``most`` times.
    """
    spark = candidates.sparkSession
    rows = candidates.select(F.col(group).alias("g"), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("o"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c"))
    path = new_dir(spark, "candidates")
    rows.filter(F.col("c") <= budget).write.parquet(path)
    rows = spark.read.parquet(path)
    taken = None
    for step in range(1, most + 1):
        left = rows
        if taken is not None:
            state = taken.groupBy("g").agg(F.max("o").alias("last"), F.sum("c").alias("used"), F.count("*").alias("n"))
            left = rows.join(state, "g").filter((F.col("n") == step - 1) & (F.col("o") > F.col("last")) & (F.col("used") + F.col("c") <= budget))
        best = left.groupBy("g").agg(F.min(F.struct("o", "k", "c")).alias("x")).select("g", F.lit(step).cast("long").alias("ord"), "x.*")
        every = best if taken is None else taken.unionByName(best)
        # a few rows for each group; cut here, as each step reads the one before twice
        path = new_dir(spark, "taken")
        every.write.parquet(path)
        taken, before = spark.read.parquet(path), taken
        if before is not None and taken.filter(F.col("ord") == step).isEmpty():
            break
    return taken.select(F.col("g").alias(group), "ord", F.col("k").alias(key), F.col("c").alias(cost))


def take_while(candidates: DataFrame, group: str, order: list[Column], cost: str, budget: int, most: int = MAP_FILES) -> DataFrame:
    """candidates up to the first that does not fit, ``most`` at most, with their running sum ``used``."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = candidates.withColumn("ord", F.row_number().over(w).cast("long")).filter(F.col("ord") <= most)
    return rows.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).filter(F.col("used") <= budget)


def test_capped(candidates: DataFrame, group: str, order: list[Column], is_test: str, most: int = SIGNATURE_FILES, share: float = TEST_SHARE) -> DataFrame:
    """candidates that keep tests under a share of the taken; the first ``most`` are looked at."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    rows = candidates.withColumn("_r", rank).filter(F.col("_r") <= most)
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(is_test).alias("t")))).alias("xs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tests"), F.array().cast("array<int>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        no = x["t"] & (acc["tests"] >= share * (acc["n"] + 1))
        return F.struct(
            F.when(no, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(~no & x["t"], acc["tests"] + 1).otherwise(acc["tests"]).alias("tests"),
            F.when(no, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["_r"]))).alias("kept"),
        )

    kept = lists.select(group, F.explode(F.aggregate("xs", start, take)["kept"]).alias("_r"))
    return rows.join(kept, [group, "_r"]).withColumnRenamed("_r", "ord")


def merged_ranges(ranges: DataFrame, group: list[str], first: str, last: str, gap: int = 1) -> DataFrame:
    """(group, first, last): ranges that touch or overlap become one."""
    w = Window.partitionBy(*group).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(first) <= F.max(last).over(w) + gap, 0).otherwise(1)
    at = Window.partitionBy(*group).orderBy(first, last).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.withColumn("_new", new).withColumn("_run", F.sum("_new").over(at))
    return rows.groupBy(*group, "_run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_run")


def signature_lines(symbols: DataFrame, most: int = 60) -> DataFrame:
    """(path, ord, line) of each file's symbols (path, pos, name, kind, signature, parent, line_start, line_end): ``most`` of them, members
    indented, long values cut, and a line that counts the rest."""
    shown = F.when(F.col("signature") != "", F.col("signature")).otherwise(F.col("name"))
    shown = F.when(F.col("kind").isin("property", "const") & (F.length(shown) > 80), F.concat(F.substring(shown, 1, 77), F.lit("..."))).otherwise(shown)
    span = F.concat(F.lit("    # L"), F.col("line_start").cast("string"), F.when(F.col("line_end") != F.col("line_start"), F.concat(F.lit("-"), F.col("line_end").cast("string"))).otherwise(""))
    lines = symbols.filter(F.col("pos") < most).select("path", F.col("pos").alias("ord"), F.concat(F.when(F.col("parent").isNotNull(), "  ").otherwise(""), shown, span).alias("line"))
    rest = symbols.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return lines.unionByName(rest.select("path", F.lit(most).alias("ord"), F.concat(F.lit("# ... "), (F.col("n") - most).cast("string"), F.lit(" more symbols")).alias("line")))
