"""Table changes as joins: every mutation is a function from tables to the next tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows that insert: the first of each key in order, none whose key is in base."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(base.select(*keys).distinct(), keys, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], when_matched: dict[str, Column] | None = None, delete_absent: bool = False) -> DataFrame:
    """Merge of one delta row a key: columns of the delta win where they are not null, or by the given expressions.

    The expressions see the base's columns by name and the delta's as d_<name>.
    """
    names = [c for c in base.columns if c not in keys]
    d = delta.select(*keys, *(F.col(c).alias(f"d_{c}") for c in delta.columns if c not in keys), F.lit(True).alias("d_here"))
    both = base.withColumn("b_here", F.lit(True)).join(d, keys, "right" if delete_absent else "full_outer")
    pick = lambda c: (when_matched or {}).get(c, F.coalesce(f"d_{c}", c) if f"d_{c}" in d.columns else F.col(c))
    value = lambda c: F.when(F.col("b_here") & F.col("d_here"), pick(c)).when(F.col("d_here"), F.col(f"d_{c}") if f"d_{c}" in d.columns else F.lit(None)).otherwise(F.col(c))
    return both.select(*keys, *(value(c).alias(c) for c in names))


def patch(base: DataFrame, keys: DataFrame, on: list[str], changes: dict[str, Column]) -> DataFrame:
    """Sets columns of the rows whose key is listed."""
    hit = base.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return hit.select(*(F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in base.columns))


def delete_keys(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti").select(*base.columns)


def delete_where(base: DataFrame, test: Column) -> DataFrame:
    return base.where(~F.coalesce(test, F.lit(False)))


def cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, test: Column) -> tuple[DataFrame, DataFrame]:
    """Deletes parents and the children that refer to them."""
    gone = parents.where(test).select(F.col(parent_key).alias(child_key)).distinct()
    return delete_where(parents, test), children.join(gone, child_key, "left_anti").select(*children.columns)


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def repaired(children: DataFrame, parents: DataFrame, hops: DataFrame, key: str) -> DataFrame:
    """Follows each reference directly or, where it has no parent, over its hops (old, new); those that lead nowhere are dropped.

    Hops meet their targets first, so that children are joined once and by their own key: references without a hop never meet as nulls.
    """
    ids = parents.select(F.col("_id").alias("_target")).distinct()
    hop = hops.select(F.col("old").alias("_old"), F.col("new").alias("_target"))
    led = hop.join(ids, "_target", "left_semi").join(ids.select(F.col("_target").alias("_old")), "_old", "left_anti").select("_old", "_target")
    leads = ids.select(F.col("_target").alias("_old"), "_target").unionByName(led)
    return children.join(leads, F.col(key) == F.col("_old")).withColumn(key, F.col("_target")).select(*children.columns)


def split_columns(base: DataFrame, key: str, moved: list[str], child_key: str) -> tuple[DataFrame, DataFrame]:
    """Vertical split: moved columns go to a side table with a row for each base row that has any of them."""
    side = base.select(F.col(key).alias(child_key), *moved).where(F.coalesce(*(F.col(c).cast("string") for c in moved)).isNotNull())
    return base.drop(*moved), side


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of after that differ from before in any column; nulls are equal."""
    names = [c for c in after.columns if c != key]
    old = before.select(key, *(F.col(c).alias(f"_o_{c}") for c in names))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return after.join(old, key).where(~same).select(*after.columns)
