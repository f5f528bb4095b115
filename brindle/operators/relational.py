"""Filter, join, aggregation, ordering and subquery operators with the engine's semantics, as DataFrame functions.

All of them only declare a logical plan. Join sides are left to the optimizer and its size checks; nothing here
broadcasts by hand except where a bound is given and checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null counts as false."""
    return df.filter(predicate)


def not_where(df: DataFrame, predicate: Column) -> DataFrame:
    """The others, as DELETE keeps them: false or null."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def in_list(value: Column, items: list, negated: bool = False) -> Column:
    """[NOT] IN over a list that may hold None: three-valued, so NOT IN a list with a null is never true."""
    hit = value.isin([i for i in items if i is not None])
    out = F.when(value.isNull(), F.lit(None).cast("boolean")).when(hit, True)
    out = out.when(F.lit(any(i is None for i in items)), F.lit(None).cast("boolean")).otherwise(False)
    return ~out if negated else out


def like(value: Column, pattern: str, negated: bool = False) -> Column:
    """LIKE with % and _ and no escape character."""
    out = value.like(pattern.replace("\\", "\\\\"))
    return ~out if negated else out


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Join on AND-ed equalities and an optional further condition. Null keys never match."""
    on = [left[a] == right[b] for a, b in keys]
    return left.join(right, reduce(lambda x, y: x & y, on + ([residual] if residual is not None else [])), how)


def salted_join(large: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join for a key that a few values dominate on one side: its rows are spread, the other side's repeated."""
    spread = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "__salt"]).drop("__salt")


def semi_in(left: DataFrame, value: str, right: DataFrame, column: str) -> DataFrame:
    """value IN (SELECT column ...): each row at most once."""
    return left.join(right.select(F.col(column).alias("__v")), left[value] == F.col("__v"), "left_semi")


def anti_not_in(left: DataFrame, value: str, right: DataFrame, column: str) -> DataFrame:
    """value NOT IN (SELECT column ...): nothing if the subquery holds a null; a null value only if it is empty.

    Unlike the built-in null-aware join, which broadcasts, this is a plain anti join behind two one-row facts.
    """
    vs = right.select(F.col(column).alias("__v"))
    facts = vs.agg(F.count("*").alias("__n"), F.count("__v").alias("__known"))
    kept = left.join(vs, left[value] == F.col("__v"), "left_anti").crossJoin(F.broadcast(facts))
    return kept.filter((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & left[value].isNotNull())).drop("__n", "__known")


def aggregate(df: DataFrame, keys: list, aggregates: list[Column], having: Column | None = None) -> DataFrame:
    """GROUP BY with HAVING; no keys give exactly one row, and null keys one group."""
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    return out.filter(having) if having is not None else out


def ordered(df: DataFrame, *items: tuple[str, str]) -> list[Column]:
    """ORDER BY items (column, asc or desc) with nulls last going up and first going down."""
    return [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_first() for c, way in items]


def top_n(df: DataFrame, items: list[tuple[str, str]], n: int) -> DataFrame:
    """ORDER BY ... LIMIT n: bounded heaps in the tasks, merged."""
    return df.orderBy(*ordered(df, *items)).limit(n)


def correlated_aggregate(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, aggregate: Column, name: str, restrict: bool = False) -> DataFrame:
    """The value of an aggregate over the inner rows of each outer row's key, null where there are none.

    restrict: a semi join first drops inner keys that the (filtered) outer side doesn't have, which pays where few
    outer rows are left.
    """
    if restrict:
        inner = inner.join(outer.select(F.col(outer_key).alias("__k")).distinct(), inner[inner_key] == F.col("__k"), "left_semi")
    by = inner.groupBy(F.col(inner_key).alias("__key")).agg(aggregate.alias(name))
    return outer.join(by, outer[outer_key] == F.col("__key"), "left").drop("__key")


def placed(df: DataFrame, order: list[Column], path: str, name: str) -> tuple[DataFrame, int]:
    """df with each row's place in the given order, from 0, and how many rows there are.

    It is written to ``path`` in order, part by part, so that places follow from files and stay, ties included.
    """
    df.orderBy(*order).write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    sizes = {r.f: r["count"] for r in got.groupBy(part.alias("f")).count().collect()}  # one row a file
    before, at = [], 0
    for f in range(max(sizes, default=0) + 1):
        before.append(at)
        at += sizes.get(f, 0)
    return got.select("*", (F.array(*[F.lit(n).cast("long") for n in before])[part] + F.col("_metadata.row_index")).alias(name)), at


def sliding(df: DataFrame, n: int, by: list[str], place: str, aggregate: Column, name: str, before: int, after: int, block: int = 256, blocks: int = 16) -> DataFrame:
    """aggregate over each row's group from ``before`` rows before it to ``after`` rows behind it, for groups of any size.

    A window holds its whole partition, and the buffer that a spill file is read with (1 MB) stays until its task ends. So
    a partition here is a block of ``block`` places of a group, with the rows beside it that its frames reach, and a
    task has the next ``blocks`` blocks. df, n, place: from ``placed``, by group first.
    """
    at = lambda offset: F.floor((F.col(place) + offset) / block)
    tasks = max(n - 1 + before, 0) // block // blocks + 1
    spread = df.withColumn("__block", F.explode(F.sequence(F.greatest(at(-after), F.lit(0)), at(before))))
    spread = spread.withColumn("__task", F.floor(F.col("__block") / blocks).cast("int")).repartitionById(tasks, "__task")
    w = Window.partitionBy(*by, "__task", "__block").orderBy(place).rowsBetween(-before, after)
    return spread.withColumn(name, aggregate.over(w)).filter(F.col("__block") == at(0)).drop("__block", "__task")


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each left row the last right ``value`` of its key at or before its time, by one sort of the union.

    An extension. Keys are spread by hash; a key's rows are streamed in order, not held.
    """
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.col(at), "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__v", "__side")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): ranges are repeated for the bins of ``width`` they cover, then joined by bin.

    An extension; instead of comparing every pair as a nested loop does.
    """
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")
