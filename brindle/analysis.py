"""What Catalyst's analyser knows and the dialect needs: the operand types of divisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle import dialect


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def division_types(spark: SparkSession, text: str) -> dict[int, tuple[str, str]]:
    """Operand types of the divisions that dialect.render marked in a query, from its analysed plan."""
    found: dict[int, tuple[str, str]] = {}

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "Concat":
            parts = list(_each(e.children()))
            head = parts[0].toString()
            if head.startswith(dialect.MARK) and len(parts) == 3:
                a, b = (p.child() for p in parts[1:])
                found[int(head[len(dialect.MARK) :])] = (a.dataType().simpleString(), b.dataType().simpleString())
        for child in _each(e.children()):
            expression(child)
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            plan(e.plan())

    def plan(p) -> None:
        for e in _each(p.expressions()):
            expression(e)
        for child in _each(p.children()):
            plan(child)

    plan(spark.sql(text)._jdf.queryExecution().analyzed())
    return found


def run_query(spark: SparkSession, toks: list[dialect.Token]) -> DataFrame:
    """A query of the dialect over the session's views."""
    return spark.sql(dialect.render(toks, lambda text: division_types(spark, text)))
