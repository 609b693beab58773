"""Evaluate an expression from the command line.

    python -m obsframe "3.3 + 7"
    python -m obsframe "avg(v)" --init "CREATE TEMP VIEW t AS SELECT explode(sequence(1, 3)) AS v" --from t
    python -m obsframe "packed.norm(packed.literal([3, 4]))" --python
    python -m obsframe "sqrt(9)" --script run.py
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession


def helpers(spark: SparkSession) -> dict:
    """Names that a Python expression can use."""
    from pyspark.sql import functions as F

    from . import plans
    from .functions import complexes, packed
    from .operators import calculus, fit, linear, observables, signal, statistics
    from .sources import text

    return {"spark": spark, "F": F, "packed": packed, "complexes": complexes, "plans": plans, "calculus": calculus, "fit": fit, "linear": linear, "observables": observables, "signal": signal, "statistics": statistics, "text": text, "read_matrix": lambda path, skip=0: text.read_matrix(spark, path, skip)}


def evaluate(spark: SparkSession, expression: str, init: list[str] | None = None, source: str | None = None, python: bool = False) -> DataFrame:
    """One expression as a DataFrame: SQL, or Python over `helpers`."""
    for statement in init or []:
        spark.sql(statement)
    if not python:
        return spark.sql(f"SELECT {expression}" + (f" FROM {source}" if source else ""))
    value = eval(expression, helpers(spark))  # the user's own expression
    if isinstance(value, DataFrame):
        return value
    return spark.range(1).select(value.alias("result")) if isinstance(value, Column) else spark.createDataFrame([(str(value),)], "result string")


def script(expression: str, init: list[str] | None = None, source: str | None = None, python: bool = False) -> str:
    """A program that evaluates the expression."""
    return f"from obsframe.session import session\nfrom obsframe.shell import evaluate, show\n\nshow(evaluate(session(), {expression!r}, {init!r}, {source!r}, {python!r}))\n"


def show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(*row)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="obsframe", description="Evaluate an expression with Spark.")
    parser.add_argument("expression")
    parser.add_argument("--init", action="append", help="SQL statement to run first; may be repeated")
    parser.add_argument("--from", dest="source", help="table or view the expression reads")
    parser.add_argument("--python", action="store_true", help="the expression is Python over the library's modules")
    parser.add_argument("--script", help="write a program instead of running")
    a = parser.parse_args(argv)
    if a.script:
        with open(a.script, "w") as f:
            f.write(script(a.expression, a.init, a.source, a.python))
        return
    from .session import session

    show(evaluate(session(), a.expression, a.init, a.source, a.python))
