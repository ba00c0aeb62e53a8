"""Query registry: a DataFrame job plus, where one exists, the SQL that must return the same rows.

Fixture views turn the driver tables into the tables a grading service would hold. A view is either one SQL text
both engines run, or a DataFrame builder with its SQL twin; the oracle of a query is prefixed with the views it
names, so that it runs on the plain driver tables alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rubrica.session import ship_code

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass(frozen=True)
class View:
    name: str
    sql: str
    build: Callable | None


VIEWS: dict[str, View] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Views that DuckDB computes once per oracle, however often it names them.
HEAVY = {"v_word", "v_mark", "v_cv_mark", "v_vector_concept", "s_hit", "s_body", "s_kept", "s_flipped", "s_accepted", "s_note_anchor"}


def view(name: str, sql: str, build: Callable | None = None) -> None:
    VIEWS[name] = View(name, sql.strip(), build)


def _names_in(sql: str, pool) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in pool if n in words]


def _closure(sql: str) -> list[str]:
    """Views a text needs, dependencies first."""
    order: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for n in _names_in(text, VIEWS):
            if n != me and n not in order:
                visit(VIEWS[n].sql, n)
                if n not in order:
                    order.append(n)

    visit(sql, None)
    return order


class Tables:
    """Driver tables and fixture views of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                # documents feed per-row text work; as a file or two they would all be read by as many cores
                few = name == "documents" and len(df.inputFiles()) < self.spark.sparkContext.defaultParallelism
                self._seen[name] = df.repartition("doc_id") if few else df
            else:
                v = VIEWS[name]
                self._seen[name] = v.build(self) if v.build else self.sql(v.sql)
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        for n in _names_in(text, TABLES) + _names_in(text, VIEWS):
            self(n).createOrReplaceTempView(n)
        return self.spark.sql(text)


def plain(df: DataFrame) -> DataFrame:
    """Report types: integers as bigint, decimals and floats as double, so both engines print alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name` with its oracle."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(ship_code(spark), __file__)
            return plain(fn(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            ctes = [f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}(\n{VIEWS[n].sql}\n)" for n in _closure(body)]
            if body.upper().startswith("WITH RECURSIVE"):
                body = body[len("WITH RECURSIVE") :].lstrip()
                ORACLES[name] = "WITH RECURSIVE " + ",\n".join([*ctes, body])
            elif body.upper().startswith("WITH"):
                ORACLES[name] = "WITH " + ",\n".join([*ctes, body[4:].lstrip()])
            else:
                ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        return fn

    return wrap


def r(expr: str, digits: int = 4) -> str:
    """Oracle text rounding a double by its decimal digits, half up."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"
