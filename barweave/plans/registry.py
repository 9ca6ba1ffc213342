"""Registered queries: a Spark job and the same in SQL, with one description of the columns for both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Columns as ``spec`` says: "name" text, ":i" whole number (times as seconds), ":d" rounded, ":b" truth value."""
    kinds = dict(df.dtypes)
    out = []
    for name, kind in ((*x.split(":"), "s")[:2] for x in spec.split()):
        c = F.col(name)
        if kind == "i":
            c = (F.unix_seconds(c) if kinds[name] == "timestamp" else F.datediff(c, F.lit("1970-01-01")) if kinds[name] == "date" else c).cast("long")
        elif kind == "d":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(select: str, spec: str) -> str:
    kinds = {"i": "CAST({0} AS BIGINT) AS {0}", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "b": "CAST({0} AS BOOLEAN) AS {0}", "s": "CAST({0} AS VARCHAR) AS {0}"}
    cols = ", ".join(kinds[k].format(f'"{n}"') for n, k in ((*x.split(":"), "s")[:2] for x in spec.split()))
    return f"SELECT {cols} FROM ({select}) AS answer"


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql


def _needed(sql: str, done: list[str]) -> None:
    import re

    for word in re.findall(r"[a-z_][a-z0-9_]*", sql):
        if word in _CTES and word not in done:
            _needed(_CTES[word], done)
            if word not in done:
                done.append(word)


def query(name: str, spec: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` may use the common tables by name."""

    def wrap(job: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shaped(job(spark, sf_dir), spec)
        if sql is not None:
            done: list[str] = []
            _needed(sql, done)
            head = "WITH " + ", ".join(f"{c} AS ({_CTES[c]})" for c in done) + " " if done else ""
            ORACLES[name] = head + shaped_sql(sql, spec)
        return job

    return wrap
