"""Queries over the supplied tables and their SQL equivalents, by name.

A query and its SQL share one list of output columns; doubles are rounded alike on both sides, on final outputs only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Name -> (SQL of keys and columns before rounding, columns).
RAW: dict[str, tuple[str, tuple[str, ...]]] = {}

BARS_SQL = """bars AS (
  SELECT l_returnflag || '-' || l_linestatus AS stock_id, l_shipdate AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS k FROM lineitem)
  GROUP BY ALL)"""

SERIES = ("stock_id", "date")


def over(n: int | None = None, back: int | None = None, ahead: int | None = None) -> str:
    """A SQL window over the series: the last n rows, all rows so far, or between two offsets (negative: before)."""
    head = "OVER (PARTITION BY stock_id ORDER BY date"
    if back is not None:
        side = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
        return f"{head} ROWS BETWEEN {side(back)} AND {side(ahead)})"
    return f"{head} ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"


def moving(f: str, c: str, n: int, least: int | None = None) -> str:
    least = n if least is None else least
    return f"{f}({c}) {over(n)}" if least <= 1 else f"CASE WHEN count({c}) {over(n)} >= {least} THEN {f}({c}) {over(n)} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY stock_id ORDER BY date)"


def lead(c: str, n: int = 1) -> str:
    return f"lead({c}, {n}) OVER (PARTITION BY stock_id ORDER BY date)"


def pct(c: str, n: int) -> str:
    return f"{c} / nullif({lag(c, n)}, 0) - 1"


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None, columns: dict[str, int | None], keys: tuple[str, ...] = SERIES) -> None:
    """sql: common tables (after WITH) and a final SELECT that gives keys and columns; digits None: as it is."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*keys, *[(F.round(c, d) if d is not None else F.col(c)).alias(c) for c, d in columns.items()])

    QUERIES[name] = query
    if sql is not None:
        ctes, final = sql.rsplit("\nFINAL\n", 1) if "\nFINAL\n" in sql else ("", sql)
        outs = ", ".join([*keys, *[f"round({c}, {d}) + 0.0 AS {c}" if d is not None else c for c, d in columns.items()]])
        RAW[name] = ((f"WITH RECURSIVE {ctes}\n" if ctes else "") + f"SELECT {', '.join([*keys, *columns])} FROM ({final}) AS final_", tuple(columns))
        ORACLES[name] = (f"WITH RECURSIVE {ctes}\n" if ctes else "") + f"SELECT {outs} FROM ({final}) AS final_"


def on_bars(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None, **columns: int | None) -> None:
    """A query on the line-item bars. sql: a SELECT list over bars, or common tables, FINAL, and a SELECT."""
    from tidemark.sources.bars import lineitem_bars

    if sql is not None:
        sql = f"{BARS_SQL}{sql}" if "\nFINAL\n" in sql else f"{BARS_SQL}\nFINAL\nSELECT stock_id, date, {sql} FROM bars"
    register(name, lambda spark, d: run(lineitem_bars(spark, d)), sql, columns)


from tidemark.plans import evaluation, models, patterns, recurrences, relational, wholes, windows  # noqa: E402, F401
