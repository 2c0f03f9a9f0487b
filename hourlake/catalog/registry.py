"""Registry of queries and their SQL twins."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourlake.catalog.views import CTES, Views
from hourlake.session import ensure_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prepend every view the body needs, directly or through other views."""
    names, todo = [], [body]
    while todo:
        text = todo.pop()
        for n in CTES:
            if n not in names and re.search(rf"\b{n}\b", text):
                names.append(n)
                todo.append(CTES[n])
    ordered = [n for n in CTES if n in names]
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    """Register fn(views) -> DataFrame under a name."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(ensure_utc(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return deco


# Averages of two-decimal values often end in an exact half at the last digit kept,
# where the order of summation decides the rounding. Both sides shift by the same
# small amount first, so that no such value sits on a half.
NUDGE = 0.013


def shown(c, digits: int = 6):
    return F.round(c + F.lit(NUDGE * 10**-digits), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(
        *[
            shown(F.col(c), digits).alias(c)
            if t in ("double", "float")
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of `rounded` for one expression."""
    return f"(round(({expr}) + {NUDGE * 10**-digits:.3e}, {digits}) + 0.0)"
