"""Data contracts: checks that raise, each one small aggregate or anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a stated contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ContractError(f"missing columns: {missing}")
    return df


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """No key twice; the message shows five."""
    if twice := df.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(5).collect():
        raise ContractError(f"repeated {keys}: {[tuple(r[k] for k in keys) for r in twice]}")
    return df


def require_complete(df: DataFrame, *names: str) -> DataFrame:
    """No nulls in the columns, as after a left join that must find everything."""
    counts = df.agg(*[F.sum(F.col(n).isNull().cast("long")).alias(n) for n in names]).first().asDict()
    if gaps := {k: v for k, v in counts.items() if v}:
        raise ContractError(f"nulls: {gaps}")
    return df


def require_known(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Every key occurs in the other table."""
    if missing := df.join(other, list(keys), "left_anti").select(*keys).distinct().limit(5).collect():
        raise ContractError(f"unknown {keys}: {[tuple(r) for r in missing]}")
    return df


def require_disjoint(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """No key in both, as for positives and negatives or the two sides of a split."""
    if common := a.join(b.select(*keys).distinct(), list(keys), "left_semi").select(*keys).limit(5).collect():
        raise ContractError(f"in both: {[tuple(r) for r in common]}")


def require_rows(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise ContractError(f"{n} rows, expected {expected}")
    return df


def require_binary(df: DataFrame, name: str, both: bool = False) -> DataFrame:
    """Values 0 and 1 only and, if asked, each of them present."""
    seen = {r[0] for r in df.select(name).distinct().limit(3).collect()}
    if not seen <= {0, 1} or both and seen != {0, 1}:
        raise ContractError(f"{name} holds {seen}")
    return df


def require_range(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    a, b = df.agg(F.min(name), F.max(name)).first()
    if a is not None and not low <= a <= b <= high:
        raise ContractError(f"{name} runs from {a} to {b}, allowed {low} to {high}")
    return df
