"""Carry columns of any name past an operator that adds its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many ids or fewer, 16 MB of long integers, are sent to every worker; more are joined by a shuffle.
SENT_TO_ALL = 1_000_000


def sent(ids: DataFrame, most: int = SENT_TO_ALL) -> DataFrame:
    """A written table of ids for a semi or anti join with long rows, which need not move if the ids are few."""
    return F.broadcast(ids) if ids.count() <= most else ids


def wrapped(docs: DataFrame, *names: str, without: tuple[str, ...] = ()) -> DataFrame:
    """The named columns, and as one struct ``row`` all others but ``without``; no name of theirs meets another then."""
    apart = {c.lower() for c in (*names, *without)}
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in apart]
    return docs.select(*names, (F.struct(*others) if others else F.struct(F.lit(0))).alias("row"))


def unwrapped(columns: list[str], *names: str, made: dict[str, Column] | None = None) -> list[Column]:
    """The columns in their order, from ``made``, from the named ones that stand apart, or from ``row``."""
    apart = {c.lower(): F.col(c) for c in names} | {c.lower(): v for c, v in (made or {}).items()}
    return [apart.get(c.lower(), F.col("row").getField(c)).alias(c) for c in columns]
