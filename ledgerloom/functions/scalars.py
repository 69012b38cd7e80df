"""Scalar expressions shared by the operators; all are built-in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The action kinds, in ordinal order.
ACTION_KINDS = ("transfer", "stake", "swap", "memo", "dust", "consolidate")


def pairs_of(k: Column) -> Column:
    """k choose 2 as a long."""
    return F.expr("cast(0 as bigint)") + F.floor(k * (k - 1) / 2).cast("long")


def tolerance(amount: Column, bps: int) -> Column:
    """floor(amount * bps / 10000) without overflow."""
    return F.floor(amount.cast("decimal(28,0)") * F.lit(bps).cast("decimal(9,0)") / F.lit(10_000)).cast("decimal(38,0)")


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def second_of_day(ts: Column) -> Column:
    return F.pmod(ts, F.lit(86_400))


def hour_of_day(ts: Column) -> Column:
    return F.floor(second_of_day(ts) / 3600).cast("int")


def short_account(hex_id: Column) -> Column:
    """First and last two bytes of a hex account id."""
    return F.concat(F.substring(hex_id, 1, 4), F.lit(".."), F.substring(hex_id, -4, 4))


def kind_ordinal(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ACTION_KINDS)), kind) - 1


def account_hex(byte_array: Column) -> Column:
    """JSON byte array to lower-case hex; its order is the order of the bytes."""
    return F.concat_ws("", F.transform(byte_array, lambda b: F.lpad(F.lower(F.hex(b.cast("long"))), 2, "0")))


def account_bytes(hex_id: Column) -> Column:
    """Inverse of :func:`account_hex`."""
    at = F.sequence(F.lit(1), F.greatest(F.length(hex_id) - 1, F.lit(1)), F.lit(2))
    return F.transform(at, lambda i: F.conv(hex_id.substr(i, F.lit(2)), 16, 10).cast("int"))


def round6(p: Column) -> Column:
    return F.round(p, 6)
