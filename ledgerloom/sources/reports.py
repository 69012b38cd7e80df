"""Reports as JSON documents and as text tables, for people and other programs. Reports are small: a row per ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_document(report: DataFrame) -> DataFrame:
    """One JSON document per row, NULLs kept as null and NaN as a string."""
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """The documents as lines of text below ``path``."""
    report_document(report).coalesce(1).write.mode("overwrite").text(path)


def _shown(kind: str, value: Column) -> Column:
    return F.format_number(value, 2) if kind in ("double", "float") else value.cast("string")


def text_table(reports: dict[str, DataFrame], width: int = 26, column: int = 14) -> DataFrame:
    """(n, line): a head with the names of the reports, then a line per figure that all of them have."""
    first = next(iter(reports.values()))
    kinds = dict(first.dtypes)
    figures = [c for c in first.columns if all(c in r.columns for r in reports.values())]
    pad = lambda text, n: F.lpad(F.coalesce(text, F.lit("-")), n, " ")
    side = None
    for i, r in enumerate(reports.values()):
        one = r.select(F.array(*(_shown(kinds[c], F.col(c)) for c in figures)).alias(f"v{i}"))
        side = one if side is None else side.join(F.broadcast(one))
    head = F.concat(F.lit(" " * width), *(pad(F.lit(name), column) for name in reports))
    lines = [F.concat(F.rpad(F.lit(c), width, " "), *(pad(F.get(f"v{i}", F.lit(k)), column) for i in range(len(reports)))) for k, c in enumerate(figures)]
    return side.select(F.posexplode(F.array(head, *lines)).alias("n", "line"))
