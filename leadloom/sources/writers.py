"""Sinks: CSV files for spreadsheets, JSON lines, Parquet tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exports
from ..operators.contracts import customer_documents


FIRST_OF_PARTITION = (1 << 33) - 1      # the row number within a partition, in a monotonically increasing id


def write_csv(df: DataFrame, path: str, header: Sequence[str] | None = None, bom: bool = True) -> None:
    """Every cell quoted, a header in every part file, with the mark spreadsheets need for UTF-8.

    The header goes in front of the first line of each partition; one part has the header only, so that an empty table has it too.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    title = ("\ufeff" if bom else "") + ",".join('"' + n.replace('"', '""') + '"' for n in header or df.columns)
    line = F.concat_ws(",", *[quoted(c) for c in df.columns])
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(FIRST_OF_PARTITION)) == 0
    lines = df.select(F.when(first, F.concat(F.lit(title + "\n"), line)).otherwise(line).alias("value"))
    lines.unionByName(df.sparkSession.range(1, numPartitions=1).select(F.lit(title).alias("value"))).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_companies(trend: DataFrame, path: str, fmt: str = "csv", lang: str = "ko") -> None:
    if fmt == "csv":
        write_csv(exports.companies_export(trend, lang), path)
    else:
        write_json(trend, path)


def export_leads(leads: DataFrame, codes: DataFrame, path: str, fmt: str = "csv", lang: str = "ko") -> None:
    if fmt == "csv":
        write_csv(exports.leads_export(leads, codes, lang), path)
    else:
        write_json(leads, path)


def export_contracts(customers: DataFrame, contracts: DataFrame, path: str, fmt: str = "csv",
                     codes: DataFrame | None = None, lang: str = "ko") -> None:
    if fmt == "csv":
        write_csv(exports.contracts_export(customers, contracts, codes, lang), path)
    else:
        write_json(customer_documents(customers, contracts), path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append-only tables (scan history, status history)."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
