"""Import of lead files: column mapping, duplicate check and report."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ranking import first_per_key
from ..functions.text import computed, empty_to_null, stripped, value_map
from .leads import normalised, score_leads

PREVIEW = ("company_name", "contact_name", "rank", "phone", "mobile", "email", "source", "budget", "expected_start")


def map_import_columns(raw: DataFrame, aliases: Mapping[str, Sequence[str]] = fixed.HEADER_ALIASES,
                       values: Mapping[str, Mapping[str, str]] = fixed.VALUE_ALIASES) -> DataFrame:
    """Rows of (file, row, raw map of original headers) to lead fields; unknown headers are dropped.

    Headers are turned into field names once per row; of headers for one field the last filled one holds. `file` may be missing.
    """
    field_of = {alias: name for name, words in aliases.items() for alias in words}
    header = lambda e: F.ltrim(F.lower(stripped(e["key"])), F.lit("\ufeff"))
    known = F.filter(F.transform(F.filter(F.map_entries("raw"), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(
        value_map(header(e), field_of).alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    names = F.transform("_known", lambda e: e["key"])
    last = F.filter("_known", lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), e["key"]) == 0)
    typed = computed(computed(raw, _known=known), _fields=F.map_from_entries(last))

    def field(name: str) -> Column:
        value = F.try_element_at("_fields", F.lit(name))
        if name in values:
            value = F.coalesce(value_map(F.lower(stripped(value)), values[name]), value)
        return value.alias(name)

    return typed.select(*row_key(raw), *[field(name) for name in aliases])


def row_key(df: DataFrame) -> list[str]:
    """The columns that name an uploaded row."""
    return [c for c in ("file", "row") if c in df.columns]


def with_import_key(df: DataFrame) -> DataFrame:
    """The key under which two leads are the same: e-mail, else company and contact."""
    email = empty_to_null("email")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return df.withColumns({"k_kind": F.when(email.isNotNull(), "email").otherwise("pair"),
                           "k1": F.coalesce(email, low("company_name")),
                           "k2": F.when(email.isNotNull(), "").otherwise(low("contact_name"))})


KEY = ["k_kind", "k1", "k2"]


def import_anti_join(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Import rows whose key no existing lead has."""
    return with_import_key(rows).join(with_import_key(leads).select(*KEY), KEY, "left_anti")


def classify_import(raw: DataFrame, leads: DataFrame) -> DataFrame:
    """Every mapped row with its outcome: new, duplicate or an error code."""
    typed = with_import_key(normalised(map_import_columns(raw)))
    firsts = typed.where("code is null").groupBy(*KEY).agg(F.min(F.struct(*row_key(raw))).alias("_first"))
    known = with_import_key(leads).select(*KEY).distinct().withColumn("_known", F.lit(True))
    joined = typed.join(firsts, KEY, "left").join(known, KEY, "left")
    outcome = (F.when(F.col("code").isNotNull(), F.col("code"))
               .when(F.coalesce("_known", F.lit(False)) | (F.struct(*row_key(raw)) != F.col("_first")), "duplicate").otherwise("new"))
    return joined.withColumn("outcome", outcome).drop("_first", "_known", "code", *KEY)


def import_report(classified: DataFrame, inserted: bool = False) -> DataFrame:
    """One row: total, valid, duplicates, errors, inserted."""
    new = F.count_if(F.col("outcome") == "new")
    return classified.agg(
        F.count(F.lit(1)).alias("total"), new.alias("valid"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(~F.col("outcome").isin("new", "duplicate")).alias("errors"),
        (new if inserted else F.lit(0).cast("bigint")).alias("inserted"))


def import_errors(classified: DataFrame) -> DataFrame:
    return classified.where(~F.col("outcome").isin("new", "duplicate")).select(*row_key(classified), F.col("outcome").alias("code"))


def import_preview(classified: DataFrame, n: int | None = None) -> DataFrame:
    """The (first n) rows that would be written."""
    new = classified.where("outcome = 'new'")
    return (new.orderBy(*row_key(new)).limit(n) if n else new).select(*row_key(new), *PREVIEW)


def import_leads(raw: DataFrame, leads: DataFrame, as_of: Column,
                 first_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new leads, their first history rows, report) of uploaded files.

    New ids count on from `first_id`, else from the largest existing one: the files one after the other, rows by number, with gaps for rows that are not new.
    """
    classified = classify_import(raw, leads)
    first = F.lit(first_id) if first_id is not None else F.coalesce(leads.agg(F.max("id")).scalar(), F.lit(0)) + 1
    fresh = score_leads(classified.where("outcome = 'new'").drop("outcome"), as_of.cast("date"))
    if "file" in raw.columns:
        sizes = raw.groupBy(F.col("file").alias("_file")).agg(F.max("row").alias("_rows"))
        before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))   # one row per file
        files = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
        fresh = fresh.join(files, F.col("file").eqNullSafe(F.col("_file"))).withColumn("row", F.col("row") + F.col("_before")).drop("_file", "_before", "file")
    rows = fresh.select((F.col("row") + first - 1).cast("bigint").alias("id"), "*",
                        as_of.alias("created_at"), as_of.alias("updated_at")).drop("row")
    history = rows.select(F.col("id").alias("lead_id"), F.lit(None).cast("string").alias("from_status"),
                          F.col("status").alias("to_status"), F.col("created_at").alias("at"))
    return rows, history, import_report(classified, inserted=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return first_per_key(df, keys, order)


def merge_existing_keys(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys taken by existing leads or by rows of the file."""
    return with_import_key(existing).select(*KEY).unionByName(with_import_key(seen).select(*KEY)).distinct()
