"""Line deduplication by overlapping windows of three lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common


def _windows(lines: Column, width: int) -> Column:
    """Start and hash of every window of `width` lines that are not all blank. Two hashes: 96 bits together."""
    at = lambda i: [F.element_at(lines, i + k) for k in range(1, width + 1)]
    filled = lambda i: F.length(F.btrim(F.concat(*at(i)), F.lit(" \t\r\x0b\x0c"))) > 0
    made = F.transform(F.sequence(F.lit(0), F.size(lines) - width), lambda i: F.struct(
        i.alias("start"), F.xxhash64(*at(i)).alias("h"), F.hash(*at(i)).alias("g"), filled(i).alias("filled")))
    return F.when(F.size(lines) >= width, F.filter(made, lambda w: w["filled"]))


def _runs(sorted_lines: Column) -> Column:
    """(first, last) of each run of neighbouring positions."""
    at = lambda i: F.element_at(sorted_lines, i)
    n = F.size(sorted_lines)
    first = F.filter(sorted_lines, lambda x, i: (i == 0) | (x - F.element_at(sorted_lines, F.when(i > 0, i).otherwise(F.lit(1))) > 1))
    last = F.filter(sorted_lines, lambda x, i: (i == n - 1) | (at(F.when(i < n - 1, i + 2).otherwise(n)) - x > 1))
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: the slices between a run and the next one, each line copied once."""
    n = F.size(runs)
    before = F.slice(lines, F.lit(1), runs[0]["first"])
    after = lambda r, i: F.slice(lines, r["last"] + 2, F.when(i < n - 1, F.element_at(runs, F.when(i < n - 1, i + 2).otherwise(1))["first"])
                                 .otherwise(F.size(lines)) - r["last"] - 1)
    return F.concat(before, F.flatten(F.transform(runs, after)))


def repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text key and `runs`: the covered line positions of each document that has some, merged into runs.

    Lines are what newlines separate. Every window of `width` consecutive lines, unless all blank, is hashed; of equal windows the
    first by (doc_id, position) stays, and all lines of the others are covered. Windows overlap, also within one document.
    """
    text = common.filled("text")
    lines = docs.select("doc_id", common.text_key(text).alias("key"), F.split(text, "\n", -1).alias("lines"))
    windows = lines.select("doc_id", "key", F.explode(_windows(F.col("lines"), width)).alias("w")) \
        .select("doc_id", "key", F.col("w.start").alias("start"), F.col("w.h").alias("h"), F.col("w.g").alias("g"))
    windows = common.staged(windows, "windows")
    place = F.struct("doc_id", "key", "start")
    repeated = common.staged(windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                             .filter(F.col("first") != F.col("last")).select("h", "g", "first"), "repeated")
    later = windows.join(repeated, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("start") + (width - 1))).alias("line"))
    return covered.groupBy("doc_id", "key").agg(_runs(F.sort_array(F.collect_set("line"))).alias("runs"))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (`row`: the given row as a struct, `n_lines`, `runs`, `kept_text`), one for each row of `docs`.

    A null text stays null and has one empty line; a text without repeated windows stays as it is, and so do texts of fewer than `width` lines. A text
    all of whose lines are covered becomes empty; its row stays. Rows alike in doc_id and text are one document. Null ids come
    first in the order. An empty table gives no rows. Further columns may have any name.
    """
    runs = repeated_lines(docs, width)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), common.text_key(common.filled("text")).alias("k"))
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left")
    lines = F.split(common.filled("row.text"), "\n", -1)
    kept = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(_kept(lines, F.col("runs")), "\n"))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), "runs", kept.alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """`docs` with repeated lines taken out of `text`; n_chars, where there is such a column, follows the new text."""
    out = dedup_lines(docs, width)
    length = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept_text"), "n_chars": length}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if new.get(c) is not None else F.col("row").getField(c).alias(c)
                        for c in docs.columns])
