"""Benchmark decontamination: a prefix-filtered join of document shingles with item windows, verified word by word."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common


def _hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each position on; empty if there are fewer."""
    n = F.size(words)
    made = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.lit(k), *[F.element_at(words, i + j) for j in range(k)]))
    return F.when(n >= k, made).otherwise(F.array().cast("array<bigint>"))


def _wid(words: Column) -> Column:
    return F.array_join(words, " ")         # words hold no blank


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct windows of all items: wid (the words with blanks between), words, size, k (words of its shingles), shingles."""
    words = benchmark.select(common.words_of(common.lowered(common.filled("text")), common.PLAIN_WORD).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    cut = words.select("ws", F.explode(starts).alias("at")).select(F.slice("ws", F.col("at"), window).alias("words")).distinct()
    size = F.size("words")
    shingles = F.when(size >= shingle, _hashes(F.col("words"), shingle))
    for k in range(1, shingle):
        shingles = F.when(size == k, _hashes(F.col("words"), k)).otherwise(shingles)
    return cut.select(_wid(F.col("words")).alias("wid"), "words", size.alias("size"), F.least(size, F.lit(shingle)).alias("k"), shingles.alias("shingles"))


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row per occurrence of an item window in a document: row_id of `docs`, start (word, from 0), size, wid, words.

    1. The shingles of all windows (few words in a row) are looked up in all documents; what stands around a hit is kept with it.
    2. Their frequencies in the documents order the shingles of a window by rarity. A window needs all its shingles, so the
       prefix that has to be shared is the rarest one; only hits of prefix shingles meet windows.
    3. Length and position: the window must fit into the document around the shingle. 4. All its words are compared.
    Spark broadcasts the windows' shingles and prefixes, which are written tables, if they are below its threshold, and shuffles otherwise.
    """
    windows = common.staged(item_windows(benchmark, window, shingle), "item-windows")
    wanted = common.staged(windows.select("k", F.explode("shingles").alias("h")).distinct(), "shingles")
    sizes = [r.k for r in windows.select("k").distinct().collect()]     # at most `shingle` numbers
    words = docs.select("row_id", "ws")
    seen = None
    for k in sorted(sizes):
        # the outer form: for the inner one the words would be cut out anew in a filter
        at = words.select("row_id", "ws", F.posexplode_outer("ws").alias("pos", "word")).filter(F.col("pos") <= F.size("ws") - k)
        part = at.select("row_id", "ws", "pos", F.xxhash64(F.lit(k), *[F.get("ws", F.col("pos") + j) for j in range(k)]).alias("h")) \
            .join(wanted.filter(F.col("k") == k).select("h"), "h")
        around = F.slice("ws", F.greatest(F.col("pos") - window, F.lit(0)) + 1, F.lit(3 * window))
        part = part.select("row_id", "h", "pos", F.size("ws").alias("n"), F.greatest(F.col("pos") - window, F.lit(0)).alias("from"), around.alias("around"))
        seen = part if seen is None else seen.unionByName(part)
    if seen is None:
        return words.select("row_id", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("wid"), "ws").limit(0).withColumnRenamed("ws", "words")
    seen = common.staged(seen, "shingle-hits")
    frequency = seen.groupBy("h").agg(F.count("*").alias("df"))
    ordered = windows.select("wid", "words", "size", F.posexplode("shingles").alias("offset", "h")).join(frequency, "h")
    prefix = ordered.groupBy("wid").agg(F.first("words").alias("words"), F.first("size").alias("size"), F.count_distinct("h").alias("found"),
                                        F.min(F.struct("df", "h", "offset")).alias("rare"), F.count("*").alias("have")) \
        .filter(F.col("have") >= F.col("size") - F.least("size", F.lit(shingle)) + 1)      # a window whose shingles are not all seen cannot occur
    prefix = common.staged(prefix.select("wid", "words", "size", F.col("rare.h").alias("h"), F.col("rare.offset").alias("offset")), "prefixes")
    start = F.col("pos") - F.col("offset")
    met = seen.join(prefix, "h").filter((start >= 0) & (start + F.col("size") <= F.col("n"))) \
        .filter(F.slice("around", start - F.col("from") + 1, F.col("size")) == F.col("words"))
    return met.select("row_id", start.alias("start"), "size", "wid", "words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated, key (hash of the text).

    Words are runs of letters and digits in lower case (A-Z). A window is `window` consecutive words of an item, or a whole shorter
    item; document words inside any occurrence of a window are hit. Null and empty texts have no words; items without
    words have no window; item ids of null are left out of the list. Rows alike in doc_id and text are one document and get one row
    each. Empty tables give no hits or no rows; further columns are not read.
    """
    text = common.filled("text")
    words = common.words_of(common.lowered(text), common.PLAIN_WORD)
    rows = docs.select("doc_id", common.text_key(text).alias("key"), words.alias("ws"))
    hits = window_hits(rows.select(F.struct("doc_id", "key").alias("row_id"), "ws"), benchmark, window, shingle)
    hits = common.staged(hits.select("row_id.doc_id", "row_id.key", "start", "size", "wid").distinct(), "hits")
    # covered words: each occurrence adds what reaches beyond all before it
    before = Window.partitionBy("doc_id", "key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = hits.withColumn("reach", F.coalesce(F.max(end).over(before), F.lit(0))) \
        .withColumn("new", F.greatest(end - F.greatest("start", "reach"), F.lit(0))) \
        .groupBy("doc_id", "key").agg(F.sum("new").cast("long").alias("n_hit"))
    item_words = benchmark.select(F.col("item_id").cast("string").alias("item"), common.words_of(common.lowered(common.filled("text")), common.PLAIN_WORD).alias("iw")).filter(F.size("iw") > 0)
    owners = item_words.select("item", "iw", F.explode(F.sequence(F.lit(1), F.greatest(F.size("iw") - (window - 1), F.lit(1)))).alias("at")) \
        .select("item", _wid(F.slice("iw", F.col("at"), window)).alias("wid")).distinct()
    owners = common.staged(owners, "owners")
    items = hits.select("doc_id", "key", "wid").distinct().join(owners, "wid").select("doc_id", "key", "item").distinct() \
        .groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("item")).alias("items"), F.count("*").alias("n_items"))
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col("d.key") == F.col(f"{other}.key"))
    counted = docs.select("doc_id", common.text_key(text).alias("key"), F.regexp_count(text, F.lit(common.PLAIN_WORD_ANY_CASE)).cast("long").alias("n_words"))
    joined = counted.alias("d").join(covered.alias("c"), same("c"), "left").join(items.alias("i"), same("i"), "left")
    n_hit = F.coalesce("c.n_hit", F.lit(0).cast("long"))
    return joined.select("d.doc_id", "d.key", "d.n_words", n_hit.alias("n_hit"), F.coalesce("i.n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.coalesce("i.items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` without the documents that hold an item window; all columns as they are, whatever their names."""
    bad = decontaminate(docs, benchmark, **how).filter("contaminated").select("doc_id", "key").distinct()
    bad = common.staged(bad, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), common.text_key(common.filled("text")).alias("k"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left_anti").select("row.*")
