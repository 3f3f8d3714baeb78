"""The corpus operators as registered queries over the whole tables, and their SQL twins for DuckDB."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import alignment, chat, common, decontaminate, exact, hmm, lexical, licenses, lines, mixing, ngram_join, pii, suffix_dedup, toxicity

TOKENIZER_FILES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PSEUDONYM_TEST_KEY = "change-me"        # for the query on test tables only: whoever knows the key can reverse the pseudonyms


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_found (values replaced), kinds (sorted, comma-joined), text (with pseudonyms)."""
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_TEST_KEY)
    return out.select("row.doc_id", F.size("found").cast("long").alias("n_found"),
                      F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda h: h["kind"]))), ",").alias("kinds"), "text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), smallest=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the labels of documents that are not held out; scores every document."""
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(F.col("doc_id"), 5) == 0
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.train(docs.join(labels, "doc_id"))
    out = toxicity.toxicity(docs, model).select("row.doc_id", "score", "predicted", "n_sentences", F.size("spans").alias("n_toxic_sentences"))
    return out.select("doc_id", (_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_sentences", "n_toxic_sentences")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), words=4, similarity=(85, 100)).select("doc_id", "n_shingles", "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (runs of removed lines), kept_sha256 (of the remaining text)."""
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(F.coalesce("runs", F.array()), F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"] + 1))
    return out.select("row.doc_id", "n_lines", removed.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"),
                      F.sha2(common.filled("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(F.col("doc_id"), 7) == 2
    model, words = hmm.train(docs.filter(~held_out).select(common.filled("text").alias("text")))
    out = hmm.score(docs, model, words)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(_table(spark, sf_dir, "documents")).drop("copies")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, files: tuple[str, str] = TOKENIZER_FILES) -> DataFrame:
    """The digest of the groups is taken before the rows are written, so that their text travels no further than its task."""
    tokens = alignment.read_files(*files)
    rows = alignment.token_groups(_table(spark, sf_dir, "documents"), tokens)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = common.staged(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return alignment.with_scores(rows, tokens)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    return chat.chat_digests(chat.format_chats(chat.table_log(table.unionByName(more))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_hmm_scores": op7_hmm_scores,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_license_scan": op10_license_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_chat_format": op12_chat_format,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, list_slice(ws, st, st + least(len(ws), 10) - 1) AS win
              FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS st FROM b WHERE len(ws) > 0)),
        s AS (SELECT doc_id, k, st, list_slice(ws, st, st + k - 1) AS win
              FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS st FROM w, (SELECT DISTINCT k FROM i))),
        h AS (SELECT s.doc_id, s.st, s.k, i.item_id FROM s JOIN i ON s.k = i.k AND s.win = i.win),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(st, st + k - 1)) AS p FROM h) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items,
               sha256(coalesce(g.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
              FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS i FROM d)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w
              WHERE NOT regexp_full_match(win, '[ \t\r\n\v\f]*')),
        c AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
        l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM d),
        m AS (SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone,
                     c.pos IS NOT NULL AND lag(c.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) IS NULL AS starts
              FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * n AS cap FROM s),
        l AS (SELECT *, row_number() OVER o AS place, cap / weight AS ratio,
                     (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
              FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
        r AS (SELECT source, n, CASE WHEN level >= ratio THEN cap
                     ELSE weight * (SELECT min_by(level, place) FROM l WHERE level < ratio) END AS target FROM l),
        q AS (SELECT d.doc_id, d.size, r.n AS source_size, r.target, CASE WHEN r.n > 0 THEN r.target / r.n ELSE 0.0::DOUBLE END AS rate,
                     ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || d.size::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS drawn
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM q""",
    "op12_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        f AS (SELECT *, '### ' || role || ':' || chr(10) || regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') || chr(10) || '</turn>' || chr(10) AS formatted FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(formatted))::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        t AS (SELECT row, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
        f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
        s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS nd, sum(len(ws))::BIGINT AS nt FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
        r AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
              FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, row, doc_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10""",
}
