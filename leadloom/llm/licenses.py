"""Licence scans: ordered signature rules behind a keyword filter, overlaps resolved by priority and containment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common

# Fixed phrases and labels that are always reported.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label, keyword (stands in whatever the name matches), name as a pattern over lower-case words with single blanks
FAMILIES = (
    ("mit", "mit", "mit"), ("mit-0", "mit", "mit (?:0|no attribution)"), ("x11", "x11", "x11"), ("isc", "isc", "isc"),
    ("apache-2", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?v?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?v?1 1"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"), ("bsd", "bsd", "bsd(?: style)?"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: only| or later)?"), ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "general", "gnu general public license(?: version| v)? ?v?2(?: 0)?"), ("gpl-3", "general", "gnu general public license(?: version| v)? ?v?3(?: 0)?"),
    ("gpl", "general", "gnu general public license"), ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license(?: version| v)? ?v?2(?: 1)?"), ("lgpl-3", "lesser", "gnu lesser general public license(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?:(?: version| v)? ?v?[23](?: [01])?)?"), ("agpl-3", "affero", "gnu affero general public license(?:(?: version| v)? ?v?3(?: 0)?)?"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?:(?: version| v)? ?v?3(?: 0)?)?"), ("gfdl", "documentation", "gnu free documentation license(?:(?: version| v)? ?v?1 [123])?"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?v?2(?: 0)?"), ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? ?v?1 1"),
    ("mpl", "mpl", "mpl(?:(?: version| v)? ?v?[12](?: [01])?)?"), ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?v?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?v?2(?: 0)?"), ("cddl", "distribution", "common development and distribution license(?:(?: version| v)? ?v?1 [01])?"),
    ("cddl", "cddl", "cddl(?:(?: version| v)? ?v?1 [01])?"), ("cpl-1", "common", "common public license(?:(?: version| v)? ?v?1(?: 0)?)?"), ("ipl-1", "ibm", "ibm public license"),
    ("zlib", "zlib", "zlib(?: libpng)?"), ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("beerware", "beerware", "beerware"),
    ("artistic-2", "artistic", "artistic license(?: version| v)? ?v?2(?: 0)?"), ("artistic-1", "artistic", "artistic license(?: version| v)? ?v?1(?: 0)?"),
    ("boost-1", "boost", "boost software license(?:(?: version| v)? ?v?1(?: 0)?)?"), ("ofl-1.1", "sil", "sil open font license(?:(?: version| v)? ?v?1 1)?"),
    ("eupl", "eupl", "eupl(?:(?: version| v)? ?v?1 [012])?"), ("eupl", "european", "european union public licen[cs]e(?:(?: version| v)? ?v?1 [012])?"),
    ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "microsoft", "microsoft reciprocal license"), ("psf-2", "python", "python software foundation license(?:(?: version| v)? ?v?2)?"),
    ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"), ("php-3", "php", "php(?: version| v)? ?v?3(?: 0?1?)?"), ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"), ("w3c", "w3c", "w3c(?: software)?(?: notice)?"), ("curl", "curl", "curl"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("afl-3", "academic", "academic free license(?:(?: version| v)? ?v?3(?: 0)?)?"), ("osl-3", "open", "open software license(?:(?: version| v)? ?v?3(?: 0)?)?"),
    ("qpl-1", "qpl", "qpl(?:(?: version| v)? ?v?1 0)?"), ("qpl-1", "public", "q public license(?:(?: version| v)? ?v?1 0)?"), ("sleepycat", "sleepycat", "sleepycat"), ("zpl-2", "zope", "zope public license(?:(?: version| v)? ?v?2 [01])?"),
    ("busl-1.1", "business", "business source license(?:(?: version| v)? ?v?1 1)?"), ("sspl-1", "server", "server side public license(?:(?: version| v)? ?v?1)?"),
    ("odbl", "database", "open database license"), ("pddl", "dedication", "public domain dedication and license"), ("json", "json", "json"),
    ("cc0", "cc0", "cc0(?:(?: version| v)? ?v?1 0)?(?: universal)?"), ("cc-by", "cc", "cc by(?:(?: version| v)? ?v?[1234] [05])?"), ("cc-by-sa", "cc", "cc by sa(?:(?: version| v)? ?v?[1234] [05])?"),
    ("cc-by-nd", "cc", "cc by nd(?:(?: version| v)? ?v?[1234] [05])?"), ("cc-by-nc", "cc", "cc by nc(?:(?: version| v)? ?v?[1234] [05])?"), ("cc-by-nc-sa", "cc", "cc by nc sa(?:(?: version| v)? ?v?[1234] [05])?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?:(?: version| v)? ?v?[1234] [05])?"), ("cc-by", "commons", "creative commons attribution(?:(?: version| v)? ?v?[1234] 0)?"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?:(?: version| v)? ?v?[1234] 0)?"), ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?:(?: version| v)? ?v?[1234] 0)?"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?(?:(?: version| v)? ?v?[1234] 0)?"),
)
# pattern around a name, priority, confidence: a longer or more explicit statement wins
TEMPLATES = (
    ("spdx license identifier {}", 4, 1.0),
    ("(?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 3, 0.95),
    ("(?:licensed|released|distributed|published|available|provided|covered) under (?:a|an) {}(?: licen[cs]e)?", 3, 0.9),
    ("subject to the (?:terms of )?(?:the )?{}(?: licen[cs]e)?", 3, 0.9),
    ("{} licen[cs]e", 2, 0.8),
    ("licen[cs]e (?:is )?{}", 2, 0.7),
)
# statements without a family
OTHERS = (
    ("public-domain", "domain", "(?:in|into|to) the public domain", 2, 0.8), ("public-domain", "domain", "public domain", 1, 0.5),
    ("proprietary", "reserved", "all rights reserved", 1, 0.5), ("proprietary", "confidential", "proprietary and confidential", 2, 0.7),
)
# a document without any of these and without a statement "… under" or a word "cc" has no signature: one of them stands in every match of a rule above
GATE = ("licen", "spdx", "public", "reserved", "confidential", "subject", "commons", "apache")
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"    # between words of a lower-case text
UNDER = rf"(?:released|distributed|published|available|provided|covered){BREAK}+under{BREAK}"


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(label, keyword, pattern, priority, confidence, base) of every rule: the base phrases, then names in templates, then the others."""
    out = [(label, phrase.split()[-2] if label != "cc-by-nc" else "cc", phrase, 3, 0.95, True) for phrase, label in BASE_PHRASES]
    out += [(label, keyword, template.format(name), priority, sure, False) for label, keyword, name in FAMILIES for template, priority, sure in TEMPLATES]
    out += [(label, keyword, name, 1, 0.6, False) for label, keyword, name in FAMILIES if "licen" in name or keyword in ("cc", "commons")]  # titles by themselves
    return out + [(label, keyword, pattern, priority, sure, False) for label, keyword, pattern, priority, sure in OTHERS]


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"),
                              F.lit(f" {pattern}(?= )").alias("pattern"), F.lit(priority).alias("priority"),
                              F.lit(sure).alias("sure"), F.lit(base).alias("base"))
                     for n, (label, keyword, pattern, priority, sure, base) in enumerate(rules())])


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(docs: DataFrame) -> DataFrame:
    """One row per document and match of a rule (one with null rule where nothing matched): row_id, doc_id, n_words, label, priority, sure,
    base, start_word, start, stop (characters of the normalised words), suppressed.

    Texts that pass the gate are turned into lower-case words with single blanks; a rule is tried only where its keyword stands. A
    match is suppressed if another one that is not of lower priority contains it (of equal ones the first label stays).
    """
    text = common.filled("text")
    low = F.lower(text)
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(low, F.lit(word))
    gate = gate | (F.contains(low, F.lit("cc")) & low.rlike(rf"(?:^|{BREAK})cc(?:$|{BREAK})"))
    gate = gate | (F.contains(low, F.lit("under")) & low.rlike(UNDER))
    norm = F.concat(F.lit(" "), F.array_join(common.words_of(common.lowered(text), common.PLAIN_WORD), " "), F.lit(" "))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id",
                       F.regexp_count(text, F.lit(common.PLAIN_WORD_ANY_CASE)).cast("long").alias("n_words"),
                       F.when(gate, norm).alias("norm"))
    tried = rows.select("row_id", "doc_id", "n_words", "norm", F.explode_outer(
        F.filter(_rule_table(), lambda r: F.contains(F.col("norm"), r["keyword"]))).alias("r"))
    found = F.regexp_extract_all("norm", F.col("r.pattern"), F.lit(0))
    between = F.slice(F.split("norm", F.col("r.pattern"), -1), F.lit(1), F.size(found))
    zipped = F.when(F.col("r").isNotNull(), F.arrays_zip(
        F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(between, _spaces).alias("gap_words"),
        F.transform(found, lambda x: F.length(x)).alias("span"), F.transform(found, _spaces).alias("span_words")))
    flat = tried.select("row_id", "doc_id", "n_words", "r", F.posexplode_outer(zipped).alias("nth", "m"))
    flat = flat.select("row_id", "doc_id", "n_words", "r.rule", "r.label", "r.priority", "r.sure", "r.base", "nth", "m.*")
    by_rule = Window.partitionBy("row_id", "rule").orderBy("nth")
    placed = flat.repartition("row_id").withColumn("stop", F.sum(F.col("gap") + F.col("span")).over(by_rule)) \
        .withColumn("start", F.col("stop") - F.col("span")) \
        .withColumn("start_word", F.sum(F.col("gap_words") + F.col("span_words")).over(by_rule) - F.col("span_words"))
    earlier = Window.partitionBy("row_id").orderBy("start", F.desc("stop"), F.desc("priority"), "label", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for level in (4, 3, 2, 1):
        reach = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(earlier)).otherwise(reach)
    return placed.withColumn("reach", reach).withColumn("suppressed", F.coalesce(F.col("reach") >= F.col("stop"), F.lit(False))) \
        .select("row_id", "doc_id", "n_words", "label", "priority", "sure", "base", F.when(F.col("span").isNotNull(), F.col("start_word")).alias("start_word"),
                "start", "stop", "suppressed", F.col("span").isNotNull().alias("found"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count wherever they stand; labels are theirs and those of the matches that nothing suppresses, sorted and
    comma-joined ('' if there are none). score is the confidence of the surest of them, else 0. Null and empty texts have no
    words; rows that repeat are scanned each for itself; an empty table gives no rows; further columns are not read.
    """
    rows = detections(docs)
    base = F.col("found") & F.coalesce("base", F.lit(False))
    counted = F.col("found") & (F.coalesce("base", F.lit(False)) | ~F.col("suppressed"))
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    return rows.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start_word"))).alias("first_word"), F.max(F.when(base, F.col("start_word"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(counted).alias("labels"),
        F.coalesce(F.max(F.when(counted, F.col("sure"))), F.lit(0.0)).alias("score")).drop("row_id")
