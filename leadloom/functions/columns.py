"""Normalised forms of text typed by people: ranks, numbers, money, dates, phones, tech lists."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import empty_to_null, token_pattern, trimmed

# the shape of a date and its format; the shape keeps the parser off texts it would reject
DATE_FORMATS = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
                (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{8}$", "yyyyMMdd"))


def rank_code(c: Column) -> Column:
    """A rank code as it is; else the best-scored rank whose alias occurs; else 'other'; blank is null."""
    text = F.lower(trimmed(c))
    by_score = sorted(fixed.RANK_ALIASES, key=lambda code: -fixed.RANK_SCORE[code])
    found = F.coalesce(*[F.when(text.rlike(token_pattern(fixed.RANK_ALIASES[code], "a-z")), code)
                         for code in by_score], F.lit("other"))
    return F.when(text.isin(*fixed.RANKS), text).when(text.isNotNull(), found)


def biz_number(c: Column) -> Column:
    text = trimmed(c)
    digits = F.regexp_replace(text, r"(?U)\D", "")
    return F.when(F.length(digits) == 10, F.concat_ws(
        "-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 5))).otherwise(text)


def _grouped(digits: Column, head: int, tail: int = 4) -> Column:
    mid = F.length(digits) - head - tail
    return F.concat_ws("-", F.substring(digits, 1, head), F.substring(digits, F.lit(head + 1), mid),
                       F.right(digits, F.lit(tail)))


def lead_phone(c: Column) -> Column:
    """Phone of a lead grouped the Korean way; anything of another length stays as typed."""
    text = trimmed(c)
    raw = F.regexp_replace(text, r"(?U)\D", "")
    d = F.when(raw.startswith("82") & (F.length(raw) >= 10),
               F.concat(F.lit("0"), F.substring(raw, F.lit(3), F.length(raw)))).otherwise(raw)
    n = F.length(d)
    return (F.when(d.startswith("02") & n.isin(9, 10), _grouped(d, 2))
            .when(n.isin(10, 11), _grouped(d, 3)).otherwise(text))


def scan_phone(c: Column) -> Column:
    """Phone found on a page; '' when it is a range of years or no phone length."""
    d = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\d+]", ""), r"^\+?82", "0")
    n = F.length(d)
    return (F.when(F.btrim(c).rlike("(?U)" + fixed.YEAR_RANGE) | (n < 8) | (n > 12), "")
            .when(d.startswith("02") & n.isin(9, 10), _grouped(d, 2))
            .when(d.rlike(r"^1[5-9]\d{2}") & (n == 8), F.concat_ws("-", F.left(d, F.lit(4)), F.right(d, F.lit(4))))
            .when(n.isin(10, 11), _grouped(d, 3)).otherwise(d))


def budget(c: Column) -> Column:
    """Won amount of texts such as '1억 5000만', '2.5억' or '150,000,000'; null without a number."""
    text = F.replace(trimmed(c), F.lit(","), F.lit(""))
    pattern = F.lit(r"(\d+(?:\.\d+)?)\s*(억|만|원)?")
    numbers = F.regexp_extract_all(text, pattern, F.lit(1))
    units = F.regexp_extract_all(text, pattern, F.lit(2))
    factor = lambda u: F.when(u == "억", 1e8).when(u == "만", 1e4).otherwise(1.0)
    parts = F.zip_with(numbers, units, lambda x, u: x.cast("double") * factor(u))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    # plain digits, the common case, need no pattern search
    return F.when(text.rlike(r"^\d{1,15}$"), text.try_cast("bigint")).when(F.size(numbers) > 0, total.try_cast("bigint"))


def digits_number(c: Column) -> Column:
    """All digits of a text as one number ('약 5명' is 5)."""
    return empty_to_null(F.regexp_replace(trimmed(c), r"(?U)\D", "")).try_cast("bigint")


def whole_number(c: Column) -> Column:
    """A number without its fraction; null when the text is not a number."""
    text = F.replace(trimmed(c), F.lit(","), F.lit(""))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def iso_date(c: Column) -> Column:
    text = F.left(trimmed(c), F.lit(10))
    out = F
    for shape, form in DATE_FORMATS:
        out = out.when(text.rlike(shape), F.try_to_date(text, form))
    return out


def year_month(c: Column) -> Column:
    pattern = r"(?U)(20\d{2})\D{0,3}(\d{1,2})"
    text = trimmed(c)
    month = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(month.between(1, 12), F.concat_ws(
        "-", F.regexp_extract(text, pattern, 1), F.lpad(month.cast("string"), 2, "0")))


def months_until(ym: Column, as_of: Column) -> Column:
    return ((F.left(ym, F.lit(4)).cast("int") - F.year(as_of)) * 12
            + F.substring(ym, 6, 2).cast("int") - F.month(as_of))


def tech_list(c: Column) -> Column:
    """JSON list or text split at | ; , / — trimmed, first spelling kept."""
    parsed = F.when(trimmed(c).startswith("["), F.from_json(c, "array<string>"))
    items = F.filter(F.transform(F.coalesce(parsed, F.split(c, "[|;,/]")), trimmed), lambda x: x.isNotNull())
    folded = F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(
        F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.coalesce(folded, F.array().cast("array<string>"))


def format_krw(amount: Column, lang: str = "ko") -> Column:
    """Won the way each language reads it (억 / 만, or tỷ / triệu); '' for nothing or less."""
    unit = fixed.KRW_UNITS
    v = amount.cast("bigint")
    if lang == "vi":
        trim = lambda x: F.regexp_replace(F.translate(F.format_number(x, 1), ",.", ".,"), ",0$", "")
        tenth = lambda by: F.round(v / F.lit(by).cast("decimal(12,0)"), 1)
        out = (F.when(v >= 1_000_000_000, F.concat(trim(tenth(1_000_000_000)), F.lit(f" {unit['billion']} ₩")))
               .when(v >= 1_000_000, F.concat(trim(tenth(1_000_000)), F.lit(f" {unit['million']} ₩")))
               .otherwise(F.concat(F.translate(F.format_number(v, 0), ",", "."), F.lit(" ₩"))))
    else:
        eok = F.when(v % 100_000_000 == 0, (v / 100_000_000).cast("bigint").cast("string")).otherwise(
            F.round(v / F.lit(100_000_000).cast("decimal(12,0)"), 1).cast("decimal(20,1)").cast("string"))
        man = F.round(v / F.lit(10_000).cast("decimal(12,0)"), 0).cast("bigint")
        out = (F.when(v >= 100_000_000, F.concat(F.lit("₩ "), eok, F.lit(unit["eok"])))
               .when(v >= 10_000, F.concat(F.lit("₩ "), F.format_number(man, 0), F.lit(unit["man"])))
               .otherwise(F.concat(F.lit("₩ "), F.format_number(v, 0))))
    return F.when(v > 0, out).otherwise("")
