"""Text columns. Patterns use `(?U)` so that \\s, \\d, \\b and case folding cover all of Unicode."""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """`body(x)` with x bound to a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns added behind a generator, so that later filters and columns refer to their values and
    the optimizer does not copy their expressions."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, held).select(*kept, *[F.col(f"_held.{n}").alias(n) for n in columns])


EDGE_CHARS = " \t\r\n·|/-–—:：,"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(c: Column, chars: int | None) -> Column:
    """The first `chars` characters; the whole text for None."""
    return F.left(c, F.lit(chars)) if chars else c


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def non_empty(c: Column) -> Column:
    """`empty_to_null` of a costly value, which is computed once; nullif computes it to compare and again to return it."""
    return F.try_element_at(F.filter(F.array(c), lambda v: v != ""), F.lit(1))


WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def stripped(c: Column | str) -> Column:
    """Without white space at both ends. Spark trims a list of characters one by one, so texts with a visible ASCII character at both ends go by as they are."""
    text = col(c)
    clean = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def trimmed(c: Column | str) -> Column:
    """Stripped text; blank becomes null."""
    return empty_to_null(stripped(c))


def titled(c: Column | str) -> Column:
    """`initcap`, without its search for word breaks in texts of one word of ASCII letters."""
    text = col(c)
    word = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))
    return F.when(text.rlike("^[A-Za-z]+$"), word).otherwise(F.initcap(text))


def tidy(c: Column | str) -> Column:
    """White space (non-breaking included) collapsed to one blank, separators cut off both ends."""
    flat = F.regexp_replace(F.translate(col(c), " ", " "), r"(?U)\s+", " ")
    return F.btrim(flat, F.lit(EDGE_CHARS))


def escape(token: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}&#~/-])", r"\\\1", token)


def any_of(tokens: Iterable[str]) -> str:
    """Alternation of literal tokens."""
    return "(?:" + "|".join(escape(t) for t in tokens) + ")"


def token_pattern(tokens: Sequence[str], boundary: str = "a-z0-9") -> str:
    """One pattern for a token list: ASCII tokens match as whole words, others as substrings."""
    ascii_tokens = [t for t in tokens if t.isascii()]
    other = [t for t in tokens if not t.isascii()]
    parts = []
    if ascii_tokens:
        parts.append(rf"(?<![{boundary}]){any_of(ascii_tokens)}(?![{boundary}])")
    if other:
        parts.append(any_of(other))
    return "|".join(parts) if parts else r"(?!)"


def has_token(c: Column, tokens: Sequence[str], boundary: str = "a-z0-9") -> Column:
    return c.rlike(token_pattern(tokens, boundary))


def first_token(c: Column, tokens: Sequence[str | tuple[str, str]], boundary: str = "a-z0-9") -> Column:
    """The first token of the list that occurs (list order, not text order), else null.

    A pair `(token, label)` yields the label."""
    pairs = [(t, t) if isinstance(t, str) else t for t in tokens]
    hits = [F.when(c.rlike(token_pattern((t,), boundary)), F.lit(label)) for t, label in pairs]
    guard = has_token(c, [t for t, _ in pairs], boundary)
    return F.when(guard, F.coalesce(*hits))


def count_tokens(c: Column, tokens: Sequence[str], boundary: str = "a-z0-9") -> Column:
    total = F.lit(0)
    for t in tokens:
        total = total + c.rlike(token_pattern((t,), boundary)).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("int")).when(has_token(c, tokens, boundary), total).otherwise(0)


def contains_any(c: Column, tokens: Iterable[str]) -> Column:
    return c.rlike(any_of(tokens))


def names_any(c: Column, tokens: Iterable[str]) -> Column:
    """Whether a text holds one of the tokens in any case.

    A token that holds another one tells nothing more. Tokens without letters that have a case (Hangul) are sought as they are, which is cheaper.
    """
    tokens = list(tokens)
    few = [t for i, t in enumerate(tokens) if not any(o.lower() in t.lower() and (o.lower() != t.lower() or k < i) for k, o in enumerate(tokens) if k != i)]
    cased = [t for t in few if t.lower() != t.upper()]
    plain = [t for t in few if t not in cased]
    hits = [c.contains(plain[0])] if len(plain) == 1 else [c.rlike(any_of(plain))] if plain else []
    return reduce(lambda a, b: a | b, hits + ([c.rlike(f"(?iU){any_of(cased)}")] if cased else []))


ODD_CASE = "\u0131\u017f\u0307"      # what is left in lower case of the letters beyond ASCII that match i and s in any case


def may_name(c: Column, tokens: Iterable[str]) -> Column:
    """False only for texts in which no token stands, in any case and with any white space between its words: a test of a whole page before its lines are tried."""
    def held(low: Column) -> Column:
        words = [[low.contains(w) for w in t.lower().split()] for t in tokens]
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, ws) for ws in words] + [low.contains(x) for x in ODD_CASE])
    return let(F.lower(c), held)


def label_value(c: Column, labels: Sequence[str], max_len: int | None = None, separators: str = ":：") -> Column:
    """Value of `label : value`; the first label with a non-empty value wins, else null."""
    tail = rf"\s*[{separators}]\s*([^\n|·•]{{2,{max_len or ''}}})"
    values = [non_empty(tidy(F.regexp_extract(c, f"(?iU){escape(label)}{tail}", 1))) for label in labels]
    return F.when(names_any(c, labels) & c.rlike(rf"(?iU){any_of(labels)}\s*[{separators}]"), F.coalesce(*values))


def one_of(c: Column, allowed: Sequence[str], default: str | None = None) -> Column:
    lowered = F.lower(trimmed(c))
    return F.coalesce(F.when(lowered.isin(*allowed), lowered), F.lit(default))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def value_map(c: Column, mapping: dict) -> Column:
    """Look a column up in a small literal mapping; null where the key is missing."""
    items = ", ".join(sql_literal(x) for pair in mapping.items() for x in pair)
    return F.try_element_at(F.expr(f"map({items})"), c)


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"),
            ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
            ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&trade;", "™"),
            ("&#160;", " "), ("&amp;", "&"))


def unescape_html(c: Column) -> Column:
    """Named entities of the list above and decimal or hex character references. Texts without an ampersand go by as they are."""
    return let(c, lambda text: F.when(text.contains("&"), _unescaped(text)).otherwise(text))


def _unescaped(c: Column) -> Column:
    out = c
    for name, char in ENTITIES[:-1]:
        out = F.replace(out, F.lit(name), F.lit(char))
    pattern = r"&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"
    code = lambda r: F.when(r.rlike("^&#[xX]"), F.conv(F.regexp_extract(r, "[xX]([0-9a-fA-F]+)", 1), 16, 10)) \
        .otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    char = lambda r: let(code(r), lambda n: F.when(
        valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).when(n.isNotNull(), "\ufffd"))

    def numeric(text: Column) -> Column:
        """Split around the references and put their characters in between."""
        refs = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), char)
        pieces = F.split(text, pattern, -1)
        return F.array_join(F.zip_with(pieces, refs, lambda piece, c: F.concat(piece, F.coalesce(c, F.lit("")))), "")

    out = let(out, lambda text: F.when(text.contains("&#"), numeric(text)).otherwise(text))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))
