"""Format-preserving pseudonyms for personal data: Feistel networks keyed per kind of value, in column expressions only."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import let
from leadloom.llm import common

ROUNDS = 8
D2 = r"[0-9]{1,2}"
# IBAN lengths by country
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH ST", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "TL GI IQ IL OM AE SO", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT LY", 26: "IS TR", 27: "FR GR IT MR MC SM BI DJ",
    28: "AL AZ BY CY DO GT HU LB PL NI HN", 29: "BR EG PS QA UA", 30: "JO KW YE", 31: "MT SC", 32: "LC", 33: "RU"}
_iban_form = lambda n, countries: rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
CARD_4X4 = r"[3-6][0-9]{3}(?:[ -][0-9]{4}){3}"
# kind, what its text must hold, what must not stand before, candidate, and patterns of the shorter cuts that are tried in turn (the first that validates is
# taken). Kinds are tried one after the other over the whole text, each at every place where a candidate may start, so that one that
# does not validate hides neither its neighbours nor later kinds; values found are out of sight of later kinds.
KINDS = (
    ("email", "@", r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", ()),
    ("iban", "[A-Z]{2}[0-9]{2}", "(?<![A-Za-z0-9])", "(?:" + "|".join(_iban_form(*c) for c in IBAN_COUNTRIES.items()) + ")(?![A-Za-z0-9])", ()),
    ("iban", "[A-Z]{2}[0-9]{2}", "(?<![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
     tuple(rf"^[A-Z0-9]{{4}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}(?= )" for n in range(7, 1, -1) for tail in ("(?: ?[A-Z0-9]{1,3})", ""))),
    ("date", "[0-9]", "(?<![0-9A-Za-z./-])", rf"(?:[0-9]{{4}}-{D2}-{D2}|[0-9]{{4}}/{D2}/{D2}|{D2}/{D2}/[0-9]{{4}}|{D2}\.{D2}\.[0-9]{{4}}|{D2}-{D2}-[0-9]{{4}})(?![0-9A-Za-z]|[./-][0-9])", ()),
    ("ip", "[0-9]", "(?<![0-9A-Za-z.])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])", ()),
    ("ssn", "[0-9]", "(?<![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])", ()),
    ("card", "[3-6][0-9]{3}", "(?<![0-9A-Za-z])", rf"(?:{CARD_4X4}|[3-6][0-9]{{3}}[ -][0-9]{{6}}[ -][0-9]{{4,5}}|[3-6][0-9]{{12,18}})(?![0-9A-Za-z])", ()),
    ("card", "[3-6][0-9]{3}", "(?<![0-9A-Za-z])", rf"{CARD_4X4}[ -][0-9]{{3}}(?![0-9A-Za-z])", ()),
    ("phone", "[0-9]{4}", "(?<![0-9A-Za-z+])", r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])", ()),
    ("phone", r"\+[0-9]", "", r"\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}(?![0-9])",
     (r"^\+(?:[ .()-]{0,2}[0-9]){7,15}\)?(?=[ .(-])",)),
    # other groupings of a card, each stretch once
    ("card", "[3-6][0-9]", "(?<![0-9A-Za-z])", r"[3-6][0-9](?:[ -]?[0-9]){11,17}(?![0-9A-Za-z]|-[0-9])",
     tuple(rf"^[0-9](?:[ -]?[0-9]){{{n}}}(?=[ -])" for n in range(17, 11, -1))),
)
MARKS = [chr(0xFDD0 + n) for n in range(len(KINDS) + 1)]      # no characters; those that a text has all the same are put aside under the first
GATE = "[0-9@]"
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 269, 271   # 72,899 days, to August 2099: a product of two factors for the two halves


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _noise(key: Column, kind: str, number: Column, half: Column) -> Column:
    """60 keyed bits for a round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), number, half).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: Column, inverse: bool) -> Column:
    """A keyed permutation of Z_a x Z_b, as a struct (l, r): the halves take turns in adding a keyed function of the other one."""
    sign = F.lit(-1 if inverse else 1)

    def turn(s: Column, number: Column) -> Column:
        new_l = F.pmod(s["l"] + sign * F.pmod(_noise(key, kind, number, s["r"]), a), a)
        new_r = F.pmod(s["r"] + sign * F.pmod(_noise(key, kind, number, s["l"]), b), b)
        return F.when(number % 2 == 0, F.struct(new_l.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), new_r.alias("r")))

    order = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _permuted_digits(digits: Column, kind: str, key: Column, inverse: bool) -> Column:
    """A digit string of the same length (up to 36 digits)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    part = lambda s: F.coalesce(F.nullif(s, F.lit("")).cast("long"), F.lit(0))
    made = feistel(part(F.substring(digits, F.lit(1), u)), part(F.substring(digits, u + 1, n)), power(u), power(n - u), kind, key, inverse)
    return let(made, lambda m: F.concat(F.lpad(m["l"].cast("string"), u, "0"), F.lpad(m["r"].cast("string"), n - u, "0")))


def _refilled(match: Column, digits: Column) -> Column:
    """The match with its digits replaced one by one; what stands between them stays."""
    return F.array_join(F.transform(F.split(match, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(match, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits from the right, every second one doubled from the second on."""
    back = F.split(F.reverse(digits), "")
    value = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(back, value), F.lit(0), lambda s, v: s + v)


def _iban_rest(text: Column) -> Column:
    """Remainder by 97 with the first four characters moved to the end and letters as 10..35."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97)
                       .otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _card(m: Column, key: Column, inverse: bool) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key, inverse))
        return let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return let(_digits(m), lambda d: F.when(_luhn_sum(d) % 10 == 0, _refilled(m, new(d))))


def _ssn(m: Column, key: Column, inverse: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    made = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key, inverse)
    shown = lambda s: F.concat(F.lpad((s["l"] + F.when(s["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"),
                               F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, let(made, shown))


def _ip(m: Column, key: Column, inverse: bool) -> Column:
    def new(o: Column) -> Column:
        at = lambda i: o[i].cast("long")
        valid = (at(0) < 256) & (at(1) < 256) & (at(2) < 256) & (at(3) < 256)
        made = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536), "ip", key, inverse)
        return F.when(valid, let(made, lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)))
    return let(F.split(m, r"\."), new)


def _phone(m: Column, key: Column, inverse: bool) -> Column:
    """North American numbers keep area codes and exchanges from 200 on; others keep their first two digits."""
    def new(d: Column) -> Column:
        lead, ten = F.when(F.length(d) == 11, "1").otherwise(""), F.right(d, F.lit(10))
        area, exchange, line = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 3).cast("long"), F.substring(ten, 7, 4).cast("long")
        american = ((F.length(d) == 10) & ~m.startswith("+")) | ((F.length(d) == 11) & d.startswith("1"))
        made = feistel(area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(8_000_000), "phone", key, inverse)
        shown = let(made, lambda s: _refilled(m, F.concat(lead, (s["l"] + 200).cast("string"), (F.floor(s["r"] / 10000) + 200).cast("string"),
                                                          F.lpad((s["r"] % 10000).cast("string"), 4, "0"))))
        other = _refilled(m, F.concat(F.substring(d, 1, 2), _permuted_digits(F.substring(d, F.lit(3), F.length(d)), "phone", key, inverse)))
        return F.when(american, F.when((area >= 200) & (exchange >= 200), shown)).when(F.length(d).between(7, 15), other)
    return let(_digits(m), new)


def _date(m: Column, key: Column, inverse: bool) -> Column:
    """Real days from 1900 to August 2099. Year first, or month/day/year with slashes (day first where only that is a date), else day first."""
    def new(p: Column) -> Column:
        iso, slash = F.length(p[0]) == 4, m.contains("/")
        as_date = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        us = as_date(p[2], p[0], p[1])
        us_form = slash & us.isNotNull()
        day = F.datediff(F.when(iso, as_date(p[0], p[1], p[2])).when(us_form, us).otherwise(as_date(p[2], p[1], p[0])), F.lit(FIRST_DAY).cast("date"))
        made = feistel(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), "date", key, inverse)
        bare = F.when(iso, (F.length(p[1]) == 1) | (F.length(p[2]) == 1)).otherwise((F.length(p[0]) == 1) | (F.length(p[1]) == 1))
        mark = F.when(iso, F.substring(m, 5, 1)).otherwise(F.regexp_extract(m, "[./-]", 0))

        def shown(s: Column) -> Column:
            date = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_B + s["r"]).cast("int"))
            two = lambda n: F.when(bare, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
            y, mo, d = F.lpad(F.year(date).cast("string"), 4, "0"), two(F.month(date)), two(F.day(date))
            return F.when(iso, F.concat(y, mark, mo, mark, d)) \
                .when(us_form, F.concat(mo, mark, d, mark, y)).otherwise(F.concat(d, mark, mo, mark, y))
        return F.when(day.between(0, DAYS_A * DAYS_B - 1), let(made, shown))
    return let(F.split(m, "[./-]"), new)


def _shifted(chars: Column, other: Column, number: Column, kind: str, key: Column, inverse: bool) -> Column:
    """Letters and digits moved on within their class, by a keyed function of the other half."""
    stream = F.sha2(F.concat_ws("|", key, F.lit(kind), number, F.array_join(other, "")).cast("binary"), 256)
    sign = F.lit(-1 if inverse else 1)

    def moved(st: Column) -> Column:
        step = lambda i: sign * F.conv(F.substring(st, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda c, i, first, size: F.chr(F.pmod(F.ascii(c) - first + step(i), F.lit(size)) + first)
        return F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), within(c, i, 48, 10)).when(c.rlike("[a-z]"), within(c, i, 97, 26))
                           .when(c.rlike("[A-Z]"), within(c, i, 65, 26)).otherwise(c))
    return let(stream, moved)


def _permuted_text(text: Column, kind: str, key: Column, inverse: bool) -> Column:
    """Letters stay letters and digits stay digits; the halves take turns as in `feistel`."""
    chars = F.split(text, "")
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.length(text)).alias("r"))

    def turn(s: Column, number: Column) -> Column:
        return F.when(number % 2 == 0, F.struct(_shifted(s["l"], s["r"], number, kind, key, inverse).alias("l"), s["r"].alias("r"))) \
            .otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], s["l"], number, kind, key, inverse).alias("r")))
    order = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return let(F.aggregate(order, start, turn), lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))


def _email(m: Column, key: Column, inverse: bool) -> Column:
    return F.concat(_permuted_text(F.substring_index(m, "@", 1), "email", key, inverse), F.lit("@"), F.substring_index(m, "@", -1))


def _iban(m: Column, key: Column, inverse: bool) -> Column:
    """Country kept, the account part permuted, check digits worked out anew; blanks stay where they are."""
    def new(c: Column) -> Column:
        made = _permuted_text(F.substring(c, F.lit(5), F.length(c)), "iban", key, inverse)
        checked = let(made, lambda b: F.concat(F.substring(c, 1, 2), F.lpad((98 - _iban_rest(F.concat(F.substring(c, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
        place = lambda t: F.array_join(F.transform(F.split(m, ""), lambda x, i: F.when(x == " ", x).otherwise(
            F.substring(t, F.length(F.replace(F.substring(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
        return F.when((_iban_rest(c) == 1) & F.length(c).between(15, 34), let(checked, place))
    return let(F.replace(m, F.lit(" "), F.lit("")), new)


NO_HITS = "array<struct<kind:string,value:string,found:string>>"     # a type, as columns need a session
MAKERS: dict[str, Callable[[Column, Column, bool], Column]] = {
    "email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def _marked(text: Column, n: int, key: Column, inverse: bool) -> Column:
    """Struct (text: with MARKS[n + 1] in the place of each value of KINDS[n] that validates, hits: array of (kind, value, found))."""
    kind, _, before, pattern, cuts = KINDS[n]
    begin = f"{before}(?=({pattern}))"
    once = n == len(KINDS) - 1

    def made(m: Column) -> Column:
        of = lambda c: let(c, lambda found: F.struct(F.lit(kind).alias("kind"), MAKERS[kind](found, key, inverse).alias("value"), found.alias("found")))
        if not cuts:
            return of(m)
        shorter = F.filter(F.array(*[F.regexp_extract(m, cut, 0) for cut in cuts]), lambda c: c != "")
        every = F.transform(F.array_distinct(F.concat(F.array(m), shorter)), of)
        return let(every, lambda e: F.coalesce(F.try_element_at(F.filter(e, lambda h: h["value"].isNotNull()), F.lit(1)), e[0]))

    def step(s: Column, x: Column) -> Column:
        """A piece of the text from a candidate's start on; `skip`: characters of it that belong to a value before."""
        piece, hit = x["piece"], x["hit"]
        size = F.length(piece)
        taken = (s["skip"] == 0) & hit["value"].isNotNull()
        used = F.when(taken, F.length(hit["found"])).when((s["skip"] == 0) & F.lit(once), F.length(hit["found"])).otherwise(s["skip"])
        rest = F.substring(piece, F.when(taken | (s["skip"] > 0), used).otherwise(0) + 1, size)
        return F.struct(F.greatest(used - size, F.lit(0)).alias("skip"),
                        F.when(taken | (s["skip"] == 0), F.array_append(s["out"], F.concat(F.when(taken, F.lit(MARKS[n + 1])).otherwise(""), rest)))
                        .otherwise(F.array_append(s["out"], rest)).alias("out"),
                        F.when(taken, F.array_append(s["hits"], hit)).otherwise(s["hits"]).alias("hits"))

    def placed(found: Column) -> Column:
        pieces = F.split(F.concat(F.lit(" "), text), begin, -1)      # the blank keeps a start at the first place apart
        zipped = lambda p: F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.transform(found, made), lambda a, h: F.struct(a.alias("piece"), h.alias("hit")))
        start = lambda p: F.struct(F.lit(0).alias("skip"), F.array(F.substring(p[0], F.lit(2), F.length(p[0]))).alias("out"), F.array().cast(NO_HITS).alias("hits"))
        done = let(pieces, lambda p: F.aggregate(zipped(p), start(p), step))
        return F.when(F.size(found) > 0, let(done, lambda d: F.struct(F.array_join(d["out"], "").alias("text"), d["hits"].alias("hits")))) \
            .otherwise(F.struct(text.alias("text"), F.array().cast(NO_HITS).alias("hits")))
    return let(F.when(text.rlike(KINDS[n][1]), F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(begin), F.lit(1))).otherwise(F.array().cast("array<string>")), placed)


def _filled(text: Column, mark: str, values: Column) -> Column:
    return F.array_join(F.zip_with(F.split(text, mark, -1), values, lambda piece, v: F.concat(piece, F.coalesce(v, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """Rows (`row`: the given row as a struct, `text`: with pseudonyms, `found`: array of (kind, value, found)).

    E-mail names, IBANs, dates, IPv4 addresses, social security numbers, card and phone numbers that validate (checksum, range,
    calendar) are replaced by a value of the same format that validates too. The mapping is a permutation for each kind and key,
    so equal values stay equal in all documents, different ones stay different, and `inverse` brings them back. (Dates with one-digit
    parts, and day/month dates with slashes, are not always told apart on the way back; nor is a value where a longer or overlapping cut that did not
    validate before does so by chance with the new digits.) Null texts stay null; texts without
    candidates stay as they are. Each row is treated by itself: repeated rows, null ids and an empty table need no rule.
    """
    secret = F.lit(key)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    marks = f"[{MARKS[0]}-{MARKS[-1]}]"

    rows = rows.withColumn("own", F.regexp_extract_all(text, F.lit(marks), F.lit(0)))
    rows = rows.withColumn("now", F.when(text.rlike(GATE), F.when(F.size("own") > 0, F.regexp_replace(text, marks, MARKS[0])).otherwise(text)))
    hits = [f"hits{n}" for n in range(len(KINDS))]
    for n in range(len(KINDS)):         # one generator each: what a kind finds is worked out once
        held = F.explode(F.array(_marked(F.col("now"), n, secret, inverse))).alias("s")
        rows = rows.select("row", "own", *hits[:n], held).select("row", "own", *hits[:n], F.col("s.hits").alias(hits[n]), F.col("s.text").alias("now"))
    new = F.col("now")
    for n in reversed(range(len(KINDS))):
        new = _filled(new, MARKS[n + 1], F.transform(hits[n], lambda h: h["value"]))
    found = F.concat(*hits)
    return rows.select("row", F.when(F.size(found) > 0, _filled(new, MARKS[0], F.col("own"))).otherwise(text).alias("text"), found.alias("found"))
