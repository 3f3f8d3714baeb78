"""Element nesting as tables: a tag is a row, running depths match start and end tags, containment is an interval question.

Every element of a page is an interval of the page's parts (a tag and the text after it). Rules for tags that do not pair up:
an end tag without an open element is ignored; list entries, table rows and cells end at the next tag of their kind in the same list or
table, at the latest with that list or table; a link ends at the next link tag; any other element without an end tag reaches to the end of the page.
Void elements hold nothing and are no elements here.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import VOID
from ..functions.text import computed

# what a tag is counted with: scopes with the elements that they bound, every other name for itself
FAMILIES = {"ul": "list", "ol": "list", "menu": "list", "li": "list", "table": "table", "tr": "table", "td": "table", "th": "table"}
ITEMS = ("li", "tr", "td", "th", "a")       # elements whose end tag may be missing


def tag_pattern(names: Sequence[str]) -> str:
    return rf"(?is)</?(?:{'|'.join(names)})(?=[\s/>])[^>]*>"


def parts(html: Column, names: Sequence[str]) -> Column:
    """The page cut before each tag of `names`: part 0 is what stands before the first, part i begins with tag i."""
    tags = F.regexp_extract_all(html, F.lit(tag_pattern(names)), F.lit(0))
    return F.zip_with(F.concat(F.array(F.lit("")), tags), F.split(html, tag_pattern(names), -1), lambda t, p: F.concat(t, p))


def _told(n: Column, values: Sequence) -> Column:
    """values[n]: a short list looked up by number."""
    return F.get(F.array(*[F.lit(v) for v in values]), n)


def spans(pages: DataFrame, key: Sequence[str], html: Column, names: Sequence[str]) -> DataFrame:
    """One row per element of `names`: key, name, open, end, on_page. It consists of the parts open to end - 1; bit i of on_page says that a tag names[i] is on its page.

    Within a family of tags start tags count 1 and end tags -1; the running sum less its running minimum is the depth, so that stray end tags
    change nothing. An end tag belongs to the start tag before it on its level; an item to the scope that is open on its level. The rows
    of a page are sorted a few times and never paired; they hold numbers for names and families, and the last column of the key, the number
    of a page, comes first in sorts. Null and empty pages have no elements.
    """
    assert not set(names) & set(VOID.split("|")) and len(names) < 32
    families = sorted({FAMILIES.get(n, n) for n in names})
    by = tuple(reversed(key))
    tags = F.regexp_extract_all(html, F.lit(tag_pattern(names)), F.lit(0))
    number = lambda t: F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(F.regexp_extract(t, r"(?i)^</?([a-z0-9]+)", 1))).cast("int") - 1
    split = F.transform(tags, lambda t: F.struct(number(t).alias("name"), t.startswith("</").alias("close")))
    named = computed(pages.select(*key, split.alias("_t")), _t=F.col("_t"))
    on_page = F.aggregate("_t", F.lit(0), lambda bits, t: bits.bitwiseOR(_told(t["name"], [1 << i for i in range(len(names))])))
    rows = named.select(*key, on_page.alias("on_page"), F.size("_t").alias("n"), F.posexplode("_t").alias("pos", "t")).select(
        *key, "on_page", (F.col("n") + 1).alias("last"), (F.col("pos") + 1).alias("pos"), "t.name", "t.close").repartition(*key)
    item = _told(F.col("name"), [n in ITEMS for n in names])
    step = F.when(item, 0).when(F.col("close"), -1).otherwise(1)
    rows = rows.withColumn("family", _told(F.col("name"), [families.index(FAMILIES.get(n, n)) for n in names])).withColumn("item", item).withColumn("step", step)

    within = Window.partitionBy(*by, "family").orderBy("pos")
    rows = rows.withColumn("sum", F.sum("step").over(within))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(within), F.lit(0)))
    rows = rows.withColumn("before", F.lag("depth", 1, 0).over(within))
    rows = rows.filter(F.col("item") | ~F.col("close") | (F.col("before") > 0))
    rows = rows.withColumn("level", F.when(~F.col("item") & F.col("close"), F.col("before")).otherwise(F.col("depth")))

    on_level = Window.partitionBy(*by, "family", "level").orderBy("pos")
    after = on_level.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("scope", F.last(F.when(~F.col("item") & ~F.col("close"), F.col("pos")), ignorenulls=True).over(on_level))
    rows = rows.withColumn("closed", F.first(F.when(~F.col("item"), F.col("pos")), ignorenulls=True).over(after))

    in_scope = Window.partitionBy(*by, "family", "level", "scope").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    row = _told(F.col("name"), [n == "tr" for n in names])
    ends_row, ends_cell = F.col("item") & row, F.col("item")
    next_row = F.first(F.when(ends_row, F.col("pos")), ignorenulls=True).over(in_scope)
    next_item = F.first(F.when(ends_cell, F.col("pos")), ignorenulls=True).over(in_scope)
    rows = rows.withColumn("next", F.when(row, next_row).otherwise(next_item))
    end = F.least(F.coalesce("closed", "last"), F.when(F.col("item"), F.coalesce("next", "last")).otherwise(F.col("last")))
    return rows.filter(~F.col("close")).select(*key, _told(F.col("name"), names).alias("name"), F.col("pos").alias("open"), end.alias("end"), "on_page")


def nearest(elements: DataFrame, key: Sequence[str], around: Sequence[str], of: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """`elements` (rows of `spans`) with box_open and box_end: the innermost other element named in `around` that holds their start, null if none.

    Elements of one family lie beside or inside each other, so that the last one opened on a point's level holds it; of the families'
    answers the one that starts last is taken, which also settles elements that overlap. The rows stay dealt by page throughout. Only elements
    named in `of` (all without it) are asked for; with the `names` given to `spans`, only of families that have a box on their page.
    """
    families = sorted({FAMILIES.get(n, n) for n in around})
    by = tuple(reversed(key))
    number = F.lit(None).cast("int")
    for name in around:
        number = F.when(F.col("name") == name, families.index(FAMILIES.get(name, name))).otherwise(number)
    # of one place: ends first, then the questions, then starts; an inner element ends before an outer one
    event = lambda family, at, turn, tie, step: F.struct(family.alias("family"), at.alias("at"), F.lit(turn).alias("turn"), tie.alias("tie"), F.lit(step).alias("step"))
    box, asks = F.col("_box").isNotNull(), F.col("name").isin(*of) if of else F.lit(True)

    def asked_of(f: int) -> Column:
        if not names:
            return asks
        bits = lambda kinds: F.col("on_page").bitwiseAND(sum(1 << i for i, n in enumerate(names) if n in kinds)) != 0
        mine = bits([n for n in around if families.index(FAMILIES.get(n, n)) == f])
        return asks & (mine | ~bits(around)) if f == 0 else asks & mine          # without any box one answer is left, that there is none
    events = F.array(F.when(box, event(F.col("_box"), F.col("open"), 2, F.lit(0), 1)), F.when(box, event(F.col("_box"), F.col("end"), 0, -F.col("open"), -1)),
                     *[F.when(asked_of(f), event(F.lit(f), F.col("open"), 1, F.lit(0), 0)) for f in range(len(families))])
    rows = elements.withColumn("_box", number).select(*key, "name", "open", "end", F.explode(F.array_compact(events)).alias("e")).select(*key, "name", "open", "end", "e.*")
    order = ("at", "turn", "tie")
    rows = rows.withColumn("depth", F.sum("step").over(Window.partitionBy(*by, "family").orderBy(*order)))
    rows = rows.withColumn("level", F.when(F.col("step") < 0, F.col("depth") + 1).otherwise(F.col("depth")))
    # start and end of a box in one number, in order of the starts
    opened = F.when(F.col("step") > 0, F.shiftleft(F.col("open").cast("long"), 32) + F.col("end"))
    rows = rows.withColumn("box", F.last(opened, ignorenulls=True).over(Window.partitionBy(*by, "family", "level").orderBy(*order)))
    asked = rows.filter("step = 0").groupBy(*key, "name", "open", "end").agg(F.max(F.when(F.col("depth") > 0, F.col("box"))).alias("box"))
    return asked.select(*key, "name", "open", "end", F.shiftright("box", 32).cast("int").alias("box_open"), F.col("box").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("box_end"))


def between(page_parts: Column, start: Column, end: Column) -> Column:
    """HTML of the parts start to end - 1."""
    return F.array_join(F.slice(page_parts, start + 1, end - start), "")
