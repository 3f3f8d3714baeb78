"""Name variants settled in rounds against the walk from the best name on."""
import random

import pytest

from leadloom.operators import people

PEOPLE = "domain string, name string, title_rank int, position string, source_url string, seq long"


def walk(rows, n):
    """{domain: [(name, rank, position)]}"""
    found = {}
    for domain, name, rank, position, _, seq in sorted(rows, key=lambda r: r[5]):
        old = found.setdefault(domain, {}).get(name)
        found[domain][name] = (rank, seq, position) if old is None else (min(old[0], rank), old[1], position if rank < old[0] else old[2])
    out = {}
    for domain, names in found.items():
        kept = []
        for name, (rank, first, position) in sorted(names.items(), key=lambda x: (x[1][0], x[1][1], x[0])):
            if (n is None or len(kept) < n) and not any(name.lower() in k.lower() or k.lower() in name.lower() for k, *_ in kept):
                kept.append((name, rank, position))
        out[domain] = kept
    return out


def chosen(spark, rows, n):
    out = {}
    for r in people.key_contacts(spark.createDataFrame(rows, PEOPLE).repartition(5), n).orderBy("domain", "place").collect():
        out.setdefault(r.domain, []).append((r.name, r.title_rank, r.position))
        assert r.place == len(out[r.domain])
    return out


@pytest.mark.parametrize("n", [None, 3])
def test_variants(spark, n):
    rng = random.Random(4)
    words = ["Kim", "Lee", "Park", "Go", "An", "Na", "kim", "Oh"]
    rows = [(f"d{rng.randrange(4)}", " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.randrange(6), f"p{i}", "u", i) for i in range(400)]
    # better and worse names that settle one after the other
    rows += [("chain", f"Ab{i} Ab{i + 1}" if i % 2 else f"Ab{i + (i // 2) % 2}", i // 3, "p", "u", 1000 + i) for i in range(20)]
    rows += [("one", "Solo", 1, "p", "u", 2000)]
    assert chosen(spark, rows, n) == walk(rows, n)


def test_a_hot_domain(spark):
    """A hundred thousand names of one domain, as rows; the best name is a variant of a tenth of them."""
    from pyspark.sql import functions as F
    names = spark.range(100_000).select(
        F.lit("hot").alias("domain"), F.concat(F.lit("Nm"), F.lpad(F.conv(F.col("id").cast("string"), 10, 26), 6, "0")).alias("name"), F.lit(1).alias("title_rank"),
        F.lit("p").alias("position"), F.lit("u").alias("source_url"), F.col("id").alias("seq"))
    short = spark.createDataFrame([("hot", "Nm0001", 0, "p", "u", -1)], PEOPLE)
    out = people.key_contacts(names.unionByName(short))
    want = sum(1 for r in names.select("name").collect() if "nm0001" not in r.name.lower()) + 1
    assert out.count() == want < 100_000


def test_the_representative_is_added_once(spark):
    contacts = spark.createDataFrame([("a", 1, "Kim Min Ho", "CTO", "u")], "domain string, place int, name string, position string, source_url string")
    ceo = spark.createDataFrame([("a", "kim  minho", "u"), ("b", "Lee", "u")], "domain string, value string, source_url string")
    assert [(r.domain, r.place, r.name) for r in people.with_ceo(contacts, ceo).orderBy("domain").collect()] == [("a", 1, "Kim Min Ho"), ("b", 1, "Lee")]
    assert people.with_ceo(contacts, spark.createDataFrame([("a", "Park", "u")], ceo.schema), 1).count() == 1
