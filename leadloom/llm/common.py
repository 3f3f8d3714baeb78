"""Helpers of the corpus operators: text columns, byte batches for NumPy, tables in the shared folder."""
from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED_WORD = r"[^\x20\x09-\x0D]+"                      # anything between blanks
# digits, letters and all beyond ASCII; listed, as a long complement takes six times as long to match
PLAIN_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
PLAIN_WORD_ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"


def filled(c: str) -> Column:
    """Text as a string; null counts as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def lowered(c: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all machines see; a temporary one only where none is set (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here, and Spark knows the table's size."""
    path = f"{shared_dir(df.sparkSession)}/corpus-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, before the end of the job."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the steps that run inside, and what was there before for those after."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def release(spark: SparkSession) -> None:
    """Delete the staged tables under the shared folder. For the end of a job: results that are still lazy read them."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "corpus-*")) or []:
        fs.delete(status.getPath(), True)


def text_key(text: Column) -> Column:
    """With doc_id the key of a row; rows alike in both are one document given twice and get the same result."""
    return F.xxhash64(text)


# --- batches of texts as one byte array, for vectorised work inside Arrow batches ---

BATCH_BYTES = 1_000_000


def byte_batches(texts, most: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes of some texts one after the other, their offsets). A long text makes a batch of its own."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)
        if held and size + len(raw) > most:
            yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])


_random = np.random.default_rng(20260101)
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 2**64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_powers = {1: (np.ones(1, np.uint64), np.ones(1, np.uint64))}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = max(_powers)
    if size < n:
        up, down = _powers[size]
        while len(up) < n:
            step = len(up)
            up = np.concatenate([up, up * np.uint64(pow(BASE, step, 2**64))])
            down = np.concatenate([down, down * np.uint64(pow(INVERSE, step, 2**64))])
        _powers.clear()
        _powers[len(up)] = up, down
        size = len(up)
    return _powers[size][0][:n], _powers[size][1][:n]


def prefix_hash(raw: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """P with P[j] - P[i] = sum of code * BASE**position over raw[i:j]."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * powers(len(raw))[0], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each raw[start:end], the same wherever the bytes stand."""
    down = powers(len(prefix))[1]
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def blank_separated(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the index of each word's text. `blank` says which bytes part words."""
    solid = ~blank[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = solid[edges]        # a text's first and last byte end words as blanks do
    stops[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


# --- a bounded filter in front of a shuffle: it lets through too much, never too little ---

def reduced(parts, combine):
    """The parts of an RDD combined on the executors, so deep that at most about 32 of them reach the driver, however many there are."""
    return parts.treeReduce(combine, depth=max(2, math.ceil(math.log(max(parts.getNumPartitions(), 1), 32))))


def bitmap(df: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """2**bits flags of the 64-bit values in `column`, by their top bits after a scramble. Parts are joined pairwise on the executors."""
    spark = df.sparkSession

    def flags(rows) -> Iterator[np.ndarray]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        part = []
        for r in rows:
            part.append(r[0])
            if len(part) == 100_000:
                _set(out, part, bits)
                part = []
        _set(out, part, bits)
        yield out

    rows = df.select(column).rdd
    rows = rows.coalesce(min(rows.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
    return reduced(rows.mapPartitions(flags), np.bitwise_or)


def _set(flags: np.ndarray, values: list[int], bits: int) -> None:
    at = mixed(np.array(values, np.int64).view(np.uint64)) >> np.uint64(64 - bits)
    np.bitwise_or.at(flags, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def flagged(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = int(len(flags)).bit_length() + 2
    at = mixed(values.view(np.uint64)) >> np.uint64(64 - bits)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame) -> DataFrame:
    """Staged (node, label): the smallest node of the connected component, for every other node of `edges` (a, b: long).

    Large-star and small-star rounds until nothing changes; each round is written, and only a count and a checksum reach the driver.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
