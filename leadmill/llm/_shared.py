"""What the operators of this subpackage share: staged tables, bounded samples and text blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, as in tests; an
    error on a cluster, whose executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="leadmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; null keys give null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(m))


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cut a long text before white space that follows a word, so that no word is cut; the blocks join to the text."""
    if len(text) <= size:
        yield text
        return
    cut, start = re.compile(r"(?<=\S)\s"), 0
    while start < len(text):
        found = cut.search(text, start + size) if start + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def numbered(df: DataFrame) -> DataFrame:
    """df with a row_id; to be staged at once, so that the numbers stay as they are."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def gapless_rank(df: DataFrame, group: str, n_buckets: int, name: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap; df is a staged table with a row_id.

    Two levels: ranks within (group, bucket of row_id), and the rows in lower buckets. No group meets in one task, however
    large: a bucket holds about rows / n_buckets.
    """
    from pyspark.sql import Window

    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64("row_id"), F.lit(n_buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(group, "__bucket").agg(F.count("*").alias("__n")).select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, "__bucket").orderBy("row_id")
    ranked = dealt.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(base.hint("shuffle_hash"), [group, "__bucket"]).withColumn(name, (F.col("__rank") + F.col("__base")).cast("long")).drop("__bucket", "__rank", "__base")


#: Characters whose class, case and normal form are the same in Python and in the tokenizers' libraries.
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def plain(text: str) -> bool:
    """No characters but those above, and nothing that begins a special token."""
    if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return False
    try:
        text.encode("latin-1")  # the quick test
    except UnicodeEncodeError:
        return not NOT_PLAIN.search(text)
    return True
