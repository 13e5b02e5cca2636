"""A visited-set filter in front of the exact anti-join.

The filter is a Bloom filter cut into buckets of 32,768 bits, one row (bucket,
bits) each: a key sets ``BITS`` bits of one bucket.  Building it is one grouping
with partial bitmaps on the map side; filters of the same number of buckets are
merged by OR, so each crawl keeps its own and later crawls add theirs.  A key
that the filter does not know is new for certain and is never shuffled; the few
that it may know go through the exact anti-join, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.session import BROADCAST_BYTES, cut_lineage

BUCKET_BITS = 32_768
#: Bits set per key, bits of the filter per key.
BITS = 6
BITS_PER_KEY = 10


def buckets_for(keys: int) -> int:
    """Buckets (a power of two) for a number of keys."""
    n = 1
    while n * BUCKET_BITS < keys * BITS_PER_KEY:
        n *= 2
    return n


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def bucket_of(digest: Column, buckets: int) -> Column:
    return _number(digest, 1, 8) % buckets


def places_of(digest: Column) -> list[Column]:
    """Bits of a key, from an md5 digest in hex: the same on every engine."""
    return [_number(digest, 9 + 4 * i, 4) % BUCKET_BITS for i in range(BITS)]


@dataclass
class VisitedFilter:
    """(bucket, bits) rows of a filter with ``buckets`` buckets."""
    rows: DataFrame
    buckets: int

    @classmethod
    def of(cls, seen: DataFrame, key: str, buckets: int | None = None) -> "VisitedFilter":
        """Filter of the keys of ``seen``; nulls are no keys."""
        keys = seen.where(F.col(key).isNotNull())
        buckets = buckets or buckets_for(keys.agg(F.approx_count_distinct(key)).first()[0])
        digest = F.md5(F.col(key))
        each = keys.select(bucket_of(digest, buckets).alias("bucket"), F.explode(F.array(*places_of(digest))).alias("place"))
        return cls(cut_lineage(each.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))), buckets)

    def merge(self, other: "VisitedFilter") -> "VisitedFilter":
        """Filter of the keys of both."""
        if other.buckets != self.buckets:
            raise ValueError("filters to merge need the same number of buckets")
        both = self.rows.unionByName(other.rows).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return VisitedFilter(cut_lineage(both), self.buckets)

    def fits(self) -> bool:
        """Whether the filter may be broadcast: its size is known before it is built."""
        return self.buckets * BUCKET_BITS // 8 <= BROADCAST_BYTES

    def flag(self, df: DataFrame, key: str, name: str = "maybe_seen") -> DataFrame:
        """``df`` with ``name``: false for keys that are not in the filter for certain
        (null keys never are)."""
        digest = F.md5(F.col(key))
        keyed = df.withColumn("__digest", digest).withColumn("__bucket", bucket_of(F.col("__digest"), self.buckets))
        rows = self.rows.select(F.col("bucket").alias("__bucket"), "bits")
        joined = keyed.join(F.broadcast(rows) if self.fits() else rows, "__bucket", "left")

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            return F.get(F.array(*[byte.bitwiseAND(1 << i) != 0 for i in range(8)]), (place % 8).cast("int"))

        known = F.lit(True)
        for place in places_of(F.col("__digest")):
            known = known & is_set(place)
        return joined.select(*df.columns, F.coalesce(known, F.lit(False)).alias(name))


def new_keys(df: DataFrame, seen: DataFrame, key: str, known: VisitedFilter | None = None) -> DataFrame:
    """Rows of ``df`` whose key is not in ``seen``, as ``df ANTI JOIN seen`` (a null
    key is new).  Only keys that the filter may know take part in the join; a filter
    too large to broadcast is left out."""
    known = known or VisitedFilter.of(seen, key)
    if not known.fits():
        return df.join(seen.select(key), key, "left_anti")
    flagged = known.flag(df, key, "__maybe")
    sure = flagged.where(~F.col("__maybe")).drop("__maybe")
    checked = flagged.where("__maybe").drop("__maybe").join(seen.select(key), key, "left_anti")
    return sure.unionByName(checked)


def filter_report(df: DataFrame, seen: DataFrame, key: str, known: VisitedFilter) -> DataFrame:
    """One row: distinct keys, those passed by the filter alone, those it sent on to
    the exact join, and its false positives among them."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    marked = known.flag(keys, key).join(seen.select(key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    seen_ = F.coalesce("__seen", F.lit(False))
    return marked.agg(F.count("*").alias("n_keys"), F.count_if(~F.col("maybe_seen")).alias("n_passed"),
                      F.count_if("maybe_seen").alias("n_checked"), F.count_if(F.col("maybe_seen") & ~seen_).alias("n_false"),
                      F.count_if(~F.col("maybe_seen") & seen_).alias("n_missed"))
