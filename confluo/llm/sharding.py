"""Sharding by sampled splitters (DataFrame functions only).

A size-weighted sample of keys gives quantile boundaries for many small ranges; records are dealt to ranges,
overfull ranges are subdivided, and running byte sums inside each range place every record exactly.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize

LOWEST = (-(1 << 63), -(1 << 63), -1.0)
HIGHEST = ((1 << 63) - 1, (1 << 63) - 1, 2.0)
KEY = ("h", "k", "tie")
#: The top bits of the first key part choose which ranges a record is compared with.
BUCKET_SHIFT = 54


def _key(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(prefix + c) for c in KEY])


def _sample(records: DataFrame, rate: F.Column, seed: int) -> list[tuple]:
    """Keys kept with the probability rate; the caller bounds the expected number."""
    return sorted(tuple(r) for r in records.where(F.rand(seed) < rate).select(*KEY).collect())


def _every(keys: list[tuple], step: int) -> list[tuple]:
    return keys[step - 1 :: step]


def _deal(records: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Adds rid: the number of the range [splitter, next splitter) that holds the record's key."""
    edges = [LOWEST, *sorted(set(splitters)), HIGHEST]
    rows = [
        (bucket, rid, *lo, *hi)
        for rid, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
        for bucket in range(lo[0] >> BUCKET_SHIFT, (hi[0] >> BUCKET_SHIFT) + 1)
    ]
    names = ["bucket long", "rid int", *(f"{p}{c} {t}" for p in ("lo_", "hi_") for c, t in zip(KEY, ("long", "long", "double"), strict=True))]
    ranges = records.sparkSession.createDataFrame(rows, ", ".join(names))
    # At most one row a range and bucket: the number of ranges is a parameter, not a size of the data.
    return (
        records.withColumn("bucket", F.shiftright("h", BUCKET_SHIFT))
        .join(F.broadcast(ranges), "bucket")
        .where((_key() >= _key("lo_")) & (_key() < _key("hi_")))
        .select(*records.columns, "rid")
    )


def shard_by_sampled_splitters(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 32,
    samples_per_range: int = 32,
) -> DataFrame:
    """Deal documents into n_shards shards of nearly equal bytes.

    A record's size is the UTF-8 bytes of its text plus 8. Records are ordered by (hash of the text, id), so equal
    texts stand together; where the middle byte of a record falls in the total decides its shard, so shards differ by
    less than the largest record. Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Null texts count as empty (size 8, crc of nothing); null ids order first; repeated rows are told apart by a stored
    random tie value; an empty table gives an empty result; other input columns are ignored, whatever their names; texts of
    any length are one record and never moved, only their sizes and hashes are.

    The driver receives about n_shards * ranges_per_shard * samples_per_range sampled keys and one row a range, however
    large the input is. A sampled record counts by bytes and by rows, so neither many tiny nor a few huge texts make an
    overfull range; ranges over twice the fair share are subdivided by further samples.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    old = Scratch(docs.sparkSession)
    records = old.write(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST[0])).alias("k"),
            F.rand(1).alias("tie"),
        ),
        "shard-records",
    )()
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = n_shards * ranges_per_shard
    if not n:
        return records.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    weight = (F.col("size") / total + 1 / n) / 2
    splitters = _every(_sample(records, weight * (n_ranges * samples_per_range), 2), samples_per_range)
    for again in range(8):
        ranged = _deal(records, splitters)
        held = sorted(tuple(r) for r in ranged.groupBy("rid").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
        share = {rid: max(rows / n, b / total) * n_ranges / 2 for rid, rows, b in held if rows > 1}
        over = {rid: x for rid, x in share.items() if x > 2}
        if not over:
            break
        denser = ranged.where(F.col("rid").isin(list(over)))
        splitters += _every(_sample(denser, weight * (n_ranges * samples_per_range * 4), 3 + again), samples_per_range)

    before_rows = accumulate((rows for _, rows, _ in held), initial=0)
    before_bytes = accumulate((b for _, _, b in held), initial=0)
    offsets = records.sparkSession.createDataFrame(
        [(rid, r, b) for (rid, _, _), r, b in zip(held, before_rows, before_bytes, strict=False)], "rid int, row0 long, byte0 long"
    )
    inside = Window.partitionBy("rid").orderBy(*KEY)
    middle = 2 * (F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    placed = materialize(
        ranged.join(F.broadcast(offsets), "rid").select(
            "doc_id",
            "size",
            "text_crc32",
            F.floor(middle * n_shards / (2 * total)).cast("int").alias("shard"),
            (F.col("row0") + F.row_number().over(inside) - 1).alias("at"),
        ),
        "shard-placed",
    )
    old.clear()
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return shard_by_sampled_splitters(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
