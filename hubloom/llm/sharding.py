"""Balance shards on bytes, tokens and rows by vector bin packing (operator 10).

Documents with equal texts are one group. Groups are placed by their vector (bytes, tokens,
rows) where the dot product with the shards' residual capacity is highest. Small groups are
packed as bundles of groups that a hash picks, so the packing sees a bounded number of
items whatever the input; a group that is larger than a shard is split by document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from hubloom.llm.tables import read_table, word_count, written

SHARDS = 24
# Bundles for each shard. A group over this share of a shard is an item of its own.
BUNDLES = 256
# A group over this many shards, in any of the three measures, is split.
WHOLE_SHARE = 1
# Large groups are dealt to pieces of about this share of a shard: these are placed apart where
# the group is split, and numbered apart in any case, so that no task holds a whole group.
PIECE_SHARE = 1 / 64

MEASURES = ("bytes", "tokens", "rows")
# Weight of each measure in the dot product; sizes are what must come out near equal.
MEASURE_WEIGHTS = (16.0, 1.0, 1.0)


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: largest items first, each to the largest dot product.

    `vectors` holds (bytes, tokens, rows) by row. Each measure is scaled to a capacity of 1
    for a shard; an item goes where its weighted vector times the residual capacity is
    highest, ties to the smaller shard. Residuals may turn negative: nothing is left out.
    """
    total = vectors.sum(axis=0)
    scaled = vectors * (shards / np.where(total > 0, total, 1))
    residual = np.ones((shards, vectors.shape[1]))
    weighted = scaled * np.array(MEASURE_WEIGHTS)
    placed = np.zeros(len(vectors), np.int64)
    for item in np.argsort(-scaled.max(axis=1), kind="stable"):
        placed[item] = shard = int(np.argmax(residual @ weighted[item]))
        residual[shard] -= scaled[item]
    return placed


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
                    bundles: int = BUNDLES) -> DataFrame:
    """Columns doc_id, size, tokens, text_crc32, shard, slot (gapless from 0 in each shard).

    Size is the text's UTF-8 bytes plus 8; a null text has none and counts as empty. Every row
    is placed, repeated rows and rows without an id too. Ties in slots are broken by id, then
    arbitrarily between rows alike. An empty table gives an empty result. Other columns are
    not looked at. What reaches the driver are the sums of at most `shards` * (4 * `bundles` +
    3 / PIECE_SHARE) bundles and pieces.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"),
        word_count(text).alias("tokens"), F.crc32(whole).alias("text_crc32"),
        F.xxhash64(whole, F.octet_length(whole)).alias("text_key")))
    groups = rows.groupBy("text_key").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    total = rows.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
                     F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32",
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*[F.col(m) * (shards / max(total[m] or 0, 1)) for m in MEASURES])
    # Each measure sums to `shards` shares, so at most 3 * shards * bundles groups are large.
    large = (groups.withColumn("share", share).filter(F.col("share") > 1 / bundles)
             .select(F.col("text_key").alias("large_key"),
                     (F.col("share") > WHOLE_SHARE).alias("parted"),
                     F.ceil(F.col("share") / PIECE_SHARE).cast("int").alias("pieces")))
    bundle = F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(shards * bundles))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_key", F.lit(2)), F.col("pieces")), F.lit(0)).cast("int")
    items = (rows.join(F.broadcast(large), F.col("text_key") == F.col("large_key"), "left")
             .withColumn("piece", piece)
             .withColumn("item", F.when(F.col("large_key").isNull(), F.concat(F.lit("b"), bundle))
                         .when(F.col("parted"), F.concat_ws(":", "text_key", "piece"))
                         .otherwise(F.col("text_key").cast("string")))
             .select("doc_id", "size", "tokens", "text_crc32", "text_key", "item", "piece"))
    sums = (items.groupBy("item", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"),
                                               F.count("*").alias("rows")).orderBy("item", "piece").collect())
    of = {item: k for k, item in enumerate(dict.fromkeys(s["item"] for s in sums))}
    vectors = np.zeros((len(of), len(MEASURES)))
    for s in sums:
        vectors[of[s["item"]]] += [s[m] for m in MEASURES]
    placed = pack(vectors, shards).tolist()
    places, filled = [], [0] * shards
    for s in sums:
        shard = placed[of[s["item"]]]
        places.append((s["item"], s["piece"], shard, filled[shard]))
        filled[shard] += s["rows"]
    spark = docs.sparkSession
    placement = spark.createDataFrame(places, "placed_item string, placed_piece int, shard int, first_slot long")
    within = Window.partitionBy("item", "piece").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    return (items.withColumn("place", F.row_number().over(within))
            .join(F.broadcast(placement), (F.col("item") == F.col("placed_item")) & (F.col("piece") == F.col("placed_piece")))
            .select("doc_id", "size", "tokens", "text_crc32", "shard",
                    (F.col("first_slot") + F.col("place") - 1).cast("long").alias("slot")))


def op10_sharding(spark, sf_dir):
    placed = shard_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
