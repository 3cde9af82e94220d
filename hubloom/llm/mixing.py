"""Mix sources to target weights by capped water-filling (operator 6), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hubloom.llm.tables import read_table, stored, unused, word_count, written

# Strips of the draw range that are added up before single documents are looked at.
STRIP_BITS = 10
DRAW_BITS = 60

# Weights of the sources by code point, repeating, share of all words, most epochs of a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def draw(key: Column, seed: int = SEED) -> Column:
    """A 60-bit number from the seed and the key's text, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long")


def fill_targets(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets by water-filling of (source, weight, source_size), one row per source.

    All sources share `share` times the sum of sizes by weight; none gets over `max_epochs`
    times its size, and what it can't take goes to the others by weight until none is above.
    Sorted by cap over weight, the clamped sources come first; the level is that of the first
    source that isn't clamped. If no source can take more, every target is its cap.
    One row per weighted source, so the windows are as small as the list of weights.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy((F.col("cap") / F.col("weight")), F.col("place"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sources.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("words", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("rest", F.col("words") - F.col("full"))
        .withColumn("clamped", F.col("cap") * F.col("open_weight") < F.col("rest") * F.col("weight"))
        .withColumn("level", F.when(~F.col("clamped"), F.col("rest") / F.col("open_weight")))
        .withColumn("level", F.first("level", ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("clamped") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return ranked.select("source", "weight", "source_size", target.alias("target"))


def weights_by_order(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Give the sources of (source, source_size) the weights in turn, by code point, null last."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    return (sizes.withColumn("place", place)
            .withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int"))))


def fractional_cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole repetitions of each source and the draw up to which documents come once more.

    `rows` has (source, size, draw). By draw, documents are taken until the words that the
    whole repetitions leave are reached, to half the last document. Sizes are added up by
    strips of the draw range first; only the strip in which a source's count is reached is
    looked at by draw, so no source is gathered in one task.
    """
    shift = DRAW_BITS - STRIP_BITS
    plan = targets.withColumn("whole", F.coalesce(
        F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)))
    plan = plan.withColumn("words_left", F.col("target") - F.col("whole") * F.col("source_size"))
    by_strip = Window.partitionBy("source").orderBy("strip")
    strips = (
        rows.groupBy("source", F.shiftright("draw", shift).alias("strip")).agg(F.sum("size").alias("strip_size"))
        .withColumn("reached", F.sum("strip_size").over(by_strip))
        .join(plan.select(F.col("source").alias("of"), "words_left"), F.col("source").eqNullSafe(F.col("of")))
        .select("source", "strip", "words_left", (F.col("reached") - F.col("strip_size")).alias("passed"), "reached")
    )
    last = (strips.filter((F.col("passed") < F.col("words_left")) & (F.col("words_left") < F.col("reached")))
            .select(F.col("source").alias("of"), F.col("strip").alias("last_strip"), "words_left", "passed"))
    by_draw = Window.partitionBy("source").orderBy("draw")
    within = (
        rows.join(last, F.col("source").eqNullSafe(F.col("of"))
                  & (F.shiftright("draw", shift) == F.col("last_strip")))
        .groupBy("source", "draw", "words_left", "passed").agg(F.sum("size").alias("here"))
        .withColumn("middle", 2 * (F.col("passed") + F.sum("here").over(by_draw)) - F.col("here"))
        .filter(F.col("middle") <= 2 * F.col("words_left"))
        .groupBy("source").agg(F.max("draw").alias("cut"))
    )
    full = strips.filter(F.col("reached") <= F.col("words_left")).groupBy("source").agg(
        (F.shiftleft(F.max("strip") + 1, shift) - 1).alias("cut"))
    cuts = within.unionByName(full).groupBy("source").agg(F.max("cut").alias("cut"))
    cuts = cuts.select(F.col("source").alias("cut_source"), "cut")
    return (plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
            .select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")))


def mixing_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
                seed: int = SEED) -> DataFrame:
    """One row per document: how often the mix takes it.

    Columns: doc_id, source, size, draw, source_size, target, repeats (0 to `max_epochs`).
    Null text has size 0; a null source is a source of its own, last in order. Documents
    without an id are drawn by their text. Repeated rows share a draw, so all or none of them
    come once more. An empty table gives an empty result. Other columns are not looked at.
    """
    rows, plan = source_plan(docs, key, text, source, weights, share, max_epochs, seed)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "source", "size", "draw", "source_size", "target", repeats("draw", max_epochs).alias("repeats")))


def row_draw(key: str, text: str, seed: int) -> Column:
    """The draw of a row, by its id, or by its text where it has none."""
    return draw(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")), seed)


def repeats(drawn: str, max_epochs: int) -> Column:
    """How often a row of that draw is taken, next to its source's `whole` and `cut`."""
    once_more = F.when(F.col(drawn) <= F.col("cut"), 1).otherwise(0)
    return F.least(F.col("whole") + once_more, F.lit(max_epochs)).cast("int")


def source_plan(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], share: float,
                max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, draw) of each row, and (of, source_size, target, whole, cut) of each source."""
    rows = written(docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
        row_draw(key, text, seed).alias("draw")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = fill_targets(weights_by_order(sizes, weights), share, max_epochs)
    return rows, stored(fractional_cuts(rows, targets)).withColumnRenamed("source", "of")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: rows of `docs`, each as often as the plan takes it.

    A row's copies stand one after the other. How often it comes follows from its draw and two
    numbers of its source, so only a row for each source meets the documents, which are not
    shuffled. Nulls, repeated rows and empty tables as in `mixing_plan`; any columns may be there.
    """
    _, plan = source_plan(docs, key, text, source, weights, share, max_epochs, seed)
    drawn, of, copy = (unused(docs, name) for name in ("draw", "of", "copy"))
    plan = plan.select(F.struct("whole", "cut").alias("plan"), F.col("of").alias("planned"))
    plan = plan.select(F.col("planned").alias(of), F.col("plan").alias(copy))
    times = F.least(F.col(f"{copy}.whole") + F.when(F.col(drawn) <= F.col(f"{copy}.cut"), 1).otherwise(0), F.lit(max_epochs))
    return (docs.withColumn(drawn, row_draw(key, text, seed))
            .join(plan, F.col(source).eqNullSafe(F.col(of)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
            .select(*docs.columns))


def op6_mixing(spark, sf_dir):
    plan = mixing_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


OP6_SQL = r"""
WITH rows AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS draw
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes),
caps AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS words,
         coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, place
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_words,
         (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, place
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_weight
  FROM ranked),
levels AS (
  SELECT *, cap * open_weight < (words - full_words) * weight AS clamped,
         (words - full_words) / open_weight AS level_here FROM caps),
targets AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight *
           (SELECT level_here FROM levels WHERE NOT clamped
            ORDER BY cap::DOUBLE / weight, place LIMIT 1)) END AS target
  FROM levels),
halves AS (
  SELECT source, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM targets),
draws AS (
  SELECT source, draw, sum(size) AS here,
         sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) AS reached FROM rows GROUP BY source, draw)
SELECT r.doc_id, r.size, h.source_size, h.target,
       (r.size * least(2, h.whole + CASE WHEN 2 * d.reached - d.here <= 2 * (h.target - h.whole * h.source_size)
                                    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN halves h ON r.source IS NOT DISTINCT FROM h.source
JOIN draws d ON d.source IS NOT DISTINCT FROM r.source AND d.draw = r.draw
"""
