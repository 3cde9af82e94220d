import random

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import differences
from hubloom.llm import mixing


def poured(sizes, weights, share=1.5, most=2):
    """Clamp and hand on, round by round."""
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_are_those_of_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 3, 40, 500, 6000]) for i in range(rng.randint(1, 12))}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    result = {r["source"]: r["target"] for r in mixing.fill_targets(mixing.weights_by_order(rows)).collect()}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    for source, target in poured(sizes, weights).items():
        assert result[source] == pytest.approx(target)


def documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["a"] * 6 + ["b", "c", None]))
            for i in range(600)]
    return spark.createDataFrame(rows + rows[:20] + [(None, "three words here", "b"), (None, None, "c")],
                                 "doc_id long, text string, source string")


def test_sql_and_laws(spark):
    docs = documents(spark).filter("doc_id IS NOT NULL")
    plan = mixing.mixing_plan(docs).withColumn("taken", (F.col("size") * F.col("repeats")).cast("long"))
    plan = plan.select("doc_id", "size", "source", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert differences(plan.drop("source"), con, mixing.OP6_SQL) == []
    for row in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                          F.max("size").alias("largest")).collect():
        assert abs(row["taken"] - row["target"]) <= row["largest"]
    assert plan.filter("taken > 2 * size").count() == 0
    assert plan.exceptAll(mixing.mixing_plan(docs).withColumn("taken", (F.col("size") * F.col("repeats")).cast("long"))
                          .select(*plan.columns)).count() == 0


def test_mixed_rows_are_the_plan(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs).count()
    assert mixed == mixing.mixing_plan(docs).agg(F.sum("repeats")).first()[0]


def test_main_path_is_native(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_mix_keeps_columns_of_any_name(spark):
    docs = documents(spark).withColumns({c: F.lit(f"own {c}") for c in ("draw", "of", "copy", "whole", "cut", "plan", "planned", "_mix_draw")})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.select("draw", "of", "copy", "cut").distinct().collect() == [
        ("own draw", "own of", "own copy", "own cut")]
    taken = {(r["doc_id"], r["text"]): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    given = {(r["doc_id"], r["text"]): r["count"] for r in docs.groupBy("doc_id", "text").count().collect()}
    plan = {r["doc_id"]: r["repeats"] for r in mixing.mixing_plan(docs).filter("doc_id IS NOT NULL").collect()}
    assert all(taken.get(k, 0) == n * plan[k[0]] for k, n in given.items() if k[0] is not None)
    assert mixing.mix(docs.filter("false")).count() == 0


def test_documents_are_not_shuffled(spark):
    physical = mixing.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical and "hashpartitioning" not in physical
