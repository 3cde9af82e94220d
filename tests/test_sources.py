"""Malformed raw rows, sketched medians, and the versioned store."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hubloom.operators.geography import state_centroids
from hubloom.sources.raw import CSV_LAYOUT, read_raw_csv, rejected_by_file, table_counts
from hubloom.sources.snapshots import SnapshotTable


def write_raw(folder, **rows):
    """A file for each raw table: the header, and the given lines."""
    for table, (pattern, fields) in CSV_LAYOUT.items():
        lines = [",".join(name for name, _ in fields), *rows.get(table, [])]
        (folder / pattern.replace("*", "x_")).write_text("\n".join(lines) + "\n")


GOOD_ORDER = "o1,c1,delivered,2017-01-02 10:00:00,,,,"
BROKEN = {
    "orders": [GOOD_ORDER, "o2,c2,delivered,02/01/2017,,,,", "o3,c3,delivered,,,,,", "o4,c4"],
    "order_items": ["o1,1,p1,s1,2017-01-05 00:00:00,10.5,2.0", "o1,2,p1,s1,2017-01-05 00:00:00,ten,2.0",
                    "o1,x,p1,s1,,1.0,free", 'o5,3,"p ""1"", a",s1,,7,1e1', "o6,4,p1,s1,,1.0,2.0,3.0"],
    "geolocation": ["1,-23.5,-46.6,sao paulo,SP", "2,-23.5W,-46.6,sao paulo,SP", "3,,,nowhere,RJ"],
    "customers": ["c1,u1,1,sao paulo,SP", "c2,u2"],
}


def test_malformed_rows_are_set_aside(spark, tmp_path):
    write_raw(tmp_path, **BROKEN)
    raw = read_raw_csv(spark, str(tmp_path), malformed="reject")
    counts = {r.raw_table: (r.rows, r.rejected) for r in table_counts(raw).collect()}
    assert counts == {"orders": (2, 2), "order_items": (2, 3), "geolocation": (2, 1), "customers": (1, 1),
                      "sellers": (0, 0), "products": (0, 0), "category_translation": (0, 0)}
    by_file = {os.path.basename(r.file): r.rejected for r in rejected_by_file(raw).collect()}
    assert by_file == {"x_orders_dataset.csv": 2, "x_order_items_dataset.csv": 3, "x_geolocation_dataset.csv": 1,
                       "x_customers_dataset.csv": 1}
    problems = {(r.raw_table, r.row): r.problem for r in raw.rejected.collect()}
    assert problems["order_items", "o1,2,p1,s1,2017-01-05 00:00:00,ten,2.0"] == "price: ten"
    assert problems["order_items", "o1,x,p1,s1,,1.0,free"] == "order_item_id: x; freight_value: free"
    assert problems["orders", "o4,c4"] == problems["customers", "c2,u2"] == "number of fields"
    # what is kept doesn't depend on the columns in use
    assert sorted(r.freight_value for r in raw.order_items.select("freight_value").collect()) == [2.0, 10.0]
    assert raw.order_items.count() == 2 and raw.customers.select("customer_state").count() == 1
    kept = raw.order_items.where("order_id = 'o5'").first()
    assert (kept.product_id, kept.price, kept.order_item_id) == ('p "1", a', 7.0, 3)
    assert [r.order_purchase_timestamp is None for r in raw.orders.orderBy("order_id").collect()] == [False, True]


def test_malformed_rows_are_an_error_or_null(spark, tmp_path):
    write_raw(tmp_path, **BROKEN)
    strict = read_raw_csv(spark, str(tmp_path))
    with pytest.raises(PySparkException, match=r"malformed row in .*x_order_items_dataset.csv \(price: ten\)"):
        strict.order_items.where("order_item_id = 2").select("order_id").collect()
    assert strict.sellers.count() == 0
    loose = read_raw_csv(spark, str(tmp_path), malformed="null")
    assert loose.order_items.count() == 5 and loose.order_items.where("price IS NULL").count() == 1
    assert table_counts(loose).agg(F.sum("rejected")).first()[0] == 0
    with pytest.raises(ValueError, match="malformed must be"):
        read_raw_csv(spark, str(tmp_path), malformed="skip")


def test_clean_files_have_no_malformed_rows(spark, tmp_path):
    write_raw(tmp_path, orders=[GOOD_ORDER] * 3)
    assert read_raw_csv(spark, str(tmp_path)).orders.count() == 3
    assert read_raw_csv(spark, str(tmp_path), malformed="reject").rejected.count() == 0


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_sketch_is_within_its_rank_error(spark, accuracy):
    """Skewed and repeated values, one state with most of the rows, several partitions."""
    points = (spark.range(0, 60000, numPartitions=7)
              .selectExpr("if(id % 10 < 8, 'SP', 'RJ') AS geolocation_state", "pow(rand(5), 5) * 1000 AS geolocation_lat",
                          "floor(rand(3) * 20) AS geolocation_lng").cache())
    sketched = {r.state: r for r in state_centroids(points, accuracy).collect()}
    for state in ("SP", "RJ"):
        rows = points.where(F.col("geolocation_state") == state).collect()
        for axis in ("lat", "lng"):
            values = np.sort([r[f"geolocation_{axis}"] for r in rows])
            found, n = sketched[state][axis], len(values)
            low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
            assert found in values and low - n / accuracy <= n / 2 <= high + n / accuracy + 1
    plan = state_centroids(points, accuracy)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_percentile_approx" in plan


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_readers_keep_their_version(spark, tmp_path, fmt):
    table = SnapshotTable(spark, str(tmp_path / "t"), fmt)
    schema = "id BIGINT, name STRING"
    with pytest.raises(FileNotFoundError):
        table.read(schema)
    rows = lambda n: spark.range(n).selectExpr("id", "concat('n ', id) AS name")
    assert table.publish(rows(3)).number == 1
    first = table.read(schema)
    assert table.publish(rows(5)).number == 2
    assert first.count() == 3 and table.read(schema).count() == 5 and table.read(schema, 1).count() == 3
    table.publish(table.read(schema).where("id > 3"))  # from itself
    assert [(r.id, r.name) for r in table.read(schema).collect()] == [(4, "n 4")]
    assert [v.number for v in table.versions()] == [2, 3]  # two are kept
    with pytest.raises(FileNotFoundError, match="no version 1"):
        table.read(schema, 1)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(4).toDF("id"))
    broken = spark.range(0, 100, numPartitions=4).selectExpr("if(id = 99, raise_error('killed'), id) AS id")
    with pytest.raises(PySparkException, match="killed"):
        table.publish(broken)
    assert table.read().count() == 4 and [v.number for v in table.versions()] == [1]
    # a write that got as far as its data, but not to its version
    spark.range(7).toDF("id").write.parquet(str(tmp_path / "t/data/unfinished"))
    assert table.read().count() == 4
    assert table.remove_unpublished() >= 1 and table.read().count() == 4
    assert os.listdir(tmp_path / "t/data") == [table.versions()[0].data]


def test_writers_at_one_number_leave_one_winner(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(1).toDF("id"), keep=5)
    for data, n in (("a", 2), ("b", 3)):  # both have seen version 1
        spark.range(n).toDF("id").write.parquet(str(tmp_path / f"t/data/{data}"))
        (tmp_path / f"t/versions/{2:012d}-{data}").touch()
    assert table.read().count() == 3 and table.publish(spark.range(9).toDF("id"), keep=5).number == 3
