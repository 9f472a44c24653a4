"""Commits of several tables, the feed of a catalog's own edits, and counts kept up from it."""

import itertools

import pytest
from pyspark.sql import functions as F

from shelfmark.plans.catalog import KEYS, Catalog
from shelfmark.plans.feed_queries import FEED_TABLES, MEASURES, fitted
from shelfmark.sources import commits
from shelfmark.sources.versions import VersionTaken
from shelfmark.streaming import catalog_feed as E
from shelfmark.streaming import changefeed as G
from shelfmark.streaming import counters as M

WHEN = "2024-06-01 12:00:00"


@pytest.fixture
def shop(spark, tmp_path):
    made = Catalog(spark, str(tmp_path / "shop"))
    sections = spark.createDataFrame([("a", "a", "A", True), ("b", "b", "B", True)], "id string, slug string, name string, is_active boolean")
    items = spark.createDataFrame([("1", "a", "one"), ("2", "a", "two"), ("3", "b", "three"), ("4", None, "four")], "id string, category_id string, name string") \
        .withColumn("price", F.col("id").cast("decimal(10,2)")).withColumn("is_available", F.lit(True)).withColumn("sort_order", F.lit(1))
    info = spark.createDataFrame([(1, "Shop", "ETB")], "id int, name string, currency string")
    owner = spark.createDataFrame([("u",)], "user_id string")
    made.load({name: fitted(rows, name) for name, rows in
               {"categories": sections, "menu_items": items, "cafe_info": info, "admin_users": owner}.items()})
    return made


def when():
    return F.lit(WHEN).cast("timestamp")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def places(catalog):
    return {r.id: r.category_id for r in catalog.table("menu_items").collect()}


def test_a_delete_over_two_tables_is_seen_at_once(spark, shop):
    before = shop.now()
    assert shop.delete("categories", ids(spark, "a"), "u", when()) == 2
    assert places(before) == {"1": "a", "2": "a", "3": "b", "4": None} and before.table("categories").count() == 2
    assert places(shop) == {"1": None, "2": None, "3": "b", "4": None} and shop.table("categories").count() == 1


def test_a_commit_that_fails_between_two_tables_is_never_seen(spark, shop):
    fewer = shop.table("categories").where("id = 'b'")
    broken = shop.table("menu_items").withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commits.write_commit(spark, shop.folder, {"categories": fewer, "menu_items": broken}, 1)
    assert shop._version() == 1 and shop.table("categories").count() == 2 and shop.menu().count() == 2
    assert commits.write_commit(spark, shop.folder, {"categories": fewer}, 1) == 2
    assert shop.table("categories").count() == 1 and len(places(shop)) == 4
    with pytest.raises(VersionTaken):
        commits.write_commit(spark, shop.folder, {"menu_items": shop.table("menu_items")}, 1)


def edit(spark, shop):
    shop.update("menu_items", spark.createDataFrame([("1", "b"), ("4", "a")], "id string, category_id string"), "u", when())
    shop.delete("categories", ids(spark, "b"), "u", when())
    shop.delete("menu_items", ids(spark, "2", "none"), "u", when())
    again = spark.createDataFrame([("2", "back", "a")], "id string, name string, category_id string").withColumn("price", F.lit(9).cast("decimal(10,2)"))
    shop.insert("menu_items", again, "u", when())
    shop.save_info(spark.createDataFrame([("Other",)], "name string"), "u", when())


def images(rows):
    return sorted(map(str, rows.collect()))


def test_replaying_the_feed_gives_the_tables(spark, shop, tmp_path):
    feed = str(tmp_path / "feed")
    assert E.publish(spark, shop.folder, feed, FEED_TABLES, KEYS) == 1
    edit(spark, shop)
    assert E.publish(spark, shop.folder, feed, FEED_TABLES, KEYS) == 6
    rows = spark.read.parquet(feed)
    counts = {(r.commit, r.table, r.op): r.n for r in rows.groupBy("commit", "table", "op").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1, "categories", "insert"): 2, (1, "menu_items", "insert"): 4, (1, "cafe_info", "insert"): 1,
                      (2, "menu_items", "update"): 2, (3, "categories", "delete"): 1, (3, "menu_items", "update"): 2,
                      (4, "menu_items", "delete"): 1, (5, "menu_items", "insert"): 1, (6, "cafe_info", "update"): 1}
    for name in FEED_TABLES:
        state = str(tmp_path / name)
        stream = E.of_table(E.feed_source(spark, feed, FEED_TABLES, files_per_batch=1), name)
        G.change_apply(stream, state, f"{state}-cp", KEYS[name], E.ORDER, compact_every=2).awaitTermination()
        now = G.current_state(spark, state, KEYS[name], E.ORDER)
        table = shop.table(name)
        assert images(now.select(*table.columns)) == images(table)


def test_equal_versions_and_odd_rows_change_nothing(spark):
    old = spark.createDataFrame([("1", None, float("nan")), ("2", "x", 0.0)], "id string, a string, b double")
    assert E.row_changes(old, old, "id").isEmpty()
    assert [(r.key, r.op, r.old, r.new.a) for r in E.row_changes(old.limit(0), old.where("id = 2"), "id").collect()] == [("2", "insert", None, "x")]
    wider = old.withColumn("c", F.lit(1))
    assert {r.op for r in E.row_changes(old, wider, "id").collect()} == {"update"}


def counted(rows):
    return {r.category_id: (r.n_items, r.n_available, float(r.total_price)) for r in rows.collect() if r.n_items}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2, 1], [2, 2, 3, 0, 1, 0]])
def test_counts_equal_a_recount_for_any_batches(spark, tmp_path, order):
    """Late batches, repeated batches and a replayed last one."""
    schema = "commit long, op string, id string, category_id string, is_available boolean, price decimal(10,2)"
    log = [(1, "insert", "1", "a", True, 5), (1, "insert", "2", "a", None, None), (2, "update", "1", "b", False, 7),
           (2, "insert", "3", None, True, 1), (3, "delete", "2", "a", None, None), (3, "update", "3", "a", True, 2), (4, "insert", "2", "b", True, 3)]
    from decimal import Decimal
    changes = spark.createDataFrame([(*r[:5], None if r[5] is None else Decimal(r[5])) for r in log], schema)
    batches = [changes.where(F.col("commit") == c + 1) for c in range(4)]
    state, counters = str(tmp_path / "state"), str(tmp_path / "counters")
    keep = M.counter_keeper(state, counters, "id", E.ORDER, "category_id", MEASURES, compact_every=2)
    for n, part in itertools.chain(enumerate(order), [(len(order) - 1, order[-1])]):
        G.write_delta(batches[part], n, state, "id", E.ORDER)
        keep(batches[part], n)
    assert counted(M.current_counters(spark, counters, "category_id", list(MEASURES))) == {"a": (1, 1, 2.0), "b": (2, 1, 10.0)}
