"""Sources, snapshots, access rules and audits on small inputs."""

import pytest
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.operators import access as A
from shelfmark.operators import audit as U
from shelfmark.operators import listing as R
from shelfmark.sources import snapshots as N
from shelfmark.sources import tables as S
from shelfmark.sources import versions
from shelfmark.sources.workspace import fresh_folder, workspace

DAY = 24 * 60 * 60 * 1000


def test_singletons(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert [r.v for r in S.read_singleton(df).collect()] == ["a"]
    assert S.read_singleton(df, value=9).collect() == []
    assert [r.v for r in S.require_single(df.where("id = 1")).collect()] == ["a"]
    for statement in (S.read_singleton(df, value=2), S.require_single(df), S.require_single(df.where("id = 9"))):
        with pytest.raises(Exception):
            statement.collect()


def test_null_order_and_currency(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id int, o int")
    assert [r.id for r in S.scan_ordered(df, "o", "id").collect()] == [3, 2, 1]
    assert [r.id for r in R.order_one_column(df, "o", "id", descending=True).collect()] == [1, 2, 3]
    info = spark.createDataFrame([(1, "USD")], "id int, currency string")
    assert {r.currency for r in R.with_currency(df, info).collect()} == {"USD"}
    assert [r.currency for r in R.with_currency(df, info.where("id = 0")).collect()] == ["ETB"] * 3
    assert {r.currency for r in R.with_currency(df, info.withColumn("currency", F.lit(""))).collect()} == {"ETB"}


def test_search_is_literal(spark):
    items = spark.createDataFrame([(1, "50% off", None), (2, "Plain", "has a_b"), (3, "PLAIN", "")], "id int, name string, description string")
    find = lambda q: sorted(r.id for r in R.text_search(items, q).collect())
    assert (find("%"), find("A_B"), find("plain"), find(""), find(" ")) == ([1], [2], [2, 3], [1, 2, 3], [1, 2])


def test_null_flags_mean_on(spark):
    df = spark.createDataFrame([(1, None), (2, False), (3, True)], "id int, is_active boolean")
    assert [r.id for r in R.active_categories(df).collect()] == [1, 3]
    assert [r.id for r in R.filter_is(df, "is_active", None).collect()] == [1]
    assert [r.id for r in R.filter_neq(df, "is_active", True).collect()] == [2]


def test_manifest_lists_files_without_reading_them(spark, tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "a.png").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    manifest = S.object_manifest(spark, str(tmp_path))
    assert sorted((r.name, r.size, r.media) for r in manifest.collect()) == [("a.png", 5, "image/png"), ("b.txt", 1, V.DEFAULT_MEDIA_TYPE)]
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    probe = S.bucket_probe(manifest.withColumn("bucket_id", F.lit("b")))
    assert tuple(probe.first()) == ("b", "a.png", 2)


def test_catalog_checks(spark):
    spark.range(1).createOrReplaceTempView("known_table")
    found = S.catalog_checks(S.registered_tables(spark), ["known_table", "absent_table"])
    assert {r.table: r.present for r in found.collect()} == {"known_table": True, "absent_table": False}


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.latest_version(spark, folder) is None
    assert versions.write_version(spark.range(3), folder) == 1
    first = versions.read_version(spark, folder)
    assert versions.write_version(first.where("id > 0"), folder, ["id"]) == 2
    assert (first.count(), versions.read_version(spark, folder).count()) == (3, 2)
    (tmp_path / "t" / "version=3").mkdir()  # a write that never finished
    assert versions.latest_version(spark, folder) == 2


def test_workspace_is_the_named_folder(spark):
    assert workspace(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")


def test_two_writers_of_one_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    versions.write_version(spark.range(3), folder)
    assert versions.write_version(spark.range(4), folder, version=2) == 2
    with pytest.raises(versions.VersionTaken):
        versions.write_version(spark.range(5), folder, version=2)
    assert versions.read_version(spark, folder).count() == 4
    broken = spark.range(5).where(F.raise_error(F.lit("refused")).cast("boolean"))
    with pytest.raises(Exception, match="refused"):
        versions.write_version(broken, folder)
    assert versions.write_version(spark.range(6), folder) == 3  # a failed write gives its number back
    (tmp_path / "t" / "claim=4").touch()                          # a killed one doesn't
    with pytest.raises(versions.VersionTaken):
        versions.write_version(spark.range(7), folder)
    versions.release(spark, folder, 4)
    assert versions.write_version(spark.range(7), folder) == 4


def save(spark, folder, saved_at, data='{"items":[1]}'):
    rows = spark.createDataFrame([("items", "c", 0, data)], N.CONTENT_SCHEMA)
    rows.write.mode("append").parquet(f"{folder}/saved_at={saved_at}")


def latest(spark, folder, as_of):
    return sorted({r.saved_at for r in N.snapshot_latest_valid(spark, folder, as_of).collect()})


def test_snapshot_age_and_choice(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert latest(spark, folder, 0) == []
    save(spark, folder, 1000)
    assert latest(spark, folder, 1000 + 7 * DAY) == [1000]
    assert latest(spark, folder, 1001 + 7 * DAY) == []
    save(spark, folder, 5000)
    assert latest(spark, folder, 6000) == [5000]
    save(spark, folder, 7000)
    save(spark, folder, 7000, "{broken")
    assert latest(spark, folder, 8000) == [5000]  # the newest readable one
    save(spark, folder, 7500)
    part = next(p for p in (tmp_path / "s" / "saved_at=7500").glob("part-*.parquet") if p.stat().st_size)
    part.write_bytes(b"no parquet")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    assert latest(spark, folder, 8000) == [5000]


def test_snapshot_fallback_and_clear(spark, tmp_path):
    folder = str(tmp_path / "s")
    save(spark, folder, 1000)
    saved = N.snapshot_latest_valid(spark, folder, 2000)
    missing = lambda: spark.read.parquet(str(tmp_path / "nothing"))
    failing = lambda: saved.withColumn("data", F.raise_error(F.lit("lost while reading")))
    assert {r.source for r in N.snapshot_fallback(missing, saved).collect()} == {"snapshot"}
    assert {r.source for r in N.snapshot_fallback(failing, saved).collect()} == {"snapshot"}
    assert {r.source for r in N.snapshot_fallback(lambda: saved, saved).collect()} == {"fresh"}
    N.snapshot_clear(spark, folder)
    assert latest(spark, folder, 2000) == []
    save(spark, folder, 3000)
    assert latest(spark, folder, 3000) == [3000]
    expired = N.snapshot_latest_valid(spark, folder, 3000 + 8 * DAY)
    with pytest.raises(Exception, match="could not load"):
        N.loaded_or_error(N.snapshot_fallback(missing, expired)).collect()


def test_visibility(spark):
    owners = spark.createDataFrame([("o", "a"), ("p", "b")], "user_id string, email string")
    cats = spark.createDataFrame([(1, True), (2, False)], "id int, is_active boolean")
    seen = lambda t, df, who: A.visible_rows(t, df, owners, who).count()
    assert [seen("categories", cats, w) for w in (None, "x", "o")] == [1, 1, 2]
    assert [seen("admin_users", owners, w) for w in (None, "x", "o")] == [0, 0, 1]
    objects = spark.createDataFrame([("menu-images",), ("private",)], "bucket_id string")
    assert seen("objects", objects, None) == 1


def test_write_outcomes(spark):
    owners = spark.createDataFrame([("o",)], "user_id string")
    cases = [("o", "menu_items", "insert", None, "allowed"), ("o", "cafe_info", "delete", None, "no_rows"),
             ("o", "admin_users", "insert", None, "rejected"), ("x", "categories", "delete", None, "no_rows"),
             (None, "categories", "insert", None, "rejected"), ("o", "objects", "insert", "menu-images", "allowed"),
             ("o", "objects", "insert", "private", "rejected"), ("o", "objects", "update", None, "no_rows")]
    df = spark.createDataFrame(cases, "user_id string, tbl string, op string, bucket string, want string")
    assert all(r.outcome == r.want for r in A.authorize_changes(df, owners, bucket="bucket").collect())
    matrix = {(r.role, r.tbl, r.op): r.expected for r in A.policy_matrix(spark).collect()}
    assert len(matrix) == 45 and all(v != "allowed" for (role, _, _), v in matrix.items() if role != "owner")


def test_rollup_and_expectations(spark):
    checks = spark.createDataFrame([("ok",), ("warn",)], "status string")
    assert tuple(U.check_rollup(checks).first()) == (2, 0, 1, True)
    assert U.check_rollup(checks.withColumn("status", F.lit("fail"))).first().passed is False
    df = spark.createDataFrame([(1,), (2,)], "id int")
    found = U.expectations(df, {"rows": (F.count(F.lit(1)), 2), "top": (F.max("id"), 3)})
    assert {r.rule: r.ok for r in found.collect()} == {"rows": True, "top": False}
    assert [tuple(r) for r in U.seed_diff(df, df.unionByName(df.where("id = 1"))).collect()] == [(1, 1)]
