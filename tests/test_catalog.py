"""The stored catalog, from the first seed to a reader's view after an owner's edits."""

import pytest
from menu_fixture import CATEGORIES, CATEGORY_COLUMNS, INFO, INFO_COLUMNS, ITEM_COLUMNS, USER_COLUMNS, items
from pyspark.sql import functions as F

from shelfmark.operators import listing as R
from shelfmark.operators.audit import seed_diff
from shelfmark.plans.catalog import Catalog, NotAllowed, category_form, info_form, item_form
from shelfmark.sources.versions import VersionTaken


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def frames(spark):
    return (spark.createDataFrame(CATEGORIES, CATEGORY_COLUMNS), spark.createDataFrame(items(), ITEM_COLUMNS),
            spark.createDataFrame(INFO, INFO_COLUMNS))


@pytest.fixture(scope="module")
def seeded(spark, tmp_path_factory):
    shop = Catalog(spark, str(tmp_path_factory.mktemp("catalog")))
    shop.seed(*frames(spark), at(1))
    users = spark.createDataFrame([("u1", "Owner@Example.com", None), ("u2", "guest@example.com", None)], USER_COLUMNS)
    shop.grant(spark.createDataFrame([("owner@EXAMPLE.com",)], "email string"), users, "the owner", at(1))
    return shop


@pytest.fixture
def shop(spark, seeded, tmp_path):
    """A copy of the seeded catalog for one test."""
    copy = Catalog(spark, str(tmp_path))
    for name in ("categories", "menu_items", "cafe_info", "admin_users"):
        copy._write(name, seeded.table(name))
    return copy


def item_id(shop, name):
    return shop.table("menu_items").where(F.col("name") == name).first().id


def patch(spark, key, **values):
    kinds = {"price": "decimal(10,2)", "is_available": "boolean", "sort_order": "int"}
    from decimal import Decimal

    cells = [Decimal(str(v)) if k == "price" and v is not None else v for k, v in values.items()]
    return spark.createDataFrame([(key, *cells)], ", ".join(["id string", *[f"{k} {kinds.get(k, 'string')}" for k in values]]))


def test_seed_counts(seeded):
    assert [seeded.table(t).count() for t in ("categories", "menu_items", "cafe_info", "admin_users")] == [7, 27, 1, 1]
    counts = R.conditional_counts(seeded.table("menu_items"), {
        "am": F.col("description_am").isNotNull(), "new": F.col("badge") == "new", "hot": F.col("badge") == "hot"}).first()
    assert tuple(counts) == (4, 5, 1)
    first = seeded.table("menu_items").where("name = 'Pizza No. 1'").first()
    assert (first.price, first.emoji, first.is_available) == (450, None, True)  # a given null stays
    slugs = {r.slug: r.icon_bg for r in seeded.table("categories").collect()}
    assert slugs["juice"] == "#111111" and slugs["pizza"] is None  # given null is not a default


def test_seed_twice_is_seed_once(spark, shop):
    before = {t: shop.table(t) for t in ("categories", "menu_items", "cafe_info")}
    shop.seed(*frames(spark), at(9))
    assert all(seed_diff(df, shop.table(t)).isEmpty() for t, df in before.items())


def test_seed_rows_keep_every_rule_and_get_ids_of_their_own(spark, shop):
    categories, rows, info = frames(spark)
    twice = rows.where("name = 'Juice No. 1'").withColumn("name", F.lit("Same"))
    bad = twice.withColumn("price", F.lit(-5).cast("decimal(10,2)"))
    with pytest.raises(Exception, match="price not negative"):
        shop.seed(categories, rows.unionByName(bad), info, at(2))
    assert shop.table("menu_items").count() == 27
    more = rows.unionByName(twice).unionByName(twice)
    shop.seed(categories, more, info, at(2))
    shop.seed(categories, more, info, at(3))
    same = shop.table("menu_items").where("name = 'Same'").collect()
    assert len(same) == 2 and len({r.id for r in same}) == 2 and shop.table("menu_items").count() == 29


def test_equal_inserts_are_two_rows(spark, shop):
    juice = shop.table("categories").where("slug = 'juice'").first().id
    cake = spark.createDataFrame([("Cake", juice), ("Cake", juice)], "name string, category_id string") \
        .withColumn("price", F.lit(10).cast("decimal(10,2)"))
    shop.insert("menu_items", cake, "u1", at(2))
    shop.insert("menu_items", cake.limit(1), "u1", at(2))
    assert shop.table("menu_items").where("name = 'Cake'").select("id").distinct().count() == 3


def test_a_statement_planned_on_an_older_state_fails(spark, shop):
    base = shop._version("menu_items")
    state = shop.table("menu_items")
    shop.delete("menu_items", state.limit(1).select("id"), "u1", at(2))
    with pytest.raises(VersionTaken):
        shop._write("menu_items", state, base)
    assert shop.table("menu_items").count() == 26


def test_reader_sees_sections_tabs_and_prices(seeded):
    listing = seeded.listing()
    assert listing.count() == 27 and listing.select("slug").distinct().count() == 7
    tabs = [r.slug for r in seeded.tabs().orderBy("pos").collect()]
    assert tabs == ["all", *[c[0] for c in CATEGORIES]]
    assert {r.slug for r in seeded.listing("pizza").collect()} == {"pizza"}
    assert seeded.listing("no-such-tab").count() == 27
    menu = {r.slug: r["items"] for r in seeded.menu().collect()}
    assert [x["price_label"] for x in menu["pizza"]][0] == "450 ETB"
    assert [x["badge_label"] for x in menu["burger"]] == ["", "NEW", "", "HOT", ""]


def test_price_edit_reaches_the_reader(spark, shop):
    key = item_id(shop, "Pizza No. 1")
    shop.update("menu_items", patch(spark, key, price=499), "u1", at(5))
    labels = [r.price_label for r in shop.listing("pizza").collect()]
    assert "499 ETB" in labels and "450 ETB" not in labels
    row = shop.table("menu_items").where(F.col("id") == key).first()
    assert row.updated_at > row.created_at
    untouched = shop.table("menu_items").where(F.col("id") != key).where("updated_at > created_at")
    assert untouched.isEmpty()


def test_fractional_price(spark, shop):
    shop.update("menu_items", patch(spark, item_id(shop, "Pizza No. 2"), price="450.50"), "u1", at(5))
    assert "450.50 ETB" in [r.price_label for r in shop.listing().collect()]
    assert "450.5 ETB" in [r.price_label for r in shop.owner_items().collect()]


def test_add_edit_sell_out_and_delete(spark, shop):
    coffee = shop.table("categories").where("slug = 'coffee'").first().id
    typed = spark.createDataFrame([("  Test Drink ", "175 birr", coffee, " with milk ", "", "new", "6")],
                                  "name string, price string, category_id string, description string, emoji string, badge string, sort_order string")
    shop.insert("menu_items", item_form(typed), "u1", at(2))
    row = shop.table("menu_items").where("name = 'Test Drink'").first()
    assert (row.price, row.description, row.emoji, row.sort_order, row.is_available) == (175, "with milk", "🍽", 6, True)
    assert "175 ETB" in [r.price_label for r in shop.listing("coffee").collect()]

    shop.update("menu_items", patch(spark, row.id, name="Test Drink Deluxe", description=None), "u1", at(3))
    assert shop.table("menu_items").where(F.col("id") == row.id).first().description is None
    shop.set_availability(spark.createDataFrame([(row.id, None)], "id string, is_available boolean"), "u1", at(4))
    listing = shop.listing()
    assert listing.where("badge_label = 'SOLD OUT'").count() == 1
    assert listing.where(F.col("id") == row.id).first().pos == 6  # after every available drink
    assert shop.owner_items(search="DELUXE").count() == 1

    shop.delete("menu_items", spark.createDataFrame([(row.id,), ("unknown",)], "id string"), "u1", at(5))
    assert shop.table("menu_items").count() == 27


def test_category_life(spark, shop):
    typed = spark.createDataFrame([(" Sweets & Cakes", " DESSERTS ", " ", "8x")], "name string, slug string, subtitle string, sort_order string")
    shop.insert("categories", category_form(typed), "u1", at(2))
    row = shop.table("categories").where("slug = 'desserts'").first()
    assert (row.name, row.subtitle, row.icon_bg, row.sort_order, row.is_active) == ("Sweets & Cakes", None, "#f4f1e9", 8, True)
    assert shop.tabs().where("slug = 'desserts'").count() == 1           # tabs keep empty categories
    assert shop.listing().where("slug = 'desserts'").isEmpty()
    assert {r.slug: r.n_items for r in shop.owner_categories().collect()}["desserts"] == 0

    pizza = shop.table("categories").where("slug = 'pizza'").select("id")
    shop.delete("categories", pizza, "u1", at(3))
    assert shop.table("menu_items").count() == 27
    freed = shop.table("menu_items").where("category_id is null")
    assert freed.count() == 5 and freed.where("updated_at > created_at").count() == 5
    assert shop.listing().count() == 22
    assert [r.meta.split(" • ")[0] for r in shop.owner_items().orderBy(F.desc("category_order")).limit(5).collect()] == ["No category"] * 5


def test_hidden_category(spark, shop):
    key = shop.table("categories").where("slug = 'juice'").first().id
    hide = spark.createDataFrame([(key, False)], "id string, is_active boolean")
    shop.update("categories", hide, "u1", at(2))
    assert shop.listing().count() == 21 and shop.listing("juice").count() == 21
    assert shop.read("categories").count() == 6 and shop.read("categories", "u1").count() == 7


@pytest.mark.parametrize("who", [None, "u2"])
def test_strangers_change_nothing(spark, shop, who):
    new = spark.createDataFrame([("Hacked",)], "name string")
    with pytest.raises(NotAllowed):
        shop.insert("menu_items", new, who, at(2))
    with pytest.raises(NotAllowed):
        shop.insert("admin_users", spark.createDataFrame([("u2",)], "user_id string"), who, at(2))
    key = item_id(shop, "Pizza No. 1")
    assert shop.update("menu_items", patch(spark, key, price=1), who, at(2)) is None
    assert shop.delete("categories", shop.table("categories"), who, at(2)) is None
    assert shop.table("menu_items").where("price = 450").count() == 1 and shop.table("categories").count() == 7
    assert shop.read("admin_users", who).isEmpty() and shop.read("menu_items", who).count() == 27


def test_even_owners_cannot_write_the_owner_list(spark, shop):
    with pytest.raises(NotAllowed):
        shop.insert("admin_users", spark.createDataFrame([("u2",)], "user_id string"), "u1", at(2))
    assert shop.delete("cafe_info", spark.createDataFrame([(1,)], "id int"), "u1", at(2)) is None
    assert shop.is_admin("u1") and not shop.is_admin("u2")


def refused(statement):
    with pytest.raises(Exception) as error:
        statement()
    return str(error.value)


def test_broken_rules_fail_the_statement(spark, shop):
    versions_before = shop.table("menu_items").inputFiles()
    bad = [patch(spark, "n1", name="Bad", price=-5), patch(spark, "n2", name="B", badge="bogus"),
           patch(spark, "n3", name=None), patch(spark, "n4", name="C", category_id="nowhere")]
    for rows, rule in zip(bad, ["price not negative", "badge known", "name missing", "category_id reference"]):
        assert rule in refused(lambda: shop.insert("menu_items", rows, "u1", at(2)))
    twice = spark.createDataFrame([("pizza", "Dup")], "slug string, name string")
    assert "slug unique" in refused(lambda: shop.insert("categories", twice, "u1", at(2)))
    two_rows = patch(spark, "n5", name="ok").unionByName(patch(spark, "n5", name="again"))
    assert "id unique" in refused(lambda: shop.insert("menu_items", two_rows, "u1", at(2)))
    key = item_id(shop, "Pizza No. 1")
    assert "price" in refused(lambda: shop.update("menu_items", patch(spark, key, price=-1), "u1", at(2)))
    assert shop.table("menu_items").inputFiles() == versions_before and shop.table("categories").count() == 7
    slug = spark.createDataFrame([("a b", "N", "", "1")], "slug string, name string, subtitle string, sort_order string")
    assert "slug may hold only" in refused(lambda: shop.insert("categories", category_form(slug), "u1", at(2)))


def test_info_row(spark, shop):
    typed = spark.createDataFrame([(" Test House ", " Best here ", "  ", " ")], "name string, tagline string, currency string, phone string")
    shop.save_info(info_form(typed), "u1", at(2))
    row = shop.info().first()
    assert (row.name, row.tagline, row.currency, row.phone, row.name_am) == ("Test House", "Best here", "ETB", None, "ቤት")
    with pytest.raises(NotAllowed):
        shop.save_info(info_form(typed), "u2", at(2))
    empty = Catalog(spark, shop.folder + "/empty")
    assert empty.info().isEmpty() and empty.listing().isEmpty()


def test_owner_grants(spark, shop):
    users = spark.createDataFrame([("u3", "new@x.com", None), ("u4", "Sure@x.com", None)], USER_COLUMNS) \
        .withColumn("email_confirmed_at", F.when(F.col("id") == "u4", at(1)))
    asked = spark.createDataFrame([("NEW@x.com",), ("sure@X.com",), ("gone@x.com",)], "email string")
    outcomes = {r.email: r.outcome for r in shop.grant(asked, users, "a manager", at(2)).collect()}
    assert outcomes == {"NEW@x.com": "unconfirmed", "sure@X.com": "granted", "gone@x.com": "missing"}
    assert {r.user_id: r.full_name for r in shop.table("admin_users").collect()} == {"u1": "the owner", "u3": "a manager", "u4": "a manager"}
    shop.grant(asked, users, "other", at(3))
    assert shop.table("admin_users").count() == 3
    shop.revoke(spark.createDataFrame([("new@X.COM",)], "email string"))
    assert not shop.is_admin("u3") and shop.is_admin("u4")
