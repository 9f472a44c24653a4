"""Snapshots, change streams and the state they lead to, over the star tables."""

from pyspark.sql import functions as F

from shelfmark.fixed_values import SNAPSHOT_TTL_MS
from shelfmark.operators import listing as R
from shelfmark.operators.changes import delete_rows, update_patch
from shelfmark.plans.catalog import KEYS, Catalog
from shelfmark.plans.catalog import TABLES as CATALOG_TABLES
from shelfmark.plans.read_queries import MENU_TEXT_SQL, flat_pages
from shelfmark.plans.registry import query
from shelfmark.plans.star import CREATED, NOW, as_changes
from shelfmark.sources import snapshots as N
from shelfmark.sources import tables as S
from shelfmark.sources.workspace import fresh_folder, stored
from shelfmark.streaming import catalog_feed as E
from shelfmark.streaming import changefeed as G
from shelfmark.streaming import counters as M

AS_OF = 1_717_243_200_000
ORDER = ["ts", "event_id"]
INFO_SQL = "select 1 id, 'ETB' currency, cast(count(*) as varchar) || ' items' name from it"
PAGES_SQL = """
select 'items' part, cast(category_id as varchar) category_id, (pos - 1) // 500 page, count(*) n, '' label{more} from listing group by all
union all select 'tabs', cast(null as varchar), cast(null as bigint), 1, name{more} from cat where is_active
union all select 'tabs', cast(null as varchar), cast(null as bigint), 1, 'All'{more}
union all select 'info', cast(null as varchar), cast(null as bigint), 1, name{more} from (""" + INFO_SQL + """)"""


def shown(s):
    """Menu pages, tabs and an info row, as a snapshot holds them."""
    info = s.items().agg(F.lit(1).alias("id"), F.lit("ETB").alias("currency"),
                         F.concat(F.count(F.lit(1)).cast("string"), F.lit(" items")).alias("name"))
    return N.catalog_snapshot(R.category_menu(s.items(), s.categories()), R.nav_tabs(s.categories()), info)


def menu_folder(s, *saved_at):
    """The catalog saved once for each time, built once; returns where."""
    folder = fresh_folder(s.spark, "snapshot")
    N.snapshot_write(shown(s), folder, *saved_at)
    return folder


def parts(snapshot, *more):
    n = F.when(F.col("part") == "items", F.json_array_length(F.get_json_object("data", "$.items"))).otherwise(1)
    label = F.when(F.col("part") == "tabs", F.regexp_replace(F.get_json_object("data", "$.label"), r"^\S+ ", "")) \
        .when(F.col("part") == "info", F.get_json_object("data", "$.name")).otherwise("")
    return snapshot.select("part", "category_id", "page", n.cast("bigint").alias("n"), label.alias("label"), *more)


# -- snapshots -------------------------------------------------------------------------------------

@query("snapshot_write", PAGES_SQL.format(more=f", cast({AS_OF} as bigint) saved_at"))
def _(s):
    return parts(N.snapshot_read(s.spark, menu_folder(s, AS_OF)), "saved_at")


@query("snapshot_latest_valid", PAGES_SQL.format(more=f", cast({AS_OF - SNAPSHOT_TTL_MS} as bigint) saved_at"))
def _(s):
    """The oldest snapshot is past its time, the next just as old as allowed, and the newest corrupt."""
    folder = menu_folder(s, AS_OF - SNAPSHOT_TTL_MS - 1, AS_OF - SNAPSHOT_TTL_MS, AS_OF)
    broken = s.spark.read.schema(N.CONTENT_SCHEMA).parquet(f"{folder}/saved_at={AS_OF}").limit(1).withColumn("data", F.lit("{broken"))
    stored(broken, "broken").write.mode("append").parquet(f"{folder}/saved_at={AS_OF}")
    return parts(N.snapshot_latest_valid(s.spark, folder, AS_OF), "saved_at")


@query("snapshot_fallback", PAGES_SQL.format(more=", 'snapshot' source") + " union all " + PAGES_SQL.format(more=", 'fresh' source"))
def _(s):
    """Once the source fails while it is read, once it doesn't."""
    saved = N.snapshot_latest_valid(s.spark, menu_folder(s, AS_OF), AS_OF).drop("saved_at")
    lost = N.snapshot_fallback(lambda: shown(s).withColumn("data", F.raise_error(F.lit("the disk is gone"))), saved)
    found = N.snapshot_fallback(lambda: shown(s), saved)
    return parts(N.loaded_or_error(lost), "source").unionByName(parts(N.loaded_or_error(found), "source"))


@query("snapshot_clear", "select count(distinct category_id) > 0 had_rows, 0 n_left from listing")
def _(s):
    folder = menu_folder(s, AS_OF)
    before = stored(N.snapshot_read(s.spark, folder).agg((F.count(F.lit(1)) > 0).alias("had_rows")), "before")
    N.snapshot_clear(s.spark, folder)
    left = N.snapshot_read(s.spark, folder).agg(F.count(F.lit(1)).cast("int").alias("n_left"))
    return before.select("had_rows", left.scalar().alias("n_left"))


# -- change feed -----------------------------------------------------------------------------------

def event_stream(s):
    schema = s.table("events").schema
    return as_changes(G.change_source(s.spark, s.folder, schema, pattern="events.parquet"))


@query("change_source", "select op, count(*) n, cast(sum(payload) as double) total from log group by op")
def _(s):
    folder, checkpoint = fresh_folder(s.spark, "feed"), fresh_folder(s.spark, "feed-checkpoint")
    stream = event_stream(s).writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(folder)
    stream.awaitTermination()
    landed = s.spark.read.parquet(folder)
    return landed.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").cast("double").alias("total"))


STATE_SQL = """
select user_id, event_id, op, cast(payload as double) payload from log
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and op <> 'delete'"""


@query("state_as_of", STATE_SQL)
def state_as_of(s):
    state = G.state_as_of(s.changes(), "user_id", ORDER)
    return state.select("user_id", "event_id", "op", F.col("payload").cast("double").alias("payload"))


@query("change_apply", STATE_SQL)
def _(s):
    folder, checkpoint = fresh_folder(s.spark, "state"), fresh_folder(s.spark, "state-checkpoint")
    G.change_apply(event_stream(s), folder, checkpoint, "user_id", ORDER).awaitTermination()
    state = G.current_state(s.spark, folder, "user_id", ORDER)
    return state.select("user_id", "event_id", "op", F.col("payload").cast("double").alias("payload"))


def item_changes(s):
    """The last event of each user as a change of the item with that key: it moves and gets a new price."""
    last = G.latest_per_key(s.table("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ORDER)
    return last.select(F.col("user_id").alias("id"), (F.col("event_id") % 25).alias("category_id"),
                       F.col("value").cast("decimal(10,2)").alias("price"), "event_type")


@query("refresh_affected", """
, last as (select user_id k, event_id % 25 c, cast(value as decimal(10,2)) p, event_type from events
  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
now as (select id, name, coalesce(c, category_id) category_id, coalesce(p, price) price, is_available, badge, sort_order
        from it left join last on id = k where k is null or event_type <> 'error'),
hit as (select category_id h from it join last on id = k union select c from last),
fresh as (select i.id, i.name, i.category_id, c.slug,
                   row_number() over (partition by i.category_id order by not i.is_available, i.sort_order, i.name, i.id) pos,
                   case when price = floor(price) then cast(cast(price as bigint) as varchar)
                        else cast(price as varchar) end || ' ETB' price_label,
                   case when not i.is_available then 'SOLD OUT' when badge = 'new' then 'NEW'
                        when badge = 'hot' then 'HOT' else '' end badge_label
            from now i join cat c on i.category_id = c.id where c.is_active and i.category_id in (select h from hit))
""" + MENU_TEXT_SQL.format(source="fresh"))
def _(s):
    changes, before = item_changes(s), s.items()
    kept = delete_rows(before, changes.where("event_type = 'error'"))
    after = update_patch(kept, changes.where("event_type <> 'error'"), "id", ["category_id", "price"])
    affected = G.affected_categories(before, changes)
    return flat_pages(G.refresh_affected(after, s.categories(), affected))


# -- the catalog's own edits -----------------------------------------------------------------------

FEED_TABLES = {name: CATALOG_TABLES[name] for name in ("categories", "menu_items", "cafe_info")}
GONE = "brand-11"     # the category that an owner deletes
MEASURES = {"n_items": "1L", "n_available": "cast(is_available as long)", "total_price": "price"}


def fitted(rows, name):
    """Rows in a catalog table's schema; columns they don't have are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in CATALOG_TABLES[name]])


def edited_catalog(s):
    """Brands and parts taken over as a catalog, then edited by its owner in five statements; and its feed's folder."""
    spark, when = s.spark, F.lit(CREATED).cast("timestamp")
    later = F.lit(NOW).cast("timestamp")
    shop, feed = Catalog(spark, fresh_folder(spark, "shop")), fresh_folder(spark, "shop-feed")
    one = s.brands().agg(F.lit(1).alias("id"), F.lit("ETB").alias("currency"), F.lit("Parts").alias("name"))
    owner = one.select(F.lit("owner").alias("user_id"))
    loaded = {"categories": s.brands(), "menu_items": s.parts(), "cafe_info": one}
    dated = {name: fitted(rows.withColumn("updated_at", when), name) for name, rows in loaded.items()}
    shop.load(dated | {"admin_users": fitted(owner, "admin_users")})
    doubled = s.parts().where("id % 5 = 0").select(F.col("id").cast("string").alias("id"), (F.col("price") * 2).cast("decimal(10,2)").alias("price"))
    shop.update("menu_items", doubled, "owner", later)
    shop.delete("categories", s.brands().where(F.col("slug") == GONE).select("id"), "owner", later)
    shop.delete("menu_items", s.parts().where("id % 7 = 0").select(F.col("id").cast("string").alias("id")), "owner", later)
    fresh = s.brands().where(F.col("slug") != GONE).select(
        F.concat(F.lit("new-"), "slug").alias("id"), F.col("id").alias("category_id"), "name", F.lit(1).cast("decimal(10,2)").alias("price"))
    shop.insert("menu_items", fresh, "owner", later)
    shop.save_info(one.select(F.lit("Renamed").alias("name")), "owner", later)
    E.publish(spark, shop.folder, feed, FEED_TABLES, KEYS)
    return shop, feed


EDITED_SQL = """
, gone as (select id from brand where slug = 'brand-11'),
doubled as (select cast(id as varchar) id, category_id, id k, name, case when id % 5 = 0 then price * 2 else price end price from parts),
freed as (select id, k, name, price, case when category_id in (select id from gone) then null else category_id end category_id from doubled),
added as (select 'new-' || slug id, id category_id, name, 1.0 price from brand where slug <> 'brand-11'),
final as (select id, category_id, name, cast(price as double) price from freed where k % 7 <> 0
          union all select id, category_id, name, cast(price as double) from added)
"""


@query("catalog_feed", EDITED_SQL + """
select 1 "commit", 'categories' tbl, id "key", 'insert' op, null::double old_price, null::double new_price, null old_category, null new_category from brand
union all select 1, 'menu_items', cast(id as varchar), 'insert', null, cast(price as double), null, category_id from parts
union all select 1, 'cafe_info', '1', 'insert', null, null, null, null
union all select 2, 'menu_items', cast(p.id as varchar), 'update', cast(p.price as double), cast(p.price * 2 as double), category_id, category_id
  from parts p where p.id % 5 = 0
union all select 3, 'categories', id, 'delete', null, null, null, null from gone
union all select 3, 'menu_items', id, 'update', cast(price as double), cast(price as double), category_id, null
  from doubled where category_id in (select id from gone)
union all select 4, 'menu_items', id, 'delete', cast(price as double), null, category_id, null from freed where k % 7 = 0
union all select 5, 'menu_items', id, 'insert', null, cast(price as double), null, category_id from added
union all select 6, 'cafe_info', '1', 'update', null, null, null, null""")
def _(s):
    """Every change of three tables, as it comes through the stream."""
    _, feed = edited_catalog(s)
    landed, checkpoint = fresh_folder(s.spark, "landed"), fresh_folder(s.spark, "landed-checkpoint")
    E.feed_source(s.spark, feed, FEED_TABLES).writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(landed).awaitTermination()
    item = F.col("menu_items")
    return s.spark.read.parquet(landed).select(
        F.col("commit").cast("int").alias("commit"), F.col("table").alias("tbl"), "key", "op",
        item["old"]["price"].cast("double").alias("old_price"), item["new"]["price"].cast("double").alias("new_price"),
        item["old"]["category_id"].alias("old_category"), item["new"]["category_id"].alias("new_category"))


def replayed(s, after=None):
    """State of the items after replaying the feed, two files a batch; `after(folder)` gives a hook."""
    _, feed = edited_catalog(s)
    state, checkpoint = fresh_folder(s.spark, "shop-state"), fresh_folder(s.spark, "shop-checkpoint")
    items = E.of_table(E.feed_source(s.spark, feed, FEED_TABLES, files_per_batch=2), "menu_items")
    G.change_apply(items, state, checkpoint, "id", E.ORDER, after=after and after(state)).awaitTermination()
    return state


@query("catalog_replay", EDITED_SQL + "select * from final")
def _(s):
    state = G.current_state(s.spark, replayed(s), "id", E.ORDER)
    return state.select("id", "category_id", "name", F.col("price").cast("double").alias("price"))


@query("maintained_counts", EDITED_SQL + """
select category_id, count(*) n_items, count(*) n_available, cast(sum(cast(price as decimal(18,2))) as double) total_price from final group by category_id""")
def _(s):
    """Counts per category from signed deltas of the feed; rows without a category are the null group."""
    counters = fresh_folder(s.spark, "counters")
    replayed(s, lambda state: M.counter_keeper(state, counters, "id", E.ORDER, "category_id", MEASURES))
    counts = M.current_counters(s.spark, counters, "category_id", list(MEASURES)).where("n_items <> 0")
    return counts.withColumn("total_price", F.col("total_price").cast("double"))
