"""Scans, filters, listings, counts and orders over the star tables."""

from pyspark.sql import functions as F

from shelfmark.functions import labels as L
from shelfmark.functions.text import count_label
from shelfmark.operators import listing as R
from shelfmark.operators.access import is_admin_rows
from shelfmark.operators.changes import email_lookup, seed_new_only, seed_resolve, update_patch
from shelfmark.operators.ranking import position_within
from shelfmark.plans.registry import query
from shelfmark.plans.star import TABLES, moment
from shelfmark.sources import tables as S

LISTED = ["id", "name", "category_id", "pos", "price_label", "badge_label"]
MENU_TEXT_SQL = """
select category_id, slug, (pos - 1) // 500 page, count(*) n_items,
       string_agg(pos || ':' || name || ':' || price_label || ':' || badge_label, '|' order by pos) menu_text
from {source} group by all"""


def flat_pages(pages):
    """Nested pages as text, so that SQL can be compared."""
    line = F.transform("items", lambda x: F.concat_ws(
        ":", x["pos"].cast("string"), x["name"], x["price_label"], x["badge_label"]))
    return pages.select("category_id", "slug", "page", F.size("items").cast("bigint").alias("n_items"),
                        F.concat_ws("|", line).alias("menu_text"))


# -- scans -----------------------------------------------------------------------------------------

@query("scan_ordered", "select id, name, sort_order from it")
def _(s):
    return S.scan_ordered(s.items().select("id", "name", "sort_order"), "sort_order", "id")


@query("read_singleton", "select id, name from it where id = 1")
def _(s):
    return S.read_singleton(s.items().select("id", "name"))


@query("require_single", """
select id, name, cast(p as double) price from it join
  (select arg_max(o_custkey, {'a': o_totalprice, 'b': o_orderkey}) k,
          cast(max(o_totalprice) as decimal(10,2)) p from orders) on id = k""")
def _(s):
    biggest = s.table("orders").agg(
        F.max_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("id"),
        F.max("o_totalprice").cast("decimal(10,2)").alias("price"))
    written = update_patch(s.dated_items(), biggest, "id", ["price"], touch=("updated_at", moment("2024-06-01")))
    affected = S.require_single(written.where(F.col("updated_at") == moment("2024-06-01")))
    return affected.select("id", "name", F.col("price").cast("double").alias("price"))


@query("values_source", """
select badge, count(*) n from customer
join (values ('BUILDING', 'new'), ('MACHINERY', 'hot')) v(segment, badge) on segment = c_mktsegment group by badge""")
def _(s):
    rows = S.values_source(s.spark, [("BUILDING", "new"), ("MACHINERY", "hot")], "c_mktsegment string, badge string")
    return s.table("customer").join(rows, "c_mktsegment").groupBy("badge").agg(F.count(F.lit(1)).alias("n"))


ABSENT = "table_never_made"


def published(s):
    """(table, n_files, n_bytes) of the table files that are really in the folder."""
    files = S.object_manifest(s.spark, s.folder, "*.parquet")
    table = F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return files.groupBy(table.alias("table")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


@query("catalog_checks", " union all ".join(
    f"select '{t}' \"table\", true present" for t in TABLES) + f" union all select '{ABSENT}', false")
def _(s):
    """Which of the expected tables the folder holds; one is not there."""
    return S.catalog_checks(published(s), [*TABLES, ABSENT])


@query("object_manifest", " union all ".join(
    f"select '{t}' \"table\", true has_bytes, count(*) n_rows from {t}" for t in TABLES))
def _(s):
    """The files of the given folder beside the rows of the tables they hold."""
    counted = S.table_rows({t: s.table(t) for t in TABLES})
    return published(s).join(counted, "table").select("table", (F.col("n_bytes") > 0).alias("has_bytes"), "n_rows")


@query("bucket_probe", """
select regexp_extract(url, '://([^/]+)/', 1) bucket_id, min(page_id) first_object, count(*) n_objects from pages group by 1""")
def _(s):
    return S.bucket_probe(s.table("pages").select(F.regexp_extract("url", "://([^/]+)/", 1).alias("bucket_id"), F.col("page_id").alias("name")))


# -- filters ---------------------------------------------------------------------------------------

@query("filter_eq", "select id, name from it where description = 'BUILDING'")
def _(s):
    return R.filter_eq(s.items(), "description", "BUILDING").select("id", "name")


@query("filter_neq", "select id, badge from it where badge <> 'new'")
def _(s):
    return R.filter_neq(s.items(), "badge", "new").select("id", "badge")


@query("filter_is_null", "select id, name from it where category_id is null")
def _(s):
    return R.filter_is(s.items(), "category_id", None).select("id", "name")


@query("active_categories", "select id, slug, name from cat where is_active")
def _(s):
    return R.active_categories(s.categories()).select("id", "slug", "name")


@query("category_filter", "select id, name, category_id from it where category_id = 3")
def _(s):
    return R.category_filter(s.items(), 3).select("id", "name", "category_id")


@query("tab_filter", """
select 'known' tab, id, slug from listing where slug = 'nation-3' union all
select 'hidden' tab, id, slug from listing union all select 'all' tab, id, slug from listing""")
def _(s):
    shown = R.in_active_category(s.items(), s.categories()).select("id", "slug")
    tabs = {"known": "nation-3", "hidden": "nation-5", "all": "all"}
    parts = [R.tab_filter(shown, s.categories(), slug).select(F.lit(tab).alias("tab"), "id", "slug")
             for tab, slug in tabs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("text_search", """
select id, name, description from parts
where contains(lower(name), lower('RED')) or contains(lower(coalesce(description, '')), lower('RED'))""")
def _(s):
    return R.text_search(s.parts(), "RED").select("id", "name", "description")


@query("unassigned_excluded", "select id, category_id from it where category_id in (select id from cat)")
def _(s):
    return R.unassigned_excluded(s.items(), s.categories()).select("id", "category_id")


@query("compound_predicate", """
select id, name, category_id from parts where category_id = 'Brand#3'
and (contains(lower(name), 'red') or contains(lower(description), 'red'))""")
def _(s):
    return R.owner_search(s.parts(), "Brand#3", "red").select("id", "name", "category_id")


# -- joins -----------------------------------------------------------------------------------------

@query("menu_listing", "select id, name, category_id, pos, price_label, badge_label from listing")
def menu_listing(s):
    return R.menu_listing(s.items(), s.categories()).select(*LISTED)


@query("admin_listing", """
select i.id, i.name, case when c.id is null then 'No category' else ' ' || c.name end || ' • ' || description meta,
       coalesce(c.sort_order, 999) category_order,
       rtrim(rtrim(cast(price as varchar), '0'), '.') || ' ETB' price_label,
       concat_ws(' ', case badge when 'new' then 'NEW' end, case badge when 'hot' then 'HOT' end,
                 case when not is_available then 'SOLD OUT' end) pills
from it i left join cat c on i.category_id = c.id""")
def _(s):
    rows = R.admin_listing(s.items(), s.categories())
    return rows.select("id", "name", "meta", "category_order", "price_label", F.concat_ws(" ", "pills").alias("pills"))


@query("with_currency", """
select id, cur || ':' || id label, cur currency, 'ETB' fallback
from it, (select r_name cur from region where r_regionkey = 1)""")
def _(s):
    info = s.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("currency"))
    rows = R.with_currency(s.items().select("id"), info)
    label = F.concat_ws(":", "currency", F.col("id").cast("string"))
    missing = R.currency_of(info.where("id < 0"))
    return rows.select("id", label.alias("label"), "currency", missing.alias("fallback"))


def seed(s):
    """Suppliers as seed rows; some name a category that does not exist."""
    slug = F.concat(F.lit("nation-"), (F.col("s_suppkey") % 30).cast("string"))
    return s.table("supplier").select(F.col("s_suppkey").alias("seed_id"), F.col("s_name").alias("name"),
                                      slug.alias("slug"), F.col("s_acctbal").alias("price"))


@query("seed_resolve", """
select s_suppkey seed_id, s_name name, s_acctbal price, cat.id category_id
from supplier join cat on slug = 'nation-' || (s_suppkey % 30)""")
def _(s):
    return seed_resolve(seed(s), s.categories()).select("seed_id", "name", "price", "category_id")


def order_names(s):
    """Orders as seed rows named after customers, the last third of them unknown; many names repeat."""
    number = F.lpad((F.col("o_custkey") * 3 / 2).cast("bigint").cast("string"), 9, "0")
    slug = F.concat(F.lit("nation-"), (F.col("o_orderkey") % 30).cast("string"))
    return s.table("orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer#"), number).alias("name"),
                                    slug.alias("slug"), F.col("o_totalprice").cast("decimal(10,2)").alias("price"))


ORDER_NAMES_SQL = """(select o_orderkey seq, 'Customer#' || lpad(cast(o_custkey * 3 // 2 as varchar), 9, '0') name,
    'nation-' || (o_orderkey % 30) slug, cast(o_totalprice as decimal(10,2)) price from orders)"""


@query("seed_new_only", f"select seq, name from {ORDER_NAMES_SQL} where name not in (select name from it)")
def _(s):
    return seed_new_only(order_names(s).select("seq", "name"), s.items()).select("seq", "name")


@query("is_admin_rows", "select event_id, user_id from req where user_id in (select user_id from owner)")
def _(s):
    return is_admin_rows(s.requests(), s.owners()).select("event_id", "user_id")


@query("email_lookup", """
select n_nationkey, id from nation join usr on lower(email) = lower('CUSTOMER#' || lpad(cast(n_nationkey as varchar), 9, '0'))""")
def _(s):
    address = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0"))
    wanted = s.table("nation").select("n_nationkey", address.alias("email"))
    return email_lookup(wanted, s.users()).select("n_nationkey", F.col("user.id").alias("id"))


@query("orphan_items", """
select i.id, case when category_id is null then 'unassigned' else 'dangling' end reason
from it i where category_id is null or category_id not in (select id from cat where region <> 2)""")
def _(s):
    return R.orphan_items(s.items(), s.categories().where("region <> 2")).select("id", "reason")


@query("orphaned_by_delete", """
select c.id category_id, count(i.id) n_items from cat c left join it i on i.category_id = c.id
where region = 2 group by c.id""")
def _(s):
    return R.orphaned_by_delete(s.items(), s.categories().where("region = 2"))


@query("empty_categories", "select id, name, is_active from cat where id not in (select category_id from it where category_id is not null)")
def _(s):
    return R.empty_categories(s.categories(), s.items()).select("id", "name", "is_active")


# -- aggregates ------------------------------------------------------------------------------------

@query("items_per_category", """
select c.id, c.name, count(i.id) n_items, count(i.id) || case count(i.id) when 1 then ' item' else ' items' end label
from cat c left join it i on i.category_id = c.id group by c.id, c.name""")
def _(s):
    counts = R.items_per_category(s.categories(), s.items())
    return counts.select("id", "name", "n_items", count_label("n_items", "item", "items").alias("label"))


@query("totals", """
select 'categories' "table", count(*) n from cat union all select 'items', count(*) from it
union all select 'listing', count(*) from listing""")
def _(s):
    return R.totals({"categories": s.categories(), "items": s.items(),
                     "listing": R.in_active_category(s.items(), s.categories())})


@query("conditional_counts", """
select count(*) filter (where category_id is not null) assigned, count(*) filter (where badge = 'new') badge_new,
       count(*) filter (where not is_available) sold_out from it""")
def _(s):
    return R.conditional_counts(s.items(), {
        "assigned": F.col("category_id").isNotNull(), "badge_new": F.col("badge") == "new",
        "sold_out": ~L.is_on("is_available")})


@query("category_menu", MENU_TEXT_SQL.format(source="listing"))
def category_menu(s):
    return flat_pages(R.category_menu(s.items(), s.categories()))


@query("next_sort_order", "select count(*) + 1 next_sort_order from it")
def _(s):
    return R.next_sort_order(s.items())


# -- positions and orders --------------------------------------------------------------------------

@query("item_position", """
select id, category_id, row_number() over (partition by category_id
  order by not is_available, sort_order, name, id) pos from it""")
def _(s):
    return R.item_position(s.items()).select("id", "category_id", "pos")


@query("category_order", "select id, row_number() over (order by sort_order, name, id) section from cat")
def _(s):
    return R.category_position(s.categories()).select("id", "section")


@query("item_order", """
select id, category_id, name, row_number() over (partition by category_id order by sort_order, name, id) pos from parts""")
def _(s):
    return R.item_position(s.parts()).select("id", "category_id", "name", "pos")


@query("admin_order", """
select i.id, i.name, row_number() over (order by coalesce(c.sort_order, 999), i.sort_order, i.name, i.id) pos
from it i left join cat c on i.category_id = c.id""")
def _(s):
    rows = R.admin_listing(s.items(), s.categories())
    return position_within(rows, [], R.admin_order()).select("id", "name", "pos")


@query("order_one_column", "select user_id, email from owner")
def _(s):
    return R.order_one_column(s.owners().select("user_id", "email"), "email", "user_id", descending=True)


@query("limit_n", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 1")
def _(s):
    docs = s.table("documents").select("doc_id", "n_chars")
    return R.limit_n(docs, [F.desc("n_chars"), F.col("doc_id")], 1)


@query("nav_tabs", """
select cast(0 as bigint) pos, 'all' slug, '🔥 All' label union all
select row_number() over (order by sort_order, name, id), slug, '🍽 ' || name from cat where is_active""")
def _(s):
    return R.nav_tabs(s.categories())
