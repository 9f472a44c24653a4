"""Set-based writes, access rules and audits over the star tables."""

from pyspark.sql import functions as F

from shelfmark.fixed_values import ITEM_DEFAULTS
from shelfmark.operators import access as A
from shelfmark.operators import audit as U
from shelfmark.operators import changes as C
from shelfmark.operators.listing import union_all
from shelfmark.plans.read_queries import ORDER_NAMES_SQL, order_names
from shelfmark.plans.registry import query
from shelfmark.plans.star import NOW, moment
from shelfmark.sources import versions
from shelfmark.sources.workspace import fresh_folder



def touch():
    return "updated_at", moment(NOW)


def defaults(table: dict):
    return {name: F.lit(value) for name, value in table.items()}


def shown(items, *more):
    """Item columns that both engines print alike."""
    extra = [F.col(c) if isinstance(c, str) else c for c in more]
    return items.select("id", "category_id", "name", F.col("price").cast("double").alias("price"), "badge",
                        "is_available", "sort_order", *extra)


def is_touched():
    return (F.col("updated_at") == moment(NOW)).alias("touched")


SHOWN_SQL = "id, category_id, name, cast(price as double) price, badge, is_available, sort_order"


# -- inserts, patches, deletes ---------------------------------------------------------------------

@query("insert_defaults", f"""
select {SHOWN_SQL}, description from it union all
select 1000000 + s_suppkey, null, s_name, 0.0, null, true, 0, case when s_nationkey < 12 then 'given' else 'fallback' end
from supplier""")
def _(s):
    named = F.when(F.col("s_nationkey") < 12, F.array(*map(F.lit, ["id", "name", "badge", "description"]))) \
        .otherwise(F.array(*map(F.lit, ["id", "name", "badge"])))
    batch = s.table("supplier").select(
        (F.lit(1000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("badge"), F.lit("given").alias("description"), named.alias("patch_cols"))
    rules = {**defaults(ITEM_DEFAULTS), "description": F.lit("fallback"), "badge": F.lit("new")}
    return shown(C.insert_defaults(s.items(), batch, rules, patch_cols="patch_cols"), "description")


def event_patches(s):
    """Events as single-row patches in event order; each kind of event sets its own columns."""
    kind = F.col("event_type")

    def names(*columns):
        return F.array(*map(F.lit, columns))

    sets = F.when(kind == "purchase", names("price")).when(kind == "view", names("badge")) \
        .when(kind == "click", names("is_available", "price")).otherwise(F.array().cast("array<string>"))
    return s.table("events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), sets.alias("patch_cols"),
        F.col("value").cast("decimal(10,2)").alias("price"), F.when(F.col("value") > 5, F.lit("hot")).alias("badge"),
        (F.col("value") > 10).alias("is_available"))


PATCHED_SQL = """
e as (select user_id k, event_id n, event_type t, cast(value as decimal(10,2)) p,
             {'v': case when value > 5 then 'hot' end} b, value > 10 a from events),
f as (select k, arg_max(p, n) filter (t in ('purchase', 'click')) p, arg_max(b, n) filter (t = 'view') b,
             arg_max(a, n) filter (t = 'click') a from e group by k)"""


@query("update_patch", f"""
, {PATCHED_SQL}
select id, category_id, name, cast(coalesce(p, price) as double) price,
       case when b is not null then b.v else badge end badge,
       coalesce(a, is_available) is_available, sort_order, k is not null touched from it left join f on id = k""")
def _(s):
    patched = C.update_patch(s.dated_items(), event_patches(s), "id", ["price", "badge", "is_available"],
                             seq="seq", patch_cols="patch_cols", touch=touch())
    return shown(patched, is_touched())


@query("set_availability", """
select id, name, coalesce(on_sale, is_available) is_available, k is not null touched from it left join
(select user_id k, coalesce(arg_max({'v': value > 10}, event_id).v, false) on_sale from events group by user_id) on id = k""")
def _(s):
    batch = s.table("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
                                     (F.col("value") > 10).cast("int").alias("is_available"))
    rows = C.set_availability(s.dated_items(), batch, seq="seq", touch=touch())
    return rows.select("id", "name", "is_available", is_touched())


@query("delete_rows", "select id, name from it where id not in (select user_id from events where event_type = 'error')")
def _(s):
    gone = s.table("events").where("event_type = 'error'").select(F.col("user_id").alias("id"))
    return C.delete_rows(s.items(), gone).select("id", "name")


@query("upsert", """
, b as (select o_custkey * 2 k, cast(max(o_totalprice) as decimal(10,2)) p from orders group by 1)
select coalesce(id, k) id, category_id, case when k is null then name else 'Order name ' || k end name,
       cast(coalesce(p, price) as double) price, badge, coalesce(is_available, true) is_available,
       coalesce(sort_order, 0) sort_order, id is not null and k is not null touched from it full join b on id = k""")
def upsert(s):
    key = (F.col("o_custkey") * 2).alias("id")
    batch = s.table("orders").groupBy(key).agg(F.max("o_totalprice").cast("decimal(10,2)").alias("price")) \
        .withColumn("name", F.concat(F.lit("Order name "), F.col("id").cast("string")))
    rules = {**defaults(ITEM_DEFAULTS), "updated_at": moment("2024-01-01 00:00:00")}
    return shown(C.upsert(s.dated_items(), batch, "id", rules, touch=touch()), is_touched())


@query("insert_if_absent", """
, old as (select distinct p_name name, cast(-1 as bigint) id, 'kept' category_id from part where p_brand = 'Brand#1' and p_size < 26)
select name, id, category_id from old union all
select name, min(id), arg_min(category_id, id) from parts where name not in (select name from old) group by name""")
def _(s):
    stored = s.table("part").where((F.col("p_brand") == "Brand#1") & (F.col("p_size") < 26)) \
        .select(F.col("p_name").alias("name"), F.lit(-1).cast("bigint").alias("id"), F.lit("kept").alias("category_id")).distinct()
    batch = s.parts().select("name", "id", "category_id", F.col("id").alias("seq"))
    return C.insert_if_absent(stored, batch, "name", "seq")


@query("seed_load", f"""
select id, category_id, name, cast(price as double) price, is_available from it union all
select 10000000 + seq, c.id, n.name, cast(price as double), true from {ORDER_NAMES_SQL} n join cat c using (slug)
where n.name not in (select name from it)""")
def _(s):
    seed = order_names(s).withColumn("id", F.lit(10000000) + F.col("seq"))
    rows = C.seed_load(s.items(), seed, s.categories(), defaults=defaults(ITEM_DEFAULTS))
    return rows.select("id", "category_id", "name", F.col("price").cast("double").alias("price"), "is_available")


@query("delete_set_null", """
select id, case when category_id in (select id from cat where region = 1) then null else category_id end category_id,
       coalesce(category_id in (select id from cat where region = 1), false) touched from it""")
def _(s):
    rows = C.delete_set_null(s.dated_items(), s.categories().where("region = 1"), touch=touch())
    return rows.select("id", "category_id", is_touched())


@query("delete_cascade", "select user_id, email from owner where user_id not in (select id from usr where not confirmed)")
def _(s):
    gone = s.users().where(F.col("email_confirmed_at").isNull())
    return C.delete_cascade(s.owners(), gone).select("user_id", "email")


@query("touch_updated_at", """
select id, case when badge = 'new' then '2024-06-01 12:00:00' else '2024-01-01 00:00:00' end updated_at from it""")
def _(s):
    updated = F.coalesce(F.col("badge") == "new", F.lit(False))
    rows = C.touch_updated_at(s.dated_items(), updated, moment(NOW))
    return rows.select("id", F.col("updated_at").cast("string").alias("updated_at"))


@query("constraint_check", """
select 'price not negative' rule, cast(id as varchar) "key" from it where price < 0 union all
select 'badge known', cast(id as varchar) from it where badge not in ('new') union all
select 'category_id missing', cast(id as varchar) from it where category_id is null union all
select 'description unique', description from it group by description having count(*) > 1 union all
select 'category_id reference', cast(id as varchar) from it where category_id in (select id from cat where region = 2)""")
def constraint_check(s):
    return C.constraint_check(
        s.items(), "id", {"price not negative": F.col("price") >= 0, "badge known": F.col("badge").isin("new")},
        required=["category_id"], unique=["name", "description"],
        references={"category_id": (s.categories().where("region <> 2"), "id")})


@query("quarantine", """
, rows as (select case when id % 50 <> 0 then id end id, name, id % 1400 code, category_id, price, badge from it)
select id, name, price < 0 or coalesce(badge = 'hot', false) or category_id is null
       or count(*) over (partition by code) > 1 or category_id in (select id from cat where region = 2) refused
from rows""")
def _(s):
    """Rows of which some have no key and some share a code."""
    rows = s.items().withColumn("code", F.col("id") % 1400).withColumn("id", F.when(F.col("id") % 50 != 0, F.col("id")))
    clean, refused = C.quarantine(
        rows, {"price not negative": F.col("price") >= 0, "badge known": F.col("badge").isin("new")},
        required=["category_id"], unique=["code"], references={"category_id": (s.categories().where("region <> 2"), "id")})
    return clean.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True))) \
        .select("id", "name", "refused")


# -- owner grants ----------------------------------------------------------------------------------

def grant_requests(s):
    number = F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0")
    return s.table("orders").select(F.concat(F.lit("CUSTOMER#"), number).alias("email")).distinct()


GRANTS_SQL = """
g as (select r.email email, usr.id user_id, case when usr.id is null then 'missing' when not confirmed then 'unconfirmed' else 'granted' end outcome
      from (select distinct 'CUSTOMER#' || lpad(cast(o_custkey * 2 as varchar), 9, '0') email from orders) r
      left join usr on lower(usr.email) = lower(r.email))"""


@query("grant_outcomes", f", {GRANTS_SQL} select email, user_id, outcome from g")
def _(s):
    return C.grant_outcomes(grant_requests(s), s.users())


@query("grant_owner", f""", {GRANTS_SQL}
select coalesce(o.user_id, g.user_id) user_id, coalesce(g.email, o.email) email, coalesce(full_name, 'granted owner') full_name
from owner o full join (select * from g where user_id is not null) g on g.user_id = o.user_id""")
def _(s):
    outcomes = C.grant_outcomes(grant_requests(s), s.users())
    return C.grant_owner(s.owners(), outcomes, "granted owner", moment(NOW)).select("user_id", "email", "full_name")


@query("revoke_owner", """
select user_id, email from owner where lower(email) not in (select 'owner' || n_nationkey || '@example.com' from nation)""")
def _(s):
    gone = s.table("nation").select(F.concat(F.lit("OWNER"), F.col("n_nationkey").cast("string"), F.lit("@EXAMPLE.com")).alias("email"))
    return C.revoke_owner(s.owners(), gone).select("user_id", "email")


# -- access ----------------------------------------------------------------------------------------

@query("visible_rows", """
select 'anon' viewer, 'categories' tbl, id from cat where is_active union all
select 'member', 'categories', id from cat where is_active union all select 'owner', 'categories', id from cat union all
select v, 'menu_items', id from it, (values ('anon'), ('member'), ('owner')) t(v) union all
select 'owner', 'admin_users', user_id from owner where user_id = 0""")
def _(s):
    viewers = {"anon": None, "member": 1, "owner": 0}
    tables = {"categories": (s.categories(), "id"), "menu_items": (s.items(), "id"), "admin_users": (s.owners(), "user_id")}
    parts = [A.visible_rows(tbl, df, s.owners(), user).select(F.lit(viewer).alias("viewer"), F.lit(tbl).alias("tbl"), F.col(key).alias("id"))
             for viewer, user in viewers.items() for tbl, (df, key) in tables.items()]
    return union_all(parts)


OUTCOME_SQL = """case when user_id in (select user_id from owner) and tbl <> 'admin_users' and not (tbl = 'cafe_info' and op = 'delete')
       then 'allowed' when op = 'insert' then 'rejected' else 'no_rows' end"""


@query("authorize_changes", f"select event_id, user_id, op, tbl, {OUTCOME_SQL} outcome from req")
def authorize_changes(s):
    return A.authorize_changes(s.requests(), s.owners())


@query("policy_matrix", f"""
, d as (select *, {OUTCOME_SQL} outcome, case when user_id in (select user_id from owner) then 'owner' else 'member' end role from req),
m as (select role, tbl, op, case when role = 'owner' and tbl <> 'admin_users' and not (tbl = 'cafe_info' and op = 'delete') then 'allowed'
        when op = 'insert' then 'rejected' else 'no_rows' end expected
      from (values ('anon'), ('member'), ('owner')) r(role),
           (values ('menu_items'), ('categories'), ('cafe_info'), ('admin_users'), ('objects')) t(tbl),
           (values ('insert'), ('update'), ('delete')) o(op))
select m.role, m.tbl, m.op, expected, count(d.event_id) n_requests, count(*) filter (where outcome <> expected) n_unexpected
from m left join d using (role, tbl, op) group by all""")
def _(s):
    decided = A.is_admin_rows(A.authorize_changes(s.requests(), s.owners()), s.owners(), flag="is_owner")
    role = F.when(F.col("is_owner"), F.lit("owner")).otherwise(F.lit("member"))
    return A.policy_coverage(decided.withColumn("role", role))


# -- audit -----------------------------------------------------------------------------------------

def table_checks(s):
    stranger = A.visible_rows("categories", s.categories(), s.owners())
    return U.audit_tables([
        U.check_not_empty("categories", s.categories(), "category", "categories"),
        U.check_not_empty("items", s.items(), "item", "items"),
        U.check_not_empty("negative keys", s.items().where("id < 0"), "item", "items"),
        U.check_singleton("first item", s.items(), "id", 1, "name"),
        U.check_singleton("missing item", s.items(), "id", -1, "name"),
        U.check_none_visible("owners", A.visible_rows("admin_users", s.owners(), s.owners())),
        U.check_none_visible("hidden categories", stranger.where("region = 1")),
    ])


AUDIT_SQL = """
a as (
select 'categories readable' check_name, 'ok' status, count(*) || ' categories found' detail from cat union all
select 'items readable', 'ok', count(*) || ' items found' from it union all
select 'negative keys readable', 'fail', '0 items found' union all
select 'first item row exists', 'ok', max(name) from it where id = 1 union all
select 'missing item row exists', 'fail', 'missing row id=-1' union all
select 'owners not exposed', 'ok', '0 rows visible' union all
select 'hidden categories not exposed', 'warn', count(*) || ' rows visible' from cat where region = 1)"""


@query("audit_tables", f", {AUDIT_SQL} select * from a")
def _(s):
    return table_checks(s)


@query("check_rollup", f""", {AUDIT_SQL} select count(*) n_checks, count(*) filter (where status = 'fail') n_fail, count(*) filter (where status = 'warn') n_warn,
       count(*) filter (where status = 'fail') = 0 passed from a""")
def _(s):
    return U.check_rollup(table_checks(s))


@query("expectations", """
, m as (select count(*) n, count(*) filter (where badge = 'new') b, count(distinct name) d, min(price) p from it)
select r.rule, r.actual, r.expected, coalesce(r.actual = r.expected, false) ok from m, lateral (
  select 'rows' rule, cast(n as varchar) actual, '1500' expected union all select 'new badges', cast(b as varchar), '5' union all
  select 'names unique', cast(n = d as varchar), 'true' union all select 'price floor', cast(p >= 0 as varchar), 'true') r""")
def _(s):
    return U.expectations(s.items(), {
        "rows": (F.count(F.lit(1)), 1500), "new badges": (F.count_if(F.col("badge") == "new"), 5),
        "names unique": (F.count(F.lit(1)) == F.countDistinct("name"), "true"), "price floor": (F.min("price") >= 0, "true")})


@query("seed_diff", f"""
select n.name, count(*) n_added from {ORDER_NAMES_SQL} n join cat using (slug)
where n.name not in (select name from it) group by n.name""")
def _(s):
    """What a first load changes; loading the same seed again on the stored result changes nothing more."""
    seed = order_names(s).withColumn("id", F.lit(0).cast("bigint")).select("id", "name", "slug")
    before = s.items().select(F.lit(0).cast("bigint").alias("id"), "category_id", "name")
    folder = fresh_folder(s.spark, "seeded")
    versions.write_version(C.seed_load(before, seed, s.categories()), folder)
    once = versions.read_version(s.spark, folder)
    twice = C.seed_load(once, seed, s.categories())
    first = U.seed_diff(before.select("name"), once.select("name"))
    return first.unionByName(U.seed_diff(once.select("name"), twice.select("name")))
