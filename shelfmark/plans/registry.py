"""Registry of verified queries: each a Spark plan over the star tables, with its SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The catalog views of shelfmark.plans.star in SQL.
VIEWS = """
cat as (select cast(n_nationkey as bigint) id, replace(lower(n_name), '_', '-') slug, n_name name,
               n_regionkey * 100 + n_nationkey sort_order, n_regionkey <> 0 is_active, n_regionkey region
        from nation),
it as (select c_custkey id, cast(nullif(c_nationkey, 7) as bigint) category_id, c_name name,
              c_mktsegment description, cast(c_acctbal as decimal(10,2)) price, c_acctbal >= 0 is_available,
              case c_mktsegment when 'BUILDING' then 'new' when 'MACHINERY' then 'hot' end badge,
              cast(c_custkey % 10 as int) sort_order
       from customer),
brand as (select p_brand id, replace(lower(p_brand), '#', '-') slug, p_brand name, min(p_size) sort_order
          from part group by p_brand),
parts as (select p_partkey id, p_brand category_id, p_name name, p_type description,
                 cast(p_retailprice as decimal(10,2)) price, p_size sort_order from part),
log as (select user_id, ts, event_id, cast(value as decimal(10,2)) payload,
               case event_type when 'error' then 'delete' when 'signup' then 'insert' else 'update' end op
        from events),
req as (select event_id, user_id,
               case event_type when 'error' then 'delete' when 'signup' then 'insert' else 'update' end op,
               case event_id % 4 when 0 then 'menu_items' when 1 then 'categories'
                                 when 2 then 'cafe_info' else 'admin_users' end tbl
        from events),
owner as (select distinct user_id, 'Owner' || user_id || '@Example.com' email, 'first owner' full_name
          from events where user_id % 25 = 0),
usr as (select c_custkey id, c_name email, c_acctbal >= 0 confirmed from customer),
listing as (select i.id, i.name, i.category_id, c.slug, c.name category_name,
                   row_number() over (partition by i.category_id
                                      order by not i.is_available, i.sort_order, i.name, i.id) pos,
                   case when price = floor(price) then cast(cast(price as bigint) as varchar)
                        else cast(price as varchar) end || ' ETB' price_label,
                   case when not i.is_available then 'SOLD OUT' when badge = 'new' then 'NEW'
                        when badge = 'hot' then 'HOT' else '' end badge_label
            from it i join cat c on i.category_id = c.id where c.is_active)
"""


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a plan under its name. `sql` may use the catalog views."""
    def register(plan: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Star(spark, folder))
        if sql is not None:
            ORACLES[name] = f"with {VIEWS.strip()}\n{sql.strip()}" if views else sql.strip()
        return plan
    return register
