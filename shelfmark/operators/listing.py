"""Reading a catalog: filters, listings, counts, orphans and the nested menu.

Joins carry no broadcast hints: Spark broadcasts a side whose size it has checked and otherwise
shuffles, splitting skewed partitions at run time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions import labels as L
from shelfmark.functions.text import filled
from shelfmark.operators.ranking import position_within
from shelfmark.schemas import CATEGORIES, ITEMS, CategoryCols, ItemCols

PAGE_SIZE = 500


# -- filters ---------------------------------------------------------------------------------------

def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_neq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose value differs; as in SQL a null neither equals nor differs."""
    return df.where(F.col(column) != F.lit(value))


def filter_is(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def active_categories(categories: DataFrame, c: CategoryCols = CATEGORIES) -> DataFrame:
    return categories.where(L.is_on(c.active))


def category_filter(items: DataFrame, category=None, i: ItemCols = ITEMS) -> DataFrame:
    return items if category in (None, "") else items.where(F.col(i.category) == F.lit(category))


def tab_filter(sections: DataFrame, categories: DataFrame, target: str,
               slug: str = "slug", c: CategoryCols = CATEGORIES) -> DataFrame:
    """Sections of one tab. 'all', or a slug no active category has, shows every section."""
    known = active_categories(categories, c).where(F.col(c.slug) == target)
    return sections.where((F.col(slug) == target) | ~known.exists())


def text_search(items: DataFrame, query: str, i: ItemCols = ITEMS) -> DataFrame:
    """Literal substring of name or description in any letter case; an empty query keeps all."""
    if not query:
        return items
    wanted = F.lower(F.lit(query))
    return items.where(F.contains(F.lower(i.name), wanted)
                       | F.contains(F.lower(F.coalesce(i.description, F.lit(""))), wanted))


def owner_search(items: DataFrame, category=None, query: str = "", i: ItemCols = ITEMS) -> DataFrame:
    return text_search(category_filter(items, category, i), query, i)


# -- orders ----------------------------------------------------------------------------------------

def by_locale(name) -> Column:
    """Sort key only: a collated column must not reach the output."""
    return F.collate(F.col(name), "UNICODE")


def category_order(c: CategoryCols = CATEGORIES) -> list[Column]:
    return [L.or_zero(c.order), by_locale(c.name), F.col(c.id)]


def item_order(i: ItemCols = ITEMS) -> list[Column]:
    """What can be had now leads; the owner's numbers and then the names arrange the rest."""
    return [~L.is_on(i.available), L.or_zero(i.order), by_locale(i.name), F.col(i.id)]


def admin_order(category_sort: str = "category_order", i: ItemCols = ITEMS) -> list[Column]:
    """Category first; sold-out items keep their place."""
    return [F.col(category_sort), L.or_zero(i.order), by_locale(i.name), F.col(i.id)]


def order_one_column(df: DataFrame, column: str, tie_break: str, descending: bool = False) -> DataFrame:
    """Total order: the tie break also lets the sort cut a value that many rows share."""
    key = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, tie_break)


def limit_n(df: DataFrame, order: list, n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def item_position(items: DataFrame, i: ItemCols = ITEMS, name: str = "pos") -> DataFrame:
    return position_within(items, [i.category], item_order(i), name)


def category_position(categories: DataFrame, c: CategoryCols = CATEGORIES, name: str = "section") -> DataFrame:
    return position_within(categories, [], category_order(c), name)


# -- joins -----------------------------------------------------------------------------------------

def category_side(categories: DataFrame, c: CategoryCols = CATEGORIES) -> DataFrame:
    """Category columns under names that cannot clash with item columns."""
    optional = {"category_emoji": c.emoji, "category_order": c.order}
    return categories.select(
        F.col(c.id).alias("_cat_id"), F.col(c.slug).alias("slug"), F.col(c.name).alias("category_name"),
        *[F.col(source).alias(name) for name, source in optional.items() if source in categories.columns])


def in_active_category(items: DataFrame, categories: DataFrame, i: ItemCols = ITEMS,
                       c: CategoryCols = CATEGORIES) -> DataFrame:
    """Items with their active category; uncategorised items and items of hidden categories drop out."""
    cats = category_side(active_categories(categories, c), c)
    return items.join(cats, items[i.category] == cats["_cat_id"]).drop("_cat_id")


def unassigned_excluded(items: DataFrame, categories: DataFrame, i: ItemCols = ITEMS,
                        c: CategoryCols = CATEGORIES) -> DataFrame:
    keys = categories.select(F.col(c.id).alias(i.category))
    return items.join(keys, i.category, "left_semi")


def currency_of(info: DataFrame, currency: str = "currency", id_col: str = "id") -> Column:
    """The singleton's currency as a scalar subquery: no row or no text gives the default."""
    return L.currency_or_default(info.where(F.col(id_col) == 1).select(currency).scalar())


def with_currency(df: DataFrame, info: DataFrame, currency: str = "currency", id_col: str = "id") -> DataFrame:
    return df.withColumn("currency", currency_of(info, currency, id_col))


def shown_items(items: DataFrame, currency: Column | None = None, i: ItemCols = ITEMS) -> DataFrame:
    """Categorised items with their position, price label and badge.

    A category is shown whole or not at all, so its items may be filtered before they are numbered.
    """
    placed = item_position(items.where(F.col(i.category).isNotNull()), i)
    return placed.withColumn("price_label", L.format_price(i.price, currency)) \
        .withColumn("badge_label", L.display_badge(i.available, i.badge))


def menu_listing(items: DataFrame, categories: DataFrame, currency: Column | None = None, i: ItemCols = ITEMS,
                 c: CategoryCols = CATEGORIES) -> DataFrame:
    """The reader's listing: each shown item with its category, position, price label and badge."""
    active = unassigned_excluded(items, active_categories(categories, c), i, c)
    return in_active_category(shown_items(active, currency, i), categories, i, c)


def admin_listing(items: DataFrame, categories: DataFrame, currency: Column | None = None, i: ItemCols = ITEMS,
                  c: CategoryCols = CATEGORIES) -> DataFrame:
    """The owner's listing: every item, with 'No category' sorted last where none matches."""
    cats = category_side(categories, c).withColumn("_matched", F.lit(True))
    joined = items.join(cats, items[i.category] == cats["_cat_id"], "left")
    matched = F.col("_matched").isNotNull()
    emoji = F.coalesce("category_emoji", F.lit("")) if "category_emoji" in cats.columns else F.lit("")
    label = F.when(matched, F.concat(emoji, F.lit(" "), F.col("category_name"))) \
        .otherwise(F.lit(V.NO_CATEGORY_LABEL))
    order = F.when(matched, L.or_zero("category_order")).otherwise(F.lit(V.NO_CATEGORY_ORDER))
    described = F.concat_ws(V.SEPARATOR, label, filled(i.description)) if i.description in items.columns else label
    return joined.withColumn("meta", described).withColumn("category_order", order) \
        .withColumn("price_label", L.format_price_raw(i.price, currency)) \
        .withColumn("pills", L.status_pills(i.available, i.badge)) \
        .drop("_cat_id", "_matched", "category_name", "category_emoji", "slug")


def orphan_items(items: DataFrame, categories: DataFrame, i: ItemCols = ITEMS,
                 c: CategoryCols = CATEGORIES) -> DataFrame:
    """Items without a live category. Null keys are set apart, so they never meet in one join task."""
    keys = categories.select(F.col(c.id).alias(i.category))
    unassigned = items.where(F.col(i.category).isNull()).withColumn("reason", F.lit("unassigned"))
    dangling = items.where(F.col(i.category).isNotNull()).join(keys, i.category, "left_anti") \
        .select(*items.columns).withColumn("reason", F.lit("dangling"))
    return unassigned.unionByName(dangling)


def orphaned_by_delete(items: DataFrame, deleted: DataFrame, i: ItemCols = ITEMS, key: str = "id") -> DataFrame:
    """How many items each deleted category would leave without one."""
    keys = deleted.select(F.col(key).alias(i.category)).distinct()
    counts = items.groupBy(i.category).agg(F.count(F.lit(1)).alias("n_items"))
    return keys.join(counts, i.category, "left").select(i.category, L.or_zero("n_items").cast("bigint").alias("n_items"))


def empty_categories(categories: DataFrame, items: DataFrame, i: ItemCols = ITEMS,
                     c: CategoryCols = CATEGORIES) -> DataFrame:
    used = items.select(F.col(i.category).alias(c.id)).where(F.col(c.id).isNotNull()).distinct()
    return categories.join(used, c.id, "left_anti")


# -- aggregates ------------------------------------------------------------------------------------

def items_per_category(categories: DataFrame, items: DataFrame, i: ItemCols = ITEMS,
                       c: CategoryCols = CATEGORIES) -> DataFrame:
    """Item count of every category, 0 included; items are counted before they are joined."""
    counts = items.where(F.col(i.category).isNotNull()).groupBy(F.col(i.category).alias(c.id)) \
        .agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(counts, c.id, "left") \
        .withColumn("n_items", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table as (table, n)."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
              for name, df in tables.items()]
    return union_all(counts)


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])


def next_sort_order(df: DataFrame) -> DataFrame:
    """Default order value of a new row: the row count plus one, not the largest value plus one."""
    return df.agg((F.count(F.lit(1)) + 1).alias("next_sort_order"))


def menu_pages(placed: DataFrame, fields: list[str], i: ItemCols = ITEMS, page_size: int = PAGE_SIZE) -> DataFrame:
    """Nest positioned items into ordered lists, one row per category and page of items.

    A category of any size becomes as many pages as it needs; no row grows with the data.
    """
    page = F.floor((F.col("pos") - 1) / page_size).cast("bigint")
    entry = F.struct("pos", *fields)
    return placed.withColumn("page", page).groupBy(i.category, "page") \
        .agg(F.sort_array(F.collect_list(entry)).alias("items"))


def category_menu(items: DataFrame, categories: DataFrame, currency: Column | None = None, i: ItemCols = ITEMS,
                  c: CategoryCols = CATEGORIES, page_size: int = PAGE_SIZE) -> DataFrame:
    """The nested menu of the active categories. Whole pages meet the categories, not single items."""
    placed = shown_items(unassigned_excluded(items, active_categories(categories, c), i, c), currency, i)
    pages = menu_pages(placed, [i.id, i.name, "price_label", "badge_label"], i, page_size)
    return in_active_category(pages, categories, i, c)


# -- set operations --------------------------------------------------------------------------------

def nav_tabs(categories: DataFrame, c: CategoryCols = CATEGORIES) -> DataFrame:
    """The 'all' tab, then the active categories in order, empty ones included."""
    slug, label = V.ALL_TAB
    first = categories.sparkSession.createDataFrame([(0, slug, label)], "pos bigint, slug string, label string")
    emoji = F.col(c.emoji) if c.emoji in categories.columns else F.lit(None).cast("string")
    rest = category_position(active_categories(categories, c), c, "pos") \
        .select("pos", F.col(c.slug).cast("string").alias("slug"), L.emoji_label(emoji, c.name).alias("label"))
    return first.unionByName(rest)


def union_all(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
