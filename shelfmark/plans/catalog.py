"""A stored catalog: reads as its readers see it, and writes as its owners make them.

Every write reads the tables at the newest commit, plans the next state of one or more of them and writes those whole:
many edits belong in one batch, and a steady trickle of them in ``streaming.changefeed``. A statement that breaks a rule
fails while it is written, so its commit never becomes visible; one that changes several tables changes them at once.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark import schemas as K
from shelfmark.functions import text as X
from shelfmark.operators import access as A
from shelfmark.operators import changes as C
from shelfmark.operators import listing as R
from shelfmark.sources import commits
from shelfmark.sources import tables as S

TABLES = {"categories": K.CATEGORIES_SCHEMA, "menu_items": K.ITEMS_SCHEMA,
          "cafe_info": K.INFO_SCHEMA, "admin_users": K.OWNERS_SCHEMA}
KEYS = {"categories": "id", "menu_items": "id", "cafe_info": "id", "admin_users": "user_id"}
CLUSTERED = {"categories": ["sort_order", "name"], "menu_items": ["category_id", "sort_order"]}
DEFAULTS = {"categories": V.CATEGORY_DEFAULTS, "menu_items": V.ITEM_DEFAULTS,
            "cafe_info": {"id": 1, "currency": V.DEFAULT_CURRENCY, "header_emoji": V.DEFAULT_EMOJI}}
UNIQUE = {"categories": ["id", "slug"], "menu_items": ["id"], "cafe_info": ["id"], "admin_users": ["user_id"]}
REQUIRED = {"categories": ["slug", "name", "sort_order", "is_active"],
            "menu_items": ["name", "price", "is_available", "sort_order"], "cafe_info": ["name", "currency"]}


def row_checks(table: str) -> dict[str, Column]:
    return {
        "menu_items": {"price not negative": F.col("price") >= 0, "badge known": F.col("badge").isin(*V.BADGE_LABELS)},
        "cafe_info": {"id is 1": F.col("id") == 1},
    }.get(table, {})


def row_id(*columns: str) -> Column:
    """Id of a new row from its content; a retried task gives the same one."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.md5(text.cast("binary"))


def with_row_ids(rows: DataFrame, *columns: str, salt: int = 0) -> DataFrame:
    """Rows with an id of their own each: equal rows differ by their number, equal statements by the salt."""
    content = row_id(*columns)
    equal = Window.partitionBy(content).orderBy(*[F.col(c) for c in columns])
    numbered = rows.withColumn("_ordinal", F.row_number().over(equal)).withColumn("_salt", F.lit(salt))
    return numbered.withColumn("id", row_id(*columns, "_ordinal", "_salt")).drop("_ordinal", "_salt")


def item_form(rows: DataFrame) -> DataFrame:
    """Item fields as typed into a form, turned into column values; other columns pass through."""
    rules = {
        "name": X.trim_text("name"), "price": X.parse_float("price").cast("decimal(10,2)"),
        "category_id": X.filled("category_id"), "description": X.blank_to_null("description"),
        "description_am": X.blank_to_null("description_am"), "emoji": X.blank_to_null("emoji", V.DEFAULT_EMOJI),
        "badge": X.filled("badge"), "image_url": X.filled("image_url"), "sort_order": X.parse_int("sort_order").cast("int"),
    }
    return rows.select(*[rules.get(c, F.col(c)).alias(c) for c in rows.columns])


def category_form(rows: DataFrame) -> DataFrame:
    """Category fields from a form; a slug with other characters than a-z, 0-9 and dash is an error."""
    slug = F.lower(X.trim_text("slug"))
    refused = F.raise_error(F.concat(F.lit("slug may hold only a-z, 0-9 and dashes: "), slug))
    rules = {
        "name": X.trim_text("name"), "slug": F.when(X.slug_valid("slug"), slug).otherwise(refused),
        "emoji": X.blank_to_null("emoji", V.DEFAULT_EMOJI), "subtitle": X.blank_to_null("subtitle"),
        "sort_order": X.parse_int("sort_order").cast("int"),
    }
    return rows.select(*[rules.get(c, F.col(c)).alias(c) for c in rows.columns])


def info_form(rows: DataFrame) -> DataFrame:
    """Info fields from a form: the name is trimmed, the currency has a default, the rest may be null."""
    def rule(name):
        if name == "name":
            return X.trim_text(name)
        return X.blank_to_null(name, V.DEFAULT_CURRENCY if name == "currency" else None)

    return rows.select(*[(F.col(c) if c == "id" else rule(c)).alias(c) for c in rows.columns])


class NotAllowed(Exception):
    """An insert by someone who is not an owner."""


class Catalog:
    """The newest commit at each call, or the one given for all calls."""

    def __init__(self, spark: SparkSession, folder: str, commit: int | None = None):
        self.spark, self.folder, self.commit = spark, folder, commit

    def now(self) -> "Catalog":
        """The catalog as it is now, for as long as it is read."""
        return Catalog(self.spark, self.folder, self._version())

    # -- reads --

    def table(self, name: str) -> DataFrame:
        """A table at the commit, or no rows where nothing was stored yet."""
        found = commits.table_at(self.spark, self.folder, name, self._version())
        return self.spark.createDataFrame([], TABLES[name]) if found is None else found

    def read(self, name: str, user_id: str | None = None) -> DataFrame:
        return A.visible_rows(name, self.table(name), self.table("admin_users"), user_id)

    def info(self) -> DataFrame:
        return S.read_singleton(self.table("cafe_info"))

    def currency(self) -> Column:
        return R.currency_of(self.table("cafe_info"))

    def menu(self, user_id: str | None = None) -> DataFrame:
        """Menu pages as one reader sees them."""
        at = self.now()
        return R.category_menu(at.read("menu_items", user_id), at.read("categories", user_id), at.currency())

    def listing(self, tab: str = V.ALL_TAB[0], user_id: str | None = None) -> DataFrame:
        at = self.now()
        categories = at.read("categories", user_id)
        rows = R.menu_listing(at.read("menu_items", user_id), categories, at.currency())
        return R.tab_filter(rows, categories, tab)

    def tabs(self, user_id: str | None = None) -> DataFrame:
        return R.nav_tabs(self.read("categories", user_id))

    def owner_items(self, category: str | None = None, search: str = "") -> DataFrame:
        at = self.now()
        found = R.owner_search(at.table("menu_items"), category, search)
        return R.admin_listing(found, at.table("categories"), at.currency())

    def owner_categories(self) -> DataFrame:
        at = self.now()
        return R.items_per_category(at.table("categories"), at.table("menu_items"))

    def is_admin(self, user_id: str | None) -> bool:
        return user_id is not None and not self.table("admin_users").where(F.col("user_id") == user_id).isEmpty()

    # -- writes --

    def load(self, states: dict[str, DataFrame]) -> int:
        """Whole tables as one commit, unchecked: a catalog taken over from elsewhere."""
        return self._commit(states, self._version())

    def seed(self, categories: DataFrame, items: DataFrame, info: DataFrame, as_of: Column) -> int:
        """First load of three tables in one commit, safe to repeat. Item rows name their category by slug."""
        at = self.now()
        with_id = categories.withColumn("id", row_id("slug")).withColumn("seq", F.col("sort_order"))
        sections = C.insert_if_absent(at.table("categories"), with_id, "slug", "seq", self._defaults("categories", as_of))
        first = info.withColumn("seq", F.lit(1))
        named = with_row_ids(items, "slug", "name", "sort_order")
        states = {"categories": sections,
                  "cafe_info": C.insert_if_absent(at.table("cafe_info"), first, "id", "seq", self._defaults("cafe_info", as_of)),
                  "menu_items": C.seed_load(at.table("menu_items"), named, sections, defaults=self._defaults("menu_items", as_of))}
        kept = {name: at._enforced(name, state, state, state.columns, sections) for name, state in states.items()}
        return self._commit(kept, at.commit)

    def insert(self, name: str, rows: DataFrame, user_id: str | None, as_of: Column) -> int:
        if not self._may(name, "insert", user_id):
            raise NotAllowed(f"new row violates the access rules of {name}")
        at = self.now()
        if "id" not in rows.columns:
            rows = with_row_ids(rows, *rows.columns, salt=at.commit)
        target = at.table(name)
        fresh = C.new_rows(target, rows, self._defaults(name, as_of))
        return at._checked(name, target.unionByName(fresh), fresh, TABLES[name].names)

    def update(self, name: str, patches: DataFrame, user_id: str | None, as_of: Column) -> int | None:
        """Patch rows by id; the columns of `patches` are set. Someone else than an owner changes no rows."""
        if not self._may(name, "update", user_id):
            return None
        at = self.now()
        key, target = KEYS[name], at.table(name)
        columns = [c for c in patches.columns if c != key]

        def patched(rows):
            return C.update_patch(rows, patches, key, columns, touch=("updated_at", as_of))

        hit = target.join(patches.select(key).distinct(), key, "left_semi").select(*target.columns)
        return at._checked(name, patched(target), patched(hit), columns)

    def set_availability(self, flags: DataFrame, user_id: str | None, as_of: Column) -> int | None:
        coerced = flags.select("id", F.coalesce("is_available", F.lit(False)).alias("is_available"))
        return self.update("menu_items", coerced, user_id, as_of)

    def save_info(self, patch: DataFrame, user_id: str | None, as_of: Column) -> int:
        if not self._may("cafe_info", "insert", user_id):
            raise NotAllowed("new row violates the access rules of cafe_info")
        at = self.now()
        one = patch.withColumn("id", F.lit(1))
        state = C.upsert(at.table("cafe_info"), one, "id", self._defaults("cafe_info", as_of),
                         touch=("updated_at", as_of))
        return at._checked("cafe_info", state, state, one.columns)

    def delete(self, name: str, keys: DataFrame, user_id: str | None, as_of: Column) -> int | None:
        """Delete by id; items of a deleted category stay, without one, from the same commit on."""
        if not self._may(name, "delete", user_id):
            return None
        at = self.now()
        states = {name: C.delete_rows(at.table(name), keys, KEYS[name])}
        if name == "categories":
            states["menu_items"] = C.delete_set_null(at.table("menu_items"), keys, touch=("updated_at", as_of))
        return self._commit(states, at.commit)

    def grant(self, emails: DataFrame, users: DataFrame, full_name: str, as_of: Column) -> DataFrame:
        """Make users owners by address; returns what became of each address. Not open to readers or owners."""
        at = self.now()
        outcomes = C.grant_outcomes(emails, users)
        self._write("admin_users", C.grant_owner(at.table("admin_users"), outcomes, full_name, as_of), at.commit)
        return outcomes

    def revoke(self, emails: DataFrame) -> int:
        at = self.now()
        return self._write("admin_users", C.revoke_owner(at.table("admin_users"), emails), at.commit)

    # -- helpers --

    def _may(self, name: str, op: str, user_id: str | None) -> bool:
        return op in V.OWNER_WRITES.get(name, []) and self.is_admin(user_id)

    def _defaults(self, name: str, as_of: Column) -> dict[str, Column]:
        fixed = {column: F.lit(value) for column, value in DEFAULTS.get(name, {}).items()}
        return {**fixed, "created_at": as_of, "updated_at": as_of}

    def _version(self, name: str | None = None) -> int:
        """Number of the commit that is read; tables share it."""
        return commits.latest_commit(self.spark, self.folder) if self.commit is None else self.commit

    def _enforced(self, name: str, state: DataFrame, changed: DataFrame, columns: list[str],
                  categories: DataFrame | None = None) -> DataFrame:
        """A state whose changed rows keep every rule, or else fails when it is written. Looked at are those rows and,
        for a unique column that was set, the rows that share its values."""
        sections = self.table("categories") if categories is None else categories
        references = {"category_id": (sections, "id")} if name == "menu_items" and "category_id" in columns else {}
        found = [C.constraint_check(changed, KEYS[name], row_checks(name), REQUIRED[name], references=references)]
        for column in UNIQUE[name]:
            if column in columns:
                rivals = state.join(changed.select(column).distinct(), column, "left_semi")
                found.append(C.constraint_check(rivals, KEYS[name], unique=[column]))
        return C.enforce(state, R.union_all(found))

    def _checked(self, name: str, state: DataFrame, changed: DataFrame, columns: list[str]) -> int:
        return self._write(name, self._enforced(name, state, changed, columns), self._version())

    def _write(self, name: str, state: DataFrame, base: int | None = None) -> int:
        return self._commit({name: state}, self._version() if base is None else base)

    def _commit(self, states: dict[str, DataFrame], base: int) -> int:
        """Write the commit after `base`, on which the states were planned. It fails if another writer has made that
        commit meanwhile, and so loses no write."""
        return commits.write_commit(self.spark, self.folder, states, base, CLUSTERED)
