"""Writes as set-based batches: target and batch in, new target out; nothing is changed in place.

A batch is folded to one row per key by aggregation before it meets the target, so a key repeated in a
third of the batch costs one partial aggregate and no skewed join.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import filled
from shelfmark.operators.keys import own_shuffle
from shelfmark.operators.listing import union_all

ALL_COLUMNS = None


def _typed(column: Column, target: DataFrame, name: str) -> Column:
    return column.cast(target.schema[name].dataType)


def _patched(name: str, batch: DataFrame, patch_cols: str | None) -> Column:
    """Does a batch row set this column? Without a list of names every column of the batch is set."""
    if name not in batch.columns:
        return F.lit(False)
    return F.lit(True) if patch_cols is None else F.array_contains(patch_cols, name)


def new_rows(target: DataFrame, batch: DataFrame, defaults: dict[str, Column],
             patch_cols: str | None = None) -> DataFrame:
    """Batch rows in the shape of the target: an omitted column takes its default, an explicit null stays."""
    def value(name):
        default = _typed(defaults.get(name, F.lit(None)), target, name)
        if name not in batch.columns:
            return default
        given = _typed(F.col(name), target, name)
        return given if patch_cols is None else \
            F.when(_patched(name, batch, patch_cols), given).otherwise(default)

    return batch.select(*[value(name).alias(name) for name in target.columns])


def insert_defaults(target: DataFrame, batch: DataFrame, defaults: dict[str, Column],
                    patch_cols: str | None = None) -> DataFrame:
    return target.unionByName(new_rows(target, batch, defaults, patch_cols))


def fold_patches(batch: DataFrame, key: str, columns: list[str], seq: str | None = None,
                 patch_cols: str | None = None) -> DataFrame:
    """One row per key: each column a struct of its last set value in `seq` order, null if never set.

    Without `seq` the batch is one statement, in which a repeated key is an error.
    """
    folded = []
    for name in columns:
        boxed = F.when(_patched(name, batch, patch_cols), F.struct(F.col(name).alias("value")))
        rank = F.when(_patched(name, batch, patch_cols), F.col(seq)) if seq else F.lit(1)
        folded.append(F.max_by(boxed, rank).alias(f"_set_{name}"))
    grouped = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *folded)
    if seq is None:
        twice = F.raise_error(F.concat(F.lit("key given twice in one batch: "), F.col(key).cast("string")))
        grouped = grouped.withColumn(key, F.when(F.col("_n") > 1, twice).otherwise(F.col(key)))
    return grouped.drop("_n")


def touched(name: str, value: Column, updated: Column, touch: tuple[str, Column] | None) -> Column:
    """The touch rule: an updated row gets the new time, whether or not a value changed."""
    if touch and touch[0] == name:
        return F.when(updated, touch[1]).otherwise(value)
    return value


def touch_updated_at(df: DataFrame, updated: Column, as_of: Column, column: str = "updated_at") -> DataFrame:
    return df.withColumn(column, F.when(updated, as_of).otherwise(F.col(column)))


def _apply_patches(target: DataFrame, folded: DataFrame, key: str, columns: list[str],
                   touch: tuple[str, Column] | None) -> DataFrame:
    patches = folded.withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    joined = target.join(patches, target[key] == F.col("_key"), "left")
    hit = F.col("_hit").isNotNull()

    def value(name):
        old = F.col(name)
        if name in columns:
            box = F.col(f"_set_{name}")
            old = F.when(box.isNotNull(), _typed(box["value"], target, name)).otherwise(old)
        return touched(name, old, hit, touch)

    return joined.select(*[value(name).alias(name) for name in target.columns])


def update_patch(target: DataFrame, batch: DataFrame, key: str, columns: list[str], seq: str | None = None,
                 patch_cols: str | None = None, touch: tuple[str, Column] | None = None) -> DataFrame:
    """Set the listed columns of rows found by key; an explicit null overwrites, unknown keys do nothing."""
    folded = fold_patches(batch, key, columns, seq, patch_cols)
    return _apply_patches(target, folded, key, columns, touch)


def unmatched_keys(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of a patch or delete that found no row."""
    return batch.select(key).distinct().join(target.select(key), key, "left_anti")


def set_availability(target: DataFrame, batch: DataFrame, key: str = "id", flag: str = "is_available",
                     seq: str | None = None, touch: tuple[str, Column] | None = None) -> DataFrame:
    """Flag patch; the given value is coerced, so null means not available."""
    coerced = batch.withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return update_patch(target, coerced, key, [flag], seq, touch=touch)


def delete_rows(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return target.join(keys.select(key).distinct(), key, "left_anti").select(*target.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str, defaults: dict[str, Column] | None = None,
           columns: list[str] | None = ALL_COLUMNS, patch_cols: str | None = None,
           touch: tuple[str, Column] | None = None) -> DataFrame:
    """Patch rows whose key exists, insert the others; a key given twice in the batch is an error.

    Two one-sided joins instead of a full one: while the batch is small enough to broadcast, the target
    is read but never shuffled.
    """
    defaults = defaults or {}
    columns = [c for c in (columns or target.columns) if c != key and c in batch.columns]
    folded = fold_patches(batch, key, columns, None, patch_cols)
    known = target.select(key).join(folded.select(key), key, "left_semi")
    fresh = folded.join(known, key, "left_anti")

    def value(name):
        if name == key:
            return _typed(F.col(key), target, key)
        default = _typed(defaults.get(name, F.lit(None)), target, name)
        if name not in columns:
            return default
        box = F.col(f"_set_{name}")
        return F.when(box.isNotNull(), _typed(box["value"], target, name)).otherwise(default)

    inserted = fresh.select(*[value(name).alias(name) for name in target.columns])
    return _apply_patches(target, folded, key, columns, touch).unionByName(inserted)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, seq: str,
                     defaults: dict[str, Column] | None = None) -> DataFrame:
    """Insert only unknown keys; an existing row stays as it is and the first row of the batch wins."""
    columns = [c for c in batch.columns if c in target.columns and c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(seq)).alias("_first")).select(key, "_first.*")
    fresh = first.join(target.select(key), key, "left_anti")
    return insert_defaults(target, fresh, defaults or {})


def seed_resolve(seed: DataFrame, categories: DataFrame, slug: str = "slug", id_col: str = "id",
                 into: str = "category_id", how: str = "inner") -> DataFrame:
    """Swap the natural key of seed rows for the category id; rows with an unknown key are dropped."""
    keys = categories.select(F.col(slug), F.col(id_col).alias(into))
    return seed.join(keys, slug, how).drop(slug)


def seed_unresolved(seed: DataFrame, categories: DataFrame, slug: str = "slug") -> DataFrame:
    return seed.join(categories.select(slug).distinct(), slug, "left_anti")


def seed_new_only(seed: DataFrame, target: DataFrame, name: str = "name") -> DataFrame:
    stored = target.select(F.col(name).alias("_stored")).where(F.col("_stored").isNotNull()).distinct()
    return seed.join(stored, own_shuffle(seed[name]) == own_shuffle(stored["_stored"]), "left_anti")


def seed_load(target: DataFrame, seed: DataFrame, categories: DataFrame, slug: str = "slug", name: str = "name",
              id_col: str = "id", into: str = "category_id", defaults: dict[str, Column] | None = None) -> DataFrame:
    """Load seed rows whose name is not stored yet. Rows repeated in the seed all load; a rerun adds none."""
    resolved = seed_resolve(seed, categories, slug, id_col, into)
    return insert_defaults(target, seed_new_only(resolved, target, name), defaults or {})


def delete_set_null(items: DataFrame, deleted: DataFrame, category: str = "category_id", key: str = "id",
                    touch: tuple[str, Column] | None = None) -> DataFrame:
    """Items after a delete of categories: they survive without a category, as updated rows."""
    gone = deleted.select(F.col(key).alias("_gone")).where(F.col("_gone").isNotNull()).distinct()
    joined = items.join(gone, own_shuffle(items[category]) == own_shuffle(gone["_gone"]), "left")
    hit = F.col("_gone").isNotNull()

    def value(name):
        kept = F.when(~hit, F.col(name)) if name == category else F.col(name)
        return touched(name, kept, hit, touch)

    return joined.select(*[value(name).alias(name) for name in items.columns])


def delete_cascade(owners: DataFrame, deleted_users: DataFrame, user: str = "user_id", key: str = "id") -> DataFrame:
    return delete_rows(owners, deleted_users.select(F.col(key).alias(user)), user)


# -- constraints -----------------------------------------------------------------------------------

def broken(predicate: Column) -> Column:
    """A check fails only where its predicate is false; null passes."""
    return F.coalesce(~predicate, F.lit(False))


def row_violations(df: DataFrame, key: str, checks: dict[str, Column], required: list[str] = ()) -> DataFrame:
    """(rule, key) of every failed row rule, all rules in one pass."""
    failed = [F.when(broken(predicate), F.lit(rule)) for rule, predicate in checks.items()]
    failed += [F.when(F.col(name).isNull(), F.lit(f"{name} missing")) for name in required]
    return df.select(F.explode(F.array_compact(F.array(*failed))).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """Values that break uniqueness, with how many rows hold them."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows")) \
        .where(F.col("n_rows") > 1)


def missing_references(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(column))
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti").select(*df.columns)


def constraint_check(df: DataFrame, key: str, checks: dict[str, Column] | None = None, required: list[str] = (),
                     unique: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """All violations as (rule, key); for a broken uniqueness the key is the repeated value."""
    found = []
    if checks or required:
        found.append(row_violations(df, key, checks or {}, required))
    for column in unique:
        found.append(duplicate_values(df, column).select(
            F.lit(f"{column} unique").alias("rule"), F.col(column).cast("string").alias("key")))
    for column, (parent, parent_key) in (references or {}).items():
        found.append(missing_references(df, column, parent, parent_key).select(
            F.lit(f"{column} reference").alias("rule"), F.col(key).cast("string").alias("key")))
    return union_all(found)


def enforce(df: DataFrame, violations: DataFrame) -> DataFrame:
    """Strict mode: one violation fails the whole statement when it runs."""
    sample = violations.agg(F.min(F.concat_ws(": ", "rule", "key"))).scalar()
    failure = F.raise_error(F.concat(F.lit("constraint violated, "), sample))
    return df.where(F.when(sample.isNotNull(), failure.cast("boolean")).otherwise(F.lit(True)))


def refused_rows(df: DataFrame, checks: dict[str, Column] | None = None, required: list[str] = (),
                 unique: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None,
                 name: str = "refused") -> DataFrame:
    """Add whether a row breaks any rule. Of rows that share a value of a unique column all are refused.

    Row rules need no join; uniqueness and references join on the column they are about, so rows with a null
    key are judged like all others. Null values are neither repeated nor dangling.
    """
    bad = [broken(predicate) for predicate in (checks or {}).values()] + [F.col(c).isNull() for c in required]
    marked = df.withColumn(name, reduce(lambda a, b: a | b, bad, F.lit(False)))
    sides = [(c, duplicate_values(df, c).select(F.col(c).alias("_value")), True) for c in unique]
    sides += [(c, parent.select(F.col(k).alias("_value")).where(F.col(k).isNotNull()).distinct(), False)
              for c, (parent, k) in (references or {}).items()]
    for column, values, hit_is_bad in sides:
        known = values.select(own_shuffle(F.col("_value")).alias("_key"), F.lit(True).alias("_hit"))
        joined = marked.join(known, own_shuffle(marked[column]) == F.col("_key"), "left")
        hit = F.col("_hit").isNotNull()
        wrong = hit if hit_is_bad else ~hit & F.col(column).isNotNull()
        marked = joined.withColumn(name, F.col(name) | wrong).drop("_key", "_hit")
    return marked


def quarantine(df: DataFrame, checks: dict[str, Column] | None = None, required: list[str] = (),
               unique: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into clean and refused."""
    marked = refused_rows(df, checks, required, unique, references, "_refused")
    return marked.where(~F.col("_refused")).drop("_refused"), marked.where("_refused").drop("_refused")


# -- owner grants ----------------------------------------------------------------------------------

def email_lookup(requests: DataFrame, users: DataFrame, email: str = "email", how: str = "inner") -> DataFrame:
    """Users found by address in any letter case; of several the smallest id counts."""
    known = users.where(F.col(email).isNotNull()).groupBy(F.lower(email).alias("_email")) \
        .agg(F.min_by(F.struct("*"), F.col("id")).alias("user"))
    same = own_shuffle(F.lower(requests[email])) == own_shuffle(known["_email"])
    return requests.join(known, same, how).drop("_email")


def grant_outcomes(requests: DataFrame, users: DataFrame, email: str = "email",
                   confirmed: str = "email_confirmed_at") -> DataFrame:
    """Per requested address: missing, unconfirmed (still granted) or granted, with the user id."""
    found = email_lookup(requests, users, email, "left")
    user = F.col("user")
    outcome = F.when(user.isNull(), F.lit("missing")) \
        .when(user[confirmed].isNull(), F.lit("unconfirmed")).otherwise(F.lit("granted"))
    return found.select(*requests.columns, user["id"].alias("user_id"), outcome.alias("outcome"))


def grant_owner(owners: DataFrame, outcomes: DataFrame, full_name: str, created_at: Column,
                email: str = "email") -> DataFrame:
    """Owner list after the grants: known owners get the new address, others a row of their own."""
    granted = outcomes.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max(email).alias("email"))
    return upsert(owners, granted, "user_id", {"full_name": F.lit(full_name), "created_at": created_at})


def revoke_owner(owners: DataFrame, emails: DataFrame, email: str = "email") -> DataFrame:
    gone = emails.select(F.lower(filled(email)).alias("_gone")).distinct()
    return owners.join(gone, F.lower(owners[email]) == F.col("_gone"), "left_anti")
