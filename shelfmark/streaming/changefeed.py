"""Current state from a log of changes.

Each micro-batch is folded to its latest change per key and written as one delta folder named by the
batch id, so a replayed batch replaces its own folder. The state is the latest change per key over the
newest base and the deltas after it, so late and out-of-order changes need no lookup when they are
written, and a batch costs what it holds, not what the state holds. ``compact`` writes a new base.
Deletes stay as tombstones: an older change that comes late must not bring a row back.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.functions import labels as L
from shelfmark.operators.keys import own_shuffle
from shelfmark.operators.listing import PAGE_SIZE, category_menu, in_active_category, item_position, menu_pages
from shelfmark.schemas import CATEGORIES, ITEMS, CategoryCols, ItemCols
from shelfmark.sources.versions import drop_folders, numbered

DELETE = "delete"
KEEP_BASES = 2        # bases kept, with the deltas after the older of them, for readers still at work


def change_source(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                  files_per_batch: int | None = None) -> DataFrame:
    """Change rows as a stream over the files of a log folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def latest_per_key(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; aggregated map-side first, so a hot key is no hot task."""
    rest = [c for c in log.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(key).agg(last).select(key, "_last.*").select(*log.columns)


def without_deleted(latest: DataFrame, op: str = "op") -> DataFrame:
    return latest.where(F.col(op) != DELETE)


def state_as_of(log: DataFrame, key: str, order: list[str], op: str = "op", until=None) -> DataFrame:
    """Live rows after replaying a log, up to and including a time if one is given."""
    seen = log if until is None else log.where(F.col(order[0]) <= until)
    return without_deleted(latest_per_key(seen, key, order), op)


def write_delta(batch: DataFrame, batch_id: int, folder: str, key: str, order: list[str]) -> None:
    latest_per_key(batch, key, order).write.mode("overwrite").parquet(f"{folder}/delta/batch={batch_id}")


def change_apply(changes: DataFrame, folder: str, checkpoint: str, key: str, order: list[str],
                 after: Callable[[DataFrame, int], None] | None = None, compact_every: int = 100,
                 **trigger) -> StreamingQuery:
    """Start applying a change stream to the state in `folder`; `after` sees each folded batch."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch, batch_id, folder, key, order)
        if after is not None:
            after(batch.sparkSession.read.parquet(f"{folder}/delta/batch={batch_id}"), batch_id)
        if batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, folder, key, order)
            drop_old(batch.sparkSession, folder)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def parts(spark: SparkSession, folder: str, upto: int | None = None) -> tuple[list[str], int]:
    """Folders that make up the state (after one batch, if given), and the last batch in them."""
    def known(kind, prefix):
        return [n for n in numbered(spark, f"{folder}/{kind}", prefix) if upto is None or n <= upto]

    bases, deltas = known("base", "upto"), known("delta", "batch")
    base = bases[-1] if bases else -1
    newer = [b for b in deltas if b > base]
    paths = [f"{folder}/base/upto={base}"] if bases else []
    return paths + [f"{folder}/delta/batch={b}" for b in newer], max([base, *newer])


def latest_changes(spark: SparkSession, folder: str, key: str, order: list[str], upto: int | None = None) -> DataFrame:
    paths, _ = parts(spark, folder, upto)
    if not paths:
        raise FileNotFoundError(f"no state in {folder}")
    return latest_per_key(spark.read.parquet(*paths), key, order)


def current_state(spark: SparkSession, folder: str, key: str, order: list[str], op: str = "op",
                  upto: int | None = None) -> DataFrame:
    return without_deleted(latest_changes(spark, folder, key, order, upto), op)


def compact(spark: SparkSession, folder: str, key: str, order: list[str]) -> int:
    """Fold base and deltas, tombstones included, into a new base; readers of the old one are not disturbed."""
    paths, last = parts(spark, folder)
    target = f"{folder}/base/upto={last}"
    if target not in paths:  # a replayed batch finds its base already written
        latest_per_key(spark.read.parquet(*paths), key, order).write.mode("overwrite").parquet(target)
    return last


def drop_old(spark: SparkSession, folder: str, keep: int = KEEP_BASES) -> None:
    """Remove bases but the last `keep`, and the deltas that the oldest base left holds."""
    bases = numbered(spark, f"{folder}/base", "upto")
    if len(bases) >= keep:
        drop_folders(spark, f"{folder}/base", "upto", bases[:-keep])
        held = [b for b in numbered(spark, f"{folder}/delta", "batch") if b <= bases[-keep]]
        drop_folders(spark, f"{folder}/delta", "batch", held)


def affected_categories(before: DataFrame, changes: DataFrame, i: ItemCols = ITEMS) -> DataFrame:
    """Old and new category of each changed item."""
    keys = changes.select(i.id).distinct()
    old = before.join(keys, i.id, "left_semi").select(i.category)
    return old.unionByName(changes.select(i.category)).where(F.col(i.category).isNotNull()).distinct()


def refresh_affected(after: DataFrame, categories: DataFrame, affected: DataFrame, currency=None,
                     i: ItemCols = ITEMS, c: CategoryCols = CATEGORIES, **options) -> DataFrame:
    """Menu pages of the affected categories only; the others did not change."""
    hit = affected.select(F.col(i.category).alias("_hit"))
    items = after.join(hit, own_shuffle(after[i.category]) == own_shuffle(hit["_hit"]), "left_semi")
    return category_menu(items, categories, currency, i, c, **options)


def menu_refresher(state: str, menu: str, order: list[str], i: ItemCols = ITEMS,
                   page_size: int = PAGE_SIZE) -> Callable[[DataFrame, int], None]:
    """Hook for ``change_apply``: after each batch writes the item pages of the categories it affected.

    Only changes of the batch's items, and of items that ever were in an affected category, are folded: both are
    found by semi-joins before the fold. Pages hold prices and badges as they are; what depends on categories or the
    currency is added when the menu is read, so their changes need no pages anew. The list of categories comes
    last; until it is there, readers keep the older pages.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def written(frame: DataFrame, name: str) -> DataFrame:
            path = f"{menu}/{name}"
            frame.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        def folded(keys: DataFrame, upto: int) -> DataFrame:
            log = spark.read.parquet(*parts(spark, state, upto)[0])
            return without_deleted(latest_per_key(log.join(keys, i.id, "left_semi").select(*log.columns), i.id, order))

        keys = written(batch.select(i.id).distinct(), "work/keys")
        seen = batch.select(i.category).unionByName(folded(keys, batch_id).select(i.category))
        if parts(spark, state, batch_id - 1)[0]:
            seen = seen.unionByName(folded(keys, batch_id - 1).select(i.category))
        affected = written(seen.where(F.col(i.category).isNotNull()).distinct(), "work/affected")
        log = spark.read.parquet(*parts(spark, state, batch_id)[0])
        once_there = written(log.join(affected, i.category, "left_semi").select(i.id).distinct(), "work/candidates")
        items = written(folded(once_there, batch_id).join(affected, i.category, "left_semi"), "work/items")
        placed = item_position(items, i).withColumn("badge_label", L.display_badge(i.available, i.badge))
        written(menu_pages(placed, [i.id, i.name, i.price, "badge_label"], i, page_size), f"pages/batch={batch_id}")
        written(affected, f"affected/batch={batch_id}")

    return refresh


def current_menu(spark: SparkSession, menu: str, categories: DataFrame, currency=None, i: ItemCols = ITEMS,
                 c: CategoryCols = CATEGORIES) -> DataFrame:
    """The menu as it is now: of each active category the pages of the last batch that affected it, none if it was
    left empty, with the categories and the currency of today."""
    newest = spark.read.parquet(f"{menu}/affected").groupBy(i.category).agg(F.max("batch").alias("batch"))
    pages = spark.read.parquet(f"{menu}/pages").join(newest, [i.category, "batch"]).drop("batch")
    entry = F.transform("items", lambda x: F.struct(
        x["pos"].alias("pos"), x[i.id].alias(i.id), x[i.name].alias(i.name),
        L.format_price(x[i.price], currency).alias("price_label"), x["badge_label"].alias("badge_label")))
    return in_active_category(pages.withColumn("items", entry), categories, i, c)
