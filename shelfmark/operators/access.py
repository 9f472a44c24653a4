"""Row-level access as data filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.schemas import CATEGORIES, CategoryCols


def is_owner(owners: DataFrame, user_id, user: str = "user_id") -> Column:
    """Is this one principal on the owner list? A subquery; nobody (null) is never an owner."""
    return owners.where(F.col(user) == F.lit(user_id)).exists() if user_id is not None else F.lit(False)


def is_admin_rows(df: DataFrame, owners: DataFrame, principal: str = "user_id", user: str = "user_id",
                  flag: str | None = None) -> DataFrame:
    """Rows whose principal is an owner, or with `flag` all rows and the answer as a column.

    The owner list holds each user once.
    """
    keys = owners.select(F.col(user).alias("_owner"))
    if flag is None:
        return df.join(keys, df[principal] == F.col("_owner"), "left_semi")
    joined = df.join(keys, df[principal] == F.col("_owner"), "left")
    return joined.withColumn(flag, F.col("_owner").isNotNull()).drop("_owner")


def visible_rows(table: str, df: DataFrame, owners: DataFrame, user_id=None,
                 c: CategoryCols = CATEGORIES, user: str = "user_id") -> DataFrame:
    """Rows of a table that one principal may read; `user_id` None is an anonymous reader."""
    if table == "categories":
        return df.where(F.col(c.active) | is_owner(owners, user_id, user))
    if table == "admin_users":
        return df.where(F.col(user) == F.lit(user_id)) if user_id is not None else df.where(F.lit(False))
    if table == "objects":
        return df.where(F.col("bucket_id") == V.OBJECT_BUCKET)
    return df


def write_outcome(owner: Column, table: Column, op: Column, bucket: Column | None = None) -> Column:
    """allowed; rejected (an insert fails loudly); no_rows (updates and deletes find nothing to change)."""
    writable = [f"{name}:{op_name}" for name, ops in V.OWNER_WRITES.items() for op_name in ops]
    permitted = owner & F.concat_ws(":", table, op).isin(writable)
    if bucket is not None:
        permitted = permitted & ((table != "objects") | F.coalesce(bucket == V.OBJECT_BUCKET, F.lit(False)))
    return F.when(permitted, F.lit("allowed")).when(op == "insert", F.lit("rejected")).otherwise(F.lit("no_rows"))


def authorize_changes(requests: DataFrame, owners: DataFrame, principal: str = "user_id", table: str = "tbl",
                      op: str = "op", bucket: str | None = None, user: str = "user_id") -> DataFrame:
    """Add the outcome of each change request under the principal's role."""
    flagged = is_admin_rows(requests, owners, principal, user, flag="_is_owner")
    where = None if bucket is None else F.col(bucket)
    outcome = write_outcome(F.col("_is_owner"), F.col(table), F.col(op), where)
    return flagged.withColumn("outcome", outcome).drop("_is_owner")


def policy_matrix(spark) -> DataFrame:
    """role, table and op with the outcome the rules give (fixed size: roles x tables x ops)."""
    def exploded(values, name):
        return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)

    cells = spark.range(1).select(exploded(V.VIEWER_ROLES, "role")) \
        .select("role", exploded(V.GUARDED_TABLES, "tbl")).select("role", "tbl", exploded(V.WRITE_OPS, "op"))
    return cells.withColumn("expected", write_outcome(F.col("role") == "owner", F.col("tbl"), F.col("op")))


def policy_coverage(decided: DataFrame, role: str = "role", table: str = "tbl", op: str = "op") -> DataFrame:
    """The matrix beside the decided requests of each cell: how many, and how many went another way."""
    seen = decided.groupBy(F.col(role).alias("role"), F.col(table).alias("tbl"), F.col(op).alias("op")) \
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("outcome") == "allowed").alias("_allowed"),
             F.count_if(F.col("outcome") == "rejected").alias("_rejected"),
             F.count_if(F.col("outcome") == "no_rows").alias("_no_rows"))
    agreed = F.when(F.col("expected") == "allowed", F.col("_allowed")) \
        .when(F.col("expected") == "rejected", F.col("_rejected")).otherwise(F.col("_no_rows"))
    matrix = policy_matrix(decided.sparkSession)
    return matrix.join(seen, ["role", "tbl", "op"], "left").select(
        "role", "tbl", "op", "expected", F.coalesce("_n", F.lit(0)).alias("n_requests"),
        F.coalesce(F.col("_n") - agreed, F.lit(0)).alias("n_unexpected"))
