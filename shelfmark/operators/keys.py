"""Join keys for sides that were aggregated by the key."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def own_shuffle(column: Column) -> Column:
    """The column as a join key that both sides are shuffled by anew.

    A side made distinct by the key is partitioned by it already. Joined like that, the adaptive planner
    cannot split a hot key of the other side; a key wrapped in a struct gets a shuffle of its own, which it
    can. Two nulls are equal in a struct, so one side must hold none.
    """
    return F.struct(column.alias("key"))
