"""Session settings the plans are made for. Nothing here is needed for right results."""


def session_settings(cores: int) -> dict[str, str]:
    """Settings for a session with so many cores in all.

    Shuffles start with enough partitions to be cut and are merged to about 128 MB by the adaptive planner,
    which also splits partitions that one key makes large.
    """
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.shuffle.partitions": str(cores if cores <= 16 else cores * 3),
        "spark.sql.files.maxPartitionBytes": "128m",
    }
