"""Looking rows up in another table when one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key holding at least this share of the rows is hot, so there are at most 256 of them.
HOT_SHARE = 1 / 256
# Below this many rows no key can be large enough to matter.
SKEW_FROM_ROWS = 2_000_000
SALTS = 64


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
           skew_from_rows: int = SKEW_FROM_ROWS) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key at most once.

    ``how`` is ``left``, ``left_semi`` or ``left_anti``. Rows of a hot key are spread over
    ``SALTS`` tasks and only the hot rows of ``right`` are copied to them. Rows with a
    missing key match nothing; they are spread as well.
    """
    rows = left.count()
    if rows < skew_from_rows:
        return left.join(right, keys, how)
    # At most 1 / HOT_SHARE keys reach the count, which bounds what is broadcast.
    hot = (
        left.groupBy(*keys).count().where(F.col("count") >= rows * HOT_SHARE)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    # The salt depends on the partition alone, so a task that runs again gives the same one.
    spread = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | missing, spread).otherwise(F.lit(0))
    ).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
