"""An id for every row, in the order of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm._store import written

ID = "order_id_"


def with_order(docs: DataFrame, key: Column, *carry: Column) -> DataFrame:
    """(ID, *carry): ID is the key itself if no two rows share one and none lacks it, as is usual; one narrow aggregate tells.

    Otherwise ID follows the key, null last, and then the rows' order: the keys alone are sorted by range, and joined back.
    """
    rows = docs.select(key.cast("long").alias("key_"), *carry)
    if not rows.groupBy("key_").count().where("count > 1 or key_ is null").limit(1).count():
        return rows.withColumnRenamed("key_", ID)
    rows = written(rows.withColumn("row_", F.monotonically_increasing_id()), "rows")
    by = [F.col("key_").isNull(), F.col("key_"), F.col("row_")]
    ranked = rows.select("key_", "row_").repartitionByRange(*by).sortWithinPartitions(*by)
    ranked = written(ranked.select("row_", F.monotonically_increasing_id().alias(ID)), "order")
    return rows.drop("key_").join(ranked, "row_").drop("row_").select(ID, *[c for c in rows.columns if c not in ("key_", "row_")])
