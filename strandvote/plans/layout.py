"""Tables that keep their partitioning from stage to stage.

Members, metrics and bins of structures meet by the keys of their group in several stages, votes and sequences by
their header. Stored in buckets of one key and number, two such tables are joined, and one is aggregated, bucket by
bucket, without being dealt again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..storage import shared_dir


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in so many buckets by keys, sorted by them inside; read again.

    Rows are dealt to the buckets once, so that there is a file a bucket. Tables that are to meet without an
    exchange need the same keys, of the same types, and the same number. buckets should leave no more than a
    task's memory sorts at ease: about 200 MB each.
    """
    name = name or f"table_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)

