"""A stream of voxels, one grid operator for each image of a micro-batch.

There is no state between images: an image is whole once its rows are in one
micro-batch, and a replayed batch overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweave.grid import FLOAT, Grid


def each_image(stream: DataFrame, shape: tuple[int, int, int], op: Callable[[Grid], Grid], path: str, checkpoint: str, dtype: str = FLOAT) -> StreamingQuery:
    """Applies ``op`` to each image of a stream (img, z, y, x, v) and writes Parquet below ``path``.

    A micro-batch holds few images; their ids are listed, their voxels are not.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for row in batch.select("img").distinct().toLocalIterator():
            one = Grid(batch.filter(F.col("img") == row[0]).select("z", "y", "x", F.col("v").cast("double").alias("v")), shape, dtype)
            op(one).df.withColumn("img", F.lit(row[0])).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/img={row[0]}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
