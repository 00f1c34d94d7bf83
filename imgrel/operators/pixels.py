"""Grey rasters as tables of pixels ``(image_id, y, x, v)``: quality metrics and choices, which are aggregations by image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_vectors(df: DataFrame, side: int = 8) -> DataFrame:
    """``vec_id, embedding`` as grey rasters of ``side`` x ``side``: values from -0.5 to 0.5 become 0 to 255."""
    level = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long")
    return df.select("vec_id", F.posexplode("embedding").alias("i", "e")).select(
        F.col("vec_id").alias("image_id"), F.floor(F.col("i") / side).cast("long").alias("y"),
        (F.col("i") % side).cast("long").alias("x"), level.alias("v"),
    )


def quality(pairs: DataFrame) -> DataFrame:
    """PSNR and SSIM of ``(image_id, a, b)``: one group-by, no second pass.

    SSIM uses the whole image as its window.  Equal images have a PSNR of
    infinity.  Grey images stand for four channels of which alpha never
    differs, so three of four squared errors count.
    """
    mse = F.avg(F.pow(F.col("a").cast("double") - F.col("b"), 2)) * 0.75
    stats = pairs.groupBy("image_id").agg(
        mse.alias("mse"), F.avg(F.col("a").cast("double")).alias("ma"), F.avg(F.col("b").cast("double")).alias("mb"),
        F.var_pop(F.col("a").cast("double")).alias("va"), F.var_pop(F.col("b").cast("double")).alias("vb"),
        F.covar_pop(F.col("a").cast("double"), F.col("b").cast("double")).alias("cov"),
    )
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cov") + c2)) / (
        (F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (F.col("va") + F.col("vb") + c2)
    )
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / F.col("mse")))
    return stats.select(
        "image_id", F.round(psnr, 6).alias("psnr"), F.round(F.least(F.greatest(ssim, F.lit(0.0)), F.lit(1.0)), 6).alias("ssim")
    )


def smallest(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate with the fewest bytes of each key; of equal ones the first by ``priority``."""
    order = Window.partitionBy(key).orderBy("bytes", "priority")
    return candidates.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
