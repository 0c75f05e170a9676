"""Classes of photo pixels from their colours: sky flooded from the top, vegetation, water, the rest building.

Connected regions are labelled in two levels: first within blocks of pixels, each in one task; then labels that meet across
a block's border are the edges of a much smaller graph, whose components join them. So a photo of any size is many tasks,
and the graph holds borders only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators import rasters
from skylattice.operators.graph import connected_components
from skylattice.operators.quantiles import exact_quantiles

#: Fixed values of the rules: smooth and bright, or bluish; green; bluish and smooth below the horizon; shares of a block.
SKY_GRAD, SKY_LIGHT, SKY_BLUE_LIGHT = 0.08, 0.45, 0.3
GREENER, LEAST_GREEN, WATER_BLUE, WATER_GRAD = 1.04, 0.12, 0.95, 0.06
SKY_SHARE, OTHER_SHARE = 0.5, 0.35
#: Pixels that a building's region needs to be a point.
LEAST_BLOB = 6
#: Rows and columns of a photo are below this, photos below 2^23.
SIDE = 1 << 20


def labelled(mask: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Smallest of ``codes`` in each 4-connected region of ``mask``."""
    far = np.iinfo(np.int64).max
    label = np.where(mask, codes, far)
    while True:
        wide = np.pad(label, 1, constant_values=far)
        new = np.where(mask, np.minimum.reduce([label, wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]]), far)
        if (new == label).all():
            return label
        label = new


def regions(px: DataFrame, block: int = 64) -> DataFrame:
    """``px`` (photo, row, col) with ``region``, the same for pixels that steps to the four neighbours connect."""

    def within(g: pd.DataFrame) -> pd.DataFrame:
        r, c = (g["row"] % block).to_numpy(), (g["col"] % block).to_numpy()
        mask, codes = np.zeros((block, block), dtype=bool), np.zeros((block, block), dtype=np.int64)
        mask[r, c], codes[r, c] = True, (g["photo"].to_numpy() * SIDE + g["row"].to_numpy()) * SIDE + g["col"].to_numpy()
        return pd.DataFrame({"photo": g["photo"], "row": g["row"], "col": g["col"], "label": labelled(mask, codes)[r, c]})

    cut = px.select(F.col("photo").cast("long").alias("photo"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    cut = cut.withColumn("br", F.floor(F.col("row") / block)).withColumn("bc", F.floor(F.col("col") / block))
    local = cut.groupBy("photo", "br", "bc").applyInPandas(within, "photo long, row long, col long, label long")
    step = lambda down, right: local.where(F.col("row" if down else "col") % block == block - 1).select("photo", (F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), F.col("label").alias("other"))
    edges = step(1, 0).unionByName(step(0, 1)).join(local, ["photo", "row", "col"]).select("label", "other").distinct()
    joined = connected_components(edges, "label", "other")
    return local.join(joined, F.col("label") == F.col("node"), "left").select("photo", "row", "col", F.coalesce("component", "label").alias("region"))


def pixel_classes(px: DataFrame, scale: int = 4, block: int = 64) -> DataFrame:
    """Class of each block of ``scale`` x ``scale`` pixels of the working resolution (photo, row, col, r, g, b in 0 to 1; without
    gaps): photo, row, col, class."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    rows = rasters.beside(px.withColumn("gray", 0.299 * r + 0.587 * g + 0.114 * b), "gray", ("photo",))
    apart = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)), F.lit(0.0))  # noqa: E731  0 at the photo's edge
    rows = rows.withColumn("grad", F.round(apart("left", "right") + apart("up", "down"), 9)).select("photo", "row", "col", "r", "g", "b", "grad")
    open_ = (F.col("grad") < SKY_GRAD) & ((F.greatest("r", "g", "b") > SKY_LIGHT) | ((b > r) & (b > g) & (F.greatest("r", "g", "b") > SKY_BLUE_LIGHT)))
    found = regions(rows.where(open_), block)
    top = found.where("row = 0").select("photo", "region").distinct()
    sky = found.join(top, ["photo", "region"]).select("photo", "row", "col", F.lit(True).alias("sky"))
    rows = rows.join(sky, ["photo", "row", "col"], "left").withColumn("sky", F.coalesce("sky", F.lit(False)))
    last = rows.groupBy("photo", "col").agg(F.coalesce(F.max(F.when(F.col("sky"), F.col("row"))), F.lit(0)).alias("last"))
    horizon = exact_quantiles(last, ["photo"], "last", {"horizon": 0.5}).select("photo", F.floor("horizon").alias("horizon"))
    rows = rows.join(horizon, "photo")
    leaf = ~F.col("sky") & (g > r * GREENER) & (g > b * GREENER) & (g > LEAST_GREEN)
    rows = rows.withColumn("leaf", leaf)
    wet = ~F.col("sky") & ~F.col("leaf") & (b >= r * WATER_BLUE) & (F.col("grad") < WATER_GRAD) & (F.col("row") > F.col("horizon"))
    share = lambda x: F.avg(x.cast("double"))
    small = rows.groupBy("photo", F.floor(F.col("row") / scale).alias("row"), F.floor(F.col("col") / scale).alias("col")).agg(share(F.col("sky")).alias("sky"), share(F.col("leaf")).alias("leaf"), share(wet).alias("wet"))
    kind = F.when(F.col("sky") > SKY_SHARE, "sky").when(F.col("leaf") > OTHER_SHARE, "vegetation").when(F.col("wet") > OTHER_SHARE, "water").otherwise("building")
    return small.select("photo", "row", "col", kind.alias("class"))
