"""Dominant colour of a box: a numpy helper over image bytes, and its relational twin over pixel rows."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hue ranges (of 180), each without its upper end; the last red one reaches to 180.
HUES = ((0, 8, "red"), (9, 24, "orange"), (25, 34, "yellow"), (35, 80, "green"), (81, 95, "cyan"), (96, 129, "blue"), (130, 170, "purple"), (171, 181, "red"))
BLACK_BELOW, GRAY_BELOW, WHITE_FROM = 40, 25, 200


def to_hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0 to 179), saturation and value (0 to 255) of 8-bit BGR pixels, rounded."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = np.where(high == low, 1.0, high - low)
    hue = np.select([high == low, high == r, high == g], [0.0, (g - b) / spread, 2 + (b - r) / spread], 4 + (r - g) / spread) * 30
    hue = np.rint(np.where(hue < 0, hue + 180, hue)).astype(np.int64) % 180
    return hue, np.rint(np.where(high > 0, 255 * (high - low) / np.where(high > 0, high, 1), 0)).astype(np.int64), high.astype(np.int64)


def hex_color(h: float, s: float, v: float) -> str:
    return "#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hsv_to_rgb(h / 180, s / 255, v / 255))


def dominant_color(image: np.ndarray, bbox: list[float]) -> tuple[str, str | None]:
    """Name and hex shade of what fills the middle of a box of a BGR image.

    Boxes under 4 pixels a side are unknown. Dark regions are black, pale ones white or gray; otherwise the
    hue range with the most saturation times value wins (the first of equals), its shade being the range's
    commonest hue with that hue's mean saturation and value.
    """
    height, width = image.shape[:2]
    x1, x2 = sorted(min(width, max(0, int(np.rint(v)))) for v in (bbox[0], bbox[2]))
    y1, y2 = sorted(min(height, max(0, int(np.rint(v)))) for v in (bbox[1], bbox[3]))
    if x2 - x1 < 4 or y2 - y1 < 4:
        return "unknown", None
    dx, dy = (x2 - x1) // 10, (y2 - y1) // 10
    hue, sat, val = (c.ravel() for c in to_hsv(image[y1 + dy : y2 - dy, x1 + dx : x2 - dx]))
    if (v := int(val.mean())) < BLACK_BELOW:
        return "black", hex_color(0, 0, v)
    if int(sat.mean()) < GRAY_BELOW:
        return ("white", "#ffffff") if v >= WHITE_FROM else ("gray", hex_color(0, 0, v))
    weight = np.bincount(hue, sat * val, 181)
    low, high, name = max(HUES, key=lambda b: weight[b[0] : b[1]].sum())
    shades, times = np.unique(hue[(hue >= low) & (hue < high)], return_counts=True)
    if not len(shades):
        return name, None
    usual = shades[times.argmax()]  # of equally common shades the lowest
    own = hue == usual
    return name, hex_color(int(usual), int(sat[own].mean()), int(val[own].mean()))


#: Boxes that are sent to all tasks at once (some 60 bytes each), to meet the images as these are read.
BOXES = 1_000_000


def annotate_colors(detections: DataFrame, images: DataFrame, boxes: int = BOXES) -> DataFrame:
    """detections with color_name and color_hex from images(frame_path, image); null where an image is missing or broken, or a box has no four numbers.

    An image never enters a shuffle: the distinct boxes of its path, gathered in a row, come to the task that reads it, which decodes it once
    for all of them, and only colours go on to the detections. More boxes than `boxes` are sent in parts by a hash of the path; a part
    reads its own images only, as read_images' paths are known before a file is opened.
    """

    @F.pandas_udf("array<struct<bbox:array<double>,color_name:string,color_hex:string>>")
    def shades(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows in columns:
            out = []
            for h, w, c, d, own in zip(*rows, strict=True):
                found = []
                for box in own:
                    try:
                        found.append((box, *dominant_color(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))[..., :3], list(box))))
                    except (TypeError, ValueError, IndexError):
                        found.append((box, None, None))
                out.append([{"bbox": b, "color_name": n, "color_hex": x} for b, n, x in found])
            yield pd.Series(out, dtype=object)

    wanted = detections.where("frame_path is not null and bbox is not null").groupBy("frame_path").agg(F.collect_set("bbox").alias("boxes"))
    n = max(1, -(-(wanted.agg(F.sum(F.size("boxes"))).first()[0] or 0) // boxes))
    shaded: DataFrame | None = None
    for i in range(n):
        own = lambda df, i=i: df.where(F.pmod(F.xxhash64("frame_path"), F.lit(n)) == i)
        met = own(images.select("frame_path", "image")).where("image is not null").join(F.broadcast(own(wanted)), "frame_path")
        part = met.select("frame_path", F.explode(shades("image.height", "image.width", "image.nChannels", "image.data", "boxes")).alias("s"))
        shaded = part if shaded is None else shaded.unionByName(part)
    colors = shaded.select("frame_path", "s.*").dropDuplicates(["frame_path", "bbox"])
    return detections.drop("color_name", "color_hex").join(colors, ["frame_path", "bbox"], "left")


def hue_bin(hue: Column) -> Column:
    """Number of the hue range, null between ranges."""
    out = F.lit(None).cast("int")
    for i, (low, high, _) in enumerate(HUES):
        out = F.when((hue >= low) & (hue < high), i).otherwise(out)
    return out


def dominant_color_pixels(pixels: DataFrame) -> DataFrame:
    """(det_id, color_name) from pixels(det_id, h, s, v): the same rules as sums over rows."""
    means = pixels.groupBy("det_id").agg(F.floor(F.avg("s")).alias("mean_s"), F.floor(F.avg("v")).alias("mean_v"))
    bins = pixels.withColumn("bin", hue_bin(F.col("h"))).where("bin is not null").groupBy("det_id", "bin").agg(F.sum(F.col("s") * F.col("v")).alias("weight"))
    best = bins.groupBy("det_id").agg(F.max(F.struct("weight", -F.col("bin"))).alias("top")).select("det_id", F.when(F.col("top.weight") > 0, -F.col("top.col2")).otherwise(0).alias("bin"))
    names = F.array(*[F.lit(n) for _, _, n in HUES])
    color = F.when(F.col("mean_v") < BLACK_BELOW, "black").when((F.col("mean_s") < GRAY_BELOW) & (F.col("mean_v") >= WHITE_FROM), "white").when(F.col("mean_s") < GRAY_BELOW, "gray").otherwise(F.element_at(names, F.coalesce("bin", F.lit(0)) + 1))
    return means.join(best, "det_id", "left").select("det_id", color.alias("color_name"), "mean_s", "mean_v")
