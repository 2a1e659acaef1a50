"""Masks, boxes and label lists of annotated images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.channels import channel_thresholds

# Class order and the fine part names of each coarse part.
CATEGORIES = ["bird", "cat", "cow", "dog", "horse", "sheep"]
BIRD_PARTS = {
    "head": ["head", "leye", "reye", "beak"],
    "torso": ["torso", "neck", "lwing", "rwing"],
    "leg": ["lleg", "rleg", "lfoot", "rfoot"],
    "tail": ["tail"],
}
MAMMAL_PARTS = {
    "head": ["head", "leye", "reye", "lear", "rear", "nose", "muzzle", "rhorn", "lhorn"],
    "torso": ["torso", "neck"],
    "bleg": ["lbleg", "rbleg", "lbpa", "rbpa", "lblleg", "lbuleg", "rblleg", "rbuleg", "rbho", "lbho"],
    "fleg": ["lfleg", "rfleg", "lfpa", "rfpa", "lflleg", "lfuleg", "rflleg", "rfuleg", "rfho", "lfho"],
}
TAILED_MAMMALS = ["cat", "dog"]
ASSOCIATION_IOU = 0.2
#: places in a word of a packed mask
WORD = 64


def coarse_parts(category: str) -> dict[str, list[str]]:
    if category == "bird":
        return BIRD_PARTS
    if category in TAILED_MAMMALS:
        return {**MAMMAL_PARTS, "tail": ["tail"]}
    return MAMMAL_PARTS


def pack_mask(mask: Column) -> Column:
    """A flattened binary mask as 64-bit words; the last holds what is left, in its low bits."""
    words = F.ceil(F.size(mask) / WORD).cast("int")
    one = lambda w: F.aggregate(
        F.slice(mask, w * WORD + 1, WORD), F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR((v > 0).cast("bigint"))
    )
    numbers = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, one)


def unpack_mask(words: Column, size: Column) -> Column:
    """The first ``size`` places of a packed mask of that size, as 0 and 1."""

    def bit(at: Column) -> Column:
        word = F.floor(at / WORD).cast("int")
        left = F.least(F.lit(WORD), size - word * WORD) - 1 - at % WORD
        return F.call_function("shiftright", F.get(words, word), left.cast("int")).bitwiseAND(F.lit(1)).cast("int")

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, bit)


def merge_words(one: Column, two: Column) -> Column:
    """OR of two packed masks; a word that one of them lacks counts as empty."""
    none = F.lit(0).cast("bigint")
    return F.zip_with(one, two, lambda a, b: F.coalesce(a, none).bitwiseOR(F.coalesce(b, none)))


def packed_iou(f: Column, p: Column) -> Column:
    """Intersection over union of two packed masks of one size; 0 without overlap."""
    count = lambda c: F.aggregate(c, F.lit(0), lambda acc, w: acc + F.bit_count(w))
    inter = count(F.zip_with(f, p, lambda a, b: a.bitwiseAND(b)))
    union = count(F.zip_with(f, p, lambda a, b: a.bitwiseOR(b)))
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / union)


def mask_iou(f: Column, p: Column) -> Column:
    """Intersection over union of two flattened binary masks; 0 without overlap."""
    return packed_iou(pack_mask(f), pack_mask(p))


def association_score(
    maps: DataFrame,
    masks: DataFrame,
    rate: float = 0.005,
    min_iou: float = ASSOCIATION_IOU,
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """(channel, association): best part's share of images whose thresholded map overlaps the part.

    ``maps``: (image, channel, values); ``masks``: (image, part, mask) on the same grid.
    """
    if thresholds is None:
        flat = maps.select("channel", F.explode("values").alias("value"))
        thresholds = channel_thresholds(flat, rate=rate)
    active = maps.join(thresholds, "channel").select(
        "image", "channel", pack_mask(F.transform("values", lambda v: ((v.cast("double") - F.col("threshold")) > 0).cast("int"))).alias("active")
    )
    # the parts of an image travel together and packed: a map meets them in one row
    parts = masks.select("image", F.struct("part", pack_mask(F.col("mask")).alias("words")).alias("p"))
    parts = parts.groupBy("image").agg(F.collect_list("p").alias("parts"))
    hit = lambda p: (packed_iou(F.col("active"), p["words"]) > min_iou).cast("double")
    hits = F.transform("parts", lambda p: F.struct(p["part"].alias("part"), hit(p).alias("hit")))
    overlap = active.join(parts, "image").select("channel", F.inline(hits))
    rates = overlap.groupBy("channel", "part").agg(F.avg("hit").alias("rate"))
    return rates.groupBy("channel").agg(F.max("rate").alias("association"))


def _mapping(df: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("category"), F.lit(coarse).alias("coarse"), F.lit(fine).alias("part"))
        for c in CATEGORIES
        for coarse, fines in coarse_parts(c).items()
        for fine in fines
    ]
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merge_part_masks(masks: DataFrame) -> DataFrame:
    """(image, category, coarse, mask): OR of the fine masks; an absent coarse part is all zeros.

    ``masks``: (image, category, part, mask).  Parts outside the mapping are
    ignored, but their image and category have rows.  Masks move as packed
    words, and only once: an image's few parts meet in its row, equal ones
    combined before they move.
    """
    mapping = _mapping(masks).groupBy("category").agg(
        F.collect_set("coarse").alias("_all"), F.collect_list(F.struct("part", "coarse")).alias("_known")
    )
    rows = masks.join(F.broadcast(mapping), "category")  # six rows
    coarse = F.get(F.filter("_known", lambda k: k["part"] == F.col("part")), F.lit(0))["coarse"]
    words = F.when(coarse.isNotNull(), F.struct(coarse.alias("coarse"), pack_mask(F.col("mask")).alias("words")))
    found = rows.groupBy("image", "category").agg(
        F.collect_set(words).alias("_parts"), F.max(F.size("mask")).alias("_w"), F.first("_all").alias("_all")
    )
    full = found.select("image", "category", "_parts", "_w", F.explode("_all").alias("coarse"))
    mine = F.filter("_parts", lambda p: p["coarse"] == F.col("coarse"))
    merged = F.aggregate(F.transform(mine, lambda p: p["words"]), pack_mask(F.array_repeat(F.lit(0), F.col("_w"))), merge_words)
    return full.select("image", "category", "coarse", unpack_mask(merged, F.col("_w")).alias("mask"))


def normalize_boxes(boxes: DataFrame) -> DataFrame:
    """Add *_scaled coordinates: relative to the image, min/max swapped when reversed, inside [0,1]."""

    def scaled(first: str, second: str, size: str) -> tuple[Column, Column]:
        a, b = F.col(first) / F.col(size), F.col(second) / F.col(size)
        inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        return inside(F.least(a, b)), inside(F.greatest(a, b))

    x0, x1 = scaled("xmin", "xmax", "width")
    y0, y1 = scaled("ymin", "ymax", "height")
    return boxes.withColumns({"xmin_scaled": x0, "xmax_scaled": x1, "ymin_scaled": y0, "ymax_scaled": y1})


def largest_box(boxes: DataFrame, keys: Sequence[str] = ("image", "category"), order: Sequence[str] = ("box_no",)) -> DataFrame:
    """Box of greatest positive area per key; the first under ``order`` on ties."""
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    rank = F.struct((-area).alias("a"), *[F.col(o) for o in order])
    box = F.struct("ymin", "xmin", "ymax", "xmax", area.alias("area"))
    best = boxes.where(area > 0).groupBy(*keys).agg(F.min_by(box, rank).alias("b"))
    return best.select(*keys, "b.*")


def single_object_images(boxes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(image, category) pairs with exactly one box, and with a part list when one is given."""
    single = (
        boxes.groupBy("image", "category").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("image", "category")
    )
    if parts is not None:
        single = single.join(parts, ["image", "category"], "left_semi")
    return single


def collect_labels(
    rows: DataFrame, keys: Sequence[str] = ("split", "image"), label: str = "category", position: str = "pos"
) -> DataFrame:
    """(keys, labels): distinct categories of each image in first-seen order (a handful per image)."""
    first = rows.groupBy(*keys, label).agg(F.min(position).alias("_p"))
    packed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", label))).alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda s: s[label]).alias("labels"))


def shape_stats(images: DataFrame) -> DataFrame:
    return images.agg(
        F.min("height").alias("min_height"),
        F.max("height").alias("max_height"),
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
    )


def split_counts(rows: DataFrame, split: str = "split") -> DataFrame:
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
