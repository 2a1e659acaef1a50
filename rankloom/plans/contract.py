"""Fixed-width feature contract of the click model inputs.

A contract is read from its JSON form (sections ``field_length_dict``,
``dims_dict``, ``fmap`` and ``stride``); the values below are the parts the
operators need by default.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import accumulate

# ---- fixed values of the contract -------------------------------------------------
INPUT_FIELDS = [
    ("realtime_features", 150),
    ("features_pair_4", 4),
    ("goods_sparse_features", 20),
    ("sequence", 350),
    ("bucket_user_features", 195),
    ("bucket_goods_features", 147),
    ("bucket_pair_features", 24),
    ("context_feature", 3),
    ("bucket_user_cspu_features", 28),
    ("bucket_ozid_cspu_features", 28),
    ("bucket_user_behavior_features", 34),
    ("bucket_goods_gross_features", 1),
]

# order of the 14 sequence segments; the two supplier segments are not used
LONG_LENGTH, SHORT_LENGTH = 30, 20
SEQUENCE_SEGMENTS = [
    ("long_click", LONG_LENGTH, "cspu_idx"),
    ("long_cart", LONG_LENGTH, "cspu_idx"),
    ("long_buy", LONG_LENGTH, "cspu_idx"),
    ("long_buy_supplier", LONG_LENGTH, None),
    ("long_buy_level2", LONG_LENGTH, "level2_idx"),
    ("long_cart_level2", LONG_LENGTH, "level2_idx"),
    ("long_click_level2", LONG_LENGTH, "level2_idx"),
    ("short_click", SHORT_LENGTH, "cspu_idx"),
    ("short_cart", SHORT_LENGTH, "cspu_idx"),
    ("short_buy", SHORT_LENGTH, "cspu_idx"),
    ("short_click_supplier", SHORT_LENGTH, None),
    ("short_click_level2", SHORT_LENGTH, "level2_idx"),
    ("short_cart_level2", SHORT_LENGTH, "level2_idx"),
    ("short_buy_level2", SHORT_LENGTH, "level2_idx"),
]

SPARSE_ID_NAMES = [
    "front_lv1", "front_lv2", "back_lv1", "back_lv2", "back_lv3", "back_lv4", "oz_id", "sku_id", "cspu_id", "spu_id",
    "supplier_id", "selling_points", "oz_pro_id", "storage_type", "goods_unit", "brand", "specification", "origin",
    "shelf_life", "goods_entity",
]

# (name in the sparse id field, vocabulary): concatenated ones first, then the separate ones
SPARSE_CONCATENATED = [
    ("back_lv1", "level1_idx"),
    ("back_lv3", "level3_idx"),
    ("back_lv4", "level4_idx"),
    ("goods_unit", "goods_unit_idx"),
    ("origin", "origin_idx"),
    ("selling_points", "selling_points_idx"),
    ("brand", "brand_idx"),
    ("goods_entity", "entity_idx"),
]
SPARSE_SEPARATE = [("cspu_id", "cspu_idx"), ("supplier_id", "supplier_idx"), ("back_lv2", "level2_idx")]

VOCABULARY = {
    "buy_time": 50,
    "is_click": 2,
    "is_cart": 2,
    "is_buy": 2,
    "level1_idx": 100,
    "level2_idx": 500,
    "level3_idx": 2000,
    "level4_idx": 6000,
    "entity_idx": 6000,
    "cspu_idx": 300000,
    "supplier_idx": 50000,
    "selling_points_idx": 170000,
    "brand_idx": 50000,
    "goods_unit_idx": 100,
    "origin_idx": 10000,
    "week": 10,
    "hour": 30,
    "is_week": 3,
}

# (part of realtime_features, width, vocabulary width of each slot); None = not used
REALTIME_PARTS = [
    ("realtime_user", 5, None),
    ("realtime_pair_click", 1, None),
    ("realtime_front_category", 24, None),
    ("realtime_back_category", 48, 10),
    ("realtime_goods", 15, 32),
    ("realtime_passtime", 21, 114),
    ("realtime_user_group", 36, 32),
]

# discrete slots of the bucket fields as (start, width), and where continuous slots begin
BUCKET_SLOTS = {
    "bucket_user_features": [(0, 66)],
    "bucket_goods_features": [(4, 49)],
    "bucket_pair_features": [(0, 10), (20, 4)],
    "bucket_user_cspu_features": [(0, 28)],
    "bucket_ozid_cspu_features": [(0, 28)],
    "bucket_user_behavior_features": [(0, 34)],
    "bucket_goods_gross_features": [(0, 1)],
}
CONTINUOUS_START = {"bucket_user_features": 120, "bucket_goods_features": 98}
PAIR_NAMES = ["buy_time", "is_click", "is_cart", "is_buy"]

HORIZONS = [1, 3, 7, 14]
TOTAL_HORIZONS = [1, 7, 14, 30]
# -----------------------------------------------------------------------------------


@dataclass
class FeatureContract:
    fields: list[tuple[str, int]] = field(default_factory=lambda: list(INPUT_FIELDS))
    dims: dict[str, dict[str, int]] = field(default_factory=lambda: {"others": dict(VOCABULARY)})
    names: dict[str, list[str]] = field(default_factory=lambda: {"goods_idx": list(SPARSE_ID_NAMES)})

    @property
    def strides(self) -> list[int]:
        return list(accumulate(w for _, w in self.fields))

    @property
    def width(self) -> int:
        return self.strides[-1]

    def group_dims(self, group: str) -> list[int]:
        """Vocabulary sizes of a field group, in feature-map order."""
        return [self.dims[group][n] for n in self.names[group]]

    @staticmethod
    def from_json(text: str) -> FeatureContract:
        raw = json.loads(text)
        lengths = raw["field_length_dict"]
        return FeatureContract(
            [(n, lengths[n]) for n in raw["stride"]["inputs"]], raw["dims_dict"], raw["fmap"]
        )
