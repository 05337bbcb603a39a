"""Schemas and the dimension tables of classes and experts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class ids, expert ids, aliases, tracking gates.
CLASS_IDS = {"car": 0, "truck": 1, "trailer": 2, "bus": 3, "construction_vehicle": 4, "bicycle": 5, "motorcycle": 6, "pedestrian": 7, "traffic_cone": 8, "barrier": 9}
EXPERT_IDS = {"centerpoint": 0, "pointpillars": 1, "centerpoint_pillar": 2, "ssn": 3, "voxelnext": 4, "transfusion_l": 5, "bevfusion_lidar": 6}
UNKNOWN_CLASS, UNKNOWN_EXPERT = -1, 7
CLASS_ALIASES = {
    "vehicle.car": "car",
    "vehicle.truck": "truck",
    "vehicle.construction": "construction_vehicle",
    "vehicle.bus.rigid": "bus",
    "vehicle.bus.bendy": "bus",
    "vehicle.trailer": "trailer",
    "movable_object.barrier": "barrier",
    "vehicle.motorcycle": "motorcycle",
    "vehicle.bicycle": "bicycle",
    "human.pedestrian.adult": "pedestrian",
    "human.pedestrian.child": "pedestrian",
    "human.pedestrian.wheelchair": "pedestrian",
    "human.pedestrian.stroller": "pedestrian",
    "human.pedestrian.personal_mobility": "pedestrian",
    "human.pedestrian.police_officer": "pedestrian",
    "human.pedestrian.construction_worker": "pedestrian",
    "movable_object.trafficcone": "traffic_cone",
    "movable_object.pushable_pullable": "barrier",
    "movable_object.debris": "barrier",
    "static_object.bicycle_rack": "bicycle",
}
#: Categories that count in figures of recovered objects; the others are dropped there.
EVALUATED_CATEGORIES = tuple(k for k in CLASS_ALIASES if k not in ("human.pedestrian.wheelchair", "human.pedestrian.stroller", "human.pedestrian.personal_mobility", "movable_object.pushable_pullable", "movable_object.debris", "static_object.bicycle_rack"))
COORDINATE_FRAMES = ("global", "ego", "lidar")
TRACK_GATES = {"car": 4.0, "truck": 6.0, "bus": 6.0, "trailer": 6.0, "construction_vehicle": 4.0, "pedestrian": 1.0, "motorcycle": 4.0, "bicycle": 2.5, "traffic_cone": 1.0, "barrier": 1.0}
#: In the order of the model's input vector.
FEATURES = ("expert_id", "detection_score", "dist_from_ego", "box_width", "box_length", "box_height", "vel_magnitude", "n_peer_overlaps", "max_peer_iou", "mean_peer_score", "score_variance", "expert_agreement", "n_spatial_overlaps", "class_agreement", "max_class_score", "n_active_experts", "dist_to_drivable_area")
NEURAL_FEATURES = tuple(f for f in FEATURES if f != "dist_to_drivable_area")

_doubles = T.ArrayType(T.DoubleType())
#: One box of a submission file.
SUBMITTED = T.StructType([T.StructField("sample_token", T.StringType()), *(T.StructField(n, _doubles) for n in ("translation", "size", "rotation", "velocity")), T.StructField("detection_name", T.StringType()), T.StructField("detection_score", T.DoubleType()), T.StructField("attribute_name", T.StringType())])
SUBMISSION = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.BooleanType())), T.StructField("results", T.MapType(T.StringType(), T.ArrayType(SUBMITTED)))])
BOXES = "sample_token string, expert string, expert_ord int, box_pos int, x double, y double, z double, w double, l double, h double, qw double, qx double, qy double, qz double, vx double, vy double, class_name string, class_id int, score double, attribute string, coord_frame string, yaw double"
_matrix = T.ArrayType(_doubles)
#: One frame of raw ground truth; a box is x, y, z, length, width, height, yaw.
GROUND_TRUTH = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("ego2global", _matrix),
        T.StructField("lidar_points", T.StructType([T.StructField("lidar2ego", _matrix), T.StructField("lidar_path", T.StringType()), T.StructField("num_pts_feats", T.IntegerType())])),
        T.StructField("instances", T.ArrayType(T.StructType([T.StructField("bbox_3d", _doubles), T.StructField("bbox_label_3d", T.IntegerType()), T.StructField("bbox_3d_isvalid", T.BooleanType())]))),
    ]
)


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """``table`` as an expression; it is small and fixed, so no join is needed."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def canonical_class(name: Column) -> Column:
    """The class that ``name`` is or stands for; null if neither."""
    return F.when(name.isin(*CLASS_IDS), name).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_ALIASES.items() for x in kv]), name))


def evaluated_class(category: Column) -> Column:
    """As ``canonical_class`` for categories of annotations that count in evaluation; others give null."""
    return F.when(category.isin(*EVALUATED_CATEGORIES), canonical_class(category))
