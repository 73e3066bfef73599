"""Pose operators: joint chains from angles, projection from several sides with a common fit, keyframe retiming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bone lengths of a three-bone chain, as shares of the body.
BONES = (0.30, 0.25, 0.12)
DECIMALS = 6


def chain_joints(poses: DataFrame) -> DataFrame:
    """(label, frame, joint, x, y, z) of a chain whose bones bend by three angles and turn by a fourth; e has radians."""
    bend = [F.element_at("e", 1), F.element_at("e", 1) + F.element_at("e", 2), F.element_at("e", 1) + F.element_at("e", 2) + F.element_at("e", 3)]
    turn = F.element_at("e", 4)
    x, y, z, joints = F.lit(0.0), F.lit(0.0), F.lit(0.0), []
    for k, (length, angle) in enumerate(zip(BONES, bend)):
        out = length * F.sin(angle)
        x, y, z = x + out * F.cos(turn), y + length * F.cos(angle), z + out * F.sin(turn)
        joints.append(F.struct(F.lit(k + 1).alias("joint"), F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"), F.round(z, DECIMALS).alias("z")))
    return poses.select("label", "frame", F.explode(F.array(*joints)).alias("j")).select("label", "frame", "j.*")


def projected(joints: DataFrame, sides: int = 8, elevation: float = 20.0) -> DataFrame:
    """(label, frame, joint, side, u, v): joints seen from ``sides`` directions, orthographic, from above."""
    yaw = F.radians(F.col("side") * F.lit(360.0 / sides))
    up = F.radians(F.lit(elevation))
    seen = joints.select("*", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    u = F.col("x") * F.cos(yaw) + F.col("z") * F.sin(yaw)
    depth = F.col("z") * F.cos(yaw) - F.col("x") * F.sin(yaw)
    return seen.select("label", "frame", "joint", "side", F.round(u, DECIMALS).alias("u"), F.round(F.col("y") * F.cos(up) - depth * F.sin(up), DECIMALS).alias("v"))


def fit(views: DataFrame) -> DataFrame:
    """(label, scale, foot): one scale and foot line for all sides of a clip, from every second frame, within limits."""
    even = views.filter("frame % 2 = 0").groupBy("label").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.max(F.abs("u")).alias("wide"))
    scale = F.greatest(F.lit(0.36), F.least(F.lit(0.72), 0.45 / F.greatest(F.col("hi") - F.col("lo"), 2 * F.col("wide"))))
    foot = F.greatest(F.lit(0.06), F.least(F.lit(0.3), 0.12 - F.col("lo") * scale * 0.1))
    return even.select("label", F.round(scale, 5).alias("scale"), F.round(foot, 5).alias("foot"))


def retimed_keys(keys: DataFrame, lead: float = 0.4, tail: float = 0.5, length: float = 3.04) -> DataFrame:
    """(user_id, j, t): keys (user_id, j, t, pose) with the holds before and after the action cut short, the action scaled if it must be.

    A hold is a run of equal poses at the start or the end. Times between keep their proportions.
    """
    by = W.partitionBy("user_id")
    order = by.orderBy("j")
    same_first = F.col("pose") == F.first("pose").over(order)
    same_last = F.col("pose") == F.first("pose").over(by.orderBy(F.col("j").desc()))
    first_change = F.min(F.when(~same_first, F.col("j"))).over(by)
    last_change = F.max(F.when(~same_last, F.col("j"))).over(by)
    marked = keys.select("user_id", "j", "t", first_change.alias("a"), last_change.alias("b"), F.max("j").over(by).alias("z"))
    start = F.max(F.when(F.col("j") < F.coalesce("a", F.col("z") + 1), F.col("t"))).over(by)
    stop = F.min(F.when(F.col("j") > F.coalesce("b", F.lit(-1)), F.col("t"))).over(by)
    spans = marked.select("user_id", "j", "t", start.alias("s"), F.greatest(stop, start).alias("e"), F.max("t").over(by).alias("end"))
    head, rest = F.least(F.col("s"), F.lit(lead)), F.least(F.col("end") - F.col("e"), F.lit(tail))
    action = F.col("e") - F.col("s")
    factor = F.when(action > 0, F.least(F.lit(1.0), (length - head - rest) / action)).otherwise(1.0)
    new = (
        F.when(F.col("t") <= F.col("s"), F.when(F.col("s") > 0, F.col("t") * head / F.col("s")).otherwise(0.0))
        .when(F.col("t") <= F.col("e"), head + (F.col("t") - F.col("s")) * factor)
        .otherwise(head + action * factor + (F.col("t") - F.col("e")) * rest / F.greatest(F.col("end") - F.col("e"), F.lit(1e-9)))
    )
    return spans.select("user_id", "j", F.round(new + 1e-7, 5).alias("t"))  # keeps ties on one side


def drawn_order(views: DataFrame) -> DataFrame:
    """(label, frame, side, joint, z): the order in which joints are drawn, the lowest seen first; ties by joint."""
    order = W.partitionBy("label", "frame", "side").orderBy("v", "joint")
    return views.select("label", "frame", "side", "joint", (F.row_number().over(order) - 1).alias("z"))
