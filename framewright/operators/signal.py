"""Signal operators over (user_id, frame, value, n): scores, lags, islands, smoothing, gaps, resampling, blending.

Windows partition by signal and order by frame; where another frame of the same signal is needed at a computed index,
it is joined by key. Each needs one shuffle by signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by():
    return W.partitionBy("user_id")


def _order():
    return W.partitionBy("user_id").orderBy("frame")


def zscores(sig: DataFrame) -> DataFrame:
    """(user_id, frame, z): value against the signal's mean, over its population deviation."""
    z = (F.col("value") - F.avg("value").over(_by())) / (F.stddev_pop("value").over(_by()) + 1e-6)
    return sig.select("user_id", "frame", F.round(z, 6).alias("z"))


def best_lags(sig: DataFrame, most: int = 10, rows: int = 24) -> DataFrame:
    """(user_a, user_b, lag, score): the lag at which signal b = a + 1 agrees best with a; ties go to the least lag."""
    z = zscores(sig)
    a = z.select(F.col("user_id").alias("user_a"), F.col("frame"), F.col("z").alias("za"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    a = a.withColumn("user_b", F.col("user_a") + 1).withColumn("at", F.col("frame") + F.col("lag"))
    b = z.select(F.col("user_id").alias("user_b"), F.col("frame").alias("at"), F.col("z").alias("zb"))
    scores = a.join(b, ["user_b", "at"]).groupBy("user_a", "user_b", "lag").agg(F.round(F.avg(F.col("za") * F.col("zb")), 6).alias("score"), F.count(F.lit(1)).alias("m")).filter(F.col("m") >= rows)
    best = scores.groupBy("user_a", "user_b").agg(F.max(F.struct("score", -F.col("lag"))).alias("s"))
    return best.select("user_a", "user_b", (-F.col("s.col2")).alias("lag"), F.col("s.score").alias("score"))


def stance_slopes(sig: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, slope): weighted mean slope of the runs in which the signal moves in its main direction."""
    steps = sig.select("user_id", "frame", "value", (F.lead("value").over(_order()) - F.col("value")).alias("d"))
    sign = F.when(F.count_if(F.col("d") < -0.5).over(_by()) >= F.count_if(F.col("d") > 0.5).over(_by()), -1).otherwise(1)
    moving = steps.filter("d is not null").withColumn("sign", sign).withColumn("moving", F.col("sign") * F.col("d") > 0.5)
    share = F.avg(F.col("moving").cast("int")).over(_by())
    runs = moving.withColumn("share", share).withColumn("island", F.sum((~F.col("moving")).cast("int")).over(_order().rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.filter("moving and share >= 0.25").groupBy("user_id", "island").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b"), F.count(F.lit(1)).alias("m"))
    runs = runs.filter(F.col("m") >= least)
    points = runs.select("user_id", "island", "m", F.explode(F.sequence("a", "b")).alias("frame")).join(sig.select("user_id", "frame", "value"), ["user_id", "frame"])
    slopes = points.groupBy("user_id", "island", "m").agg(F.abs(F.regr_slope("value", "frame")).alias("s"))
    return slopes.groupBy("user_id").agg(F.round(F.sum(F.col("s") * F.col("m")) / F.sum("m"), 4).alias("slope"))


def active_speed(sig: DataFrame) -> DataFrame:
    """(user_id, first, last, peak): where the speed is over 6 % of its maximum, padded by 2, and the fastest frame."""
    speed = sig.select("user_id", "frame", "n", F.coalesce(F.abs(F.col("value") - F.lag("value").over(_order())), F.lit(0.0)).alias("s"))
    top = speed.withColumn("limit", 0.06 * F.max("s").over(_by()))
    on = F.when(F.col("s") > F.col("limit"), F.col("frame"))
    out = top.groupBy("user_id").agg(F.min(on).alias("a"), F.max(on).alias("b"), F.max("n").alias("n"), F.max(F.struct("s", -F.col("frame"))).alias("m"))
    return out.select(
        "user_id", F.coalesce(F.greatest(F.col("a") - 2, F.lit(0)), F.lit(0)).alias("first"),
        F.coalesce(F.least(F.col("b") + 2, F.col("n") - 1), F.col("n") - 1).alias("last"), (-F.col("m.col2")).alias("peak"),
    )


def smoothed(sig: DataFrame, radius: int = 2, wrap: bool = False) -> DataFrame:
    """(user_id, frame, smooth): Gaussian weights over +-radius frames, around the end or held at it."""
    sigma = max(1.0, radius / 1.5)
    spread = sig.select("user_id", "frame", "n", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("o"))
    at = F.pmod(F.col("frame") + F.col("o"), F.col("n")) if wrap else F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("frame") + F.col("o")))
    near = spread.withColumn("at", at).join(sig.select("user_id", F.col("frame").alias("at"), "value"), ["user_id", "at"])
    weight = F.exp(-(F.col("o") * F.col("o")) / F.lit(2 * sigma * sigma))
    return near.groupBy("user_id", "frame").agg(F.round(F.sum(weight * F.col("value")) / F.sum(weight), 6).alias("smooth"))


def gap_filled(sig: DataFrame, missing) -> DataFrame:
    """(user_id, frame, filled): missing values on the line between their neighbours, or the nearest one at an end."""
    known = F.when(~missing, F.col("value"))
    at = F.when(~missing, F.col("frame"))
    back, ahead = _order().rowsBetween(W.unboundedPreceding, 0), _order().rowsBetween(0, W.unboundedFollowing)
    near = sig.select(
        "user_id", "frame", F.last(known, True).over(back).alias("v0"), F.last(at, True).over(back).alias("f0"),
        F.first(known, True).over(ahead).alias("v1"), F.first(at, True).over(ahead).alias("f1"),
    )
    line = F.when(F.col("f1") == F.col("f0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("frame") - F.col("f0")) / (F.col("f1") - F.col("f0")))
    return near.select("user_id", "frame", F.round(F.coalesce(line, "v0", "v1"), 6).alias("filled"))


def resampled(sig: DataFrame, source_fps: float = 30.0, fps: float = 24.0) -> DataFrame:
    """(user_id, i, source, value): the nearest source frame for every frame at the new rate."""
    counts = sig.select("user_id", "n").distinct()
    made = counts.select("user_id", "n", F.explode(F.sequence(F.lit(0), F.ceil((F.col("n") - 1) * F.lit(fps / source_fps)))).alias("i"))
    made = made.select("user_id", "i", F.least(F.col("n") - 1, F.bround(F.col("i") * F.lit(source_fps / fps)).cast("long")).alias("source"))
    return made.join(sig.select("user_id", F.col("frame").alias("source"), "value"), ["user_id", "source"]).select("user_id", "i", "source", "value")


def loop_blended(sig: DataFrame, length: int = 100, blend: int = 12) -> DataFrame:
    """(user_id, frame, blended): the signal repeated to ``length``, its last frames eased towards the first value."""
    first = F.first("value").over(_order())
    width = F.least(F.lit(blend), F.col("n"))
    u = (F.col("frame") - (F.col("n") - width) + 1) / (width + 1)
    ease = F.when(F.col("frame") >= F.col("n") - width, u * u * (3 - 2 * u)).otherwise(0.0)
    eased = sig.select("user_id", F.col("frame").alias("at"), "n", (F.col("value") + (first - F.col("value")) * ease).alias("v"))
    frames = sig.select("user_id", "n").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("frame"), "n").withColumn("at", F.col("frame") % F.col("n"))
    return frames.join(eased.drop("n"), ["user_id", "at"]).select("user_id", "frame", F.round("v", 6).alias("blended"))


def key_interpolated(keys: DataFrame, every: int = 5) -> DataFrame:
    """(user_id, t, pose): keys are every ``every``-th frame; between two of them the value eases by smoothstep."""
    keyed = F.when(F.col("frame") % every == 0, F.col("value"))
    at = F.when(F.col("frame") % every == 0, F.col("frame"))
    back, ahead = _order().rowsBetween(W.unboundedPreceding, 0), _order().rowsBetween(0, W.unboundedFollowing)
    near = keys.select(
        "user_id", F.col("frame").alias("t"), F.last(keyed, True).over(back).alias("v0"), F.last(at, True).over(back).alias("f0"),
        F.first(keyed, True).over(ahead).alias("v1"), F.first(at, True).over(ahead).alias("f1"),
    )
    u = F.when(F.col("f1") > F.col("f0"), (F.col("t") - F.col("f0")) / (F.col("f1") - F.col("f0"))).otherwise(0.0)
    eased = F.col("v0") + (F.coalesce("v1", "v0") - F.col("v0")) * u * u * (3 - 2 * u)
    return near.select("user_id", "t", F.round(eased, 6).alias("pose"))


def drift(sig: DataFrame, limit: float, step: int = 2) -> DataFrame:
    """(user_id, bad, total): frames of every ``step``-th that are off, times ``step``; all frames."""
    off = (F.col("frame") % step == 0) & (F.col("value") > limit)
    return sig.groupBy("user_id").agg((step * F.count_if(off)).alias("bad"), F.count(F.lit(1)).alias("total"))


def changed_from_first(sig: DataFrame, limit: float, share: float = 0.1) -> DataFrame:
    """(user_id, changed, bad): frames far from the first one; bad where they are more than ``share`` of all."""
    away = F.abs(F.col("value") - F.first("value").over(_order())) > limit
    return sig.select("user_id", away.alias("away")).groupBy("user_id").agg(F.count_if(F.col("away")).alias("changed"), (F.avg(F.col("away").cast("int")) > share).alias("bad"))


def played(sig: DataFrame, seconds: float = 2.0, fps: float = 12.0, ticks: float = 60.0) -> DataFrame:
    """(user_id, tick, frame, value, scroll): the frame shown at each tick of playback, and a ground offset."""
    shown = sig.select("user_id", "n").distinct().select("user_id", "n", F.explode(F.sequence(F.lit(0), F.lit(int(seconds * ticks) - 1))).alias("tick"))
    shown = shown.withColumn("frame", F.pmod(F.floor(F.col("tick") * fps / ticks), F.col("n")))
    scroll = F.round(F.pmod(-3.5 * F.col("tick"), F.lit(64.0)), 6)
    return shown.join(sig.select("user_id", "frame", "value"), ["user_id", "frame"]).select("user_id", "tick", "frame", "value", scroll.alias("scroll"))


def stills(sig: DataFrame, count: int = 10) -> DataFrame:
    """(user_id, i, frame, t): ``count`` evenly spaced frames, each once, with their time in seconds at 24 frames a second."""
    ends = sig.select("user_id", "n").distinct()
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (count - 1)).cast("long"))
    chosen = ends.select("user_id", F.posexplode(F.array_sort(F.array_distinct(at))).alias("i", "frame"))
    return chosen.select("user_id", "i", "frame", F.round(F.col("frame") / 24, 6).alias("t"))
