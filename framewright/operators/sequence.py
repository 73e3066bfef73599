"""Sequence operators over clips: period search, loop and one-shot picks, seams, consensus periods.

A clip table has (label, frame, e, n), frames from 0 without gaps. Lags are taken within segments of a clip that overlap by
the largest lag: a vector shuffles once or twice, whatever the number of lags, and no task needs a whole clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FPS = 24
#: Centres that are compared with every point.
MAX_CENTRES = 10_000
#: Frames of a segment.
SEGMENT = 64


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def lag_curves(clip: DataFrame, lo: int, hi: int) -> DataFrame:
    """(label, period, frame, d): distance of each frame to the one ``period`` later."""
    own = F.floor(F.col("frame") / SEGMENT)
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - hi) / SEGMENT))
    spread = clip.select("label", "frame", "e", F.explode(F.sequence(first, own)).alias("segment"))
    rows = spread.groupBy("label", "segment").agg(F.array_sort(F.collect_list(F.struct("frame", "e"))).alias("r"))
    size = F.size("r")

    def of_frame(i: Column) -> Column:
        here = F.col("r")[i]
        last = F.least(F.lit(hi), size - 1 - i)
        lags = F.when(last >= lo, F.sequence(F.lit(lo), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(lags, lambda p: F.struct(p.alias("period"), here["frame"].alias("frame"), distance(here["e"], F.col("r")[i + p]["e"]).alias("d")))

    early = F.sequence(F.lit(0), F.least(F.lit(SEGMENT), size) - 1)
    curves = rows.select("label", F.explode(F.flatten(F.transform(early, of_frame))).alias("c"))
    return curves.select("label", "c.period", "c.frame", "c.d")


def lag_sums(curves: DataFrame) -> DataFrame:
    """(label, period, score, d, frame): the mean distance of each lag, its least one, and the first frame that has it."""
    sums = curves.groupBy("label", "period").agg(F.avg("d").alias("score"), F.min(F.struct("d", "frame")).alias("m"))
    return sums.select("label", "period", "score", "m.d", "m.frame")


def score_curve(clip: DataFrame, lo: int = 8, hi: int = 30) -> DataFrame:
    """(label, period, score): mean distance per lag, 4 decimals."""
    return lag_sums(lag_curves(clip, lo, hi)).select("label", "period", F.round("score", 4).alias("score"))


def valleys(scores: DataFrame) -> DataFrame:
    """Interior local minima of (label, period, score), with best: the least score."""
    w = W.partitionBy("label").orderBy("period")
    near = scores.select(
        "label", "period", "score", F.min("score").over(W.partitionBy("label")).alias("best"),
        F.lag("score").over(w).alias("before"), F.lead("score").over(w).alias("after"),
    )
    return near.filter("score <= before and score <= after").select("label", "period", "score", "best")


def _listed(sums: DataFrame) -> DataFrame:
    """(label, lags): the sums of a clip's lags in one row, by period; there are as many as lags were asked for."""
    return sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("period", "score", "d", "frame"))).alias("lags"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chosen(lags: Column, tolerance: float) -> Column:
    """Of a clip's lags the shortest valley within ``tolerance`` of the best one, else the best one."""
    score = lambda i: lags[i]["score"]
    inner = F.when(F.size(lags) > 2, F.sequence(F.lit(1), F.size(lags) - 2)).otherwise(F.array().cast("array<int>"))
    best = F.array_min(lags["score"])
    fits = F.filter(inner, lambda i: (score(i) <= score(i - 1)) & (score(i) <= score(i + 1)) & (score(i) <= best * tolerance))
    least = F.array_min(F.transform(lags, lambda x, i: F.struct(x["score"].alias("score"), i.alias("i"))))["i"]
    return lags[F.coalesce(F.array_min(fits), least)]


def find_cycle(curves: DataFrame, tolerance: float = 1.15) -> DataFrame:
    """(label, period, start, seam): the shortest valley within ``tolerance`` of the best lag, else the best lag."""
    found = _listed(lag_sums(curves)).select("label", _chosen(F.col("lags"), tolerance).alias("c"))
    return found.select("label", "c.period", F.col("c.frame").alias("start"), F.round("c.d", 6).alias("seam"))


def loop_picks(clip: DataFrame, n: int = 8, lo: int = 8, hi: int = 30, tolerance: float = 1.15) -> DataFrame:
    """(label, slot, pick, fps): up to ``n`` evenly spaced frames of the loop, from the frame with the lowest head on.

    A loop that is half of a better one (0.95 of the score near twice the period) is searched again there. The head's
    height is the vector's first value.
    """
    rounded = lambda x: F.round(x["score"], 4)

    def cycle(lags: Column, once: Column) -> Column:
        near = F.filter(lags, lambda x: x["period"].between(2 * once["period"] - 2, 2 * once["period"] + 2))
        better = F.array_min(F.transform(near, rounded)) < 0.95 * rounded(once)
        return F.when(F.coalesce(better, F.lit(False)), _let(near, lambda x: _chosen(x, tolerance))).otherwise(once)

    lags = F.col("lags")
    found = _listed(lag_sums(lag_curves(clip, lo, hi))).select("label", _let(_chosen(lags, tolerance), lambda once: cycle(lags, once)).alias("c"))
    cycles = found.select("label", "c.period", F.col("c.frame").alias("start"))
    heads = clip.select("label", "frame", F.element_at("e", 1).alias("head")).join(cycles, "label")
    heads = heads.filter(F.col("frame").between(F.col("start"), F.col("start") + F.col("period") - 1))
    phase = heads.groupBy("label", "period", "start").agg(F.max(F.struct("head", -F.col("frame"))).alias("m"))
    phase = phase.select("label", "period", "start", (-F.col("m.col2") - F.col("start")).alias("phase"), F.least(F.lit(n), F.col("period")).alias("n"))
    slots = phase.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    step = F.bround(F.col("slot") * F.col("period") / F.col("n")).cast("int")
    return slots.select(
        "label", "slot", (F.col("start") + (F.col("phase") + step) % F.col("period")).alias("pick"),
        F.round(F.col("n") * FPS / F.col("period"), 6).alias("fps"),
    )


def common_cycle(scores: DataFrame, lo: int = 10, hi: int = 40) -> DataFrame:
    """(label, cycle, length): one period that fits the curves of all labels, and each label's own lag near it."""
    scores = scores.persist()  # a row a lag, read several times
    low = valleys(scores).select("label", "period", (F.col("score") / F.col("best")).alias("rel"))
    best = scores.groupBy("label").agg(F.min(F.struct("score", "period"))["period"].alias("best"))
    parts = best.select("label", F.explode(F.array(*[F.col("best") / k for k in (1, 2, 3)])).alias("f")).filter(F.col("f") >= 0.7 * lo)
    backed = parts.join(low.filter("rel <= 1.8"), "label", "left").groupBy("label", "f").agg(
        F.max(F.col("period").between(0.8 * F.col("f"), 1.25 * F.col("f")).cast("int")).alias("ok")
    )
    tried = backed.select("label", "f", F.when(F.col("ok") == 1, 0.0).otherwise(0.5).alias("extra"), F.explode(F.sequence(F.lit(2 * lo), F.lit(2 * hi))).alias("c2"))
    cost = tried.groupBy("label", "c2").agg(F.min(F.abs(F.log(F.col("f") / (F.col("c2") / 2))) + F.col("extra")).alias("cost"))
    total = cost.groupBy("c2").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("dirs"))
    floor = total.agg(F.min("cost").alias("floor"), F.max("dirs").alias("all"))
    cycle = total.join(F.broadcast(floor), F.col("cost") <= F.col("floor") + 0.01 * F.col("all") + 1e-9).agg((F.max("c2") / 2).alias("c"), F.first("all").alias("all"))
    aims = cycle.select("all", F.explode(F.array(F.struct(F.col("c").alias("t"), F.lit(1).alias("k")), F.struct((2 * F.col("c")).alias("t"), F.lit(2).alias("k")))).alias("a")).select("all", "a.*")
    ratio = F.abs(F.log(F.col("period") / F.col("t")))
    near = low.filter("rel <= 3").join(F.broadcast(aims), ratio <= F.log(F.lit(1.6)))
    near = near.groupBy("label", "k", "t", "all").agg(F.min(F.struct(F.round(ratio + 0.3 * (F.col("rel") - 1), 9), "rel", "period")).alias("m"))
    near = near.select("label", "k", "t", "all", F.col("m.rel").alias("rel"), F.col("m.period").alias("length"))
    both = near.filter("k = 1").select("label", F.col("rel").alias("rel1")).join(near.filter("k = 2").select("label", F.col("rel").alias("rel2")), "label")
    votes = both.agg(F.count_if(F.col("rel2") < 0.75 * F.col("rel1")).alias("votes"))
    picked = near.join(F.broadcast(votes), F.when(2 * F.col("votes") > F.col("all"), 2).otherwise(1) == F.col("k"))
    return picked.select("label", F.col("t").alias("cycle"), "length")


def active_window(clip: DataFrame) -> DataFrame:
    """(label, first, last, peak): where a clip differs from its first frame, padded by 2; the whole clip if nowhere."""
    w = W.partitionBy("label").orderBy("frame")
    diff = clip.select("label", "frame", "n", distance(F.col("e"), F.first("e").over(w)).alias("d"))
    top = diff.withColumn("limit", F.greatest(F.lit(0.004), 0.2 * F.max("d").over(W.partitionBy("label"))))
    found = top.groupBy("label").agg(
        F.min(F.when(F.col("d") > F.col("limit"), F.col("frame"))).alias("a"), F.max(F.when(F.col("d") > F.col("limit"), F.col("frame"))).alias("b"),
        F.max(F.struct("d", -F.col("frame"))).alias("m"), F.max("n").alias("n"),
    )
    return found.select(
        "label", F.coalesce(F.greatest(F.col("a") - 2, F.lit(0)), F.lit(0)).alias("first"),
        F.coalesce(F.least(F.col("b") + 2, F.col("n") - 1), F.col("n") - 1).cast("int").alias("last"), (-F.col("m.col2")).alias("peak"),
    )


def active_window_hold(clip: DataFrame) -> DataFrame:
    """The same from steps between frames, for motions that end in a held pose; falls back to the plain window."""
    w = W.partitionBy("label").orderBy("frame")
    step = clip.select("label", "frame", "n", distance(F.col("e"), F.lead("e").over(w)).alias("s"), distance(F.col("e"), F.first("e").over(w)).alias("d"))
    top = step.withColumn("limit", F.greatest(F.lit(0.002), 0.15 * F.max("s").over(W.partitionBy("label"))))
    moving = top.filter(F.col("s") > F.col("limit")).groupBy("label").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    ends = step.join(moving, "label").select("label", "frame", "d", "n", F.greatest(F.col("a") - 2, F.lit(0)).alias("first"), F.least(F.col("b") + 3, F.col("n") - 1).cast("int").alias("last"))
    peaks = ends.filter("frame <= last").groupBy("label", "first", "last").agg(F.max(F.struct("d", -F.col("frame"))).alias("m"))
    held = peaks.select("label", "first", "last", (-F.col("m.col2")).alias("peak"))
    return held.unionByName(active_window(clip).join(moving, "label", "left_anti"))


def oneshot_picks(window: DataFrame, n: int = 8) -> DataFrame:
    """(label, slot, pick): evenly spaced frames of the window; the slot nearest to the peak takes it; sorted, distinct."""
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.col("first") + F.bround(i * (F.col("last") - F.col("first")) / (n - 1)).cast("int")).alias("pick"), i.alias("slot")))
    with_even = window.withColumn("even", even)
    best = F.array_min(F.transform("even", lambda p: F.struct(F.abs(p["pick"] - F.col("peak")).alias("gap"), p["slot"].alias("slot"))))["slot"]
    forced = F.transform("even", lambda p: F.when(p["slot"] == F.col("best"), F.col("peak")).otherwise(p["pick"]))
    picks = with_even.withColumn("best", best).select("label", F.array_sort(F.array_distinct(forced)).alias("picks"))
    return picks.select("label", F.posexplode("picks").alias("slot", "pick"))


def seams(clip: DataFrame) -> DataFrame:
    """(label, jump, step, bad): the jump from the last frame to the first against the median step."""
    w = W.partitionBy("label").orderBy("frame")
    steps = clip.select("label", "frame", "n", "e", distance(F.col("e"), F.lead("e").over(w)).alias("s"), distance(F.col("e"), F.first("e").over(w)).alias("d"))
    out = steps.groupBy("label").agg(F.max(F.when(F.col("frame") == F.col("n") - 1, F.col("d"))).alias("jump"), F.median("s").alias("step"))
    return out.select("label", F.round("jump", 6).alias("jump"), F.round("step", 6).alias("step"), ((F.col("jump") > 0.01) & (F.col("jump") > 2.2 * F.col("step"))).alias("bad"))


def nearest_of(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, k): the centre (k, e) nearest to each point (id, e); ties go to the least k. More than MAX_CENTRES centres are an error."""
    if centres.limit(MAX_CENTRES + 1).count() > MAX_CENTRES:
        raise ValueError(f"nearest_of takes up to {MAX_CENTRES} centres")
    table = centres.agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("centres"))
    gap = lambda c: F.aggregate(F.zip_with(F.col("e"), c["e"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return points.join(F.broadcast(table)).select("id", F.array_min(F.transform("centres", lambda c: F.struct(F.round(gap(c), 9).alias("d"), c["k"].alias("k"))))["k"].alias("k"))


def mean_vectors(points: DataFrame) -> DataFrame:
    """(k, e): the mean vector of each label of (label, e), 6 decimals."""
    means = points.select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg("v"), 6).alias("v"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("l"))
    return listed.select(F.col("label").alias("k"), F.col("l.v").alias("e"))


def shifted_picks(picks: DataFrame, lags: DataFrame, ends: DataFrame) -> DataFrame:
    """(label, slot, pick): picks (label, slot, pick) moved by each label's lag (label, lag), kept inside its clip (label, n)."""
    moved = picks.join(lags, "label").join(ends, "label")
    return moved.select("label", "slot", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("pick") + F.col("lag"))).alias("pick"))
