"""Near vectors by spherical-cap filters of a structured random product code.

A vector is turned by a random rotation and cut into BLOCKS blocks. A filter is a choice of one random unit codeword a
block, and stands for the cap of vectors whose inner products with its codewords add up to a threshold or more. A vector
is list-decoded to all filters it exceeds the threshold for: blocks are taken one after the other, and a beginning is
given up as soon as the best codewords of the other blocks can't bring it over the threshold. The threshold gives
LISTED filters on average; a vector that lists fewer than LEAST lowers its own until it has them. Vectors are compared if
they share a filter; with 64 dimensions a pair at a cosine of 0.98 shares none with a probability of about 5e-5 (measured on
random pairs), and nearer pairs practically never. There are as many filters as vectors, at least a million, so that a
filter of spread-out data holds a bounded number of vectors at every size.

Groups of near vectors don't grow into rows of pairs. Equal vectors are one class. A class that is linked with the leader of
one of its filters joins the leader's cell. Filters are joined by cells, not by members. Where the centres and radii of
two cells (or of one cell with itself) settle the matter by the triangle inequality, links are counted by size; the
members of others are compared in blocks of BLOCK_ROWS by matrix products, a row a pair of blocks, which return counts.
A sketch of 128 sign bits keeps far pairs from fetching their vectors; every link is confirmed in double precision.
A group of g near vectors that fills no small ball still takes g * g / 2 products, as its links are to be counted one by one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import ragged, tidy
from framewright.llm.common import join_groups, stored
from framewright.llm.components import components

BLOCKS = 2
LISTED, LEAST = 20, 12
LEAST_CODEWORDS = 1024
SKETCH_WORDS = 2
#: Sketches may differ in so many standard deviations more bits than vectors at the angle in question do.
DEVIATIONS = 6
BLOCK_ROWS = 256
#: Angles that settle a matter without looking at the vectors keep this distance from the limit.
MARGIN = 1e-7


class ProductCode:
    """Rotation, codewords a block, signs and threshold for vectors of ``dim`` components; the same in every process."""

    def __init__(self, dim: int, codewords: int):
        rng = np.random.default_rng([20241105, dim, codewords])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        self.blocks = list(zip(cuts, cuts[1:]))
        self.words = [_unit(rng.standard_normal((codewords, b - a))) for a, b in self.blocks]
        self.signs = rng.standard_normal((dim, 64 * SKETCH_WORDS))
        probe = _unit(rng.standard_normal((500, dim)))
        low, high = 0.0, 2.0
        for _ in range(16):  # the threshold that lists LISTED filters on average
            self.threshold = (low + high) / 2
            many = sum(len(self._listed(probe[k : k + 100], self.threshold)[0]) for k in range(0, 500, 100)) / 500 if self.threshold > 0.2 else math.inf
            low, high = (self.threshold, high) if many > LISTED else (low, self.threshold)

    def _listed(self, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that a row of ``unit`` exceeds ``threshold`` for."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ w.T for (a, b), w in zip(self.blocks, self.words)]
        best = np.stack([s.max(1) for s in scores], 1)
        rest = best.sum(1, keepdims=True) - best
        row, value, number = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        later = best.sum(1)
        for k, s in enumerate(scores):
            later = later - best[:, k]
            of, word = np.nonzero(s >= threshold - rest[:, k : k + 1])
            counts = np.bincount(of, minlength=len(unit))
            at = ragged((np.cumsum(counts) - counts)[row], counts[row])
            again = np.repeat(np.arange(len(row)), counts[row])
            value = value[again] + s[of[at], word[at]]
            number, row = number[again] * s.shape[1] + word[at], row[again]
            keep = value + later[row] >= threshold
            row, value, number = row[keep], value[keep], number[keep]
        return row, number

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of rows of unit vectors, by row: all filters beyond the threshold, LEAST at least (or all there are)."""
        least = min(LEAST, math.prod(len(w) for w in self.words))
        todo, threshold, found = np.arange(len(unit)), self.threshold, []
        while len(todo):
            row, number = self._listed(unit[todo], threshold)
            enough = np.bincount(row, minlength=len(todo)) >= least
            found.append((todo[row[enough[row]]], number[enough[row]]))
            todo, threshold = todo[~enough], threshold - 0.05 * abs(self.threshold)
        row, number = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        order = np.argsort(row, kind="stable")
        return row[order], number[order]

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@functools.lru_cache(maxsize=4)
def product_code(dim: int, codewords: int) -> ProductCode:
    return ProductCode(dim, codewords)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _decoded(classes: DataFrame, codewords: int) -> DataFrame:
    """(class, filter, sketch) of classes (class, dim, v), a row a filter; filters of other dimensions have other numbers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                step = max(1, (1 << 21) // codewords)
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    code, unit = product_code(dim, codewords), _unit(_matrix(part.column("v"), dim))
                    row, number = code.filters(unit)
                    sketch = code.sketch(unit)[row]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("class").take(pa.array(row)), pa.array(number), pa.array(np.full(len(row), dim, np.int32)), *[pa.array(sketch[:, k]) for k in range(SKETCH_WORDS)]],
                        names=["class", "number", "dim", *[f"s{k}" for k in range(SKETCH_WORDS)]],
                    )

    kinds = "class long, number long, dim int, " + ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))
    return classes.select("class", "dim", "v").mapInArrow(tidy(decode), kinds)


def _cosines(pairs: DataFrame) -> DataFrame:
    """``pairs`` with columns u and v (vectors of one length) replaced by cosine."""
    keep = [c for c in pairs.columns if c not in ("u", "v")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.zeros(batch.num_rows)
            dims = np.diff(batch.column("u").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                own = np.nonzero(dims == dim)[0]
                a, b = (_unit(_matrix(batch.column(c).take(pa.array(own)), dim)) for c in ("u", "v"))
                cosine[own] = (a * b).sum(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(cosine)], names=[*keep, "cosine"])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in keep)
    return pairs.mapInArrow(tidy(measure), f"{kinds}, cosine double")


def _near_sketch(right: str, angle: Column) -> Column:
    """Whether sketches s0, .. and <right>0, .. may belong to vectors within ``angle``."""
    bits, share = 64 * SKETCH_WORDS, F.least(F.lit(1.0), angle / math.pi)
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"{right}{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    return differ <= bits * share + DEVIATIONS * F.sqrt(bits * share * (1 - share))


def _compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """(class, cell, other, many): links of members of cell with those of other, for pairs (a, b) of cells, a = b too.

    ``members`` has (cell, class, size, v). Blocks of members meet in matrix products; a block with another is a row.
    A member isn't linked with itself here.
    """
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("classes"))
    wanted = pairs.select(F.col("a").alias("cell")).union(pairs.select(F.col("b").alias("cell"))).distinct()
    rows = members.join(wanted, "cell", "left_semi").join(sizes, "cell")
    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("classes") / BLOCK_ROWS))
    blocks = rows.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("class", "size", "v")).alias("rows"))
    blocks = stored(blocks, "blocks")
    left, right = (blocks.select(F.col("cell").alias(c), F.col("block").alias(f"k{c}"), F.col("rows").alias(f"r{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("ka") <= F.col("kb")))
    both = both.select("a", "b", ((F.col("a") == F.col("b")) & (F.col("ka") == F.col("kb"))).alias("own"), "ra", "rb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in ("a", "b"))
                one, two = (batch.column(c)[k].values for c in ("ra", "rb"))
                own = [x.field("class").to_numpy() for x in (one, two)]
                size = [x.field("size").to_numpy() for x in (one, two)]
                u, v = (_unit(_matrix(x.field("v"), len(one.field("v")[0]))) for x in (one, two))
                near = u @ v.T >= cosine
                ways = [(own[0], near, size[1], a, b), (own[1], near.T, size[0], b, a)]
                if batch.column("own")[k].as_py():
                    np.fill_diagonal(near, False)
                    del ways[1]
                for ids, links, sizes, cell, other in ways:
                    counts = links @ sizes
                    hit = np.nonzero(counts)[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[hit]), pa.array(np.full(len(hit), cell, np.int64)), pa.array(np.full(len(hit), other, np.int64)), pa.array(counts[hit].astype(np.int64))],
                        names=["class", "cell", "other", "many"],
                    )

    return both.mapInArrow(tidy(compare), "class long, cell long, other long, many long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, codewords: int | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Rows with equal, not null labels, vectors of one length and a cosine of at least ``cosine`` (above 0.9) in double precision
    are linked, if the filters bring them together; no pair below it is. n_links counts the other rows linked with a row
    directly; component_id is the least id reachable. A null label, and a vector that is null, empty, zero or holds null
    or non-finite components, is linked with nothing: no links, its own id as component. Rows repeated with the same id
    are rows of their own, linked if their vectors are; a null id is never the least beside others. ``kept`` is whether
    the id is component_id. ``codewords`` (a block) follow from the number of rows if not given. Other columns don't
    matter; an empty table gives an empty result.
    """
    good = vectors[vector_col].isNotNull() & vectors[label_col].isNotNull() & (F.size(vectors[vector_col]) > 0)
    sound = F.forall(vectors[vector_col], lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vectors[vector_col], lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), F.when(good & sound, F.struct(vectors[label_col].alias("label"), vectors[vector_col].alias("v"))).alias("key"))
    valid = rows.filter("key is not null")
    classes = valid.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "key", F.col("key.v").alias("v"), F.size("key.v").alias("dim"), "least", "size"), "classes")
    total = max(1, classes.count())
    words = codewords or max(LEAST_CODEWORDS, math.isqrt(total))
    limit = math.acos(cosine)

    labels = classes.select("class", F.col("key.label").alias("label"))
    sketch = [f"s{k}" for k in range(SKETCH_WORDS)]
    met = _decoded(classes, words).join(labels, "class").select(F.xxhash64("label", "dim", "number").alias("filter"), "class", *sketch)
    met = stored(met, "filters")
    # the first of each filter in a random order leads it
    rank = F.xxhash64("class")
    heads = met.groupBy("filter").agg(F.min(F.struct(rank.alias("rank"), "class", *sketch)).alias("head"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    heads = stored(heads.select("filter", "many", F.col("head.class").alias("leader"), *[F.col(f"head.s{k}").alias(f"t{k}") for k in range(SKETCH_WORDS)]), "leaders")
    n_met = max(1, met.count())
    led = stored(join_groups(met, heads, "filter", "many", n_met).filter((F.col("class") != F.col("leader")) & _near_sketch("t", F.lit(limit))).select("class", "leader").distinct(), "led")
    key = classes.select(F.col("class"), "key", "v")
    followers = stored(led.groupBy("leader").agg(F.count(F.lit(1)).alias("many")).join(key.select(F.col("class").alias("leader"), F.col("key.label").alias("label2"), F.col("v").alias("u")), "leader"), "followers")
    tried = join_groups(led, followers, "leader", "many", max(1, led.count())).join(key, "class")
    tried = tried.filter((F.col("key.label") == F.col("label2")) & (F.size("u") == F.size("v"))).select("class", "leader", "u", "v")
    joined = _cosines(tried).filter(F.col("cosine") >= cosine)
    chosen = joined.groupBy("class").agg(F.min(F.struct(F.xxhash64("leader").alias("rank"), "leader", "cosine")).alias("best"))
    placed = classes.join(chosen, "class", "left")
    placed = placed.select("class", F.coalesce("best.leader", "class").alias("cell"), F.coalesce("best.cosine", F.lit(1.0)).alias("cosine"), "least", "size", "v")
    placed = stored(placed, "placed")
    cells = placed.groupBy("cell").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("classes"), F.min("cosine").alias("inner"), F.min("least").alias("least"))
    cells = cells.withColumn("radius", F.when(F.col("inner") < 1, F.acos("inner")).otherwise(0.0))
    cells = stored(cells.withColumn("tight", (F.col("classes") == 1) | (2 * F.col("radius") <= limit - MARGIN)), "cells")

    # filters hold cells; each cell is there with the sketch of its centre
    centre = met.groupBy("class").agg(*[F.first(c).alias(c) for c in sketch]).withColumnRenamed("class", "cell")
    centre = stored(centre.join(cells.select("cell", "radius"), "cell"), "centres")
    sets = met.select("filter", "class").join(placed.select("class", "cell"), "class").select("filter", "cell").distinct()
    crowded = sets.groupBy("filter").agg(F.collect_set("cell").alias("cells")).filter("size(cells) > 1")
    pairs = crowded.select("cells", F.explode("cells").alias("a")).select("a", F.explode(F.filter("cells", lambda x: x > F.col("a"))).alias("b")).distinct()
    one = centre.select(F.col("cell").alias("a"), F.col("radius").alias("ra"), *sketch)
    two = centre.select(F.col("cell").alias("b"), F.col("radius").alias("rb"), *[F.col(c).alias(f"t{c[1:]}") for c in sketch])
    near = _near_sketch("t", F.lit(limit) + F.col("ra") + F.col("rb"))
    pairs = stored(pairs.join(one, "a").join(two, "b").filter(near).select("a", "b"), "pairs")
    side = lambda c, v: cells.select(F.col("cell").alias(c), F.col("radius").alias(f"r{c}"), F.col("total").alias(f"n{c}")).join(
        key.select(F.col("class").alias(c), F.col("key.label").alias(f"l{c}"), F.col("v").alias(v)), c
    )
    fetched = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").filter((F.col("la") == F.col("lb")) & (F.size("u") == F.size("v")))
    angle, reach = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))), F.col("ra") + F.col("rb")
    verdict = (
        F.when(reach == 0, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
        .when(angle + reach <= limit - MARGIN, "all").when(angle - reach > limit + MARGIN, "none").otherwise("some")
    )
    judged = _cosines(fetched.select("a", "b", "ra", "rb", "na", "nb", "u", "v")).withColumn("verdict", verdict).filter("verdict <> 'none'")
    judged = stored(judged.select("a", "b", "na", "nb", "verdict"), "judged")
    whole = judged.filter("verdict = 'all'")
    loose = cells.filter("not tight").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    partly = stored(_compared(judged.filter("verdict = 'some'").select("a", "b").union(loose), placed.select("cell", "class", "size", "v"), cosine), "partly")

    around = whole.select(F.col("a").alias("cell"), F.col("nb").alias("more")).union(whole.select(F.col("b").alias("cell"), F.col("na").alias("more")))
    around = around.groupBy("cell").agg(F.sum("more").alias("around"))
    beside = partly.groupBy("class").agg(F.sum("many").alias("beside"))
    # members are linked with their cell's leader, wherever that is placed itself
    led_by = placed.select(F.col("class").alias("a"), F.col("cell").alias("b")).join(cells.select(F.col("cell").alias("a")), "a", "left_semi")
    links = whole.select("a", "b").union(partly.select(F.col("cell").alias("a"), F.col("other").alias("b"))).union(led_by)
    group = stored(components(links), "components").withColumnRenamed("node", "cell")
    known = cells.select("cell", "total", F.col("least").alias("cell_least")).join(around, "cell", "left").join(group, "cell", "left")
    known = stored(known.select("cell", "total", "cell_least", F.coalesce("around", F.lit(0)).alias("around"), F.coalesce("component", "cell").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("cell_least").alias("component_id"))
    of_cell = stored(known.join(least, "component").join(cells.select("cell", "classes", "tight"), "cell").drop("component", "cell_least"), "of-cell")
    of_class = join_groups(placed.select("class", "cell", "size"), of_cell, "cell", "classes", total).join(beside, "class", "left")
    links_of = F.when(F.col("tight"), F.col("total")).otherwise(F.col("size")) - 1 + F.col("around") + F.coalesce("beside", F.lit(0))
    answer = stored(of_class.select("class", links_of.alias("n_links"), "component_id").join(classes.select("class", "key", "size"), "class").drop("class"), "answers")
    together = join_groups(valid, answer, "key", "size", max(1, rows.count())).select("id", "n_links", "component_id")
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return alone.unionByName(together).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_cap_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
