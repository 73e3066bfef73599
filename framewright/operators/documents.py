"""Project documents and their motions as JSON texts and tables: reading, finding, overlaying, merging, partial redo, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOTION = "struct<id:string,name:string,status:string>"
PROJECT = f"struct<id:string,name:string,created:string,turnaround:string,motions:array<{MOTION}>>"
#: Seconds of work a direction takes by source, and of drawing a mannequin.
DIRECTION_SECONDS = {"text": 125, "video": 720, "mannequin": 320, "follow": 720}
MANNEQUIN_SECONDS = 50


def projects(documents: DataFrame) -> DataFrame:
    """(place, id, name, created, turnaround, motions) of (path, json), last path first.

    Broken documents, and those without an id, name, date or turnaround, are left out; missing motions count 0.
    """
    p = F.from_json("json", PROJECT, {"mode": "PERMISSIVE"})
    good = documents.select("path", p.alias("p")).filter("p.id is not null and p.name is not null and p.created is not null and p.turnaround is not null")
    motions = F.when(F.col("p.motions").isNull(), 0).otherwise(F.size("p.motions"))
    listed = good.select("path", "p.id", "p.name", "p.created", "p.turnaround", motions.alias("motions"))
    return listed.withColumn("place", F.row_number().over(W.orderBy(F.col("path").desc())) - 1).drop("path")


def motions_of(documents: DataFrame) -> DataFrame:
    """(project, place, id, name, status): the motions of (path, json), in their documents' order."""
    p = F.from_json("json", PROJECT, {"mode": "PERMISSIVE"})
    return documents.select(p.alias("p")).select(F.col("p.id").alias("project"), F.posexplode("p.motions").alias("place", "m")).select("project", "place", "m.*")


def found(wanted: DataFrame, motions: DataFrame) -> DataFrame:
    """``wanted`` (project, id) with name and status of the motion; one that no document has is an error."""
    there = motions.select("project", "id", "name", "status", F.lit(True).alias("there"))
    missing = F.raise_error(F.concat(F.lit("no motion "), F.col("id"), F.lit(" in "), F.col("project")))
    return wanted.join(there, ["project", "id"], "left").select("project", F.when(F.col("there"), F.col("id")).otherwise(missing.cast("string")).alias("id"), "name", "status")


def interrupted(motions: DataFrame) -> DataFrame:
    """Motions that were running or waiting when the server stopped are marked interrupted."""
    return motions.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def overlaid(defaults: dict[str, str], own: Column) -> Column:
    """A map of defaults, with the values of a map (null: none) over them."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(rest, own)


def keyframes(text: Column, fields: str = "t:double,v:double") -> Column:
    """The keys of a JSON object that stands somewhere in a text, from its first to its last brace, by time; none is an error."""
    keys = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), f"struct<keys:array<struct<{fields}>>>")["keys"]
    return F.when(F.size(keys) > 0, F.array_sort(keys)).otherwise(F.raise_error(F.lit("no keyframes")))


def repaired_set(held: Column, added: Column, removed: Column) -> Column:
    """The sorted set of repaired frames after adding some and removing others."""
    return F.array_sort(F.array_except(F.array_union(held, added), removed))


def last_wins(files: DataFrame) -> DataFrame:
    """(path, value) of (path, rank, value): of files with one path the one of the highest rank."""
    return files.groupBy("path").agg(F.max(F.struct("rank", "value"))["value"].alias("value"))


def edited_overrides(held: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, slot, frame): chosen frames after edits (key, slot, frame); a null frame takes the choice back."""
    kept = held.join(edits.select("key", "slot"), ["key", "slot"], "left_anti")
    return kept.unionByName(edits.filter("frame is not null"))


def redone(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, dir, value, chosen): results of which some directions were made anew; these lose their chosen frames."""
    again = fresh.select("key", "dir", "value", F.lit(None).cast(dict(held.dtypes)["chosen"]).alias("chosen"))
    return held.join(fresh.select("key", "dir"), ["key", "dir"], "left_anti").unionByName(again)


def active_jobs(jobs: DataFrame) -> DataFrame:
    """(project, id, kind, progress) of jobs that wait or run, newest first by place."""
    live = jobs.filter(F.col("state").isin("queued", "running"))
    return live.select("project", "id", "kind", (F.floor(F.col("progress") * 1000 + 0.5) / 1000).alias("progress"), (F.row_number().over(W.partitionBy("project").orderBy(F.col("created").desc(), "id")) - 1).alias("place"))


def expected_seconds(selected: DataFrame) -> DataFrame:
    """(project, seconds) of (project, source, directions): how long the selected motions will take."""
    each = F.element_at(F.create_map(*[F.lit(x) for pair in DIRECTION_SECONDS.items() for x in pair]), F.col("source"))
    return selected.groupBy("project").agg(F.sum(F.when(F.col("source") == "mannequin", MANNEQUIN_SECONDS).otherwise(0) + F.col("directions") * each).alias("seconds"))


def pixel_cells(cells: DataFrame) -> DataFrame:
    """(key, cells) of (key, dir, height, cell, wanted): pixel cells of a figure's median height, null beyond half to twice the wanted."""
    n = F.bround(F.try_divide("height", "cell")).cast("int")
    mid = cells.groupBy("key").agg(F.median("height").alias("height"), F.first("cell").alias("cell"), F.first("wanted").alias("wanted"))
    return mid.select("key", F.when(n.between(0.5 * F.col("wanted"), 2 * F.col("wanted")), n).alias("cells"))


def pixel_heights(motions: DataFrame, sheets: DataFrame) -> DataFrame:
    """(key, height) of (key, file, style, wanted) and sheets (file, cells): 0 unless pixel art; the measured cells, else the setting."""
    return motions.join(sheets, "file", "left").select("key", F.when(F.col("style") != "pixel", 0).otherwise(F.coalesce(F.nullif("cells", F.lit(0)), "wanted")).alias("height"))


def reseeded(workflow: Column, seed: Column) -> Column:
    """A JSON workflow with every whole-number seed or noise_seed replaced; null where it has none."""
    places = r'("(?:seed|noise_seed)"\s*:\s*)-?\d+(?=\s*[,}\]])'
    return F.when(F.rlike(workflow, F.lit(places)), F.regexp_replace(workflow, F.lit(places), F.concat(F.lit("$1"), seed.cast("string"))))


def filled_json(template: Column, values: dict[str, Column]) -> Column:
    """A JSON template with {{NAME}} filled in at any depth: a whole string takes the value's type, a part its text.

    All marks are filled at once: a value that holds a mark stays as it is.
    """
    names = "|".join(values)
    marks = "\"\\{\\{(?:" + names + ")\\}\\}\"|\\{\\{(?:" + names + ")\\}\\}"
    texts = []
    for name, value in values.items():
        typed = F.coalesce(F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
        inner = F.coalesce(F.regexp_extract(F.to_json(F.array(value.cast("string"))), r'(?s)^\["(.*)"\]$', 1), F.lit(""))
        texts += [F.lit('"{{' + name + '}}"'), typed, F.lit("{{" + name + "}}"), inner]
    found = F.regexp_extract_all(template, F.lit(f"({marks})"), 1)
    pieces = F.zip_with(F.split(template, marks, -1), found, lambda text, mark: F.concat(text, F.coalesce(F.element_at(F.create_map(*texts), mark), F.lit(""))))
    return F.array_join(pieces, "")


def unique_keys(rows: DataFrame, scope: str, order: list[str], key: str) -> DataFrame:
    """(scope, place, name): keys in order; one that is taken gets the least number from 2 on that makes it new.

    Only keys that are equal but for the digits they end in can meet. Where such keys are all equal, or all different, a
    name follows from its place among them; only the others are named one after another, in a row of their scope.
    """
    at = W.partitionBy(scope).orderBy(*order, key)
    placed = rows.select(F.col(scope).alias("_scope"), F.col(key).alias("key"), (F.row_number().over(at) - 1).alias("place"), F.regexp_extract(F.col(key), r"(?s)^(.*?)[0-9]*$", 1).alias("stem"))
    equal = W.partitionBy("_scope", "stem", "key").orderBy("place")
    alike = W.partitionBy("_scope", "stem")
    placed = placed.withColumn("nth", F.row_number().over(equal))
    mixed = (F.max("nth").over(alike) > 1) & ~F.min("key").over(alike).eqNullSafe(F.max("key").over(alike))
    placed = placed.withColumn("mixed", F.coalesce(mixed, F.lit(False)))
    plain = placed.filter("NOT mixed").select("_scope", "place", F.when(F.col("nth") > 1, F.concat("key", F.col("nth").cast("string"))).otherwise(F.col("key")).alias("name"))

    def step(taken: Column, base: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(base, n.cast("string")))
        new = F.when(F.array_contains(taken, base), F.filter(numbered, lambda k: ~F.array_contains(taken, k))[0]).otherwise(base)
        return F.concat(taken, F.array(new))

    listed = placed.filter("mixed").groupBy("_scope", "stem").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("s"))
    names = F.aggregate(F.col("s.key"), F.array().cast("array<string>"), step)
    folded = listed.select("_scope", F.explode(F.arrays_zip(F.col("s.place").alias("place"), names.alias("name"))).alias("r")).select("_scope", "r.place", "r.name")
    return plain.unionByName(folded).withColumnRenamed("_scope", scope)
