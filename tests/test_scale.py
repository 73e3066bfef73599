"""Plans that must not grow faster than their input: where pixels are dealt, what is shuffled, what is never broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from framewright.operators import cutout, effects, palette, regions
from framewright.plans import catalog
from framewright.sources import tables

SF = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pictures_are_dealt_by_frame_before_they_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(tables, "PICTURES_A_TASK", 20)
    rows = tables.pictures(spark, SF)
    assert rows.rdd.getNumPartitions() == 25
    text = plan(rows)
    assert text.index("explode") < text.index("hashpartitioning(label")  # plans are printed from the last step to the first


@pytest.mark.parametrize("name", ["img_combine", "img_combine_shadow", "img_matte_vivid", "img_cutouts", "img_finish", "img_merge_edit", "img_frame_alpha", "img_drawing_alpha", "img_splice", "img_detached"])
def test_kernels_of_a_chain_deal_pixels_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3  # vectors by label, vectors by frame, digests
    assert "Join" not in text and text.count("Window [") == 1


@pytest.mark.parametrize("name", ["img_sheet_cells", "img_missing_cells"])
def test_sheet_cells_broadcast_nothing(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


def test_outlines_need_no_window_over_pixels(spark):
    rows = regions.added(tables.pictures(spark, SF), {"alpha": F.col("a") / 255.0})
    text = plan(effects.clean_silhouette(rows))
    assert "RowFrame, 1, unboundedfollowing" not in text  # quadratic in a label's frames
    assert not re.search(r"windowspecdefinition\(label#\d+, y#\d+, x#\d+", text)


def test_a_note_is_lost_where_rows_may_move(spark):
    rows = tables.pictures(spark, SF)
    assert regions.added(rows, {"k": F.lit(1)})._framed == rows._framed
    moved = rows.filter("x < 30")
    assert getattr(moved, "_framed", None) is None
    shuffled = moved.repartition(3, "x")
    whole = cutout.distances(shuffled, "d", F.col("a") > 0, 3).groupBy("label", "frame").agg(F.sum("d").alias("d")).agg(F.count("*")).collect()
    assert whole == [(500,)]


@pytest.mark.parametrize("name", ["exp_document", "exp_resource"])
def test_sheets_shuffle_narrow_lines_once(spark, name, monkeypatch):
    monkeypatch.setattr(tables, "CELLS_A_TASK", 500)
    rows = catalog.QUERIES[name](spark, SF)
    assert plan(rows).count("Exchange") == 1
    assert rows.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500)


def test_steps_between_frames_join_in_as_many_tasks_as_the_pixels_need(spark, monkeypatch):
    monkeypatch.setattr(tables, "PICTURES_A_TASK", 20)
    text = plan(catalog.QUERIES["img_frame_steps"](spark, SF))
    assert len(re.findall(r"hashpartitioning\(label#\d+, next#\d+L?, y#\d+, x#\d+, 25\)", text)) == 2


@pytest.mark.parametrize("name", ["img_combine_shadow", "img_effects", "img_finish", "img_cutouts", "img_refined_edges", "img_matte_vivid", "img_chroma_alpha", "img_frame_alpha", "img_plain_alpha", "img_reference"])
def test_kernels_of_a_chain_take_pixels_to_python_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert len(re.findall(r"(?<!Python)MapInArrow", text)) == 1


def test_outlines_and_palettes_go_with_one_pixel_of_a_frame(spark):
    text = plan(catalog.QUERIES["img_bursts"](spark, SF))
    assert len(re.findall(r"MapInArrow", text)) == 2 and not re.search(r"Sort [^\n]*outlines", text)


def test_palettes_sort_no_box_whole(spark, monkeypatch):
    plans, keep = {}, palette.stored
    monkeypatch.setattr(palette, "stored", lambda rows, name: (plans.setdefault(name, plan(rows)), keep(rows, name))[1])
    catalog.QUERIES["img_palette"](spark, SF)
    assert "Window" not in plans["palette-sides"] + plans["palette-centres"]
    assert "_at#" in plans["palette-cuts"]  # only the step of the half is put in order


def test_skinned_vertices_are_not_shuffled(spark):
    text = plan(catalog.QUERIES["skel_skinned"](spark, SF))
    top = text[: text.index("MapInArrow")]
    assert "Exchange" not in top and not re.search(r"hashpartitioning\([^)]*vertex", text[: text.index("Union")])


def test_bodies_of_one_tile_are_moved_in_one_pass(spark):
    text = plan(catalog.QUERIES["skel_skinned"](spark, SF))
    assert text.count("MapInArrow") == 1 and text.count("Union") == 1  # influences and transforms are dealt once


def test_small_frames_of_pixel_art_are_dealt_before_they_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(tables, "FRAMES_A_TASK", 20)
    text = plan(catalog.QUERIES["px_clean"](spark, SF))
    assert re.search(r"posexplode.*?Exchange hashpartitioning\(label#\d+, frame#\d+, 25\)", text, re.S)
