"""Pixel art's hold against a frame-at-a-time model."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import pixel_art as op

PALETTE = [(20, 20, 20), (30, 30, 30), (60, 200, 60), (60, 60, 200), (200, 200, 80)]
CELLS = "label int, frame int, by long, bx long, votes array<long>, q int, a boolean"


def modelled(cells):
    """What each cell should hold, with slack for blocks of two."""
    out, last = [], {}
    for label, frame, by, bx, votes, q, a in sorted(cells, key=lambda c: c[1]):
        was, opaque = last.get((label, by, bx), (q, False))
        if a and opaque and was != q and votes[was] > 0 and votes[was] >= votes[q] - 2 and (was < 2) == (q < 2):
            q = was
        last[label, by, bx] = (q, a)
        out.append((label, frame, by, bx, q, a))
    return out


@pytest.mark.parametrize("span", [1, 5, 128])
def test_spans_hold_what_whole_clips_hold(spark, monkeypatch, span):
    rng, kept, keep = random.Random(3), [], op.stored
    cells = [(label, f, by, 0, [rng.choice([0, 3, 4, 5, 6]) for _ in PALETTE], rng.randrange(5), rng.random() < 0.9) for label in (1, 2, None) for by in range(3) for f in range(60) if rng.random() < 0.9 and not 20 < f < 32]
    monkeypatch.setattr(op, "SPAN", span)
    monkeypatch.setattr(op, "stored", lambda rows, name: (kept.append(keep(rows, name)), kept[-1])[1])
    got = [tuple(r) for r in op.held(spark.createDataFrame(cells, CELLS), PALETTE, 2).collect()]
    key = lambda c: (c[0] or 0, *c[1:])
    assert sorted(got, key=key) == sorted(modelled(cells), key=key)
    assert any(c[5] != r[4] for c, r in zip(sorted(cells, key=key), sorted(got, key=key)))
    assert kept[0].agg(F.max(F.size("f"))).first()[0] <= span  # no list grows with a clip, as each step copies the list so far
