import math

import numpy as np
import pytest

from framewright.operators import resample
from tests.test_regions import table


def weights(size, to):
    """Lanczos weights as a matrix, straight from the kernel."""
    scale = max(size / to, 1.0)
    out = np.zeros((to, size))
    for t in range(to):
        centre = (t + 0.5) * size / to
        for s in range(size):
            if int(centre - 3 * scale + 0.5) <= s < int(centre + 3 * scale + 0.5):
                v = (s + 0.5 - centre) / scale
                out[t, s] = np.sinc(v) * np.sinc(v / 3) if abs(v) < 3 else 0.0
    return out / out.sum(1, keepdims=True)


def planes(rows, size, names):
    out = np.zeros((len(names), *size))
    for r in rows.collect():
        out[:, r.y, r.x] = [r[c] for c in names]
    return out


@pytest.mark.parametrize("scale", [0.4, 1.0, 1.5])
def test_sprites_against_a_matrix_resampler(spark, scale):
    rng = np.random.default_rng(4)
    data = {c: rng.integers(0, 256, (1, 9, 12)) for c in "rgb"} | {"a": rng.choice([0, 60, 255], (1, 9, 12))}
    to = resample.scaled((9, 12), scale)
    got = planes(resample.shrunk_sprites(table(spark, **data), 9, 12, scale, faint=0), to, "rgba")
    across, down = weights(12, to[1]), weights(9, to[0])
    byte = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    small = lambda v: byte(down @ byte(v @ across.T))
    alpha = small(data["a"][0].astype(float))
    assert np.abs(got[3] - alpha).max() <= 1
    for k, c in enumerate("rgb"):
        carried = np.minimum(small(np.floor(data[c][0] * data["a"][0] / 255 + 0.5)), alpha)  # a colour is 255 at most
        assert np.abs(got[k] * got[3] / 255 - carried)[got[3] > 0].max() <= 2
        assert (got[k][got[3] == 0] == 0).all()


def test_faint_pixels_are_emptied_and_one_size_keeps_all(spark):
    data = {c: np.full((1, 6, 6), 90) for c in "rgb"} | {"a": np.zeros((1, 6, 6), int)}
    data["a"][0, 2, 2], data["a"][0, 4, 4] = 12, 13
    got = {(r.y, r.x): (r.r, r.a) for r in resample.shrunk_sprites(table(spark, **data), 6, 6, 1.0).collect()}
    assert got[4, 4][1] == 13 and all(v == (0, 0) for k, v in got.items() if k != (4, 4))


def test_small_frames_are_area_means(spark):
    rng = np.random.default_rng(6)
    data = {c: rng.integers(0, 256, (2, 6, 9)) for c in "rgb"} | {"a": rng.integers(0, 256, (2, 6, 9))}
    rows = resample.small_frames(table(spark, **data), 6, 9, 6)
    got = planes(rows.filter("frame = 1"), (4, 6), "rgb")
    for k, c in enumerate("rgb"):
        fine = np.kron(data[c][1] * data["a"][1] / 65025, np.ones((2, 2)))  # each pixel as four: 12 x 18 into 4 x 6
        assert np.allclose(got[k], fine.reshape(4, 3, 6, 3).mean((1, 3)))
    assert resample.small_frames(table(spark, **data), 6, 9).filter("frame = 0").count() == 54
    with pytest.raises(ValueError):
        resample.area_taps(3, 4)


def test_steps_go_round_and_skip_single_frames(spark):
    data = {c: np.stack([np.full((4, 4), v) for v in (0, 51, 255)]) for c in "rgb"} | {"a": np.full((3, 4, 4), 255)}
    rows = table(spark, **data)
    got = {(r.frame, r.next): r.step for r in resample.frame_steps(rows, 4, 4).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {(0, 1): 0.2, (1, 2): 0.8, (2, 0): 1.0}
    assert resample.frame_steps(rows.filter("frame = 0"), 4, 4).count() == 0


def test_weights_add_up():
    for size, to in ((32, 13), (5, 5), (7, 20), (3, 1)):
        sums = {}
        for t, _, w in resample.lanczos_taps(size, to):
            sums[t] = sums.get(t, 0) + w
        assert len(sums) == to and all(math.isclose(v, 2**22, abs_tol=40) for v in sums.values())
