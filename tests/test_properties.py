"""Properties over many made inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import columns as C
from tessella.operators import fitting, geometry, masks
from tessella.plans.projections import four_corner_maps, stain_normalise

number = st.floats(-1000, 1000, allow_nan=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(number, number), min_size=3, max_size=8), st.floats(1, 500), st.floats(1, 500))
def test_clipping_never_grows(points, w, h):
    centre = np.mean(points, 0)
    poly = np.array(sorted(points, key=lambda p: np.arctan2(p[1] - centre[1], p[0] - centre[0])))
    hull = np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    cut = geometry._clip(hull, w / 2, h / 2)
    assert abs(geometry._area(cut) - w * h / 4) < 1e-6 * w * h
    clipped = geometry._clip(poly, w, h)
    if len(clipped):
        assert clipped[:, 0].min() >= -1e-6 and clipped[:, 0].max() <= w + 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=6, max_size=6), min_size=1, max_size=7))
def test_labels_partition_the_foreground(rows):
    fg = np.array(rows)
    for k in (4, 8):
        lab = masks.label_image(fg, k)
        assert ((lab > 0) == fg).all()
        assert set(np.unique(lab)) <= set(range(lab.max() + 1)) and len(set(np.unique(lab)) - {0}) == lab.max()
    assert masks.label_image(fg, 8).max() <= masks.label_image(fg, 4).max()


@settings(max_examples=60, deadline=None)
@given(number, number, st.integers(0, 6), st.integers(0, 6))
def test_level0_lift_and_scale(x, y, a, b):
    m = [[1.1, 0.2, 5.0], [-0.1, 0.9, 3.0]]
    lifted = np.array(C.level0(m, a, b))
    want = np.array(m) @ np.array([x / 2**a, y / 2**a, 1]) * 2**b
    assert np.allclose((lifted @ np.array([x, y, 1]))[:2], want)


@settings(max_examples=30, deadline=None)
@given(st.lists(number, min_size=8, max_size=8))
def test_corner_map_meets_its_corners(noise):
    src = np.array([[0, 0], [100, 0], [100, 80], [0, 80]], float)
    dst = src + np.array(noise).reshape(4, 2) / 50
    m = four_corner_maps(src[None], dst[None])[0]
    p = np.c_[src, np.ones(4)] @ m.T
    assert np.allclose(p[:, :2] / p[:, 2:], dst, atol=1e-6)
    h = fitting.homography_fit(src, dst)
    assert np.allclose(h, m, atol=1e-5)


def test_constant_tiles_have_no_stains():
    assert stain_normalise(np.full((4, 4, 3), 255.0)) is None
