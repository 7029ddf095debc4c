"""Video stages against plain numpy over the whole stack, and the registered chains."""

import math

import numpy as np
import pytest

from frameloom.operators import signal, video
from frameloom.plans.pipeline import default_registry
from frameloom.streaming.stages import ewma_step

RNG = np.random.default_rng(11)
STACK = RNG.normal(0, 1, (23, 7, 9)).astype(np.float32)


def frames_of(spark, stack):
    rows = [(k, *x.shape, x.astype(float).ravel().tolist()) for k, x in enumerate(stack)]
    return spark.createDataFrame(rows, video.FRAMES).repartition(3)


def stack_of(df, shape=STACK.shape):
    rows = df.orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(shape[0]))
    return np.array([r.pixels for r in rows]).reshape(shape)


def gaussian(stack, sigma, axis):
    reach = int(4 * sigma + 0.5)
    out = np.zeros(stack.shape)
    for t in range(stack.shape[axis]):
        weights = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
        at = [slice(None)] * 3
        at[axis] = t
        for k, w in weights.items():
            place = min(max(t + k, 0), stack.shape[axis] - 1)
            out[tuple(at)] += w / sum(weights.values()) * stack.take(place, axis)
    return out


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_highpass_does_not_depend_on_chunks(spark, chunk):
    got = stack_of(video.temporal_highpass(frames_of(spark, STACK), 1.3, chunk))
    assert np.allclose(got, STACK - gaussian(STACK, 1.3, 0), atol=1e-5)


def test_gaussian_reaches_over_edges(spark):
    got = stack_of(video.spatial_gaussian(frames_of(spark, STACK), 0.8))
    assert np.allclose(got, gaussian(gaussian(STACK, 0.8, 1), 0.8, 2), atol=1e-5)


def test_robust_z_is_that_of_the_frame(spark):
    got = stack_of(video.frame_robust_z(frames_of(spark, STACK), epsilon=0.5))
    for image, z in zip(STACK.astype(float), got, strict=True):
        middle = np.median(image)
        want = (image - middle) / (1.4826 * np.median(abs(image - middle)) + 0.5)
        assert np.allclose(z, np.where(want > 0, want, 0), atol=1e-5)


def test_cfar_mask_by_brute_force(spark):
    got = stack_of(video.cfar_mask(frames_of(spark, STACK), 0.2, 1, 2, 1e-3))
    padded = np.pad(np.maximum(STACK.astype(float), 0), ((0, 0), (2, 2), (2, 2)), mode="edge")
    for t, y, x in np.ndindex(STACK.shape):
        square = padded[t, y : y + 5, x : x + 5]
        ring = np.r_[square[[0, 4]].ravel(), square[1:4, [0, 4]].ravel()]
        score = (square[2, 2] - ring.mean()) / (math.sqrt(ring.var() + 1e-3) + 1e-3)
        assert got[t, y, x] == (score >= math.sqrt(-2 * math.log(0.2)))
    with pytest.raises(ValueError, match="larger than the guard"):
        video.cfar_mask(frames_of(spark, STACK), guard_px=3, training_radius_px=3)


def test_frames_are_moved_onto_the_first(spark):
    base = RNG.uniform(5, 9, (12, 12))  # far from 0, so that what moves in counts
    moved = np.zeros_like(base)
    moved[2:, :-1] = base[:-2, 1:]
    stack = np.stack([base, moved])
    dy, dx, back = video.best_shift(moved, base, 3)
    assert (dy, dx) == max(((a, b) for a in range(-3, 4) for b in range(-3, 4)), key=lambda s: product(moved, base, *s))
    got = stack_of(video.registered(frames_of(spark, stack), 3), stack.shape)
    assert np.allclose(got[0], base, atol=1e-5) and np.allclose(got[1], back, atol=1e-5)
    assert signal.rigid_shifts(frames_of(spark, stack[1:]), base, 3).first()[1:] == (dy, dx)


def product(image, base, dy, dx):
    centre, total = base.mean(), 0.0
    for y, x in np.ndindex(base.shape):
        if 0 <= y - dy < base.shape[0] and 0 <= x - dx < base.shape[1]:
            total += image[y - dy, x - dx] * (base[y, x] - centre)
    return total


def test_ewma_scores_follow_the_stream(spark):
    got = stack_of(video.ewma_scores(frames_of(spark, STACK), 0.1, 0.7, 0.0))
    for y, x in np.ndindex(STACK.shape[1:]):
        mean, variance = float(STACK[0, y, x]), 1.0
        for t in range(len(STACK)):
            z, mean, variance = ewma_step(mean, variance, float(STACK[t, y, x]), 0.1)
            assert abs(z - 0.7) < 1e-4 or abs(got[t, y, x] - (z if z >= 0.7 else 0)) < 1e-4


def test_components_of_the_largest_values(spark):
    stack = np.zeros((4, 8, 10))
    stack[0, 1:3, 1:3], stack[1, 2:4, 2:4] = 3, 5  # one part over two frames
    stack[2, 4, 4], stack[3, 6, 6:9] = 9, 2.5  # a corner only touches; a line
    out = video.projected_components(frames_of(spark, stack), 2.0, 1.1, 3, 100).collect()
    assert [(r.id, r.area_px, r.peak_z, r.bbox) for r in out] == [("roi_001", 7, 5.0, [1, 1, 3, 3]), ("roi_002", 3, 2.5, [6, 6, 8, 6])]
    assert abs(out[0].x - 2) < 1e-9 and (out[1].x, out[1].y) == (7, 6)
    assert video.projected_components(frames_of(spark, stack).where("frame < 0")).collect() == []


def test_written_chain_runs(spark):
    stack = RNG.normal(0, 0.2, (30, 24, 24))
    for t, (y, x), top in ((12, (8, 8), 9), (20, (16, 15), 6)):
        stack[t, y - 2 : y + 3, x - 2 : x + 3] += top
    names = ["temporal_highpass_gaussian", "spatial_gaussian", "robust_positive_local_z", "component_filter", "heuristic_priority_v1"]
    spec = {"steps": [{"id": x, "stage": x} for x in names]}
    out = default_registry().run(spec, frames_of(spark, stack)).orderBy("rank").collect()
    assert [(round(r.y), round(r.x)) for r in out[:2]] == [(8, 8), (16, 15)] and out[0].priority_score > out[1].priority_score
    wrong = {"steps": [{"id": "a", "stage": "component_filter"}, {"id": "b", "stage": "spatial_gaussian", "params": {"sigma_px": 11}}]}
    found = default_registry().problems(wrong)
    assert any("needs scores" in x for x in found) and any("above 10" in x for x in found)
