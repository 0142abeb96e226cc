import numpy as np
import pytest

from skylathe.operators import pixels


def _pixels(spark, frames):
    rows = [(k, y, x, float(v)) for k, image in frames.items() for (y, x), v in np.ndenumerate(image) if v == v]
    return spark.createDataFrame(rows, "frame string, y int, x int, value double").repartition(4)


def _maxima(image, reach, above, below):
    out = set()
    for (y, x), v in np.ndenumerate(image):
        around = [(image[i, j], (i, j)) for i in range(max(0, y - reach), min(image.shape[0], y + reach + 1)) for j in range(max(0, x - reach), min(image.shape[1], x + reach + 1)) if image[i, j] == image[i, j]]
        if above < v < below and not any(o > v or o == v and at < (y, x) for o, at in around):
            out.add((y, x, float(v)))
    return out


@pytest.mark.parametrize(("reach", "tile"), [(1, 5), (3, 7), (7, 4), (7, 64), (0, 8)])
def test_maxima_on_tile_edges_equal_those_of_the_frame(spark, reach, tile):
    rng = np.random.default_rng(reach + tile)
    frames = {"a": rng.integers(0, 12, (33, 29)).astype(float), "b": rng.normal(0, 5, (20, 40)), "c": np.zeros((9, 9))}
    frames["b"][3:6, 7] = np.nan
    got = pixels.local_maxima(_pixels(spark, frames), ["frame"], reach, -1.0, 11.5, tile)
    found = {k: set() for k in frames}
    for r in got.collect():
        found[r.frame].add((r.y, r.x, r.value))
    assert found == {k: _maxima(image, reach, -1.0, 11.5) for k, image in frames.items()}


def _moved(image, dy, dx):
    """A Fourier shift, right for any part of a pixel."""
    ky, kx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real


@pytest.mark.parametrize(("bin_", "upsample"), [(1, 2), (1, 10), (2, 4)])
def test_planted_parts_of_a_pixel_are_found(spark, bin_, upsample):
    rng = np.random.default_rng(upsample)
    y, x = np.mgrid[0:64, 0:48]
    sky = sum(rng.uniform(50, 200) * np.exp(-((y - a) ** 2 + (x - b) ** 2) / (3 * bin_ * bin_)) for a, b in rng.uniform(4, 44, (25, 2)))
    step = bin_ / upsample
    shifts = {"f0": (0.0, 0.0), "f1": (step, -step), "f2": (3 * bin_ + step, 2.0 * bin_), "f3": (-5.0 * bin_, 4 * bin_ - step), "f4": (0.0, -7 * step)}
    frames = {k: _moved(sky, *s) + rng.normal(0, 0.02, sky.shape) for k, s in shifts.items()}
    got = pixels.registered(_pixels(spark, frames), "frame", "f0", 64, 48, bin_, 12.0, upsample)
    found = {r.frame: (r.dy, r.dx) for r in got.collect()}
    assert set(found) == set(shifts) and all(found[k] == pytest.approx(s, abs=step * (0.01 if upsample == 2 else 1.01)) for k, s in shifts.items())
    with pytest.raises(ValueError, match="no frame"):
        pixels.registered(_pixels(spark, frames), "frame", "f9", 64, 48)


def test_flat_frames_do_not_move(spark):
    frames = {"a": np.ones((16, 16)), "b": np.full((16, 16), 7.0)}
    assert {(r.dy, r.dx) for r in pixels.registered(_pixels(spark, frames), "frame", "a", 16, 16, 2, 2.0, 4).collect()} == {(0.0, 0.0)}
