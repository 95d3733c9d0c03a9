"""Raster kernels in numpy for boolean or integer arrays (rows, columns), and their use on tables of images.

Kernels see one image at a time; `map_images` runs them over Arrow batches, so an image is the unit of work and memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def shifted(mask: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """The array moved by (dy, dx), `fill` where nothing comes in."""
    out = np.full_like(mask, fill)
    h, w = mask.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def dilate(mask: np.ndarray, size: int = 3, cross: bool = False) -> np.ndarray:
    r, out = size // 2, mask.copy()
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if not cross or not dy or not dx:
                out |= shifted(mask, dy, dx)
    return out


def erode(mask: np.ndarray, size: int = 3, cross: bool = False) -> np.ndarray:
    """What lies outside of the image counts as set."""
    return ~dilate(~mask, size, cross)


def close(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return erode(dilate(mask, size), size)


def open_(mask: np.ndarray, size: int = 3, cross: bool = False) -> np.ndarray:
    return dilate(erode(mask, size, cross), size, cross)


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Morphological skeleton with the cross kernel: union of what each erosion's opening loses."""
    out, left = np.zeros_like(mask), mask.copy()
    while left.any():
        out |= left & ~open_(left, cross=True)
        rest = erode(np.pad(left, 1), cross=True)[1:-1, 1:-1]
        left = rest
    return out


def _removable() -> np.ndarray:
    """For both steps of thinning and each pattern of eight neighbours (bits, around from above) whether the pixel may go."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    changes = ((bits == 0) & (np.roll(bits, -1, axis=1) == 1)).sum(1)
    border = (bits.sum(1) >= 2) & (bits.sum(1) <= 6) & (changes == 1)
    above, right, below, left = bits[:, 0], bits[:, 2], bits[:, 4], bits[:, 6]
    first = (above * right * below == 0) & (right * below * left == 0)
    second = (above * right * left == 0) & (above * below * left == 0)
    return np.stack([border & first, border & second])


_REMOVABLE = _removable()
_AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def thin(mask: np.ndarray) -> np.ndarray:
    """Two-step thinning: border pixels with 2 to 6 neighbours and one change around go, in turn from two sides, until none can.

    A pixel's neighbours are a number of eight bits, looked up in a table; only pixels still set are looked at.
    """
    h, w = mask.shape
    padded = np.pad(mask.astype(np.uint8), 1).ravel()
    offsets = np.array([dy * (w + 2) + dx for dy, dx in _AROUND])
    alive = np.flatnonzero(padded)
    idle, step = 0, 0
    while idle < 2 and len(alive):
        pattern = padded[alive[:, None] + offsets] @ (1 << np.arange(8))
        going = _REMOVABLE[step][pattern]
        padded[alive[going]] = 0
        alive = alive[~going]
        idle, step = (0 if going.any() else idle + 1), 1 - step
    return padded.reshape(h + 2, w + 2)[1:-1, 1:-1].astype(bool)


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Components numbered from 1 in order of their first pixel, 0 outside. Runs of a row are joined to those above."""
    h, w = mask.shape
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        j = first[y - 1]
        for i in range(first[y], first[y + 1]):
            while j < first[y] and end[j] + reach <= begin[i]:
                j += 1
            k = j
            while k < first[y] and begin[k] < end[i] + reach:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
                k += 1
    out, number = np.zeros((h, w), np.int32), {}
    for i in range(len(row)):
        out[row[i], begin[i] : end[i]] = number.setdefault(find(i), len(number) + 1)
    return out


def rooms(barrier: np.ndarray, least: int = 1500, share: float = 0.005) -> np.ndarray:
    """Free components that don't touch the border and have max(least, share of the image) pixels at least, numbered anew."""
    free = label(~barrier, diagonal=True)
    outside = np.unique(np.concatenate([free[0], free[-1], free[:, 0], free[:, -1]]))
    size = np.bincount(free.ravel())
    kept = [k for k in range(1, len(size)) if k not in outside and size[k] >= max(least, share * barrier.size)]
    table = np.zeros(len(size), np.int32)
    table[kept] = np.arange(1, len(kept) + 1)
    return table[free]


def fill_polygon(ring: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels whose centre lies in a ring of (x, y) points, by the parity of crossings of each row."""
    out = np.zeros((height, width), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for y in range(height):
        c = y + 0.5
        hit = (a[:, 1] > c) != (b[:, 1] > c)
        xs = np.sort(a[hit, 0] + (c - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
        for lo, hi in zip(xs[::2], xs[1::2], strict=False):
            out[y, max(0, int(np.ceil(lo - 0.5))) : max(0, int(np.ceil(hi - 0.5)))] = True
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """An open polyline without points nearer than the tolerance to what remains (farthest point first)."""
    keep, todo = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, d = points[lo], points[hi] - points[lo]
        p = points[lo + 1 : hi] - a
        size = np.hypot(*d)
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / size if size else np.hypot(p[:, 0], p[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[lo + 1 + k] = True
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return points[keep]


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each set pixel to the nearest unset one (infinite if there is none)."""
    h, w = mask.shape
    far = float(h + w) ** 2 * 4
    rows = np.where(mask, far, 0.0)
    offsets = np.arange(h)
    column = np.stack([(rows + ((offsets[:, None] - y) ** 2)).min(0) for y in range(h)]) if h else rows
    column = np.stack([np.where(mask[y], column[y], 0) for y in range(h)]) if h else column
    cols = np.arange(w)
    out = np.stack([(column + (cols[None, :] - x) ** 2).min(1) for x in range(w)], 1) if w else column
    return np.where(out >= far, np.inf, np.sqrt(out))


def _lanczos_weights(size: int, to: int, lobes: int = 3) -> np.ndarray:
    """Weights (to x size) of a windowed sinc, widened by the scale where it shrinks."""
    scale = size / to
    wide = max(scale, 1.0)
    centers = (np.arange(to) + 0.5) * scale
    first = np.maximum((centers - lobes * wide + 0.5).astype(int), 0)
    last = np.minimum((centers + lobes * wide + 0.5).astype(int), size)
    at = np.arange(size)
    x = (at[None, :] - centers[:, None] + 0.5) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    w[(at[None, :] < first[:, None]) | (at[None, :] >= last[:, None])] = 0
    return w / w.sum(1, keepdims=True)


def resample(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A grey image (0 to 255) resized by Lanczos weights, across then down, rounded to whole levels after each."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(gray.astype(float) @ _lanczos_weights(gray.shape[1], cols).T)
    return level(_lanczos_weights(gray.shape[0], rows) @ across)


def _number(bits: np.ndarray) -> int:
    return int("".join("1" if b else "0" for b in bits.ravel()), 2)


def difference_hash(gray: np.ndarray) -> int:
    """64 bits: whether each cell of a 9 x 8 miniature is darker than its right neighbour."""
    small = resample(gray, 8, 9)
    return _number(small[:, 1:] > small[:, :-1])


def perceptual_hash(gray: np.ndarray) -> int:
    """63 bits: the low 8 x 8 cosine terms of a 32 x 32 miniature, the constant one left out, against their median."""
    k = np.arange(32)
    basis = np.cos(np.pi * np.arange(8)[:, None] * (2 * k + 1) / 64)
    basis[0] /= np.sqrt(2)
    low = (basis @ resample(gray, 32, 32) @ basis.T).ravel()[1:]
    return _number(low > np.median(low))


def trimmed(gray: np.ndarray, ink: int = 220) -> np.ndarray:
    """The image without the margin that has no level under `ink`; as it is if nothing has."""
    y, x = np.nonzero(gray < ink)
    return gray[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(y) else gray


def signatures(gray: np.ndarray) -> list[tuple[int, int]]:
    """Both hashes of the trimmed image, turned by 0, 90, 180 and 270 degrees against the clock."""
    own = trimmed(gray)
    return [(difference_hash(x), perceptual_hash(x)) for x in (np.rot90(own, k) for k in range(4))]


def block_mean(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means of a grid of cells; each pixel goes to the cell that holds its centre."""
    h, w = gray.shape
    y, x = (np.arange(h) * rows) // h, (np.arange(w) * cols) // w
    cell = (y[:, None] * cols + x[None, :]).ravel()
    n = np.bincount(cell, minlength=rows * cols)
    return (np.bincount(cell, gray.ravel().astype(float), rows * cols) / np.maximum(n, 1)).reshape(rows, cols)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring within a convex ring (counter-clockwise), cut edge by edge."""
    out = [tuple(map(float, p)) for p in subject]
    for (ax, ay), (bx, by) in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        new = []
        for i, (p, s) in enumerate(zip(out, side, strict=True)):
            q, t = out[i - 1], side[i - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                new.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                new.append(p)
        out = new
    return np.array(out).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    """Signed shoelace area; counter-clockwise rings are positive."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def convex_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of two convex rings in any direction."""
    a, b = (r if ring_area(r) >= 0 else r[::-1] for r in (a, b))
    both = ring_area(clip_convex(a, b))
    union = ring_area(a) + ring_area(b) - both
    return both / union if union > 0 else 0.0


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without points on its edges."""
    p = sorted(map(tuple, np.unique(points, axis=0)))
    if len(p) < 3:
        return np.array(p, float)

    def half(q: list) -> list:
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, angle of the long side in degrees, 0 to 180) of the least-area rectangle around points."""
    h = hull(points)
    if len(h) < 3:
        d = h[-1] - h[0]
        return float(np.hypot(*d)), 0.0, float(np.degrees(np.arctan2(d[1], d[0])) % 180)
    best = None
    for d in np.roll(h, -1, axis=0) - h:
        u = d / np.hypot(*d)
        along, across = h @ u, h @ np.array([-u[1], u[0]])
        a, b = np.ptp(along), np.ptp(across)
        angle = np.degrees(np.arctan2(u[1], u[0])) % 180
        found = (a * b, a, b, angle) if a >= b else (a * b, b, a, (angle + 90) % 180)
        if best is None or found[0] < best[0] - 1e-9:
            best = found
    return float(best[1]), float(best[2]), float(best[3])


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str, image: str = "image", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """Rows (image, ...) that a kernel gives for each image: `pixels` is a binary of one byte a pixel, row by row."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, *r) for i, p, w in zip(pdf[image], pdf[pixels], pdf[width], strict=True) for r in kernel(np.frombuffer(p, np.uint8).reshape(-1, w))]
            yield pd.DataFrame(rows, columns=[image, *names])

    return images.select(image, pixels, width).mapInPandas(run, f"{image} long, {schema}")
