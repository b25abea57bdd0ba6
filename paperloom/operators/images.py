"""Measures, corrections and candidates of page images, in numpy, many images a task.

An image is a row (image_id, height, width, channels, pixels): unsigned bytes, row
by row, channels in the order blue, green, red.  Rows whose pixels are null or do
not fill height x width x channels get a null result.  Filters extend an image by
its mirror without the edge pixel, unless a function says otherwise.

Two measures have methods of their own, as no edge detector is at hand: skew is the
angle whose projection of strong gradients is the most uneven, and the page's
outline is the quadrangle of the extreme corners of what is brighter than Otsu's
threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality


@dataclass(frozen=True)
class Config:
    """The thresholds and sizes of the pipeline's configuration."""

    min_width: int = 1200
    max_width: int = 2200
    long_edge: int = 3200
    contrast: float = 45.0
    dark: float = 80.0
    bright: float = 210.0
    noise: float = 9.0
    denoise_blur: float = 80.0
    clip: float = 2.0
    tiles: int = 8
    block: int = 31
    block_less: float = 11.0
    border_margin: int = 6
    max_candidates: int = 6


@dataclass
class Candidate:
    name: str
    image: np.ndarray
    steps: list[str] = field(default_factory=list)

    @property
    def score(self) -> float:
        return score(self.image)


def pixels(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray | None:
    """The array of an image; None where the bytes do not fill it."""
    if not data or not height or not width or len(data) != height * width * (channels or 1):
        return None
    flat = np.frombuffer(data, np.uint8)
    return flat.reshape(height, width) if (channels or 1) == 1 else flat.reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


# --- filters ---

def _extended(a: np.ndarray, by: int, mode: str = "reflect") -> np.ndarray:
    out = a
    while by > 0:  # a mirror is as wide as the image at most
        step = by if mode == "edge" else max(1, min(by, min(out.shape) - 1))
        out = np.pad(out, step, "edge" if min(out.shape) == 1 else mode)
        by -= step
    return out


def _along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation without ends, by running sums where the kernel is flat."""
    n, size = len(kernel), a.shape[axis] - len(kernel) + 1
    out = np.zeros([size if k == axis else s for k, s in enumerate(a.shape)])
    for i in range(n):
        out += kernel[i] * a.take(range(i, i + size), axis)
    return out


def gaussian(a: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """The blur of an odd kernel, its spread by the size."""
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-x * x / (2 * spread * spread))
    kernel /= kernel.sum()
    return _along(_along(_extended(a.astype(np.float64), size // 2, mode), kernel, 0), kernel, 1)


def box(a: np.ndarray, size: int, mode: str = "reflect") -> np.ndarray:
    """The mean over a square, by sums along rows and columns."""
    wide = _extended(a.astype(np.float64), size // 2, mode)
    for axis in (0, 1):
        sums = np.concatenate([np.zeros_like(wide.take([0], axis)), np.cumsum(wide, axis)], axis)
        n = wide.shape[axis]
        wide = sums.take(range(size, n + 1), axis) - sums.take(range(n - size + 1), axis)
    return wide / (size * size)


def laplacian(g: np.ndarray) -> np.ndarray:
    e = _extended(g.astype(np.float64), 1)
    return e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * e[1:-1, 1:-1]


def median3(g: np.ndarray) -> np.ndarray:
    """The median of each 3 x 3 square, edges repeated."""
    return np.median(sliding_window_view(np.pad(g, 1, "edge"), (3, 3)).reshape(*g.shape, 9), axis=2).astype(np.uint8)


def _stretched(a: np.ndarray) -> np.ndarray:
    low, high = float(a.min()), float(a.max())
    return np.zeros(a.shape, np.uint8) if high <= low else np.rint((a - low) * (255.0 / (high - low))).astype(np.uint8)


# --- measures ---

def noise(g: np.ndarray) -> float:
    return float(np.abs(g.astype(np.int16) - median3(g)).std())


def _odd(n: int) -> int:
    return n + 1 - n % 2


def shadow(g: np.ndarray) -> float:
    return float(np.rint(gaussian(g, _odd(max(31, int(min(g.shape) * 0.08))))).std() / 255.0)


def border(g: np.ndarray) -> float:
    """The mean share of dark pixels of the four edge strips."""
    y, x = (max(2, int(n * 0.025)) for n in g.shape)
    return float(np.mean([np.mean(s < 35) for s in (g[:y], g[g.shape[0] - y:], g[:, :x], g[:, g.shape[1] - x:])]))


def skew(g: np.ndarray) -> float:
    """Degrees, from -30 to 30, in quarters; 0 without enough edges."""
    e = g.astype(np.float64)
    strong = np.abs(np.diff(e, axis=0)) > 50
    ys, xs = np.nonzero(strong)
    if len(ys) < 100:
        return 0.0
    if len(ys) > 20_000:  # evenly spread over the whole image
        keep = np.linspace(0, len(ys) - 1, 20_000).astype(int)
        ys, xs = ys[keep], xs[keep]
    best, found = -1.0, 0.0
    for angle in sorted(np.arange(-30, 30.25, 0.25), key=abs):
        t = np.radians(angle)
        at = np.rint(ys * np.cos(t) - xs * np.sin(t)).astype(int)
        uneven = float((np.bincount(at - at.min()).astype(np.float64) ** 2).sum())
        if uneven > best * 1.0001:
            best, found = uneven, float(angle)
    return found


def otsu(g: np.ndarray) -> int:
    """The threshold of the greatest variance between the two sides; a pixel above it is bright."""
    counts = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (sums / below - (sums[-1] - sums) / above) ** 2, -1)
    return int(np.argmax(between))


def corners(points: np.ndarray) -> np.ndarray:
    """Of points (x, y) the corners: top left, top right, bottom right, bottom left."""
    total, apart = points.sum(1), points[:, 1] - points[:, 0]
    return points[[np.argmin(total), np.argmin(apart), np.argmax(total), np.argmax(apart)]].astype(np.float64)


def outline(g: np.ndarray) -> tuple[float, float, np.ndarray | None]:
    """(share of the image, confidence that it is a page, its corners)."""
    ys, xs = np.nonzero(g > otsu(g))
    if not len(ys) or g.min() == g.max():
        return 0.0, 0.0, None
    quad = corners(np.column_stack([xs, ys]))
    x, y = quad.T
    area = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
    share = area / g.size
    filled = len(ys) / max(1.0, area)
    if 0.25 <= share <= 0.98 and filled > 0.8:
        return share, min(1.0, share * 1.2), quad
    return share, 0.35 if 0.45 <= share <= 0.98 else 0.0, quad


def score(image: np.ndarray) -> float:
    """How well an image suits recognition, 0 to 1."""
    g = grey(image)
    contrast, sharp, bright, ink = float(g.std()), float(laplacian(g).var()), float(g.mean()), float((g < 210).mean())
    parts = (0.32 * min(1.0, contrast / 70), 0.30 * min(1.0, sharp / 450), 0.23 * (1 - min(1.0, abs(bright - 172) / 172)), 0.15 * (1 - min(1.0, abs(ink - 0.18) / 0.35)))
    return max(0.0, sum(parts))


def measures(image: np.ndarray) -> dict[str, float]:
    g = grey(image)
    share, confidence, _ = outline(g)
    return {"brightness": float(g.mean()), "contrast": float(g.std()), "blur_score": float(laplacian(g).var()), "noise_score": noise(g), "skew_angle": skew(g),
            "shadow_score": shadow(g), "border_score": border(g), "document_area_ratio": share, "perspective_confidence": confidence}


# --- corrections ---

def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """By area where it shrinks, by cubic curves where it grows."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        m = max(1, round(n * scale))
        weights = np.zeros((m, n))
        if m < n:
            edges = np.arange(m + 1) * (n / m)
            for i in range(m):
                first, last = int(edges[i]), min(n, int(np.ceil(edges[i + 1])))
                cover = np.minimum(np.arange(first, last) + 1, edges[i + 1]) - np.maximum(np.arange(first, last), edges[i])
                weights[i, first:last] = cover / cover.sum()
        else:
            at = (np.arange(m) + 0.5) * (n / m) - 0.5
            base = np.floor(at).astype(int)
            for k in range(-1, 3):
                d = np.abs(at - base - k)
                near, far = (1.25 * d - 2.25) * d * d + 1, ((-0.75 * d + 3.75) * d - 6) * d + 3
                np.add.at(weights, (np.arange(m), np.clip(base + k, 0, n - 1)), np.where(d <= 1, near, far))
        out = np.moveaxis(np.tensordot(weights, out, (1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def normal_width(image: np.ndarray, config: Config = Config()) -> tuple[np.ndarray, str | None]:
    width = image.shape[1]
    if width < config.min_width:
        return resized(image, config.min_width / width), f"upscale:{config.min_width / width:.2f}"
    if width > config.max_width:
        return resized(image, config.max_width / width), f"downscale:{config.max_width / width:.2f}"
    return image, None


def bounded(image: np.ndarray, config: Config = Config()) -> np.ndarray:
    """The image with its long edge at most ``long_edge``."""
    longest = max(image.shape[:2])
    return resized(image, config.long_edge / longest) if longest > config.long_edge else image


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float | None) -> np.ndarray:
    """Bilinear samples at (x, y); outside, the edge or ``fill``."""
    h, w = image.shape[:2]
    a = image.astype(np.float64)
    cx, cy = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(cx.astype(int), max(0, w - 2)), np.minimum(cy.astype(int), max(0, h - 2))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = cx - x0, cy - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    if fill is not None:
        out[(x < -0.5) | (x > w - 0.5) | (y < -0.5) | (y > h - 0.5)] = fill
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def warped(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrangle (top left, top right, bottom right, bottom left) as an upright image; a side under 100 pixels leaves the image."""
    tl, tr, br, bl = quad
    w, h = (int(max(np.linalg.norm(p - q), np.linalg.norm(r - s))) for p, q, r, s in ((br, bl, tr, tl), (tr, br, tl, bl)))
    if w < 100 or h < 100:
        return image
    target = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows, right = [], []
    for (u, v), (x, y) in zip(target, quad, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    x, y, z = (m[k, 0] * u + m[k, 1] * v + m[k, 2] for k in range(3))
    return _sampled(image, x / z, y / z, None)


def perspective_corrected(image: np.ndarray) -> tuple[np.ndarray, bool]:
    share, confidence, quad = outline(grey(image))
    if quad is None or confidence <= 0.35 or share < 0.25:
        return image, False
    return warped(image, quad), True


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle, white outside."""
    h, w = image.shape[:2]
    t = np.radians(degrees)
    u, v = np.meshgrid(np.arange(w) - (w - 1) / 2, np.arange(h) - (h - 1) / 2)
    return _sampled(image, np.cos(t) * u - np.sin(t) * v + (w - 1) / 2, np.sin(t) * u + np.cos(t) * v + (h - 1) / 2, 255)


def deskewed(g: np.ndarray) -> tuple[np.ndarray, float]:
    """The image turned upright where it leans by 0.35 degrees or more, and by how much it leant."""
    angle = skew(g)
    return (rotated(g, angle) if abs(angle) >= 0.35 else g), angle


def without_shadows(g: np.ndarray) -> np.ndarray:
    background = np.rint(gaussian(g, _odd(max(31, int(min(g.shape) * 0.06)))))
    return _stretched(np.clip(np.rint(np.divide(g * 245.0, background, out=np.zeros(g.shape), where=background > 0)), 0, 255))


def trimmed(image: np.ndarray) -> np.ndarray:
    """Without dark borders, unless that would take over three tenths of a side."""
    g = grey(image)
    ys, xs = np.nonzero(g > 35)
    if not len(ys):
        return image
    pad = max(8, int(min(g.shape) * 0.01))
    x1, y1, x2, y2 = max(0, xs.min() - pad), max(0, ys.min() - pad), min(g.shape[1], xs.max() + 1 + pad), min(g.shape[0], ys.max() + 1 + pad)
    return image if x2 - x1 < g.shape[1] * 0.7 or y2 - y1 < g.shape[0] * 0.7 else image[y1:y2, x1:x2]


def clean_border(g: np.ndarray, margin: int) -> np.ndarray:
    out = g.copy()
    if margin > 0:
        out[:margin] = out[-margin:] = out[:, :margin] = out[:, -margin:] = 255
    return out


def equalised(g: np.ndarray, config: Config = Config()) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, blended between their centres."""
    k = config.tiles
    h, w = g.shape
    th, tw = -(-h // k), -(-w // k)
    wide = np.pad(g, ((0, th * k - h), (0, tw * k - w)), "reflect" if th * k - h < h and tw * k - w < w else "edge")
    maps = np.empty((k, k, 256))
    limit = max(1, int(config.clip * th * tw / 256))
    for i in range(k):
        for j in range(k):
            counts = np.bincount(wide[i * th:(i + 1) * th, j * tw:(j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            maps[i, j] = np.cumsum(np.minimum(counts, limit) + over / 256) * (255 / (th * tw))
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, k - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, k - 1)
    y0, x0 = np.minimum(y.astype(int), k - 2 if k > 1 else 0)[:, None], np.minimum(x.astype(int), k - 2 if k > 1 else 0)[None, :]
    y1, x1, fy, fx = np.minimum(y0 + 1, k - 1), np.minimum(x0 + 1, k - 1), y[:, None] - y0, x[None, :] - x0
    blend = (maps[y0, x0, g] * (1 - fx) + maps[y0, x1, g] * fx) * (1 - fy) + (maps[y1, x0, g] * (1 - fx) + maps[y1, x1, g] * fx) * fy
    return np.clip(np.rint(blend), 0, 255).astype(np.uint8)


def smoothed(g: np.ndarray, reach: int = 3, colour: float = 40.0, space: float = 40.0) -> np.ndarray:
    """Bilateral: a mean over neighbours, weighted by nearness in place and in brightness."""
    wide, a = _extended(g.astype(np.float64), reach), g.astype(np.float64)
    total, weight = np.zeros(g.shape), np.zeros(g.shape)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            if dx * dx + dy * dy <= reach * reach:
                b = wide[reach + dy:reach + dy + g.shape[0], reach + dx:reach + dx + g.shape[1]]
                w = np.exp(-(dx * dx + dy * dy) / (2 * space * space) - (b - a) ** 2 / (2 * colour * colour))
                total += w * b
                weight += w
    return np.rint(total / weight).astype(np.uint8)


def averaged(g: np.ndarray, strength: float = 9.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: a mean over places whose surroundings look alike."""
    reach = search // 2
    a = g.astype(np.float64)
    wide = _extended(a, reach)
    total, weight = np.zeros(g.shape), np.zeros(g.shape)
    for dy in range(search):
        for dx in range(search):
            b = wide[dy:dy + g.shape[0], dx:dx + g.shape[1]]
            w = np.exp(-box((a - b) ** 2, template) / (strength * strength))
            total += w * b
            weight += w
    return np.rint(total / weight).astype(np.uint8)


# --- binaries and candidates ---

def adaptive(g: np.ndarray, config: Config = Config()) -> np.ndarray:
    size = _odd(max(15, config.block))
    mean = np.rint(gaussian(g, size, "edge"))
    return np.where(g > mean - config.block_less, 255, 0).astype(np.uint8)


def sauvola(g: np.ndarray, k: float = 0.2) -> np.ndarray:
    """Bright where over the local mean, lowered where the local spread is small."""
    size = _odd(max(25, int(min(g.shape) * 0.035)))
    mean = box(g, size)
    spread = np.sqrt(np.maximum(0, box(g.astype(np.float64) ** 2, size) - mean ** 2))
    return np.where(g > mean * (1 + k * (spread / 127.5 - 1)), 255, 0).astype(np.uint8)


def by_otsu(g: np.ndarray) -> np.ndarray:
    return np.where(g > otsu(g), 255, 0).astype(np.uint8)


def colour_prepared(image: np.ndarray, m: dict[str, float], config: Config = Config()) -> tuple[np.ndarray, list[str]]:
    out, steps = image if image.ndim == 3 else np.repeat(image[..., None], 3, 2), []
    if m["perspective_confidence"] > 0.55:
        out, changed = perspective_corrected(out)
        steps += ["perspective_correct"] if changed else []
    out, scaled = normal_width(out, config)
    steps += [scaled] if scaled else []
    if m["border_score"] > 0.08:
        out = trimmed(out)
        steps.append("border_trim")
    return out, steps


def grey_prepared(image: np.ndarray, m: dict[str, float], config: Config = Config()) -> tuple[np.ndarray, list[str]]:
    g, steps = grey(image), []
    if m["shadow_score"] > 0.08:
        g = without_shadows(g)
        steps.append("shadow_correct")
    if m["contrast"] < config.contrast or not config.dark <= m["brightness"] <= config.bright:
        g = equalised(g, config)
        steps.append("clahe")
    else:
        g = _stretched(g)
        steps.append("histogram_normalize")
    if m["noise_score"] > config.noise and m["blur_score"] > config.denoise_blur:
        g = averaged(g)
        steps.append("nl_means_denoise")
    elif m["noise_score"] > config.noise * 0.75:
        g = smoothed(g)
        steps.append("bilateral_denoise")
    g, angle = deskewed(g)
    steps.append(f"deskew:{angle:.2f}" if abs(angle) >= 0.35 else "deskew_checked")
    if m["border_score"] > 0.08:
        g = clean_border(g, config.border_margin)
        steps.append("border_cleanup")
    return g, steps


def candidates(image: np.ndarray, config: Config = Config()) -> list[Candidate]:
    """The versions of an image that recognition may choose from, the best scored first."""
    m = measures(image)
    colour, steps = colour_prepared(image, m, config)
    g, more = grey_prepared(colour, m, config)
    steps_grey = [*steps, *more]
    out = [Candidate("color_preserved", colour, steps), Candidate("enhanced_gray", g, steps_grey)]
    if g.shape[1] > g.shape[0] * 1.12:
        out += [Candidate(f"orientation_{name}", np.rot90(grey(colour), turn), [*steps_grey, name]) for name, turn in (("rotate_90_clockwise", -1), ("rotate_90_counterclockwise", 1))]
    out += [Candidate("adaptive_binary", adaptive(g, config), [*steps_grey, "adaptive_threshold", "light_morphology"]), Candidate("sauvola_binary", sauvola(g), [*steps_grey, "sauvola_threshold", "light_morphology"])]
    if m["shadow_score"] < 0.08 and m["contrast"] >= config.contrast:
        out.append(Candidate("otsu_binary", by_otsu(g), [*steps_grey, "otsu_threshold"]))
    return sorted(out, key=lambda c: -c.score)[:max(1, config.max_candidates)]


# --- visual cues ---

def coloured_sidebar(image: np.ndarray) -> bool:
    """Whether the left third is coloured, and more so, or otherwise lit, than what is right of four tenths."""
    if image.ndim == 2:
        return False
    a = image.astype(np.float64)
    value, low = a.max(2), a.min(2)
    colour = np.divide(value - low, value, out=np.zeros(value.shape), where=value > 0) * 255
    left, body = slice(0, max(1, int(image.shape[1] * 0.34))), slice(int(image.shape[1] * 0.40), None)
    if not colour[:, body].size:
        return False
    own = colour[:, left].mean()
    return bool(own > 22 and (own - colour[:, body].mean() > 18 or abs(value[:, left].mean() - value[:, body].mean()) > 28))


def line_density(g: np.ndarray) -> float:
    """The share of pixels on straight horizontal or vertical edges of a thirty-fifth of the width, or a forty-fifth of the height, or more."""
    a = g.astype(np.int16)
    edges = np.zeros(g.shape, bool)
    edges[1:] |= np.abs(np.diff(a, axis=0)) > 60
    edges[:, 1:] |= np.abs(np.diff(a, axis=1)) > 60
    long = np.zeros(g.shape, bool)
    for e, out, size in ((edges, long, max(12, g.shape[1] // 35)), (edges.T, long.T, max(12, g.shape[0] // 45))):
        if e.shape[1] >= size:
            full = sliding_window_view(e, size, axis=1).all(2)
            for k in range(size):
                out[:, k:k + full.shape[1]] |= full
    return float(long.mean())


def drawn(image: np.ndarray, boxes: list[tuple[int, int, int, int]], colour: tuple[int, int, int] = (0, 160, 0), thick: int = 2) -> np.ndarray:
    """A copy with the outlines of boxes (x1, y1, x2, y2)."""
    out = (image if image.ndim == 3 else np.repeat(image[..., None], 3, 2)).copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        x1, x2, y1, y2 = max(0, x1), min(w - 1, x2), max(0, y1), min(h - 1, y2)
        if x1 <= x2 and y1 <= y2:
            out[y1:y1 + thick, x1:x2 + 1] = out[max(y1, y2 - thick + 1):y2 + 1, x1:x2 + 1] = colour
            out[y1:y2 + 1, x1:x1 + thick] = out[y1:y2 + 1, max(x1, x2 - thick + 1):x2 + 1] = colour
    return out


# --- over tables ---

MEASURES = ("brightness", "contrast", "blur_score", "noise_score", "skew_angle", "shadow_score", "border_score", "document_area_ratio", "perspective_confidence")


#: What ``quality`` calls them.
RENAMED = {"blur_score": "sharpness", "noise_score": "noise", "skew_angle": "skew", "shadow_score": "shadow", "border_score": "border", "perspective_confidence": "perspective"}


def _mapped(images: DataFrame, schema: str, of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for i, *image in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in of(i, pixels(*image))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _arrow(schema))

    return images.select("image_id", "height", "width", "channels", "pixels").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def profile(images: DataFrame) -> DataFrame:
    """(image_id, the measures, score, sidebar, lines): nulls for an image that cannot be read."""
    schema = ", ".join(["image_id long", *(f"{m} double" for m in MEASURES), "score double", "sidebar boolean", "line_density double"])

    def of(i, image):
        if image is None:
            return [(i, *[None] * (len(MEASURES) + 3))]
        return [(i, *measures(image).values(), score(image), coloured_sidebar(image), line_density(grey(image)))]

    return _mapped(images, schema, of)


def flagged(images: DataFrame) -> DataFrame:
    """``profile`` with ``flags``, the names of the faults that its measures show, and the decisions on what to correct."""
    c = Config()
    named = profile(images).withColumnsRenamed(RENAMED)
    back = named.withColumn("flags", quality.flags(named)).withColumnsRenamed({v: k for k, v in RENAMED.items()})
    return back.withColumns({
        "needs_denoise": (F.col("noise_score") > c.noise) & (F.col("blur_score") > c.denoise_blur),
        "needs_contrast_boost": (F.col("contrast") < c.contrast) | (F.col("brightness") < c.dark) | (F.col("brightness") > c.bright),
        "needs_deskew": F.abs("skew_angle") > 0.35, "needs_shadow_correction": F.col("shadow_score") > 0.08, "needs_border_cleanup": F.col("border_score") > 0.08})


def versions(images: DataFrame, config: Config = Config()) -> DataFrame:
    """(image_id, rank, name, score, steps, height, width, channels, pixels): the candidates of each image, the best first."""
    schema = "image_id long, rank int, name string, score double, steps array<string>, height int, width int, channels int, pixels binary"

    def of(i, image):
        for k, c in enumerate(candidates(image, config) if image is not None else [], 1):
            a = np.ascontiguousarray(c.image)
            yield i, k, c.name, c.score, c.steps, a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, a.tobytes()

    return _mapped(images, schema, of)
