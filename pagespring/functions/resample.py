"""Image resampling and model inputs in numpy, for batch functions on the workers."""

from __future__ import annotations

import math

import numpy as np

LONGEST, MULTIPLE, PATCH = 1540, 28, 14
CAPTION_SIDE, LINE_SIDE = 378, 384
# The recogniser's channel means and deviations.
MEAN = (0.48145466, 0.4578275, 0.40821073)
STD = (0.26862954, 0.26130258, 0.27577711)


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0.0)


KERNELS = {"lanczos3": (lanczos3, 3.0), "triangle": (triangle, 1.0)}


def weights(size: int, new: int, kernel: str) -> np.ndarray:
    """(new, size) matrix: each row weighs the old places for one new place, summing to 1.

    The kernel widens with the ratio when an image shrinks, so that every pixel counts.
    """
    f, support = KERNELS[kernel]
    ratio = size / new
    wide = max(ratio, 1.0)
    centre = (np.arange(new) + 0.5) * ratio
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) <= support, f(x), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, w: int, h: int, kernel: str = "lanczos3") -> np.ndarray:
    """uint8 (h, w, c) to the exact size, each axis on its own, rounded half up (a millionth
    below counts as half, whatever the order of sums) and clamped."""
    x = weights(image.shape[0], h, kernel) @ image.astype(np.float64).reshape(image.shape[0], -1)
    x = x.reshape(h, image.shape[1], -1)
    x = np.einsum("nw,hwc->hnc", weights(image.shape[1], w, kernel), x)
    return np.clip(np.floor(np.round(x, 6) + 0.5), 0, 255).astype(np.uint8)


def resize_to_fill(image: np.ndarray, side: int, kernel: str = "triangle") -> np.ndarray:
    """Scaled to cover a square, aspect kept, the overflow cut evenly from both ends."""
    h, w = image.shape[:2]
    scale = max(side / w, side / h)
    nw, nh = max(side, round(w * scale)), max(side, round(h * scale))
    x = resize(image, nw, nh, kernel)
    top, left = (nh - side) // 2, (nw - side) // 2
    return x[top : top + side, left : left + side]


def planar(image: np.ndarray, mean=(0.5,) * 3, std=(0.5,) * 3) -> np.ndarray:
    """uint8 (h, w, 3) to float32 (3, h, w): (p / 255 - mean) / std."""
    x = (image.astype(np.float32) / np.float32(255) - np.float32(mean)) / np.float32(std)
    return np.ascontiguousarray(x.transpose(2, 0, 1))


def recogniser_input(image: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(pixels, patches down, patches across) of an RGB page: longest edge to LONGEST
    (up as well), black padding right and below to a multiple, normalised."""
    h, w = image.shape[:2]
    scale = np.float32(LONGEST) / np.float32(max(w, h))
    nw, nh = (int(math.floor(float(np.float32(n) * scale) + 0.5)) for n in (w, h))
    pw, ph = (-(-n // MULTIPLE) * MULTIPLE for n in (nw, nh))
    page = np.zeros((ph, pw, 3), np.uint8)
    page[:nh, :nw] = resize(image, nw, nh)
    return planar(page, MEAN, STD), ph // PATCH, pw // PATCH


def captioner_input(image: np.ndarray) -> np.ndarray:
    return planar(resize_to_fill(image, CAPTION_SIDE))


def line_input(image: np.ndarray, thick: bool = False, ink: int = 170) -> np.ndarray:
    """A text line for the handwriting reader: exact square, aspect not kept."""
    x = resize(image, LINE_SIDE, LINE_SIDE, "triangle")
    return planar(thickened(x, ink) if thick else x)


def gray_of(image: np.ndarray) -> np.ndarray:
    """(2126 r + 7152 g + 722 b) / 10000 in whole numbers."""
    return (image.astype(np.int64) @ np.array([2126, 7152, 722])) // 10000


def thickened(image: np.ndarray, ink: int = 170) -> np.ndarray:
    """Black where the pixel or a neighbour is ink."""
    g = np.pad(gray_of(image), 1, constant_values=255)
    h, w = image.shape[:2]
    least = np.min([g[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)
    return np.where((least < ink)[:, :, None], np.uint8(0), image)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[y : y + h, x : x + w]
