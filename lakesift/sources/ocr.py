"""Texts of images: conversion, four preparations, and an engine of yours tried with several layouts and languages.

Preparations are numpy on grey pictures.  Decoding needs PIL and the default engine pytesseract; both are imported only when used,
so either can be replaced by a function of your own.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable

import numpy as np

# Greatest side and quality of a converted picture, layouts, languages in the order they are tried, and
# the settings of the preparations.
MAX_SIDE, QUALITY = 2500, 90
LAYOUTS = (6, 11, 4)
LANGUAGES = ("eng+rus", "chi_sim+chi_tra+eng", "eng")
UPSCALE, CLIP, TILES, BLUR, WINDOW, OFFSET = 2, 3.0, 8, (0.25, 0.5, 0.25), 31, 11
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))

#: Picture, language and layout to text.
Engine = Callable[[np.ndarray, str, int], str]
#: Bytes to a grey picture and where it is from.
Loader = Callable[[bytes], tuple[np.ndarray, str]]


def convert(content: bytes) -> bytes:
    """A TIFF as JPEG: colour or grey, grey ones stretched, at most MAX_SIDE wide and high."""
    from PIL import Image, ImageOps

    picture = Image.open(io.BytesIO(content))
    if picture.mode == "L":
        picture = ImageOps.autocontrast(picture)
    elif picture.mode != "RGB":
        picture = picture.convert("RGB")
    if max(picture.size) > MAX_SIDE:
        picture.thumbnail((MAX_SIDE, MAX_SIDE), Image.Resampling.LANCZOS)
    out = io.BytesIO()
    picture.convert("RGB").save(out, format="JPEG", quality=QUALITY, optimize=True)
    return out.getvalue()


def load(content: bytes) -> tuple[np.ndarray, str]:
    """A grey picture, and whether it is the original, a converted TIFF or a TIFF that could not be converted."""
    from PIL import Image

    whence = "original_image"
    if content[:4] in (b"II*\0", b"MM\0*"):
        try:
            content, whence = convert(content), "converted_jpg"
        except OSError:
            whence = "original_tif"
    return np.asarray(Image.open(io.BytesIO(content)).convert("L")), whence


def equalized(grey: np.ndarray) -> np.ndarray:
    """Brightness spread so that all levels are about as frequent."""
    upto = np.bincount(grey.ravel(), minlength=256).cumsum()
    least = upto[upto > 0][0]
    if least == grey.size:
        return grey.copy()
    return np.rint((upto - least).clip(0) * 255 / (grey.size - least)).astype(np.uint8)[grey]


def equalized_in_tiles(grey: np.ndarray) -> np.ndarray:
    """Equalisation by tile with clipped histograms, blended between tiles, so that glare stays local."""
    h, w = grey.shape
    size = -(-h // TILES), -(-w // TILES)
    padded = np.pad(grey, ((0, size[0] * TILES - h), (0, size[1] * TILES - w)), mode="reflect" if min(h, w) > max(size) else "edge")
    tiles = padded.reshape(TILES, size[0], TILES, size[1]).transpose(0, 2, 1, 3).reshape(TILES * TILES, -1)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles]).astype(float)
    top = max(1.0, CLIP * tiles.shape[1] / 256)
    over = (counts - top).clip(0).sum(1, keepdims=True)
    levels = (np.minimum(counts, top) + over / 256).cumsum(1) * 255 / tiles.shape[1]
    levels = levels.reshape(TILES, TILES, 256)
    y, x = ((np.arange(n) + 0.5) / s - 0.5 for n, s in zip((h, w), size, strict=True))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: levels[i.clip(0, TILES - 1)[:, None], j.clip(0, TILES - 1)[None, :], grey]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(out.clip(0, 255)).astype(np.uint8)


def _along(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Rows and columns convolved with a symmetric kernel, edges reflected."""
    for axis in (0, 1):
        r = len(kernel) // 2
        wide = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="reflect" if a.shape[axis] > r else "edge")
        a = sum(k * np.take(wide, np.arange(i, i + a.shape[axis]), axis) for i, k in enumerate(kernel))
    return a


def local_threshold(grey: np.ndarray) -> np.ndarray:
    """White where a pixel is no more than OFFSET darker than its surroundings, weighted by a Gaussian."""
    sigma = 0.3 * ((WINDOW - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-0.5 * ((np.arange(WINDOW) - WINDOW // 2) / sigma) ** 2)
    mean = _along(grey.astype(float), kernel / kernel.sum())
    return np.where(grey > np.rint(mean) - OFFSET, 255, 0).astype(np.uint8)


def sharpened(grey: np.ndarray) -> np.ndarray:
    wide = np.pad(grey.astype(np.int32), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    h, w = grey.shape
    out = sum(k * wide[i : i + h, j : j + w] for i, row in enumerate(SHARPEN) for j, k in enumerate(row))
    return out.clip(0, 255).astype(np.uint8)


def two_levels(grey: np.ndarray) -> np.ndarray:
    """Black and white at the level that parts the brightness best (Otsu)."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    n, total = counts.cumsum(), (counts * np.arange(256)).cumsum()
    rest = grey.size - n
    with np.errstate(divide="ignore", invalid="ignore"):
        between = n * rest * (total / n - (total[-1] - total) / rest) ** 2
    return np.where(grey > int(np.nan_to_num(between).argmax()), 255, 0).astype(np.uint8)


def upscaled(grey: np.ndarray) -> np.ndarray:
    """Twice as wide and high, by cubic interpolation."""
    out = grey.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = (np.arange(n * UPSCALE) + 0.5) / UPSCALE - 0.5
        low = np.floor(at).astype(int)
        shape = [1, 1]
        shape[axis] = -1
        total = 0.0
        for k in (-1, 0, 1, 2):
            d = np.abs(at - low - k)
            weight = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * (d**3 - 5 * d**2 + 8 * d - 4), 0))
            total = total + np.take(out, (low + k).clip(0, n - 1), axis) * weight.reshape(shape)
        out = total
    return np.rint(out.clip(0, 255)).astype(np.uint8)


def preparations(grey: np.ndarray) -> list[np.ndarray]:
    """The four pictures that an engine sees."""
    in_tiles = np.rint(_along(equalized_in_tiles(grey).astype(float), np.array(BLUR))).astype(np.uint8)
    return [upscaled(p) for p in (equalized(grey), local_threshold(in_tiles), sharpened(grey), two_levels(grey))]


def tesseract(command: str | None = None) -> Engine:
    def engine(picture: np.ndarray, language: str, layout: int) -> str:
        import pytesseract
        from PIL import Image

        if command:
            pytesseract.pytesseract.tesseract_cmd = command
        return pytesseract.image_to_string(Image.fromarray(picture), lang=language, config=f"--oem 3 --psm {layout}")

    return engine


def cleaned(text: str) -> str:
    return re.sub(r"[ \t]+", " ", text.replace("\f", " ")).strip()


def backend(engine: Engine, loader: Loader = load) -> Callable[[bytes], tuple[str, str]]:
    """For ``files.texts``: of each preparation and layout the text in the first language that gives one, one below the other.

    A picture that cannot be read is ("", "failed"); an engine's error counts as no text.
    """

    def read(content: bytes) -> tuple[str, str]:
        try:
            grey, whence = loader(content)
        except Exception:  # whatever a decoder raises
            return "", "failed"
        found = []
        for picture in preparations(grey):
            for layout in LAYOUTS:
                for language in LANGUAGES:
                    try:
                        text = cleaned(engine(picture, language, layout))
                    except Exception:  # a language or layout that the engine lacks
                        continue
                    if text:
                        found.append(text)
                        break
        return "\n".join(found), whence

    return read
