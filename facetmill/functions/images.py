"""Kernels for one gray image (rows x columns of numbers 0 to 255)."""

from __future__ import annotations

import re

import numpy as np

GRAY, TOLERANCE, STD_TOLERANCE = 127.0, 2.0, 0.75
CELL, BINS, BLOCK = 8, 9, 2
_HEADER = re.compile(rb"(P[2356])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s")


def decode_pnm(content: bytes) -> np.ndarray | None:
    """A P2, P3, P5 or P6 file as gray float32; None if it can't be read.

    Three channels are averaged; values that are all at most 1 are taken as
    shares of 255.
    """
    m = _HEADER.match(content or b"")
    if not m:
        return None
    kind, w, h, top = m[1], int(m[3]), int(m[5]), int(m[7])
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * channels
    if not n or not 0 < top < 65536:
        return None
    raw = content[m.end() :]
    if kind in (b"P2", b"P3"):
        try:
            values = np.array(re.sub(rb"#[^\n]*", b" ", raw).split()[:n], dtype=np.int64)
        except ValueError:
            return None
    else:
        kind_of = np.dtype(">u2") if top > 255 else np.dtype("u1")
        if len(raw) < n * kind_of.itemsize:
            return None
        values = np.frombuffer(raw, dtype=kind_of, count=n)
    if len(values) < n:
        return None
    image = values.astype(np.float32).reshape((h, w) if channels == 1 else (h, w, 3))
    if channels == 3:
        image = image.mean(axis=2, dtype=np.float32)
    return image * np.float32(255.0) if image.max() <= 1.0 else image


def gray_bars(image: np.ndarray) -> tuple[int, int]:
    """Widths of the uniform gray bars at the left and right; one wider than a quarter of the image counts as none."""
    w = image.shape[1]
    other = np.flatnonzero(~((np.abs(image.mean(axis=0) - GRAY) <= TOLERANCE) & (image.std(axis=0) <= STD_TOLERANCE)))
    left, right = (int(other[0]), w - 1 - int(other[-1])) if len(other) else (w, 0)
    return left if left <= w // 4 else 0, right if right <= w // 4 else 0


def crop_bars(image: np.ndarray) -> tuple[np.ndarray, int, int]:
    left, right = gray_bars(image)
    return image[:, left : image.shape[1] - right], left, right


def clahe(image: np.ndarray, tile: int = 8, clip_limit: float = 0.02, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive equalisation (Zuiderveld, 1994), 0 to 255.

    Tiles of ``tile`` pixels over the mirrored image; each tile's histogram is
    clipped at a share of its pixels and the rest spread evenly; the mappings
    of the four nearest tiles are blended. A constant image stays constant.
    """
    image = np.clip(np.asarray(image, dtype=np.float64), 0.0, 255.0)
    low, high = image.min(), image.max()
    if low == high:
        return image.astype(np.float32)
    level = np.round((image - low) / (high - low) * (bins - 1)).astype(np.int64)
    h, w = level.shape
    padded = np.pad(level, ((0, -h % tile), (0, -w % tile)), mode="symmetric")
    rows, cols = padded.shape[0] // tile, padded.shape[1] // tile
    tiles = padded.reshape(rows, tile, cols, tile).transpose(0, 2, 1, 3).reshape(rows * cols, tile * tile)
    counts = np.zeros((rows * cols, bins))
    np.add.at(counts, (np.repeat(np.arange(rows * cols), tile * tile), tiles.ravel()), 1)
    clip = max(1, int(clip_limit * tile * tile))
    excess = np.maximum(counts - clip, 0).sum(axis=1, keepdims=True)
    counts = np.minimum(counts, clip) + excess / bins
    mapping = (counts.cumsum(axis=1) / (tile * tile)).reshape(rows, cols, bins)

    def places(n: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / tile - 0.5
        first = np.floor(at).astype(np.int64)
        return np.clip(first, 0, last), np.clip(first + 1, 0, last), at - first

    r0, r1, fr = places(h, rows - 1)
    c0, c1, fc = places(w, cols - 1)
    pick = lambda r, c: mapping[r[:, None], c[None, :], level]
    top = pick(r0, c0) * (1 - fc) + pick(r0, c1) * fc
    bottom = pick(r1, c0) * (1 - fc) + pick(r1, c1) * fc
    out = top * (1 - fr)[:, None] + bottom * fr[:, None]
    low, high = out.min(), out.max()
    return ((out - low) / (high - low) * 255.0 if high > low else out * 255.0).astype(np.float32)


def hog(image: np.ndarray) -> np.ndarray:
    """Histogram of oriented gradients (Dalal and Triggs, 2005): 9 bins, 8 x 8 cells, 2 x 2 blocks, clipped L2 norm.

    Central differences, zero at the borders; order: block row, block column,
    cell row, cell column, bin.
    """
    image = np.asarray(image, dtype=np.float64) / 255.0
    down, across = np.zeros_like(image), np.zeros_like(image)
    down[1:-1], across[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    rows, cols = image.shape[0] // CELL, image.shape[1] // CELL
    if rows < BLOCK or cols < BLOCK:
        return np.zeros(0)
    size = np.hypot(down, across)[: rows * CELL, : cols * CELL]
    angle = np.degrees(np.arctan2(down, across))[: rows * CELL, : cols * CELL]
    angle = np.where(angle < 0, angle + 180, angle)
    angle = np.where(angle >= 180, angle - 180, angle)
    bin_ = np.minimum((angle // (180 / BINS)).astype(np.int64), BINS - 1)
    cell = (np.arange(rows * CELL)[:, None] // CELL) * cols + np.arange(cols * CELL)[None, :] // CELL
    cells = np.bincount((cell * BINS + bin_).ravel(), size.ravel(), minlength=rows * cols * BINS).reshape(rows, cols, BINS) / (CELL * CELL)
    blocks = np.lib.stride_tricks.sliding_window_view(cells, (BLOCK, BLOCK), axis=(0, 1)).transpose(0, 1, 3, 4, 2)
    norm = lambda b: b / np.sqrt((b**2).sum(axis=(2, 3, 4), keepdims=True) + 1e-10)
    return norm(np.minimum(norm(blocks), 0.2)).ravel()
