"""Image kernels on arrays (height x width x 3, RGB, uint8), by the public formulas."""

from __future__ import annotations

import hashlib

import numpy as np


def to_rgb(a: np.ndarray) -> np.ndarray:
    """uint8 RGB of a gray, RGB or RGBA image; floats are taken as 0-1."""
    a = np.asarray(a)
    if a.ndim == 2:
        a = a[:, :, None]
    if a.ndim != 3:
        raise ValueError("an image has two or three axes")
    if a.dtype.kind == "f":
        a = (np.clip(a, 0, 1) * 255).astype(np.uint8)
    a = a[:, :, [0, 0, 0]] if a.shape[2] < 3 else a[:, :, :3]
    return a.astype(np.uint8)


def gray(a: np.ndarray) -> np.ndarray:
    return a.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _padded(g: np.ndarray, by: int) -> np.ndarray:
    return np.pad(g, by, mode="reflect") if min(g.shape) > by else np.pad(g, by, mode="edge")


def laplacian_variance(g: np.ndarray) -> float:
    p = _padded(g, 1)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def noise(g: np.ndarray) -> float:
    """Deviation of what a 5 x 5 binomial blur takes away."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    p = _padded(g, 2)
    h, w = g.shape
    rows = sum(k[i] * p[:, i : i + w] for i in range(5))
    return float((g - np.rint(sum(k[i] * rows[i : i + h] for i in range(5)))).std())


def blockiness(g: np.ndarray, size: int = 8) -> float:
    d = [np.abs(g[i] - g[i - 1]).mean() for i in range(size, g.shape[0], size)] + [np.abs(g[:, i] - g[:, i - 1]).mean() for i in range(size, g.shape[1], size)]
    return float(np.mean(d)) if d else 0.0


def entropy(g: np.ndarray) -> float:
    p = np.bincount(np.clip(g, 0, 255).astype(np.int64).ravel(), minlength=256) / g.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def hsv(a: np.ndarray) -> np.ndarray:
    """8-bit convention: hue in half degrees, saturation and value in 0-255."""
    f = a.astype(np.float64)
    v, low = f.max(axis=2), f.min(axis=2)
    d = v - low
    safe = np.where(d > 0, d, 1)
    r, g, b = f[..., 0], f[..., 1], f[..., 2]
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(d > 0, np.where(h < 0, h + 360, h), 0)
    return np.stack([h / 2, np.where(v > 0, 255 * d / np.where(v > 0, v, 1), 0), v], axis=2)


def lab(a: np.ndarray) -> np.ndarray:
    """8-bit convention: L * 255 / 100, a + 128, b + 128."""
    c = a.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    x = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    bright = np.where(x[..., 1] > 0.008856, 116 * np.cbrt(x[..., 1]) - 16, 903.3 * x[..., 1])
    return np.stack([bright * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=2)


def area_resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the (fractional) cells of a new grid."""

    def weights(n: int, m: int) -> np.ndarray:
        lo, hi = np.arange(m) * n / m, (np.arange(m) + 1) * n / m
        i = np.arange(n)
        out = np.clip(np.minimum(hi[:, None], i[None, :] + 1) - np.maximum(lo[:, None], i[None, :]), 0, None)
        return out / out.sum(axis=1, keepdims=True)

    return weights(g.shape[0], h) @ g @ weights(g.shape[1], w).T


def linear_resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear with pixel centres aligned."""

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(x).astype(int)
        return lo, np.minimum(lo + 1, n - 1), x - lo

    a, b, t = at(g.shape[0], h)
    c, d, u = at(g.shape[1], w)
    rows = g[a] * (1 - t)[:, None] + g[b] * t[:, None]
    return rows[:, c] * (1 - u) + rows[:, d] * u


def _bits(a: np.ndarray) -> int:
    """64 bits, most significant first, as a signed number."""
    n = 0
    for b in a.ravel():
        n = n << 1 | int(b)
    return n - (1 << 64) if n >> 63 else n


def phash(g: np.ndarray) -> int:
    s = area_resize(g, 32, 32)
    k = np.arange(32)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.sqrt(2 / 32)
    c[0] /= np.sqrt(2)
    low = (c @ s @ c.T)[:8, :8]
    return _bits(low > np.median(low))


def ahash(g: np.ndarray) -> int:
    s = area_resize(g, 8, 8)
    return _bits(s > s.mean())


def glcm(g: np.ndarray, size: int = 128, levels: int = 64) -> dict[str, float]:
    """Means over four directions of the co-occurrence measures at distance 1, of 0-255 levels."""
    return cooccurrence(np.clip(linear_resize(g, size, size), 0, 255).astype(np.int64) // (256 // levels), levels)


def texture_of(scores: np.ndarray, size: int = 128, levels: int = 64) -> dict[str, float]:
    """The same of any map of numbers, spread over the levels from its least to its greatest."""
    s = linear_resize(scores, size, size)
    return cooccurrence(((s - s.min()) / (s.max() - s.min() + 1e-9) * (levels - 1)).astype(np.int64), levels)


def cooccurrence(q: np.ndarray, levels: int) -> dict[str, float]:
    size = len(q)
    i, j = np.mgrid[0:levels, 0:levels]
    out: dict[str, list[float]] = {}
    for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1)):
        a, b = (q[: size - dy, : size - dx], q[dy:, dx:]) if dx >= 0 else (q[: size - dy, -dx:], q[dy:, : size + dx])
        p = np.bincount((a * levels + b).ravel(), minlength=levels**2).reshape(levels, levels).astype(float)
        p = (p + p.T) / (2 * a.size)
        m = (i * p).sum()
        var = ((i - m) ** 2 * p).sum()
        for k, v in (
            ("contrast", ((i - j) ** 2 * p).sum()), ("dissimilarity", (np.abs(i - j) * p).sum()), ("homogeneity", (p / (1 + (i - j) ** 2)).sum()),
            ("asm", (p**2).sum()), ("energy", np.sqrt((p**2).sum())), ("correlation", ((i - m) * (j - m) * p).sum() / var if var > 1e-15 else 1.0),
        ):
            out.setdefault(f"glcm_{k}", []).append(float(v))
    return {k: float(np.mean(v)) for k, v in out.items()}


def frequency_bands(g: np.ndarray, size: int = 128) -> dict[str, float]:
    """Shares of the spectrum's magnitude in three rings."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(linear_resize(g, size, size))))
    y, x = np.mgrid[0:size, 0:size] - size // 2
    r = np.hypot(y, x) / (size // 2)
    total = f.sum() + 1e-12
    return {"freq_low": float(f[r < 0.1].sum() / total), "freq_mid": float(f[(r >= 0.1) & (r < 0.4)].sum() / total), "freq_high": float(f[r >= 0.4].sum() / total)}


def record(a: np.ndarray, blur: float = 50.0, texture: bool = True) -> dict[str, object]:
    """All metrics of one RGB image."""
    h, w = a.shape[:2]
    g, whole = gray(a), np.rint(gray(a))
    f = a.reshape(-1, 3).astype(np.float64)
    s, la = hsv(a), lab(a)
    mean = f.mean(axis=0)
    warm = mean[0] / (mean[2] + 1e-6)
    sharp = laplacian_variance(whole)
    out: dict[str, object] = {
        "height": h, "width": w, "channels": 3, "aspect_ratio": round(w / h, 4), "megapixels": round(h * w / 1e6, 4),
        "mean_rgb": mean.tolist(), "std_rgb": f.std(axis=0).tolist(), "min_rgb": f.min(axis=0).tolist(), "max_rgb": f.max(axis=0).tolist(),
        "brightness": float(g.mean()), "contrast": float(g.std()), "sharpness": sharp, "is_blurry": sharp < blur, "noise_estimate": noise(whole),
        "overexposed_frac": float((g > 245).mean()), "underexposed_frac": float((g < 10).mean()), "entropy_val": entropy(whole), "compression_score": blockiness(g),
        "mean_hsv": s.reshape(-1, 3).mean(axis=0).tolist(), "mean_lab": la.reshape(-1, 3).mean(axis=0).tolist(), "saturation_mean": float(s[..., 1].mean()),
        "is_grayscale_like": float(s[..., 1].mean()) < 15, "color_temp": "warm" if warm > 1.1 else "cool" if warm < 0.9 else "neutral",
        "phash": phash(g), "ahash": ahash(g), "md5": hashlib.md5(a.tobytes()).hexdigest(),
    }
    if texture:
        out |= glcm(g) | frequency_bands(g)
    return out
