"""A small convolutional network over bytes, trained and applied with numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, and each filter keeps its
largest response per window. Windows overlap and cover a text to its end, so nothing is left out. The
byte 0 pads short texts and responds with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def windows(texts: list[bytes], length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts (n, length) as bytes, and the number of windows of each text (1 at least).

    The last window of a text ends where the text ends.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = 1 + np.maximum(0, -(-(sizes - length) // stride))
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.minimum(nth * stride, np.maximum(0, sizes[owner] - length)) + (np.cumsum(sizes) - sizes)[owner]
    data = np.frombuffer(b"".join(texts) + bytes(length), np.uint8)
    out = data[begin[:, None] + np.arange(length)]
    for i in np.flatnonzero(sizes[owner] < length):
        out[i, sizes[owner[i]]:] = 0
    return out, counts


@dataclass
class Filters:
    """Embedding and filters. Filters narrower than the widest are zero beyond their width."""

    widths: tuple[int, ...]
    per_width: int
    dims: int = 8
    seed: int = 0
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.wide, self.count = max(self.widths), self.per_width * len(self.widths)
        self.mask = np.zeros((self.wide, self.dims, self.count), np.float32)
        for i, w in enumerate(self.widths):
            self.mask[:w, :, i * self.per_width:(i + 1) * self.per_width] = 1
        if not self.params:
            scale = np.sqrt(2 / (self.mask.sum((0, 1)) + 1e-6))
            self.params = {
                "embed": rng.normal(0, 0.5, (256, self.dims)).astype(np.float32),
                "filters": (rng.normal(0, 1, self.mask.shape) * scale * self.mask).astype(np.float32),
                "bias": np.zeros(self.count, np.float32)}
            self.params["embed"][0] = 0

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses (windows, positions, filters) of a few windows."""
        n, length = rows.shape
        places = length - self.wide + 1
        flat = self.params["embed"][rows].reshape(n, length * self.dims)
        step = flat.strides
        seen = np.lib.stride_tricks.as_strided(flat, (n, places, self.wide * self.dims),
                                               (step[0], step[1] * self.dims, step[1]))
        table = self.params["filters"].reshape(-1, self.count)
        return (seen.reshape(n * places, -1) @ table).reshape(n, places, self.count)

    def pooled(self, rows: np.ndarray, block: int = 32) -> np.ndarray:
        """Largest response of each filter in each window, after bias and rectifier (windows, filters)."""
        out = np.empty((len(rows), self.count), np.float32)
        for i in range(0, len(rows), block):
            y = self.responses(rows[i:i + block])
            while y.shape[1] > 1:
                half = y.shape[1] // 2
                z = np.maximum(y[:, :half], y[:, half:2 * half])
                if y.shape[1] % 2:
                    np.maximum(z[:, 0], y[:, -1], out=z[:, 0])
                y = z
            out[i:i + block] = y[:, 0]
        return np.maximum(out + self.params["bias"], 0)

    def pooled_at(self, rows: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """As ``pooled``, with the position of each largest response."""
        out, at = np.empty((len(rows), self.count), np.float32), np.empty((len(rows), self.count), np.int64)
        for i in range(0, len(rows), block):
            y = self.responses(rows[i:i + block])
            best = at[i:i + block] = y.argmax(1)
            out[i:i + block] = np.take_along_axis(y, best[:, None], 1)[:, 0]
        return np.maximum(out + self.params["bias"], 0), at

    def gradients(self, rows: np.ndarray, pooled: np.ndarray, at: np.ndarray, up: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the pooled responses; only the windows at the maxima take part."""
        up = np.where(pooled > 0, up, 0).astype(np.float32)
        hit = rows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(self.wide)]  # (n, filters, wide)
        seen = self.params["embed"][hit]
        d_filters = np.einsum("nf,nfkd->kdf", up, seen, optimize=True) * self.mask
        back = up[:, :, None, None] * self.params["filters"].transpose(2, 0, 1)[None]
        d_embed = np.stack([np.bincount(hit.ravel(), back[..., d].ravel(), 256) for d in range(self.dims)], 1)
        d_embed[0] = 0
        return {"embed": d_embed.astype(np.float32), "filters": d_filters, "bias": up.sum(0)}


class Adam:
    """Plain Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            scale = np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
            self.params[k] -= self.rate * scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
