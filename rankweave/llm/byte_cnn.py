"""A small convolutional network over bytes, forward and backward in numpy.

Each byte is a learned vector; filters of several widths slide over a window of fixed length,
the largest response of each filter is kept, and a softmax layer names the class. As a
filter's response is a sum over its taps and a tap only sees one byte, each tap is a table of
256 rows, and the convolution adds rows of tables. With max pooling only one position of each
filter gets a gradient.
"""

from __future__ import annotations

import numpy as np

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 16, 8


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """The bytes in rows of a fixed length; the last row is filled up with zeros."""
    rows = max(1, -(-len(raw) // window))
    out = np.zeros(rows * window, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(rows, window)


class ByteCNN:
    def __init__(self, classes: list[str], seed: int = 1, widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS,
                 depth: int = DEPTH):
        rng = np.random.default_rng(seed)
        self.classes, self.widths, self.filters = classes, widths, filters
        self.p = {"embed": rng.normal(0, 0.5, (256, depth)), "bias": np.zeros(filters * len(widths)),
                  "out": rng.normal(0, 0.1, (filters * len(widths), len(classes))), "b": np.zeros(len(classes))}
        for w in widths:
            self.p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(depth * w), (w, depth, filters))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.ready()

    def ready(self) -> None:
        """Tables of the taps, after the parameters changed."""
        self.taps = {w: [np.ascontiguousarray(self.p["embed"] @ self.p[f"k{w}"][o]) for o in range(w)]
                     for w in self.widths}

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of every filter in every window, and where it is."""
        best, where = [], []
        for w in self.widths:
            n = x.shape[1] - w + 1
            z = self.taps[w][0][x[:, :n]]
            for o in range(1, w):
                z += self.taps[w][o][x[:, o:o + n]]
            if places:
                at = z.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(z.max(axis=1))
        h = np.concatenate(best, axis=1) + self.p["bias"]
        return (h, where) if places else h

    def log_probs(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        out = []
        for a in range(0, len(x), step):
            z = np.maximum(self.pooled(x[a:a + step]), 0) @ self.p["out"] + self.p["b"]
            z -= z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, where = self.pooled(x, places=True)
        a = np.maximum(h, 0)
        z = a @ self.p["out"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": a.T @ d, "b": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        dh = (d @ self.p["out"].T) * (h > 0)
        g["bias"] = dh.sum(axis=0)
        column = np.arange(self.filters)[None, :]
        for k, w in enumerate(self.widths):
            part, at = dh[:, k * self.filters:(k + 1) * self.filters], where[k]
            grad = np.zeros_like(self.p[f"k{w}"])
            for o in range(w):
                seen = np.take_along_axis(x, at + o, axis=1)
                table = np.zeros((256, self.filters), dtype=np.float32)
                np.add.at(table, (seen, np.broadcast_to(column, seen.shape)), part)
                grad[o] = self.p["embed"].T @ table
                g["embed"] += table @ self.p[f"k{w}"][o].T
            g[f"k{w}"] = grad
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam over shuffled batches; the step shrinks to zero in the course of training."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), batch):
                rows = order[a:a + batch]
                t += 1
                step = rate * (1 - (t - 1) / total)
                for k, g in self.gradient(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
                self.ready()
