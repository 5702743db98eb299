"""Rotation, quantization and estimation of whole matrices in numpy: what the Arrow workers run.

Everything is in double. A row is a rotated, padded vector; r = row - centre; D its length; B bits in all, of which
one is the sign and ex = B - 1 the magnitude.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tessella.functions.integers import floor_log2, is_power_of_2, padded

#: Width of the error bound, in standard deviations.
EPS = 1.9
#: Share of the sweep's end at which it starts, by ex bits.
SWEEP_FROM = (0.0, 0.15, 0.20, 0.52, 0.59, 0.71, 0.75, 0.77, 0.81)
SLACK = 1e-5
PRIME = 2147483647


def sign_of(seed: int, turn: int, i: np.ndarray | int):
    """+1 or -1 for each coordinate of a round: a formula in whole numbers that SQL can repeat."""
    h = (seed * 48271 + (turn + 1) * 69621 + (i + 1) * 40692 + ((i + 1) * (i + 1) % 65537) * 16807) % 2147483647
    return 1 - 2 * (h // 65536 % 2)


def flip(x: np.ndarray, seed: int, turn: int) -> np.ndarray:
    return x * sign_of(seed, turn, np.arange(x.shape[1]))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Sum over i of (-1) ** bits(i & j) x_i, unscaled; the length is a power of 2."""
    n, size, step = x.shape[0], x.shape[1], 1
    while step < size:
        y = x.reshape(n, -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x


def kac_step(x: np.ndarray) -> np.ndarray:
    """Halves (a, b) become (a + b, a - b), unscaled."""
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half] + x[:, half:], x[:, :half] - x[:, half:]], axis=1)


@dataclass(frozen=True)
class Rotation:
    """A seeded orthogonal map with padding to a multiple of 64.

    kind "fht": four rounds of sign flips and Hadamard transforms (with Kac steps where the length is no power of 2);
    kind "matrix": the Q of a seeded Gaussian matrix. Equal settings give equal maps.
    """

    dim: int
    kind: str = "fht"
    seed: int = 42
    size: int = field(default=0)

    def __post_init__(self):
        size = self.size or padded(self.dim)
        if size % 64 or size < self.dim:
            raise ValueError(f"padded length {size}: a multiple of 64 of at least {self.dim} is needed")
        if self.kind not in ("fht", "matrix"):
            raise ValueError(f"no rotation {self.kind!r}")
        if self.kind == "fht" and not 64 <= size < 4096:
            raise ValueError(f"the transform takes lengths from 64 to 4095, not {size}")
        object.__setattr__(self, "size", size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if x.ndim != 2 or x.shape[1] != self.dim:
            raise ValueError(f"vectors of length {self.dim} are needed, not {x.shape}")
        if self.kind == "matrix":
            return x @ _orthogonal(self.size, self.seed)[: self.dim]
        x = np.concatenate([x, np.zeros((len(x), self.size - self.dim))], axis=1)
        if is_power_of_2(self.size):
            for turn in range(4):
                x = hadamard(flip(x, self.seed, turn)) / np.sqrt(self.size)
            return x
        span = 1 << floor_log2(self.size)
        for turn in range(4):
            x = flip(x, self.seed, turn)
            part = slice(0, span) if turn % 2 == 0 else slice(self.size - span, self.size)
            x[:, part] = hadamard(x[:, part]) / np.sqrt(span)
            x = kac_step(x)
        return x / 4

    def to_json(self) -> dict:
        return {"dim": self.dim, "kind": self.kind, "seed": self.seed, "size": self.size}


@lru_cache(8)
def _orthogonal(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(gaussian(size, size, seed))
    return (q * np.sign(np.diag(r))).T


def drawn(seed: int, i: np.ndarray, j: np.ndarray | int = 0) -> np.ndarray:
    """A number from 0 to PRIME - 1 that depends on seed and the pair (i, j) only: a formula in whole numbers that SQL can repeat."""
    h = (seed % PRIME * 48271 + (np.asarray(i, np.int64) % PRIME + 1) * 69621 + (np.asarray(j, np.int64) % PRIME + 1) * 40692) % PRIME
    for c in (12345, 6789, 101):
        h = (h * h + c) % PRIME
    return h


def drawn_int(lo: int, hi: int, seed: int, i: np.ndarray) -> np.ndarray:
    """A number from lo to hi for each i."""
    return lo + drawn(seed, i) % (hi - lo + 1)


def gaussian_of(ids: np.ndarray, cols: int, seed: int = 42) -> np.ndarray:
    """Rows of a seeded Gaussian matrix, each from its own number alone, so that any executor can make any row (Box and Muller)."""
    i, j = np.asarray(ids, np.int64)[:, None], np.arange(cols)
    u, v = (drawn(seed, i, 2 * j) + 1) / PRIME, drawn(seed, i, 2 * j + 1) / PRIME
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def gaussian(rows: int, cols: int, seed: int = 42) -> np.ndarray:
    return gaussian_of(np.arange(rows), cols, seed)


def check_bits(bits: int) -> int:
    """ex bits of a total of 1 to 9."""
    if not 1 <= bits <= 9:
        raise ValueError(f"{bits} bits: 1 to 9 are possible")
    return bits - 1


def _safe(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def factors(r: np.ndarray, c: np.ndarray, u: np.ndarray, metric: str) -> dict[str, np.ndarray]:
    """f_add, f_rescale, f_error of residuals r with decoded directions u about centres c; a zero residual has no error and no rescale."""
    n2, s, shift = (r * r).sum(1), (r * u).sum(1), (c * u).sum(1)
    spread = np.maximum(_safe(n2 * (u * u).sum(1), s * s) - 1, 0) / max(r.shape[1] - 1, 1)
    error = np.sqrt(n2) * EPS * np.sqrt(spread)
    ratio = _safe(n2, s)
    if metric == "l2":
        return {"f_add": n2 + 2 * ratio * shift, "f_rescale": -2 * ratio, "f_error": 2 * error}
    return {"f_add": 1 - (r * c).sum(1) + ratio * shift, "f_rescale": -ratio, "f_error": error}


def certain(f_error: np.ndarray, g_error: np.ndarray, size: int) -> np.ndarray:
    """The most that an estimate can err, by Cauchy and Schwarz, a little widened for rounding; f_error is EPS deviations of size - 1 directions."""
    return f_error * (np.sqrt(max(size - 1, 1)) / EPS) * g_error + 1e-7 * (1 + g_error * g_error)


def one_bit(r: np.ndarray, zero_is_one: bool = False) -> np.ndarray:
    return ((r >= 0) if zero_is_one else (r > 0)).astype(np.int64)


def best_scale(a: np.ndarray, ex: int) -> float:
    """The scale t of |r| / |r|'s coordinates whose rounding has the largest cosine with them, found by a sweep over all t at which a level changes."""
    top = a.max(initial=0.0)
    if ex == 0 or top <= 0:
        return 0.0
    last = (1 << ex) - 1
    end = (last + 10) / top
    level = np.floor(end * SWEEP_FROM[ex] * a + SLACK)
    den, num = 0.25 * len(a) + (level * level + level).sum(), ((level + 0.5) * a).sum()
    live = np.flatnonzero(a > 0)
    dims, steps, times = [live], [level[live] + 1], [(level[live] + 1) / a[live]]
    more = live
    step = level[live] + 2
    while len(more):
        good = (step <= last) & (step / a[more] < end)
        more, step = more[good], step[good]
        dims.append(more), steps.append(step), times.append(step / a[more])
        step = step + 1
    dim, step, t = np.concatenate(dims), np.concatenate(steps), np.concatenate(times)
    order = np.lexsort((dim, t))
    score = (num + np.cumsum(a[dim][order])) / np.sqrt(den + np.cumsum(2 * step[order]))
    return float(t[order][score.argmax()])


@lru_cache(64)
def usual_scale(dim: int, ex: int, seed: int = 42) -> float:
    """Mean best scale of 100 random directions: the fast setting."""
    x = np.abs(gaussian(100, dim, seed))
    x /= np.sqrt((x * x).sum(1))[:, None]
    return float(np.mean([best_scale(row, ex) for row in x]))


def magnitudes(r: np.ndarray, ex: int, scale: float | np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of |r| on ex bits, flipped where r is below zero, and 1 / (sum of decoded times direction). scale None: the best of each row."""
    size = np.sqrt((r * r).sum(1))
    a = np.abs(r) * _safe(np.ones(len(r)), size)[:, None]
    t = np.array([best_scale(row, ex) for row in a]) if scale is None else np.broadcast_to(np.asarray(scale, float), (len(r),))
    last = (1 << ex) - 1
    m = np.minimum(np.floor(t[:, None] * a + SLACK), last).astype(np.int64)
    w = ((m + 0.5) * a).sum(1)
    return np.where(r < 0, last - m, m), np.where(w > 0, _safe(np.ones(len(r)), w), 1.0)


def decoded(sign: np.ndarray, code: np.ndarray, ex: int) -> np.ndarray:
    """The direction that a total code stands for."""
    return code + (sign << ex) - ((1 << ex) - 0.5)


@dataclass
class Codes:
    """Sign bits, magnitudes, and their factors about a centre."""

    bits: int
    sign: np.ndarray
    one: dict[str, np.ndarray]
    code: np.ndarray
    ex: dict[str, np.ndarray]


def encode(x: np.ndarray, c: np.ndarray, bits: int, metric: str = "l2", fast: bool = False) -> Codes:
    """Rows of x about centres c (one for all, or one a row). With 1 bit the ex factors are those of the sign alone."""
    ex = check_bits(bits)
    c = np.broadcast_to(c, x.shape)
    r = x - c
    sign = one_bit(r, zero_is_one=ex > 0)
    one = factors(r, c, sign - 0.5, metric)
    if ex == 0:
        return Codes(bits, sign, one, np.zeros_like(sign), one)
    code, _ = magnitudes(r, ex, usual_scale(x.shape[1], ex) if fast else None)
    return Codes(bits, sign, one, code, factors(r, c, decoded(sign, code, ex), metric))


def query_terms(q: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """k1 and kb: the constants of the one-bit and the full estimate."""
    total = q.sum(-1)
    return -0.5 * total, -((1 << bits) - 1) / 2 * total


def centre_terms(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """g_add and g_error of queries and centres, row by row."""
    d2 = ((q - c) ** 2).sum(-1)
    return (d2 if metric == "l2" else -(q * c).sum(-1)), np.sqrt(d2)


def estimates(codes: Codes, q: np.ndarray, g_add, g_error) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one query and all rows: the one-bit estimate and its lower bound, the full estimate and its lower bound."""
    ex = codes.bits - 1
    k1, kb = query_terms(q, codes.bits)
    ip = codes.sign @ q
    est = codes.one["f_add"] + g_add + codes.one["f_rescale"] * (ip + k1)
    low = est - codes.one["f_error"] * g_error
    full = codes.ex["f_add"] + g_add + codes.ex["f_rescale"] * ((1 << ex) * ip + codes.code @ q + kb)
    return est, low, full, full - codes.one["f_error"] * g_error / (1 << ex)


def scalar_quantize(x: np.ndarray, c: np.ndarray, bits: int, mode: str = "reconstruction", fast: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total codes with delta and vl, so that code * delta + vl stands for x - c. Modes: reconstruction, unbiased, plain."""
    ex = check_bits(bits)
    r = x - np.broadcast_to(c, x.shape)
    sign = one_bit(r, zero_is_one=ex > 0)
    code = np.zeros_like(sign) if ex == 0 else magnitudes(r, ex, usual_scale(x.shape[1], ex) if fast else None)[0]
    u = decoded(sign, code, ex)
    nd, nu = np.sqrt((r * r).sum(1)), np.sqrt((u * u).sum(1))
    cosine = _safe((r * u).sum(1), nd * nu)
    scale = {"reconstruction": nd / nu * cosine, "unbiased": _safe(nd / nu, cosine), "plain": nd / nu}[mode]
    return code + (sign << ex), scale, -scale * ((1 << ex) - 0.5)


def lookup_table(q: np.ndarray, bits: int = 8) -> tuple[np.ndarray, float, float]:
    """Partial sums of four coordinates at a time (first coordinate highest), on 8 or 16 bits: levels, delta, and lo times the number of tables."""
    groups = q.reshape(-1, 4)
    masks = (np.arange(16)[:, None] >> np.arange(3, -1, -1)) & 1
    sums = groups @ masks.T
    lo, hi = sums.min(), sums.max()
    delta = (hi - lo) / ((1 << bits) - 1)
    return (np.round(_safe(sums - lo, np.array(delta))).astype(np.int64) if delta else np.zeros(sums.shape, np.int64)), float(delta), float(lo * len(groups))


def table_dot(sign: np.ndarray, levels: np.ndarray, delta: float, low: float) -> np.ndarray:
    """<sign, q> through a lookup table of q."""
    masks = sign.reshape(len(sign), -1, 4) @ np.array([8, 4, 2, 1])
    return levels[np.arange(levels.shape[0]), masks].sum(1) * delta + low


def pack_codes(codes: np.ndarray, bits: int) -> list[bytes]:
    """Rows of unsigned codes as bits, the lowest first: dim * bits / 8 bytes each."""
    planes = (codes[:, :, None] >> np.arange(bits)) & 1
    return [np.packbits(p.ravel().astype(np.uint8), bitorder="little").tobytes() for p in planes]


def unpack_codes(rows: list[bytes], dim: int, bits: int) -> np.ndarray:
    flat = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little", count=dim * bits) for x in rows])
    return flat.reshape(len(rows), dim, bits).astype(np.int64) @ (1 << np.arange(bits))


def record_bytes(size: int, bits: int) -> dict[str, int]:
    """Bytes that a vector of a padded length takes: sign record, magnitude record, and a block of 32 with or without error terms."""
    ex = check_bits(bits)
    return {"one": size // 8 + 12, "ex": size * ex // 8 + 8 if ex else 0, "block": 32 * size // 8 + 384, "graph_block": 32 * size // 8 + 256}


def rotation_of(x: dict) -> Rotation:
    return Rotation(x["dim"], x["kind"], x["seed"], x["size"])
