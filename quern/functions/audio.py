"""Signal features on NumPy arrays: resampling, framed spectra, and the two fixed networks. Weights are given or generated, never shipped."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np

from quern.sources.codecs import InvalidInput

# Fixed values of the signal chain.
RATE = 11_025
PHASES, TAPS, ROLLOFF, BETA = 4096, 35, 0.9, 6.0
WING = PHASES * (TAPS - 1) // 2
FINGERPRINT_WINDOW, FINGERPRINT_HOP, FINGERPRINT_FFT, FINGERPRINT_STEP, FINGERPRINT_FRAMES = 22_050, 11_025, 1024, 512, 42
MUSIC_WINDOW, MUSIC_HOP, MUSIC_FFT, MUSIC_STEP, MUSIC_FRAMES = 55_125, 11_025, 512, 256, 214
#: Kernel height, width, channels in and out, stride down and across.
EMBEDDER_LAYERS = ((1, 4, 1, 16, 1, 2), (4, 1, 16, 32, 2, 1), (1, 4, 32, 48, 1, 2), (4, 1, 48, 64, 2, 1), (1, 4, 64, 96, 1, 2), (4, 1, 96, 128, 2, 1), (1, 4, 128, 192, 1, 2), (4, 1, 192, 256, 2, 1), (1, 4, 256, 192, 1, 1), (4, 1, 192, 128, 1, 1))
#: Kernel height, width, channels in and out, pooled after.
DETECTOR_LAYERS = ((3, 3, 1, 8, True), (3, 3, 8, 16, True), (3, 3, 16, 32, True), (3, 3, 32, 64, True), (3, 3, 64, 64, True), (2, 2, 64, 32, True), (2, 2, 32, 32, False))
GROUPS, SPATIAL_EPS, INPUT_EPS, NORM_FLOOR, EMBEDDING, HIDDEN = 16, 0.1, 1e-8, 1e-12, 96, 16
F32 = np.float32


def kaiser_wing() -> np.ndarray:
    """Half of a Kaiser-windowed sinc, PHASES values to a tap."""
    i = np.arange(1, WING)
    angle = np.pi * i / PHASES
    window = np.i0(BETA * np.sqrt(np.maximum(1 - (i / (WING - 1)) ** 2, 0))) / np.i0(BETA)
    return np.concatenate([[ROLLOFF], np.sin(ROLLOFF * angle) / angle * window]).astype(F32)


@cache
def _half_kernel() -> np.ndarray:
    return kaiser_wing().astype(np.float64)


def resample(samples, rate: int) -> np.ndarray:
    """16-bit samples at any rate to floats at RATE.

    Output n lies at n * rate / RATE on the input's axis. It is the dot product of the input around it with a kernel that is symmetric
    in the distance, which is the half kernel of :func:`kaiser_wing`, looked up without interpolation and stretched where the rate
    falls. Samples beyond the ends are silent, and the kernel's last entry serves samples at or before the centre only. Places are
    whole numbers, so the entry of a distance is exact; where it lies on the border of two, the lower one serves samples before the
    centre if the clock of this signal chain, whose step is a double, runs behind.
    """
    if rate <= 0:
        raise InvalidInput("the sample rate must be positive")
    kernel, scale = _half_kernel(), max(rate, RATE)
    step = Fraction(1 / (RATE / float(rate)))
    behind = step < Fraction(rate, RATE)
    x = np.asarray(samples, np.int16) * 2.0**-15
    count = -(-len(x) // step)  # centres before the end
    reach = (TAPS - 1) // 2 * scale // RATE + 2
    around = np.arange(-reach, reach + 1)
    entries = np.where(around <= 0, WING, WING - 1)
    padded = np.pad(x, reach + 1)
    out = np.empty(count, F32)
    for a in range(0, count, 16_384):
        near, rest = np.divmod(np.arange(a, min(a + 16_384, count)) * rate, RATE)
        distance = np.abs(rest[:, None] - RATE * around)  # in units of 1 / RATE samples
        entry, border = np.divmod(distance * PHASES, scale)
        if behind:
            entry -= (border == 0) & (around <= 0) & (distance > 0)
        weight = np.where(entry < entries, kernel[np.minimum(entry, WING - 1)], 0.0)
        near = np.minimum(near, len(x))
        out[a : a + len(near)] = RATE / scale * (weight * padded[near[:, None] + around + reach + 1]).sum(1)
    return out


def windows(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """All whole windows, (n, size); none for shorter input."""
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.zeros((0, size), x.dtype)


def spectra(window: np.ndarray, fft: int, step: int, frames: int, keep_dc: bool) -> np.ndarray:
    """Magnitudes (frames, bins) of Hamming-weighted frames; a floating-point FFT of another order, so not bit for bit."""
    hamming = (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(fft) / fft)).astype(F32)
    part = np.lib.stride_tricks.sliding_window_view(window, fft)[::step][:frames] * hamming
    return np.abs(np.fft.rfft(part, axis=1))[:, 0 if keep_dc else 1 :].astype(F32)


def fingerprint_input(window) -> np.ndarray:
    w = np.asarray(window, F32)
    if len(w) != FINGERPRINT_WINDOW:
        raise InvalidInput(f"a fingerprint takes {FINGERPRINT_WINDOW} samples, not {len(w)}")
    return spectra(w, FINGERPRINT_FFT, FINGERPRINT_STEP, FINGERPRINT_FRAMES, False)


def music_input(window) -> np.ndarray:
    w = np.asarray(window, F32)
    if len(w) != MUSIC_WINDOW:
        raise InvalidInput(f"the detector takes {MUSIC_WINDOW} samples, not {len(w)}")
    return spectra(w, MUSIC_FFT, MUSIC_STEP, MUSIC_FRAMES, True)


def convolve(x: np.ndarray, kernel: np.ndarray, stride: tuple[int, int] = (1, 1), centred: bool = False) -> np.ndarray:
    """x (h, w, c) by kernel (kh, kw, c, o) to SAME size. ``centred`` pads (k - 1) // 2 before; else half of what the stride leaves over."""
    kh, kw = kernel.shape[:2]
    h, w = (-(-n // s) for n, s in zip(x.shape[:2], stride, strict=True))
    need = [max((o - 1) * s + k - n, 0) for o, s, k, n in zip((h, w), stride, (kh, kw), x.shape[:2], strict=True)]
    before = [(k - 1) // 2 for k in (kh, kw)] if centred else [n // 2 for n in need]
    padded = np.pad(x, [*((b, max(n - b, 0)) for b, n in zip(before, need, strict=True)), (0, 0)])
    view = np.lib.stride_tricks.sliding_window_view(padded, (kh, kw), (0, 1))[:: stride[0], :: stride[1]][:h, :w]
    return np.einsum("hwcij,ijco->hwo", view, kernel, optimize=True).astype(F32)


def group_norm(x: np.ndarray, scale: np.ndarray, bias: np.ndarray) -> np.ndarray:
    g = x.reshape(-1, GROUPS, x.shape[2] // GROUPS).astype(np.float64)
    mean, var = g.mean((0, 2), keepdims=True), g.var((0, 2), keepdims=True)
    return (((g - mean) / np.sqrt(var + SPATIAL_EPS)).reshape(x.shape) * scale + bias).astype(F32)


def elu(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, np.expm1(np.minimum(x, 0)), x).astype(F32)


@dataclass(frozen=True)
class Embedder:
    """Ten strided convolutions with group normalisation, then a head to a unit vector."""

    kernels: list[np.ndarray]
    scales: list[np.ndarray]
    biases: list[np.ndarray]
    head_kernel: np.ndarray  #: (128, 96, 16)
    head_scale: np.ndarray  #: (1536,)
    head_bias: np.ndarray
    output_kernel: np.ndarray
    output_bias: np.ndarray  #: (96,)

    @classmethod
    def generated(cls, seed: int = 1) -> Embedder:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(size=shape) / np.sqrt(np.prod(shape[:-1]))).astype(F32)
        n = HIDDEN * EMBEDDING
        return cls([draw(*s[:4]) for s in EMBEDDER_LAYERS], [np.ones(s[3], F32) for s in EMBEDDER_LAYERS], [np.zeros(s[3], F32) for s in EMBEDDER_LAYERS], draw(128, EMBEDDING, HIDDEN), np.ones(n, F32), np.zeros(n, F32), draw(n, 1)[:, 0], np.zeros(EMBEDDING, F32))

    @classmethod
    def from_floats(cls, raw: bytes) -> Embedder:
        """From little-endian floats: per layer kernel, scale, bias; then the five tensors of the head."""
        values, at = np.frombuffer(raw, "<f4"), 0

        def take(*shape: int) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape))
            if at + n > len(values):
                raise InvalidInput("too few weights")
            at += n
            return values[at - n : at].reshape(shape)

        layers = [(take(*s[:4]), take(s[3]), take(s[3])) for s in EMBEDDER_LAYERS]
        n = HIDDEN * EMBEDDING
        return cls(*(list(z) for z in zip(*layers, strict=True)), take(128, EMBEDDING, HIDDEN), take(n), take(n), take(n), take(EMBEDDING))

    def parameters(self) -> int:
        return sum(a.size for x in vars(self).values() for a in (x if isinstance(x, list) else [x]))

    def infer(self, spectrum: np.ndarray) -> np.ndarray:
        x = np.asarray(spectrum, F32).reshape(FINGERPRINT_FRAMES, 512, 1)
        x = (x - x.mean()) / np.sqrt(x.var() + F32(INPUT_EPS))
        for (*_, down, across), kernel, scale, bias in zip(EMBEDDER_LAYERS, self.kernels, self.scales, self.biases, strict=True):
            x = elu(group_norm(convolve(x, kernel, (down, across)), scale, bias))
        # The head reads the tensor as 128 rows of 96, writes 96 rows of 16, and normalises that as 16 rows of 96.
        hidden = np.einsum("id,idh->dh", x.reshape(128, EMBEDDING), self.head_kernel).reshape(HIDDEN, EMBEDDING)
        hidden = (hidden - hidden.mean(1, keepdims=True)) / np.sqrt(hidden.var(1, keepdims=True) + SPATIAL_EPS)
        hidden = elu(hidden * self.head_scale.reshape(HIDDEN, -1) + self.head_bias.reshape(HIDDEN, -1))
        y = (hidden * self.output_kernel.reshape(HIDDEN, -1)).sum(0) + self.output_bias
        return (y / np.sqrt(max(float((y * y).sum()), NORM_FLOOR))).astype(F32)


@dataclass(frozen=True)
class Detector:
    """Seven convolutions and three dense layers to the probability of music."""

    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    dense: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def generated(cls, seed: int = 2, sizes: tuple[int, int] = (8, 8)) -> Detector:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.normal(size=shape) / np.sqrt(np.prod(shape[:-1]))).astype(F32)
        widths = (384, *sizes, 1)
        return cls([draw(*s[:4]) for s in DETECTOR_LAYERS], [np.zeros(s[3], F32) for s in DETECTOR_LAYERS], [(draw(a, b), np.zeros(b, F32)) for a, b in zip(widths, widths[1:], strict=False)])

    @classmethod
    def from_floats(cls, raw: bytes, sizes: tuple[int, int] = (8, 8)) -> Detector:
        """From little-endian floats: per layer kernel and bias, then those of the dense layers."""
        if len(raw) % 4:
            raise InvalidInput("weights take four bytes each")
        shapes = [shape for *s, _ in DETECTOR_LAYERS for shape in (tuple(s), (s[3],))]
        widths = (384, *sizes, 1)
        shapes += [shape for a, b in zip(widths, widths[1:], strict=False) for shape in ((a, b), (b,))]
        values = np.frombuffer(raw, "<f4")
        if len(values) < sum(int(np.prod(s)) for s in shapes):
            raise InvalidInput("too few weights")
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = [v.reshape(s) for v, s in zip(np.split(values[: cuts[-1]], cuts[:-1]), shapes, strict=True)]
        n = 2 * len(DETECTOR_LAYERS)
        return cls(parts[:n:2], parts[1:n:2], list(zip(parts[n::2], parts[n + 1 :: 2], strict=True)))

    def infer(self, spectrum: np.ndarray) -> float:
        x = np.log(np.asarray(spectrum, F32).reshape(MUSIC_FRAMES, 257, 1) + F32(0.01))
        x = (x - x.mean()) / np.sqrt(max(float(x.var()), 0.01))
        for (*_, pooled), kernel, bias in zip(DETECTOR_LAYERS, self.kernels, self.biases, strict=True):
            x = np.maximum(convolve(x, kernel, centred=True) + bias, 0)
            if pooled:
                h, w = x.shape[0] // 2, x.shape[1] // 2
                x = x[: 2 * h, : 2 * w].reshape(h, 2, w, 2, -1).max((1, 3))
        y = x.ravel()
        for kernel, bias in self.dense[:-1]:
            y = np.maximum(y @ kernel + bias, 0)
        logit = float((y @ self.dense[-1][0] + self.dense[-1][1])[0])
        return float(1 / (1 + np.exp(-logit)))
