import numpy as np
import pytest

from quern.functions import audio as A
from quern.operators import audio as O
from quern.operators.index import Settings, VectorIndex
from quern.sources.codecs import InvalidInput, deterministic_pcm

# Samples at two rates, and their first outputs as float bits.
AT_22050 = [2307, -3446, -11841, -12952, -6592, -2734, 797, 422, 1225, -176, 2223, 2834, 1672, 1953, 1808, 2679, 198, 1376, -6004, -10594, -12301, -17790, -20060, -21813, -21000, -25707, -26290, -25755, -26974, -23627, -22712, -20506, -18887, -17090, -16437, -15486, -12247, -10428, -7104, -5509, -8508, -8115, -9136, -11433, -10122, -9796, -9834, -8816, -8220, -8261, -7847, -8525, -8031, -6652, -5523, -5128, -9292, -6616, -860, -74, 2111, 6573, 9262, 10242]
WANT_22050 = [0x3CBFAB7E, 0xBEA298F0, 0xBE822D64, 0x3D0E4081, 0xB8BCB400, 0x3D822F8C, 0x3D823021, 0x3D69D598, 0x3D54B48F, 0xBE1A5F84, 0xBED979E0, 0xBF19F541, 0xBF3135C4, 0xBF4C295F, 0xBF4AE32C, 0xBF2F308C]
AT_16000 = [1841, -6785, -13540, -6090, -844, 1104, 372, 1204, 2955, 1389, 2414, 1527, 1261, -4742, -11470, -15166, -21228, -20634, -24781, -26125, -26492, -24413, -21803, -19388, -17072, -16124, -13112, -9496, -5951, -7779, -8588, -10548, -10537, -9519, -9335, -7913, -8325, -8068, -7975, -5261, -6227, -8663, -1602, 282, 4975, 9161, 11210, 15700, 17305, 9866, 2255, -2461, -8352, -11909, -16166, -15856, -12810, -11783, -11975, -10101, -5822, 5188, 10899, 17550, 20694, 24339, 30349, 27561, 24246, 26618, 23568, 14376, 8842, 2438, 5880, 8263, 716, 470, 1090, 5952, 8990, 9358, 10923, 11515, 19572, 16879, 18336, 14326, 10242, 5588, 37, 4510, 1812, -2134, -9052, -7967]
WANT_16000 = [0x3CC2CC0E, 0xBEA2F9E9, 0xBE81EC26, 0x3D0CF7FC, 0x38FABA2B, 0x3D820F29, 0x3D824122, 0x3D69F820, 0x3D549189, 0xBE1A5CB0, 0xBED982D9, 0xBF19FE5D, 0xBF314159, 0xBF4C2F13, 0xBF4AF2C0, 0xBF2F3CE0]


@pytest.mark.parametrize("rate, samples, want", [(22_050, AT_22050, WANT_22050), (16_000, AT_16000, WANT_16000)])
def test_resampler(rate, samples, want):
    out = A.resample(samples, rate)[: len(want)]
    assert np.abs(out - np.array(want, np.uint32).view(np.float32)).max() < 1e-6


def test_resampler_lengths():
    assert len(A.resample(np.zeros(128_000, np.int16), 16_000)) == 88_201
    assert len(A.resample(np.zeros(176_400, np.int16), 22_050)) == 88_200
    assert len(A.resample([], 16_000)) == 0
    with pytest.raises(InvalidInput):
        A.resample([], 0)


def test_windows_and_shapes():
    x = np.zeros(88_201, np.float32)
    assert len(A.windows(x, A.FINGERPRINT_WINDOW, A.FINGERPRINT_HOP)) == 7
    assert len(A.windows(x, A.MUSIC_WINDOW, A.MUSIC_HOP)) == 4
    assert len(A.windows(x[:10], A.MUSIC_WINDOW, A.MUSIC_HOP)) == 0
    pcm = np.array(deterministic_pcm(), np.float32) / 32768
    assert A.fingerprint_input(pcm).shape == (42, 512)
    with pytest.raises(InvalidInput):
        A.music_input(pcm)


def test_spectra_against_sums():
    """Magnitudes of a frame by the definition of the transform."""
    pcm = np.array(deterministic_pcm(A.MUSIC_WINDOW), np.float32) / 32768
    for got, size, step, frame, first in ((A.fingerprint_input(pcm[: A.FINGERPRINT_WINDOW]), A.FINGERPRINT_FFT, A.FINGERPRINT_STEP, 5, 1), (A.music_input(pcm), A.MUSIC_FFT, A.MUSIC_STEP, 200, 0)):
        n = np.arange(size)
        part = pcm[frame * step : frame * step + size] * (0.54 - 0.46 * np.cos(2 * np.pi * n / size))
        want = [abs(sum(part * np.exp(-2j * np.pi * k * n / size))) for k in range(first, size // 2 + 1)]
        assert np.allclose(got[frame], want, atol=1e-3)


def test_convolution_against_loops():
    r = np.random.default_rng(1)
    for kh, kw, sh, sw in [(1, 4, 1, 2), (4, 1, 2, 1), (3, 3, 1, 1)]:
        x, k = r.normal(size=(5, 7, 2)).astype("f"), r.normal(size=(kh, kw, 2, 3)).astype("f")
        got = A.convolve(x, k, (sh, sw))
        h, w = -(-5 // sh), -(-7 // sw)
        top, left = max((h - 1) * sh + kh - 5, 0) // 2, max((w - 1) * sw + kw - 7, 0) // 2
        want = np.zeros((h, w, 3))
        for y in range(h):
            for z in range(w):
                for i in range(kh):
                    for j in range(kw):
                        a, b = y * sh + i - top, z * sw + j - left
                        if 0 <= a < 5 and 0 <= b < 7:
                            want[y, z] += x[a, b] @ k[i, j]
        assert np.allclose(got, want, atol=1e-5)


def test_networks():
    e = A.Embedder.generated()
    assert e.parameters() == 887_712
    v = e.infer(A.fingerprint_input(np.array(deterministic_pcm(), np.float32) / 32768))
    assert v.shape == (96,) and abs(float((v * v).sum()) - 1) < 1e-5
    raw = b"".join(np.asarray(a, "<f4").tobytes() for k, s, b in zip(e.kernels, e.scales, e.biases) for a in (k, s, b)) + b"".join(np.asarray(a, "<f4").tobytes() for a in (e.head_kernel, e.head_scale, e.head_bias, e.output_kernel, e.output_bias))
    assert np.allclose(A.Embedder.from_floats(raw).infer(np.ones((42, 512))), e.infer(np.ones((42, 512))))
    with pytest.raises(InvalidInput):
        A.Embedder.from_floats(raw[:-4])
    assert 0 < A.Detector.generated().infer(np.abs(np.random.default_rng(1).normal(size=(214, 257)))) < 1


def test_chain(spark):
    r = np.random.default_rng(3)
    pcm = [(i, 16_000, [int(x) for x in r.integers(-9000, 9000, 100_000 if i < 2 else 20_000)]) for i in range(3)]
    captures = spark.createDataFrame(pcm, "capture_id bigint, sample_rate int, samples array<int>")
    detector, embedder = A.Detector.generated(), A.Embedder.generated()
    floats = O.resample(captures)
    q = O.embeddings(floats, embedder).collect()
    assert sorted((x["capture_id"], x["qi"]) for x in q) == [(i, j) for i in range(2) for j in range(5)]
    vectors = spark.createDataFrame([(n, x["q"], x["capture_id"]) for n, x in enumerate(sorted(q, key=lambda x: (x["capture_id"], x["qi"])))], "vec_id bigint, embedding array<float>, label int")
    index = VectorIndex.from_embeddings(vectors, Settings(subspaces=12, words=10, partitions=4, probes=4))
    out = {x["capture_id"]: x for x in O.recognize_pcm(captures, index, detector, embedder, threshold=0.0).collect()}
    assert set(out) == {0, 1} and all(out[i]["track_id"] == i and out[i]["offset"] == 0 for i in out)
    ranked = O.search_pcm(captures, index, embedder).where("rank = 1").collect()
    assert {x["capture_id"]: (x["track_id"], x["offset"]) for x in ranked} == {0: (0, 0), 1: (1, 0)}
