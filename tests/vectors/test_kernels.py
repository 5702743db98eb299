import numpy as np
import pytest

from tessella.functions import integers
from tessella.functions import kernels as K

R = np.random.default_rng(0)


@pytest.mark.parametrize("dim", [63, 64, 65, 100, 128, 192, 1000])
@pytest.mark.parametrize("kind", ["fht", "matrix"])
def test_rotation_keeps_products_and_pads(dim, kind):
    rotation = K.Rotation(dim, kind)
    assert rotation.size % 64 == 0 and dim <= rotation.size < dim + 64
    x = R.normal(size=(6, dim))
    y = rotation(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.array_equal(y, K.Rotation(dim, kind)(x))
    assert not np.allclose(y, K.Rotation(dim, kind, seed=7)(x))


def test_rotation_limits():
    for dim in (4096, 5000):
        with pytest.raises(ValueError):
            K.Rotation(dim)
    K.Rotation(4095 - 63)
    with pytest.raises(ValueError):
        K.Rotation(64, size=100)
    with pytest.raises(ValueError):
        K.Rotation(64)(np.zeros((2, 65)))


def test_hadamard_entries_and_flips():
    h = K.hadamard(np.eye(64))
    assert np.array_equal(h, [[(-1) ** (i & j).bit_count() for j in range(64)] for i in range(64)])
    x = np.arange(1.0, 129)[None]
    y = K.flip(x, 42, 0)
    assert np.array_equal(np.abs(y), x) and 30 < (y < 0).sum() < 98
    assert np.allclose(K.kac_step(K.kac_step(x)), 2 * x)


def brute_scale(a, ex):
    """The best of very many scales, by the cosine of the rounded direction."""
    best = 0.0
    for t in np.linspace(0.01, ((1 << ex) + 9) / a.max(), 4000):
        u = np.minimum(np.floor(t * a + 1e-5), (1 << ex) - 1) + 0.5
        best = max(best, (u @ a) / np.sqrt(u @ u))
    return best


@pytest.mark.parametrize("ex", [2, 3, 5])
def test_best_scale_is_best(ex):
    for _ in range(5):
        a = np.abs(R.normal(size=64))
        a /= np.linalg.norm(a)
        u = np.minimum(np.floor(K.best_scale(a, ex) * a + 1e-5), (1 << ex) - 1) + 0.5
        assert (u @ a) / np.sqrt(u @ u) >= brute_scale(a, ex) - 0.01


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("fast", [True, False])
def test_estimates_near_and_bounded(metric, fast):
    x = R.normal(size=(300, 64))
    c, q = x.mean(0), R.normal(size=64)
    true = ((x - q) ** 2).sum(1) if metric == "l2" else 1 - x @ q
    errors = []
    for bits in range(1, 10):
        codes = K.encode(x, c, bits, metric, fast)
        est, low, full, full_low = K.estimates(codes, q, *K.centre_terms(q, c, metric))
        errors.append(np.abs(full - true).mean())
        assert (low <= true + 1e-9).mean() > 0.9 and (full_low <= true + 1e-9).mean() > 0.8
    assert all(a > b for a, b in zip(errors, errors[1:])) and errors[-1] < 0.05 * errors[0]


def test_one_formula_for_both_factors():
    r, c = R.normal(size=(20, 64)), R.normal(size=64)
    sign, (code, inverse) = K.one_bit(r, True), K.magnitudes(r, 4)
    f = K.factors(r, np.broadcast_to(c, r.shape), K.decoded(sign, code, 4), "l2")
    assert np.allclose(f["f_rescale"], -2 * np.sqrt((r * r).sum(1)) * inverse)


@pytest.mark.parametrize("metric,add", [("l2", 0.0), ("ip", 1.0)])
def test_zero_residuals_and_zero_coordinates(metric, add):
    x = np.zeros((2, 64))
    x[1, 0] = 1.0
    for bits in (1, 5):
        f = K.encode(x, np.zeros(64), bits, metric).ex
        assert f["f_add"][0] == add and f["f_rescale"][0] == 0 and f["f_error"][0] == 0
        assert all(np.isfinite(v).all() for v in f.values())


def test_scalar_modes():
    x, c = R.normal(size=(50, 128)), R.normal(size=128)
    last = np.inf
    for bits in range(1, 10):
        code, delta, vl = K.scalar_quantize(x, c, bits)
        assert code.min() >= 0 and code.max() < 1 << bits
        mse = ((code * delta[:, None] + vl[:, None] - (x - c)) ** 2).mean()
        assert mse < last
        last = mse
    code, delta, vl = K.scalar_quantize(x, c, 5, "unbiased")
    back = code * delta[:, None] + vl[:, None]
    assert np.allclose((back * (x - c)).sum(1), ((x - c) ** 2).sum(1))
    code, delta, vl = K.scalar_quantize(x, c, 5, "plain")
    assert np.allclose(((code * delta[:, None] + vl[:, None]) ** 2).sum(1), ((x - c) ** 2).sum(1))


@pytest.mark.parametrize("bits", range(1, 9))
def test_packed_codes_give_the_same_products(bits):
    q, code = R.uniform(0, 100, 768), R.integers(0, 1 << bits, (3, 768))
    packed = K.pack_codes(code, bits)
    assert all(len(p) == 768 * bits // 8 for p in packed)
    assert np.allclose(K.unpack_codes(packed, 768, bits) @ q, code @ q)


@pytest.mark.parametrize("bits,tol", [(8, 0.3), (16, 2e-3)])
def test_lookup_tables(bits, tol):
    q, sign = R.normal(size=128), R.integers(0, 2, (40, 128))
    assert np.abs(K.table_dot(sign, *K.lookup_table(q, bits)) - sign @ q).max() < tol
    assert np.allclose(K.table_dot(sign, *K.lookup_table(np.zeros(128), bits)), 0)


def test_sizes_and_integers():
    assert K.record_bytes(64, 5) == {"one": 20, "ex": 40, "block": 640, "graph_block": 512} and K.record_bytes(64, 1)["ex"] == 0
    assert [integers.padded(d) for d in (1, 64, 65, 128)] == [64, 64, 128, 128]
    assert integers.floor_log2(65) == 6 and integers.ceil_log2(65) == 7 and integers.ceil_log2(64) == 6 and integers.ceil_div(7, 2) == 4
    assert integers.is_power_of_2(64) and not integers.is_power_of_2(0) and not integers.is_power_of_2(65)
    for bits in (0, 10):
        with pytest.raises(ValueError):
            K.check_bits(bits)
