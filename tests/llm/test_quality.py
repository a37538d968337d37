"""The network against a convolution written out, and its gradients against differences."""

import math

import numpy as np

from graphloom.llm import quality as q


def plain(network, text):
    """The probability of one text: every chunk, place and filter by itself."""
    tops, at = [], 0
    while text and (at == 0 or at + q.SHARED < len(text)):
        symbols = [b + 1 for b in text[at : at + q.CHUNK]]
        symbols += [0] * (q.CHUNK - len(symbols))
        wide = [network.bytes[s].astype(float) for s in symbols]
        tops.append([max(0.0, max(sum(float(wide[p + k] @ network.filters[k * q.WIDE : (k + 1) * q.WIDE, f]) for k in range(q.SPAN)) for p in range(0, q.CHUNK - q.SPAN + 1, q.STRIDE)) + float(network.bias[f])) for f in range(q.FILTERS)])
        at += q.CHUNK - q.SHARED
    mean = np.mean(tops, axis=0) if tops else np.zeros(q.FILTERS)
    most = np.max(tops, axis=0) if tops else np.zeros(q.FILTERS)
    return 1 / (1 + math.exp(-float(np.concatenate([mean, most]) @ network.out + network.shift[0])))


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_equals_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(3)
    network = q.Network(rng)
    network.bias += rng.normal(size=q.FILTERS).astype(np.float32) * 0.1
    sizes = [0, 1, 7, q.CHUNK - 1, q.CHUNK, q.CHUNK + 1, q.CHUNK - q.SHARED, 2 * q.CHUNK - q.SHARED + 1, 0, 1300]
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in sizes]
    want = [plain(network, t) for t in texts]
    for at_once in (3, 512):
        monkeypatch.setattr(q, "AT_ONCE", at_once)
        assert np.allclose(network.probabilities(*joined(texts)), want, atol=1e-5)
    assert np.allclose(network.probabilities(*joined(texts[::-1])), want[::-1], atol=1e-5)


def test_gradients_are_differences():
    rng = np.random.default_rng(4)
    network = q.Network(rng)
    network.bias += 0.05
    texts, y = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (40, 600, 3)], np.array([1, 0, 1], np.float32)
    data, offsets = joined(texts)
    _, slopes = network._step(data, offsets, y)
    for name, slope in zip(("bytes", "filters", "bias", "out", "shift"), slopes):
        own = getattr(network, name)
        for at in rng.integers(0, own.size, 8):
            place = np.unravel_index(at, own.shape)
            if name == "bytes" and place[0] == 0:
                continue
            losses = []
            for step in (2e-3, -2e-3):
                own[place] += step
                losses.append(network._step(data, offsets, y)[0])
                own[place] -= step
            extra = 1e-4 * own[place] if name == "out" else 0  # of the weights' size
            assert abs((losses[0] - losses[1]) / 4e-3 + extra - slope[place]) < 5e-3, name
