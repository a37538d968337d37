"""Operator 8: document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import small_batches, table, text_first
from .toxicity import held_out, sample

#: Labelled documents that are learnt from, at most, and the longest of them.
SAMPLE, SAMPLE_CHARS = 2400, 12_000
#: Numbers that stand for a byte, bytes that a filter spans, bytes between two places of it, filters.
WIDE, SPAN, STRIDE, FILTERS = 4, 8, 2, 24
#: Bytes of a chunk, and those that it shares with the next one.
CHUNK, SHARED = 512, 32
#: Chunks that are computed at once.
AT_ONCE = 512
THRESHOLD = 0.3

_STEP = CHUNK - SHARED
_PLACES = (CHUNK - SPAN) // STRIDE + 1


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each chunk of the texts ``data[offsets[i]:offsets[i + 1]]`` and the text it belongs to; an empty text has none.

    Chunks of a text overlap by ``SHARED`` bytes and cover it to the end."""
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - SHARED) // _STEP)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[owner] + nth * _STEP, owner


def _grid(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of each chunk plus one, and zeros past the text's end."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int32) + 1, 0)


class Network:
    """Bytes to numbers, filters over them, the largest answer of each filter in a chunk; a document's mean and largest of those
    answers make one probability. All parameters are learnt."""

    def __init__(self, rng: np.random.Generator):
        self.bytes = (rng.normal(size=(257, WIDE)) * 0.5).astype(np.float32)
        self.bytes[0] = 0
        self.filters = (rng.normal(size=(SPAN * WIDE, FILTERS)) / np.sqrt(SPAN * WIDE)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.normal(size=2 * FILTERS) * 0.1).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def _patches(self, grid: np.ndarray) -> np.ndarray:
        x = self.bytes[grid].reshape(len(grid), CHUNK * WIDE)
        return np.lib.stride_tricks.as_strided(x, (len(grid), _PLACES, SPAN * WIDE), (x.strides[0], STRIDE * WIDE * 4, 4))

    def answers(self, grid: np.ndarray, where: bool = False):
        """The largest answer of each filter in each chunk, and its place if asked for."""
        got = (self._patches(grid).reshape(-1, SPAN * WIDE) @ self.filters).reshape(len(grid), _PLACES, FILTERS)
        top = got.max(1) + self.bias
        return (np.maximum(top, 0), got.argmax(1)) if where else np.maximum(top, 0)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        starts, owner = chunks(data, offsets)
        n = len(offsets) - 1
        sums, most, count = np.zeros((n, FILTERS), np.float64), np.zeros((n, FILTERS), np.float32), np.bincount(owner, minlength=n)
        for at in range(0, len(starts), AT_ONCE):
            o = owner[at : at + AT_ONCE]
            got = self.answers(_grid(data, starts[at : at + AT_ONCE], offsets[o + 1]))
            first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            sums[o[first]] += np.add.reduceat(got, first, axis=0)
            most[o[first]] = np.maximum(most[o[first]], np.maximum.reduceat(got, first, axis=0))
        mean = sums / np.maximum(count, 1)[:, None]
        z = np.hstack([mean, most]) @ self.out.astype(np.float64) + float(self.shift[0])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def _step(self, data, offsets, y):
        """Gradients of the log loss of some documents."""
        starts, owner = chunks(data, offsets)
        n, count = len(y), np.maximum(np.bincount(owner, minlength=len(y)), 1)
        grid = _grid(data, starts, offsets[owner + 1])
        parts = [self.answers(grid[i : i + AT_ONCE], True) for i in range(0, len(grid), AT_ONCE)]
        top, place = (np.concatenate(x) for x in zip(*parts))
        mean, most = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
        np.add.at(mean, owner, top)
        mean /= count[:, None]
        np.maximum.at(most, owner, top)
        doc = np.hstack([mean, most])
        p = 1 / (1 + np.exp(-np.clip(doc @ self.out + self.shift, -30, 30)))
        err = (p - y) / n
        d_doc = err[:, None] * self.out
        # the mean hands its part to every chunk, the largest only to chunks that have it
        d_top = d_doc[owner, :FILTERS] / count[owner, None] + d_doc[owner, FILTERS:] * (top == most[owner])
        d_top *= top > 0
        chunk, f = np.nonzero(d_top)
        g, at = d_top[chunk, f], place[chunk, f] * STRIDE
        symbols = grid[chunk[:, None], at[:, None] + np.arange(SPAN)]
        patch = self.bytes[symbols].reshape(len(g), SPAN * WIDE)
        d_filters = np.zeros((FILTERS, SPAN * WIDE), np.float32)
        np.add.at(d_filters, f, g[:, None] * patch)
        d_bytes = np.zeros_like(self.bytes)
        np.add.at(d_bytes, symbols.ravel(), (g[:, None] * self.filters.T[f]).reshape(-1, WIDE))
        d_bytes[0] = 0
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        return loss, [d_bytes, d_filters.T, d_top.sum(0), doc.T @ err + 1e-4 * self.out, err.sum(keepdims=True)]

    def fit(self, texts: list[bytes], labels: list[int], rng: np.random.Generator, rounds: int = 14, batch: int = 48) -> "Network":
        """Adam over shuffled documents; both labels weigh what they weigh in the sample."""
        own = [self.bytes, self.filters, self.bias, self.out, self.shift]
        m, v, t = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own], 0
        y = np.array(labels, np.float32)
        for r in range(rounds):
            rate = 0.01 * (1 - r / rounds) + 0.001
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                offsets = np.concatenate([[0], np.cumsum([len(texts[k]) for k in some])])
                data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
                if not len(data):
                    continue
                t += 1
                for x, g, a, b in zip(own, self._step(data, offsets, y[some])[1], m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    x -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Network:
    """A network learnt from labelled documents; without any it is the untrained one, whose scores are about a half."""
    rng = np.random.default_rng(seed)
    return Network(rng).fit([t.encode("utf-8", "surrogatepass") for t in texts], labels, rng) if texts else Network(rng)


def _scorer(network, threshold: float):
    from .shingles import _bytes_of

    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column(0))
            score = network.value.probabilities(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    return run


def score_texts(docs: DataFrame, network: Network, threshold: float = THRESHOLD, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with score (0 to 1, higher is better) and predicted (1 from ``threshold`` on).

    The chunks cover the whole text. Null and empty texts have no chunk and get the score of no answers. Rows are judged each for
    itself, without a shuffle, so repeated rows get the same score each; very long texts are one row of many chunks. Columns of
    ``keep`` that are named like the added ones are replaced. An empty table gives an empty one.
    """
    rows = small_batches(text_first(docs, text, keep, ("score", "predicted")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(network), threshold), kept + "score double, predicted int")


def trained(spark: SparkSession, sf_dir: str) -> Network:
    return fit(*sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0, 5, SAMPLE, SAMPLE_CHARS))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted")
