"""Operator 2: toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

A sentence is judged by its spans: its words, and runs of neighbouring fragments read as one word. Two spans' inner product sums,
over all subsequences of four letters that occur in both, the product of their decays; one that spreads over more letters weighs
less, over more than ``WINDOW`` nothing. So letters put into a word, or dropped from it, lower the product but do not zero it. The
kernel is the third power of its cosine. Landmarks are spans of labelled sentences, toxic ones and clean ones alike to them. A
document's score is a logistic function of the margins of its sentences' spans: the largest, the number of toxic ones, and their
part of all.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import give_back, make_room, small_batches, table, text_first

#: Labelled documents that are learnt from, at most (those with the smallest hashes of their ids), and the longest of them.
SAMPLE, SAMPLE_CHARS = 4000, 20_000
#: Spans that are looked at as landmarks, and landmarks from toxic and from other sentences, at most.
CANDIDATES, LANDMARKS = 256, (96, 64)
#: Cosine from which two spans count as alike, and under which a span's kernel counts as nothing.
ALIKE, FAR = 0.5, 0.3
#: The kernel is this power of the cosine.
POWER = 3
#: Clean spans that the machine is fitted against, at most: the hardest ones.
AGAINST = 4000
#: Letters that a subsequence may spread over, and the weight of each.
WINDOW, DECAY = 6, 0.9
#: Letters of a span that are compared at once; a longer span is compared in overlapping pieces.
PIECE = 26
#: Letters of a fragment, at most: neighbouring fragments that are no common words are also read as one word.
FRAGMENT = 4
#: Scores that a worker keeps, at most.
CACHE = 400_000

# Letters: 0 nothing, 1 marks, which are dropped, 2 start, 3 end, 4 to 29 a to z, from 30 on letters of other scripts, several to
# one code, from 44 on accents, which follow their letter.
_LETTERS = 48
_PLACES = 1 << 17
#: Characters that are read as the letters they look like.
_LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}


def _folds() -> tuple[np.ndarray, np.ndarray]:
    """The letter of each character of the basic plane, without case, and its accent."""
    out, accent = np.ones(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    for c in range(0x20, 1 << 16):
        if 0xD800 <= c < 0xE000 or 0x4E00 <= c < 0xD7A4:
            continue
        apart = unicodedata.normalize("NFKD", _LOOKALIKES.get(chr(c), chr(c)))
        base = apart[0].lower()[0]
        if "a" <= base <= "z":
            out[c] = 4 + ord(base) - 97
            if len(apart) > 1 and unicodedata.combining(apart[1]):
                accent[c] = 44 + ord(apart[1]) % (_LETTERS - 44)
        elif base.isalpha():
            out[c] = 30 + ord(base) % 14
    wide = np.arange(0x4E00, 0xD7A4)
    out[wide] = 30 + wide % 14
    return out, accent


_TABLE, _ACCENT = _folds()
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str | None) -> list[str]:
    """The text's words between white space, lower-cased, without marks at their ends; words of marks only are left out."""
    return [w for w in (x if x.isalnum() else _EDGE.sub("", x) for x in (text or "").lower().split()) if w]


def fragments(found: list[str], common: frozenset) -> list[str]:
    """Neighbouring words read as one: three single letters or more, and two to four words that are short and not common ones,
    at least one of them of at most ``FRAGMENT`` letters. Single letters in a row count as one word there."""
    most = FRAGMENT + 2
    short = [i for i, w in enumerate(found) if len(w) <= most and (w not in common or len(w) == 1)]
    out, at, n = [], 0, len(short)
    while at < n:
        to = at + 1  # a stretch of neighbours
        while to < n and short[to] == short[to - 1] + 1:
            to += 1
        if to - at > 1:
            out += _joined(found[short[at] : short[to - 1] + 1], common)
        at = to
    return out


def _joined(stretch: list[str], common: frozenset) -> list[str]:
    out, some, row = [], [], []
    for w in [*stretch, ""]:
        if len(w) == 1:
            row.append(w)
            continue
        if len(row) > 2:
            out.append("".join(row))
            some.append((out[-1], True))
        else:
            some += [(x, x not in common) for x in row]
        row = []
        if w:
            some.append((w, len(w) <= FRAGMENT))
    for at, (w, loose) in enumerate(some):
        if len(w) == 1 and not loose:
            continue
        for nxt, also in some[at + 1 : at + 4]:
            if len(w) > PIECE or (len(nxt) == 1 and not also):
                break
            w, loose = w + nxt, loose or also
            if loose:
                out.append(w)
    return out


def spans(text: str | None, common: frozenset = frozenset()) -> list[str]:
    """The words of a text and its runs of fragments, as often as they occur."""
    found = words(text)
    return found + fragments(found, common)


def _coded(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the spans' pieces, one row each, and the span that each piece belongs to."""
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    raw = np.frombuffer("".join(some).encode("utf-32-le", "replace"), np.uint32)
    raw = np.minimum(raw, 0xFFFF)
    codes, owner = _TABLE[raw], np.repeat(np.arange(len(some)), sizes)
    accent = _ACCENT[raw]
    if accent.any():
        codes, owner = np.stack([codes, accent], axis=1).ravel(), np.repeat(owner, 2)
    keep = codes > 1
    codes, owner = codes[keep], owner[keep]
    # start, letters, end of each span, one after the other
    sizes = np.bincount(owner, minlength=len(some)) + 2
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(some) else 0, dtype=np.uint8)
    flat[ends - sizes], flat[ends - 1] = 2, 3
    flat[np.arange(len(codes)) + 2 * owner + 1] = codes
    half = PIECE // 2
    pieces = np.maximum(1, -(-(sizes - half) // half))
    of = np.repeat(np.arange(len(some)), pieces)
    begin = (ends - sizes)[of] + half * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    length = np.minimum(PIECE, ends[of] - begin)
    width = int(length.max(initial=0)) + WINDOW
    at = np.arange(width)
    inside = at < length[:, None]
    out = np.where(inside, flat[np.minimum(begin[:, None] + at, max(0, len(flat) - 1))] if len(flat) else 0, 0).astype(np.uint8)
    return out, of


_STEPS = [(a, b, c) for c in range(3, WINDOW) for b in range(2, c) for a in range(1, b)]


_WEIGHT = np.array([DECAY ** (c + 1) for _, _, c in _STEPS], dtype=np.float32)


def _scales() -> np.ndarray:
    """By number of letters: the norm of a span whose subsequences are all different, the least that it can be."""
    out = np.ones(PIECE + 1)
    for n in range(4, PIECE + 1):
        out[n] = np.sqrt(sum(max(0, n - c) * DECAY ** (2 * (c + 1)) for _, _, c in _STEPS))
    return out


_SCALE = _scales().astype(np.float32)


def _runs(coded: np.ndarray):
    """Places of subsequences by row, for each way to spread one. Place 0 is for those past a row's end."""
    c = coded.astype(np.int64)
    width = c.shape[1] - WINDOW
    code = [c * k for k in (1, _LETTERS + 1, (_LETTERS + 1) ** 2, (_LETTERS + 1) ** 3)]
    for i, j, k in _STEPS:
        at = code[3][:, :width] + code[2][:, i : i + width] + code[1][:, j : j + width] + code[0][:, k : k + width]
        yield ((at * 0x9E3779B1 >> 13) % (_PLACES - 1) + 1) * (c[:, k : k + width] > 0)


def _exact(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights by row, each place once with the sum of its weights, divided by the row's norm."""
    ids = list(_runs(coded))
    weight = np.repeat(_WEIGHT, ids[0].shape[1])
    ids = np.concatenate(ids, axis=1)
    order = np.argsort(ids, axis=1)
    ids, w = np.take_along_axis(ids, order, 1), weight[order]
    w[ids == 0] = 0
    total = np.cumsum(w, axis=1, dtype=np.float64)
    last = np.ones(ids.shape, dtype=bool)
    last[:, :-1] = ids[:, 1:] != ids[:, :-1]
    # the sum of a place's weights stands at its last occurrence
    upto = np.where(last, total, 0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(ids), 1)), upto[:, :-1]], axis=1), axis=1)
    w = np.where(last, total - before, 0)
    w[ids == 0] = 0
    return ids, (w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


class Landmarks:
    """Spans that others are compared with: their weights by place, and the largest weight of each place in any of them."""

    def __init__(self, some: list[str]):
        coded, owner = _coded(some)
        ids, w = _exact(coded[np.concatenate([[True], owner[1:] != owner[:-1]])] if len(owner) else coded)
        used = np.unique(ids[w > 0])
        self.slot = np.zeros(_PLACES, dtype=np.int32)
        self.slot[used] = np.arange(1, len(used) + 1)
        self.by_slot = np.zeros((len(used) + 1, len(some)), dtype=np.float32)
        np.add.at(self.by_slot, (self.slot[ids], np.arange(len(some))[:, None]), w)
        self.by_slot[0] = 0
        self.most = np.zeros(_PLACES, dtype=np.float32)
        self.most[used] = self.by_slot[1:].max(1)

    def cosines(self, some: list[str], least: float = FAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces that may have a cosine of ``least`` with a landmark: their spans, their cosines with each landmark, and the
        number of pieces. A piece whose subsequences' largest weights sum to less than that cannot."""
        if not some:
            return np.zeros(0, np.int64), np.zeros((0, self.by_slot.shape[1]), np.float32)
        coded, owner = _coded(some)
        bound = np.zeros(len(coded), dtype=np.float32)
        for w, ids in zip(_WEIGHT, _runs(coded)):
            bound += w * self.most[ids].sum(1)
        near = np.flatnonzero(bound >= least * _SCALE[np.minimum((coded > 0).sum(1), PIECE)])
        out = np.zeros((len(near), self.by_slot.shape[1]), dtype=np.float32)
        for at in range(0, len(near), 512):
            part = coded[near[at : at + 512]]
            part = part[:, : int((part > 0).sum(1).max()) + WINDOW]
            ids, w = _exact(part)
            slot = self.slot[ids]
            row, col = np.nonzero((slot > 0) & (w > 0))
            values = self.by_slot[slot[row, col]] * w[row, col][:, None]
            starts = np.searchsorted(row, np.arange(len(part)))
            full = np.flatnonzero(np.diff(np.append(starts, len(row))))
            if len(full):
                out[at + full] = np.add.reduceat(values, starts[full], axis=0)
        return owner[near], out


def evidence(margins: np.ndarray) -> np.ndarray:
    """What a document is judged by: its largest margin, the logarithm of its toxic spans, and their part of all its spans."""
    if not len(margins):
        return np.array([-1.0, 0.0, 0.0])
    hits = float(np.clip(margins, 0, 1).sum())
    return np.array([np.clip(margins.max(), -1, 1), np.log1p(hits), min(1.0, 20 * hits / (len(margins) + 10))])


class Machine:
    """The fitted machine: landmarks with their weights, a bias, the common short words, and the weights of a document's evidence."""

    def __init__(self, landmarks: Landmarks | None, alpha: np.ndarray, bias: float, weights: np.ndarray, common: frozenset = frozenset()):
        self.landmarks, self.alpha, self.bias, self.weights, self.common = landmarks, np.asarray(alpha, np.float32), bias, np.asarray(weights, float), common

    def margins(self, some: list[str]) -> np.ndarray:
        """The margin of each span, the largest of its pieces."""
        out = np.zeros(len(some), dtype=np.float32)
        if self.landmarks is None:
            return out
        order = sorted(range(len(some)), key=lambda i: len(some[i]))  # rows of a block are as wide as its longest span
        out[:] = self.bias
        for at in range(0, len(some), 4096):
            part = np.array(order[at : at + 4096])
            owner, cosines = self.landmarks.cosines([some[i] for i in part])
            np.maximum.at(out, part[owner], self.bias + kernel(cosines) @ self.alpha)
        return out

    def probability(self, margins: np.ndarray) -> float:
        """The probability that a document with spans of these margins is toxic."""
        z = self.weights[0] + evidence(np.asarray(margins, dtype=np.float64)) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def kernel(cosines: np.ndarray) -> np.ndarray:
    return np.maximum(cosines, 0) ** POWER


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 1000, ridge: float = 5e-5) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Nesterov's method; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    step = 1 / (2 * (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2) + ridge)
    w = z = np.zeros(x.shape[1])
    for t in range(rounds):
        short = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (-2 * x.T @ (weight * y * short) + ridge * z)
        z, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _disguised(span: str, rng) -> list[str]:
    """The span with one letter put into it, with two, with a letter doubled, with one left out."""
    if len(span) < 4:
        return []
    letter = lambda: chr(97 + rng.integers(26))
    a, b, c, d, e = rng.integers(1, len(span), 5)
    once = span[:a] + letter() + span[a:]
    return [once, span[:e] + letter() + letter() + span[e:], span[:b] + span[b - 1] + span[b:], span[: c - 1] + span[c:] if len(span) > 5 else once, once[:d] + letter() + once[d:]]


def _toxic_landmarks(named: list[str], toxic: np.ndarray, clean: np.ndarray, in_toxic: np.ndarray, in_clean: np.ndarray, total: tuple) -> list[int]:
    """Places in ``named`` of the spans that, alone or with those alike to them, are far more frequent in toxic documents.
    ``toxic`` and ``clean`` count each span's occurrences, ``in_toxic`` and ``in_clean`` its documents."""
    n1, n0, w1, w0 = total
    lift = in_toxic / n1 - 3 * in_clean / n0 - 2 / n1
    candidates = [int(i) for i in np.argsort(-lift, kind="stable")[:CANDIDATES] if lift[i] > 0 and len(named[i]) > 2]
    if not candidates:
        return []
    marks = Landmarks([named[i] for i in candidates])
    around1, around0 = np.zeros(len(candidates)), np.zeros(len(candidates))
    for at in range(0, len(named), 4096):
        owner, cosines = marks.cosines(named[at : at + 4096], ALIKE)
        around1 += toxic[at + owner] @ (cosines >= ALIKE)
        around0 += clean[at + owner] @ (cosines >= ALIKE)

    def surprise(k1, k0):  # in standard deviations over three times the clean rate
        expected = (k0 + 0.5) * w1 / w0
        return (k1 - 3 * expected) / np.sqrt(k1 + 9 * expected)

    best = np.maximum(surprise(around1, around0), surprise(toxic[candidates], clean[candidates]))
    return [candidates[j] for j in np.argsort(-best, kind="stable").tolist() if best[j] >= 3][: LANDMARKS[0]]


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Machine:
    """Learn from labelled documents, each a bag of sentences of which at least one is toxic if the document is.

    The landmarks are spans that are frequent in toxic sentences, and the spans of other sentences that are most alike to them.
    The machine is fitted on all spans of toxic sentences that are alike to the former, and disguised forms of them, against
    spans of the others. The documents' evidence is then weighed by logistic regression. Without both labels every score is
    the share of toxic ones.
    """
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return _without(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    found = [words(t) for t in texts]
    seen: dict[str, int] = {}
    for bag, label in zip(found, y):
        if not label:
            for w in set(bag):
                seen[w] = seen.get(w, 0) + 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    common = frozenset(w for w, k in seen.items() if len(w) <= FRAGMENT + 2 and k >= max(3, n0 // 50))
    bags = [bag + fragments(bag, common) for bag in found]
    named = sorted({s for bag in bags for s in bag})
    place = {s: i for i, s in enumerate(named)}
    places = [np.array([place[s] for s in bag], dtype=np.int64) for bag in bags]
    counts = np.zeros((2, len(named)))
    within = np.zeros((2, len(named)))
    for at, label in zip(places, y):
        np.add.at(counts[label], at, 1.0)
        within[label][np.unique(at)] += 1
    total = (n1, n0, max(1.0, counts[1].sum()), max(1.0, counts[0].sum()))
    likely = _toxic_landmarks(named, counts[1], counts[0], within[1], within[0], total)
    if not likely:
        return _without(float(y.mean()))

    # how alike every span is to a toxic landmark
    marks = Landmarks([named[i] for i in likely])
    top = np.zeros(len(named), dtype=np.float32)
    for at in range(0, len(named), 4096):
        owner, cosines = marks.cosines(named[at : at + 4096])
        np.maximum.at(top, at + owner, cosines.max(1, initial=0))
    # of the spans alike to a landmark, those that are not far more frequent in toxic documents are clean
    much = counts[1] / total[2] > 3 * (counts[0] + 0.1) / total[3]
    good = np.flatnonzero(much & (top >= ALIKE + 0.1) & (counts[1] > 0))
    clean = np.flatnonzero((within[0] > 0) & ~much)
    hardest = clean[np.argsort(-top[clean] - 0.02 * np.log1p(within[0][clean]), kind="stable")]
    landmarks = [named[i] for i in [*likely, *hardest[: LANDMARKS[1]].tolist()]]
    landmarks += [v for i in likely if within[1][i] >= 0.1 * n1 for v in _disguised(named[i], rng)][: LANDMARKS[1]]
    landmarks = list(dict.fromkeys(landmarks))
    marks = Landmarks(landmarks)

    def kernels(some):
        out = np.zeros((len(some), marks.by_slot.shape[1]), dtype=np.float32)
        for at in range(0, len(some), 4096):
            owner, cosines = marks.cosines(some[at : at + 4096])
            np.maximum.at(out, at + owner, kernel(cosines))
        return out.astype(np.float64)

    values, vectors = np.linalg.eigh(kernels(landmarks))
    keep = values > 1e-4 * values.max()
    project = vectors[:, keep] / np.sqrt(values[keep])  # Nystroem: the landmarks' kernel to the power -1/2

    chosen = [named[i] for i in good]
    # each toxic document's weight is dealt out to its spans
    share = np.full(len(named), 1e-3)
    is_good = np.zeros(len(named), dtype=bool)
    is_good[good] = True
    for at, label in zip(places, y):
        own = np.unique(at[is_good[at]]) if label else at[:0]
        share[own] += 1 / max(1, len(own))
    masked = [(v, share[i]) for i in good for v in _disguised(named[i], rng) + _disguised(named[i], rng) if v not in seen]
    masked_share = np.array([w for _, w in masked])
    masked = [v for v, _ in masked]
    share = share[good]
    against = np.unique(np.concatenate([hardest[: AGAINST // 2], rng.choice(clean, min(len(clean), AGAINST // 2), replace=False)])) if len(clean) else clean
    # a span that clean documents hold too is on both sides, so that its margin tells how sure it is
    both = good[counts[0][good] > 0]
    doubt = share[counts[0][good] > 0] * np.minimum(4, 2 * counts[0][both] / counts[1][both])
    light = 1 + np.log1p(within[0][against])
    x = np.concatenate([kernels(chosen), kernels(masked), kernels([named[i] for i in both]), kernels([named[i] for i in against])]) @ project
    sign = np.concatenate([np.ones(len(chosen) + len(masked)), -np.ones(len(both) + len(against))])
    weight = np.concatenate([share / share.sum(), 0.6 * masked_share / max(1e-9, masked_share.sum()), doubt / share.sum(), 1.5 * light / max(1e-9, light.sum())])
    w, bias = _svm(x, sign, weight)
    machine = Machine(marks, project @ w, bias, np.zeros(4), common)
    margins = machine.margins(named).astype(np.float64)
    # one toxic span makes a document toxic: each toxic document's worst span is also put into a clean document
    worst = [margins[at].max() for at, label in zip(places, y) if label and len(at)]
    hosts = [at for at, label in zip(places, y) if not label]
    mixed = [evidence(np.append(margins[hosts[i]], m)) for i, m in zip(rng.integers(0, len(hosts), len(worst)), worst)]
    facts = np.array([evidence(margins[at]) for at in places] + mixed)
    return Machine(marks, machine.alpha, bias, _logistic(facts, np.append(y, np.ones(len(mixed))), np.append(np.ones(len(y)), np.full(len(mixed), 0.5))), common)


def _without(share: float) -> Machine:
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    return Machine(None, np.zeros(0), 0.0, np.array([bias, 0, 0, 0]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Bias and weights of a logistic regression by Newton's method; no weight is negative, as more evidence is never less toxic."""
    use, out = list(range(x.shape[1])), np.zeros(x.shape[1] + 1)
    while True:
        z = np.hstack([np.ones((len(x), 1)), x[:, use]])
        w = np.zeros(z.shape[1])
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (weight * (p - y)) + ridge * w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + (ridge + 1e-6) * np.eye(len(w))
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if not use or w[1:].min(initial=0) >= 0:
            out[0], out[1:][use] = w[0], w[1:]
            return out
        use.remove(use[int(np.argmin(w[1:]))])


def _scorer(machine, threshold: float):
    def run(batches):
        make_room()
        m, kept = machine.value, {}
        get = kept.__getitem__
        for batch in batches:
            score = []
            for at in range(0, batch.num_rows, 256):
                bags = [spans(t, m.common) for t in batch.column(0).slice(at, 256).to_pylist()]
                new = set().union(*bags).difference(kept) if bags else set()
                if len(kept) + len(new) > CACHE:
                    kept.clear()
                    new = set().union(*bags)
                fresh = list(new)
                kept.update(zip(fresh, m.margins(fresh).tolist()) if fresh else ())
                score += [m.probability(np.fromiter(map(get, b), np.float64, len(b))) for b in bags]
            score = np.array(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])
        kept.clear()
        give_back()

    return run


def score_texts(docs: DataFrame, machine: Machine, threshold: float, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each row with score (0 to 1) and predicted (1 from ``threshold`` on).

    The whole text is scored. Null and empty texts have no spans and get the score of a document without evidence. Rows are
    judged each for itself, without a shuffle, so repeated rows get the same score each; very long texts are one row. Columns of
    ``keep`` that are named like the added ones are replaced. An empty table gives an empty one.
    """
    rows = small_batches(text_first(docs, text, keep, ("score", "predicted")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return rows.mapInArrow(_scorer(shared, threshold), kept + "score double, predicted int")


def held_out(fold: int, folds: int) -> F.Column:
    """Whether the crc32 of the id's text leaves the remainder ``fold``; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of the labelled documents that are not held out: at most ``most``, by hash of the id, none over ``chars``.

    Labels other than 0 and 1 are ignored; of several labels of a document the largest counts. Only this sample reaches the driver.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(fold, folds)).groupBy("doc_id").agg(F.max(label).alias("y"))
    # the smallest hashes of the ids are chosen before any text moves
    some = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter(F.length("text") <= chars)
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return [r.text for r in rows], [int(r.y) for r in rows]


def trained(spark: SparkSession, sf_dir: str) -> Machine:
    return fit(*sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 1, 3))


THRESHOLD = 0.7


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, trained(spark, sf_dir), THRESHOLD)
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", "predicted")
