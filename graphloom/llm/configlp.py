"""The configuration program of bin packing over a histogram of lengths: multiplicative weights, knapsack pricing, rounding.

A configuration is a multiset of lengths whose sum is at most the capacity. The program asks for the least number of
configurations, fractions allowed, that cover every length as often as the histogram has it. All of it works on the histogram, so
its cost is bounded by the capacity and does not grow with the number of items.
"""

from __future__ import annotations

import numpy as np

#: Rounds of pricing, at most; what they leave uncovered is packed by best fit.
ROUNDS = 250
#: Configurations taken from one pricing, at most.
WIDTH = 24
#: How far the price of a covered length falls below that of an uncovered one, as a share of it.
RATE = 0.004
#: A step covers at most this share of what is left of any length it uses, or one bin.
STEP = 0.25
#: A configuration is used if it is worth the best one but for so many units of length.
SLACK = 1.0


def priced(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best sum of prices for each capacity from 0, and the length taken last there
    (0: none). ``price[l]`` is the price of length l, -inf where it is not to be used."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = price[1 : c + 1] + best[c - 1 :: -1] if c > 1 else price[1:2] + best[:1]
        l = int(sums.argmax())
        if sums[l] > best[c - 1]:
            best[c], last[c] = sums[l], l + 1
        else:
            best[c] = best[c - 1]
    return best, last


def configuration(last: np.ndarray, capacity: int, counts: np.ndarray) -> dict[int, int]:
    """The configuration that the table ``last`` of ``priced`` gives for a capacity, without copies that ``counts`` does not have."""
    out, c = {}, capacity
    while c > 0:
        l = int(last[c])
        if not l:
            c -= 1
            continue
        if out.get(l, 0) + 1 <= counts[l]:
            out[l] = out.get(l, 0) + 1
        c -= l
    return out


def covered(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often to use each, fractions allowed, by multiplicative weights, in the order of their first use.

    A length's weight starts at its share of the volume, the dual solution of bins without waste, and falls exponentially with the
    share of it that is covered; its price is the weight over its count. Of equally good configurations those of long items come
    first. Each round prices by one knapsack table and uses the best configurations with each of the longest lengths, once at
    least, so that a length of few items is done with in few rounds.
    """
    length, left, used = np.arange(capacity + 1), counts.astype(float), {}
    long_first = length * (1 + length / (2 * capacity * capacity))
    for _ in range(rounds):
        live = np.flatnonzero(left[1:] >= 1) + 1
        if not len(live):
            break
        price = np.full(capacity + 1, -np.inf)
        price[live] = (long_first * np.exp(-RATE * (1 - left / np.maximum(counts, 1))))[live]
        best, last = priced(price, capacity)
        took = 0
        for l in live[::-1].tolist():
            if took == WIDTH:
                break
            if left[l] < 1 or price[l] + best[capacity - l] < best[capacity] - SLACK:
                continue
            left[l] -= 1
            c = configuration(last, capacity - l, left)
            left[l] += 1
            c[l] = c.get(l, 0) + 1
            if sum(price[k] * a for k, a in c.items()) < best[capacity] - SLACK:
                continue
            took += 1
            times = max(1.0, min(STEP * left[k] / a for k, a in c.items()))
            for k, a in c.items():
                left[k] -= a * times
            key = tuple(sorted(c.items()))
            used[key] = used.get(key, 0) + times
        if not took:
            c = configuration(last, capacity, left)
            for k, a in c.items():
                left[k] -= a
            key = tuple(sorted(c.items()))
            used[key] = used.get(key, 0) + 1
    return [(dict(k), x) for k, x in used.items()]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling length, done for all bins of equal content at once."""
    open_bins: dict[int, list] = {}  # room left: [content, number of bins]
    for l in range(capacity, 0, -1):
        n = int(counts[l])
        while n:
            room = next((r for r in range(l, capacity + 1) if open_bins.get(r)), None)
            content, bins = open_bins[room].pop() if room is not None else ({}, n)
            each = (room if room is not None else capacity) // l
            full = min(bins, n // each)
            if full:
                open_bins.setdefault((room if room is not None else capacity) - each * l, []).append([content | {l: each}, full])
                n -= full * each
                bins -= full
            elif bins:
                open_bins.setdefault((room if room is not None else capacity) - n * l, []).append([content | {l: n}, 1])
                n, bins = 0, bins - 1
            if bins and room is not None:
                open_bins.setdefault(room, []).append([content, bins])
    return [(content, bins) for rooms in open_bins.values() for content, bins in rooms]


#: Shares of the solution, in the order of its rounds, of which the roundings are compared.
SHARES = (1.0, 0.95, 0.85, 0.7, 0.5, 0.3, 0.15, 0.05)


def _rounded(counts: np.ndarray, capacity: int, solution: list, share: float) -> dict[tuple, int]:
    """Whole uses of the first configurations, down and then up while their items last; best fit for all other items."""
    left, out = counts.copy(), {}
    most, kept = share * sum(x for _, x in solution), []
    for c, x in solution:
        if most <= 0:
            break
        kept.append((c, min(x, most)))
        most -= x

    def use(c, times):
        times = min([times, *(int(left[l]) // a for l, a in c.items())])
        if times > 0:
            for l, a in c.items():
                left[l] -= a * times
            k = tuple(sorted(c.items()))
            out[k] = out.get(k, 0) + times

    for c, x in kept:
        use(c, int(x))
    for c, x in kept:
        if x % 1 >= 0.5:
            use(c, 1)
    for c, n in best_fit(left, capacity):
        k = tuple(sorted(c.items()))
        out[k] = out.get(k, 0) + n
    return out


def pack(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations and whole numbers of bins that hold exactly ``counts[l]`` items of each length l from 1 to ``capacity``.

    The solution is rounded as a whole and, where that needs more bins than the volume, without its last rounds, whose choice of
    lengths was small; what is not kept goes by best fit. The rounding with the fewest bins is taken.
    """
    counts = np.asarray(counts, dtype=np.int64)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    solution, best = covered(counts, capacity, rounds), None
    for share in SHARES:
        out = _rounded(counts, capacity, solution, share)
        if best is None or sum(out.values()) < sum(best.values()):
            best = out
        if sum(best.values()) <= least:
            break
    return [(dict(k), n) for k, n in best.items()]
