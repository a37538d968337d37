"""Words of Han text: the most probable path through a dictionary's word graph, and a four-state model for what it does not know.

Dictionaries and models are tables: read from files, or counted from a corpus by ``word_counts`` and ``state_counts``. A segmenter
is made of them on the driver, within stated bounds, and goes to the executors once, as a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .names import STOP_WORDS

#: A few words, so that the segmenter works without a dictionary of one's own.
SEED_WORDS = ("北京", "上海", "中国", "天安门", "清华大学", "北京大学", "计算机", "计算机科学", "人工智能", "知识图谱", "大学", "学习", "科学", "长江", "黄河", "李白", "杜甫", "首都", "城市", "工作")
#: A dictionary of more words does not go to the executors; use its most frequent ones.
MOST_WORDS = 2_000_000
#: States of a character: begin, end and middle of a word, or a word of its own; and which may follow which, and stand last.
STATES = "BEMS"
_AFTER = {"B": "EM", "E": "BS", "M": "EM", "S": "BS"}
#: Entries of the table by which many runs are cut at once, and characters that are.
TABLE, AT_ONCE = 1 << 24, 1 << 17
#: Parts of texts, at least, that are gone through at the same time; of fewer, long ones each is gone through by itself.
TOGETHER = 24
#: Runs whose words a model keeps.
REMEMBERED = 1 << 16
#: Weight of what a model has never seen.
NEVER = -3.14e100

_RUN = re.compile(r"[一-龥]+|[A-Za-z0-9]+|[^\W_]+")


class Model:
    """Log probabilities: of the first state, of a state after another, and of a character in a state; absent ones are ``NEVER``."""

    def __init__(self, start: Mapping[str, float], follow: Mapping[tuple[str, str], float], emit: Mapping[tuple[str, str], float]):
        self.start, self.follow, self.emit = dict(start), dict(follow), dict(emit)
        self._known: dict[str, list[str]] = {}

    def states(self, run: str) -> str:
        """The most probable states of a run's characters, by Viterbi; of equally probable ones those that come first in ``STATES``."""
        here = {s: self.start.get(s, NEVER) + self.emit.get((s, run[0]), NEVER) for s in "BS"}
        back = []
        for c in run[1:]:
            ways = {s: max(((here[p] + self.follow.get((p, s), NEVER), -STATES.index(p), p) for p in here if s in _AFTER[p])) for s in STATES if any(s in _AFTER[p] for p in here)}
            here = {s: w[0] + self.emit.get((s, c), NEVER) for s, w in ways.items()}
            back.append({s: w[2] for s, w in ways.items()})
        state = max((s for s in "ES" if s in here), key=lambda s: (here[s], -STATES.index(s)))
        out = [state]
        for step in reversed(back):
            out.append(step[out[-1]])
        return "".join(reversed(out))

    def cut(self, run: str) -> list[str]:
        """The words of a run; those of short ones, which come again, are kept."""
        out = self._known.get(run)
        if out is None:
            ends = [i for i, s in enumerate(self.states(run), 1) if s in "ES"]
            out = [run[a:b] for a, b in zip([0, *ends], ends)]
            if len(run) <= 16 and len(self._known) < REMEMBERED:
                self._known[run] = out
        return out


class Segmenter:
    """Segments runs of Han characters; other runs of letters and digits are one word, and marks are dropped.

    ``words`` are words with their weights (log probabilities), or words of equal weight. A character outside the dictionary has
    the smallest weight of all. ``modes``: MIX takes the path of words whose weights sum highest, of equal ones that with the
    longest first words; DEFAULT lets the model join neighbouring single characters of that path; SEARCH adds, in front of a word of
    DEFAULT, the dictionary words of two characters (in words of more than two) and of three (of more than three) inside it; HMM
    uses the model alone. Without a model single characters stay apart, but in HMM runs of unknown characters stay together.
    """

    def __init__(self, words: Mapping[str, float] | Iterable[str] = SEED_WORDS, model: Model | None = None):
        weights = dict(words) if isinstance(words, Mapping) else dict.fromkeys(words, -1.0)
        self.weights, self.model, self.single = weights, model, set()
        self.low, self.middle = (min(weights.values()), median(weights.values())) if weights else (-1.0, -1.0)
        self.starts: set[str] = set()
        for w in weights:
            self._enter(w)

    def _enter(self, word: str) -> None:
        self.starts.update(word[:k] for k in range(1, len(word) + 1))
        self._made = None

    def add(self, word: str, weight: float | None = None) -> Segmenter:
        """A word of one's own, with the dictionary's median weight unless one is given; the model leaves it alone."""
        if word:
            self.weights[word] = self.middle if weight is None else weight
            self.single.add(word)
            self._enter(word)
        return self

    def path(self, run: str) -> list[str]:
        """The words of the best path through the word graph, found from the run's end on."""
        n = len(run)
        best, size = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            top, k = self.weights.get(run[i], self.low) + best[i + 1], 1
            for j in range(i + 2, n + 1):
                word = run[i:j]
                if word not in self.starts:
                    break
                weight = self.weights.get(word)
                if weight is not None and weight + best[j] >= top:
                    top, k = weight + best[j], j - i
            best[i], size[i] = top, k
        out, i = [], 0
        while i < n:
            out.append(run[i : i + size[i]])
            i += size[i]
        return out

    def _table(self):
        """The place of each character, what beginning of a word follows each on each character, and their weights as words; or None
        where that is too large, or weights are not whole numbers, whose sums are the same in any order."""
        if self._made is None:
            marks = {c: i for i, c in enumerate(sorted({c for w in self.weights for c in w}), 1)}
            fit = (len(self.starts) + 1) * (len(marks) + 1) <= TABLE and all(float(w).is_integer() and abs(w) < 1 << 30 for w in [self.low, *self.weights.values()])
            self._made = ()
            if fit and marks:
                node = {p: i for i, p in enumerate(self.starts, 1)} | {"": 0}
                exact = np.float32 if all(abs(w) < 1 << 24 for w in [self.low, *self.weights.values()]) else np.float64
                follow, weight = np.zeros((len(node), len(marks) + 1), np.int32), np.full(len(node), -np.inf, exact)
                for p, i in node.items():
                    if p:
                        follow[node[p[:-1]], marks[p[-1]]] = i
                        weight[i] = self.weights.get(p, -np.inf)
                place = np.zeros(max(map(ord, marks)) + 2, np.int32)
                place[[ord(c) for c in marks]] = list(marks.values())
                self._made = place, follow, weight, max(map(len, self.weights))
        return self._made or None

    def paths(self, runs: list[str]) -> Iterator[list[str]]:
        """The paths of many runs, ``path`` of each: of as many characters at once as ``AT_ONCE`` says."""
        at = 0
        while at < len(runs):
            n, to = len(runs[at]), at + 1
            while to < len(runs) and n + len(runs[to]) <= AT_ONCE:
                n, to = n + len(runs[to]), to + 1
            sizes = self._sizes(runs[at:to]) if self._table() else None
            begin = 0
            for run in runs[at:to]:
                if sizes is None:
                    yield self.path(run)
                    continue
                own, n = sizes[begin : begin + len(run)].tolist(), len(run)
                out, i = [], 0
                while i < n:
                    j = i + own[i]
                    out.append(run[i:j])
                    i = j
                begin += n + 1
                yield out
            at = to

    def _sizes(self, runs: list[str]) -> np.ndarray:
        """The length of the best path's first word from each place of the runs on, a place between each two of them. No word of the
        dictionary reaches over some places: what lies between these is gone through from its end, all at the same time."""
        place, follow, weight, longest = self._table()
        codes = np.frombuffer("\0".join([*runs, ""]).encode("utf-32-le"), np.uint32)
        marks, n = place[np.minimum(codes, len(place) - 1)], len(codes)
        here, node = np.arange(n), follow[0, marks]
        table = np.full((n, longest), -np.inf, weight.dtype)  # the longest words first: of equal sums they win
        table[:, -1] = np.where(np.isneginf(weight[node]), self.low, weight[node])
        reach, most = np.arange(1, n + 1), 1
        for k in range(1, longest):
            keep = np.flatnonzero(node[: np.searchsorted(here, n - k)])
            here = here[keep]
            if not len(here):
                break
            node = follow[node[keep], marks[here + k]]
            more = weight[node]
            known = np.flatnonzero(more > -np.inf)
            if len(known):
                found, most = here[known], k + 1
                table[found, -1 - k] = more[known]
                reach[found] = found + most
        table, far = table[:, longest - most :], np.arange(most, 0, -1)
        ends = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, n + 1)) + 1
        length = np.diff(ends, prepend=0)
        order = np.argsort(-length, kind="stable")
        ends, length = ends[order], length[order]
        alone = int(length[TOGETHER]) if len(length) > TOGETHER else 0
        active = np.searchsorted(-length, -np.arange(1, alone + 1), side="right")
        best, size = np.zeros(n + 1), np.ones(n, np.int64)
        for t, m in enumerate(active.tolist(), 1):
            p, lo = ends[:m] - t, max(0, most - t)
            after = best[p[:, None] + far[lo:]]
            if t <= most:
                after[:, 0] = 0.0
            after += table[p, lo:]
            k = after.argmax(axis=1)
            best[p], size[p] = after[np.arange(m), k], far[lo + k]
        for end, n in zip(ends[:TOGETHER].tolist(), length[:TOGETHER].tolist()):
            part = table[end - n : end - alone]
            row, word = np.nonzero(part > -np.inf)
            ways = zip(row[::-1].tolist(), (most - word)[::-1].tolist(), part[row, word][::-1].tolist())  # the shortest words first
            sums, own = [-np.inf] * (n - alone) + best[end - alone : end].tolist() + [0.0], [1] * (n - alone)
            for i, k, w in ways:
                if i + k <= n and w + sums[i + k] >= sums[i]:
                    sums[i], own[i] = w + sums[i + k], k
            size[end - n : end - alone] = own
        return size

    def _loose(self, words: Iterable[str], known: bool) -> list[str]:
        """``words`` with neighbouring single characters joined: by the model, or unknown ones whole."""
        out, held = [], ""
        for w in words:
            if len(w) == 1 and w not in self.single and not (known and w in self.weights):
                held += w
                continue
            if held:
                out += self.model.cut(held) if self.model else [held]
                held = ""
            out.append(w)
        if held:
            out += self.model.cut(held) if self.model else [held]
        return out

    def _run(self, run: str, mode: str, path: list[str] | None = None) -> list[str]:
        if mode == "HMM" and self.model:
            return self.model.cut(run)
        path = self.path(run) if path is None else path
        if mode == "HMM":
            return self._loose(path, True)
        words = path if mode == "MIX" or not self.model else self._loose(path, False)
        return list(self._search(words)) if mode == "SEARCH" else words

    def _search(self, words: Iterable[str]) -> Iterator[str]:
        for w in words:
            for k in (2, 3):
                if len(w) > k:
                    yield from (w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k] in self.weights)
            yield w

    def cut(self, text: str | None, mode: str = "DEFAULT") -> list[str]:
        """The words of a text, in order; null and empty texts have none."""
        out: list[str] = []
        for m in _RUN.finditer(text or ""):
            out.extend(self._run(m.group(), mode) if "一" <= m.group()[0] <= "龥" else [m.group()])
        return out

    def cut_all(self, texts: Iterable[str | None], mode: str = "DEFAULT") -> Iterator[list[str]]:
        """``cut`` of each text, with the paths of all found together."""
        parts = [_RUN.findall(t or "") for t in texts]
        han = lambda run: "一" <= run[0] <= "龥"
        found = iter(()) if mode == "HMM" and self.model else self.paths([r for p in parts for r in p if han(r)])
        for p in parts:
            out: list[str] = []
            for r in p:
                out += self._run(r, mode, next(found, None)) if han(r) else [r]
            yield out

    def column(self, c: Column, mode: str = "DEFAULT", stop_words: bool = False) -> Column:
        """The words of a column, and without the stop words if asked. The word graph is beyond SQL, so batches go through Arrow."""
        sent = SparkSession.active().sparkContext.broadcast(self)
        skipped = frozenset(STOP_WORDS if stop_words else ())

        @F.arrow_udf("array<string>")
        def cut(texts: pa.Array) -> pa.Array:
            parts, ends = [pa.array([], pa.string())], [0]
            for ws in sent.value.cut_all(texts.to_pylist(), mode):
                parts.append(pa.array([w for w in ws if w not in skipped] if skipped else ws, pa.string()))
                ends.append(ends[-1] + len(parts[-1]))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))

        return cut(c)


def word_counts(tokens: DataFrame, column: str = "tokens", longest: int = 16, most: int = MOST_WORDS) -> DataFrame:
    """word, n and weight (the logarithm of its share) of the ``most`` frequent words up to a length, by n and then by word."""
    return frequent(tokens.select(F.explode(column).alias("word"), F.lit(1).cast("long").alias("n")), longest, most)


def frequent(counts: DataFrame, longest: int = 16, most: int = MOST_WORDS) -> DataFrame:
    """``word_counts`` of words that are counted in parts (word, n)."""
    counted = counts.filter(F.char_length("word").between(1, longest)).groupBy("word").agg(F.sum("n").alias("n"))
    return weighted(counted.orderBy(F.desc("n"), "word").limit(most))


def weighted(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with the weight of each: the logarithm of its share of all n."""
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).withColumn("weight", F.log(F.col("n") / F.col("total"))).drop("total")  # one row


def load_words(spark: SparkSession, path: str, default: int = 1) -> DataFrame:
    """word, n and tag of a dictionary file: a word a line, then maybe its frequency, then maybe its tag, with spaces between.

    Of lines with one word the largest frequency counts; lines that are empty or begin with # are left out.
    """
    part = F.split(F.trim("value"), r"\s+")
    number = F.try_element_at(part, F.lit(2)).try_cast("bigint")
    rows = spark.read.text(path).filter("trim(value) <> '' and value not like '#%'").select(part[0].alias("word"), F.coalesce(number, F.lit(default)).alias("n"), F.try_element_at(part, F.when(number.isNull(), F.lit(2)).otherwise(3)).alias("tag"))
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.max_by("tag", "n").alias("tag"))


def neighbour_counts(tokens: DataFrame, column: str = "tokens", fold: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """word, before and n: how often a word is a row's first (before is empty), or follows one of one character (S) or of more (E).

    ``fold`` makes one word of several of the same length. Rows are lists of words in order; null and empty words are left out, as are
    empty lists. Counted within tasks first.
    """
    rows = tokens.select(F.filter(F.col(column), lambda w: F.coalesce(w, F.lit("")) != "").alias("w"))
    each = rows.select(F.explode(F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("p"))).alias("x")).filter("x.w is not null")
    before = F.when(F.col("x.p") == "", "").when(F.char_length("x.p") == 1, "S").otherwise("E")
    return each.groupBy(fold(F.col("x.w")).alias("word"), before.alias("before")).agg(F.count("*").alias("n"))


def state_counts(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """kind (start, follow or emit), a, b and n: how often a row begins with state b, b follows a, and state a has character b.

    Rows are as in ``neighbour_counts``; only distinct words are taken apart.
    """
    return states_of(neighbour_counts(tokens, column))


def states_of(counts: DataFrame) -> DataFrame:
    """``state_counts`` of ``neighbour_counts``."""
    size = F.char_length("word")
    state = lambda i: F.when(size == 1, "S").when(i == 1, "B").when(i == size, "E").otherwise("M")
    each = counts.select("word", "before", "n", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    here = each.select("n", state(F.col("i")).alias("s"), F.substr("word", "i", F.lit(1)).alias("c"), F.when(F.col("i") == 1, F.col("before")).otherwise(state(F.col("i") - 1)).alias("p"))
    seen = lambda kind, a, b: F.struct(kind.alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.array(seen(F.when(F.col("p") == "", "start").otherwise("follow"), "p", "s"), seen(F.lit("emit"), "s", "c"))
    return here.select("n", F.explode(both).alias("y")).groupBy("y.kind", "y.a", "y.b").agg(F.sum("n").alias("n"))


def model_of(counts: DataFrame) -> Model:
    """The model of ``state_counts``; its rows, four for each character of the script at most, go to the driver."""
    share = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("kind", "a")))
    start, follow, emit = {}, {}, {}
    for r in counts.select("kind", "a", "b", share.alias("p")).collect():
        {"start": start, "follow": follow, "emit": emit}[r.kind][r.b if r.kind == "start" else (r.a, r.b)] = r.p
    return Model(start, follow, emit)


def load_model(spark: SparkSession, path: str) -> Model:
    """A model file: lines of # apart, the start weights of B, E, M and S, four lines of the weights of each after each, and a
    line of ``character:weight`` pairs, with commas between, for each of the four states."""
    lines = [r.value.strip() for r in spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").collect()]
    lines = [x for x in lines if x and not x.startswith("#")]
    number = lambda line: [float(x) for x in line.split()]
    start = dict(zip(STATES, number(lines[0])))
    follow = {(a, b): w for a, line in zip(STATES, lines[1:5]) for b, w in zip(STATES, number(line))}
    emit = {(s, pair[0]): float(pair[2:]) for s, line in zip(STATES, lines[5:9]) for pair in line.split(",") if pair}
    return Model(start, follow, emit)


def segmenter(words: DataFrame, model: Model | None = None, own: DataFrame | None = None) -> Segmenter:
    """A segmenter over a dictionary table (word, weight; or word, n), with words of one's own (word) if given."""
    known = (words if "weight" in words.columns else weighted(words)).select("word", "weight")
    if (n := known.limit(MOST_WORDS + 1).count()) > MOST_WORDS:
        raise ValueError(f"a dictionary of {n} words or more; keep the {MOST_WORDS} most frequent")
    made = Segmenter({r.word: r.weight for r in known.collect() if r.word}, model)
    for r in own.select("word").collect() if own is not None else []:
        made.add(r.word)
    return made
