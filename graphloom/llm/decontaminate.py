"""Operator 7: benchmark passages in documents, found by one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small_batches, table, text_first

#: Words of a window.
WINDOW = 13
#: Characters of benchmark text that one automaton may be built from, and texts that are scanned with one before the next is built.
#: A benchmark within the former, as those in use are, has one automaton a task. Of a larger one only one is held at a time.
AUTOMATON_BYTES, SCANNED_BYTES = 16 << 20, 64 << 20

#: Word bytes are digits, letters and all bytes over 0x7F; A-Z are lower-cased, everything else is a space.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))


def normal(text: str | None) -> list[bytes]:
    """The words of a text: lower-cased ASCII letters, digits and characters beyond ASCII; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows(items: list[tuple], window: int = WINDOW) -> dict[bytes, list]:
    """Window, as its words joined by spaces with a space at both ends, to the ids of the items that hold it."""
    out: dict[bytes, list] = {}
    for item, text in items:
        words = normal(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            ids = out.setdefault(b" " + b" ".join(words[at : at + window]) + b" ", [])
            if item not in ids:
                ids.append(item)
    return out


def automaton(found: dict[bytes, list]):
    """The automaton over one Latin-1 character per byte, so that places in it are byte offsets; None without windows."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w, ids in found.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), ids))
    if not found:
        return None
    a.make_automaton()
    return a


def scan(a, words: list[bytes]) -> tuple[np.ndarray, set]:
    """The [first, last) word ranges that windows cover, by start, and the ids of their items. One pass over the text."""
    if a is None or not words:
        return np.zeros((0, 2), np.int64), set()
    line = b" " + b" ".join(words) + b" "
    ends, sizes, items = [], [], set()
    for end, (n, length, ids) in a.iter(line.decode("latin-1")):
        ends.append(end + 1 - length)
        sizes.append(n)
        items.update(ids)
    if not ends:
        return np.zeros((0, 2), np.int64), items
    # the words' starts give back the word that a byte offset of the automaton belongs to
    starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    first = np.searchsorted(starts, np.array(ends))
    return np.stack([first, first + np.array(sizes)], axis=1), items


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw)]
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(point[places[a][0]]) - 1, int(point[places[b - 1][1] - 1])) for a, b in ranges]


_HITS = pa.schema([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _scanner(chunks, spans: bool):
    def run(batches):
        built = automaton(windows(chunks[0])) if len(chunks) == 1 else None
        for batch in batches if len(chunks) == 1 else _gathered(batches):
            texts = batch.column(0).to_pylist()
            split = [normal(t) for t in texts]
            hits, items = [np.zeros((0, 2), np.int64)] * len(texts), [set() for _ in texts]
            for chunk in chunks:
                a = built if len(chunks) == 1 else automaton(windows(chunk))
                for i, words in enumerate(split):
                    found, ids = scan(a, words)
                    if len(found):
                        hits[i] = np.concatenate([hits[i], found])
                        items[i] |= ids
            ranges = [merged(h) for h in hits]
            out = [
                pa.array([len(w) for w in split], pa.int64()),
                pa.array([[list(r) for r in x] for x in ranges], _HITS.field("ranges").type),
                pa.array([[list(r) for r in _spans(t, x)] if spans and x else [] for t, x in zip(texts, ranges)], _HITS.field("spans").type),
                pa.array([sorted(map(str, x - {None})) for x in items], _HITS.field("items").type),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], schema=pa.schema([*list(batch.schema)[1:], *_HITS]))

    return run


def _gathered(batches):
    """The batches, joined until they hold ``SCANNED_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SCANNED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _chunks(benchmark: DataFrame) -> list[list[tuple]]:
    """The benchmark's (item_id, text) in lists of ``AUTOMATON_BYTES`` or one item. The driver holds the benchmark, a set of
    test items made by hand; the corpus itself never comes here. Items without a text are not looked for."""
    out, held = [[]], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if held and held + len(r.text) > AUTOMATON_BYTES:
            out.append([])
            held = 0
        out[-1].append((r.item_id, r.text))
        held += len(r.text)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple = ("doc_id",), text: str = "text", spans: bool = True) -> DataFrame:
    """The columns ``keep`` and: n_words; ranges of words that lie in a benchmark window; the same as spans of code points of
    the original text (left empty unless ``spans``); items, the ids (as strings, sorted) whose windows occur.

    A window is 13 consecutive words of an item; an item of fewer words is one window; one without words is none. Null and
    empty texts have no words. Repeated rows are judged each for itself, repeated items count once by id. Items with a null id
    are looked for too, but are not in items. A very long text is one row, scanned once. Columns of ``keep`` that are named like the
    added ones are replaced. An empty table gives an empty one. No shuffle.
    """
    rows = small_batches(text_first(docs, text, keep, ("n_words", "ranges", "spans", "items")))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scanner(_chunks(benchmark), spans), kept + "n_words bigint, ranges array<array<bigint>>, spans array<array<bigint>>, items array<string>")


def judged(hits: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (a hit, and at least a twentieth of the words hit) added to ``decontaminate``'s rows."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    out = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return judged(hits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
i as (select distinct item_id, {_SQL_WORDS} as w from benchmark where item_id is not null and text is not null),
iw as (select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') as k
       from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) as p from i where len(w) > 0)),
dw as (select r, n, p, array_to_string(w[p : p + n - 1], ' ') as k
       from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from d, (select distinct n from iw) where len(w) >= n)),
m as (select r, dw.n, p, item_id from dw join iw using (n, k)),
h as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(p, p + n - 1)) from m) group by r),
it as (select r, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct r, item_id::varchar as s from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join it using (r)
"""
