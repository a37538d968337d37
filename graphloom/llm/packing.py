"""Operator 12: documents packed into few sequences, by the configuration program over the histogram of their lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import configlp
from .bytebpe import ByteEncoder
from .tables import cut, give_back, table

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Texts, and bytes of them, that are encoded at once, but one text at least.
STEP_ROWS, STEP_BYTES = 256, 2 << 20
#: The first ranks of each task's lengths are broadcast if there are at most so many; of more, pieces are joined with them.
SENT_ROWS = 1 << 20
PIECES = "part int, doc_id long, piece int, start long, length int, local long, ids binary"
PACKED = "doc_id long, piece int, start long, length int, sequence_id long, offset int, ids binary"

_ENCODERS: dict[str, ByteEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _steps(batches):
    """Slices of batches that hold few bytes of text."""
    for batch in batches:
        ends = np.cumsum([0, *((x.as_py() or 0) for x in pc.binary_length(batch.column(1)))])
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + STEP_BYTES, "right")) - 1
            hi = min(max(hi, lo + 1), lo + STEP_ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _pieces(path: str, end_id: int, capacity: int, batches):
    """The pieces of documents, each with its number among the task's pieces of its length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ByteEncoder(path))
    end = np.array([end_id], dtype=encode.width)
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in _steps(batches):
        out = [[] for _ in names]
        for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
            ids = np.concatenate([ids, end])
            first = len(ids) % capacity or capacity
            for piece, hi in enumerate(range(first, len(ids) + 1, capacity)):
                lo = max(0, hi - capacity) if piece else 0
                for column, x in zip(out, (part, doc, piece, lo, hi - lo, int(seen[hi - lo]), ids[lo:hi].tobytes())):
                    column.append(x)
                seen[hi - lo] += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=names)
    give_back()


def placements(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For ranges of ranks among the pieces of one length: where a range starts (length << 44 | rank), the first sequence of
    its configuration, the copies that a sequence of it holds, and the place of the first copy."""
    rank, rows, sequence = {}, [], 0
    for config, times in plan:
        offset = 0
        for l, copies in sorted(config.items(), reverse=True):
            first = rank.get(l, 0)
            rows.append((l << 44 | first, sequence, copies, offset))
            rank[l], offset = first + copies * times, offset + copies * l
        sequence += times
    return tuple(np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T)


def _placed(sent, batches):
    start, sequence, copies, offset = sent.value
    for batch in batches:
        doc, piece, lo, length, ids, rank = batch.columns
        n, r = length.to_numpy().astype(np.int64), rank.to_numpy()
        at = np.searchsorted(start, n << 44 | r, "right") - 1
        i = r - (start[at] & (1 << 44) - 1)
        yield pa.RecordBatch.from_arrays([doc, piece, lo, length, pa.array(sequence[at] + i // copies[at]), pa.array((offset[at] + i % copies[at] * n).astype(np.int32)), ids], names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, sequence_id, offset and ids of each piece of ``docs`` (doc_id, text; others are ignored).

    A document's ids are those of its whole text (null: empty) and ``end_id``; one of more than ``capacity`` is cut into pieces
    of that length, of which the first may be shorter. ``ids`` are little-endian, of two bytes where the vocabulary allows it.
    A sequence's pieces lie from offset 0 without gaps and hold at most ``capacity`` ids. Rows with null or equal doc_ids are
    documents each. An empty table has no pieces.

    Texts are encoded once, into a table in the shared folder, where each piece has a number among the pieces of its length in
    its task. Only the histogram of lengths, at most ``capacity`` counts, goes to the driver, where ``configlp.pack`` makes
    the plan; its size is bounded by ``capacity`` and its rounds. Sums over tasks turn numbers into ranks, and the plan has the
    place of each rank, so a length of any number of pieces is dealt out without bringing them together.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    pieces = cut(docs.select("doc_id", "text").mapInArrow(lambda b: _pieces(path, end_id, capacity, b), PIECES), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    sent = spark.sparkContext.broadcast(placements(configlp.pack(histogram, capacity)))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("base"))
    base = F.broadcast(base) if counts.count() <= SENT_ROWS else base
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("local") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(lambda b: _placed(sent, b), PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence of ``pack``: sequence_id, its ids in order, and doc_id, piece, start, length and offset of its parts."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("own")
    joined = F.aggregate("own", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids")
    return packed.groupBy("sequence_id").agg(own).select("sequence_id", joined, F.transform("own", lambda x: x.dropFields("ids")).alias("parts"))


def _digests(batches):
    for batch in batches:
        crc = []
        for ids, n in zip(batch.column(0), batch.column(4).to_pylist()):
            raw = ids.as_buffer()
            crc.append(zlib.crc32(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64())], names=[*batch.schema.names[1:], "ids_crc32"])


def digests(packed: DataFrame) -> DataFrame:
    """The pieces of ``pack`` with a checksum of their ids, as 32-bit integers, in the place of the ids."""
    longs = packed.select("ids", "doc_id", "piece", "start", F.col("length").cast("long"), "sequence_id", F.col("offset").cast("long"))
    return longs.mapInArrow(_digests, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
