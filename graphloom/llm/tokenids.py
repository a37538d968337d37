"""Operator 1: token ids of whole texts, in Simple-8b shards sorted by document id."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .tables import give_back, scratch, small_batches, table

#: A segment ends with the document that brings it to so many ids; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
#: Words, and halves of words, that a worker keeps ready, at most; then the older half of them is dropped.
CACHE_WORDS, CACHE_HALVES = 500_000, 1_000_000
#: A batch of fewer bytes is encoded with the next one.
PAIR_BYTES = 4 << 20
SHARDS = "shard int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"

#: Letters and digits that neither normalisation nor a neighbouring mark can change, then ASCII marks without the apostrophe.
#: The tokenizer always splits between the two, so both halves can be encoded alone.
_SIMPLE = re.compile("([0-9A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


class Encoder:
    """Encodes texts with a ``tokenizers`` file; each distinct word goes through the library once while it is kept.

    Text is cut at spaces and line feeds only, where the tokenizer itself always splits. ``special`` holds the strings of its
    added tokens; a word that holds one goes to the library as it is. Works for tokenizers that drop white space, with or without
    case. Many words go to the library as one text, with a mark between them whose id parts the answer again, if the tokenizer is
    seen to keep that mark apart.
    """

    MARK = "~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words: dict[str, bytes] = {"": b""}
        self.halves: dict[str, bytes] = {}
        one = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.fold = one("Word") == one("word") and one("\u00c9T\u00c9") == one("\u00e9t\u00e9")
        mark = one(self.MARK)
        apart = len(mark) == 1 and one(f"ab {self.MARK} c,{self.MARK}") != one("ab c,") and one(f"ab {self.MARK} {self.MARK} c,") == one("ab") + mark * 2 + one("c,")
        self.mark = mark[0] if apart else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _library(self, pieces: list[str]) -> list[bytes]:
        if self.mark is None or len(pieces) < 2:
            return self._each(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(pieces)], add_special_tokens=False)[0].ids, dtype=self.width)
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(pieces) - 1:  # some piece holds the mark itself: those go alone
            held = {i: b for i, b in zip((k for k, p in enumerate(pieces) if self.MARK in p), self._each([p for p in pieces if self.MARK in p]))}
            rest = iter(self._library([p for p in pieces if self.MARK not in p]) if held and len(held) < len(pieces) else self._each([p for p in pieces if self.MARK not in p]))
            return [held[i] if i in held else next(rest) for i in range(len(pieces))]
        raw, size = ids.tobytes(), self.width.itemsize
        return [raw[i:j] for i, j in zip([0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(raw)])]

    @staticmethod
    def _trim(kept: dict, most: int) -> None:
        if len(kept) > most:
            for k in list(kept)[: len(kept) // 2]:
                if k:
                    del kept[k]

    def _learn(self, new: list[str], special: bool) -> None:
        """The ids of words that are not kept; ``special`` if any of them may hold an added token."""
        match, known, words = _SIMPLE.fullmatch, self.halves, self.words
        if special:
            apart = [w for w in new if any(s in w for s in self.special)]
            words.update(zip(apart, self._each(apart)))
            apart = set(apart)
            new = [w for w in new if w not in apart]
        # words of letters and digits alone, then those with marks behind, then all others
        bare, front, back, marked, whole = [], [], [], [], []
        for w in new:
            if w.isalnum() and w.isascii():
                bare.append(w)
            elif m := match(w):
                a, b = m.groups()
                marked.append(w)
                front.append(a)
                back.append(b)
            else:
                whole.append(w)
        low, front = (list(map(str.lower, bare)), list(map(str.lower, front))) if self.fold else (bare, front)
        self._trim(known, CACHE_HALVES)
        fresh = [h for h in {*low, *front, *back} if h not in known]
        known.update(zip(fresh, self._library(fresh)))
        words.update(zip(whole, self._library(whole)))
        get = known.__getitem__
        words.update(zip(bare, map(get, low)))
        words.update(zip(marked, map(bytes.__add__, map(get, front), map(get, back))))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow numbers the distinct words, so that only those are looked up one by one."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        if not len(column):
            return []
        column = column.fill_null("")
        cut_up = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        numbered = cut_up.flatten().dictionary_encode()
        distinct, place = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        self._trim(self.words, CACHE_WORDS)
        blobs = list(map(self.words.get, distinct))
        at = [i for i, b in enumerate(blobs) if b is None]
        if at:
            new = [distinct[i] for i in at]
            self._learn(new, any(pc.any(pc.match_substring(column, s)).as_py() for s in self.special))
            for i, b in zip(at, map(self.words.__getitem__, new)):
                blobs[i] = b
        flat = np.frombuffer(b"".join(blobs), self.width)
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.width.itemsize
        start, n = (np.cumsum(size) - size)[place], size[place]
        ends = np.cumsum(n)
        whole = np.int32 if len(flat) + (ends[-1] if len(ends) else 0) < 1 << 30 else np.int64
        ids = flat[np.repeat((start - (ends - n)).astype(whole), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=whole)]
        edges = np.concatenate([[0], ends])[cut_up.offsets.to_numpy() - cut_up.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _paired(batches):
    """Two small batches as one: they share many words."""
    held = None
    for batch in batches:
        if held is None and batch.nbytes < PAIR_BYTES:
            held = batch
        elif held is None:
            yield batch
        else:
            yield from pa.Table.from_batches([held, batch]).combine_chunks().to_batches()
            held = None
    if held is not None:
        yield held


def _segments(path: str, end_id: int, batches):
    shard, seq, first = TaskContext.get().partitionId(), 0, 0
    encode, schema = encoder(path), pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
    ids, parts, held = [], [], 0

    def segment():
        nonlocal seq, first, ids, parts, held
        values = np.concatenate(parts)
        row = pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "first": first, "n_ids": held, "doc_ids": ids, "lengths": [len(x) for x in parts], "payload": simple8b.encode(values)}], schema=schema)
        seq, first, ids, parts, held = seq + 1, first + held, [], [], 0
        return row

    end = np.array([end_id], dtype=encode.width)
    for batch in _paired(batches):
        for doc, part in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
            ids.append(doc)
            parts.append(np.concatenate([part, end]))
            held += len(part) + 1
            if held >= SEGMENT_IDS:
                yield segment()
    if ids:
        yield segment()
    give_back()


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into shards below ``path``, in ascending doc_id order.

    One shard per range of ids; a shard is a Parquet file of segments, each a Simple-8b payload with its documents' ids and
    lengths and its place among the shard's ids. A null text is empty and gives the end id alone. Rows with equal ids follow
    each other, ordered by a hash of their text; null ids come first. An empty table gives shards without segments. Tasks
    hold one segment at a time, plus the batch they read. The files are written by Spark's own committer, so a lost
    executor's tasks just run again. ``end_id`` has to fit the vocabulary's id width.
    """
    rows = docs.select("doc_id", "text")
    order = ["doc_id", F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    small_batches(spread).mapInArrow(lambda b: _segments(tokenizer, end_id, b), SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment, as written; ``start`` is the number of ids in all segments before it.

    The number of ids in each shard, one row per shard, is summed up on the driver.
    """
    segments = spark.read.schema(SHARDS).parquet(path)
    totals = sorted((r.shard, r.n) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = [], 0
    for shard, n in totals:
        starts.append((shard, at))
        at += n
    return segments.join(F.broadcast(spark.createDataFrame(starts, "shard int, base long")), "shard").withColumn("start", F.col("base") + F.col("first"))


def _digests(batches):
    for batch in batches:
        for row in batch.to_pylist():
            values = simple8b.decode(row["payload"]).astype("<u4")
            ends = np.cumsum(row["lengths"])
            out, raw = [], memoryview(values.tobytes())
            for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                out.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of each document, decoded from the files."""
    return segments.select("doc_ids", "lengths", "payload", "start").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and return the digests read back from them."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer or default_tokenizer(), end_id)
    return digests(read_shards(spark, path))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
