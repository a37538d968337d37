import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import configlp, packing
from graphloom.llm.bytebpe import ByteEncoder

ODD = ["a", "b'", "'", "'s", " ", "  ", "\n", "\t", " ", "　", "1", "12", ".", ",", "é", "中", "🙂", "\0", "<|endoftext|>", "can't", "'ll ", "\x1c", "\x85", "Ⅷ", "²", "_", "\r\n", "I'm", "́", "‍"]


def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(rng):
    encode, tokenizer = ByteEncoder(packing.default_tokenizer()), library()
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(4000)] + [" " * 5000, "\n" * 999 + "x", "z" * 4000]
    assert encode.ranked is not None
    for text, ids in zip(texts, encode(pa.array(texts))):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_without_ranks(monkeypatch):
    encode = ByteEncoder(packing.default_tokenizer())
    fast = [x.tolist() for x in encode(pa.array(["It's 12", None]))]
    encode.ranked = None
    assert [x.tolist() for x in encode(pa.array(["It's 12", None]))] == fast


def check(docs, rows, capacity):
    """Pieces hold all ids of each document in order, sequences are gapless and not too long; the number of sequences."""
    tokenizer, by_doc, by_sequence = library(), {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2").tolist()
        assert len(ids) == r.length
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in docs}
    for doc, text in docs:
        pieces, whole = sorted(by_doc[doc]), ids_of(tokenizer, text)
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert [i for _, _, ids in pieces for i in ids] == whole
        assert [s for _, s, _ in pieces] == np.cumsum([0, *(len(ids) for _, _, ids in pieces[:-1])]).tolist()
        assert all(len(ids) == capacity for _, _, ids in pieces[1:]) and len(pieces) == -(-len(whole) // capacity)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.fixture(scope="module")
def docs():
    import random

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice([*ODD, " the", " word", " of"]) for _ in range(n))
    return [(i, text(rng.randrange(0, 60))) for i in range(200)] + [(300, None), (301, ""), (302, text(3000)), (303, "x" * 5000)] + [(i, "same again") for i in range(400, 460)]


def test_pack_keeps_everything(spark, docs):
    packed = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), capacity=64)
    n = check(docs, packed.collect(), 64)
    total = sum(len(ids_of(library(), t)) for _, t in docs)
    assert -(-total // 64) <= n <= 1.02 * total / 64 + 1


def test_ranks_joined_instead_of_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SENT_ROWS", 0)
    check(docs, packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), capacity=50).collect(), 50)


def test_sequences_and_digests(spark, docs):
    packed = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), capacity=64)
    whole = {r.sequence_id: (np.frombuffer(bytes(r.ids), "<u2"), r.parts) for r in packing.sequences(packed).collect()}
    rows = packing.digests(packed).collect()
    assert len(rows) == sum(len(parts) for _, parts in whole.values())
    for r in rows:
        ids = whole[r.sequence_id][0][r.offset : r.offset + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32


def test_null_ids_repeats_empty_and_other_columns(spark):
    rows = [(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (1, "c", 3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, part long")).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 2), ("1", 3), ("1", 3), ("None", 3)]
    assert len({r.sequence_id for r in got}) == 1 and sorted(r.offset for r in got)[0] == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_equals_the_plain_one(rng):
    for capacity in (10, 37, 100):
        for _ in range(40):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 80))]
            found = configlp.best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert sum(n for _, n in found) == plain_best_fit(lengths, capacity)


def test_knapsack_is_exact(rng):
    price = np.array([-np.inf, -np.inf, 2.0, 3.5, -np.inf, 6.5, -np.inf, 9.9])
    best, last = configlp.priced(np.append(price, [-np.inf] * 13), 20)
    plain = [0.0] * 21
    for c in range(1, 21):
        plain[c] = max([plain[c - 1], *(price[l] + plain[c - l] for l in range(2, 8) if l <= c)])
    assert np.allclose(best, plain)


def test_program_is_near_the_bound_where_best_fit_is_not(rng):
    """Triples that fill bins exactly: best fit by falling length misses many of them."""
    lengths = [x for _ in range(3000) for a, b in [(rng.randrange(30, 70), rng.randrange(40, 80))] for x in (a, b, 204 - a - b)]
    counts = np.bincount(lengths, minlength=205)
    plan = configlp.pack(counts, 204)
    kept = np.zeros(205, dtype=int)
    for config, n in plan:
        assert sum(l * a for l, a in config.items()) <= 204 and n > 0
        for l, a in config.items():
            kept[l] += a * n
    assert (kept == counts).all()
    bins = sum(n for _, n in plan)
    assert 3000 <= bins <= 3000 * 1.01 and bins < sum(n for _, n in configlp.best_fit(counts, 204))
