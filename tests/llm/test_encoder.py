"""The word-wise encoder against the tokenizer library on whole texts."""

import numpy as np
import pytest
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from graphloom.llm import tokenids

ODD = ["~", "~ ~~ a~b ~a a~ ,~", "It's <|endoftext|> x<|endoftext|>y ~", "\u00dcn\u00ef \u00c9T\u00c9 e\u0301", "a\tb\u00a0c\r\nd", "\u4f60\u597d \U0001f600 1,234.50!!", "", "   ", "don't DON'T we'll 's 't", "x" * 3000, "\u0130stanbul \u1e9eS \ufb01"]


def test_odd_texts():
    path = tokenids.default_tokenizer()
    encoder, library = tokenids.Encoder(path), Tokenizer.from_file(path)
    assert encoder.mark is not None and encoder.fold
    for texts in ([t] for t in ODD):
        assert [x.tolist() for x in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    fresh = tokenids.Encoder(path)
    assert [x.tolist() for x in fresh(ODD + ODD)] == [library.encode(t, add_special_tokens=False).ids for t in ODD + ODD]
    assert fresh([None])[0].tolist() == []


@pytest.mark.parametrize("lower", [True, False])
def test_other_tokenizers(tmp_path, rng, lower):
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "word", "Word", "WORD", "one", "~", ",", "a", "b", "c"])}
    made = Tokenizer(models.WordLevel(vocabulary, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    if lower:
        made.normalizer = normalizers.Lowercase()
    made.save(str(tmp_path / "t.json"))
    encoder = tokenids.Encoder(str(tmp_path / "t.json"))
    assert encoder.fold == lower
    texts = [" ".join(rng.choice(["word", "Word", "WORD", "one", "~", "Word,", "a", "zzz", "~~"]) for _ in range(20)) for _ in range(9)]
    assert [x.tolist() for x in encoder(texts)] == [made.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.dtype(encoder.width).itemsize == 2
