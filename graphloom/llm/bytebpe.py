"""Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

#: Fixed value: the pattern that byte-level tokenizers of this kind cut texts with before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, for
    the letters from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Gives the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Where the file's merges make tokens in the order of their ids, as usual, ``tiktoken`` merges by the ranks that are read from
    that file, which takes a quarter of the time; any other byte-level file, and any text with the string of an added token, goes
    through the ``tokenizers`` library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told, vocab = json.loads(self.tokenizer.to_str()), self.tokenizer.get_vocab(with_added_tokens=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.ranked = self._ranked(told, vocab)

    @staticmethod
    def _ranked(told: dict, vocab: dict):
        before, model = told["pre_tokenizer"] or {}, told["model"]
        plain = not told["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        if not plain or model.get("dropout") or model.get("ignore_merges") or merged != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        byte = _byte_of()
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if self.ranked is None:
            return self.library([t or "" for t in texts.to_pylist()])
        return [self.library([t])[0] if any(s in t for s in self.special) else np.array(self.ranked.encode_ordinary(t), dtype=self.width) for t in (t or "" for t in texts.to_pylist())]
