"""Token ids from the `tokenizers` library, for operators that count or store tokens.

The library encodes each distinct pre-token once (many of them joined by spaces in a call: a
pre-token stands alone wherever white space surrounds it, and its last id is the one with the word
end); documents are then put together from those ids as in operator 4.
"""

from __future__ import annotations

import os

import numpy as np

from furrow.llm.bpe import TextEncoder, WordBpe

_JOIN = 256
_ENCODERS: dict[str, TextEncoder] = {}


def _library_words(path: str, bpe: WordBpe):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    if own.post_processor is not None or not bpe.ends_word.any():
        raise ValueError(f"{path}: not a word-end BPE without post-processor")

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = own.encode_batch_fast([" ".join(words[i : i + _JOIN]) for i in range(0, len(words), _JOIN)], add_special_tokens=False)
        ids = np.array([x for p in parts for x in p.ids], np.int32)
        count = np.diff(np.r_[-1, np.flatnonzero(bpe.ends_word[ids])])
        if len(count) != len(words):  # a word with a white-space letter would break the rule above
            each = [p.ids for p in own.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([x for p in each for x in p], np.int32), np.array([len(p) for p in each], np.int64)
        return ids, count

    return encode


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        bpe = WordBpe(path)
        _ENCODERS[path] = TextEncoder(bpe, _library_words(path, bpe))
    return _ENCODERS[path]
