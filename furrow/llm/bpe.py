"""Operator 4: byte-pair encoding and decoding in batched numpy merge rounds.

A slice of texts is cut into white-space chunks on its bytes, each distinct chunk is normalised and
split into pre-tokens once, and the symbols of all new pre-tokens lie in one flat array.  Every
round looks up the rank of all changed neighbours by binary search over the sorted pair keys and
merges, in each word, the pair of the lowest rank wherever it stands; words without a known pair
leave.  So a long word takes as many rounds as it has different merges, not as it has merges.
Documents are then put together by ragged gathers.  Encoding is map-only: no shuffle, and the
memory of a task is bounded by the slice, the longest text and WORD_CACHE remembered pre-tokens.

Null text counts as empty: no tokens, and the empty text when decoded.  Rows are encoded each on their
own, whatever their other columns hold.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.common import hash_spans, slices, spare_name, utf8, word_spans

TEXT_SLICE = 4 << 20
WORD_CACHE = 400_000
_INF = np.int32(2**31 - 1)

# The tokenizer file's pre-token pattern (white space written out as the Unicode property).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+"
_TOKENS = regex.compile(PATTERN)
_TOKENS_AND_BREAKS = regex.compile(r"\n|" + PATTERN)
# Letters of these blocks are the same in every Unicode version since 6; the library itself splits chunks with others.
_NEWER = regex.compile("[^\0-\u024f\u0386-\u03ff\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ragged_take(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start[i]:start[i]+length[i]]."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary and merge table of a word-end BPE tokenizer file (NFC, lower case, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.path = path
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # a merge whose result can take part in one of a lower rank (if another merge makes it too) goes one place at a time
        soonest = np.full(self.size, len(merges), np.int64)
        for part in (keys // self.size, keys % self.size):
            np.minimum.at(soonest, part, np.arange(len(merges)))
        self.alone = soonest[self.made] <= np.arange(len(merges))
        self.strings = [""] * self.size
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        self.ends_word = np.array([s.endswith(suffix) for s in self.strings])
        pieces = [(" " + s).encode() for s in self.strings]
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _INF)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        if not size.sum():
            return np.empty(0, np.int32), size
        data, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
        sym, last = self.inner[data], end[size > 0] - 1
        sym[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), size)
        out_sym, out_word = [], []
        rank = np.full(len(sym), _INF, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        while len(sym):
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            nth, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            low = np.minimum.reduceat(rank, starts)
            over = (low == _INF)[nth]
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
                go = ~over
                sym, word, rank, low_here = sym[go], word[go], rank[go], low[nth[go]]
                if not len(sym):
                    break
            else:
                low_here = low[nth]
            hit = np.flatnonzero(rank == low_here)
            run = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], np.arange(len(hit)), 0))
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # all places of the pair at once, every second one of an overlapping run; only the leftmost where the order could matter
            hit = hit[np.where(self.alone[rank[hit]], first, (np.arange(len(hit)) - run) % 2 == 0)]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word, rank = sym[stay], word[stay], rank[stay]
            hit = hit - np.arange(len(hit))  # one symbol went for each place before it
            for at in (hit, hit[hit > 0] - 1):
                if len(at):
                    nxt = np.minimum(at + 1, len(sym) - 1)
                    ok = (at + 1 < len(sym)) & (word[at] == word[nxt])
                    rank[at] = np.where(ok, self.rank(sym[at], sym[nxt]), _INF)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def decode_rows(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """One text for each row: the token strings joined by a space (the file has no decoder)."""
        length = self.piece_len[ids]
        flat = ragged_take(self.pieces, self.piece_start[ids], length)
        ends = np.cumsum(count)
        total = np.r_[0, np.cumsum(length)]
        size = total[ends] - total[ends - count]
        keep = np.ones(len(flat), bool)
        keep[(np.cumsum(size) - size)[size > 0]] = False  # the space before a row's first token
        offsets = np.r_[0, np.cumsum(np.maximum(size - 1, 0))]
        return pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat[keep])).cast(pa.string())


class _Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class TextEncoder:
    """Encodes slices of texts; `encode_words` gives the ids of new pre-tokens."""

    def __init__(self, bpe: WordBpe, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None):
        self.bpe, self.encode_words = bpe, encode_words or bpe.encode_words
        self._special = regex.compile("(" + "|".join(map(regex.escape, bpe.specials)) + ")") if bpe.specials else regex.compile("((?!))")
        self._library = None
        self._reset()

    def _reset(self) -> None:
        self.index, self.rooms = _Index({"\n": 0}), {}
        self.flat, self.start, self.count = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for s, i in self.bpe.specials.items():
            self.index["\0" + s]
            self._add(np.array([i], np.int32), np.array([1]))

    def _add(self, ids: np.ndarray, count: np.ndarray) -> None:
        self._append("start", len(self.flat) + np.cumsum(count) - count)
        self._append("count", count)
        self._append("flat", ids)

    def _append(self, name: str, values: np.ndarray) -> None:
        """Grow an array in place; its room doubles, so that small additions do not copy it."""
        old = getattr(self, name)
        room = self.rooms.get(name, old)
        n = len(old) + len(values)
        if n > len(room) or old.base is not room:
            room = np.empty(max(n, 2 * len(old), 1024), old.dtype)
            room[: len(old)] = old
            self.rooms[name] = room
        room[len(old) : n] = values
        setattr(self, name, room[:n])

    def _pretokens(self, chunk: str) -> list[str]:
        out = []
        for part in self._special.split(chunk):
            if part in self.bpe.specials:
                out.append("\0" + part)
            else:
                out += self._split_newer(part) if _NEWER.search(part) else _TOKENS.findall(_normal(part))
        return out

    def _split_newer(self, part: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.bpe.path)
            self._bytes = {c: b for b, c in enumerate(_byte_chars())}
        split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
        return [bytes(map(self._bytes.__getitem__, s)).decode() for s, _ in split]

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts without line breaks."""
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        joined = "\n".join(texts)
        if self._special.search(joined) or (not joined.isascii() and _NEWER.search(joined)):
            tokens = []
            for t in texts:
                plain = t.isascii() and "<|" not in t
                tokens += _TOKENS.findall(t.lower()) if plain else self._pretokens(t)
                tokens.append("\n")
        else:
            tokens = _TOKENS_AND_BREAKS.findall(_normal(joined) + "\n")
        if len(self.index) > WORD_CACHE:
            self._reset()
        index, known = self.index, len(self.index)
        code = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        if len(index) > known:
            self._add(*self.encode_words(list(index)[known:]))
        end, count = np.flatnonzero(code == 0), self.count[code]
        ids = ragged_take(self.flat, self.start[code], count)
        total = np.r_[0, np.cumsum(count)]
        return ids, np.diff(np.r_[0, total[end]])

    def _chunks_of(self, data: np.ndarray, offsets: np.ndarray):
        """(start, row and place in the list of distinct chunks of each word; ids and number of ids of the distinct chunks)."""
        start, end, row = word_spans(data, offsets)
        code, _ = pd.factorize(hash_spans(data, start, end))
        first = np.full(code.max() + 1 if len(code) else 0, -1, np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        lo = int(offsets[0])
        raw = data[lo : int(offsets[-1])].tobytes()
        ids, count = self.chunks([raw[a:b].decode() for a, b in zip((start[first] - lo).tolist(), (end[first] - lo).tolist(), strict=True)])
        return start, row, code, ids, count

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row) of the rows that offsets delimit."""
        _, row, code, ids, count = self._chunks_of(data, offsets)
        begin, each = np.cumsum(count) - count, count[code]
        return ragged_take(ids, begin[code], each), np.bincount(row, weights=each, minlength=len(offsets) - 1).astype(np.int64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte start, number of ids) of each word of the rows that offsets delimit."""
        start, _, code, _, count = self._chunks_of(data, offsets)
        return start, count[code]


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # lower case letter by letter, so no final sigma


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's own encoder for a tokenizer file."""
    if ("numpy", path) not in _ENCODERS:
        _ENCODERS["numpy", path] = TextEncoder(WordBpe(path))
    return _ENCODERS["numpy", path]


def list_array(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", tokens: str = "tokens", decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """docs with `tokens` (array<int>) and, if named, `decoded` (the text that decode() gives for them).

    All other columns pass through; a clashing name of a new column gets underscores at its end.
    """
    path = path or default_path()
    tokens = spare_name(docs, tokens)
    decoded = decoded and spare_name(docs, decoded)
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    fields = [*kept, T.StructField(tokens, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets, TEXT_SLICE):
                ids, count = own.slice(data, offsets[i : j + 1])
                columns = [batch.column(n).slice(i, j - i) for n in names] + [list_array(ids, count)]
                if decoded:
                    columns.append(own.bpe.decode_rows(ids, count))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def decode(rows: DataFrame, path: str | None = None, tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """rows with the text of their token ids; null ids give the empty text."""
    path = path or default_path()
    decoded = spare_name(rows, decoded)
    schema = T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path).bpe
        for batch in batches:
            column = batch.column(tokens)
            count = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
            ids = np.array(pa.compute.list_flatten(column), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_rows(ids, count)], schema.names)

    return rows.mapInArrow(run, schema)
