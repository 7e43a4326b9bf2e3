"""Operator 7: token counts that follow edits.

Every document has a segment tree over its pre-token segments, kept as a table: `build()` encodes the
texts once and returns them with the trees' leaves, `apply_edits()` takes rows of that table with
edits and returns them with texts, leaves and counts brought up to date, so its result is the table
for the next edits.  No text is encoded again but for the regions that edits touch.

A leaf is a white-space-delimited piece with the white space after it (so every pre-token lies in one
leaf; white space at the start of a text is a leaf too), held as its number of characters and of
tokens; inner nodes are the sums of their subtrees and are added up from the leaves when a tree is
loaded.  An edit replaces characters [start, stop) by a text: the leaves that it touches are found by
descending on character sums; their text after the edit, with the boundary context that the change
can reach (the rest of the touched leaves, and following leaves as long as no white space ends the
region), is encoded again; and the sums on the paths to the root are updated.  Tokens never span
white space, so the root's count equals that of encoding the whole edited text.

Edits of a document apply in the order of its array, each to the text that the one before left.
Positions are code points and are clamped to the text; start > stop counts as start = stop; a null
edit is skipped, null positions are 0, null replacements are empty, null edits are none; null text is
the empty text.  Rows with repeated or null ids are documents of their own.  Everything is map-only:
a task holds one slice of texts and their trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.bpe import default_path
from furrow.llm.common import narrow, slices, spare_name, utf8, wide
from furrow.llm.library_tokens import encoder

_LEAF = regex.compile(r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+")
_BLANK = frozenset(" \t\n\v\f\r")
_RESPLIT_CHARS = 4096
LEAVES = ("leaf_chars", "leaf_tokens")
COUNTS = ("n_tokens_before", "n_tokens", "n_chars_after", "n_chars_encoded")
Count = Callable[[list[str]], np.ndarray]


class TokenTree:
    """Segment tree of one document; `count` gives the token counts of a list of texts."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, count: Count):
        self.text, self.count, self.encoded_chars = text, count, 0
        self._build(chars, tokens)

    @classmethod
    def of(cls, text: str, count: Count) -> TokenTree:
        leaves = _LEAF.findall(text)
        return cls(text, np.array([len(x) for x in leaves], np.int64), count(leaves), count)

    def _build(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = max(len(chars), 1)
        self.size = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)  # of node i: characters, tokens; children 2i, 2i+1
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        at = self.size
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(at // 2, 2, 2).sum(1)
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> np.ndarray:
        """(characters, tokens) of the leaves that have text."""
        own = self.sums[self.size : self.size + self.n]
        return own[own[:, 0] > 0]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds character `at`, where it begins)."""
        node, begin, sums = 1, 0, self.sums
        while node < self.size:
            left = int(sums[2 * node, 0])
            if at - begin < left:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        return node - self.size, begin

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def plan(self, start: int, stop: int, new: str) -> tuple[int, int, int, int, str] | None:
        """(first leaf, last leaf, first character, character after the last, their text after the edit), None if nothing changes."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if start == stop and not new:
            return None
        if not n:
            return 0, 0, 0, 0, new
        first, begin = self.find(min(start, n - 1))  # an appended word joins an unfinished one
        last, end = self.find(max(min(stop, n) - 1, start)) if stop > start else (first, begin)
        end += int(self.sums[last + self.size, 0])
        region = self.text[begin:start] + new + self.text[stop:end]
        while region and region[-1] not in _BLANK and end < n:
            last, _ = self.find(end)
            size = int(self.sums[last + self.size, 0])
            region += self.text[end : end + size]
            end += size
        return first, last, begin, end, region

    def apply(self, plan: tuple[int, int, int, int, str], tokens: int) -> None:
        """Carry out a plan whose text has that many tokens."""
        first, last, begin, end, region = plan
        self.encoded_chars += len(region)
        self.text = self.text[:begin] + region + self.text[end:]
        self._set(first, len(region), tokens)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)
        if len(region) > _RESPLIT_CHARS:  # so that later edits of a long insertion find small leaves
            parts = _LEAF.findall(region)
            own = self.sums[self.size : self.size + self.n]
            inside = np.stack([[len(x) for x in parts], self.count(parts)], axis=1)
            self._build(*np.concatenate([own[:first], inside, own[last + 1 :]]).T)

    def edit(self, start: int, stop: int, new: str) -> None:
        if (plan := self.plan(start, stop, new)) is not None:
            self.apply(plan, int(self.count([plan[4]])[0]))


def _counter(path: str) -> Count:
    own = encoder(path)

    def count(texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        return own.slice(*utf8(pa.array(texts, pa.large_string())))[1]

    return count


def build(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with leaf_chars and leaf_tokens (binary, numbers as narrow() packs them): the segment tree of each text.

    Clashing names get underscores.
    """
    path = path or default_path()
    names = [spare_name(docs, n) for n in LEAVES]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.BinaryType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets):
                per_row, *leaves = leaves_of(own, data, offsets[i : j + 1])
                cuts = np.cumsum(per_row)[:-1]
                packed = [pa.array([narrow(x) for x in np.split(each, cuts)], pa.binary()) for each in leaves]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *packed], schema.names)

    return docs.mapInArrow(run, schema)


def leaves_of(own, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of leaves of each row, characters and tokens of all leaves) of the rows that offsets delimit."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    start, each = own.words(data, offsets)
    rows = offsets[:-1][np.diff(offsets) > 0]
    at = np.union1d(rows, start)
    tokens = np.zeros(len(at), np.int64)
    tokens[np.searchsorted(at, start)] = each
    points = np.r_[0, np.cumsum((data[lo:hi] & 0xC0) != 0x80)]
    chars = np.diff(points[np.r_[at, hi] - lo]) if len(at) else np.empty(0, np.int64)
    return np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=len(offsets) - 1), chars, tokens


def apply_edits(trees: DataFrame, path: str | None = None, text: str = "text", edits: str = "edits", leaves: tuple[str, str] = LEAVES, keep: list[str] | None = None) -> DataFrame:
    """Rows of build()'s table with their edits carried out, and COUNTS: tokens before and after, characters after,
    and characters encoded again.

    `edits` is array<struct<start: int or long, stop: int or long, text: string>>.  keep: only these
    columns and COUNTS; else all, with text and leaves as the edits leave them.  Clashing names get underscores.
    """
    path = path or default_path()
    kept = [f for f in trees.schema.fields if keep is None or f.name in keep]
    added = [spare_name(trees, n) for n in COUNTS]
    schema = T.StructType(kept + [T.StructField(n, T.LongType()) for n in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            for i, j in slices(utf8(batch.column(text))[1]):
                yield one(batch.slice(i, j - i), count)

    def one(part: pa.RecordBatch, count: Count) -> pa.RecordBatch:
        texts = ["" if x is None else x for x in part.column(text).to_pylist()]
        columns = [part.column(c).to_pylist() for c in leaves]
        trees_ = [TokenTree(x, wide(c), wide(t), count) for x, c, t in zip(texts, *columns, strict=True)]
        before = [t.tokens for t in trees_]
        queues = [[e for e in changes or [] if e is not None] for changes in part.column(edits).to_pylist()]
        for nth in range(max(map(len, queues), default=0)):  # the nth edits of all documents are encoded together
            due = [(t, t.plan(q[nth]["start"] or 0, q[nth]["stop"] or 0, q[nth]["text"] or "")) for t, q in zip(trees_, queues, strict=True) if len(q) > nth]
            due = [(t, p) for t, p in due if p is not None]
            for (t, p), n in zip(due, count([p[4] for _, p in due]).tolist(), strict=True):
                t.apply(p, n)
        columns = []
        for f in kept:
            if f.name == text:
                columns.append(pa.array([t.text for t in trees_], pa.string()))
            elif f.name in leaves:
                columns.append(pa.array([narrow(t.leaves()[:, leaves.index(f.name)]) for t in trees_], pa.binary()))
            else:
                columns.append(part.column(f.name))
        numbers = [before, [t.tokens for t in trees_], [len(t.text) for t in trees_], [t.encoded_chars for t in trees_]]
        return pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in numbers], schema.names)

    return trees.mapInArrow(run, schema)
