"""Operator 9: secret scan with inferred grammars.

Base rules find assignments, access keys and hex runs by pattern.  On top of them the method learns
formats.  Labelled credentials of a kind make a prefix tree, which is folded into a probabilistic
automaton by merging states whose observed frequencies are statistically compatible (Hoeffding
bound, red-blue order, the best explaining of several).  Kinds are

* `like_assign`, `like_access`, `like_hex`: learned from the corpus' own credentials, which the base
  rules label (the value of an assignment, the whole of the others);
* the public formats of FORMATS, learned from seeded strings.

Every candidate is scored by its log likelihood under each automaton less that under a character
model of the corpus, per character.  Candidates are the base spans' strings, and every stretch of 16
or more characters of a maximal run of credential characters (dots at its ends cut): a stretch starts
anywhere and goes on while its automaton knows the next character; of those that end at one place in
one state the likeliest start is taken, of the ends of a start the last that passes.  So a credential
is found behind `NAME=` or inside a URL.  A stretch is added under the automaton's name, best score
first and free of overlaps, if it overlaps no base span, is as likely under the automaton as its
held-out credentials (less SLACK), and its score passes the kind's threshold: the least of the
held-out ones, but above that of ORDINARY strings drawn from the character model.

Base spans always stay; `score` and `format` say which automaton explains a span best.  Positions are
code points, end exclusive.  Null text is the empty text; repeated rows and ids are scanned each on
their own; other columns, null or not, are left alone.

Two passes over whole texts, without samples of documents.  The first counts byte pairs of all text
outside base spans and runs that hold a public format, and collects the labelled strings; each distinct one counts once, and of each kind
the TRAINING + HELD_OUT of the smallest hash are used (the bound on labelled rows; a kind with fewer
than MIN_LABELLED is not learned).  The second scans.  What reaches the driver is 65,536 pair counts
and the bounded sample; an automaton has some tens of states.  Rows without a match pass through as
they are.
"""

from __future__ import annotations

import heapq
import itertools
import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import runs, slices, spare_name, utf8, written

# The base rules and their order.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

MIN_RUN = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
TRAINING, HELD_OUT, MIN_LABELLED, ALPHA = 1000, 100, 50, 0.01
ORDINARY, MARGIN, SLACK, SMOOTHING = 1000, 0.25, 0.1, 200
FLOOR = math.log(1e-4)
CACHED, CACHED_CHARS = 20_000, 256
_LOWER, _UPPER, _ALNUM = string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in _ALNUM + "+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True

# Public credential formats from which labelled strings are drawn: (literal prefix, alphabet, length) parts.
FORMATS = {
    "forge_token": [("ghp_", _ALNUM, 36)],
    "chat_token": [("xoxb-", string.digits, 12), ("-", string.digits, 12), ("-", _ALNUM, 24)],
    "payment_key": [("sk_live_", _ALNUM, 24)],
    "maps_key": [("AIza", _ALNUM + "-_", 35)],
    "web_token": [("eyJ", _ALNUM + "-_", 33), (".eyJ", _ALNUM + "-_", 40), (".", _ALNUM + "-_", 43)],
}


def labelled_credentials(n: int = TRAINING, seed: int = 5) -> dict[str, list[str]]:
    """Seeded labelled strings of each public format."""
    rng = random.Random(seed)
    return {k: ["".join(p + "".join(rng.choices(a, k=m)) for p, a, m in parts) for _ in range(n)] for k, parts in FORMATS.items()}


class Automaton:
    """Probabilistic deterministic automaton inferred from strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.visits, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for ch in s:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.seen.append(Counter())
                    self.visits.append(0)
                    self.ends.append(0)
                self.seen[at][ch] += 1
                at = self.next[at][ch]
                self.visits[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._keep(self._merge_states())
        self.logs = [{c: math.log(n / max(v, 1)) for c, n in seen.items()} for seen, v in zip(self.seen, self.visits, strict=True)]
        self.stop = [math.log(e / max(v, 1)) if e else FLOOR for e, v in zip(self.ends, self.visits, strict=True)]
        at, self.prefix = 0, ""  # what every string that is followed without an unknown character begins with
        while len(self.next[at]) == 1 and not self.ends[at] and len(self.prefix) < len(self.next):
            ((c, at),) = self.next[at].items()
            self.prefix += c

    def _merge_states(self) -> list[int]:
        """Red states are final; a blue one (child of a red one) is merged into a red one or becomes red, often visited ones first."""
        red, is_red = [0], {0}
        blue = [(-self.visits[b], b, 0, c) for c, b in self.next[0].items()]
        heapq.heapify(blue)
        while blue:
            _, b, parent, ch = heapq.heappop(blue)
            fitting = [r for r in red if self._compatible(r, b)]
            if fitting:  # rare states are compatible with many: the one that explains their strings best takes them
                r = max(fitting, key=lambda r: self._fit(r, b)) if len(fitting) > 1 else fitting[0]
                self.next[parent][ch] = r
                for owner, c, child in self._fold(r, b):
                    if owner in is_red:
                        heapq.heappush(blue, (-self.visits[child], child, owner, c))
            else:
                red.append(b)
                is_red.add(b)
                for c, child in self.next[b].items():
                    heapq.heappush(blue, (-self.visits[child], child, b, c))
        return red

    def _keep(self, red: list[int]) -> None:
        """Number the merged states anew and drop the rest of the tree."""
        index = {r: i for i, r in enumerate(red)}
        self.next = [{c: index[to] for c, to in self.next[r].items()} for r in red]
        self.visits, self.ends, self.seen = ([x[r] for r in red] for x in (self.visits, self.ends, self.seen))

    def _fit(self, a: int, b: int) -> float:
        """Log likelihood of the strings below b under the automaton from a."""
        todo, total = [(a, b)], 0.0
        while todo:
            a, b = todo.pop()
            n = self.visits[a]
            if self.ends[b]:
                total += self.ends[b] * (math.log(self.ends[a] / n) if self.ends[a] else FLOOR)
            for c, m in self.seen[b].items():
                total += m * (math.log(self.seen[a][c] / n) if self.seen[a][c] else FLOOR)
                todo.append((self.next[a].get(c, a), self.next[b][c]))
        return total

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.visits[a], self.visits[b]
            if a == b or not n1 or not n2:
                continue
            least = self.bound * (n1**-0.5 + n2**-0.5)
            if least > 1:  # frequencies differ by 1 at most, here and, visited less often, further down
                continue
            if abs(self.ends[a] / n1 - self.ends[b] / n2) >= least:
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][c] / n1 - self.seen[b][c] / n2) >= least:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> list[tuple[int, str, int]]:
        """Add the subtree at b to the automaton at a; (state, character, child) of the transitions that are new."""
        todo, new = [(a, b)], []
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            self.seen[a].update(self.seen[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child
                    new.append((a, c, child))
        return new

    def log_likelihood(self, s: str) -> float:
        at, total = 0, 0.0
        for c in s:
            total += self.logs[at].get(c, FLOOR)
            at = self.next[at].get(c, at)
        return total + self.stop[at]

    def mean(self, s: str) -> float:
        return self.log_likelihood(s) / len(s)

    def stretches(self, s: str, least: float) -> Iterator[tuple[int, int, float]]:
        """(start, end, log likelihood) of stretches of s with known characters only and a mean of at least `least`.

        Of stretches that meet in a state, only the one furthest above `least` is followed: whatever
        comes next adds the same to all of them.
        """
        if self.prefix not in s:
            return
        paths: dict[int, tuple[float, int]] = {}
        i = s.find(self.prefix)
        while 0 <= i < len(s):
            if s.startswith(self.prefix, i) and (0 not in paths or paths[0][0] < 0):
                paths[0] = (0.0, i)
            c, onward = s[i], {}
            for at, (above, start) in paths.items():
                step = self.logs[at].get(c)
                if step is not None:
                    above, to = above + step - least, self.next[at][c]
                    if to not in onward or onward[to][0] < above:
                        onward[to] = (above, start)
            paths, i = onward, i + 1
            for at, (above, start) in paths.items():
                if i - start >= MIN_RUN and self.ends[at] and above + self.stop[at] >= 0:
                    yield start, i, above + least * (i - start) + self.stop[at]
            if not paths:
                i = s.find(self.prefix, i)


@lru_cache(maxsize=4)
def _public(alpha: float) -> dict[str, Automaton]:
    return {k: Automaton(v, alpha) for k, v in labelled_credentials(TRAINING).items()}


@lru_cache(maxsize=4)
def _least(alpha: float) -> dict[str, float]:
    """The least mean log likelihood of each public format's held-out strings, less SLACK."""
    held = labelled_credentials(HELD_OUT, seed=6)
    return {k: min(map(a.mean, held[k])) - SLACK for k, a in _public(alpha).items()}


class CharacterModel:
    """Log probability of a character after another in ordinary text, from byte pair counts (256 x 256)."""

    def __init__(self, pairs: np.ndarray):
        alone = (pairs.sum(0)[:128] + 1) / (pairs.sum() + 128)  # what rare predecessors fall back to
        self.logs = np.log((pairs[:128, :128] + SMOOTHING * alone) / (pairs[:128].sum(1, keepdims=True) + SMOOTHING))

    def sums(self, s: str) -> np.ndarray:
        """Log probability of the first 0, 1, ... characters of s after a space."""
        b = np.frombuffer(b" " + s.encode("ascii"), np.uint8)
        return np.r_[0.0, np.cumsum(self.logs[b[:-1], b[1:]])]

    def mean(self, s: str, a: int, b: int, sums: np.ndarray) -> float:
        """Per character, of s[a:b] after a space."""
        return float(self.logs[32, ord(s[a])] + sums[b] - sums[a + 1]) / (b - a)

    def draw(self, lengths: list[int], seed: int = 9) -> list[str]:
        """A string of credential characters of each length, as the model makes them."""
        own = np.flatnonzero(_RUN[:128])
        p = np.exp(self.logs[:, own])
        p = np.cumsum(p / p.sum(1, keepdims=True), axis=1)
        rng, out = np.random.default_rng(seed), []
        for n in lengths:
            at, s = 32, []
            for u in rng.random(n).tolist():
                at = int(own[min(int(np.searchsorted(p[at], u)), len(own) - 1)])
                s.append(chr(at))
            out.append("".join(s))
        return out


class Scanner:
    """Base rules, automata, character model and thresholds."""

    def __init__(self, pairs: np.ndarray, labelled: dict[str, list[str]] | None = None, alpha: float = ALPHA):
        """pairs: byte pair counts of ordinary text; labelled: strings of the base kinds in order of their hash."""
        self.model = CharacterModel(pairs)
        self.automata = {f"like_{k}": Automaton(v[: len(v) - len(v) // 11], alpha) for k, v in sorted((labelled or {}).items()) if len(v) >= MIN_LABELLED}
        held = {f"like_{k}": v[len(v) - len(v) // 11 :] for k, v in (labelled or {}).items()}
        self.automata |= _public(alpha)
        held |= labelled_credentials(HELD_OUT, seed=6)
        self.least, self.limits = {}, {}
        for k, a in self.automata.items():
            self.least[k] = min(map(a.mean, held[k])) - SLACK
            ordinary = self.model.draw([max(len(held[k][i % len(held[k])]), MIN_RUN) for i in range(ORDINARY)])
            self.limits[k] = max(min(self._score(a, s) for s in held[k]), max(self._score(a, s) for s in ordinary) + MARGIN)
        self.kinds = (*BASE_KINDS, *self.automata)
        self._known: dict[str, list] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    @classmethod
    def over(cls, docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> Scanner:
        """The scanner that the texts of docs teach."""

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, found = np.zeros(1 << 16, np.int64), set()
            for batch in batches:
                data, offsets = utf8(batch.column(0))
                for i, j in slices(offsets):
                    own, strings = learn_slice(data, offsets[i : j + 1])
                    pairs += own
                    found |= strings
            some = np.flatnonzero(pairs)
            labelled = sorted(found)
            kind = pa.array([""] * len(some) + [k for k, _ in labelled], pa.string())
            value = pa.array([str(x) for x in some.tolist()] + [v for _, v in labelled], pa.string())
            yield pa.RecordBatch.from_arrays([kind, value, pa.array(np.r_[pairs[some], np.ones(len(labelled), np.int64)])], ["kind", "value", "n"])

        learned = docs.select(F.col(text).alias("t")).mapInArrow(learn, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
        learned = written(learned, "learned")
        by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
        first = learned.where("kind <> ''").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= TRAINING + HELD_OUT)
        pairs, labelled = np.zeros(1 << 16, np.int64), defaultdict(list)
        for r in learned.where("kind = ''").collect():
            pairs[int(r.value)] = r.n
        for r in sorted(first.collect(), key=lambda r: (r.kind, r.nth)):
            labelled[r.kind].append(r.value)
        return cls(pairs.reshape(256, 256), labelled, alpha)

    def _score(self, auto: Automaton, s: str) -> float:
        return auto.mean(s) - float(self.model.sums(s)[-1]) / len(s)

    def explain(self, s: str) -> tuple[str, float]:
        """(automaton that scores s best, its score)."""
        return max(((k, self._score(a, s)) for k, a in self.automata.items()), key=lambda x: x[1])

    def _ranked(self, s: str) -> list[tuple[float, str, int, int]]:
        """(score, kind, start, end) of the stretches of a run that pass, best first."""
        if s in self._known:
            return self._known[s]
        best: dict[tuple[str, int], tuple[float, int]] = {}
        sums = None
        for k, auto in self.automata.items():
            for a, b, likelihood in auto.stretches(s, self.least[k]):
                if sums is None:
                    sums = self.model.sums(s)
                score = likelihood / (b - a) - self.model.mean(s, a, b, sums)
                if score >= self.limits[k] and s[b - 1] != ".":
                    best[k, a] = (score, b)  # ends come in order, so the last one stays
        ranked = sorted(((score, k, a, b) for (k, a), (score, b) in best.items()), reverse=True)
        if len(s) <= CACHED_CHARS:
            if len(self._known) >= CACHED:
                self._known.clear()
            self._known[s] = ranked
        return ranked

    def _found(self, base: list[tuple[str, int, int]], candidates: list[tuple[int, str]], text: str) -> list[tuple[str, int, int, float, str]]:
        """All spans of a text from its base spans and its runs (start, run)."""
        out = []
        for k, a, b in base:
            best, score = self.explain(ASSIGN.match(text, a)[2] if k == "assign" else text[a:b])
            out.append((k, a, b, score, best))
        at = 0
        for first, s in candidates:
            ranked = self._ranked(s)
            if not ranked:
                continue
            while at < len(base) and base[at][2] <= first:  # a base span that ends later comes again for the next run
                at += 1
            taken = [(a - first, b - first) for _, a, b in itertools.takewhile(lambda x: x[1] < first + len(s), base[at:])]
            for score, k, a, b in ranked:
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((k, first + a, first + b, score, k))
        return sorted(out, key=lambda x: (x[1], self.kinds.index(x[0])))

    def spans(self, text: str) -> list[tuple[str, int, int, float, str]]:
        """(kind, start, end, score, format) of one text, by start, then kind; plainly, text by text."""
        return self._found(base_spans(text), [(m.start() + len(m[0]) - len(m[0].lstrip(".")), s) for m in CANDIDATE.finditer(text) if len(s := m[0].strip(".")) >= MIN_RUN], text)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int, float, str]]]:
        """spans() of those rows of a slice that have any: bytes are looked at first, texts only where there is something to find."""
        lo = int(offsets[0])
        raw = data[lo : int(offsets[-1])]
        start, end = runs(_RUN[raw], offsets)
        some = np.flatnonzero(end - start >= MIN_RUN)
        row = np.searchsorted(offsets, start[some], "right") - 1
        plain, rows = raw.tobytes(), _hinted_rows(raw, offsets)
        for r, a, b in zip(row.tolist(), (start[some] - lo).tolist(), (end[some] - lo).tolist(), strict=True):
            if r not in rows and self._ranked(plain[a:b].decode("ascii").strip(".")):
                rows.add(r)
        found = {r: self.spans(plain[int(offsets[r]) - lo : int(offsets[r + 1]) - lo].decode()) for r in sorted(rows)}
        return {r: each for r, each in found.items() if each}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules by start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], BASE_KINDS.index(x[0])))


def _hinted_rows(raw: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows of a slice that may hold a base span: a long hex run, an access key's start, or a keyword in any case."""
    bounds = offsets - offsets[0]
    start, end = runs(_HEX[raw], offsets)
    rows = set((np.searchsorted(offsets, start[end - start >= 16], "right") - 1).tolist())
    plain = raw.tobytes()
    low = plain.lower()
    for word, where in ((b"AKIA", plain), *((k, low) for k in KEYWORDS)):
        at = where.find(word)
        while at >= 0:  # the next one after this row
            r = int(np.searchsorted(bounds, at, "right")) - 1
            rows.add(r)
            at = where.find(word, int(bounds[r + 1]))
    return rows


def holds_format(s: str) -> bool:
    """Whether a stretch of the run is as likely as a public format's held-out strings."""
    return any(True for k, a in _public(ALPHA).items() for _ in a.stretches(s, _least(ALPHA)[k]))


def learn_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, set[tuple[str, str]]]:
    """(counts of 65,536 byte pairs, labelled strings as (base kind, string)) of the rows that offsets delimit.

    Pairs within a row count if neither byte lies in a base span or in a run that holds a public format.
    """
    lo = int(offsets[0])
    raw = data[lo : int(offsets[-1])]
    if len(raw) < 2:
        return np.zeros(1 << 16, np.int64), set()
    pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
    bounds = offsets - lo
    out, labelled = [bounds[(bounds > 0) & (bounds < len(raw))] - 1], set()
    plain = raw.tobytes()
    for r in _hinted_rows(raw, offsets):
        first = int(bounds[r])
        text = plain[first : int(bounds[r + 1])].decode()
        for k, a, b in base_spans(text):
            labelled.add((k, ASSIGN.match(text, a)[2] if k == "assign" else text[a:b]))
            at = first + (a if text.isascii() else len(text[:a].encode()))
            out.append(np.arange(max(at - 1, 0), min(at + b - a, len(pair))))
    start, end = runs(_RUN[raw], offsets)
    some = end - start >= MIN_RUN
    for a, b in zip((start[some] - lo).tolist(), (end[some] - lo).tolist(), strict=True):
        if holds_format(plain[a:b].decode("ascii")):
            out.append(np.arange(max(a - 1, 0), min(b, len(pair))))
    return np.bincount(pair, minlength=1 << 16) - np.bincount(pair[np.unique(np.concatenate(out))], minlength=1 << 16), labelled


_SPAN = (("kind", T.StringType(), pa.string()), ("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("score", T.DoubleType(), pa.float64()), ("format", T.StringType(), pa.string()))
SPANS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _SPAN]))


def _span_array(found: dict[int, list[tuple]], n: int) -> pa.Array:
    count = np.zeros(n, np.int32)
    for r, each in found.items():
        count[r] = len(each)
    flat = [s for r in sorted(found) for s in found[r]]
    fields = [pa.array([s[i] for s in flat], t) for i, (_, _, t) in enumerate(_SPAN)]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.StructArray.from_arrays(fields, [name for name, _, _ in _SPAN]))


def scan(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, redact_with: str | None = None) -> DataFrame:
    """docs (or only its columns `keep`) with `secrets`, an array of spans; with redact_with, `text` has each
    stretch of overlapping spans replaced by it (null texts stay null)."""
    scanner = scanner or Scanner.over(docs, text)
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]
    name = spare_name(docs, "secrets")
    schema = T.StructType([*kept, T.StructField(name, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                found = scanner.slice(data, offsets[i : j + 1])
                columns = [part.column(f.name) for f in kept]
                if redact_with is not None and found:
                    mask = np.zeros(len(part), bool)
                    mask[list(found)] = True
                    clean = pa.array([redact(part.column(text)[r].as_py(), found[r], redact_with) for r in sorted(found)], part.column(text).type)
                    columns = [pc.replace_with_mask(c, pa.array(mask), clean) if f.name == text else c for f, c in zip(kept, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, _span_array(found, len(part))], schema.names)

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, start, end, *_ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])
