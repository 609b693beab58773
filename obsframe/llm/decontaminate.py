"""Operator 4: benchmark decontamination with a generalised suffix automaton of the test items' words.

Texts are lower-cased (A-Z) and cut into words. The automaton is over words, one for all items; a document's words
are streamed through it, and the longest match that ends at each word is tracked. A match of `window` words, or a
whole item of fewer words, is a hit. Long hits, or hits that cover too much of a document, can be removed. Only runs of
words in which each neighbouring pair occurs in some item are streamed: no match can leave such a run.

The automaton lives on each executor, so its size is bounded: items are dealt into as many groups as keep each below
ITEM_CHARS characters (a longer item is cut into pieces that share window - 1 words). With several groups, one pass
over the documents tells, by hashes of all windows, those that can hold any hit, without loss; only these few meet the
groups one after the other, and hits are judged together in the end. Results do not depend on the grouping.

Nulls: a null text or item has no words. An item without words has no window. Repeated items with one id count once;
repeated documents, and rows with a null or repeated id, are judged alike, each by its own text. Very long texts are
judged whole. Empty tables give no hits and no rows. Other columns are never read by `contamination`, and kept as they
are by `decontaminate`.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import bound_batches, materialize, spread

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM_CHARS = 1_000_000
#: Groups that are met between two written tables, and bits of the table of windows at most (beyond, more documents than
#: need be meet the groups; none is lost).
CHAIN, MOST_BITS = 4, 28


def normalised_words(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []  # bytes.lower() changes A-Z only


class WordAutomaton:
    """Generalised suffix automaton of (item id, words) pairs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        pairs = [a * len(self.vocabulary) + b for _, c in coded for a, b in itertools.pairwise(c)]
        #: Neighbouring words of items, each pair as one number; sorted.
        self.pairs = np.unique(np.array(pairs, np.int64))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        #: For each state, the state on its suffix path that holds its last `window` words.
        self.at_window = [-1] * len(self.next)
        for s in order[1:]:
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[self.link[s]] < window else self.at_window[self.link[s]]
        self.items: dict[int, set] = {}
        short: dict[int, list] = {}
        for item, codes in coded:
            state = 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                if n >= window:
                    self.items.setdefault(self.at_window[state], set()).add(item)
            if len(codes) < window:
                while self.length[self.link[state]] >= len(codes):
                    state = self.link[state]
                short.setdefault(state, []).append((len(codes), item))
        #: For each state, whole items of fewer words that end there.
        self.short: dict[int, list] = {}
        if short:
            for s in order[1:]:
                if found := short.get(s, []) + self.short.get(self.link[s], []):
                    self.short[s] = found

    def _add(self, length: int, link: int, to: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(to)
        return len(self.next) - 1

    def _split(self, state: int, c: int) -> int:
        """The state for state's longest string and c, cut off from longer strings."""
        q = self.next[state][c]
        if self.length[q] == self.length[state] + 1:
            return q
        copy = self._add(self.length[state] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while state >= 0 and self.next[state].get(c) == q:
            self.next[state][c] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _runs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the words, and begins and ends of the runs that a match can lie in."""
        codes = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
        inside = codes >= 0
        if self.shortest > 1:  # whether a word and the next are neighbours in an item
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            inside = inside[:-1] & inside[1:] & (self.pairs[at] == pair) if len(self.pairs) else np.zeros(0, bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2] + (self.shortest > 1)
        long = end - begin >= self.shortest
        return codes, begin[long], end[long]

    def matches(self, words: list[bytes]):
        """(place of the last word, longest matching length, state) wherever a window may end."""
        codes, begins, ends = self._runs(words)
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            state = length = 0
            for at, c in enumerate(codes[begin:end].tolist(), begin):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    length += 1
                else:
                    state = length = 0
                if length >= self.shortest:
                    yield at, length, state

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [first, last, whole] of hit words, and the items that have windows there. whole is 1 for items of fewer
        words than a window; spans of either kind are merged."""
        spans: list[list[int]] = []
        found: set = set()
        for at, length, state in self.matches(words):
            if length >= self.window:
                found |= self.items[self.at_window[state]]
                spans.append([at - self.window + 1, at, 0])
            for n, item in self.short.get(state, ()):
                if n <= length:
                    found.add(item)
                    spans.append([at - n + 1, at, 1])
        return _by_kind(spans), found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans [first, last] of either kind in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _by_kind(spans: list[list[int]]) -> list[list[int]]:
    return [[a, b, kind] for kind in (0, 1) for a, b in _merged([s for s in spans if s[2] == kind])]


def _to_cut(spans: list[list[int]], limit: int) -> list[list[int]]:
    """Hit stretches of at least `limit` words, and whole short items at any length."""
    return _merged([[a, b, 0] for a, b in _merged(spans) if b - a + 1 >= limit] + [s for s in spans if s[2]])


class WindowSieve:
    """A table of bits of the hashes of all windows, and of whole short items: what misses it holds no hit."""

    def __init__(self, groups: list[list], window: int):
        import xxhash

        self._hash = xxhash.xxh64_intdigest
        hashes: dict[int, list] = {}
        for items in groups:
            for words in map(normalised_words, (t for _, t in items)):
                if words:
                    n = min(len(words), window)
                    hashes.setdefault(n, []).append(self._windows(self._codes(words), n))
        flat = {n: np.concatenate(h) for n, h in hashes.items()}
        self.shift = np.uint64(64 - min(MOST_BITS, max(10, 5 + int(sum(map(len, flat.values()))).bit_length())))
        self.tables = {}
        for n, h in flat.items():
            self.tables[n] = np.zeros(1 << int(64 - self.shift) >> 3, np.uint8)
            at = h >> self.shift
            np.bitwise_or.at(self.tables[n], (at >> np.uint64(3)).view(np.int64), np.left_shift(1, (at & np.uint64(7)).view(np.int64)).astype(np.uint8))

    def _codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._hash, words), np.uint64, len(words))

    @staticmethod
    def _windows(codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
        for k in range(n):
            out = (out ^ codes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xD6E8FEB86659FD93)

    def may_hit(self, words: list[bytes]) -> bool:
        codes = self._codes(words)
        for n, table in self.tables.items():
            at = self._windows(codes, n) >> self.shift
            if np.any(table[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1):
                return True
        return False


_built: list = [None, None, None]


def _automaton(shared, window: int) -> WordAutomaton:
    """Built once in each worker from the broadcast items; the items are kept beside it, so that identity tells them."""
    items = shared.value
    if _built[0] is not items or _built[1] != window:
        _built[:] = items, window, WordAutomaton([(i, normalised_words(t)) for i, t in items], window)
    return _built[2]


def _pieces(text: str, most: int, window: int):
    """A text of no more than `most` characters as it is, a longer one as pieces that share window - 1 words."""
    if len(text) <= most:
        yield text
        return
    words = [w.decode("utf-8", "replace") for w in normalised_words(text)]
    begin = 0
    while True:
        end, size = begin, 0
        while end < len(words) and (size < most or end - begin < 2 * window):
            size += len(words[end]) + 1
            end += 1
        yield " ".join(words[begin:end])
        if end == len(words):
            return
        begin = end - window + 1


def _item_groups(items: DataFrame, id_col: str, text_col: str, item_chars: int, window: int) -> tuple[list, object]:
    """Broadcast lists of (id, text), each of about item_chars characters at most, and with several, their sieve."""
    spark = items.sparkSession
    groups, size = [[]], 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        for piece in _pieces(row["t"], item_chars, window):
            if groups[-1] and size + len(piece) > item_chars:
                groups.append([])
                size = 0
            groups[-1].append((row["i"], piece))
            size += len(piece) + 8
    sieve = spark.sparkContext.broadcast(WindowSieve(groups, window)) if len(groups) > 1 else None
    return [spark.sparkContext.broadcast(g) for g in groups], sieve


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_STATE = "doc_id long, text string, n_words long, n_hit long, spans array<array<long>>, items array<string>"
_STATE_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]


def _state(rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_STATE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], ["doc_id", "text", "n_words", "n_hit", "spans", "items"])


def _sieved(sieve):
    """doc_id and text as they come; texts without any hit are dropped, their words counted."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised_words(text)
                rows.append((i, text if sieve.value.may_hit(words) else None, len(words), 0, [], []))
            yield _state(rows)

    return run


def _scan(shared, window: int, last: bool):
    """Hits of a group of items in doc_id and text, or beside those of other groups."""

    def run(batches):
        auto = _automaton(shared, window)
        for batch in batches:
            rows = []
            for i, text, *before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before and text is None:
                    rows.append((i, None, *before))
                    continue
                words = normalised_words(text)
                spans, found = auto.hits(words)
                items = sorted(map(str, found))
                if before:
                    spans, items = _by_kind(spans + before[2]), sorted({*items, *before[3]})
                rows.append((i, None if last else text, len(words), sum(b - a + 1 for a, b in _merged(spans)), spans, items))
            yield _state(rows)

    return run


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (first and last word of each hit stretch, and 1 for whole items of fewer words than
    a window, which are listed apart), items (ids as strings, sorted)."""
    groups, sieve = _item_groups(items, item_id, item_text, item_chars, window)
    rows = spread(bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    if sieve is not None:
        rows = materialize(rows.mapInArrow(_sieved(sieve), _STATE), "sieved")
    for k, shared in enumerate(groups, 1):
        rows = rows.mapInArrow(_scan(shared, window, k == len(groups)), _STATE)
        if k % CHAIN == 0 and k < len(groups):
            rows = materialize(rows, "scanned")
    return rows.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of contamination()."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, span_limit: int = 10, coverage_limit: float = 0.5,
    text_col: str = "text", chars_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """docs with hit stretches of span_limit words or more, and whole items of fewer words than a window, cut out of the
    text; documents of which hits (of any length) cover more than coverage_limit of the words are dropped. Clean rows
    stay exactly as they are; chars_col, if there, follows the text. Several groups of items find their hits in the text
    as it came; it is judged and cut once."""
    groups, sieve = _item_groups(items, item_id, item_text, item_chars, window)
    width = len(docs.columns)
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1
    schema = T.StructType([*docs.schema.fields, T.StructField("_".join(["spans", *docs.columns]), _SPANS)])
    rows = spread(bound_batches(docs))
    clean = rows.mapInArrow(_sifted(sieve, text_at, False), docs.schema) if sieve is not None else None
    if sieve is not None:
        rows = materialize(rows.mapInArrow(_sifted(sieve, text_at, True), docs.schema), "sifted")
    for k, shared in enumerate(groups[:-1], 1):
        rows = rows.mapInArrow(_finder(shared, window, text_at, width, schema.names[-1]), schema)
        if k % CHAIN == 0:
            rows = materialize(rows, "found")
    out = rows.mapInArrow(_cutter(groups[-1], window, span_limit, coverage_limit, text_at, chars_at, width), docs.schema)
    return out if clean is None else clean.union(out)  # one schema


def _sifted(sieve, text_at: int, hit: bool):
    """Rows whose texts can hold a hit, or the others."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([sieve.value.may_hit(normalised_words(t)) == hit for t in batch.column(text_at).to_pylist()], pa.bool_()))

    return run


def _earlier(batch, width) -> list:
    """The spans that earlier groups of items found, in the column after those of the documents."""
    return batch.column(width).to_pylist() if batch.num_columns > width else [[]] * batch.num_rows


def _finder(shared, window, text_at, width, name):
    def run(batches):
        auto = _automaton(shared, window)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            spans = [_by_kind(s + auto.hits(normalised_words(t))[0]) for s, t in zip(_earlier(batch, width), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(spans, pa.list_(pa.list_(pa.int64())))], [*batch.schema.names[:width], name])

    return run


def _cutter(shared, window, span_limit, coverage_limit, text_at, chars_at, width):
    def run(batches):
        auto = _automaton(shared, window)
        for batch in batches:
            earlier = _earlier(batch, width)
            batch = batch.select(range(width))
            texts, keep, changed = batch.column(text_at).to_pylist(), [], False
            for k, text in enumerate(texts):
                words = normalised_words(text)
                spans = earlier[k] + auto.hits(words)[0]
                keep.append(sum(b - a + 1 for a, b in _merged(spans)) <= coverage_limit * len(words))
                cut = _to_cut(spans, span_limit)
                if cut and keep[-1]:
                    raw = text.encode("utf-8", "replace")
                    at = [m.span() for m in WORDS.finditer(raw.lower())]
                    pieces, low = [], 0
                    for a, b in cut:
                        pieces.append(raw[low : at[a][0]])
                        low = at[b][1]
                    texts[k], changed = b"".join([*pieces, raw[low:]]).decode("utf-8", "replace"), True
            columns = list(batch.columns)
            if changed:
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                if chars_at >= 0:
                    columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return run
