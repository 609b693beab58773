"""Operator 8: removal of repeated passages by recompression.

A window is WINDOW consecutive words of one document. Words covered by a window whose words also start earlier are
removed; all windows are judged on the input.

Recompression names runs of equal words, and then, in rounds, pairs: symbols fall on one of two sides by a hash, and
a left one followed by a right one becomes a new symbol. A name is a hash of what it stands for, so equal substrings get
equal names everywhere without an exchange, but for symbols near their ends, which can pair with what stands outside.
How far that reaches into a window follows from the window's own words: a run at an end may go on outside; a first
symbol of the right side, or a last one of the left side, may pair outside. What is left inside is the consistent
interior. A window's anchor is the least hash among the triples of neighbouring symbols in its highest interior that has
three (or pairs, or single symbols; or of the window itself, when it has no interior, as in long runs): equal windows
have equal anchors. Few rounds, and joint symbols, keep anchors sparse and still telling.

1. Whole texts that repeat are found by SHA-256 of their words; only the first of each goes on.
2. Anchors that occur once in the corpus prove their windows unique. Anchors are counted with partial sums.
3. Only documents with repeated anchors are read again, in chunks of some megabytes; of their windows, only those with
   repeated anchors are hashed (128 bits), and those that repeat within a chunk are settled there, so a very common
   passage reaches the shuffle once a chunk. What is left travels as packed arrays, a row for each chunk and bucket of
   hashes; there are as many buckets as keep each at some BUCKET_WORDS words of the corpus.
4. In a bucket, all but the earliest of equal windows are marked, first among ranges of CHUNK_RANGE chunks, then among
   the earliest of each range, so that no task sees all copies of a passage. Marks go back to their chunk, each with the
   window that it repeats.
5. Neighbouring marks that repeat neighbouring windows make a span. Spans are verified on their words: by SHA-256 of
   pieces (cut where the earlier text's words have a number divisible by PIECE, so pieces are few), made from either
   text when the words are removed. Should any differ (two words or windows had equal hashes), steps 3 to 5 run again
   with SHA-256 of the windows' words in place of the hashes. Equal windows always have equal hashes, so none is lost.

Nulls: a null text has no words; a null id sorts before all others. Rows that repeat an id are ordered by a hash of the
text; rows equal in both count as one document and get the same result each. Very long texts are judged whole, as a
chunk of their own. Empty table: no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import bound_batches, by_bytes, drop, free_shuffles, materialize, partitions, spread, stored_bytes

WINDOW, ROUNDS, NEIGHBOURS = 20, 2, 3
CHUNK_BYTES = 4_000_000
BUCKET_WORDS = 1_000_000
CHUNK_RANGE, PIECE = 1024, 64
NULL_ID = -(2**63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


def _word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with a mark after each text, whether each is a mark, and where texts begin."""
    import xxhash

    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    codes = np.zeros(int(size.sum()), np.uint64)
    mark = np.zeros(len(codes), bool)
    for at, words in zip(begin.tolist(), texts, strict=True):
        codes[at : at + len(words)] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        mark[at + len(words)] = True
    return codes, mark, begin


def window_starts(mark: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places where a whole window of one text starts."""
    if len(mark) < window:
        return np.zeros(0, np.int64)
    marks = np.concatenate(([0], np.cumsum(mark)))
    return np.flatnonzero(marks[window:] == marks[:-window])


def window_hashes(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(window):
        c = codes[starts + k]
        a = a * _ODD[0] + c
        b = (b ^ c) * _ODD[1]
    return _mix(a), _mix(b)


def word_hashes(texts: list[list[bytes]], begin: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """As window_hashes, but the first 128 bits of SHA-256 of the windows' words."""
    out = np.zeros((len(starts), 2), np.uint64)
    owner = np.searchsorted(begin, starts, side="right") - 1
    for k, (o, at) in enumerate(zip(owner.tolist(), (starts - begin[owner]).tolist(), strict=True)):
        out[k] = np.frombuffer(_digest(texts[o], at, window)[:16], np.uint64)
    return out[:, 0], out[:, 1]


def _digest(words: list[bytes], at: int, n: int) -> bytes:
    return hashlib.sha256(b" ".join(words[at : at + n])).digest()


def anchors(codes: np.ndarray, mark: np.ndarray, starts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """Name and first word of each window's anchor."""
    out, where = np.zeros(len(starts), np.uint64), starts.copy()
    if not len(starts):
        return out, where
    # Runs of equal words.
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | mark[1:] | mark[:-1]
    run, place = np.cumsum(new) - 1, np.flatnonzero(new)
    length = np.diff(np.append(place, len(codes))).astype(np.uint64)
    name = np.where(length > 1, _mix(codes[place] * _ODD[1] + length), codes[place])
    mark = mark[place]
    who = np.arange(len(starts))
    low, high = run[starts] + 1, run[starts + window - 1]
    levels = []
    for level in range(rounds + 1):
        live = low < high
        who, low, high = who[live], low[live], high[live]
        levels.append((who, low, high, name, place))
        if level == rounds or not len(who):
            break
        left = (_mix(name + _ODD[2] * np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        starts_pair = np.zeros(len(name), bool)
        starts_pair[:-1] = left[:-1] & ~left[1:] & ~mark[:-1] & ~mark[1:]
        keep = np.ones(len(name), bool)
        keep[1:] = ~starts_pair[:-1]
        low = low + ~left[low]
        high = high - left[high - 1]
        index = np.cumsum(keep) - 1
        ok = low < high
        low, high = np.where(ok, index[np.minimum(low, len(index) - 1)], 0), np.where(ok, index[high - 1] + 1, 0)
        pair = np.flatnonzero(starts_pair)
        paired = name.copy()
        paired[pair] = _mix(name[pair] * _ODD[0] + _mix(name[pair + 1] + _ODD[2]) + np.uint64(level + 1))
        name, place, mark = paired[keep], place[keep], mark[keep]
    # Some neighbouring symbols of the highest level that has as many inside say most; else fewer.
    done = np.zeros(len(starts), bool)
    for wide in range(neighbours, 0, -1):
        for who, low, high, name, place in reversed(levels):
            open_ = ~done[who] & (high - low >= wide)
            who, low, high = who[open_], low[open_], high[open_] - (wide - 1)
            if not len(who):
                continue
            joint = name.copy()
            for k in range(1, wide):
                joint[:-k] = _mix(joint[:-k] * _ODD[3] + _mix(name[k:] ^ _ODD[0]))
            key, best = _mix(joint ^ _ODD[1]), low.copy()
            for k in range(1, int((high - low).max())):
                at = np.minimum(low + k, high - 1)
                best = np.where(key[at] < key[best], at, best)
            out[who], where[who], done[who] = joint[best], place[best], True
    rest = np.flatnonzero(~done)
    out[rest] = window_hashes(codes, starts[rest], window)[0]
    return out, where


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.Array:
    """One list for each of n owners, from values in owners' order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _described(window: int):
    """For each text: the digest of its words, their number, and its anchors (twice when an anchor stands in several
    places)."""

    def run(batches):
        for batch in batches:
            raws = batch.column(2).to_pylist()
            for a, b in by_bytes(raws, CHUNK_BYTES):
                texts = [(r or b"").split() for r in raws[a:b]]
                codes, mark, begin = _word_codes(texts)
                starts = window_starts(mark, window)
                name, where = anchors(codes, mark, starts, window)
                owner = np.searchsorted(begin, where, side="right") - 1
                order = np.lexsort((where, name, owner))
                name, where, owner = name[order], where[order], owner[order]
                fresh = np.ones(len(name), bool)  # another place, and no more than the second of a name in a text
                fresh[1:] = (name[1:] != name[:-1]) | (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
                name, owner = name[fresh], owner[fresh]
                few = np.ones(len(name), bool)
                few[2:] = (name[2:] != name[:-2]) | (owner[2:] != owner[:-2])
                name, owner = name[few], owner[few]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([_digest(t, 0, len(t)) for t in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(_i64(name), owner, b - a, pa.int64())], ["id", "th", "root", "n_words", "anchors"])

    return run


_INT, _LONG = pa.list_(pa.int32()), pa.list_(pa.int64())
_PACKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("h", _LONG), ("h2", _LONG), ("start", _INT), ("doc", _INT), ("ids", _LONG), ("ths", _LONG), ("counts", _INT)])
_PACK_COLUMNS = "chunk long, bucket int, h array<long>, h2 array<long>, start array<int>, doc array<int>, ids array<long>, ths array<long>, counts array<int>"
_DOCS = pa.schema([("at", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("first", _INT), ("last", _INT), ("rid", _LONG), ("rth", _LONG), ("rat", _INT)])
_DOC_COLUMNS = "at int, id long, th long, first array<int>, last array<int>, rid array<long>, rth array<long>, rat array<int>"
_MARKS = pa.schema([("chunk", pa.int64()), ("doc", _INT), ("start", _INT), ("rid", _LONG), ("rth", _LONG), ("rat", _INT)])
_MARK_COLUMNS = "chunk long, doc array<int>, start array<int>, rid array<long>, rth array<long>, rat array<int>"
_NEEDS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("first", _INT), ("last", _INT), ("at", _INT), ("n", _INT), ("rid", _LONG), ("rth", _LONG), ("rat", _INT)])
_NEED_COLUMNS = "id long, th long, first array<int>, last array<int>, at array<int>, n array<int>, rid array<long>, rth array<long>, rat array<int>"


def _spans(owner, start, rid, rth, rat):
    """Of marked windows, in order of owner and start: owner, first and last start, and the earlier window of the first,
    for each run of neighbours that repeat neighbours."""
    if not len(start):
        return owner, start, start, rid, rth, rat
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (rid[1:] != rid[:-1]) | (rth[1:] != rth[:-1]) | (rat[1:] != rat[:-1] + 1)
    head = np.flatnonzero(new)
    return owner[head], start[head], start[np.append(head[1:], len(start)) - 1], rid[head], rth[head], rat[head]


def _pieces(first, last, rat, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which span, how many words after its first, and how many words: spans cut where the earlier text's words have a
    number divisible by PIECE."""
    n = (last - first + window).astype(np.int64)
    low = rat // PIECE
    many = (rat + n - 1) // PIECE - low + 1
    span = np.repeat(np.arange(len(n)), many)
    block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[span]
    begin, end = np.maximum(block * PIECE, rat[span]), np.minimum((block + 1) * PIECE, rat[span] + n[span])
    return span, begin - rat[span], end - begin


def _packed(chunk: np.ndarray, bucket: np.ndarray, h, h2, start, doc, ids, ths) -> list[pa.Array]:
    """Columns of packs: a row for each run of a chunk and bucket, in it a text for each run of a document."""
    cut = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
    new = (np.diff(chunk, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
    run = np.flatnonzero(new)
    ends, runs = np.append(cut, len(chunk)).astype(np.int32), np.append(np.searchsorted(run, cut), len(run)).astype(np.int32)
    pack = lambda x, t, e: pa.ListArray.from_arrays(pa.array(e), pa.array(x, t))
    out = [pa.array(chunk[cut], pa.int64()), pa.array(bucket[cut], pa.int32()), pack(_i64(h), pa.int64(), ends), pack(_i64(h2), pa.int64(), ends), pack(start, pa.int32(), ends)]
    return out + [pack(doc[run], pa.int32(), runs), pack(ids[run], pa.int64(), runs), pack(ths[run], pa.int64(), runs), pack(np.diff(np.append(run, len(chunk))), pa.int32(), runs)]


def _earliest(order, h, h2) -> np.ndarray:
    """For each window, the first in order among those with equal hashes; order sorts by hashes first."""
    head = np.ones(len(order), bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.zeros(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return first


def _candidates(window: int, buckets: int, strong: bool):
    """Rows of two kinds: packs of windows to rank, by chunk and bucket, and the documents of a chunk with the spans that
    were settled in it."""

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        whole = pa.schema([*_PACKS, *_DOCS])
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.select(["id", "th"]), sort_keys=[("id", "ascending"), ("th", "ascending")]))
            raws, ids, ths = batch.column(2).to_pylist(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in by_bytes(raws, CHUNK_BYTES):
                chunk, n = chunk + 1, b - a
                texts = [(r or b"").split() for r in raws[a:b]]
                codes, mark, begin = _word_codes(texts)
                starts = window_starts(mark, window)
                known = np.unique(batch.column(3).slice(a, n).flatten().to_numpy(zero_copy_only=False))
                name = _i64(anchors(codes, mark, starts, window)[0])
                starts = starts[known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name] if len(known) else starts[:0]
                if not len(starts):
                    continue
                h, h2 = word_hashes(texts, begin, starts, window) if strong else window_hashes(codes, starts, window)
                owner = np.searchsorted(begin, starts, side="right") - 1
                # Starts are in (id, th, start) order, so the first of equal hashes is the earliest; equal rows tie.
                first = _earliest(np.lexsort((h2, h)), h, h2)
                at = (starts - begin[owner]).astype(np.int32)
                id_, th = ids[a + owner], ths[a + owner]
                tie = (id_ == id_[first]) & (th == th[first]) & (at == at[first])
                used = np.flatnonzero(np.bincount(owner, minlength=n))
                of, *spans = _spans(*(x[~tie] for x in (owner, at, id_[first], th[first], at[first])))
                lists = [_lists(x, of, n, t.value_type).take(pa.array(used)) for x, t in zip(spans, _DOCS.types[3:], strict=True)]
                docs = [pa.array(used, pa.int32()), pa.array(ids[a + used]), pa.array(ths[a + used]), *lists]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), chunk)), *[pa.nulls(len(used), t) for t in _PACKS.types[1:]], *docs], schema=whole)
                bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.flatnonzero(tie)
                order = order[np.argsort(bucket[order], kind="stable")]
                packs = _packed(np.full(len(order), chunk), *(x[order] for x in (bucket, h, h2, at, owner, id_, th)))
                yield pa.RecordBatch.from_arrays([*packs, *[pa.nulls(len(packs[0]), t) for t in _DOCS.types]], schema=whole)

    return run


def _later(survivors: bool):
    """Of the packs of each bucket (and range of chunks): the windows that also start earlier, by chunk, with the earliest;
    and, on request, the others as packs. Rows come in order of bucket and range."""
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False)
    whole = pa.schema([*_PACKS, *[f.with_name(f"m_{f.name}") for f in _MARKS][1:]]) if survivors else _MARKS

    def rank(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        h, h2, start, doc, ids, ths, counts = (flat(t.column(k).combine_chunks()) for k in range(2, 9))
        doc, ids, ths = (np.repeat(x, counts) for x in (doc, ids, ths))
        chunk = np.repeat(t.column(0).to_numpy(), pa.compute.list_value_length(t.column(2)).to_numpy())
        first = _earliest(np.lexsort((start, ths, ids, h2, h)), h, h2)
        tie = (ids == ids[first]) & (ths == ths[first]) & (start == start[first])
        late = np.flatnonzero(~tie)
        late = late[np.lexsort((start[late], doc[late], chunk[late]))]
        edge = np.flatnonzero(np.diff(chunk[late], prepend=-1)) if len(late) else late
        cut = pa.array(np.append(edge, len(late)).astype(np.int32))
        marks = [pa.array(chunk[late][edge], pa.int64())]
        marks += [pa.ListArray.from_arrays(cut, pa.array(x, t.value_type)) for x, t in zip((doc[late], start[late], ids[first[late]], ths[first[late]], start[first[late]]), _MARKS.types[1:], strict=True)]
        if not survivors:
            yield pa.RecordBatch.from_arrays(marks, schema=whole)
            return
        yield pa.RecordBatch.from_arrays([marks[0], *[pa.nulls(len(edge), t) for t in _PACKS.types[1:]], *marks[1:]], schema=whole) if len(edge) else _none(whole)
        # Of windows that tie, all stand for one text; each has its own chunk to answer to.
        left = np.flatnonzero(tie)
        left = left[np.lexsort((start[left], doc[left], chunk[left]))]
        packs = _packed(chunk[left], np.full(len(left), t.column(1)[0].as_py()), *(x[left] for x in (h, h2, start, doc, ids, ths)))
        yield pa.RecordBatch.from_arrays([*packs, *[pa.nulls(len(packs[0]), t) for t in _MARKS.types[1:]]], schema=whole)

    def run(batches):
        held, key = [], None
        for batch in batches:
            buckets, ranges = batch.column(1).to_numpy(), batch.column(9).to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(buckets) != 0) | (np.diff(ranges) != 0)) + 1).tolist(), len(buckets)]
            for a, b in itertools.pairwise(cut):
                if a == b:
                    continue
                if key is not None and (buckets[a], ranges[a]) != key:
                    yield from rank(held)
                    held = []
                key = buckets[a], ranges[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from rank(held)

    return run


def _none(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in schema.types], schema=schema)


def _gather(window: int):
    """Rows of a chunk: marks first (doc, start and what they repeat), then documents. All spans of each document that has
    any, and the pieces by which they are verified."""
    values = lambda c, k: c[k].values.to_numpy(zero_copy_only=False)

    def run(batches):
        chunk, held, made = None, [], None
        for batch in batches:
            rows = []
            chunks, ats = batch.column("chunk").to_numpy(), batch.column("at").to_pylist()
            for k, at in enumerate(ats):
                if chunks[k] != chunk:
                    chunk, held, made = chunks[k], [], None
                if at < 0:
                    held.append([values(batch.column(c), k) for c in ("doc", "start", "rid", "rth", "rat")])
                    continue
                if made is None:
                    marks = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 5
                    order = np.lexsort((marks[1], marks[0]))
                    made = _spans(*(x[order] for x in marks))
                mine = slice(*np.searchsorted(made[0], [at, at + 1]))
                spans = [np.concatenate((x[mine], values(batch.column(c), k))) for x, c in zip(made[1:], ("first", "last", "rid", "rth", "rat"), strict=True)]
                if len(spans[0]):
                    first, last, rid, rth, rat = spans
                    span, skip, n = _pieces(first, last, rat, window)
                    rows.append((batch.column("id")[k].as_py(), batch.column("th")[k].as_py(), first, last, first[span] + skip, n, rid[span], rth[span], rat[span] + skip))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NEEDS.types, strict=True)], schema=_NEEDS)

    return run


def _removed(window: int, spans: bool):
    """For each text with spans: removed words, the digest of the others, and, on request, the stretches removed and the text
    left. For each piece to verify: the earlier text, place and number of words, and the digest of the words here."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), _LONG, _LONG, _INT, _INT, pa.list_(pa.binary()), pa.list_(_LONG), pa.string()][: 11 if spans else 9]
    names = ["id", "th", "n_removed", "kept", "p_rid", "p_rth", "p_at", "p_n", "p_sha", "spans", "left_text"][: len(kinds)]

    def run(batches):
        for batch in batches:
            rows = []
            for k, (id_, th, raw, first, last, at, n, rid, rth, rat, s_at, s_n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                words = (raw or b"").split()
                low, high = np.array(first or [], np.int64), np.array(last or [], np.int64) + window
                edge = np.bincount(low, minlength=len(words) + 1) - np.bincount(np.minimum(high, len(words)), minlength=len(words) + 1)
                gone = np.cumsum(edge)[:-1] > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                own = [_digest(words, a, m) for a, m in zip(at or [], n or [], strict=True)]
                served = [_digest(words, a, m) for a, m in zip(s_at or [], s_n or [], strict=True)]
                proof = ((rid or []) + [id_] * len(served), (rth or []) + [th] * len(served), (rat or []) + (s_at or []), (n or []) + (s_n or []), own + served)
                change = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                rows.append((id_, th, int(gone.sum()), _digest(left, 0, len(left)), *proof) + ((change.reshape(-1, 2).tolist(), b" ".join(left).decode("utf-8", "replace")) if spans else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _marks(found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Marks by chunk, and the tables that they are read from."""
    spark = found.sparkSession
    packs = found.where("bucket is not null").select("chunk", "bucket", "h", "h2", "start", "doc", "ids", "ths", "counts")
    ranges = -(-found.where("bucket is null").select("chunk").distinct().count() // CHUNK_RANGE)
    parts = partitions(spark, stored_bytes(found))
    dealt = packs.withColumn("range", F.pmod(F.xxhash64("chunk"), F.lit(max(ranges, 1))).cast("int"))
    ranked = lambda rows, more, columns: rows.repartition(parts, "bucket", "range").sortWithinPartitions("bucket", "range").mapInArrow(_later(more), columns)
    if ranges <= 1:
        return ranked(dealt, False, _MARK_COLUMNS), []
    names = ["doc", "start", "rid", "rth", "rat"]
    both = f"{_PACK_COLUMNS}, m_" + _MARK_COLUMNS.removeprefix("chunk long, ").replace(", ", ", m_")
    first = materialize(ranked(dealt, True, both), "ranges")
    marks = first.where("bucket is null").select("chunk", *[F.col(f"m_{c}").alias(c) for c in names])
    rest = first.where("bucket is not null").select(*packs.columns, F.lit(0).alias("range"))
    return marks.unionByName(ranked(rest, False, _MARK_COLUMNS)), [first]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with_text: also spans (first word, word after the last) and
    left_text for documents that lose words but are no copies of a whole text, null for others."""
    spark = docs.sparkSession
    rows = bound_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("raw"))
    described = materialize(spread(rows).mapInArrow(_described(window), "id long, th long, root binary, n_words long, anchors array<long>"), "described")
    firsts = materialize(described.groupBy("root").agg(F.min(F.struct("id", "th")).alias("f"), F.max("n_words").alias("n")), "roots")
    first = (F.col("id") == F.col("f.id")) & (F.col("th") == F.col("f.th"))
    # A hash of id and text stands for a document here; documents that share it only get candidates of each other.
    key = F.xxhash64("id", "th").alias("k")
    each = described.join(firsts, "root").where(first).select(key, F.explode("anchors").alias("name"))
    repeated = materialize(each.groupBy("name").count().where(F.col("count") > 1).select("name"), "repeated")
    free_shuffles(spark)
    chosen = materialize(each.join(repeated, "name").groupBy("k").agg(F.collect_set("name").alias("names")), "chosen")  # at most a text's words
    facts = materialize(described.select("id", "th", "root", "n_words"), "facts")  # the same without anchors
    del each
    drop(repeated, described)
    free_shuffles(spark)
    buckets = max(4 * partitions(spark), -(-(firsts.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS))
    for strong in (False, True):
        changed = _changes(rows, chosen, key, window, buckets, strong, with_text)
        proofs = changed.select(F.explode(F.arrays_zip("p_rid", "p_rth", "p_at", "p_n", "p_sha")).alias("p")).select("p.*")
        if proofs.groupBy("p_rid", "p_rth", "p_at", "p_n").agg(F.min("p_sha").alias("a"), F.max("p_sha").alias("b")).where("a <> b").isEmpty():
            break
        drop(changed)
    else:
        raise RuntimeError("texts of equal SHA-256 differ")
    drop(chosen)
    every = facts.join(firsts, "root").withColumn("copy", ~first & (F.col("n_words") >= window))
    out = every.join(changed.drop("p_rid", "p_rth", "p_at", "p_n", "p_sha"), ["id", "th"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.lower(F.hex(F.coalesce("kept", "root")))).alias("kept_sha256"),
    ]
    return out.select(*columns, *(["spans", F.when(F.col("copy"), F.lit("")).otherwise(F.col("left_text")).alias("left_text")] if with_text else []))


def _changes(rows: DataFrame, chosen: DataFrame, key, window: int, buckets: int, strong: bool, with_text: bool) -> DataFrame:
    """A table of the texts that lose words, or that others repeat, with the pieces that prove it."""
    spark = rows.sparkSession
    again = rows.withColumn("k", key).join(chosen, "k").select("id", "th", "raw", "names")
    found = materialize(again.mapInArrow(_candidates(window, buckets, strong), f"{_PACK_COLUMNS}, {_DOC_COLUMNS}"), "windows")
    del again
    free_shuffles(spark)
    marks, ranges = _marks(found)
    spans = ["first", "last"]
    marks = marks.select("*", F.lit(-1).alias("at"), *[F.lit(None).cast("long").alias(c) for c in ("id", "th")], *[F.lit(None).cast("array<int>").alias(c) for c in spans])
    members = found.where("bucket is null").select("chunk", "at", "id", "th", *spans, "rid", "rth", "rat", *[F.lit(None).cast("array<int>").alias(c) for c in ("doc", "start")])
    met = members.unionByName(marks).repartition(partitions(spark, stored_bytes(found)), "chunk").sortWithinPartitions("chunk", "at")
    marked = materialize(met.mapInArrow(_gather(window), _NEED_COLUMNS).dropDuplicates(["id", "th"]), "marked")  # equal rows have equal marks
    drop(found, *ranges)
    free_shuffles(spark)
    # A text serves pieces of 64 words at most, cut at fixed places: no more than some 33 kinds for each of its words.
    asked = marked.select(F.explode(F.arrays_zip("rid", "rth", "rat", "n")).alias("p")).select("p.*").distinct()
    served = asked.groupBy(F.col("rid").alias("id"), F.col("rth").alias("th")).agg(F.collect_list(F.struct("rat", "n")).alias("s"))
    served = served.select("id", "th", F.col("s.rat").alias("s_at"), F.col("s.n").alias("s_n"))
    needs = marked.join(served, ["id", "th"], "full_outer")
    schema = "id long, th long, n_removed long, kept binary, p_rid array<long>, p_rth array<long>, p_at array<int>, p_n array<int>, p_sha array<binary>" + (", spans array<array<long>>, left_text string" if with_text else "")
    texts = rows.join(needs, ["id", "th"]).select("id", "th", "raw", "first", "last", "at", "n", "rid", "rth", "rat", "s_at", "s_n")
    out = materialize(texts.mapInArrow(_removed(window, with_text), schema).dropDuplicates(["id", "th"]), "changed")
    drop(marked)
    free_shuffles(spark)
    return out
