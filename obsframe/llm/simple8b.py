"""Operator 3: token ids in Simple-8b word-aligned blocks.

A 64-bit word has a 4-bit selector on top and 60 bits of payload. Selector k < 15 says how many ids of how many bits
the payload holds; selector 15 is an escape, and the next word is one raw value of up to 64 bits. Blocks of 4,096 ids
start at recorded word offsets and are coded and decoded many at a time.

A file numbers its ids by how often it has them, so that most numbers are small and many fit in a word; the table of ids
by number stands in the footer. A token file: magic, words of all blocks, then the footer (word offset of each block,
ids by number, document ids, null flags, document lengths) and a trailer of fixed size. Documents are range-partitioned by id (and by a hash of the text, so
that a much repeated id still spreads), and sorted; file order is id order. Files are written under a temporary name
and renamed; their content is a function of the partition, so a task that runs again writes the same file.

Nulls: a null text is empty and yields the end id alone; a null id sorts first and is kept as null. Repeated rows are
kept, those of one id ordered by the text's hash. Very long texts are encoded and stored whole, in one file. Empty
table: no files, no rows. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .work import bound_batches, by_bytes, materialize, new_path, partitions, stored_bytes

# Ids in a word, and bits of each, by selector; 120 ids of no bits are zeros.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
BLOCK, PAD = 4096, 120
MAGIC = b"S8BTOK02"
#: Ids of a file, about: so many are held until their numbers are known (a single document may have more).
FILE_IDS = 8_000_000
_LIMITS = np.array([1 << b for b in BITS[:-1]], np.uint64)
_small = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)


def _classes(values: np.ndarray) -> np.ndarray:
    """The least selector whose bits hold each value."""
    if len(values) and values.max() < len(_small):
        return _small[values]
    return np.searchsorted(_LIMITS, values, side="right").astype(np.uint8)


def _selectors(values: np.ndarray) -> np.ndarray:
    """At each place, the selector that packs most of the values from there on."""
    top = {1: _classes(values)}
    # maximum over each window length that a selector needs, from two shorter ones
    for n, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (15, 5), 30: (15, 15), 60: (30, 30), 120: (60, 60)}.items():
        m = top[a].copy()
        np.maximum(m[: -(n - b)], top[b][n - b :], out=m[: -(n - b)])
        top[n] = m
    out = np.full(len(values), ESCAPE, np.uint8)
    for k in range(ESCAPE - 1, -1, -1):
        np.copyto(out, np.uint8(k), where=top[int(COUNTS[k])] <= k)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word offset of each block with the total at the end."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    padded = np.zeros((blocks, BLOCK + PAD), np.uint64)
    for i in range(blocks):
        part = values[i * BLOCK : (i + 1) * BLOCK]
        padded[i, : len(part)] = part
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    flat = padded.ravel()
    select = _selectors(flat)
    # A word may not run over the end of its block's ids into the padding of another: the padding is as long as a word.
    step = COUNTS[select]
    at = np.arange(blocks) * (BLOCK + PAD)
    end, which = at + size, np.arange(blocks)
    places, owners = [], []
    while len(at):
        places.append(at)
        owners.append(which)
        at = at + step[at]
        live = at < end
        if not live.all():
            at, end, which = at[live], end[live], which[live]
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    k = select[place]
    words_each = 1 + (k == ESCAPE)
    offset = np.concatenate(([0], np.cumsum(words_each)))
    words = np.zeros(offset[-1], np.uint64)
    for s in np.unique(k):
        p, to = place[k == s], offset[:-1][k == s]
        if s == ESCAPE:
            words[to] = np.uint64(ESCAPE) << np.uint64(60)
            words[to + 1] = flat[p]
        else:
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            packed = np.bitwise_or.reduce(flat[p[:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
            words[to] = packed | (np.uint64(s) << np.uint64(60))
    in_block = np.bincount(owner, weights=words_each, minlength=blocks).astype(np.int64)
    return words, np.concatenate(([0], np.cumsum(in_block)))


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive blocks; offsets as from encode()."""
    if not n:
        return np.zeros(0, np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(select == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    head = np.flatnonzero(~raw[:-1])
    k, count = select[head], COUNTS[select[head]]
    block = np.searchsorted(offsets, head, side="right") - 1
    before = np.cumsum(count) - count
    first = np.searchsorted(head, offsets[:-1])
    place = before - before[first][block] + block * (BLOCK + PAD)
    out = np.zeros((len(offsets) - 1) * (BLOCK + PAD) + PAD, np.uint64)
    for s in np.unique(k):
        mine = k == s
        p, w = place[mine], words[head[mine]]
        if s == ESCAPE:
            out[p] = words[head[mine] + 1]
        else:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            out[p[:, None] + np.arange(COUNTS[s])] = (w[:, None] >> shifts) & mask
    return out[: (len(offsets) - 1) * (BLOCK + PAD)].reshape(-1, BLOCK + PAD)[:, :BLOCK].ravel()[:n]


def _store(uri: str):
    """File system and path of a URI that Spark and pyarrow both know."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """One token file; add() takes whole documents in order."""

    def __init__(self, uri: str, name: str, attempt: str):
        self._fs, folder = _store(uri)
        self._fs.create_dir(folder, recursive=True)
        self._temporary, self.path = f"{folder}/_{attempt}-{name}", f"{folder}/{name}"
        self._file = self._fs.open_output_stream(self._temporary)
        self._file.write(MAGIC)
        self._parts, self._offsets, self._ids, self._lengths = [], [np.zeros(1, np.int64)], [], []
        self.n_ids = self.n_docs = 0

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self._ids += doc_ids
        self._lengths.append(lengths)
        self._parts.append(ids.astype(np.uint32))
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)

    def _numbered(self) -> tuple[np.ndarray, Iterator[np.ndarray]]:
        """Ids by number, the most frequent first (ties: smaller ids), and the numbers of all ids in whole blocks."""
        values = np.concatenate(self._parts) if self._parts else np.zeros(0, np.uint32)
        self._parts = []
        kinds, times = np.unique(values, return_counts=True)
        order = np.lexsort((kinds, -times))
        number = np.empty(len(kinds), np.uint32)
        number[order] = np.arange(len(kinds), dtype=np.uint32)
        pieces = (values[i : i + 256 * BLOCK] for i in range(0, len(values), 256 * BLOCK))
        if len(kinds) and kinds[-1] < 1 << 22:  # a table by id; ids are no larger in any usual vocabulary
            by_id = np.zeros(int(kinds[-1]) + 1, np.uint32)
            by_id[kinds] = number
            return kinds[order], (by_id[p] for p in pieces)
        return kinds[order], (number[np.searchsorted(kinds, p)] for p in pieces)

    def _put(self, values: np.ndarray) -> None:
        words, offsets = encode(values)
        self._file.write(words.astype("<u8").tobytes())
        self._offsets.append(offsets[1:] + self._offsets[-1][-1])

    def close(self) -> None:
        table, numbers = self._numbered()
        for part in numbers:
            self._put(part)
        offsets = np.concatenate(self._offsets)
        null = np.array([i is None for i in self._ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self._ids], "<i8")
        for part in (offsets.astype("<i8"), table.astype("<u4"), ids, null, np.concatenate(self._lengths).astype("<i8"), np.array([len(offsets), len(table), self.n_docs, self.n_ids], "<i8")):
            self._file.write(part.tobytes())
        self._file.write(MAGIC)
        self._file.close()
        self._fs.move(self._temporary, self.path)


def read_token_file(uri: str) -> Iterator[tuple[object, int, int, np.ndarray]]:
    """(document id, place of its first id in the file, number of ids, ids), with some 256 blocks in memory at a time."""
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        f.seek(f.size() - 40)
        tail = f.read(40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n_offsets, n_table, n_docs, n_ids = np.frombuffer(tail[:32], "<i8")
        at = f.size() - 40 - 8 * n_offsets - 4 * n_table - 17 * n_docs
        f.seek(at)
        offsets = np.frombuffer(f.read(8 * n_offsets), "<i8")
        table = np.frombuffer(f.read(4 * n_table), "<u4")
        doc_ids = np.frombuffer(f.read(8 * n_docs), "<i8")
        null = np.frombuffer(f.read(n_docs), np.uint8)
        lengths = np.frombuffer(f.read(8 * n_docs), "<i8")
        ends = np.cumsum(lengths)
        doc, done, held = 0, 0, []
        for b in range(0, max(1, n_offsets - 1), 256):
            last = min(b + 256, n_offsets - 1)
            f.seek(len(MAGIC) + 8 * offsets[b])
            words = np.frombuffer(f.read(8 * (offsets[last] - offsets[b])), "<u8")
            values = table[decode(words, offsets[b : last + 1] - offsets[b], min((last - b) * BLOCK, n_ids - b * BLOCK))]
            low = 0
            while doc < n_docs and ends[doc] <= done + len(values):
                high = ends[doc] - done
                held.append(values[low:high])
                yield (None if null[doc] else int(doc_ids[doc])), int(ends[doc] - lengths[doc]), int(lengths[doc]), held[0] if len(held) == 1 else np.concatenate(held)
                held, low, doc = [], high, doc + 1
            if low < len(values):
                held.append(values[low:])
            done += len(values)


def write_tokens(df: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Encode and write whole texts in id order; returns the manifest (shard, part, file, n_docs, n_ids), written too."""
    path = tokenizer or default_tokenizer()
    end = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt = context.partitionId(), str(context.taskAttemptId())
        writer, rows = None, []

        def close():
            writer.close()
            rows.append((shard, len(rows), f"{uri}/{writer.path.rsplit('/', 1)[1]}", writer.n_docs, writer.n_ids))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                flat, lengths = encoder(path).encode(texts[a:b])
                if len(end):
                    flat = np.insert(flat, np.cumsum(lengths), end[0])
                    lengths = lengths + 1
                if writer is None:
                    writer = TokenFileWriter(uri, f"tokens-{shard:06d}-{len(rows):04d}.s8b", attempt)
                writer.add(ids[a:b], lengths, flat)
                if writer.n_ids >= FILE_IDS:
                    close()
                    writer = None
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "part", "file", "n_docs", "n_ids"), r, strict=True)) for r in rows], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    spark = df.sparkSession
    rows = bound_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(partitions(spark, stored_bytes(df)), "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return materialize(rows.mapInArrow(write, "shard int, part int, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of a manifest."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))  # a row per file
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, start, n, ids in read_token_file(uri):
                    rows.append((doc_id, base + start, n, zlib.crc32(ids.tobytes())) + ((ids.tolist(),) if with_ids else ()))
                    held += n if with_ids else 1
                    if held >= (500_000 if with_ids else 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [k for k, _ in fields])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [k for k, _ in fields])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n_ids = manifest.agg(F.sum("n_ids")).first()[0] or 0
    return files.repartition(partitions(manifest.sparkSession, 2 * n_ids)).mapInArrow(read, schema)  # some two bytes an id


def token_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write token files to a fresh shared folder and describe every document from the files."""
    return read_tokens(write_tokens(df, new_path(df.sparkSession, "tokens"), id_col, text_col, tokenizer, end_id))
