"""Operator 7: SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits a lane: the majority, bit by bit, of the XXH64 hashes of word shingles, repeats included
(further lanes take mixes of those hashes).
Distinct fingerprints are dealt into tiles; pairs of tiles whose population counts differ beyond the radius are never
compared, all others are, with numpy exclusive-or and bit counts. A tile is a combination of the population counts of
the four quarters of the first lane: the distance of two fingerprints is at least the sum of the differences of those
counts, so only tiles with a sum up to the radius meet.

With a similarity of shingle sets (Jaccard), tiles are bands of set sizes (the smaller is at least that share of the
larger). Bits are then the parities of the distinct shingles that fall to each place: two sets differ in at least as
many shingles as bits, so pairs are ruled out without loss, and all others are checked on their shingles.

Each tile (a large one in chunks of CHUNK rows) is packed into one row. Up to GROUP chunks of a tile are at home in one
task and see the chunks they meet pass by, so memory is that of a group and a visitor, and a chunk is sent once to each
group, not to each chunk, that it meets. A visitor is linked once to each component of home rows that it touches, not to
each row, so a group of m near copies makes links in proportion to m.

Nulls: a null or empty text has no shingle and fingerprint zero, linked like any other; rows with a null id get a
fingerprint and no component. Rows that share an id are one document. Empty table: no rows. Other columns are never
read by `near_duplicates`, and kept by `keep_one`.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .work import bound_batches, drop, free_shuffles, materialize, partitions, spread

#: Rows of a chunk: of tiles, of bands of shingle counts (which are larger), and of those with their shingles.
CHUNK, WIDE_CHUNK, SET_CHUNK = 2048, 4096, 1024
#: Longs of a chunk's fingerprints or shingles, and pairs or shared shingles that are looked at together, at most.
CELLS, BLOCK = 1_000_000, 2_000_000
#: Chunks of a tile that one task holds, and their longs, at most (a single chunk may be larger).
GROUP, GROUP_CELLS = 32, 6_000_000
SEED = 42


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash: a full avalanche of the hash and the lane's number."""
    h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30)) ^ (h << np.uint64(23))


def fingerprint(raw: bytes | None, words: int, lanes: int = 1) -> tuple[list[int], int]:
    """Lanes as signed 64-bit integers, and, with several lanes, the number of distinct shingles."""
    import xxhash

    parts = raw.lower().split() if raw else []  # bytes: A-Z only, and exactly space and \x09-\x0D
    if not parts:
        return [0] * lanes, 0
    text = memoryview(b" ".join(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(words, len(parts))
    begin, end = begin[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist()
    count, kinds = np.zeros((lanes, 64), np.int64), set()
    for at in range(0, len(begin), 65_536):
        first = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(begin[at : at + 65_536], end[at : at + 65_536], strict=True)], "<u8")
        if lanes > 1:
            kinds.update(first.tolist())
        for lane in range(lanes):
            h = _mixed(first, lane) if lane else first
            count[lane] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * count > len(begin), axis=1, bitorder="little").view("<i8").ravel().tolist()
    return out, len(kinds)


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    import xxhash

    parts = raw.lower().split() if raw else []
    if not parts:
        return np.zeros(0, np.uint64)
    text = memoryview(b" ".join(parts))
    end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begin = np.append(0, end[:-1] + 1)
    k = min(words, len(parts))
    pairs = zip(begin[: len(parts) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in pairs), np.uint64, len(parts) - k + 1))


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (a long for each lane), n (distinct shingles, with several lanes)."""

    def run(batches):
        for batch in batches:
            made = [fingerprint(t, words, lanes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.int64())], ["doc_id", "fp", "n"])

    rows = spread(bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    return rows.mapInArrow(run, "doc_id long, fp array<long>, n long")


def _band(n: int, similarity: float) -> tuple[int, float]:
    """The band of a number of distinct shingles, and the band's upper end: two numbers whose ratio is at least the
    similarity lie in one band or in neighbours (which are a little wider than that, for rounding)."""
    width = -np.log(similarity) * (1 + 1e-9)
    band = int(np.log(n) / width) + 1 if n else 0
    return band, float(np.exp(band * width))


def parities(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """For each of 64 * lanes places, whether an odd number of the hashes falls there. A shingle that two sets do not
    share changes one place, so the bits that differ are never more than the shingles that do."""
    odd = np.bincount((shingles & np.uint64(64 * lanes - 1)).view(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def signatures(docs: DataFrame, words: int, lanes: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (distinct shingles), key (hash of their set), tile (its band), fp (parities in as many places as the
    band's largest set has shingles, or 64 a lane if that is more)."""

    def run(batches):
        import xxhash

        for batch in batches:
            n, key, tile, fp = [], [], [], []
            for raw in batch.column(1).to_pylist():
                shingles = shingle_set(raw, words)
                band, most = _band(len(shingles), similarity)
                n.append(len(shingles))
                key.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                tile.append(band)
                fp.append(parities(shingles, 1 << int(np.ceil(np.log2(max(lanes, most / 64))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(tile, pa.int64()), pa.array(fp, pa.list_(pa.int64()))], ["doc_id", "n", "key", "tile", "fp"])

    rows = spread(bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    return rows.mapInArrow(run, "doc_id long, n long, key binary, tile long, fp array<long>")


def _population_tiles(radius: int):
    """Tile of a row, and offsets to the tiles it meets that come later in order."""
    lane = F.col("fp")[0]
    quarter = [F.bit_count(F.shiftrightunsigned(lane, 16 * i).bitwiseAND(F.lit(65535))) for i in range(4)]
    base = [32**i for i in range(4)]  # counts are 0 to 16, so a difference up to 15 stays within its digit
    tile = sum((q.cast("long") * b for q, b in zip(quarter, base, strict=True)), F.lit(0).cast("long"))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    later = sorted(x for d in steps if (x := sum(a * b for a, b in zip(d, base, strict=True))) > 0)
    return tile, later


def _near(a, b, radius: float, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and b (a has some hundred) within the radius, and their distance. The first `dense` lanes are compared
    for all pairs, the others for those that these leave."""
    lanes = a.shape[1]
    d = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :]).astype(np.uint8 if dense < 4 else np.uint16 if dense < 1000 else np.uint32)
    for k in range(1, dense):
        d += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    flat = np.flatnonzero(d.ravel() <= radius)
    i, j = np.divmod(flat, len(b))
    d = d.ravel()[flat].astype(np.int64)
    if lanes > dense:
        step = max(BLOCK // (lanes - dense), 1)
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            d[part] += np.bitwise_count(a[i[part], dense:] ^ b[j[part], dense:]).sum(axis=1, dtype=np.int64)
        ok = d <= radius
        i, j, d = i[ok], j[ok], d[ok]
    return i, j, d


class _Prints:
    """Finds rows of a chunk whose fingerprints are within the radius."""

    def __init__(self, n, values, radius):
        self.fp, self.radius = values.reshape(len(n), -1).view(np.uint64), radius

    def near(self, n, values):
        """Given rows i and rows j of the chunk, block by block."""
        fp, lanes = values.reshape(len(n), -1).view(np.uint64), self.fp.shape[1]
        # As many lanes as it takes for unlike pairs (half the bits differ) to exceed the radius.
        dense = next((k for k in range(1, lanes) if 32 * k - 12 * k**0.5 >= self.radius), lanes)
        for at in range(0, len(n), 512):
            i, j, _ = _near(fp[at : at + 512], self.fp, self.radius, dense)
            yield i + at, j


class _Parities:
    """Finds rows of a chunk whose sets can have the similarity: sizes a, b that share c have it if c >= s (a + b - c),
    thus if they differ in no more than (1 - s) / (1 + s) of a + b shingles; their parities differ in no more places."""

    def __init__(self, n, values, similarity):
        self.n, self.fp, self.similarity = n, values.reshape(len(n), -1).view(np.uint64), similarity

    def near(self, n, values):
        """Given rows i and rows j of the chunk, block by block."""
        fp, home, s = values.reshape(len(n), -1).view(np.uint64), self.fp, self.similarity
        lanes = min(fp.shape[1], home.shape[1])
        # Half as many places: each takes the parity of two.
        fp, home = (np.bitwise_xor.reduce(x.reshape(len(x), -1, lanes), axis=1) for x in (fp, home))
        share = (1 - s) / (1 + s)
        most = share * (n.max() + self.n.max()) + 1e-6
        odd = 32 * (1 - np.exp(-2 * (n.min() + self.n.min()) / (64 * lanes)))  # bits of a lane that differ in unlike pairs
        dense = next((k for k in range(1, lanes) if odd * k - 12 * k**0.5 >= most), lanes)
        for at in range(0, len(n), 512):
            i, j, d = _near(fp[at : at + 512], home, most, dense)
            i = i + at
            a, b = n[i], self.n[j]
            ok = (d <= share * (a + b) + 1e-6) & (np.minimum(a, b) >= s * np.maximum(a, b))
            yield i[ok], j[ok]


class _Sets:
    """Finds rows of a chunk whose sets of shingles have the similarity (Jaccard), by an index from shingles to rows."""

    def __init__(self, n, values, similarity):
        order = np.argsort(values)
        self.n, self.values, self.row, self.similarity = n, values[order], np.repeat(np.arange(len(n)), n)[order], similarity

    def near(self, n, values):
        """Given rows i and rows j of the chunk, block by block: all pairs that share a shingle are looked at."""
        low = np.searchsorted(self.values, values)
        times = np.searchsorted(self.values, values, "right") - low
        end = np.append(0, np.cumsum(n))
        before, m, a = np.append(0, np.cumsum(times))[end], len(self.n), 0
        while a < len(n):
            b = min(max(int(np.searchsorted(before, before[a] + BLOCK, "right")) - 1, a + 1), a + max(BLOCK // m, 1), len(n))
            t = times[end[a] : end[b]]
            at = np.repeat(low[end[a] : end[b]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            both = np.bincount(np.repeat(np.repeat(np.arange(b - a), n[a:b]), t) * m + self.row[at], minlength=(b - a) * m)
            code = np.flatnonzero(both)
            i, j, both = code // m + a, code % m, both[code]
            ok = both >= self.similarity * (n[i] + self.n[j] - both)
            yield i[ok], j[ok]
            a = b


class _Linked:
    """Rows of a chunk at home, and their components among themselves. Rows are linked to the first of their component,
    a visitor once to each component that it touches."""

    def __init__(self, node, n, values, finder):
        self.node, self.finder, self.part = node, finder(n, values), np.arange(len(node))
        for i, j in self.finder.near(n, values):
            i, j = i[i < j], j[i < j]
            while len(i):
                ra, rb = self.part[i], self.part[j]
                apart = ra != rb
                i, j, ra, rb = i[apart], j[apart], ra[apart], rb[apart]
                np.minimum.at(self.part, np.maximum(ra, rb), np.minimum(ra, rb))
                while not np.array_equal(self.part, up := self.part[self.part]):
                    self.part = up

    def own(self):
        i = np.flatnonzero(self.part != np.arange(len(self.node)))
        return self.node[i], self.node[self.part[i]]

    def visit(self, node, n, values):
        m = len(self.node)
        c = np.concatenate([np.unique(i * m + self.part[j]) for i, j in self.finder.near(n, values)])
        return node[c // m], self.node[c % m]


class _Touched:
    """Rows of a chunk at home. Of these and of visitors, those that are near any other row are given (as u and v)."""

    def __init__(self, node, n, values, finder):
        self.node, self.finder, self.seen = node, finder(n, values), np.zeros(len(node), bool)
        for i, j in self.finder.near(n, values):
            self.seen[i[i != j]] = True

    def own(self):
        return self.node[self.seen], self.node[self.seen]

    def visit(self, node, n, values):
        here, away = np.zeros(len(self.node), bool), np.zeros(len(node), bool)
        for i, j in self.finder.near(n, values):
            away[i], here[j] = True, True
        out = np.concatenate((node[away], self.node[here & ~self.seen]))
        self.seen |= here
        return out, out


def _compare(home_of, finder):
    """Packed tiles: for each (tile, team) the chunks at home, then those that visit them. Chunks at home visit the ones
    that came before them."""

    def run(batches):
        key, homes = None, []
        for batch in batches:
            tile, team, visitor = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k in range(batch.num_rows):
                part = [batch.column(c)[k].values.to_numpy() for c in (3, 4, 5)]
                if key != (tile[k], team[k]):
                    key, homes = (tile[k], team[k]), []
                found = [home.visit(*part) for home in homes]
                if not visitor[k]:
                    homes.append(home_of(*part, finder))
                    found.append(homes[-1].own())
                for pair in found:
                    for at in range(0, len(pair[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], pa.int64()) for x in pair], ["u", "v"])

    return run


def _meet(rows: DataFrame, later: list[int], chunk: int, home_of, finder, name: str) -> DataFrame:
    """u, v, written as a table: what each chunk at home gives with those of its tile and of the tiles that lie `later`
    by as much. rows: node, n, fp (longs), tile."""
    # At most 17^4 combinations of quarter counts, or some 200 bands: a proven bound for the broadcasts below.
    cells = F.sum(F.size("fp").cast("long"))
    sizes = rows.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / chunk, cells / CELLS)).cast("int").alias("chunks"), cells.alias("cells"))
    held = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.floor(F.col("chunks") * GROUP_CELLS / F.greatest("cells", F.lit(1))))).cast("int")
    tiles = materialize(sizes.select("tile", "chunks", held.alias("held"), F.ceil(F.col("chunks") / held).cast("int").alias("teams"), "cells"), "tiles")
    counts = F.broadcast(tiles.drop("cells"))
    rows = rows.join(counts, "tile").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # A tile, or a chunk of a large one, travels as one row of arrays; what is copied to the tiles it meets are such rows.
    packed = rows.groupBy("tile", "chunk", "held").agg(F.collect_list(F.struct("node", "n", "fp")).alias("rows"))
    pick = lambda field: F.transform("rows", lambda r: r[field])
    team = F.floor(F.col("chunk") / F.col("held")).cast("int").alias("team")
    packed = materialize(packed.select("tile", team, pick("node").alias("node"), pick("n").alias("n"), F.flatten(pick("fp")).alias("fp")), "packed")
    columns = ["tile", "team", "visitor", "node", "n", "fp"]
    visits = F.concat(
        F.array(F.struct(F.col("tile").alias("tile"), F.lit(True).alias("own"))),
        F.transform(F.array(*map(F.lit, later)), lambda d: F.struct((F.col("tile") + d).alias("tile"), F.lit(False).alias("own"))),
    )
    away = packed.select("node", "n", "fp", F.col("team").alias("from"), F.explode(visits).alias("to"))
    away = away.where("not to.own or `from` > 0").select("node", "n", "fp", "from", F.col("to.tile").alias("tile"), F.col("to.own").alias("own"))
    away = away.join(counts, "tile").withColumn("team", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("from")).otherwise(F.col("teams")) - 1)))
    met = packed.withColumn("visitor", F.lit(0)).select(columns).unionByName(away.withColumn("visitor", F.lit(1)).select(columns))
    # What all teams get, at most: each tile once for each team of its own and of those it meets.
    sent = tiles.select(F.col("cells").alias("n"), F.explode(F.array(*map(F.lit, [0, *later]))).alias("d"), "tile").select("n", (F.col("tile") + F.col("d")).alias("tile"))
    longs = sent.join(F.broadcast(tiles), "tile").agg(F.sum(F.col("n") * F.col("teams"))).first()[0] or 0
    met = met.repartition(partitions(rows.sparkSession, 8 * longs), "tile", "team").sortWithinPartitions("tile", "team", "visitor")
    out = materialize(met.mapInArrow(_compare(home_of, finder), "u long, v long"), name)
    drop(tiles, packed)
    return out


def links(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """u, v: links that join all nodes within the radius; rows: node, n, fp, distinct fingerprints."""
    tile, later = _population_tiles(radius)
    return _meet(rows.select("node", "n", "fp", tile.alias("tile")), later, chunk, _Linked, functools.partial(_Prints, radius=radius), "links")


def _shingle_sets(docs: DataFrame, ids: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """node, n, fp (sorted distinct hashes of shingles), tile of the texts with the given ids (column node)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([_band(len(h), similarity)[0] for h in sets], pa.int64())], ["node", "n", "fp", "tile"])

    texts = bound_batches(docs).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(ids, "node").select("node", "text").mapInArrow(run, "node long, n long, fp array<long>, tile long").distinct()


def _similar(kinds: DataFrame, docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """u, v: links that join all nodes whose shingles have the similarity; kinds: node, n, fp, tile of `signatures`.

    Rows that by their parities cannot have it with any other are set aside. The rest travel with their shingles, and
    each pair of them in bands that meet is checked where it meets, so nothing is chosen among pairs, and no table
    holds them."""
    touched = _meet(kinds, [1], WIDE_CHUNK, _Touched, functools.partial(_Parities, similarity=similarity), "touched")
    free_shuffles(docs.sparkSession)
    ids = touched.select(F.col("u").alias("node")).distinct()
    sets = materialize(_shingle_sets(docs, ids, words, similarity, id_col, text_col), "shingles")
    drop(touched)
    out = _meet(sets, [1], SET_CHUNK, _Linked, functools.partial(_Sets, similarity=similarity), "verified")
    drop(sets)
    free_shuffles(docs.sparkSession)
    return out


def _grouped(docs: DataFrame, words: int, lanes: int, radius: int, similarity: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Two tables: a row for each document, and the component of each kind of document; and the column they share."""
    if similarity is None:
        made, same = materialize(fingerprints(docs, words, lanes, id_col, text_col), "fingerprints"), "fp"
        kinds = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("node"), F.max("n").alias("n")).where("node is not null"), "distinct")
        found = links(kinds, radius)
    else:
        made, same = materialize(signatures(docs, words, lanes, similarity, id_col, text_col), "signatures"), "key"
        kinds = made.groupBy("key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "fp", "tile")])
        kinds = materialize(kinds.where("node is not null"), "distinct")
        found = _similar(kinds.select("node", "n", "fp", "tile"), docs, words, similarity, id_col, text_col)
    edges = found
    shared = made.groupBy("doc_id").agg(F.min(same).alias("a"), F.max(same).alias("b")).where("doc_id is not null and a <> b")
    if not shared.isEmpty():  # ids with several texts join their fingerprints
        ids = made.where("doc_id is not null").select("doc_id", same).distinct().join(kinds, same).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        edges = edges.unionByName(ids.where("u <> v"))
    parts = connected_components(edges).select(F.col("node"), F.col("root"))
    named = materialize(kinds.join(parts, "node", "left").select(same, F.coalesce("root", "node").alias("component_id")), "components")
    drop(found, kinds)
    return made, named, same


def _members(made: DataFrame, named: DataFrame, same: str) -> DataFrame:
    out = made.join(named, same, "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, lanes: int = 1, radius: int = 2, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least id that can be reached over links, itself included).

    Without a similarity, fingerprints within the radius are linked. With one, all documents are whose sets of shingles
    have it (Jaccard), exactly; fp then holds the parities by which pairs are ruled out, and the radius has no part."""
    return _members(*_grouped(docs, words, lanes, radius, similarity, id_col, text_col))


def keep_one(docs: DataFrame, words: int = 5, lanes: int = 8, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each group: the one of the least id. Rows without an id stay. Groups are
    joined by pairs of at least the similarity of shingles, exactly."""
    made, named, same = _grouped(docs, words, lanes, 0, similarity, id_col, text_col)
    keep = materialize(_members(made, named, same).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct(), "kept")
    drop(made, named)
    # The row travels as a struct, so that no column of the input can clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    first = rows.join(keep, "id").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("h"))).where("r = 1")
    return first.select("row.*").unionByName(rows.where("id is null").select("row.*"))
