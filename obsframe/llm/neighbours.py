"""Operator 6: approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and cut into slots of WIDTH: a bucket of a table is a
combination of HASHES slots. A query visits its own bucket and perturbed ones (each slot one down, the same, or one
up) in order of estimated success, the sum of squared distances to the slot borders that are crossed. Candidates of
all tables are merged and ranked by exact cosine.

Buckets are dealt into shards; a bucket of more than HOT rows is split over several. A query's vector goes once to each
shard that holds a bucket it visits; the shard scores its candidates and keeps the best few of each query, so what is
merged at the end grows with queries and shards, not with pairs. Of equal vectors only the ids that can be among the
nearest are kept (equal scores go to smaller ids, so this loses nothing), and equal query vectors are searched once.

A query whose buckets hold fewer than k others is searched once more among all rows, in blocks, so every query gets k
neighbours, or all candidates where there are fewer.

Vectors that are null, zero, of another length than most, or with null or non-finite components take no part, as
queries or candidates. Rows that repeat an id and a vector count once; an id with several vectors is never its own
neighbour. Ties go to smaller ids. Empty table: no rows. Other columns are never read. Components are kept as they
are: float or double.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .work import drop, materialize, partitions, stored_bytes

TABLES, HASHES, WIDTH, PROBES, SEED = 3, 8, 2.2, 500, 20
#: Rows of a bucket in one shard, and rows (a table's worth of each vector) of a shard, about.
HOT, SHARD_ROWS, LEAST_SHARDS = 10_000, 100_000, 64
#: Queries whose best candidates a shard holds before it passes them on.
HELD_QUERIES = 20_000


@lru_cache(maxsize=4)
def _family(dim: int, tables: int, hashes: int, width: float, seed: int):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


@lru_cache(maxsize=4)
def _perturbations(hashes: int) -> np.ndarray:
    return np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), np.int64)


class Multiprobe:
    def __init__(self, dim: int, tables=TABLES, hashes=HASHES, width=WIDTH, probes=PROBES, seed=SEED):
        self.dim, self.tables, self.hashes, self.width, self.probes, self.seed = dim, tables, hashes, width, probes, seed

    def _slots(self, x: np.ndarray) -> np.ndarray:
        a, b = _family(self.dim, self.tables, self.hashes, self.width, self.seed)
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        return ((unit @ a + b) / self.width).reshape(len(x), self.tables, self.hashes)

    def _code(self, slots: np.ndarray, table: int) -> np.ndarray:
        """A bucket as one number: slots as digits, then the table."""
        digit = 1 << (56 // self.hashes)
        return ((np.clip(slots + digit // 2, 0, digit - 1)) @ (digit ** np.arange(self.hashes, dtype=np.int64))) * self.tables + table

    def buckets(self, x: np.ndarray) -> np.ndarray:
        slots = np.floor(self._slots(x)).astype(np.int64)
        return np.stack([self._code(slots[:, t], t) for t in range(self.tables)], axis=1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Codes of the buckets each query visits, most promising first within a table."""
        f, moves = self._slots(x), _perturbations(self.hashes)
        n = min(self.probes, len(moves))
        out = []
        for t in range(self.tables):
            slot = np.floor(f[:, t]).astype(np.int64)
            down = f[:, t] - slot
            cost = (down**2) @ (moves == -1).T + ((1 - down) ** 2) @ (moves == 1).T
            best = np.argpartition(cost, n - 1, axis=1)[:, :n]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
            out.append(self._code(slot[:, None, :] + moves[best], t))
        return np.concatenate(out, axis=1)


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _hashed(df: DataFrame, index: Multiprobe, method: str) -> DataFrame:
    """df (id, v) with codes."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                codes = getattr(index, method)(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(codes), pa.list_(pa.int64()))], ["id", "v", "codes"])

    return df.select("id", "v").mapInArrow(run, f"id long, v {df.schema['v'].dataType.simpleString()}, codes array<long>")


def _best_of_shard(keep: int, tables: int):
    """Rows of a shard: candidates (query false) first, then queries with the codes they visit."""

    def run(batches):
        shard, held, made, best = None, [], None, {}

        def flush():
            rows = [(q, i, s) for q, top in best.items() for s, i in top]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        for batch in batches:
            shards, is_query, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            vectors, codes = _matrix(batch.column(3)), batch.column(4)
            cut = np.flatnonzero((np.diff(shards) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for a, b in itertools.pairwise([0, *cut.tolist(), len(ids)]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, held, made = shards[a], [], None
                if not is_query[a]:
                    held.append((codes.slice(a, b - a).flatten().to_numpy(zero_copy_only=False), ids[a:b], vectors[a:b]))
                    continue
                if not held:
                    continue
                if made is None:
                    code, who, v = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.lexsort((who, code))
                    code, who, v = code[order], who[order], v[order]
                    made, held = (np.unique(code), np.flatnonzero(np.diff(code, prepend=code[0] - 1)), len(code), who, v, np.linalg.norm(v, axis=1)), [True]
                kinds, first, total, who, v, norm = made
                last = np.append(first[1:], total)
                for k in range(a, b):
                    wanted = codes[k].values.to_numpy(zero_copy_only=False)
                    at = np.searchsorted(kinds, wanted)
                    at = at[(at < len(kinds)) & (kinds[np.minimum(at, len(kinds) - 1)] == wanted)]
                    if not len(at):
                        continue
                    rows = np.concatenate([np.arange(first[x], last[x]) for x in at.tolist()])
                    score = (v[rows] @ vectors[k]) / (norm[rows] * np.linalg.norm(vectors[k]))
                    q = int(ids[k])
                    near = who[rows]
                    if len(rows) > 4 * keep * tables:  # a vector is in a shard once for each table at most
                        close = score >= np.partition(score, len(score) - keep * tables)[len(score) - keep * tables]
                        if len(np.unique(near[close])) >= keep:  # not so where ids have several vectors
                            near, score = near[close], score[close]
                    order = np.argsort(score, kind="stable")  # of an id's scores the highest is written last
                    pairs = dict(zip(near[order].tolist(), score[order].tolist(), strict=True))
                    for s, i in best.get(q, ()):
                        pairs[i] = max(s, pairs.get(i, s))
                    best[q] = sorted(((s, i) for i, s in pairs.items()), key=lambda p: (-p[0], p[1]))[:keep]
                    if len(best) > HELD_QUERIES:
                        yield flush()
        if best:
            yield flush()

    return run


def cosine(a: Column, b: Column) -> Column:
    """In double precision, from the vectors as they are."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: rows that take part; components other than float are doubles."""
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def _searched(held: DataFrame, sent: DataFrame, shards: int, k: int, tables: int, name: str) -> DataFrame:
    """head, vec_id, score: the best k + 1 found for each query; held and sent: shard, is_query, id, v, codes."""
    parts = partitions(held.sparkSession, tables * stored_bytes(held))  # a vector is held once a table
    met = held.unionByName(sent).repartition(max(parts, min(shards, 4 * parts)), "shard").sortWithinPartitions("shard", "is_query")
    found = met.mapInArrow(_best_of_shard(k + 1, tables), "query_id long, vec_id long, score double")
    first = Window.partitionBy("head").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy(F.col("query_id").alias("head"), "vec_id").agg(F.max("score").alias("score"))
    return materialize(merged.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"), name)


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row that the condition `queries` (over the
    column id) holds for, among all rows but those of its own id."""
    spark = df.sparkSession
    ship(spark)
    rows = valid_vectors(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["n"])
    index = Multiprobe(sizes["n"], tables, hashes, width, probes)
    # Of equal vectors, a query needs its k nearest and, perhaps, one more beside itself.
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1).select("id", "v").dropDuplicates(["id", "v"])
    kept = materialize(_hashed(kept, index, "buckets"), "hashed")
    hashed = kept.select("id", "v", F.explode("codes").alias("code"))
    total = sizes["count"] * tables
    shards = max(LEAST_SHARDS, -(-total // SHARD_ROWS))
    # At most total / HOT buckets are hot.
    hot = materialize(hashed.groupBy("code").count().where(F.col("count") > HOT).select("code", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "hot")
    shard = F.pmod(F.xxhash64("code", "part"), F.lit(shards)).cast("int").alias("shard")
    parts = F.coalesce("parts", F.lit(1))
    held = hashed.join(hot, "code", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    held = held.select(shard, F.lit(False).alias("is_query"), "id", "v", F.array("code").alias("codes"))
    asked = rows.where(queries)
    # An id may have several vectors, so distinct vectors are numbered, once and for all as the table is written.
    heads = materialize(asked.select("v").distinct().withColumn("head", F.monotonically_increasing_id()), "heads")
    visits = materialize(_hashed(heads.select(F.col("head").alias("id"), "v"), index, "visits"), "visits")
    to = visits.select("id", F.explode("codes").alias("code")).join(hot, "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    to = to.select("id", "code", shard).groupBy("id", "shard").agg(F.collect_list("code").alias("codes"))  # probes of one query
    asking = heads.select(F.col("head").alias("id"), "v")
    sent = to.join(asking, "id").select("shard", F.lit(True).alias("is_query"), "id", "v", "codes")
    found = _searched(held, sent, shards, k, tables, "found")
    drop(visits, hot)
    # Queries that met fewer than they should: all rows, dealt into shards, see each of them.
    least = F.lit(min(k + 1, kept.select("id").distinct().count()))
    full = found.groupBy("head").count().where(F.col("count") >= least).select(F.col("head").alias("id"))
    short = materialize(asking.join(full, "id", "left_anti"), "short")
    if not short.isEmpty():
        shards = max(LEAST_SHARDS, -(-sizes["count"] // SHARD_ROWS))
        none = F.array(F.lit(0).cast("long")).alias("codes")
        every = kept.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "v", none)
        sent = short.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "id", "v", none)
        again = _searched(every, sent, shards, k, 1, "again")
        found = found.join(short.select(F.col("id").alias("head")), "head", "left_anti").unionByName(again)
    members = asked.join(heads.select("v", "head"), "v").select(F.col("id").alias("query_id"), "head").distinct()
    out = members.join(found, "head").where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
