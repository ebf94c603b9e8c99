"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts Gaussian projections into cells of width W; a vector lies in one bucket of each
table.  A query visits its own bucket and the perturbed ones in the estimated order of success:
neighbouring cells, one or more at once, by their summed squared distance to the query's
projections.  Candidates of all tables are merged and ranked by the exact distance.

The number of directions and of probes is fitted on a sample: of the settings that find TARGET of
the neighbours there, the one that will cost least for as many rows as there are.  More rows ask for
finer buckets.

Buckets of a table are dealt to groups of about BLOCK_VECTORS vectors.  A query goes to each group
once, with the buckets that it visits there.  Groups with many vectors or queries are dealt out in
blocks of bounded size, every block of the one against every block of the other, so a bucket that
holds a third of all vectors is neither gathered in a task nor cut short.  What leaves a task is at
most K rows per query and block.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterframe.durable import durable

K = 10
TABLES = 10
#: Directions that are tried, around the binary logarithm of the number of rows less AROUND.
DIRECTIONS, AROUND, MOST_DIRECTIONS = (-2, 0, 2, 4), 6, 20
#: What a copy of a query costs, in comparisons of two vectors.
COPY_COST = 60
#: Cells that a probe may change at once, where probes are fitted.
MOVES = 4
#: Buckets visited in each table: the fewest that find TARGET of the true neighbours within the fitting sample, at most MOST_PROBES.
TARGET, MOST_PROBES, FIT_QUERIES = 0.95, 1024, 100
#: Cell width, in standard deviations of the projections.
WIDTH = 2.5
#: Vectors, as expected, on which centre, spread and number of probes are fitted (a sample is sparser than all rows, so its neighbours are harder to find); every vector is indexed.
FIT_VECTORS = 4096
SEED = 11
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
#: Rows of results after which a task reduces them to K per query.
HELD_ROWS = 400_000


@dataclass
class Hashes:
    centre: np.ndarray  # (dim)
    directions: np.ndarray  # (tables, dim, directions)
    shift: np.ndarray  # (tables, directions), in cells
    width: np.ndarray  # (tables, directions)

    @staticmethod
    def fit(sample: np.ndarray, directions: int = 10, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> Hashes:
        rng = np.random.default_rng(seed)
        a = rng.normal(size=(tables, sample.shape[1], directions))
        centre = sample.mean(axis=0)
        spread = np.stack([(sample - centre) @ x for x in a]).std(axis=1)
        return Hashes(centre, a, rng.uniform(0, 1, (tables, directions)), width * np.where(spread > 0, spread, 1.0))

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Position of each vector along each direction, in cells."""
        return (vectors - self.centre) @ self.directions[table] / self.width[table] + self.shift[table]


def bucket(cells: np.ndarray) -> np.ndarray:
    """A 64-bit number of each row of cell numbers; buckets that happen to share one are searched together."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for j in range(cells.shape[-1]):
        h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def perturbations(away: np.ndarray, most: int) -> Iterator[list[int]]:
    """Sets of cell changes by rising sum of ``away``: number j is one cell down in direction j, number j + directions one up."""
    directions, order = len(away) // 2, np.argsort(away, kind="stable")
    cost = away[order]
    yield []
    given, heap = 1, [(cost[0], (0,))]
    while heap and given < most:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(cost):
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        moves = [int(order[i]) for i in chosen]
        if len({m % directions for m in moves}) == len(moves):
            given += 1
            yield moves


@cache
def combinations(directions: int, moves: int = MOVES) -> np.ndarray:
    """All changes of up to ``moves`` cells by one: rows of -1, 0 and 1."""
    out = [np.zeros((1, directions), np.int8)]
    for n in range(1, min(moves, directions) + 1):
        places = np.array(list(itertools.combinations(range(directions), n)))
        signs = np.array(list(itertools.product((-1, 1), repeat=n)), np.int8)
        c = np.zeros((len(places), len(signs), directions), np.int8)
        np.put_along_axis(c, np.broadcast_to(places[:, None, :], (*c.shape[:2], n)), np.broadcast_to(signs[None], (*c.shape[:2], n)), axis=2)
        out.append(c.reshape(-1, directions))
    return np.concatenate(out)


def probe_ranks(model: Hashes, sample: np.ndarray, asks: np.ndarray, table: int) -> np.ndarray:
    """For queries ``asks`` of the sample, at which probe of the table each vector of the sample is found: MOST_PROBES if at none."""
    cells = model.cells(sample, table)
    own, changes = np.floor(cells), combinations(cells.shape[1])
    inside = (cells - own)[asks]
    score = (changes < 0).astype(np.float32) @ (inside**2).T.astype(np.float32) + (changes > 0).astype(np.float32) @ ((1 - inside) ** 2).T.astype(np.float32)
    most = min(MOST_PROBES, len(changes))
    top = np.argpartition(score, most - 1, axis=0)[:most]
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(score, top, axis=0), axis=0, kind="stable"), axis=0).T
    to, of = bucket(own[asks][:, None, :] + changes[top]), bucket(own)
    out = np.full((len(asks), len(sample)), MOST_PROBES)
    for n, row in enumerate(to):
        order = np.argsort(row, kind="stable")
        at = np.minimum(np.searchsorted(row[order], of), most - 1)
        out[n] = np.where(row[order][at] == of, order[at], MOST_PROBES)
    return out


def fitted_probes(model: Hashes, sample: np.ndarray, k: int = K) -> tuple[int, float]:
    """Buckets to visit per table to find TARGET of the true neighbours of some sampled vectors, and the share of all vectors that these are compared with, summed over the tables.

    The vectors are drawn from the whole sample, among those whose own buckets do not hold all their
    neighbours: a dense group, however large, says nothing about the vectors outside it.
    Zero probes if MOST_PROBES buckets a table do not find TARGET of them.
    """
    k = min(k, len(sample) - 1)
    own = np.stack([bucket(np.floor(model.cells(sample, table))) for table in range(len(model.directions))])
    asks, near = [], []
    for i in np.random.default_rng(SEED).permutation(len(sample)).tolist():
        away = ((sample - sample[i]) ** 2).sum(axis=1)
        away[i] = np.inf
        nearest = np.argsort(away, kind="stable")[:k]
        if not (own[:, nearest] == own[:, i : i + 1]).any(axis=0).all():  # any number of probes does for the rest
            asks.append(i)
            near.append(nearest)
            if len(asks) == FIT_QUERIES:
                break
    if not asks:
        return 1, float(len(own))
    ranks = np.stack([probe_ranks(model, sample, np.array(asks), table) for table in range(len(own))])
    first = np.sort(np.take_along_axis(ranks.min(axis=0), np.array(near), axis=1).ravel())
    last = int(first[min(len(first) - 1, int(np.ceil(TARGET * len(first))))])
    return (last + 1, float((ranks <= last).mean(axis=(1, 2)).sum())) if last < MOST_PROBES else (0, 0.0)


def fitted(sample: np.ndarray, rows: int, k: int = K) -> tuple[Hashes, int]:
    """The model and number of probes that cost a query least among ``rows`` rows; zero probes if none finds TARGET."""
    best = None
    middle = round(np.log2(max(rows, 1024))) - AROUND
    for d in sorted({min(MOST_DIRECTIONS, max(2, middle + x)) for x in DIRECTIONS}):
        model = Hashes.fit(sample, d)
        probes, share = fitted_probes(model, sample, k)
        cost = share * rows + COPY_COST * probes * TABLES
        if best is None or probes and (not best[1] or cost < best[2]):
            best = model, probes, cost
        elif not probes or cost > 1.5 * best[2]:  # finer buckets still only cost more
            break
    return best[0], best[1]


def visited(position: np.ndarray, probes: int) -> np.ndarray:
    """Cell numbers of the buckets that a query at ``position`` visits, its own first."""
    own = np.floor(position)
    inside, directions = position - own, len(position)
    out = []
    for moves in perturbations(np.concatenate([inside**2, (1 - inside) ** 2]), probes):
        c = own.copy()
        for m in moves:
            c[m % directions] += -1 if m < directions else 1
        out.append(c)
    return np.array(out)


def usable(vector_col: str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector_col, lambda x: x != 0), F.lit(False))


def best(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, vec, score) the k nearest of each query; a vec counts once."""
    q, v, s = rows
    order = np.lexsort((s, v, q))
    q, v, s = q[order], v[order], s[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[first], v[first], s[first]
    order = np.lexsort((v, s, q))
    q, v, s = q[order], v[order], s[order]
    start = np.searchsorted(q, q, side="left")
    near = np.arange(len(q)) - start < k
    return q[near], v[near], s[near]


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64)


def block_join(rows: DataFrame, by: list[str], dim: int, k: int = K, kind: str = "<f8") -> DataFrame:
    """``(query_id, vec_id, score)``: for rows ``(by..., is_query, id, bs, v)`` the k nearest vectors of each query in its block, among those whose bucket is one of the query's ``bs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, size = [none], 0

        def search(ids: np.ndarray, is_query: np.ndarray, bs: np.ndarray, vectors: np.ndarray) -> None:
            nonlocal held, size
            q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
            if not len(q) or not len(c):
                return
            of = np.frombuffer(b"".join(bs[c]), "<i8")
            order = np.argsort(of, kind="stable")
            c, of = c[order], of[order]
            own, against = ids[c], vectors[c]
            for i in q.tolist():
                to = np.frombuffer(bs[i], "<i8")
                lo, n = np.searchsorted(of, to, side="left"), np.searchsorted(of, to, side="right")
                n = n - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = at[own[at] != ids[i]]
                if not len(at):
                    continue
                score = np.sqrt(((vectors[i] - against[at]) ** 2).sum(axis=-1))
                near = np.arange(len(at))
                if len(at) > 4 * k:  # an over-full choice first; ties with its last one stay in
                    near = np.flatnonzero(score <= np.partition(score, 4 * k)[4 * k])
                found = best((np.full(len(near), ids[i]), own[at[near]], score[near]), k)
                if len(found[0]) < k and len(near) < len(at):  # repeated ids crowd the choice: then all are looked at
                    found = best((np.full(len(at), ids[i]), own[at], score), k)
                held.append(found)
                size += len(found[0])
            if size > HELD_ROWS:
                held = [best(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                size = len(held[0][0])

        keys = ids = is_query = bs = vectors = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(by))], axis=1)
            n = len(by)
            part = (own, batch.column(n + 1).to_numpy(zero_copy_only=False), batch.column(n).to_numpy(zero_copy_only=False).astype(bool), np.array([*batch.column(n + 2).to_pylist(), None], dtype=object)[:-1], _matrix(batch.column(n + 3), dim, kind))
            keys, ids, is_query, bs, vectors = part if keys is None else (np.concatenate(x) for x in zip((keys, ids, is_query, bs, vectors), part, strict=True))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                search(ids[a:b], is_query[a:b], bs[a:b], vectors[a:b])
            keys, ids, is_query, bs, vectors = (x[cuts[-1] :] for x in (keys, ids, is_query, bs, vectors))
            if size > HELD_ROWS // 2:  # results of many queries leave before they pile up
                q, v, s = best(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])
                held, size = [none], 0
        if keys is not None:
            search(ids, is_query, bs, vectors)
        q, v, s = best(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return rows.select(*by, "is_query", "id", "bs", "v").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows ``(by..., is_query, id, bs, v)`` of groups, dealt out to blocks ``nb`` of vectors and ``qb`` of queries; groups without the one or the other go."""
    load = rows.groupBy(*by).agg(F.count_if(~F.col("is_query")).alias("n"), F.count_if("is_query").alias("m")).filter("n > 0 and m > 0")
    load = load.select(*by, F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("qb"))
    mine = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    d = rows.join(load, by)
    d = d.withColumn("nbs", F.when(F.col("is_query"), all_of("nb")).otherwise(mine("nb"))).withColumn("qbs", F.when(F.col("is_query"), mine("qb")).otherwise(all_of("qb")))
    return d.withColumn("nb", F.explode("nbs")).withColumn("qb", F.explode("qbs"))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each query among all rows but its own, Euclidean, ties to the smaller id.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite components, take
    no part, nor do vectors of another dimension than most have.  An id given more than once counts
    once, at its nearest vector.  A query that found fewer than k (and fewer than there are) is
    compared with all rows, in blocks; so is every query where no number of probes reaches TARGET.  Other columns are left out; no usable rows give no rows.
    """
    spark = vectors.sparkSession
    # vectors travel in their own precision and are compared in double precision
    element, kind = ("float", "<f4") if dict(vectors.dtypes)[vector_col] == "array<float>" else ("double", "<f8")
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("bigint").alias("id"), is_query.alias("is_query"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, candidates = sizes["dim"], sizes["ids"] - 1
    rows = rows.filter(F.size("v") == dim)
    # about FIT_VECTORS rows, by a hash of the id: no sort, and no task sends more than its share
    share = int(min(1.0, FIT_VECTORS / sizes["n"]) * (1 << 31))
    sample = np.array([r["v"] for r in rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share).collect()]).reshape(-1, dim)
    if not len(sample):
        sample = np.array([rows.first()["v"]])
    model, probes = fitted(sample, sizes["n"], k)
    shared = spark.sparkContext.broadcast(model)
    groups = max(1, sizes["n"] // BLOCK_VECTORS)

    def hashed(batches: Iterator[pa.RecordBatch], probes: int = probes) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, asks = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                x = np.array(part.column(2).to_pylist(), dtype=np.float64).reshape(-1, dim)
                blobs = [v.tobytes() for v in x.astype(kind)]
                t, g, q, who, bs = [], [], [], [], []
                for table in range(len(model.directions) if probes else 1):
                    cells = model.cells(x, table)
                    # without probes all is one bucket, and groups are blocks of vectors that every query visits
                    own = bucket(np.floor(cells)) if probes else np.zeros(len(ids), np.int64)
                    t += [table] * len(ids)
                    g += (own % groups).tolist() if probes else (bucket(ids[:, None]) % groups).tolist()
                    q += [False] * len(ids)
                    who += range(len(ids))
                    bs += [b.tobytes() for b in own.astype("<i8")]
                    for i in np.flatnonzero(asks).tolist():
                        if probes:
                            to = np.unique(bucket(visited(cells[i], probes)))
                            to = to[np.argsort(to % groups, kind="stable")].astype("<i8")
                            cuts = [0, *(np.flatnonzero(np.diff(to % groups)) + 1).tolist(), len(to)]
                            g += (to[cuts[:-1]] % groups).tolist()
                            bs += [to[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                        else:
                            cuts = range(groups + 1)
                            g += range(groups)
                            bs += [own[:1].astype("<i8").tobytes()] * groups
                        t += [table] * (len(cuts) - 1)
                        q += [True] * (len(cuts) - 1)
                        who += [i] * (len(cuts) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(g, pa.int64()), pa.array(q), pa.array(ids[who]), pa.array(bs, pa.binary()), pa.array([blobs[i] for i in who], pa.binary())], ["t", "g", "is_query", "id", "bs", "v"])

    schema, by = "t int, g bigint, is_query boolean, id bigint, bs binary, v binary", ["t", "g"]
    # hashed twice, once to count groups and once to deal them out: cheaper than to keep TABLES copies of every vector on disk
    found = durable(_merged(block_join(dealt(rows.mapInArrow(hashed, schema), by), [*by, "nb", "qb"], dim, k, kind), k))
    if probes:
        asked = rows.filter("is_query").select("id").distinct()
        short = durable(asked.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, candidates)).select("id"))
        if not short.isEmpty():
            again = rows.filter("not is_query").unionByName(rows.filter("is_query").withColumn("is_query", F.lit(False))).unionByName(rows.filter("is_query").join(short, "id", "left_semi"))
            every = again.mapInArrow(lambda b: hashed(b, 0), schema)
            rest = _merged(block_join(dealt(every, by), [*by, "nb", "qb"], dim, k, kind), k)
            found = found.join(short.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
