"""Approximate nearest neighbours by balanced posting lists.

A bounded sample of the vectors is split again and again into balanced clusters until each is small; their centroids name the
posting lists. Centroids are searched by an in-memory graph: each is linked to its nearest ones, and a search walks from fixed
entry points along the links with a beam. Every vector is indexed under its nearest centroid and, as a boundary vector, under
others that are hardly farther (unless a chosen centroid is nearer to that one than the vector is). A query reads the nearest lists
whose centroid's distance is within a ratio of the nearest's. Nearness is the cosine in double precision.

How many lists and what ratio follow from the data: PROBED queries, those of the smallest hash, are answered exactly by one pass over all vectors;
the number is the least that would have led to the share AIM of their true neighbours, and the ratio the least that loses none of these. So recall
doesn't fall as lists become more or dimensions higher; where no distance tells lists apart, more of them are read.

Equal vectors are folded before anything is shuffled: only their smallest ids can be among the nearest, so a group of copies
is one entry. Lists are cut into blocks of vectors, and a list's queries into blocks, so that a large list is many rows; block
pairs meet by a join on list, block and a group of query blocks, and each pair is one matrix product that returns each query's best.
Queries that find fewer than they could (their few lists hold less) read all lists. The centroids (at most
MOST_LISTS) and their graph are broadcast: 64 dimensions take 4 MB and 1 MB. Beyond MOST_LISTS times LIST_SIZE vectors the lists grow
with the table instead of their number.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most, take no
part, and rows with a null id neither; rows repeated with the same id count once, and if their vectors differ that of the least hash
counts; components may be as large or small as doubles are; ties go to the smaller id; with fewer
candidates than `k` all found are returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, as_batch, written

#: Vectors a list is meant to hold, lists at most, and vectors looked at for each list to place its centroid.
LIST_SIZE, MOST_LISTS, SAMPLE_PER_LIST = 100, 8192, 8
#: Links of a centroid, and width of the beam.
LINKS, BEAM = 24, 64
#: Lists a vector stands in at most, and how much farther they may be.
COPIES, NEAR = 4, 1.15
#: Queries that are answered exactly to find how many lists are read, and the share of their neighbours that these must lead to; the ratio where the number is given.
PROBED, AIM, RATIO = 200, 0.96, 1.6
#: Vectors and queries in a block, and query blocks that meet a block of vectors in one task.
BLOCK, QUERY_BLOCK, ASKS = 512, 128, 16


def balanced_centroids(x: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of clusters of at most `size` rows, neighbours in the tree next to each other."""
    rng = np.random.default_rng(seed)
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            mean = x[rows].mean(axis=0)
            done.append(mean / max(np.linalg.norm(mean), 1e-12) if np.linalg.norm(mean) > 1e-9 else x[rows[0]])
            continue
        k = min(8, -(-len(rows) // size))
        centers = x[rng.choice(rows, k, replace=False)]
        for _ in range(6):
            own = _even(x[rows] @ centers.T, -(-len(rows) // k))
            centers = np.stack([x[rows[own == j]].mean(axis=0) if (own == j).any() else centers[j] for j in range(k)])
        todo += [rows[own == j] for j in range(k) if (own == j).any()]
    return np.array(done, np.float32)


def _even(nearness: np.ndarray, room: int) -> np.ndarray:
    """A cluster for each row, the nearest that has room; rows that lose most by another choice come first."""
    ranks = np.argsort(-nearness, axis=1)
    two = np.take_along_axis(nearness, ranks[:, :2], axis=1)
    own, left = np.full(len(nearness), -1), np.full(nearness.shape[1], room)
    order = np.argsort(two[:, -1] - two[:, 0], kind="stable")
    for place in range(nearness.shape[1]):
        for j in range(nearness.shape[1]):
            wish = order[(own[order] < 0) & (ranks[order, place] == j)][: left[j]]
            own[wish] = j
            left[j] -= len(wish)
    return own


class CentroidGraph:
    """Unit centroids, each linked to its nearest ones."""

    def __init__(self, centroids: np.ndarray, links: int = LINKS, entries: int = 64):
        self.centroids, n = centroids, len(centroids)
        links = min(links, max(1, n - 1))
        self.links = np.zeros((n, links), np.int32)
        for at in range(0, n, 1024):
            near = centroids[at : at + 1024] @ centroids.T
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
            self.links[at : at + 1024] = np.argpartition(-near, links - 1, axis=1)[:, :links] if n > 1 else 0
        # far links as well, so that no part of the graph is out of reach
        self.links = np.concatenate([self.links, ((np.arange(n)[:, None] * 7919 + np.arange(1, 3) * (n // 3 + 1)) % n).astype(np.int32)], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, entries)).astype(np.int32))

    def search(self, queries: np.ndarray, beam: int = BEAM, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids found for each query, nearest first, and their cosines."""
        q, n = len(queries), len(self.centroids)
        beam = min(beam, n)
        seen = np.zeros((q, n), bool)
        found = np.tile(self.entries, (q, 1))
        near = queries @ self.centroids[self.entries].T
        seen[:, self.entries] = True
        opened = np.zeros(found.shape, bool)
        rows = np.arange(q)[:, None]
        while True:
            order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            found, near, opened = (np.take_along_axis(a, order, axis=1) for a in (found, near, opened))
            wait = np.where(opened | np.isneginf(near), -np.inf, near)
            pick = np.argsort(-wait, axis=1, kind="stable")[:, :step]
            live = np.take_along_axis(wait, pick, axis=1) > -np.inf
            if not live.any():
                return found, near
            np.put_along_axis(opened, pick, True, axis=1)
            after = self.links[np.take_along_axis(found, pick, axis=1)].reshape(q, -1)
            fresh = np.repeat(live, self.links.shape[1], axis=1) & ~seen[rows, after]
            after_sorted = np.sort(np.where(fresh, after, n), axis=1)  # each new one once
            fresh = (after_sorted < n) & np.concatenate([np.ones((q, 1), bool), after_sorted[:, 1:] != after_sorted[:, :-1]], axis=1)
            after = np.where(fresh, after_sorted, 0)
            seen[rows, after] |= fresh
            r, c = np.nonzero(fresh)
            new = np.full(after.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("ij,ij->i", queries[r], self.centroids[after[r, c]])
            found, near, opened = np.concatenate([found, after], axis=1), np.concatenate([near, new], axis=1), np.concatenate([opened, ~fresh], axis=1)


def _apart(near: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * near, 1e-12))


def lists_of_vector(graph: CentroidGraph, x: np.ndarray, copies: int = COPIES, far: float = NEAR) -> list[np.ndarray]:
    """The lists in which each unit vector stands."""
    found, near = graph.search(x, beam=24)
    apart = _apart(near)
    out = []
    for lists, d in zip(found, apart, strict=True):
        chosen = [lists[0]]
        for c, own in zip(lists[1:], d[1:], strict=True):
            if len(chosen) == copies or own > far * d[0]:
                break
            if (_apart(graph.centroids[chosen] @ graph.centroids[c]) >= own).all():
                chosen.append(c)
        out.append(np.array(chosen, np.int32))
    return out


def lists_of_query(graph: CentroidGraph, x: np.ndarray, probes: int, ratio: float) -> list[np.ndarray]:
    """The lists that each unit query reads: the nearest `probes`, but for those beyond the ratio. The beam is wider than they are many."""
    beam = max(BEAM, probes + probes // 3)
    found, near = graph.search(x, beam, step=max(4, beam // 16))
    apart = _apart(near)
    return [lists[:probes][d[:probes] <= ratio * d[0]].astype(np.int32) for lists, d in zip(found, apart, strict=True)]


def reading_for(nodes: DataFrame, asked: DataFrame, graph: CentroidGraph, dim: int, k: int, aim: float, probed: int) -> tuple[int, float]:
    """How many lists must be read for `probed` of the queries to meet the share `aim` of their k nearest vectors, and the least ratio of distances that loses none of these."""
    few = [r["vec"] for r in asked.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(probed).collect()]
    if not few:
        return 1, 1.0
    held = nodes.sparkSession.sparkContext.broadcast(_unit(few, dim))
    schema = pa.schema([("query", pa.int32()), ("near", pa.float32()), ("vec", pa.binary())])

    def look(batches):
        """Each query's k + 1 nearest of each few batches."""
        q = held.value
        for batch in batches:
            if len(batch):
                near = _units(batch) @ q.T
                top = np.argsort(-near, axis=0, kind="stable")[: k + 1]
                rows, columns = top.T.ravel(), np.repeat(np.arange(len(q)), len(top))
                yield as_batch(schema, query=columns, near=near[rows, columns], vec=batch.column(0).take(pa.array(rows)).cast(pa.binary()))

    best = nodes.select("vec").mapInArrow(look, "query int, near float, vec binary").withColumn("part", F.spark_partition_id() % 512)
    for keys in (["query", "part"], ["query"]):
        best = best.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "vec")), asc=False), 1, k + 1).alias("best"))
        best = best.select(*keys, F.explode("best").alias("b")).select(*keys, "b.*")
    pairs = [(r["query"], r["vec"]) for r in best.collect() if r["vec"] != few[r["query"]]]  # (k + 1) * probed rows
    if not pairs:
        return 1, 1.0
    lists = lists_of_vector(graph, _unit([v for _, v in pairs], dim))
    apart = _apart(held.value @ graph.centroids.T)
    rank = np.argsort(np.argsort(apart, axis=1, kind="stable"), axis=1)
    need = np.array([rank[q, own].min() + 1 for (q, _), own in zip(pairs, lists, strict=True)])
    ratio = np.array([apart[q, own].min() / apart[q].min() for (q, _), own in zip(pairs, lists, strict=True)])
    probes = int(np.sort(need)[min(len(need) - 1, int(np.ceil(aim * len(need))))])
    return probes, float(ratio[need <= probes].max()) * (1 + 1e-6)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v: array of doubles) of the rows that take part, one vector for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0
    rows = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    # ids with different vectors are few: only their rows are looked at again
    several = rows.groupBy("id").agg(F.min(F.xxhash64("v")).alias("keep"), F.max(F.xxhash64("v")).alias("most")).where("keep <> most").select("id", "keep")
    several = written(several, "several")
    maybe, plain = KeyFilter(several, "id", "several").split(rows, "id")
    chosen = maybe.join(several, "id", "left").where(F.coalesce(F.xxhash64("v") == F.col("keep"), F.lit(True)))
    return plain.select("id", "v").union(chosen.select("id", "v"))


def folded(rows: DataFrame, keep: int) -> DataFrame:
    """(vec: the components as bytes, ids: the `keep` smallest ids, dim) of each different vector of rows (id, v)."""
    schema = pa.schema([("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("dim", pa.int32())])

    def local(batches):
        held: dict[bytes, list[int]] = {}

        def out():
            return as_batch(schema, vec=list(held), ids=[sorted(set(x))[:keep] for x in held.values()], dim=[len(x) // 8 for x in held])

        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths())
            ends = np.cumsum(sizes)
            flat = np.array(batch.column(1).flatten())
            for i, a, b in zip(batch.column(0).to_pylist(), ends - sizes, ends, strict=True):
                ids = held.setdefault(flat[a:b].tobytes(), [])
                ids.append(i)
                if len(ids) >= 8 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(held) > 100_000:
                yield out()
                held.clear()
        if held:
            yield out()

    few = rows.mapInArrow(local, "vec binary, ids array<long>, dim int").withColumn("part", F.spark_partition_id() % 512)
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    return few.groupBy("vec", "dim", "part").agg(least).groupBy("vec", "dim").agg(least)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: no cosine changes, and no square overflows."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -power)


def _unit(vecs: list[bytes], dim: int) -> np.ndarray:
    x = scaled(np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _units(batch: pa.RecordBatch) -> np.ndarray:
    return _unit(batch.column(0).to_pylist(), len(batch.column(0)[0].as_py()) // 8)


def _placed(nodes: DataFrame, graph, chooser) -> DataFrame:
    """nodes (vec, ids), a row for each of its lists."""
    held = nodes.sparkSession.sparkContext.broadcast(graph)
    schema = pa.schema([("list", pa.int32()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                lists = chooser(held.value, _units(part))
                where = np.repeat(np.arange(len(part)), [len(c) for c in lists])
                taken = part.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), taken.column(0).cast(pa.binary()), taken.column(1)], schema=schema)

    return nodes.select("vec", "ids").mapInArrow(run, "list int, vec binary, ids array<long>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", list_size: int = LIST_SIZE, aim: float = AIM, probed: int = PROBED, probes: int | None = None, ratio: float = RATIO) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query row its k nearest other rows found. is_query is a condition on the id column; `probes` and `ratio` are found for `aim` unless given."""
    keep = k + 1
    rows = valid(vectors, id_col, vector_col)
    nodes = written(folded(rows, keep), "nodes")
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n, known = (sizes["dim"], sizes["n"], sizes["ids"]) if sizes else (0, 0, 0)
    nodes = nodes.where(F.col("dim") == dim)
    lists = int(np.clip(-(-n // list_size), 1, MOST_LISTS))
    sample = nodes.orderBy(F.xxhash64("vec"), "vec").limit(lists * SAMPLE_PER_LIST).select("vec").toArrow().combine_chunks()
    graph = None
    if n:
        units = _units(sample.to_batches()[0])
        graph = CentroidGraph(balanced_centroids(units, max(1, round(len(units) / lists))))
        lists = len(graph.centroids)
    members = written(_placed(nodes, graph, lists_of_vector), "members")
    parts = written(members.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "parts")  # a row for each list: a few times MOST_LISTS at most
    blocks = members.join(F.broadcast(parts), "list").withColumn("block", F.pmod(F.xxhash64("vec"), "blocks"))
    blocks = written(blocks.groupBy("list", "block").agg(F.collect_list("vec").alias("vecs"), F.collect_list("ids").alias("ids")), "blocks")
    named = written(rows.withColumnRenamed("id", id_col).where(is_query).select(F.col(id_col).alias("id"), "v"), "queries")
    asked = written(folded(named, 1).where(F.col("dim") == dim), "asked")
    if n and probes is None:
        probes, ratio = reading_for(nodes, asked, graph, dim, k, aim, probed)
    reads = _placed(asked, graph, lambda g, x: lists_of_query(g, x, probes, ratio)).select("list", "vec")
    best = written(best_of(blocks, parts, reads, dim, keep), "best")
    few = asked.join(best.where(F.size("best") >= min(keep, known)), "vec", "left_anti").select("vec")
    rest = written(few, "few")
    if rest.count():
        every = best_of(blocks, parts, rest.select(F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), "vec"), dim, keep)
        best = best.join(rest, "vec", "left_anti").unionByName(every)
    answers = _with_bytes(named).join(best, "vec").select("query_id", F.slice(F.filter("best", lambda b: b.id != F.col("query_id")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def best_of(blocks: DataFrame, parts: DataFrame, reads: DataFrame, dim: int, keep: int) -> DataFrame:
    """(vec, best: array of score and id) of the queries in reads (list, vec): the `keep` nearest in the lists they read."""
    reads = written(reads, "reads")
    count = reads.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asks"))
    count = written(count.join(F.broadcast(parts), "list").select("list", "blocks", "asks"), "asks")  # a row for each list
    asks = reads.join(F.broadcast(count), "list").withColumn("ask", F.pmod(F.xxhash64("vec"), "asks")).groupBy("list", "ask", "blocks").agg(F.collect_list("vec").alias("asks"))
    # each query block goes to each block of its list, and each block to each group of query blocks
    asks = asks.select("list", F.floor(F.col("ask") / ASKS).cast("int").alias("group"), "asks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    laid = blocks.join(F.broadcast(count.select("list", F.col("asks").alias("n"))), "list").select("list", F.col("block").cast("int").alias("block"), "vecs", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ASKS).cast("int"))).alias("group"))
    schema = pa.schema([("vec", pa.binary()), ("best", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))])

    def look(batches):
        for batch in batches:
            for row in range(len(batch)):
                vecs, ids, asks = (batch.column(c)[row].values for c in range(3))
                x, q = (scaled(np.frombuffer(b"".join(b.to_pylist()), np.float64).reshape(len(b), dim)) for b in (vecs, asks))
                nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                near = (q / nq[:, None]) @ (x / nx[:, None]).T
                at = max(0, near.shape[1] - keep)
                limit = np.partition(near, at, axis=1)[:, at] - 1e-9
                asked, held = np.nonzero(near >= limit[:, None])
                score = (x[held] * q[asked]).sum(axis=1) / (nx[held] * nq[asked])
                # a row for each id of a vector, then each query's best
                sizes = np.array(ids.value_lengths())
                begin, n = (np.cumsum(sizes) - sizes)[held], sizes[held]
                name = np.asarray(ids.flatten())[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
                asked, score = np.repeat(asked, n), np.repeat(score, n)
                order = np.lexsort((name, -score, asked))
                asked, score, name = asked[order], score[order], name[order]
                first = np.searchsorted(asked, np.arange(len(q)))
                kept = np.arange(len(asked)) - first[asked] < keep
                ends = np.cumsum(np.bincount(asked[kept], minlength=len(q)))
                pairs = pa.StructArray.from_arrays([pa.array(score[kept]), pa.array(name[kept], pa.int64())], ["score", "id"])
                best = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([asks.cast(pa.binary()), best.cast(schema.field(1).type)], schema=schema)

    looked = laid.join(asks, ["list", "block", "group"]).select("vecs", "ids", "asks").mapInArrow(look, "vec binary, best array<struct<score:double,id:long>>")
    # sorted, an entry that several lists gave stands next to itself
    sort = F.array_sort(F.transform(F.flatten(F.collect_list("best")), lambda b: F.struct((-b.score).alias("far"), b.id.alias("id"))))
    found = looked.groupBy("vec").agg(sort.alias("all")).select("vec", F.filter("all", lambda b, k: (k == 0) | (b != F.get("all", k - 1))).alias("all"))
    return found.select("vec", F.transform(F.slice("all", 1, keep), lambda b: F.struct((-b.far).alias("score"), b.id.alias("id"))).alias("best"))


def _with_bytes(rows: DataFrame) -> DataFrame:
    """(query_id, vec) of rows (id, v), with the vector as the bytes that folded() has."""
    schema = pa.schema([("query_id", pa.int64()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            yield as_batch(schema, query_id=batch.column(0), vec=[np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()])

    return rows.mapInArrow(run, "query_id long, vec binary").distinct()
