"""SimHash near-duplicate groups by a generalised pigeonhole search.

If two 64-bit fingerprints differ in at most t bits, and the bits are split into partitions with thresholds whose (t_i + 1) sum
to t + 1, then some partition differs in at most t_i bits. Correlated bits share a partition, so that what they repeat is paid
for once; the thresholds (and the number of partitions) are chosen by dynamic programming on the estimated numbers of probes and
candidates. Every distinct fingerprint is indexed once per partition under its bits there and probes with all values within
t_i flips; the join is on (partition, value), candidates are verified on all 64 bits, and components are taken over the links.
Rows with equal fingerprints are folded into one node first, so a group of copies costs one row.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; texts of fewer than `width`
words are one shingle; repeated rows share a fingerprint (and a component); other columns are ignored; an empty table gives an
empty result; null ids take part in no component and have a null one unless another row of the group has an id.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, row_key, written
from .components import components

BITS = 64
ID, KEY = "_kept_id", "_kept_key"
#: Fingerprints looked at to group bits and estimate candidates.
SAMPLE = 2000
#: What verifying a candidate costs, in probes.
CANDIDATE_COST = 5.0


def fingerprint(text: str, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the shingles of a text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches):
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield as_batch(pa.schema([("doc_id", batch.schema.field(0).type), ("fp", pa.int64())]), doc_id=batch.column(0), fp=fps)

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def partitions(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each grown from its first free bit by the most correlated one."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(float)
    spread = bits - bits.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    near = np.abs(spread.T @ spread / norm / norm[:, None])
    free, found = list(range(BITS)), []
    for k in range(parts):
        group = [free.pop(0)]
        while len(group) < len(range(k, BITS, parts)):
            group.append(free.pop(int(np.argmax(near[np.ix_(free, group)].sum(axis=1)))))
        found.append(sorted(group))
    return found


def estimated(sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """The share of pairs that differ in at most 0, 1, ..., most bits of a group: as seen in the sample, and at least as if bits were independent."""
    mask = np.uint64(sum(1 << b for b in group))
    own = sample & mask
    seen = np.zeros(most + 1)
    for k in range(1, len(own)):
        d = np.bitwise_count(own[k:] ^ own[:-k])[np.bitwise_count(sample[k:] ^ sample[:-k]) > most]  # links themselves cost the same in any plan
        seen += [(d <= t).sum() for t in range(most + 1)]
    seen /= max(1, len(own) * (len(own) - 1) / 2)
    ones = np.array([((own >> np.uint64(b)) & np.uint64(1)).mean() if len(own) else 0.5 for b in group])
    ways = np.zeros(most + 1)
    ways[0] = 1.0
    for p in 2 * ones * (1 - ones):
        ways = ways * (1 - p) + np.append(0, ways[:-1]) * p
    return np.maximum(seen, np.cumsum(ways)).tolist()


def allocate(costs: list[list[float]], need: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: not probed) with sum(t_i + 1) = need at the least total cost; costs[i][t] is that of t_i = t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(need - used, len(own))):
                if used + t + 1 <= need and t < len(own):
                    new = (cost + (own[t] if t >= 0 else 0.0), [*chosen, t])
                    if used + t + 1 not in after or new[0] < after[used + t + 1][0]:
                        after[used + t + 1] = new
        best = after
    return best[need]


def plan(sample: np.ndarray, rows: int, most: int) -> list[tuple[int, int, list[int]]]:
    """(partition mask, threshold, flips to probe with) of the cheapest split into two or more partitions."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)  # an empty table has any plan
    choices = []
    for parts in range(2, most + 2):
        groups = partitions(sample, parts)
        costs = []
        for g in groups:
            shares = estimated(sample, g, most)
            costs.append([rows * sum(comb(len(g), j) for j in range(t + 1)) + CANDIDATE_COST * rows * rows / 2 * shares[t] for t in range(most + 1)])
        cost, chosen = allocate(costs, most + 1)
        choices.append((cost, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    if most == 0:
        return [(-1, 0, [0])]
    out = []
    for g, t in min(choices)[2]:
        flips = [0]
        layer = [(0, -1)]
        for _ in range(t):
            layer = [(f | 1 << b, k) for f, last in layer for k, b in enumerate(g) if k > last]
            flips += [f for f, _ in layer]
        out.append((_signed(sum(1 << b for b in g)), t, [_signed(f) for f in flips]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_fingerprints(fps: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of column fp that differ in at most `most` bits."""
    rows = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    index, probe = [], []
    for k, (mask, _, flips) in enumerate(plan(sample, rows, most)):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        index.append(fps.select(F.col("fp").alias("a"), F.lit(k).alias("part"), own.alias("value")))
        probe.append(fps.select(F.col("fp").alias("b"), F.lit(k).alias("part"), own.alias("own"), F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip")).select("b", "part", F.col("own").bitwiseXOR(F.col("flip")).alias("value")))
    left, right = index[0], probe[0]
    for x, y in zip(index[1:], probe[1:], strict=True):
        left, right = left.union(x), right.union(y)
    hits = left.join(right, ["part", "value"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return hits.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) and n_links (other distinct fingerprints in reach of a link)."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = written(similar_fingerprints(nodes.select("fp"), most), "similar")
    both = links.union(links.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "fp")
    named = links.join(nodes.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    roots = components(named.select("u", "v").where("u is not null and v is not null"), "u", "v")
    classes = nodes.join(degree, "fp", "left").join(roots.withColumnRenamed("node", "first"), "first", "left")
    classes = classes.select("fp", F.coalesce("root", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, most: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the smallest id of each group, one of repeated ids; all rows with a null id stay. Columns are unchanged."""
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), most, width, id_col, text_col)
    # of rows that share an id one text stays: that of the smallest key
    one = found.where("doc_id = component_id").select(F.col("doc_id").alias(ID)).distinct()
    known = docs.where(F.col(id_col).isNotNull()).withColumn(KEY, row_key(id_col, text_col))
    first = written(known.groupBy(F.col(id_col).alias(ID)).agg(F.min(KEY).alias(KEY)).join(one, ID), "kept")
    return known.join(first, (known[id_col] == first[ID]) & (known[KEY] == first[KEY]), "left_semi").dropDuplicates([id_col]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
