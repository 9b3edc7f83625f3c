"""Near copies: texts whose SimHash fingerprints (of the same shingles) differ in at most MOST bits, and texts whose sets of word shingles have an
exact Jaccard similarity of `SIMILARITY` or more. Both are links, and groups are the components of all links.

The first are found by op9's search, which misses none. Candidates of the second come from SimHash fingerprints: the 64 majority bits are cut in BLOCKS blocks, and two texts meet if all bits of some
AGREE blocks agree, so no pair that differs in at most BLOCKS - AGREE bits is missed. At similarity 0.8 about 10 bits differ, too
many for a search that must not form far pairs (see README), so the reach is carried on to there by MinHash bands: of BANDS times
ROWS minima, two texts also meet if all minima of some band agree; at 0.8 a pair meets in no band with probability
(1 - 0.8 ** 4) ** 25 = 2e-6. Each of these links is verified on the texts' own sets before components.

In the bucket of a band or of some blocks, all are held against one of them first, so that a group of g copies gives g pairs a
bucket. Then, without that one, those outside the bucket's largest component so far are held against all of the bucket, in parts: a
part of the asking sets meets a part of the sets in one row, and a task gives back one link for each asking text and component it
reaches, so no pair but a link is ever a row.
Texts that are equal word by word are folded into one node first.

Defined results: words are between ASCII white space, ASCII letters without case; texts of at most `width` words are one
shingle; texts without words (null, empty, blank) are copies of each other and of no other; of each group a row of the smallest id
stays, the one of the smallest key if several texts have that id, and repeated rows stay once; rows with a null id all stay;
columns are unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, as_batch, chunks, free_name, row_key, written
from .components import components
from .simhash import BITS, fingerprint, similar_fingerprints

WIDTH, SIMILARITY = 5, 0.8
#: Bits in which fingerprints that are links may differ.
MOST = 3
#: Blocks of a fingerprint, and how many must agree for a pair to be a candidate.
BLOCKS, AGREE = 6, 3
BANDS, ROWS = 25, 4
#: Pairs of a node that are verified in one task at least.
SALT = 64
#: Nodes in a block, and bytes of their sets, both about.
BLOCK, BLOCK_BYTES = 128, 4 << 20
#: Shingles whose minima are taken at once.
AT_ONCE = 4096
_seeded = np.random.default_rng(11)
FACTORS = (_seeded.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
OFFSETS = _seeded.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The sorted different XXH64 (seed 42) of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def band_values(shingles: np.ndarray) -> list[int]:
    """A hash of the minima of each band, and of its number."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint64)
    for k in range(0, len(shingles), AT_ONCE):
        least = np.minimum(least, ((shingles[k : k + AT_ONCE] * FACTORS + OFFSETS) >> np.uint64(32)).min(axis=1))
    raw = least.astype(np.uint32).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(raw[b].tobytes(), b) - (1 << 63) for b in range(BANDS)]


#: The bits of each choice of AGREE blocks; bits k, k + BLOCKS, ... are block k.
MASKS = [sum(1 << b for k in chosen for b in range(k, BITS, BLOCKS)) for chosen in combinations(range(BLOCKS), AGREE)]


def block_values(fp: int) -> list[int]:
    """A hash of the bits of each choice of AGREE blocks of a fingerprint, and of its number."""
    return [xxhash.xxh64_intdigest((fp & mask).to_bytes(BITS // 8, "big"), BANDS + k) - (1 << 63) for k, mask in enumerate(MASKS)]


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(key, id, node: a hash of the words, size: of the set of shingles, fp: the fingerprint, none without words, bands: those of the fingerprint's blocks and of the minima) of rows (key, id, text)."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.string()), ("node", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches):
            nodes, sizes, fps, bands = [], [], [], []
            for t in texts:
                words = split(t)
                shingles = shingle_set(words, width)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), 7) - (1 << 63))
                sizes.append(len(shingles))
                fp = fingerprint(t, width)
                fps.append((fp + (1 << 63)) % (1 << 64) - (1 << 63) if words else None)
                bands.append(block_values(fp) + band_values(shingles) if words else [])
            kinds = schema.set(1, pa.field("id", batch.schema.field(1).type))
            yield as_batch(kinds, key=batch.column(0), id=batch.column(1), node=nodes, size=sizes, fp=fps, bands=bands)

    return rows.mapInArrow(run, f"key long, id {kind}, node long, size int, fp long, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, shingles as bytes) are similar; pairs of a much paired node go to several tasks."""
    ways = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("ways"))
    one = sets.join(ways, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("salt"), F.col("shingles").alias("x"))
    dealt = pairs.join(ways, "a").select("a", "b", F.pmod(F.xxhash64("b"), "ways").cast("int").alias("salt"))
    laid = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(one, ["a", "salt"]).select("a", "b", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                near.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            found = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield as_batch(schema, a=found.column(0), b=found.column(1))

    return laid.mapInArrow(run, "a long, b long")


def alike_fingerprints(found: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints differ in at most MOST bits: of each fingerprint's nodes to its first one, and of first ones."""
    nodes = written(found.where("fp is not null").select("fp", "node").distinct(), "fingerprints")
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    own = nodes.join(first, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = written(similar_fingerprints(first.select("fp"), MOST), "similar")
    named = pairs.join(first.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    return written(own.union(named.select("u", "v")), "alike")


def groups(rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(key, id, root) of rows (key, id, text): those of a group share the root."""
    found = written(sketches(rows, width), "sketches")
    # rows alike in their words are one node before its bands are dealt out
    each = written(found.select("node", "size", "bands").dropDuplicates(["node"]), "nodes").select("node", "size", F.explode("bands").alias("band"))
    order = F.xxhash64("node", "band")  # so that a group's buckets have different first ones
    buckets = each.groupBy("band").agg(F.count("*").alias("n"), F.min_by("node", order).alias("first"), F.min_by("size", order).alias("first_size")).where("n > 1").select("band", "first", "first_size")
    # a subset's size is the most that two sets can share
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9
    buckets = written(buckets, "buckets")
    members = written(KeyFilter(buckets, "band", "bands").split(each, "band")[0].join(buckets, "band"), "members")  # most bands have no partner and stay where they are
    pairs = written(members.where("node != first").where(alike(F.col("size"), F.col("first_size"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    near = written(found.groupBy("node").agg(F.min("key").alias("key")).join(members.select("node").distinct(), "node"), "near")

    def hashed(batches):
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
        for batch, texts in chunks(batches):
            yield as_batch(schema, node=batch.column(0), shingles=[shingle_set(split(t), width).tobytes() for t in texts])

    wanted = KeyFilter(near, "key", "near").split(rows, "key")[0]  # other texts aren't shuffled
    sets = written(wanted.join(near, "key").dropDuplicates(["node"]).select("node", "text").mapInArrow(hashed, "node long, shingles binary"), "sets")
    links = written(verified(pairs, sets, similarity).union(alike_fingerprints(found)), "copies")
    roots = components(links)
    # all have been held against the first one
    own = members.where("node != first").join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = own.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    own = written(own.join(mixed, "band", "left_semi"), "mixed")
    roots = components(links.union(joining(own, sets, similarity)))
    return found.join(roots, "node", "left").select("key", "id", F.coalesce("root", "node").alias("root"))


def joining(own: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components of the nodes own (band, node, size, root): for each node outside its bucket's largest component one to each other component that has a similar node in the bucket."""
    largest = own.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("band").agg(F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size * 8 / BLOCK_BYTES, F.lit(1))).cast("int")
    size = written(largest.select("band", "main.root", blocks(F.col("n"), F.col("size")).alias("blocks"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("asks")).withColumnRenamed("root", "main"), "sizes")
    full = written(own.select("band", "node", "root").join(size, "band").join(sets, "node"), "full")
    block = F.collect_list(F.struct("node", "root", "shingles"))
    held = full.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).groupBy("band", "block", "asks").agg(block.alias("held")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    asking = full.where("root <> main").withColumn("ask", F.pmod(F.xxhash64("node", F.lit(1)), "asks").cast("int")).groupBy("band", "ask", "blocks").agg(block.alias("asking")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                held_rows, asking_rows = (batch.column(k)[row].as_py() for k in (0, 1))
                parts = [np.frombuffer(x["shingles"], np.uint64) for x in held_rows]
                sizes = np.array([len(x) for x in parts])
                values, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                nodes, roots = (np.array([x[c] for x in held_rows], np.int64) for c in ("node", "root"))
                a, b = [], []
                for x in asking_rows:
                    own_set = np.frombuffer(x["shingles"], np.uint64)
                    low, high = np.searchsorted(values, own_set, "left"), np.searchsorted(values, own_set, "right")
                    n = high - low
                    same = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(parts))
                    near = np.flatnonzero((same >= similarity * (len(own_set) + sizes - same) - 1e-9) & (roots != x["root"]))
                    _, first = np.unique(roots[near], return_index=True)
                    a += [x["node"]] * len(first)
                    b += nodes[near[first]].tolist()
                yield as_batch(schema, a=a, b=b)

    return written(held.join(asking, ["band", "block", "ask"]).select("held", "asking").mapInArrow(run, "a long, b long"), "joining")


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of the smallest id of each group, and all rows with a null id. Columns are unchanged."""
    key = free_name(docs, "key")
    known = docs.where(F.col(id_col).isNotNull()).withColumn(key, row_key(id_col, text_col))
    rows = known.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = groups(rows, width, similarity).groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    kept = written(kept.select(F.col("first.key").alias(key)), "kept")
    return KeyFilter(kept, key, "kept").split(known, key)[0].join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns).union(docs.where(F.col(id_col).isNull()))
