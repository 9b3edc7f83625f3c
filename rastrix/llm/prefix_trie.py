"""A trie of conversations' beginnings, by radix partitioning from the most significant turn on.

Turns (role and text) are dictionary-encoded: each distinct turn, known by the SHA-256 digest of both, gets an id, so only
ids are sorted and shuffled. A node of depth d is a distinct sequence of d turns; it is named by its depth and its smallest member, as two nodes of one
depth share no member.

All conversations begin in one bucket, the root. While buckets are large, a round deals the members of all of them out by their next turns
(one turn in the first round, then 2, 4 and at most 8): a grouping by bucket and the ids of those turns, which sums up within tasks before it
shuffles, gives the nodes of these depths, and the last ones are the buckets of the next round. A bucket with one member is a chain,
whose nodes are its turns. A bucket whose members have at most LOCAL turns left goes to one task, where multikey quicksort (three
ways by the symbol at one place) finishes it: each group of equal symbols is a node, emitted as the recursion (on a stack of
its own) meets it. So a task gets LOCAL turns at most, however many conversations share a beginning or how long one is. At the end subtrees are summed
up from the last round to the first.

Defined results: rows with a null conversation take no part; null roles and texts count as empty; turns follow their number, null first,
those of one number their digest; a repeated row is a turn of its own; other columns, whatever their names, are ignored; an empty table gives no node, not even a
root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, release, written

#: Turns that a bucket may have left to be finished in one task, and turns by which a round deals at most.
LOCAL, DIGITS = 8192, 8
#: Characters of conversations' numbers that are hashed at once, and rows of a batch.
PIECE, ROWS = 1 << 15, 20_000
WORD = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def encoded(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos from 1, id, words) of all turns in order, and the dictionary (id, digest, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows, "turns")
    # ids ascend with the digests, so they don't depend on how rows are dealt out
    dictionary = rows.groupBy("digest").agg(F.max("words").alias("words")).repartitionByRange("digest").sortWithinPartitions("digest")
    dictionary = written(dictionary.select(F.monotonically_increasing_id().alias("id"), "digest", "words"), "dictionary")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("id")]
    coded = written(rows.join(dictionary.select("digest", "id"), "digest").select("conv", "turn", "id", "words"), "coded")
    schema = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("id", pa.int64()), ("words", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if len(conv):
                starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
                pos = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff([*starts, len(conv)]))
                if conv[0] == last:
                    pos[: starts[1] if len(starts) > 1 else len(conv)] += had
                last, had = conv[-1], pos[-1]
                yield as_batch(schema, conv=conv, part=np.full(len(conv), part), pos=pos, id=batch.column(1), words=batch.column(2))

    # a conversation may reach over several ranges: what earlier ones hold of it is added, a row a range at most
    ranged = written(coded.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "id", "words").mapInArrow(number, "conv long, part int, pos long, id long, words long"), "ranged")
    earlier = ranged.groupBy("conv", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before is not null").select("conv", "part", "before")
    return ranged.join(F.broadcast(written(earlier, "earlier")), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "words"), dictionary


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, id, words) and lengths (conv, len) of conversations that begin with h turns of c - c % 20 in place of their own first h, h = crc32(c) % 4."""
    turns = written(turns, "numbered")
    h = (F.crc32(F.col("conv").cast("string")) % 4).alias("h")
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = turns.where((F.col("conv") % 20 == 0) & (F.col("pos") <= 3))
    known = heads.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("has"))
    plan = own.select("conv", "own", h, (F.col("conv") - F.col("conv") % 20).alias("base")).join(known, "base", "left")
    plan = plan.select("conv", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("took"), "own")
    plan = written(plan.withColumn("len", F.col("took") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "lengths")
    kept = turns.where(F.col("pos") > F.crc32(F.col("conv").cast("string")) % 4).join(plan.select("conv", "took", "h"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("took")).alias("depth"), "id", "words")
    given = plan.where("took > 0").select("conv", "base", "took").join(heads.select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "id", "words"), "base").where("depth <= took")  # 20 conversations a base at most
    return written(kept.unionByName(given.select("conv", "depth", "id", "words")), "rebuilt"), plan.select("conv", "len")


def finish(members: list[tuple[int, list[int], list[int]]]) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Nodes [name, depth, parent's place or -1, members, children, leaves, saved tokens] below a bucket, and (member, place of the node in which it ends), for members (conversation, ids, words)."""
    nodes: list[list[int]] = []
    ends = []
    stack = [(members, 0, -1)]
    while stack:
        part, at, up = stack.pop()
        mid = part[len(part) // 2][1]
        pivot = mid[at] if at < len(mid) else -1
        less, same, more = [], [], []
        for m in part:
            symbol = m[1][at] if at < len(m[1]) else -1
            (same if symbol == pivot else less if symbol < pivot else more).append(m)
        stack += [(rest, at, up) for rest in (less, more) if rest]
        if pivot < 0:
            ends += [(m[0], up) for m in same]
        else:
            nodes.append([min(m[0] for m in same), at + 1, up, len(same), 0, 0, (len(same) - 1) * same[0][2][at]])
            stack.append((same, at + 1, len(nodes) - 1))
    for node in reversed(nodes):  # parents come before their children
        node[5] = node[5] or 1
        if node[2] >= 0:
            above = nodes[node[2]]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes, ends


def finished(rows: DataFrame) -> DataFrame:
    """Nodes (kind 0), sums of buckets (1) and ends (2: conv_id ends in the node parent_conv_id) of rows (node, top, conv, depth, id, words) of buckets, each in one task."""
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))])

    def close(name: int, top: int, members: dict[int, tuple[list[int], list[int]]]) -> list[tuple]:
        nodes, ends = finish([(c, *m) for c, m in members.items()])
        tops = [x for x in nodes if x[2] < 0]
        out = [(0, x[0], top + x[1], nodes[x[2]][0] if x[2] >= 0 else name, *x[3:]) for x in nodes]
        out.append((1, name, top, None, None, len(tops), sum(x[5] for x in tops), sum(x[6] for x in tops)))
        return out + [(2, c, top + nodes[at][1], nodes[at][0], None, None, None, None) for c, at in ends]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, members, out = None, {}, []
        for batch in batches:
            for node, top, conv, id_, words in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (node, top) != bucket:
                    if members:
                        out += close(*bucket, members)
                    bucket, members = (node, top), {}
                ids, counts = members.setdefault(conv, ([], []))
                ids.append(id_)
                counts.append(words)
                if len(out) > ROWS:
                    yield as_batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                    out = []
        if members:
            out += close(*bucket, members)
        if out:
            yield as_batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
        release()

    dealt = rows.repartition("node", "top").sortWithinPartitions("node", "top", "conv", "depth").select("node", "top", "conv", "id", "words")
    return dealt.mapInArrow(run, "kind int, " + NODE)


def trie(turns: DataFrame, lengths: DataFrame, local: int = LOCAL, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """Nodes (NODE), and (conv, node, depth): in which node each conversation ends. turns: (conv, depth, id, words); lengths: (conv, len), also of conversations without turns."""
    spark = turns.sparkSession
    root, n, rest = lengths.agg(F.min("conv"), F.count("*"), F.sum("len")).first()
    if not n:
        return spark.createDataFrame([], NODE), spark.createDataFrame([], "conv long, node long, depth long")
    # where each conversation stands after a round: (conv, len, node, depth, n, rest: turns that the node's members have left)
    stands = [lengths.select("conv", "len", F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(n).cast("long").alias("n"), F.lit(rest).cast("long").alias("rest"))]
    large, begin, rounds = (F.col("len") > F.col("depth")) & (F.col("n") > 1) & (F.col("rest") > local), 0, []
    while not (big := stands[-1].where(large)).isEmpty():
        take = min(1 << len(rounds), digits)
        next_turns = turns.where((F.col("depth") > begin) & (F.col("depth") <= begin + take)).join(big.select("conv", "node", "len"), "conv")
        held = next_turns.groupBy("conv", "node", "len").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "words"))).alias("s")).select("conv", "node", "len", F.col("s.id").alias("ids"), F.col("s.words").alias("words"))  # `take` turns at most
        held = written(held, "dealt")
        each = held.select("conv", "node", "ids", "words", "len", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("at"))
        groups = each.groupBy("node", F.slice("ids", 1, F.col("at")).alias("key")).agg(F.min("conv").alias("child"), F.count("*").alias("n"), F.max(F.element_at("words", F.col("at"))).alias("words"), F.sum(F.col("len") - begin - F.col("at")).alias("rest"))
        groups = written(groups, "groups")
        stand = held.join(groups.select("node", F.col("key").alias("ids"), "child", "n", "rest"), ["node", "ids"]).select("conv", "len", F.col("child").alias("node"), (F.lit(begin) + F.size("ids")).cast("long").alias("depth"), "n", "rest")
        stands.append(written(stand, "stands"))
        rounds.append((groups, begin, take))
        begin += take
    every = stands[0]
    for s in stands[1:]:
        every = every.unionByName(s)
    left = every.where((F.col("len") > F.col("depth")) & ~large).select("conv", "len", "node", F.col("depth").alias("top"), "n")
    left = written(turns.join(left, "conv").where("depth > top"), "left")
    chains = left.where("n = 1").select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    done = written(finished(left.where("n > 1")), "finished")
    ends = every.where("len = depth").select("conv", "node", "depth").unionByName(chains.where("n_children = 0").select(F.col("conv_id").alias("conv"), F.col("conv_id").alias("node"), "depth"))
    ends = ends.unionByName(done.where("kind = 2").select(F.col("conv_id").alias("conv"), F.col("parent_conv_id").alias("node"), "depth"))
    nodes = chains.unionByName(done.where("kind = 0").drop("kind"))
    sums = done.where("kind = 1").select(F.col("conv_id").alias("child"), "depth", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    for groups, begin, take in reversed(rounds):
        size = F.size("key")
        alone = (size == take) & (F.col("n") == 1) & (F.col("rest") > 0)  # the top of a chain
        known = groups.withColumn("depth", (size + begin).cast("long")).join(sums.where(F.col("depth") == begin + take), ["child", "depth"], "left")
        own = known.select("node", "key", size.alias("size"), F.when(alone, 1).otherwise(F.coalesce("kids", F.lit(0))).alias("kids"), F.when(alone | (F.col("rest") == 0), 1).otherwise(F.coalesce("leaves", F.lit(0))).alias("leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved"))
        up = own.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size")))).groupBy("node", F.slice("key", 1, F.col("at")).alias("key"))
        up = written(up.agg(F.sum(F.when(F.col("at") == F.col("size"), F.col("kids")).when(F.col("at") == F.col("size") - 1, 1).otherwise(0)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sums")
        above = groups.select("node", F.col("key").alias("above"), F.col("child").alias("parent"))
        named = groups.withColumn("above", F.slice("key", 1, size - 1)).join(above, ["node", "above"], "left").join(up, ["node", "key"])
        nodes = nodes.unionByName(named.select(F.col("child").alias("conv_id"), (size + begin).cast("long").alias("depth"), F.coalesce("parent", "node").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
        sums = sums.unionByName(up.where(F.size("key") == 0).select(F.col("node").alias("child"), F.lit(begin).cast("long").alias("depth"), F.col("kids").cast("long").alias("kids"), F.col("leaves").cast("long").alias("leaves"), "saved"))
    top = spark.createDataFrame([(root, 0, n)], "child long, depth long, n long").join(sums.where("depth = 0"), ["child", "depth"], "left")
    chain = int(n == 1 and rest > 0)
    nodes = nodes.unionByName(top.select(F.col("child").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("kids", F.lit(chain)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens")))
    return nodes, ends


def with_digests(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ends_sha256, of the numbers of the conversations that end there, ascending and comma-joined. Numbers are joined to pieces by ranges of all ends, so a node in which many end is many tasks' work; its pieces pass the hash one by one."""
    keys = ["node", "depth"]
    joined = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])])[: len(node)])
            cut = np.unique(np.concatenate([cut, np.arange(0, len(node), PIECE // 10)])).astype(np.int64)
            names = conv.astype(str).tolist()
            yield as_batch(joined, node=node[cut], depth=depth[cut], first=conv[cut], piece=[",".join(names[a:b]) for a, b in zip(cut, [*cut[1:], len(node)], strict=True)])

    hashed = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for node, depth, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (node, depth) == key:
                    state.update(b"," + piece.encode())
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (node, depth), hashlib.sha256(piece.encode())
            if out:
                yield as_batch(hashed, **dict(zip(hashed.names, zip(*out, strict=True), strict=True)))
        if key:
            yield as_batch(hashed, node=[key[0]], depth=[key[1]], sha=[state.hexdigest()])

    ends = written(ends, "ends")
    dealt = ends.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv").select("node", "depth", "conv")
    parts = dealt.mapInArrow(pieces, "node long, depth long, first long, piece string")
    found = parts.repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "piece").mapInArrow(digest, "node long, depth long, sha string")
    joined_to = nodes.join(found.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    return joined_to.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH said AS (
    SELECT conv_id AS c, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM said),
-- crc32 bit by bit
drawn AS (
    SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> CAST(b AS INTEGER)) & 1)))), lambda a, b: CASE WHEN (xor(a, b) & 1) = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)) % 4 AS h
    FROM (SELECT DISTINCT c FROM placed)),
lent AS (SELECT d.c, d.h, p.pos AS depth, p.k, p.w FROM drawn d JOIN placed p ON p.c = d.base AND p.pos <= d.h),
took AS (SELECT d.c, d.h, count(l.depth) AS took FROM drawn d LEFT JOIN lent l USING (c) GROUP BY ALL),
turns AS (
    SELECT c, depth, k, w FROM lent
    UNION ALL SELECT p.c, t.took + p.pos - t.h, p.k, p.w FROM placed p JOIN took t USING (c) WHERE p.pos > t.h),
convs AS (SELECT d.c, coalesce(list(t.k ORDER BY depth) FILTER (t.k IS NOT NULL), []) AS ks, coalesce(list(t.w ORDER BY depth) FILTER (t.k IS NOT NULL), []) AS ws FROM drawn d LEFT JOIN turns t USING (c) GROUP BY d.c),
beginnings AS (SELECT c, ks, ws, unnest(range(len(ks) + 1)) AS d FROM convs),
nodes AS (
    SELECT d, array_to_string(ks[1:d], '') AS key, min(c) AS conv_id, count(*) AS n, max(CASE WHEN d > 0 THEN ws[d] ELSE 0 END) AS w, arg_min(ks, c) AS ks,
           string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(ks) = d) AS ends
    FROM beginnings GROUP BY ALL),
kids AS (SELECT d - 1 AS d, array_to_string(ks[1:d - 1], '') AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, key)),
below AS (
    SELECT up AS d, array_to_string(ks[1:up], '') AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * w) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS up FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_nodes f JOIN below b USING (d, key) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.key = array_to_string(f.ks[1:f.d - 1], '')
"""
