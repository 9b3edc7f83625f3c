"""Language-model scores by logistic mixing of hashed-context bit predictors, and a unigram base score.

A text is read as its class, its lower-cased (A-Z) words, each with a space behind it, and one end. Bytes are predicted bit by bit from
the most significant one. Contexts are the last 1, 2, 3, 4 and 6 bytes of the word and a sparse one (the last but one to the fourth last),
some with the class, each with a table of hashed slots that counts zeros and ones, and class and word so far. For that one there are no
slots: classes' words stand in sorted order, so those that begin alike stand together, and their counts are sums over stretches of the
order, exact up to PREFIX bytes and as many as the corpus has. A slot's count gives a probability and a confidence. A gate (what is known
of the word so far, the confidence of the longest hashed context, and which bit it is) selects the weights with which the predictions are
mixed in the logistic domain; a last table refines the mixed probability by the same knowledge.

Classes of texts stand for what a text's words have in common (its language above all). The covariance of the hashed short words of all
training texts (a matrix of fixed size, summed up by Spark) has a few large eigenvalues; short words are grouped along their vectors, and a
text is of the class whose direction its own short words have. A text costs its class as well, by the classes' shares.

A byte's probability depends on class and word up to it, so it is worked out once for each different beginning. The table of
words is dealt into parts by ranges. Of the prefixes of a part's first and last word, which go on in other parts, all counts are
summed up beforehand. Weights and the last table are learnt online: each part's words teach them batch by batch, from the eighth of the
training texts (by a hash of the text) that the counts of that step lack, and the parts' results are averaged by what they have seen, in
ROUNDS rounds. No text is too long for it, and none is left out. Scoring changes nothing, so a text's score doesn't depend on other
texts' order.

What is broadcast has a fixed bound: the slots' tables (2 bytes a slot, 10 MB), the `common` most frequent words, the weights, and counts of
the prefixes of at most 2 * MOST_PARTS words. Rarer words meet their counts and probabilities by a join.

Defined results: null and empty texts are the end alone (one token); without training texts every probability of a bit is a
half and the base is that of no token known; repeated rows are scored each; null ids count as fold 0; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_batch, chunks, written

#: Bytes that each hashed context looks at, as a mask of the last six (the lowest byte is the last one), and log2 of its slots.
CLASS, SIX = np.uint64(0xFF << 48), np.uint64((1 << 48) - 1)
CONTEXTS = ((0xFF000000000000FF, 16), (0x00FF00000000FFFF, 18), (0x00FF000000FFFFFF, 20), (0xFFFFFFFF, 20), (0xFFFFFFFFFFFF, 21), (0x00FF0000FFFFFF00, 20))
LONGEST = 4  # the place of the longest in CONTEXTS
HASHED, INPUTS = len(CONTEXTS), len(CONTEXTS) + 2
OFFSETS = tuple(np.cumsum([0, *(1 << b for _, b in CONTEXTS)]).tolist())
SLICE = 1 << 14
LEVELS, KNOWN = 4, 10
#: Bytes of a word up to which its beginning is a context, and up to which beginnings are shared between words.
PREFIX, SHARED = 17, 65
START, END = 0x20, b"\n"
STEPS = 33
ROUNDS, BATCH, RATE = 2, 512, 0.05
#: Short words (up to so many bytes) stand for a text's class, in so many hashed features; classes at most; the least eigenvalue that
#: makes one, by the largest.
SHORT, FEATURES, MOST_CLASSES, LEAST_VALUE = 4, 256, 8, 0.2
#: Words in a part, their bytes, and parts at most.
PART_WORDS, PART_BYTES, MOST_PARTS = 150_000, 32 << 20, 4096
#: Different words that a task counts before it hands them on.
HELD = 300_000
COMMON, COMMON_BYTES = 100_000, 64


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def token_of(unit: bytes) -> int:
    return xxhash.xxh64_intdigest(unit) - (1 << 63)


class Classes:
    """Classes of texts from the sums of their features' products; every text is of the first one if there are no sums."""

    def __init__(self, products: np.ndarray | None = None, sums: np.ndarray | None = None, texts: int = 0):
        self.turn = None
        if not texts:
            return
        self.mean = sums / texts
        cov = products / texts - np.outer(self.mean, self.mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        values, vectors = np.linalg.eigh(cov / np.outer(spread, spread))
        order = np.argsort(-values)[: MOST_CLASSES - 1]
        keep = order[values[order] > LEAST_VALUE * values[order[0]]]
        rows = vectors[:, keep] * values[keep]
        rows /= np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12
        weight = spread**2
        centres = [rows[int(np.argmax(weight))]]
        while len(centres) <= len(keep):  # the farthest feature starts the next class
            centres.append(rows[int(np.argmax(np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0) * weight))])
        centres = np.array(centres)
        for _ in range(30):
            own = np.argmax(rows @ centres.T, axis=1)
            centres = np.array([np.average(rows[own == k], axis=0, weights=weight[own == k]) if (own == k).any() else centres[k] for k in range(len(centres))])
            centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
        self.turn = (vectors[:, keep] / spread[:, None]) @ centres.T

    def features(self, found: Counter) -> tuple[list[int], list[int]]:
        """Buckets of the short words of a text, and how often each word occurs."""
        short = [(w, n) for w, n in found.items() if len(w) <= SHORT]
        return [zlib.crc32(w) % FEATURES for w, _ in short], [n for _, n in short]

    def unit(self, found: Counter) -> np.ndarray:
        """The features of a text: square roots of counts, at length one."""
        x = np.sqrt(np.bincount(*self.features(found), minlength=FEATURES)) if found else np.zeros(FEATURES)
        return x / max(np.linalg.norm(x), 1e-12)

    def of(self, found: Counter) -> bytes:
        """The class of a text as a byte."""
        return b"A" if self.turn is None else bytes([65 + int(np.argmax((self.unit(found) - self.mean) @ self.turn))])


def text_classes(texts: DataFrame) -> Classes:
    """Classes from all texts of the column."""
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def pack(total):
        return as_batch(schema, block=[0], sums=[total.tobytes()])

    def add(batches):
        total, plain = np.zeros((FEATURES + 1, FEATURES)), Classes()
        some = 0
        for _, part in chunks(batches, limit=1 << 20):
            x = np.stack([plain.unit(Counter(words_of(t))) for t in part])
            total[:-1] += x.T @ x
            total[-1] += x.sum(axis=0)
            some += len(part)
        if some:
            yield pack(np.append(total.ravel(), some))

    def merge(batches):
        found = [np.frombuffer(x) for batch in batches for x in batch.column(1).to_pylist()]
        if found:
            yield pack(sum(found))

    each = texts.mapInArrow(add, "block int, sums binary").withColumn("block", (F.spark_partition_id() % 16).cast("int"))
    found = [np.frombuffer(r[1]) for r in each.repartition(16, "block").mapInArrow(merge, "block int, sums binary").collect()]
    if not found:
        return Classes()
    total = sum(found)
    return Classes(total[: FEATURES * FEATURES].reshape(FEATURES, FEATURES), total[FEATURES * FEATURES : -1], int(total[-1]))


def counted_units(rows: DataFrame, classes: Classes) -> DataFrame:
    """(unit: class, word and space, or class and end; fit, teach: occurrences) over rows (text, role: 0 no training, 1 fit, 2 teach)."""
    held = rows.sparkSession.sparkContext.broadcast(classes)
    schema = pa.schema([("unit", pa.binary()), ("fit", pa.int64()), ("teach", pa.int64())])

    def run(batches):
        held_counts: dict[tuple[int, bytes], Counter] = {}

        def out():
            for (role, kind), found in held_counts.items():
                n = list(found.values())
                none = [0] * len(n)
                yield as_batch(schema, unit=[kind + w + b" " if w != END else kind + w for w in found], fit=n if role == 1 else none, teach=n if role == 2 else none)
            held_counts.clear()

        for batch, texts in chunks(batches, limit=1 << 20):
            for role, text in zip(batch.column(1).to_pylist(), texts, strict=True):
                words = words_of(text)
                own = held_counts.setdefault((role, held.value.of(Counter(words))), Counter())
                own.update(words)
                own[END] += 1
            if sum(map(len, held_counts.values())) > HELD:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "unit binary, fit long, teach long").groupBy("unit").agg(F.sum("fit").alias("fit"), F.sum("teach").alias("teach"))


def slots(history: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """(contexts, bits, places): the slot in which each context counts each bit of the byte after the history (six bytes as a number)."""
    out = np.empty((HASHED, 8, len(byte)), np.int32)
    nodes = [((byte.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - b)) for b in range(8)]  # the bits so far, after a 1
    for n, (mask, size) in enumerate(CONTEXTS):
        h = ((history & np.uint64(mask)) + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for b, node in enumerate(nodes):
            out[n, b] = (((h + node) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - size)).astype(np.int32) + OFFSETS[n]
    return out


def bits(byte: np.ndarray) -> np.ndarray:
    return np.stack([(byte >> (7 - b)) & 1 for b in range(8)]).astype(np.int8)


class Beginnings:
    """Units in sorted order, byte by byte: at each depth the different beginnings with one byte more, and what is counted of them.

    counts: a column of `units` rows for each kind of count. edges: for beginnings that go on in other parts, the counts of each next byte
    over all parts (by kind).
    """

    def __init__(self, units: list[bytes], counts: np.ndarray, edges: dict[bytes, np.ndarray]):
        self.units, self.counts, self.edges = units, counts, edges
        self.data = np.frombuffer(b"".join(units), np.uint8)
        self.size = np.fromiter(map(len, units), np.int64, len(units))
        self.begin = np.cumsum(self.size) - self.size

    def depths(self, kind: int):
        """For each depth: (head of each unit still there, these units, history and byte of each head, its mass at each bit or None, its counts)."""
        there, group = np.arange(len(self.units)), np.zeros(len(self.units), np.int64)
        history = np.full(len(self.units), START, np.uint64)
        for depth in range(min(SHARED, int(self.size.max(initial=0)))):
            byte = self.data[self.begin[there] + depth]
            new = np.append(True, (group[1:] != group[:-1]) | (byte[1:] != byte[:-1]))
            heads = np.flatnonzero(new)
            own = np.add.reduceat(self.counts[there], heads, axis=0)
            mass = self._masses(group[heads], byte[heads], own[:, kind], kind, depth, there) if depth <= PREFIX else None
            head = np.cumsum(new) - 1
            yield head, there, history[there[heads]], byte[heads], mass, own
            if depth:
                history[there] = (history[there] & CLASS) | (((history[there] << np.uint64(8)) | byte) & SIX)
            else:
                history[there] = (byte.astype(np.uint64) << np.uint64(48)) | np.uint64(START)
            stay = self.size[there] > depth + 1
            there, group = there[stay], head[stay]
            if not len(there):
                return

    def _masses(self, parent: np.ndarray, byte: np.ndarray, own: np.ndarray, kind: int, depth: int, there: np.ndarray) -> np.ndarray:
        """(9, heads): what is counted of each head's beginning without its last byte, then with one more bit of it at a time."""
        out = np.empty((9, len(byte)))
        for b in range(9):
            part = byte >> (8 - b) if b else np.zeros(len(byte), np.uint8)
            starts = np.flatnonzero(np.append(True, (parent[1:] != parent[:-1]) | (part[1:] != part[:-1])))
            out[b] = np.repeat(np.add.reduceat(own, starts), np.diff(np.append(starts, len(byte))))
        for unit, edge in ((there[0], parent[0]), (there[-1], parent[-1])):
            table = self.edges.get(self.units[unit][:depth])
            if table is not None:
                sums = np.append(0, np.cumsum(table[kind]))
                at = np.flatnonzero(parent == edge)
                for b in range(9):
                    low = (byte[at].astype(np.int64) >> (8 - b)) << (8 - b)
                    out[b, at] = sums[low + (1 << (8 - b))] - sums[low]
        return out

    def rest(self):
        """(unit, history, byte) of the bytes beyond SHARED."""
        for k in np.flatnonzero(self.size > SHARED):
            unit = np.frombuffer(self.units[k], np.uint8).astype(np.uint64)
            history = np.zeros(len(unit) - SHARED, np.uint64)
            for j in range(6):
                history |= unit[SHARED - 1 - j : len(unit) - 1 - j] << np.uint64(8 * j)
            history |= unit[0] << np.uint64(48)
            yield int(k), history, unit[SHARED:].astype(np.uint8)


def quantised(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of a one in twelfths and the level of confidence (0: nothing seen) of slots."""
    odds = np.log((n1 + 0.3) / (n0 + 0.3))
    return np.clip(np.round(odds * 12), -127, 127).astype(np.int8), np.where(n0 + n1 == 0, 0, np.minimum(LEVELS - 1, 1 + np.log2(np.maximum(n0 + n1, 1)) / 3)).astype(np.uint8)


class Mixer:
    """Gated weights and the refining table, with what either has seen."""

    def __init__(self):
        self.weights = np.full((8 * KNOWN * LEVELS, INPUTS), 0.1)
        self.weights[:, HASHED:] = 0.6, 0.0
        self.squares = np.zeros(self.weights.shape)
        self.seen = np.zeros(len(self.weights))
        self.refine = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, STEPS))), (8 * KNOWN, 1))
        self.refined = np.full(self.refine.shape, 20.0)

    def inputs(self, tables: tuple[np.ndarray, np.ndarray], history: np.ndarray, byte: np.ndarray, mass: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """For all bits (8 x places): the inputs, the gate, the row of the refining table, and the bit."""
        where, bit = slots(history, byte), bits(byte)
        x = np.empty((INPUTS, 8, len(byte)))
        np.divide(tables[0][where], 12, out=x[:HASHED])
        level = tables[1][where[LONGEST]]
        if mass is None:
            x[HASHED], known = 0.0, np.zeros(bit.shape, np.int64)
        else:
            total = mass[:8]
            ones = np.where(bit == 1, mass[1:], total - mass[1:])
            x[HASHED] = np.log((ones + 0.3) / (total - ones + 0.3))
            known = np.searchsorted([1, 2, 5, 31], total, side="right") * 2 + ((ones == 0) | (ones == total))
        x[-1] = 0.3
        row = np.arange(8)[:, None] * KNOWN + known
        return x.reshape(INPUTS, -1), (row * LEVELS + level).ravel(), row.ravel(), bit.ravel()

    def dot(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ji->j", x, self.weights[gate]), -8, 8)

    def probability(self, dot: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of a one: the mixed one and the refined one, averaged."""
        at = (dot + 8) * ((STEPS - 1) / 16)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        p = self.refine[row, low] * (1 - part) + self.refine[row, low + 1] * part
        return np.clip((1 / (1 + np.exp(-dot)) + p) / 2, 1e-5, 1 - 1e-5)

    def log10_p(self, tables, history: np.ndarray, byte: np.ndarray, mass: np.ndarray | None) -> np.ndarray:
        """log10 of the probability of each byte after its history."""
        out = np.empty(len(byte))
        for at in range(0, len(byte), 1 << 14):
            to = at + (1 << 14)
            x, gate, row, bit = self.inputs(tables, history[at:to], byte[at:to], mass if mass is None else mass[:, at:to])
            p = self.probability(self.dot(x, gate), row)
            out[at:to] = np.log10(np.where(bit == 1, p, 1 - p)).reshape(8, -1).sum(axis=0)
        return out

    def learn(self, tables, history: np.ndarray, byte: np.ndarray, mass: np.ndarray | None, times: np.ndarray) -> None:
        """Online: each batch is predicted with what those before have taught, then corrects the weights and the table."""
        for at in range(0, len(byte), BATCH):
            to = at + BATCH
            x, gate, row, bit = self.inputs(tables, history[at:to], byte[at:to], mass if mass is None else mass[:, at:to])
            t = np.tile(times[at:to].astype(float), 8)
            dot = self.dot(x, gate)
            error = t * (bit - 1 / (1 + np.exp(-dot)))
            size = len(self.weights)
            step = np.stack([np.bincount(gate, weights=error * x[k], minlength=size) for k in range(INPUTS)], axis=1)
            self.squares += step**2
            self.weights += RATE * step / np.sqrt(self.squares + 1e-6)
            self.seen += np.bincount(gate, weights=t, minlength=size)
            near = row * STEPS + np.round((dot + 8) * ((STEPS - 1) / 16)).astype(np.int64)
            seen = np.bincount(near, weights=t, minlength=self.refine.size).reshape(self.refine.shape)
            ones = np.bincount(near, weights=t * bit, minlength=self.refine.size).reshape(self.refine.shape)
            self.refine = (self.refine * self.refined + ones) / (self.refined + seen)
            self.refined += seen

    @classmethod
    def averaged(cls, mixers: list[Mixer]) -> Mixer:
        """Each gate's weights and each cell of the table by what every mixer has seen of it."""
        out = cls()
        seen = sum(m.seen for m in mixers)
        weights = sum(m.weights * m.seen[:, None] for m in mixers)
        out.weights = np.where(seen[:, None] > 0, weights / np.maximum(seen, 1)[:, None], out.weights)
        out.squares, out.seen = sum(m.squares for m in mixers), seen
        own = [m.refined - 20.0 for m in mixers]
        out.refine = (out.refine * 20.0 + sum(m.refine * n for m, n in zip(mixers, own, strict=True))) / (20.0 + sum(own))
        out.refined = 20.0 + sum(own)
        return out

    def onward(self) -> Mixer:
        """A mixer that goes on from here and counts anew what it sees."""
        out = Mixer()
        out.weights, out.refine = self.weights.copy(), self.refine.copy()
        return out


def slot_tables(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Quantised tables of the slots over units (unit, fit), each different beginning weighed by how often it occurs."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def parts(found):
        for k, table in found:
            if table.any():
                yield as_batch(schema, slice=[k], counts=[zlib.compress(np.ascontiguousarray(table).tobytes(), 1)])

    def count(batches):
        tables = np.zeros((2, OFFSETS[-1]))

        def add(history, byte, times):
            for at in range(0, len(byte), 1 << 16):
                to = at + (1 << 16)
                where, one = slots(history[at:to], byte[at:to]), bits(byte[at:to])
                for n in range(HASHED):
                    for v in (0, 1):
                        pick = one == v
                        np.add.at(tables[v], where[n][pick], np.broadcast_to(times[at:to], one.shape)[pick])

        any_unit = False
        for batch in batches:
            pairs = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if not pairs:
                continue
            any_unit = True
            held = Beginnings([u for u, _ in pairs], np.array([[n] for _, n in pairs], np.int64), {})
            for depth, (_, _, history, byte, _, own) in enumerate(held.depths(0)):
                if depth:  # the class is known
                    add(history, byte, own[:, 0].astype(float))
            for k, history, byte in held.rest():
                add(history, byte, np.full(len(byte), float(pairs[k][1])))
        if any_unit:
            yield from parts((k, tables[:, k * SLICE : (k + 1) * SLICE].astype(np.int64)) for k in range(-(-OFFSETS[-1] // SLICE)))

    def streamed(batches):
        now, total = None, None
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1)
                if k != now:
                    if now is not None:
                        yield now, total
                    now, total = k, table.copy()
                else:
                    total += table
        if now is not None:
            yield now, total

    def summed(batches):
        yield from parts(streamed(batches))

    def finished(batches):
        for k, table in streamed(batches):
            odds, level = quantised(*table)
            yield as_batch(schema, slice=[k], counts=[zlib.compress(odds.tobytes() + level.tobytes(), 1)])

    each = units.mapInArrow(count, "slice int, counts binary").withColumn("block", F.floor(F.spark_partition_id() / 64))
    some = each.repartition("slice", "block").sortWithinPartitions("slice").select("slice", "counts").mapInArrow(summed, "slice int, counts binary")
    every = some.repartition("slice").sortWithinPartitions("slice").mapInArrow(finished, "slice int, counts binary")
    odds, level = np.zeros(OFFSETS[-1], np.int8), np.zeros(OFFSETS[-1], np.uint8)
    for k, blob in every.toLocalIterator(prefetchPartitions=False):
        raw = zlib.decompress(blob)
        half = len(raw) // 2
        odds[k * SLICE : k * SLICE + half] = np.frombuffer(raw[:half], np.int8)
        level[k * SLICE : k * SLICE + half] = np.frombuffer(raw[half:], np.uint8)
    return odds, level


def edge_counts(units: DataFrame, bounds: list[bytes]) -> dict[bytes, np.ndarray]:
    """Of every prefix (up to PREFIX bytes) of the bounds: how often each byte follows it in units (unit, fit, all), for both counts."""
    prefixes = {b[:k] for b in bounds for k in range(min(len(b), PREFIX) + 1)}
    held = units.sparkSession.sparkContext.broadcast(prefixes)

    def run(batches):
        wanted = held.value
        found: dict[tuple[bytes, int], list[int]] = {}
        for batch in batches:
            for unit, *n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for k in range(min(len(unit) - 1, PREFIX) + 1):
                    if unit[:k] not in wanted:
                        break
                    own = found.setdefault((unit[:k], unit[k]), [0, 0])
                    own[0] += n[0]
                    own[1] += n[1]
        kinds = pa.schema([("prefix", pa.binary()), ("byte", pa.int32()), ("fit", pa.int64()), ("every", pa.int64())])
        yield as_batch(kinds, prefix=[p for p, _ in found], byte=[b for _, b in found], fit=[n for n, _ in found.values()], every=[n for _, n in found.values()])

    summed = units.select("unit", "fit", "every").mapInArrow(run, "prefix binary, byte int, fit long, every long").groupBy("prefix", "byte").agg(F.sum("fit").alias("fit"), F.sum("every").alias("every"))
    out = {p: np.zeros((2, 256)) for p in prefixes}
    for r in summed.collect():  # bounded by the prefixes of the parts' bounds
        out[bytes(r["prefix"])][:, r["byte"]] = r["fit"], r["every"]
    return out


def _of_part(table: pa.Table, edges: dict[bytes, np.ndarray]) -> Beginnings:
    units = table["unit"].to_pylist()
    order = sorted(range(len(units)), key=units.__getitem__)
    counts = np.stack([table[c].to_numpy() for c in ("fit", "every", "teach", "total")], axis=1)[order]
    return Beginnings([units[k] for k in order], counts, edges)


def learnt(parts: DataFrame, tables, edges) -> Mixer:
    """The mixer that all parts of units teach, with counts of the fit texts only."""
    mixer = Mixer()
    spark = parts.sparkSession
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((tables, edges, mixer))

        def teach(table: pa.Table) -> pa.Table:
            known, own_edges, start = held.value
            own, mine = _of_part(table, own_edges), start.onward()
            for depth, (_, _, history, byte, mass, counts) in enumerate(own.depths(0)):
                some = (counts[:, 2] > 0) & (depth > 0)
                mine.learn(known, history[some], byte[some], mass if mass is None else mass[:, some], counts[some, 2])
            for k, history, byte in own.rest():
                if own.counts[k, 2]:
                    mine.learn(known, history, byte, None, np.full(len(byte), own.counts[k, 2]))
            return pa.table({"part": table["part"][:1].cast(pa.int32()), "mixer": pa.array([pickle.dumps(mine)], pa.binary())})

        def average(batches):
            found = [pickle.loads(x) for batch in batches for x in batch.column(1).to_pylist()]
            if found:
                yield as_batch(pa.schema([("part", pa.int32()), ("mixer", pa.binary())]), part=[0], mixer=[pickle.dumps(Mixer.averaged(found))])

        each = parts.groupBy("part").applyInArrow(teach, "part int, mixer binary")
        found = [pickle.loads(r[1]) for r in each.repartition(16, "part").mapInArrow(average, "part int, mixer binary").collect()]
        if found:
            mixer = Mixer.averaged(found)
    return mixer


def scored_units(parts: DataFrame, tables, edges, mixer: Mixer) -> DataFrame:
    """(unit, token: its hash, n: training occurrences of the word, log_p: log10 of its probability in its class), with counts of all training texts for the words so far."""
    held = parts.sparkSession.sparkContext.broadcast((tables, edges, mixer))

    def score(table: pa.Table) -> pa.Table:
        known, own_edges, mixed = held.value
        own = _of_part(table, own_edges)
        logs = np.zeros(len(own.units))
        for depth, (head, there, history, byte, mass, _) in enumerate(own.depths(1)):
            if depth:  # the class is known
                logs[there] += mixed.log10_p(known, history, byte, mass)[head]
        for k, history, byte in own.rest():
            logs[k] += mixed.log10_p(known, history, byte, None).sum()
        return pa.table({"unit": pa.array(own.units, pa.binary()), "token": pa.array(map(token_of, own.units), pa.int64()), "n": pa.array(own.counts[:, 3]), "log_p": pa.array(logs)})

    return parts.groupBy("part").applyInArrow(score, "unit binary, token long, n long, log_p double")


def score_texts(docs: DataFrame, learn: Column, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; models learn from the rows for which `learn` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), learn.alias("learn"))
    role = F.when(~F.coalesce("learn", F.lit(False)), 0).when(F.pmod(F.xxhash64("text"), F.lit(8)) == 0, 2).otherwise(1).cast("int")
    classes = text_classes(rows.where("learn").select("text"))
    counted = counted_units(rows.select("text", role.alias("role")), classes).withColumn("every", F.col("fit") + F.col("teach"))
    of_word = Window.partitionBy(F.expr("substring(unit, 2)"))  # a row for each class at most
    units = written(counted.withColumn("total", F.sum("every").over(of_word)).withColumn("one", F.col("unit") == F.min("unit").over(of_word)), "units")
    total = units.agg(F.sum("every"), F.count_if(F.col("one") & (F.col("total") > 0)), F.count("*"), F.sum(F.length("unit"))).first()
    n_all, kinds, n_units, n_bytes = (x or 0 for x in total)
    ends_in = {bytes(r[0])[:1]: r[1] for r in units.where(F.expr("substring(unit, 2)") == F.lit(END)).select("unit", "every").collect()}  # a row for each class
    shares = {k: np.log10((n + 0.5) / (sum(ends_in.values()) + 0.5 * len(ends_in))) for k, n in ends_in.items()}
    n_parts = int(np.clip(max(-(-n_units // PART_WORDS), -(-n_bytes // PART_BYTES)), 1, MOST_PARTS))
    parts = written(units.repartitionByRange(n_parts, "unit").withColumn("part", F.spark_partition_id()), "parts")
    ends = parts.groupBy("part").agg(F.min("unit").alias("first"), F.max("unit").alias("last")).select(F.substring("first", 1, PREFIX + 1), F.substring("last", 1, PREFIX + 1)).collect()  # MOST_PARTS rows at most
    edges = edge_counts(units, [bytes(b) for r in ends for b in r]) if len(ends) > 1 else {}
    tables = slot_tables(units.where("fit > 0").select("unit", "fit").coalesce(n_parts))  # a task hands on a whole table, however few words it has
    scored = written(scored_units(parts, tables, edges, learnt(parts, tables, edges)), "scored-units")
    often = scored.where(F.length("unit") <= COMMON_BYTES).orderBy(F.desc("n"), "unit").limit(common).select("unit", "n", "log_p").toArrow()
    whole = n_all + 0.5 * (kinds + 1)
    place: dict[bytes, dict[bytes, int]] = {}  # by class, then by word
    for k, u in enumerate(often["unit"].to_pylist()):
        place.setdefault(u[:1], {})[u[1:] if u[1:] == END else u[1:-1]] = k
    n_often, log_often = often["n"].to_numpy(), often["log_p"].to_numpy()
    top = spark.sparkContext.broadcast((place, n_often, np.log10((n_often + 0.5) / whole), log_often, classes, shares))
    rare_kind = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int32())]))
    schema = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("size", pa.int64()), ("rare", rare_kind)])

    def run(batches):
        place, n_often, base_often, log_often, classes, shares = top.value
        for batch, texts in chunks(batches, limit=1 << 20):
            keys, times, where, kinds, sizes = [], [], [], [], []
            n_tokens, size = [], []
            for text in texts:
                words = words_of(text)
                found = Counter(words)
                kind = classes.of(found)
                found[END] += 1
                kinds.append(kind)
                keys.extend(found)
                times.extend(found.values())
                where.extend(map(place.get(kind, {}).get, found, repeat(-1)))
                sizes.append(len(found))
                n_tokens.append(len(words) + 1)
                size.append(sum(map(len, words)) + len(words) + 1)
            where, times, text_of = np.array(where, np.int64), np.array(times, np.int64), np.repeat(np.arange(len(texts)), sizes)
            hit = where >= 0
            at, t, own = where[hit], times[hit], text_of[hit]
            summed = lambda x: np.bincount(own, weights=x, minlength=len(texts))  # noqa: E731, B023
            rare = np.flatnonzero(~hit)
            tokens = [token_of(kinds[d] + keys[k] + (b" " if keys[k] != END else b"")) for k, d in zip(rare.tolist(), text_of[rare].tolist(), strict=True)]
            bounds = np.append(0, np.cumsum(np.bincount(text_of[rare], minlength=len(texts)))).astype(np.int32)
            columns = {
                "n_tokens": n_tokens,
                "n_known": summed(t * (n_often[at] > 0)).astype(np.int64),
                "base": summed(t * base_often[at]),
                "score": summed(t * log_often[at]) + np.array([shares[k] for k in kinds]),
                "size": size,
            }
            parts = [pa.array(columns[f.name], f.type) for f in schema if f.name != "rare"]
            parts.append(pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(times[rare], pa.int32())], fields=list(rare_kind.value_type))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *parts], schema=pa.schema([("doc_id", batch.schema.field(0).type), *schema]))

    kind = docs.schema[id_col].dataType.simpleString()
    seen = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, score double, size long, rare array<struct<token:long,times:int>>")
    seen = written(seen.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = seen.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.times").hint("merge").join(scored.select("token", "n", "log_p"), "token")
    rest = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(whole)))).alias("base_sum"), F.sum(F.col("times") * F.col("log_p")).alias("score_sum"))
    score = F.col("score") + F.coalesce("score_sum", F.lit(0.0))
    return seen.drop("rare").hint("merge").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_sum", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score / F.log10(F.lit(2.0)) / F.col("size")).alias("bits_per_byte"),
    )
