"""Exact removal of long repeated byte strings, by column-wise construction of a suffix order with common prefixes.

A byte goes if a string of `length` bytes over it also starts anywhere else. Three steps find those strings without shuffling
texts by their suffixes:

1. Anchors. Of the `gram`-byte strings inside each window of `least` bytes, the one of the smallest hash is its anchor (of equals the
   leftmost if another could stand before it in the window, else the rightmost). Equal windows have equal anchors at equal places, so
   equal windows meet under one anchor. Stretches with a period p that are at least `length` + p bytes long repeat themselves: they are
   told at once, and only the windows that start in their first p bytes have anchors, for others to meet. All windows with an anchor lie in the context of `length - gram` bytes before and `length`
   bytes from its start. Contexts are counted by their 128-bit XXH3; those that occur twice are repeated as a whole, so copies cost
   one row.
2. Columns. The different contexts of an anchor are a collection of documents aligned at the anchor. Their suffix order is
   built by inserting one symbol per document each round, from the last column to the first: a stable sort of the former order
   by the new symbol; the common prefix of two neighbours is one more than the least common prefix between their former
   places. Only the order, the common prefixes and one column are looked at in a round; the columns stand one after another
   and are read in sequence. A window is repeated if a neighbour shares `length` bytes or more. Spark's sorted shuffle files
   take the place of the method's external files: they bring the collections to a task one at a time, sorted by anchor.
3. Spans. Each occurrence of a context takes its spans over; a text's spans are merged and cut out. If `least` is below `length`, shorter
   repeats, of `least` bytes or more, are found alike; they stay, and n_repeated says how many bytes they cover. That takes anchors of
   smaller windows, which are more.

Anchors with over `hot` different contexts don't go to one task: blocks of their windows are counted by 128-bit hashes over all
tasks and cut where they decide nothing, which gives the same result.

Defined results: null and empty texts have 0 bytes and no spans; texts shorter than `length` stay as they are; repeated rows
count as documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, SharedTable, as_batch, chunks, written

LENGTH, GRAM, HOT = 400, 60, 20_000
#: Bytes that passages of over 50 words seldom fall below (41 of 13,084 documents of check_s hold shorter ones only).
PASSAGE = 280
#: Contexts that a task takes up before it builds their order.
BLOCK = 30_000
#: An odd multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of an array of bytes, from prefix sums modulo 2**64."""

    powers: dict[int, np.ndarray] = {}
    values = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        for b in (base, pow(base, -1, 1 << 64)):
            if len(self.powers.get(b, ())) < n:
                step = np.full(max(n, 1 << 21), b, np.uint64)
                step[0] = 1
                self.powers[b] = np.multiply.accumulate(step)
        self.inverse = self.powers[pow(base, -1, 1 << 64)]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.values[data] * self.powers[base][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        return _mixed((self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size])


def second(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """How far behind each of the sorted places its hash comes again, if that is less than `width`; else `width`."""
    places, back = np.unique(first, return_inverse=True)
    found, open_ = np.full(len(places), width), np.arange(len(places))
    for d in range(1, width):
        open_ = open_[places[open_] + d < len(hashes)]
        if not len(open_):
            break
        same = hashes[places[open_] + d] == hashes[places[open_]]
        found[open_[same]] = d
        open_ = open_[~same]
    return found[back]


def periodic(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, periods: np.ndarray, rolling: Rolling, length: int) -> list[tuple[int, int, int]]:
    """The largest stretches (begin, end, p) of a text with period p, `length` + p bytes long at least, about windows (sorted starts) with those supposed periods."""
    text = np.searchsorted(begins, starts, side="right") - 1
    inside = starts + periods + length <= ends[text]
    starts, periods, text = starts[inside], periods[inside], text[inside]
    same = rolling.of(starts, starts + length) == rolling.of(starts + periods, starts + periods + length)
    out: list[tuple[int, int, int]] = []
    for s, p, t in zip(starts[same].tolist(), periods[same].tolist(), text[same].tolist(), strict=True):
        if out and s + length <= out[-1][1]:
            continue
        a, b = int(begins[t]), int(ends[t])
        differs = np.flatnonzero(data[a : b - p] != data[a + p : b]) + a
        k = int(np.searchsorted(differs, s))
        begin, end = int(differs[k - 1]) + 1 if k else a, (int(differs[k]) if k < len(differs) else b - p) + p
        if end - begin >= length + p:
            out.append((begin, end, p))
    return out


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, least: int, gram: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]:
    """Of the texts data[begins:ends]: text number, place, hash of the gram, the context's two hashes, bytes before and from the anchor; and stretches that repeat themselves: text number, begin, end."""
    empty = (np.array([], np.int64),) * 2 + (np.array([], np.uint64),) * 3 + (np.array([], np.int64),) * 2, []
    if len(data) < least:
        return empty
    rolling = Rolling(data, BASE)
    hashes = rolling.all(gram)
    width = least - gram + 1
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    numbers = np.arange(len(hashes), dtype=np.uint64)
    starts = len(data) - least + 1

    def lowest(order: np.ndarray) -> np.ndarray:  # of each window: where its least hash is, the first by `order`
        full = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max)
        full[: len(hashes)] = (hashes & ~place) | order
        blocks = full.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & place).astype(np.int64)

    whole = np.zeros(len(data) + 1, np.int64)  # 1 where a window lies within one text
    long = ends - begins >= least
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, ends[long] - least + 1, -1)
    windows = np.flatnonzero(np.cumsum(whole)[:starts] > 0)
    if not len(windows):
        return empty
    at, last = lowest(numbers)[windows], (place.astype(np.int64) - lowest(place - numbers))[windows]
    tied = np.flatnonzero(at != last)
    period = second(hashes & ~place, at[tied], width)
    short = period <= least // 2  # two such periods that share all but a byte of a window have a common one
    runs = periodic(data, begins, ends, windows[tied[short]], period[short], rolling, length)
    late = at[tied] - windows[tied] < period
    at[tied[late]] = last[tied[late]]
    needed = np.zeros(len(data) + 1, np.int64)
    for begin, end, p in runs:
        needed[begin + p] -= 1
        needed[end - least + 1] += 1
    at = np.unique(at[np.cumsum(needed)[windows] == 0])
    text = np.searchsorted(begins, at, side="right") - 1
    left = np.minimum(at - begins[text], length - gram)
    right = np.minimum(ends[text] - at, length)
    raw = memoryview(data)
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b], seed=s) for a, b, s in zip((at - left).tolist(), (at + right).tolist(), left.tolist(), strict=True)), ">u8").reshape(-1, 2)
    of = [int(np.searchsorted(begins, begin, side="right")) - 1 for begin, _, _ in runs]
    return (text, at - begins[text], hashes[at], *(k.astype(np.uint64) for k in keys.T), left, right), [(t, begin - int(begins[t]), end - int(begins[t])) for t, (begin, end, _) in zip(of, runs, strict=True)]


def column_order(group: np.ndarray, columns: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """The first and the last column from which `length` symbols of each row also occur in another row of its group, and the same for `least`; -1: none.

    Rows are sorted by group; columns (one array per column) are aligned at the anchor; a row has symbols in the columns from
    length - gram - left to length - gram + right only.
    """
    n, total = len(group), 2 * length - gram
    found = [(size, np.full(n, -1, np.int32), np.full(n, -1, np.int32)) for size in dict.fromkeys((length, least))]
    order, shared = np.arange(n), np.zeros(n + 1, np.int32)
    base = group.astype(np.int64) * 257
    apart = group[1:] != group[:-1]
    begin, end = length - gram - left, length - gram + right
    for j in range(total - 1, -1, -1):
        symbol = np.where((begin <= j) & (j < end), columns[j], np.int64(256))[order]
        key = base + symbol
        if (key[1:] < key[:-1]).any():
            moved = np.argsort(key, kind="stable")
            order, symbol = order[moved], symbol[moved]
        else:
            moved = np.arange(n)
        equal = np.flatnonzero((symbol[1:] == symbol[:-1]) & ~apart & (symbol[1:] < 256))
        before, here = moved[equal], moved[equal + 1]
        common = shared[here]
        far = np.flatnonzero(here - before > 1)
        if len(far):  # the least common prefix between the former places
            bounds = np.stack([before[far] + 1, here[far] + 1], axis=1).ravel()
            common[far] = np.minimum.reduceat(shared, bounds)[::2]
        shared = np.zeros(n + 1, np.int32)
        shared[equal + 1] = common + 1
        for size, first, last in found:
            if length - size <= j <= length - gram:  # the window holds the anchor
                rows = order[(shared[:-1] >= size) | (shared[1:] >= size)]
                first[rows] = j
                last[rows[last[rows] < 0]] = j
    return tuple(x for _, *pair in found for x in pair)


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = [t.encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    return np.frombuffer(b"".join(codes), np.uint8), np.append(0, ends[:-1]), ends


KEYS = ["gram", "k1", "k2"]


def repeated_spans(rows: DataFrame, length: int, least: int, gram: int, hot: int) -> DataFrame:
    """(row, spans: array of start, end and whether it has `length` bytes) of the texts in rows (row, text) that hold repeated strings of `least` bytes."""

    def find(batches):
        schema = pa.schema([("row", pa.int64()), ("pos", pa.int64()), ("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("before", pa.int32()), ("size", pa.int32())])
        for batch, texts in chunks(batches, limit=1 << 20):
            data, begins, ends = _bytes(texts)
            (text, pos, *keys, left, right), runs = anchors(data, begins, ends, length, least, gram)
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            row = rows[text]
            g, k1, k2 = (k.view(np.int64) for k in keys)
            yield as_batch(schema, row=row, pos=pos, gram=g, k1=k1, k2=k2, before=left.astype(np.int32), size=right.astype(np.int32))
            if runs:
                none = [None] * len(runs)
                yield as_batch(schema, row=[rows[t] for t, _, _ in runs], pos=[a for _, a, _ in runs], gram=none, k1=none, k2=none, before=none, size=[b - a for _, a, b in runs])

    sizes = list(dict.fromkeys((length, least)))
    all_found = written(rows.mapInArrow(find, "row long, pos long, gram long, k1 long, k2 long, before int, size int"), "anchors")
    found, runs = all_found.where("gram is not null"), all_found.where("gram is null")
    contexts = found.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(F.struct("row", "pos", "before", "size")).alias("at"))
    different = SharedTable(contexts, "different")
    # a stage of its own, so that the join may split the contexts of a frequent anchor
    grams = written(different.df.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("n").alias("all")).where("all > 1"), "grams")
    contexts = written(different.df.join(grams.hint("merge"), "gram").select(*KEYS, "n", "at.*", "contexts"), "contexts")
    different.drop()  # all that is read from it is written
    # contexts that occur once need their bytes held against the others of their anchor
    mixed = contexts.where("contexts > 1")
    needed = KeyFilter(mixed.select("row"), "row", "needed").split(rows, "row")[0]  # other texts aren't shuffled

    def with_text(part: DataFrame) -> DataFrame:
        places = part.groupBy("row").agg(F.collect_list(F.struct("pos", *KEYS, "n", "before", "size")).alias("places"))
        return needed.join(places, "row").select("text", "places")

    def take(batches):
        schema = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("before", pa.int32()), ("context", pa.binary())])
        for batch, texts in chunks(batches):
            out = []
            for text, places in zip(texts, batch.column(1).to_pylist(), strict=True):
                code = text.encode("utf-8", "replace")
                out += [(p["gram"], p["k1"], p["k2"], p["n"], p["before"], code[p["pos"] - p["before"] : p["pos"] + p["size"]]) for p in places]
            yield as_batch(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    kinds = "gram long, k1 long, k2 long, n long, before int, context binary"
    pieces = with_text(mixed.where(F.col("contexts") <= hot)).mapInArrow(take, kinds)

    def order(batches):
        wide, room = 2 * length - gram, length - gram
        schema = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("whole", pa.bool_()), ("low", pa.int32()), ("high", pa.int32())])

        def built(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            g, n, left = (t[c].to_numpy() for c in ("gram", "n", "before"))
            codes = t["context"].to_pylist()
            group = np.cumsum(np.append(0, g[1:] != g[:-1]))
            right = np.array([len(c) for c in codes]) - left
            table = np.frombuffer(b"".join(b"\0" * (room - x) + c + b"\0" * (length - y) for c, x, y in zip(codes, left, right, strict=True)), np.uint8)
            ends = column_order(group, np.ascontiguousarray(table.reshape(-1, wide).T), left, right, length, least, gram)
            out = []
            for size, first, last in zip(sizes, ends[::2], ends[1::2], strict=True):
                hit = np.flatnonzero((first >= 0) & (n == 1))
                out.append(as_batch(schema, gram=g[hit], k1=t["k1"].to_numpy()[hit], k2=t["k2"].to_numpy()[hit], whole=np.full(len(hit), size == length), low=(first[hit] - room).astype(np.int32), high=(last[hit] - room + size).astype(np.int32)))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(map(len, out)) else out[0]

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            g = batch.column(0).to_numpy()
            begin = 0
            cuts = np.flatnonzero(np.append(not held or held[-1].column(0)[-1].as_py() != g[0], g[1:] != g[:-1])) if len(g) else []
            for cut in cuts:  # an anchor's contexts stay together
                if count + cut - begin >= BLOCK:
                    held.append(batch.slice(begin, cut - begin))
                    yield built([b for b in held if len(b)])
                    held, count, begin = [], 0, cut
            held.append(batch.slice(begin))
            count += len(g) - begin
        if count:
            yield built([b for b in held if len(b)])

    spans = pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(order, "gram long, k1 long, k2 long, whole boolean, low int, high int")

    hot_bytes = written(with_text(mixed.where(F.col("contexts") > hot)).mapInArrow(take, kinds), "hot")
    size = F.when(F.col("whole"), length).otherwise(least)
    for one in sizes if hot_bytes.take(1) else ():
        spans = spans.union(hot_spans(hot_bytes, one, gram).select(*KEYS, F.lit(one == length).alias("whole"), "low", "high"))
    copied = contexts.where("n > 1").select(*KEYS, F.explode(F.array(*(F.lit(x == length) for x in sizes))).alias("whole"), (-F.col("before")).alias("low"), F.col("size").alias("high"))
    spans = spans.union(copied)
    spans = written(spans.where(F.col("high") - F.col("low") >= size).groupBy(*KEYS, "whole").agg(F.min("low").alias("low"), F.max("high").alias("high")), "spans")
    hits = found.select("row", "pos", *KEYS).join(spans, KEYS).select("row", (F.col("pos") + F.col("low")).alias("start"), (F.col("pos") + F.col("high")).alias("end"), "whole")
    hits = hits.union(runs.select("row", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"), F.lit(True).alias("whole")))
    return hits.groupBy("row").agg(F.collect_set(F.struct("start", "end", "whole")).alias("spans"))


def hot_spans(contexts: DataFrame, size: int, gram: int) -> DataFrame:
    """(gram, k1, k2, low, high): of the contexts (gram, k1, k2, n, before, context) of anchors that too many share for one task, stretches of windows that other contexts have as well.

    Windows are looked at in blocks of neighbouring starts. What all windows of a block have in common must occur twice for one of them to be
    repeated, and if what the block covers occurs twice, all are. Blocks between the two are cut in four, with all contexts that share their
    middle, until they are single windows; so a passage that very many texts share costs a context a few blocks at its ends.
    """
    room, width, live, found = size - gram, -(-(size - gram + 1) // 4), None, None
    schema = pa.schema([*((k, pa.int64()) for k in (*KEYS, "n")), ("at", pa.int32()), *((k, pa.int64()) for k in ("m1", "m2", "c1", "c2"))])

    def keyed(width: int, last: int):
        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    code, before = row["context"], row["before"]
                    low, high = max(-before, -room), min(len(code) - before - size, 0)
                    blocks = range(-room, 1, width) if row["blocks"] is None else [x for b in row["blocks"] for x in range(b, min(b + last, 1), width)]
                    for a in blocks:
                        b = min(a + width - 1, 0)
                        if a > high or b < low or low > high:
                            continue
                        middle = np.frombuffer(xxhash.xxh3_128_digest(code[before + b : before + a + size]), ">i8").tolist()
                        cover = np.frombuffer(xxhash.xxh3_128_digest(code[before + a : before + b + size]), ">i8").tolist() if a >= low and b <= high else [None, None]
                        out.append((row["gram"], row["k1"], row["k2"], row["n"], a, *middle, *cover))
                if out:
                    yield as_batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

        return run

    last = width
    while True:
        asked = contexts.withColumn("blocks", F.lit(None).cast("array<int>")) if live is None else contexts.join(live, KEYS)
        rows = written(asked.mapInArrow(keyed(width, last), "gram long, k1 long, k2 long, n long, at int, m1 long, m2 long, c1 long, c2 long"), "blocks")
        middle, cover = ["gram", "at", "m1", "m2"], ["gram", "at", "c1", "c2"]
        twice = lambda keys, rows=rows: rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).count().where("count > 1").drop("count")
        own, covered = rows.where("n = 1"), written(twice(cover), "covered")
        sure = own.join(covered, cover, "left_semi").select(*KEYS, F.col("at").alias("low"), (F.least(F.col("at") + width - 1, F.lit(0)) + size).cast("int").alias("high"))
        sure = sure.groupBy(*KEYS).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        found = sure if found is None else found.union(sure)
        if width == 1:
            return found
        open_ = own.join(covered, cover, "left_anti").select(*middle).distinct().join(twice(middle), middle, "left_semi")
        live = rows.join(open_, middle, "left_semi").groupBy(*KEYS).agg(F.collect_set("at").alias("blocks"))
        last, width = width, -(-width // 4)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, least: int | None = None, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated (bytes under repeats of `least` bytes, by default `length`), and kept (the bytes that stay) unless with_texts=False."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("row", F.xxhash64("doc_id", "text"))  # rows that are alike in both have the same result
    spans = repeated_spans(named.select("row", "text"), length, min(length, least or length), gram, hot)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch, texts in chunks(batches):
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_repeated": [], "kept": []}
            for text, found in zip(texts, batch.column(2).to_pylist(), strict=True):
                code = text.encode("utf-8", "replace")
                runs = merged([(s["start"], s["end"]) for s in found or [] if s["whole"]])
                repeated = sum(b - a for a, b in merged([(s["start"], s["end"]) for s in found or []]))
                at, kept = 0, []
                for a, b in runs:
                    kept.append(code[at:a])
                    at = b
                rest = b"".join([*kept, code[at:]])
                for name, value in zip(out, (len(code), len(code) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), repeated, rest), strict=True):
                    out[name].append(value)
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())] + ([("kept", pa.binary())] if with_texts else []))
            yield as_batch(schema, **{f: out[f] if f in out else batch.column(0) for f in schema.names})

    kinds = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + ", kept binary" * with_texts
    spans = written(spans, "spans-by-row")
    maybe, whole = KeyFilter(spans, "row", "spans").split(named, "row")
    both = maybe.join(spans, "row", "left").select("doc_id", "text", "spans").union(whole.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType)))
    return both.mapInArrow(cut, kinds)
