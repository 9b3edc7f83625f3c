"""Quality by a generalised additive model with pairwise interactions, boosted cyclically in shallow trees.

A text becomes FEATURES, numbers of its form that know no language: shares of kinds of characters, of words and lines that
repeat, lengths, entropy. Each feature is cut into bins at quantiles of the training rows. The model is one table of values for each
feature and for each of the chosen pairs of features; a text's logit is the sum of its bins' entries, so scoring a batch is one
look-up and addition of an array a table.

Learning goes round the features in turn: each gets a small tree on its bins, fitted to the gradient that all tables together
leave, and a small step of it is added to its table. No feature is served first, so features that say the same share the effect.
When a part of the training rows kept apart stops gaining, pairs are ranked by what the best cross (one cut on either feature) would take off the
loss; the best PAIRS of them are boosted alike, with such crosses as trees. BAGS models on different parts are averaged, table by
table, which is again one model.

Training uses at most `per_class` labelled texts of either class, those of the smallest hash of their id, whole, weighted back
to the classes' sizes; the driver holds their features only (about 20 numbers a text). Texts are scored where they lie: no shuffle.

Defined results: null and empty texts are texts of no characters and score like any other; without training texts of both
classes every score is the share of good ones (0.5 if there is none); labels other than 0 and 1 and rows with null ids don't
teach; of several labels of an id the largest holds; repeated rows are scored each; other columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, release

PER_CLASS = 20_000
#: Bins of a feature, and of either feature of a pair; pairs; models that are averaged.
BINS, PAIR_BINS, PAIRS, BAGS = 48, 12, 10, 4
#: Size of a step, rounds at most, rounds without gain after which learning ends, leaves of a tree, and rows (by weight) that a leaf needs.
RATE, ROUNDS, PATIENCE, LEAVES, LEAST = 0.1, 400, 25, 3, 5.0
FEATURES = ("log_chars", "log_words", "word_length", "line_length", "upper", "digits", "points", "symbols", "marks_in_words", "spaces", "distinct_words", "word_again", "commonest_word", "distinct_lines", "lines_ended", "caps_words", "odd_endings", "entropy", "letter_runs", "longest_word")
#: Those that are taken text by text, and what ends a sentence.
PER_TEXT = [FEATURES.index(x) for x in ("line_length", "distinct_words", "word_again", "commonest_word", "distinct_lines", "lines_ended", "entropy")]
ENDS = frozenset(".!?…:;\"'”»")
LETTER, UPPER, DIGIT, POINT, SYMBOL, SPACE, MARK = 1, 2, 4, 8, 16, 32, 64


@cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    table = np.full(0x110000, SYMBOL, np.uint8)
    for code in range(0x30000):
        c = unicodedata.category(chr(code))
        table[code] = LETTER | UPPER if c in ("Lu", "Lt") else LETTER if c[0] == "L" else MARK if c[0] == "M" else DIGIT if c[0] == "N" else SPACE if c[0] == "Z" or code in (9, 10, 11, 12, 13) else SYMBOL
    table[[ord(x) for x in ".,;:!?'\"()-¿¡«»…–—’‘“”"]] = POINT
    return table


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    column = dict(zip(FEATURES, out.T, strict=True))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)  # a line end after each text
    kind = kinds()[codes]
    begin = np.cumsum(lengths + 1) - lengths - 1

    def count(at: np.ndarray) -> np.ndarray:
        """How many of the ascending places lie in each text."""
        return np.searchsorted(at, begin + lengths) - np.searchsorted(at, begin)

    letter, upper, space = (kind & LETTER) > 0, (kind & UPPER) > 0, kind == SPACE
    column["log_chars"][:] = np.log1p(lengths)
    inside = letter[:-2] & letter[2:] & ((kind[1:-1] & (POINT | SYMBOL)) > 0)
    for name, flags in (("upper", upper), ("digits", kind == DIGIT), ("points", kind == POINT), ("symbols", kind == SYMBOL), ("spaces", space), ("letter_runs", letter[1:] & (codes[1:] == codes[:-1])), ("marks_in_words", inside)):
        column[name][:] = count(np.flatnonzero(flags) + (len(codes) - len(flags) + 1) // 2) / np.maximum(lengths, 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))  # where words begin and end, in turn
    first, end = edges[::2], edges[1::2]
    n = np.maximum(count(first), 1)
    small, large = (np.concatenate([[0], np.cumsum(x)]) for x in (letter & ~upper, upper))
    column["log_words"][:] = np.log1p(count(first))
    column["caps_words"][:] = count(first[(small[end] == small[first]) & (large[end] - large[first] > 1)]) / n
    column["odd_endings"][:] = count(first[(kind[end - 1] == SYMBOL) | (codes[end - 1] == ord("!"))]) / n
    column["word_length"][:] = (lengths - count(np.flatnonzero(space))) / n
    longest = np.zeros(len(texts))
    np.maximum.at(longest, np.searchsorted(begin, first, side="right") - 1, end - first)
    column["longest_word"][:] = np.log1p(longest)
    for k, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        counts = Counter(words)
        p = np.bincount(codes[begin[k] : begin[k] + lengths[k]] & 1023)
        p = p[p > 0] / max(1, lengths[k])
        m, width = max(1, len(lines)), max(1, len(words))
        out[k, PER_TEXT] = np.log1p(len(text) / m), len(counts) / width, sum(map(eq, words, words[1:])) / width, max(counts.values(), default=0) / width, len(set(lines)) / m, sum(x.rstrip()[-1:] in ENDS for x in lines) / m, -(p * np.log2(p)).sum()
    return out


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between at most `bins` bins, at quantiles, between different values."""
    found = np.unique(values)
    if len(found) <= bins:
        return (found[1:] + found[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="midpoint"))


def stumps(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The value of each bin by a tree of at most so many leaves on sums by bin: cuts one after another, each the one that gains most."""
    g, h = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, weight))
    parts = [(0, len(gradient))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            cut = np.arange(a + 1, b)
            lg, lh, rg, rh = g[cut] - g[a], h[cut] - h[a], g[b] - g[cut], h[b] - h[cut]
            gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1), -1)
            if len(cut) and gain.max() > best[0]:
                best = (gain.max(), k, int(cut[gain.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def cross(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """What the best cross (a cut on either axis) gains on sums by bins of two features, and the values of the bins."""
    g, h = (np.pad(np.cumsum(np.cumsum(x, axis=0), axis=1), ((1, 0), (1, 0))) for x in (gradient, weight))
    if min(gradient.shape) < 2:
        return 0.0, np.zeros(gradient.shape)

    def quarters(t: np.ndarray) -> list[np.ndarray]:
        a, left, top, all_ = t[1:-1, 1:-1], t[1:-1, -1:], t[-1:, 1:-1], t[-1, -1]
        return [a, left - a, top - a, all_ - left - top + a]

    gs, hs = quarters(g), quarters(h)
    gain = sum(x**2 / (np.maximum(y, 0) + 1) for x, y in zip(gs, hs, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + 1)
    gain = np.where(np.minimum.reduce([np.where(y < 1e-9, least, y) for y in hs]) >= least, gain, 0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(gradient.shape)
    for (rows, cols), x, y in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs, strict=True):
        out[rows, cols] = x[i, j] / (max(y[i, j], 0) + 1)
    return float(gain[i, j]), out


class AdditiveModel:
    """An offset, cuts and a table for each feature, and coarser cuts and a table for each pair."""

    def __init__(self, share: float = 0.5):
        self.share, self.cuts = share, None

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = PAIRS, bags: int = BAGS, seed: int = 5) -> AdditiveModel:
        self.cuts, self.coarse = ([cuts_of(c, n) for c in x.T] for n in (BINS, PAIR_BINS))
        fine, coarse = self.binned(x)
        rng = np.random.default_rng(seed)
        part = rng.permutation(len(y)) % max(2, bags)
        loss = lambda z, rows: (weight[rows] * np.logaddexp(0, np.where(y[rows] == 1, -z[rows], z[rows]))).sum()

        def boost(z: np.ndarray, tables: list[np.ndarray], places: list[np.ndarray], tree, inner: np.ndarray, apart: np.ndarray) -> None:
            """Adds steps to the tables, round by round, and leaves them and z as they were in the round that was best apart."""
            best, since = loss(z, apart), 0
            kept = ([t.copy() for t in tables], z.copy())
            for _ in range(ROUNDS):
                for t, at in zip(tables, places, strict=True):
                    p = 1 / (1 + np.exp(-z[inner].clip(-30, 30)))
                    w = weight[inner]
                    g, h = (np.bincount(at[inner], v, t.size).reshape(t.shape) for v in (w * (y[inner] - p), w * p * (1 - p)))
                    step = RATE * tree(g, h).clip(-4, 4)
                    t += step
                    z += step.ravel()[at]
                now = loss(z, apart)
                if now < best - 1e-6 * abs(best):
                    best, since, kept = now, 0, ([t.copy() for t in tables], z.copy())
                elif (since := since + 1) >= PATIENCE:
                    break
            for t, old in zip(tables, kept[0], strict=True):
                t[:] = old
            z[:] = kept[1]

        share = float((weight * y).sum() / weight.sum())
        self.offset = np.log(share / (1 - share))
        runs = []
        for b in range(max(1, bags)):
            inner, apart = np.flatnonzero(part != b), np.flatnonzero(part == b)
            z, tables = np.full(len(y), self.offset), [np.zeros(len(c) + 1) for c in self.cuts]
            boost(z, tables, list(fine.T), lambda g, h: stumps(g, h, LEAVES, LEAST), inner, apart)
            runs.append((inner, apart, z, tables))
        shapes = [(len(self.coarse[i]) + 1, len(self.coarse[j]) + 1) for i, j in combinations(range(x.shape[1]), 2)]
        gains = []
        for (i, j), shape in zip(combinations(range(x.shape[1]), 2), shapes, strict=True):
            at, total = coarse[:, i] * shape[1] + coarse[:, j], 0.0
            for inner, _, z, _ in runs:
                p = 1 / (1 + np.exp(-z[inner].clip(-30, 30)))
                g, h = (np.bincount(at[inner], v, shape[0] * shape[1]).reshape(shape) for v in (weight[inner] * (y[inner] - p), weight[inner] * p * (1 - p)))
                total += cross(g, h, LEAST)[0]
            gains.append((total, i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(gains, key=lambda x: (-x[0], x[1:]))[:pairs] if gain > 0]
        widths = [len(c) + 1 for c in self.coarse]
        places = [coarse[:, i] * widths[j] + coarse[:, j] for i, j in self.pairs]
        crossed = []
        for inner, apart, z, _ in runs:
            own = [np.zeros((widths[i], widths[j])) for i, j in self.pairs]
            if own:
                boost(z, own, places, lambda g, h: cross(g, h, LEAST)[1], inner, apart)
            crossed.append(own)
        self.tables = [sum(r[3][k] for r in runs) / len(runs) for k in range(x.shape[1])]
        self.pair_tables = [sum(c[k] for c in crossed) / len(runs) for k in range(len(self.pairs))]
        return self

    def binned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1) for cuts in (self.cuts, self.coarse))

    def logits(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.binned(x)
        z = np.full(len(x), self.offset)
        for t, at in zip(self.tables, fine.T, strict=True):
            z += t[at]
        for t, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
            z += t[coarse[:, i], coarse[:, j]]
        return z

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.cuts is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-self.logits(features(texts)).clip(-500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """A model from labelled rows for which `learn` (a condition on the label table's id) holds."""
    spark = docs.sparkSession
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = dict(known.groupBy("label").count().collect())
    if len(sizes) < 2:
        return AdditiveModel(float(*sizes) if sizes else 0.5)
    few = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    chosen = spark.createDataFrame(few, known.schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch, texts in chunks(batches, limit=1 << 20):
            yield as_batch(schema, label=batch.column(batch.schema.get_field_index("label")), x=list(features(texts)))
        release()

    # repeated rows of an id teach once, whatever the order in which they come
    found = rows.select("doc_id", "label", "text").mapInArrow(run, "label int, x array<double>").groupBy("label", "x").count().toArrow()
    y, x, n = found["label"].to_numpy(), np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES)), found["count"].to_numpy().astype(float)
    share = sizes[1] / sum(sizes.values())
    if len(set(y.tolist())) < 2:
        return AdditiveModel(share)
    order = np.lexsort([*x.T, y])
    x, y, n = x[order], y[order], n[order]
    weight = n * np.array([sizes[v] / n[y == v].sum() for v in y.tolist()])
    return AdditiveModel(share).fit(x, y.astype(float), weight * n.sum() / weight.sum())


def quality(docs: DataFrame, model: AdditiveModel, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `least` on) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches, limit=1 << 20):
            score = held.value.scores(texts)
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("score", pa.float64()), ("predicted", pa.int32())])
            yield as_batch(schema, doc_id=batch.column(0), score=score, predicted=(score >= least).astype(np.int32))
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
