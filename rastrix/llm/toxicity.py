"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Two words are alike by the subsequences of four characters they share, gaps allowed: a subsequence that spans s characters
weighs DECAY**s, up to SPAN. Words get a mark at either end; characters that are no letter or digit are left out, and runs of
single characters ("i d i o t") are read as one word, so gapped and spelled-out insults look like plain ones, and an inserted
letter only weakens the likeness. Landmark words give the Nyström map: kernel values with the landmarks, whitened by the
landmarks' own kernel. A linear machine (squared hinge) on it judges words. As the kernel's features can be written down,
machine, landmarks and map fold into one table of weights per subsequence (hashed), and a word costs a few look-ups.

Labels are of texts, so training is on several instances: of a toxic text one word at least is at fault, of any other none is. A text
scores as its most toxic word. The machine starts from words that occur in toxic texts far more often than chance, in different surroundings
(copies of a text show the same ones and count once), along with variants that have a character inserted. Then, in each of ROUNDS rounds, Spark
finds the word of every labelled text that the machine takes as most toxic (its witness): those of toxic texts are the one class,
and those of the others join the other class. A word that speaks for one toxic text alone, below
the margin, may be there by chance and stays out. A logistic curve fitted on training texts kept apart maps a text's score to 0..1.

Training uses at most `per_class` labelled texts of either class, those of the smallest hash of their id, whole; the Nyström map has at most
`landmarks` words. The driver holds a few words for each of these texts, and the machine's matrix of landmarks times landmarks.

Defined results: null and empty texts, and texts without a letter or digit, score as the least toxic word does; without
training texts of both classes every score is the share of toxic ones (0 if there is none); labels other than 0 and 1 and rows
with null ids don't teach; of several labels of an id the largest holds; repeated rows are scored each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, release, written

DECAY, SPAN, SLOTS = 0.5, 7, 1 << 20
LANDMARKS, PER_CLASS = 1000, 3000
#: Rounds of finding witnesses, and words that each text of the other class gives in one.
ROUNDS, HARDEST = 4, 3
#: An insult is so many times as frequent in toxic texts as in others, and at most this share of such words may be there by chance.
TIMES, BY_CHANCE = 20.0, 0.03
#: Bytes of memo at most, about; what texts without words score.
MEMO_BYTES, FLOOR = 64 << 20, -3.0
SPELLED = re.compile(r"(?<=\s)\w(?:\s\w){2,}(?!\S)")
OTHER = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words as they stand, and runs of single characters as one word each."""
    low = text.lower()
    found = low.split()
    if m := SPELLED.findall(f" {low}"):
        found += ["".join(x.split()) for x in m]
    return found


PATTERNS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def by_length(words: list[str]):
    """(places in the list, code points of the words there between the marks 1 and 2, a row each) for each length of word."""
    if not words:
        return
    clean = [OTHER.sub("", w) for w in words]
    lengths = np.fromiter(map(len, clean), np.int64, len(clean))
    order = np.argsort(lengths, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(lengths[order]) > 0))
    for at, end in zip(bounds, [*bounds[1:], len(words)], strict=True):
        rows = order[at:end]
        points = np.frombuffer("".join(f"\1{clean[k]}\2" for k in rows).encode("utf-32-le", "replace"), np.uint32)
        yield rows, points.reshape(len(rows), -1)


def subsequences(points: np.ndarray):
    """For each pattern of gaps: the slots of the subsequences of each row, and their weight."""
    one, two, three = (np.ascontiguousarray(points.T) * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    one7 = one >> np.uint32(7)
    for a, b, c in PATTERNS:
        if (n := len(one) - c) > 0:
            h = (one[:n] ^ two[a : a + n]) * np.uint32(0x27D4EB2F) + (three[b : b + n] ^ one7[c : c + n])
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(12), np.float32(DECAY ** (c + 1))


def size(width: int) -> float:
    """The length in feature space of a word with so many symbols, had it no subsequence twice."""
    return max(1e-9, sum(max(0, width - c) * DECAY ** (2 * c + 2) for _, _, c in PATTERNS)) ** 0.5


class Landmarks:
    """Landmark words: for each slot the landmarks that hold it and its weight in them, slot after slot."""

    def __init__(self, words: list[str]):
        found = [(slots, np.broadcast_to(rows, slots.shape), np.full(slots.shape, weight / size(points.shape[1]))) for rows, points in by_length(words) for slots, weight in subsequences(points)]
        slot, row, weight = (np.concatenate([np.zeros(0, kind), *(f[k].ravel() for f in found)]) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        keys, back = np.unique(slot * len(words) + row, return_inverse=True)  # a slot twice in a word weighs twice
        self.n, self.weight = len(words), np.bincount(back, weights=weight, minlength=len(keys))
        self.slot, self.row = keys // max(1, len(words)), keys % max(1, len(words))
        self.begin = np.searchsorted(self.slot, np.arange(SLOTS + 1)).astype(np.int32)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words (rows) with the landmarks."""
        out = np.zeros((len(words), self.n))
        for rows, points in by_length(words):
            for k in range(0, len(rows), 500):
                part = rows[k : k + 500]
                for slots, weight in subsequences(points[k : k + 500]):
                    begin, n = self.begin[slots.ravel()], np.diff(self.begin)[slots.ravel()]
                    entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = np.repeat(np.tile(np.arange(len(part)), slots.shape[0]), n)
                    out[part] += weight * np.bincount(at * self.n + self.row[entry], weights=self.weight[entry], minlength=len(part) * self.n).reshape(len(part), self.n)
            out[rows] /= size(points.shape[1])
        return out

    def folded(self, beta: np.ndarray) -> np.ndarray:
        """The weight of each slot in the sum of the landmarks, each times its beta."""
        return np.bincount(self.slot, weights=self.weight * beta[self.row], minlength=SLOTS).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the last weight is the offset. A step's matrix changes by the rows only that come inside the margin or leave it."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    h = np.eye(x.shape[1])
    h[-1, -1] = 1e-6
    w, pull, within = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(len(x), bool)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        changed = np.flatnonzero(inside != within)
        if not len(changed):
            break
        part, signed = x[changed], cost * weight[changed] * np.where(inside[changed], 1.0, -1.0)
        h += (part * signed[:, None]).T @ part
        pull += part.T @ (signed * y[changed])
        new, within = np.linalg.solve(h, pull), inside
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def with_insertions(word: str) -> list[str]:
    """Variants of a word with a character inserted."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in ("x", word[k - 1])] if len(word) > 3 else []


class ToxicModel:
    """Weights of subsequences, an offset, and the logistic curve of a text's score."""

    def __init__(self, share: float = 0.0):
        self.table: np.ndarray | None = None
        self.offset, self.slope, self.middle, self.share = 0.0, 1.0, 0.0, share
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, float] = {}
        self.memo_bytes = 0

    def fit(self, insults: list[str], others: list[str], marks: list[str]) -> None:
        """From words of either class, which weigh the same in all; marks: the landmarks."""
        basis = Landmarks(marks)
        values, vectors = np.linalg.eigh(basis.kernel(marks))
        keep = values > 1e-4
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        positive = list(dict.fromkeys([*insults, *(v for w in insults for v in with_insertions(w))]))
        x = basis.kernel([*positive, *others]) @ whiten
        y = np.repeat([1.0, -1.0], [len(positive), len(others)])
        weight = np.append(np.full(len(positive), 1 / len(positive)), np.full(len(others), 1 / max(1, len(others)))) * 1000
        w = machine(x, y, weight)
        self.table = basis.folded(whiten @ w[:-1])
        self.offset = float(w[-1])
        self.forget()

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.offset, np.float32)
        for rows, points in by_length(words):
            for k in range(0, len(rows), 20_000):
                total = sum((self.table[slots].sum(axis=0) * weight for slots, weight in subsequences(points[k : k + 20_000])), np.float32(0))
                out[rows[k : k + 20_000]] += total / np.float32(size(points.shape[1]))
        return out

    def learn(self, words: set[str]) -> None:
        """Judges the words that the memo lacks."""
        new = words.difference(self.memo)
        if self.memo_bytes > MEMO_BYTES:
            self.forget()
            new = words
        new = list(new)
        self.memo.update(zip(new, self.decisions(new).tolist(), strict=True))
        self.memo_bytes += sum(map(len, new)) + 150 * len(new)

    def margins(self, texts: list[str]) -> np.ndarray:
        """The decision on each text's most toxic word."""
        split = [set(words_of(t)) for t in texts]
        self.learn(set().union(*split))
        get = self.memo.__getitem__
        return np.array([max(map(get, words), default=FLOOR) for words in split])

    def witnesses(self, texts: list[str], most: list[int]) -> list[list[tuple[str, float]]]:
        """The most toxic words of each text, so many at most, letters and digits only, and the decisions on them."""
        split = [sorted({c for w in words_of(t) if (c := OTHER.sub("", w))}) for t in texts]
        self.learn(set().union(*split))
        return [sorted(((w, self.memo[w]) for w in words), key=lambda x: -x[1])[:n] for words, n in zip(split, most, strict=True)]

    def calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Fits the logistic curve by Newton steps, with the labels drawn in by one count of either class."""
        ones = labels.sum()
        target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
        x = np.stack([margins, np.ones(len(margins))], axis=1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
            step = np.linalg.solve(h, x.T @ (target - p) - np.array([1e-3, 0]) * w)
            w += step.clip(-2, 2)
            if np.abs(step).max() < 1e-7:
                break
        self.slope, self.middle = w.tolist()

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-(self.slope * self.margins(texts) + self.middle).clip(-500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """A model from labelled rows for which `learn` (a condition on the label table's id) holds."""
    spark = docs.sparkSession
    known = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    hashed = known.withColumn("h", F.xxhash64("doc_id"))
    few = [r for y in (0, 1) for r in hashed.where(F.col("label") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    if len({r["label"] for r in few}) < 2:
        return ToxicModel(float(bool(few and few[0]["label"])))
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in few], hashed.select("doc_id", "label").schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))), "labelled")
    schema = pa.schema([("word", pa.string()), ("around", pa.int64()), ("label", pa.int32())])

    def places(batches):
        for batch, texts in chunks(batches):
            for label, text in zip(batch.column(batch.schema.get_field_index("label")).to_pylist(), texts, strict=True):
                words = words_of(text)
                around = [xxhash.xxh64_intdigest(f"{a} {b}") >> 1 for a, b in zip(["", *words[:-1]], [*words[1:], ""])][: len(words)]
                both = list(dict.fromkeys((c, x) for w, x in zip(words, around, strict=True) if len(c := OTHER.sub("", w)) > 1))
                yield as_batch(schema, word=[x[0] for x in both], around=[x[1] for x in both], label=[label] * len(both))

    counted = rows.where("fold <> 0").mapInArrow(places, "word string, around long, label int").distinct().groupBy("word").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    counted = written(counted, "words")
    all_bad, all_good = counted.agg(F.sum("bad"), F.sum("good")).first()
    odds = (F.col("bad") + 0.5) / F.lit((all_bad or 0) + 1.0) / ((F.col("good") + 0.5) / F.lit((all_good or 0) + 1.0))
    least = least_places(counted, (all_bad or 0) / max(1, (all_bad or 0) + (all_good or 0)))
    start = {r[0]: float(r[1]) for r in counted.where((F.col("bad") >= least) & (odds >= TIMES)).select("word", "bad").collect()}  # words of the chosen texts
    clean = counted.where("good > 0")
    common = [r[0] for r in clean.orderBy(F.desc("good"), "word").limit(landmarks // 4).collect()]
    spread = [r[0] for r in clean.orderBy(F.xxhash64("word"), "word").limit(landmarks // 2).collect()]
    model = ToxicModel(sum(r["label"] for r in few) / len(few))
    if not start or not common:
        return model
    insults, others = start, list(dict.fromkeys(common + spread))
    for _ in range(ROUNDS):
        others = [w for w in others if w not in insults]
        most = sorted(insults, key=lambda w: (-insults[w], w))[: landmarks // 4]
        # the newest words of the other class are the hardest
        model.fit(list(insults), others, list(dict.fromkeys(most + others[::-1][: landmarks // 4] + common + spread))[:landmarks])
        found = witness_table(rows.where("fold <> 0"), model).collect()  # a few rows for each chosen text
        texts, best, hard = Counter(), {}, {}
        for label, word, decision in found:
            if label:
                texts[word] += 1
                best[word] = max(decision, best.get(word, decision))
            elif decision > -1:
                hard[word] = max(decision, hard.get(word, decision))
        insults = start | {w: float(n) for w, n in sorted(texts.items()) if (n > 1 or best[w] >= 1) and (w not in hard or w in start)}
        others = list(dict.fromkeys(others + sorted(hard, key=lambda w: (hard[w], w))))
    others = [w for w in others if w not in insults]
    most = sorted(insults, key=lambda w: (-insults[w], w))[: landmarks // 4]
    model.fit(list(insults), others, list(dict.fromkeys(most + others[::-1][: landmarks // 4] + common + spread))[:landmarks])
    apart = margin_table(rows.where("fold = 0"), model).toPandas()
    if apart["label"].nunique() == 2:
        model.calibrate(apart["margin"].to_numpy(), apart["label"].to_numpy())
    return model


def witness_table(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """(label, word, decision): of each different text of rows (text, label) the witness, of those that aren't toxic the HARDEST most toxic words."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("label", pa.int32()), ("word", pa.string()), ("decision", pa.float64())])

    def run(batches):
        for batch, texts in chunks(batches, limit=1 << 20):
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            best = held.value.witnesses(texts, [1 if y else HARDEST for y in labels])
            found = [(y, w, d) for y, words in zip(labels, best, strict=True) for w, d in words]
            yield as_batch(schema, label=[f[0] for f in found], word=[f[1] for f in found], decision=[f[2] for f in found])

    return rows.select("text", "label").distinct().mapInArrow(run, "label int, word string, decision double")


def margin_table(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """(label, margin) of rows (text, label)."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in chunks(batches, limit=1 << 20):
            yield as_batch(pa.schema([("label", pa.int32()), ("margin", pa.float64())]), label=batch.column(batch.schema.get_field_index("label")), margin=held.value.margins(texts))

    return rows.select("text", "label").mapInArrow(run, "label int, margin double")


def least_places(counted: DataFrame, share: float, most: int = 30) -> int:
    """In how many different surroundings of toxic texts, and no others, a word must stand: the least number at which few words do so by chance."""
    total = dict(counted.groupBy((F.col("bad") + F.col("good")).alias("n")).count().where(F.col("n") <= most).collect())
    pure = dict(counted.where("good = 0").groupBy("bad").count().where(F.col("bad") <= most).collect())
    return next((n for n in range(2, most) if pure.get(n, 0) and total[n] * share**n <= BY_CHANCE * pure[n]), most)


def toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from a half on) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches, limit=1 << 20):
            score = held.value.scores(texts)
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("score", pa.float64()), ("predicted", pa.int32())])
            yield as_batch(schema, doc_id=batch.column(0), score=score, predicted=(score >= 0.5).astype(np.int32))
        held.value.forget()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
