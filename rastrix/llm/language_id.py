"""Language identification with interpolated Kneser-Ney character models.

For each language, character n-grams up to `order` of its training texts give a model with absolute discounts: the highest
order uses counts, lower ones the number of different characters seen before (continuation counts), and each level passes its
discounted mass to the next. The n-grams of a language lie in one sorted array of 64-bit hashes per order; look-ups are binary
searches. A text's language is that of the lowest cross-entropy per character. It is rejected if that cross-entropy lies more
than DEVIATIONS standard deviations above the language's mean; mean and deviation (with a part that shrinks with the length) are
calibrated on training texts that the counts don't hold. The score is the language's share among all, times a logistic curve of
the distance to that limit, so text of no learned language scores low.

Letters are lower-cased; all other characters are boundaries. Spark counts n-grams and deals out the texts; a task looks up
the distinct n-grams of a chunk once.

Training uses `per_language` labelled texts of each language on average (those of the smallest hash of their id), whole. The
models hold all n-grams of these texts and are broadcast: their size follows this bounded sample, not the table.

Defined results: null texts and texts without a letter are `und` with score 0 and are rejected; without any training text
everything is `und`; ties go to the first language in alphabetical order; repeated rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks

UNKNOWN = "und"
ORDER = 4
PER_LANGUAGE = 400
#: Standard deviations above the mean of its language that a text's cross-entropy may lie. The spread has a heavy tail: at 4 of them
#: 35 of 10,000 texts (sf0.1) lie higher, clean ones among them; text of other languages and random letters lies far above 8.
DEVIATIONS = 8.0
#: How fast the score falls at that limit, for each nat.
SHARP = 12.0
#: Characters of text that a task takes up at once.
AT_ONCE = 2 << 20
#: Log-probability of a character no model knows: one of so many.
ALPHABET = 10_000


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each run of other characters as one 0, each text between two zeros; and where each text begins."""
    if not _table:
        _table.append(_letters())
    joined = "\0" + "\0\0".join(t.replace("\0", " ") for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    low = _table[0][raw]
    ends = np.cumsum([len(t) + 2 for t in texts])
    first = np.zeros(len(low), bool)
    first[np.append(0, ends[:-1])] = True
    keep = (low != 0) | first | np.append(True, low[:-1] != 0)
    out = low[keep]
    return out, np.searchsorted(np.flatnonzero(keep), np.flatnonzero(first))


def gram_codes(sym: np.ndarray, begins: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places with a character to predict, for n = 1..order the n symbols that end there); before its text's start all is 0."""
    own = np.zeros(len(sym), np.int64)
    own[begins] = 1
    begin_of = begins[np.cumsum(own) - 1]
    at = np.flatnonzero(own == 0)
    return at, [np.where(at - k >= begin_of[at], sym[np.maximum(at - k, 0)], 0) for k in range(order)]


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of symbols, the last symbol first."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def count_grams(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram: `order` code points, the last character first, n) over the texts of rows (lang, text)."""

    def run(batches):
        for batch, texts in chunks(batches, limit=AT_ONCE):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang in sorted(set(langs)):
                sym, begins = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
                at, grams = gram_codes(sym, begins, order)
                if not len(at):
                    continue
                found, n = np.unique(np.stack(grams, axis=1), axis=0, return_counts=True)
                yield as_batch(pa.schema([("lang", pa.string()), ("gram", pa.list_(pa.int32())), ("n", pa.int64())]), lang=[lang] * len(found), gram=found.astype(np.int32).tolist(), n=n)

    return rows.mapInArrow(run, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """Kneser-Ney models of several languages; each has sorted hash arrays of its own, so size follows the n-grams, not languages times n-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        """counts: for each language the n-grams of the highest order (rows, last character first) and how often each occurs."""
        self.langs, self.order = sorted(counts), order
        #: For each language and order: sorted hashes of the n-grams and their discounted probabilities, then of the contexts and the mass they leave.
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        #: For each language the mean cross-entropy, the variance that any text has about it and that of one character.
        self.spread = np.tile([np.inf, 0.0, 0.0], (len(self.langs), 1))
        for lang in self.langs:
            rows, freq = counts[lang]
            levels = []
            for n in range(1, order + 1):
                own = np.unique(rows[:, : n + 1], axis=0) if n < order else rows  # each different character before counts once
                weight = np.ones(len(own)) if n < order else freq.astype(float)
                short, where = np.unique(own[:, :n], axis=0, return_inverse=True)
                c = np.bincount(where.ravel(), weights=weight)
                ones, twos = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
                h = mixed([short[:, j] for j in range(n)])
                ctx = mixed([short[:, j] for j in range(1, n)]) if n > 1 else np.zeros(len(short), np.uint64)
                u, back = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(back, weights=c), np.bincount(back)
                order_h = np.argsort(h)
                levels.append((h[order_h], ((c - discount) / total[back])[order_h].astype(np.float32), u, (discount * kinds / total).astype(np.float32)))
            self.tables.append(levels)

    @staticmethod
    def _found(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        slot = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where(hashes[slot] == wanted, values[slot], np.float32(default))

    def log_p(self, grams: list[np.ndarray]) -> np.ndarray:
        """Natural log-probabilities of the last characters of n-grams (as from gram_codes), a column per language."""
        p = np.full((len(grams[0]), len(self.langs)), 1.0 / ALPHABET)
        for n in range(1, self.order + 1):
            ctx = mixed(grams[1:n]) if n > 1 else np.zeros(len(grams[0]), np.uint64)
            own = mixed(grams[:n])
            for j, levels in enumerate(self.tables):
                hashes, part, contexts, rest = levels[n - 1]
                p[:, j] = self._found(hashes, part, own, 0.0) + self._found(contexts, rest, ctx, 1.0) * p[:, j]
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters scored, cross-entropy per character for each language) of each text."""
        sym, begins = symbols(texts)
        sizes = np.diff(np.append(begins, len(sym))) - 1
        n_letters = np.add.reduceat((sym != 0).view(np.int8), begins, dtype=np.int64)
        where, different = different_grams(sym, begins, sizes, self.order)
        logs = self.log_p(different)
        sums = np.empty((len(texts), len(self.langs)))
        for j in range(len(self.langs)):
            each = np.ascontiguousarray(logs[:, j])[where]
            each[begins] = 0.0
            sums[:, j] = np.add.reduceat(each, begins)
        return n_letters, -sums / np.maximum(sizes, 1)[:, None]

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """What cross-entropies texts of a language have that the counts don't hold: a mean, and a variance with a part that shrinks with the length."""
        n, entropy = self.entropies(texts)
        for j, lang in enumerate(self.langs):
            own = np.array([x == lang for x in langs]) & (n > 0)
            if own.sum() > 1:
                e, size = entropy[own, j], n[own].astype(float)
                mean = np.average(e, weights=np.minimum(size, 500))
                # of the squared distances, the share that falls as one over the length
                design = np.stack([np.ones(len(e)), 1 / size], axis=1)
                weight = np.sqrt(np.minimum(size, 500))[:, None]
                fixed, falling = np.linalg.lstsq(design * weight, (e - mean) ** 2 * weight[:, 0], rcond=None)[0]
                self.spread[j] = mean, max(fixed, 0.01), max(falling, 1.0)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool, float | None]]:
        """(language, score, rejected, cross-entropy)"""
        if not self.langs:
            return [(UNKNOWN, 0.0, True, None)] * len(texts)
        n, entropy = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        odds = np.exp(-np.minimum(np.maximum(n, 1), 200)[:, None] * (entropy - low[:, None]))
        mean, fixed, falling = self.spread[best].T
        spare = np.where(np.isinf(mean), 1e9, mean - low + DEVIATIONS * np.sqrt(fixed + falling / np.maximum(n, 1)))  # nats below the limit
        score = 1 / odds.sum(axis=1) / (1 + np.exp(-np.clip(SHARP * spare, -500, 500)))
        return [(self.langs[b], float(p), bool(x < 0), float(e)) if k else (UNKNOWN, 0.0, True, None) for k, b, p, e, x in zip(n, best, score, low, spare, strict=True)]


def different_grams(sym: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each symbol the number of its n-gram (the symbols up to it), and of each different n-gram the symbols, the last first.

    Symbols are numbered, then pairs of a numbered n-gram and the symbol before it, so the tables stay near the number of n-grams that occur.
    """
    where, alphabet = _numbered(sym, 0x110000)
    code, s = where, len(alphabet)
    nothing = int(np.searchsorted(alphabet, 0))  # every text begins with a 0
    columns = [alphabet]
    for k in range(1, order):
        before = np.full(len(code), nothing, np.int64)
        before[k:] = code[:-k]
        for j in range(k):
            before[(begins + j)[sizes >= j]] = nothing
        where, kinds = _numbered(where * s + before, len(columns[0]) * s)
        columns = [*(c[kinds // s] for c in columns), alphabet[kinds % s]]
    return where, columns


def _numbered(codes: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each code (below bound) among the different ones, and these in order."""
    if bound > 1 << 23:
        kinds, where = np.unique(codes, return_inverse=True)
        return where, kinds
    there = np.zeros(bound, bool)
    there[codes] = True
    kinds = np.flatnonzero(there)
    number = np.empty(bound, np.int32)
    number[kinds] = np.arange(len(kinds), dtype=np.int32)
    return number[codes].astype(np.int64), kinds


def train(docs: DataFrame, learn, order: int = ORDER, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models from the rows for which the condition `learn` holds and text and language are not null.

    A language's texts are those with the smallest hashes of their ids, `per_language` of them on average (all, if it has fewer): a
    share of the range of hashes is taken that its number of ids sets, so no group of rows has to be brought together.
    Of the chosen texts, every fifth (by the hash) calibrates; the others are counted.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Models({}, order)
    share = F.lit(False)
    for lang, n in sizes.items():
        top = (1 << 63) - 1 if n <= per_language else int(per_language / n * 2.0**64) - (1 << 63)
        share = share | ((F.col("lang") == lang) & (F.col("h") <= F.lit(top)))
    chosen = rows.where(share).groupBy("lang", "h").agg(F.min("text").alias("text"))  # rows repeated with an id count once
    fold = F.pmod(F.xxhash64("h"), F.lit(5))
    counts = count_grams(chosen.where(fold != 0).select("lang", "text"), order).toArrow()  # bounded by the chosen texts
    langs = counts["lang"].combine_chunks().dictionary_encode() if len(counts) else None
    models = Models({}, order)
    if langs is not None:
        grams = np.array(counts["gram"].combine_chunks().flatten()).reshape(-1, order)
        which, n = np.array(langs.indices), np.array(counts["n"])
        models = Models({x: (grams[which == k].astype(np.int64), n[which == k]) for k, x in enumerate(langs.dictionary.to_pylist())}, order)
    held = chosen.where(fold == 0).select("text", "lang").toArrow()
    if len(held) and models.langs:
        models.calibrate(held["text"].to_pylist(), held["lang"].to_pylist())
    return models


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected, cross_entropy (nats per character; null for `und`)."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch, texts in chunks(batches, limit=AT_ONCE):
            lang, score, rejected, entropy = zip(*held.value.predict(texts), strict=True)
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])
            yield as_batch(schema, doc_id=batch.column(0), lang_pred=lang, score=score, rejected=rejected, cross_entropy=entropy)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")


def keep_identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch, texts in chunks(batches, text_col, AT_ONCE):
            yield batch.filter(pa.array([not x[2] for x in held.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
