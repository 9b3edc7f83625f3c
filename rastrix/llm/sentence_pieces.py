"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text becomes symbols with a leading space mark; words (a run of marks and what follows it) never share a merge, as no piece
holds a mark after another character. The words of a chunk that the memo lacks are laid out in one flat array of symbols. Each
round finds the best pair of every word by a segmented minimum, merges its occurrences from the left, all words at once, and
compacts the arrays; words without a pair leave. Merging all occurrences of the best pair in one round gives the same result as
one at a time where no pair with the merged piece ranks before that piece; of other pairs a round merges the leftmost only.
Words of over LONG symbols (text without spaces) merge, in each round, every pair that ranks before all pairs within `reach`
symbols to its left (or alike, if it leaves no better pair) and before or alike those to its right, where `reach` is the length of the longest piece: no piece can grow
from beyond that to one of its symbols, so nothing comes before it. So a round works on all parts of the word at once, and the
number of rounds doesn't grow with its length.
Symbols outside the vocabulary become byte pieces. Spark deals out the texts; words' ids are kept in a memo bounded in bytes, which
goes at the end of each partition.

Defined results: null and empty texts give the end id alone and decode to an empty text; repeated rows are encoded each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, release

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of text that a task takes up at once.
AT_ONCE = 1 << 20
#: Bytes of memo at most, about.
MEMO_BYTES = 64 << 20
#: Symbols from which a word is merged by neighbourhoods.
LONG = 64
NONE = np.int64(1) << 40


class PieceModel:
    """The tables of a model file (its bytes): symbols, pairs with their ranks, byte pieces and decoded forms."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(content)
        kinds = proto.ModelProto.SentencePiece
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation and normal, byte and control pieces are handled")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.value = {i: b for b, i in self.bytes.items()}
        self.text = {i: p.piece.replace(MARK, " ") for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.names = [str(i) for i in range(len(model.pieces))]
        self.forms = [self.text.get(i, "") for i in range(len(model.pieces))]
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in normal)
        # symbols: pieces first, then single characters that occur in pieces only as parts
        size = len(model.pieces)
        symbols = dict(normal)
        for p in normal:
            for c in p:
                if c not in symbols:
                    symbols[c] = size
                    size += 1
        self.symbols, self.size = symbols, size
        order = {p: k for k, p in enumerate(sorted(normal, key=lambda p: (-model.pieces[normal[p]].score, normal[p])))}
        pairs = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * (size + 1) + b, order[p], i))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        first = np.full(size, NONE)  # the best rank of any pair with a symbol
        for part in (self.keys // (size + 1), self.keys % (size + 1)):
            np.minimum.at(first, part, self.ranks)
        self.calm = first[self.merged] > self.ranks  # whether merging this pair leaves no better pair
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.ranks = np.append(self.ranks, NONE)
        self.merged = np.append(self.merged, -1)
        self.calm = np.append(self.calm, False)
        #: Symbol of each code point of the basic plane and beyond; size: outside the vocabulary.
        self.of_point = np.full(0x110000, size, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_point[ord(s)] = i
        self.reach = max(map(len, normal), default=1)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.memo_bytes = 0

    def _long_rounds(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of one long word after all merges, and the code point at which each begins."""
        sym = self.of_point[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        at = np.arange(len(sym))
        while len(sym) > 1:
            slot = self._slots(sym[:-1], sym[1:], np.ones(len(sym) - 1, bool))
            rank = self.ranks[slot]
            before, after = self._least_near(rank), self._least_near(rank[::-1])[::-1]
            safe = (rank < NONE) & (rank <= before) & (rank <= after)
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))  # of alike neighbours every second one, from the left, where that leaves no better pair
            start = np.repeat(starts, np.diff(np.append(starts, len(rank))))
            run = np.flatnonzero(safe & ((rank < before) | self.calm[slot] & safe[start] & ((np.arange(len(rank)) - start) % 2 == 0)))
            if not len(run):
                break
            sym[run] = self.merged[slot[run]]
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            sym, at = sym[keep], at[keep]
        return sym, at

    def _least_near(self, rank: np.ndarray) -> np.ndarray:
        """The least of the `reach` values before each one."""
        out, width = np.append(NONE, rank[:-1]), 1
        while width < self.reach:  # a window of twice the width is two windows
            step = min(width, self.reach - width)
            out = np.minimum(out, np.append(np.full(min(step, len(out)), NONE), out[:-step]))
            width += step
        return out

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols after all merges, the code point at which each begins, and each one's word, in order."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_point[points].astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        at = np.arange(len(sym))
        slot = np.full(len(sym), len(self.keys) - 1)  # of each symbol's pair with the next one
        slot[:-1] = self._slots(sym[:-1], sym[1:], word[:-1] == word[1:])
        done = []
        while len(sym):
            rank = self.ranks[slot]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            live = best < NONE
            if not live.all():  # words without a pair leave
                done.append((sym[~live], at[~live], word[~live]))
                sym, at, word, slot, rank, best = (x[live] for x in (sym, at, word, slot, rank, best))
                if not len(sym):
                    break
            run = np.flatnonzero(rank == best)
            first = np.append(True, np.diff(run) > 1)  # of neighbouring picks every second one, from the left
            place = np.arange(len(run)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            run = run[(place % 2 == 0) & (self.calm[slot[run]] | np.append(True, np.diff(word[run]) > 0))]
            sym[run] = self.merged[slot[run]]
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            now = run - np.arange(len(run))  # the merged symbols' places after compaction
            sym, at, word, slot = sym[keep], at[keep], word[keep], slot[keep]
            for left in (now[now > 0] - 1, now):
                right = np.minimum(left + 1, len(sym) - 1)
                slot[left] = self._slots(sym[left], sym[right], (word[left] == word[right]) & (right > left))
        sym, at, word = (np.concatenate(x) if x else np.array([], np.int64) for x in zip(*done, strict=True)) if done else (np.array([], np.int64),) * 3
        order = np.argsort(at, kind="stable")
        return sym[order], at[order], word[order]

    def _slots(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> np.ndarray:
        """The table rows of pairs; the last row stands for none."""
        key = np.where(together, left * (self.size + 1) + right, -1)
        slot = np.searchsorted(self.keys, key)
        return np.where(self.keys[slot] == key, slot, len(self.keys) - 1)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.memo)
        if self.memo_bytes > MEMO_BYTES:
            self.forget()
            new = words
        for w in [w for w in new if len(w) > LONG]:
            sym, at = self._long_rounds(w)
            ids = [i for s, a in zip(sym.tolist(), at.tolist(), strict=True) for i in ([s] if s < len(self.names) else self._bytes(w[a]))]
            self._keep(w, ids, self.pieces_text(ids))
        new = sorted(w for w in new if len(w) <= LONG)
        if not new:
            return
        sym, at, word = self._rounds(new)
        bounds = np.searchsorted(word, np.arange(len(new) + 1))
        offsets = np.cumsum([0, *map(len, new)])
        plain = np.logical_and.reduceat(sym < len(self.names), bounds[:-1]).tolist()
        syms, ats, ends = sym.tolist(), at.tolist(), bounds.tolist()
        form = self.forms.__getitem__
        for k, w in enumerate(new):
            ids = syms[ends[k] : ends[k + 1]]
            if plain[k]:
                self._keep(w, ids, "".join(map(form, ids)))
            else:  # characters outside the vocabulary
                ids = [i for s, a in zip(ids, ats[ends[k] : ends[k + 1]], strict=True) for i in ([s] if s < len(self.names) else self._bytes(w[a - offsets[k]]))]
                self._keep(w, ids, self.pieces_text(ids))

    def _keep(self, word: str, ids: list[int], form: str) -> None:
        self.memo[word] = (" ".join(map(self.names.__getitem__, ids)), len(ids), form)
        self.memo_bytes += 300 + 3 * len(word) + 6 * len(ids)

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]

    def pieces_text(self, ids: list[int]) -> str:
        """The text of ids before the leading space goes; bytes that are no UTF-8 become U+FFFD each."""
        found, k = [], 0
        while k < len(ids):
            if ids[k] in self.value:
                end = k
                while end < len(ids) and ids[end] in self.value:
                    end += 1
                found.append(_utf8(bytes(self.value[i] for i in ids[k:end])))
                k = end
                continue
            found.append(" ⁇ " if ids[k] == self.unknown else "" if ids[k] in self.control else self.text[ids[k]])
            k += 1
        return "".join(found)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if self.prefix and ids and ids[0] in self.text and text.startswith(" ") else text

    def words(self, text: str) -> list[str]:
        marked = self.prefix + text.replace(" ", MARK) if text else ""
        return WORDS.findall(marked) if self.words_apart else [marked] * bool(marked)

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Ids with the end id, joined by spaces, their number, and the decoded text."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        out = []
        get = self.memo.__getitem__
        for words in split:
            if not words:
                out.append((str(self.end), 1, ""))
                continue
            ids, n, forms = zip(*map(get, words), strict=True)
            text = "".join(forms)
            out.append((f"{' '.join(ids)} {self.end}", sum(n) + 1, text[1:] if self.prefix and text.startswith(" ") else text))
        return out


def _utf8(data: bytes) -> str:
    found, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                found.append(data[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                pass
        else:
            found.append("�")
            k += 1
    return "".join(found)


#: The last model's tables stay in the worker (20 MB), its memo doesn't.
_models: dict[int, PieceModel] = {}


def encode_pieces(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = True) -> DataFrame:
    """Per row: the id, n_tokens, ids (array), decoded (text), and SHA-256 of both; with_texts=False leaves the two long columns out.

    `content` is the model file's bytes; they are broadcast (a vocabulary of fixed size, 0.5 MB for 32k pieces).
    """
    return _encode(docs, content, id_col, text_col, [], with_texts)


def round_trip(docs: DataFrame, content: bytes, text_col: str = "text") -> DataFrame:
    """The table with each text replaced by its decoded form; null texts stay null."""
    return _encode(docs, content, docs.columns[0], text_col, docs.columns, True)


def _encode(docs: DataFrame, content: bytes, id_col: str, text_col: str, keep: list[str], with_texts: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(content)

    def model() -> PieceModel:
        if (found := _models.get(hash(held.value))) is None:
            _models.clear()
            found = _models[hash(held.value)] = PieceModel(held.value)
        return found

    if keep:
        place = keep.index(text_col)

        def replace(batches):
            for batch, texts in chunks(batches, text_col, AT_ONCE):
                was = batch.column(place).is_null().to_pylist()
                new = [None if gone else x[2] for gone, x in zip(was, model().encode(texts), strict=True)]
                yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            model().forget()
            release()

        return docs.mapInArrow(replace, docs.schema)

    kinds = {"doc_id": docs.schema[id_col].dataType.simpleString(), "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if with_texts else {})

    def run(batches):
        for batch, texts in chunks(batches, limit=AT_ONCE):
            ids, n, decoded = (list(x) for x in zip(*model().encode(texts), strict=True))
            columns = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in decoded]}
            types = {"doc_id": batch.schema.field(0).type, "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            if with_texts:
                columns |= {"ids": [list(map(int, x.split())) for x in ids], "decoded": decoded}
                types |= {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
            yield as_batch(pa.schema(list(types.items())), **columns)
        model().forget()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
