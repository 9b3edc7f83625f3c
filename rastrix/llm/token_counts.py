"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

A byte-level BPE splits text into pieces with a fixed pattern and merges bytes within a piece. Within a piece, a sequence of
tokens is the encoding exactly when each neighbouring pair is stable (encoding the pair's bytes gives the pair back). So the
last token of every prefix follows from shorter prefixes: of the tokens that end there, exactly one is stable next to the
last token before it. One pass stores the count and the last token at every prefix; truncation and budget questions are then
look-ups. Spark deals out the texts; a task keeps the counts of the pieces it has met in a memo bounded in bytes, which goes at
the end of each partition.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens inside texts count as one token;
repeated rows are counted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, chunks, release

#: The pattern of byte-level BPE pieces; a fixed value of the public vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of memo at most, about, and pairs of tokens whose stability is kept.
MEMO_BYTES, PAIRS = 64 << 20, 250_000
FOREVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """How vocabulary files write bytes: printable ones as themselves, the others as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens at all prefixes with the vocabulary of a tokenizer file (its content as JSON text)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = _byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.tokens = {plain(t) for t in spec["model"]["vocab"] if t not in special}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = map(plain, m.split(" ") if isinstance(m, str) else m)
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b))
        lengths = sorted({len(t) for t in self.tokens}, reverse=True)
        #: Lengths of tokens, the longest first, that fit a prefix of 0, 1, 2, ... bytes; the last entry holds for all longer ones.
        self.fitting = [[n for n in lengths if n <= end] for end in range(lengths[0] + 1)]
        self.pieces = regex.compile(PIECES)
        self.forget()
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}

    def forget(self) -> None:
        self.memo: dict[str | None, int] = {}
        self.memo_bytes = 0

    def lengths(self, end: int) -> list[int]:
        return self.fitting[min(end, len(self.fitting) - 1)]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The symbols that stand at one end of a token while it is built: each with the merges between which it stands there."""
        if (found := self.edges.get((token, side))) is None:
            found, now, until = [], token, FOREVER
            while True:
                born = self.rank[self.parts[now]] if len(now) > 1 else -1
                found.append((now, born, until))
                if len(now) == 1:
                    break
                now, until = self.parts[now][side], born
            self.edges[token, side] = found
        return found

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether no merge crosses from a to b: none is due while both of its symbols stand side by side (equal ranks: the left one first)."""
        if (found := self.pairs.get((a, b))) is None:
            found = True
            for x, born_x, end_x in self._edge(a, 1):
                for y, born_y, end_y in self._edge(b, 0):
                    if born_x < end_y and born_y < end_x and (r := self.rank.get((x, y))) is not None and r < end_x and r <= end_y:
                        found = False
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
                self.edges.clear()
            self.pairs[a, b] = found
        return found

    def states(self, piece: bytes, known: tuple[bytes, list[int], list[bytes]] = (b"", [0], [b""])) -> tuple[list[int], list[bytes]]:
        """For every prefix of one piece, the empty one included: its token count and its last token.

        `known` holds another piece and its states; those of the common prefix are taken over (and the lists are reused).
        """
        before, count, last = known
        start = 0
        for a, b in zip(piece, before):
            if a != b:
                break
            start += 1
        count, last = count[: start + 1], last[: start + 1]
        tokens, stable, fitting, most = self.tokens, self.pairs.get, self.fitting, len(self.fitting) - 1
        for end in range(start + 1, len(piece) + 1):
            for n in fitting[end if end < most else most]:
                t = piece[end - n : end]
                if t in tokens:
                    if n == end:
                        ok = True
                    elif (ok := stable((last[end - n], t))) is None:
                        ok = self.stable(last[end - n], t)
                    if ok:
                        count.append(count[end - n] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return count, last

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, the empty one included."""
        return self.states(piece)[0]

    def piece(self, piece: str) -> int:
        if (n := self.memo.get(piece)) is None:
            n = self.prefixes(piece.encode("utf-8", "replace"))[-1]
        return n

    def spans(self, text: str, sizes: list[int] | None = None) -> list[str | None]:
        """Pieces of a text in order; None stands for a special token. The characters of those are added to `sizes`."""
        if self.special is None or not self.special.search(text):
            return self.pieces.findall(text)
        found: list[str | None] = []
        at = 0
        for m in self.special.finditer(text):
            found += [*self.pieces.findall(text[at : m.start()]), None]
            at = m.end()
            if sizes is not None:
                sizes.append(at - m.start())
        return found + self.pieces.findall(text[at:])

    def learn(self, pieces: set[str | None]) -> None:
        """Counts the pieces that the memo lacks, in sorted order, so that common prefixes are worked out once."""
        new = pieces.difference(self.memo)
        if self.memo_bytes > MEMO_BYTES:
            self.forget()
            new = pieces
        known: tuple[bytes, list[int], list[bytes]] = (b"", [0], [b""])
        for code, p in sorted((p.encode("utf-8", "replace"), p) for p in new if p is not None):
            known = (code, *self.states(code, known))
            self.memo[p] = known[1][-1]
            self.memo_bytes += 150 + len(code)
        self.memo[None] = 1

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [self.spans(t) for t in texts]
        self.learn(set().union(*pieces))
        get = self.memo.__getitem__
        return [sum(map(get, p)) for p in pieces]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def cut(self, text: str, budget: int) -> int:
        """UTF-8 bytes of the longest run of leading whole tokens within the budget."""
        used = at = chars = 0
        sizes: list[int] = []
        spans = self.spans(text, sizes)
        special = iter(sizes)
        for p in spans:
            n = 1 if p is None else self.piece(p)
            before, chars = chars, chars + (len(p) if p is not None else next(special))
            size = len(text[before:chars].encode("utf-8", "replace"))
            if used + n > budget:
                if p is not None and used < budget:
                    at += self.ends(p.encode("utf-8", "replace"))[budget - used]
                return at
            used, at = used + n, at + size
        return at

    def ends(self, piece: bytes) -> list[int]:
        """Byte offsets after 0, 1, 2, ... tokens of a piece, followed back from its end through the stored last tokens."""
        last, at = self.states(piece)[1], len(piece)
        found = [at]
        while at:
            at -= len(last[at])
            found.append(at)
        return found[::-1]


class PrefixTable:
    """The token count at every prefix of one text; positions are characters."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.before = [0], [0]
        for p in counter.spans(text):
            size = len(p) if p is not None else len(counter.special.match(text, self.starts[-1])[0])
            self.starts.append(self.starts[-1] + size)
            self.before.append(self.before[-1] + (1 if p is None else counter.piece(p)))

    def at(self, n: int) -> int:
        """Tokens of text[:n]. Cutting can change the split of the last pieces only: of a run of white space, a contraction or a special string. Those few are looked up anew."""
        import bisect

        k = max(0, bisect.bisect_right(self.starts, n) - 3)
        return self.before[k] + self.counter.count(self.text[self.starts[k] : n])

    @cached_property
    def total(self) -> int:
        return self.before[-1]


#: The last counter's tables stay in the worker, its memo doesn't.
_counters: dict[int, PrefixCounter] = {}


def token_counts(docs: DataFrame, content: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes, n_tokens, over_limit and kept_bytes (the bytes of the leading tokens within the limit) of every text.

    `content` is the tokenizer file's JSON; it is broadcast (a vocabulary of fixed size, 1.6 MB for 50k tokens).
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(content)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = _counters.get(hash(held.value))
        if counter is None:
            _counters.clear()
            counter = _counters[hash(held.value)] = PrefixCounter(held.value)
        for batch, texts in chunks(batches, limit=1 << 20):
            n = counter.counts(texts)
            size = [len(t.encode("utf-8", "replace")) for t in texts]
            kept = [s if k <= limit else counter.cut(t, limit) for t, k, s in zip(texts, n, size, strict=True)]
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("kept_bytes", pa.int64())])
            yield as_batch(schema, doc_id=batch.column(0), n_bytes=size, n_tokens=n, over_limit=[k > limit for k in n], kept_bytes=kept)
        counter.forget()
        release()

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, kept_bytes long")
