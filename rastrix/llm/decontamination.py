"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks look at some of a few neighbouring words and ignore the others. The masked words of every place of every benchmark
item are hashed once; a document's places are hashed alike and joined with them. Each hit names a diagonal (an item laid over a
document at an offset), which is verified: of some `window` neighbouring words of the item (all, if it has fewer), a share of
at least `similarity` must be equal. Items have masks by their length (TIERS); together those of a tier hit every window with as
many substituted words as a similarity of 0.8 allows (3 of 16; 1 of 9, 2 of 10 to 14, 3 of 15; 1 of 5 to 8), so none is missed
from there on. A lower `similarity` may miss some.

Words are runs of letters and digits, lower-cased. As all masks begin and end with a word they look at, a bit map of the
words of a tier's items leaves most places out before they are hashed. The hashes of a benchmark of up to `small` places are broadcast
(24 MB at most by default); a larger one is joined by a shuffle. Documents are hashed in one pass that shuffles nothing; only hits are,
and they are few: a diagonal of a row counts once, however many seeds it has.

Defined results: null and empty texts have no hit, and items of fewer than LEAST_WORDS words neither (they are no evidence); repeated
rows are judged alike; a document in which several items occur has a row for each; other columns are ignored; an empty table on either
side gives no hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, free_name, row_key, written

#: From so many words of an item on, these masks; those of a tier have one span. Found by trying sets of masks.
TIERS = ((16, ("100110111", "111100011", "100101111", "111010101")), (9, ("111001", "110101")), (5, ("1101", "1011")))
LEAST_WORDS = TIERS[-1][0]
WINDOW, SIMILARITY = 16, 0.8
#: Seeds of a benchmark that are broadcast at most.
SMALL = 1_000_000
#: Bits of the map of the words that a tier's items have.
BITS = 1 << 17
APART = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.split(F.lower(text), APART)


def word_bits(items: DataFrame) -> Column:
    """A bit map of BITS bits, as a constant array of longs, of the hashes of all words of the items; its size is fixed."""
    h = items.select(F.explode("words").alias("w")).select(F.xxhash64("w").bitwiseAND(BITS - 1).alias("h"))
    each = h.groupBy(F.shiftright("h", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()
    found = {r["slot"]: r["bits"] for r in each}
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(BITS >> 6))), ",").cast("array<long>")


def _held(bits: Column) -> Column:
    return F.transform("h", lambda w: F.getbit(F.get(bits, F.shiftright(w.bitwiseAND(BITS - 1), 6).cast("int")), w.bitwiseAND(63).cast("int")))


def _both_held(places: Column, held: str, span: int) -> Column:
    return F.filter(places, lambda p: (F.get(held, p) == 1) & (F.get(held, p + span - 1) == 1))


def seeds(docs: DataFrame, tiers: list[tuple[tuple[str, ...], Column | None]]) -> DataFrame:
    """The rows of docs (with an array column `words`) exploded to (place, seed), a row for each mask and place; `words` goes.

    tiers: masks of one span, with the bit map from word_bits of places whose first or last word no item has: no mask can hit there.
    """
    rest = [c for c in docs.columns if c != "words"]
    found = docs.select(*rest, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    looks = []
    for n, (masks, bits) in enumerate(tiers):
        span = len(masks[0])
        places = F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span)).otherwise(F.array().cast("array<int>"))
        if bits is not None:
            found = found.withColumn(f"held{n}", _held(bits))
            places = _both_held(places, f"held{n}", span)
        looks.append((f"places{n}", places, masks))
    found = found.select(*rest, "h", *[places.alias(name) for name, places, _ in looks])

    def look(name: str, mask: str) -> Column:
        return F.transform(name, lambda p: F.struct(p.alias("place"), F.xxhash64(F.lit(mask), *[F.get("h", p + k) for k, c in enumerate(mask) if c == "1"]).alias("seed")))

    return found.select(*rest, F.explode(F.flatten(F.array(*[look(name, m) for name, _, masks in looks for m in masks]))).alias("s")).select(*rest, "s.place", "s.seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, item_id, n_matched, similarity): of every row and item with a verified overlap the most words equal on a diagonal and the best window's share."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.filter(words(F.coalesce(F.col(item_text).cast("string"), F.lit(""))), lambda w: w != "").alias("words"))
    items = items.withColumn("tier", F.coalesce(*[F.when(F.size("words") >= least, k) for k, (least, _) in enumerate(TIERS)])).where("tier is not null")
    items = written(items.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "words")), "items")
    there = sorted(r[0] for r in items.select("tier").distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row_key(id_col, text_col).alias("key"))
    # without any item one tier still gives the columns
    tiers = [(k, TIERS[k][1], items.where(F.col("tier") == k)) for k in there or [0]]
    index = reduce(DataFrame.union, [seeds(own.select("item", "words").distinct(), [(masks, None)]) for _, masks, own in tiers])
    index = written(index.withColumnRenamed("place", "item_place"), "seeds")
    if index.count() <= small:
        index = F.broadcast(index)
    hits = seeds(rows.select("key", words(F.col("text")).alias("words")), [(masks, word_bits(own)) for _, masks, own in tiers]).join(index, "seed")
    hits = written(hits.select("key", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "hits")
    # items go to the hits, and only texts with a hit are shuffled, once
    asked = hits.join(items.select("item", "item_id", F.col("words").alias("own")), "item").drop("item")
    laid = KeyFilter(hits, "key", "hits").split(rows, "key")[0].join(asked, "key").select("key", "doc_id", "item_id", "own", "shift", words(F.col("text")).alias("words"))
    before = F.greatest(-F.col("shift"), F.lit(0))  # words of the item that lie before the text
    under = F.concat(F.array_repeat(F.lit(""), before), F.slice("words", F.greatest("shift", F.lit(0)) + 1, F.greatest(F.size("own") - before, F.lit(0))))
    equal = F.zip_with("own", under, lambda a, b: F.when(a == b, 1).otherwise(0))
    laid = laid.select("key", "doc_id", "item_id", equal.alias("equal"), F.least(F.lit(window), F.size("own")).alias("width"))
    share = F.array_max(F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("width")), lambda k: F.aggregate(F.slice("equal", k + 1, F.col("width")), F.lit(0), lambda a, b: a + b)))
    laid = laid.select("key", "doc_id", "item_id", F.aggregate("equal", F.lit(0), lambda a, b: a + b).alias("n"), (share / F.col("width")).alias("share")).where(F.col("share") >= similarity)
    return laid.groupBy("key", "doc_id", "item_id").agg(F.max("n").cast("long").alias("n_matched"), F.max("share").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_matched and similarity of every document and benchmark item that overlap."""
    found = overlaps(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.round(F.max("similarity"), 6).alias("similarity"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that overlap no benchmark item, with all their columns."""
    key = free_name(docs, "key")
    found = written(overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("key").alias(key)).distinct(), "overlaps")
    maybe, clean = KeyFilter(found, key, "overlaps").split(docs.withColumn(key, row_key(id_col, text_col)), key)
    return clean.unionByName(maybe.join(found, key, "left_anti")).select(docs.columns)


#: In DuckDB's SQL without masks: by the pigeonhole principle each overlap has 4 equal words in a row (3 for items of 6 to 15 words, 2 for 5), whose diagonals are verified.
ORACLE_SQL = f"""
WITH items AS (SELECT item_id, w, CASE WHEN len(w) >= 16 THEN 4 WHEN len(w) >= 6 THEN 3 ELSE 2 END AS g FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= {LEAST_WORDS}),
docs AS (SELECT DISTINCT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') AS w FROM documents),
item_places AS (SELECT item_id, g, w, unnest(range(0, len(w) - g + 1)) AS p FROM items),
item_grams AS (SELECT item_id, g, p, w[p + 1:p + g] AS gram FROM item_places),
sizes AS (SELECT DISTINCT g FROM items),
doc_places AS (SELECT doc_id, g, w, unnest(range(0, len(w) - g + 1)) AS p FROM docs, sizes),
doc_grams AS (SELECT doc_id, g, p, w[p + 1:p + g] AS gram FROM doc_places),
hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.p - i.p AS shift FROM doc_grams d JOIN item_grams i ON d.g = i.g AND d.gram = i.gram),
laid AS (SELECT h.doc_id, h.item_id, least({WINDOW}, len(i.w)) AS width, list_transform(range(0, len(i.w)), lambda k: CASE WHEN k + shift >= 0 AND i.w[k + 1] = d.w[k + shift + 1] THEN 1 ELSE 0 END) AS eq
  FROM hits h JOIN items i ON i.item_id = h.item_id JOIN docs d ON d.doc_id = h.doc_id),
scored AS (SELECT doc_id, item_id, list_sum(eq) AS n, list_max(list_transform(range(0, len(eq) - width + 1), lambda k: list_sum(eq[k + 1:k + width]))) / width AS share FROM laid)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_matched, round(max(share), 6) AS similarity FROM scored WHERE share >= {SIMILARITY} GROUP BY doc_id, item_id
"""
