"""Line deduplication by a log-template tree, in DataFrame operations only.

A line's words (between white space) lead it down a tree of fixed depth: the number of words first, then its first `leading`
words, words with a digit standing for any. Leaves that lines of fewer than `min_docs` different texts reach hold nothing that
recurs and end there. In the others, a word stays in the template if at least `min_docs` occurrences in the leaf agree on it
at its place, and becomes a variable field if not; a line whose template keeps less than `share` of its words is too far from
the others and is its own template. A template of lines in `min_docs` different texts or more recurs: its lines go from all
documents but the one of the smallest id, so no wording is lost from the corpus. Lines of fewer than `min_words` words stay.
drop_recurring_lines also takes out lines of over `long_words` words that stand word for word in `long_docs` different texts or more,
from all but the text (and its exact copies) of the smallest id; the query's report (and its SQL) has the templates alone.
The tree doesn't depend on the order of lines, as online parsers' trees do.

Exact copies of a text count once, so that a group of copies doesn't make its own lines recur. Lines travel
as hashes; a second reading brings the words of each different line whose leaf a broadcast bit map (of fixed size) holds. Texts
aren't shuffled but those that lose lines: a like map of their keys leaves all others where they are. Counts are combined before
each shuffle, and joins are merge joins at every size.

Defined results: null texts stay null and empty ones empty; if all lines of a text go, an empty text stays; lines end at a line feed, and what
is left is joined by line feeds; repeated rows get equal results; the other columns pass unchanged; an empty table gives an
empty result; where all ids of a template's texts are null, its lines go from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, free_name, row_key, written

MIN_DOCS, LEADING, SHARE, MIN_WORDS = 10, 3, 0.75, 5
LONG_WORDS, LONG_DOCS = 50, 2
FIELD = "<*>"
BLANK = "[ \t\r\u000b\u000c]+"


def masked(text: Column) -> Column:
    """The text with words that hold a digit as variable fields."""
    blank = " \t\r\n\u000b\u000c"
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, f"(?<![^{blank}])[^{blank}0-9]*+[0-9][^{blank}]*+", FIELD)).otherwise(text)


def line_words(line: Column) -> Column:
    return F.filter(F.split(line, BLANK), lambda w: w != "")


def split_lines(docs: DataFrame, leading: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, copy, place, words, leaf, line) of every line of `min_words` words or more."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.xxhash64(text).alias("copy"), F.transform(F.split(masked(text), "\n"), lambda x: line_words(x)).alias("lines"))
    lines = rows.select("doc_id", "key", "copy", F.posexplode("lines").alias("place", "words")).where(F.size("words") >= min_words)
    return lines.select("*", F.xxhash64(F.size("words"), F.slice("words", 1, leading)).alias("leaf"), F.xxhash64("words").alias("line"))


def recurring_lines(docs: DataFrame, min_docs: int, leading: int, share: float, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, place) of the lines that go: the row's key and the line's number from 0."""
    split = split_lines(docs, leading, min_words, id_col, text_col)
    lines = written(split.drop("words"), "lines")
    leaves = lines.groupBy("leaf", "copy").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("copies")).where(F.col("copies") >= min_docs).select("leaf")
    leaves = written(leaves, "leaves")
    held = KeyFilter(leaves, "leaf", "leaf")
    live = written(held.split(lines, "leaf")[0].join(leaves.hint("merge"), "leaf", "left_semi"), "live")
    times = live.groupBy("leaf", "line", "copy").agg(F.min("doc_id").alias("first"))
    # the words of each different line come from a second reading, of lines whose leaf is in the map
    parsed = held.split(split.select("leaf", "line", "words"), "leaf")[0].groupBy("leaf", "line").agg(F.first("words").alias("words"))
    kinds = written(times.groupBy("leaf", "line").agg(F.count("*").alias("copies")).hint("merge").join(parsed, ["leaf", "line"]), "kinds")
    tokens = kinds.select("leaf", "line", "copies", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    agreed = tokens.groupBy("leaf", "at", "word").agg(F.sum("copies").alias("support")).where(F.col("support") >= min_docs).select("leaf", "at", "word")
    kept = tokens.join(agreed.hint("merge"), ["leaf", "at", "word"]).where(F.col("word") != FIELD).groupBy("leaf", "line", "n").agg(F.count("*").alias("same"), F.xxhash64(F.array_sort(F.collect_list(F.struct("at", "word")))).alias("shape"))
    templates = kept.where(F.col("same") >= F.col("n") * share).select("leaf", "line", F.xxhash64("leaf", "shape").alias("shape"))
    named = times.join(templates.hint("merge"), ["leaf", "line"], "left").select("line", "copy", "first", F.coalesce("shape", F.xxhash64(F.lit("line"), "line")).alias("template"))
    named = written(named, "templates")
    often = named.groupBy("template", "copy").agg(F.min("first").alias("first")).groupBy("template").agg(F.count("*").alias("copies"), F.min("first").alias("first")).where(F.col("copies") >= min_docs)
    goes = named.select("line", "template").distinct().join(often.select("template", "first").hint("merge"), "template").select("line", "first")
    return live.join(goes.hint("merge"), "line").where(F.coalesce(F.col("doc_id") != F.col("first"), F.lit(True))).select("key", "place")


def long_lines(docs: DataFrame, gone: DataFrame, long_words: int, long_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(key, place) of the lines of over `long_words` words that stand word for word in `long_docs` different texts or more, but for those of one text: that of the smallest id, then key.

    Lines that are `gone` (key, place) don't count, and texts are as those leave them; exact copies stay exact copies.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n")).alias("place", "raw"))
    lines = rows.where(F.length("raw") > 2 * long_words).withColumn("words", line_words(F.col("raw"))).where(F.size("words") > long_words)
    lines = written(lines.select("doc_id", "key", "copy", "place", F.xxhash64("words").alias("line")), "long")
    took = gone.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("took"))
    lines = lines.join(took, "key", "left").withColumn("took", F.coalesce("took", F.array().cast("array<int>"))).where(~F.array_contains("took", F.col("place")))
    lines = lines.select("doc_id", "key", "place", "line", F.xxhash64("copy", "took").alias("copy"))
    often = lines.select("line", "copy").distinct().groupBy("line").agg(F.count("*").alias("copies")).where(F.col("copies") >= long_docs).select("line")
    live = written(lines.join(often, "line", "left_semi"), "long-live")
    first = live.groupBy("line").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copy")).alias("first"))
    return live.join(first, "line").where(F.col("copy") != F.col("first.copy")).select("key", "place")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, share: float = SHARE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, long_docs: int = LONG_DOCS) -> DataFrame:
    """The table with the recurring lines and the repeated long ones taken out of its texts; all rows and columns stay."""
    gone = written(recurring_lines(docs, min_docs, leading, share, min_words, id_col, text_col), "recurring")
    return _without(docs, gone.union(long_lines(docs, gone, long_words, long_docs, id_col, text_col)), id_col, text_col)[0].select(docs.columns)


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with the lines taken out of the text, and the names of added columns: the lines, and the numbers of those that went. Rows that the map of the keys lacks stay where they are; the others meet their lines by a join."""
    key, places, lines = (free_name(docs, x) for x in ("key", "gone", "lines"))
    gone = written(gone.groupBy(F.col("key").alias(key)).agg(F.collect_set("place").alias(places)), "gone")
    maybe, whole = KeyFilter(gone, key, "gone").split(docs.withColumn(key, row_key(id_col, text_col)), key)
    joined = maybe.join(gone.hint("merge"), key, "left").drop(key)
    joined = joined.unionByName(whole.drop(key).withColumn(places, F.lit(None).cast("array<int>"))).withColumn(lines, F.split(F.col(text_col).cast("string"), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return joined.withColumn(text_col, F.when(F.col(places).isNotNull(), left).otherwise(F.col(text_col))), lines, places


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, share: float = SHARE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text that stays) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, lines, places = _without(rows, recurring_lines(rows, min_docs, leading, share, min_words, "doc_id", "text"), "doc_id", "text")
    return found.select(
        "doc_id",
        F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


_B = "[ \\t\\r\\x0b\\x0c]+"
#: The same in DuckDB's SQL, on the words themselves instead of their hashes.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
every AS (SELECT row, doc_id, text AS copy, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs WHERE text IS NOT NULL),
split AS (SELECT row, doc_id, copy, place, list_filter(regexp_split_to_array(regexp_replace(raw, '[^ \\t\\r\\x0b\\x0c]*[0-9][^ \\t\\r\\x0b\\x0c]*', '{FIELD}', 'g'), '{_B}'), lambda x: x <> '') AS w FROM every),
lines AS (SELECT *, [CAST(len(w) AS VARCHAR)] || w[1:{LEADING}] AS leaf FROM split WHERE len(w) >= {MIN_WORDS}),
leaves AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT copy) >= {MIN_DOCS}),
live AS (SELECT * FROM lines WHERE leaf IN (SELECT leaf FROM leaves)),
kinds AS (SELECT leaf, w, count(DISTINCT copy) AS copies FROM live GROUP BY leaf, w),
tokens AS (SELECT leaf, w, copies, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM kinds),
agreed AS (SELECT leaf, pos, word FROM tokens GROUP BY leaf, pos, word HAVING sum(copies) >= {MIN_DOCS}),
kept AS (SELECT t.leaf, t.w, count(*) AS same, list(struct_pack(p := t.pos, x := t.word) ORDER BY t.pos) AS shape FROM tokens t JOIN agreed a ON t.leaf = a.leaf AND t.pos = a.pos AND t.word = a.word WHERE t.word <> '{FIELD}' GROUP BY t.leaf, t.w),
named AS (SELECT l.*, CASE WHEN k.same >= len(l.w) * {SHARE} THEN CAST(k.shape AS VARCHAR) ELSE 'line' || CAST(l.w AS VARCHAR) END AS template FROM live l LEFT JOIN kept k ON l.leaf = k.leaf AND l.w = k.w),
often AS (SELECT leaf, template, min(doc_id) AS first FROM named GROUP BY leaf, template HAVING count(DISTINCT copy) >= {MIN_DOCS}),
gone AS (SELECT n.row, n.place FROM named n JOIN often o ON n.leaf = o.leaf AND n.template = o.template WHERE n.doc_id <> o.first OR n.doc_id IS NULL OR o.first IS NULL),
left_over AS (SELECT e.row, string_agg(e.raw, chr(10) ORDER BY e.place) AS kept FROM every e ANTI JOIN gone g ON e.row = g.row AND e.place = g.place GROUP BY e.row),
n AS (SELECT row, count(*) AS n FROM every GROUP BY row), g AS (SELECT row, count(*) AS n FROM gone GROUP BY row)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_dropped, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN n USING (row) LEFT JOIN g USING (row) LEFT JOIN left_over l USING (row)
"""
