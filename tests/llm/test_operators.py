"""Each operator against a brute-force version, and on messy and empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rastrix.llm import decontamination, language_id, line_dedup, lm_scoring, nearest, queries, sentence_pieces, simhash, substring_dedup, token_counts, toxicity
from rastrix.llm.components import components
from rastrix.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_file


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}


# nearest neighbours


def true_nearest(table, k=5):
    good = [(i, np.array(v, float)) for i, v in table if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))), i) for i, x in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest_recall(spark, sf_dir):
    found = defaultdict(list)
    for r in queries.op1_nearest(spark, sf_dir).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    truth = true_nearest([tuple(r)[:2] for r in queries.table(spark, sf_dir, "embeddings").collect()])
    assert found.keys() == truth.keys()
    hits = 0
    for q, best in truth.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, len(best) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:]))
        hits += len({i for i, _ in best} & {i for _, i, _ in got})
    assert hits >= 0.9 * sum(map(len, truth.values()))


def test_nearest_messy(spark):
    v = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, -0.0])]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("vec", F.lit("x"))
    found = sorted(tuple(r) for r in nearest.nearest(table, F.col("vec_id") % 50 == 0).collect())
    near = lambda q, others: [(q, k + 1, i, s) for k, (i, s) in enumerate(others)]
    assert found == near(0, [(2, 1.0), (3, 1.0), (50, 1.0), (8, 0.0), (10, -1.0)]) + near(50, [(0, 1.0), (2, 1.0), (3, 1.0), (8, 0.0), (10, -1.0)])
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_extremes(spark):
    v = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [0.1, 1.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 2.0]), (50, [1.0, 1.0])]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    assert len(found) == 10 and found[0, 4] == 1.0
    assert found[0, 1] == pytest.approx(1 / math.sqrt(1.01), rel=1e-12) and found[0, 2] == pytest.approx(0.1 / math.sqrt(1.01), rel=1e-12)
    assert found[50, 3] in (pytest.approx(1.0, rel=1e-12), pytest.approx(3 / math.sqrt(10), rel=1e-12))


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_nearest_recall_where_lists_are_pruned(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(30_000, 64))
    if kind == "clustered":
        x = rng.normal(size=(300, 64))[rng.integers(0, 300, len(x))] + 0.3 * x
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": flat})).repartition(8)
    found = defaultdict(set)
    for r in nearest.nearest(table, F.col("vec_id") % 50 == 0, list_size=25).collect():  # 1200 lists
        found[r["query_id"]].add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, len(x), 50)] = -2
    truth = np.argpartition(-near, 5, axis=1)[:, :5]
    recall = sum(len(found[50 * k] & set(t.tolist())) for k, t in enumerate(truth)) / truth.size
    print(kind, recall)
    assert recall >= 0.93


def test_nearest_fills_up(spark):
    rng = np.random.default_rng(13)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    found = Counter(r["query_id"] for r in nearest.nearest(table, F.col("vec_id") % 50 == 0, list_size=2, probes=1).collect())
    assert found == {k: 5 for k in range(0, 600, 50)}


def test_graph_and_lists():
    x = np.random.default_rng(0).normal(size=(3000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centroids = nearest.balanced_centroids(x, 10)
    assert 300 <= len(centroids) <= 1500
    graph = nearest.CentroidGraph(centroids)
    found, _ = graph.search(x[:200])
    true = np.argsort(-(x[:200] @ centroids.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) for f, t in zip(found.tolist(), true.tolist())]) > 9
    assert {len(c) for c in nearest.lists_of_vector(graph, x[:500])} > {1}


# benchmark decontamination


@pytest.mark.parametrize("n", range(5, 17))
def test_masks_leave_no_window_out(n):
    masks = next(m for least, m in decontamination.TIERS if n >= least)
    for gone in combinations(range(n), n - math.ceil(0.8 * n)):
        assert any(all(p + k not in gone for k, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)), gone


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_overlaps_by_all_alignments(spark, small):
    rng = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(300)]
    items = [list(rng.choice(vocab, n)) for n in (*range(3, 22), 40) for _ in range(2)]
    docs = []
    for k in range(300):
        own = list(rng.choice(vocab, int(rng.integers(0, 30))))
        if k % 3:
            item = list(items[k % len(items)])
            for j in rng.choice(len(item), min(len(item), int(rng.integers(0, 5))), replace=False):
                item[j] = "other"
            own[len(own) // 2 : len(own) // 2] = item[: len(item) - int(rng.integers(0, 3))]
        docs.append(own)
    truth = set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            if len(item) < 5:
                continue
            width = min(16, len(item))
            for shift in range(-len(item), len(words) + 1):
                equal = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
                if max(sum(equal[k : k + width]) for k in range(len(item) - width + 1)) / width >= 0.8:
                    truth.add((d, i))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, bench, small=small).collect()}
    assert found == truth and {len(items[i]) for _, i in truth} > {5, 8, 9, 10, 15, 16}


def test_overlaps_with_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    some = lambda n, *gone: " ".join(["x", "y"] + ["z" if k in gone else w for k, w in enumerate(item[:n])] + ["tail"])
    docs = [(1, some(18)), (2, some(18, 2, 7, 12)), (3, some(18, 1, 3, 5, 7, 9, 11, 13)), (4, some(8)), (5, None), (6, ""), (7, some(18).upper()), (7, some(18).upper()), (None, some(18))]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("item", F.lit("?"))
    bench = spark.createDataFrame([(1, " ".join(item) + "."), (2, None), (3, "short x tail y"), (4, " ".join(item[:9]))], "item_id long, text string").withColumn("words", F.lit(0))
    found = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["similarity"]) for r in decontamination.contaminated(table, bench).collect()}
    assert found == {(i, 1): (18, 1.0) for i in (1, 7, None)} | {(2, 1): (15, 0.8125), (1, 4): (9, 1.0), (4, 4): (8, 0.888889), (7, 4): (9, 1.0), (None, 4): (9, 1.0)} | ({(2, 4): (7, round(7 / 9, 6))} if 7 / 9 >= 0.8 else {})
    clean = decontamination.without_benchmark(table, bench)
    assert clean.columns == table.columns and sorted(r[0] for r in clean.collect()) == [3, 5, 6]
    assert decontamination.contaminated(table.limit(0), bench).count() == decontamination.contaminated(table, bench.limit(0)).count() == 0


# line dedup


def test_recurring_lines(spark):
    license = "Released under version {} of the license"
    docs = [(i, f"own line number {'abcdefghijklmnop'[i]} is here\n{license.format(i)}\nshort one") for i in range(12)]
    docs += [(100 + i, "a copied text of six words\nwith two lines of five words") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (None, license.format(77)), (203, license.format("x"))]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("place", F.lit(3))
    kept = line_dedup.drop_recurring_lines(table)
    assert kept.columns == table.columns and kept.count() == table.count()
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert found[0] == docs[0][1] and found[200] is None and found[201] == "" and found[202] == "\n\n" and found[None] == "" and found[100] == docs[12][1]
    # "own line number <x> is here" recurs as well, with the letter as the variable field
    assert all(found[i] == "short one" for i in range(1, 12))
    assert found[203] == ""
    report = {r["doc_id"]: r for r in line_dedup.line_report(table).collect()}
    assert (report[1]["n_lines"], report[1]["n_dropped"], report[1]["kept_sha256"]) == (3, 2, hashlib.sha256(b"short one").hexdigest())
    assert (report[200]["n_lines"], report[201]["n_lines"]) == (0, 1)
    assert line_dedup.line_report(table.limit(0)).count() == 0


# language identification


def test_language_id(spark, sf_dir, texts):
    found = rows(queries.op4_language_id(spark, sf_dir))
    lang = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf_dir, "documents").collect()}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in texts if crc32(str(i).encode()) % 4 == 2} and len(found) == len(texts)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_id_messy(spark, messy, no_docs):
    models = language_id.train(messy, F.lit(True))
    found = {r["doc_id"]: r for r in language_id.identify(messy, models).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"] for i in (3, 4, 5, 9))
    assert found[1]["lang_pred"] == "en" and language_id.identify(messy, models).count() == messy.count()
    assert {r["lang_pred"] for r in language_id.identify(messy, language_id.train(no_docs, F.lit(True))).collect()} == {"und"}
    assert language_id.keep_identified(messy, models).columns == messy.columns
    assert language_id.identify(no_docs, models).count() == 0


def kneser_ney(counts, order, text):
    """The log-probability of each character of a text, by dictionaries and the formulas as they are written."""

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 1 / language_id.ALPHABET
        if n == order:
            c = dict(counts)
        else:
            longer = {g[-(n + 1) :] for g in counts}
            c = Counter(g[1:] for g in longer)
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        total = sum(v for g, v in c.items() if g[:-1] == gram[:-1])
        if not total:
            return prob(gram[1:])
        kinds = sum(g[:-1] == gram[:-1] for g in c)
        return max(c.get(gram, 0) - d, 0) / total + d * kinds / total * prob(gram[1:])

    padded = "\0" * (order - 1) + text
    return [math.log(prob(padded[k : k + order])) for k in range(len(text))]


def test_kneser_ney_by_dictionaries():
    rng = np.random.default_rng(2)
    texts = {x: ["".join(rng.choice(list(letters), 60)) for _ in range(4)] for x, letters in (("x", "abcd"), ("y", "cdef"))}
    counts = {}
    for x, own in texts.items():
        padded = [f"\0\0\0{t}\0" for t in own]
        counts[x] = Counter(t[k : k + 4] for t in padded for k in range(len(t) - 3))
    arrays = {x: (np.array([[ord(c) for c in reversed(g)] for g in c]), np.array(list(c.values()))) for x, c in counts.items()}
    models = language_id.Models(arrays, 4)
    asked = ["abcabd", "fedcab", "aq", "cdcdcdcd"]
    n, found = models.entropies(asked)
    for t, size, row in zip(asked, n, found):
        assert size == len(t)
        for j, x in enumerate("xy"):
            assert row[j] * (len(t) + 1) == pytest.approx(-sum(kneser_ney(counts[x], 4, f"{t}\0")), rel=1e-4)


def test_language_id_rejects(spark, sf_dir):
    models = language_id.train(queries.table(spark, sf_dir, "documents"), F.lit(True))
    bad = ["Это обычный русский текст о погоде и природе, ничего больше.", "これは日本語の文章です。今日は天気がいいですね。", "qxzj vvkw zzqp xkcd jjqq wvxz qqqz xjwk zkvv qpzx", "12345 !!", ""]
    good = ["Then the anin of theon erly and in it therer", "the"]
    table = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(table, models).collect()}
    assert [found[k]["rejected"] for k in range(7)] == [True] * 5 + [False] * 2
    assert all(found[k]["score"] < 0.01 for k in range(5)) and found[5]["score"] > 0.9
    assert sorted(r["doc_id"] for r in language_id.keep_identified(table, models).collect()) == [5, 6]


def test_kneser_ney_sums_to_one():
    grams = np.array([[ord(c) for c in g] for g in ("bca", "cba", "abc", "aab")])
    m = language_id.Models({"x": (grams, np.array([3, 1, 1, 2]))}, 3)
    total = sum(math.exp(m.log_p([np.array([c]), np.array([ord("c")]), np.array([ord("a")])])[0, 0]) for c in range(1, language_id.ALPHABET + 1))
    assert abs(total - 1) < 0.01


# substring dedup


def removed(texts, length, least):
    codes = [(t or "").encode() for t in texts]
    seen = {size: Counter(c[k : k + size] for c in codes for k in range(len(c) - size + 1)) for size in (length, least)}
    out = []
    for c in codes:
        gone, shared = np.zeros(len(c), bool), np.zeros(len(c), bool)
        for size, flags in ((length, gone), (least, shared)):
            for k in range(len(c) - size + 1):
                if seen[size][c[k : k + size]] > 1:
                    flags[k : k + size] = True
        kept = bytes(np.frombuffer(c, np.uint8)[~gone])
        out.append((len(c), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(shared.sum())))
    return out


SPANS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]


@pytest.mark.parametrize("length,least,gram,hot", [(40, 40, 10, 20_000), (40, 25, 10, 3), (40, 30, 20, 20_000)])
def test_substring_dedup(spark, length, least, gram, hot):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé "), n))
    parts = [word(n) for n in (30, 45, 60, 90, 200)]
    docs = ["".join(parts[j] if rng.random() < 0.5 else word(int(rng.integers(0, 60))) for j in rng.integers(0, 5, 6)) for _ in range(60)]
    docs += ["a" * 200, "ab" * 90, None, "", docs[0], docs[0], word(39), word(40)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("gram", F.lit(1))
    found = {r["doc_id"]: tuple(r[c] for c in SPANS) for r in substring_dedup.remove_repeats(table, length, least, gram, hot, with_texts=False).collect()}
    assert [found[k] for k in range(len(docs))] == removed(docs, length, least)


def test_substring_dedup_documents(spark, sf_dir, texts):
    found = {r["doc_id"]: tuple(r[c] for c in SPANS) for r in substring_dedup.remove_repeats(queries.table(spark, sf_dir, "documents"), least=280, with_texts=False).collect()}
    assert [found[k] for k in texts] == removed(texts.values(), 400, 280)
    found = {r["doc_id"]: tuple(r[c] for c in SPANS) for r in queries.op5_substring_dedup(spark, sf_dir).collect()}
    assert [found[k] for k in texts] == removed(texts.values(), 400, 400)


def test_substring_dedup_passages(spark, tmp_path):
    """Passages of over 50 words that take less than 400 bytes stay, and are told of."""
    passage = " ".join(f"w{k:04d}" for k in range(51))
    own = lambda n: " ".join(f"{n}o{k:04d}" for k in range(90))
    docs = [passage, f"{own(1)} {passage}", f"{passage} {own(2)} {passage}", own(3), f"{own(4)} {passage[:270]}", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert [found[k]["n_removed"] for k in range(6)] == [0] * 6
    assert [found[k]["n_repeated_280"] for k in range(6)] == [r[-1] for r in removed(docs, 400, 280)]
    assert [found[k]["n_repeated_280"] > 0 for k in range(6)] == [True] * 3 + [False] * 3


@pytest.mark.parametrize("length,least,gram,hot", [(40, 40, 10, 20_000), (40, 25, 10, 3), (60, 30, 12, 20_000)])
def test_substring_dedup_periods(spark, length, least, gram, hot):
    """Stretches with a period, of all lengths about those that repeat themselves, at all phases, next to each other and to other text."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    units = ["a", "ab", "the ", "aab", "Is onhe. ", "aba", word(12), word(14), word(17), word(25)]
    stretch = lambda: (units[rng.integers(len(units))] * 90)[(k := int(rng.integers(0, 12))) : k + int(rng.integers(20, 95))]
    docs = ["".join(stretch() if rng.random() < 0.6 else word(int(rng.integers(0, 50))) for _ in range(int(rng.integers(1, 6)))) for _ in range(150)]
    docs += [(u * 90)[k : k + n] for u in units for k, n in ((0, length - 1), (1, length), (2, length + len(u) - 1), (0, length + len(u)), (3, 2 * length))]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r["doc_id"]: tuple(r[c] for c in SPANS) for r in substring_dedup.remove_repeats(table, length, least, gram, hot, with_texts=False).collect()}
    assert [found[k] for k in range(len(docs))] == removed(docs, length, least)
    # a stretch has a few anchors, however long it is
    codes = np.frombuffer((word(200) + "the " * 500 + word(200)).encode(), np.uint8)
    (_, at, *_), runs = substring_dedup.anchors(codes, np.array([0]), np.array([len(codes)]), length, least, gram)
    assert len(runs) == 1 and runs[0][2] - runs[0][1] >= 2000 and ((at > 200) & (at < 2200)).sum() <= 8


def test_substring_dedup_rows_of_one_id(spark):
    a, b = "x".join(map(str, range(300))), "y".join(map(str, range(300, 600)))
    table = spark.createDataFrame([(1, a), (1, b), (2, b + "z"), (3, "q" * 5000)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(table).collect())
    assert found == [(1, 0), (1, len(b)), (2, len(b)), (3, 5000)]


def test_substring_dedup_messy(messy, no_docs):
    found = rows(substring_dedup.remove_repeats(messy, with_texts=False))
    assert len(found) == messy.count() and {r["n_bytes"] for r in found if r["doc_id"] in (3, 4)} == {0}
    assert substring_dedup.remove_repeats(no_docs).count() == 0


# token counts


def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(tokenizer_file(BYTE_BPE)))


def test_token_counts(spark, sf_dir, texts, messy, no_docs):
    lib = byte_bpe()
    for r in queries.op6_token_counts(spark, sf_dir).collect():
        n = len(lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 512)
    content = tokenizer_file(BYTE_BPE).read_text(encoding="utf-8")
    for a, b in zip(rows(token_counts.token_counts(messy, content)), messy.collect(), strict=True):
        assert a["n_tokens"] == len(lib.encode(b["text"] or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(no_docs, content).count() == 0


def test_prefix_table():
    lib, counter = byte_bpe(), token_counts.PrefixCounter(tokenizer_file(BYTE_BPE).read_text(encoding="utf-8"))
    text = "  It's the d'edou 1234,  ...\n\n\t <|endoftext|> wasn't été   "
    table = token_counts.PrefixTable(counter, text)
    for n in range(len(text) + 1):
        assert table.at(n) == len(lib.encode(text[:n], add_special_tokens=False).ids), text[:n]


# language model scoring


def test_lm_scoring(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    split = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for i, t in texts.items()}
    train = [i for i in texts if crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in [*split[i], None])
    n, v = sum(counts.values()), len(counts)
    for i, words in split.items():
        r, every = found[i], [*words, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in set(train), len(every), sum(counts[w] > 0 for w in every), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in every), rel=1e-9)
    assert all(r["score"] < 0 for r in found.values())


def test_lm_beats_the_base(spark):
    found = [r for r in queries.op7_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    score, base = sum(r["score"] for r in found), sum(r["base_score"] for r in found)
    # the base gives all unknown words one share however many there could be; a model that spells them has to make up for that
    assert score > 0.98 * base
    assert np.mean([r["score"] > r["base_score"] for r in found]) > 0.6
    size = sum(-r["score"] / math.log10(2) / r["bits_per_byte"] for r in found)
    assert -score / math.log10(2) / size < 2.15


def naive_lm(texts, learn, mixer, classes):
    """log10 probabilities of texts by loops over words, bits and contexts, with given weights and classes."""
    mask = (1 << 64) - 1

    def units(text):
        words = lm_scoring.words_of(text)
        kind = classes.of(Counter(words))
        return [kind + w + b" " for w in words] + [kind + b"\n"]

    def hashed(history, node):
        where = []
        for n, (look, size) in enumerate(lm_scoring.CONTEXTS):
            h = ((history & look) + n + 1) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            where.append((n, ((h + node) * 0xBF58476D1CE4E5B9 & mask) >> (64 - size)))
        return where

    def walk(unit):
        """(place, bit, history, node) after the class."""
        history = unit[0] << 48 | 0x20
        for k in range(1, len(unit)):
            for b in range(8):
                yield k, b, unit[k] >> (7 - b) & 1, history, (unit[k] | 256) >> (8 - b)
            history = unit[0] << 48 | (history << 8 | unit[k]) & (1 << 48) - 1

    fit, every = Counter(), Counter()
    for t, role in zip(texts, learn):
        for u in units(t):
            fit[u] += role == 1
            every[u] += role > 0
    tables = defaultdict(lambda: [0, 0])
    for u, n in fit.items():
        for _, _, bit, history, node in walk(u):
            for at in hashed(history, node):
                tables[at][bit] += n
    ends = {c: sum(n for u, n in every.items() if u == c + b"\n") for c in {u[:1] for u in every}}
    out = []
    for t in texts:
        own = units(t)
        total = math.log10((ends[own[0][:1]] + 0.5) / (sum(ends.values()) + 0.5 * len(ends)))
        for u in own:
            for k, b, bit, history, node in walk(u):
                x, level = [], 0
                for n, at in hashed(history, node):
                    odds, levels = lm_scoring.quantised(*map(np.array, tables[n, at]))
                    x.append(float(odds) / 12)
                    level = int(levels) if n == lm_scoring.LONGEST else level
                known = 0
                if k <= lm_scoring.PREFIX:
                    like = [(v, n) for v, n in every.items() if len(v) > k and v[:k] == u[:k] and (v[k] | 256) >> (8 - b) == node]
                    zero, one = (sum(n for v, n in like if (v[k] >> (7 - b) & 1) == d) for d in (0, 1))
                    x.append(math.log((one + 0.3) / (zero + 0.3)))
                    known = 2 * sum(zero + one >= e for e in (1, 2, 5, 31)) + (not zero or not one)
                else:
                    x.append(0.0)
                x.append(0.3)
                row = b * lm_scoring.KNOWN + known
                dot = min(8, max(-8, sum(p * q for p, q in zip(x, mixer.weights[row * lm_scoring.LEVELS + level]))))
                at = (dot + 8) * 2
                low = min(int(at), lm_scoring.STEPS - 2)
                fine = mixer.refine[row, low] * (1 - at + low) + mixer.refine[row, low + 1] * (at - low)
                p = min(1 - 1e-5, max(1e-5, (1 / (1 + math.exp(-dot)) + fine) / 2))
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_lm_scores_by_loops(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 9)))) for _ in range(30)] + ["x" * 90]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 12)))) for _ in range(30)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {}
    for name in ("learnt", "text_classes"):
        real = getattr(lm_scoring, name)
        monkeypatch.setattr(lm_scoring, name, lambda *a, real=real, name=name: kept.setdefault(name, real(*a)))
    monkeypatch.setattr(lm_scoring, "PART_WORDS", 20)  # several parts, so that prefixes go on in others
    found = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(table, F.col("doc_id") % 5 != 0, common=5).collect()}
    roles = {r[0]: r[1] for r in table.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).when(F.pmod(F.xxhash64("text"), F.lit(8)) == 0, 2).otherwise(1)).collect()}
    truth = naive_lm(texts, [roles[k] for k in range(30)], kept["learnt"], kept["text_classes"])
    assert [found[k] for k in range(30)] == pytest.approx(truth, rel=1e-6)


def test_lm_scoring_messy(messy, no_docs):
    found = rows(lm_scoring.score_texts(messy, F.col("doc_id").isNull() | (F.col("doc_id") != 2)))
    assert len(found) == messy.count() and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 10)}) == 1
    nothing = rows(lm_scoring.score_texts(messy, F.lit(False)))
    assert {r["train_tokens"] for r in nothing} == {0} and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in nothing)
    assert lm_scoring.score_texts(no_docs, F.lit(True)).count() == 0


# sentence pieces


def test_sentence_pieces(spark, sf_dir, texts, messy, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file(PIECE_BPE)))

    def truth(text):
        ids = lib.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    for r in queries.op8_sentence_pieces(spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == truth(texts[r["doc_id"]])
    content = tokenizer_file(PIECE_BPE).read_bytes()
    for a, b in zip(rows(sentence_pieces.encode_pieces(messy, content)), messy.collect(), strict=True):
        assert (a["n_tokens"], a["ids_sha256"], a["decoded_sha256"]) == truth(b["text"])
    assert sentence_pieces.encode_pieces(no_docs, content).count() == 0
    assert sentence_pieces.round_trip(messy, content).columns == messy.columns


def test_sentence_pieces_without_spaces():
    import time

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=str(tokenizer_file(PIECE_BPE)))
    model = sentence_pieces.PieceModel(tokenizer_file(PIECE_BPE).read_bytes())
    rng = np.random.default_rng(4)
    vocab = [lib.id_to_piece(i).strip("▁") for i in range(300, 32_000)]
    texts = ["".join(rng.choice(list(a), int(rng.integers(65, 300)))) for a in ("abcdefghijklmnopqrstuvwxyz", "aet", "a", "é日aa") for _ in range(60)]
    texts += ["".join(rng.choice(vocab, 60)) for _ in range(60)]
    for t, (ids, n, decoded) in zip(texts, model.encode(texts)):
        truth = lib.encode(t, add_eos=True)
        assert (ids, n, decoded) == (" ".join(map(str, truth)), len(truth), lib.decode(truth)), t
    seconds = []
    for n in (40_000, 160_000):
        text = "".join(rng.choice(list("etaoinshr"), n))
        began = time.process_time()
        ids = model.encode([text])[0][0]
        seconds.append(time.process_time() - began)
        assert ids == " ".join(map(str, lib.encode(text, add_eos=True)))
    assert seconds[1] < 12 * seconds[0] + 1  # four times the text


# simhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([words[k : k + 3] for k in range(len(words) - 2)] if len(words) > 3 else [words])]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints, most=3):
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= most:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in prints}


def test_simhash(spark, sf_dir, texts):
    found = {r["doc_id"]: r for r in queries.op9_simhash(spark, sf_dir).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == classes(prints)


@pytest.mark.parametrize("most", [0, 2, 3, 5])
def test_similar_fingerprints(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(1 << 63), 1 << 63, 40)
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 7, 300)]
    fps = sorted({int(np.int64(np.uint64(np.int64(rng.choice(base))) ^ np.uint64(f))) for f in flips} | {0, -1, 1, 7, 15})
    found = sorted(tuple(r) for r in simhash.similar_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), most).collect())
    assert found == [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most]


def test_simhash_messy(messy, no_docs):
    found = rows(simhash.near_duplicates(messy))
    assert len(found) == messy.count()
    assert {r["component_id"] for r in found if r["doc_id"] in (3, 4, 5)} == {3} and {r["component_id"] for r in found if r["doc_id"] in (1, 2, 10)} == {1}
    kept = simhash.keep_one(messy)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == messy.columns and len(ids) == len(set(ids)) and {1, 3, 6, None} <= set(ids) and not {2, 4, 5, 10} & set(ids)
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 90)] + [(200, 150), (150, 170)] + [(300, k) for k in range(301, 330)] + [(5, 5)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    truth = {k: 0 for k in range(1, 91)} | {170: 150, 200: 150} | {k: 300 for k in range(301, 330)}
    assert {k: v for k, v in found.items() if k != v} == truth


# toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es"], k)) for k in rng.integers(1, 5, 300)]
    bad = ["dumbo", "crapface", "zonkhead"]

    def text(insults):
        words = list(rng.choice(plain, int(rng.integers(10, 60))))
        for w in insults:
            words.insert(int(rng.integers(0, len(words))), w)
        return " ".join(words)

    toxic = rng.random(900) < 0.3
    docs = [(i, text([str(rng.choice(bad))] if t else [])) for i, t in enumerate(toxic)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = {r["doc_id"]: r for r in toxicity.toxicity(table, model).collect()}
    assert np.mean([found[i]["predicted"] == t for i, t in enumerate(toxic)]) > 0.97
    tricks = [(1, "there d u m b o on"), (2, "there du.mbo on"), (3, "there crapxface on"), (4, "there zonk-head on"), (5, ""), (6, None), (7, "there on"), (8, "...")]
    extra = spark.createDataFrame(tricks, "doc_id long, text string").withColumn("score", F.lit("?"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(extra, model).collect()}
    assert all(got[i] >= 0.5 for i in (1, 2, 3, 4)) and all(got[i] < 0.5 for i in (5, 6, 7, 8))
    assert toxicity.toxicity(extra.limit(0), model).count() == 0
    one_class = toxicity.train(table, labels.where("toxic = 0"), F.lit(True))
    assert {r["score"] for r in toxicity.toxicity(extra, one_class).collect()} == {0.0}


def kernel(a, b):
    """The subsequence kernel of two words as it is written: all subsequences of four characters, by their spans."""

    def weights(word):
        marked, found = f"\1{word}\2", Counter()
        for at in combinations(range(len(marked)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                found["".join(marked[k] for k in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
        return found

    x, y = weights(a), weights(b)
    return sum(x[k] * y[k] for k in x) / toxicity.size(len(a) + 2) / toxicity.size(len(b) + 2)


def test_string_kernel_by_enumeration():
    words = ["idiot", "idioxt", "iddiot", "hello", "the", "a", "dumbo", "theidiots", "été", "aaaaaa"]
    basis = toxicity.Landmarks(words)
    found = basis.kernel(words)
    assert np.allclose(found, [[kernel(a, b) for b in words] for a in words], atol=2e-3)  # hashed slots may meet
    model = toxicity.ToxicModel()
    model.fit(["idiot", "dumbo"], ["hello", "the", "a", "theatre"], words)
    values, vectors = np.linalg.eigh(found)
    keep = values > 1e-4
    x = np.array([[kernel(a, b) for b in words] for a in words]) @ vectors[:, keep] / np.sqrt(values[keep])
    assert np.allclose(x @ x.T, found, atol=1e-2)  # the Nyström map gives the kernel back on the landmarks
    decisions = dict(zip(words, model.decisions(words)))
    assert min(decisions[w] for w in ("idiot", "idioxt", "iddiot", "dumbo")) > 0 > max(decisions[w] for w in ("hello", "the", "a"))


def test_toxicity_messy(spark, sf_dir, messy, no_docs):
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.train(messy, labels, F.lit(True))
    assert toxicity.toxicity(messy, model).count() == messy.count()
    share = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]  # no texts of either class
    scores = {r["score"] for r in toxicity.toxicity(messy, toxicity.train(no_docs, labels, F.lit(True))).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(share)
    assert {r["score"] for r in toxicity.toxicity(messy, toxicity.train(messy, labels.limit(0), F.lit(True))).collect()} == {0.0}
