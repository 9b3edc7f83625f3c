"""The conversation trie, the quality classifier and whitening, each against a version by loops and on messy and empty tables."""

import hashlib
import math
import re
from collections import defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrix.llm import prefix_trie, quality, queries, whitening

# conversation trie

TURNS = "conv_id long, turn long, role string, text string, digest string, pos long, words string, id long, part int"


def rebuilt_by_loops(rows):
    """rows (conv_id, turn, role, text): each conversation's turns after rebuilding."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    h = {c: crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def trie_by_loops(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += own
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(key))
        out.append((m[0], len(key), members[key[:-1]][0] if key else None, len(m), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(df, **how):
    turns, _ = prefix_trie.encoded(df)
    nodes, ends = prefix_trie.trie(*prefix_trie.rebuilt(turns), **how)
    return sorted(map(tuple, prefix_trie.with_digests(nodes, ends).collect()), key=str)


def messy_turns():
    rows = [(c, t, "user" if t % 2 else "assistant", f"hi {t} there" if c % 3 else f"x{t} {c % 5}") for c in range(60) for t in range(c % 7)]
    rows += [(100, t, "user", "same again") for t in range(40)] + [(c, t, "user", "same again") for c in (101, 107, 140) for t in range(37)]  # beginnings of one another
    rows += [(200, None, None, None), (200, 3, None, "a\x0bb c  d"), (200, 3, "user", ""), (200, 3, "user", ""), (None, 1, "user", "lost"), (201, 0, "u", "1:ab"), (202, 0, "u1", ":ab"), (203, 5, "", "long " * 30_000)]
    return rows


@pytest.mark.parametrize("how", [{}, {"local": 0}, {"local": 25, "digits": 3}, {"local": 100}])
def test_trie_by_loops(spark, how):
    rows = messy_turns()
    df = spark.createDataFrame([(*r, "d", 1, "w", 2, 3) for r in rows], TURNS).repartition(5)
    assert found_trie(df, **how) == trie_by_loops(rebuilt_by_loops(rows))


def test_trie_of_a_conversation_over_many_ranges(spark):
    rows = [(7, t, "user", f"t{t % 11}") for t in range(3000)] + [(c, 0, "user", "t0") for c in range(20, 26)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        turns, _ = prefix_trie.encoded(spark.createDataFrame([(*r, "d", 1, "w", 2, 3) for r in rows], TURNS))
        assert [r["pos"] for r in turns.where("conv = 7").orderBy("pos").collect()] == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_few_or_no_turns(spark):
    no = spark.createDataFrame([], TURNS)
    assert found_trie(no) == []
    for rows in ([(5, 0, "user", "one")], [(20, 0, "u", "a b"), (23, 0, "u", "a b")], [(None, 0, "u", "x")]):
        assert found_trie(spark.createDataFrame([(*r, "d", 1, "w", 2, 3) for r in rows], TURNS)) == trie_by_loops(rebuilt_by_loops(rows))


def test_trie_query_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    truth = trie_by_loops(rebuilt_by_loops(rows))
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, sf_dir).collect()), key=str) == truth
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert sorted(db.execute(prefix_trie.ORACLE_SQL).fetchall(), key=str) == truth


def test_quicksort_of_one_bucket():
    rng = np.random.default_rng(3)
    members = [(int(c), rng.integers(0, 3, rng.integers(1, 7)).tolist()) for c in rng.permutation(200)]
    nodes, ends = prefix_trie.finish([(c, ids, [2] * len(ids)) for c, ids in members])
    beginnings = {tuple(ids[:d]) for _, ids in members for d in range(1, len(ids) + 1)}
    assert len(nodes) == len(beginnings) and len(ends) == len(members)
    assert sum(n[3] for n in nodes) == sum(len(ids) for _, ids in members)
    assert sum(n[5] for n in nodes if n[2] < 0) == sum(not any(b[: len(a)] == a for b in beginnings if len(b) == len(a) + 1) for a in beginnings)


# quality


def test_features_one_by_one():
    text = "Ab cd.\nAb x!! QQ $$ 12\n\nAb cd."
    found = dict(zip(quality.FEATURES, quality.features(["", text, "é  "])[1], strict=True))
    words, n = text.split(), len(text)
    assert found["log_words"] == pytest.approx(math.log1p(len(words))) and found["word_length"] == pytest.approx(sum(map(len, words)) / len(words))
    assert found["upper"] == pytest.approx(5 / n) and found["digits"] == pytest.approx(2 / n) and found["symbols"] == pytest.approx(2 / n) and found["points"] == pytest.approx(4 / n)
    assert found["caps_words"] == pytest.approx(1 / len(words)) and found["odd_endings"] == pytest.approx(2 / len(words))
    assert found["distinct_words"] == pytest.approx(6 / len(words)) and found["distinct_lines"] == pytest.approx(2 / 3) and found["lines_ended"] == pytest.approx(2 / 3)
    assert found["longest_word"] == pytest.approx(math.log1p(3)) and found["entropy"] == pytest.approx(-sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)))
    whole = ["", text, "é  ", "a" * 50_000 + " b"]
    assert np.allclose(quality.features(whole), np.concatenate([quality.features([t]) for t in whole]))


def test_trees_against_enumeration():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=9), rng.random(9) + 0.5
    value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 9), key=lambda c: value(0, c) + value(c, 9))
    step = quality.stumps(g, h, 2, 0.0)
    assert np.allclose(step[:cut], g[:cut].sum() / (h[:cut].sum() + 1)) and np.allclose(step[cut:], g[cut:].sum() / (h[cut:].sum() + 1))
    g2, h2 = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.5
    gains = {}
    for i in range(1, 4):
        for j in range(1, 5):
            gains[i, j] = sum(g2[r, c].sum() ** 2 / (h2[r, c].sum() + 1) for r in (slice(i), slice(i, None)) for c in (slice(j), slice(j, None))) - g2.sum() ** 2 / (h2.sum() + 1)
    gain, table = quality.cross(g2, h2, 0.0)
    i, j = max(gains, key=gains.get)
    assert gain == pytest.approx(gains[i, j]) and np.allclose(table[:i, j:], g2[:i, j:].sum() / (h2[:i, j:].sum() + 1))


def test_interaction_is_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x, y, np.ones(3000))
    assert model.pairs[0] == (0, 1) and ((model.logits(x) > 0) == y).mean() > 0.95
    fine, coarse = model.binned(x[:5])
    by_hand = [model.offset + sum(t[fine[k, f]] for f, t in enumerate(model.tables)) + sum(t[coarse[k, i], coarse[k, j]] for (i, j), t in zip(model.pairs, model.pair_tables)) for k in range(5)]
    assert np.allclose(model.logits(x[:5]), by_hand)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and quality is not null").groupBy("quality", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in got}
    assert n[1, 1] >= 0.99 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.95 * (n[0, 0] + n.get((0, 1), 0))


def test_quality_on_messy_and_empty_tables(spark, messy, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 0), (6, 1), (9, 0), (None, 1), (7, 5), (8, None)], "doc_id long, quality int")
    model = quality.train(messy, labels, F.lit(True))
    got = quality.quality(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[3] == by[4] and by[1] == by[2]
    assert quality.quality(no_docs, model).count() == 0
    assert quality.train(no_docs, labels, F.lit(True)).scores(["a"]) == [pytest.approx(3 / 5)]
    assert quality.train(messy, labels.where("quality = 1"), F.lit(True)).scores([""]) == [1.0]
    assert quality.train(messy, labels.limit(0), F.lit(True)).scores([""]) == [0.5]


# whitening

VECTORS = "vec_id long, embedding array<double>, x long, id string, row int"


def whitened_by_loops(table, components=4):
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in table}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * a - b for a, b in zip(r, s)] for r in fit], dtype=float) / n
    v = sum(np.outer(r, r) for r in away) / n
    values, vectors = np.linalg.eigh(v)
    return {(i, k): (n, sum((n * a - b) ** 2 for a, b in zip(r, s)), float(np.dot([(n * a - b) / n for a, b in zip(r, s)], vectors[:, -k])) / values[-k] ** 0.5, values[-k] / np.trace(v)) for i, r in x.items() for k in range(1, min(components, len(s)) + 1)}


def same_whitening(got, truth):
    assert {(r["vec_id"], r["component"]) for r in got} == truth.keys() and len(got) == len(truth)
    signs = {}
    for r in got:
        n, deviation, white, explained = truth[r["vec_id"], r["component"]]
        sign = signs.setdefault(r["component"], math.copysign(1, white * r["whitened"])) if abs(white) > 1e-6 else signs.get(r["component"], 1)
        assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, deviation, deviation)
        assert r["whitened"] * sign == pytest.approx(white, abs=1e-7) and r["explained"] == pytest.approx(explained, rel=1e-7) and r["identity_error"] < 1e-6


def test_whitening_by_loops(spark, sf_dir):
    truth = whitened_by_loops([tuple(r)[:2] for r in queries.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()])
    same_whitening(queries.op13_whitening(spark, sf_dir).collect(), truth)


def test_whitening_with_copies_and_messy_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.normal(size=5) * [4, 3, 2, 1, 0.5] + 100).tolist()) for k in range(80)]
    good += [(k, good[3][1]) for k in range(100, 160)] + [((1 << 60) + 1, [-0.001, 0.0, -0.0, 1e-300, 7.0])]
    bad = [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, [math.nan] * 5), (504, [math.inf, 1.0, 1.0, 1.0, 1.0]), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "i", 2) for r in good + bad], VECTORS).repartition(6)
    same_whitening(whitening.whiten(df).collect(), whitened_by_loops(good))


def test_whitening_without_variance_and_beyond_longs(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "i", 2) for r in rows], VECTORS)
    assert whitening.whiten(make([])).collect() == []
    one = whitening.whiten(make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in one)
    big = whitening.whiten(make([(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0])])).collect()
    assert all(r["deviation"] is None and int(r["deviation_exact"]) > 1 << 63 for r in big if r["vec_id"] < 3) and {r["whitened"] for r in big if r["component"] == 2} == {None}
    assert sorted(round(r["whitened"], 6) for r in big if r["component"] == 1) == pytest.approx([-1.224745, 0, 1.224745], abs=1e-5)
