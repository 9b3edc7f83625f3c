"""Groups of near copies against brute force over exact sets of five-word shingles."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from rastrix.llm import near_copies
from rastrix.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def first_of_groups(texts):
    """The smallest id of each component of the links at 0.8 or more, and the number of links between different texts."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in combinations(sorted(texts), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            links += texts[a] != texts[b]
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i for i in texts if top(i) == i}, links


def edited(rng, words, places):
    words = list(words)
    for p in rng.choice(len(words), places, replace=False):
        words[p] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = {}
    for k in range(60):  # pairs around 0.8, from 0.6 to 0.95
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        out[2 * k], out[2 * k + 1] = " ".join(words), edited(rng, words, 2 + k % 11)
    chain = [f"c{k}" for k in range(400)]  # each near the next only
    out |= {200 + k: " ".join(chain[12 * k : 12 * k + 200]) for k in range(12)}
    star = [f"s{k}" for k in range(200)]  # one group around a text
    out |= {300 + k: edited(rng, star, 3) for k in range(40)} | {399: " ".join(star)}
    short = ["one", "two", "One", "a b c d e", "a b c d f", "a b c d e f", "b c d e f", "", "  \n", None]
    return out | {400 + k: t for k, t in enumerate(short)}


def test_groups_equal_brute_force(spark, texts):
    truth, links = first_of_groups(texts)
    assert links > 60
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == truth


def test_stage_on_documents(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    truth, _ = first_of_groups({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()} == truth


def test_messy(messy, no_docs):
    kept = near_copies.keep_one(messy)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == messy.columns and sorted(ids, key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert near_copies.keep_one(no_docs).count() == 0


def test_pairs_judged_are_not_judged_again(spark, monkeypatch):
    """Two texts that share bands and are no copies have been held against each other: neither goes to the blocks."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, edited(rng, words, 10))]  # a similarity of about 0.7
    asked = []
    inner = near_copies.joining
    monkeypatch.setattr(near_copies, "joining", lambda own, *rest: asked.append(own.count()) or inner(own, *rest))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert near_copies.keep_one(docs).count() == 40
    assert asked == [0]


def test_candidates_come_from_simhash(spark):
    """Texts whose fingerprints differ in at most 3 bits meet by the fingerprint's blocks, whatever their MinHash bands are."""
    rng = np.random.default_rng(7)
    texts = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        texts += [(2 * k, str(2 * k), " ".join(words)), (2 * k + 1, str(2 * k + 1), edited(rng, words, 1 + k % 5))]
    fps = {i: fingerprint(t, near_copies.WIDTH) for i, _, t in texts}
    minima = {i: set(near_copies.band_values(near_copies.shingle_set(near_copies.split(t)))) for i, _, t in texts}
    found = near_copies.sketches(spark.createDataFrame(texts, "key long, id string, text string"), near_copies.WIDTH).collect()
    blocks = {r["key"]: set(r["bands"]) - minima[r["key"]] for r in found}
    near = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert len(near) > 5 and any(fps[a] != fps[b] for a, b in near)
    assert all(blocks[a] & blocks[b] for a, b in near)


def test_fingerprints_of_three_bits_share_blocks():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        fp = int(rng.integers(0, 1 << 63)) << 1 | 1
        other = fp
        for bit in rng.choice(64, 3, replace=False).tolist():
            other ^= 1 << bit
        assert set(near_copies.block_values(fp)) & set(near_copies.block_values(other))


def test_fingerprints_within_three_bits_are_links(spark):
    """Texts mostly made of one repeated passage: fingerprints within 3 bits, sets of shingles less than 0.8 alike. Such links were dropped."""
    rng = np.random.default_rng(9)
    texts = {}
    for k in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 30)] * 40
        texts |= {2 * k + side: " ".join([*words, *(f"own{x}" for x in rng.integers(0, 1 << 40, 12))]) for side in (0, 1)}
    near = [k for k in range(6) if (fingerprint(texts[2 * k], near_copies.WIDTH) ^ fingerprint(texts[2 * k + 1], near_copies.WIDTH)).bit_count() <= 3]
    assert near and all(jaccard(shingles(texts[2 * k]), shingles(texts[2 * k + 1])) < 0.8 for k in near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()} == set(texts) - {2 * k + 1 for k in near}
