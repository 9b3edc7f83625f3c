"""The pipeline's stages one by one, and the SQL of the two operators that have it."""

import os

import duckdb

import corpus_pipeline
from rastrix.llm import queries


def canonical(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=str)


def test_oracles(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        truth = db.execute(sql)
        assert canonical(df.columns, df.collect()) == canonical([c[0] for c in truth.description], truth.fetchall()), name


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    before = {r["doc_id"] for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = corpus_pipeline.written(after, "test")
        kept.append({r["doc_id"] for r in docs.collect()})
    assert before >= kept[0] == kept[1] > kept[2] > kept[3]
    assert len(kept[0]) > 0.9 * len(before)
    assert not {r["doc_id"] for r in queries.decontamination.contaminated(docs, queries.table(spark, sf_dir, "benchmark")).collect()}
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == kept[3]
    assert sorted(r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r["ids_sha256"] for r in last.collect())


def test_stages_on_messy_tables(spark, sf_dir, messy, no_docs):
    for docs in (messy, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            assert found.count() <= docs.count()


def test_queries_are_all_there():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14)) and os.path.exists(corpus_pipeline.__file__)
