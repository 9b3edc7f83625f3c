"""Long lines that stand word for word in few texts, in the pipeline's stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rastrix.llm import line_dedup


def passage(name, n):
    return " ".join(f"{name}{k if k % 7 == 0 else chr(97 + k % 26)}" for k in range(n))


@pytest.mark.parametrize("times", [2, 3, 9])
def test_passages(spark, times):
    long, fifty, short = passage("long", 60), passage("fifty", 50), "a short line of words stays"
    docs = [(10 + i, f"own text of number {chr(97 + i)}\n{long.replace(' ', '  ', i)}\n{fifty}\n{short}") for i in range(times)]
    docs += [(50, docs[0][1]), (60, f"{passage('alone', 80)}\n{passage('alone', 80)}"), (70, None), (71, ""), (72, long + " other")]
    other = passage("nameless", 55)
    docs += [(None, f"{other}\nx"), (None, f"{other}\ny")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = [tuple(r) for r in corpus_pipeline.without_recurring_lines(spark, table, "").collect()]
    left = {i: t for i, t in found if i is not None}
    assert len(found) == len(docs) and left[10] == docs[0][1]
    for i in range(1, times):
        assert left[10 + i] == f"own text of number {chr(97 + i)}\n{fifty}\n{short}"
    assert left[50] == docs[0][1]  # an exact copy stays one
    assert left[60] == docs[times + 1][1] and left[70] is None and left[71] == "" and left[72] == long + " other"
    nameless = sorted(t for i, t in found if i is None)
    assert len(nameless) == 2 and sum(other in t for t in nameless) == 1
    # the query's report has the templates alone, as its SQL
    assert line_dedup.line_report(table.where("doc_id is not null")).agg(F.sum("n_dropped")).first()[0] == 0
