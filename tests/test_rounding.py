"""Values halfway between two roundings."""

from pyspark.sql import functions as F

from rastrix import queries
from rastrix.operators import image


def test_halves_round_as_in_sql(spark):
    """0.142812499999... prints as 0.1428125 less a bit: multiplied it is a half, and DuckDB rounds it by that."""
    import duckdb

    values = [k / 64 / 255 * (j / 64) * 1.2 for k in range(300, 420, 7) for j in range(1, 200, 3)] + [0.0, -0.0000005, -2.5]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    assert [r["value"] for r in queries.halves(df).collect()] == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_texture_of_a_tie(spark):
    """Contrast and energy are whole sums divided once: a sum of shares misses the last bit, by the order of rows."""
    gaps = [(0, 1, 5), (1, 3, 7), (2, 2, 11), (5, 4, 13), (3, 9, 12)]
    rows = [("a", 2 * k, y, float(a), n) for k, (a, b, n) in enumerate(gaps) for y in range(n)] + [("a", 2 * k + 1, y, float(b), n) for k, (a, b, n) in enumerate(gaps) for y in range(n)]
    cells = spark.createDataFrame([(b, 3 * (x // 2) + x % 2, y, v) for b, x, y, v, _ in rows], "band string, px int, py int, value double")
    r = image.texture(cells.orderBy(F.rand(3))).first()
    n = sum(g[2] for g in gaps)
    assert r["energy"] == sum(g[2] ** 2 for g in gaps) / n**2
    assert r["contrast"] == sum(g[2] * (g[0] - g[1]) ** 2 for g in gaps) / n
    assert abs(r["homogeneity"] - sum(g[2] / (1 + (g[0] - g[1]) ** 2) for g in gaps) / n) < 1e-12
