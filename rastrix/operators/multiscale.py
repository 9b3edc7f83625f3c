"""Multiscale geographically weighted regression by backfitting.

Each column has a bandwidth of its own. The model is a sum of one term for each column (x times a local coefficient); in turn, each term is fitted
anew to what the others leave: a smoothing of that partial residual over what lies within the column's bandwidth. Rows of a place share their coefficients, so
a place's sums of products are all that a smoothing needs; it is one pass over near places. A column's bandwidth is the one of the
candidates with the least leave-one-out error, chosen in each round until one comes up again; all candidates are summed up in one pass.

Rounds go on until the terms no longer change. Plain rounds may take hundreds for that (305 on 100 suppliers), so once the bandwidths stand, each round begins with the
combination of the last rounds' results whose changes cancel best (Anderson's acceleration): a round's fixed points are the same, and few rounds reach one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import reach
from ..functions.stored import stored
from .regression import linear
from .spatial import Dealt, dealt, kernel_sums

#: Rounds whose results are combined.
PAST = 6


def multiscale_regression(rows: DataFrame, y: str, columns: list[str], widths: list[float], kind: str = "bisquare", rounds: int = 10_000, tolerance: float = 1e-8) -> tuple[DataFrame, dict[str, float]]:
    """(id, beta: the intercept's and columns' local coefficients, yhat, residual) of rows (id, x, y, columns), and each term's bandwidth; `widths` are the candidates. Terms start from the
    global fit; rounds end when all terms change by no more than the share `tolerance` (root of the sum of squares), or after `rounds`. Rows with a null value take no part in a fit; without a place they have coefficients of zero."""
    base = rows.select("id", "x", "y", F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns, 1)], F.col(y).cast("double").alias("_y"))
    terms = range(len(columns) + 1)
    beta = {r["term"]: r["coefficient"] for r in linear(rows, y, columns).collect()}
    whole = base.where(" and ".join(f"{c} is not null" for c in ("x", "y", "_y", *[f"_x{k}" for k in terms])))
    x, b, product = [F.col(f"_x{k}") for k in terms], [F.col(f"b{k}") for k in terms], lambda p, q: F.col(f"s{min(p, q)}_{max(p, q)}")
    sums = [F.sum(x[p] * x[q]).alias(f"s{p}_{q}") for p in terms for q in terms if p <= q] + [F.sum(x[p] * F.col("_y")).alias(f"t{p}") for p in terms]
    places = stored(base.where("x is not null and y is not null").select("x", "y").distinct().join(whole.groupBy("x", "y").agg(*sums), ["x", "y"], "left").na.fill(0.0), "places")
    state = places.select("*", *[F.lit(float(v)).alias(f"b{k}") for k, v in enumerate(beta.values())], F.array().cast("array<struct<now:array<double>,change:array<double>>>").alias("past"))
    deals: dict[float, Dealt] = {}

    def smoothed(held: DataFrame, over: list[float], apart: bool = False) -> DataFrame:
        far = max(over)
        if far not in deals:
            deals[far] = dealt(places, places, reach(far, kind))
        return kernel_sums(places, held, ["u", "v"], over, kind, apart=apart, deal=deals[far])

    def left_out(k: int, held: DataFrame) -> list[float]:
        """The error of each width where each row is left out of its own fit: its share goes from the sums of its place, which weigh 1. A width at which a row has no other to go by has none."""
        around = smoothed(held, widths, apart=True)
        own = whole.join(state.select("x", "y", *[f"b{m}" for m in terms]), ["x", "y"]).withColumn("p", F.col("_y") - sum((x[m] * b[m] for m in terms if m != k), F.lit(0.0)))
        tried = own.join(held, ["x", "y"]).join(around, ["x", "y"], "left")
        rest = lambda c, n, share: F.coalesce(f"{c}{n}", F.lit(0.0)) + (F.col(c) - x[k] * share)
        missed = [F.sum((F.col("p") - x[k] * F.try_divide(rest("u", n, F.col("p")), rest("v", n, x[k]))) ** 2).alias(f"m{n}") for n in range(len(widths))]
        score = tried.agg(*missed, *[F.count_if(rest("v", n, x[k]) == 0).alias(f"l{n}") for n in range(len(widths))]).first()
        return [float("inf") if score[f"l{n}"] or score[f"m{n}"] is None else score[f"m{n}"] for n in range(len(widths))]

    seen: list[list[float]] = [[] for _ in terms]
    chosen, settled, past, last = [widths[0]] * len(seen), [len(widths) == 1] * len(seen), 0, float("inf")
    for done in range(1, rounds + 1):
        stands = all(settled)
        state = state.select("*", *[c.alias(f"o{k}") for k, c in enumerate(b)])
        for k in terms:
            rest = F.col(f"t{k}") - sum((product(k, m) * b[m] for m in terms if m != k), F.lit(0.0))
            held = state.select("x", "y", rest.alias("u"), product(k, k).alias("v"))
            if not settled[k]:
                scores = left_out(k, held)
                best = widths[min(range(len(widths)), key=lambda n: (scores[n], n)) if min(scores) < float("inf") else -1]
                settled[k], chosen[k] = best in seen[k], best
                seen[k].append(best)
            fitted = smoothed(held, [chosen[k]]).select("x", "y", F.try_divide("u", "v").alias("_fitted"))
            state = stored(state.join(fitted, ["x", "y"], "left").withColumn(f"b{k}", F.coalesce("_fitted", F.lit(0.0))).drop("_fitted"), "state")
        if not stands:
            state = state.drop(*[f"o{k}" for k in terms])
            continue
        one = F.struct(F.array(*b).alias("now"), F.array(*[c - F.col(f"o{k}") for k, c in enumerate(b)]).alias("change"))
        state = state.withColumn("past", F.concat(F.slice("past", 2, PAST) if past == PAST else F.col("past"), F.array(one))).drop(*[f"o{k}" for k in terms])
        past = min(past + 1, PAST)
        at = lambda j, of, k: F.col("past")[j][of][k]
        pairs = [(i, j) for i in range(past) for j in range(i, past)]
        dots = [F.sum(sum((product(k, k) * at(i, "change", k) * at(j, "change", k) for k in terms), F.lit(0.0))) for i, j in pairs]
        *found, size = [v or 0.0 for v in state.agg(*dots, F.sum(sum((product(k, k) * b[k] * b[k] for k in terms), F.lit(0.0)))).first()]
        change = (found[-1] / size) ** 0.5 if size else 0.0
        if not change > tolerance or done == rounds:
            break
        if change > 2 * last:  # a combination that led astray
            state, past = state.withColumn("past", F.slice("past", 1, 0)), 0
        elif past > 1:
            gram = np.zeros((past, past))
            for (i, j), v in zip(pairs, found, strict=True):
                gram[i, j] = gram[j, i] = v
            turn = np.diff(np.eye(past), axis=0)
            scale = np.sqrt(np.maximum(np.diag(turn @ gram @ turn.T), 1e-300))
            share = np.linalg.lstsq(turn @ gram @ turn.T / np.outer(scale, scale), turn @ gram[-1] / scale, rcond=1e-10)[0] / scale
            share = np.eye(past)[-1] - share @ turn
            state = state.withColumns({f"b{k}": sum((at(j, "now", k) * float(share[j]) for j in range(past)), F.lit(0.0)) for k in terms})
        last = change
    own = base.join(state.select("x", "y", *b), ["x", "y"], "left").na.fill(0.0, [f"b{k}" for k in terms])
    yhat = sum((x[k] * b[k] for k in terms), F.lit(0.0))
    return own.select("id", F.array(*b).alias("beta"), yhat.alias("yhat"), (F.col("_y") - yhat).alias("residual")), dict(zip(["intercept", *columns], chosen, strict=True))
