"""Mixing a corpus to target domain weights by soft membership.

Domains are the combinations of two labelled columns. A classifier fitted on the labels table gives
each document a posterior over domains, and each document a rate. The expected tokens of a domain
are the sum over documents of rate * tokens * posterior; nonnegative rates that bring these totals
to their targets come from projected-gradient least squares, started at rate 1 for all. A gradient
step moves every rate by the same combination of its posterior, so the whole state of the descent
is a few numbers per step, and each iteration is one aggregation over (tokens, posterior) rows.
"""

from __future__ import annotations

import warnings

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import nbsvm, text
from marlstone.llm.labelled import append
from marlstone.llm.store import Scratch

#: Labelled columns whose combinations are domains, and the share of tokens that each should have.
LABELS = ("quality", "toxic")
DOMAINS = ((1, 0), (1, 1), (0, 0), (0, 1))
TARGETS = {(1, 0): 0.90, (1, 1): 0.03, (0, 0): 0.06, (0, 1): 0.01}
#: Labelled documents of each class for each column's classifier at most.
ROWS_PER_CLASS = 4000
#: Most steps, and the misfit (share of all tokens) at which the descent ends.
MAX_STEPS, ENOUGH = 15, 1e-6


def domain_name(domain: tuple) -> str:
    return "_".join(f"{label}{value}" for label, value in zip(LABELS, domain))


@dataclass
class Mixer:
    """Classifiers and the steps of the descent; rates() and posteriors are functions of a text alone."""

    models: list[nbsvm.Model]
    steps: list[list[float]] = field(default_factory=list)

    def posteriors(self, texts: pa.Array) -> np.ndarray:
        columns, at = nbsvm.features(texts)
        one = [m.of_features(columns, at) for m in self.models]
        return np.stack([np.prod([p if v else 1 - p for p, v in zip(one, domain)], axis=0) for domain in DOMAINS], axis=1)

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        x = np.ones(len(posterior))
        for s in self.steps:
            x = np.maximum(0.0, x - posterior @ np.array(s))
        return x

    def added(self, texts: pa.Array) -> dict[str, pa.Array]:
        p = self.posteriors(texts)
        n = np.diff(text.words(texts, lower=False)[1])
        flat = pa.array(p.ravel())
        return {"n_tokens": pa.array(n, pa.int64()), "posterior": pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), flat), "rate": pa.array(self.rates(p))}


_ADDED = {"n_tokens": T.LongType(), "posterior": T.ArrayType(T.DoubleType()), "rate": T.DoubleType()}


def _rate(steps: list[list[float]], p: Column) -> Column:
    x = F.lit(1.0)
    for s in steps:
        x = F.greatest(F.lit(0.0), x - sum((F.get(p, F.lit(k)) * F.lit(float(v)) for k, v in enumerate(s)), F.lit(0.0)))
    return x


def _totals(rows: DataFrame, steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain at the rates of these steps, and the Gram matrix of documents whose rate is above 0."""
    k = len(DOMAINS)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    timed = rows.withColumn("x", _rate(steps, F.col("posterior")))
    sums = [F.sum(F.col("n_tokens") * F.col("x") * p[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.when(F.col("x") > 0, F.col("n_tokens") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]
    found = [float(v or 0.0) for v in timed.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()]
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, found[k:]):
        gram[i, j] = gram[j, i] = v
    return np.array(found[:k]), gram


class Steps(list):
    """Steps of a descent, and the misfit that they leave: the tokens off their domain's target, as a share of all."""

    misfit = 0.0


def descend(rows: DataFrame, targets: dict[tuple, float] = TARGETS) -> Steps:
    """Steps that bring (n_tokens, posterior) rows to the targets, shares of all their tokens.

    Each is the least-squares gradient scaled by the inverse Gram matrix of the documents that
    still have a positive rate, and halved until the misfit (the sum of differences) falls. Targets
    that nonnegative rates can reach are reached to ENOUGH; for others the steps end short of the
    least squares, and misfit says by how much the targets are missed.
    """
    all_tokens = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    if not all_tokens:
        return Steps()
    goal = np.array([targets.get(d, 0.0) for d in DOMAINS])
    goal = goal / goal.sum() * all_tokens
    steps = Steps()
    totals, gram = _totals(rows, steps)
    misfit = float(np.abs(totals - goal).sum())
    while len(steps) < MAX_STEPS and misfit > ENOUGH * all_tokens:
        # Sums depend on the order of rows in their last digits only; rounding hides that.
        scaled = np.linalg.solve(gram / all_tokens + 1e-9 * np.eye(len(goal)), (totals - goal) / all_tokens)
        for _ in range(6):
            trial = Steps([*steps, [float(f"{v:.9g}") for v in scaled]])
            new, new_gram = _totals(rows, trial)
            if float(np.abs(new - goal).sum()) < misfit:
                break
            scaled = scaled / 2
        else:
            break
        steps, totals, gram, misfit = trial, new, new_gram, float(np.abs(new - goal).sum())
    steps.misfit = misfit / all_tokens
    return steps


def fit(docs: DataFrame, labels: DataFrame, targets: dict[tuple, float] = TARGETS, rows_per_class: int = ROWS_PER_CLASS, text_col: str = "text") -> Mixer:
    """Classifiers from bounded samples of labels, posteriors and token counts of all docs, and the rates' steps."""
    plain = docs.withColumnRenamed(text_col, "text") if text_col != "text" else docs
    mixer = Mixer([nbsvm.fit(plain.select("doc_id", "text"), labels, label, rows_per_class) for label in LABELS])
    shared = docs.sparkSession.sparkContext.broadcast(mixer)
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = append(plain.select("text"), "text", _ADDED, lambda t: shared.value.added(t), False).select("n_tokens", "posterior")
    mixer.steps = descend(scratch.write(rows, "posteriors"), targets)
    scratch.drop()
    if mixer.steps.misfit > ENOUGH:
        warnings.warn(f"the rates miss their targets by {mixer.steps.misfit:.2%} of all tokens", stacklevel=2)
    return mixer


def apply(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, posterior (in the order of DOMAINS), rate, and copies.

    copies is rate rounded down or up: up with the chance of its fraction, by the hash of the id, so
    that expected copies are the rate. Null and empty texts have no tokens and get the rate of their
    posterior like others. Columns by those names are replaced; repeated rows are treated alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(mixer)
    rated = append(docs.drop("copies"), text_col, _ADDED, lambda t: shared.value.added(t), keep_text)
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1 << 32)) / float(1 << 32)
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + F.when(chance < F.col("rate") - whole, 1).otherwise(0)).cast("bigint"))
