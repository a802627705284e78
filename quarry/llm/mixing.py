"""Mixing sources to target weights by soft membership.

A classifier trained on the labels table gives each document posteriors p over domains. Non-negative document rates r are
fitted by projected gradient to least squares: the expected tokens of each domain, sum of r * tokens * p, shall match a budget times
the domain's weight. The residual is whitened by the second moments of p, so steps of length one converge in a few rounds. From
r = 1 on, a document's rate depends on its posteriors and on the rounds' small gradients alone; each round is one distributed sum
of as many numbers as domains, and no rate is ever gathered or shuffled. After every REPLAYED rounds the rates are written with the
memberships, so that a round never repeats more than so many steps.

Where no row may go (least of 1 or more), the budget is the smallest one at which rates that rise linearly with the posteriors reach the
targets; so the domain that limits it gets as many tokens more as other domains' documents bring with them. A fit ends when the
targets are met within CLOSE of all tokens (Mix.met), or when the least squares no longer fall (targets out of reach, met as closely as
possible: Mix.met is false); after ROUNDS without either it raises NotSettled. Steps have momentum, which starts anew when the squares
rise; the sums at the point ahead follow from those of the last two rounds, so that it costs no pass.

A rate becomes whole copies: its integer part, and one more with the probability of the rest, drawn by a hash of the id.

Cases: null and empty texts have no tokens and get the rate of the classifier's base posteriors; unlabelled domains have the posterior that
their absence leaves; a weight of 0 asks for no tokens of a domain, which raises ValueError where no row may go, as do negative or no
weights; equal texts get equal rates; rows with equal ids stay separate rows; an empty table gives no rows and meets its targets.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.common import buffers, discard, map_batches, texts, written
from quarry.llm.toxicity import Model
from quarry.llm.words import mix

TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
#: Most rounds; the share of all tokens by which a domain may miss; the least relative fall of the squares in SETTLED rounds
#: that goes on; steps repeated a round.
ROUNDS, CLOSE, STALLED, SETTLED, REPLAYED = 200, 1e-6, 2e-3, 6, 8


class NotSettled(RuntimeError):
    """The rounds ran out before the targets were met or the least squares stopped falling."""


def domain(quality: str = "quality", toxic: str | None = "toxic") -> Column:
    """The domain of a labelled row."""
    by_quality = F.when(F.col(quality) == 1, "high").when(F.col(quality).isNotNull(), "low")
    return by_quality if toxic is None else F.when(F.col(toxic) == 1, "toxic").otherwise(by_quality)


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], of: Column, **options) -> Model:
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), of.alias("label")).where("label is not null")
    return toxicity.fit(docs, known.groupBy("doc_id").agg(F.max("label").alias("label")), names, shapes=True, **options)


def posteriors(model: Model, column: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by domains, and each row's tokens."""
    margins, tokens = model.margins(*buffers(column), dense, shapes=True)
    odds = toxicity.probabilities(margins)
    return odds / odds.sum(axis=1, keepdims=True), tokens


def replay(p: np.ndarray, steps: np.ndarray, least: float, at: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rates of documents with posteriors p after these steps (a gradient and, last, a momentum each) and before the last one; at: where to begin, if not at the first ones."""
    r, past = at or (np.maximum(np.ones(len(p)), least),) * 2
    for step in steps:
        r, past = np.maximum(r + step[-1] * (r - past) - p @ step[:-1], least), r
    return r, past


@dataclasses.dataclass(frozen=True)
class Mix:
    model: Model
    steps: np.ndarray
    least: float
    #: Tokens by domain before, after, and asked for.
    before: np.ndarray
    after: np.ndarray
    asked: np.ndarray
    met: bool = True


def memberships(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, p (a posterior for each of the model's names)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "w" not in state:
            state["w"] = held.value.dense()
        p, tokens = posteriors(held.value, batch.column(1), state["w"])
        at = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.ListArray.from_arrays(pa.array(at), pa.array(p.ravel()))], ["doc_id", "tokens", "p"])

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, tokens long, p array<double>")


def _sums(rows: DataFrame, value, size: int) -> np.ndarray:
    """The sum over all rows of value(tokens, p, (rate, the one before)), `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                n = batch.column(0).to_numpy().astype(float)
                total += value(n, batch.column(1).flatten().to_numpy().reshape(len(n), -1), tuple(batch.column(i).to_numpy() for i in (2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    found = rows.select("tokens", "p", "rate", "past").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r.k] = r.v
    return out


def _advanced(rows: DataFrame, steps: np.ndarray, least: float) -> DataFrame:
    """rows with the rates after these steps."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        found = replay(p, steps, least, tuple(batch.column(i).to_numpy() for i in (2, 3)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], ["tokens", "p", "rate", "past"])

    return map_batches(rows, run, "tokens long, p array<double>, rate double, past double")


def budget_of(before: np.ndarray, second: np.ndarray, weight: np.ndarray, least: float) -> float:
    """All tokens; where no row may go, the smallest budget that rates 1 + (a non-negative combination of the posteriors) bring to the weights."""
    total = before.sum() * max(1.0, least)
    if least < 1 or not total:
        return total
    # second / before: a domain's tokens bring other domains' in these shares
    shares = second / np.maximum(before, 1e-12)[:, None]
    reach = np.linalg.lstsq(shares.T, weight, rcond=None)[0]
    if (reach > 1e-3 * weight).all():
        return max(total, least * (before / reach).max())
    return max(total, 2 * least * (before / weight).max())  # out of linear reach: slack lets clipped rates come closer


def solve(rows: DataFrame, model: Model, targets: dict[str, float], least: float = 0.0, rounds: int = ROUNDS) -> Mix:
    """Rates of at least `least` for rows of memberships()."""
    k = len(model.names)
    weight = np.array([targets[x] for x in model.names], float)
    if (weight < 0).any() or not weight.sum() > 0:
        raise ValueError(f"weights must be non-negative and not all zero: {targets}")
    if least >= 1 and (weight == 0).any():
        raise ValueError(f"a domain of weight 0 can't be left out where every row stays: {targets}")
    weight = weight / weight.sum()
    first = F.lit(max(1.0, least))
    now_at, table = rows.select("tokens", "p", first.alias("rate"), first.alias("past")), None
    moments = _sums(now_at, lambda n, p, at: np.concatenate([n @ p, (p.T @ (p * n[:, None])).ravel()]), k + k * k)
    before, second = moments[:k], moments[k:].reshape(k, k)
    total = before.sum()
    asked = budget_of(before, second, weight, least) * weight
    if not total:
        return Mix(model, np.zeros((0, k + 1)), least, before, before, asked)
    inverse = np.linalg.pinv(second / total + 1e-9 * np.eye(k))
    steps, fresh, since = np.zeros((0, k + 1)), 0, 0
    now = past = before * max(1.0, least)
    squares, met = [], False
    for _ in range(rounds):
        gap = (now - asked) / total
        met = bool(np.abs(gap).max() < CLOSE)
        squares.append(float(gap @ inverse @ gap))
        if met or len(squares) > SETTLED and min(squares) > (1 - STALLED) * min(squares[:-SETTLED]):
            break
        since = 0 if len(squares) > 1 and squares[-1] > squares[-2] else since + 1
        momentum = max(0, since - 1) / (since + 2)
        steps, fresh = np.vstack([steps, [*(inverse @ (gap + momentum * (now - past) / total)), momentum]]), fresh + 1
        now, past = _sums(now_at, lambda n, p, at, s=steps[-fresh:]: (n * replay(p, s, least, at)[0]) @ p, k), now
        if fresh == REPLAYED:
            old, table = table, written(_advanced(now_at, steps[-fresh:], least), "rates")
            now_at, fresh = table, 0
            if old is not None:
                discard(old)
    else:
        raise NotSettled(f"{rounds} rounds; tokens {now.tolist()}, asked {asked.tolist()}")
    if table is not None:
        discard(table)
    return Mix(model, steps, least, before, now, asked, met)


def _copies(rate: np.ndarray, ids: np.ndarray) -> np.ndarray:
    draw = (mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    return (np.floor(rate) + (draw < rate - np.floor(rate))).astype(np.int64)


def rates(rows: DataFrame, mix_: Mix) -> DataFrame:
    """doc_id, tokens, p, rate, copies; rows: of memberships()."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        r, _ = replay(p, mix_.steps, mix_.least)
        ids = batch.column(0).fill_null(0).to_numpy()
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(_copies(r, ids))], ["doc_id", "tokens", "p", "rate", "copies"])

    return map_batches(rows.select("doc_id", "tokens", "p"), run, "doc_id long, tokens long, p array<double>, rate double, copies long")


def mixed(docs: DataFrame, mix_: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, each row as often as its rate says; computed in one pass, without a join."""
    held = docs.sparkSession.sparkContext.broadcast(mix_)
    state: dict = {}
    at, of = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        if "w" not in state:
            state["w"] = m.model.dense()
        r, _ = replay(posteriors(m.model, batch.column(at), state["w"])[0], m.steps, m.least)
        n = _copies(r, batch.column(of).cast(pa.int64()).fill_null(0).to_numpy())
        return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))

    return map_batches(docs, run, docs.schema)


def fit_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, of: Column | None = None, **options) -> tuple[Mix, DataFrame]:
    """The mix, and the memberships it was fitted to."""
    names = tuple(targets)
    model = fit(docs, labels, names, domain() if of is None else of, **options)
    rows = written(memberships(docs, model), "memberships")
    return solve(rows, model, targets, least), rows
