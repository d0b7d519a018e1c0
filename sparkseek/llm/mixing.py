"""Mixing to target weights by soft membership: predicted domain posteriors, and document rates by projected gradient."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, column, labelled_sample, mapped, materialise, private, slices, text_buffer, words

#: The domain of a row of the labelled table, and the share of tokens that each is to have.
DOMAIN = "CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' END"
TARGETS = {"clean": 0.95, "toxic": 0.05, "junk": 0.0}
#: Labelled rows of each domain that the classifier is fitted on, at most, with their whole texts, and the bytes that
#: these have together.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 16 << 20
#: Word hashes are counted in so many buckets; those in fewer sampled rows than MIN_ROWS aren't features.
BUCKETS = 1 << 18
MIN_ROWS = 8
#: Weight of staying near a rate of 1.
RIDGE = 1e-4
#: Documents whose posteriors agree in the first places share a rate: so many steps from 0 to 1, and so many cells at most.
STEPS = 512
MOST_CELLS = 1 << 18
#: Gradient steps end when the loss is so near to its least possible value (the duality gap), or with a warning.
GAP = 1e-7
ITERATIONS = 20_000
#: Without a budget, a domain that is too scarce for its share is repeated up to so many times, and has less beyond that.
MOST_REPEATS = 4
_KINDS = ("upper", "digit", "mark", "other")
_KIND = np.zeros(256, np.int64)
_KIND[:] = 4
_KIND[65:91], _KIND[48:58], _KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0, 1, 2
_KIND[[9, 10, 13, *range(97, 123), 32, *range(128, 256)]] = 3


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts: number of words; (row, bucket) of the distinct word buckets; shares of kinds of bytes."""
    data, off = text_buffer(texts)
    n = len(off) - 1
    h, _, _, first = words(data, off)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    both = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    size = np.diff(off)
    kinds = np.bincount(np.repeat(np.arange(n) * 5, size) + _KIND[data], minlength=5 * n).reshape(n, 5)[:, :4] / np.maximum(size, 1)[:, None]
    return count, both // BUCKETS, both % BUCKETS, kinds


@dataclass
class Classifier:
    """Softmax regression on the buckets present and on the kinds of bytes."""

    domains: list[str]
    index: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, np.int32))
    weights: np.ndarray | None = None
    prior: np.ndarray | None = None

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, posterior of each domain) of each text; a text without words gets the prior."""
        count, row, bucket, kinds = _features(texts)
        p = np.tile(self.prior, (len(count), 1))
        some = count > 0
        if self.weights is not None and some.any():
            p[some] = _softmax(self._logits(row, bucket, kinds, len(count)))[some]
        return count, p

    def _logits(self, row: np.ndarray, bucket: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
        at = self.index[bucket]
        row, at = row[at >= 0], at[at >= 0]
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        k = len(self.domains)
        out = np.stack([np.bincount(row, self.weights[at, i], n) * scale for i in range(k)], 1)
        return out + np.hstack([kinds, np.ones((n, 1))]) @ self.weights[-kinds.shape[1] - 1 :]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, domains: list[str], share: np.ndarray, steps: int = 150) -> Classifier:
    """Fits by Adam on the whole sample at once; domains count by their share of all labelled rows."""
    model = Classifier(domains, prior=share)
    parts, at = [], 0
    array = pa.array(texts, pa.large_string())
    for lo, hi in slices(array):
        count, row, bucket, kinds = _features(array.slice(lo, hi - lo))
        parts.append((row + at, bucket, kinds))
        at += hi - lo
    n, k = len(texts), len(domains)
    row, bucket, kinds = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.vstack([p[2] for p in parts])
    rows = np.bincount(bucket, minlength=BUCKETS)
    used = np.flatnonzero(rows >= MIN_ROWS)
    model.index[used] = np.arange(len(used))
    feature = model.index[bucket]
    row, feature = row[feature >= 0], feature[feature >= 0]
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    value = scale[row]
    dense = np.hstack([kinds, np.ones((n, 1))])
    weights = np.zeros((len(used) + dense.shape[1], k))
    own = np.bincount(labels, minlength=k)
    balance = (share / np.maximum(own, 1) * n)[labels][:, None]
    truth = np.eye(k)[labels]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, weights[feature, i] * value, n) for i in range(k)], 1) + dense @ weights[len(used) :]
        error = (_softmax(z) - truth) * balance / n
        gradient = np.vstack([np.stack([np.bincount(feature, error[row, i] * value, len(used)) for i in range(k)], 1), dense.T @ error]) + 1e-6 * weights
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        weights -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights = weights
    return model


def fit(docs: DataFrame, labels: DataFrame, domain: str = DOMAIN, domains: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier of labelled documents, by at most SAMPLE_ROWS rows of each domain: the first by a hash of the id.

    domain is a SQL expression over labels; rows where it, the id or the text is null, or that is none of domains, are
    left out; an id with several domains counts for the least, and one of its texts counts. Priors are the shares of all
    labelled ids. Without any labelled row the domains are equally likely for every text.
    """
    domains = domains or [*TARGETS]
    known = labels.select(column(id_col).alias("id"), F.expr(domain).alias("kind")).where("id IS NOT NULL").where(F.col("kind").isin(domains)).groupBy("id").agg(F.min("kind").alias("kind"))
    share, sample = labelled_sample(docs, known, id_col, text_col, SAMPLE_ROWS, SAMPLE_BYTES)
    total = sum(share.values())
    rows = sorted((r["place"], r["text"], r["kind"]) for r in sample.collect()) if total else []
    prior = np.array([share.get(d, 0) / total for d in domains]) if total else np.full(len(domains), 1 / len(domains))
    if not rows:
        return Classifier(domains, prior=prior)
    return train([text for _, text, _ in rows], np.array([domains.index(kind) for _, _, kind in rows]), domains, prior)


def cell_steps(k: int) -> int:
    """Steps of each of k posteriors, so that there are MOST_CELLS cells at most, about."""
    steps = STEPS
    while steps > 2 and math.comb(steps + k - 1, k - 1) > MOST_CELLS:
        steps -= max(1, steps // 16)
    return steps


def cell_of(p: np.ndarray) -> np.ndarray:
    """The cell of each row of posteriors, a number: all but the last, rounded."""
    steps = cell_steps(p.shape[1])
    at = np.floor(p[:, :-1] * steps + 0.5).astype(np.int64)
    out = np.zeros(len(p), np.int64)
    for i in range(at.shape[1]):
        out = out * (steps + 1) + at[:, i]
    return out


@dataclass
class Rates:
    """The rate of each cell of posteriors, and what the domains have by them and should have, in shares of all tokens."""

    cells: np.ndarray
    rates: np.ndarray
    expected: np.ndarray
    target: np.ndarray
    gap: float

    def __call__(self, p: np.ndarray) -> np.ndarray:
        """1 for a cell without tokens."""
        if not len(self.cells):
            return np.ones(len(p))
        cell = cell_of(p)
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.rates[at], 1.0)


def gradient_steps(w: np.ndarray, p: np.ndarray, target: np.ndarray, scale: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """(rates, duality gap): the rates r >= 0 that minimise, by projected gradient with momentum,

        1/2 sum over domains of scale * (sum of w p r - target)^2 + ridge/2 * sum of w (r - 1)^2.

    w are token shares, one metric for the steps; p the posteriors. The momentum starts anew where the loss grows.
    """
    r = ahead = np.ones(len(w))
    t, last, gap = 0, math.inf, math.inf
    size = 1 / (float(np.linalg.eigvalsh((p * np.sqrt(scale)).T @ (p * np.sqrt(scale) * w[:, None])).max(initial=0.0)) + ridge)

    def loss_and_bound(r: np.ndarray) -> tuple[float, float]:
        y = scale * ((w * r) @ p - target)
        loss = (y**2 / scale).sum() / 2 + ridge / 2 * (w * (r - 1) ** 2).sum()
        slope = p @ y
        best = np.maximum(0.0, 1 - slope / ridge)
        return loss, float((w * (slope * best + ridge / 2 * (best - 1) ** 2)).sum() - y @ target - (y**2 / scale).sum() / 2)

    bound = -math.inf
    for step in range(ITERATIONS):
        slope = p @ (scale * ((w * ahead) @ p - target)) + ridge * (ahead - 1)
        new = np.maximum(0.0, ahead - size * slope)
        if step % 8 == 0:
            loss, low = loss_and_bound(new)
            bound = max(bound, low)
            gap = loss - bound
            if gap <= GAP:
                return new, gap
            if loss > last:
                t = 0
            last = loss
        ahead, r, t = np.maximum(0.0, new + t / (t + 3) * (new - r)), new, t + 1
    warnings.warn(f"the rates are {gap:.2g} from the least loss after {ITERATIONS} steps", stacklevel=2)
    return r, gap


def solve(memberships: DataFrame, targets: dict[str, float], domains: list[str], budget: float | None = None, ridge: float = RIDGE) -> Rates:
    """Rates that bring each domain's expected tokens to its target; memberships has n (tokens) and p (posteriors).

    Least squares over rates r >= 0: sum over domains of (expected - target)^2 / available, plus ridge times the
    token-weighted mean of (r - 1)^2, by gradient steps with projection onto r >= 0, in the metric that weights a
    document by its tokens. The gradient at a document depends on its posteriors alone, so documents of like posteriors
    take the same steps: tasks sum the tokens and the posteriors of each cell of them over all documents, and the steps
    are taken on these sums, of which there are MOST_CELLS at most whatever the table. What the domains then have is
    what all documents have, as the sums are exact.

    budget is the share of all tokens that the mixture has. By default it is that at which the domain of the largest
    target is used once and whole; scarcer domains repeat for their share, up to MOST_REPEATS times.
    """
    k = len(domains)
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    want = want / want.sum() if want.sum() > 0 else np.full(k, 1 / k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy().astype(np.float64)
            p = b.column("p").flatten().to_numpy().reshape(-1, k)
            cells, at = np.unique(cell_of(p), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(np.bincount(at, x, len(cells))) for x in (n, *(p * n[:, None]).T)]], names=["cell", "n", *[f"s{i}" for i in range(k)]])

    parts = arrow_map(memberships.where("n > 0"), sums, ", ".join(["cell bigint", "n double", *[f"s{i} double" for i in range(k)]]))
    rows = sorted(tuple(r) for r in parts.groupBy("cell").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(k)]).collect())
    if not rows:
        return Rates(np.zeros(0, np.int64), np.zeros(0), np.zeros(k), want, 0.0)
    cells, table = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    total = table[:, 0].sum()
    w, p = table[:, 0] / total, table[:, 1:] / table[:, :1]
    available = w @ p
    can = (want > 0) & (available > 0)
    if budget is not None:
        target = want * budget
    elif can.any():
        main = max(np.flatnonzero(can), key=lambda i: (want[i], available[i]))
        target = np.minimum(want * available[main] / want[main], available * MOST_REPEATS)
    else:
        target = want
    rates, gap = gradient_steps(w, p, target, 1 / np.maximum(available, 1e-6), ridge)
    return Rates(cells, rates, (w * rates) @ p, target, gap)


def _lists(p: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def memberships(docs: DataFrame, model: Classifier, id_col: str, text_col: str, kept: list[str]) -> DataFrame:
    """The columns kept as c0, c1, ..., draw (a hash of id and text), n (words) and p (posteriors), in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                n, p = shared.value.posteriors(texts.slice(lo, hi - lo))
                some = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], some.column("draw"), pa.array(n, pa.int64()), _lists(p)], names=[*names, "draw", "n", "p"])

    chosen = docs.select(*[column(c).alias(name) for c, name in zip(kept, names)], F.xxhash64(column(id_col), column(text_col)).alias("draw"), column(text_col).alias("text"))
    schema = chosen.drop("text").select("*", F.lit(0).cast("bigint").alias("n"), F.array(F.lit(0.0)).alias("p")).schema
    return materialise(arrow_map(chosen, run, schema), "memberships")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = DOMAIN, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, repeat: bool = False) -> DataFrame:
    """The columns `keep` of docs (all by default), with n_tokens, posteriors array<double>, rate and copies.

    Domains are the keys of targets, in order, for the posteriors too. rate is how often the document is used on
    average, copies how often it is used: the whole part of the rate, and one more with the probability of the rest, by
    a hash of id and text. With repeat, each row comes copies times instead, without the four columns.

    Null and empty texts have no tokens, the priors as posteriors and the rate that these give. Rows that are the same
    in id and text, null ids too, have the same rate and copies; ties need no order. The four columns replace columns of
    docs by these names, unless repeat is set. An empty table gives an empty result.
    """
    targets = targets or TARGETS
    domains = [*targets]
    new = [] if repeat else ["n_tokens", "posteriors", "rate", "copies"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in new]
    known = memberships(docs, fit(docs, labels, domain, domains, id_col, text_col), id_col, text_col, kept)
    shared = docs.sparkSession.sparkContext.broadcast(solve(known.select("n", "p"), targets, domains, budget))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates = shared.value
        for batch in batches:
            draws, n, lists = batch.columns[-3:]
            p = lists.flatten().to_numpy().reshape(batch.num_rows, len(domains))
            rate = rates(p)
            u = (draws.to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0**-53
            copies = (np.floor(rate) + (u < rate - np.floor(rate))).astype(np.int32)
            some = batch.columns[:-3]
            if repeat:
                at = pa.array(np.repeat(np.arange(batch.num_rows), copies))
                yield pa.RecordBatch.from_arrays([c.take(at) for c in some], names=kept)
            else:
                yield pa.RecordBatch.from_arrays([*some, n, lists, pa.array(rate), pa.array(copies)], names=[*kept, *new])

    kinds = {"n_tokens": "bigint", "posteriors": "array<double>", "rate": "double", "copies": "int"}
    schema = docs.select(*[column(c) for c in kept], *[F.lit(None).cast(kinds[c]).alias(c) for c in new]).schema
    return mapped(known, run, schema)
