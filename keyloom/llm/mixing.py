"""Mixing sources to target weights (problem 7).

1. A naive Bayes classifier over hashed token ids is fitted on a bounded sample of the documents that name their source
   (the labelled table).  Its tempered posteriors, with the target weights as prior, are each document's soft
   membership in the domains; the temperature is fitted on a held-out part of the sample.
2. Nonnegative document rates are fitted by distributed projected-gradient least squares: expected token totals of the
   domains, soft by posterior and hard by the named source, are to match the targets.  Rates are projected onto
   ``[0, max_repeat]``.  A rate depends on the summed gradients by two short vectors only (lazy projection), so a step
   is one aggregate over the compact table and no per-document state is rewritten.  Steps are scaled by the Gram matrix
   of the documents whose rate is free; several dampings are tried at once, and steps end when they gain nothing more.
3. The mix is as large as the caps allow.  Where domains of that size can't be met within ``TOLERANCE``, the largest
   size at which they can is searched by halving; where none will do, the full size is kept and the misses reported.
4. Rates become whole repeats by a threshold on a hash of the document, shifted per source by less than one until the
   source's expected total is met.

The driver and each task hold vectors and matrices of the size of the target table, the classifier's table, which has
at most ``MODEL_CELLS`` cells, and a histogram; none grows with the documents.  Each document is tokenised once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.runtime import cut

#: Rank file of a byte-level tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's public splitting pattern (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: About so many labelled documents, the same number of each source where there are enough, fit the classifier.
SAMPLE = 20_000
#: One document of the sample in so many is held out for temperature and accuracy.
HELD_OUT = 5
#: Most cells of the classifier's table; token ids are hashed into as many buckets as fit, 2**14 at most.
MODEL_CELLS, MOST_BUCKETS = 1 << 23, 1 << 14
#: Ridge of the least squares for soft and for hard totals, as shares of the mix per unit of the rate's shift.
RIDGE_SOFT, RIDGE_HARD = 1e-4, 1e-5
#: A fit has converged when a further step promises less than this; by it shares change by 0.00002 at most.
CONVERGED = 1e-5
#: Dampings that are tried in one pass, as parts of the steepest curvature there can be; at 1 a step always gains.
DAMPINGS = (0.0, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)
#: Largest miss of a soft domain share for which the mix isn't made smaller; the smallest part of the full size that is
#: tried for it, and how often the interval between is halved.
TOLERANCE, SMALLEST, HALVINGS = 0.004, 0.25, 4
BINS = 8192


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class _Tokens:
    """Token ids of texts.  The rank file is shipped to the executors, which need not share the driver's disk."""

    def __init__(self, documents: DataFrame, path: str):
        documents.sparkSession.sparkContext.addFile(path)
        self.name = path.rsplit("/", 1)[-1]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        encode = encoding(SparkFiles.get(self.name)).encode_ordinary
        return [np.asarray(encode(x), dtype=np.int64) for x in texts.to_pylist()]


def _uniform(*columns: str) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


@dataclass
class Classifier:
    """Log-probabilities ``[bucket][source]``, log-prior and temperature; ``accuracy`` is that of held-out documents."""

    weights: np.ndarray
    prior: np.ndarray
    temperature: float = 1.0
    accuracy: float = float("nan")
    n_held_out: int = 0

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[_buckets(ids, len(self.weights))].sum(axis=0, dtype=np.float64)

    def posterior(self, ids: np.ndarray) -> np.ndarray:
        """Probability of each domain for a document's tokens."""
        return softmax(self.temperature * self.logits(ids) + self.prior)


def softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


def _buckets(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids * 2654435761 % (1 << 32)) % n


def fit_classifier(
    usable: DataFrame, sources: list[str], weights: np.ndarray, tokens: _Tokens, sample: int = SAMPLE
) -> Classifier:
    """Fit on a bounded sample of ``source, text``; which documents it holds depends on their ids and texts only."""
    index = {x: i for i, x in enumerate(sources)}
    with np.errstate(divide="ignore"):
        prior = np.log(weights / max(weights.sum(), 1e-300))
    counted = {r.source: r.n for r in usable.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_buckets = int(min(MOST_BUCKETS, max(64, 1 << (MODEL_CELLS // max(1, len(sources))).bit_length() - 1)))
    if not counted:
        return Classifier(np.zeros((n_buckets, len(sources)), np.float32), prior)
    share = F.create_map(*[F.lit(x) for s, n in counted.items() for x in (s, min(1.0, sample / len(counted) / n))])
    draw = _uniform("doc_id", "text")
    drawn = usable.withColumn("_draw", draw / F.element_at(share, F.col("source"))).where("_draw < 1.0")
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id", "text"), F.lit(HELD_OUT)) == 0

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index) * n_buckets, dtype=np.int64)
        for batch in batches:
            cells = [index[x] * n_buckets + _buckets(ids, n_buckets) for x, ids in zip(batch.column(0).to_pylist(), tokens(batch.column(1)))]
            if cells:
                counts += np.bincount(np.concatenate(cells), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    parts = drawn.where(~held).select("source", "text").mapInArrow(emit, "at long, n long")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # MODEL_CELLS rows at most
    counts = np.zeros(len(sources) * n_buckets)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    smooth = counts.reshape(len(sources), n_buckets) + 0.5
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)
    model = Classifier(table, prior)
    shared = usable.sparkSession.sparkContext.broadcast(model)  # MODEL_CELLS at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tokens(batch.column(1))
            logits = [shared.value.logits(x).tolist() for x in ids]
            at = [index[x] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(logits, pa.list_(pa.float64()))],
                ["at", "n", "logits"],
            )

    tested = drawn.where(held).select("source", "text").mapInArrow(judge, "at long, n long, logits array<double>").toArrow()
    if tested.num_rows:  # about SAMPLE / HELD_OUT rows
        at, n = tested["at"].to_numpy(), tested["n"].to_numpy().astype(np.float64)
        logits = np.array(tested["logits"].to_pylist())
        model.n_held_out, model.accuracy = len(at), float((logits.argmax(axis=1) == at).mean())
        totals = np.bincount(at, n, len(sources))
        mass = weights[at] * n / np.maximum(totals[at], 1.0)  # as in a mix that has the target weights

        def loss(temperature: float) -> float:
            p = softmax(temperature * logits + prior)[np.arange(len(at)), at]
            return -float((mass * np.log(np.maximum(p, 1e-300))).sum())

        model.temperature = float(min(np.geomspace(1e-3, 3.0, 80), key=loss))
    return model


def memberships(usable: DataFrame, model: Classifier, tokens: _Tokens) -> DataFrame:
    """``doc_id, source, n_tokens, domains, u``: posteriors in the order of the sources, and a number per document."""
    shared = usable.sparkSession.sparkContext.broadcast(model)  # MODEL_CELLS at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tokens(batch.column(2))
            domains = [shared.value.posterior(x).astype(np.float32) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(domains, pa.list_(pa.float32())), batch.column(3)],
                ["doc_id", "source", "n_tokens", "domains", "u"],
            )

    ddl = "doc_id long, source string, n_tokens long, domains array<float>, u double"
    drawn = usable.select(F.col("doc_id").cast("long"), "source", "text", _uniform("doc_id", "text").alias("u"))
    return drawn.mapInArrow(emit, ddl).where(F.col("n_tokens") > 0)


class Rates:
    """Rates of documents: a base rate per source, moved along posterior and source, projected onto [0, cap]."""

    def __init__(self, sources: list[str], weight: np.ndarray, supply: np.ndarray, caps: np.ndarray):
        self.index = {x: i for i, x in enumerate(sources)}
        self.weight, self.supply, self.caps = weight, supply, caps
        self.size = 0.0
        self.moves = np.zeros(2 * len(sources))

    def documents(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source index, tokens, posteriors) of the documents of a batch."""
        at = np.array([self.index[x] for x in batch.column("source").to_pylist()], dtype=np.int64)
        domains = batch.column("domains").flatten().to_numpy().reshape(len(at), len(self.weight))
        return at, batch.column("n_tokens").to_numpy().astype(np.float64), domains.astype(np.float64)

    def free(self, at: np.ndarray, domains: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Rates before they are projected."""
        k = len(self.weight)
        found = (self.weight * self.size / self.supply)[at] + domains @ moves[:k] + moves[k:][at]
        return np.where(self.weight[at] > 0, found, 0.0)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source index, tokens, rate) of the documents of a batch."""
        at, tokens, domains = self.documents(batch)
        return at, tokens, np.clip(self.free(at, domains, self.moves), 0.0, self.caps[at])


@dataclass
class _State:
    """A point of the least squares: moves, shares of the domains (soft then hard), Gram matrix of the free documents."""

    moves: np.ndarray
    shares: np.ndarray
    gram: np.ndarray
    value: float


def _states(members: DataFrame, rates: Rates, points: list[np.ndarray]) -> list[_State]:
    """Evaluate the least squares at several points in one pass over the documents."""
    k = len(rates.weight)
    wide = 2 * k
    cells = wide + wide * wide + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(points), cells))
        for batch in batches:
            at, tokens, domains = rates.documents(batch)
            mass, caps = tokens / rates.size, rates.caps[at]
            for row, moves in zip(out, points):
                free = rates.free(at, domains, moves)
                rate = np.clip(free, 0.0, caps)
                row[:k] += (rate * mass) @ domains
                row[k:wide] += np.bincount(at, rate * mass, k)
                inside = (free > 0) & (free < caps)
                d, m, a = domains[inside], mass[inside], at[inside]
                gram = row[wide:-1].reshape(wide, wide)
                weighted = d * m[:, None]
                gram[:k, :k] += weighted.T @ d
                for source in np.unique(a):
                    gram[k + source, :k] += weighted[a == source].sum(axis=0)
                gram[k:, k:] += np.diag(np.bincount(a, m, k))
                row[-1] += (mass * np.where(free > caps, caps * free - caps * caps / 2, rate * rate / 2)).sum()
        flat = out.ravel()
        nonzero = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(nonzero), pa.array(flat[nonzero])], ["at", "n"])

    rows = members.mapInArrow(emit, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(points) * cells)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()  # len(DAMPINGS) times (2 sources + 1) squared rows at most
    ridge = _ridge(k)
    target = np.concatenate([rates.weight, rates.weight])
    found = []
    for row, moves in zip(out.reshape(len(points), cells), points):
        gram = row[wide:-1].reshape(wide, wide)
        gram[:k, k:] = gram[k:, :k].T
        found.append(_State(moves, row[:wide], gram, float((ridge * moves**2).sum() / 2 + row[-1] - target @ moves)))
    return found


def _ridge(k: int) -> np.ndarray:
    return np.concatenate([np.full(k, RIDGE_SOFT), np.full(k, RIDGE_HARD)])


def _fit_rates(members: DataFrame, rates: Rates, most_steps: int | None) -> np.ndarray:
    """Move the rates to the least squares at their size; the shares that the domains then have, soft and hard.

    The objective falls with every step and is convex, so the steps come to an end by themselves.
    """
    ridge = _ridge(len(rates.weight))
    target = np.concatenate([rates.weight, rates.weight])
    steepest = 2.0 * rates.supply[rates.weight > 0].sum() / rates.size
    at = _states(members, rates, [rates.moves])[0]
    steps, begun = 0, at.value
    while most_steps is None or steps < most_steps:
        gradient = ridge * at.moves + at.shares - target
        steps_by = [-np.linalg.solve(at.gram + np.diag(ridge + x * steepest), gradient) for x in DAMPINGS]
        if -float(gradient @ steps_by[0]) < CONVERGED:
            break
        best = min(_states(members, rates, [at.moves + x for x in steps_by]), key=lambda x: x.value)
        if at.value - best.value < max(CONVERGED / 10, (begun - at.value) / 1000):
            break
        at = best
        steps += 1
    rates.moves = at.moves
    return at.shares


def _fit_size(members: DataFrame, rates: Rates, largest: float, most_steps: int | None) -> tuple[float, np.ndarray]:
    """Fit the rates at the largest part of the full size at which the soft domains are met; (part, expected shares)."""
    k = len(rates.weight)

    def fitted(part: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        rates.size, rates.moves = largest * part, moves
        expected = _fit_rates(members, rates, most_steps)
        return rates.moves, expected, bool(np.abs(expected[:k] - rates.weight).max() <= TOLERANCE)

    full = fitted(1.0, rates.moves)
    if full[2] or most_steps is not None:
        return 1.0, full[1]
    low, high = SMALLEST, 1.0
    best = fitted(low, np.zeros(2 * k))
    if not best[2]:
        rates.size, rates.moves = largest, full[0]
        return 1.0, full[1]
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        found = fitted(middle, best[0])
        low, high, best = (middle, high, found) if found[2] else (low, middle, best)
    rates.size, rates.moves = largest * low, best[0]
    return low, best[1]


def _shifts(members: DataFrame, rates: Rates, goal: np.ndarray) -> np.ndarray:
    """Per source, the shift of the rounding threshold that brings the whole repeats nearest to the expected total.

    Shifts by -1 and 1 give at most and at least the expected total, so the one wanted lies between them.
    """
    k = len(goal)
    last = 2 * BINS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((k, last + 1))  # tokens gained from shift to shift; last: total at shift -1
        for batch in batches:
            at, tokens, rate = rates.of(batch)
            mark = rate + batch.column("u").to_numpy()
            low = np.floor(mark - 1.0)
            np.add.at(bins, (at, last), np.clip(low, 0, rates.caps[at]) * tokens)
            for step in (0, 1):  # the shifts at which the repeats go up by one
                gains = (low + step >= 0) & (low + step < rates.caps[at])
                up = np.floor(mark) + step - mark
                where = np.clip(((up + 1.0) * BINS).astype(np.int64), 0, last - 1)
                np.add.at(bins, (at[gains], where[gains]), tokens[gains])
        flat = bins.ravel()
        nonzero = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(nonzero), pa.array(flat[nonzero])], ["at", "n"])

    parts = members.mapInArrow(emit, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    rows = parts.toArrow()  # sources times bins at most
    bins = np.zeros(k * (last + 1))
    bins[rows["at"].to_numpy()] = rows["n"].to_numpy()
    bins = bins.reshape(k, -1)
    totals = bins[:, -1:] + np.concatenate([np.zeros((k, 1)), np.cumsum(bins[:, :-1], axis=1)], axis=1)
    return np.abs(totals - goal[:, None]).argmin(axis=1) / BINS - 1.0


@dataclass
class Mix:
    """``chosen``: ``doc_id, source, n_tokens, repeats, domains``; the order of the domains is ``sources``."""

    chosen: DataFrame
    sources: list[str]
    classifier: Classifier | None = None
    #: Expected shares of the fitted rates, soft and hard, and the size as a part of what the caps allow.
    expected: np.ndarray | None = None
    part: float = 1.0


def fit_mix(
    documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, most_steps: int | None = None, sample: int = SAMPLE
) -> Mix:
    """Fit classifier and rates and choose the documents; ``most_steps`` stops the least squares early.

    The mix is as large as the caps allow its domains to be met.  Targets with a null source, a weight or cap that
    isn't positive, or no usable document get nothing; the others keep their proportions.  A source that occurs twice
    has the sum of its weights and the largest of its caps.  Repeated documents are documents of their own; a document
    with a null id is mixed like others.  Null and empty texts can't be mixed.  Without any usable document or target
    the result is empty.
    """
    wanted = targets.where((F.col("weight") > 0) & (F.col("max_repeat") > 0) & F.col("source").isNotNull())
    rows = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("cap")).collect()
    rows.sort(key=lambda r: r.source)  # one row per target
    sources = [r.source for r in rows]
    usable = documents.where(F.col("source").isin(sources) & (F.length("text") > 0)).select("doc_id", "source", "text")
    tokens = _Tokens(documents, tokenizer)
    given = np.array([float(r.weight) for r in rows])
    model = fit_classifier(usable, sources, given, tokens, sample)
    members = cut(memberships(usable, model, tokens))
    supply = {r.source: float(r.n) for r in members.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    if not supply:
        return Mix(members.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"), "domains"), sources)
    weight = np.where([x in supply for x in sources], given, 0.0)
    weight = weight / weight.sum()
    caps = np.array([float(r.cap) for r in rows])
    tokens_of = np.array([supply.get(x, 1.0) for x in sources])
    rates = Rates(sources, weight, tokens_of, caps)
    used = weight > 0
    largest = ((caps * tokens_of)[used] / weight[used]).min()
    part, expected = _fit_size(members, rates, largest, most_steps)
    # Rates outside of what whole numbers can express are only rounded here.
    shift = _shifts(members, rates, expected[len(weight) :] * rates.size)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, rate = rates.of(batch)
            mark = rate + batch.column("u").to_numpy() + shift[at]
            repeats = np.clip(np.floor(mark), 0, rates.caps[at]).astype(np.int32)
            repeats = np.where(weight[at] > 0, repeats, 0).astype(np.int32)
            names = ["doc_id", "source", "n_tokens", "repeats", "domains"]
            columns = [batch.column(x) for x in names[:3]] + [pa.array(repeats), batch.column("domains")]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(repeats > 0))

    ddl = "doc_id long, source string, n_tokens long, repeats int, domains array<float>"
    return Mix(members.mapInArrow(emit, ddl), sources, model, expected, part)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, most_steps: int | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of the chosen documents; see ``fit_mix``."""
    return fit_mix(documents, targets, tokenizer, most_steps).chosen.drop("domains")


def shares(found: Mix, targets: DataFrame) -> DataFrame:
    """``source, weight, share, soft_share, n_tokens, n_documents, most_repeats`` of a mix, for every target.

    share is the actual one in the total size, soft_share that of the domain by the posteriors of the chosen documents;
    0 for a source without documents, null for all if the mix is empty.
    """
    names = F.array(*[F.lit(x) for x in found.sources]) if found.sources else F.array().cast("array<string>")
    size = F.col("n_tokens") * F.col("repeats")
    parts = found.chosen.select("source", "n_tokens", "repeats", F.explode(F.arrays_zip(names.alias("name"), F.col("domains").alias("p"))).alias("d"))
    own = F.col("d.name") == F.col("source")
    sums = parts.groupBy(F.col("d.name").alias("source")).agg(
        F.sum(F.when(own, size)).alias("n_tokens"),
        F.count_if(own).alias("n_documents"),
        F.max(F.when(own, F.col("repeats"))).alias("most_repeats"),
        F.sum(size * F.col("d.p")).alias("_soft"),
    )
    total = sums.agg(F.sum("n_tokens").alias("n")).scalar()
    known = targets.where(F.col("source").isNotNull()).select("source", "weight")
    counted = known.join(sums, "source", "left").na.fill(0, ["n_tokens", "n_documents", "most_repeats", "_soft"])
    return counted.select(
        "source", "weight", (F.col("n_tokens") / total).alias("share"), (F.col("_soft") / total).alias("soft_share"),
        "n_tokens", "n_documents", "most_repeats",
    )
