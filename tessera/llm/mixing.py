"""Mixing sources to target weights by soft membership.

A classifier fitted on the labels table gives each document posteriors over domains, p_dk. With t_d tokens and rate r_d, domain
k is expected to get sum_d r_d t_d p_dk tokens; rates minimise the squared distance of these totals to the targets, by
projected gradient over all documents. With e = totals - targets, M = sum_d t_d p_d p_d' and distances taken in the norm of
the inverse of M, the step is r_d <- max(y_d - p_d . M^-1 e, 0). Its Lipschitz constant is 1 by construction; y_d is r_d with the
momentum of the last step (accelerated projected gradient), which begins anew where it points uphill. Rates have no upper bound
unless a caller gives one; what is left between totals and targets is logged. A step needs a few sums of one pass over a narrow
table, and a document's rate follows from its posteriors and the K-vectors of the steps so far, so no state is kept for documents
between passes, and a lost executor costs the part of one pass.
"""

from __future__ import annotations

import logging
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, narrow

#: The bounded sample of labelled documents that the classifier is fitted on.
LABELLED = 6_000
FEATURES = 1 << 18
#: Passes over the sample, more of them where it is so small that they would make fewer than UPDATES steps.
EPOCHS, UPDATES, MEMO = 12, 800, 200_000
#: Weight of the prior of the classifier's weights, against one document.
RIDGE = 0.4
DOMAINS = ("high", "low", "toxic")
LOG = logging.getLogger(__name__)
#: Fixed-point steps at most, and the change of the totals, against all tokens, that ends them. Damping, against M's diagonal.
STEPS, ENOUGH, DAMP = 60, 1e-5, 0.02


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = zlib.crc32(word.strip(b".,;:!?\"'()*#$%&|")) % FEATURES
        return h


def _words(text: bytes | None, memo: dict) -> tuple[int, np.ndarray]:
    """The number of words and the distinct features; case and punctuation at the ends don't count."""
    words = text.lower().split() if text else []
    return len(words), np.unique(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))


class Domains:
    """Multinomial logistic regression over hashed words that occur in a text."""

    def __init__(self, names: tuple[str, ...] = DOMAINS) -> None:
        self.names = names
        self.w = np.zeros((FEATURES, len(names)), np.float32)
        self.b = np.zeros(len(names), np.float32)

    def fit(self, rows: list[np.ndarray], labels: list[int], seed: int = 3) -> Domains:
        rng = np.random.default_rng(seed)
        seen = np.bincount(np.concatenate(rows), minlength=FEATURES) if rows else np.zeros(FEATURES, int)
        rows = [r[seen[r] >= 3] for r in rows]  # words of one or two documents tell nothing of others
        y = np.array(labels)
        share = np.bincount(y, minlength=len(self.names)) + 1.0
        self.b[:] = np.log(share / share.sum())
        scale = np.full(FEATURES, 1e-6, np.float32)
        for _ in range(max(EPOCHS, -(-UPDATES * 32 // max(len(rows), 1)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 32):
                part = order[at : at + 32]
                d = self._posteriors([rows[i] for i in part])
                d[np.arange(len(part)), y[part]] -= 1
                size = [len(rows[i]) for i in part]
                who, what = np.repeat(np.arange(len(part)), size), np.concatenate([rows[i] for i in part]).astype(np.int64)
                used, back = np.unique(what, return_inverse=True)
                g = np.stack([np.bincount(back, d[who, k], len(used)) for k in range(len(self.names))], 1) / len(part)
                g += RIDGE / len(rows) * self.w[used]
                scale[used] += (g**2).sum(1)
                self.w[used] -= 0.15 * g / np.sqrt(scale[used])[:, None]
                self.b -= 0.02 * d.mean(0)
        return self

    def _posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        logits = np.stack([self.w[r].sum(0) for r in rows]).astype(np.float64) + self.b
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)

    def posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._posteriors(rows) if rows else np.zeros((0, len(self.names)))


def fit_domains(docs: DataFrame, labels: DataFrame) -> Domains:
    """The classifier from labels(doc_id, quality, toxic): toxic is a domain, the rest are high or low by quality.

    At most LABELLED labelled documents are used, those whose hashes come first; rows with a null label are passed over. Without
    labelled rows every document has even posteriors.
    """
    marks = narrow(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and quality is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    rows = narrow(docs, doc_id="long", text="string").join(F.broadcast(marks), "doc_id").select("doc_id", domain.alias("domain"), "text")

    def run(batches):
        memo = _Memo()
        for batch in batches:
            feats = [_words(t, memo)[1] for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.list_(pa.int64()))], ["doc_id", "domain", "feats"])

    got = sorted(((r.doc_id, r.domain, r.feats) for r in rows.mapInArrow(run, "doc_id long, domain int, feats array<long>").collect()), key=lambda r: (r[0], r[1], r[2]))
    model = Domains()
    if not got:
        return model
    return model.fit([np.array(r[2], np.int64) for r in got], [r[1] for r in got])


def _memberships(model: Domains):
    def run(batches):
        memo = _Memo()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                got = [_words(t, memo) for t in part.column(1).cast(pa.binary()).to_pylist()]
                p = model.posteriors([x for _, x in got])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1]))], ["doc_id", "tokens", *(f"p_{n}" for n in model.names)])

    return run


def memberships(docs: DataFrame, model: Domains) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tokens, p_<domain>...): tokens are the words of the whole text."""
    schema = "doc_id long, tokens long, " + ", ".join(f"p_{n} double" for n in model.names)
    return narrow(docs, doc_id="long", text="string").mapInArrow(_memberships(model), schema)


def _walk(p: np.ndarray, steps: list[tuple[np.ndarray, float]], most: float, bounds=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rates of rows of posteriors after these steps (gradient, momentum after it), those before the last one, and the point it
    was taken from."""
    low, high = (0.0, most) if bounds is None else bounds(p)
    r = y = before = at = np.clip(np.ones(len(p)), low, high)
    for g, momentum in steps:
        before, at = r, y
        r = np.clip(y - p @ g, low, high)
        y = r + momentum * (r - before) if momentum else r
    return r, before, at


def rates(p: np.ndarray, steps: list[tuple[np.ndarray, float]], most: float, bounds=None) -> np.ndarray:
    """The rate of each row of posteriors after these steps; all begin at 1. bounds: a function of p that gives each row's, instead."""
    return _walk(p, steps, most, bounds)[0]


def fit_rates(members: DataFrame, names: tuple[str, ...], targets: dict[str, float] | None = None, budget: float | None = None, most: float = math.inf, totals: dict[str, float] | None = None, bounds=None) -> list[tuple[np.ndarray, float]]:
    """The steps: K-vectors, each with the momentum after it. targets: shares of `budget` tokens (all tokens there are, if None); totals: tokens, instead.

    The totals reached, the goals and their differences go to the log, as a warning where they miss by over a thousandth of all tokens.
    """
    k = len(names)
    at = ["tokens", *(f"p_{n}" for n in names)]
    names_of_sums = [f"s{i}" for i in range(2 * k + 1 + k * k)]

    def sums(steps: list[tuple[np.ndarray, float]]):
        """Totals of the rates and of the rates before, how far the last step went against its momentum, and M at first."""

        def run(batches):
            first, last, uphill, second = np.zeros(k), np.zeros(k), 0.0, np.zeros((k, k))
            for batch in batches:
                t, *p = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in at)
                p = np.stack(p, 1)
                tp = p * t[:, None]
                r, before, at_ = _walk(p, steps, most, bounds)
                first += r @ tp
                last += before @ tp
                uphill += ((at_ - r) * (r - before)) @ t
                if not steps:
                    second += p.T @ tp
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*first, *last, uphill, *second.ravel())], names_of_sums)

        row = members.select(*at).mapInArrow(run, ", ".join(f"{n} double" for n in names_of_sums)).agg(*[F.sum(n).alias(n) for n in names_of_sums]).first()
        out = np.array([x or 0.0 for x in row])
        return out[:k], out[k : 2 * k], out[2 * k], out[2 * k + 1 :].reshape(k, k)

    now, _, _, m = sums([])
    everything = now.sum()
    if everything <= 0:
        return []
    if totals is not None:
        goal = np.array([totals.get(n, x) for n, x in zip(names, now, strict=True)], float)
    else:
        goal = np.array([targets.get(n, 0.0) for n in names], float)
        goal *= (everything if budget is None else budget) / max(goal.sum(), 1e-12)
    # Against the diagonal, so that a domain of few tokens gets near its goal in as many steps as a large one.
    inverse = np.linalg.inv(m + np.diag(DAMP * np.diag(m) + 1e-9 * everything))
    steps: list[tuple[np.ndarray, float]] = []
    ahead, speed = now, 1.0  # the totals at the point that the next step is taken from
    for _ in range(STEPS):
        steps.append((inverse @ (ahead - goal), 0.0))
        new, before, uphill, _ = sums(steps)
        done = np.abs(new - now).max() <= ENOUGH * everything or np.abs(new - goal).max() <= ENOUGH * everything
        now = new
        if done:
            break
        last, speed = (1.0, 1.0) if uphill > 0 else (speed, (1 + math.sqrt(1 + 4 * speed * speed)) / 2)
        momentum = (last - 1) / speed
        steps[-1] = (steps[-1][0], momentum)
        ahead = new + momentum * (new - before)
    level = logging.WARNING if np.abs(now - goal).max() > 1e-3 * everything else logging.INFO
    for name, got, want in zip(names, now, goal, strict=True):
        LOG.log(level, "domain %s: %.0f expected tokens, goal %.0f, residual %.0f", name, got, want, got - want)
    return steps


def _copies(key: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Whole copies, rounded up with the probability of the fraction, by a hash of the document."""
    u = np.array([zlib.crc32(f"mix:{x}".encode()) for x in key]) / 2**32
    return np.floor(rate + u).astype(np.int64)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, most: float = math.inf) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tokens, p_<domain>..., rate, copies), a row for each input row.

    Null, empty and blank texts have no tokens and the posteriors of a text without known words. Null doc_ids and repeated rows
    stay. Extra columns are ignored; an empty table gives an empty one. Rates are 0 or more, without an upper bound by default
    (`most`); how far the totals are from the targets is logged.
    """
    model = fit_domains(docs, labels)
    members = materialize(memberships(docs, model), "members")
    steps = fit_rates(members, model.names, targets, budget, most)

    def run(batches):
        for batch in batches:
            p = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(model.names))], 1)
            r = rates(p, steps, most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(_copies(batch.column(0).to_pylist(), r), pa.int64())], [*batch.schema.names, "rate", "copies"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", rate double, copies long"
    return members.mapInArrow(run, schema)


def _strongest(p: np.ndarray, at: int) -> np.ndarray:
    """True for rows of posteriors whose strongest domain is that at `at`, alone."""
    return p[:, at] > np.delete(p, at, 1).max(1)


def _marked(docs: DataFrame, model: Domains) -> DataFrame:
    """docs with columns c0, c1, ..., then tokens and posteriors: one pass of the classifier, after which all read numbers alone."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = docs.columns.index("text")
    predict = _memberships(model)

    def mark(batches):
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                (got,) = predict([pa.RecordBatch.from_arrays([part.column(text), part.column(text)], ["doc_id", "text"])])
                yield pa.RecordBatch.from_arrays([*part.columns, *got.columns[1:]], [*part.schema.names, *got.schema.names[1:]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", tokens long, " + ", ".join(f"p_{n} double" for n in model.names)
    return materialize(plain.mapInArrow(mark, schema), "members")


def _repeated(docs: DataFrame, marked: DataFrame, names: tuple[str, ...], steps: list[tuple[np.ndarray, float]], most: float, bounds) -> DataFrame:
    """Rows of docs in as many copies as their rates say; rows that repeat have as many each."""
    columns, key = list(docs.columns), docs.columns.index("doc_id")
    k, own = len(names), list(range(len(docs.columns)))

    def keep(batches):
        for batch in batches:
            p = np.stack([batch.column(len(columns) + 1 + i).to_numpy(zero_copy_only=False) for i in range(k)], 1)
            copies = _copies(batch.column(key).to_pylist(), rates(p, steps, most, bounds))
            for i in range(copies.max(initial=0)):  # so that no batch is larger than what was read
                yield batch.filter(pa.array(copies > i)).select(own)

    plain = marked.select(*[f"c{i}" for i in own])
    return marked.mapInArrow(keep, plain.schema).toDF(*columns)


def _mine(names: tuple[str, ...], domain: str):
    return F.col(f"p_{domain}") > F.greatest(*[F.col(f"p_{n}") for n in names if n != domain])


def drop_domain(docs: DataFrame, labels: DataFrame, domain: str = "toxic", share: float = 0.0) -> DataFrame:
    """docs thinned so that documents of `domain` keep `share` of their tokens and the others theirs.

    A document is of the domain that has the largest posterior, of another one than `domain` where that is tied. The targets are
    the totals at which the others' rates are 1 and its own `share`; the projection bounds rates by these values from below for
    the others, from above for its own, so that no draw drops one of the others or, at a share of 0, keeps one of its own.
    Null, empty and blank texts have no tokens and the posteriors of a text without known words. Rows that repeat go or stay
    together; an empty table gives an empty one; extra columns come through, whatever their names.
    """
    model = fit_domains(docs, labels)
    at = model.names.index(domain)
    marked = _marked(docs, model)
    # What the classifier's doubts give to each domain stays: the totals aimed at are those of the documents of other domains.
    part = F.when(_mine(model.names, domain), share).otherwise(1.0) * F.col("tokens")
    goal = marked.agg(*[F.sum(part * F.col(f"p_{n}")).alias(n) for n in model.names]).first().asDict()

    def bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _strongest(p, at)
        return np.where(own, 0.0, 1.0), np.where(own, share, 1.0)

    steps = fit_rates(marked, model.names, totals={n: x or 0.0 for n, x in goal.items()}, bounds=bounds)
    return _repeated(docs, marked, model.names, steps, 1.0, bounds)


def mix_without(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "toxic") -> DataFrame:
    """docs without those of `domain`, the others repeated so that their tokens have the target shares over the other domains.

    A document is of the domain that has the largest posterior, of another one than `domain` where that is tied. The rates of its
    own are 0, those of the others 1 or more, so none of the others goes. The totals aimed at are the smallest ones of these shares
    at which no domain of the others shrinks; a domain that is no document's strongest one can't be raised and has no share, and what
    the others' posteriors give to `domain` stays as it is. No rate is above the largest factor by which a domain has to grow: a
    domain whose posteriors are spread over documents of others may stay below its total. A document comes in whole copies, rounded up or down by a hash of its id; how far the totals are from their goals is
    logged. Null, empty and blank texts have no tokens and the posteriors of a text without known words. Rows that repeat go or
    stay together; an empty table gives an empty one; extra columns come through, whatever their names.
    """
    model = fit_domains(docs, labels)
    at = model.names.index(domain)
    marked = _marked(docs, model)
    part = F.when(_mine(model.names, domain), 0.0).otherwise(1.0) * F.col("tokens")
    sums = [F.sum(part * F.col(f"p_{n}")).alias(n) for n in model.names] + [F.max(_mine(model.names, n) & (F.col("tokens") > 0)).alias(f"any_{n}") for n in model.names]
    row = marked.agg(*sums).first()
    now = {n: row[n] or 0.0 for n in model.names}
    wanted = {n: targets[n] for n in model.names if n != domain and targets.get(n, 0) > 0 and row[f"any_{n}"]}
    size = max((now[n] / x for n, x in wanted.items()), default=0.0)
    most = max([1.0, *(size * x / now[n] for n, x in wanted.items())])

    def bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _strongest(p, at)
        return np.where(own, 0.0, 1.0), np.where(own, 0.0, most)

    steps = fit_rates(marked, model.names, totals=now | {n: size * x for n, x in wanted.items()}, bounds=bounds)
    return _repeated(docs, marked, model.names, steps, most, bounds)
