"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import LOWER, U64, slices, span_hashes

#: Bits of a term's hash, terms that the machine holds, factors of a term, bytes of the word beginnings that are terms too.
BITS, TERMS, FACTORS, BEGINNINGS = 32, 2_048, 4, (4, 5)
#: Labelled documents of each class that training reads, drawn by hash; documents of those that a learned term must be in.
SAMPLE_DOCS, LEAST_DOCS = 4_000, 5
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def terms(data: np.ndarray, ends: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct terms as sorted hashes, or of those the ones in the sorted array `among`, and the bounds of the
    texts. A word is a run of letters, a-z or any byte over 127, in lower case; terms are words and their beginnings."""
    data = LOWER[data]
    n = len(data)
    full = np.zeros(n + 1, bool)
    full[:n] = LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.concatenate([[False], full[:-1]])
    starts, stops = np.flatnonzero(full & (~before | edge)), np.flatnonzero(before & (~full | edge))
    of = np.searchsorted(ends, starts, "right") - 1
    keys, owners = [span_hashes(data, starts, stops)], [of]
    for k in BEGINNINGS:
        long = stops - starts > k
        keys.append(span_hashes(data, starts[long], starts[long] + k))
        owners.append(of[long])
    key, owner = np.concatenate(keys) >> U64(64 - BITS), np.concatenate(owners).astype(U64)
    if among is not None:
        hint = np.zeros(1 << 16, bool)
        hint[among & U64(0xFFFF)] = True
        near = np.flatnonzero(hint[key & U64(0xFFFF)])
        key, owner = key[near], owner[near]
        at = np.minimum(np.searchsorted(among, key), max(len(among) - 1, 0))
        hit = among[at] == key if len(among) else np.zeros(len(key), bool)
        key, owner = key[hit], owner[hit]
    both = np.unique(owner << U64(BITS) | key)
    return both & U64((1 << BITS) - 1), np.searchsorted(both >> U64(BITS), np.arange(len(ends)).astype(U64))


@dataclass
class Machine:
    """score = sigmoid(bias + sum of w over the terms + sum over pairs of terms of their factors' products)."""

    bias: float
    keys: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key, bounds = terms(data, ends, self.keys)
        x = np.searchsorted(self.keys, key)
        sums = np.zeros((len(bounds) - 1, FACTORS + 2))
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            v = self.v[x]
            each = np.concatenate([self.w[x][:, None], (v * v).sum(axis=1, keepdims=True), v], axis=1)
            sums[full] = np.add.reduceat(each, bounds[:-1][full], axis=0)
        z = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(axis=1) - sums[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(sample: DataFrame, count: int = TERMS) -> np.ndarray:
    """The `count` terms of a sample (toxic, terms), in at least LEAST_DOCS documents, whose presence tells most about the
    label (likelihood ratio). Terms are counted where they are; only those chosen come to the driver."""
    toxic = F.col("toxic") > 0
    total = sample.agg(F.count(F.lit(1)).cast("double").alias("many"), F.count_if(toxic).cast("double").alias("bad")).first()
    many, bad = F.lit(total["many"]), F.lit(total["bad"])
    each = sample.select(toxic.alias("toxic"), F.explode("terms").alias("term")).groupBy("term").agg(F.count_if("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    a, n = F.col("a"), F.col("n")
    part = lambda o, e: F.when(o > 0, o * F.ln(F.greatest(o, F.lit(1e-9)) / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)
    tells = part(a, n * bad / many) + part(n - a, n * (many - bad) / many) + part(bad - a, (many - n) * bad / many) + part(many - bad - n + a, (many - n) * (many - bad) / many)
    best = each.where(n >= LEAST_DOCS).select("term", tells.alias("tells")).orderBy(F.desc("tells"), "term").limit(count)
    return np.sort(np.array([r.term for r in best.select("term").collect()], np.int64)).astype(U64)


def train(keys: np.ndarray, docs: list[np.ndarray], y: np.ndarray, weights: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.1, sparse: float = 2e-4, seed: int = 3) -> Machine:
    """AdaGrad on the weighted logistic loss, with an L1 penalty on the linear weights. docs: of each document its terms, as
    places in the sorted array keys."""
    m, rng = len(keys), np.random.default_rng(seed)
    theta = np.zeros((m, FACTORS + 1))
    theta[:, 1:] = rng.normal(0, 0.01, (m, FACTORS))
    prior = float(np.clip((weights * y).sum() / max(weights.sum(), 1e-9), 1e-3, 1 - 1e-3))
    bias, heat, bias_heat = float(np.log(prior / (1 - prior))), np.full((m, FACTORS + 1), 1e-3), 1e-1
    rows = [d.astype(np.int64) for d in docs]
    for _ in range(epochs if m else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = np.concatenate([rows[k] for k in pick])
            of = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
            t = theta[x]
            total = np.stack([np.bincount(of, t[:, f], len(pick)) for f in range(FACTORS + 1)], axis=1)
            square = np.bincount(of, (t[:, 1:] ** 2).sum(axis=1), len(pick))
            z = bias + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weights[pick] / len(pick)
            each = np.concatenate([g[of, None], g[of, None] * (total[of, 1:] - t[:, 1:])], axis=1)
            grad = np.stack([np.bincount(x, each[:, f], m) for f in range(FACTORS + 1)], axis=1)
            grad[:, 1:] += sparse * theta[:, 1:]
            heat += grad * grad
            step = rate / np.sqrt(heat)
            theta -= step * grad
            theta[:, 0] = np.sign(theta[:, 0]) * np.maximum(np.abs(theta[:, 0]) - step[:, 0] * sparse, 0)
            bias_heat += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_heat)
    return Machine(float(bias), keys, theta[:, 0], theta[:, 1:])


def fitted(docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE_DOCS) -> Machine | None:
    """Learns from at most about per_class labelled documents of each class for which `learn` holds; classes are weighed back
    to their shares. Terms are made and chosen where the documents are; of a document only its places among the chosen ones
    come to the driver, TERMS at most. Where a document has several labels the highest counts; null labels and ids don't. None
    where nothing is labelled."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learn)
    counts = {r[0]: r[1] for r in marks.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    if not counts:
        return None
    rate = F.when(F.col("toxic") > 0, F.lit(min(1.0, per_class / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, per_class / max(counts.get(0, 0), 1))))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30) < rate)
    rows = docs.select("doc_id", "text").join(common.broadcast_if_small(common.settled(drawn), 4 * per_class), "doc_id").select("doc_id", "toxic", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, ends in slices(b, "text"):
                x, bounds = terms(data, ends)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int64)))], ["doc_id", "toxic", "terms"])

    sample = common.settled(rows.mapInArrow(gather, "doc_id long, toxic int, terms array<long>"))
    keys = telling(sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(2).to_pylist():
                x = np.array(x, np.int64).astype(U64)
                at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
                found.append((at[keys[at] == x] if len(keys) else at[:0]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "places"])

    got = sample.mapInArrow(place, "doc_id long, toxic int, places binary").toArrow().sort_by([("doc_id", "ascending"), ("places", "ascending")])
    y = (got.column("toxic").to_numpy() > 0).astype(np.float64)
    if not len(y):
        return None
    share = [counts.get(k, 0) / max((y == k).sum(), 1) for k in (0, 1)]
    weights = np.where(y > 0, share[1], share[0])
    return train(keys, [np.frombuffer(t, np.uint16) for t in got.column("places").to_pylist()], y, weights / weights.mean())


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score: the machine over every term of the whole text. A null or empty text has no terms and gets the bias's
    score; 0 for all where nothing was learned. Rows repeat as they come; an empty table gives no rows."""
    rows = docs.select("doc_id", "text")
    if machine is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, ends in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(machine.scores(data, ends), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(read, "doc_id long, score double")


def learnable(doc_id):
    return F.pmod(common.crc_of_id(doc_id), F.lit(5)) != 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op10's contract: learns where crc32 of the id, mod 5, is not 0, and scores all."""
    out = scored(docs, fitted(docs, labels, learnable(F.col("doc_id"))))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    machine = fitted(docs, labels, F.lit(True))
    if machine is None:
        return docs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, ends in slices(b, "text"):
                yield part.filter(pa.array(machine.scores(data, ends) < 0.5))

    return docs.mapInArrow(read, docs.schema)
