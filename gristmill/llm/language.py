"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import LOWER, slices

#: Bytes of a window, filter widths, filters of each width, dimensions of a byte's embedding.
WINDOW, WIDTHS, FILTERS, DIMENSIONS = 256, (2, 3, 4), 12, 8
#: Documents of each language, snippets of a document and characters of a snippet that training reads.
SAMPLE_DOCS, SNIPPETS, SNIPPET_CHARS = 1_500, 2, 300
UNKNOWN = "und"
SLICE = 1 << 18


@dataclass
class Net:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]


def windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of each text in windows of WINDOW bytes, the last padded with spaces: windows, their text, their bytes."""
    n = np.diff(ends)
    count = np.maximum(1, -(-n // WINDOW))
    of = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start, held = ends[of] + k * WINDOW, np.minimum(WINDOW, n[of] - k * WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    if not len(data):
        return np.full(at.shape, 32, np.uint8), of, held
    return np.where(inside, LOWER[data][np.minimum(at, len(data) - 1)], 32).astype(np.uint8), of, held


def train(texts: list[str], labels: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Net:
    """Adam on the cross-entropy of each window's language."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    x, of, held = windows(np.frombuffer(b"".join(raw), np.uint8), ends)
    y = np.array([languages.index(v) for v in labels])[of]
    x, y = x[held >= 16], y[held >= 16]
    if not len(x):
        x, y = windows(np.frombuffer(b"".join(raw), np.uint8), ends)[0], np.array([languages.index(v) for v in labels])[of]
    normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    net = Net(languages, normal(256, DIMENSIONS) * 0.5, [normal(w * DIMENSIONS, FILTERS) / np.sqrt(w * DIMENSIONS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(languages)) * 0.1, np.zeros(len(languages), np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            b, t = x[order[i : i + batch]], y[order[i : i + batch]]
            m = len(b)
            e = net.embedding[b]
            pooled, best, seen = [], [], []
            for w, f, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
                stacked = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
                c = stacked.reshape(-1, w * DIMENSIONS) @ f
                c = c.reshape(m, -1, FILTERS) + bias
                a = c.argmax(axis=1)
                pooled.append(np.maximum(np.take_along_axis(c, a[:, None], 1)[:, 0], 0))
                best.append(a)
                seen.append(stacked)
            h = np.concatenate(pooled, axis=1)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(m), t] -= 1
            p /= m
            dh = (p @ net.out.T) * (h > 0)
            de = np.zeros_like(net.embedding)
            dfs, dbs = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                won = np.take_along_axis(seen[k], best[k][:, :, None], 1)
                dfs.append(np.einsum("mfd,mf->df", won, g))
                dbs.append(g.sum(axis=0))
                back = (g[:, :, None] * f.T[None]).reshape(m, FILTERS, w, DIMENSIONS)
                at = b[np.arange(m)[:, None, None], best[k][:, :, None] + np.arange(w)]
                np.add.at(de, at.reshape(-1), back.reshape(-1, DIMENSIONS))
            step += 1
            for q, g, (m1, m2) in zip(net.parts(), [de, *dfs, *dbs, h.T @ p, p.sum(axis=0)], moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """Applies a net. A filter's response is a sum of table entries, one for each pair of bytes and for an odd last byte."""

    def __init__(self, net: Net):
        self.net, self.tables = net, []
        for w, f in zip(WIDTHS, net.filters, strict=True):
            one = [net.embedding @ f[j * DIMENSIONS : (j + 1) * DIMENSIONS] for j in range(w)]
            own = [(j, (one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS), True) for j in range(0, w - 1, 2)]
            self.tables.append(own + ([(w - 1, one[w - 1], False)] if w % 2 else []))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        pooled = []
        for w, own, bias in zip(WIDTHS, self.tables, self.net.biases, strict=True):
            total, n = None, WINDOW - w + 1
            for j, t, pair in own:
                c = np.take(t, (pairs if pair else x)[:, j : j + n], axis=0)
                total = c if total is None else np.add(total, c, out=total)
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        z = np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, learn, per_language: int = SAMPLE_DOCS) -> list:
    """(lang, text) of snippets: about per_language documents of each language, drawn by hash, at places drawn by hash."""
    has = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in has.groupBy("lang").count().collect()}
    rate = F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, min(1.0, per_language / v))]) if counts else F.create_map().cast("map<string,double>")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - SNIPPET_CHARS, F.lit(0)) + 1).cast("int") + 1
    snippets = F.array(*[F.substring("text", at(k), F.lit(SNIPPET_CHARS)) for k in range(SNIPPETS)])
    return has.where(draw < F.element_at(rate, F.col("lang"))).select("lang", F.explode(snippets).alias("text")).orderBy("lang", "text").collect()


def fitted(docs: DataFrame, learn) -> Net | None:
    rows = sample(docs, learn)
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def predicted(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred, score: every byte of the text is read, in windows; the windows' probabilities are averaged by their
    bytes. A text that is null or has no letter is `und` with score 0, as is any where no language was learned. Rows repeat
    as they come; an empty table gives no rows."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            for part, data, ends in slices(batch, "text", SLICE):
                total = np.zeros((part.num_rows, len(net.languages)))
                weight = np.zeros(part.num_rows)
                x, of, held = windows(data, ends)
                for i in range(0, len(x), SLICE // WINDOW):
                    p, k, h = reader.probabilities(x[i : i + SLICE // WINDOW]), of[i : i + SLICE // WINDOW], held[i : i + SLICE // WINDOW]
                    np.add.at(total, k, p * h[:, None])
                    np.add.at(weight, k, h)
                total /= np.maximum(weight, 1)[:, None]
                known = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                best = total.argmax(axis=1)
                lang = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(total.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(read, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """op2's contract: learns where crc32 of the id, mod 4, is not 2, and predicts for all."""
    held = F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    named = docs.select("doc_id", "text", "lang")
    return predicted(named, fitted(named, ~held)).select("doc_id", (F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")
