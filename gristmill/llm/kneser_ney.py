"""Language-model scoring: an interpolated modified Kneser-Ney model of any order, counted in Spark, kept as sorted hash arrays."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import U64, mix, slices, words

#: Words of an n-gram, unless a caller says otherwise; README tells what a higher order takes.
ORDER = 2
#: Bytes of text for each shard of the model; tokens that a task counts before it hands counts on; documents of the sample that
#: tells frequent words, and the share of tokens that makes a word frequent (no more than 1 / SHARE words can be).
SHARD_BYTES, FLUSH_TOKENS, SAMPLE_DOCS, SHARE = 16 << 20, 1_500_000, 2_000, 2e-4
#: A word is the upper 48 bits of its hash; the document's begin and end have ids of their own.
ID_BITS = 48
BEGIN, END = U64(1), U64(2)
SCORE_SLICE = 4 << 20
#: Tables of shards that a task keeps mapped at once; each holds up to two open files.
MAPPED = 128


def six(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def pack(*arrays: np.ndarray) -> bytes:
    """Ids (uint64) in six bytes each, counts in as few bytes as the largest needs, compressed: they are mostly small."""
    out = []
    for a in arrays:
        if a.dtype == np.uint64:
            raw, kind = six(a), b"i"
        else:
            t = next(t for t in ("u1", "u2", "u4", "u8") if not len(a) or a.max() < 1 << 8 * int(t[1]))
            raw, kind = a.astype("<" + t).tobytes(), t[1].encode()
        body = pa.compress(raw, "zstd", asbytes=True)
        out.append(kind + len(raw).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpack(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(b):
        kind, n, m = b[at : at + 1], int.from_bytes(b[at + 1 : at + 9], "little"), int.from_bytes(b[at + 9 : at + 17], "little")
        raw = pa.decompress(b[at + 17 : at + 17 + m], n, "zstd", asbytes=True)
        out.append(from_six(raw) if kind == b"i" else np.frombuffer(raw, f"<u{int(kind)}").astype(np.int64))
        at += 17 + m
    return out


def chain(data: np.ndarray, ends: np.ndarray, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of the texts, a column a place, the last one the tokens: each text's words and its end. Before its first word
    come begins. Also each text's bounds."""
    h, first = words(data, ends)
    ids = np.maximum(h >> U64(64 - ID_BITS), U64(3))
    n = np.diff(first)
    bounds = first + np.arange(len(first))
    token = np.full(len(ids) + len(n), END, U64)
    token[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    place = np.arange(len(token)) - np.repeat(bounds[:-1], n + 1)
    back = lambda j: np.where(place >= j, token[np.maximum(np.arange(len(token)) - j, 0)], BEGIN)
    return [*(back(j) for j in range(order - 1, 0, -1)), token], bounds


def key_of(ids: list[np.ndarray]) -> np.ndarray:
    key = ids[0]
    for x in ids[1:]:
        key = mix(key * U64(0x9E3779B97F4A7C15) + x)
    return key


def shard_of(ids: list[np.ndarray], key: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """An n-gram lies in the shard of the word before its last; if that is frequent, in one drawn by the n-gram itself. A word
    lies in its own."""
    if len(ids) == 1:
        return (mix(ids[0]) % U64(shards)).astype(np.int64)
    before = ids[-2]
    own = mix(before) % U64(shards)
    at = np.minimum(np.searchsorted(frequent, before), max(len(frequent) - 1, 0))
    hot = frequent[at] == before if len(frequent) else np.zeros(len(before), bool)
    return np.where(hot, key % U64(shards), own).astype(np.int64)


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys starts."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def summed(ids: list[np.ndarray], *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in the order of their keys: keys, ids, and the sums of their values."""
    key = key_of(ids)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = starts_of(key)
    return key[start], [c[order[start]] for c in ids], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def lower_grams(ids: list[np.ndarray], count: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """What distinct n-grams tell of those a word shorter: keys, ids, and of each its distinct words before, its occurrences,
    and as a context the sum of counts and how many successors have a count of one, two, three or more."""
    one, none, met = np.ones(len(count), np.int64), np.zeros(len(count), np.int64), count > 0
    context = [none, none, count, (count == 1) * one, (count == 2) * one, (count >= 3) * one]
    suffix = [one[met], raw[met], *[none[met]] * 4]
    shorter = [np.concatenate([a, b[met]]) for a, b in zip(ids[:-1], ids[1:], strict=True)]
    return summed(shorter, *(np.concatenate(x) for x in zip(context, suffix, strict=True)))


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Writes arrays to a shared folder. A task that is run again writes the same content, and a file appears whole or not."""
    for k, a in arrays.items():
        path = f"{folder}/{name}.{k}"
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        a.tofile(part)
        os.replace(part, path)


def mapped(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    path = f"{folder}/{name}.{kind}"
    return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)


class Tables:
    """The sorted tables of a kind of shard, mapped when they are asked for; only the last MAPPED stay mapped."""

    def __init__(self, read):
        self.read, self.held = read, OrderedDict()

    def __getitem__(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s in self.held:
            self.held.move_to_end(s)
        else:
            self.held[s] = self.read(s)
            if len(self.held) > MAPPED:
                self.held.popitem(last=False)
        return self.held[s]


def parted(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and the places where it does, in order."""
    order = np.argsort(shard, kind="stable")
    edges = np.append(starts_of(shard[order]), len(shard))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(shard[order[low]]), order[low:high]


#: Figures of an n-gram that is a context too: distinct words before it, occurrences, and four as a context.
FIGURES = 6


def table_name(k: int) -> str:
    return {1: "words", 2: "pairs"}.get(k, f"grams{k}")


@dataclass
class Model:
    """folder: where the shards are; frequent: words whose n-grams are spread over shards; totals, and discounts by length."""

    folder: str
    order: int
    shards: int
    frequent: np.ndarray
    tokens: int
    distinct: int
    continued: int
    discounts: dict[int, tuple[float, float, float]]
    level: float

    @property
    def d1(self) -> tuple[float, float, float]:
        return self.discounts[1]

    @property
    def d2(self) -> tuple[float, float, float]:
        return self.discounts[2]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts; where those are too few to tell, 0.5 of a count."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    found = [k - (k + 1) * y * b / a if a and y else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in enumerate(found, 1))


def discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.where(count >= 3, d[2], np.where(count == 2, d[1], d[0])), 0)


def frequent_words(docs: DataFrame, n: int) -> np.ndarray:
    """Ids of words that make up SHARE of the tokens of a sample drawn by hash; it decides where bigrams are counted, no result."""
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, ends in slices(batch, "text"):
                (before, _), _ = chain(data, ends, 2)
                key, _, (c,) = summed([before], np.ones(len(before), np.int64))
                keep = c >= SHARE / 2 * c.sum()
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].astype(np.int64)), pa.array(c[keep]), pa.array(np.full(keep.sum(), c.sum()))], ["word", "c", "n"])

    found = drawn.mapInArrow(count, "word long, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).where(F.col("c") >= SHARE * F.col("n"))
    top = found.orderBy(F.desc("c"), "word").limit(int(2 / SHARE)).toPandas()["word"].to_numpy()
    return np.unique(np.concatenate([top.astype(np.uint64), [BEGIN]])).astype(np.uint64)


def fitted(docs: DataFrame, folder: str, order: int = ORDER) -> Model:
    """Counts every n-gram of `order` words (2 or more) of docs' whole texts and writes the model to a folder that all
    executors share.

    Tasks count the n-grams they read, and hand on distinct ones by shard, as packed arrays. Each shard merges its parts and
    keeps its n-grams as sorted hashes with their counts. What it knows of those a word shorter (successors of a context by
    their count, distinct words before a suffix, occurrences) goes on, pre-summed, to the shards of those, and so down to words."""
    if order < 2:
        raise ValueError("a model's order is 2 or more")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(1, -(-(size[1] or 0) // SHARD_BYTES))
    frequent = frequent_words(docs, size[0])

    def by_shard(key: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[int, bytes]]:
        if len(ids) > 1:  # equal words before the last next to each other pack better
            near = np.argsort(ids[-2], kind="stable")
            key, ids, values = key[near], [c[near] for c in ids], [v[near] for v in values]
        return [(s, pack(*(c[at] for c in (*ids, *values)))) for s, at in parted(shard_of(ids, key, frequent, shards))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            found = by_shard(*summed([np.concatenate(c) for c in zip(*held, strict=True)], np.ones(n, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["shard", "part"])

        for batch in batches:
            for _, data, ends in slices(batch, "text"):
                grams, _ = chain(data, ends, order)
                held.append(grams)
                n += len(grams[0])
                if n >= FLUSH_TOKENS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merged(group: pd.DataFrame, k: int) -> tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        parts = [unpack(b) for b in group["part"]]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return int(group["shard"].iloc[0]), *summed(columns[:k], *columns[k:])

    def merge(k: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            s, key, ids, figures = merged(group, k)
            c, raw = figures[0], figures[0 if k == order else 1]
            kept = np.stack(figures, axis=1)
            wide = len(kept) and int(kept.max()) >= 1 << 32
            save(folder, f"{table_name(k)}-{s}", keys=key, **({"counts8": kept.astype("<u8")} if wide else {"counts": kept.astype("<u4")}))
            stats = [int((c == j).sum()) for j in (1, 2, 3, 4)]
            return pd.DataFrame([(x, b, 0, 0, 0, 0) for x, b in by_shard(*lower_grams(ids, c, raw))] + [(-1, b"", *stats)], columns=["shard", "part", "n1", "n2", "n3", "n4"])

        return run

    def merge_words(group: pd.DataFrame) -> pd.DataFrame:
        s, word, _, figures = merged(group, 1)
        save(folder, f"words-{s}", keys=word, figures=np.stack(figures, axis=1).astype("<i8"))
        met, raw = figures[:2]
        return pd.DataFrame([(int(raw.sum()), int((raw > 0).sum()), int(met.sum()), *(int((met == k).sum()) for k in (1, 2, 3, 4)), int((met >= 3).sum()))], columns=["tokens", "distinct", "continued", "m1", "m2", "m3", "m4", "m3p"])

    found, d = docs.mapInArrow(count, "shard long, part binary"), {}
    for k in range(order, 1, -1):
        held = common.settled(found.groupBy("shard").applyInPandas(merge(k), "shard long, part binary, n1 long, n2 long, n3 long, n4 long"))
        n = held.where("shard < 0").agg(*[F.sum(f"n{j}") for j in (1, 2, 3, 4)]).first()
        d[k] = discounts(*(float(x or 0) for x in n))
        found = held.where("shard >= 0").select("shard", "part")
    out = found.groupBy("shard").applyInPandas(merge_words, "tokens long, distinct long, continued long, m1 long, m2 long, m3 long, m4 long, m3p long")
    t = out.agg(*[F.sum(c).alias(c) for c in out.columns]).first()
    tokens, distinct, continued = (t[k] or 0 for k in ("tokens", "distinct", "continued"))
    d[1] = discounts(*(float(t[f"m{k}"] or 0) for k in (1, 2, 3, 4)))
    level = (d[1][0] * (t["m1"] or 0) + d[1][1] * (t["m2"] or 0) + d[1][2] * (t["m3p"] or 0)) / max(continued, 1)
    return Model(folder, order, shards, frequent, tokens, distinct, continued, d, level)


class Scorer:
    """Maps a model's arrays into memory as they are needed and looks up a slice's n-grams, each distinct one once."""

    def __init__(self, model: Model):
        self.m = m = model
        words_of = lambda s: (mapped(m.folder, f"words-{s}", "keys", "<u8"), mapped(m.folder, f"words-{s}", "figures", "<i8").reshape(-1, FIGURES))
        self.tables = {1: Tables(words_of)} | {k: Tables(self.reader(k)) for k in range(2, m.order + 1)}
        self.words, self.pairs = self.tables[1], self.tables[2]

    def width(self, k: int) -> tuple[int, ...]:
        return () if k == self.m.order else (FIGURES,)

    def reader(self, k: int):
        def read(s: int) -> tuple[np.ndarray, np.ndarray]:
            name = f"{table_name(k)}-{s}"
            counts = mapped(self.m.folder, name, "counts", "<u4")
            counts = counts if len(counts) else mapped(self.m.folder, name, "counts8", "<u8")
            return mapped(self.m.folder, name, "keys", "<u8"), counts.reshape(-1, *self.width(k))

        return read

    @staticmethod
    def lookup(key: np.ndarray, shard: np.ndarray, tables: Tables, width: tuple) -> np.ndarray:
        """key is sorted; what is not there counts 0."""
        out = np.zeros((len(key), *width), np.int64)
        for s, own in parted(shard):
            keys, values = tables[s]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                hit = keys[at] == key[own]
                out[own[hit]] = values[at[hit]]
        return out

    def figures(self, ids: list[np.ndarray]) -> np.ndarray:
        """What the model holds of n-grams, a row each."""
        k = len(ids)
        key, some, again = np.unique(key_of(ids), return_index=True, return_inverse=True)
        return self.lookup(key, shard_of([c[some] for c in ids], key, self.m.frequent, self.m.shards), self.tables[k], self.width(k))[again]

    def score(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        m = self.m
        grams, bounds = chain(data, ends, m.order)
        n = np.diff(bounds)
        earlier = np.arange(len(grams[0])) - 1
        earlier[bounds[:-1]] = -1  # a first token's context is begins, whose figures stand last
        with_begin = [np.append(c, BEGIN) for c in grams]
        held = self.figures(with_begin[-1:])
        c, met = held[:-1, 1], held[:-1, 0]
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        p = (discounted(met, m.d1) + (m.level if m.continued else 1.0) * max(m.continued, 1) / (m.distinct + 1)) / max(m.continued, 1)
        for k in range(2, m.order + 1):
            total, successors = held[earlier, 2], held[earlier, 3:]
            back_off = np.where(total > 0, (successors * np.array(m.discounts[k])).sum(axis=1) / np.maximum(total, 1), 1.0)
            held = self.figures(with_begin[-k:])
            p = discounted(held[:-1] if k == m.order else held[:-1, 0], m.discounts[k]) / np.maximum(total, 1) + back_off * p
        add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(n) else x[:0]
        return n, add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score, score. A null text is an empty one, whose only token
    is its end. Rows repeat as they come; an empty table gives no rows; with nothing learned every token is unknown."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, data, ends in slices(batch, "text", SCORE_SLICE):
                n, known, base, score = scorer.score(data, ends)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *map(pa.array, (n.astype(np.int64), known, np.full(len(n), model.tokens, np.int64), base, score))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model_folder(docs: DataFrame) -> str:
    """A new folder for a model under the shared folder, which workers must be able to open and map: a mounted path."""
    path = common.Workspace(docs.sparkSession, "kneser-ney").path
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if not path.startswith("/"):
        raise ValueError(f"the model must lie in a folder that is mounted on every worker, not in {path}")
    return path


def language_model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """op7's contract: learns where crc32 of the id, mod 10, is not 0, and scores all."""
    held: Column = F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(10)) == 0
    out = scored(docs, fitted(docs.where(~held), model_folder(docs), order))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
