"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a full sequence, windows that a partition keeps open, partitions whose leftovers are merged together.
CAPACITY, OPEN, MERGED = 2048, 16, 64
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encodings: dict = {}


def encoding(ranks_path: str):
    """The byte-level BPE of the given ranks, which are the vocabulary of byte_bpe_50k.json; its end-of-text string is a
    special token in either file's reading. The tests hold its ids against those of the tokenizers library."""
    if ranks_path not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _encodings[ranks_path]


def token_ids(text: str | None, ranks_path: str) -> np.ndarray:
    return np.array([*encoding(ranks_path).encode(text or "", allowed_special="all"), END_ID], dtype="<u4")


class Packer:
    """Places pieces best-fit into a fixed number of open windows. When none fits, the fullest is topped up with the piece's
    first ids and emitted. Sequences are numbered from `number`."""

    def __init__(self, number: int):
        self.number, self.open, self.done = number, [], []

    def emit(self, window: list) -> None:
        at = 0
        for doc_id, start, ids, total in window:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.number, at))
            at += len(ids)
        self.number += 1

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= CAPACITY:
            self.emit([(doc_id, start, ids[:CAPACITY], total)])
            start, ids = start + CAPACITY, ids[CAPACITY:]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] + len(ids) <= CAPACITY]
        if fits:
            w = max(fits, key=lambda w: w[0])
        elif len(self.open) < OPEN:
            self.open.append(w := [0, []])
        else:
            w = max(self.open, key=lambda w: w[0])
            gap = CAPACITY - w[0]
            w[1].append((doc_id, start, ids[:gap], total))
            self.open.remove(w)
            self.emit(w[1])
            return self.add(doc_id, start + gap, ids[gap:], total)
        w[0] += len(ids)
        w[1].append((doc_id, start, ids, total))
        if w[0] == CAPACITY:
            self.open.remove(w)
            self.emit(w[1])

    def merge(self) -> list:
        """Fills sequences from the open windows one after the other; returns the pieces of the last, unfilled one."""
        rest, room = [], CAPACITY
        for _, window in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, ids, total in window:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    rest.append((doc_id, start, part, total))
                    start, room = start + len(part), room - len(part)
                    if not room:
                        self.emit(rest)
                        rest, room = [], CAPACITY
        self.open = []
        return rest

    def finish(self) -> None:
        """Merges, and cuts what is left into sequences whose lengths are powers of two, which need no padding."""
        rest = self.merge()
        left = sum(len(x[2]) for x in rest)
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                window.append((doc_id, start, ids, total))
                room -= len(ids)
            self.emit(window)


def packed(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, as op5's contract has it. Each document is its ids and then id 1; a null or empty text is that id
    alone; repeated rows are packed each on their own; a null id stays null; an empty table gives no rows.

    A partition packs what it reads and keeps at most OPEN windows. At its end it fills up its windows from each other and
    hands on the one unfilled sequence; those of MERGED partitions are merged the same way, so nothing meets in one task."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [x.split()[0] for x in PIECE.split(", ")]

    def frame(rows: list, ids: list, group: int) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary()), pa.array([group] * len(rows), pa.int64())], [*names, "ids", "group"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        p = Packer(part << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                p.add(doc_id, 0, ids, len(ids))
                if len(p.done) > 10_000:
                    yield frame(p.done, [None] * len(p.done), -1)
                    p.done = []
        rest = p.merge()
        yield frame(p.done, [None] * len(p.done), -1)
        yield frame([(d, s, len(i), 0, t, part, n) for n, (d, s, i, t) in enumerate(rest)], [i.tobytes() for _, _, i, _ in rest], part // MERGED)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["sequence_id", "offset"])
        p = Packer((1 << 62) + (int(g["group"].iloc[0]) << 32))
        window = [(None if pd.isna(d) else int(d), int(s), np.frombuffer(i, "<u4"), int(t)) for d, s, i, t in zip(g["doc_id"], g["start"], g["ids"], g["doc_tokens"], strict=True)]
        p.open = [[sum(len(x[2]) for x in window), window]]
        p.finish()
        out = pd.DataFrame(p.done, columns=names)
        return out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = common.settled(rows.mapInArrow(pack, PIECE + ", ids binary, group long"))
    merged = rows.where("group >= 0").groupBy("group").applyInPandas(merge, PIECE)
    return rows.where("group < 0").select(*names).unionByName(merged)
