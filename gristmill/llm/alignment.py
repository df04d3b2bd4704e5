"""Cross-tokenizer alignment: a label for each byte, and a regular expression that reads token groups from them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import slices

#: The label of a byte: no token ends with it, one of A does, one of B does, both do.
LABELS = np.frombuffer(b".ab*", np.uint8)
#: A group: up to a byte with which both end.
GROUP = re.compile(rb"[^*]*\*")
#: Id pairs that hold at least one in so many of all links are looked up in a broadcast table; there can't be more of them.
FREQUENT = 1 << 17
_loaded: dict = {}


class Pieces:
    """The bytes of each id of a vocabulary, and each id in decimal, as flat arrays."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        wide = len(str(len(pieces)))
        self.digits = np.frombuffer(b"".join(str(k).encode().rjust(wide, b"\0") for k in range(len(pieces))), np.uint8).reshape(-1, wide)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - ends + n, n) + np.arange(n.sum())].tobytes()


def byte_level(ranks_path: str):
    """The byte-level tokenizer of a rank file, as a function from text to ids, and its pieces."""
    if ranks_path not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            pieces[k] = piece
        _loaded[ranks_path] = lambda t: np.array(own.encode_ordinary(t), np.int64), Pieces(pieces)
    return _loaded[ranks_path]


def sentence_pieces(model_path: str):
    """The sentence-piece tokenizer of a model file, as a function from text to ids, and its pieces."""
    if model_path not in _loaded:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model_path)
        of = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        _loaded[model_path] = lambda t: np.array(own.encode(t, num_threads=1), np.int64), Pieces([of(own.id_to_piece(k)) for k in range(own.get_piece_size())])
    return _loaded[model_path]


def byte_labels(a_length: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """For each byte 1 if a token of A ends with it, plus 2 if one of B does."""
    out = np.zeros(int(a_length.sum()), np.uint8)
    out[np.cumsum(a_length) - 1] |= 1
    out[np.cumsum(b_length) - 1] |= 2
    return out


def token_groups(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has: the labels of either kind in each span that ends with both."""
    spans = GROUP.findall(LABELS[label].tobytes())
    ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
    count = lambda x: np.diff(np.cumsum(x, dtype=np.int64)[ends - 1], prepend=0)
    return count(label & 1), count(label >> 1)


def linked_pairs(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id pair, A's in the upper half, of each two tokens that share bytes: between two labelled bytes lies one such."""
    at = label[label > 0]
    return (a[np.cumsum(at & 1, dtype=np.int64) - (at & 1)] << 32) | b[np.cumsum(at >> 1, dtype=np.int64) - (at >> 1)]


def groups_text(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, of_a: Pieces, of_b: Pieces) -> bytes:
    """Groups as `a1,a2|b1;a3|b2,b3`, ids in decimal."""
    wide = max(of_a.digits.shape[1], of_b.digits.shape[1])
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    at_a, at_b = np.arange(len(a)) + np.repeat(to_b - n_b, n_a), np.arange(len(b)) + np.repeat(to_a, n_b)
    out = np.zeros((len(a) + len(b), wide + 1), np.uint8)
    out[at_a, wide - of_a.digits.shape[1] : wide] = of_a.digits[a]
    out[at_b, wide - of_b.digits.shape[1] : wide] = of_b.digits[b]
    out[:, wide] = ord(",")
    out[at_a[to_a - 1], wide] = ord("|")
    out[at_b[to_b - 1], wide] = ord(";")
    return out[out > 0][:-1].tobytes()


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """For every document its tokens, groups and links counted, its groups' hash, and its distinct id pairs with how often
    each is linked."""

    def one(text: str | None) -> tuple:
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return none
        (encode_a, of_a), (encode_b, of_b) = byte_level(ranks_path), sentence_pieces(model_path)
        whole = f" {text}".encode()
        a, b = encode_a(f" {text}"), encode_b(text)
        if of_a.joined(a) != whole or of_b.joined(b) != whole:
            return none
        label = byte_labels(of_a.length[a], of_b.length[b])
        n_a, n_b = token_groups(label)
        links = linked_pairs(label, a, b)
        sha = hashlib.sha256(groups_text(a, b, n_a, n_b, of_a, of_b)).hexdigest()
        return len(a), len(b), len(n_a), len(links), sha, *np.unique(links, return_counts=True)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                *figures, pairs, times = zip(*map(one, part.column(1).to_pylist()), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(t))) for x, t in ((pairs, np.int64), (times, np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(f, pa.int64()) for f in figures[:4]], pa.array(figures[4]), *lists], [c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold an id pair linked, and whether no other pair of its B id has more."""
    counts = common.settled(pairs.groupBy("pair").agg(F.sum("times").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return common.settled(counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def alignment(docs: DataFrame, ranks_path: str = "", model_path: str = "") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, by a byte-level tokenizer A and a
    sentence-piece tokenizer B.

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, and an empty
    hash. Rows with one id, or none, are aligned each, and rows that repeat count in the corpus each time; a count_sum beyond a
    long is null; an empty table gives no rows; other columns play no part.

    Texts are tokenized once. The counts of the id pairs come back to the documents by two joins: pairs that hold one in
    FREQUENT of all links, at most that many, from a broadcast table; the others, each too rare to be a hot key, by pair."""
    ranks_path, model_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), model_path or public_tokenizers.path("piece_bpe_32k.model")
    ws = common.Workspace(docs.sparkSession, "alignment")
    rows = ws.write(aligned(docs, ranks_path, model_path).withColumn("row", F.monotonically_increasing_id()), "rows")
    pairs = rows.select("row", "times", F.posexplode("pairs").alias("k", "pair")).select("row", "pair", F.col("times")[F.col("k")].alias("times"))
    counts = pair_counts(pairs)
    least = (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    seen = pairs.join(frequent, "pair").unionByName(pairs.join(frequent, "pair", "left_anti").join(counts.where(F.col("n") < least).hint("merge"), "pair"))
    found = seen.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.try_sum(F.try_multiply(F.col("n"), F.col("times"))).alias("count_sum"))
    held = lambda c: F.when(F.col("n_links") == 0, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", held("n_best"), held("count_sum"), "groups_sha256")
