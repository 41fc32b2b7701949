"""Byte-level BPE by public rank files: encoding with a segment tree per piece, and decoding.

A piece is a run of bytes that no merge crosses. Each byte position that still starts a token
is a leaf holding the rank of the pair that starts there; inner nodes hold the smaller rank of
their children, so the root finds the leftmost pair of least rank. A merge updates the leaves of
the two tokens and of the left neighbour, each in logarithmic time: n log n for any piece, also
for one run of a million letters. Pieces of one width are rows of one array of trees, and a step
merges one pair in each of them; where only a few are left, they go on one by one. Pieces recur,
so each worker process keeps the ids of short ones, in two generations: when the younger is full
it becomes the older one, and what is not asked for again goes.
"""

import base64
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

NONE = 1 << 62
#: Pieces kept per generation, and their greatest length.
TABLE_PIECES = 200_000
LONGEST_KEPT = 64
#: Trees of one width that are worth an array, and its greatest number of nodes.
TOGETHER, NODES = 24, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly merge the leftmost pair of least rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the token to the left
    get = ranks.get
    tree = [NONE] * (2 * width)
    tree[width:width + n - 1] = [get(piece[i:i + 2], NONE) for i in range(n - 1)]
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a <= b else b
            if tree[i] == best:
                break
            tree[i] = best

    while (best := tree[1]) < NONE:
        i = 1
        while i < width:
            i <<= 1
            if tree[i] != best:
                i += 1
        i -= width
        j = end[i]
        stop = end[j]
        end[i] = stop
        put(j, NONE)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i:end[stop]], NONE))
        else:
            put(i, NONE)
        if before[i] >= 0:
            put(before[i], get(piece[before[i]:stop], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Pairs:
    """Rank of two neighbouring tokens by their ids; a rank is the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        found = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array([*sorted(found), 1 << 62], np.int64)
        self.ranks = np.array([*(found[k] for k in self.keys[:-1].tolist()), NONE], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_together(pieces: list[bytes], pairs: Pairs, ranks: dict[bytes, int]) -> list[bytes]:
    """``merge`` of pieces of two bytes or more and of one width, one step of all trees at a time; ids as 32-bit integers."""
    sizes = np.array([len(p) for p in pieces])
    count, width = len(pieces), 1 << int(sizes.max() - 1).bit_length()
    here = np.arange(width) < sizes[:, None]
    ids = np.zeros((count, width), np.int64)
    ids[here] = pairs.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.full((count, 2 * width), NONE, np.int64)
    tree[:, width:-1] = np.where(here[:, 1:], pairs.rank(ids[:, :-1], ids[:, 1:]), NONE)
    step = width
    while step > 1:
        half = step >> 1
        np.minimum(tree[:, step:2 * step:2], tree[:, step + 1:2 * step:2], out=tree[:, half:step])
        step = half
    # flat views: token by start, its end, and the start of the token before
    nodes, token = tree.ravel(), ids.ravel()
    end = np.tile(np.arange(1, width + 1), count)
    before = np.tile(np.arange(-1, width - 1), count)
    starts = here.copy()
    rows = np.arange(count)
    while True:
        best = nodes[rows * 2 * width + 1]
        on = best < NONE
        rows, best = rows[on], best[on]
        if len(rows) < min(TOGETHER, count):
            break
        base, root = rows * width, rows * 2 * width
        at = np.ones(len(rows), np.int64)
        while at[0] < width:
            at *= 2
            at += nodes[root + at] != best
        i = at - width
        j = end[base + i]
        stop = end[base + j]
        token[base + i] = best
        end[base + i] = stop
        starts.ravel()[base + j] = False
        size = sizes[rows]
        inner = stop < size
        right = np.full(len(rows), NONE)
        right[inner] = pairs.rank(best[inner], token[(base + stop)[inner]])
        before[(base + stop)[inner]] = i[inner]
        ahead = before[base + i]
        left = ahead >= 0
        nodes[root + width + j] = NONE
        nodes[root + width + i] = right
        nodes[(root + width + ahead)[left]] = pairs.rank(token[(base + ahead)[left]], best[left])
        for some, leaf in ((slice(None), j), (slice(None), i), (left, ahead)):
            node, top = width + leaf[some], root[some]
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = top + 2 * node
                nodes[top + node] = np.minimum(nodes[child], nodes[child + 1])
    flat, ends = ids[starts].astype(np.int32).tobytes(), (4 * np.cumsum(starts.sum(axis=1))).tolist()
    out = [flat[a:b] for a, b in zip([0, *ends], ends)]
    for row in rows.tolist():
        out[row] = np.array(merge(pieces[row], ranks), np.int32).tobytes()
    return out


class Encoder:
    """Texts to ids, with the ids of recent pieces."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs, pattern: str):
        self.ranks, self.pairs, self.split = ranks, pairs, regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as 32-bit integers one after the other."""
        split = [self.split.findall(t) if t else [] for t in texts]
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        again = new.intersection(old)
        young.update((p, old[p]) for p in again)
        long = self._learn(new - again)
        young.update(long)
        ids = young.__getitem__
        out = [b"".join(map(ids, pieces)) for pieces in split]
        for piece in long:
            del young[piece]
        if len(young) > TABLE_PIECES:
            self.young, self.old = {}, young
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Adds short pieces to the table and returns the long ones."""
        widths: dict[int, list[tuple[str, bytes]]] = {}
        found: dict[str, bytes] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                widths.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
            else:
                found[piece] = whole.to_bytes(4, sys.byteorder)
        for bits, own in widths.items():
            step = max(1, NODES >> bits)
            for at in range(0, len(own), step):
                part = own[at:at + step]
                if len(part) < TOGETHER:
                    found.update((piece, np.array(merge(raw, self.ranks), np.int32).tobytes()) for piece, raw in part)
                else:
                    found.update(zip([piece for piece, _ in part], merge_together([raw for _, raw in part], self.pairs, self.ranks)))
        long = {p: found.pop(p) for p in [p for p in found if len(p) > LONGEST_KEPT]}
        self.young.update(found)
        return long


def decoder(ranks: dict[bytes, int]) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from ids to the bytes they stand for, and the number of bytes of each."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    flat, sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
    firsts = np.cumsum(sizes) - sizes

    def decode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = sizes[ids]
        shift = firsts[ids] - (np.cumsum(lengths) - lengths)
        return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths

    return decode


def _arrow_bytes(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


#: The encoder and decoder of this worker process, for the vocabulary that it met last.
_coder: dict[str, tuple[Encoder, Callable]] = {}


def coder(name: str, ranks: dict[bytes, int], pairs: Pairs, pattern: str) -> tuple[Encoder, Callable]:
    if name not in _coder:
        _coder.clear()
        _coder[name] = Encoder(ranks, pairs, pattern), decoder(ranks)
    return _coder[name]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids and the bytes ``decoded`` from these ids, one row per row of ``docs``.

    NULL and empty texts have no ids. Rows are read one by one: repeated rows and NULL ids need
    no care, an empty table gives no rows, other columns are ignored. The vocabulary (some
    50,000 entries) is read by the driver and broadcast with the pairs that make up its tokens.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    name = hashlib.md5(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    sent = spark.sparkContext.broadcast((ranks, Pairs(ranks)))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decode = coder(name, *sent.value, pattern)
        for batch in batches:
            for part in slices(batch):
                coded = encoder.encode(part.column(1).to_pylist())
                ids = np.frombuffer(b"".join(coded), np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int64)
                data, lengths = decode(ids)
                upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), _arrow_bytes(data, np.diff(upto))],
                    ["doc_id", "token_ids", "decoded"])

    return docs.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded binary")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that ids of a batch never stand in memory together."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with the bytes ``decoded`` of its ids; NULL gives no bytes."""
    sent = tokens.sparkSession.sparkContext.broadcast({i: t for t, i in load_ranks(ranks_path).items()})

    @F.udf("binary", useArrow=True)
    def join(ids):
        table = sent.value
        return b"".join(table[i] for i in ids) if ids is not None else b""

    return tokens.withColumn("decoded", join(F.col(ids_col)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes."""
    return encoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
