"""Keys of word runs: packing by leading bits, sets of keys as bits, and which keys recur, found by fingerprints."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evtlake.llm.common import stored
from evtlake.llm.jaccard_join import sorted_groups
from evtlake.llm.words import mix

#: A set of keys is sent as this many bits at most.
MOST_BITS = 28
_P = np.uint64(0x9E3779B97F4A7C15)


def extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a run with one more word."""
    return mix(key.view(np.uint64) * _P + word.view(np.uint64)).view(np.int64)


def shrunk(values: np.ndarray) -> bytes:
    """An array as compressed bytes: counts are mostly small, and a column of them crosses the network whole."""
    raw = np.ascontiguousarray(values)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def packed(keys: np.ndarray, bits: int, *columns: np.ndarray) -> list[tuple[int, list[bytes]]]:
    """Columns cut by the leading ``bits`` of ``keys`` (unsigned), which are in order."""
    bucket = (keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)).astype(np.int64)
    own, firsts = np.unique(bucket, return_index=True)
    return [(int(b), [np.ascontiguousarray(c[i:j]).tobytes() for c in columns]) for b, i, j in zip(own, firsts, np.append(firsts[1:], len(keys)))]


def bits_for(total: int, bucket: int) -> int:
    """Leading bits that leave about ``bucket`` of ``total`` evenly spread keys together."""
    return min((total // bucket).bit_length(), 31)


class Sieve:
    """A set of keys as bits, one bit each; a key outside may share a bit, a key inside is always found."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(max(int(n * 16).bit_length(), 12), MOST_BITS)
        self.masks = np.zeros(1 << (self.bits - 6), np.uint64)
        at = F.shiftrightunsigned(keys.columns[0], 64 - self.bits)
        rows = keys.select(at.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m")).toArrow()
        self.masks[rows["w"].to_numpy()] = rows["m"].to_numpy().view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.masks[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def fingerprints(keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows (bucket, prints, n) of sorted unsigned keys: 32 bits of each beside those of its bucket."""
    rows = packed(keys, bits, (keys << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), n.astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array([b for b, _ in rows], pa.int64()), pa.array([x[0] for _, x in rows], pa.binary()), pa.array([x[1] for _, x in rows], pa.binary())],
        ["bucket", "prints", "n"])


def recurring(prints: DataFrame, bits: int, least: int) -> Sieve:
    """Keys whose ``n`` add up to ``least`` or more over all rows (bucket, prints, n), and some that share their fingerprint with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            found = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column(1)])
            n = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in group.column(2)])
            order = np.argsort(found)
            found, n = found[order], n[order]
            firsts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else order
            often = found[firsts][np.add.reduceat(n, firsts, dtype=np.int64) >= least] if len(found) else found
            top = np.uint64(group.column(0)[0].as_py() << (64 - bits) if bits else 0)
            yield pa.RecordBatch.from_arrays([pa.array((top | often.astype(np.uint64) << np.uint64(32) >> np.uint64(bits)).view(np.int64))], ["key"])

    dealt = prints.repartition("bucket").sortWithinPartitions("bucket")
    return Sieve(stored(dealt.mapInArrow(run, "key bigint"), "recurring"))
