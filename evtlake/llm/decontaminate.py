"""Benchmark decontamination by winnowing.

A window of L words (13, or all words of a shorter item) is found through fingerprints: of
the hashes of all k-grams, every w consecutive ones keep their minimum. With k + w - 1 = L any
two places that share L words share a whole sliding window, and so keep the same minimum
there. Fingerprints of documents and items are joined, each with the words around it, and each hit
is extended word by word:
L equal words or more around a hit are an occurrence. Every length of a short item has its own
k and w; only lengths that the benchmark has are fingerprinted.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evtlake.llm.common import stored
from evtlake.llm.words import gram_hashes, word_hashes

WINDOW = 13
#: Bits of the sieve through which fingerprints of documents pass before they leave their task: 8 MB, however large the
#: benchmark. It lets every true hit through; others are sorted out by the join.
SIEVE_BITS = 1 << 26


def shape(length: int) -> tuple[int, int]:
    """k and w for windows of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def winnow(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their positions: the rightmost minimum of each window of k-gram hashes."""
    k, w = shape(length)
    grams = gram_hashes(words, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j:j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    at = np.unique(at)
    return grams[at] ^ np.uint64(length), at


def item_fingerprints(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """length, fingerprint, item_id, words before the hit and the words around it that a window can reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                length = min(window, len(words))
                if length:
                    k, _ = shape(length)
                    for h, p in zip(*(x.tolist() for x in winnow(words, length))):
                        low = max(0, p - (length - k))
                        rows.append((length, np.uint64(h).astype(np.int64).item(), item, p - low, words[low:p + length].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary()))],
                ["length", "hash", "item_id", "before", "around"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).mapInArrow(
        run, "length int, hash bigint, item_id string, before int, around binary").dropDuplicates()


def sieve_of(prints: DataFrame) -> np.ndarray:
    """One bit per fingerprint, by its lowest bits; Spark builds it in pages of 32768 bits, at most 2048 of them."""
    place = F.pmod("hash", F.lit(SIEVE_BITS)) + 1  # Spark numbers bits from 1
    pages = prints.select(place.alias("at")).groupBy((F.bitmap_bucket_number(F.col("at")) - 1).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at"))).alias("bits")).collect()
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in pages:
        at = r.page * 4096
        sieve[at:at + 4096] = np.frombuffer(r.bits, np.uint8)
    return sieve


def document_fingerprints(docs: DataFrame, lengths: list[int], sieve: np.ndarray) -> DataFrame:
    """doc_id, key, n_words and the fingerprints ``found`` that the benchmark may have, with the words around them, per row of ``docs`` (doc_id, key, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()), ("around", pa.binary())])

    def fingerprints(words: np.ndarray) -> list[dict]:
        out = []
        for length in lengths:
            hashes, at = winnow(words, length)
            place = hashes.view(np.int64) % SIEVE_BITS
            hit = (sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            k, _ = shape(length)
            for h, p in zip(hashes.view(np.int64)[hit].tolist(), at[hit].tolist()):
                low = max(0, p - (length - k))
                out.append({"hash": h, "pos": p, "before": p - low, "around": words[low:p + length].tobytes()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts, found = [], []
                for text in part.column(2).to_pylist():
                    words = word_hashes(text)
                    counts.append(len(words)), found.append(fingerprints(words))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(found, pa.list_(struct))],
                                                 ["doc_id", "key", "n_words", "found"])

    return docs.mapInArrow(run, f"doc_id {kind}, key bigint, n_words bigint, found array<struct<hash:bigint,pos:bigint,before:int,around:binary>>")


def extend(pos: int, before: int, around: bytes, item_before: int, item_around: bytes, length: int) -> tuple[int, int] | None:
    """The span of equal words around a hit, if a window fits into it. Both contexts hold all words a window can reach."""
    here, there = np.frombuffer(around, np.uint64), np.frombuffer(item_around, np.uint64)
    back, ahead = min(before, item_before), min(len(here) - before, len(there) - item_before)
    wrong = np.flatnonzero(here[before - back:before + ahead] != there[item_before - back:item_before + ahead])
    left = int(wrong[wrong < back].max(initial=-1)) + 1
    right = int(wrong[wrong >= back].min(initial=back + ahead))
    return (pos - back + left, pos - back + right) if right - left >= length else None


def occurrences(found: DataFrame, prints: DataFrame) -> DataFrame:
    """key, hit ``spans`` (merged, end exclusive) and ``item_ids`` (sorted) of all texts with a proven window."""
    hits = found.where(F.size("found") > 0).dropDuplicates(["key"]).select("key", F.inline("found")).withColumnsRenamed({"before": "d_before", "around": "d_around"})
    joined = hits.join(prints, "hash").select("key", "pos", "d_before", "d_around", "before", "around", "length", "item_id")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [extend(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 7)))]
            kept = [i for i, x in enumerate(spans) if x]
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), pa.array([spans[i][0] for i in kept], pa.int64()), pa.array([spans[i][1] for i in kept], pa.int64()),
                batch.column(7).take(rows)], ["key", "start", "end", "item_id"])

    proven = joined.mapInArrow(prove, "key bigint, start bigint, end bigint, item_id string").distinct()
    span = F.struct("start", "end")
    gathered = proven.groupBy("key").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def merge(done, x):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] < x["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return gathered.select("key", F.aggregate("spans", none, merge).alias("spans"), "item_ids")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, the hit word ``spans``, the ``item_ids`` and ``contaminated``, one row per row of ``docs``.

    A document is contaminated when 5 % of its words or more are hit. NULL and empty texts have
    no words and are clean; empty items, or an empty benchmark, hit nothing. Items without id
    count as the item ''; items with one id are one item. Repeated documents are judged alike;
    hits belong to a text, not to an id. An empty table gives no rows; other columns are ignored.
    Texts are read once and never shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    prints = stored(item_fingerprints(items, item_id_col, item_text_col, window), "item-prints")
    lengths = sorted(r.length for r in prints.select("length").distinct().collect())  # 13 at most
    found = stored(document_fingerprints(rows, lengths, sieve_of(prints)), "document-prints")
    hits = stored(occurrences(found, prints), "item-hits")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0))
    out = found.select("doc_id", "key", "n_words").join(hits, "key", "left").withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", "n_words", "n_hit", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    keyed = docs.select(F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"), F.struct("*").alias("_row"))
    judged = contamination(keyed.select("_key", "_text"), items, "_key", "_text").where("contaminated").select("doc_id").distinct()
    bad = stored(judged, "contaminated")
    return keyed.join(bad, keyed["_key"] == bad["doc_id"], "left_anti").select("_row.*")
