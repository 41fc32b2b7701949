"""Resampling of documents towards a target by importance weights of hashed word n-grams.

The features of a text are its words and pairs of neighbouring words; each falls into a bucket by
the CRC-32 of its bytes. Distinct features of a slice of texts are grouped by equal length into
matrices of bytes, one row each, and the checksums of all rows are updated column by column; the
buckets are scattered back to the occurrences.

Buckets of every document are written once, as two bytes a feature. Counts of buckets, at most
BUCKETS rows, give the gain of a bucket; the mean gain of a document and a perturbation made from
its id (Gumbel) give its score, and the highest scores are drawn without replacement. Scores are
whole numbers of a narrow range, so counts per score tell where each of them stands, and only the
rows of one score are ever ordered together.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.llm.common import stored
from evtlake.llm.word_slices import Classes, slices
from evtlake.plans import ordering

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, 7
WORDS = Classes(bytes(set(range(128)) - set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")))
#: Longer features are cut into blocks of this many bytes, whose checksums are joined.
BLOCK = 1024
CELLS = 1 << 21


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _columns(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Checksum registers of all rows after all columns of ``matrix``."""
    for column in matrix.T:
        state = _TABLE[(state ^ column) & 255] ^ (state >> np.uint32(8))
    return state


#: Register of every byte value at each of four places after a block of zero bytes: registers are linear.
_SHIFT = _columns((np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel(),
                  np.zeros((1024, BLOCK), np.uint8)).reshape(4, 256)


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes."""
    n, width = matrix.shape
    blocks = width // BLOCK
    head = width - blocks * BLOCK
    state = _columns(np.full(n, 0xFFFFFFFF, np.uint32), matrix[:, :head])
    if blocks:
        own = _columns(np.zeros(n * blocks, np.uint32), matrix[:, head:].reshape(n * blocks, BLOCK)).reshape(n, blocks)
        for i in range(blocks):
            state = own[:, i] ^ np.bitwise_xor.reduce([_SHIFT[j][(state >> np.uint32(8 * j)) & 255] for j in range(4)])
    return ~state


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``, one matrix per length (cut into several where it would be large)."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    widths, firsts = np.unique(lengths[order], return_index=True)
    for width, rows in zip(widths.tolist(), np.split(order, firsts[1:])):
        step = max(1, CELLS // width)
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            if len(some) == 1:
                matrix = data[starts[some[0]]:starts[some[0]] + width].reshape(1, -1)
            else:
                matrix = data[starts[some][:, None] + np.arange(width)]
            out[some] = crc32_rows(matrix)
    return out


def feature_buckets(texts: list[str | None], step: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """For every text its row, number of words and the bucket of every occurrence of a feature."""
    words, found = 0, []
    for s in slices(texts, WORDS, 1, **({} if step is None else {"step": step})):
        # all words with one blank between them: every feature is a span of it
        n = len(s.codes)
        places = np.cumsum(s.lengths + 1) - s.lengths - 1
        stream = np.full(len(s.letters) + n, 32, np.uint8)
        stream[np.arange(len(s.letters)) + np.repeat(np.arange(n), s.lengths)] = s.letters
        single = np.flatnonzero(s.owned)
        double = np.flatnonzero(s.owned & s.follows)
        pairs = s.codes[double].astype(np.int64) * len(s.words) + s.codes[double + 1] if n else np.empty(0, np.int64)
        _, first_single, of_single = np.unique(s.codes[single], return_index=True, return_inverse=True)
        _, first_double, of_double = np.unique(pairs, return_index=True, return_inverse=True)
        a, b = single[first_single], double[first_double]
        at = np.concatenate([a, b])
        sizes = np.concatenate([s.lengths[a], s.lengths[b] + 1 + s.lengths[b + 1]]) if n else np.empty(0, np.int64)
        buckets = (crc32_spans(stream, places[at], sizes) % BUCKETS).astype(np.uint16)
        values = np.concatenate([buckets[:len(a)][of_single], buckets[len(a):][of_double]])
        parts = np.concatenate([s.part[single], s.part[double]])
        values = values[np.argsort(parts, kind="stable")]
        ends = np.cumsum(np.bincount(parts, minlength=len(s.rows)))
        for i, (row, owned, end) in enumerate(zip(s.rows.tolist(), s.counts().tolist(), ends.tolist())):
            words += owned
            found.append(values[ends[i - 1] if i else 0:end])
            if s.last[i]:
                yield row, words, np.concatenate(found)
                words, found = 0, []


def featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features and the buckets (two bytes each) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                _, words, found = zip(*feature_buckets(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(words, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(features: DataFrame) -> np.ndarray:
    """Occurrences per bucket: counted in tasks, then BUCKETS sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for row in features.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed bucket frequencies."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features`` with the floored mean gain in place of the buckets."""
    kind = features.schema["doc_id"].dataType.simpleString()
    sent = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(sent.value[np.frombuffer(x.as_py(), np.uint16)].sum()) for x in batch.column(3)]
            mean = [total // n if n else 0 for total, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def perturbation(id_col: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel variate made from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
                      share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank, one row per row of ``docs``.

    Of the N documents with ``least_words`` words or more, the floor(share * N / 100) of highest
    score are drawn and ranked from 1; ties go to the smaller id, NULL last, then to fewer features.
    Other documents have a NULL rank. NULL and empty texts have no features and weight 0. Rows are
    judged one by one, so repeated rows are drawn one by one; NULL ids share one perturbation. An
    empty target is uniform; an empty table gives no rows; other columns are ignored.
    """
    features = stored(featured(docs, id_col, text_col), "features")
    gain = gains(bucket_counts(features), bucket_counts(featured(target.select(F.lit(0).alias("_id"), target_text), "_id", target_text)))
    scored = stored(weighted(features, gain).withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed)), "scored")
    enough = F.col("n_words") >= least_words
    # one row per score, whole numbers of a range that the gains bound
    tally = scored.where(enough).groupBy("score").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    drawn = F.floor(F.lit(share) * F.sum("_n").over(Window.partitionBy()) / 100)
    places = tally.select(F.col("score").alias("_score"), F.coalesce(above, F.lit(0)).alias("_above"), drawn.alias("_drawn"))
    placed = scored.join(F.broadcast(places), enough & (F.col("score") == F.col("_score")), "left")
    inside = enough & (F.col("_above") < F.col("_drawn"))
    ahead = placed.where(inside).withColumn("_id", F.struct(F.col("doc_id").isNull(), "doc_id"))
    ranked = ordering.number_rows(ahead, ["score"], ["_id", "n_features"], "_pos").withColumn(
        "rank", F.when(F.col("_above") + F.col("_pos") < F.col("_drawn"), F.col("_above") + F.col("_pos") + 1))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
