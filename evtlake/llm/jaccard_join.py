"""Near-duplicate documents: Jaccard join of word 5-grams by the chosen-path method.

Documents with equal gram sets are one class and are joined once. Each class has a minwise
embedding: T sampled tokens (i, smallest hash i of its grams); two sets share a fraction of
tokens equal to their Jaccard similarity. A run splits classes recursively: every node of the
recursion chooses two of the T positions by its path, and a class goes to the two children
named by its tokens there. Small buckets are compared by brute force on their tokens, larger
ones are split again. A bucket that hardly shrinks holds sets that are all alike and is kept
as one. A pair at the threshold survives a node with f = 1 - (1 - threshold * f)^2 at any depth,
94 % at 0.8; runs are repeated until the target recall (0.9999: four runs).

What the buckets find are candidates only: they connect classes to clusters, and inside each
cluster exact similarities of whole sets are computed from the texts, blockwise where a cluster
is large, by products of sparse 0/1 matrices. Links are counted where they are found, never
written as pairs; linked classes are components.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.llm.common import add_facts, stored
from evtlake.llm.words import gram_hashes, mix, word_hashes

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
TOKENS = 64
#: Buckets up to this many classes are compared by brute force.
BUCKET = 512
#: A larger bucket that keeps more than this share of its parent is taken as one cluster of candidates.
DENSE = 0.6
#: Exact comparison: classes and grams of a block. Two blocks meet in one task.
BLOCK_ROWS, BLOCK_GRAMS = 800, 1_000_000

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def grams_of(text: str | None, k: int = GRAM) -> np.ndarray:
    """Sorted distinct hashes of the k-grams of a text; a shorter text is one gram, no words are none."""
    words = word_hashes(text)
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else words


def tokens_of(grams: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(grams), 4096):
        hashed = grams[at:at + 4096, None] * _A
        hashed += _B
        np.minimum(out, (hashed.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold is missed with probability 1 - recall at most."""
    f = 1.0
    for _ in range(200):
        f = 1 - (1 - threshold * f) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - f) - 1e-9)) if f < 1 else 1


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row key, digest of the gram set ('' without words), number of grams and tokens of ``docs`` (doc_id, key, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [grams_of(t, k) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([hashlib.md5(g.tobytes()).digest() if len(g) else b"" for g in sets], pa.binary()),
                    pa.array([len(g) for g in sets], pa.int64()),
                    pa.array([tokens_of(g).tobytes() if len(g) else b"" for g in sets], pa.binary())],
                    ["doc_id", "key", "digest", "size", "tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, key string, digest binary, size bigint, tokens binary")


def children(nodes: DataFrame) -> DataFrame:
    """Two child buckets for every row (digest, path, parent size, tokens)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(1).to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS)
            chosen = np.argpartition(mix(path[:, None] ^ steps), 1, axis=1)[:, :2]
            taken = np.take_along_axis(tokens, chosen, axis=1).astype(np.uint64)
            child = mix(mix(path[:, None] + steps[chosen]) ^ taken)
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(twice), pa.array(child.view(np.int64).ravel()), batch.column(2).take(twice)],
                ["digest", "path", "parent"])

    return nodes.select("digest", "path", "parent", "tokens").mapInArrow(run, "digest binary, path bigint, parent bigint")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of consecutive rows with one value in the first column."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if held and keys[a] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(n: int, links: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Smallest member of the component of each of n nodes; links: a node and its neighbours."""
    root = np.arange(n)
    for i, others in links:
        if len(others):
            roots = np.unique(root[np.append(others, i)])
            if len(roots) > 1:
                root[np.isin(root, roots[1:])] = roots[0]
    return root


def bucket_edges(leaves: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (a, b): each class with the first of its local component, by shared tokens."""
    least = (threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)) * TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            if group.num_rows < 2:
                continue
            digests = group.column(1).to_pylist()
            tokens = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
            near = ((i, i + 1 + np.flatnonzero((tokens[i + 1:] == tokens[i]).sum(axis=1) >= least)) for i in range(len(tokens) - 1))
            root = components(len(tokens), near)
            own = [(digests[i], digests[r]) for i, r in enumerate(root) if i != r]
            if own:
                a, b = zip(*own)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    spread = leaves.select("path", "digest", "tokens").repartition("path").sortWithinPartitions("path", "digest")
    return spread.mapInArrow(run, "a binary, b binary").distinct()


def candidate_edges(classes: DataFrame, threshold: float, recall: float, bucket: int = BUCKET) -> DataFrame:
    """Edges between classes that meet in some bucket of some run and look similar there."""
    roots = F.explode(F.array(*[F.lit(r).cast("long") for r in range(runs_for(threshold, recall))]))
    tokens = classes.select("digest", "tokens")
    nodes = classes.select("digest", roots.alias("path"), F.lit(None).cast("long").alias("parent"), "tokens")
    found = []
    while True:
        rows = children(nodes)
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("digest").alias("first")).where("n > 1")
        sizes = stored(sizes, "bucket-sizes")
        shared = stored(rows.select("digest", "path").join(sizes, "path"), "bucket-rows")
        dense = (F.col("n") > bucket) & (F.col("n") > DENSE * F.col("parent"))
        found.append(bucket_edges(shared.where(F.col("n") <= bucket).join(tokens, "digest"), threshold))
        found.append(shared.where(dense & (F.col("digest") != F.col("first"))).select(F.col("digest").alias("a"), F.col("first").alias("b")))
        again = shared.where((F.col("n") > bucket) & ~F.coalesce(dense, F.lit(False)))
        if again.isEmpty():
            break
        nodes = again.select("digest", "path", F.col("n").alias("parent")).join(tokens, "digest")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return stored(edges.distinct(), "candidates")


def connected(edges: DataFrame) -> DataFrame:
    """node and root (smallest member) for every node of ``edges`` (a, b), by alternating large and small stars."""
    now, before = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").distinct()
        large = stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = stored(small, "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark


def exact_links(members: DataFrame, texts: DataFrame, threshold: float, k: int, block_rows: int, block_grams: int) -> DataFrame:
    """Per class: edges (digest, first) of linked classes and the number of documents linked through them.

    ``members``: digest, cluster, key of a row to read the text by, n documents, size. Large clusters are
    cut into blocks, and every two blocks meet in one group; each pair is compared once.
    """
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_grams)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # always by a shuffle, so that the cost follows the input and never jumps where a broadcast ends
    chosen = placed.join(texts.hint("merge"), F.col("key") == F.col("_key")).select(
        "cluster", "digest", "n", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.concat_ws(":", F.hex("cluster"), F.least("block", "other"), F.greatest("block", "other"))
    spread = chosen.select(key.alias("key"), "digest", "n", "block", "other", "text").repartition("key").sortWithinPartitions("key", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            seen, sets, n, block = [], [], [], []
            # the key tells whether a block meets itself, as the other block may have no rows here
            inside = group.column(3)[0].as_py() == group.column(4)[0].as_py()
            for digest, docs, own, text in zip(*(group.column(i).to_pylist() for i in (1, 2, 3, 5))):
                if seen and seen[-1] == digest:
                    continue  # another row of the same document
                grams = grams_of(text, k)
                if hashlib.md5(grams.tobytes()).digest() == digest:
                    seen.append(digest), sets.append(grams), n.append(docs), block.append(own)
            if len(seen) < 2:
                continue
            linked = similar(sets, threshold)
            block, n = np.array(block), np.array(n, np.int64)
            if not inside:
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            docs = (linked * n[None, :]).sum(axis=1)
            root = components(len(seen), ((i, np.flatnonzero(linked[i])) for i in range(len(seen))))
            some = np.flatnonzero(docs)
            if len(some):
                yield pa.RecordBatch.from_arrays([
                    pa.array([seen[i] for i in some], pa.binary()), pa.array([seen[root[i]] for i in some], pa.binary()),
                    pa.array(docs[some], pa.int64())], ["a", "b", "links"])

    return spread.mapInArrow(run, "a binary, b binary, links bigint")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of the threshold or more, exactly."""
    sizes = np.array([len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column, minlength=len(grams)) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(often.sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9


def row_key(id_col: str, text_col: str) -> Column:
    """What tells a row from others: its id, or that it has none, and its text by 128 bits."""
    own = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    return F.concat(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), own)


def judged(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, recall: float = RECALL,
           k: int = GRAM, bucket: int = BUCKET, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """``near_duplicates`` with the row key and the ``root`` of the class, NULL of a text without words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    known = stored(signed(rows, k), "signed")
    classes = stored(known.where("size > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("tokens").alias("tokens")), "classes")
    clusters = connected(candidate_edges(classes, threshold, recall, bucket))
    members = stored(clusters.join(classes, clusters["node"] == classes["digest"]).select(
        "digest", F.col("root").alias("cluster"), "key", "n", "size"), "members")
    links = stored(exact_links(members, rows.select(F.col("key").alias("_key"), "text"), threshold, k, block_rows, block_grams), "links")
    parts = connected(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    linked = classes.select("digest", "doc_id", "n").join(counts, F.col("digest") == F.col("a"), "left").join(
        parts, F.col("digest") == F.col("node"), "left").select(
        "digest", "doc_id", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "digest").alias("root"))
    linked = stored(linked, "linked")
    lowest = linked.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    facts = stored(linked.join(lowest, "root").select("digest", "n", "class_id", "n_links", "root"), "class-facts")
    out = add_facts(known.select("doc_id", "key", "digest"), facts, "digest", "n", F.col("key"))
    empty = F.length("digest") == 0
    return out.select("doc_id", "key", "root", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id and n_links, one row per row of ``docs``.

    n_links counts the other documents whose gram set has at least the threshold's similarity,
    equal sets included; class_id is the smallest id of the documents connected by links.
    Texts without words (NULL, empty) link to nothing and are classes of their own. Repeated
    rows are copies of each other. NULL ids take part and never name a class unless all its ids
    are NULL. An empty table gives no rows; other columns are ignored. ``options`` are those of
    ``judged``.
    """
    return judged(docs, id_col, text_col, **options).drop("key", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps its document of smallest id.

    Different texts under one id are different documents: where they are in different classes, each
    class keeps its own; where they are in one class, one of them stays. A class without any id keeps
    one row. Of rows that repeat id and text one stays, also of texts without words.
    """
    rows = judged(docs, id_col, text_col, **options)
    first = rows.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("key").alias("_kept")).select("_kept")
    kept = stored(first.unionByName(rows.where(F.col("root").isNull()).select(F.col("key").alias("_kept")).distinct()), "kept")
    whole = docs.select(row_key(id_col, text_col).alias("_key"), F.struct("*").alias("_row"))
    stay = whole.join(kept.hint("merge"), F.col("_key") == F.col("_kept"), "left_semi")
    # the join has put the rows of a key together already
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_row")))
    return stay.withColumn("_place", place).where("_place = 1").select("_row.*")
