"""Phrase collocations: counts of word runs by vertical partitioning, scored by their weakest cut.

Words get 64-bit ids (those of frequent words are checked to be distinct) and texts are written once
as slices of codes. Runs of up to ``depth`` words are suffixes of the text, cut off at that depth.
Prefixes of suffixes are counted; a prefix with more suffixes than one task's memory budget is
replaced by its extensions by one word, and the rest are packed, in order of their keys, into groups
of the budget's size. Every group is one independent task: its suffixes, with equal ones of a slice
already merged, are sorted, which lays out the group's subtree, and the count of a node is the total
of its leaves.

The range read per suffix is elastic: it ends before a rare word, and before a pair of neighbours
that is rare by the counts of fingerprints, which are never too small. A phrase of rare words or
pairs cannot be frequent, so nothing is lost. Frequent words and pairs reach the tasks as bits of
bounded number; a bit shared by chance costs time, never a count.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.llm.common import stored
from evtlake.llm.jaccard_join import sorted_groups
from evtlake.llm.keys import Sieve, bits_for, extended, fingerprints, recurring
from evtlake.llm.word_slices import Classes, slices
from evtlake.plans import ordering

DEPTH, LEAST, TOP = 5, 100, 2000
#: Suffixes of a group, and how many groups there are at most; beyond that the groups grow.
BUDGET, MOST_GROUPS = 1_000_000, 1 << 20
STEP = 1 << 21
NO_LANG = "und"
WORDS = Classes(b" \t", b".,;:!?\n\x0b\x0c\r")


# --- texts as codes -----------------------------------------------------------------


def coded(docs: DataFrame, text_col: str, lang_col: str, seed: int, ahead: int) -> DataFrame:
    """Two kinds of rows: words (lang, word, id, n) counted per slice, and slices (lang, n words, ids, codes).

    A code is the 1-based place among the slice's ids, negative for context words, 0 for a break.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                by_lang: dict[str, list[str | None]] = {}
                part = batch.slice(at, 2048)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for s in slices(texts, WORDS, ahead, STEP):
                        if not len(s.codes):
                            continue
                        name = lang.encode() + b"\0"
                        ids = np.array([xxhash.xxh3_64_intdigest(name + w, seed) or 1 for w in s.words.to_pylist()], np.uint64).view(np.int64)
                        n = np.bincount(s.codes[s.owned], minlength=len(ids))
                        codes = np.zeros(len(s.codes) + int((~s.follows).sum()), np.int32)
                        codes[np.arange(len(s.codes)) + np.cumsum(~s.follows) - ~s.follows] = np.where(s.owned, s.codes + 1, -1 - s.codes)
                        some = np.flatnonzero(n)
                        none = pa.nulls(len(some), pa.binary())
                        last = lambda kind, x: pa.array([x], kind)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.arange(len(some) + 1) == len(some)), pa.array([lang] * (len(some) + 1)),
                            pa.concat_arrays([s.words.take(pa.array(some)).cast(pa.binary()), last(pa.binary(), None)]),
                            pa.concat_arrays([pa.array(ids[some]), last(pa.int64(), None)]),
                            pa.concat_arrays([pa.array(n[some]), last(pa.int64(), int(n.sum()))]),
                            pa.concat_arrays([none, last(pa.binary(), ids.tobytes())]), pa.concat_arrays([none, last(pa.binary(), codes.tobytes())])],
                            ["is_slice", "lang", "word", "id", "n", "ids", "codes"])

    rows = docs.select(F.coalesce(lang_col, F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "is_slice boolean, lang string, word binary, id bigint, n bigint, ids binary, codes binary")


def as_key(id_col: Column) -> Column:
    """A word id as the eight bytes it has inside a phrase, lowest first."""
    digits = F.lpad(F.hex(id_col), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def coded_corpus(docs: DataFrame, text_col: str, lang_col: str, ahead: int, least: int) -> tuple[DataFrame, DataFrame, Sieve]:
    """Slices (lang, n, ids, codes), the frequent words (lang, word, id, n), and their ids, which are distinct."""
    spark = docs.sparkSession
    for seed in range(16):
        rows = stored(coded(docs, text_col, lang_col, seed, ahead), "coded", "zstd")
        often = rows.where("not is_slice").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        known = Sieve(stored(often.select("id"), "frequent-ids"))
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.holds(batch.column(2).to_numpy())))

        spelled = rows.where("not is_slice").select("lang", "word", "id", "n").mapInArrow(run, "lang string, word binary, id bigint, n bigint")
        # a word is frequent or it is not: two words of one id are told apart here, and then another seed is tried
        words = stored(spelled.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words")
        shared = words.groupBy("id").agg(F.count("*").alias("words"), F.sum("n").alias("n")).where((F.col("words") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return rows.where("is_slice").select("lang", "n", "ids", "codes"), words.where(F.col("n") >= least), known
    raise RuntimeError("no seed gives distinct word ids")


# --- sieves and routes --------------------------------------------------------------


def suffixes(ids: np.ndarray, codes: np.ndarray, depth: int, words: Sieve, pairs: Sieve | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of a slice in order of their digests, [n, depth] ids with 0 after their end, and how often each occurs.

    They end before a word or a pair that the sieves do not hold; those of one word are left out.
    """
    at = np.abs(codes).astype(np.int64) - 1
    alive = (codes != 0) & words.holds(ids)[at]
    joined = alive[:-1] & alive[1:]
    if pairs is not None:
        both = np.flatnonzero(joined)
        joined[both] = pairs.holds(extended(ids[at[both]], ids[at[both + 1]]))
    joined = np.append(joined, np.zeros(depth, bool))
    starts = np.flatnonzero((codes > 0) & joined[:len(codes)])
    out = np.zeros((depth, len(starts)), np.int64)
    on = np.ones(len(starts), bool)
    for j in range(depth):
        if j:
            on = on & joined[starts + j - 1]
        out[j, on] = ids[at[starts[on] + j]]
    digest = out[0]
    for j in range(1, depth):
        digest = extended(digest, out[j])
    order = np.argsort(digest.view(np.uint64))
    out = out[:, order]
    # suffixes of one digest are neighbours, and they are compared themselves
    first = np.flatnonzero(np.append(True, (out[:, 1:] != out[:, :-1]).any(axis=0))) if len(order) else order
    return out[:, first].T, np.diff(np.append(first, len(order)))


def frequent_pairs(corpus: DataFrame, words: Sieve, least: int, budget: int) -> Sieve:
    """Pairs of frequent words that occur ``least`` times or more by the counts of their fingerprints."""
    total = corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = bits_for(total, budget)
    sent = corpus.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, codes in zip(*(column.to_pylist() for column in batch.columns)):
                rows, n = suffixes(np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int32), 2, sent.value, None)
                yield fingerprints(extended(np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1])).view(np.uint64), n, bits)

    return recurring(corpus.select("ids", "codes").mapInArrow(run, "bucket bigint, prints binary, n binary"), bits, least)


def route(rows: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the prefix that a suffix belongs to, and how many shorter prefixes of it were too large."""
    key, levels, on = rows[:, 0], np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
    for j in range(1, rows.shape[1]):
        if not len(hot) or not on.any():
            break
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        large = on & (hot[place] == key)
        levels += large
        on = large & (rows[:, j] != 0)
        key = np.where(on, extended(key, rows[:, j]), key)
    return key, levels


# --- groups and their subtrees ------------------------------------------------------


def group_prefixes(corpus: DataFrame, depth: int, words: Sieve, pairs: Sieve, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of prefixes that are too large for a group, and the first key of every group but the first.

    Both have about as many entries as there are groups, MOST_GROUPS at most.
    """
    spark = corpus.sparkSession
    hot, sized = np.empty(0, np.int64), None
    for level in range(1, depth + 1):
        sent = spark.sparkContext.broadcast((hot, words, pairs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot, words, pairs = sent.value
            for batch in batches:
                for ids, codes in zip(*(column.to_pylist() for column in batch.columns)):
                    rows, n = suffixes(np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int32), depth, words, pairs)
                    key, levels = route(rows, hot)
                    # at a level the prefixes of that many words are counted, below prefixes that were too large
                    here = (levels == level - 1) & (rows[:, level - 1] != 0)
                    keys, of = np.unique(key[here], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(of, n[here], len(keys)).astype(np.int64))], ["key", "n"])

        found = stored(corpus.select("ids", "codes").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "prefixes")
        if level == 1:
            total = found.agg(F.sum("n")).first()[0] or 0
            budget = max(budget, -(-total // MOST_GROUPS))
        # equal suffixes are merged per slice, so whole ones are small however often they occur
        last = level == depth
        mine = found if last else found.where(F.col("n") <= budget)
        mine = mine.select("key", F.least("n", F.lit(budget)).alias("n"))
        sized = mine if sized is None else sized.unionByName(mine)
        more = np.empty(0, np.int64) if last else np.array([r.key for r in found.where(F.col("n") > budget).select("key").collect()], np.int64)
        if not len(more):
            break
        hot = np.sort(np.concatenate([hot, more]))
    placed = ordering.running_total(sized.withColumn("_b", F.shiftright("key", 52)), "_at", F.col("n"), ["_b"], [F.col("key")])
    firsts = placed.groupBy(F.expr(f"_at div {budget}").alias("g")).agg(F.min("key").alias("key")).where("g > 0")
    return hot, np.sort(np.array([r.key for r in firsts.collect()], np.int64))


def subtree_counts(corpus: DataFrame, depth: int, words: Sieve, pairs: Sieve, least: int, budget: int) -> DataFrame:
    """phrase (ids of 2 to ``depth`` words, eight bytes each) and n of all runs that occur ``least`` times or more."""
    hot, bounds = group_prefixes(corpus, depth, words, pairs, budget)
    sent = corpus.sparkSession.sparkContext.broadcast((hot, bounds, words, pairs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, bounds, words, pairs = sent.value
        for batch in batches:
            for ids, codes in zip(*(column.to_pylist() for column in batch.columns)):
                rows, n = suffixes(np.frombuffer(ids, np.int64), np.frombuffer(codes, np.int32), depth, words, pairs)
                key, _ = route(rows, hot)
                order = np.argsort(key)
                rows, n = rows[order], n[order]
                groups = np.searchsorted(bounds, key[order], "right")
                own, firsts = np.unique(groups, return_index=True)
                ends = np.append(firsts[1:], len(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own, pa.int32()),
                    pa.array([rows[a:b].T.tobytes() for a, b in zip(firsts, ends)], pa.binary()),
                    pa.array([n[a:b].astype(np.int64).tobytes() for a, b in zip(firsts, ends)], pa.binary())], ["group", "rows", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value[0]
        for group in sorted_groups(batches):
            rows = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(depth, -1) for x in group.column(1)], axis=1)
            n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column(2)])
            order = np.lexsort(rows[::-1])
            rows, n = np.ascontiguousarray(rows[:, order]), n[order]
            new = np.append(True, rows[0, 1:] != rows[0, :-1])
            for level in range(2, depth + 1):
                ids = rows[level - 1]
                new = new | np.append(True, ids[1:] != ids[:-1])
                starts = np.flatnonzero(new)
                total = np.add.reduceat(n, starts)
                nodes = rows[:level, starts]
                _, levels = route(np.vstack([nodes, np.zeros((1, len(starts)), np.int64)]).T if level < depth else nodes.T, hot)
                # a prefix that was too large has leaves in other groups too
                keep = np.flatnonzero((nodes[-1] != 0) & ((total >= least) | ((levels >= level) & (level < depth))))
                if len(keep):
                    flat = np.ascontiguousarray(nodes[:, keep].T)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in flat], pa.binary()), pa.array(total[keep])], ["phrase", "n"])

    dealt = corpus.select("ids", "codes").mapInArrow(deal, "group int, rows binary, n binary").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(build, "phrase binary, n bigint").groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- phrases ------------------------------------------------------------------------


def part(phrase: Column, first: Column | int, words: Column | int) -> Column:
    """Ids of ``words`` words from the ``first`` one, counted from 0."""
    number = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(phrase, number(first) * 8 + 1, number(words) * 8)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST,
                 top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` best phrases of every language.

    Phrases have 2 to ``depth`` words and occur ``least`` times or more. Score is that of the cut
    that scores least, floor(1000 * a * n / (l * r)) in whole numbers. A phrase that only occurs
    inside a longer one is left out. Ties go by count, then by the phrase's bytes. NULL and empty
    texts have no words; a NULL language is ``und``; repeated rows count repeatedly. A table without
    frequent phrases gives no rows; other columns are ignored.
    """
    corpus, frequent, known = coded_corpus(docs, text_col, lang_col, depth - 1, least)
    pairs = frequent_pairs(corpus, known, least, budget)
    phrases = stored(subtree_counts(corpus, depth, known, pairs, least, budget), "phrases")
    singles = frequent.select(as_key(F.col("id")).alias("phrase"), "lang", "word", "n")
    counts = phrases.unionByName(singles.select("phrase", "n"))
    size = (F.length("phrase") / 8).cast("int")
    # every phrase inside a longer one with as many occurrences is inside one that is longer by a word
    inner = phrases.where(size > 2).select(F.explode(F.array(part(F.col("phrase"), 0, size - 1), part(F.col("phrase"), 1, size - 1))).alias("phrase"), "n").distinct()
    kept = phrases.join(inner, ["phrase", "n"], "left_anti")
    cuts = kept.select("phrase", F.col("n").alias("a"), size.alias("size"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left = counts.select(F.col("phrase").alias("_l"), F.col("n").alias("l"))
    right = counts.select(F.col("phrase").alias("_r"), F.col("n").alias("r"))
    cut = cuts.join(left, part(F.col("phrase"), 0, F.col("k")) == F.col("_l")).join(
        right, part(F.col("phrase"), F.col("k"), F.col("size") - F.col("k")) == F.col("_r"))
    totals = corpus.groupBy("lang").agg(F.sum("n").alias("total"))
    owner = singles.select(F.col("phrase").alias("_w"), "lang").join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cut.join(owner, part(F.col("phrase"), 0, 1) == F.col("_w")).withColumns(
        {"_up": exact("a") * exact("total") * F.lit(1000).cast("decimal(4,0)"), "_down": exact("l") * exact("r")}).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("phrase", "lang", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select(
        "phrase", "lang", "a", "n", "_c.l", "_c.r", "_c.score")
    order = [F.desc("score"), F.desc("a")]
    near = best.withColumn("_place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_place") <= top)
    spelled = near.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("_i")).join(
        singles.select(F.col("phrase").alias("_w"), F.col("word").cast("string").alias("word")), part(F.col("phrase"), F.col("_i"), 1) == F.col("_w"))
    named = spelled.groupBy("lang", F.col("phrase").alias("_ids"), "a", "l", "r", "n", "score").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
