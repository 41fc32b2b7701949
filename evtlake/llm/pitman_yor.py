"""Hierarchical Pitman-Yor language model: a restaurant for every preceding word, all sharing the root.

Every word, and the begin of a text, has a restaurant: its customers are the tokens that follow the
word. Each table of a restaurant is a customer of the root, whose base is uniform over the training
tokens and one unknown token. Seating is sampled by blocked Gibbs sweeps: in a sweep, all customers of
a dish leave their restaurant and are seated again one after the other, given the tables of the
restaurant's other dishes and the root's probability of the dish, and then the dish's customers at the
root. Dishes of a sweep are seated side by side, each seeing the totals that the sweep before has left.
Runs of customers that join existing tables are skipped by thinning, so a dish costs about as much as
it has tables, however many customers there are. The predictive probabilities of the last sweeps are
averaged for each token.

Texts are written once as slices of codes. Counts of slices meet in blocks. Restaurants of heavy words,
which make up CONTEXT_SHARE of the training tokens or more, are dealt by the word that follows: there
are at most 1 / CONTEXT_SHARE of them, so no word is large, the root's customers of a word are in its
block, and their totals are one row per restaurant. Restaurants of all other words are whole in the
block of their word (``Light``), so their totals move nowhere. There a dish of one customer has one
table whatever happens; for the others the root's counts of their words come from the blocks of words
before each sweep, and their tables go back. In the end the slices' words and pairs are looked up in
the blocks, and what the slices need for their probabilities comes back.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evtlake.llm.common import release, stored
from evtlake.llm.jaccard_join import sorted_groups
from evtlake.llm.keys import bits_for, grown, shrunk
from evtlake.llm.word_slices import Classes, Slice, slices
from evtlake.llm.words import mix

BURN_IN, SAMPLES, STRENGTH, SEED = 1, 3, 1.0, 5
#: Least share of the training tokens of a word whose restaurant is dealt by the words that follow.
CONTEXT_SHARE = 2e-4
STEP = 1 << 22
#: Words of slices that one task handles at a time.
BUCKET = 250_000
#: Training tokens in a block of other restaurants.
LIGHT_BUCKET = 2_000_000
BEGIN, END = 1, 2
WORDS = Classes(b" \t\n\x0b\x0c\r")
ASKS = "bucket bigint, slice bigint, names binary, n binary, m binary, ctx binary, c binary"
BLOCKS = "bucket bigint, names binary, n binary, m binary, ctx binary, c binary, fixed binary, routes binary, places binary, t binary, root binary"
LIGHT_ASKS = "bucket bigint, slice bigint, names binary, m binary, words binary, w binary, c binary"
LIGHT = "bucket bigint, kind int, slice bigint, names binary, once binary, m binary, words binary, w binary, c binary, t binary"
#: Kinds of LIGHT rows: all pairs of a block; those with several customers; places of a slice's pairs; words for a block of words; their tables.
PAIRS, LIVE, PLACES, WORDS_OF, TABLES_OF = range(5)


#: Spark removes the shuffles of a write when it has ended, and its tasks hold few of the large rows at a time.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
           "spark.sql.parquet.columnarReaderBatchSize": "16"}
#: Bytes of rows that a task hands over at a time.
PORTION = 1 << 21


def settled(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """``stored``, after which the shuffles that led to it are removed."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        conf.set(key, value)
    try:
        return stored(df, name, compression)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def by_group(one: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``one`` for every group of sorted rows; what it held is gone when the next group comes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            yield from one(group)
            del group
            pa.default_memory_pool().release_unused()

    return run


def by_row(one: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``one`` for the values of every row; what it held is gone when the next row comes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(*(c[i].as_py() for c in batch.columns))
            pa.default_memory_pool().release_unused()

    return run


# --- texts as slices ----------------------------------------------------------------


def sliced(docs: DataFrame, seed: int, step: int) -> DataFrame:
    """Slices of ``docs`` (doc_id, held_out, text): their words' ids with counts of training tokens, and codes; ``n`` is the number of words.

    The codes of a part are the 1-based places of its words among the slice's sorted ids, with BEGIN and
    END at the ends of a text; a negative code is context of a cut part, 0 ends a part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(s: Slice, opens: np.ndarray, held: np.ndarray, doc_ids: pa.Array, row: int, at: int) -> pa.RecordBatch:
        parts = len(s.rows)
        inner = np.bincount(s.part, minlength=parts)
        sizes = opens + inner + s.last + 1
        ends = np.cumsum(sizes)
        begins = ends - sizes
        codes = np.zeros(ends[-1], np.int32)
        codes[begins[opens]] = 1
        codes[ends[s.last] - 2] = 2
        place = np.arange(len(s.part)) + (begins + opens - (np.cumsum(inner) - inner))[s.part]
        codes[place] = np.where(s.owned, s.codes + 3, -3 - s.codes)
        ids = np.array([BEGIN, END, *(xxhash.xxh3_64_intdigest(w, seed) for w in s.words.to_pylist())], np.uint64).view(np.int64)
        ids[2:][(ids[2:] >= 0) & (ids[2:] <= END)] += END + 1
        order = np.argsort(ids.view(np.uint64))
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(1, len(ids) + 1)
        codes = np.where(codes == 0, 0, np.sign(codes) * rank[np.abs(codes) - 1]).astype(np.int32)
        n = np.bincount(s.codes[s.owned & ~held[s.part]], minlength=len(ids) - 2)
        n = np.concatenate([[(opens & ~held).sum(), (s.last & ~held).sum()], n]).astype(np.int64)[order]
        ids = ids[order]
        return pa.RecordBatch.from_arrays([
            pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, parts], pa.int32()), doc_ids),
            *[pa.array([x], pa.binary()) for x in ((row + s.rows).tobytes(), held.tobytes(), ids.tobytes(), shrunk(n), shrunk(codes))]],
            ["slice", "n", "doc_ids", "owners", "held", "ids", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = at = TaskContext.get().partitionId() << 33
        first = True
        for batch in batches:
            held_out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for s in slices((x.as_py() for x in batch.column(2)), WORDS, 1, step):
                opens, first = np.append(first, s.last[:-1]), s.last[-1]
                yield one(s, opens, held_out[s.rows], batch.column(0).take(pa.array(s.rows)), row, at)
                # before the next one is made
                del s
                at += 1
            row += batch.num_rows
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, f"slice bigint, n bigint, doc_ids array<{kind}>, owners binary, held binary, ids binary, counts binary, codes binary")


def word_counts(corpus: DataFrame) -> DataFrame:
    """id and n of every training word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n in zip(*(c.to_pylist() for c in batch.columns)):
                n = grown(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[n > 0]), pa.array(n[n > 0])], ["id", "n"])

    return corpus.select("ids", "counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def context_of(ids: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """The restaurant of every word, -1 for none."""
    place = np.minimum(np.searchsorted(contexts, ids), len(contexts) - 1)
    return np.where(contexts[place] == ids, place, -1).astype(np.int32)


def cuts(ids: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of the runs of sorted ids that share their leading bits."""
    key = ids.view(np.uint64)
    own, firsts = np.unique((key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)).astype(np.int64), return_index=True)
    return list(zip(own.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(key)]))


class Counts:
    """Words of a slice, and its distinct pairs of a context and a word, by word and context."""

    def __init__(self, own: np.ndarray, codes: bytes, held: bytes, contexts: int):
        codes, self.held = grown(codes, np.int32), np.frombuffer(held, bool)
        at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] != 0))
        self.part = np.cumsum(codes == 0, dtype=np.int32)[at]
        self.word = np.abs(codes[at + 1]) - 1
        context = own[codes[at] - 1]
        train = ~self.held[self.part]
        self.n = np.bincount(self.word, train, len(own)).astype(np.int64)
        #: of every token, its pair or -1
        self.pair = np.full(len(at), -1, np.int32)
        inside = context >= 0
        distinct, of = np.unique(self.word[inside].astype(np.int64) * contexts + context[inside], return_inverse=True)
        self.pair[inside] = of
        self.c = np.bincount(of, train[inside], len(distinct)).astype(np.int64)
        self.owner, self.ctx = np.divmod(distinct, contexts)
        self.m = np.bincount(self.owner, minlength=len(own))
        self.rest, self.train, self.before, self.size = np.flatnonzero(~inside), train, codes[at] - 1, len(own)

    def light(self) -> tuple[np.ndarray, ...]:
        """Distinct pairs after other words, by that word and the next: both words, training count; and the pair of every token in ``rest``."""
        distinct, of = np.unique(self.before[self.rest].astype(np.int64) * self.size + self.word[self.rest], return_inverse=True)
        c = np.bincount(of, self.train[self.rest], len(distinct)).astype(np.int64)
        return *np.divmod(distinct, max(1, self.size)), c, of

    def packed(self, ids: np.ndarray, bits: int) -> list[tuple[int, list[bytes]]]:
        """Names, counts, numbers of pairs, contexts and their counts by bucket of the word."""
        ends = np.concatenate([[0], np.cumsum(self.m)])
        out = []
        for name, i, j in cuts(ids, bits):
            pairs = slice(ends[i], ends[j])
            out.append((name, [ids[i:j].tobytes(), *map(shrunk, (self.n[i:j], self.m[i:j], self.ctx[pairs].astype(np.int32), self.c[pairs]))]))
        return out


def dealt(corpus: DataFrame, contexts: np.ndarray, bits: int) -> DataFrame:
    """The counts of every slice, packed by bucket."""
    sent = corpus.sparkSession.sparkContext.broadcast(contexts)

    def one(number: int, ids: bytes, codes: bytes, held: bytes) -> pa.RecordBatch:
        ids = np.frombuffer(ids, np.int64)
        rows = Counts(context_of(ids, sent.value), codes, held, len(sent.value)).packed(ids, bits)
        return pa.RecordBatch.from_arrays([
            pa.array([b for b, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
            *[pa.array([x[i] for _, x in rows], pa.binary()) for i in range(5)]], ["bucket", "slice", "names", "n", "m", "ctx", "c"])

    return corpus.select("slice", "ids", "codes", "held").mapInArrow(by_row(one), ASKS)


def _columns(row: dict) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["names"], np.int64), *(grown(row[c], kind) for c, kind in (("n", np.int64), ("m", np.int64), ("ctx", np.int32), ("c", np.int64)))


def blocks(asks: DataFrame, contexts: int, told: DataFrame | None) -> DataFrame:
    """Blocks of training words: their counts and pairs with customers, one table each to begin with.

    ``told`` are the words of other restaurants; without it, tokens after other words are customers of the root.
    """
    with_light = told is not None

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        every = group.to_pylist()
        rows = [_columns(row) for row in every if row["slice"] >= 0]
        names, n, m, ctx, c = (np.concatenate(x) for x in zip(*rows))
        words, of = np.unique(names.view(np.uint64), return_inverse=True)
        n = np.bincount(of, n, len(words)).astype(np.int64)
        pairs, place = np.unique(np.repeat(of, m) * contexts + ctx, return_inverse=True)
        c = np.bincount(place, c, len(pairs)).astype(np.int64)
        keep = n > 0
        if not keep.any():
            return
        pairs, c = pairs[c > 0], c[c > 0]
        owner, ctx = np.divmod(pairs, contexts)
        m = np.bincount(owner, minlength=len(words))[keep]
        size, kept = int(keep.sum()), words[keep]
        # customers of the root: one for each table, and tokens after words without a restaurant
        fixed = (n - np.bincount(owner, c, len(words)).astype(np.int64))[keep] * (not with_light)
        cw, routes, places = fixed + m, [], [np.zeros(0, np.int32)]
        for row in every:
            if row["slice"] < 0:
                at = np.searchsorted(kept, np.frombuffer(row["names"], np.uint64))
                once, many = grown(row["once"], np.int64), grown(row["many"], np.int64)
                fixed[at] += once
                cw[at] += once + many
                if many.any():
                    places.append(at[many > 0].astype(np.int32))
                    routes.append((-1 - row["slice"], len(places[-1])))
        parts = [kept.view(np.int64), n[keep], m, ctx.astype(np.int32), c, fixed, np.array(routes, np.int64), np.concatenate(places), np.ones_like(c), np.stack([cw, np.ones(size, np.int64)])]
        yield pa.RecordBatch.from_arrays([group.column(0).slice(0, 1).combine_chunks(), pa.array([parts[0].tobytes()], pa.binary()), *[pa.array([shrunk(x)], pa.binary()) for x in parts[1:]]],
                                         ["bucket", "names", "n", "m", "ctx", "c", "fixed", "routes", "places", "t", "root"])

    if with_light:
        asks = asks.unionByName(told, allowMissingColumns=True)
    return asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(by_group(one), BLOCKS)


# --- seating ------------------------------------------------------------------------


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and step alone."""
    x = mix(key.view(np.uint64) ^ mix(np.array([step], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def seat(c: np.ndarray, rate: np.ndarray, more: np.ndarray | float, discount: float, key: np.ndarray, seed: int) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, seated one after the other.

    The first customer opens a table; with t tables, the next one opens another with weight
    ``rate`` + ``more`` * t and joins one of the dish's with weight seated - discount * t.
    """
    t = (c > 0).astype(np.int64)
    live, step = np.flatnonzero(c > 1), seed << 20
    at = np.ones(len(live))
    more = np.broadcast_to(np.asarray(more, np.float64), c.shape)
    while len(live):
        tables = t[live]
        new = rate[live] + more[live] * tables
        # the chance of a new table falls with every customer, so candidates come at the present chance and are thinned
        chance = new / (at - discount * tables + new)
        with np.errstate(divide="ignore"):
            gap = np.floor(np.log(uniform(key[live], step)) / np.log1p(-chance)) + 1
        at = at + np.where(chance > 0, np.where(chance < 1, gap, 1), np.inf)
        inside = at <= c[live]
        t[live[inside & (uniform(key[live], step + 1) * chance < new / (at - 1 - discount * tables + new))]] += 1
        keep = inside & (at < c[live])
        live, at, step = live[keep], at[keep], step + 2
    return t


def root_probability(cw: np.ndarray, tw: np.ndarray, root: dict) -> np.ndarray:
    d, a = root["discount"], root["strength"]
    return (np.maximum(cw - d * tw, 0) + (a + d * root["tables"]) * root["base"]) / (a + root["customers"])


def discount_of(ones: int, twos: int) -> float:
    """Discount by the numbers of dishes with one and with two customers."""
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


class Block:
    """Words of a block with the pairs of their restaurants; ``t`` and ``root`` hold the last state first, then the samples'."""

    def __init__(self, row: dict):
        self.names, self.n, self.m, self.ctx, self.c = _columns(row)
        self.owner = np.repeat(np.arange(len(self.names)), self.m)
        root = grown(row["root"], np.int64)
        states = len(root) // max(1, 2 * len(self.names))
        self.root = root.reshape(states, 2, len(self.names))
        self.t = grown(row["t"], np.int64).reshape(states, len(self.c))
        self.fixed = grown(row["fixed"], np.int64)

    @staticmethod
    def routes(row: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Every block of other restaurants that seats words of this one, and their places."""
        places, at = grown(row["places"], np.int32), 0
        for light, size in grown(row["routes"], np.int64).reshape(-1, 2).tolist():
            yield light, places[at:at + size]
            at += size

    def totals(self, contexts: int) -> np.ndarray:
        """Tables and customers per restaurant, and of the root at the end."""
        sides = [np.bincount(self.ctx, x, contexts) for x in (self.t[0], self.c)]
        return np.column_stack([np.append(s, r.sum()) for s, r in zip(sides, self.root[0][::-1])]).astype(np.int64)


def swept(state: DataFrame, ups: DataFrame | None, tables: np.ndarray, root: dict, leaf: dict, seed: int, keep: bool) -> DataFrame:
    """``state`` after a sweep; ``tables`` are those of every restaurant, and the new ones are appended where ``keep`` is set.

    ``ups`` are the tables that blocks of other restaurants have for words of a block.
    """
    sent = state.sparkSession.sparkContext.broadcast(tables)

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        row, *others = group.to_pylist()
        b = Block(row)
        cw, tw = b.root[0]
        p = root_probability(cw, tw, root)[b.owner]
        d = leaf["discount"]
        key = mix(b.names[b.owner].view(np.uint64) + mix(b.ctx.astype(np.uint64) + np.uint64(1))).view(np.int64)
        t = seat(b.c, (leaf["strength"] + d * (sent.value[b.ctx] - b.t[0])) * p, d * p, d, key, 2 * seed)
        cw = b.fixed + np.bincount(b.owner, t, len(cw)).astype(np.int64)
        places = dict(Block.routes(row))
        for other in others:
            cw[places[other["slice"]]] += grown(other["up"], np.int64)
        rate = (root["strength"] + root["discount"] * (root["tables"] - tw)) * root["base"]
        tw = seat(cw, rate, root["discount"] * root["base"], root["discount"], b.names, 2 * seed + 1)
        ends = np.stack([cw, tw])
        old_t, old_root = b.t[1:], b.root[1:]
        t = np.concatenate([t[None], old_t, *([t[None]] if keep else [])])
        ends = np.concatenate([ends[None], old_root, *([ends[None]] if keep else [])])
        names = ["bucket", "names", "n", "m", "ctx", "c", "fixed", "routes", "places"]
        yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int64()), *[pa.array([row[c]], pa.binary()) for c in names[1:]], *[pa.array([shrunk(x)], pa.binary()) for x in (t, ends)]],
                                         [*names, "t", "root"])

    if ups is not None:
        rows = state.withColumn("slice", F.lit(-1).cast("long")).unionByName(ups, allowMissingColumns=True)
        state = rows.repartition("bucket").sortWithinPartitions("bucket", "slice")
    return state.mapInArrow(by_group(one), BLOCKS)


def restaurant_totals(state: DataFrame, contexts: int) -> np.ndarray:
    """[restaurants and the root, (tables, customers)]: sums of all blocks, one row per restaurant."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((contexts + 1, 2), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += Block(row).totals(contexts)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["at", "t", "c"])

    out = np.zeros((contexts + 1, 2), np.int64)
    for row in state.mapInArrow(run, "at bigint, t bigint, c bigint").groupBy("at").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect():
        out[row.at] = row.t, row.c
    return out


def sizes(state: DataFrame) -> tuple[int, ...]:
    """How many pairs, and how many words at the root, have one and two customers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                total += [np.count_nonzero(x == k) for x in (b.c, b.root[0][0]) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["a", "b", "c", "d"])

    found = state.mapInArrow(run, "a bigint, b bigint, c bigint, d bigint")
    return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "abcd"]).first())


def sampled(state: DataFrame, light: "Light | None", distinct: int, contexts: int, burn_in: int, samples: int, strength: float) -> tuple[DataFrame, dict]:
    """Blocks with the seating of every sample, and the totals that go with them; ``light`` is seated along."""
    pairs_once, pairs_twice, words_once, words_twice = sizes(state)
    if light:
        pairs_once, pairs_twice = (x + y for x, y in zip((pairs_once, pairs_twice), light.sizes()))
    leaf = {"strength": strength, "discount": discount_of(pairs_once, pairs_twice)}
    root = {"strength": strength, "discount": discount_of(words_once, words_twice), "base": 1.0 / (distinct + 1)}
    totals = {"leaf": leaf, "roots": [], "tables": []}
    for sweep in range(burn_in + samples + 1):
        sums = restaurant_totals(state, contexts)
        root = {**root, "tables": int(sums[-1, 0]), "customers": int(sums[-1, 1])}
        if sweep > burn_in:
            totals["roots"].append(root)
            totals["tables"].append(sums[:-1, 0])
        totals["customers"] = sums[:-1, 1]
        if sweep < burn_in + samples:
            ups = light.sweep(state, root, leaf, sweep, sweep >= burn_in) if light else None
            before, state = state, settled(swept(state, ups, sums[:-1, 0], root, leaf, sweep, sweep >= burn_in), "seating")
            release(before)
    return state, totals


# --- restaurants of other words -----------------------------------------------------


def light_asks(corpus: DataFrame, contexts: np.ndarray, bits: int) -> DataFrame:
    """The pairs of every slice after words that are not in ``contexts``, packed by bucket of that word."""
    sent = corpus.sparkSession.sparkContext.broadcast(contexts)

    def one(number: int, ids: bytes, codes: bytes, held: bytes) -> pa.RecordBatch:
        ids = np.frombuffer(ids, np.int64)
        before, word, c, _ = Counts(context_of(ids, sent.value), codes, held, len(sent.value)).light()
        m = np.bincount(before, minlength=len(ids))
        own = np.flatnonzero(m)
        ends = np.concatenate([[0], np.cumsum(m[own])])
        rows = []
        for name, i, j in cuts(ids[own], bits):
            pairs = slice(ends[i], ends[j])
            words, w = np.unique(word[pairs], return_inverse=True)
            rows.append((name, [ids[own[i:j]].tobytes(), shrunk(m[own[i:j]]), ids[words].tobytes(), shrunk(w.astype(np.int32)), shrunk(c[pairs])]))
        return pa.RecordBatch.from_arrays([
            pa.array([b for b, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()),
            *[pa.array([x[i] for _, x in rows], pa.binary()) for i in range(5)]], ["bucket", "slice", "names", "m", "words", "w", "c"])

    return corpus.select("slice", "ids", "codes", "held").mapInArrow(by_row(one), LIGHT_ASKS)


def light_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, slice, {column: bytes}) as rows of LIGHT, about PORTION bytes at a time."""
    names, held, size = [c.split()[0] for c in LIGHT.split(", ")], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int32()), pa.array([r[2] for r in held], pa.int64()),
            *[pa.array([r[3].get(c) for r in held], pa.binary()) for c in names[3:]]], names)

    for row in rows:
        more = sum(map(len, row[3].values()))
        if held and size + more > PORTION:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield batch()


def light_blocks(asks: DataFrame, bits: int) -> DataFrame:
    """Rows of LIGHT for every block of restaurants; ``bits`` are those of blocks of words."""
    def rows_of(rows: list[dict]) -> Iterator[tuple]:
        bucket = rows[0]["bucket"]
        names, before = np.unique(np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows]), return_inverse=True)
        words, of = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]), return_inverse=True)
        starts = np.cumsum([0, *(len(r["words"]) // 8 for r in rows)])
        parts = [grown(r["w"], np.int32) for r in rows]
        ends = np.cumsum([0, *map(len, parts)])
        word = of[np.concatenate([x + at for x, at in zip(parts, starts)])]
        m = np.concatenate([grown(r["m"], np.int64) for r in rows])
        pairs, place = np.unique(np.repeat(before, m) * len(words) + word, return_inverse=True)
        del parts, before, of, word, m
        c = np.bincount(place, np.concatenate([grown(r["c"], np.int64) for r in rows]), len(pairs)).astype(np.int64)
        ctx, word = np.divmod(pairs, len(words))
        del pairs
        yield bucket, PAIRS, -2, {"m": shrunk(np.bincount(ctx, minlength=len(names))), "c": shrunk(c)}
        for row, i, j in zip(rows, ends, ends[1:]):
            yield bucket, PLACES, row["slice"], {"w": shrunk(np.diff(place[i:j], prepend=0).astype(np.int32))}
        del place
        live = np.flatnonzero(c > 1)
        if len(live):
            own, at = np.unique(ctx[live], return_inverse=True)
            dishes, w = np.unique(word[live], return_inverse=True)
            yield bucket, LIVE, -1, {
                "names": names[own].tobytes(), "once": shrunk(np.bincount(ctx[c == 1], minlength=len(names))[own]), "m": shrunk(np.bincount(at)),
                "words": words[dishes].tobytes(), "w": shrunk(w.astype(np.int32)), "c": shrunk(c[live]), "t": shrunk(np.ones(len(live), np.int64))}
        once, many = (np.bincount(word[x], minlength=len(words)) for x in (c == 1, c > 1))
        there = np.flatnonzero(once + many)
        for to, i, j in cuts(words[there], bits):
            some = there[i:j]
            yield to, WORDS_OF, -1 - bucket, {"names": words[some].tobytes(), "once": shrunk(once[some]), "m": shrunk(many[some])}

    run = by_group(lambda group: light_rows(rows_of(group.to_pylist())))
    return asks.repartition("bucket").sortWithinPartitions("bucket", "slice").mapInArrow(run, LIGHT)


class Light:
    """Restaurants of words that are not heavy, each whole in the block of its word.

    ``rows`` hold the pairs, ``live`` the seating of those with several customers: the last state first,
    then the samples'. All others have as many tables as customers, one or none.
    """

    def __init__(self, asks: DataFrame, bits: int):
        self.bits, self.rows = bits, settled(light_blocks(asks, bits), "light")
        self.seated = None

    @property
    def live(self) -> DataFrame:
        return (self.rows if self.seated is None else self.seated).where(F.col("kind") == LIVE)

    def told(self) -> DataFrame:
        """Words of the restaurants, for their blocks: how many have one customer, and how many have several."""
        return self.rows.where(F.col("kind") == WORDS_OF).select("bucket", "slice", "names", "once", F.col("m").alias("many"))

    def sizes(self) -> tuple[int, int]:
        """How many pairs have one and two customers."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2, np.int64)
            for batch in batches:
                for c in batch.column(0).to_pylist():
                    c = grown(c, np.int64)
                    total += [np.count_nonzero(c == 1), np.count_nonzero(c == 2)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["a", "b"])

        found = self.rows.where(F.col("kind") == PAIRS).select("c").mapInArrow(run, "a bigint, b bigint")
        return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "ab"]).first())

    def sweep(self, state: DataFrame, root: dict, leaf: dict, seed: int, keep: bool) -> DataFrame:
        """Seat all dishes anew, given the root in ``state``; their tables by block of words come back."""
        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ends = grown(row["root"], np.int64)[:2 * (len(row["names"]) // 8)].reshape(2, -1)
                    found = [(light, shrunk(ends[:, places])) for light, places in Block.routes(row)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([x[0] for x in found], pa.int64()), pa.array([row["bucket"]] * len(found), pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["bucket", "slice", "down"])

        bits = self.bits

        def rows_of(group: pa.Table) -> Iterator[tuple]:
            row, *others = group.to_pylist()
            names, words = (np.frombuffer(row[x], np.uint64) for x in ("names", "words"))
            once, m, c = (grown(row[x], np.int64) for x in ("once", "m", "c"))
            w, t = grown(row["w"], np.int32), grown(row["t"], np.int64).reshape(-1, len(c))
            ctx = np.repeat(np.arange(len(names)), m)
            # blocks of words come in order, as the words do
            ends = np.concatenate([grown(x["down"], np.int64).reshape(2, -1) for x in others], axis=1)
            p, d = root_probability(*ends, root)[w], leaf["discount"]
            tables = once + np.bincount(ctx, t[0], len(names)).astype(np.int64)
            key = mix(words[w] + mix(names[ctx])).view(np.int64)
            new = seat(c, (leaf["strength"] + d * (tables[ctx] - t[0])) * p, d * p, d, key, 2 * seed)
            sums = np.bincount(w, new, len(words)).astype(np.int64)
            yield row["bucket"], LIVE, -1, {**{x: row[x] for x in ("names", "once", "m", "words", "w", "c")}, "t": shrunk(np.concatenate([new[None], t[1:], *([new[None]] if keep else [])]))}
            for to, i, j in cuts(words, bits):
                yield to, TABLES_OF, row["bucket"], {"t": shrunk(sums[i:j])}

        downs = state.select("bucket", "names", "routes", "places", "root").mapInArrow(down, "bucket bigint, slice bigint, down binary")
        rows = self.live.drop("kind").unionByName(downs, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "slice")
        before, self.seated = self.seated, settled(rows.mapInArrow(by_group(lambda group: light_rows(rows_of(group))), LIGHT), "light-seating")
        if before is not None:
            release(before)
        return self.seated.where(F.col("kind") == TABLES_OF).select("bucket", "slice", F.col("t").alias("up"))

    def release(self) -> None:
        for table in (self.rows, self.seated):
            if table is not None:
                release(table)

    def answers(self, samples: int) -> DataFrame:
        """For every slice: customers and tables of its pairs (tables only where there are several customers), and customers and tables of their restaurants."""
        def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
            base, *rows = group.to_pylist()
            m, c = grown(base["m"], np.int64), grown(base["c"], np.int64)
            ctx, t = np.repeat(np.arange(len(m)), m), np.repeat((c > 0).astype(np.int64)[None], samples, axis=0)
            if rows[0]["slice"] < 0:
                t[:, c > 1] = grown(rows.pop(0)["t"], np.int64).reshape(samples + 1, -1)[1:]
            facts = np.stack([np.bincount(ctx, x, len(m)).astype(np.int64) for x in (c, *t)])
            for row in rows:
                place = np.cumsum(grown(row["w"], np.int32), dtype=np.int64)
                of = c[place]
                parts = of, t[:, place[of > 1]], facts[:, np.unique(ctx[place])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["slice"]], pa.int64()), pa.array([2], pa.int32()), pa.array([row["bucket"]], pa.int64()), *[pa.array([shrunk(x)], pa.binary()) for x in parts]],
                    ["slice", "kind", "bucket", "c", "t", "facts"])

        rows = self.rows.where(F.col("kind").isin(PAIRS, PLACES)).select("bucket", "slice", "m", "c", "w").unionByName(
            self.live.select("bucket", "slice", "t"), allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "slice")
        return rows.mapInArrow(by_group(one), "slice bigint, kind int, bucket bigint, c binary, t binary, facts binary")


# --- scores -------------------------------------------------------------------------


def looked_up(asks: DataFrame, state: DataFrame, totals: dict, contexts: int) -> DataFrame:
    """For every packed row of a slice: training counts of its words, customers and tables of the root for every sample, and log10 probabilities of its pairs."""
    sent = asks.sparkSession.sparkContext.broadcast(totals)

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        totals = sent.value
        leaf, tables, customers = totals["leaf"], totals["tables"], totals["customers"]
        d, a = leaf["discount"], leaf["strength"]
        rows = group.to_pylist()
        known = [Block(row) for row in rows if row["slice"] < 0]
        block = known[0] if known else Block({**{c: b"" for c in ("names", "n", "m", "ctx", "c", "fixed", "t", "root")}})
        keys = block.owner * contexts + block.ctx
        size = len(block.names)
        out = []
        for row in rows:
            if row["slice"] < 0:
                continue
            names, _, m, ctx, _ = _columns(row)
            place = np.searchsorted(block.names.view(np.uint64), names.view(np.uint64))
            there = np.zeros(len(names), bool)
            there[place < size] = block.names[place[place < size]] == names[place < size]
            place = np.where(there, place, 0)
            word = np.repeat(np.arange(len(names)), m)
            wanted = np.where(there[word], place[word] * contexts + ctx, -1)
            at = np.searchsorted(keys, wanted)
            found = np.zeros(len(wanted), bool)
            found[at < len(keys)] = keys[at[at < len(keys)]] == wanted[at < len(keys)]
            at = np.where(found, at, 0)
            pick = lambda values, where, ok: np.where(ok, values[where], 0) if len(values) else np.zeros(len(ok), np.int64)
            c = pick(block.c, at, found)
            pair_mean, at_root = np.zeros(len(wanted)), []
            for s, root in enumerate(totals["roots"]):
                ends = block.root[1 + s] if size else np.zeros((2, 0), np.int64)
                at_root.append([pick(x, place, there) for x in ends])
                p = root_probability(*at_root[-1], root)
                t = pick(block.t[1 + s], at, found) if len(block.c) else 0
                pair_mean += (np.maximum(c - d * t, 0) + (a + d * tables[s][ctx]) * p[word]) / (a + customers[ctx])
            with np.errstate(divide="ignore"):
                logs = np.log10(pair_mean / len(totals["roots"])).astype(np.float32)
            out.append((row["slice"], row["bucket"], [shrunk(x) for x in (pick(block.n, place, there).astype(np.int64), np.array(at_root, np.int64), logs)]))
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.int64()),
                *[pa.array([x[2][i] for x in out], pa.binary()) for i in range(3)]], ["slice", "kind", "bucket", "n", "root", "pair"])

    offers = state.drop("routes", "places").withColumn("slice", F.lit(-1).cast("long"))
    rows = asks.unionByName(offers, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "slice")
    return rows.mapInArrow(by_group(one), "slice bigint, kind int, bucket bigint, n binary, root binary, pair binary")


def scored(corpus: DataFrame, answers: DataFrame, contexts: np.ndarray, totals: dict, tokens: int, distinct: int) -> DataFrame:
    """owner, doc_id, held_out, n_tokens, n_known, base_score and score of every part of a text; ``corpus`` is released."""
    spark, kind = corpus.sparkSession, corpus.schema["doc_ids"].dataType.elementType.simpleString()
    sent = spark.sparkContext.broadcast(contexts)
    roots, d, a = totals["roots"], totals["leaf"]["discount"], totals["leaf"]["strength"]

    def own_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shrunk(context_of(np.frombuffer(ids, np.int64), sent.value)) for ids in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([0] * len(own), pa.int32()), pa.array([0] * len(own), pa.int64()), *batch.columns[1:4], pa.array(own, pa.binary()), batch.column(5)],
                ["slice", "kind", "bucket", "doc_ids", "owners", "held", "own", "codes"])

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = group.column("kind").to_pylist()
        at = kinds.index(0)
        doc_ids, owners, held, own, codes = (group.column(c)[at].as_py() for c in ("doc_ids", "owners", "held", "own", "codes"))
        found = Counts(grown(own, np.int32), codes, held, len(sent.value))
        every = lambda c, t, kind, *shape: [grown(group.column(c)[i].as_py(), t).reshape(*shape, -1) for i, k in enumerate(kinds) if k == kind]  # noqa: E731, B023
        n, pair = (np.concatenate(every(c, t, 1), axis=-1).ravel() for c, t in (("n", np.int64), ("pair", np.float32)))
        ends = np.concatenate(every("root", np.int64, 1, len(roots), 2), axis=2)
        at_root = [root_probability(*x, root) for x, root in zip(ends, roots)]
        root = np.log10(sum(at_root) / len(roots))
        base = np.log10((n + 0.5) / (tokens + 0.5 * (distinct + 1)))
        token, size = found.word, len(found.held)
        score = np.where(found.pair >= 0, np.append(pair.astype(np.float64), 0.0)[found.pair], root[token])
        if 2 in kinds:
            before, word, _, of = found.light()
            before = np.unique(before, return_inverse=True)[1]
            c = np.concatenate(every("c", np.int64, 2), axis=-1).ravel()
            t = np.repeat((c > 0).astype(np.int64)[None], len(roots), axis=0)
            t[:, c > 1] = np.concatenate(every("t", np.int64, 2, len(roots)), axis=1)
            customers, *tables = np.concatenate(every("facts", np.int64, 2, len(roots) + 1), axis=1)
            mean = sum((np.maximum(c - d * t[s], 0) + (a + d * tables[s][before]) * at_root[s][word]) / (a + customers[before]) for s in range(len(roots))) / len(roots)
            score[found.rest] = np.log10(mean)[of]
        sums = [np.bincount(found.part, x(), size) for x in (lambda: None, lambda: (n > 0)[token], lambda: base[token], lambda: score)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(owners, np.int64)), pa.array(doc_ids, group.schema.field("doc_ids").type.value_type), pa.array(found.held),
            pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3])],
            ["owner", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    own = settled(corpus.select("slice", "doc_ids", "owners", "held", "ids", "codes").mapInArrow(
        own_codes, f"slice bigint, kind int, bucket bigint, doc_ids array<{kind}>, owners binary, held binary, own binary, codes binary"), "own")
    release(corpus)
    rows = own.unionByName(answers, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind", "bucket")
    return rows.mapInArrow(by_group(one), f"owner bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


# --- the operator -------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES,
              strength: float = STRENGTH, context_share: float | None = None, seed: int = SEED, step: int = STEP, bucket: int = BUCKET,
              heavy_share: float = CONTEXT_SHARE, light_bucket: int = LIGHT_BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``.

    Scores are log10 probabilities of the whole text with its end: ``base_score`` by smoothed counts
    of single tokens, ``score`` by the sampled model. Both learn from rows that are not held out,
    copies counted as often as they occur; NULL ids are not held out. NULL and empty texts are one
    end. Without training rows every token has probability 1. Words are told apart by 64-bit keys.
    An empty table gives no rows; other columns are ignored. Perplexity is
    10 ** (-sum(score) / sum(n_tokens)). Every preceding word has a restaurant, unless ``context_share``
    asks for a smaller model: tokens after words of a lesser share of the training tokens are then
    customers of the root. ``heavy_share`` and ``light_bucket`` say where restaurants are kept, and
    change no more of the result than which random numbers are drawn.
    """
    share = heavy_share if context_share is None else context_share
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    corpus = stored(sliced(rows, seed, step), "slices")
    words = settled(word_counts(corpus), "words", "zstd")
    tokens, distinct = words.where(F.col("id") != BEGIN).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where((F.col("id") == BEGIN) | (F.col("id") != END) & (F.col("n") >= share * tokens)).select("id").collect()
    contexts = np.unique(np.array([BEGIN, *(r.id for r in frequent)], np.int64))
    release(words)
    bits = bits_for(corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bucket)
    asks = dealt(corpus, contexts, bits)
    light = Light(light_asks(corpus, contexts, bits_for(tokens, light_bucket)), bits) if context_share is None else None
    state = settled(blocks(asks, len(contexts), light.told() if light else None), "blocks")
    state, totals = sampled(state, light, distinct, len(contexts), burn_in, samples, strength)
    # one kind after the other: the shuffles and tables that led to the first are gone when the second is made
    answers = settled(looked_up(asks, state, totals, len(contexts)), "answers")
    release(state)
    if light:
        answers = answers.unionByName(settled(light.answers(samples), "light-answers"), allowMissingColumns=True)
        light.release()
    parts = settled(scored(corpus, answers, contexts, totals, tokens, distinct), "parts", "snappy")
    whole = parts.groupBy("owner").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"))
