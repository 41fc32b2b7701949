"""Splits, sampling weights, weighted draws and shuffles, all seeded by digests."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evtlake.functions.codes import WeightTiers
from evtlake.functions.expr import bind, hash_fraction, seeded_hash
from evtlake.plans import lookup, ordering

DRAWS_PER_BLOCK = 100_000
#: The keyed permutation: rounds, the prime of its mixing function, and how often a cell may walk on.
ROUNDS, PRIME, WALK = 4, (1 << 31) - 1, 16


def key_digest(seed: int | str, key: str | Sequence[str]) -> Column:
    """Seeded digest of a key of one or more columns."""
    names = [key] if isinstance(key, str) else list(key)
    # in a key of several columns NULL and the borders between them count
    parts = [F.col(names[0])] if len(names) == 1 else [F.to_json(F.struct(*names))]
    return seeded_hash(seed, *parts)


def split_events(df: DataFrame, val: float = 0.2, seed: int = 42, key: str | Sequence[str] = "event_id") -> DataFrame:
    """Add ``split``: exactly ``int(n * val)`` events are ``val``, chosen by digest.

    The digest at the cut is found from block counts; the split itself is a comparison
    per row and moves nothing. ``key`` names an event: after a union of datasets, whose ids
    repeat, it is (source, id). Rows that repeat the whole key are one event and stay together,
    so the size is then off by less than the rows of the one key at the cut.
    """
    hashed = df.withColumn("_h", key_digest(seed, key))
    counted = df.agg(F.count("*").alias("n"))
    n_train = counted.select(F.col("n") - F.floor(F.col("n") * F.lit(float(val)))).scalar()
    cut = ordering.hash_cutoff(hashed.select("_h"), "_h", n_train)
    is_val = F.coalesce(F.col("_h") >= cut, F.lit(False))
    return hashed.withColumn("split", F.when(is_val, "val").otherwise("train")).drop("_h")


def split_files(
    df: DataFrame, val: float = 0.1, seed: int = 42, file: str = "file_path",
    train: Sequence[str] | None = None, valid: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split`` by whole files: ``int(n * (1 - val))`` files train, the rest val.

    With explicit glob lists a file belongs to the list that matches it, else to none.
    """
    files = df.select(file).distinct()
    if train is not None and valid is not None:
        def listed(patterns: Sequence[str]) -> Column:
            return F.col(file).rlike("|".join(fnmatch.translate(p) for p in patterns))
        sides = files.withColumn("split", F.when(listed(train), "train").when(listed(valid), "val"))
    else:
        rank = F.row_number().over(Window.orderBy(seeded_hash(seed, F.col(file)), file)) - 1
        n_train = F.floor(F.count("*").over(Window.partitionBy()) * F.lit(1.0 - val))
        sides = files.withColumn("split", F.when(rank < n_train, "train").otherwise("val"))
    return df.join(ordering.broadcast_if_short(sides.where(F.col("split").isNotNull())), file)


def sample_weights(
    df: DataFrame, tiers: WeightTiers = WeightTiers(), label: str = "label",
    energy: str = "mc_primary_energy", dir_z: str = "mc_primary_dir_z",
) -> DataFrame:
    """Add ``weight`` and ``category``. Only starting (class 1) upgoing events are boosted."""
    starting = F.col(label) == 1
    up = (F.col(dir_z) > 0) & ~F.isnan(dir_z)
    category, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, threshold, w in tiers.tiers:
        reached = starting & up & (F.col(energy) >= threshold) & ~F.isnan(energy)
        category = F.coalesce(category, F.when(reached, name))
        weight = F.coalesce(weight, F.when(reached, w))
    rest = F.when(starting & up, "low_upgoing").when(starting, "starting_downgoing").otherwise("background")
    return df.withColumns({
        "category": F.coalesce(category, rest),
        "weight": F.coalesce(weight, F.lit(tiers.default)),
    })


def weight_report(weighted: DataFrame) -> DataFrame:
    """Events, weight and effective weight per category.

    ``probability`` is the share of a draw. ``reported_share`` is the share among the
    categories the usual report counts, which leave ``low_upgoing`` out.
    """
    per = weighted.groupBy("category").agg(
        F.count("*").alias("events"), F.first("weight").alias("weight"), F.sum("weight").alias("effective"))
    counted = F.when(F.col("category") != "low_upgoing", F.col("effective"))
    everything = Window.partitionBy()
    return per.withColumns({
        "probability": F.col("effective") / F.sum("effective").over(everything),
        "reported_share": counted / F.sum(counted).over(everything),
    })


def weighted_sample(
    df: DataFrame, seed: int = 42, n: int | None = None, key: str | Sequence[str] = "event_id", weight: str = "weight"
) -> DataFrame:
    """Draw events with replacement, each draw with probability proportional to weight.

    One row per draw: ``draw`` and the drawn key. By default there are as many draws as
    events, named by the event keys; otherwise ``n`` draws named 0 to n-1. Events lie on a line as
    intervals of their weight, and a draw is a digest-made position on it. ``key`` may be several
    columns, such as (source, id); ``draw`` is then a struct of them.
    """
    names = [key] if isinstance(key, str) else list(key)
    total, events = df.agg(F.sum(weight), F.count("*")).first()
    if not total:
        raise ValueError("weights sum to zero")
    hashed = ordering.hash_levels(df.select(*names, weight).withColumn("_h", key_digest(seed, key)))
    line = ordering.running_total(hashed, "_lo", F.col(weight), ["_hb"], [F.col("_h"), *map(F.col, names)])
    intervals = line.select(*names, "_lo", (F.col("_lo") + F.col(weight)).alias("_hi"))
    own = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    called = df.select(own.alias("draw")) if n is None else df.sparkSession.range(n).toDF("draw")
    text = F.col("draw") if n is not None or len(names) == 1 else F.to_json("draw")
    draws = called.withColumn("_u", hash_fraction(seeded_hash(f"{seed}-draw", text)) * F.lit(float(total)))
    block = float(total) / max(16, max(events, n or 0) // DRAWS_PER_BLOCK)
    return lookup.interval_lookup(
        draws, "_u", intervals, "_lo", "_hi", block, contiguous=True
    ).select("draw", *names)


def shuffle_by_file(
    df: DataFrame, seed: int, order: Sequence[str], levels: Sequence[str] = (), file: str = "file_path"
) -> DataFrame:
    """Add ``position`` for a random order of files that keeps each file's rows in order."""
    hashed = df.withColumn("_h", seeded_hash(seed, F.col(file)))
    return ordering.row_positions(
        hashed, "position", ["_h", *levels], [F.col(c) for c in order]).drop("_h")


def whole_div(x: Column, y: Column) -> Column:
    """Integer quotient of numbers from 0, exact beyond the 53 bits of a double."""
    return F.call_function("div", x, y)


def round_constants(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below PRIME for each half round."""
    digests = [hashlib.md5(f"{seed}-{k}".encode()).hexdigest() for k in range(2 * rounds)]
    return [tuple(1 + int(d[i:i + 10], 16) % (PRIME - 1) for i in (0, 10, 20)) for d in digests]


def permuted(index: Column, n: Column, seed: int) -> Column:
    """Position of row ``index`` in a seeded shuffle of the numbers 0 to n-1: a permutation, computed row by row.

    A Feistel network on pairs (left, right) of a grid of a * b cells that is just larger than n: each
    half is shifted by a keyed function of the other one. A cell beyond the end walks on through the
    network until it is inside. For n up to 4e18.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = whole_div(n + a - 1, a)

    def mixed(x: Column, c: Column) -> Column:
        return bind((x + c["u"]) % PRIME, lambda y: ((y * y) % PRIME * c["v"] + c["w"]) % PRIME)

    keys = round_constants(seed)
    number = lambda k: F.struct(*[F.lit(v).cast("long").alias(name) for name, v in zip("uvw", k)])
    rounds = F.array(*[F.struct(number(first).alias("l"), number(second).alias("r")) for first, second in zip(keys[::2], keys[1::2])])

    def through(x: Column) -> Column:
        def step(state: Column, key: Column) -> Column:
            left = (state["l"] + mixed(state["r"], key["l"])) % a
            return bind(left, lambda v: F.struct(v.alias("l"), ((state["r"] + mixed(v, key["r"])) % b).alias("r")))
        start = F.struct(whole_div(x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])

    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), through(index), lambda x, _: F.when(x < n, x).otherwise(through(x)))
    return bind(inside, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a cell did not come back inside")).cast("long")))


def shuffle_events(df: DataFrame, seed: int, index: str, n: Column | int) -> DataFrame:
    """Add ``position`` for a seeded full shuffle of ``n`` rows that ``index`` numbers from 0.

    Nothing is sorted or moved, and another epoch is another seed. A file table gives the numbers of
    written rows: the start of the file and the index of the row in it.
    """
    # a total from a subquery cannot stand inside the rounds themselves
    counted = df.withColumn("_n", F.lit(n).cast("long") if isinstance(n, int) else n)
    return counted.withColumn("position", permuted(F.col(index).cast("long"), F.col("_n"), seed)).drop("_n")


def lay_out(df: DataFrame, position: str = "position") -> DataFrame:
    """Physically order rows by position: ranges across partitions, sorted inside."""
    return df.repartitionByRange(position).sortWithinPartitions(position)
