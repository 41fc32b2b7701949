"""Point clouds: farthest points, nearest neighbours, neighbour pooling, tokens.

Clouds are rows of at most ``chunk`` points. A cloud of one row is reduced inside its
task by NumPy over Arrow batches. A larger cloud stays spread over its rows, so no cloud has
to fit in one task. Its farthest points are picked in rounds: every row offers its farthest
points, CANDIDATES of the whole cloud together, and tells how far its other points can be; one
task picks among the offered points as long as no other can come before, which is the exact
order of picks. A cloud of up to CANDIDATES points needs one round. Neighbours are searched
per row in a k-d partition, nearest boxes first, and the best of all rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from evtlake.operators import boxes
from evtlake.operators.boxes import gaps
from evtlake.plans import arrow, ordering

CHUNK = 8_192
SLAB = 1 << 14  # padded points handled together inside one task
BROADCAST_CLOUDS = 10_000
CANDIDATES = 1 << 16
TOKEN_BLOCK = 64  # centres whose neighbours are merged together
AXES = ("x", "y", "z", "t")
CENTRES = "array<struct<pos:long,x:double,y:double,z:double,t:double>>"


def clouds(points: DataFrame, key: str, features: Sequence[str] = (), pos: str = "pos",
           axes: Sequence[str] = AXES, chunk: int = CHUNK) -> DataFrame:
    """Point rows -> (key, chunk, chunks, n, pts); ``n`` counts the points of the whole cloud.

    A NULL coordinate or feature is NaN, whatever the size of the cloud.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    entry = F.struct(
        F.col(pos).cast("long").alias("pos"),
        *[number(a).alias(x) for a, x in zip(axes, AXES)],
        F.array(*[number(f) for f in features]).cast("array<double>").alias("f"))
    rows = points.groupBy(key, F.expr(f"cast({pos} div {chunk} as int)").alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("pts"))
    big = points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    if big.isEmpty():
        return rows.withColumns({"n": F.size("pts").cast("long"), "chunks": F.lit(1)})
    # one row per chunk of a big cloud, so that joining sizes does not gather the cloud; rounds read the rows again and again
    copies = big.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return ordering.kept(rows.join(copies, [key, "chunk"], "left").withColumns({
        "n": F.coalesce("n", F.size("pts").cast("long")), "chunks": F.coalesce("chunks", F.lit(1))}), "clouds")


# --- clouds inside one task ---------------------------------------------------------


def farthest(slab: np.ndarray, valid: np.ndarray, count: int) -> np.ndarray:
    """Farthest-point picks [B, count] of padded clouds [4, B, N].

    The first point starts; among equally far points the earlier one is taken.
    """
    every = np.arange(len(valid))
    picks = np.zeros((len(valid), count), dtype=np.int64)
    closest = np.where(valid, np.inf, -1.0)
    for step in range(1, count):
        centre = slab[:, every, picks[:, step - 1], None]
        closest = np.fmin(closest, gaps(slab, centre))
        picks[:, step] = closest.argmax(axis=1)
    return picks


def nearest(points: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k points [4, N] nearest to each of the points ``at``.

    Everything up to the k-th distance is a candidate, so equal distances go by position.
    """
    n = points.shape[1]
    k = min(k, n)
    if n >= boxes.MANY and np.isfinite(points).all():
        return boxes.nearest(boxes.Boxes(points, leaf=boxes.NEAR_LEAF), points[:, at], k)
    d2 = gaps(points[:, None, :], points[:, at, None])
    reach = np.partition(d2, k - 1, axis=1)[:, k - 1]
    if np.isnan(reach).any():
        order = np.argsort(d2, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(d2, order, axis=1)
    centre, pos = np.nonzero(d2 <= reach[:, None])
    found = d2[centre, pos]
    by = np.lexsort((pos, found, centre))
    first = np.searchsorted(centre, np.arange(len(at)))
    best = by[first[:, None] + np.arange(k)]
    return pos[best], found[best]


def slabs(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar size together, so that padding stays small."""
    order = np.argsort(sizes, kind="stable")
    start = 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or (stop + 1 - start) * sizes[order[stop]] > SLAB:
            yield order[start:stop]
            start = stop


def _points(flat: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates [4, n], positions and features [n, width] of point structs."""
    width = len(flat.field("f")[0]) if len(flat) else 0
    return (np.stack([np.asarray(flat.field(a)) for a in AXES]), np.asarray(flat.field("pos")),
            np.asarray(flat.field("f").flatten()).reshape(len(flat), width))


def _reducer(tokens: int, k: int) -> Callable:
    """Arrow batches (key, pts) of whole clouds -> rows (key, token_no, at, nbr_pos, nbr_d2, pooled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pts = batch.column(0), batch.column(1)
            if len(keys) == 0:
                continue
            bounds = np.asarray(pts.offsets)
            xyzt, _, feats = _points(pts.values)
            width = feats.shape[1]
            sizes = np.diff(bounds)
            for rows in slabs(sizes):
                valid = np.arange(sizes[rows].max())[None, :] < sizes[rows][:, None]
                slab = np.zeros((4, *valid.shape))
                slab[:, valid] = np.concatenate([xyzt[:, bounds[r]:bounds[r + 1]] for r in rows], axis=1)
                picks = farthest(slab, valid, tokens)
                near, away, pooled = [], [], []
                for row, at in zip(rows, picks) if k else ():
                    mine = slice(bounds[row], bounds[row + 1])
                    order, d2 = nearest(xyzt[:, mine], at, k)
                    best = feats[mine][order].max(axis=1)
                    near.append(order)
                    away.append(d2)
                    pooled.append(np.where(np.isfinite(best), best, 0.0))
                count = len(rows) * tokens
                lengths = [o.shape[1] for o in near for _ in range(tokens)] if k else [0] * count
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(np.repeat(rows, tokens))),
                    pa.array(np.tile(np.arange(tokens, dtype=np.int32), len(rows))),
                    pa.array(picks.ravel()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o.ravel() for o in near]) if k else [], pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g.ravel() for g in away]) if k else [], pa.float64())),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(count + 1) * (width if k else 0), pa.int32()),
                        pa.array(np.concatenate([p.ravel() for p in pooled]) if k else [], pa.float64())),
                ], names=["_k", "token_no", "at", "nbr_pos", "nbr_d2", "pooled"])

    return run


def _local(whole: DataFrame, key: str, tokens: int, k: int) -> DataFrame:
    kind = whole.schema[key].dataType.simpleString()
    reduced = whole.select(key, "pts").mapInArrow(
        _reducer(tokens, k),
        f"{key} {kind}, token_no int, at long, nbr_pos array<long>, nbr_d2 array<double>, pooled array<double>")
    return reduced.select(
        key, "token_no", F.col("at").alias("pos"),
        F.arrays_zip(F.col("nbr_pos").alias("pos"), F.col("nbr_d2").alias("d2")).alias("neighbours"), "pooled")


# --- clouds spread over rows --------------------------------------------------------


def _attach(rows: DataFrame, small: DataFrame, heads: DataFrame, key: str, few: bool) -> DataFrame:
    """Give every row of a cloud its cloud's ``small`` row without gathering the cloud.

    Few clouds are broadcast; otherwise the small row is copied once per chunk.
    """
    if few:
        return rows.join(F.broadcast(small), key)
    copies = small.join(heads, key).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return rows.join(copies, [key, "chunk"])


def _offered(kind: str, key: str, rows: DataFrame) -> DataFrame:
    """Every row's farthest points from the centres so far, and the first of those it keeps back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, chunks, pts, centres = (batch.column(c)[i] for c in range(1, 5))
                xyzt, pos, _ = _points(pts.values)
                known = np.array([[c[a] for a in AXES] for c in centres.as_py()]).T
                closest = np.full(len(pos), np.inf)
                if known.size:
                    near = boxes.Field(xyzt, pos)
                    for centre in known.T:
                        near.add(centre)
                    closest[near.at[near.here]] = near.closest[near.here]
                order = np.lexsort((pos, -closest))
                share = max(1, CANDIDATES // chunks.as_py())
                some, rest = order[:share], order[share:]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1), pa.array([pos[some]], pa.list_(pa.int64())), pa.array([xyzt[:, some].ravel()], pa.list_(pa.float64())),
                    pa.array([closest[some]], pa.list_(pa.float64())), pa.array([closest[rest[0]] if len(rest) else -np.inf]),
                    pa.array([pos[rest[0]] if len(rest) else boxes.NONE], pa.int64()),
                    batch.column(4).slice(i, 1) if chunk.as_py() == 0 else pa.array([[]], batch.column(4).type)],
                    ["_k", "pos", "xyzt", "closest", "far", "who", "centres"])

    return rows.select(key, "chunk", "chunks", "pts", "centres").mapInArrow(
        run, f"{key} {kind}, pos array<long>, xyzt array<double>, closest array<double>, far double, who long, centres {CENTRES}")


def _picked(kind: str, key: str, offers: DataFrame, tokens: int) -> DataFrame:
    """Centres with the picks of one round: up to the first that a point kept back might precede."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in arrow.groups(batches):
            table = pa.Table.from_batches(group)
            whole = lambda name: np.concatenate([np.asarray(x.values) for x in table[name]])  # noqa: E731, B023
            xyzt = np.concatenate([np.asarray(x.values).reshape(4, -1) for x in table["xyzt"]], axis=1)
            near = boxes.field(xyzt, whole("pos"), whole("closest"))
            back = max(zip(table["far"].to_pylist(), (-w for w in table["who"].to_pylist())))
            centres = [c for row in table["centres"].to_pylist() for c in row]
            while len(centres) < tokens:
                far, who = near.best()
                if (far, -who) < back:
                    break
                at = near.point(who)
                centres.append({"pos": who, **dict(zip(AXES, at.tolist()))})
                near.add(at)
            yield pa.RecordBatch.from_arrays([group[0].column(0).slice(0, 1), pa.array([centres], table.schema.field("centres").type)], ["_k", "centres"])

    return offers.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} {kind}, centres {CENTRES}")


def _spread_centres(big: DataFrame, heads: DataFrame, key: str, tokens: int, few: bool) -> DataFrame:
    """(key, centres) of spread clouds. Each round picks at least one point of every open cloud, and more the smaller the cloud."""
    kind = big.schema[key].dataType.simpleString()
    rows, out = big.withColumn("centres", F.array().cast(CENTRES)), None
    while True:
        found = ordering.cut_lineage(_picked(kind, key, _offered(kind, key, rows), tokens))
        done = found.where(F.size("centres") == tokens)
        out = done if out is None else out.unionByName(done)
        open_ = found.where(F.size("centres") < tokens)
        if open_.isEmpty():
            return out
        rows = _attach(big, open_, heads, key, few)


def _spread_neighbours(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, token_no, pos, neighbours, pooled) of rows (key, pts, centres): the best of every row, then of all rows."""
    kind = rows.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xyzt, pos, feats = _points(batch.column(1)[i].values)
                centres = batch.column(2)[i].as_py()
                at = np.array([c["pos"] for c in centres], np.int64)
                near, d2 = boxes.nearest_of(xyzt, pos, np.array([[c[a] for a in AXES] for c in centres]).T, k)
                order = np.argsort(pos)
                own = feats[order[np.minimum(np.searchsorted(pos, near, sorter=order), len(pos) - 1)]]
                for first in range(0, len(at), TOKEN_BLOCK):
                    some = slice(first, first + TOKEN_BLOCK)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(i, 1), pa.array([first], pa.int32()), pa.array([at[some]], pa.list_(pa.int64())),
                        pa.array([near[some].ravel()], pa.list_(pa.int64())), pa.array([d2[some].ravel()], pa.list_(pa.float64())),
                        pa.array([own[some].ravel()], pa.list_(pa.float64()))], ["_k", "first", "at", "near", "d2", "f"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, key_of, state = None, None, None
        for name, run in arrow.runs(batches, 2):
            if current is not None and name != current:
                yield out(key_of, current[1], *state)
                state = None
            current, key_of = name, run.column(0).slice(0, 1)
            for i in range(run.num_rows):
                at = np.asarray(run.column(2)[i].values)
                near, d2 = (np.asarray(run.column(c)[i].values).reshape(len(at), k) for c in (3, 4))
                f = np.asarray(run.column(5)[i].values).reshape(len(at), k, -1)
                if state is not None:
                    near, d2, f = (np.concatenate([a, b], axis=1) for a, b in zip(state[1:], (near, d2, f)))
                    order = np.lexsort((near, d2), axis=1)[:, :k]
                    near, d2, f = np.take_along_axis(near, order, 1), np.take_along_axis(d2, order, 1), np.take_along_axis(f, order[:, :, None], 1)
                state = at, near, d2, f
        if state is not None:
            yield out(key_of, current[1], *state)

    def out(key_of: pa.Array, first: int, at: np.ndarray, near: np.ndarray, d2: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        there = near != boxes.NONE
        pooled = np.where(there[:, :, None], f, -np.inf).max(axis=1)
        ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]), pa.int32())
        return pa.RecordBatch.from_arrays([
            key_of.take(pa.array(np.zeros(len(at), np.int64))), pa.array(np.arange(first, first + len(at)), pa.int32()), pa.array(at),
            pa.ListArray.from_arrays(ends, pa.array(near[there])), pa.ListArray.from_arrays(ends, pa.array(d2[there])),
            pa.array(list(np.where(np.isfinite(pooled), pooled, 0.0)), pa.list_(pa.float64()))], ["_k", "token_no", "pos", "nbr_pos", "nbr_d2", "pooled"])

    found = rows.select(key, "pts", "centres").mapInArrow(
        find, f"{key} {kind}, first int, at array<long>, near array<long>, d2 array<double>, f array<double>")
    merged = found.repartition(key, "first").sortWithinPartitions(key, "first").mapInArrow(
        best, f"{key} {kind}, token_no int, pos long, nbr_pos array<long>, nbr_d2 array<double>, pooled array<double>")
    return merged.select(key, "token_no", "pos", F.arrays_zip(F.col("nbr_pos").alias("pos"), F.col("nbr_d2").alias("d2")).alias("neighbours"), "pooled")


def _spread(big: DataFrame, key: str, tokens: int, k: int) -> DataFrame:
    big = big.select(key, "chunk", "chunks", "pts")
    heads = big.where(F.col("chunk") == 0).select(key, "chunks")
    few = heads.limit(BROADCAST_CLOUDS + 1).count() <= BROADCAST_CLOUDS
    centres = _spread_centres(big, heads, key, tokens, few)
    if k:
        return _spread_neighbours(_attach(big, centres, heads, key, few), key, k)
    return centres.select(key, F.posexplode("centres").alias("token_no", "_c")).select(
        key, "token_no", "_c.pos", F.lit(None).cast("array<struct<pos:long,d2:double>>").alias("neighbours"),
        F.lit(None).cast("array<double>").alias("pooled"))


def _reduced(cloud: DataFrame, key: str, tokens: int, k: int) -> DataFrame:
    """Tokens of clouds with more than ``tokens`` points."""
    large = cloud.where(F.col("n") > tokens)
    out = _local(large.where(F.col("chunks") == 1), key, tokens, k)
    big = large.where(F.col("chunks") > 1)
    return out if big.isEmpty() else out.unionByName(_spread(big, key, tokens, k))


# --- operators ----------------------------------------------------------------------


def farthest_points(cloud: DataFrame, key: str, tokens: int) -> DataFrame:
    """(key, token_no, pos): farthest-point picks, or all points of clouds up to ``tokens``."""
    small = cloud.where(F.col("n") <= tokens).select(key, F.explode("pts").alias("_p")).select(
        key, F.col("_p.pos").cast("int").alias("token_no"), "_p.pos")
    return small.unionByName(_reduced(cloud, key, tokens, 0).select(key, "token_no", "pos"))


def knn(cloud: DataFrame, key: str, tokens: int, k: int) -> DataFrame:
    """(key, token_no, rank, pos, d2): the ``k`` nearest points of every centroid, itself included."""
    return _reduced(cloud, key, tokens, k).select(
        key, "token_no", F.posexplode("neighbours").alias("rank", "_n")).select(
        key, "token_no", "rank", "_n.pos", "_n.d2")


def neighbour_max_pool(cloud: DataFrame, key: str, tokens: int, k: int) -> DataFrame:
    """(key, token_no, pooled): element-wise maximum of the neighbours' features, non-finite -> 0."""
    return _reduced(cloud, key, tokens, k).select(key, "token_no", "pooled")


def tokenize_events(cloud: DataFrame, key: str, tokens: int, k: int, width: int) -> DataFrame:
    """(key, token_no, valid, pos, features): exactly ``tokens`` rows per cloud.

    Small clouds keep their own points, larger ones get pooled picks; missing tokens are
    zero rows with ``valid`` false.
    """
    small = cloud.where(F.col("n") <= tokens)
    own = small.select(key, F.explode("pts").alias("_p")).select(
        key, F.col("_p.pos").cast("int").alias("token_no"), F.lit(True).alias("valid"), "_p.pos",
        F.col("_p.f").alias("features"))
    pooled = _reduced(cloud, key, tokens, k).select(
        key, "token_no", F.lit(True).alias("valid"), "pos", F.col("pooled").alias("features"))
    zeros = F.array_repeat(F.lit(0.0), width)
    padding = small.where((F.col("n") < tokens) & (F.col("chunk") == 0)).select(
        key, F.explode(F.sequence(F.col("n").cast("int"), F.lit(tokens - 1))).alias("token_no"),
        F.lit(False).alias("valid"), F.lit(None).cast("long").alias("pos"), zeros.alias("features"))
    return own.unionByName(pooled).unionByName(padding)


def token_rows(tokens: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row per cloud: its ``valid`` flags and ``features`` in token order, with the columns of ``labels``.

    That is what a predictor reads; a cloud has as many tokens as ``tokenize_events`` was asked for.
    """
    token = F.struct("token_no", "valid", "features")
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(token)).alias("_t"))
    return rows.select(key, F.col("_t.valid").alias("valid"), F.col("_t.features").alias("features")).join(labels, key)


def score_events(df: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """Apply a caller's batch predictor: a function from one pandas frame to another."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield predict(frame)

    return df.mapInPandas(run, schema)


def score_batches(df: DataFrame, load: Callable, inputs: Mapping[str, Sequence[int]], returns: str, batch: int = 1024, out: str = "prediction") -> DataFrame:
    """Add the predictions of a model that is loaded once per worker process.

    ``load`` returns the predictor, a function from one array of ``batch`` rows or fewer per input to
    an array or a dictionary of arrays; ``inputs`` names array or number columns with the shape of a
    row, () for a number. ``returns`` is the type of a prediction.
    """
    from pyspark.ml.functions import predict_batch_udf
    shapes = {i: list(shape) for i, shape in enumerate(inputs.values()) if len(shape)}
    predict = predict_batch_udf(load, return_type=T.DataType.fromDDL(returns), batch_size=batch, input_tensor_shapes=shapes)
    return df.withColumn(out, predict(*inputs))
