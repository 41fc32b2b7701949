"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage of the whole text is
encoded (shares of bytes, shape of its words, repetition), a small network maps it to a hidden
vector, gated attention weighs the passages of a document, and the weighted sum is scored.

The network is fitted by the driver on a bounded sample of labelled documents, each with all its
passages; scoring reads every passage of every document in Spark tasks, with the fitted weights sent
to them. A long text is read STEP bytes at a time, and its attention is summed up as it goes.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of a passage, and of a text that are read at a time.
PASSAGE, STEP = 512, 1 << 20
#: The fit sees so many labelled documents per class at most, and so many passages of all of them together.
SAMPLE_DOCS, SAMPLE_PASSAGES = 2500, 100_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 12, 128, 4e-3, 1e-4
SHAPES = 12
FEATURES = 256 + SHAPES


def passages(text: str | None) -> np.ndarray:
    """One row of FEATURES per passage of PASSAGE bytes; a text without bytes is one empty passage."""
    return np.concatenate(list(passage_parts(text)))


def passage_parts(text: str | None, step: int = STEP) -> Iterator[np.ndarray]:
    """The rows of ``passages``, those of ``step`` bytes at a time."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        yield np.zeros((1, FEATURES), np.float32)
    for at in range(0, len(data), step):
        yield _features(data[at:at + step], data[max(at - 1, 0):at], len(data))


def _features(data: np.ndarray, before: np.ndarray, total: int) -> np.ndarray:
    """Features of the passages of ``data``, which follows the byte ``before`` (if any) in a text of ``total`` bytes."""
    n = -(-len(data) // PASSAGE)
    where = np.arange(len(data)) // PASSAGE
    counts = np.bincount(where * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    sizes = counts.sum(axis=1, keepdims=True)
    shape = np.zeros((n, SHAPES), np.float32)
    shape[:, 0] = counts[:, 65:91].sum(axis=1)
    shape[:, 1] = counts[:, 97:123].sum(axis=1)
    shape[:, 2] = counts[:, 48:58].sum(axis=1)
    shape[:, 3] = counts[:, [32, 9, 10, 13]].sum(axis=1)
    shape[:, 4] = counts[:, 33:48].sum(axis=1) + counts[:, 58:65].sum(axis=1) + counts[:, 91:97].sum(axis=1) + counts[:, 123:127].sum(axis=1)
    shape[:, 5] = counts[:, 128:].sum(axis=1)
    shape /= sizes
    # pairs of neighbours belong to the passage of the second byte
    joined = np.concatenate([before, data])
    owner = where[1 - len(before):]
    blank = (joined == 32) | (joined == 10)
    shape[:, 6] = np.bincount(owner[blank[1:] & blank[:-1]], minlength=n) / sizes[:, 0]
    words = np.maximum(1, np.bincount(owner[~blank[1:] & blank[:-1]], minlength=n))
    shape[:, 7] = np.minimum(sizes[:, 0] / words, 40) / 10
    pairs = joined[:-1].astype(np.int64) << 8 | joined[1:]
    distinct = np.bincount(np.unique((owner << 16) + pairs) >> 16, minlength=n) if len(pairs) else np.zeros(n)
    shape[:, 8] = distinct / sizes[:, 0]
    shape[:, 9] = np.log1p(sizes[:, 0]) / 6
    shape[:, 10] = np.log1p(total) / 12
    shape[:, 11] = (counts[:, :32].sum(axis=1) - counts[:, 10]) / sizes[:, 0]
    return np.concatenate([np.sqrt(counts / sizes), shape], axis=1)


def bags(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All passages in one matrix, and where each document starts."""
    sizes = np.array([len(x) for x in found])
    return np.concatenate(found), np.cumsum(sizes) - sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _hidden(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hidden vectors of passages, the two sides of their gated attention, and its logits."""
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    return h, t, g, (t * g) @ w["a"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    h, t, g, a = _hidden(w, x)
    e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), sizes))
    alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": _sigmoid(z @ w["c"] + w["c0"]), "sizes": sizes}


def _forward_in_parts(w: dict[str, np.ndarray], parts: Iterator[np.ndarray]) -> float:
    """The score of one document whose passages come in parts: sums relative to the greatest logit so far."""
    top, total, z = -np.inf, 0.0, np.zeros(HIDDEN)
    for x in parts:
        h, _, _, a = _hidden(w, x)
        now = max(top, a.max())
        e = np.exp(a - now)
        total, z, top = total * np.exp(top - now) + e.sum(), z * np.exp(top - now) + e @ h, now
    return float(_sigmoid(z / total @ w["c"] + w["c0"])[0])


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    d = (f["p"] - y) * weight / weight.sum()
    dz = np.repeat(d[:, None] * w["c"][None, :], f["sizes"], axis=0)
    up = (dz * f["h"]).sum(axis=1)
    da = f["alpha"] * (up - np.repeat(np.add.reduceat(f["alpha"] * up, starts), f["sizes"]))
    dt, dg = da[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["alpha"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"c": f["z"].T @ d, "c0": d.sum(keepdims=True), "a": (f["t"] * f["g"]).T @ da, "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "W": ((x - w["mean"]) / w["scale"]).T @ dh, "b": dh.sum(axis=0)}


def fit(found: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights by Adam over shuffled batches; both classes weigh the same. One class or none gives a constant."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(found) if found else np.zeros((1, FEATURES), np.float32)
    scale = x.std(axis=0)
    w = {"mean": x.mean(axis=0), "scale": np.where(scale > 1e-4, scale, 1.0).astype(np.float32),
         "W": rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)).astype(np.float32), "b": np.zeros(HIDDEN, np.float32),
         "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)).astype(np.float32), "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)).astype(np.float32),
         "a": rng.normal(0, GATE ** -0.5, GATE).astype(np.float32), "c": rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32), "c0": np.zeros(1, np.float32)}
    y = np.asarray(labels, np.float32)
    if len(found) == 0 or y.min() == y.max():
        w["c"][:] = 0
        w["c0"][:] = 0 if len(found) == 0 else 4 * (2 * y[0] - 1)
        return w
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    names = ["W", "b", "V", "U", "a", "c", "c0"]
    m, v, step = {k: np.zeros_like(w[k]) for k in names}, {k: np.zeros_like(w[k]) for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(found))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            g = _gradients(w, *bags([found[i] for i in part]), y[part], weight[part])
            step += 1
            for k in names:
                grad = g[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                w[k] = (w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_passages: int, id_col: str, text_col: str, label_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """All passages, and labels, of documents that are not held out: ``per_class`` of each class at most, in order of a digest
    of the id, as long as those of a class have half of ``most_passages`` together. Rows that repeat id and text count once."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()

    def first(rows: DataFrame, order: list[Column]) -> DataFrame:
        return rows.where("y = 0").orderBy(*order).limit(per_class).unionByName(rows.where("y = 1").orderBy(*order).limit(per_class))

    order = [F.xxhash64("id"), F.col("id")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(first(usable, order)), "id").select(
        "id", "y", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    size = F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1))
    sized = first(rows.select("id", "y", "key", size.alias("n")).distinct(), [*order, F.col("key")])
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(*order, "key"))
    kept = sized.withColumn("_upto", upto).where(F.col("_upto") <= most_passages // 2).select("id", "y", "key")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].astype(str), "y": batch["y"], "key": batch["key"], "x": [passages(t).tobytes() for t in batch["text"]]})

    found = rows.join(F.broadcast(kept), ["id", "y", "key"], "left_semi").mapInPandas(encode, "id string, y int, key string, x binary").groupBy(
        "id", "y", "key").agg(F.first("x").alias("x")).collect()
    found.sort(key=lambda r: (r.id, r.y, r.key))
    return [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in found], np.array([r.y for r in found], np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   per_class: int = SAMPLE_DOCS, most_passages: int = SAMPLE_PASSAGES) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``.

    Labels of held-out ids (crc32 of the id mod 3 is 1) are never read; the score sees the text
    alone, so equal texts score alike. NULL and empty texts are one empty passage. Without labels
    every score is 0.5, with one class only it is a constant. NULL ids are not held out; labels that
    are repeated count once; an empty table gives no rows; other columns are ignored.
    """
    found, y = training_sample(docs, labels, per_class, most_passages, id_col, text_col, label_col)
    weights = fit(found, y)
    # in double precision and rounded, so that a score does not depend on the texts beside it
    sent = docs.sparkSession.sparkContext.broadcast({k: v.astype(np.float64) for k, v in weights.items()})

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                some = texts.iloc[at:at + 64].tolist()
                scores = np.empty(len(some))
                short = [i for i, t in enumerate(some) if not t or len(t) <= STEP // 4]
                if short:
                    scores[short] = _forward(sent.value, *bags([passages(some[i]) for i in short]))["p"]
                for i in set(range(len(some))).difference(short):
                    scores[i] = _forward_in_parts(sent.value, passage_parts(some[i]))
                out.append(np.round(scores, 9))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
