"""Language-model scores, importance weights and collocations against brute force."""

import collections
import math
import pathlib
import random
import re
import tracemalloc
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evtlake.llm import collocations, importance, pitman_yor, word_slices

SCHEMA = ("doc_id long, text string, lang string, row long, word string, id long, n long, ids string, codes string, slice string, held string, "
          "score string, rank string, weight string, buckets string, n_words string, phrase string, key string, owner string, _place string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "w", 2, 3, *["x"] * 13) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    prose = lambda n, v: " ".join(f"{rng.choice('aBc')}{rng.randrange(v)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))
    long = prose(40000, 60)
    texts = [None, "", " \n\t", "...", "one", "One two", "É é 日本 ß, É é", long, *[prose(60, 25) for _ in range(60)], prose(200, 5), "b a " * 150, "z" * 5000 + " q"]
    out = [(i, t, [None, "en", "de", "und"][i % 4]) for i, t in enumerate(texts)]
    return out + [(8, texts[8], "en")] * 3 + [(None, texts[9], None)] * 2


@pytest.mark.parametrize("step", [40, 4000, 1 << 20])
@pytest.mark.parametrize("ahead", [0, 1, 4])
def test_slices_hold_every_run_once(rows, step, ahead):
    texts = [t for _, t, _ in rows]
    classes = word_slices.Classes(b" \t", b".,\n")
    found = collections.Counter()
    for s in word_slices.slices(texts, classes, ahead, step):
        words = [w.decode() for w in s.words.to_pylist()]
        for i in np.flatnonzero(s.owned):
            j = i
            run = [words[s.codes[i]]]
            while len(run) <= ahead and s.follows[j]:
                j += 1
                run.append(words[s.codes[j]])
            found[s.rows[s.part[i]], " ".join(run)] += 1
    expected = collections.Counter()
    for row, text in enumerate(texts):
        for piece in re.split("[.,\n]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                expected[row, " ".join(words[i:i + ahead + 1])] += 1
    assert found == expected


# --- importance ---------------------------------------------------------------------


@pytest.mark.parametrize("width", [0, 1, 7, 1023, 1024, 1025, 3000])
def test_crc_of_rows(width):
    data = np.random.default_rng(width).integers(0, 256, (5, width), dtype=np.uint8)
    assert importance.crc32_rows(data).tolist() == [zlib.crc32(r.tobytes()) for r in data]


def brute_importance(rows, target):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return w, [zlib.crc32(x.encode()) % 10000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]
    s = collections.Counter(b for _, t, _ in rows for b in features(t)[1])
    t = collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in {*s, *t}}
    out = []
    for i, text, _ in rows:
        words, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[:25 * len(able) // 100]
    ranks = collections.defaultdict(list)
    for k, r in enumerate(drawn):
        ranks[r].append(k + 1)
    return sorted(((*r[:4], ranks[r].pop() if ranks[r] else None) for r in out), key=str)


def test_importance_sample(spark, rows):
    target = ["b1 a2 a2", None, "c3 b4, a1"]
    found = importance.importance_sample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_importance(rows, target)
    assert [f.dataType.simpleString() for f in found.schema.fields] == ["bigint"] * 5


def test_importance_ties_are_ranked_in_blocks(spark, rows, monkeypatch):
    from evtlake.plans import ordering
    monkeypatch.setattr(ordering.number_rows, "__defaults__", ("pos", 2))
    many = [(None, "a b " * 20, None)] * 40 + rows
    found = importance.importance_sample(table(spark, many), spark.createDataFrame([("b",)], "text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_importance(many, ["b"])


def test_importance_without_rows(spark, rows):
    nothing = table(spark, []), spark.createDataFrame([], "text string")
    assert importance.importance_sample(nothing[0], nothing[1]).count() == 0
    assert sorted(map(tuple, importance.importance_sample(table(spark, rows), nothing[1]).collect()), key=str) == brute_importance(rows, [])


# --- collocations -------------------------------------------------------------------


def brute_collocations(rows, least, top, depth=5):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    inner = collections.defaultdict(int)
    for (lang, p), c in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner[lang, p[i:i + k]] = max(inner[lang, p[i:i + k]], c)
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if 100 * inner[lang, p] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("least,top,budget", [(4, 2000, 2_000_000), (4, 25, 100), (9, 2000, 5), (100, 2000, 1)])
def test_collocations(spark, rows, least, top, budget):
    found = collocations.collocations(table(spark, rows), least=least, top=top, budget=budget)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, top)


def test_collocations_of_two_words(spark, rows):
    found = collocations.collocations(table(spark, rows), least=5, depth=2)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, 5, 2000, 2)


def test_no_collocations(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    row = spark.sql("select 40000000000L a, 9000000000000L n, 300000000000L l, 700000000000L r")
    exact = row.select(F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    assert exact.first()[0] == 1000 * 40000000000 * 9000000000000 // (300000000000 * 700000000000)


def test_keys_keep_the_bytes_of_ids(spark):
    ids = [1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1]
    found = spark.createDataFrame([(i,) for i in ids], "id long").select(collocations.as_key(F.col("id"))).collect()
    assert [bytes(r[0]) for r in found] == [np.array([i], np.int64).tobytes() for i in ids]


# --- language model -----------------------------------------------------------------


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def test_base_scores(spark, rows):
    found = pitman_yor.lm_scores(table(spark, rows)).collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_slices_and_buckets_do_not_change_scores(spark, rows):
    first = {(r.doc_id, r.n_tokens): r.score for r in pitman_yor.lm_scores(table(spark, rows)).collect()}
    again = {(r.doc_id, r.n_tokens): r.score for r in pitman_yor.lm_scores(table(spark, rows), step=300, bucket=200).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-5 for k in first)


@pytest.mark.parametrize("share", [1e-9, 1e-3, 2.0])
def test_scores_follow_the_sampled_restaurants(spark, rows, monkeypatch, share):
    """A plain loop over tokens with the tables of the samples gives the same scores, and probabilities sum to one."""
    kept = {}
    plain = pitman_yor.sampled

    def spy(*options):
        state, totals = plain(*options)
        kept.update(blocks=[pitman_yor.Block(r.asDict()) for r in state.collect()], totals=totals)
        return state, totals

    monkeypatch.setattr(pitman_yor, "sampled", spy)
    found = {(r.doc_id, r.n_tokens): r for r in pitman_yor.lm_scores(table(spark, rows), context_share=share, step=200, bucket=300).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t, _ in rows if not held(i)]
    n = collections.Counter(w for t in train for w in t)
    size = sum(n.values())
    contexts = {"", *(w for w in n if w is not None and n[w] >= share * size)}
    c = collections.Counter(p for t in train for p in zip(["", *t], t) if p[0] in contexts)
    name = {int(np.array([xxhash.xxh3_64_intdigest(w.encode(), pitman_yor.SEED)], np.uint64).view(np.int64)[0]): w for w in n if w is not None}
    name |= {pitman_yor.BEGIN: "", pitman_yor.END: None}
    order = sorted(i for i, w in name.items() if w in contexts)
    totals, samples = kept["totals"], len(kept["totals"]["roots"])
    tables, ends = [{} for _ in range(samples)], [{} for _ in range(samples)]
    for b in kept["blocks"]:
        for s in range(samples):
            for owner, ctx, customers, t in zip(b.owner, b.ctx, b.c, b.t[1 + s]):
                u, w = name[order[ctx]], name[int(b.names[owner])]
                assert customers == c[u, w] and 1 <= t <= customers
                tables[s][u, w] = int(t)
            for i, (cw, tw) in zip(b.names, b.root[1 + s].T):
                ends[s][name[int(i)]] = int(cw), int(tw)
    assert all(t.keys() == c.keys() for t in tables) and all(e.keys() == n.keys() for e in ends)
    leaf = totals["leaf"]
    d, a = leaf["discount"], leaf["strength"]
    served, opened = collections.Counter(), [collections.Counter() for _ in range(samples)]
    for (u, w), k in c.items():
        served[u] += k
        for s in range(samples):
            opened[s][u] += tables[s][u, w]
    after = collections.Counter(w for _, w in c.elements())
    for s, root in enumerate(totals["roots"]):
        of = collections.Counter()
        for (_, w), t in tables[s].items():
            of[w] += t
        # customers of the root: tables, and tokens after words without a restaurant
        assert all(cw == of[w] + n[w] - after[w] and 1 <= tw <= cw for w, (cw, tw) in ends[s].items())
        assert (root["customers"], root["tables"]) == (sum(x for x, _ in ends[s].values()), sum(x for _, x in ends[s].values()))

    def probability(u, w):
        total = 0.0
        for s, root in enumerate(totals["roots"]):
            cw, tw = ends[s].get(w, (0, 0))
            p = (max(cw - root["discount"] * tw, 0) + (root["strength"] + root["discount"] * root["tables"]) / (len(n) + 1)) / (root["strength"] + root["customers"])
            if u in contexts:
                p = (c[u, w] - d * tables[s].get((u, w), 0) + (a + d * opened[s][u]) * p) / (a + served[u])
            total += p
        return total / samples

    for i, t, _ in rows:
        if t and len(t) > 5000:
            continue
        score = sum(math.log10(probability(u, w)) for u, w in zip(["", *tokens(t)], tokens(t)))
        assert abs(score - found[i, len(tokens(t))].score) < 1e-5
    for u in ["", "a1", "b2", "never seen"]:
        assert abs(sum(probability(u, w) for w in n) + probability(u, "never seen") - 1) < 1e-9


@pytest.mark.parametrize("heavy", [0.02, 2.0])
def test_every_preceding_word_has_a_restaurant(spark, rows, monkeypatch, heavy):
    """Whichever blocks a restaurant is kept in, a plain loop over tokens with the tables of the samples gives the same scores."""
    kept = {}
    plain = pitman_yor.sampled

    def spy(state, light, *options):
        state, totals = plain(state, light, *options)
        kept.update(blocks=[pitman_yor.Block(r.asDict()) for r in state.collect()], live=[r.asDict() for r in light.live.collect()], totals=totals)
        return state, totals

    monkeypatch.setattr(pitman_yor, "sampled", spy)
    found = {(r.doc_id, r.n_tokens): r for r in pitman_yor.lm_scores(table(spark, rows), heavy_share=heavy, step=4000, bucket=300, light_bucket=9000).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [tokens(t) for i, t, _ in rows if not held(i)]
    n = collections.Counter(w for t in train for w in t)
    c = collections.Counter(p for t in train for p in zip(["", *t], t))
    name = {int(np.array([xxhash.xxh3_64_intdigest(w.encode(), pitman_yor.SEED)], np.uint64).view(np.int64)[0]): w for w in n if w is not None}
    name |= {pitman_yor.BEGIN: "", pitman_yor.END: None}
    heavies = {"", *(w for w in n if w is not None and n[w] >= heavy * sum(n.values()))}
    order = sorted(i for i, w in name.items() if w in heavies)
    totals, samples = kept["totals"], len(kept["totals"]["roots"])
    tables, ends = [{} for _ in range(samples)], [{} for _ in range(samples)]
    for b in kept["blocks"]:
        for s in range(samples):
            for owner, ctx, customers, t in zip(b.owner, b.ctx, b.c, b.t[1 + s]):
                u, w = name[order[ctx]], name[int(b.names[owner])]
                assert customers == c[u, w]
                tables[s][u, w] = int(t)
            for i, (cw, tw) in zip(b.names, b.root[1 + s].T):
                ends[s][name[int(i)]] = int(cw), int(tw)
    assert {u for u, _ in tables[0]} == heavies
    for row in kept["live"]:
        names, words = (np.frombuffer(row[x], np.int64) for x in ("names", "words"))
        before = np.repeat(names, pitman_yor.grown(row["m"], np.int64))
        after, customers = words[pitman_yor.grown(row["w"], np.int32)], pitman_yor.grown(row["c"], np.int64)
        for s, t in enumerate(pitman_yor.grown(row["t"], np.int64).reshape(samples + 1, -1)[1:]):
            for u, w, k, x in zip(before, after, customers, t):
                assert c[name[int(u)], name[int(w)]] == k and (name[int(u)], name[int(w)]) not in tables[s]
                tables[s][name[int(u)], name[int(w)]] = int(x)
    for t in tables:
        assert all(c[p] == 1 for p in c.keys() - t.keys())
        t |= dict.fromkeys(c.keys() - t.keys(), 1)
        assert t.keys() == c.keys() and all(1 <= t[p] <= c[p] for p in c)
    d, a = totals["leaf"]["discount"], totals["leaf"]["strength"]
    assert d == pitman_yor.discount_of(sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values()))
    served, opened = collections.Counter(), [collections.Counter() for _ in range(samples)]
    for (u, w), k in c.items():
        served[u] += k
        for s in range(samples):
            opened[s][u] += tables[s][u, w]
    for s, root in enumerate(totals["roots"]):
        of = collections.Counter()
        for (_, w), t in tables[s].items():
            of[w] += t
        # every customer of the root is a table
        assert {w: cw for w, (cw, _) in ends[s].items()} == of and all(1 <= tw <= cw for cw, tw in ends[s].values())
        assert (root["customers"], root["tables"]) == (of.total(), sum(x for _, x in ends[s].values()))

    def probability(u, w):
        total = 0.0
        for s, root in enumerate(totals["roots"]):
            cw, tw = ends[s].get(w, (0, 0))
            p = (max(cw - root["discount"] * tw, 0) + (root["strength"] + root["discount"] * root["tables"]) / (len(n) + 1)) / (root["strength"] + root["customers"])
            total += (c[u, w] - d * tables[s].get((u, w), 0) + (a + d * opened[s][u]) * p) / (a + served[u])
        return total / samples

    for i, t, _ in rows:
        if t and len(t) > 5000:
            continue
        score = sum(math.log10(probability(u, w)) for u, w in zip(["", *tokens(t)], tokens(t)))
        assert abs(score - found[i, len(tokens(t))].score) < 1e-5
    for u in ["", "a1", "b2", "never seen"]:
        assert abs(sum(probability(u, w) for w in n) + probability(u, "never seen") - 1) < 1e-9


def test_blocks_of_rare_words_do_not_change_scores(spark, rows):
    first, again = ({(r.doc_id, r.n_tokens): r.score for r in pitman_yor.lm_scores(table(spark, rows), heavy_share=0.02, **sizes).collect()}
                    for sizes in ({}, {"step": 4000, "bucket": 200, "light_bucket": 5000}))
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-5 for k in first)


def test_answers_are_stored_one_kind_after_the_other(spark, rows, monkeypatch):
    """No stored table waits for the shuffles of both kinds of restaurants, and the seating of heavy words is gone before the others answer."""
    plain, exchanges, seatings, left = pitman_yor.stored, {}, [], {}

    def spy(df, name, *options):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        left[name] = [path for path in seatings if pathlib.Path(path.removeprefix("file:")).exists()]
        out = plain(df, name, *options)
        if name in ("blocks", "seating"):
            seatings.append(out.stored_at)
        return out

    monkeypatch.setattr(pitman_yor, "stored", spy)
    assert pitman_yor.lm_scores(table(spark, rows), heavy_share=0.02).count() == len(rows)
    assert len(left["answers"]) == 1 and exchanges["answers"] == exchanges["light-answers"] == 1
    assert seatings and not left["light-answers"] and not left["own"]


def light_peak(buckets):
    """Peak of the task that makes blocks of rare words of ``buckets``, and the largest batch of several rows that it hands over."""
    class Rows:
        repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    def asks():
        for b in range(buckets):
            rng = np.random.default_rng(b)
            names, words = (np.unique(rng.integers(1 << 62, 1 << 63, n, np.uint64)) for n in (2000, 5000))
            m, w = np.full(len(names), 100), np.tile(np.arange(0, 5000, 50), len(names)) + np.repeat(rng.integers(0, 50, len(names)), 100)
            cells = names.tobytes(), pitman_yor.shrunk(m), words.tobytes(), pitman_yor.shrunk(w.astype(np.int32)), pitman_yor.shrunk(rng.integers(0, 3, len(w)))
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([0]), *[pa.array([x], pa.binary()) for x in cells]], ["bucket", "slice", "names", "m", "words", "w", "c"])

    rows = list(asks())
    tracemalloc.start()
    try:
        sizes = [batch.nbytes for batch in pitman_yor.light_blocks(Rows(), 5)(iter(rows)) if batch.num_rows > 1]
        return tracemalloc.get_traced_memory()[1], max(sizes, default=0)
    finally:
        tracemalloc.stop()


def test_a_task_holds_one_block_at_a_time_and_hands_it_over_in_portions(monkeypatch):
    monkeypatch.setattr(pitman_yor, "PORTION", 50_000, raising=False)
    light_peak(1)
    (one, largest), (four, _) = light_peak(1), light_peak(4)
    assert four < 1.05 * one and largest < 60_000


def test_rare_words_tell_what_follows_them(spark):
    """Each of 6,000 words makes up less than CONTEXT_SHARE of the tokens, and is always followed by the same one."""
    rng = random.Random(4)

    def text():
        at = rng.randrange(6000)
        return " ".join(f"w{(at + i) % 6000}" for i in range(200))

    docs = [(i, text(), None) for i in range(600)]
    found = pitman_yor.lm_scores(table(spark, docs)).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert 10 ** (-found[0] / found[1]) < 4


@pytest.mark.parametrize("c,rate,more,discount", [(2, 0.3, 0.1, 0.5), (30, 0.8, 0.2, 0.7), (200, 2.0, 0.0, 0.3), (50, 0.01, 0.3, 0.9)])
def test_tables_are_those_of_customers_seated_one_by_one(c, rate, more, discount):
    n = 4000
    found = pitman_yor.seat(np.full(n, c), np.full(n, rate), more, discount, np.arange(n, dtype=np.int64) * 977, 3)
    rng = np.random.default_rng(1)
    t = np.ones(n)
    for seated in range(1, c):
        new = rate + more * t
        t += rng.random(n) < new / (seated - discount * t + new)
    assert found.min() >= 1 and found.max() <= c
    assert abs(found.mean() - t.mean()) < 5 * (t.std() + 0.05) * math.sqrt(2 / n)
    assert abs(found.std() - t.std()) < 0.1 * t.std() + 0.05


def test_a_dish_of_very_many_customers():
    t = pitman_yor.seat(np.array([10 ** 12, 0, 1]), np.full(3, 1.5), 0.1, 0.6, np.arange(3, dtype=np.int64), 1)
    assert t[0] > 10 and t[1:].tolist() == [0, 1]


def test_the_model_beats_single_tokens_on_held_out_texts(spark):
    rng = random.Random(8)
    follow = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}

    def text():
        w = ["w0"]
        for _ in range(120):
            w.append(rng.choice(follow[w[-1]]))
        return " ".join(w)

    found = pitman_yor.lm_scores(table(spark, [(i, text(), None) for i in range(300)])).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert 10 ** (-found[0] / found[2]) < 6 < 50 < 10 ** (-found[1] / found[2])


def test_scores_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert [tuple(r) for r in pitman_yor.lm_scores(table(spark, [(held, "a b", None)])).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert pitman_yor.lm_scores(table(spark, [])).count() == 0
