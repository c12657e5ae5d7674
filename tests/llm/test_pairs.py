"""Neighbours, shared spans, batches and near-duplicates against brute force."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmesh.llm import history, knn, neardup, queries, spans, wordsets
from quillmesh.llm.lookalike import plain_words
from quillmesh.tables import scratch_dir


def pairs(df):
    return {tuple(r) for r in df.collect()}


def grams(t, n=3):
    w = plain_words(t)
    return set(zip(*[w[i:] for i in range(n)]))


def overlap(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def corpus(n=120, seed=5):
    """Texts of which many are edited copies of others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(n):
        if k > 20 and rng.random() < 0.6:
            body = rng.choice(texts).split()
            for _ in range(rng.randint(0, 6)):
                body[rng.randrange(len(body))] = rng.choice(words)
        else:
            body = rng.choices(words, k=rng.choice([10, 16, 30, 60, 200]))
        texts.append(" ".join(body))
    return texts


def test_near_duplicates(rows):
    texts = corpus()
    data = [(f"k{i:03d}", t) for i, t in enumerate(texts)] + [("k000", texts[0]), ("n", None), ("e", ""), (None, texts[1])]
    sets = [grams(t) if len(t.split()) >= 16 else set() for t in texts]
    want = {(f"k{i:03d}", f"k{j:03d}") for i, j in combinations(range(len(texts)), 2) if overlap(sets[i], sets[j]) >= 0.55}
    df = rows(data, "k string, t string")
    for leaf in (1000, 3):  # with 3, shards are cut into shells and blocks
        got = pairs(neardup.near_duplicates(df, "k", "t", 3, 0.55, 16, leaf=leaf))
        assert got <= want
        by = {f"k{i:03d}": t for i, t in enumerate(texts)}
        # Of copies the first and the last key stand for the text: every link between different texts is there.
        assert {frozenset((by[a], by[b])) for a, b in got} == {frozenset((by[a], by[b])) for a, b in want}
    assert neardup.near_duplicates(rows([], "k string, t string"), "k", "t").count() == 0


def test_counters_are_added_up_before_they_are_sent(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(-(2**62), 2**62, (400, 300)) // rng.integers(1, 2**40, (400, 1))
    df = spark.createDataFrame([(v,) for v in values.tolist()], "s array<bigint>").repartition(2).localCheckpoint()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    got = wordsets.gathered(wordsets.slot_counts(df, "s"))
    n = np.bincount(values.ravel() & (wordsets.COUNTERS - 1), minlength=wordsets.COUNTERS)
    assert (got == np.minimum(127, 4 * np.log2(np.maximum(n, 1))).astype(np.int8)).all()
    assert moved() - before < 8 * values.size, (moved() - before) / values.size


def test_rarest_values_of_each_set():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 3, 1 << 10).astype(np.int8)
    for step in (1, 1 << 40):  # neighbours, which the sort key doesn't tell apart, and far ones
        sets = [np.unique(rng.integers(-500, 500, n)) * step for n in (5, 80, 300, 1)]
        ends, take = np.r_[0, np.cumsum([len(s) for s in sets])], np.array([2, 40, 300, 1])
        values, of = wordsets.rarest(np.concatenate(sets), ends, counts, take)
        for k, s in enumerate(sets):
            want = sorted(s.tolist(), key=lambda v: (counts[v & 1023], v % 2**64))[: take[k]]
            assert values[of == k].tolist() == want


def test_groups_are_not_compared(rows):
    t = " ".join(f"w{i}" for i in range(40))
    df = rows([("a", t, "x"), ("b", t + " end", "x"), ("c", t + " end", "y")], "k string, t string, g string")
    assert pairs(neardup.near_duplicates(df, "k", "t", within="g")) == {("a", "b")}


def test_vantage_point_tree():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 8), dtype=np.uint64)
    points = np.repeat(base, 10, 0)
    for k in range(len(points)):
        points[k, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(63))
    tree = neardup.VPTree(points, leaf=4)
    for radius in (0, 2, 200, 600):
        for q in points[::37]:
            want = np.flatnonzero(np.bitwise_count(points ^ q).sum(1) <= radius)
            assert sorted(tree.within(q, radius)) == want.tolist()


def test_batches(rows, spark, tmp_path):
    texts = corpus(100, 6)
    rng = random.Random(7)
    data = [(f"k{i:03d}", t, rng.randint(1, 4)) for i, t in enumerate(texts)]
    data += [(k, t, min(4, b + 1)) for k, t, b in data[:9]] + [("n", None, 2), ("e", "", 2), ("x", texts[0], None)]
    seen = [(k, grams(t), b) for k, t, b in data if t and b and len(t.split()) >= 16]
    want = {(k, b) for k, s, b in seen if any(o < b and overlap(s, z) >= 0.55 for _, z, o in seen)}
    df = rows(data, "k string, t string, b int")
    got = {(r["key"], r["batch_no"]) for r in history.repeated_rows(df, "k", "t", "b").collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    # Batch after batch against the store: the same rows, without reading earlier batches again.
    store, step = history.ChunkStore(spark, str(tmp_path / "store")), set()
    for b in (1, 2, 3, 4):
        found = history.repeated_rows(df.where(F.col("b") == b), "k", "t", "b", store=store)
        step |= {(r["key"], r["batch_no"]) for r in found.collect()}
    assert step == got
    assert history.repeated_rows(rows([], "k string, t string, b int"), "k", "t", "b").count() == 0


def test_members_by_value_and_by_bits(spark, monkeypatch):
    df = spark.range(1000).selectExpr("xxhash64(id) AS h", "id", "array(id) AS a")
    values = df.where("id % 7 = 0").select("h")
    for most in (wordsets.MEMBERS, 10):  # beyond, a table of bits
        monkeypatch.setattr(wordsets, "MEMBERS", most)
        assert {r["id"] for r in wordsets.only_members(df, "h", values).collect()} == set(range(0, 1000, 7))
    assert wordsets.only_members(df, "h", values.limit(0)).count() == 0


def test_a_batch_is_matched_in_few_jobs(rows, spark, tmp_path):
    data = [(f"k{i:03d}", t, 1 + i % 2) for i, t in enumerate(corpus(60, 8))]
    df = rows(data, "k string, t string, b int")
    store = history.ChunkStore(spark, str(tmp_path / "store"))
    history.repeated_rows(df.where("b = 1"), "k", "t", "b", store=store)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert history.repeated_rows(df.where("b = 2"), "k", "t", "b", store=store).count()
    assert jobs() - before <= 28, jobs() - before


def test_candidates_with_little_in_common_do_not_move_their_sets(rows, spark, tmp_path, request):
    name = "spark.sql.autoBroadcastJoinThreshold"  # as if the tables were large
    spark.conf.set(name, -1)
    request.addfinalizer(lambda: spark.conf.unset(name))
    rng = random.Random(9)
    stock = " ".join(f"s{i}" for i in range(50))  # every pair is a candidate by it, none is near
    texts = [stock + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(240)]
    data = [(f"k{i:03d}", t, 1 + i % 2) for i, t in enumerate(texts)] + [("copy", texts[0][:-9] + " x y", 2), ("same", texts[2], 2)]
    df = rows(data, "k string, t string, b int")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    store = history.ChunkStore(spark, str(tmp_path / "store"))
    history.repeated_rows(df.where("b = 1"), "k", "t", "b", store=store)
    before = moved()
    assert pairs(history.repeated_rows(df.where("b = 2"), "k", "t", "b", store=store).select("key", "batch_no")) == {("copy", 2), ("same", 2)}
    assert moved() - before < 1_000_000, moved() - before


def test_prints_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    data = []
    for _ in range(400):
        both, a, b = (rng.integers(0, 1 << 32, rng.integers(low, high), dtype=np.uint64) for low, high in ((5, 300), (0, 90), (0, 90)))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        prints = [wordsets.odd_sketches(v, np.array([0, len(v)]), history.PRINT).reshape(-1).view(np.int64).tolist() for v in (x, y)]
        data.append((len(x), prints[0], len(y), prints[1], len(np.intersect1d(x, y)) / len(np.union1d(x, y))))
    df = spark.createDataFrame(data, "n int, print array<bigint>, other_n int, other_print array<bigint>, overlap double")
    assert df.where("overlap >= 0.55").count() > 100
    assert df.where("overlap >= 0.55").where(~history.possible(0.55)).count() == 0
    assert df.where("overlap < 0.35").where(history.possible(0.55)).count() < 0.2 * df.where("overlap < 0.35").count()
    # A store without prints decides by the sizes alone.
    assert df.where("overlap >= 0.55").withColumn("other_print", F.lit(None).cast("array<bigint>")).where(~history.possible(0.55)).count() == 0


def test_a_report_is_parsed_once(spark):
    plan = queries.p4_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1, plan.count("from_json(")


def test_distinct_values_of_each_text(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [3, 0, 50, 1, 400]
    words = wordsets.Words([[f"w{k}" for k in rng.integers(0, 40, n)] for n in sizes], np.zeros(5, np.uint64))
    close = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 4, len(words.of)).astype(np.uint64)  # alike but for their last bits
    for values in (words.hashes, words.hashes.astype(np.uint32), close):
        ends, found, beside = words.each(values, words.of, values % 7)
        for k in range(5):
            want = np.unique(values[words.of == k])
            assert found[ends[k] : ends[k + 1]].tolist() == want.tolist() and beside[ends[k] : ends[k + 1]].tolist() == (want % 7).tolist()


def test_report_text(spark):
    good = '{"x": 1, "report": {"sentences": [{"text": "A."}, {"text": "B.", "s": 2}]}}'
    df = spark.createDataFrame([(good,), (good[:50],), ("",), (None,), ('{"report": null}',), ("[]",)], "j string")
    assert [r["t"] for r in df.select(history.report_text(F.col("j")).alias("t")).collect()] == ["A. B.", None, None, None, None, None]


def brute_spans(data, least):
    seen = {}
    for k, t in data:
        for i in range(len(t) - least + 1):
            seen.setdefault(t[i : i + least], set()).add(k)
    out = set()
    for k, t in data:
        hit = [(i, i + least) for i in range(len(t) - least + 1) if len(seen[t[i : i + least]]) > 1]
        out |= {(k, a, b) for a, b in spans.merged([a for a, _ in hit], [b for _, b in hit])}
    return out


def test_shared_spans(rows):
    rng = random.Random(8)
    letters = "abcdefghij é字\U0001f600"
    passages = ["".join(rng.choices(letters, k=rng.choice([30, 39, 40, 41, 90, 300]))) for _ in range(12)]
    data = []
    for k in range(80):
        t = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            t += p[a:] + "".join(rng.choices(letters, k=rng.randint(0, 30)))
        data.append((f"k{k}", t))
    data += [("rep", "ab" * 100), ("rep2", "ab" * 60), ("same", data[5][1]), ("k1", data[1][1])]
    df = rows([*data, ("n", None), (None, "x" * 99)], "k string, t string")
    for kwargs in ({}, {"per_shard": 2, "per_task": 3}):
        got = {(r["rec_key"], r["start_pos"], r["end_pos"]) for r in spans.shared_spans(df, "k", "t", 40, **kwargs).collect()}
        assert got == brute_spans(dict.fromkeys(data), 40)
    share = {r["rec_key"]: r["share"] for r in spans.shared_shares(df, "k", "t", 40).collect()}
    assert share["rep2"] == 1.0
    assert spans.shared_spans(rows([], "k string, t string"), "k", "t").count() == 0


def test_nearest(rows):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.repeat(base, 8, 0) + rng.normal(size=(480, 16)) * 0.25
    x[100:130] = x[99]  # a group of equal vectors
    data = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    edge = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 8), (904, [float("nan")] * 16), (None, [1.0] * 16), data[7]]
    near = knn.nearest(rows([*data, *edge], "i long, e array<float>"), "i", "e", dim=16, k=5, parts=4, per_list=40, probes=6, block=64)
    got = {}
    for r in near.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"]))
    u = np.array([d[1] for d in data])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    hit = 0
    for i in range(len(u)):
        want = sorted(range(len(u)), key=lambda j: (-s[i, j], j))[:5]
        hit += len(set(want) & {o for _, o in got[i]})
    assert set(got) == set(range(len(u))) and hit >= 0.95 * 5 * len(u)
    assert [o for _, o in sorted(got[120])] == [99, 100, 101, 102, 103]
    few = knn.nearest(rows(data[:3], "i long, e array<float>"), "i", "e", dim=16, parts=4, queries=F.col("id") == 1).collect()
    assert {(r["id"], r["other"]) for r in few} == {(1, 0), (1, 2)}
    assert knn.nearest(rows(edge[:3], "i long, e array<float>"), "i", "e", dim=16).count() == 0


def _exact(u, k, least):
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: [int(j) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least] for i in range(len(u))}


def test_neighbours_do_not_depend_on_probes_or_keep(rows):
    rng = np.random.default_rng(9)
    loose = rng.normal(size=(700, 16))
    hot = rng.normal(size=16) + 0.15 * rng.normal(size=(400, 16))  # a hot group spread over many lists
    u = np.concatenate([loose, hot]).astype(np.float32).astype(np.float64)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(u)]
    u /= np.linalg.norm(u, axis=1)[:, None]
    df = rows(data, "i long, e array<float>")
    for least, asked in ((0.8, None), (None, F.col("id") % 10 == 0)):
        want = {i: o for i, o in _exact(u, 5, least or -1).items() if o and (asked is None or i % 10 == 0)}
        for group in (32_768, 100):  # with 100, lists lie in several groups
            near = knn.nearest(df, "i", "e", dim=16, k=5, least=least, queries=asked, parts=4, per_list=20, probes=2, keep=2, group=group)
            got = {}
            for r in near.orderBy("id", "rank").collect():
                got.setdefault(r["id"], []).append(r["other"])
            assert got == want


def test_neighbours_on_little_disk(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(6000, 96))
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None] * 512) / 1024  # few distinct values, as in the tables
    x[-50:] = x[:50]
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, e array<float>").coalesce(2).write.parquet(str(tmp_path / "x"))
    size = lambda p: sum(f.stat().st_size for f in Path(p).rglob("*.parquet"))
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    kept = Path(scratch_dir(spark).removeprefix("file://"), "quillmesh")
    before = size(kept) + moved()
    near = knn.nearest(spark.read.parquet(str(tmp_path / "x")), "i", "e", dim=96, k=5, least=0.8, sample=500)  # what the sample moves is bounded
    assert {(r["id"], r["other"]) for r in near.collect()} == {(a, b) for k in range(50) for a, b in ((k, 5950 + k), (5950 + k, k))}
    assert size(kept) + moved() - before < 4 * size(tmp_path / "x")


def test_one_vector_of_an_id(rows):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (3, [3.0, 0.0])]
    got = knn.nearest(rows(data, "i long, e array<double>"), "i", "e", dim=2, k=2, least=0.9, parts=1).collect()
    assert {(r["id"], r["other"], r["rank"]) for r in got} == {(1, 2, 1), (2, 1, 1)}  # the smaller array of id 1


def test_shard_that_is_searched_by_a_tree(monkeypatch):
    rng = np.random.default_rng(3)
    n = 3 * neardup.LEAF
    prints = np.repeat(rng.integers(0, 2**63, (n // 6, 8), dtype=np.uint64), 6, 0)
    for k in range(n):
        prints[k, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(63))
    rows = pd.DataFrame({"print": [p.tobytes() for p in prints], "n": 40, "sid": np.arange(n), "home": rng.random(n) < 0.7})
    found = lambda: pairs_of(neardup._searched(rows, np.array([0]), np.array([n]), 0.55))
    pairs_of = lambda df: set(map(tuple, df[["sid_a", "sid_b"]].to_numpy().tolist()))
    built = []
    tree = neardup.VPTree
    monkeypatch.setattr(neardup, "VPTree", lambda *a: built.append(1) or tree(*a))
    by_tree = found()
    assert built and by_tree
    monkeypatch.setattr(neardup, "LEAF", n)
    assert by_tree == found() and len(built) == 1
