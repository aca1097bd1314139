"""Sharding, mixing and quality rules."""

from collections import Counter, defaultdict

import numpy as np
import plain
from pyspark.sql import functions as F

from planegrid.llm.mixing import mix, sized
from planegrid.llm.quality import CUT, judged
from planegrid.llm.sharding import Leaf, base_tree, grown, shard


def test_shards_move_only_into_the_new_one(spark):
    ids = spark.range(4000).withColumn("doc_id", F.when(F.col("id") % 1000 != 1, F.col("id")))
    both = shard(shard(ids, ["doc_id"], base_tree(8)), ["doc_id"], grown(base_tree(8)), "more").collect()
    assert all(r["more"] in (r["shard"], 8) for r in both)
    counts = Counter(r["shard"] for r in both)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.25 * min(counts.values())
    assert 300 < sum(r["more"] == 8 for r in both) < 600


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    tree = base_tree(8)
    heavier = [x._replace(weight=2.0) if x.shard == 0 else x for x in tree]
    ids = spark.range(4000)
    rows = shard(shard(ids, ["id"], tree), ["id"], heavier, "after").collect()
    region = {x.shard: x.region for x in tree}
    for r in rows:
        # what moves comes to region 0, or moves inside it; the other region's rows that stay keep their shard
        assert r["after"] == r["shard"] or region[r["after"]] == 0
    share = sum(r["after"] == 0 for r in rows) / 4000
    assert abs(share - 2 / 9) < 0.03


def test_no_weight_no_rows(spark):
    tree = [Leaf(0, 0, 0, 0.0), Leaf(0, 0, 1), Leaf(1, 1, 2)]
    assert {r["shard"] for r in shard(spark.range(300), ["id"], tree).collect()} == {1, 2}


def test_sharding_edge_cases(docs, none):
    got = shard(docs, ["doc_id"], base_tree(4))
    assert got.count() == docs.count() and dict(got.dtypes)["shard"] == "int"
    assert got.where("doc_id = 3").select("shard").distinct().count() == 1
    assert got.where("doc_id IS NULL").select("shard").distinct().count() == 1
    assert shard(none, ["doc_id"], base_tree(4)).count() == 0


def test_slots_are_gapless(spark):
    from planegrid.llm.sharding import op7_hash_tree

    rows = op7_hash_tree(spark, "/root/testdata/sf0.001").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_numbers_of_rows_alike(spark):
    """Rows without any difference, more than are numbered together, and clashing names."""
    from planegrid.llm import common

    own = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.lit("x").alias("g"), F.lit(None).cast("int").alias("slot0"))
    got = common.number_within(own, ["g"], "slot")
    assert got.columns == ["doc_id", "g", "slot0", "slot"]
    r = got.agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.count_distinct("slot").alias("d"), F.count_distinct("doc_id").alias("ids")).first()
    assert tuple(r) == (200_000, 0, 199_999, 200_000, 66_667)


def test_mix_meets_targets(docs, rows):
    got = mix(sized(docs)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(plain.words(text))
    want = plain.fill(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 * largest[s] + 1e-6
    again = mix(sized(docs.repartition(3))).collect()
    key = lambda r: str(tuple(r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mix_is_fair(spark):
    """Over many seeds a document is taken as often as its fraction says."""
    own = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (10 + F.col("id") * 3).alias("size"), F.col("id").alias("h"))
    total = np.zeros(40)
    for seed in range(30):
        for r in mix(own, total_share=0.4, seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
    assert abs(total.mean() / 30 - 0.4) < 0.05 and total.min() >= 3 and total.max() <= 23


def test_mix_of_repeated_rows_and_nothing(spark, none):
    same = spark.range(90).select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit(7).cast("long").alias("size"), F.lit(5).cast("long").alias("h"))
    got = mix(same).collect()
    assert len(got) == 90 and sum(r["copies"] for r in got) == 135
    assert mix(sized(none)).count() == 0
    zero = same.withColumn("size", F.lit(0).cast("long"))
    assert sum(r["copies"] for r in mix(zero).collect()) == 0


def test_base_counts(docs, rows):
    assert judged(docs).select("g").distinct().count() == 1
    got = judged(docs).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(d, lang, s, *plain.quality(t)) for d, t, lang, s, _ in rows]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_outliers_are_rejected_and_the_rest_stays(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(40, 120))]
        w[0] = w[0].capitalize()
        if i % 40 == 0:
            w = [x + "###" for x in w]
        if i % 40 == 1:
            w = [x.upper() for x in w]
        rows.append((i, " ".join(w), "en", "a" if i % 3 else "b", 0))
    kept = {r["doc_id"]: r["kept"] for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(kept[i] == (i % 40 > 1) for i in kept)


def test_estimate_is_the_plain_one(spark):
    """The native root of the covariance gives the distances that NumPy gives."""
    from planegrid.llm.quality import STATISTICS, _inverse_root, _with_distance

    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    cov, mean = a @ a.T + np.eye(5), rng.normal(size=5)
    row = {"__g": "x"} | {f"m_{i}": float(mean[i]) for i in range(5)} | {f"c_{i}{j}": float(cov[i, j]) for i in range(5) for j in range(i + 1)}
    estimate = _inverse_root(spark.createDataFrame([row]), "__g")
    assert np.isclose(estimate.first()["log_det"], np.linalg.slogdet(cov)[1])
    x = rng.normal(size=(20, 5))
    points = spark.createDataFrame([("x", *map(float, v)) for v in x], "__g string, " + ", ".join(f"{s[0]} double" for s in STATISTICS))
    got = sorted(r["d2"] for r in _with_distance(points, estimate).collect())
    want = sorted(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(got, want)


def test_chi_square():
    """Table values of the distribution."""
    from planegrid.llm.quality import OUTER, chi2_cdf, chi2_quantile, consistency

    for q, dof, x in ((0.5, 5, 4.3515), (0.975, 5, 12.8325), (0.95, 7, 14.0671), (0.75, 5, 6.6257)):
        assert abs(chi2_quantile(q, dof) - x) < 1e-3 and abs(chi2_cdf(x, dof) - q) < 1e-4
    assert abs(chi2_cdf(CUT, 5) - OUTER) < 1e-9
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 5))
    near = x[np.argsort((x * x).sum(1))[: int(0.75 * len(x))]]
    assert np.allclose(np.cov(near.T) * consistency(0.75, 5), np.eye(5), atol=0.02)


def concentrated(x, share, starts, rng):
    """The minimum covariance determinant by brute force: many random starts, whole steps until nothing changes."""
    h = int(np.ceil(share * len(x)))
    best = None
    for _ in range(starts):
        own = x[rng.choice(len(x), 6, replace=False)]
        mean, cov = own.mean(0), np.cov(own.T, bias=True) + 1e-9 * np.eye(5)
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d, kind="stable")[:h]]
            new = own.mean(0), np.cov(own.T, bias=True)
            if np.allclose(new[1], cov):
                break
            mean, cov = new
        if best is None or np.linalg.slogdet(cov)[1] < best:
            best = np.linalg.slogdet(cov)[1]
    return best


def test_least_determinant_is_that_of_brute_force(spark):
    """Two groups of which a fifth lies apart, together and tightly: the estimate is that of the rest."""
    from planegrid.llm.quality import STATISTICS, _scaled, _starts, _step, _with_distance, consistency, least_determinant

    rng = np.random.default_rng(7)
    names = [s[0] for s in STATISTICS]
    least = np.array([s[2] for s in STATISTICS])
    groups = {}
    for g in ("a", "b"):
        mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
        x = rng.normal(size=(500, 5)) @ mix * least * 3
        x[:100] = x[:100] * 0.05 + 12 * least * (1 if g == "a" else -1)
        groups[g] = x
    points = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "__g string, " + ", ".join(f"{n} double" for n in names)).cache()
    estimate = {r["__g"]: r for r in least_determinant(points).collect()}
    tried = _starts(points)
    assert {(r["__g"], r["__k"]) for r in tried.collect()} == {(g, k) for g in groups for k in range(4)}
    for g, x in groups.items():
        clean = x[100:]
        mean, cov = clean.mean(0), np.cov(clean.T)
        r = np.array([[estimate[g][f"r_{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        found = np.linalg.inv(r) @ np.linalg.inv(r).T
        assert np.abs(np.linalg.slogdet(found)[1] - np.linalg.slogdet(cov)[1]) < 0.6
        assert np.allclose(mean, [estimate[g][f"m_{i}"] for i in range(5)], atol=0.35 * np.sqrt(np.diag(cov)).max())
    # the raw estimate: steps from the starts end no higher than brute force does
    for _ in range(12):
        tried = _step(points, tried).cache()
    for g, x in groups.items():
        ours = min(r["log_det"] for r in tried.where(F.col("__g") == g).collect())
        assert ours <= concentrated(x, 0.75, 40, rng) + 0.05
    far = {g: 0 for g in groups}
    for r in _with_distance(points, spark.createDataFrame(list(estimate.values()))).where(F.col("d2") > CUT).groupBy("__g").count().collect():
        far[r["__g"]] = r["count"]
    assert far == {"a": 100, "b": 100}
    assert consistency(0.75, 5) > 1 and _scaled(tried, 4.0).columns == tried.columns


def test_each_statistic_can_reject_by_itself():
    """The floors let the extreme of every statistic lie beyond the cut, but for repeated words, which the base rules reject."""
    from planegrid.llm.quality import STATISTICS

    extreme = {"s_length": np.log(1 + 60) - np.log(1 + 5), "s_symbols": np.log(1 + 1000), "s_capitals": np.log(101) - np.log(1 + 3), "s_lines": np.log(1 + 95)}
    for name, _, least in STATISTICS:
        assert name == "s_repeats" or (extreme[name] / least) ** 2 > CUT, name


def test_quality_of_nothing_and_of_small_groups(none, docs):
    assert judged(none).count() == 0
    assert CUT > 0 and judged(docs.where("doc_id < 4")).where("kept = base_failed").count() == 0


def test_a_source_misses_by_little(spark):
    """A few large documents among many small ones: what the last of them leaves is given or taken back."""
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 4}" if i % 5 else None, int(rng.integers(900, 3000)) if i % 9 == 0 else int(rng.integers(5, 200)), i) for i in range(400)]
    own = spark.createDataFrame(rows, "doc_id long, source string, size long, h long")
    taken, target = Counter(), {}
    for r in mix(own).collect():
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target), {s: taken[s] - target[s] for s in target}
