import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlift.operators import aggregates as ag
from ledgerlift.operators import lookup as lk
from ledgerlift.operators import ranking as rk
from ledgerlift.session import shared_dir


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)
    return spark.range(n).select("id", key.alias("g"), ((F.col("id") * 7919) % 101).alias("v"))


def test_global_row_number(spark):
    got = rk.global_row_number(skewed(spark), [("v", "desc"), ("id", "asc")]).orderBy("rank").select("v", "id", "rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    assert [(r["v"], r["id"]) for r in got] == sorted(((r["v"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))


def test_grouped_row_number_with_a_hot_group(spark):
    df = skewed(spark)
    got = rk.grouped_row_number(df, ["g"], [("v", "desc"), ("id", "asc")]).select("id", "rank")
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id")).cast("bigint").alias("rank"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_grouped_row_number_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = {(r["g"], r["id"]): r["rank"] for r in rk.grouped_row_number(df, ["g"], [("id", "asc")]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_exact_quantiles(spark):
    df = skewed(spark)
    want = {(r["g"], p): v for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect() for p, v in zip((0.1, 0.5), r["q"])}
    got = {(r["g"], r["quantile"]): r["value"] for r in rk.exact_quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    assert got == pytest.approx(want)


def test_nulls_sort_last_either_way(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    for way, first in (("asc", 2), ("desc", 3)):
        rows = rk.global_row_number(df, [("v", way), ("id", "asc")]).orderBy("rank").collect()
        assert rows[0]["id"] == first and rows[-1]["id"] == 1


def test_partition_count_does_not_change_ranks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, rk.grouped_row_number(skewed(spark), ["g"], [("v", "asc"), ("id", "asc")]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_quota(spark):
    rows = [(1, f"D{i}", 100 - i) for i in range(3)] + [(1, f"I{i}", 50 - i) for i in range(9)] + [(2, "I", 1)]
    df = spark.createDataFrame(rows, "k int, c string, v int")
    got = rk.quota_top(df, ["k"], [("v", "desc"), ("c", "asc")], limit=5, special=F.col("c").startswith("D"))
    by_key = {}
    for r in got.orderBy("k", "rank").collect():
        by_key.setdefault(r["k"], []).append(r["c"])
    assert by_key == {1: ["D0", "I0", "I1", "I2", "I3"], 2: ["I"]}


def test_fill_from_global(spark):
    listed = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q")], "k string, item string")
    ranking = spark.createDataFrame([("x", 1), ("z", 2), ("y", 3), ("w", 4), ("q", 5)], "item string, r int")
    got = {(r["k"], r["item"]) for r in rk.fill_from_global(listed, ["k"], "item", ranking, "r", 2).collect()}
    assert got == {("a", "z"), ("a", "w"), ("b", "x"), ("b", "z")}


def test_unique_lookup_drops_ambiguous_and_blank(spark):
    df = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g1"), ("b", "g2"), ("", "g3"), (None, "g4")], "k string, g string")
    assert [tuple(r) for r in lk.unique_lookup(df, ["k"], ["g"]).collect()] == [("a", "g1")]


def test_many_to_one_refuses_duplicates(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(lk.DuplicateKeyError):
        lk.many_to_one(left, right, ["k"])


def test_sparse_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "" if i % 3 == 0 else (None if i % 3 == 1 else "k")) for i in range(30)], "id int, k string")
    out = lk.sparse_join(left, spark.createDataFrame([("k", "v"), ("", "bad")], "k string, v string"), ["k"], spread=["id"])
    rows = out.collect()
    assert len(rows) == 30 and {r["v"] for r in rows if r["k"] == "k"} == {"v"} and {r["v"] for r in rows if r["k"] != "k"} == {None}


def test_sparse_join_deals_blank_keys_out(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).otherwise("").alias("k"))
        right = spark.range(0, 4000, 200).select(F.col("id").cast("string").alias("k"), F.lit("v").alias("v"))
        out = lk.sparse_join(left, right, ["k"], spread=["id"]).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("v").alias("hits")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["n"] for r in out) == 4000 and sum(r["hits"] for r in out) == 20
    assert max(r["n"] for r in out) < 1500


def test_cascade_first_method_wins_and_filled_rows_stay(spark):
    rows = spark.createDataFrame([(1, "a", "n", None, None), (2, "zz", "n", None, None), (3, "a", "n", "own", "given"), (4, "zz", "m", None, None)], "id int, c string, n string, g string, m string")
    by_code = spark.createDataFrame([("a", "G1")], "c string, g string")
    by_name = spark.createDataFrame([("n", "G2")], "n string, g string")
    out = lk.cascade_fill(rows, [("code", ["c"], by_code, ["c"]), ("name", ["n"], by_name, ["n"])], ["g"], "m", F.col("g").isNull(), spread=["c", "n"])
    assert {r["id"]: (r["g"], r["m"]) for r in out.collect()} == {1: ("G1", "code"), 2: ("G2", "name"), 3: ("own", "given"), 4: (None, None)}


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    words = ["foo", "bar", "baari", "nord", "oy", "tek"]
    texts = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)})
    names = [(t, i) for i, t in enumerate(texts)]
    known = spark.createDataFrame([(n, f"b{i % 25}") for n, i in names], "kn string, kid string")
    rows = spark.createDataFrame([(i, t + " x" if i % 2 else t[:7]) for i, t in enumerate(texts)], "rid int, nm string")
    got = {r["rid"]: r["kid"] for r in lk.unique_containment(rows, "rid", "nm", known, "kn", "kid").collect()}
    want = {}
    for r in rows.collect():
        if len(r["nm"]) < 4:
            continue
        ids = {k["kid"] for k in known.collect() if len(k["kn"]) >= 4 and (k["kn"] in r["nm"] or r["nm"] in k["kn"])}
        if len(ids) == 1:
            want[r["rid"]] = ids.pop()
    assert got == want and want


@pytest.mark.parametrize("threshold", [0.9, 0.88, 0.6])
def test_similar_pairs_against_brute_force(spark, threshold):
    rng = random.Random(1)
    words = ["sininen", "kynä", "muki", "iso", "pullo", "reppu"]
    left = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(40)}) + ["ab", "abc"]
    right = sorted({"".join(c for c in t if rng.random() > 0.07) + rng.choice(["", "x"]) for t in left}) + ["a", "abd"]
    got = lk.similar_pairs(spark.createDataFrame([(t,) for t in left], "a string"), "a", spark.createDataFrame([(t,) for t in right], "b string"), "b", threshold)
    want = {(a, b) for a in left for b in set(right) if b and SequenceMatcher(None, a, b).ratio() >= threshold}
    assert {(r["a"], r["b"]) for r in got.collect()} == want


def test_fuzzy_margin(spark):
    names = ["punainen keittiöpyyhe iso", "sininen urheilupullo metalli"]
    master = spark.createDataFrame([(n,) for n in names] + [("sininen urheilupullo metallj",)], "m string")
    asked = spark.createDataFrame([("punainen keittiöpyyhe isox",), ("sininen urheilupullo metallk",)], "a string")
    got = {r["a"]: r["m"] for r in lk.fuzzy_best(asked, "a", master, "m").collect()}
    assert got == {"punainen keittiöpyyhe isox": "punainen keittiöpyyhe iso"}  # the other has two equal rivals


def test_consolidation_of_small_leaves(spark):
    rows = [("A", "x", f"l{i}", "s") for i in range(4)] + [("A", "y", "big", "s")] * 5 + [("B", "z", "tiny", "s")]
    got = ag.consolidate_small(spark.createDataFrame(rows, "l1 string, l2 string, l3 string, src string"), ["l1", "l2", "l3"], 5, "src")
    counts = {(r["l1"], r["l3"]): r["count"] for r in got.groupBy("l1", "l3").count().collect()}
    assert counts == {("A", "big"): 5, ("Muut / tarkistettavat", "Muut / tarkistettavat"): 5}


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(ag.sum_or_zero(F.col("v")).alias("s")).collect()} == {"a": 0.0, "b": 2.0}


def test_shared_folder_is_asked_for_off_one_machine(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "/shared/"})
    assert shared_dir(Session()) == "/shared"


def test_sparse_join_reads_keys_only_and_keeps_their_types(spark, tmp_path):
    spark.range(100).selectExpr("id", "IF(id % 3 = 0, NULL, cast(id as double)) k", "uuid() wide").write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    right = spark.range(50).selectExpr("id k", "id * 2 v")
    out = lk.sparse_join(left, right, ["k"], spread=["id"]).select("id", "v")
    assert "wide" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["v"] for r in out.collect()} == {i: None if i % 3 == 0 or i >= 50 else 2 * i for i in range(100)}


def test_take_places_when_everyone_wants_the_first(spark, monkeypatch):
    monkeypatch.setattr(rk, "PLACE_SHARE", 7)
    monkeypatch.setattr(rk, "PLACE_BLOCK", 4)
    wanted = spark.createDataFrame([(i, "one" if i < 90 else None, i % 12) for i in range(100)], "id int, seg string, need int")
    ranked = spark.createDataFrame([("one", p, f"item{p}") for p in range(1, 11)] + [(None, p, f"none{p}") for p in range(1, 4)], "seg string, place bigint, item string")
    got = rk.take_places(wanted, ranked, ["seg"], "place", F.col("need"), ["id"])
    assert got.columns == ["id", "seg", "need", "place", "item"]
    want = {(i, f"item{p}") for i in range(90) for p in range(1, min(i % 12, 10) + 1)} | {(i, f"none{p}") for i in range(90, 100) for p in range(1, min(i % 12, 3) + 1)}
    rows = [(r["id"], r["item"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    every = rk.take_places(wanted.select("id"), ranked.filter("seg is not null").drop("seg"), [], "place", F.lit(3), ["id"])
    assert every.count() == 300


def test_contained_names_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(k, word(rng.choice([0, 1, 3, 9, 40]))) for k in range(120)] + [(500, None)]
    names = sorted({word(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 20) for _ in range(8)} | {t[k:k + n] for _, t in texts if t for k in (0, 2) for n in (1, 3, 4, 8, 17)} - {""})
    got = lk.contained_names(
        spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(n, len(n)) for n in names], "name string, size int"), "name"
    )
    rows = [(r["id"], r["name"]) for r in got.collect()]
    want = {(k, n) for k, t in texts if t for n in names if n in t}
    assert len(rows) == len(want) and set(rows) == want and all(r["size"] == len(r["name"]) for r in got.collect())


def test_similar_candidates_are_few_where_all_names_begin_alike(spark):
    rng = random.Random(9)
    names = ["sovelletun tuoteryhmän " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(150)]
    asked = [n[:30] + "q" + n[31:] for n in names[:75]] + names[75:80]
    left, right = spark.createDataFrame([(n,) for n in asked], "a string"), spark.createDataFrame([(n,) for n in names], "b string")
    pairs = {(r["_l"], r["_r"]) for r in lk.similar_candidates(left, "a", right, "b", 0.9).collect()}
    want = {(a, b) for a in asked for b in names if SequenceMatcher(None, a, b).ratio() >= 0.9}
    assert want <= pairs and len(want) >= 80 and len(pairs) < 0.05 * len(asked) * len(names)
    got = {(r["a"], r["b"]) for r in lk.similar_pairs(left, "a", right, "b", 0.9).collect()}
    assert got == want


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_between_brackets(spark, monkeypatch, keys):
    np = pytest.importorskip("numpy")
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([0.0, 0.0, rng.gauss(0, 50), float(rng.randint(0, 9))])) for _ in range(4000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for sketch in (10_000, 50):
        monkeypatch.setattr(rk, "SKETCH", sketch)
        got = {(*(r[k] for k in keys), r["quantile"]): r["value"] for r in rk.exact_quantiles(df, keys, "v", points).collect()}
        groups = {(): [v for _, v in rows if v is not None]} if not keys else {(g,): [v for h, v in rows if h == g and v is not None] for g in ("a", None, "one", "two")}
        want = {(*g, p): float(np.quantile(v, p)) for g, v in groups.items() for p in points}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    sure = {(*(r[k] for k in keys), r["quantile"]): r["value"] for r in rk._ranked_quantiles(df.filter("v is not null").select(*keys, F.col("v").alias("_v")), keys, points).collect()}
    assert all(sure[k] == pytest.approx(want[k]) for k in want)
    assert rk.exact_quantiles(df.filter("v is null"), keys, "v", points).count() == 0


def test_similar_candidates_lose_nothing_and_are_spread(spark, monkeypatch):
    """Few bytes of names make many pairs; before, one task checked them all."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(lk, "PAIR_SHARE", 50)
    rng = random.Random(3)
    names = sorted({f"{rng.choice(['old', 'cold', 'gröne'])} ring brand#{rng.randint(1, 25)} {rng.randint(0, 49)}" for _ in range(120)})
    asked = sorted({f"x{n}" for n in names[::3]} | {n.replace("ring", "rnig") for n in names[1::3]} | {"a", "ab"})
    left, right = spark.createDataFrame([(n,) for n in asked], "a string"), spark.createDataFrame([(n,) for n in [*names, "ab"]], "b string")
    found = lk.similar_candidates(left, "a", right, "b", 0.9)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    pairs = [(r["_l"], r["_r"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) < len(asked) * len(names) // 4
    want = {(x, y): SequenceMatcher(None, x, y).ratio() for x in asked for y in [*names, "ab"]}
    want = {p: v for p, v in want.items() if v >= 0.9}
    assert want and set(want) <= set(pairs)
    scored = lk.similar_pairs(left, "a", right, "b", 0.9).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in scored} == want


def test_shuffles_start_with_partitions_in_proportion_to_the_input(spark, sf_dir, monkeypatch):
    """Before, their number was fixed, so that a task's sorts and hash tables grew with the tables."""
    import os

    from ledgerlift import session
    from ledgerlift.catalog.bindings import table

    monkeypatch.setattr(session, "INPUT_BYTES", 5000)
    try:
        want = -(-os.path.getsize(f"{sf_dir}/lineitem.parquet") // 5000)
        df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
        table(spark, sf_dir, "region")  # a smaller table doesn't take partitions away
        assert want > 8 and f", {want})" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(session._INITIAL)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"


def test_a_written_step_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected garbage, so a job of many steps needed disk for all of them at once."""
    import time

    from ledgerlift.session import _CLEANUP, stage

    def files():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    before, setting = files(), spark.conf.get(_CLEANUP, "false")
    out = stage(spark.range(20000).repartition(8, "id").groupBy((F.col("id") % 77).alias("k")).agg(F.count("*").alias("n")), "step")
    for _ in range(50):
        left = [f for f in files() - before if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 77 and spark.conf.get(_CLEANUP, "false") == setting


def test_crowded_grams_are_dealt_on_both_sides(spark, monkeypatch):
    """The right side went to every piece of the left one, so copies grew with the cube of a gram's rows."""
    monkeypatch.setattr(lk, "PAIR_SHARE", 100)
    a = spark.range(200).select(F.lit("hot").alias("_g"), F.col("id").cast("string").alias("_l")).unionByName(spark.createDataFrame([("cold", "x")], "_g string, _l string"))
    b = spark.range(300).select(F.lit("hot").alias("_g"), F.col("id").cast("string").alias("_r")).unionByName(spark.createDataFrame([("cold", "y"), ("odd", "z")], "_g string, _r string"))
    a, b = lk.dealt_in_blocks(a, b, "_g", "_l", "_r")
    # 20 and 30 pieces of about ten; the right side alone was 300 * 600 rows before
    assert a.filter("_g = 'hot'").count() == 200 * 30 and b.filter("_g = 'hot'").count() == 300 * 20 and a.count() + b.count() == 12003
    met = a.join(b, ["_g", "_part"])
    assert met.count() == 200 * 300 + 1 == met.select("_l", "_r").distinct().count()
    assert met.groupBy("_g", "_part").count().agg(F.max("count")).first()[0] < 500
