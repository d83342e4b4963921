"""Cases of the third round's findings."""

from pyspark.sql import functions as F

from groundset.functions import columns as C
from groundset.operators import text


def test_word_bounds_are_those_of_ascii_words(spark):
    df = spark.createDataFrame([("nationñ",), ("nation",), ("nation_x",), ("ñthe é",), ("other",), (r"a\b",)], "text string")
    got = text.taxonomy(df, "text", [("beta", r"tion\b"), ("alpha", r"\bthe\b"), ("slash", r"\\b")]).collect()
    assert [r.named for r in got] == [["beta"], ["beta"], [], ["alpha"], [], ["slash"]]
    assert [r.t for r in df.select(text.generalized(F.col("text"), [(r"\bthe\b", "a")]).alias("t")).collect()] == ["nationñ", "nation", "nation_x", "ña é", "other", r"a\b"]
    assert C.ascii_bounds(r"\\b[0-9]") == r"\\b[0-9]"


def test_blocks_of_word_sets_give_the_pairs_of_all_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(text, "BLOCK_TEXTS", 16)
    monkeypatch.setattr(text, "BLOCK_ROWS", 7)
    monkeypatch.setattr(text, "BLOCK_WORDS", 1 << 8)
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("the of and a in".split() + [f"w{k}" for k in range(60)]) for _ in range(rng.choice((1, 2, 5, 9, 30, 70)))) for i in range(150)} | {900: "", 901: "the", 902: "the"}
    sets = {i: set(x.split()) for i, x in texts.items()}
    for least in (0.15, 0.5, 1.0):
        want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        df = spark.createDataFrame(list(texts.items()), "id long, text string")
        sized = df.select("id", F.array_distinct(C.tokens(F.col("text"))).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
        got = text._by_blocks(sized, least).collect()
        assert {(r.a, r.b, round(r.jaccard, 6)) for r in got} == want and len(got) == len(want) > 0
        assert {tuple(r) for r in text.jaccard_pairs(df, "id", least=least).collect()} == want


def test_search_takes_memory_of_a_slice_and_not_of_a_block():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from groundset.operators import retrieve

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(1024, 8))
    rows = np.full(1024, 10)
    asked = pd.DataFrame({"key": np.arange(1_500), "vec": list(rng.normal(size=(1_500, 8)).astype(np.float32)), "value": 0, "least": -1e9})
    tracemalloc.start()
    n = sum(len(x) for x in retrieve._wanted_cells(centres, np.ones(1024), rows, 20, True)(iter([asked])))
    near = pd.concat(retrieve._nearest(centres)(iter([asked])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == 1_500 * 1022 and len(near) == 1_500
    assert peak < 40
    assert [s.stop - s.start for s in retrieve._slices(1000, retrieve.PRODUCTS // 300)] == [300, 300, 300, 100]


def test_packed_batches_read_like_files_of_their_own(spark, tmp_path):
    from groundset.sources import records

    texts = ['{"items": [{"k": 1}, {"k": 2}]}', '{"items": [{"k": 3}', '{"other": 1}', '{"items": []}', "no json", '{"items": [{"k": "x"}]}', '{"items": 5}', '{\n"items": [{"k": 7}]\n}']
    for i, x in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(x)
    records.write_batches(spark.createDataFrame([*enumerate(texts), (8, ""), (9, None)], "i int, t string"), str(tmp_path / "packed"), F.concat(F.lit("/"), "i", F.lit(".json")), F.col("t"))
    name = F.regexp_extract("batch_file", "/([0-9]+).json$", 1).cast("int").alias("i")
    own = {tuple(r) for r in records.read_batches(spark, str(tmp_path / "*.json"), "k int").select(name, "bad", "pos", "k").collect()}
    packed = {tuple(r) for r in records.read_batches(spark, str(tmp_path / "packed"), "k int", packed=True).select(name, "bad", "pos", "k").collect()}
    assert packed == own | {(8, True, None, None), (9, True, None, None)} and len(own) >= len(texts)


def test_bootstrap_draws_are_dealt_by_their_number(spark, monkeypatch, capsys):
    from groundset.operators import stats

    df = spark.range(400).select((F.col("id") % 90).alias("c"), (F.col("id") % 7).cast("double").alias("v"))
    whole = stats.cluster_bootstrap(df, "c", "v", reps=50).first()
    monkeypatch.setattr(stats, "DRAWS", 1000)
    split = stats.cluster_bootstrap(df, "c", "v", reps=50)
    assert split.first() == whole
    split.explain()
    assert "hashpartitioning(slot" in capsys.readouterr().out.replace("#", " #").replace("( ", "(")


def test_phrases_with_common_beginnings_stand_once(spark):
    phrases = ["the end", "the enemy", "the", "a\\Eb", "a\\Ec", "a\\", "x.y", "x*", "\U0001f600\U0001f601", "\U0001f600\U0001f602", "zzz\\"]
    texts = ["THE endless", "th e", "a\\eb", "A\\ec", "a\\", "xzy", "x.y", "xx*", "\U0001f600\U0001f602!", "\U0001f600 \U0001f602", "zzz", "zzz\\E", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r.hit for r in text.holds_phrase(df, spark.createDataFrame([(p,) for p in phrases], "p string"), "t", "p", "hit").select("hit").collect()]
    assert got == [x is not None and any(p.lower() in x.lower() for p in phrases) for x in texts]
    assert text._any_of(["alike", "alive", "alive too", "b"]) == "(?:\\Qali\\E(?:\\Qke\\E|\\Qve\\E)|\\Qb\\E)"


def _two_sources(spark):
    import random

    rng = random.Random(5)
    box = lambda f, i: (f % 7, rng.choice(["a", "b", None]), i, *(lambda x, y: (x, y, x + 1.0, y + 1.0))(rng.choice([0.0, 0.2, 0.4]), rng.choice([0.0, 0.1])))
    make = lambda n: spark.createDataFrame([box(i, i) for i in range(n)] + [(9, "only", 0, 0.0, 0.0, 0.0, 0.0)] * (n % 2), "frame long, label string, idx long, x0 double, y0 double, x1 double, y1 double")
    return make(61), make(50)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_agreement_matches_boxes_once_and_rates_only_count_them(spark, monkeypatch):
    from groundset.operators import geometry

    a, b = _two_sources(spark)
    for most in (1 << 12, 3):
        monkeypatch.setattr(geometry, "ROW_PAIRS", most)
        found = geometry.agreement(a, b, "frame", "label")
        assert "collect_list" not in _plan(found)
        rates = geometry.match_rates(a, b, "frame", "label")
        assert "anti" not in _plan(rates).lower()
        want = sorted(map(str, geometry.agreement_rates(found, ["label"]).collect()))
        assert sorted(str(r) for r in rates.select("label", "n_matched", "a_only", "b_only", "rate_a", "rate_b").collect()) == want and len(want) == 4
        if most > 3:
            whole = sorted(map(str, found.collect()))
        assert sorted(map(str, found.collect())) == whole


def test_best_containment_takes_one_join_of_bounded_tasks(spark, monkeypatch):
    from groundset.operators import geometry

    monkeypatch.setattr(geometry, "TASK_BOXES", 10)
    a, b = _two_sources(spark)
    best = geometry.best_inside(a, b, ["frame", "label"])
    assert _plan(best).count("SortMergeJoin") == 1 and ", 12), REPARTITION_BY_NUM" in _plan(best)
    area = lambda x0, y0, x1, y1: max(x1 - x0, 0.0) * max(y1 - y0, 0.0)
    want = set()
    for p in a.collect():
        met = [q for q in b.collect() if q.frame == p.frame and q.label == p.label is not None]
        inside = [area(max(p.x0, q.x0), max(p.y0, q.y0), min(p.x1, q.x1), min(p.y1, q.y1)) / area(p.x0, p.y0, p.x1, p.y1) if area(p.x0, p.y0, p.x1, p.y1) else 0.0 for q in met]
        want.add((p.frame, p.idx, round(max(inside), 6) if inside else None))
    assert {(r.frame, r.idx, None if r.best is None else round(r.best, 6)) for r in best.collect()} == want


def test_rows_of_a_frequent_key_stay_in_their_tasks(spark, monkeypatch):
    from groundset.operators import sample

    monkeypatch.setattr(sample, "HOT", 25)
    rows = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") < 300, "hot").when(F.col("id") < 390, F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("key"))
    known = rows.where("key != 'k3'").groupBy("key").agg(F.count("*").alias("_rows"), F.max("id").alias("last"))
    for how, n in (("inner", 300 + 68), ("left", 400)):
        got = sample.told_of(rows, known, "key", how).withColumn("at", F.spark_partition_id()).collect()
        assert len(got) == n and len({r.at for r in got if r.key == "hot"}) >= 3
        assert {r.last for r in got if r.key == "hot"} == {299} and all(r.last is None for r in got if r.key in (None, "k3"))
    records = spark.createDataFrame([(i, f"c{i % 3}" if i % 11 else None, f"f{i % 4}", f"w{i} x{i * 7 % 50} y{i % 13} common") for i in range(60)], "id long, concept string, facet string, answer string")
    split = sorted(map(str, sample.distractors(records, "id", True, most=100).collect()))
    monkeypatch.setattr(sample, "HOT", 1 << 16)
    assert sorted(map(str, sample.distractors(records, "id", True, most=100).collect())) == split


def test_packets_meet_only_pairs_that_share_a_gram(spark):
    answers = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d"), (3, "a")], "item long, text string")
    passages = spark.createDataFrame([(10, "x a b c d"), (11, "b c d e a b c d"), (12, "z z z z")], "doc long, text string")
    packets = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 12), (3, 10)], "item long, doc long")
    got = text.packet_containment(answers, packets, passages, "item", "doc")
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}
    joins = [line for line in _plan(got).splitlines() if "SortMergeJoin" in line]
    assert not any("doc" in line and "gram" in line for line in joins) and any("LeftSemi" in line for line in joins)


def test_quotes_are_looked_for_where_documents_are_read(spark, monkeypatch):
    import random
    import re

    from groundset.operators import ground

    rng = random.Random(5)
    monkeypatch.setattr(ground, "SLICE", 64, raising=False)
    words = ["the", "of", "Мир", "東京", "\U0001f600", "a.b", "(c)", "\\E", "é\u00a0x", "longer", "w" * 40]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", ""]) for _ in range(n))
    docs = [(i, text(rng.choice((1, 5, 40, 200)))) for i in range(30)] + [((1 << 53) + 1, text(60)), (None, text(60)), (31, None), (32, " \n"), (5, text(50))]
    said = [(i, t[at : at + n]) for i, (_, t) in enumerate(docs) if t for n in (1, 3, 5, 7, 20, 40, 300) for at in [rng.randrange(len(t))]]
    said += [(1000 + i, re.sub(r"[ \n\t]+", lambda m: rng.choice(["  ", "\r\n"]), q)) for i, q in said] + [(7, "the"), (7, "\n"), (8, " "), (9, None), (None, "of"), (3000, "absent text")]

    def find(t, q):
        if (at := t.find(q)) >= 0:
            return q, at, at + len(q)
        m = re.search(r"[ \t-\r]+".join(map(re.escape, [w for w in re.split(r"[ \t-\r]+", q) if w])), t)
        return m and (m[0], *m.span())

    want = sorted((i, d, *f) for i, q in said if i is not None and q and q.strip(" \t\n\x0b\x0c\r") for d, t in docs if d is not None and t and (f := find(t, q)))
    asked = spark.createDataFrame(said, "q long, text string")
    held = spark.createDataFrame(docs, "d long, text string").coalesce(1)
    got = ground.locate(asked, held, "q", "d")
    assert "Exchange" not in _plan(got) and sorted(map(tuple, got.collect())) == want
    assert {(1 << 53) + 1, 5} <= {d for _, d, *_ in want} and {1000 <= i < 2000 and f != dict(said)[i] for i, _, f, *_ in want} == {True, False}
    # too many to be broadcast: their grams are, then neither
    monkeypatch.setattr(ground, "BROADCAST_QUOTES", 0)
    assert sorted(map(tuple, ground.locate(asked, held, "q", "d").collect())) == want
    monkeypatch.setattr(ground, "BROADCAST_ANCHORS", 0)
    assert sorted(map(tuple, ground.locate(asked, held, "q", "d").collect())) == want
