"""Cases of the fourth round's findings."""

import random

import numpy as np
from pyspark.sql import functions as F

from groundset.functions import columns as C
from groundset.operators import text


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _sets(spark, texts, kind="string"):
    return spark.createDataFrame(texts, f"id {kind}, text string").select("id", F.array_distinct(C.tokens(F.col("text"))).alias("w")).withColumn("n", F.size("w"))


def test_blocks_of_word_sets_are_not_copied_for_each_pair(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(text, "BLOCK_TEXTS", 24)
    texts = [(f"t{i}", " ".join(rng.choice("the of and a in".split() + [f"w{k}" for k in range(40)]) for _ in range(rng.choice((1, 3, 9, 25))))) for i in range(90)]
    texts += [("t5", "the of and a"), ("t5", "the of and a in w1 w2 w3"), ("t6", texts[6][1]), ("t6", texts[6][1]), (None, "the of")]  # an id with sets of several sizes, and with equal rows
    sets = [(i, set(x.split())) for i, x in texts]
    want = sorted((a, b, round(len(x & y) / len(x | y), 6)) for a, x in sets for b, y in sets if a and b and a < b and len(x & y) / len(x | y) >= 0.15)
    got = text._by_blocks(_sets(spark, texts), 0.15)
    assert "Exchange" not in _plan(got) and "CartesianProduct" in _plan(got)
    assert sorted((r.a, r.b, round(r.jaccard, 6)) for r in got.collect()) == want and len(want) > 500


def test_words_are_counted_by_products_and_by_lists_alike(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(text, "BLOCK_ROWS", 7)
    make = lambda n: [rng.choice(60, size=k, replace=False, p=np.arange(60, 0, -1) / 1830).astype(np.int64) * (1 << 57) for k in rng.integers(1, 25, n)]
    a, b = make(40), make(33)
    given = [x for side in (a, b) for x in (np.array([len(w) for w in side]), np.concatenate(side))]
    j = np.array([[len({*x} & {*y}) / len({*x} | {*y}) for y in b] for x in a])
    for dense, places in ((1, 1 << 21), (1, 5), (6, 50), (1 << 20, 5)):
        monkeypatch.setattr(text, "DENSE", dense)
        monkeypatch.setattr(text, "PLACES", places)
        got = np.zeros(j.shape)
        for row, column, value in text._near_pairs(0.15, *given):
            got[row, column] = value
        assert (got == np.where(j >= 0.15, j, 0)).all() and (got > 0).sum() > 300


def test_words_whose_hashes_meet_get_another_seed(spark, monkeypatch):
    seen = []

    def narrow(seed, word, whole=F.xxhash64):
        seen.append(seed)
        return whole(seed, word) % (2 if len(seen) == 1 else 1 << 40)

    monkeypatch.setattr(text.F, "xxhash64", narrow)
    numbers = text._word_numbers(_sets(spark, [(1, "a b c d e"), (2, "c d f")], "long"))
    assert len(seen) == 3 and spark.range(1).select(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("w")).select(F.size(F.array_distinct(numbers))).first()[0] == 3


def _embeddings(spark, folder, rows, files=3):
    """A folder of given tables that has only `embeddings`, and DuckDB over it."""
    import duckdb

    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(files).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return con


def test_anchored_packets_look_for_sources_among_all_passages(spark, tmp_path, monkeypatch):
    from compare import differences
    from groundset.operators import retrieve
    from groundset.plans import registry

    rng = np.random.default_rng(8)
    axis = np.eye(8)[0]
    for case, sources in enumerate((9, 5, 1)):
        # the first source fills more than sixty places before any other; small whole numbers, so that there are ties
        rows = [(i, [float(x) for x in np.rint(6 * (axis if i < 150 or i % 20 == 0 else -axis) + rng.normal(size=8))], 0 if i < 150 else int(rng.integers(sources))) for i in range(400)]
        con = _embeddings(spark, tmp_path / str(case), rows)
        for block, asked in ((16_384, 1024), (40, 7)):
            monkeypatch.setattr(retrieve, "CORPUS_BLOCK", block)
            monkeypatch.setattr(retrieve, "QUERY_BLOCK", asked)
            got = registry.queries()["anchored_topk"](spark, str(tmp_path / str(case)))
            assert differences(got, con, registry.oracle_sql()["anchored_topk"]) == ""
        found = got.where("query_id < 150").groupBy("query_id").agg(F.countDistinct("label").alias("n")).collect()
        assert {r.n for r in found} == {min(sources, 6)} and len(found) == 8


def test_pages_with_an_article_count_by_the_text_around_it(spark):
    from groundset.llm import html_text

    menu, notice, said, other = (" ".join(f"{name}{i}" for i in range(11)) for name in ("menu", "notice", "said", "other"))
    marked = lambda k, head: f"<body><div>{head}</div><article><p>{said} article {k}</p></article></body>"
    rows = [(1, "http://www.h.org/1", f"<body><div>{menu}</div><p>own words {said}</p><div>{notice}</div></body>"), (2, "http://h.org/2", marked(2, menu)), (3, "http://h.org/3", marked(3, f"{menu} {notice}"))]
    rows += [(4, "http://h.org/4", marked(3, f"{menu} {notice}"))]  # a copy of page 3: `notice` is on two pages
    rows += [(10 + i, "http://g.org/", marked(i, other)) for i in range(4)] + [(20, "http://f.org/", f"<p>{other}</p>"), (21, "http://h.org/", f"<p>{other}</p>"), (22, "http://h.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_text.extract_main_text(df).collect()}
    assert got == {1: f"own words {said} {notice}", 2: f"{said} article 2", 3: f"{said} article 3", 4: f"{said} article 3"} | {10 + i: f"{said} article {i}" for i in range(4)} | {20: other, 21: other, 22: ""}


def test_pages_beside_count_as_in_the_suffix_array_of_the_host(spark, monkeypatch):
    from groundset.llm import html_text

    rng = random.Random(9)
    parts = [" ".join(rng.choices("abcdefgh", k=rng.choice((6, 9, 14, 30)))) for _ in range(14)]
    texts = sorted({" ".join(rng.choice(parts) if rng.random() < 0.5 else f"own{i}x{k}" for k in range(7)) for i in range(90)})
    pages = [(i, "h", t) for i, t in enumerate(texts)]
    want = {i: set(np.flatnonzero(b)) for (i, _, t), b in zip(pages, html_text.shared_runs([t.split(" ") for t in texts], list(range(len(texts))))) if i < 10}
    make = lambda rows: spark.createDataFrame(rows, "_page long, _host string, open string").repartition(3)
    for shard, group in ((4_000, 4_000), (5, 2)):
        monkeypatch.setattr(html_text, "SHARD", shard)
        monkeypatch.setattr(html_text, "GROUP", group)
        alone = {r._page: set(r.starts) for r in html_text.repeated_starts(make(pages[:10])).collect()}
        got = {r._page: set(r.starts) for r in html_text.repeated_starts(make(pages[:10]), make(pages[10:] + pages[10:40] + [(500, "g", texts[0])])).collect()}
        assert got == {i: s for i, s in want.items() if s} != alone


def test_bound_below_the_rows_of_early_words(spark, monkeypatch):
    rng = random.Random(11)
    for least in (0.15, 0.4, 0.9):
        texts = [(i, " ".join(rng.choice("the of and a in".split() + [f"w{k}" for k in range(50)]) for _ in range(rng.choice((2, 6, 20))))) for i in range(60)]
        sets = _sets(spark, texts, "long")
        held = sets.select("id", F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("texts"))
        n = {r.word: r.texts for r in held.collect()}
        early = [w for r in sets.collect() for w in sorted(r.w, key=lambda w: (n[w], w))[: r.n - int(np.ceil(least * r.n - 1e-9)) + 1]]
        met = sum(early.count(w) ** 2 for w in set(early))
        assert 0.2 * met < text._fewest_met(sets, held, least) <= met
    assert text._fewest_met(sets.limit(0), held.limit(0), 0.5) == 0
    # where the bound is enough, texts are not put together again from their words
    seen = []
    monkeypatch.setattr(text.F, "collect_list", lambda *a, whole=F.collect_list: seen.append(a) or whole(*a))
    monkeypatch.setattr(text, "_by_blocks", lambda sets, least: spark.createDataFrame([], "a long, b long, jaccard double"))
    text.jaccard_pairs(spark.createDataFrame([(i, "the of and a in to") for i in range(20)], "id long, text string"), "id", least=0.15)
    assert not seen
