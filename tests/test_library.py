"""Edge rows of the library's own operators."""

from pyspark.sql import functions as F

from groundset.functions import columns as C
from groundset.operators import audit, geometry, ground, sample, stats, text
from groundset.sources import records
from groundset.streaming import incremental


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_spans_snap_exactly_then_by_white_space(spark):
    rows = [("a b c a b", "a b"), ("x a\n  b y", "a b"), ("no", "a b"), ("a+b [c]  (d)", "a+b [c] (d)"), ("say \\E it", "say \\E  it"), ("\U0001f600 hit", "hit"), ("x", ""), (None, "a"), ("x", None)]
    got = ground.snap(spark.createDataFrame(rows, "text string, quote string"), "text", "quote").collect()
    assert [(r.found, r.char_start, r.char_end) for r in got] == [("a b", 0, 3), ("a\n  b", 2, 7), (None, None, None), ("a+b [c]  (d)", 0, 12), ("say \\E it", 0, 9), ("hit", 2, 5), (None, None, None), (None, None, None), (None, None, None)]


def test_mismatches_hold_wrong_null_and_unknown_citations(spark):
    cited = spark.createDataFrame([(1, 0, 3, "abc"), (2, 0, 3, "abd"), (3, None, 3, "abc"), (4, 2, 9, "c"), (9, 0, 1, "a")], "k long, char_start long, char_end long, answer string")
    chunks = spark.createDataFrame([(i, "abc") for i in range(1, 5)], "k long, text string")
    assert {r.k for r in ground.mismatches(cited, chunks, "k").collect()} == {2, 3, 9}


def test_wilson_mcnemar_and_ac1_edges(spark):
    low, high = C.wilson(F.lit(0), F.lit(0))
    assert tuple(one(spark, a=low, b=high)) == (None, None)
    p = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (10, 2), (1000, 1000)], "b long, c long").select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert [r.p for r in p] == [1.0, 1.0, 1.0, 0.038574, 1.0]
    same = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "x")], "item long, label string")
    assert stats.ac1(same, "item", "label").first().ac1 == 1.0


def test_length_bands_round_half_to_even(spark):
    got = spark.createDataFrame([(1,), (5,), (6,), (10,), (25,)], "n int").select(*C.length_band(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(1, 6), (1, 10), (1, 11), (5, 15), (20, 31)]


def test_windows_of_short_and_long_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.9), (2, 0.0, 60.0), (3, 0.0, 60.1), (4, 0.0, 61.0), (5, 0.0, 90.5)], "i long, a double, b double")
    got = geometry.force_windows(rows, "a", "b").orderBy("i", "window").collect()
    assert [(r.i, r.w_start, r.w_end, r.was_long) for r in got] == [(2, 0, 60, False), (3, 0, 30, True), (3, 30, 60, True), (4, 0, 30, True), (4, 30, 60, True), (4, 60, 61, True), (5, 0, 30, True), (5, 30, 60, True), (5, 60, 90, True)]


def test_greedy_matches_are_one_to_one(spark):
    schema = "frame long, label string, idx long, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, "x", 0, 0.0, 0.0, 1.0, 1.0), (1, "x", 1, 0.0, 0.0, 1.0, 0.9), (1, "y", 2, 0.0, 0.0, 0.0, 0.0)], schema)
    b = spark.createDataFrame([(1, "x", 0, 0.0, 0.0, 1.0, 1.0), (1, "x", 1, 0.0, 0.0, 1.0, 0.8), (1, "y", 2, 0.0, 0.0, 0.0, 0.0)], schema)
    assert sorted((r.a_idx, r.b_idx) for r in geometry.greedy_matches(a, b, "frame", "label").collect()) == [(0, 0), (1, 1)]


def test_consensus_of_ties_and_nones(spark):
    votes = spark.createDataFrame([(1, "none")] * 3 + [(2, v) for v in "aaabbb"] + [(3, v) for v in "aaab"], "item long, vote string")
    got = {r.item: r.winner for r in audit.consensus(votes, "item", "vote", 6, strict=False).collect()}
    assert got == {1: "none", 2: "a", 3: "a"}


def test_chunks_of_edge_documents(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "Head\nbody one\nHead\nHead\nlast"), (4, "w " * 400)], "doc_id long, text string")
    got = text.chunk_documents(docs, "doc_id", lambda line: text.heading(line, ["^Head$"], []), budget=100).collect()
    assert sorted((r.doc_id, r.section, r.chunk_idx, r.text[:8]) for r in got) == [(3, "Head", 0, "body one"), (3, "Head", 1, "last"), (4, "root", 0, "w w w w ")]


def test_replies_are_read_tolerantly(spark):
    replies = ['x {"k": 1} y', '{"k": 9} </think> {"k": 2}', '{"k": {"a": 1}', "none", '[{"k": 3}]', None]
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(records.reply_json(F.col("r"), "k int")["k"].alias("k")).collect()
    assert [r.k for r in got] == [1, 2, None, None, 3, None]


def test_latest_rows_of_a_stream(spark, tmp_path):
    schema = "k long, at long, v string"
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.latest_stream(incremental.batch_stream(spark, str(tmp_path / "in"), schema), ["k"], ["at"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {(r.k, r.v) for r in spark.table("latest").collect()} == {(1, "c"), (2, "x")}
    finally:
        q.stop()


def test_survival_is_greedy_by_label_then_by_any(spark):
    """Against a plain loop over proposals in order."""
    import random

    random.seed(3)
    box = lambda: [(x := random.random() * 0.3), (y := random.random() * 0.3), x + 0.5, y + 0.5]
    rows = lambda n: [(f, random.choice("AB"), i, *box()) for f in range(30) for i in range(n)]
    a, b = rows(4), rows(3)
    schema = "frame int, label string, idx int, x0 double, y0 double, x1 double, y1 double"

    def iou(p, q):
        w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
        i = max(w, 0) * max(h, 0)
        return i / (0.5 - i)

    want, used = {}, set()
    for p in a:
        free = [q for q in b if q[0] == p[0] and (q[0], q[2]) not in used and iou(p, q) >= 0.5]
        for fate, own in (("kept", [q for q in free if q[1] == p[1]]), ("relabelled", [q for q in free if q[1] != p[1]])):
            if own:
                used.add((p[0], max(own, key=lambda q: (iou(p, q), q[2]))[2]))
                want[p[0], p[2]] = fate
                break
        else:
            want[p[0], p[2]] = "deleted"
    fates = geometry.survival(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "frame", "label")
    assert {(r.frame, r.idx): r.fate for r in fates.collect()} == want and set(want.values()) == {"kept", "relabelled", "deleted"}
    report = {r.label: r for r in geometry.survival_report(fates, "label").collect()}
    assert report[None].n == 120 and report[None].n_kept == sum(r.n_kept for k, r in report.items() if k)


def test_distractors_are_apart_and_in_order(spark):
    """Options are the answer and three others, unlike it and one another; easy ones of as many other concepts, hard ones of the own one where it has enough."""
    words = [f"w{i:02d}" for i in range(60)]
    rows = [(i, f"c{i % 5}", f"f{i % 7}", " ".join(words[(i * 7 + j * j) % 60] for j in range(6))) for i in range(140)]
    df = spark.createDataFrame(rows, "item int, concept string, facet string, answer string")
    by_answer = {}
    for _, c, f, t in rows:
        by_answer.setdefault(t, set()).add((c, f))
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    for hard in (False, True):
        got = sample.distractors(df, "item", hard).collect()
        assert len(got) == 140
        for r in got:
            _, concept, facet, gold = rows[r.item]
            others = [o for o in r.options if o != gold]
            assert len(others) == 3 and r.options[r.gold_position] == gold and all(jac(x, y) <= 0.6 for i, x in enumerate(r.options) for y in r.options[:i])
            if not hard:
                assert all(any(c != concept for c, _ in by_answer[o]) for o in others)
            elif not r.fell_back:
                assert all(any(c == concept and f != facet for c, f in by_answer[o]) for o in others)
        assert any(not r.fell_back for r in got) == hard
        assert len({r.gold_position for r in got}) == 4
    assert sample.distractors(df.limit(0), "item", True).count() == 0


def test_greedy_hamming_against_a_loop(spark):
    import random

    random.seed(5)
    rows = [(i % 3, i, random.getrandbits(62) if i % 4 else 7 << (i % 9)) for i in range(300)]
    want = []
    for g in range(3):
        kept = []
        for _, i, code in (r for r in rows if r[0] == g):
            if len(kept) < 6 and all((code ^ c).bit_count() > 20 for _, c in kept):
                kept.append((i, code))
        want += [(g, i) for i, _ in kept]
    df = spark.createDataFrame(rows, "g int, i int, code long")
    assert sorted(map(tuple, geometry.greedy_hamming(df, "g", "code", ["i"], radius=20).collect())) == sorted(want)


def test_sentence_windows_against_a_loop(spark):
    texts = ["One two three. Four five; six seven eight nine. " * 9, "single", "a b c. " + "x " * 30 + ". d e. f."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    pieces = {r.id: r.p for r in df.select("id", C.split_claims(F.col("text"), 1).alias("p")).collect()}
    want = []
    for i, p in pieces.items():
        at, total, windows = 0, 0, {}
        for n in (len(x.split()) for x in p):
            if total and total + n > 12:
                at, total = at + 1, 0
            total += n
            windows.setdefault(at, []).append(n)
        want += [(i, sum(w), len(w)) for w in windows.values()]
    assert sorted((r.id, r.n_words, r.n_sentences) for r in text.sentence_windows(df, "id", words=12).collect()) == sorted(want)


def test_quotes_of_any_script_are_located_wherever_they_begin(spark):
    import random

    random.seed(2)
    text = "Привет мир, plain words\nand 東京都 more of it; it's 100 % \U0001f600 done."
    rows = [(1, text), (2, " ".join(random.choices(["mir", "мир", "plain", "東京", "it's", "x" * 40], k=300))), (3, None), (4, ""), (5, "".join(random.choices("ab東 ", k=3000))), (5, "twice " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    said = ["Привет мир", "plain words", "lain wor", "東京都", "ривет", "it;  it's\n100", "😀", "%", "words and", "", "  ", None, "absent", "b東", "d 東京都 more of it; it's 100 % 😀 done"]
    said += [r[1][at : at + n] for r in rows if r[1] for n in (1, 2, 4, 9, 31, 32, 33, 80) for at in random.sample(range(max(1, len(r[1]) - n)), min(6, max(1, len(r[1]) - n)))]
    quotes = spark.createDataFrame(list(enumerate(said)), "quote_id long, text string")
    got = {(r.quote_id, r.doc_id, r.char_start, r.char_end) for r in ground.locate(quotes, docs, "quote_id", "doc_id").collect()}

    def find(t, q):
        import re

        at = t.find(q)
        if at >= 0:
            return at, at + len(q)
        m = re.search(r"[ \t-\r]+".join(map(re.escape, q.split())), t)
        return m and m.span()

    want = {(i, d, *found) for i, q in enumerate(said) if q and q.strip() for d, t in rows if t and (found := find(t, q))}
    assert got == want and {i for i, *_ in got} >= {0, 1, 2, 3, 4, 5, 6, 7, 8}
    assert ground.locate(quotes, docs.limit(0), "quote_id", "doc_id").count() == 0 and ground.locate(quotes.limit(0), docs, "quote_id", "doc_id").count() == 0
    # more quotes than may be broadcast
    ground.BROADCAST_ANCHORS, before = 3, ground.BROADCAST_ANCHORS
    try:
        assert {(r.quote_id, r.doc_id, r.char_start, r.char_end) for r in ground.locate(quotes, docs, "quote_id", "doc_id").collect()} == want
    finally:
        ground.BROADCAST_ANCHORS = before


def test_parts_are_snapped_dropped_and_counted(spark):
    parts = spark.createDataFrame([(1, 0, "mcq", "q", "pick", None), (1, 1, "doctrine", "q", "b  c", 7), (1, 2, "reasoning", "q", "nowhere", 7), (2, 0, "mcq", "q", "", None), (2, 1, "doctrine", "q", "b c", 8), (2, 2, "reasoning", "q", None, 7)], "item long, nr int, kind string, question string, quote string, cited long")
    sources = spark.createDataFrame([(7, "a b\nc d"), (9, None)], "doc_id long, text string")
    out = ground.assemble(parts, sources, "item", "nr", "kind", "question", "quote", "cited", "doc_id")
    got = {r.qid: (r.answer, r.char_start, r.char_end, r.kept) for r in out.collect()}
    assert got == {"1#0": ("pick", None, None, True), "1#1": ("b\nc", 2, 5, True), "1#2": (None, None, None, False), "2#0": ("", None, None, False), "2#1": (None, None, None, False), "2#2": (None, None, None, False)}
    report = {r.kind: (r.n_items, r.n_parts, r.n_kept, r.n_dropped, r.n_bad) for r in ground.assembly_report(out, sources, "item", "kind", "cited", "doc_id").collect()}
    assert report == {"mcq": (2, 2, 1, 1, 0), "doctrine": (2, 2, 1, 1, 0), "reasoning": (2, 2, 0, 2, 0)}


def test_chunks_of_one_document_of_many_lines_against_a_loop(spark):
    import random
    import time

    random.seed(6)
    lines = [random.choice(("Head", "x" * random.randrange(60), "", "word " * random.randrange(90))) if i % 7 else "a b c" for i in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "Head\nHead\n"), (3, None)], "doc_id long, text string")
    want, name, held, size = [], "root", [], 0

    def close():
        body = " ".join(" ".join(held).split())
        if body:
            want.append((name, body))

    for line in lines:
        weight = max(1, len(line) // 4)
        if line == "Head":
            close()
            name, held, size = line, [], 0
        elif size and size + weight > 100:
            close()
            held, size = [line], weight
        else:
            held, size = [*held, line] if len(held) < 50 else held + [line], size + weight
    close()
    began = time.time()
    got = text.chunk_documents(docs, "doc_id", lambda line: text.heading(line, ["^Head$"], []), budget=100).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.section, r.text) for r in got] == want and [r.chunk_idx for r in got] == list(range(len(want))) and time.time() - began < 60


def test_jaccard_join_against_all_pairs(spark):
    import random

    random.seed(8)
    rows = [(i, " ".join({"every", *random.choices([f"w{n}" for n in range(40)], k=random.randrange(12))})) for i in range(150)] + [(200, ""), (201, None), (202, "every"), (203, "every")]
    sets = {i: set((t or "").split()) for i, t in rows}
    for least in (0.2, 0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in text.jaccard_pairs(spark.createDataFrame(rows, "id long, text string"), "id", least=least).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pruned_search_equals_all_products(spark):
    """Many cells, bans, equal scores, a value that must differ, fewer rows than k; clustered vectors let most cells be skipped."""
    import numpy as np

    from groundset.operators import retrieve

    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 6)) * 8
    x = np.round(middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)), 2)
    x[10:14] = x[10]
    corpus = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(950, None, 0)], "doc long, vec array<double>, lot int").repartition(5)
    queries = spark.createDataFrame([(i, (x[i] / 2).tolist(), i % 3) for i in range(0, 900, 17)] + [(997, None, 0)], "q long, vec array<double>, lot int")
    banned = spark.createDataFrame([(17 * i, d) for i in range(0, 50, 2) for d in range(i, 900, 5)] + [(17, d) for d in range(897)], "q long, doc long")
    before = retrieve.QUERY_BLOCK, retrieve.CORPUS_BLOCK
    retrieve.QUERY_BLOCK, retrieve.CORPUS_BLOCK = 16, 40
    try:
        for differ, bans, k in ((None, None, 7), ("lot", None, 5), (None, banned, 6), ("lot", banned, 400)):
            got = {(r.q, r.doc, r.rank): r.score for r in retrieve.knn(queries, corpus, "q", "doc", "vec", k, differ=differ, banned=bans).collect()}
            no = {(r.q, r.doc) for r in bans.collect()} if bans else set()
            want = {}
            for i in range(0, 900, 17):
                scores = sorted((-float(x[i] / 2 @ x[d]), d) for d in range(900) if (not differ or d % 3 != i % 3) and (i, d) not in no)[:k]
                want |= {(i, d, at + 1): -s for at, (s, d) in enumerate(scores)}
            # equal scores may differ in the last digit by the order of sums, so ranks are compared by score
            assert {(i, at) for i, _, at in got} == {(i, at) for i, _, at in want}
            a, b = ({(i, at): s for (i, _, at), s in found.items()} for found in (got, want))
            assert all(abs(a[key] - b[key]) < 1e-9 for key in a)
        centres = retrieve._centres(corpus.where("vec IS NOT NULL").withColumnRenamed("doc", "key"), 900)
        assert len(centres) == 23
        near = next(retrieve._nearest(centres)(iter([corpus.where("vec IS NOT NULL").toPandas()])))
        radius, held = np.zeros(23), np.zeros(23, int)
        for cell, far in zip(near["cell"], near["far"]):
            radius[cell], held[cell] = max(radius[cell], far), held[cell] + 1
        asked = queries.where("vec IS NOT NULL").toPandas()
        least = [sorted((x[i] / 2 @ x.T), reverse=True)[6] for i in asked["q"]]
        first = next(retrieve._wanted_cells(centres, radius, held, 7, False)(iter([asked.assign(least=0.0)])))
        second = next(retrieve._wanted_cells(centres, radius, held, 7, True)(iter([asked.assign(least=least)])))
        assert len(first) + len(second) < 0.5 * len(asked) * (held > 0).sum()  # over half of the pairs of query and cell are skipped
    finally:
        retrieve.QUERY_BLOCK, retrieve.CORPUS_BLOCK = before


def test_matching_in_rounds_is_the_serial_one(spark):
    import random

    random.seed(12)
    rows = [(g, a, b, random.randrange(4)) for g in range(6) for a in range(25) for b in range(20) if random.random() < 0.3]
    pairs = spark.createDataFrame(rows, "g long, a_idx long, b_idx long, cost long")
    want = set()
    for g in range(6):
        free = set(range(20))
        for a in range(25):
            best = min(((c, b) for x, y, b, c in rows if (x, y) == (g, a) and b in free), default=None)
            if best:
                free.remove(best[1])
                want.add((g, a, best[1]))
    before = geometry.ROW_PAIRS
    try:
        for geometry.ROW_PAIRS in (10_000, 150, 0):  # in rows, some groups in rounds, all of them
            assert {(r.g, r.a_idx, r.b_idx) for r in geometry.one_to_one(pairs, ["g"], F.col("cost")).collect()} == want
    finally:
        geometry.ROW_PAIRS = before


def test_distractors_equal_a_search_of_all_answers(spark):
    """600 near-equal answers and a few distinct ones; concepts with too few facets; pools larger than the first look."""
    import hashlib

    words = [f"w{i:02d}" for i in range(90)]
    rows = [(i, f"c{i % 3}", f"f{i % 2}", f"all these words are the same in every answer but {i}") for i in range(600)]
    rows += [(600 + i, f"c{i % 9}", f"f{i % 4}", " ".join(words[i * 9 : i * 9 + 8])) for i in range(9)]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    md5 = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)

    def ring(salt, pool, item):
        stand = sorted({(md5(salt + t), t, c, f) for _, c, f, t in rows if pool is None or pool(c, f)})
        start = md5(f"{salt}{item}") % len(stand)
        return [x[1:] for x in stand[start:] + stand[:start]]

    for hard in (False, True):
        want = {}
        for item, concept, facet, gold in rows:
            stages = [(3, lambda c, f: f == facet), (4, None)]
            if hard:
                stages = [(1, lambda c, f: c == concept), (2, lambda c, f: c == concept), *stages]
            kept, tags = [], set()
            for stage, pool in stages:
                for t, c, f in ring(f"mcq{min(stage, 1) if stage < 3 else stage}", pool, item):
                    if (c == concept and f != facet and t != gold) if stage < 3 else c != concept:
                        tag = f"f{f}" if stage == 1 else None if stage == 2 else f"c:{c}"
                        if len(kept) < 3 and jac(t, gold) <= 0.6 and all(jac(t, k) <= 0.6 for k in kept) and (tag is None or tag not in tags):
                            kept.append(t)
                            tags.add(tag)
            if len(kept) == 3:
                want[item] = {gold, *kept}
        df = spark.createDataFrame(rows, "item int, concept string, facet string, answer string")
        got = {r.item: set(r.options) for r in sample.distractors(df, "item", hard, most=8).collect()}
        assert got == want and len(want) > 600


def test_mcnemar_of_large_counts(spark):
    import math

    def exact(b, c):
        n, k = b + c, min(b, c)
        return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)))

    pairs = [(60_000, 59_500), (59_900, 60_000), (3, 40), (21, 20), (10, 11), (1500, 1400), (0, 25), (25, 0)]
    got = spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    assert all(abs(r.p - exact(r.b, r.c)) < 2e-6 for r in got) and len(got) == len(pairs)
