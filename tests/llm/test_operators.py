"""The training-data operators against brute-force versions, on the smallest tables and on hand-built edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundset.llm import bpe, common, embedding_dedup, exact_dedup, html_text, langid, lm_score, mixing, quality, queries, repeats, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "the quick brown fox jumps over the lazy dog while nobody at all is watching it go. "
#: Null and empty texts, ties, repeated rows, a null id, non-BMP characters, white space only, one very long text.
EDGE = [
    (1, "a b  c", "s1"), (2, "a\tbc", "s1"), (3, None, None), (4, "", "s2"), (5, " \n", None), (6, "Same text here", "s1"), (6, "Same text here", "s1"), (7, "Same  text here", "s1"),
    (8, LONG * 3, "s3"), (9, "x" + LONG * 3, "s3"), (10, "\U0001f600 été " + LONG, "s2"), (11, LONG.replace("lazy", "idle") * 40, "s3"), (12, "123 !!", "s1"), (None, "orphan text", "s1"), (13, " ".join(f"w{i % 977}" for i in range(60_000)), "s1"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "en", 7) for r in EDGE], "doc_id long, text string, source string, lang string, id int").repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def closure(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_random_graphs_and_a_chain(spark):
    random.seed(1)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k != v}


def test_ranked_is_a_total_order(spark):
    df = common.ranked(spark.range(500).withColumn("k", F.col("id") % 7).repartition(5), F.col("k"), F.desc("id"))
    got = sorted(df.collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(500)) and [(r.k, -r.id) for r in got] == sorted((r.k, -r.id) for r in got)


def check_exact(found, given):
    groups = defaultdict(list)
    for i, t in given:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((-len(t or ""), i is None, i))
    got = defaultdict(list)
    for r in found.collect():
        got[r.digest.hex()].append(r)
    assert got.keys() == groups.keys()
    for k, members in groups.items():
        best = min(members)
        assert {r.keep_id for r in got[k]} == {best[2]} and {r.group_size for r in got[k]} == {len(members)}
        assert [r.doc_id for r in got[k] if r.kept] == [best[2]]
        assert Counter(r.doc_id for r in got[k]) == Counter(m[2] for m in members)


def test_exact_dedup(edge, none, docs, rows):
    check_exact(exact_dedup.exact_dedup(docs), rows)
    check_exact(exact_dedup.exact_dedup(edge, counters=2), [r[:2] for r in EDGE])
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 5, 7, 8, 9, 10, 11, 12, None, 13])


def test_heavy_hitters_hold_every_frequent_digest(spark):
    df = spark.createDataFrame([(bytes([i % 5 if i % 2 else 99, *(i.to_bytes(2) if i % 3 else b"")]),) for i in range(3000)], "digest binary").repartition(7)
    count = Counter(r.digest for r in df.collect())
    found = {r.digest for r in exact_dedup.heavy_hitters(df, 8).collect()}
    assert len(found) <= 9 and {d for d, n in count.items() if n >= 2 * 3000 / 9} <= found


def slow_fingerprint(text, k=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(found, given):
    prints = {(i, t): slow_fingerprint(t) for i, t in given}
    distinct = sorted(set(prints.values()))
    roots = closure(distinct, [(a, b) for x, a in enumerate(distinct) for b in distinct[:x] if (a ^ b).bit_count() <= 2])
    smallest = {}
    for (i, _), p in prints.items():
        smallest[roots[p]] = min([x for x in (smallest.get(roots[p]), i) if x is not None], default=None)
    want = Counter((i, prints[i, t], smallest[roots[prints[i, t]]]) for i, t in given)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found.collect()) == want


def test_simhash_groups(edge, none, docs, rows):
    check_simhash(simhash.simhash_groups(docs), rows)
    check_simhash(simhash.simhash_groups(edge), [r[:2] for r in EDGE])
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_links_all_pairs_within_two_bits(spark):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(30)]
    near = {b ^ sum(1 << i for i in random.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3)}
    near |= {0, 1, 2**63, 2**64 - 1}
    signed = {x - 2**64 if x >= 2**63 else x: x for x in near}
    edges = simhash.ball_edges(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in common.components(edges).collect()}
    want = closure(signed, [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 2])
    assert got == {k: v for k, v in want.items() if k != v}


def slow_shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b, similarity=0.8):
    return len(a & b) >= similarity * len(a | b)


def test_near_copies_are_found_down_to_the_threshold(spark, edge, none):
    random.seed(4)
    texts = []
    for _ in range(160):
        words = [f"w{random.randrange(5000)}" for _ in range(random.choice((40, 150, 600)))]
        texts.append(" ".join(words))
        copy = list(words)
        for _ in range(max(1, len(words) // random.choice((45, 60, 100)))):  # five shingles change with each word
            copy[random.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy).upper())
    sets = [slow_shingles(t) for t in texts]
    links = {(i, i + 1) for i in range(0, 320, 2) if alike(sets[i], sets[i + 1])}
    found = simhash.near_copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    joined = {(r.component_id, r.doc_id) for r in found if r.component_id != r.doc_id}
    assert len(links) > 80 and joined <= links and len(joined) >= 0.95 * len(links) and len(found) == 320
    assert simhash.near_copy_groups(none).count() == 0 and simhash.near_copy_groups(edge).count() == edge.count()


def test_near_copies_of_stars_and_of_small_sets(spark):
    """Edits of one original that link to it and seldom to one another; pairs of 8 and 9 words; against brute force."""
    random.seed(9)
    texts = []
    for star, n in ((0, 500), (1, 2000)):
        words = [f"s{star}w{i}" for i in range(400)]
        texts.append(" ".join(words))
        for c in range(n):
            copy = list(words)
            for at in range(6, 380, 50 if c % 10 else 25):  # every tenth lies below the threshold to the original
                copy[at + random.randrange(20)] = f"c{star}.{c}.{at}"
            texts.append(" ".join(copy))
    for i in range(40):
        words = [f"p{i}.{j}" for j in range(9)]
        texts += [" ".join(words), " ".join(words[: 8 - i % 2])]
    order = random.sample(range(len(texts)), len(texts))
    sets = dict(zip(order, map(slow_shingles, texts)))
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    links = []
    for i, s in sets.items():
        met = Counter(j for x in s for j in holders[x] if j < i) if len(s) < 10 else None
        if met is not None:
            links += [(j, i) for j in met if alike(sets[j], s)]
    ids = {x: n for n, x in enumerate(holders)}
    big = [i for i, s in sets.items() if len(s) >= 10]
    rows = np.zeros((len(big), len(ids)), bool)
    for at, i in enumerate(big):
        rows[at, [ids[x] for x in sets[i]]] = True
    shared = rows[:, rows.sum(0) > 1].astype(np.float32)
    both, size = shared @ shared.T, rows.sum(1)
    links += [(big[a], big[b]) for a, b in np.argwhere(np.triu(both >= 0.8 * (size[:, None] + size - both), 1))]
    want = closure(sorted(sets), links)
    df = spark.createDataFrame(list(zip(order, texts)), "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.component_id for r in simhash.near_copy_groups(df).collect()} == want
    assert len({want[i] for i in order[:501]}) < 100 and len({want[i] for i in order[501:2502]}) < 400


def test_near_copies_keep_one_of_each_group(edge):
    kept = simhash.drop_near_copies(edge)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.columns and {1, 8, 13, None} <= set(ids) and not {4, 5, 7} & set(ids) and ids.count(6) == 1


#: Names that operators use inside; tables may have columns of the same names.
INNER = ["key", "id", "row", "row_key", "at", "_at", "_id", "_n", "_digest", "digest", "lid", "_lid", "lang_pred", "score", "lang_score", "size", "source_size", "target", "taken", "position", "positions", "class", "bucket", "best", "root", "text_hash", "n", "h1", "h2", "q", "_q", "uses", "_uses"]


def test_columns_with_inner_names_pass_through(spark):
    rows = [(i % 3, f"some words of text number {i % 2} go here", "s", "en") for i in range(6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    df = plain.withColumns({c: F.lit(f"own {c}") for c in INNER})
    for drop, at_least in ((langid.drop_unidentified, 6), (exact_dedup.drop_exact_copies, 2), (simhash.drop_near_copies, 1), (mixing.mixed_documents, 1)):
        got = drop(df).collect()
        assert len(got) >= at_least and all(r[c] == f"own {c}" for r in got for c in INNER)
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in drop(plain).collect())
        assert drop(df.limit(0)).count() == 0


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.drop_unidentified(df).collect()] == [1]
    told = spark.createDataFrame([(i, "words of a language", "en") for i in range(20)] + [(99, "words of a language", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang for r in langid.drop_unidentified(told).collect()}[99] == "en"


def check_mix(found, given, whole=False):
    size = [len(WORD.findall(t or "")) for _, t, _ in given]
    per = Counter()
    for n, (_, _, s) in zip(size, given):
        per[s] += n
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size)
    while True:
        rate = left / max(1, sum(weight[s] for s in free))
        over = {s for s in free if 3 * per[s] < weight[s] * rate}
        if not over:
            break
        target |= {s: 3.0 * per[s] for s in over}
        left -= sum(3 * per[s] for s in over)
        free -= over
    target |= {s: min(3.0 * per[s], weight[s] * rate) for s in free}
    got = found.collect()
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == Counter((i, s, n, per[s]) for n, (i, _, s) in zip(size, given))
    for s in names:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-12) and 0 <= r.taken <= 3 * r.size and -1e-9 <= r.position <= 1 + 1e-9 for r in own)
        gap = abs(sum(r.taken for r in own) - target[s])
        assert gap <= (max(r.size for r in own) / 2 + 1 if whole else 0.5)


def test_mixing(edge, none, docs):
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(mixing.mix(docs), given)
    check_mix(mixing.mix(docs, whole=True), given, whole=True)
    check_mix(mixing.mix(edge), [r[:3] for r in EDGE])
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_positions_follow_the_schedules(docs):
    """Each first use begins when its source's integrated schedule has asked for the words before it; early sources are used earlier."""
    got = defaultdict(list)
    for r in mixing.mix(docs).collect():
        got[r.source].append(r)
    means = {}
    for at, source in enumerate(sorted(got)):
        slope, before = mixing.SLOPES[at % 3], 0
        for r in sorted(got[source], key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
            if r.taken:
                assert math.isclose(((1 - slope) * r.position + slope * r.position**2) * r.target, before, abs_tol=1e-6)
                assert r.positions == sorted(r.positions) and r.position == r.positions[0] < 1
            before += r.size
        uses = [p for r in got[source] for p in r.positions]
        means[slope] = means.get(slope, []) + uses
    early, flat, late = (sum(means[s]) / len(means[s]) for s in mixing.SLOPES)
    assert early < flat - 0.03 and flat < late - 0.03


def test_mixing_keeps_repeated_rows_apart(spark):
    rows = [(1, "a b c", "s", 1)] * 2 + [(2, "d e f", "s", 2), (None, "g", None, 3), (None, "g", None, 3), (3, None, "t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, at int")
    got = Counter(tuple(r) for r in mixing.mixed_documents(df).collect())
    plan = mixing.mix(df, whole=True).collect()
    assert sum(n for r, n in got.items() if r[0] == 1) == sum(r.taken for r in plan if r.doc_id == 1) // 3 and got[(3, None, "t", 4)] == 1


def test_mixed_documents_repeat_whole_documents(docs):
    plan = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs, whole=True).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: t // n if n else 1 for i, (t, n) in plan.items()}) + Counter()


def test_language_id_holds_out_and_scores(spark, docs, edge, none):
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    assert {r.id: r.h for r in spark.range(50).select("id", langid.held_out("id").alias("h")).collect()} == fold
    model = langid.fit(docs, trainable=~langid.held_out())
    got = langid.predict(docs.withColumn("held", langid.held_out()), model).collect()
    held = [r for r in got if r.held and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in langid.predict(edge, model).where("lang_pred = 'und'").collect()}
    assert und == {3, 4, 5, 12} and langid.predict(none, model).count() == 0
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(edge, empty).collect()} == {"und"}
    assert Counter(r.doc_id for r in langid.drop_unidentified(edge).collect()) == Counter(r[0] for r in EDGE if r[0] not in und)


def test_language_id_backs_off_for_unseen_words(spark):
    train = spark.createDataFrame([("der schnelle braune fuchs springt", "de"), ("le renard brun saute toujours", "fr")], "text string, lang string")
    model = langid.fit(train, fit_docs=100)
    got = langid.predict(spark.createDataFrame([("schnellster",), ("toujourette",)], "text string"), model).collect()
    assert {r.text: r.lang_pred for r in got} == {"schnellster": "de", "toujourette": "fr"}


def test_backoff_scores(edge, none, docs, rows):
    def check(found, given, **kw):
        one, two, texts = Counter(), Counter(), []
        for i, t in given:
            w = WORD.findall((t or "").lower())
            texts.append((i, w))
            one.update(w)
            two.update(zip(w, w[1:]))
        total, want = sum(one.values()), []
        for i, w in texts:
            s, back, own_one, own_two = 0.0, 0, Counter(w), Counter(zip(w, w[1:]))
            for j, x in enumerate(w):
                n = two[w[j - 1], x] - own_two[w[j - 1], x] if j else 0
                back += j > 0 and n == 0
                share = max(0.5, one[x] - own_one[x]) / max(1, total - len(w))
                s += math.log(n / (one[w[j - 1]] - own_one[w[j - 1]])) if n else math.log(share) + (math.log(0.4) if j else 0)
            want.append((i, len(w), back, s))
        got = sorted(((r.doc_id, r.n_words, r.n_backoff, r.log_score) for r in found.collect()), key=str)
        for a, b in zip(got, sorted(want, key=lambda x: str((x[0], x[1], x[2], x[3]))), strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)

    check(lm_score.backoff_scores(docs), rows)
    check(lm_score.backoff_scores(docs, block_chars=20_000), rows)
    check(lm_score.backoff_scores(edge), [r[:2] for r in EDGE])
    assert lm_score.backoff_scores(none).count() == 0


def brute_repeats(given):
    """given: (order, text) with distinct orders."""
    first = {}
    for o, t in sorted(given, key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], o)
    out = []
    for o, t in given:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < o:
                gone[i : i + 50] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((o, len(b), int(gone.sum()), int((edge == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_repeats(edge, none, docs, rows, monkeypatch):
    def check(found, given):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
        assert got == sorted(brute_repeats(given)) and sum(r[2] for r in got)

    check(repeats.remove_repeats(docs), rows)
    own = [r[:2] for r in EDGE if r[0] not in (None, 6)]
    check(repeats.remove_repeats(edge.where("doc_id != 6")), own)
    monkeypatch.setattr(repeats, "GROUP", 1)  # every shared anchor goes the way of the large ones
    check(repeats.remove_repeats(docs), rows)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_numbers_repeated_and_null_ids(edge):
    got = repeats.remove_repeats(edge.where("doc_id IS NULL OR doc_id IN (8, 9)").union(edge.where("doc_id = 8"))).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_bytes) for r in got) == [("8", 0, 249), ("8", 249, 249), ("9", 249, 250), ("None", 0, 11)]


def test_repeats_of_made_up_texts(spark):
    """Texts of two letters and of shared pieces: anchors with many passages, windows at both ends, pieces over a chunk's end."""
    random.seed(3)
    piece = ["".join(random.choice("ab") for _ in range(random.randrange(20, 90))) for _ in range(8)]
    given = [(i, "".join(random.choice(piece) + random.choice(["", "z", "é"]) for _ in range(random.randrange(1, 6)))) for i in range(120)]
    found = repeats.remove_repeats(spark.createDataFrame(given, "doc_id long, text string").repartition(5))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == sorted(brute_repeats(given))


def test_long_text_is_worked_on_in_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(repeats, "CHUNK", 300)
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(2000))
    parts = list(repeats._pieces(pd.Series([1, 2]), pd.Series([text, "short"])))
    covered = np.zeros(2000 - 49, int)
    for ids, offsets, b, ends in parts:
        owner, start, windows, *_ = repeats.anchors(b, ends)
        for o, s, w in zip(owner, start, windows):
            at = offsets[o] + s - np.r_[0, ends][o]
            covered[at : at + w] += 1
    assert (covered == 1).all()


def test_run_length_index_walks_every_suffix():
    random.seed(5)
    passages = [bytes(random.choice(b"ab") for _ in range(random.randrange(50, 70))) * 2 for _ in range(30)]
    passages += passages[:5]
    docs = np.arange(len(passages))
    index = repeats.RunLengthIndex(passages, docs)
    suffixes = sorted((p[i:] + b"\0" * (i == len(p)), n, i) for n, p in enumerate(passages) for i in range(len(p) + 1))
    assert len(index.run_start) < len(suffixes)
    which, at = index.earlier()
    want = {(n, i) for n, p in enumerate(passages) for i in range(len(p) - 49) if any(p[i : i + 50] in q for q in passages[:n])}
    assert set(zip(which.tolist(), at.tolist())) == want


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
    <div class="cookie-notice">We use <p>cookies</p></div><article><header><h1>Caf&eacute; &amp; bar</h1></header><p>One <b>bold</b>
    word<br>next<p>Two &lt;tags&gt;<script>var x = "<p>no</p>";</script><aside>see also</aside><form><input>go</form><!-- <p>gone</p> -->
    <div id=comments>first!</div><ul><li>a<li>b</ul></article><div>stray</div><footer>&copy; me"""
    assert html_text.blocks(page) == (["Café & bar", "One bold word", "next", "Two <tags>", "a", "b"], ["stray"])
    assert html_text.blocks(None) == ([], []) and html_text.blocks("plain") == ([], ["plain"]) and html_text.blocks("<<p") == ([], ["<"])


def test_html_titles_comments_and_share_links():
    main = lambda page: html_text.blocks(page)[0]
    assert main('<article><div class="article-header"><h1>Title</h1></div><p>Body</p><section class="related-work"><p>Others</p></section>') == ["Title", "Body", "Others"]
    assert main('<main><p>Text</p><h2>Comments</h2><ol class="commentlist"><li>hi</ol><p>more</main>') == ["Text", "more"]
    assert main('<article><p>Read this. <a class="share-button">Share <b>this</b></a></p><p>End <span class=ad>buy <span>now</span> or</span> here</article>') == ["Read this.", "End", "here"]
    assert main('<article><h2>Commentary</h2><p>a<div class="related-posts">x</div><div class="header">site</div><h2>Kept</h2><div id="sidebar">y</div></article>') == ["Commentary", "a", "Kept"]


def test_html_copies_of_a_page_keep_their_text(spark):
    page = "<body><p>a short page of some ten words without any article mark</p></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page) for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract_main_text(df).collect()} == {"a short page of some ten words without any article mark"}


def test_html_repeated_runs_go_where_no_article_is_marked(spark):
    menu = " ".join(f"item{i}" for i in range(12))
    pages = [(i, "http://www.h.org/a" if i < 6 else None, f"<body><div>{menu}</div><p>n{i} own words of it stay</p>") for i in range(7)]
    pages += [(7, "http://h.org/x", None), (8, "http://h.org/x", ""), (8, "http://h.org/x", ""), (None, "http://h.org/y", "<article>kept " + menu + "</article>")]
    got = {(r.page_id, r.url): r.text for r in html_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert [got[i, "http://www.h.org/a"] for i in range(6)] == [f"n{i} own words of it stay" for i in range(6)]
    assert got[6, None] == f"{menu} n6 own words of it stay" and got[7, "http://h.org/x"] == got[8, "http://h.org/x"] == "" and got[None, "http://h.org/y"] == "kept " + menu


def test_html_runs_are_counted_over_the_whole_host(spark):
    """Runs on 1 % of a host's pages, a host of 257 pages, any number of partitions; against the suffix array over the whole host."""
    random.seed(12)
    menus = [" ".join(f"m{k}i{i}" for i in range(10)) for k in range(100)]
    pages = [(i, "http://big.org/", f"own{i} " + menus[i % 100] + f" text{i} " + " ".join(random.choice("ab") for _ in range(9))) for i in range(700)]
    pages += [(1000 + i, "http://other.org/", f"x{i} " + menus[0] + f" y{i}") for i in range(257)]
    pages += [(2000, "http://small.org/", "one page in three rows keeps every word it has")] * 3
    want = Counter()
    for host in {p[1] for p in pages[:-3]}:
        part = [p for p in pages if p[1] == host]
        for (i, _, t), gone in zip(part, html_text.repeated([p[2].split(" ") for p in part])):
            want[i, " ".join(w for w, g in zip(t.split(" "), gone) if not g)] += 1
    want[pages[-1][0], pages[-1][2]] = 3
    assert sum(" m" in t for _, t in want) == 0
    df = spark.createDataFrame(random.sample(pages, len(pages)), "page_id long, url string, html string")
    for n in (1, 7):
        assert Counter((r.page_id, r.text) for r in html_text.extract_main_text(df.repartition(n)).collect()) == want


def test_repeated_runs_against_brute_force():
    random.seed(6)
    pages = [[random.choice("abc") for _ in range(random.randrange(0, 60))] for _ in range(12)]
    got = html_text.repeated(pages, 8, 3)
    for p, marks in zip(pages, got):
        want = np.zeros(len(p), bool)
        for i in range(len(p) - 7):
            if sum(any(q[j : j + 8] == p[i : i + 8] for j in range(len(q) - 7)) for q in pages) >= 3:
                want[i : i + 8] = True
        assert (marks == want).all()


def test_bpe_is_the_tokenizers(spark, docs, edge, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    odd = spark.createDataFrame([(900, "<|endoftext|>x <|startoftext|> a\x1cb c d İ ΣΣ é it's 12 한글", "s", "en", 1)], edge.schema)
    for df, most in ((docs, 1 << 17), (edge.union(odd), 5), (none, 5)):
        got = bpe.encode_decode(df.select("doc_id", "text"), queries.tokenizer_path(), broadcast_words=most).collect()
        for r in got:
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)


def brute_links(given, cosine=0.95):
    ok = [v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in given]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v) in zip(ok, given)]
    return [(a, b) for a in range(len(given)) for b in range(a) if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]


def check_embeddings(found, given):
    pairs = brute_links(given)
    links = Counter(x for p in pairs for x in p)
    roots = closure(range(len(given)), pairs)
    smallest = {}
    for x, r in roots.items():
        smallest[r] = min([i for i in (smallest.get(r), given[x][0]) if i is not None], default=None)
    want = Counter((i, links[x], smallest[roots[x]], i == smallest[roots[x]]) for x, (i, _) in enumerate(given))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == want


def test_embedding_groups(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    check_embeddings(embedding_dedup.embedding_groups(vectors), [(r.vec_id, r.embedding) for r in vectors.collect()])
    e = [1.0, 0.0, 0.5]
    edge = [(1, e), (2, e), (3, [2.0, 0.0, 1.0]), (4, [1.0, 0.01, 0.5]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, 0.5]), (9, [1.0, 0.5]), (10, []), (None, [0.0, 1.0, 0.0]), (11, [0.0, float("inf"), 0.0]), (12, [-1.0, 0.0, -0.5])]
    df = spark.createDataFrame(edge, "vec_id long, embedding array<float>").withColumn("vec", F.lit(1))
    check_embeddings(embedding_dedup.embedding_groups(df), edge)
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((700, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.952 * base + math.sqrt(1 - 0.952**2) * side
    given = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, near]))]
    found = embedding_dedup.embedding_groups(spark.createDataFrame(given, "vec_id long, embedding array<double>"))
    linked = sum(r.n_links for r in found.collect()) / 2
    want = len(brute_links(given))
    assert 0.95 * want <= linked <= want


def test_quality_classifier(spark, edge, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.quality_scores(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    assert sum((r.quality_score >= 0.5) == bool(r.quality) for r in got) / len(got) >= 0.95
    assert all(0 <= x <= 1 for r in got for x in (r.p_text, r.p_meta, r.quality_score))
    told = spark.createDataFrame([(1, 1), (8, 0), (9, 1), (11, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    scored = quality.quality_scores(edge, told).collect()
    assert Counter(r.doc_id for r in scored) == Counter(r[0] for r in EDGE) and all(r.quality_score is not None for r in scored)
    assert quality.quality_scores(none, told).count() == 0
    assert quality.quality_scores(edge, told.limit(0)).where("quality_score IS NOT NULL").count() == 0


def test_quality_against_plain_loops(spark):
    """The same co-training over dense rows in memory: every unlabelled row is scored in each round, and the averages of the sure ones handed over."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.withColumns({"h": F.xxhash64("doc_id"), "shard": F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS))}).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    text, meta = np.zeros((len(rows), quality.BUCKETS)), np.zeros((len(rows), quality.META))
    for i, r in enumerate(rows):
        at, value = quality.text_features(r.text)
        np.add.at(text[i], at, value)
        meta[i] = quality.meta_features(r.text, r.lang, r.source)
    known = sorted((i for i, r in enumerate(rows) if r.doc_id in label), key=lambda i: (rows[i].h, rows[i].doc_id))
    free = [i for i, r in enumerate(rows) if r.doc_id not in label]
    assert known and free

    def pseudo(w_text, w_meta):
        out, p = {}, {}
        for name, x, w in (("meta", text, w_text), ("text", meta, w_meta)):
            p[name] = {i: 1 / (1 + math.exp(-(x[i] @ w[:-1] + w[-1]))) for i in free}
        for name, x in (("text", text), ("meta", meta)):
            means, classes, n = [], [], []
            for c in (0, 1):
                for s in range(quality.SHARDS):
                    sure = [i for i in free if rows[i].shard == s and (p[name][i] if c else 1 - p[name][i]) >= quality.SURE]
                    if sure:
                        means.append(x[sure].mean(0)), classes.append(float(c)), n.append(len(sure))
            out[name] = np.array(means).reshape(len(n), x.shape[1]), np.array(classes), np.array(n, float)
        return out

    model = quality.co_train(quality._Dense(text[known]), quality._Dense(meta[known]), np.array([float(label[rows[i].doc_id]) for i in known]), pseudo)
    z = np.stack([text @ model.text[:-1] + model.text[-1], meta @ model.meta[:-1] + model.meta[-1]], 1) / 10 * model.scale[:, 0] + model.scale[:, 1]
    want = 1 / (1 + np.exp(-(z / 10 @ model.combine[:-1] + model.combine[-1])))
    got = {r.doc_id: r.quality_score for r in quality.quality_scores(docs, labels).collect()}
    assert all(math.isclose(got[r.doc_id], w, abs_tol=1e-4) for r, w in zip(rows, want))
