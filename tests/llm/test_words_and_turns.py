"""Spelling variants, byte-level BPE, conversation repair and dealt strays against brute-force versions."""

import hashlib
import heapq
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from groundset.llm import byte_bpe, conversation, queries, simhash, spelling

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_spelling", "op13_conversations"])
def test_query_matches_its_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name]) == ""


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_words_one_edit_apart_are_all_found(spark):
    """Two letters make hot buckets; non-ASCII letters, ties of n, anagrams, chains of forms."""
    random.seed(5)
    words = {"".join(random.choices("ab", k=random.choice((6, 7, 8)))) for _ in range(120)} | {"".join(random.choices("abcdeéß", k=random.choice((6, 7, 9, 12)))) for _ in range(150)}
    for w in list(words)[:120]:
        i = random.randrange(len(w))
        words |= {x for x in (w[:i] + random.choice("aé") + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i:]) if len(x) >= 6}
    n = {w: random.choice((5, 6, 25, 26, 150, 900)) for w in sorted(words)}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 5 * n[w] else None for w, v in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    got = spelling.variant_forms(spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == {w: (form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n} and len(got) == len(n)
    assert max(map(len, near.values())) > 5 and any(form[form[w]] for w in n if form[w])
    assert spelling.variant_forms(spark.createDataFrame([], "word string, n long")).count() == 0


def test_letter_runs_of_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, "ÀÉÎõüÿ StraßeĀbcdefg x×÷yzabc"), (3, "ABCDEF" * 2000), (None, "É123abcdef")]
    got = Counter((r.id, r.run) for r in spelling.letter_runs(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "run": F.lit(2)})).collect())
    assert got == Counter({(3, "ÀÉÎõüÿ"): 1, (3, "Straße".replace("S", "s")): 1, (3, "bcdefg"): 1, (3, "x×÷yzabc"): 1, (3, "abcdef" * 2000): 1, (None, "abcdef"): 1})


@pytest.mark.parametrize("chunk, overlap", [(40, 12), (64, 16), (byte_bpe.CHUNK, byte_bpe.OVERLAP)])
def test_byte_bpe_in_chunks_is_tiktokens(spark, chunk, overlap):
    """Chunks that meet inside words, contractions and white space; pre-tokens longer than the overlap."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(path), special_tokens={})
    random.seed(3)
    parts = ["a", " ", "  ", "\n", "'ll", "'", "é", "\U0001f600", "12", "..", "東", "x'", "'re ", "\t", " 　", "Hello", "<|endoftext|>"]
    rows = [(i, "".join(random.choices(parts, k=random.randrange(400)))) for i in range(150)] + [(900, None), (901, ""), (902, "a" * 30_000), (903, " " * 30_000), (903, " " * 30_000), (904, "word " * 9000), (905, "'" * 3000), (None, "z " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(7), "key": F.lit("own"), "decoded": F.lit(1)}).repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), path).collect()
    want = Counter((i, tuple(coder.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got) == want and all(r.key == "own" for r in got)
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), path, public_tokenizers.PATTERN), path).count() == 0


def test_byte_bpe_query_is_tiktokens(spark, sf):
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


WHOLE, BEGUN = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")


def slow_repair(turns):
    """The cheapest edits by a search over all of them, in the order of (cost, audit): the first complete one is the answer."""
    seen, faults = set(), []
    for role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(turns) and WHOLE.fullmatch(initials):
            return cost, audit, "\n".join(out), Counter(faults)
        # what may follow depends on the place and the last initial only
        if (at, initials[-1:]) in done or not BEGUN.fullmatch(initials):
            continue
        done.add((at, initials[-1:]))
        more = [(5, "I", at, "u", "user:"), (5, "I", at, "a", "assistant:")]
        if at < len(turns):
            (role, text), worse = turns[at], 5 * (faults[at] == "truncated")
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, out))
            if faults[at] in ("", "truncated"):
                more += [(worse, "K", at + 1, role[:1], f"{role}:{text}"), (1 + worse, "R", at + 1, "u", f"user:{text}"), (1 + worse, "R", at + 1, "a", f"assistant:{text}")]
        for price, edit, to, initial, line in more:
            heapq.heappush(heap, (cost + price, audit + edit, to, initials + (initial or "?"), (*out, line)))


@pytest.mark.parametrize("segment", [4, 1024])
def test_repairs_are_the_cheapest(spark, segment):
    random.seed(11)
    rows = []
    for c in range(250):
        for t in range(random.choice((0, 1, 2, 3, 5, 9, 14))):
            text = random.choice(("Yes.", "No!", "cut off", "\t ", "So? ", "So it is.", "end" + random.choice(".,") * 2, f"Nr {t}."))
            rows.append((None if c == 7 else c, random.choice((t, t, t, None, t + 3, 2)), random.choice(("user", "assistant", "user", "assistant", "system", "tool", "umpire", "", None)), random.choice((text, text, text, None)), "own"))
    rows += [(999, t, "user" if t % 2 else "assistant", "Same.", "own") for t in range(40)] + [(1000, 1, "user", "Twice. " * 20_000, "own")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    repaired = conversation.repair(df, segment=segment).persist()
    got = {r.conv: r for r in conversation.report(repaired).join(conversation.digests(repaired).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).collect()}
    assert len(got) == len({r[0] for r in rows}) and repaired.agg(F.max(F.size("turns"))).first()[0] <= segment
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        numbers = {t for known, t, _, _ in own if known}
        initials = [role[:1] for _, _, role, _ in own]
        cost, audit, text, faults = slow_repair([x[2:] for x in own])
        assert (r.cost, r.audit, r.sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, own)
        assert (r.blank, r.duplicate, r.truncated) == (faults["blank"], faults["duplicate"], faults["truncated"])
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) and r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
    written = [x.role + ":" + x.text for s in sorted(repaired.where("conv = 3").collect(), key=lambda s: s.segment) for x in s.repaired]
    assert hashlib.sha256("\n".join(written).encode()).hexdigest() == (got[3].sha256 if 3 in got else hashlib.sha256(b"").hexdigest())
    assert conversation.report(conversation.repair(df.limit(0))).count() == 0
    repaired.unpersist()


def test_conversations_without_rows_after_damage_are_kept(spark, tmp_path):
    import zlib

    gone = [c for c in range(400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    spark.createDataFrame([(c, 1, "user", "Hello.") for c in gone[:5]] + [(None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == {*gone[:5], None}
    assert all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone[:5])
    assert differences(queries.op13_conversations(spark, str(tmp_path)), duck_of(tmp_path), queries.oracle_sql()["op13_conversations"]) == ""


def duck_of(folder):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    return con


def test_a_stray_costs_a_crowd_one_pass(spark):
    """2000 members of one group and a stray; a bucket of one group; strays that differ meet one another once."""
    rows = [(1, 70, c, 0) for c in range(2000)] + [(1, 70, 5000, 5000)] + [(2, 71, c, 0) for c in range(500)] + [(3, 72, c, c) for c in range(40)]
    placed = spark.createDataFrame(rows, "bucket long, kind int, class long, root long").repartition(4)
    dealt = simhash.dealt_strays(placed, 64).collect()
    per = Counter(r.bucket for r in dealt)
    assert set(per) == {1, 3} and per[1] == 2001 + -(-2001 // 64)
    cells = {}
    for r in dealt:
        cells.setdefault((r.bucket, r.i, r.j), ([], []))[0 if r.asks else 1].append(r)
    met = Counter((r.bucket, *sorted((a["class"], r["class"]))) for asks, answers in cells.values() for a in asks for r in answers if a.root != r.root and (not r.stray or a["class"] < r["class"]))
    assert met == Counter({(1, c, 5000): 1 for c in range(2000)} | {(3, a, b): 1 for b in range(40) for a in range(b)})
