"""Removal of repeated passages with a run-length index, in shards that a sampling of the text deals out."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import merge_join, ranked, stored

#: Bytes of a match, of an anchor; bytes of text worked on at once; passages of an indexed shard and of the largest indexed group.
MATCH, ANCHOR, CHUNK, SHARD, GROUP = 50, 24, 1 << 18, 6_000, 6_000
_RNG = np.random.default_rng(50)
_A, _B = (_RNG.integers(0, 1 << 64, 256, np.uint64) for _ in range(2))
_P = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64, computed once in a worker."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _INVERSE)], dtype=np.uint64)
        return cls.up, cls.down


def _prefix_sums(b: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(b) + 1)
    return np.r_[np.uint64(0), np.cumsum(_B[b] * up[: len(b)], dtype=np.uint64)]


def _span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.get(len(sums))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _P)


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset, anchor, passage) of the passages of texts laid end to end in `b`, ending at `ends`.

    A window is MATCH bytes of one text; its anchor is its ANCHOR bytes of least hash (the first of equals). Windows in
    a row with the same anchor are a passage, which is their union. `anchor` and `passage` are 64-bit hashes of the bytes,
    `passage` also of the anchor's offset. What depends on a window's bytes alone is the same in every text that has it.
    """
    k, wide = ANCHOR, MATCH - ANCHOR + 1
    n = len(b) - MATCH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    powers = [np.uint64(pow(int(_P), 1 << i, 1 << 64)) for i in range(4)]
    h = [_A[b]]
    for i in range(4):  # hashes of 2, 4, 8 and 16 bytes
        s = 1 << i
        h.append(h[-1][:-s] * powers[i] + h[-1][s:])
    full = _mix(h[4][: len(b) - k + 1] * powers[3] + h[3][16 : 16 + len(b) - k + 1])
    low = np.uint64((1 << 22) - 1)
    m = (full & ~low) | np.arange(len(full), dtype=np.uint64)
    for s in (1, 2, 4, 8):
        m = np.minimum(m[:-s], m[s:])
    at = (np.minimum(m[:n], m[wide - 16 : wide - 16 + n]) & low).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + MATCH <= ends[np.minimum(owner, len(ends) - 1)]
    new = valid & np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]]
    stop = valid & np.r_[new[1:] | ~valid[1:], True]
    start, last = np.flatnonzero(new), np.flatnonzero(stop)
    q = at[start]
    passage = _span_hash(_prefix_sums(b), start, last + MATCH) ^ ((q - start).astype(np.uint64) * _BASE)
    return owner[start], start, last - start + 1, q - start, full[q].view(np.int64), passage.view(np.int64)


def _pieces(ids: pd.Series, texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, bytes, ends) of at most about CHUNK bytes: many texts, or windows of one long text in a row."""
    held, size = [], 0

    def out():
        return np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.cumsum([len(x[2]) for x in held])

    for i, t in zip(ids, texts):
        raw = (t or "").encode()
        for at in range(0, max(1, len(raw) - MATCH + 1), CHUNK):
            piece = raw[at : at + CHUNK + MATCH - 1]
            if len(piece) < MATCH:
                continue
            if held and size + len(piece) > CHUNK:
                yield out()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield out()


#: `place` packs what a passage's row has besides its keys: start * 4096 + offset of the anchor * 64 + windows * 2 + sure.
_ROWS = "anchor long, passage long, id long, place long"
_START, _OFFSET, _WINDOWS = "cast(place DIV 4096 AS int) AS start", "cast(place DIV 64 % 64 AS int) AS offset", "cast(place DIV 2 % 32 AS int) AS windows"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of all texts. Of equal passages worked on at once only those of the smallest id still have to be
    compared with other tasks'; the others are sure to be repeats, and get a key of their own."""
    for batch in batches:
        for ids, offsets, b, ends in _pieces(batch["id"], batch["text"]):
            owner, start, windows, offset, anchor, passage = anchors(b, ends)
            if not len(owner):
                continue
            origin = np.r_[0, ends[:-1]]
            own = ids[owner].astype(np.int64)
            place = ((start - origin[owner] + offsets[owner]) * 64 + offset) * 64 + windows * 2
            order = np.lexsort((own, passage, anchor))
            a, p, o = anchor[order], passage[order], own[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (p[1:] != p[:-1])]
            least = o[np.flatnonzero(new)][np.cumsum(new) - 1]
            sure = np.zeros(len(own), bool)
            sure[order] = o > least
            key = np.where(sure, _mix((own * 31 + place).view(np.uint64)).view(np.int64), anchor)
            yield pd.DataFrame({"anchor": key, "passage": np.where(sure, 0, passage), "id": own, "place": place + sure})


class RunLengthIndex:
    """A run-length compressed Burrows-Wheeler transform of passages, built from a suffix array by prefix doubling.

    Every passage ends with a terminator of its own. `walk` steps all passages backwards through the transform by
    LF-mapping over its runs, one byte of each at a time, and so gives for every position its row among the sorted
    suffixes. Rows whose suffixes agree in MATCH bytes are neighbours; for each such interval, in which matching
    statistics reach MATCH, the smallest document is kept.
    """

    def __init__(self, passages: list[bytes], docs: np.ndarray):
        sizes = np.array([len(p) for p in passages], np.int64)
        self.sizes, self.docs, self.many = sizes, docs, len(passages)
        self.first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        n = int((sizes + 1).sum())
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.first + sizes] = False
        text[inside] = np.frombuffer(b"".join(passages), np.uint8).astype(np.int64) + self.many
        text[~inside] = np.arange(self.many)
        bits, width, ranks, packed = (self.many + 256).bit_length(), 4 if self.many + 256 < 1 << 15 else 1, {}, text.copy()
        for i in range(1, width):
            packed = packed << bits
            packed[: n - i] |= text[i:]
        rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        while width < max(2 * MATCH, int(sizes.max()) + 1):
            ranks[width] = rank
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            width *= 2
        suffixes = np.argsort(rank)
        bwt = text[suffixes - 1]  # the byte before; the last terminator stands before the first passage
        self.run_start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.run_byte = bwt[self.run_start]
        length = np.diff(np.r_[self.run_start, n])
        # rows before a run's byte in the first column: smaller bytes, then earlier runs of the same byte
        order = np.argsort(self.run_byte, kind="stable")
        before = np.zeros(len(order), np.int64)
        before[order] = np.r_[0, np.cumsum(length[order])[:-1]]
        self.run_to = before
        # intervals of suffixes that agree in MATCH bytes, from ranks of 32 bytes at two places
        half = 1 << (MATCH.bit_length() - 1)
        r, shift = ranks[half], MATCH - half
        x, y = r[suffixes], r[np.minimum(suffixes + shift, n - 1)]
        self.interval = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        owner = np.searchsorted(self.first, suffixes, side="right") - 1
        self.smallest = np.minimum.reduceat(docs[owner], self.interval)

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passages, positions, rows) from the last byte of every passage to the first."""
        live = np.arange(self.many)
        row = live.copy()  # a passage's terminator is the row of its number
        step = 0
        while True:
            step += 1
            more = self.sizes[live] >= step
            live, row = live[more], row[more]
            if not len(live):
                return
            run = np.searchsorted(self.run_start, row, side="right") - 1
            row = self.run_to[run] + row - self.run_start[run]
            yield live, self.sizes[live] - step, row

    def earlier(self) -> tuple[np.ndarray, np.ndarray]:
        """(passage, position) of all windows of MATCH bytes that a passage of a smaller document has too."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for live, at, row in self.walk():
            far = at + MATCH <= self.sizes[live]
            live, at, row = live[far], at[far], row[far]
            least = self.smallest[np.searchsorted(self.interval, row, side="right") - 1]
            old = least < self.docs[live]
            found.append((live[old], at[old]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: index its passages, stream them, return the windows that repeat a smaller document's.

    A window is its anchor and MATCH - ANCHOR bytes on both sides of it, so it has half of these on one side: passages
    that share an anchor but neither half with another document can't share a window and are left out.
    """
    half = (MATCH - ANCHOR) // 2
    docs, seen = pdf["id"].to_numpy(np.int64), {}
    keys = []
    for raw, anchor, at, doc in zip(pdf["bytes"], pdf["anchor"], pdf["offset"], docs):
        own = []
        if at >= half:
            own.append((anchor, 0, raw[at - half : at]))
        if at + ANCHOR + half <= len(raw):
            own.append((anchor, 1, raw[at + ANCHOR : at + ANCHOR + half]))
        keys.append(own)
        for k in own:
            seen[k] = doc if seen.get(k, doc) == doc else -1
    some = np.fromiter((any(seen[k] == -1 for k in own) for own in keys), bool, len(keys))
    empty = pd.DataFrame({"id": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "windows": np.zeros(0, np.int32)})
    if not some.any():
        return empty
    pdf = pdf[some]
    which, at = RunLengthIndex(list(pdf["bytes"]), docs[some]).earlier()
    order = np.lexsort((at, which))
    which, at = which[order], at[order]
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    length = np.diff(np.r_[new, len(at)])
    return pd.DataFrame({"id": docs[some][which[new]], "start": (pdf["start"].to_numpy()[which[new]] + at[new]).astype(np.int32), "windows": length.astype(np.int32)})


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the wanted passages of each text."""
    for batch in batches:
        out = []
        for i, t, wanted in zip(batch["id"], batch["text"], batch["wanted"]):
            raw = (t or "").encode()
            out += [(w["anchor"], i, w["start"], w["offset"], raw[w["start"] : w["start"] + w["windows"] + MATCH - 1]) for w in wanted]
        yield pd.DataFrame(out, columns=["anchor", "id", "start", "offset", "bytes"])


_REMOVED = "n_bytes long, n_removed long, n_spans long, kept binary, starts array<int>, ends array<int>"


def _remove(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
    out = []
    for t, m in zip(texts, marks):
        raw = (t or "").encode()
        if m is None or not len(m):
            out.append((len(raw), 0, 0, raw, [], []))
            continue
        start = np.array([x["start"] for x in m], np.int64)
        end = start + np.array([x["windows"] for x in m], np.int64) + MATCH - 1
        change = np.bincount(start, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
        gone = np.r_[False, np.cumsum(change)[: len(raw)] > 0, False]
        starts, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
        out.append((len(raw), int(gone.sum()), len(starts), np.frombuffer(raw, np.uint8)[~gone[1:-1]].tobytes(), starts, ends))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, starts, ends) for every row: the UTF-8 bytes of the whole text
    without those that a string of MATCH bytes covers which also starts in a document with a smaller id.

    `kept` holds the other bytes in a row; `starts` and `ends` bound the removed runs. Strings are judged on the input
    and never cross documents. Null text counts as empty; texts shorter than MATCH lose nothing. If ids repeat, are null
    or aren't integers, documents are numbered by id (null last), then by a hash of the text, and the numbers
    compared: a repeated row is a later document. An empty table gives an empty result; other columns are not read.

    Each window of MATCH bytes is dealt by its anchor, which every copy of the window shares. Passages that are equal as
    a whole (two 64-bit hashes agree, of the anchor and of the passage) are settled by grouping. Those that share an anchor but differ go with their bytes to shards, each
    with a run-length index of its passages, through which they are streamed. An anchor with over GROUP different
    passages would make a shard too large; its windows are grouped by their hashes, which spreads them.
    """
    base = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    plain = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    if plain and base.groupBy("key").count().where("count > 1 OR key IS NULL").isEmpty():
        base = base.withColumn("id", F.col("key").cast("long"))
    else:
        base = ranked(base.withColumn("_h", F.xxhash64("text")), F.col("key").asc_nulls_last(), F.col("_h"), name="id").drop("_h")
        base = stored(base)
    texts = base.select("id", "key", "text").repartition("id")
    rows = base.select("id", "text").where(F.octet_length("text") >= MATCH).mapInPandas(_scan, _ROWS)
    same, near = W.partitionBy("anchor", "passage"), W.partitionBy("anchor")
    seen = rows.withColumn("first", F.min("id").over(same))
    for name, value in (("least", F.min("id")), ("most", F.max("id")), ("one", F.min("passage")), ("two", F.max("passage"))):
        seen = seen.withColumn(name, value.over(near))
    seen = seen.withColumn("repeat", (F.col("place") % 2 == 1) | (F.col("id") > F.col("first")))
    seen = stored(seen.where("repeat OR (least < most AND one != two)").select("anchor", "id", "place", "repeat"))
    marks = seen.where("repeat").selectExpr("id", _START, _WINDOWS)
    open_ = seen.where("NOT repeat").selectExpr("anchor", "id", _START, _OFFSET, _WINDOWS)
    large = open_.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("anchor")
    n = open_.count()
    shards = max(1, math.ceil(n / SHARD))

    def passages(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("id").agg(F.collect_list(F.struct("anchor", "start", "offset", "windows")).alias("wanted"))  # passages of one text
        return merge_join(texts, wanted, "id").select("id", "key", "text", "wanted").mapInPandas(_cut_out, "anchor long, id long, start int, offset int, bytes binary")

    dealt = passages(merge_join(open_, large, "anchor", "left_anti")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    marks = marks.union(dealt.groupBy("shard").applyInPandas(_resolve, "id long, start int, windows int"))
    if not large.isEmpty():
        hot = passages(merge_join(open_, large, "anchor", "left_semi")).mapInPandas(_windows, "window binary, id long, start int")
        lowest = hot.groupBy("window").agg(F.min("id").alias("least"))
        marks = marks.union(merge_join(hot, lowest, "window").where("least < id").select("id", "start", F.lit(1).alias("windows")))
    marks = stored(marks)
    every = marks.groupBy("id").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = merge_join(texts, every, "id", "left").select("key", F.pandas_udf(_remove, _REMOVED)("text", "marks").alias("r"))
    return joined.select(F.col("key").alias(id_col), "r.*")


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(b[i : i + MATCH], d, s + i) for b, d, s in zip(batch["bytes"], batch["id"], batch["start"]) for i in range(len(b) - MATCH + 1)]
        yield pd.DataFrame(rows, columns=["window", "id", "start"])
