"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks that are stitched where their pre-token boundaries agree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh, merge_join, stored, with_row_key

#: Code points of a chunk and of its overlap with the next one; code points beyond a match that the pattern may look at.
CHUNK, OVERLAP, LOOKAHEAD = 1 << 14, 1 << 8, 8
#: Code points or token bytes that a task holds at once, beyond one text.
SLICE = 1 << 20
#: Pre-tokens of long texts whose ids a task remembers; a new set begins when they are so many.
MEMO = 1 << 16
_PARTS = "key long, no int, ended boolean, left_at array<long>, left_ids array<binary>, middle binary, right_at array<long>, right_ids array<binary>"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _tokens(path: str) -> np.ndarray:
    """Bytes of each id; an id that no rank names has none."""
    ranks = _ranks(path)
    table = np.full(max(ranks.values(), default=-1) + 1, b"", object)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE each."""
    start = total = 0
    for at, size in enumerate(sizes):
        total += size + 1
        if total >= SLICE:
            yield start, at + 1
            start, total = at + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _encode_whole(path: str, pattern: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            rest = batch.drop_columns([text_col])
            texts = batch.column(text_col)
            for a, b in _slices([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]):
                ids = pa.array([_packed(coder.encode_ordinary(t.as_py() or "")) for t in texts[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, ids], names=[*rest.schema.names, "ids"])

    return run


def _cut_up(chunk: int, overlap: int):
    """Chunks (key, no, ended, view) of each text; each view reaches `overlap` into the next one, the last to the text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text")):
                key, text = key.as_py(), text.as_py()
                for first in range(0, len(text), SLICE):
                    starts = [s for s in range(first, min(first + SLICE, len(text)), chunk) if s == 0 or s + overlap < len(text)]
                    views = [text[s : s + chunk + overlap] for s in starts]
                    ended = [s + chunk + overlap >= len(text) for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), pa.int64()), pa.array([s // chunk for s in starts], pa.int32()), pa.array(ended, pa.bool_()), pa.array(views, pa.string())], names=["key", "no", "ended", "view"])

    return run


def _pre_tokenise(path: str, pattern: str, chunk: int, overlap: int):
    """Ids of each chunk's pre-tokens: one by one, with their places in the text, where the chunk overlaps others, and in one piece between.

    The last pre-tokens of a view that doesn't end its text are left out, as the cut may have changed them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        coder, match, seen = _coder(path, pattern), regex.compile(pattern).finditer, {}

        def ids(piece: str) -> bytes:
            found = seen.get(piece)
            if found is None:
                if len(seen) >= MEMO:
                    seen.clear()
                found = _packed(coder.encode_ordinary(piece))
                if len(piece) <= 64:
                    seen[piece] = found
            return found

        for batch in batches:
            rows = []
            for key, no, ended, view in batch.itertuples(index=False):
                left, middle, right = ([], []), [], ([], [])
                for m in match(view):
                    if not ended and m.end() > len(view) - LOOKAHEAD:
                        break
                    at = m.start()
                    if overlap <= at < chunk:
                        middle.append(ids(m[0]))
                    else:
                        side = left if at < overlap else right
                        side[0].append(no * chunk + at)
                        side[1].append(ids(m[0]))
                rows.append((key, no, ended, *left, b"".join(middle), *right))
            yield pd.DataFrame(rows, columns=["key", "no", "ended", "left_at", "left_ids", "middle", "right_at", "right_ids"])

    return run


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ids) of each text; ids are null if two neighbours share no boundary. Rows come sorted by text and chunk."""
    text, parts, tail = None, [], ([], [])
    for batch in batches:
        done = []
        for key, no, ended, left_at, left_ids, middle, right_at, right_ids in batch.itertuples(index=False):
            if no == 0:
                text, parts, shared = key, [], 0
            else:
                met = set(left_at).intersection(tail[0])
                shared = min(met) if met else None
            if shared is None or parts is None:
                parts = None
            else:
                parts += [i for at, i in zip(*tail) if at < shared] if no else []
                parts += [i for at, i in zip(left_at, left_ids) if at >= shared]
                parts.append(middle)
            tail = (list(right_at), list(right_ids))
            if ended:
                done.append((text, None if parts is None else b"".join([*parts, *tail[1]])))
                parts, tail = [], ([], [])
        yield pd.DataFrame(done, columns=["key", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` with `ids` (binary: unsigned little-endian 32-bit numbers) in place of the text, as tiktoken's `encode_ordinary` gives them.

    `path` names a file of ranks that every executor can read, `pattern` splits a text into pre-tokens and looks at most LOOKAHEAD
    code points beyond a match, never back. A text of at most `chunk` code points is encoded as it is. A longer one is dealt out in chunks that
    overlap; each is pre-tokenised and encoded by itself, wherever it lies. From a boundary that a chunk shares with the one before it, both
    read alike, so there they are joined. A text in which two neighbours share no boundary (one pre-token longer than the overlap) goes
    again with chunks and overlaps eight times as long, until it is one chunk: no text is left out or cut otherwise.

    Null and empty texts have no ids. Repeated rows each get a row, an empty table an empty result; other columns pass through, but for one called
    `ids`, which is replaced. A task holds the ids of one text at once, and its chunks only of the text it cuts.
    """
    if not LOOKAHEAD < overlap <= chunk:
        raise ValueError("an overlap is longer than the pattern's look-ahead and no longer than a chunk")
    docs = docs.select(*[c for c in docs.columns if c == text_col or c != "ids"])
    size = F.coalesce(F.length(text_col), F.lit(0))
    rest = StructType([*docs.drop(text_col).schema.fields, StructField("ids", BinaryType())])
    short = docs.where(size <= chunk).mapInArrow(_encode_whole(path, pattern, text_col), rest)
    keyed, key = with_row_key(docs.where(size > chunk), id_col)
    name = fresh(keyed, "chunked")
    found, todo = None, keyed.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    left = not todo.isEmpty()
    while left:
        chunks = todo.mapInArrow(_cut_up(chunk, overlap), "key long, no int, ended boolean, view string").repartition("key", "no")
        parts = chunks.mapInPandas(_pre_tokenise(path, pattern, chunk, overlap), _PARTS)
        ids = stored(parts.repartition("key").sortWithinPartitions("key", "no").mapInPandas(_stitch, "key long, ids binary"))
        found = ids.where("ids IS NOT NULL") if found is None else found.union(ids.where("ids IS NOT NULL"))
        failed = ids.where("ids IS NULL").select("key")
        todo, chunk, overlap = merge_join(todo, failed, "key", "left_semi"), chunk * 8, overlap * 8
        left = not failed.isEmpty()
    if found is None:
        return short
    long = merge_join(keyed.drop(text_col), found.select(F.col("key").alias(name), "ids"), F.col(key) == F.col(name)).select(*[f.name for f in rest])
    return short.union(long)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded` (binary): the bytes of its ids in a row, which need not be UTF-8 where ids were changed. Null ids count as none;
    an id without a rank has no bytes if it is below the largest, else it is an error. A column called `decoded` is replaced."""
    kept = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        for batch in batches:
            column = batch.column(ids_col)
            for a, b in _slices([len(x.as_buffer()) if x.is_valid else 0 for x in column]):
                made = pa.array([b"".join(tokens[np.frombuffer(x.as_buffer(), "<u4")]) if x.is_valid else b"" for x in column[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, made], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
