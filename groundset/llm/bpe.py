"""BPE encoding and decoding through a table of distinct words."""

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import stored

#: Words of the distinct-word table that are broadcast, at most, and the characters of such a word; words that a task remembers besides.
BROADCAST_WORDS, BROADCAST_CHARS, TASK_WORDS = 1 << 17, 64, 3 << 16
#: Words are cut at ASCII white space only; other white space stays inside a word, where the tokenizer drops it.
_WORD = re.compile(r"[^ \t-\r]+")
_BATCH = 4096
#: Characters of text whose ids are held at once, beyond one text.
SLICE_CHARS = 1_000_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads cost a third more CPU time
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _encode_words(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                part = batch.iloc[at : at + _BATCH]
                yield part.assign(ids=[e.ids for e in tok.encode_batch(part["word"].tolist(), add_special_tokens=False)])

    return run


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word of all texts with its number of occurrences."""
    words = docs.select(F.explode(F.split(F.col(text_col), r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The words of at least some frequency, the lowest for which they are no more than `most`. Frequencies are counted in steps
    of an eighth of a power of two, so no task and not the driver sees more than a few hundred rows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in bins:
        total += n
        if total > most:
            break
        least = at
    return words.where(step >= least) if least is not None else words.limit(0)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """`docs` with `ids` (array<int>) and `decoded`, as the tokenizer at `path` encodes and decodes the whole text.

    White space always ends a token and is dropped, so a text's ids are its words' ids in a row. The distinct words
    of the corpus are counted by a shuffle that combines on the map side; the most frequent ones, at most `broadcast_words`, are encoded
    once, as a table of bounded size that every task joins by word. A word beyond them is encoded at its first
    sight in a task. Decoding joins each id with its piece and puts spaces between pieces, as the tokenizer does,
    which has no decoder; special tokens are kept.

    Null and empty texts give no ids and an empty string. Texts are encoded whole, one at a time. Words of equal frequency are
    broadcast together or not at all, which changes no id. Repeated rows each get a row; an empty table gives an empty result.
    `path` must name a file that every executor can read. Columns called `ids` or `decoded` are replaced.
    """
    words = stored(word_counts(docs, text_col).where(F.length("word") <= BROADCAST_CHARS))
    frequent = frequent_words(words, broadcast_words).mapInPandas(_encode_words(path), "word string, n long, ids array<int>").select("word", "ids").toArrow()  # at most broadcast_words rows
    ids = frequent["ids"].combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((frequent["word"].combine_chunks(), ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]))
    kept = docs.drop("ids", "decoded")
    return kept.mapInArrow(_encode_texts(path, shared, text_col), StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def _encode_texts(path: str, shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        piece = np.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))], object)
        names, flat, ends = shared.value
        table = {w.as_py(): flat[a:b].astype(np.int32).tobytes() for w, a, b in zip(names, ends[:-1], ends[1:])}  # a word's ids, packed
        fixed = len(table)
        for batch in batches:
            # a batch of long texts is worked on in slices, so that memory follows the texts' size
            column, start = batch.column(text_col), 0
            while start < batch.num_rows:
                encoded, sizes, decoded, chars, at = [], [], [], 0, start
                while at < batch.num_rows and chars < SLICE_CHARS:
                    text = column[at].as_py() or ""
                    chars, at = chars + len(text) + 1, at + 1
                    words = _WORD.findall(text)
                    new = list({w for w in words if w not in table})
                    if new:
                        if len(table) + len(new) > fixed + TASK_WORDS:
                            for w in list(islice(table, fixed, None)):  # those of the task, which came after the broadcast ones
                                del table[w]
                            new = list({w for w in words if w not in table})
                        for i in range(0, len(new), _BATCH):
                            part = new[i : i + _BATCH]
                            table.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)))
                    encoded.append(b"".join([table[w] for w in words]))
                    decoded.append(" ".join(piece[np.frombuffer(encoded[-1], np.int32)].tolist()))
                    sizes.append(len(encoded[-1]) // 4)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), np.int32)))
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(decoded, pa.string())], names=[*part.schema.names, "ids", "decoded"])
                start = at

    return run
