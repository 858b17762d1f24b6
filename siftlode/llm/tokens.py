"""Encoding a whole corpus with a public byte-level BPE tokenizer.

Method: a distinct-word table. Texts are split into words by the tokenizer's own pattern in Spark tasks (vector
operations on Arrow batches), each distinct word is encoded once, and the ids come back by position.

Plan: documents are hashed into blocks of about ``block_chars`` characters. The distinct (block, word) pairs are
written once; the distinct words among them are encoded in Python (vectorised by partition) and joined back by
word. Each block then meets its own small dictionary in a co-grouped Arrow function, where ids are gathered by
position with vector operations. Only block-sized groups are ever held, the positions of words are never shuffled,
and of the vocabulary only its file, of a fixed size, is sent to the executors. A word in every block (a hot join key)
is split by adaptive skew handling. Decoding is one map: the id-to-piece table, of a fixed size, is joined where the ids
are, in time linear in the text.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlode.llm.textkernel import bpe_words, raw, row_ids, slices
from siftlode.runtime import cut, pieces

def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a vocabulary file; the folder is ``SIFTLODE_TOKENIZERS`` or /opt/tokenizers."""
    return os.path.join(os.environ.get("SIFTLODE_TOKENIZERS", "/opt/tokenizers"), name)


def load_ranks(body: bytes) -> dict[bytes, int]:
    """Piece bytes -> id of the lines of a rank file (one base64 piece and its id a line)."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, body.splitlines()) if piece}


def _encoder(body: bytes):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(body), special_tokens={})


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word) -> (word, ids): every row is encoded on its own, as one piece, without special tokens.

    The vocabulary is read on the driver and sent along, so executors need not have it.
    """
    with open(vocabulary, "rb") as f:
        shared = words.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = _encoder(shared.value)._encode_single_piece
        for batch in batches:
            word = batch.column(0)
            ids = [encode(w.encode("utf-8")) for w in word.to_pylist()]
            yield pa.RecordBatch.from_arrays([word, pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _gather(words: pa.Array, row: np.ndarray, known: pa.Array, ids: pa.ListArray) -> pa.ListArray:
    """Ids of each row's words, in order."""
    at = pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False)
    off = ids.offsets.to_numpy().astype(np.int64)
    start, length = off[:-1][at], np.diff(off)[at]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    take = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends[row], pa.int32()), pa.array(ids.values.to_numpy()[take], pa.int32()))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def block_words(blocked: DataFrame) -> DataFrame:
    """(block, text) -> the words of each batch and block, each once for a batch; a word may recur in other batches."""

    def run(batches):
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = []
            for at, part in slices(batch.column(1)):
                words, row = bpe_words(part)
                coded = words.dictionary_encode()
                n = max(1, len(coded.dictionary))
                pair = np.unique(block[at : at + len(part)][row_ids(row)] * n + coded.indices.to_numpy())
                found.append(pa.table({"block": (pair // n).astype(np.int32), "word": coded.dictionary.take(pa.array(pair % n))}))
            if found:
                yield from pa.concat_tables(found).group_by(["block", "word"]).aggregate([]).to_batches()

    return blocked.select("block", "text").mapInArrow(run, "block int, word string")


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1_500_000) -> DataFrame:
    """One row (id, ids ARRAY<INT>) per document.

    Empty and null texts give an empty array; rows that repeat the same id and text count once; two different texts
    under one id give two rows; an empty table gives an empty table. Only the two named columns are read, so further
    columns of any name do no harm. Strings that spell special tokens are ordinary text.
    """
    vocabulary = vocabulary or default_vocabulary()
    base = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.length("text"))).first()[0] or 0
    blocked = base.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(pieces(total, block_chars))).cast("int"))
    pairs = cut(block_words(blocked).distinct(), "words")
    coded = pairs.join(encode_words(pairs.select("word").distinct(), vocabulary), "word").select("block", "word", "ids")
    out = T.StructType([T.StructField("doc", base.schema["doc"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["doc", "text"]).group_by(["doc", "text"]).aggregate([])
        words, row = bpe_words(_one(left.column("text")))
        if not len(words):
            ids = pa.ListArray.from_arrays(pa.array(row, pa.int32()), pa.array([], pa.int32()))
        else:
            ids = _gather(words, row, _one(right.column("word")), _one(right.column("ids")))
        return pa.table({"doc": left.column("doc"), "ids": ids})

    made = blocked.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(fill, out)
    return made.select(F.col("doc").alias(id_col), "ids")


def piece_table(body: bytes) -> pa.Array:
    """The piece of every id of a vocabulary, by position; one empty piece more stands for ids it lacks."""
    ranks = load_ranks(body)
    pieces = [b""] * (max(ranks.values(), default=-1) + 2)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def decode_corpus(coded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids", block_ids: int = 500_000) -> DataFrame:
    """(id, text): the texts back from ids, by a join of positions with the id-to-piece table.

    The table has a fixed size and goes along with the tasks, where its key is its position: the join is a gather, in
    parts of about ``block_ids`` ids, and no position is shuffled. Each row is decoded for itself. An empty or null
    array gives the empty text, an id that the vocabulary lacks nothing. Bytes that are no UTF-8 become U+FFFD.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(coded.dtypes)[id_col]
    base = coded.select(F.col(id_col).alias("doc"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        pieces = piece_table(shared.value)
        none = len(pieces) - 1
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // block_ids
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(lists)]])) if len(lists) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids = lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids[(ids < 0) | (ids > none)] = none
                ends = pa.array(np.concatenate([[0], np.cumsum(size[a:b])]), pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(ends, pieces.take(pa.array(ids))), b"")
                body, off = raw(joined)
                texts = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts], ["doc", "text"])

    return base.mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", id_col)
