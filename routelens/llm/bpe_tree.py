"""Byte-level BPE by monoid tree reduction.

A text is cut into halves until a leaf is short; a leaf is encoded directly. Two
neighbours are joined by re-encoding a window around the cut that grows, on both
sides, until the tokens outside can't change. They can't where the split pattern
always ends a match: between a letter and what is none, a digit and what is none, and
another mark and what is none (but an apostrophe, which may begin a contraction). Each
alternative of the pattern holds one such class, with at most a blank before it, and looks no
further than the character after a run of blanks; so matches before such a point depend on what
is before it alone, and matches after it on what comes after. Where a window finds no such
point it grows to the whole neighbour: one match then covers it. Decoding joins the bytes of
the tokens up the same kind of tree.

Null texts count as empty: no tokens. Repeated rows give repeated results; a null doc_id stays
null. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, spread, table, texts_of

LEAF_CHARS = 512
RANKS = "byte_bpe_multi_50k.tiktoken"


#: Characters that the pattern's \\s stands for.
_BLANKS = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    """Letter, Number, Space or Other; empty for a character whose class isn't the same in all versions of Unicode since 3.2."""
    if c in _BLANKS:
        return "S"
    kind = unicodedata.category(c)
    if kind == "Cn" or unicodedata.ucd_3_2_0.category(c)[0] != kind[0]:
        return ""
    return kind[0] if kind[0] in "LN" else "O"


def _sync(text: str, i: int) -> bool:
    """A match of the pattern ends, and another begins, at position i, whatever stands around."""
    before, after = _class(text[i - 1]), _class(text[i])
    return bool(before) and bool(after) and before != after and before != "S" and not (text[i - 1] == "'" and after == "L")


class TreeBPE:
    """Encoder and decoder over one file of ranks."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf_chars = max(1, leaf_chars)
        self.leaf = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.name_of = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        cut = len(text) // 2
        return self.join(text, cut, self.encode(text[:cut]), self.encode(text[cut:]))

    def join(self, text: str, cut: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of ``text`` from those of its two parts."""
        a, b = cut, cut
        while a > 0 and not _sync(text, a):
            a -= 1
        while b < len(text) and not _sync(text, b):
            b += 1
        i, j = len(left), 0
        away = len(text[a:cut].encode())
        while away > 0:
            i -= 1
            away -= len(self.bytes_of[left[i]])
        more = len(text[cut:b].encode())
        while more > 0:
            more -= len(self.bytes_of[right[j]])
            j += 1
        if away or more:
            raise AssertionError("a sync point inside a token")
        return left[:i] + self.leaf(text[a:b]) + right[j:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4 * self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


@lru_cache(maxsize=4)
def tokenizer(path: str, leaf_chars: int = LEAF_CHARS) -> TreeBPE:
    """One per worker process and file."""
    return TreeBPE(path, leaf_chars)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                ids = [bpe.encode(t) for t in texts_of(own["text"])]
                yield pa.RecordBatch.from_arrays([own["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            counts, names, decoded = [], [], []
            for text in texts_of(batch["text"]):
                ids = bpe.encode(text)
                counts.append(len(ids))
                names.append(hashlib.sha256(",".join(map(bpe.name_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every whole document, encoded and decoded."""
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
