"""Best-fit packing of token pieces into sequences by vector best-fit decreasing.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces go
in falling order of size to that bin, among those with room in every dimension, whose residual after placing has the
least weighted norm (or, by choice, the largest weighted dot-product with the piece); a new bin opens if none has room.
Pieces are dealt at random to groups of about `group_pieces`, each packed by one task: a group wastes about half of its
last bin, a small share that does not grow with the data, and no task ever sees more than a group.

Edge cases: a null or empty text is the closing token alone. Rows with the same doc_id are packed each for itself.
Pieces longer than the token capacity cannot occur; one that breaks another capacity alone gets a bin of its own.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import as_text, saved, small_batches, with_rows

#: Entries of a worker's memo of words.
WORDS = 150_000
#: Texts of these characters alone need no composition and lower letter by letter among themselves, and of them the
#: tokenizer's pattern is PARTS. Capitals whose small letters are no Latin ones of this range are not among them.
_RANGE = {*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x250)}
_OTHER = re.compile(f"[^{''.join(re.escape(chr(c)) for c in sorted(_RANGE) if len(low := chr(c).lower()) == 1 and ord(low) in _RANGE)}]")
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level model has for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


class PartIds(dict):
    """Lower-cased part of a text (a word, a digit or a run of marks) to the bytes of its little-endian 32-bit ids. The
    tokenizer cuts at white space and between parts and no token spans them, so a text's ids are those of its parts one
    after the other. Parts of Latin letters go straight to its BPE model; words of other letters take its whole path and
    are kept under the word with a leading blank."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, part: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        if part[0] == " ":
            got = self.whole(part[1:])
        else:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
            got = array("I", [t.id for t in self.model.tokenize(letters)])
            if sys.byteorder == "big":
                got.byteswap()
            got = got.tobytes()
        self[part] = got
        return got

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special token, which the whole path alone knows
            return self.whole(text)
        if text.isascii() and text.isprintable() or not _OTHER.search(text):
            return b"".join(map(self.__getitem__, PARTS.findall(text.lower())))
        return b"".join(map(self.word, text.encode("utf-8", "replace").split()))

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if _OTHER.search(text):
            return self[" " + text]
        return b"".join(map(self.__getitem__, PARTS.findall(text.lower())))


_worker: dict[str, PartIds] = {}


def worker_memo(path: str) -> PartIds:
    """One memo a Python worker, kept from task to task."""
    if path not in _worker:
        _worker[path] = PartIds(path)
    return _worker[path]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cutter(path: str, capacity: int, end_id: int):
    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        memo = worker_memo(path)
        end = int(end_id).to_bytes(4, "little")
        for row in rows:
            ids = memo.text(row["text"]) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield row["doc_id"], k, at // 4, len(part) // 4, zlib.crc32(part)

    return make


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing id, cut after every `capacity` ids."""
    small_batches(docs.sparkSession)
    make = cutter(tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text")).mapInArrow(with_rows(make, PIECE, flush=20_000), PIECE_DDL)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, cost: float, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must fall."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    full = np.array([1.0, 1.0, 1.0])
    scale = np.array([1.0 / capacity, 1.0 / documents, 1.0 / cost])
    weight = np.array(weights)
    room = np.empty((n, 3))  # shares left of the open bins
    ident = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    opened = made = 0
    slack = 1e-12
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length]) * scale
        at = -1
        if opened:
            left = room[:opened] - need
            fits = np.flatnonzero((left >= -slack).all(axis=1))
            if len(fits):
                score = np.square(left[fits]) @ weight if rule == "norm" else -(room[fits] * need) @ weight
                at = int(fits[np.argmin(score)])
        if at < 0:
            at, ident[opened] = opened, made
            room[opened] = full
            opened, made = opened + 1, made + 1
        b = ident[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        room[at] -= need
        if room[at].min() <= slack:  # full: the last open bin takes its place
            opened -= 1
            room[at], ident[at] = room[opened], ident[opened]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, documents: int | None = None, cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", group_pieces: int = 6000) -> DataFrame:
    """pieces with sequence_id and offset. By default the document-count and cost capacities are those that the token
    capacity implies, so that only tokens bind."""
    limit = documents or capacity
    budget = float(cost or capacity * capacity)
    table = saved(pieces, "pieces")
    groups = max(1, -(-table.count() // group_pieces))
    keyed = table.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, limit, budget, weights, rule)
        return pdf.assign(sequence_id=pdf["pack_group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="pack_group")

    return keyed.groupBy("pack_group").applyInPandas(one, f"{PIECE_DDL}, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
