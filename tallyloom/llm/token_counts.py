"""Token counts of documents by counting every distinct pre-token once.

The tokenizer lower-cases and composes a text, cuts it into pre-tokens (words, digits, runs of marks) and merges the letters
of each by itself, so a document's count is the sum over its pre-tokens of their pieces. Pre-tokens are cut in tasks, Latin
texts by one pattern, words of other letters by the tokenizer with a memo; how many texts hold each is summed before the shuffle; the
pieces of each distinct pre-token are counted once, by the tokenizer's own model; and the numbers come back to the
documents: those of the FREQUENT commonest pre-tokens (of 64 bytes at most) in a broadcast, those of others by a join of
the documents' frequencies with the table. No list of ids is made.

Edge cases: a null or empty text, or one of white space, has no tokens. Strings of special tokens in a text count as one token,
as the library has it by default. Words of any length are worked on whole. Rows with equal ids, or equal altogether, each
give a row, a null id stays null; an empty table gives an empty result; other columns are ignored, whatever their names.
There are no ties to break in the result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import MEMO, as_text, saved, small_batches, with_rows
from tallyloom.llm.packing import _OTHER, PARTS, byte_letters
from tallyloom.llm.weighing import commonest, counted, with_rest

#: Pre-tokens that are broadcast with their pieces at most, and the bytes of each at most.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
#: Longest word in bytes that a worker keeps in its memo.
KEPT_WORD = 100
_LETTERS = byte_letters()


def letters(part: str) -> str:
    """A pre-token in the letters of the byte-level alphabet."""
    return part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_LETTERS)


class PreTokens(dict):
    """A word (what stands between white space of ASCII) to its pre-tokens, in the letters of the byte-level alphabet.
    Composition, lower case and the pattern never reach across such white space, so words can be taken one by one. A
    special token in the word is an entry of its own that begins with a blank, which no pre-token does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(f"({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})") if names else None

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = []
        for k, part in enumerate(self.special.split(word) if self.special else [word]):
            if k % 2:
                out.append(" " + part)
            else:
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))]
        if len(word) <= KEPT_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = tuple(out)
        return tuple(out)

    def of(self, text: str) -> Counter[str]:
        """How often the text holds each pre-token."""
        marked = "<|" in text  # may hold a special token
        simple = text.isascii() and text.isprintable()
        if not marked and (simple or not _OTHER.search(text)):
            found = Counter(PARTS.findall(text.lower()))
            if simple:
                return found
            return Counter({letters(p): n for p, n in found.items()})
        out: Counter[str] = Counter()
        for raw, n in Counter(text.encode("utf-8", "replace").split()).items():
            word = raw.decode()
            if marked and "<|" in word or _OTHER.search(word):
                for p in self[word]:
                    out[p] += n
            else:
                for p in PARTS.findall(word.lower()):
                    out[letters(p)] += n
        return out

    def pieces(self, token: str) -> int:
        return 1 if token[0] == " " else len(self.tokenizer.model.tokenize(token))


_worker: dict[str, PreTokens] = {}


def worker_memo(path: str) -> PreTokens:
    """One memo a Python worker, kept from task to task."""
    if path not in _worker:
        _worker[path] = PreTokens(path)
    return _worker[path]


def pre_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """token, n_texts: every distinct pre-token of the texts with how many texts hold it."""

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        memo = worker_memo(tokenizer)
        return counted((memo.of(row["text"]).keys(), len(row["text"])) for row in rows)

    schema = pa.schema([("token", pa.string()), ("n_texts", pa.int64())])
    found = docs.select(as_text("text").alias("text")).mapInArrow(with_rows(make, schema, flush=20_000), "token string, n_texts long")
    return found.groupBy("token").agg(F.sum("n_texts").alias("n_texts"))


def piece_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """token, n_texts, n_tokens: pre_tokens() with the pieces of each, counted once."""

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        memo = worker_memo(tokenizer)
        for row in rows:
            yield row["token"], row["n_texts"], memo.pieces(row["token"])

    schema = pa.schema([("token", pa.string()), ("n_texts", pa.int64()), ("n_tokens", pa.int64())])
    return pre_tokens(docs, tokenizer).mapInArrow(with_rows(make, schema, flush=20_000), "token string, n_texts long, n_tokens long")


def frequencies(docs: DataFrame, tokenizer: str, frequent) -> DataFrame:
    """doc_id, n_bytes, n_tokens (of the frequent pre-tokens) and the frequencies of the others (rest_keys, rest_n), per document. frequent:
    a broadcast from pre-token to pieces."""

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        memo, known = worker_memo(tokenizer), frequent.value
        for row in rows:
            text = row["text"]
            total, keys, times = 0, [], []
            for p, n in memo.of(text).items():
                if p in known:
                    total += n * known[p]
                else:
                    keys.append(p)
                    times.append(n)
            yield row["doc_id"], len(text) if text.isascii() else len(text.encode("utf-8", "replace")), total, keys, times

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("rest_keys", pa.list_(pa.string())), ("rest_n", pa.list_(pa.int64()))])
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text"))
    return columns.mapInArrow(with_rows(make, schema, flush=500), "doc_id long, n_bytes long, n_tokens long, rest_keys array<string>, rest_n array<long>")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = saved(piece_counts(docs, path), "pieces")
    top = commonest(pieces.filter(F.octet_length("token") <= FREQUENT_BYTES), "n_texts", frequent).select("token", "n_tokens").collect()
    known = spark.sparkContext.broadcast({r["token"]: r["n_tokens"] for r in top})
    # Written, so that the number of a row stays the same whatever is computed again.
    rows = saved(frequencies(docs, path, known).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    out = with_rest(rows, pieces, "token", ["n_tokens"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
