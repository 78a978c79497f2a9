"""Alignment of the tokens of two tokenizers by the byte ranges that they cover.

The ends of both tokenizers' tokens, as byte offsets, cut a text into elementary intervals (the union of both arrays of ends);
in each, one token of either side is the owner, found by searching the interval's end in the ends, so each interval is one
overlap. Ends that both sides share close groups; within a group every token of one side is linked with every one of the
other, so its links are the product of its sides, expanded by id. How many documents of the corpus hold a pair of
ids linked is counted once for all, and the counts come back to the links.

Neither tokenizer joins what stands before a blank or a line break that follows another sign with what comes after, nor a
Latin word with the mark behind it (the first cuts there by its pattern; that no piece of the second reaches across is
looked up in its vocabulary). Both end a token there, so groups end there too, and the chunks between such places are
tokenized and aligned once and kept in a memo. All new chunks of a batch are tokenized one behind the other and aligned in
the same few array operations.

Texts are tokenized in one pass, whose distinct pairs per document are written. The counts of the FREQUENT pairs that most
documents hold are looked up in a broadcast; pairs that are rarer are joined with the table of counts. What is shuffled
are sums per pair and rare pairs.

Edge cases: texts that are null, empty, or whose pieces don't give back the text (one with the blank's own sign U+2581)
have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Every row is a document of its own,
also with equal or null ids; ties for an A id's highest count are all best. Chunks of any length are worked on whole. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from operator import mul

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import as_text, saved, small_batches, with_rows
from tallyloom.llm.packing import byte_letters
from tallyloom.llm.weighing import commonest, with_rest

#: Pairs that are broadcast with their counts at most: 3 MB.
FREQUENT = 1 << 17
#: Chunks of a worker's memo, and the longest that it keeps, in characters.
CHUNKS, KEPT_CHUNK = 160_000, 100
#: Documents whose pairs, and whose results, make one file.
DOCS_PER_FILE = 20_000
#: Links of a group that are expanded at once; those of larger groups are counted by id on either side first.
EXPANDED = 1 << 12
#: An id pair is one number, first id * PAIR + second id.
PAIR = 1 << 20
BLANK = "▁"
#: Letters of Latin words, and marks before which a word may be cut if no piece of the second tokenizer holds both.
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ",.;:!?*%$#&)\""

#: Of a chunk: numbers of tokens on both sides, groups and links; the groups as text; distinct id pairs and how often each
#: is linked, None for once.
Aligned = tuple[int, int, int, int, str, np.ndarray, np.ndarray | None]


class Aligner:
    """Chunks to Aligned, or None where the pieces don't give a chunk back, with a memo of two generations: what was not asked
    for while the younger one filled up is forgotten."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        moved = byte_letters()
        back = {ord(moved.get(b, chr(b))): b for b in range(256)}
        self.bytes_a = {i: bytes(t.translate(back), "latin-1") for t, i in self.a.get_vocab().items() if all(ord(c) in back for c in t)}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.ranked = self._ranks(path_a)
        self.words_a, self.words_b = ([str(i) for i in range(n)] for n in (max(self.bytes_a) + 1, len(self.bytes_b)))
        pieces = [p for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size()))) if not self.b.is_byte(i) and not self.b.is_control(i)]
        reaches = lambda before, sign: any(re.search(f"{before}{re.escape(sign)}", p) for p in pieces)
        if reaches(f"[^{BLANK}]", BLANK):
            raise ValueError("a piece of the second tokenizer reaches across a blank")
        spaces = " " if reaches("", "\n") else " \n"
        marks = "".join(m for m in MARKS if not reaches(f"[{LATIN}]", m))
        self.long_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.long_a[i] = len(x)
        self.long_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}
        self.cut = re.compile(rf"(?<=\S)(?=[{spaces}])" + (rf"|(?<=[{LATIN}])(?=[{re.escape(marks)}])" if marks else ""))
        self.led = len(self.b.encode("x"))

    def _ranks(self, path: str):
        """The first tokenizer by its ranks, which is faster on short chunks, if its merges are in order of their ids and it cuts by the
        pattern that ranks go with; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        whole = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not told["normalizer"]
        if not whole or any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        special = {t["content"] for t in told["added_tokens"]}
        return tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes_a[i]: i for t, i in vocabulary.items() if t not in special}, special_tokens={}).encode_ordinary

    def chunks(self, text: str) -> list[str]:
        """The text behind the blank that both tokenizers see, cut where both end a token."""
        return self.cut.split(" " + text)

    def learn(self, chunks: set[str]) -> dict[str, Aligned | None]:
        """All of the chunks; those that the memo lacks are aligned together."""
        found, new = {}, []
        young, old = self.young, self.old
        for c in chunks:
            if c in young:
                found[c] = young[c]
            elif c in old:
                found[c] = young[c] = old[c]
            else:
                new.append(c)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for c, x in zip(part, self.align(part), strict=True):
                found[c] = x
                if len(c) <= KEPT_CHUNK:
                    young[c] = x
        if len(young) >= CHUNKS // 2:
            self.young, self.old = {}, young
        return found

    def tokens(self, whole: str, short: bool) -> tuple[list[int], list[int]]:
        """Ids of one or more chunks on end. The second tokenizer gets a word in front that takes the blank it adds. The merges by
        ranks take time that is quadratic in a chunk, so they are for short ones."""
        a = self.ranked(whole) if short and self.ranked else self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        return a, self.b.encode("x" + whole, num_threads=1)[self.led :]

    def align(self, chunks: list[str], at_once: int = 1000) -> list[Aligned | None]:
        """Aligned of each chunk, which must not be empty. Those that begin with white space and end otherwise and aren't very long, nearly all, are
        tokenized one behind the other: where they meet, both tokenizers cut."""
        plain = [c for c in chunks if c[0] in " \n" and not c[-1].isspace() and len(c) <= KEPT_CHUNK]
        out = [x for k in range(0, len(plain), at_once) for x in self._aligned(plain[k : k + at_once])]
        if len(plain) == len(chunks):
            return out
        known = dict(zip(plain, out, strict=True))
        return [known[c] if c in known else self._aligned([c])[0] for c in chunks]

    def _aligned(self, chunks: list[str]) -> list[Aligned | None]:
        raw = [c.encode("utf-8", "replace") for c in chunks]
        whole = b"".join(raw)
        ids_a, ids_b = self.tokens("".join(chunks), max(map(len, chunks)) <= KEPT_CHUNK)
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole or b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole:
            if len(chunks) == 1:
                return [None]
            half = len(chunks) // 2  # a chunk that is not given back is rare: halves find it
            return self._aligned(chunks[:half]) + self._aligned(chunks[half:])
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        # Elementary intervals of all chunks on end; a chunk's end is shared, so that none reaches across.
        ends = np.union1d(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closes = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
        to_a, to_b = owner_a[closes] + 1, owner_b[closes] + 1  # tokens up to the end of each group
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        n_b = to_b - from_b
        links = (to_a - from_a) * n_b
        # Group products, expanded: the k-th link of a group has token k // n_b of one side and k % n_b of the other.
        some = np.where(links <= EXPANDED, links, 0)
        stops = np.cumsum(some)
        group = np.repeat(np.arange(len(links)), some)
        k = np.arange(len(group)) - (stops - some)[group]
        expanded = a[from_a[group] + k // n_b[group]] * PAIR + b[from_b[group] + k % n_b[group]]
        keys = expanded.tolist()
        # Groups, tokens, links and expanded links up to the end of each chunk.
        last = np.searchsorted(ends[closes], np.cumsum([len(x) for x in raw])) + 1
        up_to = np.stack([last, to_a[last - 1], to_b[last - 1], np.cumsum(links)[last - 1], stops[last - 1]])
        counts = np.diff(up_to, axis=1, prepend=0)[1:4].tolist()
        text_a, text_b = [self.words_a[i] for i in ids_a], [self.words_b[i] for i in ids_b]
        spans = list(zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist(), strict=True))
        texts = [(text_a[i] if j - i == 1 else ",".join(text_a[i:j])) + "|" + (text_b[m] if n - m == 1 else ",".join(text_b[m:n])) for i, j, m, n in spans]
        out: list[Aligned | None] = []
        first = begin = 0
        for end, stop, tokens_a, tokens_b, n_links in zip(up_to[0].tolist(), up_to[4].tolist(), *counts, strict=True):
            if stop - begin == n_links and (n_links == 1 or len(set(keys[begin:stop])) == n_links):
                pairs, times = expanded[begin:stop], None
            else:
                count = Counter(keys[begin:stop])
                for i, j, m, n in spans[first:end]:
                    if (j - i) * (n - m) > EXPANDED:
                        right = Counter(ids_b[m:n]).items()
                        for x, p in Counter(ids_a[i:j]).items():
                            for y, q in right:
                                count[x * PAIR + y] += p * q
                pairs, times = np.fromiter(count, np.int64), np.fromiter(count.values(), np.int64)
            out.append((tokens_a, tokens_b, end - first, n_links, ";".join(texts[first:end]), pairs, times))
            first, begin = end, stop
        return out

    def texts(self, rows: Iterator[dict], at_once: int = 256, letters: int = 1 << 20) -> Iterator[tuple[dict, list[str], Counter[str], dict[str, Aligned | None]]]:
        """Each row with its chunks in order, how often it has each, and what they are. Rows are taken some at a time, bounded by
        number and by length, so that their new chunks are aligned together. A text without tokens has no chunks."""

        def told(held):
            found = self.learn(set().union(*[often for _, _, often in held]))
            bad = {c for c, x in found.items() if x is None}
            for row, chunks, often in held:
                yield (row, [], Counter(), found) if bad and not bad.isdisjoint(often) else (row, chunks, often, found)

        held, size = [], 0
        for row in rows:
            text = row["text"]
            chunks = self.chunks(text) if text else []
            held.append((row, chunks, Counter(chunks)))
            size += len(text)
            if len(held) >= at_once or size >= letters:
                yield from told(held)
                held, size = [], 0
        yield from told(held)


_worker: dict[tuple[str, str], Aligner] = {}


def worker_memo(paths: tuple[str, str]) -> Aligner:
    """One memo a Python worker, kept from task to task."""
    if paths not in _worker:
        _worker[paths] = Aligner(*paths)
    return _worker[paths]


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text"))


def groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id and groups, an array in order of the text: first and last byte offset (the blank in front has offset 0), ids of
    either side."""
    small_batches(docs.sparkSession)
    paths = _paths(a, b)

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        aligner = worker_memo(paths)
        for row, chunks, _, known in aligner.texts(rows):
            out, at = [], 0
            for c in chunks:
                for group in known[c][4].split(";"):
                    left, right = ([int(x) for x in side.split(",")] for side in group.split("|"))
                    end = at + sum(len(aligner.bytes_a[i]) for i in left)
                    out.append({"start": at, "end": end, "a": left, "b": right})
                    at = end
            yield row["doc_id"], out

    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(group))])
    return _columns(docs).mapInArrow(with_rows(make, schema, flush=100), "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def linked(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct id pairs of every document (pairs, in order) with how
    often each is linked (times)."""
    small_batches(docs.sparkSession)
    paths = _paths(a, b)

    def make(rows: Iterator[dict]) -> Iterator[tuple]:
        for row, chunks, often, known in worker_memo(paths).texts(rows):
            own, n = [known[c] for c in often], list(often.values())
            columns = list(zip(*own, strict=True)) or [()] * 7
            pairs = np.concatenate(columns[5]) if own else np.empty(0, np.int64)
            sizes = list(map(len, columns[5]))
            times = np.repeat(np.array(n, np.int64), sizes)
            begins = [0, *np.cumsum(sizes).tolist()]
            for k, more in enumerate(columns[6]):
                if more is not None:
                    times[begins[k] : begins[k + 1]] *= more
            distinct, at = np.unique(pairs, return_inverse=True)
            digest = hashlib.sha256()
            for k in range(0, len(chunks), 5000):
                digest.update((";" * bool(k) + ";".join([known[c][4] for c in chunks[k : k + 5000]])).encode())
            totals = [sum(map(mul, x, n)) for x in columns[:4]]
            yield row["doc_id"], *totals, digest.hexdigest() if chunks else "", distinct, np.bincount(at, times.astype(float), len(distinct)).astype(np.int64)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
    ddl = ", ".join(f"{n} long" for n in names) + ", groups_sha256 string, pairs array<long>, times array<long>"
    return _columns(docs).mapInArrow(with_rows(make, schema, flush=500), ddl)


def _files(links: DataFrame) -> int:
    """How many files hold a small number of values per document."""
    return max(4, links.count() // DOCS_PER_FILE)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, a, n_docs, is_best: how many documents hold an id pair linked, and whether that is its first id's highest count,
    from linked(). The highest counts are as many rows as the first vocabulary at most."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("a", F.floor(F.col("pair") / PAIR))
    counts = saved(counts.coalesce(_files(links)), "pairs")
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counts.join(F.broadcast(highest), "a").select("pair", "a", "n_docs", (F.col("n_docs") == F.col("_most")).alias("is_best"))


def _looked_up(links: DataFrame, frequent) -> DataFrame:
    """links with n_best and count_sum over the frequent pairs and, in place of pairs and times, those of the others. frequent: a
    broadcast of sorted pairs, their counts and whether each is its first id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = frequent.value
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys, times = (column[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            sizes = np.array([len(x) if x is not None else 0 for x in column["pairs"]], np.int64) if len(batch) else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
            for out, value in zip(sums, (best, counts), strict=True):
                np.add.at(out, owner[known], times[known] * value[at[known]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~known], minlength=len(sizes)))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([column[c] for c in others] + [pa.array(x) for x in sums] + rest, names=[*others, "n_best", "count_sum", "rest_keys", "rest_n"])

    others = [c for c in links.columns if c not in ("pairs", "times")]
    kinds = dict(links.dtypes)
    return links.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", n_best long, count_sum long, rest_keys array<long>, rest_n array<long>")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    # Written, so that texts are tokenized once and the number of a row stays the same whatever is computed again.
    links = saved(linked(docs, a, b).withColumn("row", F.monotonically_increasing_id()), "linked")
    counts = pair_counts(links).select("pair", F.col("n_docs").alias("count_sum"), F.col("is_best").cast("long").alias("n_best"))
    top = commonest(counts, "count_sum", frequent).toPandas().sort_values("pair")
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy(np.int64) for c in ("pair", "count_sum", "n_best")))
    out = with_rest(_looked_up(links, known), counts, "pair", ["n_best", "count_sum"])
    return out.coalesce(_files(links)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
