"""Toxicity by Levenshtein automata over a lexicon trie and context windows.

The lexicon is learned: words that are many times likelier in labelled toxic texts than in others, and stems, beginnings that
several such words share. Its trie and the Levenshtein automaton of the words read are walked together as one automaton
over (trie node, errors), where two letters that have changed places are one error; its state sets
are made on demand and remembered, so a word costs a few look-ups and most words leave the trie after two letters. Digits
that stand for letters are read as these, and a letter said three times or more as one; what matches only so is misspelled. Each
match is weighed by its context window: quotation marks around it and reporting words near it tell quotation from
abuse. A logistic regression over these counts gives the score.

Edge cases: null and empty texts have no matches and get the score of no matches. Without toxic and other labelled rows
to learn from every score is 0. Labels of unknown documents are ignored; of repeated labels the largest counts.
Repeated rows each get a row, an empty table gives an empty result, and columns of any names but the score's pass. Texts
and words of any length are read whole, in time linear in their length; a match of equally near terms counts for the first
in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import MEMO, as_text, small_batches, with_rows

#: At most about so many labelled rows are used to learn lexicon and weights.
SAMPLE = 20_000
WORD = re.compile(r"[^\W_]+")
#: Digits as letters; letters that are repeated for emphasis; fixed values.
DIGITS, REPEATED = str.maketrans("0134578", "oieastb"), re.compile(r"(.)\1{2,}")
#: Letters of a stem at least and at most.
STEMS = (4, 8)
QUOTE, LINE_END = re.compile("[\"“”„«»]"), re.compile("\n")
#: Reporting words near a match that mark a quotation; fixed values.
REPORTING = frozenset("said says say wrote writes called quote quoted quotes according reported claimed alleged dit disait écrit selon sagte schrieb laut zitiert nannte dijo escribió según llamó".split())
FEATURES = ("exact", "misspelled", "quoted", "distinct", "weight", "share")


class Trie:
    """Words within one edit of a lexicon term, or that begin with a stem (a term that ends in a star). State sets hold (node,
    errors, letter to come) triples; the letter is that of a pair that has changed places, else empty. Transitions are
    remembered."""

    def __init__(self, terms: dict[str, float], errors: int = 1, shortest_fuzzy: int = 4):
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.lengths = sorted({len(t) for t in self.stems}, reverse=True)
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.errors = errors
        self.weight = terms
        for word in terms:
            if word.endswith("*"):
                continue
            node = 0
            for letter in word:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][letter]
            self.term[node] = word
        self.shortest_fuzzy = shortest_fuzzy
        self.sets: dict[frozenset, int] = {}
        self.made: list[tuple[frozenset, dict[str, int]]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.memo: dict[str, tuple[str, int] | None] = {}
        self.start = self.state(self.closed({(0, 0, "")}))

    def closed(self, triples: set[tuple[int, int, str]]) -> frozenset:
        """With the letters of a term that the word may lack; of a node only the fewest errors are kept."""
        least: dict[tuple[int, str], int] = {}
        todo = list(triples)
        while todo:
            node, e, due = todo.pop()
            if least.get((node, due), self.errors + 1) <= e:
                continue
            least[node, due] = e
            if e < self.errors and not due:
                todo += [(child, e + 1, "") for child in self.children[node].values()]
        return frozenset((node, e, due) for (node, due), e in least.items())

    def state(self, triples: frozenset) -> int:
        if triples not in self.sets:
            self.sets[triples] = len(self.made)
            self.made.append((triples, {}))
            hits = sorted((e, self.term[n]) for n, e, due in triples if not due and self.term[n] and (not e or len(self.term[n]) >= self.shortest_fuzzy))
            self.accepts.append((hits[0][1], hits[0][0]) if hits else None)
        return self.sets[triples]

    def step(self, state: int, letter: str) -> int:
        triples, known = self.made[state]
        after = set()
        for node, e, due in triples:
            if due:
                if due == letter:
                    after.add((node, e, ""))
                continue
            for read, child in self.children[node].items():
                if read == letter:
                    after.add((child, e, ""))
                elif e < self.errors:
                    after.add((child, e + 1, ""))
                    if letter in self.children[child]:  # this letter came first, the other is due
                        after.add((self.children[child][letter], e + 1, read))
            if e < self.errors:
                after.add((node, e + 1, ""))
        known[letter] = got = self.state(self.closed(after))
        return got

    def walk(self, word: str) -> tuple[str, int] | None:
        state = self.start
        made = self.made
        for letter in word:
            after = made[state][1].get(letter)
            state = self.step(state, letter) if after is None else after
            if not made[state][0]:
                break
        return self.accepts[state]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, or None."""
        try:
            return self.memo[word]
        except KeyError:
            pass
        if len(self.memo) >= MEMO:
            self.memo.clear()
        got = self.memo[word] = self.found(word)
        return got

    def found(self, word: str) -> tuple[str, int] | None:
        plain = word if word.isalpha() else word.translate(DIGITS)
        if not plain.isalpha() or word.isdigit():
            return None
        hit = self.walk(plain)
        if not hit or hit[1]:
            stem = next((plain[:k] for k in self.lengths if plain[:k] in self.stems), None) if self.lengths else None
            if stem:
                hit = stem + "*", 0
        if (not hit or hit[1]) and REPEATED.search(plain):
            again = self.walk(REPEATED.sub(r"\1", plain)) or hit
            hit = again and (again[0], max(1, again[1]))
        return hit and (hit[0], max(1, hit[1])) if plain != word else hit


def before(low: str, start: int, line: int, window: int) -> list[str]:
    """The last `window` words of the line before start."""
    reach = 16 * window
    while True:
        at = max(line, start - reach)
        words = WORD.findall(low[at:start])
        if at == line or len(words) > window:  # the first one may be cut
            return words[-window:]
        reach *= 2


def features(text: str, trie: Trie, window: int = 8) -> list[float]:
    """In the order of FEATURES. Line ends and quotation marks are counted once, so time is linear in the text."""
    low = text.lower()
    found, words = [], 0
    memo = trie.memo
    for m in WORD.finditer(low):
        words += 1
        word = m[0]
        hit = memo[word] if word in memo else trie.match(word)
        if hit:
            found.append((m.start(), m.end(), *hit))
    if not found:
        return [0.0] * len(FEATURES)
    lines = [m.start() for m in LINE_END.finditer(low)]
    marks = [m.start() for m in QUOTE.finditer(low)]
    exact = misspelled = quoted = 0
    for start, end, _, errors in found:
        k = bisect_left(lines, start)
        line, line_end = lines[k - 1] + 1 if k else 0, lines[k] if k < len(lines) else len(low)
        opened = bisect_left(marks, start)
        inside = (opened - bisect_left(marks, line)) % 2 == 1 and opened < len(marks) and marks[opened] < line_end
        after = (m[0] for m in islice(WORD.finditer(low, end, line_end), window))
        if inside or not REPORTING.isdisjoint(before(low, start, line, window)) or not REPORTING.isdisjoint(after):
            quoted += 1
        elif errors:
            misspelled += 1
        else:
            exact += 1
    terms = {t for _, _, t, errors in found if not errors}
    weight = sum(min(4.0, trie.weight[t]) for t in terms)
    return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(len(terms)), weight / 4, min(1.0, 20 * len(found) / words)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression with intercept (last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of labelled rows that aren't held out: all, or by a hash of doc_id about `sample` of them."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > sample:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # Bounded by `sample`: ids and labels of that many rows.
    return docs.select("doc_id", as_text("text").alias("text")).join(F.broadcast(own), "doc_id").select("text", "toxic")


def learn_lexicon(rows: DataFrame, least_lift: float = 5.0, least_evidence: float = 24.0) -> dict[str, float]:
    """Words `least_lift` times likelier in toxic texts than in others, with a log-likelihood ratio of the counts of at
    least `least_evidence`, and the logarithms of their lifts. Copies of a text count once: texts are grouped by the
    smallest of three hashes of their words. The rows are a bounded sample, and so is what can pass."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), 1))
    family = F.struct(*[F.expr(f"array_min(transform(split(text, '[ \\n]+'), w -> xxhash64(w, {k})))").alias(f"h{k}") for k in range(3)])
    families = rows.select(words.alias("words"), "toxic", family.alias("family"))
    totals = {r["toxic"]: r["n"] for r in families.groupBy("toxic").agg(F.count_distinct("family").alias("n")).collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return {}
    once = families.select(F.explode("words").alias("word"), "toxic", "family").distinct()
    a, b = F.col("a"), F.col("b")
    n, expected = a + b, (a + b) * toxic / (toxic + other)
    part = lambda seen, hoped: F.when(seen > 0, seen * F.log(seen / hoped)).otherwise(0.0)
    evidence = 2 * (part(a, expected) + part(b, n - expected))
    lift = (a + 0.5) / (toxic + 1) / ((b + 0.5) / (other + 1))
    counted = lambda rows: rows.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).withColumn("lift", lift)
    telling = lambda counts: counts.filter((F.col("lift") >= least_lift) & (evidence >= least_evidence))
    beginnings = F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.length("word") - 1, F.lit(STEMS[1]))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    longer = lambda rows, *more: rows.filter(F.length("word") > STEMS[0]).select(F.explode(beginnings).alias("word"), *more)
    counts = counted(once)
    kept = telling(counts).collect()
    # A stem has four telling words at least, so it is rarely a chance of one of them.
    several = longer(telling(counts)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("word")
    stems = telling(counted(longer(once, "toxic", "family").join(F.broadcast(several), "word").distinct())).collect()  # no more than the telling words' beginnings
    terms = {r["word"]: math.log(r["lift"]) for r in sorted(kept, key=lambda r: r["word"])}
    for r in sorted(stems, key=lambda r: (len(r["word"]), r["word"])):
        if not any(r["word"].startswith(t[:-1]) for t in terms if t.endswith("*")):
            terms[r["word"] + "*"] = math.log(r["lift"])
    return terms


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Lexicon and weights; no more than about `sample` rows of counts come to the driver."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, sample)
    terms = learn_lexicon(rows)
    if not terms:
        return {}, []

    def make(stream: Iterator[dict]) -> Iterator[tuple]:
        trie = Trie(terms)
        for row in stream:
            yield (*features(row["text"], trie), float(row["toxic"]))

    schema = pa.schema([(f, pa.float64()) for f in (*FEATURES, "toxic")])
    table = rows.mapInArrow(with_rows(make, schema), ", ".join(f"{f} double" for f in (*FEATURES, "toxic"))).toPandas().to_numpy()
    table = table[np.lexsort(table.T)]
    return terms, fit(table[:, :-1], table[:, -1]).tolist()


def scorer(terms: dict[str, float], weights: list[float]):
    """The score of a text column, made in Arrow batches in the scan's own stage."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(terms)
        for texts in batches:
            yield pd.Series([probability(features(t, trie), weights) if t and weights else probability([], weights) for t in texts], dtype="float64")

    return score


def probability(x: list[float], weights: list[float]) -> float:
    if not weights:
        return 0.0
    z = weights[-1] + sum(w * v for w, v in zip(weights, x, strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, labels: DataFrame, column: str = "score", sample: int = SAMPLE) -> DataFrame:
    """docs with the score of every whole text in one more column."""
    small_batches(docs.sparkSession)
    terms, weights = model(docs, labels, sample)
    return docs.withColumn(column, scorer(terms, weights)(as_text("text")))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    got = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "score", sample)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
