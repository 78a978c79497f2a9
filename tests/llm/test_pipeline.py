import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.common import saved
from tests.llm.test_pairs import closure, shingle_set


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    rows = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.fresh(spark, f"test-{name}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        rows.append(docs.count())
    assert rows[0] >= rows[1] >= rows[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
    assert packed.filter("piece = 0").count() == docs.count()


CLASHES = ("_key", "_cuts", "_id", "_hash", "_copies", "_copy", "_toxicity", "_others", "row_key", "size", "p", "kept", "with.dot")


def odd_documents(spark):
    """Null and empty texts, repeated rows, a null id, ties, shared passages, and columns named like the operators' own."""
    draw = random.Random(4)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=5)) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [(1, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, prose(30) + " " + passage + " " + prose(30)), (7, prose(30) + " " + passage + " " + prose(30)), (8, passage), (9, "two words"), (None, prose(40)), (10, prose(9000)), (11, prose(90)), (11, prose(90))]
    texts += [texts[10], texts[8]]
    rows = [(i, t, "ab"[k % 2] if k % 5 else None, None if t is None else len(t), *[f"{c}{k}" for c in CLASHES]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def written(spark, name, df):
    path = corpus_pipeline.fresh(spark, f"test-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_on_odd_rows_equal_brute_force(spark, sf):
    docs = written(spark, "odd", odd_documents(spark))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.select("doc_id", "text").collect())
    clean = written(spark, "clean", stages["toxicity"](spark, docs, sf))
    assert clean.columns == columns and pairs(clean) == pairs(docs)  # none of them is toxic
    single = written(spark, "single", stages["minhash_near_dedup"](spark, clean, sf))
    sets = {}
    for i, t in pairs(docs):
        sets.setdefault(i, []).append(shingle_set(t))
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    groups = closure(ids, links)
    assert single.columns == columns and pairs(single) == sorted({(i, t) for i, t in pairs(docs) if groups[i] == i})
    cut = written(spark, "cut", stages["substring_dedup"](spark, single, sf))
    seen, kept = set(), dict(pairs(cut))
    assert cut.columns == columns and set(kept) == set(dict(pairs(single))) - {8}  # 8 is nothing but the passage
    for _, text in pairs(cut):
        words = text.split()
        runs = {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
        assert not runs & seen
        seen |= runs
    assert all(r.n_chars == len(r.text) for r in cut.filter("text is not null").collect())
    assert cut.filter("doc_id = 7").first()["with.dot"] == docs.filter("doc_id = 7").first()["with.dot"]
    mixed = written(spark, "mixed", stages["mixing"](spark, cut, sf))
    times = {k: n for *k, n in ((r.doc_id, r.text, r["count"]) for r in mixed.groupBy("doc_id", "text").count().collect()) for k in [tuple(k)]}
    assert mixed.columns == columns and set(times) <= {(r.doc_id, r.text) for r in cut.collect()} and max(times.values()) <= 2
    packed = stages["best_fit_packing"](spark, mixed, sf).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, sf, name):
    docs = odd_documents(spark).filter("false")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_a_second_run_leaves_the_first_result_readable(spark, sf, monkeypatch):
    copy = corpus_pipeline._stage(lambda spark, docs, sf_dir: saved(docs.select("doc_id", "text")))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"copy{k}", copy) for k in range(3)])
    first = corpus_pipeline.run(spark, sf)
    second = corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() > 0
