"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from tallyloom.llm import embeddings, minhash, substrings
from tallyloom.llm.common import shingles_of, word_hashes
from tallyloom.llm.components import components

from .conftest import corpus, prose


def words_of(text):
    return text.encode("utf-8", "replace").lower().split() if text else []


def test_word_hashes_tell_words_apart():
    known = {}
    for text in [*(t for _, t, *_ in corpus()), "\x0b a\x1cb ÀB àb  ", "x" * 3_000_000 + " y", "\ud800 ?"]:
        words, hashes = words_of(text), word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = words_of(text)
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 499), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = closure({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_brute_force(spark, docs):
    rows = minhash.near_duplicates(docs).collect()
    source = corpus()
    assert len(rows) == len(source)
    sets = {i: shingle_set(t) for i, t, *_ in source if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_finds_chains_near_the_limit_in_a_large_group(spark):
    base = prose(50, 100).split()
    rows = []
    for i in range(120):
        words = list(base)
        words[i % 95] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(2000 + i, 60)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert got == closure(sets, links)


def test_minhash_of_an_empty_table(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_of_each_keeps_columns_and_drops_repeats(docs):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 not in ids and {4, 5, 6} <= set(ids) and 7 not in ids


def repeated_brute(rows, n=50):
    seen = {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - n + 1):
            seen.setdefault(tuple(w[j : j + n]), set()).add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s}


def test_substring_dedup_finds_every_repeat(docs):
    found = substrings.repeated_passages(docs).collect()
    want = repeated_brute([(i, t) for i, t, *_ in corpus()])
    assert {r.doc_id for r in found} - {16} == (want | {3}) - {16}
    texts = {i: t for i, t, *_ in corpus()}
    passage = prose(2, 70)
    for r in found:
        assert len(words_of(texts[r.doc_id][r.start_char : r.end_char])) == r.end_word - r.start_word >= 50
    spans = {(r.doc_id, r.is_first): r for r in found}
    assert passage in texts[11][spans[11, False].start_char : spans[11, False].end_char]
    assert spans[10, True].is_first and spans[11, False].first_doc_id == 10


def test_without_repeats_leaves_the_first_and_clean_texts(docs):
    out = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    texts = {i: t for i, t, *_ in corpus()}
    assert out[10] == texts[10] and out[1] == texts[1] and out[13] == texts[13] and out[4] is None and out[5] == ""
    assert prose(2, 70) not in out[11] and out[11].startswith(prose(5, 40)) and out[12].strip() == prose(7, 30)
    assert 2 not in out and all(out[i] == texts[i] for i in range(20, 60))


def test_substring_dedup_of_an_empty_table(nothing):
    assert substrings.repeated_passages(nothing).count() == 0


def test_near_passage_with_one_edit_is_found(spark):
    p = prose(70, 90).split()
    q = list(p)
    q[45] = "other"
    rows = [(i, prose(300 + i, 80) + " " + " ".join(p if i % 2 else q) + " " + prose(400 + i, 50)) for i in range(12)]
    rows += [(100 + i, prose(600 + i, 200)) for i in range(20)]
    found = {r.doc_id for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(range(12))


@pytest.mark.parametrize("n", [46, 60, 500])
def test_compact_windows_hold_every_long_subsequence_once(n):
    shingles = shingles_of(word_hashes(" ".join(str(i * 7919 % 1000) for i in range(n + 4))))
    for keys, l, c, r in substrings.windows_of(shingles, 46):
        covered = 0
        for a, m, b in zip(l, c, r, strict=True):
            covered += sum(max(0, min(b, n - 1) - max(m, i + 45) + 1) for i in range(a, m + 1))
        assert covered == sum(n - i - 45 for i in range(n - 45))  # each subsequence in exactly one window


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 64))
    near = x[:40] + 0.05 * r.standard_normal((40, 64))
    chain = [x[50]]
    for _ in range(6):
        chain.append(chain[-1] + 0.25 * r.standard_normal(64))
    vectors = [v.tolist() for v in [*x, *near, *x[:5], *(2 * x[5:8]), *chain]]
    rows = [(i, v, "k") for i, v in enumerate(vectors)]
    rows += [(900, None, "k"), (901, [0.0] * 64, "k"), (902, [float("nan")] + [1.0] * 63, "k"), (903, [None] + [1.0] * 63, "k"), (904, [float("inf")] + [1.0] * 63, "k"), (906, [], "k")]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")).collect()}
    a = np.array(vectors)
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    s = a @ a.T >= 0.95
    np.fill_diagonal(s, False)
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(s), strict=True)]
    want = closure(range(len(vectors)), links)
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(s[i].sum()), want[i], want[i] == i)
    for i in (900, 901, 902, 903, 904, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def cosines(vectors):
    a = np.array(vectors)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    s = a @ a.T >= 0.95
    np.fill_diagonal(s, False)
    return s.sum(axis=1)


def test_embeddings_of_any_length_and_scale(spark):
    r = np.random.default_rng(9)
    groups = []
    for dims, n in ((2, 8), (3, 5), (16, 120), (96, 150), (7, 4), (64, 30)):
        x = r.standard_normal((n, dims))
        groups.append([*x, *(x + 0.02 * r.standard_normal(x.shape)), *(x[:3] * 1e-200), *(x[3:4] * 1e200)])
    rows, want = [], {}
    for g, vectors in enumerate(groups):
        for i, n in enumerate(cosines(vectors)):
            rows.append((1000 * g + i, vectors[i].tolist()))
            want[1000 * g + i] = int(n)
    got = {x.vec_id: x.n_links for x in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_codes_are_balanced_about_a_common_mean():
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 64)) + 1.5 * r.standard_normal(64)
    q = embeddings.learn(x, len(x), 0.95, 0.999)
    codes = q.codes(embeddings.unit(x))
    ones = np.unpackbits(codes[:, :1].view(np.uint8), axis=1).mean(axis=0)
    assert (abs(ones - 0.5) < 0.05).all() and np.unique(q.parts(codes)[:, 0], return_counts=True)[1].max() < 60


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exact_passages_of_families_that_share_half_of_them_are_found(spark):
    licence = prose(5000, 28)
    rows, firsts = [], 60
    for f in range(firsts):  # the same sentences in all families, then words of the family's own
        passage = licence + " " + prose(6000 + f, 26)
        rows += [(f, prose(7000 + f, 60) + " " + passage + " " + prose(7100 + f, 40)), (1000 + f, prose(7200 + f, 30) + " " + passage + " " + prose(7300 + f, 70))]
    found = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    later = {r.doc_id: r for r in found if not r.is_first}
    assert set(later) == {1000 + f for f in range(firsts)}
    assert all(r.first_doc_id == i - 1000 and (r.start_word, r.end_word) == (30, 84) for i, r in later.items())
    assert {r.doc_id for r in found if r.is_first} == set(range(firsts))


def test_near_passages_that_resemble_no_pivot_meet_in_the_end(spark, monkeypatch):
    """Of each family an early text has half of the passage, so that it is the pivot of most lists; with no stars only the
    crossing pairs are left to find the near copies."""
    monkeypatch.setattr(substrings, "STARS", 1)
    rows = []
    for f in range(12):
        p = prose(8000 + f, 110).split()
        q = list(p)
        q[55] = "other"
        rows += [(3 * f + i, prose(8100 + 10 * f + i, 50) + " " + " ".join(x) + " " + prose(8500 + 10 * f + i, 50)) for i, x in enumerate((p[:40], p, q))]
    found = {r.doc_id for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i for i in range(36) if i % 3}


def edited(words, edits, r):
    """The words with so many of them replaced, left out or put in, at places of any kind."""
    out = list(words)
    for k in range(edits):
        at = r.randrange(len(out))
        kind = r.choice("ride")
        if kind in "re":
            out[at] = f"edit{r.randrange(10**9)}"
        elif kind == "i":
            out.insert(at, f"more{r.randrange(10**9)}")
        else:
            del out[at]
    return out


def plain_shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_near_passages_with_edits_anywhere_are_found(spark):
    """Passages of 50 to 400 words with one to four edits, in other words, against the definition: 50 words on both sides, a similarity of
    0.75 between their shingles."""
    r = random.Random(31)
    rows, want = [], set()
    for f in range(600):
        p = prose(40_000 + f, r.choice([50, 55, 60, 70, 85, 100, 140, 200, 300, 400])).split()
        q = edited(p, r.choice([1, 1, 2, 3, 4]), r)
        if len(q) >= 50 and like(plain_shingles(p), plain_shingles(q)) >= 0.75:
            want.add(2 * f + 1)
        around = lambda k: prose(90_000 + 8 * f + k, r.choice([0, 0, 30, 90]))
        rows += [(2 * f, " ".join([around(0), *p, around(1)])), (2 * f + 1, " ".join([around(2), *q, around(3)]))]
    found = {x.doc_id for x in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not x.is_first}
    assert len(want) > 400 and len(want - found) <= 0.08 * len(want), (len(want), len(want - found))


def test_verifier_finds_what_all_segments_give():
    """Two short texts: every segment of 46 shingles or more of both that begins and ends with a shared one."""
    r = random.Random(7)
    agree = []
    for f in range(60):
        p = prose(70_000 + f, r.choice([50, 52, 56, 60])).split()
        q = edited(p, r.choice([1, 1, 2, 3]), r)
        a, b = plain_shingles(p), plain_shingles(q)
        ends = [k for k, x in enumerate(a) if x in b], [k for k, x in enumerate(b) if x in a]
        some = any(like(a[i : j + 1], b[m : n + 1]) >= 0.75 for i in ends[0] for j in ends[0] if j - i >= 45 for m in ends[1] for n in ends[1] if n - m >= 45)
        h, g = (shingles_of(word_hashes(" ".join(x))) for x in (p, q))
        agree.append(bool(substrings.shared_passages(h, g, 46, 0.75)) == some)
    assert sum(agree) >= 58


def test_texts_without_a_near_passage_are_left_alone(spark):
    r = random.Random(13)
    rows = []
    for f in range(200):
        p = prose(60_000 + f, 45 if f % 2 else 90).split()  # too short, or with an edit in every eighth word
        q = p if f % 2 else [f"e{f}x{i}" if i % 8 == 3 else w for i, w in enumerate(p)]
        rows += [(2 * f, " ".join([prose(95_000 + 4 * f, 60), *p, prose(95_001 + 4 * f, 60)])), (2 * f + 1, " ".join([prose(95_002 + 4 * f, 60), *q, prose(95_003 + 4 * f, 60)]))]
    assert substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
