"""Operators on single texts, pages and records."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import extraction, fingerprint, mixing, packing, reputation, toxicity, warc
from tallyloom.llm.common import fresh, shared_dir

from .conftest import corpus, prose


def test_levenshtein_walk_equals_distance():
    terms = {t: 1.0 for t in ("moron", "idiot", "scum", "lose", "loser", "clownish")}

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    row[-1] = min(row[-1], rows[-2][j - 2] + 1)
            rows.append(row)
        return rows[-1][-1]

    trie = toxicity.Trie(terms)
    words = ["moron", "mron", "idiots", "idoit", "diiot", "idito", "scam", "scum", "csum", "losers", "los", "lo", "", "zzzzzz", "idiot", "miron", "xmoron", "olse", "lsoer", "clwonish", "lcownish", "clownihs"]
    for w in words:
        best = min((distance(w, t), t) for t in terms)
        assert trie.walk(w) == ((best[1], best[0]) if best[0] <= 1 else None), w


def test_digits_repeats_and_stems():
    trie = toxicity.Trie({"moron": 1.0, "idiot": 1.0, "achlich*": 2.0, "2": 1.0})
    got = {w: trie.match(w) for w in ("idi0t", "m0ron", "1d10t", "idiooot", "mooooron", "achlichung", "achlich", "achlch", "moron", "2", "100", "r2d2", "aaaa")}
    assert got == {"idi0t": ("idiot", 1), "m0ron": ("moron", 1), "1d10t": ("idiot", 1), "idiooot": ("idiot", 1), "mooooron": ("moron", 1), "achlichung": ("achlich*", 0), "achlich": ("achlich*", 0), "achlch": None, "moron": ("moron", 0), "2": None, "100": None, "r2d2": None, "aaaa": None}


def test_quotation_is_told_from_abuse():
    trie = toxicity.Trie({"moron": 3.0})
    abuse, quote = toxicity.features("you moron", trie), toxicity.features('he said "you moron" again', trie)
    assert abuse[0] > 0 and quote[0] == 0 and quote[2] > 0


def test_toxicity_context_is_the_whole_line_and_linear():
    import time

    trie = toxicity.Trie({"moron": 3.0})
    gap = " . " * 400
    assert toxicity.features('"' + gap + "you moron" + gap + '" end', trie)[2] > 0
    assert toxicity.features("said" + gap + "you moron", trie)[2] > 0 and toxicity.features("said\nyou moron", trie)[0] > 0
    line = 'a "quoted" word and moron ' * 40_000
    began = time.time()
    toxicity.features(line, trie)
    assert time.time() - began < 20


def test_toxicity_learns_and_scores_whole_texts(spark):
    bad = ("scumword", "badword", "vileword")
    rows = [(i, prose(i, 60) + (f" {bad[i % 3]} {bad[(i + 1) % 3]} " + prose(i + 5000, 20) if i % 4 == 0 else ""), "k") for i in range(400)]
    rows += [(1000, None, "k"), (1001, "", "k"), (1002, prose(1, 30_000) + " badword scumword", "k"), (1002, prose(1, 30_000) + " badword scumword", "k"), (None, "vileword badword", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, None, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.classified(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in out if r.doc_id is not None and r.doc_id < 400)
    by = {r.doc_id: r.predicted for r in out}
    assert by[1000] == by[1001] == 0 and by[1002] == 1
    kept = toxicity.scored(docs, labels, "_t").filter("_t < 0.5")
    assert set(docs.columns) < set(kept.columns)


def test_toxicity_without_labels_or_documents(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.score, r.predicted) for r in toxicity.classified(docs, labels).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert toxicity.classified(nothing, labels).count() == 0


def test_closed_syncmers_are_context_free():
    text = prose(5, 300)
    h, at = fingerprint.anchors(text)
    moved, places = fingerprint.anchors("some other words in front " + text)
    known = dict(zip(places.tolist(), moved.tolist(), strict=True))
    assert all(known[p + 26] == x for p, x in zip(at.tolist(), h.tolist(), strict=True))
    k, s = fingerprint.K, fingerprint.S

    def inner(i):
        values = []
        for j in range(i, i + k - s + 1):
            v = 0
            for c in text[j : j + s]:
                v = (v * 0x100000001B3 + ord(c)) & (1 << 64) - 1
            v = v * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            v ^= v >> 29
            values.append(v * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
        return values

    want = [i for i in range(len(text) - k + 1) if min(v := inner(i)) in (v[0], v[-1])]
    assert at.tolist() == want


def test_fingerprints_follow_the_contract(spark, docs):
    out = fingerprint.followed(docs, fingerprint.Pairing(), fingerprint.RESULT, fingerprint.RESULT_DDL).collect()
    rows = sorted(((i, t or "") for i, t, *_ in corpus() if i is not None), key=lambda r: -r[0])
    texts = [t for _, t in rows] + [next(t for i, t, *_ in corpus() if i is None)]
    follower = {rows[k][0]: texts[k + 1] for k in range(len(rows)) if rows[k][0] != 16}
    assert len(out) == len(corpus())
    prints = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in follower:
            t = dict(rows)[r.doc_id]
            n = len(t)
            edited = t[: n - n // 2] + follower[r.doc_id][: n // 2]
            assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
            assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert next(r for r in out if r.doc_id is None).edited_sha256  # the last is followed by the first


def test_fingerprints_of_one_and_no_document(spark, nothing):
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    r = fingerprint.followed(one, fingerprint.Pairing(), fingerprint.RESULT, fingerprint.RESULT_DDL).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fingerprint.followed(nothing, fingerprint.Pairing(), fingerprint.RESULT, fingerprint.RESULT_DDL).count() == 0


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i * 7919 % 60), "abcdefg"[min(6, i % 13)], "k") for i in range(9000)] + [(9001, None, "a", "k"), (9002, "", None, "k"), (9003, "x y", None, "k"), (9003, "x y", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    first, again = (mixing.mix(mixing.sized(docs)).select("doc_id", "source", "size", "source_size", "target", "taken").toPandas() for _ in range(2))
    assert len(first) == len(rows)
    order = ["doc_id", "taken"]
    assert first.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        free -= full
        if not free:
            break
    target |= {s: unit * weight[s] for s in free}
    for s, g in first.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g["source_size"].iloc[0] == sizes[s] and g["target"].iloc[0] == pytest.approx(target[s])
        assert abs(g["taken"].sum() - target[s]) <= 60
    assert (first["taken"] <= 2 * first["size"]).all()


def test_mixing_of_tables_without_words(spark, nothing):
    assert mixing.mix(mixing.sized(nothing)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(mixing.sized(empty)).collect()} == {(0.0, 0)}


def test_mixed_documents_keeps_columns_and_counts(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 4


def test_cube_flight_keeps_its_totals():
    r = np.random.default_rng(1)
    p, size = np.full(500, 0.37), r.integers(1, 90, 500).astype(float)
    got = mixing.flight(p, size, np.random.default_rng(2), land=False)
    assert ((got > 0) & (got < 1)).sum() <= 2
    assert got.sum() == pytest.approx(p.sum()) and (got * size).sum() == pytest.approx((p * size).sum())


def test_packing_is_whole_and_within_capacity(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    out = packing.pack(packing.pieces_of(docs, capacity=256), capacity=256, group_pieces=40).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in ((i, t) for i, t, *_ in corpus() if i not in (None, 16)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.length.tolist() == [min(256, len(ids) - k) for k in range(0, len(ids), 256)]
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 256].tobytes()) for k in range(0, len(ids), 256)]
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256


def test_tokens_of_words_are_tokens_of_texts():
    import public_tokenizers

    memo = packing.PartIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["Don't stop, it's 3.14!!", "<|endoftext|> in a text", "naïve café ＡＢＣ ﬁ é", " nbsp em ls", "x\x1cy\x85z", "ΣΑΣ Σ", "漢字かな", "a" * 300, "İstanbul", "\x00 null", "?!?! ... --", "😀 emoji", "Éireuxaux, ÖFFNEN ßkeit. ǅ ŉ ª²½ ×÷ «quoted» ¿qué? ñandú's a\u00adb İi ıI ŸÿŁ", "A\x85B\xa0C\x1d漢 x\x0by ½²3'LL Ǆ ǆ", "plain text it's \t tab\n", "Straße 漢字 it's"]:
        assert memo.text(text) == memo.whole(text), text


def test_every_letter_of_the_fast_path_has_the_tokenizers_ids():
    import public_tokenizers

    memo = packing.PartIds(public_tokenizers.path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x300)]
    assert [c for c in letters if any(memo.text(t) != memo.whole(t) for t in (c, f"a{c}b", f"{c}b", f"b{c}", f"1{c}2", c + c, f"'{c}", f"A{c}\u0301"))] == []


def test_packing_of_a_few_pieces_is_nearly_the_best():
    """Against all ways to pack: best fit decreasing needs at most 11/9 of the fewest sequences, and one more."""
    draws = np.random.default_rng(11)

    def fewest(lengths, room):
        best = [len(lengths)]

        def go(k, left):
            if len(left) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(left)
                return
            for i in range(len(left)):
                if left[i] >= lengths[k] and left[i] not in left[:i]:
                    go(k + 1, left[:i] + [left[i] - lengths[k]] + left[i + 1 :])
            go(k + 1, left + [room - lengths[k]])

        go(0, [])
        return best[0]

    for n in (1, 2, 5, 8, 9):
        for top in (30, 60, 100):
            lengths = np.sort(draws.integers(1, top + 1, n))[::-1]
            bins, offsets = packing.best_fit(lengths, 100, 100, 100.0 * 100, (1.0, 0.05, 0.05))
            used = int(bins.max()) + 1
            assert fewest(lengths.tolist(), 100) <= used <= 11 / 9 * fewest(lengths.tolist(), 100) + 1
            for b in range(used):
                assert sorted(offsets[bins == b].tolist()) == [0, *np.cumsum(lengths[bins == b])[:-1].tolist()] and lengths[bins == b].sum() <= 100


def test_other_capacities_bind():
    lengths = np.array([60, 50, 40, 30, 20, 10, 5, 5])
    bins, offsets = packing.best_fit(lengths, 100, 2, 100.0 * 100, (1.0, 0.1, 0.1))
    assert max(np.bincount(bins)) <= 2
    bins, _ = packing.best_fit(lengths, 100, 100, 4000.0, (1.0, 0.1, 0.1), "dot")
    for b in set(bins.tolist()):
        assert (lengths[bins == b] ** 2).sum() <= 4000 + 1e-6 and lengths[bins == b].sum() <= 100


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div id="cookie-notice">We use cookies, please accept all of them now.</div>
<div class="ad">Buy now, a long advert sentence that has many words in it.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text&nbsp;here.<br>After break.<p>Second &lt;para&gt; <i>x</i>y.</p><form><input name=q>Search me</form><div class="comments"><p>Nice post, reader comment!</p></div>
<ul><li>one<li>two</ul></article><aside>Side words</aside><footer>&copy; foot</footer></body></html>"""


def test_extraction_of_an_article():
    assert extraction.main_text(PAGE) == "Head & line\nFirst bold text here. After break.\nSecond <para> xy.\none\ntwo"


def test_extraction_without_article_clusters_lines():
    body = "".join(f"<p>{prose(i, 60)}</p>" for i in range(5))
    html = f"<div><a href=1>a</a> <a href=2>b</a> <a>c</a></div><div>{body}</div><div><a>x</a><a>y</a></div><footer>end</footer>"
    assert extraction.main_text(html) == "\n".join(prose(i, 60) for i in range(5))


def test_extraction_of_a_page_with_article_teasers():
    body = "".join(f"<p>{prose(i, 60)}</p>" for i in range(5))
    teasers = "".join(f"<article><h3>More {i}</h3><a href=/{i}>read {i}</a></article>" for i in range(3))
    html = f"<div><h1>The head</h1>{body}</div><section>{teasers}</section>"
    assert extraction.main_text(html) == "\n".join(["The head", *(prose(i, 60) for i in range(5))])
    comments = f'<article class="comment">{prose(90, 80)}</article><article role="complementary">{prose(91, 80)}</article>'
    assert extraction.main_text(f'<article class="post has-sidebar">{body}</article>{comments}') == "\n".join(prose(i, 60) for i in range(5))


def test_extraction_leaves_out_parts_of_lines():
    a = f"<p>{prose(1, 60)}</p>"
    inside = {"<script>var x=1;</script>": "", "<style>p{}</style>": "", "<button>Press": "", "<noscript>no</noscript>": "", '<span class="ad">Buy</span>': "", "<svg><text>pic</text></svg>": "", "<select><option>one<option>two</select>": "", "<b>bold</b>": "bold "}
    for part, left in inside.items():
        for wrap in ("<article>{}</article>", "<div>{}</div>", "{}"):
            got = extraction.main_text(wrap.format(f"{a}<p>Hello {part}{'</button>' if 'button' in part else ''} world</p>{a}")).split("\n")
            assert got == [prose(1, 60), f"Hello {left}world", prose(1, 60)], (part, wrap)
    assert extraction.main_text(f"<article>{a}<p>Open <button>Press</p>{a}</article>").split("\n") == [prose(1, 60), "Open", prose(1, 60)]


def test_extraction_keeps_edges_and_headings_without_an_article():
    long = prose(3, 110)
    for wrap in ("{}", "<body>{}</body>", "<body><nav>a menu</nav><div>{}</div></body>", "<body><ul class=menu><li>x</ul><section>{}</section><footer>f</footer>"):
        got = extraction.main_text(wrap.format(f"<h1>Berlin</h1><p>{long}</p><p>short</p><p>{long}</p><p>the end</p>"))
        assert got.split("\n") == ["Berlin", long, "short", long, "the end"], wrap
        got = extraction.main_text(wrap.format(f"<h2>{long}</h2><p>by someone</p><div><p>{long}</p><h3>One</h3><p>{long}</p></div>"))
        assert got.split("\n") == [long, "by someone", long, "One", long], wrap


def test_extraction_of_comments_links_and_states():
    long = prose(4, 90)
    html = f'<body class="has-sidebar"><div class="page with-ads"><div id=content><p>{long}</p><p>{long}</p></div><div><a href=1>read more</a> <a>and more</a></div><section class=articleComments><p>{long}</p></section></div></body>'
    assert extraction.main_text(html).split("\n") == [long, long]


def plain_article(html):
    """The text of an article by cutting its known parts out with expressions, for pages like those given."""
    import html as h
    import re

    inner = re.search(r"<article>(.*?)</article>", html, re.S)
    cut = re.sub(r"(?s)<(form|aside|nav|script|style)\b.*?</\1>|<div class=\"(?:ad|comments)\".*?</div>|<!--.*?-->", "", inner[1]) if inner else ""
    blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|pre|table|tr|td|th|section)\b[^>]*>", cut)
    return "\n".join(t for b in blocks if (t := " ".join(h.unescape(re.sub(r"<br\b[^>]*>", " ", b) if "<" not in b else re.sub(r"<[^>]+>", "", re.sub(r"<br\b[^>]*>", " ", b))).split())))


def test_extraction_of_all_pages_equals_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    assert got == {i: plain_article(t or "") for i, t in html.items()}


def test_extraction_of_long_and_deep_pages():
    long = "<p>" + "word &amp; " * 300_000 + "</p>"
    assert len(extraction.main_text(f"<article>{long}</article>")) == 7 * 300_000 - 1
    assert extraction.main_text("<div>" * 20_000 + "deep") == "deep"


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "<article><p>cut &amp", "z"), (4, "u", "<article><p>cut &amp", "z"), (5, "u", "<p>" * 5000 + "deep", "z"), (None, "u", "<script>only", "z")], "page_id long, url string, html string, text string")
    out = [(r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).collect()]
    assert len(out) == 7 and (2, "", 0) in out and (3, "", 0) in out and out.count((4, "cut &", 5)) == 2 and (None, "", 0) in out and (5, "deep", 4) in out
    assert extraction.extract(pages.limit(0)).count() == 0


URLS = [(1, "http://A.Example.com/en/7x?q#f"), (2, "https://example.com/en/1"), (3, "https://m.x.example.net/de/8"), (4, "http://other.net/de/8"), (5, "http://x.org/es/"), (6, None), (7, "no scheme"), (8, "http://fr.org"), (9, "http://notexample.com/en/7"), (9, "http://notexample.com/en/7"), (10, "ftp://EXAMPLE.NET?x=/de/8"), (11, "http://com/en/")]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, labels).collect()}
    assert out[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and out[2] == ("example.com", "/en/1", "com/en/", "block")
    assert out[3] == ("m.x.example.net", "/de/8", "example.net/de/8", "block") and out[4][2:] == ("net/de/", "allow") and out[5][2:] == ("org/es/", "block")
    assert out[6] == out[7] == ("", "", None, "allow") and out[8] == ("fr.org", "", None, "allow") and out[9][2:] == ("com/en/", "block")
    assert out[10] == ("example.net", "", None, "allow") and out[11][2:] == ("com/en/", "block")


def test_reputation_shrinks_small_hosts_and_blocks_bad_ones(spark):
    hosts = spark.createDataFrame([("bad.a.com", 190, 200), ("good.b.com", 5, 200), ("new.b.com", 1, 1), ("none.c.org", 0, 0), ("x.c.org", 10, 100)], "host string, bad long, n long")
    got = {r.host: (r.mean, r.low) for r in reputation.Reputation().scores(hosts).collect()}
    assert got["bad.a.com"][1] > 0.5 > got["new.b.com"][1] and got["new.b.com"][0] < 0.9 and got["good.b.com"][0] < 0.1 and len(got) == 5


def test_sites_of_hosts(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "shop.firm.co.uk:80": ("firm.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x@y.net.": ("y.net", "net"), "10.0.0.7:8080": ("10.0.0.7", "10.0.0.7"), "": ("", ""), "com.example.com": ("example.com", "com")}
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    got = hosts.select("host", reputation.site_of(F.col("host"), "domain").alias("d"), reputation.site_of(F.col("host"), "suffix").alias("s"))
    assert {r.host: (r.d, r.s) for r in got.collect()} == cases


def test_names_of_one_country_suffix_share_no_reputation(spark):
    hosts = spark.createDataFrame([(f"h{k}.bad.co.uk", 9, 10) for k in range(20)] + [(f"h{k}.good{k}.co.uk", 0, 10) for k in range(20)] + [("new.bad.co.uk", 0, 0), ("new.other.co.uk", 0, 0)], "host string, bad long, n long")
    got = {r.host: r["mean"] for r in reputation.Reputation().scores(hosts).collect()}
    assert got["new.bad.co.uk"] > 0.6 > 0.5 > got["new.other.co.uk"]


def test_url_filter_of_empty_tables_and_the_method_blocks(spark):
    pages = spark.createDataFrame([(k, f"http://spam.example.io/en/{k}") for k in range(40)] + [(99, "http://fine.example.io/en/99"), (100, None)], "page_id long, url string")
    outcomes = spark.createDataFrame([(k, 1) for k in range(40)] + [(99, 0)], "doc_id long, bad int")
    got = {r.page_id: r.verdict for r in reputation.judge(pages, outcomes).collect()}
    assert {got[k] for k in range(40)} == {"block"} and len(got) == 42
    assert reputation.judge(pages.filter("false"), outcomes).count() == 0
    assert {r.verdict for r in reputation.judge(pages, outcomes.filter("false")).collect()} == {"allow"}


def test_warc_round_trip(spark):
    nasty = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\nWARC/1.1"
    big = "é漢" * 5000
    rows = [(1, "http://x/ y\r\n", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "u", None), (4, "u", ""), (5, "u", nasty), (6, "u", big), (6, "u", big), (7, "u", big), (8, "u", "tail\r\n\r\n"), (None, "u", "<p>hi</p>"), (9, "u", "\r\n"), (10, "u", nasty * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = warc.round_trip(pages, chunk_bytes=997).collect()
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    want = []
    for i, p in payload:
        keeper = max(j for j, q in payload if q == p and j is not None)
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == keeper else "revisit", None if i == keeper else keeper))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


EDGE = "\r\nWARC/1.1\r\n"


@pytest.mark.parametrize("size", [1 << 20, 5, 12])
def test_warc_payloads_at_the_record_boundary(spark, size):
    """Payloads that begin with, end in and are cut at what would separate records."""
    payloads = ["WARC/1.1\r\n", EDGE, "\r\n" + EDGE, "text\r\n" + EDGE, "\r\n\r\nWARC/1.1", "a\r\n\r\n", "WARC/1.1", "\r\n" + EDGE * 4, "12345" + "\r\n" + EDGE + "x", "123\r\n" + EDGE, "é" * 7, "\r" * 9, "WARC/1.1\r\nWARC-Type: response\r\n\r\n"]
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(payloads)], "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.round_trip(pages, chunk_bytes=size).collect()}
    for i, p in enumerate(payloads):
        assert out[i].payload_bytes == len(p.encode()) and out[i].payload_digest == base64.b32encode(hashlib.sha1(p.encode()).digest()).decode()


def test_warc_blocks_never_make_a_boundary():
    r = np.random.default_rng(8)
    for _ in range(3000):
        chunk = b"".join(r.choice([b"\r\n", b"\r", b"\n", b"WARC", b"/1.1", b"x", b"WARC/1.1\r\n"], r.integers(0, 14)).tolist())
        blocks = list(warc.blocks_of(chunk))
        assert b"".join(blocks) == chunk
        assert all(warc.BOUNDARY.encode() not in warc.END.encode() + b + warc.END.encode() for b in blocks)


def test_warc_long_payload_in_chunks(spark):
    pages = spark.createDataFrame([(1, "u", "é漢x" * 700_000), (2, "u", "é漢x" * 700_000)], "page_id long, url string, html string")
    path = fresh(spark, "warc")
    warc.write_archives(pages, path)
    assert spark.read.option("lineSep", warc.BOUNDARY).text(path).count() == 6  # five chunks and a revisit
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in warc.read_archives(spark, path).collect()} == {(2, 4_200_000, None), (1, 4_200_000, 2)}


def test_warc_reader_refuses_a_changed_byte(spark):
    path = fresh(spark, "warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "payload text")], "page_id long, url string, html string"), path, compression="none")
    lines = spark.read.option("lineSep", warc.BOUNDARY).text(path).collect()
    broken = spark.createDataFrame([(lines[0].value.replace("payload text", "payload texT"),)], "value string")
    broken.write.option("lineSep", warc.END).text(path + "-broken")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, path + "-broken").collect()


def test_shared_folder_is_the_session_setting(spark):
    assert fresh(spark, "x").startswith(shared_dir(spark))
