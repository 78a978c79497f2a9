"""Token counts and alignments against the libraries, text by text."""

import hashlib
from collections import Counter

import pytest
import public_tokenizers

from tallyloom.llm import alignment, token_counts

from .conftest import corpus

ODD = [
    None, "", " ", "\n", " \t\r\n ", "  two  blanks ", "a\n\n  b\n", "tab\there\r\nand\x0bthere\x0c", "it's We'LL ''s 's", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<s> </s> <unk> <0x41>",
    "naïve ＡＢＣ ﬁ ΑΣ İI ǅ Ɛdziban á x́́ <|endoftext|>́", "漢字かな交じり文 \U0001f600\U0001f468‍\U0001f469 ع ر ب ي", "▁", "a▁b c", "nul\x00 esc\x1b fs\x1c x\x1f", " no break  em line", "x" * 3000, "0123456789 " * 50,
    "fn main() {\r\n\t// ;\r\n  let x = 1;\r}\n", "the the The THE the", "� ﻿ ᠎ ​ x", "e" + "́" * 40, " leading", "trailing ", "a  \n  b \n\nc",
]


@pytest.fixture(scope="module")
def rows():
    own = [(r[0], r[1]) for r in corpus()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    return own + [(None, "null id"), (None, "null id"), (1001, "same id, other text"), (2000, " ".join(f"w{i}ord{i % 97}" for i in range(60_000)))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    named = "doc_id long, text string, n_tokens int, row string, rest string"
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], named).repartition(3)


def told(df):
    return Counter(tuple(r) for r in df.collect())


def test_counts_equal_the_library(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    want = Counter((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, counts, strict=True))
    assert told(token_counts.token_counts(docs)) == want
    assert told(token_counts.token_counts(docs, frequent=5)) == want  # nearly all by the join


def test_words_of_every_kind_of_character_are_counted_as_in_a_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, memo = Tokenizer.from_file(path), token_counts.PreTokens(path)
    letters = [chr(c) for c in [*range(0x3000), *range(0xA640, 0xA7FF), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]]
    texts = [f"{c} a{c}b{c} {c}b '{c}s 1{c}E{c}{c}́" for c in letters]
    for every in (texts, letters, [f"a{c}b" for c in letters], [f"{c} <|x {c}" for c in letters]):
        want = [len(e.ids) for e in whole.encode_batch(every, add_special_tokens=False)]
        assert [sum(n * memo.pieces(p) for p, n in memo.of(t).items()) for t in every] == want


def brute(rows):
    """The contract, a byte and a pair at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    groups = []
    for _, t in rows:
        mine = []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = ends(bytes_a), ends(bytes_b)
                i = j = 0
                for shared in sorted(set(ends_a) & set(ends_b)):
                    m, n = ends_a.index(shared, i) + 1, ends_b.index(shared, j) + 1
                    mine.append((ids_a[i:m], ids_b[j:n]))
                    i, j = m, n
        groups.append(mine)
    count, best = Counter(), {}
    for mine in groups:
        count.update({(x, y) for left, right in mine for x in left for y in right})
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    for (i, _), mine in zip(rows, groups, strict=True):
        links = [(x, y) for left, right in mine for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in mine)
        yield (i, sum(len(x) for x, _ in mine), sum(len(x) for _, x in mine), len(mine), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if mine else "")


def test_alignment_equals_brute_force(docs, rows):
    want = Counter(brute(rows))
    assert told(alignment.aligned(docs)) == want
    assert told(alignment.aligned(docs, frequent=5)) == want  # nearly all by the join


def test_groups_cover_the_bytes(docs, rows):
    for row in alignment.groups(docs.filter("doc_id between 1000 and 1026 and doc_id <> 1001")).collect():
        at = 0
        for g in row["groups"]:
            assert g["start"] == at and g["a"] and g["b"]
            at = g["end"]
        assert at == (len((" " + ODD[row["doc_id"] - 1000]).encode()) if row["groups"] else 0)


def test_chunks_of_every_kind_of_character_align_as_in_a_text():
    memo = alignment.Aligner(*alignment._paths(None, None))
    letters = [chr(c) for c in [*range(0x3100), *range(0xA640, 0xA7FF), *range(0xF900, 0x10000), *range(0x1F100, 0x1F200)]]
    texts = [f"{c} a{c} {c}\n{c}b{c}{c} \n{c}" for c in letters]
    whole_a = [e.ids for e in memo.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    for t, ids_a, ids_b in zip(texts, whole_a, memo.b.encode(texts), strict=True):
        chunks = memo.chunks(t)
        found = memo.learn(set(chunks))
        got = [found[c] for c in chunks]
        if None not in got:
            sides = [g.split("|") for x in got for g in x[4].split(";")]
            assert [int(i) for s, _ in sides for i in s.split(",")] == ids_a and [int(i) for _, s in sides for i in s.split(",")] == ids_b, repr(t)
        else:
            assert "▁" in t


def test_large_groups_are_counted_by_id(monkeypatch, docs, rows):
    few = rows[:30]
    monkeypatch.setattr(alignment, "EXPANDED", 1)
    al = alignment.Aligner(*alignment._paths(None, None))
    chunks = sorted({c for _, t in few if t for c in al.chunks(t)})
    small = al.align(chunks)
    monkeypatch.setattr(alignment, "EXPANDED", 1 << 12)
    plain = lambda x: x and (*x[:5], dict(zip(x[5].tolist(), [1] * len(x[5]) if x[6] is None else x[6].tolist(), strict=True)))
    assert [plain(x) for x in al.align(chunks)] == [plain(x) for x in small]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert told(token_counts.token_counts(empty)) == told(alignment.aligned(empty)) == Counter()
