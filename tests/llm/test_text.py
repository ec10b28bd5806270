import random
import re
import unicodedata

import pytest

from lotusrank.llm import scripts, splitting, tokens


@pytest.mark.parametrize("text, want", [
    ("рháр luật", "pháp luật"), ("do аі quyết", "do ai quyết"), ("Ðông Ɖá", "Đông Đá"), ("ｄâｎ　xã；", "dân xã;"), ("a​b­c﻿", "abc"), ("1 000 m", "1 000 m"),
    (unicodedata.normalize("NFD", "Điều lệ ngườị"), "Điều lệ ngườị"), ("ха̃ hội", "xã hội"), ("", ""), ("plain", "plain"),
    ("Москвa", "Москва"), ("Ελλάδa", "Ελλάδα"), ("Ꭺpple", "Apple"), ("𝐩𝐡á𝐩 luật", "pháp luật"), ("ｶﾞｷﾞ", "ガギ"), ("ꓔòa án", "Tòa án"),
])
def test_disguises_are_undone(text, want):
    assert scripts.normalize_text(text) == want
    assert scripts.normalize_text(want) == want


@pytest.mark.parametrize("text", ["«Договор аренды»", "то аренды", "“Λιμάνι”", "Δ và λ", "12 m³ ± 3 ‰ ½ …", "dòng\r\nhai\tba", "Café Société", "👨‍👩", "中文 – “ok”", "10 kΩ", "5 µA", "Москва", "①②", "дa"])
def test_what_belongs_there_stays(text):
    assert scripts.normalize_text(text) == text


def test_scripts_are_classified():
    assert [scripts.classify(x) for x in ("abc", "рháр", "аі", "договор", "дa", "12")] == [("single", "LATIN"), ("mixed", "LATIN"), ("whole", "CYRILLIC"), ("single", "CYRILLIC"), ("foreign", ""), ("single", "")]
    assert scripts.classify("Москвa") == ("mixed", "CYRILLIC") and scripts.classify("kΩ") == ("foreign", "")


def test_found_counts_repeats_once_and_skips_nulls(spark):
    c = spark.createDataFrame([("1", "α b", 1), ("2", None, 1), (None, "аb", 1), ("3", "sạch", 1), ("4", "рa", 2), ("4", "рa", 2)], "doc_id string, passage string, fld int")
    t = spark.createDataFrame([("7", "x\u00a0y"), ("8", "")], "qid string, question string")
    got = sorted(tuple(r) for r in scripts.found(c, t).collect())
    assert got == [("context.passage", "4"), ("train.question", "7")]


WORDS = "một hai ba. bốn năm; sáu bảy, tám chín mười: dài".split()


def make(rnd, n, nat=True):
    out = []
    for i in range(n):
        out.append(rnd.choice(WORDS) if nat else "từ")
        out.append(rnd.choice([" ", "  ", "\n", " ", " "]) if nat else " ")
    return "".join(out)


def greedy(nat, limit, overlap):
    """One cut after the other."""
    n = len(nat)
    breaks = [i + 1 for i in range(n) if nat[i]]
    out, start, cut = [], 0, 0
    while cut < n:
        far = [b for b in breaks if cut < b <= start + limit]
        cut = max(far) if far else min(start + limit, n)
        out.append((start, cut))
        near = [b for b in breaks if cut - overlap <= b < cut]
        start = min(near) if near else max(cut - overlap, 0)
    return out


@pytest.mark.parametrize("nat", [True, False])
def test_pieces_match_a_sequential_cutter(nat):
    rnd = random.Random(5)
    texts = [make(rnd, rnd.choice([0, 1, 5, 30, 200, 900]), nat) for _ in range(60)]
    got = splitting.split_batch(texts, 40, 7)
    for t, ranges in zip(texts, got):
        starts, ends, natural = splitting.scan(t)
        assert len(starts) == len(t.split())
        assert ranges == (greedy(natural.tolist(), 40, 7) if len(starts) else [])
        assert all(b - a <= 40 for a, b in ranges)


def test_splitting_a_table(spark):
    rnd = random.Random(2)
    long = "Điều 1. Mở.\n" + make(rnd, 500) + "\nĐiều 2a. Hết\n" + make(rnd, 500)
    docs = spark.createDataFrame([("1", "Luật-A", None, long), ("1", "Luật-A", None, long), ("2", None, None, None), ("3", "b", None, "ngắn"), ("4", None, "http://x/y/Ten-Dai-4.aspx", "w " * 351), ("5", None, None, "w​x " * 350)],
                                 "doc_id string, name string, link string, passage string")
    ch = spark.createDataFrame([("c#1", "Điều 9", ("a " * 100).strip() + " b" * 300), ("c#2", "p", "x " * 350)], "chunk_id string, path string, text string")
    got = splitting.split_all(docs, ch).collect()
    assert {(r.fld, r.rec_id) for r in got} == {("context.passage", "1"), ("context.passage", "4"), ("chunks.text", "c#1")}
    one = sorted((r for r in got if r.rec_id == "1"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in one] == list(range(1, len(one) + 1)) and one[0].path.startswith("Luật A > Điều 1 > Phần 1/") and "Điều 2a" in one[-1].path
    assert all(r.text in long and r.n_words == len(r.text.split()) <= 350 for r in one)
    assert all(b.start_word < a.end_word for a, b in zip(one, one[1:])) and one[-1].end_word == len(long.split())


def test_overlap_must_be_below_the_limit():
    with pytest.raises(ValueError):
        splitting.split_batch(["a b"], 5, 5)


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.vocabulary())


def test_ids_equal_plain_merging_and_round_trip(enc):
    rnd = random.Random(9)
    pool = "abcđ ĐẠ  \n\t don't'll 12½²Ⅷ٣中🙂é_-.,;<|endoftext|>" + "aaaa"
    for _ in range(1500):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50)))
        ids = enc.encode(s)
        assert b"".join(enc.bytes_of[i] for i in ids) == s.encode()
        assert ids == [i for w in tokens._FULL.findall(s) for i in enc.merge(w.encode())]


def test_ids_equal_the_public_library(enc):
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(tokens.vocabulary().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    long = "ab" * 20000 + "Quyết định số 12/QĐ-UBND\r\n" * 50 + "x" * 3000
    for s in ["", " ", long, "<|endoftext|>", "a b  c", "người dân's"]:
        assert enc.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_encode_keeps_nulls_and_empties(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "một hai", "k")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[1] == got[2] == [] and len(got[3]) > 2
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df).collect()} == {1: 0, 2: 0, 3: len(got[3])}
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
