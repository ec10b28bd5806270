import random
from collections import Counter

import numpy as np
import pytest

from lotusrank.llm import mixing, neighbours, overlap, pii


def rows(df):
    return sorted(map(tuple, df.collect()))


Q = "Pháp luật quy định mức xử phạt căn cứ văn bản nào đối với hộ kinh doanh mới đăng ký, đã nộp tờ khai thuế do lỗi của bên nhận ủy quyền tại Phòng Lao động Lộc Trì, từ 12 triệu đồng trở lên?"


def test_same_question_in_other_clothes(spark):
    other = Q.replace("12 triệu", "13 triệu")
    train = [("1", Q, ["d"], "a", "train"), ("2", other, ["d"], "a", "train"), ("3", None, None, None, "train"), ("4", " ", None, None, "train"), ("1", Q, ["d"], "a", "train"), ("9", Q.replace("hộ kinh doanh", "hợp tác xã"), ["d"], "b", "val")]
    ev = [("5", "Cho hỏi: " + Q.upper() + " Em cảm ơn.", None, "x", "public"), ("6", Q.replace("tờ khai thuế", "sổ bảo hiểm xã hội"), None, "x", "private"),
          ("7", "tu 12 trieu dong tro len, phap luat qd muc xu phatt can cu van ban nao doi voi ho kinh doanh moi dang ky, da nop to khai thuế do lỗi bên nhận ủy quyền tại Phòng Lao động Lộc Trì", None, None, "private"), ("8", None, None, "x", "public")]
    schema = "qid string, question string, answer array<string>, source string, fold string"
    t, e = spark.createDataFrame(train, schema), spark.createDataFrame(ev, schema)
    assert rows(overlap.found(t, e)) == [("1", "5"), ("1", "7")]
    n = len(overlap.canonical(Q)[0])  # one word of the second is misspelt
    assert sorted(map(tuple, overlap.counts(t, e).collect()), key=str) == sorted([("public", "x", 1, 1, n), ("private", None, 1, 1, n - 1)], key=str)
    assert rows(overlap.found(t.limit(0), e)) == []


def test_index_finds_every_segment():
    rnd = random.Random(4)
    for _ in range(30):
        recs = [[rnd.choice("abcd") for _ in range(rnd.randint(1, 12))] for _ in range(8)]
        qs = [[rnd.choice("abcde") for _ in range(rnd.randint(1, 12))] for _ in range(6)] + [recs[0]]
        q, rec, start, where = overlap.FullTextIndex(recs).seeds(qs, broken=99)
        first = np.cumsum([0] + [len(r) + 1 for r in recs])
        got = set(zip(q.tolist(), rec.tolist(), start.tolist(), (where - first[rec]).tolist()))
        want = set()
        for i, w in enumerate(qs):
            n = min(5, max(1, len(w) // 5))
            want |= {(i, j, a, b) for a in range(0, len(w) - n + 1, n) for j, r in enumerate(recs) for b in range(len(r) - n + 1) if w[a:a + n] == r[b:b + n]}
        assert got == want


def test_spans_are_the_longest_from_the_end():
    a, b = "mot hai ba bon nam sau bay tam".split(), "sau bay tam x mot hai ba bon".split()
    assert overlap.spans(a, b, 1) == [(0, 4), (5, 8)] and overlap.spans(a, b, 4) == [(0, 4)]
    rnd = random.Random(2)
    for _ in range(20):
        a, b = ([rnd.choice("abc") for _ in range(600)] for _ in range(2))
        whole = overlap.spans(a, b, 1)  # by the index of one text
        text, end = f" {' '.join(b)} ", 600
        for lo, hi in reversed(whole):
            assert hi <= end and f" {' '.join(a[lo:hi])} " in text and (not lo or f" {' '.join(a[lo - 1:hi])} " not in text)
            end = lo


def pairs_by_hand(data):
    can = {t: overlap.canonical(t)[0] for _, t, _ in data}
    return {(overlap.class_of(can[a]), overlap.class_of(can[b])) for _, a, s in data for _, b, u in data if s == "train" and u == "val" and overlap._numbers(can[a]) == overlap._numbers(can[b]) and overlap.same(can[a], can[b])}


def linked(spark, data, **kw):
    from pyspark.sql import functions as F
    recs = overlap.members(spark.createDataFrame(data, "k string, t string, s string"), "k", "t", F.col("s"), F.lit(None).cast("string"))
    return {(bytes(r.train), bytes(r.eval)) for r in overlap.class_links(recs, **kw).collect()}


def test_sharded_search_equals_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"tu{c}{d}" for c in "bcdghklm" for d in "aeiou"]
    base = [" ".join(rnd.choice(vocab) for _ in range(30)) + f" {rnd.choice([1, 1, 1, 2])}" for _ in range(60)]
    def slip(t):
        w = t.split()
        w[rnd.randrange(30)] += "x"
        at = rnd.randrange(30)
        return " ".join(w[at:] + w[:at])  # a clause that has moved
    data = [(f"t{i}", t, "train") for i, t in enumerate(base)] + [(f"e{i}", slip(rnd.choice(base)), "val") for i in range(40)]
    want = pairs_by_hand(data)
    assert len(want) >= 30
    for shard in (300_000, 500, 40):  # parts of each number's texts, then shards by words, these cut again
        assert linked(spark, data, shard=shard) == want


@pytest.mark.parametrize("slips", [1, 2])
def test_short_texts_with_slips_are_met(spark, slips):
    """Texts of 5 to 22 words, `slips` of them misspelt: all that the comparison calls the same are found."""
    rnd = random.Random(slips)
    def word():
        return "".join(rnd.choice("bcdfgklmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    def spoilt(w):
        at = rnd.randrange(len(w) - 1)
        return w[:at] + w[at + 1] + w[at] + w[at + 2:] if rnd.random() < 0.5 else w[:at] + w[at + 1:]
    data = []
    for i in range(600):
        w = [word() for _ in range(5 + i % 18)]
        data.append((f"t{i}", " ".join(w), "train"))
        for at in rnd.sample(range(len(w)), slips):
            w[at] = spoilt(w[at])
        data.append((f"e{i}", " ".join(w), "val"))
    want = pairs_by_hand(data)
    got = linked(spark, data)
    assert len(want) >= 500 and len(got & want) >= 0.99 * len(want) and got <= want


def test_one_very_long_text_in_both_splits(spark):
    import time
    began = time.time()
    long = "Điều kiện cấp phép, " * 60_000
    assert len(linked(spark, [("a", long, "train"), ("b", long[:-len("phép, ")] + "phtép", "val"), ("c", "ngắn", "val")])) == 1
    assert time.time() - began < 60


def test_slips_and_other_words():
    a = "bo cong ho so thue"
    assert overlap.same(a.split(), "bo cogn ho so thue".split()) and overlap.same(a.split(), (a + " nhuung").split())
    assert not overlap.same(a.split(), "bo sung ho so thue".split())
    assert not overlap.same(a.split(), "bo cong ho so dat".split()) and not overlap.same("muc 12".split(), "muc 13".split())


@pytest.mark.parametrize("a, b, d", [("khong", "kohng", 1), ("trieu", "tireu", 1), ("abc", "abc", 0), ("abc", "xyz", 3), ("quyet", "qyt", 2)])
def test_edits(a, b, d):
    assert overlap.edits(a, b, 2) == min(d, 3)


def brute_mutual(vecs, k, min_cos):
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(x @ x.T, 9)
    near = {}
    for a in range(len(ids)):
        order = sorted((-c[a, b], ids[b]) for b in range(len(ids)) if b != a and c[a, b] >= min_cos)
        near[ids[a]] = {i for _, i in order[:k]}
    return {(a, b) for a in ids for b in near[a] if a < b and a in near[b]}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    cent = rng.standard_normal((60, 16))
    vecs = {i: (cent[i % 60] + 0.15 * rng.standard_normal(16)) * rng.uniform(0.1, 9) for i in range(400)}
    for i in range(400, 430):
        vecs[i] = vecs[7] * 2.0
    data = [(i, [float(v) for v in x]) for i, x in vecs.items()]
    df = spark.createDataFrame(data + data[:20] + [(900, None), (901, [0.0] * 16), (902, []), (None, [1.0] * 16), (903, [float("nan")] * 16), (904, [1.0, 2.0])], "chunk_idx long, dense array<double>")
    want = brute_mutual(vecs, 5, 0.85)
    got = {tuple(r) for r in neighbours.mutual(neighbours.neighbours(df, "chunk_idx", "dense", 5, min_cos=0.85)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)
    split = {tuple(r) for r in neighbours.mutual(neighbours.neighbours(df, "chunk_idx", "dense", 5, min_cos=0.85, most=50)).collect()}
    assert split == got  # splitting hot buckets loses nothing
    near = neighbours.neighbours(df, "chunk_idx", "dense", 5).filter("a = 429").collect()
    assert sorted(r.b for r in near) == [7, 400, 401, 402, 403]
    assert neighbours.neighbours(df.limit(0), "chunk_idx", "dense", 5).count() == 0


def test_probe_sets_come_in_order_and_never_contradict():
    sets = neighbours.probe_sets(6, 20)
    assert len(sets) == 20 == len(set(sets)) and sets[0] == (0,)
    assert all(len({min(j, 11 - j) for j in s}) == len(s) for s in sets)


def test_allocation():
    got = mixing.allocate({"a": 100, "b": 10, "d": 50}, {"a": 0.5, "b": 0.5, "c": 0.3, "d": 0.0}, {"a": 2, "b": 3, "c": 1, "d": 1}, 100)
    assert got == {"a": 70.0, "b": 30.0, "c": 0.0, "d": 0.0}
    assert mixing.allocate({}, {"a": 1.0}, {"a": 1}, 10) == {"a": 0.0}
    assert mixing.exact_total({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "c": 1.0}, {"a": 1, "b": 3, "c": 1}) == 60.0


def test_mixture(spark):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["big", "big", "big", "small", None, "unlisted"]), rnd.randint(0, 60)) for i in range(900)]
    df = spark.createDataFrame(docs + docs[:30], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("big", 1.0, 1), ("small", 8.0, 2), ("none", 1.0, 3), ("small", 8.0, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mix, shares = mixing.mixture(df, t, total=None, block=100)
    m = mix.collect()
    uses = Counter((r.source, r.doc_id) for r in m)
    assert max(v for (s, _), v in uses.items() if s == "big") == 1 and max(uses.values()) == 2
    small = [d for d in docs if d[1] == "small" and d[2] > 0]
    assert {d[0] for d in small} == {i for s, i in uses if s == "small"}  # the capped source is used in full
    s = {r.source: r for r in shares.collect()}
    assert sum(r.n_tokens for r in m) == sum(x.n_tokens for x in s.values()) and abs(sum(x.actual_share for x in s.values()) - 1) < 1e-9
    assert s["none"].actual_share == 0 and s["small"].n_tokens == 2 * sum(d[2] for d in small)
    # every stretch of the schedule holds both sources in their proportions
    order = sorted({(r.slot, r.source) for r in m})
    n = len(order)
    for lo in range(0, n - 40, 20):
        part = sum(x[1] == "small" for x in order[lo:lo + 40]) / 40
        assert abs(part - sum(x[1] == "small" for x in order) / n) < 0.12
    empty, sh = mixing.mixture(df.limit(0), t)
    assert empty.count() == 0 and all(r.actual_share == 0 for r in sh.collect())


def test_shares_are_exact_by_default(spark):
    rnd = random.Random(3)
    docs = [(i, "abc"[min(2, i % 10 // 4)], rnd.randint(20, 60)) for i in range(3000)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.3, 3), ("d", 0.4, 1)], "source string, weight double, max_repeats int")
    _, shares = mixing.mixture(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), t, block=200)
    assert {r.source: round(r.actual_share, 2) for r in shares.collect()} == {"a": 0.5, "b": 0.2, "c": 0.3, "d": 0.0}


@pytest.mark.parametrize("blocks", [[("a", 20_000), ("b", 1)], [("a", 7), ("b", 300), ("c", 300)], [("a", 1)]])
def test_schedule_is_a_permutation_as_long_as_the_blocks(spark, blocks):
    got = [(r.source, r.block, r.slot) for r in mixing.schedule(spark, blocks).collect()]
    total = sum(n for _, n in blocks)
    assert sorted(s for *_, s in got) == list(range(total)) and sorted(x[:2] for x in got) == sorted((s, k) for s, n in blocks for k in range(n))
    half = [s for s, _, slot in got if slot < total / 2]
    for s, n in blocks:
        assert abs(half.count(s) - n / 2) <= 4


def test_personal_information(spark):
    texts = []
    for i in range(40):
        texts.append(f"Kính gửi: {'bà ' if i % 4 else ''}Quạch Nhuận {'Hòe' if i % 2 else 'Khoa'}; bản sao gửi khoa{i}(at)mail[dot]test, <a.b@X.Example>.")
        texts.append(f"Mọi thắc mắc gọi {'+84 61 226 4' + str(100 + i) if i % 2 else '0612 264 ' + str(100 + i)}. Số lô 0612.264.{100 + i}, giá 12.500.000 đồng. Mã hồ sơ 91626781139{i % 10}.")
    texts += ["CMND: 855.657.799; HC: q-2381015; số định danh cá nhân 0974.5433.6661; Biên lai số 6524514854", "Em ở số nhà 12B/3, ngõ 5 phố Lau Dạ, đường Hồng Sơn dài 120 mét. Trường mầm non Tuyển Dẫn.", None, "", "Flat 4, 271A Harrowgate Lane; +1 (202) 555-0190"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, kind string")
    got = {tuple(r) for r in pii.found(df, labelled=1.0).collect()}
    assert (0, "name", "quạch nhuận khoa") in got and (0, "email", "khoa0@mail.test") in got and (0, "email", "a.b@x.example") in got
    assert (1, "phone", "0612264100") in got and (3, "phone", "0612264101") in got
    assert {x[1:] for x in got if x[0] == 80} == {("id", "855657799"), ("id", "Q2381015"), ("id", "097454336661")}
    assert {x[1:] for x in got if x[0] == 81} == {("address", "12b/3")}
    assert {x[1:] for x in got if x[0] == 84} == {("address", "271a"), ("phone", "12025550190")}
    assert not any(x[0] % 2 == 1 and x[0] < 80 and x[1] in ("id", "name", "address") for x in got)
    red = {r.doc_id: r.text for r in pii.redact(df, labelled=1.0).collect()}
    assert red[82] is None and red[83] == "" and red[81].startswith("Em ở số nhà [ADDRESS], ngõ 5") and red[0] == "Kính gửi: [NAME]; bản sao gửi [EMAIL], <[EMAIL]>."
    assert "Số lô 0612.264.100" in red[1]
    assert pii.found(df.limit(0)).count() == 0


def test_what_no_seed_marks_is_discovered(spark, monkeypatch):
    """Seeds stand in 30 % of the documents; the rest of all five kinds comes through patterns learnt from these."""
    rnd = random.Random(12)
    family, given, streets = ["Quạch", "Nghiêm", "Tạ", "Lục"], ["Nhuận Hòe", "Bích Thảo", "Văn Kha", "Thị Sen"], ["Lau Dạ", "Hồng Sơn", "Tân Lập"]
    texts = []
    for i in range(400):
        name = f"{rnd.choice(family)} {rnd.choice(given)}"
        texts.append(rnd.choice([
            f"Người làm đơn: {rnd.choice(['ông ', 'bà ', ''])}{name}, trú tại số {i + 1} đường {rnd.choice(streets)}.",
            f"Liên hệ thư điện tử u{i}@mail.test hoặc điện thoại +84 61 226 {4000 + i}.",
            f"Căn cước công dân số {100000000000 + 7 * i}, cấp năm 2019.",
            f"Số biên lai {200000000000 + 7 * i}, lô đất thứ {i}.",
            f"Gọi điện thoại 0612 26{1000 + i} để được giải đáp."]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, part = ({tuple(r) for r in pii.found(df, labelled=x).collect()} for x in (1.0, 0.3))
    assert Counter(k for _, k, _ in whole).keys() == set(pii.KINDS)
    for kind in pii.KINDS:
        want = {x for x in whole if x[1] == kind}
        assert len(want & part) >= 0.95 * len(want) and len({x for x in part if x[1] == kind} - want) <= 0.02 * len(want), kind
    assert not any("biên lai" in texts[d] for d, k, _ in part if k == "id")
    monkeypatch.setattr(pii, "TYPES_EVERYWHERE", 0)  # too many types to send around
    assert {tuple(r) for r in pii.found(df, labelled=0.3).collect()} == part


def test_long_texts_stay_linear():
    import time
    began = time.time()
    pii.mentions("1" * 200_000 + "x " + "a." * 100_000 + " " + "Ab " * 60_000 + "0912 " * 40_000 + "a@b.cd " * 5000 + "12345678 " * 5000)
    overlap.canonical("a vay " * 100_000 + "hỏi " + "xin cho hoi " * 50_000)
    assert time.time() - began < 30
