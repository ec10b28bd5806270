import re

import pytest
from pyspark.sql import functions as F

from lotusrank.functions import text as T
from lotusrank.operators import chunking, render


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw", ["a\r\n\r\n\nb \t c", " x ", "", " \n ", "Điều 1\x0b", "a b"])
def test_clean_equals_plain_python(spark, raw):
    want = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", raw.replace("\r", ""))).strip()
    assert one(spark, T.clean(F.col("a")), a=raw) == want
    assert one(spark, T.words(F.col("a")), a=raw) == raw.split()


def test_titles(spark):
    df = spark.createDataFrame([("Luật-A-b", "x"), (None, "http://a/luat/Ten-Dai-123.aspx"), ("", "http://a/b"), (None, None)], "n string, l string")
    assert [r.x for r in df.select(T.title(F.col("n"), F.col("l")).alias("x")).collect()] == ["Luật A b", "Ten Dai", "", ""]


def test_header_snippet_anchor_highlight(spark):
    t = "Tên > Điều 4a\nĐiều 4a. Một\nhai <b>"
    assert one(spark, T.header_title(F.col("a")), a=t) == "Tên"
    assert one(spark, T.snippet(F.col("a"), 12), a=t) == "Điều 4a. Một"
    assert one(spark, T.anchor(F.col("a")), a="Khoản > Điều 4a") == "dieu-4a" and one(spark, T.anchor(F.col("a")), a="Phần 1") == ""
    assert one(spark, T.highlight(T.escape(F.col("a")), ["hai", "một hai"]), a="Một hai haiku <hai>") == "<mark>Một hai</mark> haiku &lt;<mark>hai</mark>&gt;"


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 448, 449, 600, 1000])
def test_windows(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, chunking.window_pieces(F.col("a")), a=text)
    assert got == chunking.windows(text)
    if n > 256:
        assert got[0].split()[0] == "w0" and got[-1].split()[-1] == f"w{n - 1}" and all(g.split()[0] == f"w{192 * i}" for i, g in enumerate(got))


def w(n, tag="x"):
    return " ".join(f"{tag}{i}" for i in range(n))


def chunk(spark, passage, name="Tên", link=None):
    d = spark.createDataFrame([("7", name, link, passage)] * 2, "doc_id string, name string, link string, passage string")
    return sorted(chunking.chunk(d).collect(), key=lambda r: r.chunk_no)


def test_articles_and_preamble(spark):
    for head, labels in ((29, ["Điều 1", "Điều 2a"]), (31, ["Phần mở đầu + Điều 1", "Điều 2a"]), (32, ["Phần mở đầu", "Điều 1", "Điều 2a"])):
        got = chunk(spark, f"{w(head)}\n\nĐiều 1. Một\n{w(40)}\n Điều 2a: Hai\n{w(40)}")
        assert [r.path for r in got] == labels and {r.tier for r in got} == {1}
        assert got[-1].text.startswith("Tên > Điều 2a\nĐiều 2a: Hai\n") and got[-1].n_words == 43 and got[0].chunk_id == "7#0"


def test_small_articles_join_the_one_before(spark):
    got = chunk(spark, f"Điều 1. {w(40)}\nĐiều 2. ngắn\nĐiều 3. ngắn\nĐiều 4. {w(40)}")
    assert [r.path for r in got] == ["Điều 1-3", "Điều 4"]


def test_long_article_goes_by_clause_and_window(spark):
    body = f"Điều 5. Tên điều\n1. {w(100)}\n2. {w(10)}\n3. {w(400)}\n4. {w(50)}"
    got = chunk(spark, body)
    assert [r.path for r in got] == ["Điều 5 > Khoản 1-2", "Điều 5 > Khoản 3 > phần 1", "Điều 5 > Khoản 3 > phần 2", "Điều 5 > Khoản 4"]
    assert {r.tier for r in got} == {2} and all(r.text.split("\n")[1] == "Điều 5. Tên điều" for r in got)
    assert [r.path for r in chunk(spark, f"Điều 5. Tên\n{w(400)}")] == ["Điều 5 > phần 1", "Điều 5 > phần 2"]


def test_tiers_zero_and_three(spark):
    assert [(r.tier, r.chunk_id, r.text) for r in chunk(spark, " ", "Chỉ-tên")] == [(0, "7#t0", "Chỉ tên")]
    assert chunk(spark, None, None) == []
    got = chunk(spark, w(300), None)
    assert [(r.tier, r.path) for r in got] == [(3, "Phần 1"), (3, "Phần 2")] and got[0].text.startswith("Phần 1\nx0 ")


def test_ordinals_follow_document_order(spark):
    d = spark.createDataFrame([(f"{i:03d}", j) for i in range(20) for j in range(i % 4)], "doc_id string, chunk_no int").repartition(6)
    got = sorted(((r.doc_id, r.chunk_no), r.chunk_idx) for r in chunking.ordinals(d).collect())
    assert [x[1] for x in got] == list(range(len(got)))


@pytest.mark.parametrize("text, want", [
    ("Điều 1. Phạm\nvi điều chỉnh\nxong.\ntiếp theo", ["Điều 1. Phạm vi điều chỉnh xong.", "tiếp theo"]),
    ("\n-----\nmở đầu\n\nvà hết;\n1. khoản\n a) điểm\n- gạch", ["mở đầu và hết;", "1. khoản", "a) điểm", "- gạch"]),
    ("Chương I\nMục 2\nMục lục\n===\nPhần X", ["Chương I", "Mục 2 Mục lục", "Phần X"]),
    ("hết.\"\ndòng\n\t\nnữa!)\ncuối", ["hết.\"", "dòng nữa!)", "cuối"]), ("", []), (" \n.-.\n", []), ("xong:", ["xong:"]),
])
def test_reflow(spark, text, want):
    assert one(spark, render.reflow(F.col("a")), a=text) == want


def test_html(spark):
    d = spark.createDataFrame([("1", "Chương I\nĐiều 1. Một & hai\n1. khoản\na) điểm\nĐiều 1. lại\nMục 1\nthường.")], "doc_id string, passage string")
    assert render.html(d, ["hai"]).first().html == ("<h2>Chương I</h2>\n<h3 id='dieu-1'>Điều 1. Một &amp; <mark>hai</mark></h3>\n<p class=\"khoan\">1. khoản</p>\n<p class=\"diem\">a) điểm</p>\n<h3>Điều 1. lại</h3>\n<h4>Mục 1 thường.</h4>")


def test_window_of_a_long_document(spark):
    d = spark.createDataFrame([("1", "tên", None, "Điều 1. Một.\n" + "dài " * 30 + ".\nĐiều 2. Hai hai.\n" + "đuôi " * 30)], "doc_id string, name string, link string, passage string")
    whole = render.html(d, []).first()
    assert not whole.truncated and "Điều 1" in whole.html
    part = render.html(d, ["hai"], 60, "Điều 2").first()
    assert part.truncated and "Điều 1" not in part.html and "<h3 id='dieu-2'>Điều 2. <mark>Hai</mark> <mark>hai</mark>." in part.html
    page = render.view(d, "1", ["hai"], "Điều 2").first()
    assert (page.name, page.link, page.anchor, page.truncated) == ("tên", "", "dieu-2", False) and page.html.count("<mark>") == 2
    assert render.view(d, "2", []).count() == 0 and render.view(d.withColumn("passage", F.lit(None).cast("string")), "1", []).first().html == ""


def test_repeated_documents_are_chunked_once(spark, monkeypatch):
    d = spark.createDataFrame([("1", "a", None, "một hai"), ("1", "a", None, "một hai"), ("1", "b", None, "một"), ("2", "c", None, "ba"), (None, "d", None, "bốn")], "doc_id string, name string, link string, passage string")
    want = [("1", "a > Phần 1\nmột hai"), ("2", "c > Phần 1\nba")]
    assert sorted((r.doc_id, r.text) for r in chunking.chunk(d).collect()) == want
    monkeypatch.setattr(chunking, "REPEATED_HERE", 0)  # too many repeats to send around
    assert sorted((r.doc_id, r.text) for r in chunking.chunk(d).collect()) == want


def test_small_parts_pile_up_in_one_run():
    p = [chunking.numbered(f"Điều {i}", w(n)) for i, n in ((1, 5), (2, 6), (3, 40), (4, 31), (5, 32))]
    assert [x for x, _ in chunking.together(p)] == ["Điều 1-4", "Điều 5"]
    assert [x for x, _ in chunking.together(p[:2])] == ["Điều 1-2"] and chunking.together([]) == []
    assert [x for x, _ in chunking.together([chunking.numbered("Điều 4a", w(40)), chunking.numbered("Điều 5", w(3))])] == ["Điều 4a + Điều 5"]
