"""Documents for reading: lines joined that were broken in mid-sentence, classed by structure, as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotusrank.functions.text import WS, anchor, bind, clean, escape, highlight, strip

# Marks of structure at the start of a line, of rules, and of a finished sentence.
STRUCTURE = rf"^(Chương{WS}+[IVXLCDM\p{{Nd}}]|Điều{WS}+\p{{Nd}}|Mục{WS}+\p{{Nd}}|Phần{WS}+[IVXLCDM\p{{Nd}}]|\p{{Nd}}+\.{WS}|[a-zđ]\){WS}|[-+*]{WS})"
RULE = rf"^([-_=–—.]|{WS})+$"
ENDED = r"[.;:!?][\"')\]]?$"
LIMIT = 400_000


def reflow(text: Column) -> Column:
    """Lines as an array: a line that opens no new unit continues the one before, unless that has ended its sentence;
    blank lines and rules are dropped."""
    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: (s != "") & ~s.rlike(RULE))

    def joined(lines: Column) -> Column:
        # a line is joined to the one before by a blank, or parted from it by a line end; only its neighbour matters
        def joint(s: Column, i: Column) -> Column:
            opens = s.rlike(STRUCTURE) | F.get(lines, i - 1).rlike(ENDED)
            return F.when(i == 0, s).when(opens, F.concat(F.lit("\n"), s)).otherwise(F.concat(F.lit(" "), s))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split(F.array_join(F.transform(lines, joint), ""), "\n"))
    return bind(kept, joined)


def kind(line: Column) -> Column:
    return (F.when(line.rlike(rf"^Chương{WS}+[IVXLCDM\p{{Nd}}]"), "h2").when(line.rlike(rf"^Điều{WS}+\p{{Nd}}+"), "h3").when(line.rlike(rf"^Mục{WS}+\p{{Nd}}"), "h4")
            .when(line.rlike(rf"^\p{{Nd}}+\.{WS}"), "khoan").when(line.rlike(rf"^[a-zđ]\){WS}"), "diem").otherwise("p"))


def lines(docs: DataFrame, limit: int | None = None, focus: str = "") -> DataFrame:
    """(doc_id, line_no, kind, anchor, line) of whole documents, or of a window of `limit` characters of each (see focused): an
    article's first line carries its anchor, later ones of the same number none."""
    text = clean(F.col("passage"))
    d = docs.select("doc_id", F.posexplode(reflow(text if limit is None else focused(text, focus, limit))).alias("line_no", "line"))
    d = d.withColumn("kind", kind(F.col("line"))).withColumn("a", F.when(F.col("kind") == "h3", anchor(F.col("line"))).otherwise(""))
    heads = d.filter("a != ''").groupBy("doc_id", "a").agg(F.min("line_no").alias("line_no"))
    d = d.join(heads.withColumnRenamed("a", "anchor"), ["doc_id", "line_no"], "left")
    return d.select("doc_id", "line_no", "kind", F.coalesce("anchor", F.lit("")).alias("anchor"), "line")


def html(docs: DataFrame, terms: list[str], limit: int | None = LIMIT, focus: str = "") -> DataFrame:
    """(doc_id, html, truncated): one string per document; of documents longer than `limit` characters the window at `focus`."""
    e = highlight(escape(F.col("line")), terms)
    tag = F.when(F.col("kind").isin("khoan", "diem"), F.concat(F.lit('<p class="'), "kind", F.lit('">'), e, F.lit("</p>")))
    tag = tag.when((F.col("kind") == "h3") & (F.col("anchor") != ""), F.concat(F.lit("<h3 id='"), "anchor", F.lit("'>"), e, F.lit("</h3>")))
    tag = tag.otherwise(F.concat(F.lit("<"), "kind", F.lit(">"), e, F.lit("</"), "kind", F.lit(">")))
    page = lines(docs, limit, focus).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", tag.alias("t")))), lambda x: x["t"]), "\n").alias("html"))
    long = docs.select("doc_id", (F.length(clean(F.col("passage"))) > F.lit(limit) if limit is not None else F.lit(False)).alias("truncated")).distinct()
    return page.join(long, "doc_id").select("doc_id", "html", "truncated")


def focused(text: Column, focus: str, limit: int = LIMIT) -> Column:
    """A window of `limit` characters that starts a quarter of it before the line that opens with `focus`."""
    at = F.regexp_instr(text, F.lit(rf"(?md)^\Q{focus}\E\b")) if focus else F.lit(0)
    start = F.greatest(F.lit(1), at - limit // 4)
    return F.when(F.length(text) > limit, F.substr(text, start, F.lit(limit))).otherwise(text)


def view(docs: DataFrame, doc_id: str, terms: list[str], focus: str = "") -> DataFrame:
    """(doc_id, name, link, html, truncated, anchor): one document for reading, with marked terms and the place to start at; a
    document without text is one empty page, an unknown one no row."""
    one = docs.filter(F.col("doc_id") == doc_id).select("doc_id", "name", "link", "passage").limit(1)
    page = html(one, terms, LIMIT, focus)
    d = one.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("link", F.lit("")).alias("link")).join(page, "doc_id", "left")
    return d.select("doc_id", "name", "link", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("truncated", F.lit(False)).alias("truncated"), anchor(F.lit(focus)).alias("anchor"))
