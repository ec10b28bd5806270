"""Rules over submissions, as findings (severity, code, qid, detail)."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 5
RAW = "qid string, kind string, has_answer boolean, answer_kind string, answer string"


def set_rules(lists: DataFrame, reference: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """E005/E006 (missing, extra questions), E011 (blank id), E012 (id repeated), E014 (id unknown to the corpus), W001
    (no id), W002 (too many) over typed lists (qid, answer array<string>). Null answers are E009."""
    blank = lambda x: F.coalesce(x.rlike(r"^[\x09-\x0d\x1c-\x20\x85\p{Z}]*$"), F.lit(True))
    one = lambda severity, code, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    none = F.array().cast("array<struct<severity:string,code:string,detail:string>>")
    a = F.col("answer")
    blanks = F.filter(F.transform(a, lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    # all that a list says about itself comes from one pass over the lists
    own = F.concat(F.when(a.isNull(), F.array(one("error", "E009", F.lit("")))).otherwise(none), F.when(F.size(a) == 0, F.array(one("warning", "W001", F.lit("")))).otherwise(none),
                   F.when(F.size(a) > MOST, F.array(one("warning", "W002", F.size(a).cast("string")))).otherwise(none),
                   F.coalesce(F.transform(blanks, lambda i: one("error", "E011", i.cast("string"))), none))
    ids = lists.select("qid", F.explode("answer").alias("id"))
    out = [lists.select("qid", F.explode(own).alias("f")).select("f.severity", "f.code", "qid", "f.detail"),
           _rule(ids.filter("id is not null").groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "error", "E012", F.col("id"))]  # over all lists of a question
    if corpus is not None:
        out.append(_rule(ids.filter(~blank(F.col("id"))).join(corpus.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti").select("qid", "id").distinct(), "error", "E014", F.col("id")))
    if reference is not None:
        ref, own = reference.select("qid").distinct(), lists.select("qid").distinct()
        out += [_rule(ref.join(own, "qid", "left_anti"), "error", "E005", F.lit("")), _rule(own.join(ref, "qid", "left_anti"), "error", "E006", F.lit(""))]
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def _rule(df: DataFrame, severity: str, code: str, detail) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("qid"), detail.alias("detail"))


def summary(findings: DataFrame, examples: int = 5) -> DataFrame:
    """(severity, code, findings, questions, examples): complete counts, and the smallest few questions of each code."""
    by = ["severity", "code"]
    first = findings.filter("qid is not null").select(*by, "qid").distinct().withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("qid"))).filter(F.col("r") <= examples)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list("qid")).alias("examples"))
    d = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("qid").alias("questions"))
    return d.join(first, by, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


class _Twice(dict):
    """A JSON object that remembers which keys came more than once."""

    def __init__(self, pairs):
        super().__init__(pairs)
        self.twice = sorted(k for k, n in Counter(k for k, _ in pairs).items() if n > 1)


def read_file(name: str, data: bytes) -> tuple[object | None, list[tuple[str, str, str]]]:
    """The JSON value of a submission file (zip or bare JSON) and findings E001-E003, W003, W004. One file, at the driver."""
    found: list[tuple[str, str, str]] = []
    if name.lower().endswith(".json"):
        found.append(("warning", "W004", name))
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                entries = [i.filename for i in z.infolist() if not i.is_dir()]
                junk = [e for e in entries if e.startswith("__MACOSX/") or e.rsplit("/", 1)[-1] in (".DS_Store", "Thumbs.db", "desktop.ini")]
                real = [e for e in entries if e not in junk]
                if junk:
                    found.append(("warning", "W003", ", ".join(junk)))
                if "submission.json" not in real:
                    nested = [e for e in real if e.endswith("/submission.json")]
                    return None, [*found, ("error", "E001", f"nested: {nested[0]}" if nested else "no submission.json at the root")]
                if len(real) > 1:
                    found.append(("error", "E002", ", ".join(e for e in real if e != "submission.json")))
                data = z.read("submission.json")
        except zipfile.BadZipFile:
            return None, [("error", "E001", "no zip file")]
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as x:
        return None, [*found, ("error", "E003", f"not UTF-8: {x.reason}")]
    try:
        return json.loads(text, object_pairs_hook=_Twice), found
    except json.JSONDecodeError as x:
        return None, [*found, ("error", "E003", x.msg)]


def validate_file(spark: SparkSession, name: str, data: bytes, reference: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """All findings of a submission file. Types matter: the id 1 is no string. E007, E008 and E009 end the checks of a
    question; ids that are no strings (E010) take no part in E011, E012 and E014."""
    value, found = read_file(name, data)
    rows = [(s, c, None, d) for s, c, d in found]
    lists: list[tuple[str, list[str]]] | None = None
    if value is not None or not any(c in ("E001", "E003") for _, c, _ in found):
        if not isinstance(value, dict) or not value:
            rows.append(("error", "E004", None, "empty" if isinstance(value, dict) else type(value).__name__))
        else:
            rows += [("error", "E013", q, "") for q in value.twice]
            lists = []
            for q, v in value.items():
                if not isinstance(v, dict):
                    rows.append(("error", "E007", q, type(v).__name__))
                elif "answer" not in v:
                    rows.append(("error", "E008", q, ""))
                elif not isinstance(v["answer"], list):
                    rows.append(("error", "E009", q, type(v["answer"]).__name__))
                else:
                    a = v["answer"]
                    rows += [("error", "E010", q, repr(x)) for x in a if not isinstance(x, str)]
                    rows += [("warning", "W001", q, "")] if not a else [("warning", "W002", q, str(len(a)))] if len(a) > MOST else []
                    lists.append((q, [x for x in a if isinstance(x, str)]))
    if reference is None:
        rows.append(("warning", "W005", None, ""))
    schema = "severity string, code string, qid string, detail string"
    out = spark.createDataFrame(rows, schema)
    if lists is not None:
        # every question of the file takes part in E005 and E006, whatever its value
        typed = spark.createDataFrame(lists, "qid string, answer array<string>")
        sets = set_rules(typed, None, corpus).filter("code not in ('W001', 'W002')")
        out = out.unionByName(sets)
        if reference is not None:
            own = spark.createDataFrame([(q,) for q in value], "qid string")
            ref = reference.select("qid").distinct()
            out = out.unionByName(_rule(ref.join(own, "qid", "left_anti"), "error", "E005", F.lit(""))).unionByName(_rule(own.join(ref, "qid", "left_anti"), "error", "E006", F.lit("")))
    return out
