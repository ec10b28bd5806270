"""Personal information in free text: bootstrapped contextual extraction of e-mail addresses, telephone and identity
numbers, street addresses and names, and their replacement by typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lotusrank.functions.scale import cut
from lotusrank.llm.scripts import VIET

KINDS = ("email", "phone", "id", "address", "name")
# The words that tell a seed of each kind; all other contexts are learnt from the corpus.
TITLES = r"(?:ông\s*\(bà\)|ông/bà|ông|bà|anh|chị|cô|chú|bác|đồng chí|luật sư|mr|mrs|ms|miss|dr|prof|sir|madam)"
ID_CUES = r"(?:cmnd|cmt|cccd|căn cước|chứng minh|định danh|hộ chiếu|passport|identity card|id card|mst cá nhân|mã số thuế cá nhân|hc)"
STREET_EN = "road|lane|street|avenue|square|court|close|drive|way|row|terrace|place|boulevard|crescent|gardens|hill"
STREET_VI = "đường|phố|ấp|thôn|xóm|đại lộ|khu phố|khóm|buôn|bản"
BRANCH_VI = "tổ|ngõ|ngách|hẻm|kiệt|khu|cụm"
AREA_VI = "quận|phường|thị trấn|xã|huyện|thị xã|thành phố|tỉnh|tp"

_U = "A-Z" + "".join(sorted({c for c in VIET if c.isupper() and not c.isascii()} | {chr(c) for c in range(0xC0, 0xDF) if c != 0xD7}))
_CAP = rf"[{_U}](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
_AT = r"(?:@|\((?:at|AT|a còng)\)|\[(?:at|AT|a còng)\])"
_PERIOD = r"(?:\.|\[dot\]|\(dot\)|\[chấm\]|\(chấm\))"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._+-])([A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?)[ \t]*{_AT}[ \t]*([A-Za-z0-9][A-Za-z0-9-]*(?:{_PERIOD}[A-Za-z0-9-]+)+)(?![A-Za-z0-9_])")
_DOT = re.compile(r"\[dot\]|\(dot\)|\[chấm\]|\(chấm\)")
_NUM = re.compile("(?<![\\w.,+-])(?:\\(\\+?\\d{1,4}\\)|\\+?\\d++)(?:(?: - |[ \u00a0.\\-])?\\(\\d++\\)|(?: - |[ \u00a0.\\-])\\d++|(?<=\\))\\d++)*(?!\\w)")
_PASS = re.compile(r"(?<![\w-])[A-Za-z][- ]?\d{7,8}(?![\w-])")
_HOUSE = re.compile(r"(?<![\w/.,+-])\d{1,4}[A-Za-z]?(?:/\d{1,4}[A-Za-z]?)*(?![\w/]|[.,]\d|[ .-]\d{2})")
_NAME = re.compile(rf"(?<![\w'’-]){_CAP}(?:[ \u00a0]+{_CAP})+")
_TITLED = re.compile(rf"(?i)(?<!\w){TITLES}\.?\s+$")
_TITLE_HEAD = re.compile(rf"(?i:{TITLES})\.?[ \u00a0]+|{_CAP}[ \u00a0]+(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir)[ \u00a0]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_RUN = re.compile(r"\d+")
_SOLID = re.compile(r"\S+")
_PLAIN = re.compile(r"[A-Za-z0-9._+-]+")
_CUED = re.compile(rf"(?:^|\s)({ID_CUES}(?:\s(?:số|no|number|công dân|nhân dân|cá nhân)){{0,3}})$")
_VI_STREET = re.compile(rf"\s*,?\s*(?:(?i:{BRANCH_VI})\s+\d[\w/]*\s*,?\s*)*(?i:{STREET_VI})\s+[{_U}]")
_VI_AREA = re.compile(rf"\s+{_CAP}(?:\s+{_CAP})*\s*,\s*(?i:{AREA_VI})\s+[{_U}]")
_EN_STREET = re.compile(rf",?\s+{_CAP}(?:\s+{_CAP}){{0,3}}?\s+(?i:{STREET_EN})(?!\w)")
_TWO_CAPS = re.compile(rf"\s+{_CAP}\s+{_CAP}")
_NO_HOUSE = re.compile(rf"(?i)(?:điều|khoản|mục|chương|phần|tờ|thửa|lô|{BRANCH_VI}|flat|unit|article|section|page|lot|sheet)\s*$")


def mask(token: str) -> str:
    """A token as a context sees it: a number is one sign, a capitalised word another."""
    return "<0>" if token[0].isdigit() else "<A>" if token[0].isupper() else token


def contexts(text: str, left_end: int, right: int, depth: int = 2) -> tuple[str, str]:
    """(left, cross): the `depth` tokens before left_end; the last of them together with the first from `right` on. The
    nearest token on the left keeps its word, the others are masked."""
    before = _TOKEN.findall(text, max(0, left_end - 40), left_end)[-depth:]
    next_ = _TOKEN.search(text, right, right + 30)
    after = mask(next_.group()) if next_ else "$"
    last = (before[-1].lower() if not before[-1][0].isdigit() else "<0>") if before else "^"
    return " ".join([mask(t) for t in before[:-1]] + [last]), f"{last} _ {after}"


def _fold(s: str) -> str:
    return unicodedata.normalize("NFC", " ".join(s.split())).lower()


def number_shape(raw: str) -> tuple[set[str], str, str]:
    """(kinds a number may be by its form, the kind it is for certain or '', normal form)."""
    digits = re.sub(r"\D", "", raw)
    n = len(digits)
    plus = raw.lstrip("(").startswith("+")
    if plus or digits.startswith("0084") and n in (13, 14):
        d = digits if plus else digits[2:]
        if d.startswith("84"):
            d = "0" + d[2:].removeprefix("0")
            return ({"phone"}, "phone" if plus or not raw.isdigit() else "", d) if n >= 10 and len(d) in (10, 11) else (set(), "", digits)
        return ({"phone"}, "phone", d) if 8 <= n <= 15 else (set(), "", digits)
    if raw.startswith("(0") and 9 <= n <= 11:
        return {"phone"}, "phone", digits
    kinds = set()
    if digits.startswith("0") and n in (10, 11):
        kinds.add("phone")
    if n in (9, 10, 12):
        kinds.add("id")
    return kinds, "", digits


def mentions(text: str) -> list[tuple]:
    """Candidates of every kind: (kind, lo, hi, found, seed, foe, left, cross, sign).

    seed: certain by its form or a cue beside it. foe: can't be of this kind, and so speaks against its context. sign: the
    form or the cue itself, as a pattern ('' if it has none).
    """
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []

    def free(lo: int, hi: int) -> bool:
        k = bisect_right(taken, (hi - 1, hi)) - 1  # the last address that starts before hi
        return k < 0 or taken[k][1] <= lo

    if "@" in text or "(a" in text or "[a" in text or "(A" in text or "[A" in text:
        for m in _EMAIL.finditer(text):
            out.append(("email", m.start(), m.end(), f"{m.group(1)}@{_DOT.sub('.', m.group(2))}".lower(), 1, 0, *contexts(text, m.start(), m.end()), _PLAIN.sub("a", m.group())))
            taken.append(m.span())
    end = 0  # of the last long number
    for run in _RUN.finditer(text):
        lo, hi = run.span()
        if hi - lo <= 4 and (m := _HOUSE.match(text, lo)) and free(*m.span()):
            street = _house(text, *m.span())
            if street is not None:
                out.append(("address", lo, m.end(), m.group().lower(), int(bool(street)), 0, *contexts(text, lo, m.end()), street))
        if 7 <= hi - lo <= 8 and lo:
            at = lo - 1 if text[lo - 1] not in "- " else lo - 2
            if at >= 0 and (m := _PASS.match(text, at)) and free(*m.span()):
                cue = _cued(text, at)
                out.append(("id", at, hi, re.sub(r"[^A-Za-z0-9]", "", m.group()).upper(), int(bool(cue)), 0, *contexts(text, at, hi, 3), cue))
        if lo >= end:
            first = lo - 1 if text[lo - 1:lo] == "+" else lo
            first -= text[first - 1:first] == "("
            for at in range(first, lo + 1):
                if m := _NUM.match(text, at):
                    end = m.end()
                    if sum(map(str.isdigit, m.group())) >= 8 and free(*m.span()):
                        out += _numbers(text, m)
                    break
    for m in _NAME.finditer(text):
        out += _names(text, m)
    return out


def _numbers(text: str, m: re.Match) -> list[tuple]:
    raw = m.group()
    kinds, sure, norm = number_shape(raw)
    cue = _cued(text, m.start())
    ctx = contexts(text, m.start(), m.end(), 3)
    out = []
    for kind in ("phone", "id"):
        seed = sure == kind or kind == "id" and bool(cue) and kind in kinds
        foe = kind not in kinds or kind == "phone" and bool(cue) and not sure
        sign = cue if kind == "id" else _RUN.sub(lambda r: str(len(r.group())), raw) if sure == kind else ""
        out.append((kind, m.start(), m.end(), norm, int(seed), int(foe), *ctx, sign))
    return out


def _cued(text: str, lo: int) -> str:
    """The words beside a number that announce an identity number, '' if there are none."""
    m = _CUED.search(re.sub(r"\W+", " ", _fold(text[max(0, lo - 40):lo])).strip())
    return m.group(1) if m else ""


def _house(text: str, lo: int, hi: int) -> str | None:
    """The word that tells a street behind a house number; '': perhaps, two capitalised words follow; None: no candidate."""
    if _NO_HOUSE.search(text[max(0, lo - 12):lo]):
        return None
    if m := _VI_STREET.match(text, hi) or _VI_AREA.match(text, hi):
        return m.group().split()[-2].lower()  # before the first letter of its name
    if m := _EN_STREET.match(text, hi):
        return m.group().split()[-1].lower()
    return "" if _TWO_CAPS.match(text, hi) else None


def _names(text: str, m: re.Match) -> list[tuple]:
    """The capitalised words as one candidate and, where the first may only open its sentence, also those after it. A name has
    two to six words: longer runs are headings and names of bodies."""
    words = [m.start() + w.start() for w in _SOLID.finditer(m.group())]
    head = _TITLE_HEAD.match(m.group())  # a title written large is no part of the name, nor is what stands before it
    cuts = [sum(w < m.start() + head.end() for w in words)] if head else [0, 1] if len(words) > 2 else [0]
    out = []
    for k in cuts:
        if not 2 <= len(words) - k <= 6:
            continue
        lo = words[k]
        title = _TITLED.search(text, max(0, lo - 24), lo)
        out.append(("name", lo, m.end(), _fold(text[lo:m.end()]), int(bool(title)), 0, *contexts(text, title.start() if title else lo, m.end()), _fold(title.group()).rstrip(".") if title else ""))
    return out


_COLS = ["doc_id", "kind", "lo", "hi", "found", "seed", "foe", "left", "cross", "sign"]
MENTION = "doc_id long, kind string, lo int, hi int, found string, seed int, foe int, left string, cross string, sign string"


def _extract(batches):
    for pdf in batches:
        yield pd.DataFrame([(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"]) for m in mentions(t)], columns=_COLS)


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return d.mapInPandas(_extract, MENTION)


TYPE = ["kind", "labelled", "seed", "foe", "left", "cross", "sign"]


def score_patterns(types: DataFrame, rounds: int = 3, sure: float = 0.6, support: int = 2) -> DataFrame:
    """Confidence of patterns, (kind, form, pattern, conf), by iteration over the pattern-instance graph.

    `types` holds mention types (TYPE) with their number n. Seeds stand in labelled documents only. A sign is judged by the
    share of seeds among the labelled mentions that bear it. Contexts are scored in rounds: a context's confidence is the
    share of accepted mentions among the decided ones it surrounds, and mentions are accepted if they are seeds or have a
    sign or context of confidence `sure` or more: seeds induce the first patterns, and what these discover supports
    further ones. Decided are accepted mentions and foes; where every candidate looks alike (names, house numbers), all
    are, in the first round those of labelled documents.
    """
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("pattern")) for f in ("left", "cross")]))
    signs = types.filter("labelled and sign != ''").groupBy("kind", F.col("sign").alias("pattern")).agg(F.sum("n").alias("seen"), (F.sum(F.col("seed") * F.col("n")) / F.sum("n")).alias("conf"))
    signs = cut(signs.select("kind", F.lit("sign").alias("form"), "pattern", "seen", "conf"))
    conf = None
    for _ in range(rounds):
        if conf is None:
            weighed = types.withColumn("w", F.col("seed").cast("double")).withColumn("alike", F.col("labelled"))
        else:
            weighed = verdicts(types, conf).withColumn("w", F.when(F.col("seed") == 1, 1.0).when((F.col("foe") == 0) & (F.col("score") >= sure), F.col("score")).otherwise(0.0)).withColumn("alike", F.lit(True))
        decided = (F.col("w") > 0) | (F.col("foe") == 1) | F.col("kind").isin("name", "address") & F.col("alike")
        got = (weighed.select("kind", "n", (F.col("w") * F.col("n")).alias("pos"), F.when(decided, F.col("n")).otherwise(0).alias("all"), forms.alias("e"))
               .groupBy("kind", "e.form", "e.pattern").agg(F.sum("n").alias("seen"), F.sum("pos").alias("pos"), F.sum("all").alias("all")))
        conf = cut(got.select("kind", "form", "pattern", "seen", F.when(F.col("pos") >= support, F.col("pos") / F.col("all")).otherwise(0.0).alias("conf")).unionByName(signs))
    return conf


def verdicts(types: DataFrame, conf: DataFrame, known: int = 5) -> DataFrame:
    """`types` with score: the confidence of the sign, or of the context on the left if that has been seen `known` times, else
    of the better of both contexts, whichever is more."""
    for form in ("left", "cross", "sign"):
        c = conf.filter(F.col("form") == form).select("kind", F.col("pattern").alias(form), F.struct("conf", "seen").alias(f"__{form}"))
        types = types.join(c, ["kind", form], "left")
    left, cross, sign = (F.coalesce(f"__{form}.conf", F.lit(0.0)) for form in ("left", "cross", "sign"))
    score = F.greatest(sign, F.when(F.col("__left.seen") >= known, left).otherwise(F.greatest(left, cross)))
    return types.withColumn("score", score).drop("__left", "__cross", "__sign")


#: Confidence from which a pattern makes its instances personal information; names often stand without their title.
SURE = {"email": 0.6, "phone": 0.6, "id": 0.6, "name": 0.3, "address": 0.3}


#: Up to so many accepted mention types go to where the mentions lie; beyond, both sides meet by type and salt.
TYPES_EVERYWHERE, SALTS = 200_000, 32


def entities(documents: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, labelled: float = 0.5) -> DataFrame:
    """(doc_id, kind, lo, hi, found): every accepted mention with its place in the text and its normal form.

    Seeds are marked in a share `labelled` of the documents, chosen by hash; all mentions everywhere are accepted by what
    the patterns learnt from these are worth, so what stands in the other documents is discovered, not listed. The graph
    is scored on mention types, which stay few; only their verdicts are joined back to the mentions. Null and empty
    texts and null keys hold nothing; repeated rows count once; where candidates share their start or end, the surer, then
    the longer stands. A corpus without seeds yields nothing.
    """
    m = candidates(documents, key, text).withColumn("labelled", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1000)) < round(1000 * labelled))
    m = cut(m.withColumn("seed", F.when(F.col("labelled"), F.col("seed")).otherwise(0)))
    types = cut(m.groupBy(*TYPE).agg(F.count(F.lit(1)).alias("n")))
    best = verdicts(types, score_patterns(types, rounds))
    need = F.lit(2.0)
    for k, v in SURE.items():
        need = F.when(F.col("kind") == k, F.lit(v)).otherwise(need)
    good = best.filter((F.col("foe") == 0) & (F.col("score") >= need)).select(*TYPE, "score")
    if good.limit(TYPES_EVERYWHERE + 1).count() <= TYPES_EVERYWHERE:
        kept = m.join(F.broadcast(good), TYPE)
    else:  # a common context would be one task's burden
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        kept = m.withColumn("__s", F.pmod(F.xxhash64("doc_id", "lo"), F.lit(SALTS)).cast("int")).join(good.withColumn("__s", salt), [*TYPE, "__s"]).drop("__s")
    kept = kept.repartition("doc_id")
    rank = [F.col("score").desc(), (F.col("hi") - F.col("lo")).desc(), F.col("kind"), F.col("found")]
    for side in ("lo", "hi"):
        kept = kept.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", side).orderBy(*rank))).filter("__r = 1").drop("__r")
    return kept.select("doc_id", "kind", "lo", "hi", "found")


def found(documents: DataFrame, labelled: float = 0.5) -> DataFrame:
    return entities(documents, labelled=labelled).select("doc_id", "kind", "found").distinct()


@F.pandas_udf(StringType())
def _replace(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, spans):
        if s is not None and t is not None:
            parts, last = [], 0
            for x in sorted(s):
                lo, hi, kind = x.split(" ")
                lo, hi = int(lo), int(hi)
                if lo >= last:
                    parts += [t[last:lo], f"[{kind.upper()}]"]
                    last = hi
            t = "".join(parts) + t[last:]
        out.append(t)
    return pd.Series(out)


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", labelled: float = 0.5) -> DataFrame:
    """(key, text): the texts with [EMAIL], [PHONE], [ID], [ADDRESS] or [NAME] in the place of each mention; all else,
    null and empty texts included, stays as it is."""
    e = entities(documents, key, text, labelled=labelled)
    spans = e.groupBy("doc_id").agg(F.collect_set(F.concat_ws(" ", F.lpad(F.col("lo").cast("string"), 10, "0"), F.col("hi").cast("string"), "kind")).alias("__s"))
    d = documents.select(F.col(key), F.col(text)).join(spans.withColumnRenamed("doc_id", "__k"), F.col(key) == F.col("__k"), "left")
    return d.select(key, F.when(F.col("__s").isNull(), F.col(text)).otherwise(_replace(text, "__s")).alias(text))
