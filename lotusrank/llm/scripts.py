"""One form of spelling for text that looks the same: look-alike letters, held-apart accents, wide forms, unseen
characters and odd spaces."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like a Latin letter (after the public Unicode confusables list).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝӏѵ", "ABESIJKMHOPCTYXaesijopcyxdhqwlv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχϲ", "ABEZHIKMNOPTYXayikvoptuxc"))
ARMENIAN = dict(zip("ՕՍոսհցզ", "OUnuhgq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
# Latin letters that look like another Latin letter of the text's language.
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g"}
SCRIPTS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "LISU": LISU}
TO_LATIN = {k: v for letters in SCRIPTS.values() for k, v in letters.items()}
#: The other way: how a look is spelt in each script; of two letters of one look the first.
SPELT = {name: {v: k for k, v in reversed(letters.items())} for name, letters in SCRIPTS.items()}

UNSEEN = "\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufe00-\ufe0f"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_TONES = ("", "\u0300", "\u0301", "\u0303", "\u0309", "\u0323")
_BASES = [*"aeiouyAEIOUY", *(x + "\u0302" for x in "aeoAEO"), *(x + "\u0306" for x in "aA"), *(x + "\u031b" for x in "ouOU")]
VIET = "".join(sorted({unicodedata.normalize("NFC", b + t) for b in _BASES for t in _TONES} | {"đ", "Đ"}))
#: What may call for a change; texts without a match are in their one form.
WIDE = "\uff01-\uff5e\uff61-\uffdc\uffe0-\uffe6\ufb00-\ufb06\U0001d400-\U0001d7ff"
SUSPECT = re.compile(f"[\u0300-\u036f{UNSEEN}{SPACES}{WIDE}\u0370-\u058f\u1f00-\u1fff{''.join(TO_LATIN)}{''.join(LATIN)}]")

_LATIN = str.maketrans(LATIN)
_LOOKALIKE = re.compile("[" + "".join(TO_LATIN) + "\u0370-\u03ff\u0400-\u04ff\u1f00-\u1fff]")
_GAP = re.compile(r"[^\w\n]*")
_UNSEEN = re.compile(f"[{UNSEEN}]")
_SPACES = re.compile(f"[{SPACES}]")
_WIDE = re.compile(f"[{WIDE}]+")
#: Scripts that write with joiners; emoji sequences need them too.
_JOINED = ("ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "GUJARATI", "GURMUKHI", "SINHALA", "KHMER", "MYANMAR", "MONGOLIAN", "SYRIAC")


@lru_cache(maxsize=4096)
def script(ch: str) -> str:
    """The script of a letter, from its Unicode name; '' for marks and all else, which belong to any script."""
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "UNKNOWN ").split(" ")[0].replace("FULLWIDTH", "LATIN")


def look(c: str) -> str:
    """What a base letter looks like, as a Latin letter; '' if like none."""
    return TO_LATIN.get(c) or (c if script(c) == "LATIN" else "")


@lru_cache(maxsize=4096)
def resolved(ch: str) -> frozenset[str]:
    """All scripts in which a letter of this look exists."""
    seen = look(unicodedata.normalize("NFD", ch)[0])
    return frozenset({script(ch)} | ({"LATIN"} | {name for name, letters in SPELT.items() if seen in letters} if seen else set()))


def spelt(token: str, target: str) -> str:
    """The token with every letter of another script in its spelling of the script `target`."""
    def one(c: str) -> str:
        if not script(c) or script(c) == target:
            return c
        return TO_LATIN.get(c, c) if target == "LATIN" else SPELT[target].get(look(c), c)
    return unicodedata.normalize("NFC", "".join(map(one, unicodedata.normalize("NFD", token))))


def classify(token: str) -> tuple[str, str]:
    """(kind, script). `single`: one script, not to be read as Latin; `whole`: one other script, but every letter also reads
    as Latin; `mixed`: several scripts, all readable as the one given, which is Latin where that is possible, else one
    in which most of the letters are written; `foreign`: several scripts without such a reading."""
    sets = [resolved(c) for c in token if script(c)]
    if not sets:
        return "single", ""
    own = Counter(script(c) for c in token if script(c))
    common = frozenset.intersection(*sets)
    if len(own) == 1:
        name = next(iter(own))
        return ("whole", name) if name != "LATIN" and "LATIN" in common else ("single", name)
    if "LATIN" in common:
        return "mixed", "LATIN"
    most = max(own, key=lambda name: (own[name], name))
    return ("mixed", most) if most in common and 2 * own[most] > own.total() else ("foreign", "")


def _keeps_joiner(text: str, at: int) -> bool:
    left = text[at - 1] if at else ""
    right = text[at + 1] if at + 1 < len(text) else ""
    if not left or not right:
        return False
    if unicodedata.name(left, "").startswith(_JOINED) and unicodedata.name(right, "").startswith(_JOINED):
        return True
    return unicodedata.category(left) in ("So", "Sk") and unicodedata.category(right) == "So"


def normalize_text(text: str) -> str:
    """The text in its one form; what belongs there (line ends, tabs, superscripts, fractions, typographic signs, words
    wholly in another script) stays.

    Unseen characters go (but joiners inside scripts and emoji that need them), other spaces become the plain one,
    wide, narrow and mathematical forms and Latin ligatures their plain letters, accents are joined with their letter. For every token the
    scripts its letters can be read in are intersected: tokens of mixed scripts get the spelling of the script that is left
    (see classify), and tokens of one other script that can be read as Latin throughout get their Latin spelling, unless
    they stand beside a word that is certainly of that script, or are one Greek letter alone.
    """
    if not SUSPECT.search(text):
        return text
    if _UNSEEN.search(text):
        text = _UNSEEN.sub(lambda m: m.group() if m.group() in "\u200c\u200d\ufe0f" and _keeps_joiner(text, m.start()) else "", text)
    text = _SPACES.sub(" ", text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _LOOKALIKE.search(text):
        text = _respell(text)
    return _compose(text.translate(_LATIN))


def _letter(c: str) -> bool:
    return c.isalpha() or "\u0300" <= c <= "\u036f"


def _token_at(text: str, at: int) -> tuple[int, int]:
    lo = hi = at
    while lo and _letter(text[lo - 1]):
        lo -= 1
    while hi < len(text) and _letter(text[hi]):
        hi += 1
    return lo, hi


def _certain(text: str, lo: int, hi: int, own: str) -> bool:
    """Whether a word beside text[lo:hi], on its line, is of script `own` beyond doubt."""
    right = _GAP.match(text, hi).end()
    left = lo
    while left and not text[left - 1].isalnum() and text[left - 1] not in "_\n":
        left -= 1
    for at in (right, left - 1):
        if 0 <= at < len(text) and _letter(text[at]):
            word = text[slice(*_token_at(text, at))]
            if classify(word) == ("single", own):
                return True
    return False


def _respell(text: str) -> str:
    out, last, at = [], 0, 0
    while m := _LOOKALIKE.search(text, at):
        lo, hi = _token_at(text, m.start())
        at = max(hi, m.end())
        tok = text[lo:hi]
        kind, name = classify(tok)
        if kind == "whole":
            alone = name == "GREEK" and sum(1 for c in tok if script(c)) == 1
            if alone or _certain(text, lo, hi, name):
                continue
            name = "LATIN"
        if kind in ("mixed", "whole"):
            out += [text[last:lo], spelt(tok, name)]
            last = hi
    return "".join(out) + text[last:]


_MARKED = re.compile("[^\\W\\d_][\u0300-\u036f]+")


def _compose(text: str) -> str:
    """Letters with their accents in one; other characters with canonical equivalents are left as they are."""
    return _MARKED.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)


@F.pandas_udf(StringType())
def _normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda t: normalize_text(t) if t is not None else None)


def normalized(col: Column) -> Column:
    """Column in its one form; null stays null."""
    return _normalize(col)


def normalize(df: DataFrame, text: str, out: str = "normalized") -> DataFrame:
    """Adds `out`. Null stays null, blank text is treated as any other, repeated rows are kept."""
    return df.withColumn(out, normalized(F.col(text)))


def _changed(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # few texts at a time as Python objects
            keys, texts = batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256).to_pylist()
            odd = [i for i, t in enumerate(texts) if SUSPECT.search(t) and normalize_text(t) != t]
            if odd:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(odd))], names=["rec_id"])


def disguised(df: DataFrame, key: str, text: str, fld: str) -> DataFrame:
    """(fld, rec_id) of the records whose text is not in its one form; repeated rows count once, null keys are none.

    Texts pass through one Arrow stage, in which all but the suspect ones are only scanned; keys alone come back.
    """
    d = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("rec_id"), text)
    return d.mapInArrow(_changed, "rec_id string").distinct().select(F.lit(fld).alias("fld"), "rec_id")


def found(context: DataFrame, train: DataFrame) -> DataFrame:
    return disguised(context, "doc_id", "passage", "context.passage").unionByName(disguised(train, "qid", "question", "train.question"))
