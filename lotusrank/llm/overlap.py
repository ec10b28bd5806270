"""Same or near-same records across splits: a full-text index of evaluation shards, searched backward by the training split."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lotusrank.functions.scale import cut, shuffle_parts
from lotusrank.llm.scripts import VIET, normalize_text

# Usual abbreviations of the language, without accents.
ABBREVIATIONS = {
    "bhxh": "bao hiem xa hoi", "bhyt": "bao hiem y te", "cty": "cong ty", "dn": "doanh nghiep", "gcn": "giay chung nhan", "hd": "hop dong",
    "htx": "hop tac xa", "nld": "nguoi lao dong", "nsdld": "nguoi su dung lao dong", "pc": "phong chay", "pccc": "phong chay chua chay", "qd": "quy dinh",
    "ubnd": "uy ban nhan dan", "hdnd": "hoi dong nhan dan", "tnhh": "trach nhiem huu han", "tphcm": "thanh pho ho chi minh",
    "vn": "viet nam", "ko": "khong", "dc": "duoc", "vs": "voi", "tt": "thi tran", "gd": "giao duc",
}
# Polite words at the start and at the end of a question, without accents.
OPENINGS = ["kinh gui ban bien tap", "kinh thua luat su", "kinh gui luat su", "thua luat su", "xin luat su cho biet", "xin luat su tu van", "luat su cho em hoi", "luat su cho toi hoi",
            "xin cho em hoi", "xin cho toi hoi", "xin cho hoi", "cho em hoi", "cho toi hoi", "cho minh hoi", "cho hoi", "em xin hoi", "toi xin hoi", "toi muon hoi", "em muon hoi",
            "ad oi", "luat su oi", "moi nguoi oi", "chao luat su", "xin chao", "em chao luat su"]
CLOSINGS = ["em cam on", "toi xin cam on", "toi cam on", "xin cam on", "em xin cam on", "cam on luat su", "cam on", "mong duoc giai dap", "mong luat su giai dap", "mong duoc tra loi",
            "xin tran trong cam on", "tran trong", "a", "vay a", "vay", "nhe", "the a"]
# Small words whose presence decides nothing, without accents.
SMALL = frozenset("tai cua co duoc tu neu nhu thi da vay la ma va o cho ve cac nhung a nhe".split())

# How the syllables of the language begin and end, without accents.
ONSETS = "ngh ng nh gh gi kh ph qu th tr ch b c d g h k l m n p q r s t v x".split()
RIMES = ("a ac ach ai am an ang anh ao ap at au ay e ec ech em en eng enh eo ep et eu i ia ich iec iem ien ieng iep iet ieu im in inh ip it iu "
         "o oa oac oach oai oam oan oang oanh oao oap oat oay oc oe oen oeo oet oi om on ong ooc oong op ot u ua uan uang uat uay uc ue uech uenh ui um un ung "
         "uo uoc uoi uom uon uong uop uot uou up ut uu uy uya uych uyen uyet uynh uyt uyu y yem yen yet yeu").split()

_WORD = re.compile(r"\w+")
_SYLLABLE = re.compile(f"(?:{'|'.join(ONSETS)})?(?:{'|'.join(RIMES)})")
_PLAIN = np.arange(0x2000, dtype=np.uint32)
for _c in VIET.lower():
    _PLAIN[ord(_c)] = ord(unicodedata.normalize("NFD", _c)[0].replace("đ", "d"))
_OPEN = re.compile(rf"(?:(?:{'|'.join(sorted(OPENINGS, key=len, reverse=True))}) )+(?=.)")
_CLOSE = re.compile(rf"(?<=.)(?: (?:{'|'.join(sorted(CLOSINGS, key=len, reverse=True))}))+$")
_LAST = frozenset(x.split()[-1] for x in CLOSINGS)
_SPELT = {k: v.split() for k, v in ABBREVIATIONS.items()}
CANON = StructType([StructField("cls", BinaryType()), StructField("line", StringType()), StructField("sig", LongType())])
#: Words in which two texts may differ on either side.
SLIPS = 4
#: Breaks that a match must survive: slips, and the seams of clauses that have moved.
BROKEN = 5


def known_syllable(word: str) -> bool:
    """Whether a word is a possible syllable of the language."""
    return bool(_SYLLABLE.fullmatch(word))


def _no_closing(words: list[str]) -> list[str]:
    end = len(words)
    while end and words[end - 1] in _LAST and (m := _CLOSE.search(" ".join(words[max(0, end - 40):end]))):
        end -= len(m.group().split())
    return words[:end]


def _unaccented(texts: list[str]) -> list[str]:
    """No disguise, no accents, no capitals; the usual letters of all texts at once."""
    whole = "\x00".join(normalize_text(t).replace("\x00", " ").lower() for t in texts)
    ch = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = ch < len(_PLAIN)
    ch = np.where(low, _PLAIN[np.where(low, ch, 0)], ch).astype("<u4")
    out = ch.tobytes().decode("utf-32-le", "surrogatepass").split("\x00")
    for i, s in enumerate(out):
        if not s.isascii():
            s = unicodedata.normalize("NFKD", s).replace("đ", "d")
            out[i] = "".join(c for c in s if not unicodedata.combining(c))
    return out


def plain_words(s: str) -> list[str]:
    """Words of an unaccented text in one spelling: abbreviations written out, no polite words around."""
    line = " ".join(_WORD.findall(s))
    if m := _OPEN.match(line):
        line = line[m.end():]
    words = _no_closing(line.split(" ")) if line else []
    if not _SPELT.keys() & set(words):
        return words
    out: list[str] = []
    for w in words:
        if w == "qd" and out and out[-1] == "ai":
            out += ["quyet", "dinh"]
        else:
            out += _SPELT.get(w, (w,))
    return out


def canonical(*texts: str) -> list[list[str]]:
    """The words of every text that decide what is asked, in the order of the text."""
    found = [plain_words(s) for s in _unaccented(list(texts))]
    return [[w for w in words if w not in SMALL] or words for words in found]


def class_of(words: list[str]) -> bytes:
    """Texts of equal words are one class: clause order leaves no trace."""
    return hashlib.blake2b(" ".join(sorted(words)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _numbers(words: list[str]) -> str:
    return " ".join(sorted(w for w in words if not w.isalpha() and any(c.isdigit() for c in w)))


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


@F.pandas_udf(CANON)
def _canonical(s: pd.Series) -> pd.DataFrame:
    words = canonical(*s)
    return pd.DataFrame({"cls": [class_of(w) for w in words], "line": [" ".join(w) for w in words], "sig": [_digest(_numbers(w)) for w in words]})


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 if it is more than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _small_slip(w: str) -> bool:
    return 4 <= len(w) <= 7 and any(len(s) >= 3 and edits(w, s, 1) == 1 for s in SMALL)


def same(a: list[str], b: list[str], known: Callable[[str], bool] = known_syllable, slips: int = SLIPS) -> bool:
    """Whether two word lists differ by slips of the pen only: every word on either side without its equal must be a
    misspelling (one edit, or two in words of four letters and more) of one on the other, or of a small word; at most
    `slips` in all, and none in numbers. Two `known` words are no misspelling of each other."""
    x, y = Counter(a), Counter(b)
    left, right = sorted((x - y).elements(), key=len, reverse=True), list((y - x).elements())
    if max(len(left), len(right)) > slips or any(c.isdigit() for w in left + right for c in w):
        return False
    for w in left:
        sure = known(w)
        near = [(edits(w, v, 2), v) for v in right if not sure or not known(v)]
        near = [(d, v) for d, v in near if d <= (2 if min(len(w), len(v)) >= 4 else 1) and min(len(w), len(v)) >= 3]
        if near:
            right.remove(min(near)[1])
        elif sure or not _small_slip(w):
            return False
    return all(not known(v) and _small_slip(v) for v in right)


class FullTextIndex:
    """FM-index over word sequences: the Burrows-Wheeler transform kept as one ascending position list per word.

    The number of times a word occurs before a position is a binary search in its list, so whole arrays of searches
    advance by one backward step at once.
    """

    def __init__(self, records: list[list[str]]):
        self.vocab: dict[str, int] = {}
        put = self.vocab.setdefault
        seqs = [[put(w, len(self.vocab)) + 1 for w in r] for r in records]
        lens = np.fromiter((len(s) + 1 for s in seqs), dtype=np.int64, count=len(seqs))
        text = np.zeros(int(lens.sum()) + 1, dtype=np.int64)
        at = 0
        for s in seqs:
            text[at:at + len(s)] = s
            at += len(s) + 1
        self.record = np.repeat(np.arange(len(seqs) + 1), np.r_[lens, 1]).astype(np.int32)
        self.start = np.r_[0, np.cumsum(lens)]
        n = self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1]
        step = 1
        while True:  # suffix order by prefix doubling
            nxt = np.full(n, -1, dtype=np.int64)
            nxt[:n - step] = rank[step:]
            key = rank * (n + 1) + nxt + 1
            uniq, new = np.unique(key, return_inverse=True)
            if len(uniq) == n or step >= n:
                rank = new
                break
            rank, step = new, step * 2
        sa = np.empty(n, dtype=np.int64)
        sa[rank] = np.arange(n)
        self.sa = sa.astype(np.int32)
        bwt = text[sa - 1]
        sigma = len(self.vocab) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        self.occ = np.sort(bwt * n + np.arange(n))  # position lists, one behind the other
        self.base = np.searchsorted(self.occ, np.arange(sigma + 1) * n)

    def step(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = word * self.n
        a = np.searchsorted(self.occ, key + lo) - self.base[word]
        b = np.searchsorted(self.occ, key + hi) - self.base[word]
        return self.first[word] + a, self.first[word] + b

    def find(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges [lo, hi) of the segments flat[first : first + length], all searched backward at once."""
        lo, hi = np.zeros(len(first), dtype=np.int64), np.full(len(first), self.n, dtype=np.int64)
        for back in range(int(length.max(initial=0))):
            live = np.flatnonzero((length > back) & (lo < hi))
            word = flat[first[live] + length[live] - 1 - back]
            hi[live[word == 0]] = 0  # a word of no record
            live, word = live[word > 0], word[word > 0]
            lo[live], hi[live] = self.step(word, lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def seeds(self, queries: list[list[str]], broken: int = BROKEN) -> tuple[np.ndarray, ...]:
        """(query, record, start, where): places where a segment of a query stands in a record.

        A query is cut into segments of a fifth of its words, of five words at most and one at least. Of these the broken + 1
        with the fewest hits are looked up: a record from which at most `broken` segments are lost keeps one of them.
        """
        get = self.vocab.get
        lens = np.fromiter((len(q) for q in queries), dtype=np.int64, count=len(queries))
        flat = np.fromiter((get(w, -1) + 1 for q in queries for w in q), dtype=np.int64, count=int(lens.sum()))
        size = np.clip(lens // 5, 1, 5)
        many = lens // size
        q = np.repeat(np.arange(len(queries)), many)
        start = (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)) * size[q]
        base = np.r_[0, np.cumsum(lens)[:-1]]
        lo, hi = self.find(flat, base[q] + start, size[q])
        order = np.lexsort((hi - lo, q))
        q, start, lo, hi = q[order], start[order], lo[order], hi[order]
        nth = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
        keep = (nth <= broken) & (hi > lo)
        q, start, lo, n = q[keep], start[keep], lo[keep], (hi - lo)[keep]
        where = self.sa[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        return np.repeat(q, n), self.record[where].astype(np.int64), np.repeat(start, n), where


def spans(words: list[str], other: list[str], least: int) -> list[tuple[int, int]]:
    """The maximal matches [start, end) of `least` words or more that cover `words`, from its end backward: each is the
    longest run before the one behind it that also stands in `other`."""
    out, end, n = [], len(words), len(words)
    if n * len(other) <= 250_000:
        text = f" {' '.join(other)} "
        while end:
            lo, run = end, " "
            while lo and (longer := f" {words[lo - 1]}{run}") in text:
                lo, run = lo - 1, longer
            if end - lo >= least:
                out.append((lo, end))
            end = lo if lo < end else end - 1
        return out[::-1]
    index = FullTextIndex([other])
    ids = np.fromiter((index.vocab.get(w, -1) + 1 for w in words), dtype=np.int64, count=n)
    while end:
        lo, rng = end, (np.zeros(1, dtype=np.int64), np.full(1, index.n, dtype=np.int64))
        while lo and ids[lo - 1]:
            rng = index.step(ids[lo - 1:lo], *rng)
            if rng[0][0] >= rng[1][0]:
                break
            lo -= 1
        if end - lo >= least:
            out.append((lo, end))
        end = lo if lo < end else end - 1
    return out[::-1]


def _bits(lists: list[list[str]]) -> np.ndarray:
    """(n, 2) words of 64 bits: one bit of 128 for every word of a text, by the hash of this process."""
    out = np.zeros((len(lists), 2), dtype=np.uint64)
    for i, ws in enumerate(lists):
        b = 0
        for w in ws:
            b |= 1 << (hash(w) & 127)
        out[i, 0], out[i, 1] = b & 0xFFFFFFFFFFFFFFFF, b >> 64
    return out


class Shard:
    """An index of evaluation texts and what decides quickly that a pair can't be the same: numbers, sizes, and bits of words."""

    def __init__(self, evals: list[list[str]], sigs: list[int]):
        self.evals = evals
        self.index = FullTextIndex(evals)
        self.size = np.array([len(w) for w in evals])
        self.sig = np.array(sigs, dtype=np.int64)
        self.bits = _bits(evals)

    def matches(self, train: list[list[str]], sigs: list[int], known: Callable[[str], bool] = known_syllable):
        """(training text, evaluation text, words covered, spans) of all pairs that say the same."""
        q, rec, _, _ = self.index.seeds(train)
        size, sig = np.array([len(w) for w in train]), np.array(sigs, dtype=np.int64)
        ok = (sig[q] == self.sig[rec]) & (np.abs(size[q] - self.size[rec]) <= SLIPS)
        pair = np.unique(q[ok] * np.int64(len(self.evals)) + rec[ok])
        q, rec = pair // len(self.evals), pair % len(self.evals)
        some, at = np.unique(q, return_inverse=True)
        bits = _bits([train[i] for i in some.tolist()])
        ok = np.bitwise_count(bits[at] ^ self.bits[rec]).sum(axis=1) <= 2 * SLIPS
        for i, j in zip(q[ok].tolist(), rec[ok].tolist()):
            if same(train[i], self.evals[j], known):
                runs = spans(train[i], self.evals[j], min(5, max(1, len(train[i]) // 5)))
                yield i, j, sum(hi - lo for lo, hi in runs), runs


_FOUND = pa.schema([("train", pa.binary()), ("eval", pa.binary()), ("covered", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32())))])


def _search(count: dict[str, int]):
    """Over rows sorted by shard and role: the evaluation texts of a shard are indexed once, its training texts pass by. Known
    is a possible syllable that many write."""
    def run(batches):
        at, shard, evals, train, asked = None, None, [], [], set()

        def passed():
            nonlocal train
            lines = [w.split(" ") for _, w, _ in train]
            got = [(train[i][0], evals[j][0], c, [list(x) for x in s]) for i, j, c, s in shard.matches(lines, [x for *_, x in train], lambda w: w in count and known_syllable(w))]
            train = []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*got), _FOUND)], schema=_FOUND)

        for batch in batches:
            for key, role, cls, line, sig, routes in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if key != at:
                    if train:
                        yield from passed()
                    at, shard, evals, asked = key, None, [], set()
                if role == 0:
                    evals.append((cls, line, sig))
                    asked.update(routes)
                    continue
                if asked.isdisjoint(routes):
                    continue
                if shard is None:
                    shard = Shard([w.split(" ") for _, w, _ in evals], [x for *_, x in evals])
                train.append((cls, line, sig))
                if len(train) >= 4096:
                    yield from passed()
        if train:
            yield from passed()
    return run


def members(df: DataFrame, key: str, text: str, split: Column, source: Column) -> DataFrame:
    """(rec, split, source, cls, line, sig): records with their words; null keys, splits and null or blank texts are none;
    repeated rows count once in what follows."""
    d = df.select(F.col(key).alias("rec"), split.alias("split"), source.alias("source"), F.col(text).alias("__t"))
    d = d.filter(F.col("rec").isNotNull() & F.col("split").isNotNull() & F.col("__t").rlike(r"[\p{L}\p{N}]"))
    # as non-deterministic, the function runs once, not again for the filter on its result
    d = d.withColumn("__c", _canonical.asNondeterministic()("__t")).select("rec", "split", "source", F.col("__c.cls").alias("cls"), F.col("__c.line").alias("line"), F.col("__c.sig").alias("sig"))
    return d.filter("line != ''")


def frequent(cls: DataFrame, share: float = 0.001) -> dict[str, int]:
    """Words of at least `share` of all texts and in how many they stand. There are at most 1 / share times as many as the
    average text has words, however large the corpus; shares mean the same in a corpus of any size."""
    n = cls.count()
    df = cls.select(F.explode(F.array_distinct(F.split("line", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in df.filter(F.col("n") >= share * n).collect()}


def _routes(count: dict[str, int], parts: dict[int, int], shards: int):
    """Where a text goes; see class_links."""
    def run(batches):
        seen: dict[str, tuple[int, int]] = {}

        def place(w: str) -> tuple[int, int]:
            got = seen.get(w)
            if got is None:
                got = seen[w] = (count.get(w, 0), _digest(w))
            return got

        for batch in batches:
            seen.clear()
            key, at, routes = [], [], []
            roles, classes, lines, sigs = (batch.column(c).to_pylist() for c in range(4))
            for i, (role, cls, line, sig) in enumerate(zip(roles, classes, lines, sigs)):
                n = parts.get(sig, 1)
                here: dict[int, list[int]] = {}
                if n == 1:
                    here[sig % shards] = [sig]
                elif n <= SLIPS + 1:
                    for k in [int.from_bytes(cls[:4], "little") % n] if role == 0 else range(n):
                        here[shards + _digest(f"{sig} {k}")] = [sig]
                else:
                    for w in sorted(set(line.split(" ")), key=place)[:SLIPS + 1]:
                        h = _digest(f"{sig}|{w}")
                        here.setdefault(-1 - h % shards, []).append(h)
                key += here.keys()
                routes += here.values()
                at += [i] * len(here)
            take = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, type=pa.int64()), *(batch.column(c).take(take) for c in range(4)), pa.array(routes, type=pa.list_(pa.int64()))], names=["shard", "role", "cls", "line", "sig", "routes"])
    return run


def class_links(recs: DataFrame, train: str = "train", *, shard: int = 300_000) -> DataFrame:
    """(train, eval, covered, spans): pairs of classes of the training split and of another that say the same; spans are the
    maximal matches [start, end) in the words of the training text, and covered counts the words in them.

    Texts are compared as classes of equal words, so copies cost nothing. Two texts that say the same have the same
    numbers, and by these they come to a shard. Where the evaluation texts of some numbers have more than `shard` words,
    they are cut by hash into parts, which all training texts of these numbers visit; where that would be more than
    SLIPS + 1 parts, texts go by their words instead: at most SLIPS words on each side are not the other's, so the
    SLIPS + 1 rarest of both (by one order of all words) have one in common, and a text goes to the shards of its numbers
    with each of these. So no text is sent to more than SLIPS + 1 shards, however many there are, but to the parts of one
    that hot words make too large. A shard is indexed once, and its training texts pass by. Nothing is dropped: what is
    lost is only a pair with more than BROKEN slips and moved seams, or whose every word is misspelt.
    """
    spark = recs.sparkSession
    side = F.when(F.col("split") == train, 1).otherwise(0)
    cls = cut(recs.groupBy(side.alias("role"), "cls").agg(F.min("line").alias("line"), F.first("sig").alias("sig")))
    size = F.size(F.split("line", " "))
    sizes = cls.filter("role = 0").groupBy("sig").agg(F.sum(size).alias("w"))
    words = sizes.agg(F.sum("w")).first()[0] or 0
    parts = {r["sig"]: -(-r["w"] // shard) for r in sizes.filter(F.col("w") > shard).collect()}  # at most words / shard entries
    shards = max(4 * shuffle_parts(spark), -(-words * (SLIPS + 1) * 2 // shard))
    count = frequent(cls)
    rows = cls.select("role", "cls", "line", "sig").mapInArrow(_routes(count, parts, shards), "shard long, role int, cls binary, line string, sig long, routes array<long>")
    if any(n > SLIPS + 1 for n in parts.values()):
        big = rows.filter("role = 0 and shard < 0").groupBy("shard").agg(F.sum(size).alias("w")).filter(F.col("w") > shard)
        big = {r["shard"]: -(-r["w"] // shard) for r in big.collect()}  # at most (SLIPS + 1) * words / shard entries
        if big:
            cuts = F.coalesce(F.create_map(*[F.lit(x).cast("long") for kv in big.items() for x in kv])[F.col("shard")], F.lit(1).cast("long"))
            own = F.pmod(F.xxhash64("cls"), cuts)
            every = F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), cuts - 1))
            rows = rows.withColumn("part", F.explode(every)).select((F.col("shard") - F.col("part") * F.lit(shards)).alias("shard"), "role", "cls", "line", "sig", "routes")
    met = rows.repartition("shard").sortWithinPartitions("shard", "role").mapInArrow(_search(count), "train binary, eval binary, covered int, spans array<array<int>>")
    return met.dropDuplicates(["train", "eval"])


def questions(train: DataFrame, official: DataFrame) -> DataFrame:
    cols = ["qid", "question", "fold", "source"]
    return members(train.select(*cols).unionByName(official.select(*cols)), "qid", "question", F.col("fold"), F.col("source"))


def links(recs: DataFrame, train: str = "train") -> DataFrame:
    """(rec_t, rec_e, split, source, covered): pairs of a training record and one of another split, with the latter's split and source."""
    recs = cut(recs)
    pairs = class_links(recs, train).select("train", "eval", "covered")
    t = recs.filter(F.col("split") == train).select(F.col("cls").alias("train"), F.col("rec").alias("rec_t")).distinct()
    e = recs.filter(F.col("split") != train).select(F.col("cls").alias("eval"), F.col("rec").alias("rec_e"), "split", "source").distinct()
    return pairs.join(t, "train").join(e, "eval").filter("rec_t != rec_e").groupBy("rec_t", "rec_e", "split", "source").agg(F.max("covered").alias("covered"))


def found(train: DataFrame, official: DataFrame) -> DataFrame:
    d = links(questions(train, official))
    return d.select(F.least("rec_t", "rec_e").alias("qid_a"), F.greatest("rec_t", "rec_e").alias("qid_b")).distinct()


def counts(train: DataFrame, official: DataFrame) -> DataFrame:
    """(fold, source, n_questions, n_pairs, n_words): evaluation questions that also stand in the training split, per fold
    and source, with the words of the training questions that their matches cover."""
    d = links(questions(train, official))
    return d.groupBy(F.col("split").alias("fold"), "source").agg(F.countDistinct("rec_e").alias("n_questions"), F.countDistinct("rec_t", "rec_e").alias("n_pairs"), F.sum("covered").alias("n_words"))
