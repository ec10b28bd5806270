"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotusrank.functions.scale import cut, with_group_offsets
from lotusrank.llm.tokens import TOKENIZERS, token_counts

GOLDEN = (math.sqrt(5) - 1) / 2


def allocate(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens per source: shares of `total` by weight, but at most repeats * available; what a capped source leaves goes
    to the others by their weights, as long as any has room. Sources without tokens or with weight <= 0 get nothing."""
    cap = {s: available.get(s, 0) * max(0, repeats.get(s) or 0) for s in weights}
    live = {s for s, w in weights.items() if w and w > 0 and cap[s] > 0}
    out = {s: 0.0 for s in weights}
    left = float(total)
    while live and left > 1e-9:
        unit = left / sum(weights[s] for s in live)
        full = {s for s in live if out[s] + unit * weights[s] >= cap[s]}
        if not full:
            for s in live:
                out[s] += unit * weights[s]
            break
        for s in full:
            left -= cap[s] - out[s]
            out[s] = float(cap[s])
        live -= full
    return out


def exact_total(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which every source that has tokens reaches its share of the mixture."""
    live = [s for s, w in weights.items() if w > 0 and available.get(s, 0) > 0 and (repeats.get(s) or 0) > 0]
    unit = min((available[s] * repeats[s] / weights[s] for s in live), default=0.0)
    return unit * sum(weights[s] for s in live)


def plan(counts: DataFrame, targets: DataFrame, total: int | str | None = None) -> list[dict]:
    """One dict per listed source; the rows of `targets` (few by nature: the sources a user lists) come to the driver."""
    t = (targets.filter(F.col("source").isNotNull() & (F.trim("source") != "") & F.col("weight").isNotNull() & ~F.isnan("weight"))
         .groupBy("source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")))
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    rows = t.join(have, "source", "left").collect()
    w = {r["source"]: float(r["weight"]) for r in rows}
    a = {r["source"]: int(r["have"] or 0) for r in rows}
    m = {r["source"]: int(r["max_repeats"]) for r in rows}
    total = sum(a.values()) if total is None else exact_total(a, w, m) if total == "exact" else total
    got = allocate(a, w, m, total)
    all_w = sum(x for x in w.values() if x > 0) or 1.0
    return [{"source": s, "target_share": max(w[s], 0.0) / all_w, "available": a[s], "max_repeats": m[s], "amount": got[s]} for s in sorted(w)]


def _spread(docs: DataFrame, parts: list[dict], seed: int) -> DataFrame:
    """Every use of every document, in shuffled order inside its source and pass, with the tokens before it."""
    def pick(field: str) -> Column:
        out = F.lit(None).cast("double")
        for p in parts:
            out = F.when(F.col("source") == p["source"], F.lit(float(p[field]))).otherwise(out)
        return out
    used = docs.withColumn("__amount", pick("amount")).withColumn("__have", pick("available")).filter("__amount > 0 and n_tokens > 0")
    passes = F.ceil(F.col("__amount") / F.col("__have")).cast("int")
    d = used.select("source", "doc_id", "n_tokens", "__amount", F.explode(F.sequence(F.lit(0), passes - 1)).alias("epoch"))
    d = d.withColumn("__h", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    order = [F.col("epoch"), F.col("__h"), F.col("doc_id")]
    d = with_group_offsets(d, ["source"], order, "n_tokens", "before")
    # the last document goes in if at least half of it belongs to the share
    return d.filter(F.col("before") + F.col("n_tokens") / 2 <= F.col("__amount")).drop("__amount", "__h")


def schedule(spark, blocks: list[tuple[str, int]]) -> DataFrame:
    """(source, block, slot): an order of all blocks in which every stretch holds the sources in their proportions.

    As many points of the golden-ratio sequence as there are blocks are mapped through the cumulative block counts to
    sources, and a source's r-th point takes its r-th block. A source's count among the points is off by its discrepancy,
    which grows with the logarithm of their number: so few points are left over by some sources and so few blocks by
    others, and these come together in the same order.
    """
    total = sum(n for _, n in blocks)
    # The fractional part of k * GOLDEN, with k split so that the product keeps its digits.
    hi, lo = F.floor(F.col("id") / 65536), F.col("id") % 65536
    u = (F.pmod(hi * F.lit((65536 * GOLDEN) % 1.0), F.lit(1.0)) + F.pmod(lo * F.lit(GOLDEN), F.lit(1.0))) % 1.0
    edge, src = 0.0, F.lit(blocks[-1][0])
    edges = []
    for s, n in blocks:
        edge += n / total
        edges.append((edge, s))
    for e, s in reversed(edges[:-1]):
        src = F.when(F.col("u") < F.lit(e), F.lit(s)).otherwise(src)
    slots = spark.range(total).select(F.col("id").alias("slot"), u.alias("u")).select("slot", src.alias("source"), F.lit(1).alias("__one"))
    drawn = cut(with_group_offsets(slots, ["source"], [F.col("slot")], "__one", "block").select("source", "block", "slot"))
    own = F.lit(0)
    for s, n in blocks:
        own = F.when(F.col("source") == s, F.lit(n)).otherwise(own)
    over = drawn.filter(F.col("block") >= own).select("slot").orderBy("slot").collect()
    got = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = sorted(((k + 1) / (n + 1), s, k) for s, n in blocks for k in range(got.get(s, 0), n))
    rest = [(s, k, r["slot"]) for (_, s, k), r in zip(short, over)]
    return drawn.filter(F.col("block") < own).unionByName(spark.createDataFrame(rest, drawn.schema))


def mixture(docs: DataFrame, targets: DataFrame, *, total: int | str | None = "exact", block: int = 8192, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of documents with columns doc_id, source, n_tokens.

    mixture: slot, source, block, doc_id, epoch, n_tokens; order by (slot, epoch, doc_id) to read it. shares: source,
    target_share, actual_share, n_tokens, n_documents, max_repeats for every listed source. `total` is the size wanted:
    by default ("exact") the largest at which every source with documents reaches its share; None takes the size of all
    documents of the listed sources, at which scarce sources fall short as far as max_repeats makes them.

    Shares: see allocate. A document is used at most max_repeats times (null: once), and again only when all others of
    its source have been used as often. Documents without tokens, without or of an unlisted source are not used;
    repeated (doc_id, source) rows count once; listed sources without documents get a share of 0.
    """
    spark = docs.sparkSession
    docs = cut(docs.filter(F.col("source").isNotNull()).groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    parts = plan(docs, targets, total)
    d = cut(_spread(docs, parts, seed).withColumn("block", F.floor(F.col("before") / block).cast("long")))
    got = {r["source"]: r for r in d.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("block").alias("b")).collect()}
    size = sum(r["t"] for r in got.values()) or 1
    rows = [(p["source"], p["target_share"], (got[p["source"]]["t"] / size) if p["source"] in got else 0.0, int(got[p["source"]]["t"]) if p["source"] in got else 0,
             int(got[p["source"]]["n"]) if p["source"] in got else 0, p["max_repeats"]) for p in parts]
    shares = spark.createDataFrame(rows, "source string, target_share double, actual_share double, n_tokens long, n_documents long, max_repeats int")
    if not got:
        return d.select(F.lit(0).cast("long").alias("slot"), "source", "block", "doc_id", "epoch", "n_tokens"), shares
    slots = schedule(spark, [(s, int(r["b"]) + 1) for s, r in sorted(got.items())])
    out = d.join(slots, ["source", "block"], "left")
    return out.select(F.coalesce("slot", F.lit(1 << 60) + F.col("block")).alias("slot"), "source", "block", "doc_id", "epoch", "n_tokens"), shares


def sized(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of documents, by a public tokenizer, in one pass without a shuffle."""
    keyed = documents.select(F.struct("doc_id", "source").alias("k"), "text")
    return token_counts(keyed, "k", "text", name=name, folder=folder).select("k.doc_id", "k.source", "n_tokens")
