"""Mixing sources to target weights by entropy balancing.

Every document starts at the same rate. The rates of least relative entropy that meet the token target of each source are
the starting rate times an exponential tilt, exp(multiplier x tokens of the document / mean tokens of its source), held
at the source's repeat limit. The convex dual is solved by safeguarded Newton steps; each step sums tokens and curvature
over a table of one row per source and document size, made once from all documents. Rates are rounded into copies: the
whole part for every document, one copy more for documents whose hash lies far enough below their rate's remainder. How
far is a threshold per source, found over all documents by narrowing histograms so that the token sums are kept; the
last documents on both sides of it are then chosen by subset sum, so that a target is missed by less than a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokenizer import encode_documents

#: Bins by which the rounding threshold is narrowed, and how often.
BINS, LEVELS = 256, 4
NEWTON_STEPS, TOLERANCE = 60, 1e-10
#: Documents of a source on each side of the threshold that are chosen by subset sum.
EDGE = 40


def _newton(sizes: DataFrame, goal: dict[str, float], limit: dict[str, float], mean: dict[str, float], start: float) -> dict[str, float]:
    """Multipliers of the dual: sum of tokens * min(start * exp(multiplier * tokens / mean), limit) = goal, for every source at once."""
    lam = {s: 0.0 for s in goal}
    low, high = {s: -math.inf for s in goal}, {s: math.inf for s in goal}
    for _ in range(NEWTON_STEPS):
        table = sizes.sparkSession.createDataFrame([(s, lam[s], float(limit[s]), mean[s]) for s in goal], "source string, lam double, top double, mean double")
        raw = F.lit(start) * F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0)))
        held = F.col("n") * F.col("tokens")
        sums = sizes.join(F.broadcast(table), "source").groupBy("source").agg(  # one row per source
            F.sum(held * F.least(raw, F.col("top"))).alias("g"), F.sum(F.when(raw < F.col("top"), held * raw * F.col("tokens") / F.col("mean")).otherwise(0.0)).alias("h")
        )
        worst = 0.0
        for r in sums.collect():
            s, miss = r["source"], goal[r["source"]] - r["g"]
            worst = max(worst, abs(miss) / max(goal[s], 1.0))
            if miss > 0:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = max(-2.0, min(2.0, miss / r["h"])) if r["h"] > 0 else math.copysign(2.0, miss)
            new = lam[s] + step
            if not low[s] < new < high[s]:  # Newton left the bracket
                new = (low[s] + high[s]) / 2 if math.isfinite(low[s]) and math.isfinite(high[s]) else lam[s] + math.copysign(2.0, miss)
            if abs(miss) > TOLERANCE * max(goal[s], 1.0):
                lam[s] = new
        if worst <= TOLERANCE:
            break
    return lam


def _subset(items: list[tuple[int, int]], goal: float) -> set[int]:
    """Ids of the items (id, size) whose sizes sum as near to the goal as any subset's."""
    reach, steps = 1, []
    for _, size in items:
        steps.append(reach)
        reach |= reach << size
    want = max(0, round(goal))
    under = (reach & ((1 << (want + 1)) - 1)).bit_length() - 1
    over = reach >> (want + 1)
    above = want + (over & -over).bit_length() if over else None
    at = above if above is not None and above - goal < goal - under else under
    out = set()
    for (k, size), before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> at & 1:
            out.add(k)
            at -= size
    return out


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Copies of each document and the shares reached.

    ``sizes`` has doc_id, source, tokens; ``targets`` has source, target_share, max_repeats. The mixture's total is
    ``total_tokens``, by default the largest at which every target can be met within its repeat limit. With a larger
    total the limited sources stay at their limit and the shares reached say so. Returns (doc_id, source, tokens,
    copies) for every document, 0 copies included (sources without a target, null sources, empty texts), and (source,
    target_share, reached_share, tokens, documents, copies, max_used) for every target. Repeated doc_ids are separate
    documents; a target without documents reaches 0; no documents give an empty result and shares of 0.
    """
    spark = sizes.sparkSession
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.filter("source is not null").collect()}  # one row per source
    sizes = sizes.select("doc_id", "source", F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.sum((F.col("tokens") > 0).cast("bigint")).alias("n")).filter(F.col("source").isin(list(wanted))).collect() if wanted else []
    have = {r["source"]: float(r["t"]) for r in held if r["t"]}
    live = {s: (share, reps) for s, (share, reps) in wanted.items() if have.get(s) and share > 0 and reps > 0}
    full = min((reps * have[s] / share for s, (share, reps) in live.items()), default=0.0)
    total = float(total_tokens or full)
    goal = {s: min(share * total, reps * have[s]) for s, (share, reps) in live.items()}
    limit = {s: reps for s, (_, reps) in live.items()}
    start = max(total / sum(have.values()), 1e-12) if have else 1.0
    free = {s: g for s, g in goal.items() if g < limit[s] * have[s] * (1 - 1e-12)}  # the others stay at their limit
    mean = {r["source"]: have[r["source"]] / r["n"] for r in held if r["t"]}
    lam = {}
    if free:
        by_size = sizes.filter(F.col("source").isin(list(free)) & (F.col("tokens") > 0)).groupBy("source", "tokens").agg(F.count("*").alias("n")).persist()
        lam = _newton(by_size, free, limit, mean, start)
        by_size.unpersist()

    # Rates, whole copies, and how far a document's hash lies above the remainder of its rate.
    rates = spark.createDataFrame([(s, s in lam, lam.get(s, 0.0), mean[s], limit[s]) for s in sorted(goal)], "source string, tilted boolean, lam double, mean double, top int")
    tilt = F.lit(start) * F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0)))
    rate = F.when(F.col("tilted"), F.least(tilt, F.col("top").cast("double"))).otherwise(F.col("top").cast("double"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 32)
    placed = sizes.join(F.broadcast(rates), "source", "left").withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int"))
    more = (F.col("whole") < F.col("top")) & (F.col("tokens") > 0)  # may get one copy more
    placed = placed.withColumn("v", F.when(more, u - F.floor((F.col("rate") - F.col("whole")) * 2**32).cast("bigint")))
    need = {r["source"]: goal[r["source"]] - r["t"] for r in placed.filter(F.col("whole").isNotNull()).groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}  # one row per source
    open_ = {s for s in free if need.get(s, 0) > 0}
    low, high, base = {s: -(2**32) for s in open_}, {s: 2**32 for s in open_}, {s: 0.0 for s in open_}
    for level in range(LEVELS):
        if not open_:
            break
        width = 2**33 // BINS ** (level + 1)
        table = spark.createDataFrame([(s, low[s], high[s]) for s in sorted(open_)], "source string, lo bigint, hi bigint")
        hist = placed.select("source", "tokens", "v").join(F.broadcast(table), "source").filter("v >= lo and v < hi").groupBy("source", F.floor((F.col("v") - F.col("lo")) / width).alias("bin")).agg(F.sum("tokens").alias("t"))
        bins: dict[str, dict[int, float]] = {}
        for r in hist.collect():  # at most BINS rows per source
            bins.setdefault(r["source"], {})[r["bin"]] = float(r["t"])
        for s in open_:
            k, acc = 0, base[s]
            while k < BINS - 1 and acc + bins.get(s, {}).get(k, 0.0) < need[s]:
                acc += bins.get(s, {}).get(k, 0.0)
                k += 1
            base[s], low[s], high[s] = acc, low[s] + k * width, low[s] + (k + 1) * width
    taken, left = _edges(placed, {s: low[s] for s in open_}, {s: need[s] - base[s] for s in open_}) if open_ else (set(), set())
    table = spark.createDataFrame([(s, low[s]) for s in sorted(open_)], "source string, below bigint")
    swaps = spark.createDataFrame([(*k, 1) for k in taken] + [(*k, -1) for k in left], "source string, v bigint, doc_id bigint, tokens bigint, swap int").distinct()  # at most 2 * EDGE a source
    out = placed.join(F.broadcast(table), "source", "left").join(F.broadcast(swaps), ["source", "v", "doc_id", "tokens"], "left")
    extra = F.coalesce((F.col("v") < F.col("below")).cast("int"), F.lit(0)) + F.coalesce("swap", F.lit(0))
    copies = out.withColumn("copies", F.when(F.col("tokens") > 0, F.coalesce(F.col("whole") + extra, F.lit(0))).otherwise(0)).select("doc_id", "source", "tokens", "copies")

    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum((F.col("copies") > 0).cast("bigint")).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("max_used"))
    shares = targets.filter("source is not null").select("source", "target_share").join(F.broadcast(got), "source", "left")  # one row per source
    shares = shares.crossJoin(F.broadcast(got.agg(F.sum("tokens").alias("all"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shares = shares.select("source", "target_share", F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("documents"), zero("copies"), zero("max_used"))
    return copies, shares


def _edges(placed: DataFrame, low: dict[str, int], need: dict[str, float]) -> tuple[set, set]:
    """Documents beside the thresholds to be taken besides those below, and to be left out of those below, by subset sum.

    ``need`` is what the documents below the threshold leave open. Repeated rows of one document are chosen together.
    """
    table = placed.sparkSession.createDataFrame(sorted(low.items()), "source string, below bigint")
    near = placed.filter("v is not null").select("source", "v", "doc_id", "tokens").join(F.broadcast(table), "source")

    def side(under: bool) -> DataFrame:
        order: list[Column] = [F.col("v").desc() if under else F.col("v"), F.col("doc_id"), F.col("tokens")]
        rows = near.filter(F.col("v") < F.col("below") if under else F.col("v") >= F.col("below"))
        return rows.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("at") <= EDGE).drop("at")  # limited before the shuffle

    keys = side(True).unionByName(side(False)).distinct()  # at most 2 * EDGE rows a source
    rows = near.join(F.broadcast(keys.drop("below")), ["source", "v", "doc_id", "tokens"]).groupBy("source", "v", "doc_id", "tokens", (F.col("v") < F.col("below")).alias("under")).agg(F.count("*").alias("n")).collect()
    taken, left = set(), set()
    for s in low:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["v"], r["doc_id"], r["tokens"]))
        chosen = _subset([(k, r["tokens"] * r["n"]) for k, r in enumerate(mine)], need[s] + sum(r["tokens"] * r["n"] for r in mine if r["under"]))
        for k, r in enumerate(mine):
            if r["under"] != (k in chosen):
                (left if r["under"] else taken).add((s, r["v"], r["doc_id"], r["tokens"]))
    return taken, left


def document_sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): size of each document in tokens of a public tokenizer."""
    return encode_documents(docs, path=path, counts_only=True, keep=("source",)).select("doc_id", "source", "tokens")
