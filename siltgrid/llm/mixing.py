"""Mixing sources to target shares of the total size, by subset-sum budget fitting on exact token counts.

The total is the largest at which every source can give its share without any document being used more often than the
source allows. A source's budget is so many full passes over it and a remainder. For the remainder documents are
counted by exact token length; an even share of each length is taken, and bounded-knapsack dynamic programming over
the leftover counts closes the gap to the budget, to the token where any combination of lengths does. Which documents
of a length are taken is a seeded draw, spread evenly over the corpus.

Only the histogram (source, length, count) reaches the driver: it grows with the longest document, not with the corpus. The plan goes
back as a table of as many rows, broadcast up to BROADCAST of them and shuffled beyond; documents are never on a broadcast side.
The draw ranks documents by a seeded hash within hash buckets of a few thousand rows, so a source or a length
with a third of all rows is never one task.

Defined cases: sources without a target, and null sources, are not wanted; documents of no tokens (null or empty texts)
are never chosen; a target source without documents gives nothing and binds no one, its actual share is 0;
shares are taken relative to their sum; repeated rows of a document are separate documents.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltgrid.llm.tokens import count_tokens
from siltgrid.session import stored

#: Tokens that are left to the dynamic programme at most, in longest documents; and rows of a draw's bucket.
REACH, BUCKET = 3, 4096
#: Rows of the plan (three numbers and a source each) that are broadcast at most.
BROADCAST = 100_000


def knapsack(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to target as any bounded combination gets.

    Sums up to target plus the longest length are held as the bits of one integer; counts are split into powers of two.
    """
    counts = {x: n for x, n in counts.items() if x > 0 and n > 0}
    if target <= 0 or not counts:
        return {}
    top = target + max(counts)
    mask = (1 << (top + 1)) - 1
    items, reach = [], [1]
    for x in sorted(counts):
        n, k = min(counts[x], top // x), 1
        while n > 0:
            take = min(k, n)
            items.append((x, take))
            reach.append((reach[-1] | reach[-1] << x * take) & mask)
            n, k = n - take, k * 2
        if reach[-1] >> target & 1:
            break
    last = reach[-1]
    below = (last & ((1 << (target + 1)) - 1)).bit_length() - 1
    above_bits = last >> (target + 1)
    above = target + (above_bits & -above_bits).bit_length() if above_bits else None
    total = above if above is not None and above - target < target - below else below
    chosen: dict[int, int] = {}
    for (x, take), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> total & 1:
            chosen[x] = chosen.get(x, 0) + take
            total -= x * take
    return chosen


def fit(counts: dict[int, int], budget: int, seed: int = 7) -> dict[int, int]:
    """Documents to take of each length for a budget of less than all of them: an even share of every length with
    seeded rounding, so that rare lengths are drawn as often as common ones, then the knapsack for the rest."""
    counts = {x: n for x, n in counts.items() if x > 0}
    total = sum(x * n for x, n in counts.items())
    if not total or budget <= 0:
        return {}
    if budget >= total:
        return dict(counts)
    draw = random.Random(f"{seed}/{budget}/{total}")
    lengths = sorted(counts)
    taken = {x: min(counts[x], int(counts[x] * budget / total + draw.random())) for x in lengths}
    left = budget - sum(x * n for x, n in taken.items())
    longest = lengths[-1]
    reserve, least = REACH * longest, min(longest, budget)  # room for the knapsack to work in
    while not least <= left <= reserve:
        draw.shuffle(lengths)
        for x in lengths:
            if left < least and taken[x]:
                taken[x] -= 1
                left += x
            elif left > reserve and taken[x] < counts[x]:
                taken[x] += 1
                left -= x
    for x, n in knapsack({x: counts[x] - taken[x] for x in counts}, left).items():
        taken[x] += n
    return {x: n for x, n in taken.items() if n}


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int, dict[int, int]]]:
    """For each source: budget in tokens, full passes, and documents to take of each length for the remainder."""
    size = {s: sum(x * n for x, n in h.items()) for s, h in histogram.items()}
    share = {s: t for s, (t, r) in targets.items() if t and t > 0 and r and r > 0}
    whole = sum(share.values()) or 1.0
    able = [size.get(s, 0) * targets[s][1] / (share[s] / whole) for s in share if size.get(s, 0)]
    total = min(able) if able else 0
    out = {}
    for s in targets:
        have = size.get(s, 0)
        budget = int(round(total * share.get(s, 0) / whole)) if have else 0
        passes = min(budget // have, targets[s][1]) if have else 0
        rest = fit(histogram.get(s, {}), budget - passes * have) if have and passes < targets[s][1] else {}
        out[s] = (budget, passes, rest)
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, shares).

    Chosen: doc_id, source, n_tokens, copies. Shares: source, target_share, max_repeats, budget, n_documents, n_copies,
    n_tokens, actual_share; a row per target source, held on the driver. documents: doc_id, source, text; targets: source,
    target_share, max_repeats (a row per source).
    """
    spark = documents.sparkSession
    goal = {r[0]: (float(r[1] or 0.0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()}
    wanted = documents.where(F.col("source").isin(list(goal)))
    sized = stored(count_tokens(wanted, ["doc_id", "source"], path=path).where("n_tokens > 0"), "sized")
    histogram: dict[str, dict[int, int]] = {}
    for s, x, n in sized.groupBy("source", "n_tokens").count().collect():
        histogram.setdefault(s, {})[x] = n
    planned = plan(histogram, goal)
    quota_rows = [(s, x, p, rest.get(x, 0), math.ceil(n / BUCKET)) for s, (_, p, rest) in planned.items() for x, n in histogram.get(s, {}).items() if p or rest.get(x)]
    quotas = spark.createDataFrame(quota_rows, "source string, n_tokens int, passes int, extra long, buckets int")
    h = F.xxhash64(F.lit(seed), "doc_id")
    small = F.broadcast if len(quota_rows) <= BROADCAST else lambda df: df.hint("merge")
    drawn = sized.join(small(quotas), ["source", "n_tokens"]).withColumn("_h", h).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 20), F.col("buckets")))
    keys = ["source", "n_tokens", "_bucket"]
    before = Window.partitionBy("source", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.where("buckets > 1").groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id")) + F.coalesce("_before", F.lit(0))
    chosen = drawn.hint("merge").join(offsets, keys, "left").withColumn("copies", F.col("passes") + F.when(rank <= F.col("extra"), 1).otherwise(0))
    chosen = stored(chosen.where("copies > 0").select("doc_id", "source", "n_tokens", F.col("copies").cast("int")), "chosen")
    used = {r[0]: r[1:] for r in chosen.groupBy("source").agg(F.count("*"), F.sum("copies"), F.sum(F.col("n_tokens").cast("long") * F.col("copies"))).collect()}
    whole = max(1, sum(n for *_, n in used.values()))
    rows = []
    for s, (budget, _, _) in planned.items():
        documents_, copies, n = used.get(s, (0, 0, 0))
        rows.append((s, goal[s][0], goal[s][1], budget, documents_, copies, n, n / whole))
    return chosen, spark.createDataFrame(rows, "source string, target_share double, max_repeats int, budget long, n_documents long, n_copies long, n_tokens long, actual_share double")
