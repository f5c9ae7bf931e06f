"""Mixing sources to target weights by Pfair scheduling: the data by built-in column functions and joins only.

Each source's documents, in a hashed order, are cut into blocks of about `block_chars` characters. With the exact target
weight w (a fraction), block i (from 0) of a source is released at floor(i / w) and due at ceil((i + 1) / w). As the
weights sum to 1, earliest-deadline-first over the released blocks meets all deadlines, so while every source has blocks
each is within less than one block of its share at each slot, however long the input. Weights are whole numbers of slots
in a period: their common denominator, or `period` slots where that is longer (weights are then the nearest parts of it, one
at least). All windows and so the schedule repeat with the period: the driver schedules one period, with a heap of a row a source, and
each block of the corpus finds its slot in it by its number. A source that has run out leaves slots empty. Sources with
the weight 0 come after all others, in proportion to their characters. Nothing is dropped or repeated: the mixture is an order.

Defined cases: a null source is a source of its own; null and empty texts weigh one character; rows repeated with one id,
or without one, have a place each; a text longer than a block lies in the block where it starts; an empty table gives an
empty result; only the key, source and text are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import broadcast_small, pieces, running_start, written


SCHEDULE = "_s string, _j long, _release long, _deadline long, _slot long"
SHARES = "_source string, _slots long, _period long, _base long"


def characters(text: str) -> Column:
    return F.greatest(F.length(F.coalesce(F.col(text), F.lit(""))), F.lit(1)).cast("long")


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> dict[str | None, int]:
    """Characters by source, a row a source."""
    return dict(docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.sum(characters(text)).alias("n")).collect())


def target_weights(sizes: dict[str | None, int], temper: float = 0.7, targets: dict[str | None, float] | None = None) -> dict[str | None, Fraction]:
    """Weights in sum 1, as the exact fractions of the decimals given; all 0 where no source has a target."""
    given = {s: Fraction(repr(float(targets.get(s, 0)))) if targets is not None else Fraction(repr(float(n) ** temper)) for s, n in sizes.items()}
    total = sum(given.values())
    return {s: w / total if total else w for s, w in given.items()}


def windows(weights: dict[str | None, Fraction], blocks: dict[str | None, int], start: int = 0) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) in the order of slots, earliest deadline first, ties by source. Weights are over 0."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    whole = lcm(*[w.denominator for w in weights.values()])
    share = [weights[s].numerator * (whole // weights[s].denominator) for s in names]
    last = [blocks[s] for s in names]
    done = [0] * len(names)
    coming, ready, t = [(0, k) for k in range(len(names)) if last[k]], [], 0
    while coming or ready:
        if not ready and coming[0][0] > t:
            t = coming[0][0]  # nothing is released: the slots of sources that ran out stay empty
        while coming and coming[0][0] <= t:
            release, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(done[k] + 1) * whole // share[k]), k, release))
        due, k, release = heapq.heappop(ready)
        yield names[k], done[k], start + release, start + due, start + t
        done[k] += 1
        t += 1
        if done[k] < last[k]:
            heapq.heappush(coming, (done[k] * whole // share[k], k))


def whole_slots(weights: dict[str | None, Fraction], period: int) -> tuple[int, dict[str | None, int]]:
    """Slots of a period, and each source's share of them: exact where the common denominator is no longer, else the nearest parts."""
    exact = lcm(*[w.denominator for w in weights.values()])
    if exact <= period:
        return exact, {s: int(w * exact) for s, w in weights.items()}
    period = max(period, 8 * len(weights))
    slots = {s: max(1, int(w * period)) for s, w in weights.items()}
    left = period - sum(slots.values())
    order = sorted(weights, key=lambda s: (slots[s] - weights[s] * period, s is not None, s or ""))
    if left >= 0:
        for s in order[:left]:
            slots[s] += 1
    else:  # small sources were rounded up: from those that are most above their weights
        for _ in range(-left):
            slots[max((s for s in order if slots[s] > 1), key=lambda s: slots[s] - weights[s] * period)] -= 1
    return period, slots


def schedule_of(spark: SparkSession, sizes: dict[str | None, int], weights: dict[str | None, Fraction], block_chars: int, period: int) -> tuple[DataFrame, DataFrame, int]:
    """A period's written schedule, a row a source with its slots a period and where its part begins, and the number of all slots."""
    blocks = {s: -(-n // block_chars) for s, n in sizes.items()}
    some = {s: w for s, w in weights.items() if w}
    none = {s: Fraction(blocks[s]) for s, w in weights.items() if not w}
    none = {s: w / sum(none.values()) for s, w in none.items()}
    rows, shares, end = [], [], 0
    for group in (some, none):
        if not group:
            continue
        length, slots = whole_slots(group, period)
        turn = list(windows({s: Fraction(k, length) for s, k in slots.items()}, slots))
        at = {(s, j): slot for s, j, _, _, slot in turn}
        rows += turn
        shares += [(s, k, length, end) for s, k in slots.items()]
        end += 1 + max((blocks[s] - 1) // k * length + at[s, (blocks[s] - 1) % k] for s, k in slots.items())
    return written(spark.createDataFrame(rows, SCHEDULE).coalesce(1), "mix-schedule"), spark.createDataFrame(shares, SHARES), end


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", targets: dict | None = None, temper: float = 0.7, block_chars: int = 20_000, period: int = 100_000) -> DataFrame:
    """One row per document row: key, source, n_chars, block, release_slot, deadline_slot, slot, position (0-based in the mixture).

    targets: weight by source (0 where missing: after all others); else the sources' characters to the power `temper`.
    """
    base = docs.select(F.col(key), F.col(source).cast("string").alias("source"), characters(text).alias("n_chars"), F.monotonically_increasing_id().alias("_row"))
    base = written(base, "mix-sizes")  # _row tells rows apart that have no key, or the same
    sizes = dict(base.groupBy("source").agg(F.sum("n_chars")).collect())  # a row a source
    n = pieces(base.count())
    placed = running_start(base.withColumn("_piece", F.pmod(F.xxhash64(key, "_row", F.lit("mix")), F.lit(n))), "n_chars", "start", [key, "_row"], ["source"], "_piece")
    placed = placed.withColumn("block", F.floor(F.col("start") / block_chars))
    schedule, shares, slots = schedule_of(docs.sparkSession, sizes, target_weights(sizes, temper, targets), block_chars, period)
    placed = placed.join(broadcast_small(shares), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("_nth", F.col("block") % F.col("_slots")).withColumn("_before", F.col("_base") + F.floor(F.col("block") / F.col("_slots")) * F.col("_period"))
    placed = placed.join(broadcast_small(schedule), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_nth") == F.col("_j")))
    times = [(F.col("_before") + F.col(f"_{c}")).alias(out) for c, out in (("release", "release_slot"), ("deadline", "deadline_slot"), ("slot", "slot"))]
    placed = written(placed.select(key, "source", "n_chars", "block", *times, "start", "_row", F.lit(1).cast("long").alias("_one")), "mix-slots")
    by_slots = placed.withColumn("_piece", F.floor(F.col("slot") / max(1, -(-slots // n))))
    return running_start(by_slots, "_one", "position", ["slot", "start", key, "_row"], [], "_piece").select(key, "source", "n_chars", "block", "release_slot", "deadline_slot", "slot", "position")
