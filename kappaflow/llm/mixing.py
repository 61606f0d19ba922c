"""Mixing sources to target weights by Poisson replication.

For target weights w_s and source sizes n_s (rows, or the sum of a size
column), a source's mean repetition rate is ``epochs * w_s * N / n_s`` with
the weights scaled to sum to one over the sources that are there.  Each row
draws its number of copies from a Poisson distribution with that mean by
inversion: a uniform number in [0, 1) comes from an MD5 hash of seed and id,
and the count is the number of cumulative probabilities that it reaches.
Copies are exploded and dealt out by a hash of seed, row, the row's place in its
input split and copy number, sorted inside each partition by that hash: a
global shuffle in one exchange, in which rows that are equal part as well.

The draw depends on seed and id alone, so lost tasks redo the same rows and
rows with equal ids get equal counts.  Where a copy goes also depends on the row's place, so
``docs`` should be read alike by a repeated task: a scan, a written table or a checkpoint.

The rates are one number per key of ``weights`` plus one for all other
sources together, so they are bounded by the parameter (``MAX_SOURCES``),
never by the data; their cumulative probabilities are a broadcast table of so many rows.  All sources outside
``weights`` share the weight ``other_weight`` in proportion to their size.

Defined cases: a null source belongs to the others; a null id hashes as the
text ``null``; a weight of zero drops a source; a source with weight but no rows is
left out of the scaling; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, col, fresh, row_hash

MAX_SOURCES = 10_000
#: 13 hex digits of a hash: 52 bits, exact in a double.
HEX_DIGITS = 13


def uniform(seed: int, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** HEX_DIGITS))


def cumulative(rate: float) -> list[float]:
    """P(X <= k) of a Poisson distribution for k = 0, 1, ... up to the last one that a 52-bit uniform number can reach."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0 ** -52 and k <= rate + 12 * math.sqrt(rate) + 40:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def poisson_count(u: Column, steps: Column) -> Column:
    """Smallest k with u < P(X <= k): the number of cumulative probabilities that u reaches."""
    return F.size(F.filter(steps, lambda p: p <= u))


def mixing_rates(docs: DataFrame, weights: dict[str, float], *, source_col: str = "source",
                 size_col: str | None = None, other_weight: float = 0.0,
                 epochs: float = 1.0) -> dict[str | None, float]:
    """Mean repetition rate by weighted source; the key None stands for all other sources.

    One aggregate over all rows; its result has at most ``len(weights) + 1`` rows.
    """
    check_columns(docs, source_col, *([size_col] if size_col else []))
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} weights; at most {MAX_SOURCES}")
    if min([other_weight, *weights.values()]) < 0:
        raise ValueError("weights must not be negative")
    src = col(source_col).cast("string")
    known = F.when(src.isin(*weights), src) if weights else F.lit(None).cast("string")
    size = F.sum(F.coalesce(col(size_col), F.lit(0))) if size_col else F.count("*")
    sizes = {r["s"]: float(r["n"]) for r in docs.groupBy(known.alias("s")).agg(size.alias("n")).collect() if r["n"] > 0}
    share = {s: w for s, w in [*weights.items(), (None, other_weight)] if s in sizes}
    scale = sum(share.values())
    total = sum(sizes.values())
    return {s: epochs * w * total / (scale * sizes[s]) if scale else 0.0 for s, w in share.items()}


def mix_sources(docs: DataFrame, weights: dict[str, float], *, id_col: str = "doc_id", source_col: str = "source",
                size_col: str | None = None, other_weight: float = 0.0, epochs: float = 1.0, seed: int = 42,
                numbered: bool = True) -> DataFrame:
    """Every drawn copy with the columns of ``docs``; ``numbered`` adds copy_no and n_copies.

    Where ``docs`` has columns of these names, the added ones get leading underscores.
    """
    check_columns(docs, id_col, source_col)
    rates = mixing_rates(docs, weights, source_col=source_col, size_col=size_col, other_weight=other_weight,
                         epochs=epochs)
    rest = F.lit(cumulative(rates.pop(None, 0.0)))
    n, copy, place, name_, steps = fresh(docs, "n", "copy", "place", "name", "steps")
    if rates:
        # At most MAX_SOURCES rows of a few dozen numbers each.
        by_source = docs.sparkSession.createDataFrame([(s, cumulative(r)) for s, r in rates.items()], f"`{name_}` string, `{steps}` array<double>")
        docs_ = docs.join(F.broadcast(by_source), col(source_col).cast("string") == col(name_), "left").withColumn(steps, F.coalesce(col(steps), rest))
    else:
        docs_ = docs.withColumn(steps, rest)
    count = poisson_count(uniform(seed, col(id_col)), col(steps))
    # The row's place in its input split tells equal rows apart; a lost task reads the same split again.
    at = F.xxhash64(row_hash(docs, seed), F.monotonically_increasing_id())
    drawn = docs_.select(*[col(c) for c in docs.columns], count.alias(n), at.alias(place)).where(col(n) > 0)
    copies = (drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), col(n))))
              .withColumn(place, F.xxhash64(col(place), col(copy))))
    mixed = copies.repartition(place).sortWithinPartitions(place)
    out = [col(c) for c in docs.columns]
    if numbered:
        taken = {c.lower() for c in docs.columns}
        name = lambda c: c if c not in taken else f"_{c}"
        out += [col(copy).alias(name("copy_no")), col(n).alias(name("n_copies"))]
    return mixed.select(*out)
