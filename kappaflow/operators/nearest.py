"""Nearest dictionary entry by an index of segments whose radius widens.

If two texts are within ``radius`` edits and one of them is cut into
``radius + 1`` segments, at least one segment stands unchanged in the other
text, moved by a bounded number of places.  So the index of a dictionary holds,
for every entry, its segments by (length of the entry, number of the segment);
a term looks up its own substrings of those lengths at the places where a
segment can be.  That is one equi-join per radius; only its matches, the
candidates, are measured.  A candidate within the radius settles a term, since
every entry within the radius is a candidate.  Terms without one go on to the next of
``RADII``.  A term that is farther from every entry than the last radius is
measured against the dictionary in blocks, which is exact too; few misspellings
are that far.  A dictionary of one block needs no index.

Distances are on characters and case-sensitive; the first entry in dictionary order wins a
tie (Q6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Radii of the index, one after the other.
RADII = (1, 2, 4)
#: Dictionary entries of a block; blocks are dealt to ``SALTS`` tasks each.
BLOCK = 1024
SALTS = 16
FAR = 1 << 30
FOUND = ("dist", "idx", "term", "priority")


def segment_bounds(length: Column, radius: int) -> list[tuple[Column, Column]]:
    """(first place, length) of the ``radius + 1`` segments of a text, which differ by one in length at most."""
    short = F.floor(length / (radius + 1)).cast("int")
    first_long = (F.lit(radius + 1) - (length - short * (radius + 1))).cast("int")  # from this segment on they are longer
    return [(F.lit(i) * short + F.greatest(F.lit(0), F.lit(i) - first_long), short + F.when(F.lit(i) >= first_long, 1).otherwise(0))
            for i in range(radius + 1)]


def entry_keys(term: Column, radius: int) -> Column:
    """Keys of an entry: its length, and number and text of each segment; entries that are too short for that have one key."""
    n = F.length(term)
    cut = F.array(*[F.struct(n.alias("len"), F.lit(i).alias("seg"), F.substring(term, first + 1, size).alias("part"))
                    for i, (first, size) in enumerate(segment_bounds(n, radius))])
    return F.when(n > radius, cut).otherwise(F.array(F.struct(n.alias("len"), F.lit(-1).alias("seg"), F.lit("").alias("part"))))


def term_keys(term: Column, radius: int) -> Column:
    """Keys under which an entry within ``radius`` edits can be found."""
    n = F.length(term)

    def of_length(length):
        """Substrings for entries of one length; with d letters more or less, edits leave a segment's move within bounds."""
        more = n - length
        back = F.floor((F.lit(radius) - more) / 2).cast("int")
        ahead = F.floor((F.lit(radius) + more) / 2).cast("int")

        def moved(i, first, size):
            low = F.greatest(F.lit(0), first - back)
            return F.transform(F.sequence(low, F.greatest(low, F.least(n - size, first + ahead))), lambda at: F.struct(
                length.alias("len"), F.lit(i).alias("seg"), F.substring(term, at + 1, size).alias("part")))

        keys = [moved(i, first, size) for i, (first, size) in enumerate(segment_bounds(length, radius))]
        short = F.array(F.struct(length.alias("len"), F.lit(-1).alias("seg"), F.lit("").alias("part")))
        return F.when(length > radius, F.concat(*keys)).otherwise(short)

    lengths = F.sequence(F.greatest(F.lit(0), n - radius), n + radius)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def within_radius(terms: DataFrame, entries: DataFrame, radius: int, within: list[str]) -> DataFrame:
    """(term_raw, dist, idx, term, priority) of the nearest entry, for the terms that have one within ``radius`` edits."""
    index = entries.select(*within, *FOUND[1:], F.explode(entry_keys(F.col("term"), radius)).alias("key")).select(
        *within, *FOUND[1:], "key.*")
    asked = terms.select(*within, "term_raw", F.explode(term_keys(F.col("term_raw"), radius)).alias("key")).select(
        *within, "term_raw", "key.*")
    pairs = asked.join(index, [*within, "len", "seg", "part"])
    near = pairs.withColumn("dist", F.call_function("levenshtein", F.col("term_raw"), F.col("term"), F.lit(radius))).where("dist >= 0")
    return near.groupBy(*within, "term_raw").agg(F.min(F.struct(*FOUND)).alias("b")).select(*within, "term_raw", "b.*")


def _nearest_in(term: Column, entries: Column) -> Column:
    """Best entry of a block as STRUCT(dist, idx, term, priority); entries are in dictionary order.

    Case-sensitive, on characters; the first entry wins a tie (strict '<' in a scan).
    """
    none = F.struct(F.lit(FAR).alias("dist"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("term"),
                    F.lit(None).cast("int").alias("priority"))

    def closer(best, x):
        # With a limit the distance is -1 where it is larger: equal ones cannot win either.
        d = F.call_function("levenshtein", term, x["term"], best["dist"] - 1)
        found = F.struct(d.alias("dist"), x["idx"].alias("idx"), x["term"].alias("term"), x["priority"].alias("priority"))
        return F.when((best["dist"] > 0) & (d >= 0), found).otherwise(best)

    return F.aggregate(entries, none, closer)


def nearest_in_blocks(terms: DataFrame, entries: DataFrame, last: int, block: int, within: list[str]) -> DataFrame:
    """The nearest entry of each term by blocks 0 to ``last`` of the dictionary."""
    number = F.floor(F.col("idx") / block).cast("int")
    blocks = (entries.select(*within, number.alias("block"), F.struct("idx", "term", "priority").alias("e"))
              .groupBy(*within, "block").agg(F.array_sort(F.collect_list("e")).alias("entries"))  # at most ``block`` entries
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    asked = terms.select(*within, "term_raw", F.pmod(F.xxhash64("term_raw"), F.lit(SALTS)).cast("int").alias("salt"),
                         F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    best = (asked.join(blocks, [*within, "block", "salt"])
            .select(*within, "term_raw", _nearest_in(F.col("term_raw"), F.col("entries")).alias("b"))
            .groupBy(*within, "term_raw").agg(F.min("b").alias("b")))  # by distance, then dictionary position
    return best.select(*within, "term_raw", "b.*")


def one_entry_per_term(lexicon: DataFrame) -> DataFrame:
    """A dictionary with each term once (by kind, if it has one): at its first place, with its last priority."""
    keys = [*(["kind"] if "kind" in lexicon.columns else []), "term"]
    return lexicon.where(F.col("term").isNotNull()).groupBy(*keys).agg(
        F.min("idx").cast("int").alias("idx"), F.max_by("priority", "idx").cast("int").alias("priority"))


def nearest_terms(terms: DataFrame, lexicon: DataFrame, block: int = BLOCK, radii=RADII, no_index: int = BLOCK,
                  staged: bool = False) -> DataFrame:
    """(term_raw, dist, idx, term, priority): the nearest dictionary entry of each distinct term.

    ``idx`` is the position in the dictionary, so blocks and ties follow it.  Where
    both sides have a ``kind``, a term meets the dictionary of its kind only.  Each radius
    is one job, whose results are checkpointed; the open terms of the next are those without any.
    A dictionary with positions up to ``no_index`` is one bounded scan and has no index.
    ``staged``: the dictionary has each term once already and is cheap to read again.
    """
    within = ["kind"] if "kind" in lexicon.columns else []
    ensure_checkpoint_dir(terms.sparkSession)
    entries = lexicon if staged else one_entry_per_term(lexicon).checkpoint()
    top = entries.agg(F.max("idx")).first()[0]
    open_ = terms.select(*within, "term_raw").distinct()
    if top is None or top < no_index:
        return nearest_in_blocks(open_, entries, (top or 0) // block, block, within)
    found = None
    open_ = open_.checkpoint()
    for radius in radii:
        near = within_radius(open_, entries, radius, within).checkpoint()
        found = near if found is None else found.unionByName(near)
        open_ = open_.join(near.select(*within, "term_raw"), [*within, "term_raw"], "left_anti").checkpoint()
        if open_.isEmpty():
            return found
    return found.unionByName(nearest_in_blocks(open_, entries, top // block, block, within))
