"""Document fingerprints: a homomorphic multiset hash, by DataFrame functions only.

A text is the multiset of its paragraphs, which here end at line breaks and at the
end of a sentence (texts of one line are common). Each paragraph hashes to a wide
vector of 120 signs, from two 64-bit hashes of 60 bits each; the fingerprint is the
sum of the vectors, so the order of paragraphs does not matter, and a paragraph goes
in or out by adding or subtracting its vector. Bits are counted in packed form:
``hash >> j`` under a mask puts two bits into lanes of 30 bits of a long, and sums
of longs are kept modulo 2**60. Each lane counts the ones of one bit; with the number
of paragraphs, that gives the sum of signs.

Likeness of two fingerprints is twice their product over the sum of their squares:
what the sum of signs is for a multiset, the estimate of it for shared paragraphs.
It is 1 for equal fingerprints and near 0 for texts without a common paragraph, with
a standard error of about 0.1.

Cases: a null text is an empty one, whose fingerprint is all zeros; two empty texts
are alike (1), an empty and another are not (0); a lane counts to 2**30 - 1, and a text
of the 2**31 - 16 bytes that a string can have holds fewer paragraphs, so sums are exact
for every text; rows with one id follow each other by a hash of their text; null ids come last in the
descending order; an empty table stays empty; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a paragraph ends.
BREAKS = r"\n+|(?<=[.!?])[ \t]+"
#: Bits of a lane, lanes of a long, and hash seeds.
LANE, LANES, SEEDS = 30, 2, (17, 71)
_MASK = sum(1 << (LANE * k) for k in range(LANES))
_MODULUS = (1 << (LANE * LANES)) - 1
_LONGS = LANE * len(SEEDS)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text as an array; none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda p: p != "")


def vector(parts: Column) -> Column:
    """The fingerprint of an array of paragraphs: their number, then packed counts of ones, all modulo 2**60."""

    def summed(hashes: Column, shift: Column) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.call_function("shiftrightunsigned", h, shift).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MODULUS)))

    def of(seed: int) -> Column:
        # The hashes are bound to a variable, so that they are made once and not for each shift.
        bound = F.transform(F.array(F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))), lambda h: F.transform(F.sequence(F.lit(0), F.lit(LANE - 1)), lambda j: summed(h, j)))
        return bound[0]

    return F.concat(F.array(F.size(parts).cast("long")), *[of(s) for s in SEEDS])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together, or of the first without the second (``sign`` -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MODULUS)))


def shown(fingerprint: Column) -> Column:
    """The fingerprint as a string: 15 hexadecimal digits for each number."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def signs(fingerprint: Column) -> Column:
    """The summed signs: twice the ones of each bit, less the number of paragraphs."""
    lane = (1 << LANE) - 1
    n = fingerprint[0]

    def of(k: int) -> Column:
        return F.transform(F.slice(fingerprint, 2, _LONGS), lambda x: 2 * F.shiftright(x, LANE * k).bitwiseAND(F.lit(lane)) - n)

    return F.concat(*[of(k) for k in range(LANES)])


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    zero = F.lit(0.0)
    total = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
    products = F.zip_with(signs(a), signs(b), lambda x, y: F.struct((x.cast("double") * y).alias("xy"), (x.cast("double") * x + y.cast("double") * y).alias("squares")))
    bound = F.transform(F.array(products), lambda p: F.struct(total(F.transform(p, lambda v: v["xy"])).alias("xy"), total(F.transform(p, lambda v: v["squares"])).alias("squares")))[0]
    ratio = F.transform(F.array(bound), lambda v: F.when(v["squares"] > 0, 2 * v["xy"] / v["squares"]).otherwise(zero))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(zero, F.least(F.lit(1.0), ratio)))


#: Ranges of ids for each shuffle partition.
RANGES = 4


def _range_number(id: Column, cuts: list, tie: Column) -> Column:
    """Which range an id is in, rising as ids fall: a search in two steps over descending cuts; null ids spread by hash."""
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]

    def passed(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda n, c: n + (id < c).cast("int"))

    if not groups:
        known = F.lit(0)
    else:
        coarse = F.array(*[F.lit(g[0]) for g in groups])
        fine = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        known = F.transform(F.array(passed(coarse)), lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * width + passed(F.get(fine, g - 1))))[0]
    return F.when(id.isNull(), len(cuts) + 1 + F.shiftright(tie, 55).cast("int")).otherwise(known)


def with_next(df: DataFrame, id: str, text: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next``, a struct of ``columns`` of the row that follows in descending id; after the last row, the first.

    Ids are cut into ranges at quantiles and each range is ordered by itself; the first
    row of the range after stands behind its last row. A task sees its ranges only, and
    a row's text moves once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    cuts = df.select(F.percentile_approx(id, [k / parts for k in range(1, parts)], 20000).alias("q")).first().q or []
    cuts = sorted({c for c in cuts if c is not None}, reverse=True)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(text)), 1)
    ranged = df.withColumn("__tie", tie).withColumn("__range", _range_number(F.col(id), cuts, F.col("__tie")))

    # The first row of each range: its id and tie by an aggregate, then the row itself; one row a range.
    leads = ranged.groupBy("__range").agg(F.max(F.struct(F.col(id).alias("id"), (-F.col("__tie")).alias("tie"))).alias("lead"))
    after = Window.orderBy("__range")
    leads = leads.withColumn("__before", F.lag("__range").over(after)).withColumn("__last", F.max("__range").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    leads = leads.select("__range", F.coalesce("__before", "__last").alias("__before"), F.col("lead.id").alias("__id"), (-F.col("lead.tie")).alias("__lead_tie"))
    found = ranged.join(F.broadcast(leads), "__range").where(F.col(id).eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__lead_tie")))
    behind = found.dropDuplicates(["__range"]).select(*df.columns, "__tie", F.col("__before").alias("__range"), F.lit(1).alias("__behind"))

    within = Window.partitionBy("__range").orderBy("__behind", F.col(id).desc_nulls_last(), F.col("__tie"), F.col(text))
    both = ranged.withColumn("__behind", F.lit(0)).unionByName(behind)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(within)).where("__behind = 0").drop("__behind", "__range", "__tie")


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as an array of longs."""
    return df.withColumn(name, vector(paragraphs(F.col(text))))
