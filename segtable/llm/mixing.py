"""Mixing sources to target weights by hierarchical budgets.

The levels of a tree (domain, language, source) are columns of the rows. A token
budget goes down from the root: a node's amount is shared among its children by
their weights; a child takes no more than its leaves hold in ``max_epochs`` epochs,
and what it cannot take goes to its siblings in proportion, so a shortage reaches
the children of an ancestor only when the whole subtree is used up.

A leaf's amount is as many whole epochs as fit and a token-prefix of the next one:
its rows in the order of a hash of seed, epoch and id, up to where the running total comes
nearest to the amount. The prefix is found in two steps, so that a leaf
with a third of all rows is no single task: sums over ``BUCKETS`` ranges of the hash
show the range in which the prefix ends, and only that range is ordered row by row.

A tree of up to ``MAX_LEAVES`` leaves is planned on the driver and broadcast to the
rows. A larger one is planned level by level as DataFrames, with windows over the
children of each node, and joined by shuffle; there, budgets differ from the driver's
by the rounding of sums of weights alone, and they add up to the same amount.

Cases: a null text has no tokens, and rows without tokens go with whole epochs and
prefixes like any others; a null level value is a child of its own; rows with one id
are neighbours in the order; weights of absent children do not matter and children
without a weight have weight 1; negative weights are an error, and children of weight
0 take only what no sibling can; an empty table gives an empty one; other columns
pass through, and one named ``copies`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import save

BUCKETS = 1024
#: A tree of up to so many leaves is planned on the driver, a larger one as DataFrames.
MAX_LEAVES = 100_000
#: A token here is a run of other than white space.
TOKEN = r"[^\x20\x09-\x0D]+"

Path = tuple
Weights = Callable[[Path, int], float]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def given(weights: dict[Path, float]) -> Weights:
    """Weights by path from the root; 1 for paths that are not named."""
    return lambda path, _: weights.get(path, 1.0)


def tempered(power: float) -> Weights:
    """Weights by size: a subtree's tokens to a power below 1, so that large ones give way to small ones."""
    return lambda _, size: float(size) ** power


def share(amount: int, weights: list[float], caps: list[int]) -> list[int]:
    """Whole numbers by weight, none above its cap, that add up to ``amount`` or to all caps."""
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    amount = min(amount, sum(caps))
    got = [0] * len(caps)
    for wanted in (True, False):  # those with a weight first; the others take what is left over
        open_ = [k for k, w in enumerate(weights) if (w > 0) == wanted and caps[k] > got[k]]
        while open_ and amount > 0:
            total = sum(weights[k] if wanted else 1.0 for k in open_)
            exact = {k: amount * (weights[k] if wanted else 1.0) / total for k in open_}
            full = [k for k in open_ if exact[k] >= caps[k]]
            if full:
                for k in full:
                    got[k] = caps[k]
                    amount -= caps[k]
                open_ = [k for k in open_ if exact[k] < caps[k]]
                continue
            for k in open_:
                got[k] = int(exact[k])
            rest = amount - sum(got[k] for k in open_)
            for k in sorted(open_, key=lambda k: (got[k] - exact[k], k)):
                more = min(rest, 1, caps[k] - got[k])
                got[k] += more
                rest -= more
            amount, open_ = 0, []
    return got


def budgets(leaves: dict[Path, int], amount: int, weights: Weights, max_epochs: int) -> dict[Path, int]:
    """Tokens for each leaf, from its own tokens and the amount for all."""
    out: dict[Path, int] = {}

    def go(prefix: Path, below: dict[Path, int], amount: int) -> None:
        if len(below) == 1 and prefix in below:
            out[prefix] = min(amount, below[prefix] * max_epochs)
            return
        children: dict[Path, dict[Path, int]] = {}
        for path, n in below.items():
            children.setdefault(path[: len(prefix) + 1], {})[path] = n
        names = sorted(children, key=repr)
        sizes = [sum(children[c].values()) for c in names]
        for c, part in zip(names, share(amount, [weights(c, s) for c, s in zip(names, sizes, strict=True)], [s * max_epochs for s in sizes]), strict=True):
            go(c, children[c], part)

    if leaves:
        go((), leaves, amount)
    return out


def _shared(children: DataFrame, names: list[str], weights: Weights, max_epochs: int) -> DataFrame:
    """``share`` for the children of every node: ``names`` and ``__size`` of a child and its parent's ``__amount``, to ``names`` and ``__amount``.

    In the order of cap by weight the full children come first, so running sums show
    which they are; the others take whole numbers and the largest remainders one more.
    """

    def weigh(*child) -> float:
        weight = float(weights(tuple(child[:-1]), child[-1]))
        if weight < 0:
            raise ValueError("weights must not be negative")
        return weight

    parent = [F.col(n) for n in names[:-1]] or [F.lit(0)]
    rows = children.withColumn("__weight", F.udf(weigh, "double")(*names, "__size")).withColumn("__cap", F.col("__size") * max_epochs)
    rows = rows.withColumn("__wanted", F.col("__weight") > 0)
    family = Window.partitionBy(*parent)
    rows = rows.withColumn("__all", F.sum("__cap").over(family)).withColumn("__first", F.sum(F.when(F.col("__wanted"), F.col("__cap")).otherwise(0)).over(family))
    rows = rows.withColumn("__amount", F.least("__amount", "__all"))
    # Those with a weight share first; the others, alike, what is left over.
    rows = rows.withColumn("__amount", F.when(F.col("__wanted"), F.least("__amount", "__first")).otherwise(F.greatest(F.lit(0), F.col("__amount") - F.col("__first"))))
    rows = rows.withColumn("__weight", F.when(F.col("__wanted"), F.col("__weight")).otherwise(1.0))
    rising = Window.partitionBy(*parent, "__wanted").orderBy(F.col("__cap") / F.col("__weight"), names[-1])
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("__left", F.col("__amount") - (F.sum("__cap").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__cap")))
    rows = rows.withColumn("__weights", F.sum("__weight").over(onward)).withColumn("__full", F.col("__left") * F.col("__weight") >= F.col("__cap") * F.col("__weights"))
    same = Window.partitionBy(*parent, "__wanted", "__full")
    full = Window.partitionBy(*parent, "__wanted")
    rows = rows.withColumn("__left", F.col("__amount") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(full))
    rows = rows.withColumn("__exact", F.greatest(F.lit(0.0), F.col("__left") * F.col("__weight") / F.sum("__weight").over(same)))
    rows = rows.withColumn("__whole", F.least(F.floor("__exact"), F.col("__cap")))
    rest = F.col("__left") - F.sum("__whole").over(same)
    more = F.row_number().over(same.orderBy(F.col("__cap") <= F.col("__whole"), F.col("__whole") - F.col("__exact"), names[-1])) <= rest
    got = F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", F.col("__whole") + more.cast("long")))
    return rows.select(*names, got.cast("long").alias("__amount"))


def _planned(leaves: DataFrame, names: list[str], amount: int, weights: Weights, max_epochs: int) -> DataFrame:
    """What ``budgets`` gives, as ``names`` and ``__amount``, for leaves (``names``, ``tokens``) of any number."""
    given_to = None
    for k in range(1, len(names) + 1):
        children = leaves.groupBy(*names[:k]).agg(F.sum("tokens").alias("__size"))
        children = children.withColumn("__amount", F.lit(amount).cast("long")) if given_to is None else _to_rows(children, given_to, names[: k - 1], small=False)
        given_to, _ = save(_shared(children, names[:k], weights, max_epochs), "mixing-budgets")
    return given_to


def mix(df: DataFrame, levels: dict[str, Column], weights: Weights, amount: int | None = None, fraction: float = 1.0, max_epochs: int = 4, seed: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``copies`` (long): how often each row is taken. ``amount`` is the budget in tokens, or ``fraction`` of all tokens."""
    spark = df.sparkSession
    names = [f"__level{k}" for k in range(len(levels))]
    rows = df.drop("copies").withColumns({n: c.cast("string") for n, c in zip(names, levels.values(), strict=True)} | {"__tokens": tokens(F.col(text))})
    totals = rows.groupBy(*names).agg(F.sum("__tokens").alias("tokens"))
    found = totals.limit(MAX_LEAVES + 1).collect()
    small = len(found) <= MAX_LEAVES
    kinds = ", ".join(f"{n} string" for n in names)
    if small:
        leaves = {tuple(r[n] for n in names): r.tokens for r in found}
        whole = sum(leaves.values())
        given_to = budgets(leaves, int(whole * fraction) if amount is None else amount, weights, max_epochs)
        plan = [(*path, given_to[path] // n if n else 0, given_to[path] % n if n else 0) for path, n in leaves.items()]
        planned = spark.createDataFrame(plan, f"{kinds}, __epochs long, __rest long")
    else:
        del found
        totals, _ = save(totals, "mixing-leaves")
        whole = totals.agg(F.sum("tokens")).first()[0]
        given_to = _planned(totals, names, int(whole * fraction) if amount is None else amount, weights, max_epochs)
        planned = _to_rows(totals, given_to, names, small=False)
        epochs, rest = F.expr("__amount div tokens"), F.expr("__amount % tokens")
        planned = planned.select(*names, F.when(F.col("tokens") > 0, epochs).otherwise(0).alias("__epochs"), F.when(F.col("tokens") > 0, rest).otherwise(0).alias("__rest"))
        planned, _ = save(planned, "mixing-plan")
    # A row for each leaf.
    placed = _to_rows(rows, planned, names, small=small)
    place = F.xxhash64(F.lit(seed), F.col("__epochs"), F.col(id))
    placed = placed.withColumn("__place", place).withColumn("__bucket", F.shiftrightunsigned("__place", 54).cast("int"))

    sums, _ = save(placed.groupBy(*names, "__rest", "__bucket").agg(F.sum("__tokens").alias("sum")), "mixing-buckets")
    upto = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("sum").over(upto)).where("upto > __rest").groupBy(*names).agg(F.min(F.struct("__bucket", (F.col("upto") - F.col("sum")).alias("before"))).alias("end"))
    if small:
        ends = spark.createDataFrame([(*[r[n] for n in names], r.end[0], r.end[1]) for r in ends.collect()], f"{kinds}, __end int, __before long")
    else:
        ends, _ = save(ends.select(*names, F.col("end.__bucket").alias("__end"), F.col("end.before").alias("__before")), "mixing-ends")

    placed = _to_rows(placed, ends, names, "left", small)
    inside = placed.where("__bucket = __end")
    running = Window.partitionBy(*names).orderBy("__place", id, F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__taken", (2 * (F.col("__before") + F.sum("__tokens").over(running)) - F.col("__tokens") <= 2 * F.col("__rest")).cast("long"))
    # A leaf whose rest no range exceeds has no end: its ranges all count, and with no rest left the first range of tokens ends it.
    outside = placed.where("__end is null or __bucket != __end").withColumn("__taken", F.coalesce(F.col("__bucket") < F.col("__end"), F.lit(True)).cast("long"))
    both = outside.unionByName(inside)
    return both.select(*[F.col(f"`{c}`") for c in df.columns if c != "copies"], (F.col("__epochs") + F.when(F.col("__rest") > 0, F.col("__taken")).otherwise(0)).alias("copies"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _to_rows(rows: DataFrame, leaves: DataFrame, names: list[str], how: str = "inner", small: bool = True) -> DataFrame:
    """``rows`` joined with a table that has a row for each leaf, broadcast if it is small."""
    other = leaves.select(*[F.col(n).alias(f"{n}_leaf") for n in names], *[c for c in leaves.columns if c not in names])
    on = _all(F.col(n).eqNullSafe(F.col(f"{n}_leaf")) for n in names)
    return rows.join(F.broadcast(other) if small else other, on, how).drop(*[f"{n}_leaf" for n in names])
