"""Connected components of a link table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import hot_rows, join_hot, remove, save


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b of one integer type) to a row for each end: id and component, the least id reachable.

    Every round takes the least label over a node's links and then the label's own
    label, so distances halve; it ends when no label has changed. Labels live in
    written tables, never on the driver. The links of a hub and the members of a giant
    component are dealt into pieces. An empty table gives an empty one.
    """
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    labels, path = save(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component")), "components")
    hubs = {r.other for r in hot_rows(both.groupBy("other").count(), ["other"])}
    total = _total(labels)
    while total is not None:
        # A node asks its label's node and its links' ends for their labels, all in one join.
        asks = labels.select("id", F.col("component").alias("asked")).unionByName(both.select("id", F.col("other").alias("asked")))
        known = labels.select(F.col("id").alias("asked"), "component")
        large = hubs | {r.component for r in hot_rows(labels.groupBy("component").count(), ["component"])}
        hot = links.sparkSession.createDataFrame([(k,) for k in sorted(large)], known.select("asked").schema) if large else None
        new, new_path = save(join_hot(asks, known, ["asked"], hot).groupBy("id").agg(F.min("component").alias("component")), "components")
        new_total = _total(new)
        remove(links.sparkSession, path)
        labels, path = new, new_path
        if new_total == total:
            break
        total = new_total
    return labels


def _total(labels: DataFrame):
    """The sum of all labels: it falls whenever any label does. None for an empty table."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
