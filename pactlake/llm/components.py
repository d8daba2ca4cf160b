"""Connected components by minimum labels and pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm.common import MOST_BROADCAST, written

#: Bytes of a label in memory, at most about.
_LABEL_BYTES = 80


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), a stored table that every round reads -> (id, comp): the smallest id that can be reached, for every id with a link.

    Each round takes the smallest label among the neighbours and then, twice, the label's own label; labels only
    shrink, and the loop ends when both ends of every link have the same label: seen from the links where the labels
    are few enough to be broadcast, else from a round without a change. Minima are combined before the shuffle, so a
    hub costs no more than its degree. No links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.filter("a <> b")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "cc-labels")
    few = labels.count() * _LABEL_BYTES <= MOST_BROADCAST
    while not (few and agreed(links, labels)):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        found = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        for _ in range(2):
            found = found.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        found = written(found, "cc-labels")
        labels = found.select("id", "comp")
        if not few and found.filter("old <> comp").isEmpty():
            break
    return labels


def agreed(links: DataFrame, labels: DataFrame) -> bool:
    """Whether both ends of every link have the same label; labels are broadcast."""
    of = lambda end: F.broadcast(labels.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")))
    return links.join(of("a"), "a").join(of("b"), "b").filter("a_comp <> b_comp").isEmpty()
