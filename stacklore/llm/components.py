"""Connected components of a table of links, by min labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import forget, keep


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node that it is linked with, over any steps) of every node in ``links`` (a, b).

    Each round takes the least label among neighbours and then that label's own
    label, so that a path of n links needs about log n rounds. Every round is a
    few joins on long keys, written to the shared folder; nothing is collected but
    the number of labels that changed.
    """
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    was = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = keep(step.join(jump, "comp").select("node", "was", F.least("comp", "further").alias("comp")), "labels")
        forget(was)
        was, labels = new, new.select("node", "comp")
        if not new.where("was <> comp").limit(1).count():
            return labels
