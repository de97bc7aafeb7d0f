"""Connected components of a link table, as joins and aggregates.

Each round hooks every component to the smallest component it is linked with,
follows the hooks to their roots by pointer doubling, and keeps the links
that still run between different components. The tables shrink from round to
round and are written to the shared folder, so a lost executor costs one step;
only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalis.llm.layout import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for every id that occurs in a link, the smallest id reachable.

    Rows with a null end or with equal ends link nothing and add no id.
    """
    links = (links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
             .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct())
    links = written(links, "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = written(both.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("u").alias("w"), F.col("p").alias("pp"))
            jumped = written(hooks.join(up, F.col("p") == F.col("w"))
                             .select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "hooks")
            hooks = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select(F.col("u").alias("id"), F.col("p").alias("component_id"))
        else:
            labels = written(labels.join(hooks, F.col("component_id") == F.col("u"), "left")
                             .select("id", F.coalesce("p", "component_id").alias("component_id")), "labels")
        up = hooks.select(F.col("u").alias("w"), F.col("p").alias("pp"))
        links = written(links.join(up, F.col("u") == F.col("w")).select(F.col("pp").alias("u"), "v")
                        .join(up, F.col("v") == F.col("w")).select("u", F.col("pp").alias("v"))
                        .where("u != v").distinct(), "links")
    if labels is None:
        labels = links.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return labels
