"""Connected components of a table of links."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.scratch import release, written

#: Rows of one key from which on a join deals the key's rows over SALTS tasks.
HUB, SALTS = 100_000, 16


def hubs(rows: DataFrame, key: str, most: int) -> DataFrame:
    """hub: keys with over most rows; at most rows / most of them, so they are broadcast."""
    return rows.groupBy(F.col(key).alias("hub")).count().where(F.col("count") > most).select("hub")


def joined(left: DataFrame, key: str, spread: str, right: DataFrame, on: str, many: DataFrame) -> DataFrame:
    """left joined with right where key = on. Rows of a hub key are dealt by spread over SALTS tasks, each of which gets right's row of that key."""
    is_hub = F.col("hub").isNotNull()
    salt: Column = F.when(is_hub, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    a = left.join(F.broadcast(many), F.col(key) == F.col("hub"), "left").withColumn("salt", salt).drop("hub")
    every = F.when(is_hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(many), F.col(on) == F.col("hub"), "left").withColumn("its_salt", F.explode(every)).drop("hub")
    return a.join(b, (F.col(key) == F.col(on)) & (F.col("salt") == F.col("its_salt"))).drop("salt", "its_salt")


def narrowed(links: DataFrame) -> DataFrame:
    """Links a, b (a < b) that connect what links (a, b) connect, mostly fewer: each node keeps its smallest neighbour below, and that one takes over its other ones.

    Two nodes below the same one are connected through it before and through the smaller of them after, so no connection is
    lost and none is new. Forests of many buckets that hold the same copies fall together into one star.
    """
    d = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    d = d.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    return d.select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("x")).distinct().select(F.col("m").alias("a"), F.col("x").alias("b"))


def components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """node, component (its smallest node), for every node in links (a, b).

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label. The
    labels are written in the shared folder after each round, and those of the round before removed. A node with a
    third of all links, and a label that a third of all nodes have, are dealt over several tasks in the joins; minima are
    aggregated before they are shuffled. Only the number of changed labels comes to the driver.
    """
    once = written(narrowed(links), "links-once")
    both = written(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    release(once)
    centres = written(hubs(both, "b", hub), "hubs")
    labels = written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = joined(both, "b", "a", labels, "node", centres).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further")).join(labels.select("label").distinct(), F.col("at") == F.col("label"), "left_semi")
        new = joined(new, "label", "node", jump, "at", hubs(labels, "label", hub)).select("node", "old", F.least("label", "further").alias("label"))
        new = written(new, "labels")
        release(labels)
        if new.where("old != label").isEmpty():
            release(both, centres)
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
