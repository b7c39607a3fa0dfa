"""Connected components of a link table, by contracting it step by step in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import fresh_path, write_and_read


def _order(node: Column, step: int) -> Column:
    """Another order of the nodes in each step, which no order of the ids can work against."""
    return F.struct(F.xxhash64(node, F.lit(step)).alias("by"), node.alias("node"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: for each id in ``links`` (``a``, ``b``) the smallest id it is connected with.

    In each step every node goes to the first among itself and its neighbours, in an order drawn anew for the step, and
    from there once more to where that one goes. Links are redrawn between what the nodes went to, until none is left.
    A node stays only where it comes first among its neighbours, so at most about half of those with links are left
    on average, less for most tables, and the steps follow the logarithm of the nodes, a chain of links included.
    Only pairs of ids are stored, none of them on the driver.
    """
    spark = links.sparkSession
    links = write_and_read(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), fresh_path(spark, "links"))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    found, step = None, 0
    while True:
        step += 1
        near = links.select(both.alias("x")).groupBy("x.node").agg(F.min(_order(F.col("x.other"), step)).alias("first"))
        goes = near.select("node", F.least("first", _order(F.col("node"), step))["node"].alias("to"))
        goes = write_and_read(goes, fresh_path(spark, "goes"))
        further = goes.select(F.col("node").alias("to"), F.col("to").alias("end"))
        goes = write_and_read(goes.join(further, "to").select("node", F.col("end").alias("to")), fresh_path(spark, "goes"))
        a, b = goes.select(F.col("node").alias("a"), F.col("to").alias("to_a")), goes.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        left = links.join(a, "a").join(b, "b").where("to_a != to_b")
        left = left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        if found is None:
            found = goes.select("node", F.col("to").alias("component"))
        else:
            moved = goes.select(F.col("node").alias("component"), "to")
            found = found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = write_and_read(found, fresh_path(spark, "components"))
        links = write_and_read(left, fresh_path(spark, "links"))
        if links.isEmpty():
            break
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return write_and_read(found.join(least, "component").select("node", F.col("least").alias("component")), fresh_path(spark, "components"))
