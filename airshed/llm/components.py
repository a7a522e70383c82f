"""Connected components of a table of links, by alternating large and small stars.

Each round links every node to the least node it knows of, first from its larger neighbours,
then from its smaller ones, until no link changes; the links are then one star for each
component.  Minima are aggregated before the shuffle and joined back, so a hub's links are
never gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airshed.llm.common import Scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Large star: the larger neighbours of every node meet its least neighbour (or itself).  Small star: the smaller
    ones and the node itself do."""
    side = pairs if larger else pairs.where("b < a")
    least = side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = side.join(least, "a")
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) that isn't the least of its component."""
    stars = scratch.keep(links.where("a <> b").select("a", "b").distinct(), f"{name}0")
    seen, k = None, 0
    while True:
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, k = (state["n"], state["h"]), k + 1
        stars = scratch.keep(_star(_star(_both(stars), True), False), f"{name}{k}")
