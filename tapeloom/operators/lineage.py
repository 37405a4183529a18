"""Strategy families: parent trees, spec differences, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.spec import fingerprint
from tapeloom.runtime import stage


def lineage(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node of parent-pointer trees.

    ``nodes``: family, id, parent_id.  A parent outside the family makes a root.
    Each round doubles the distance a pointer spans, so even a chain of a
    million versions needs about twenty joins.  A node is settled once its
    pointer reaches a root; settled nodes are kept aside.  Once a pointer spans
    more steps than there are nodes, whatever is still open runs in a circle:
    such nodes have a null root and depth.
    """
    ids = nodes.select("family", F.col("id").alias("parent_id"), F.lit(True).alias("_known"))
    linked = nodes.select("family", "id", "parent_id").join(ids, ["family", "parent_id"], "left")
    at = F.when(F.col("_known"), F.col("parent_id"))
    state = stage(
        linked.select(
            "family",
            "id",
            F.coalesce(at, F.col("id")).alias("up"),
            F.when(at.isNull(), 0).otherwise(1).cast("long").alias("depth"),
            at.isNull().alias("done"),
        )
    )
    done, open_nodes, span, total = state.where("done"), state.where(~F.col("done")), 1, nodes.count()
    while span <= total and not open_nodes.isEmpty():
        above = state.select(
            "family",
            F.col("id").alias("up"),
            F.col("up").alias("up2"),
            F.col("depth").alias("depth2"),
            F.col("done").alias("done2"),
        )
        moved = stage(
            open_nodes.join(above, ["family", "up"]).select(
                "family",
                "id",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("depth2")).alias("depth"),
                F.col("done2").alias("done"),
            )
        )
        done = done.unionByName(moved.where("done"))
        state, open_nodes, span = done.unionByName(moved.where(~F.col("done"))), moved.where(~F.col("done")), 2 * span
    circling = open_nodes.select("family", "id", F.lit(None).cast(nodes.schema["id"].dataType).alias("up"), F.lit(None).cast("long").alias("depth"))
    settled = done.select("family", "id", "up", "depth").unionByName(circling)
    return nodes.join(settled.withColumnRenamed("up", "root_id"), ["family", "id"])


def spec_diff(fields: DataFrame, left: str, right: str) -> DataFrame:
    """Paths of two stored specs that differ; a missing side shows as a dash."""
    a = fields.where(F.col("id") == left).select("path", F.col("value").alias("left_value"))
    b = fields.where(F.col("id") == right).select("path", F.col("value").alias("right_value"))
    joined = a.join(b, "path", "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    dash = F.lit("—")
    return joined.select(
        "path", F.coalesce("left_value", dash).alias("left_value"), F.coalesce("right_value", dash).alias("right_value")
    )


def with_fingerprint(strategies: DataFrame, parts: str = "parts") -> DataFrame:
    """Content hash of the rule lines (sorted); equal rules give equal hashes."""
    return strategies.withColumn("fingerprint", fingerprint(F.array_sort(parts)))


def unique_strategies(strategies: DataFrame) -> DataFrame:
    """One strategy per fingerprint, the smallest id."""
    rest = [c for c in strategies.columns if c != "fingerprint"]
    return strategies.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), "id").alias("_s")).select(
        "fingerprint", "_s.*"
    )


def family_members(strategies: DataFrame, family: str) -> DataFrame:
    return strategies.where(F.col("family") == family).orderBy("version")
