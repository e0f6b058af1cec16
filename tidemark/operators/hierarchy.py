"""Teams of tasks: a root and all that it started, directly or not. Forks are no part of a team."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stored import materialise


def subtree(threads: DataFrame, root: str, paths: bool = True) -> DataFrame:
    """id, depth and path of the root and its descendants; without paths only id and depth.

    Every task points to its parent, then to the one that this one points to, and so on, so a tree of any depth takes a round for each doubling of its depth. What ends elsewhere than at the
    root is dropped on the way, and so is what only leads around a cycle. A task has one parent; of several that are told, the smallest counts. Paths grow with the depth.
    """
    parents = threads.groupBy("id").agg(F.min("subagent_parent_id").alias("up"))
    top = F.col("id") == root
    path = [F.array("id").alias("path")] * paths
    rows = parents.select("id", F.when(~top, F.col("up")).alias("up"), F.when(top, 0).otherwise(1).alias("depth"), top.alias("top"), *path).where("top or up is not null")
    rows = materialise(rows)
    most = rows.count().bit_length() + 1  # what isn't at its end by then is in a cycle
    while most and not (moving := rows.where("up is not null")).isEmpty():
        ahead = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("top").alias("_top"), *[F.col("path").alias("_path")] * paths)
        path = [F.concat("_path", "path").alias("path")] * paths
        moved = moving.join(ahead, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("top"), *path)
        rows, most = materialise(rows.where("up is null").unionByName(moved.where("top or up is not null")), rows), most - 1
    return rows.where("top").select("id", "depth", *["path"] * paths)


def related(threads: DataFrame, thread: str) -> DataFrame:
    """Neighbours of a thread with each relation that they have to it; `unknown` if only the older inheritance edge joins them."""
    own = threads.where(F.col("id") == thread).select(F.col("subagent_parent_id").alias("_up"), F.col("forked_from_id").alias("_from"), F.col("parent_id").alias("_old"))
    near = threads.where(F.col("id") != thread).join(F.broadcast(own.limit(1)), (F.col("id") == F.col("_up")) | (F.col("id") == F.col("_from")) | (F.col("id") == F.col("_old")) | F.array_contains(F.array("subagent_parent_id", "forked_from_id", "parent_id"), thread))
    is_ = lambda c, to, name: F.when(F.col(c) == to, name)
    kinds = F.array_compact(
        F.array(is_("subagent_parent_id", F.lit(thread), "subagent"), is_("forked_from_id", F.lit(thread), "fork"), is_("id", F.col("_up"), "subagent_parent"), is_("id", F.col("_from"), "fork_parent"))
    )
    return near.select("id", "title", F.explode(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("unknown")))).alias("relation"))
