"""Sync of projects by revision numbers: what each project does next, by what it knows of its own and the shared copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_actions(projects: DataFrame) -> DataFrame:
    """Projects with the action that their state asks for, and the base a merge has.

    projects: (project_id, touched, synced_rev, marker_target, marker_base, remote_rev, remote_hash, base_rev, base_hash, reachable). A marker is a push
    that was under way. action: wait (the shared copy can't be reached while a push is in doubt), landed (the push took: adopt its
    number), push (it didn't, or local work is ahead), merge (three-way from the base, or from an empty base where both sides wrote one
    number, so that nothing is deleted), adopt (the shared copy wins; a backup of local work first if there is any), idle.
    A base is trusted only at the synced number.
    """
    marked, remote, synced = F.col("marker_target").isNotNull(), F.col("remote_rev"), F.col("synced_rev")
    trusted = F.col("base_hash").isNotNull() & F.col("base_rev").eqNullSafe(synced)
    foreign = remote.isNull() & F.col("remote_hash").isNotNull()
    moved = F.coalesce(remote > synced, synced.isNull() & remote.isNotNull())
    fork = trusted & F.coalesce(remote == synced, F.lit(False)) & ~F.col("remote_hash").eqNullSafe(F.col("base_hash"))
    same_base = remote.eqNullSafe(F.col("marker_base")) & ~(F.col("marker_base").isNull() & F.col("remote_hash").isNotNull())
    regressed = F.coalesce(remote < synced, F.lit(False))
    diverged = F.when(fork, "merge").when(trusted & moved, "merge").otherwise("adopt")
    action = (
        F.when(marked & ~F.col("reachable"), "wait").when(~F.col("reachable"), "idle")
        .when(marked & remote.eqNullSafe(F.col("marker_target")), "landed").when(marked & same_base, "push").when(marked, diverged)
        .when(fork, "merge").when(moved | foreign | regressed, F.when(F.col("touched") & trusted & moved, "merge").otherwise("adopt")).when(F.col("touched"), "push").otherwise("idle")
    )
    out = projects.withColumn("action", action)
    backup = (F.col("action") == "adopt") & F.col("touched")
    return out.withColumns({"merge_base": F.when(F.col("action") == "merge", F.when(fork, "empty").otherwise("synced")), "backup": backup})
