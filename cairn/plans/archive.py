"""Features of a stored cloud's set, computed for several voxel edges and radii and stored as a new set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.cloud import XYZ
from cairn.operators.sampling import skip_sample
from cairn.plans.multiscale import multi_radius, vector_multiscale
from cairn.sources.store import CloudStore

#: (voxel edge, radii) of each pass.
ScaleSet = list[tuple[float, list[float]]]


def archive_features(
    store: CloudStore, tag: str, scales: ScaleSet, kind: str = "eig", skip: int = 1, seed: int = 1, search: str = "all", columns: int = 0, save_as: str | None = None
) -> DataFrame:
    """(id, label, feats) for the points of set `tag`: the features of every (edge, radii) of scales, laid end to end in
    that order, radii descending; saved as a set if save_as is given.

    kind: "eig", "eigvec" or "cov" (see multi_radius, profile gpu), or "vector": means of the first `columns` entries of
    the set's feats over the neighbours. skip: all labelled points and one of skip of the others take part; 1: all, 0:
    labelled ones only. Search space: the stored points, "unlabelled" leaves out the set's labelled ones; for "vector"
    only the set's points have values to search. Labels are carried, null if there are none. All points of a pass share
    one join, so there are no partitions to loop over and none too small to be computed.
    """
    members, points = store.index(tag), store.points().select("id", *XYZ)
    if "label" not in members.columns:
        members = members.withColumn("label", F.lit(None).cast("int"))
    chosen = skip_sample(members.select("id", "label"), skip, seed)
    query = points.join(chosen, "id")
    space = points
    if search == "unlabelled":
        space = points.join(members.where("label is not null").select("id"), "id", "left_anti")
    elif search != "all":
        raise ValueError(f"unknown search space: {search}")
    parts = []
    for k, (edge, radii) in enumerate(scales):
        if kind == "vector":
            names = [f"v{i}" for i in range(columns)]
            valued = space.join(members.select("id", *(F.get("feats", F.lit(i)).alias(n) for i, n in enumerate(names))), "id")
            one = vector_multiscale(query, valued, names, edge, radii)
        else:
            one = multi_radius(query, space, edge, radii, kind)
        parts.append(one.select(F.col("qid").alias("id"), F.array(*(F.col(c).cast("double") for c in one.columns if c != "qid")).alias(f"_{k}")))
    wide = reduce(lambda a, b: a.join(b, "id"), parts)
    out = query.select("id", "label").join(wide, "id").select("id", "label", F.concat(*(F.col(f"_{k}") for k in range(len(parts)))).alias("feats"))
    if save_as is None:
        return out
    store.add_set(save_as, out)
    return store.index(save_as)
