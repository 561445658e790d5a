"""A Merkle manifest of a dataset, built level by level with windows.

A row is a leaf: the SHA-256 of its fields. In each group the leaves stand in order; every RUN consecutive nodes become
their parent, until one node, the group's subroot, is left. The subroots, ordered by group, become the root in the same
way. Whoever has a row, the digests beside its path and the root can tell whether the row is the one that was listed.

A level is one window: partitioned by group and parent number, so that a window holds RUN nodes at most, its full
ordered frame is collected into every row of the run. That list is both what the parent is the hash of and, without
the own digest, the siblings that a proof needs. Parents are deduplicated by keeping the run's first row, which has
RUN times fewer rows for the next level. Numbering the leaves of a group uses no window over it (common.numbered), so
a group may hold any share of the rows. Proofs come down the levels again, each node's from its parent's by a join on
group and number, in which a key has RUN rows at most.

Defined results: a null field is "-" and differs from every text; null groups are a group of their own, before all
others; within a group null ids come first and rows of one id go by their leaf, so repeated rows are leaves of their
own, in an order that does not matter; a lone leaf is its group's subroot, a lone subroot the root; an empty table has
no rows and no root; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import numbered, release, settle

RUN = 16
#: Group of the upper tree's nodes.
ALL = ""


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field's share of its leaf: its length in bytes and itself, so that no two rows have the same input."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(run: Column) -> Column:
    return F.array_join(run, "")


def with_runs(nodes: DataFrame) -> DataFrame:
    """(grp, idx, digest, ...) -> also up (the parent's number), run (all digests of the run, in order) and top: no
    other node is left in the group."""
    frame = Window.partitionBy("grp", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = nodes.withColumn("up", F.expr(f"idx div {RUN}")).withColumn("run", F.collect_list("digest").over(frame))
    return runs.withColumn("top", (F.col("up") == 0) & (F.size("run") == 1))


def parents(level: DataFrame) -> DataFrame:
    """The next level's nodes, one for each run."""
    return level.where(~F.col("top") & (F.col("idx") % RUN == 0)).select("grp", F.col("up").alias("idx"), digest(_joined(F.col("run"))).alias("digest"))


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Numbered leaves (grp, idx, digest) -> the levels above them, settled, and each group's last node (grp, digest, level)."""
    below, levels, tops = with_runs(leaves), [], []
    while True:
        tops.append(below.where("top").select("grp", "digest", F.lit(len(levels)).alias("level")))
        above = settle(with_runs(parents(below)), "level")
        if above.isEmpty():
            release(above)
            break
        levels.append(above)
        below = above
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return levels, settle(found, "subroots")


def descend(level: DataFrame, number: int, above: DataFrame | None, base: DataFrame) -> DataFrame:
    """Each node of a level with its steps up to the root: (place in its run, the run), the lowest first.

    above: the next level's nodes (grp, idx, steps and what else base has); base: what the last node of each group goes
    on with, and the number of the level that it is on."""
    over = base.where(F.col("level") == number).drop("level").withColumn("idx", F.lit(0).cast("long"))
    over = over if above is None else over.unionByName(above.select(*over.columns))
    own = F.array(F.struct((F.col("idx") % RUN).cast("int").alias("place"), "run"))
    joined = level.join(over.withColumnRenamed("idx", "up"), ["grp", "up"])
    return joined.withColumn("steps", F.when(F.col("top"), F.col("steps")).otherwise(F.concat(own, "steps"))).drop("up", "run", "top")


def paths(levels: list[DataFrame], base: DataFrame) -> DataFrame | None:
    """The nodes of the lowest of these levels (numbered from 1) with their steps."""
    found = None
    for number in range(len(levels), 0, -1):
        found = settle(descend(levels[number - 1], number, found, base).drop("digest"), "paths")
    return found


def build(leaves: DataFrame) -> DataFrame:
    """Leaves (grp without nulls, id, digest, ...) -> all their columns but grp, with subroot, root and steps.

    Tables of the levels above the leaves stay in the shared folder, as the result reads them; they hold a
    fifteenth of the leaves' number."""
    held = settle(leaves, "leaves")
    ranked = numbered(held, ["grp"], ["id", "digest"], "idx")
    levels, subroots = climb(ranked.select("grp", "idx", "digest"))

    listed = numbered(subroots.withColumn("_all", F.lit(ALL)), ["_all"], ["grp"], "idx").withColumnsRenamed({"grp": "of", "level": "of_level", "_all": "grp"})
    upper, tops = climb(listed.select("grp", "idx", "digest"))
    none = F.array().cast(f"array<struct<place:int,run:array<string>>>")
    start = tops.select("grp", "level", none.alias("steps"), F.col("digest").alias("root"))
    base = descend(with_runs(listed), 0, paths(upper, start), start)
    base = settle(base.select(F.col("of").alias("grp"), F.col("of_level").alias("level"), "steps", "root", F.col("digest").alias("subroot")), "subroot-paths")
    return descend(with_runs(ranked), 0, paths(levels, base), base).drop("grp", "idx")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of docs: id, digest (its leaf), subroot, root, steps (the proof) and other, the leaf of the row
    as it is with the altered columns where ``when`` holds, else null."""
    part = lambda c, changed: field(changed.get(c, F.col(f"`{c}`")))
    leaf = lambda changed: digest(*[part(c, changed) for c in fields])
    group = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    other = F.when(when, leaf(altered)) if altered else F.lit(None).cast("string")
    return build(docs.select(group.alias("grp"), F.col(f"`{id_col}`").alias("id"), leaf({}).alias("digest"), other.alias("other")))


def proof(steps: Column) -> Column:
    """The siblings' digests, level by level and left to right, as one text."""
    beside = lambda s: F.concat(F.slice(s["run"], F.lit(1), s["place"]), F.slice(s["run"], s["place"] + 2, F.lit(RUN)))
    return _joined(F.flatten(F.transform(steps, beside)))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to with these siblings."""
    up = lambda acc, s: digest(_joined(F.slice(s["run"], F.lit(1), s["place"])), acc, _joined(F.slice(s["run"], s["place"] + 2, F.lit(RUN))))
    return F.aggregate(steps, leaf, up)
