"""History: commits, trees and blobs as tables, and what of them hasn't been seen.

Commit graphs up to a counted size are walked in one task, however deep they are; larger
ones by loops of joins, each round written to the shared folder. Only sets of a counted
size are sent to all executors, through the driver; other joins are shuffled. Trees are
walked level by level, all of a level in one join.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tarn.sources.storage import drop, materialise


#: A commit graph of up to so many edges is walked in one task, which holds it as lists; the count comes first.
MOST_EDGES = 2_000_000

#: Rows of a round that may be sent to all executors; the count comes first, since the planner goes by the size of files, and sorted ids take far more in memory (84 MB where it sends up to 10).
MOST_SENT = 100_000

#: Tables of a loop's rounds that are written as one when there are so many of a kind.
MOST_PARTS = 16


def _fits(edges: DataFrame) -> bool:
    return edges.count() <= MOST_EDGES


def _beside(rows: DataFrame, count: int | None = None) -> DataFrame:
    """``rows`` as a side of a join: sent to all executors if their ``count`` is small, else shuffled, whatever the planner takes their size for."""
    return F.broadcast(rows) if count is not None and count <= MOST_SENT else rows.hint("merge")


class _Growing:
    """Rows that each round of a loop adds to; a row is written again once for every 16-fold of rounds."""

    def __init__(self, name: str, first: DataFrame):
        self.name, self.parts = name, [(0, first)]

    def add(self, rows: DataFrame) -> None:
        """``rows`` and those before are tables of ``materialise``; the last one isn't touched until the next is added."""
        while len(self.parts) >= MOST_PARTS and len({level for level, _ in self.parts[-MOST_PARTS:]}) == 1:
            level, old = self.parts[-1][0], [t for _, t in self.parts[-MOST_PARTS:]]
            self.parts[-MOST_PARTS:] = [(level + 1, materialise(reduce(DataFrame.unionAll, old), self.name))]
            drop(*old)
        self.parts.append((0, rows))

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionAll, (t for _, t in self.parts))


def _in_one_task(nodes: DataFrame, edges: DataFrame, run, schema: StructType) -> DataFrame:
    """``run`` of (pairs of nodes, parents by child) in one task; ``nodes`` has two columns, ``edges`` (child, parent)."""
    first, second = nodes.columns
    fields = nodes.schema
    tagged = nodes.select(F.col(first).alias("a"), F.col(second).alias("b"), F.lit(None).cast(edges.schema["child"].dataType).alias("child"), F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"))
    both = tagged.unionAll(edges.select(F.lit(None).cast(fields[first].dataType), F.lit(None).cast(fields[second].dataType), "child", "parent"))

    def task(batches):
        pairs, parents = [], {}
        for batch in batches:
            for a, b, child, parent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if child is None:
                    pairs.append((a, b))
                else:
                    parents.setdefault(child, []).append(parent)
        rows = iter(run(pairs, parents))
        arrow = to_arrow_schema(schema)
        while block := list(islice(rows, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block, strict=True), arrow, strict=True)], schema=arrow)

    return both.repartition(1).mapInArrow(task, schema)


def reachable_by(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, id) of all ids reachable from ``starts`` (ref, id) over ``edges`` (child, parent), starts included; one walk for all refs."""
    starts = starts.select("ref", "id").distinct()
    if _fits(edges):

        def run(pairs, parents):
            tips: dict = {}
            for ref, tip in pairs:
                tips.setdefault(ref, []).append(tip)
            for ref, stack in tips.items():
                seen = set(stack)
                while stack:
                    at = stack.pop()
                    yield ref, at
                    for p in parents.get(at, ()):
                        if p not in seen:
                            seen.add(p)
                            stack.append(p)

        return materialise(_in_one_task(starts, edges, run, starts.schema), "reached")
    frontier = materialise(starts, "starts")
    seen = _Growing("seen", frontier)
    while n := frontier.count():
        step = edges.join(_beside(frontier, n), edges.child == frontier.id).select("ref", F.col("parent").alias("id")).distinct()
        frontier = materialise(step.join(_beside(seen.all()), ["ref", "id"], "left_anti"), "seen")
        seen.add(frontier)
    return seen.all()


def reachable(tips: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids reachable from ``tips`` (id) over ``edges`` (child, parent), tips included."""
    return reachable_by(tips.select(F.lit("").alias("ref"), "id"), edges).select("id")


def commit_range(tips: DataFrame, watermarks: DataFrame, edges: DataFrame) -> DataFrame:
    """reachable(tips) less reachable(watermarks)."""
    return reachable(tips, edges).join(_beside(reachable(watermarks, edges)), "id", "left_anti")


def introduced(refs: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits to scan for ``refs`` (ref, tip, watermark or null), each once over all refs.

    A tip that isn't in the graph is an error; a watermark that isn't there, or isn't an
    ancestor of its tip, counts as none; a new ref whose tip another ref's watermark
    reaches is skipped.
    """
    missing = refs.join(commits.select(F.col("id").alias("tip")), "tip", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a tip isn't in the commit graph")
    marked = refs.where("watermark is not null").select("ref", F.col("watermark").alias("id")).join(commits.select("id"), "id", "left_semi")
    behind = reachable_by(marked.select("ref", "id"), edges)
    old = refs.where("watermark is null").select("ref", F.col("tip").alias("id")).join(behind.select("id").distinct(), "id", "left_semi").select("ref")
    ahead = reachable_by(refs.join(old, "ref", "left_anti").select("ref", F.col("tip").alias("id")), edges)
    fitting = marked.join(ahead, ["ref", "id"], "left_semi").select("ref")
    covered = behind.join(fitting, "ref", "left_semi")
    return ahead.join(covered, ["ref", "id"], "left_anti").select("id").distinct()


def generations(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, generation): 1 for roots, else 1 + the largest of the parents'. What is behind a missing parent, or in a circle, has none."""
    if _fits(edges):

        def run(pairs, parents):
            known: dict = {}
            left, children = {}, {}
            for child, own in parents.items():
                left[child] = len(own)
                for p in own:
                    children.setdefault(p, []).append(child)
            ready = [i for i, _ in pairs if i not in parents]
            known.update((i, 1) for i in ready)
            while ready:
                at = ready.pop()
                for child in children.get(at, ()):
                    left[child] -= 1
                    known[child] = max(known.get(child, 1), known[at] + 1)
                    if not left[child]:
                        ready.append(child)
            yield from ((i, g) for i, g in known.items() if not left.get(i))

        nodes = commits.select("id", F.lit(0).alias("none"))
        schema = StructType([commits.schema["id"], StructField("generation", LongType())])
        return materialise(_in_one_task(nodes, edges.distinct(), run, schema), "generation")
    return _generations_by_joins(commits, edges)


#: How a commit stands in a large graph: without parents, with one, with several.
ROOT, SINGLE, MERGE = 0, 1, 2


def _generations_by_joins(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """``generations`` of a large graph: in rounds as many as the logarithm of the longest row of
    commits with one parent each, and then as many as merges stand behind each other.

    A commit with one parent jumps over twice as many others each round, until it stands
    on a root, which settles it, or on a merge. Then merges settle once all their parents have.
    """
    of_parent = edges.schema["parent"].dataType
    each = commits.select("id", F.lit(None).cast(of_parent).alias("parent"), F.lit(0).alias("n")).unionAll(edges.select("child", "parent", F.lit(1)))
    one = (F.count("parent") == F.sum("n")) & (F.min("parent") == F.max("parent"))
    nodes = materialise(each.groupBy("id").agg(F.min("parent").alias("to"), F.when(F.sum("n") == 0, ROOT).when(one, SINGLE).otherwise(MERGE).alias("kind")), "nodes")
    singles, merges = nodes.where(F.col("kind") == SINGLE), nodes.where(F.col("kind") == MERGE).select("id")

    def onto(rows: DataFrame) -> DataFrame:
        return _beside(rows.select(F.col("id").alias("at"), *(F.col(c).alias(f"at_{c}") for c in rows.columns[1:])))

    def standing(tables: list[DataFrame], kind: int) -> DataFrame:
        return reduce(DataFrame.unionAll, tables).where(F.col("kind") == kind)

    # (id, to, far, kind): ``to`` stands ``far`` before the commit, and ``kind`` is how. Without a parent in the graph a row is lost, and all that stand on it.
    jumps = [materialise(singles.select("id", "to").join(onto(nodes.select("id", "kind")), F.col("to") == F.col("at")).select("id", "to", F.lit(1).cast("long").alias("far"), F.col("at_kind").alias("kind")), "jumps")]
    most, far = singles.count(), 1
    moving = standing(jumps, SINGLE)
    while far < most and not moving.isEmpty():  # what jumps farther than there are commits goes in a circle
        ended = reduce(DataFrame.unionAll, [t.where(F.col("kind") != SINGLE) for t in jumps])
        step = moving.join(onto(ended.unionAll(moving)), F.col("to") == F.col("at")).select("id", F.col("at_to").alias("to"), (F.col("far") + F.col("at_far")).alias("far"), F.col("at_kind").alias("kind"))
        jumps.append(materialise(step, "jumps"))
        moving, far = standing(jumps[-1:], SINGLE), far * 2
    settled = nodes.where(F.col("kind") == ROOT).select("id", F.lit(1).cast("long").alias("generation")).unionAll(standing(jumps, ROOT).select("id", (F.col("far") + 1).alias("generation")))
    if merges.isEmpty():
        return settled

    # (child, on, far): a merge's parents stand ``far`` behind the merge ``on``, or ``far`` is the parent's generation, or null where it has none.
    behind = standing(jumps, MERGE)
    parents = settled.select("id", F.lit(None).cast(of_parent).alias("on"), F.col("generation").alias("far")).unionAll(behind.select("id", "to", "far")).unionAll(merges.select("id", "id", F.lit(0).cast("long")))
    own = edges.join(_beside(merges.withColumnRenamed("id", "child")), "child", "left_semi")
    up = materialise(own.join(onto(parents), F.col("parent") == F.col("at"), "left").select("child", F.col("at_on").alias("on"), F.col("at_far").alias("far")), "merges")

    def ready(rows: DataFrame) -> DataFrame:
        g = F.when(F.col("on").isNull(), F.col("far")).otherwise(F.col("far") + F.col("generation"))
        return rows.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(g).alias("have"), F.max(g).alias("g")).where("n = have").select("id", (F.col("g") + 1).alias("generation"))

    frontier = materialise(ready(up.withColumn("generation", F.lit(None).cast("long"))), "generation")
    known = _Growing("generation", frontier)
    while n := frontier.count():
        touched = up.join(_beside(frontier, n), up.on == frontier.id).select("child").distinct()
        rows = up.join(_beside(touched), "child", "left_semi")
        frontier = materialise(ready(rows.join(_beside(known.all()), F.col("on") == F.col("id"), "left").select("child", "on", "far", "generation")), "generation")
        known.add(frontier)
    after = behind.join(onto(known.all()), F.col("to") == F.col("at")).select("id", (F.col("far") + F.col("at_generation")).alias("generation"))
    return settled.unionAll(known.all()).unionAll(after)


def tree_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, oid, change): blobs that ``new`` (path, oid, kind) adds or modifies against ``old``; equal ids and deletions give nothing."""
    blob = ("file", "executable", "symlink")
    n, o = new.alias("n"), old.alias("o")
    both = n.join(o, F.col("n.path") == F.col("o.path"), "left").where(F.col("n.kind").isin(*blob))
    change = F.when(F.col("o.oid").isNull() | ~F.col("o.kind").isin(*blob), "Add").when(F.col("n.oid") != F.col("o.oid"), "Modify")
    return both.select(F.col("n.path").alias("path"), F.col("n.oid").alias("oid"), change.alias("change")).where("change is not null")


def tree_order(name: Column, kind: Column) -> Column:
    """What entries of a tree are sorted by: a folder's name counts as if it ended in a slash."""
    return F.concat(name, F.when(kind == "tree", "/").otherwise(""))


BLOBS = ("file", "executable", "symlink")


def tree_changes(pairs: DataFrame, entries: DataFrame, max_depth: int = 256) -> DataFrame:
    """(commit_id, parent_idx, path, oid, mode, change) of blobs that trees add or modify against a parent's.

    ``pairs`` has (commit_id, parent_idx, new, old): tree ids, ``old`` null for the empty tree;
    ``entries`` (tree, name, oid, kind, mode). Subtrees with equal ids are never opened;
    deletions, gitlinks and unknown modes give nothing.
    """
    level, out = pairs, None
    level = level.withColumn("prefix", F.lit("")).where("old is null or old <> new")
    was = entries.select(F.col("tree").alias("old"), "name", F.col("oid").alias("old_oid"), F.col("kind").alias("old_kind"))
    for _ in range(max_depth):
        own = level.join(entries, level.new == entries.tree).select("commit_id", "parent_idx", "old", "prefix", "name", "oid", "kind", "mode")
        both = own.join(was, ["old", "name"], "left").where("(old_oid is null or old_oid <> oid) and kind in ('file', 'executable', 'symlink', 'tree')")
        found = materialise(both.select("commit_id", "parent_idx", F.concat("prefix", "name").alias("path"), "oid", "kind", "mode", "old_oid", "old_kind"), "changes")
        modified = F.coalesce(F.col("old_kind").isin(*BLOBS), F.lit(False))
        blobs = found.where(F.col("kind").isin(*BLOBS)).select("commit_id", "parent_idx", "path", "oid", "mode", F.when(modified, "Modify").otherwise("Add").alias("change"))
        out = blobs if out is None else out.unionAll(blobs)
        level = found.where("kind = 'tree'").select("commit_id", "parent_idx", F.col("oid").alias("new"), F.when(F.col("old_kind") == "tree", F.col("old_oid")).alias("old"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return out
    raise ValueError(f"trees deeper than {max_depth}")


def candidates(commits: DataFrame, graph: DataFrame, entries: DataFrame, merge_mode: str = "all_parents") -> DataFrame:
    """Changes of ``commits`` (id) against their parents; ``graph`` (id, tree, parents) has all known commits.

    ``all_parents`` gives one diff for each parent, ``first_parent`` the first one alone. A commit
    without parents, or whose parent isn't known, is compared with the empty tree.
    """
    own = graph.join(commits.select("id"), "id", "left_semi")
    each = own.select(F.col("id").alias("commit_id"), F.col("tree").alias("new"), F.posexplode_outer("parents").alias("at", "parent"))
    if merge_mode == "first_parent":
        each = each.where("at is null or at = 0")
    old = graph.select(F.col("id").alias("parent"), F.col("tree").alias("old"))
    pairs = each.join(old, "parent", "left").select("commit_id", F.coalesce("at", F.lit(0)).alias("parent_idx"), "new", "old")
    return tree_changes(materialise(pairs, "pairs"), entries)


def flatten_trees(roots: DataFrame, entries: DataFrame, max_depth: int = 256) -> DataFrame:
    """(root, path, oid, kind) of every entry below ``roots`` (root); ``entries`` has (tree, name, oid, kind). Gitlinks and unknown modes are left out."""
    level = roots.select("root", F.col("root").alias("tree"), F.lit("").alias("prefix"))
    out = None
    for _ in range(max_depth):
        found = materialise(level.join(entries, "tree").select("root", F.concat("prefix", "name").alias("path"), "oid", "kind"), "tree")
        if found.isEmpty():
            return found if out is None else out
        own = found.where(F.col("kind").isin("file", "executable", "symlink"))
        out = own if out is None else out.unionAll(own)
        level = found.where("kind = 'tree'").select("root", F.col("oid").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"))
    raise ValueError(f"trees deeper than {max_depth}")


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "oid") -> DataFrame:
    return candidates.join(seen.select(key), key, "left_anti")


def first_introduction(appearances: DataFrame) -> DataFrame:
    """(oid, topo, path): each blob's first appearance by topological place, then path."""
    return appearances.groupBy("oid").agg(F.min(F.struct("topo", "path")).alias("m")).select("oid", "m.topo", "m.path")
