"""Problem 4: parent-child rows to full hierarchies, of any depth, with loops told apart.

Method: a deterministic hash makes one node in RATE a splitter. Every node walks to its next splitter (or to the top of
its tree); the reduced graph of splitters is solved by pointer doubling; walks and reduced paths are joined to the exact
path of every node. Loops without a splitter are found by doubling over the nodes whose walks don't end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import Workspace

RATE = 3
#: Steps of a walk in one job, and walks' length after which loops without a splitter are looked for.
STEPS, PATIENCE = 4, 8

KEY = ["g", "node"]


def stepped(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Walkers (g, node, cur, up) one step on: cur's parent joins `up`, the ancestors so far, nearest first."""
    here = nodes.select("g", F.col("node").alias("cur"), F.col("parent").alias("next"), "parent_kind", "parent_splitter")
    moving = active.where("not done").join(here, ["g", "cur"])
    moved = moving.select("g", "node", F.col("next").alias("cur"), F.concat("up", F.array("next")).alias("up"), stops().alias("done"))
    return moved.unionByName(active.where("done"))


def stops() -> Column:
    return F.col("parent_splitter") | (F.col("parent_kind") != "inner")


def doubled(now: DataFrame) -> DataFrame:
    beyond = now.select("g", F.col("node").alias("ptr"), F.col("ptr").alias("far"))
    return now.join(beyond, ["g", "ptr"]).select("g", "node", F.col("far").alias("ptr"))


def endless(pointers: DataFrame, work: Workspace) -> DataFrame:
    """Of a graph (g, node, ptr; ptr null where the way ends): g, node, on_loop of the nodes whose way never ends.
    Doubling stops once the jump is longer than any way left could be; the jump then lands on loops only."""
    now, left = work.write_counted(pointers.where("ptr is not null"), F.lit(True))
    jump, goal = 1, left + 1
    while left and jump < goal:
        last = now
        now, left = work.write_counted(doubled(doubled(now)), F.lit(True))
        work.drop(last)
        jump *= 4
        goal = min(goal, jump + left)
    loops = now.select("g", F.col("ptr").alias("node")).distinct().withColumn("on_loop", F.lit(True))
    return now.select(*KEY).join(loops, KEY, "left").select(*KEY, F.coalesce("on_loop", F.lit(False)).alias("on_loop"))


def walks(nodes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(walkers that came to a splitter or a top, nodes caught in or under loops without a splitter)."""
    now = nodes.select("g", "node", F.when(F.col("kind") == "inner", F.col("parent")).otherwise(F.col("node")).alias("cur"), F.when(F.col("kind") == "inner", F.array("parent")).otherwise(F.array().cast("array<string>")).alias("up"), ((F.col("kind") != "inner") | stops()).alias("done"))
    caught = None
    finished: list[DataFrame] = []
    (now, left), walked = work.write_counted(now, ~F.col("done")), 1
    while True:
        finished.append(now.where("done"))
        active = now.where("not done")
        if not left:
            break
        if walked >= PATIENCE and caught is None:
            inside = active.select("g", "node").join(nodes.select("g", "node", "parent"), KEY)
            # a parent whose own walk ended leads out
            among = inside.select("g", F.col("node").alias("parent"), F.lit(True).alias("known"))
            pointers = inside.join(among, ["g", "parent"], "left").select("g", "node", F.when(F.col("known"), F.col("parent")).alias("ptr"))
            caught = work.write(endless(pointers, work))
            active = active.join(caught, KEY, "left_anti")
        for _ in range(STEPS):
            active = stepped(active, nodes)
        walked += STEPS
        now, left = work.write_counted(active, ~F.col("done"))
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part)
    if caught is None:
        caught = nodes.select(*KEY).withColumn("on_loop", F.lit(False)).where("false")
    return work.write(whole), caught


def hierarchy(df: DataFrame, scope: list[str], node: str, parent: str, order: str | None = None, rate: int = RATE) -> DataFrame:
    """One row per (scope, node): scope columns, node_id, parent_id, root_id, depth, ancestors (array, nearest first),
    path (root/.../node) and status.

    status is `ok` (the way up ends at a node without parent, whose depth is 1), `lost_parent` (the parent is no node of
    the scope), `below_lost`, `cycle` (the node reaches itself) or `below_cycle`. For lost ways, root and depth count
    from the topmost node found; in and under cycles, root, depth, ancestors and path are null. Rows with a null node
    are left out. Repeated rows are one node; of rows with different parents the last by `order` holds (ties and no
    order: the greatest parent). Columns not named are ignored."""
    work = Workspace(df.sparkSession, "hierarchy")
    g = F.struct(*[F.col(c).cast("string").alias(f"s{k}") for k, c in enumerate(scope)])
    rows = df.where(F.col(node).isNotNull()).select(g.alias("g"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"), (F.col(order) if order else F.lit(0)).alias("o"))
    rows = rows.groupBy(*KEY).agg(F.max(F.struct("o", "parent")).alias("x")).select("g", "node", "x.parent")
    rows = work.write(rows.withColumn("splitter", F.pmod(F.xxhash64("g", "node"), F.lit(rate)) == 0))
    known = rows.select("g", F.col("node").alias("parent"), F.lit(True).alias("known"))
    kinds = rows.join(known, ["g", "parent"], "left").select(*KEY, "parent", "splitter", F.when(F.col("parent").isNull(), "root").when(F.col("known"), "inner").otherwise("lost").alias("kind"))
    above = kinds.select("g", F.col("node").alias("parent"), F.col("kind").alias("parent_kind"), F.col("splitter").alias("parent_splitter"))
    nodes = work.write(kinds.join(above, ["g", "parent"], "left"))
    walked, caught = walks(nodes, work)

    # the reduced graph: splitters that stop at a splitter; the others' ways end
    kind_of = nodes.select(*KEY, "kind", "splitter")
    splitters = walked.join(kind_of.where("splitter").select(*KEY), KEY).join(kind_of.select("g", F.col("node").alias("cur"), F.col("kind").alias("cur_kind")), ["g", "cur"])
    splitters = work.write(splitters.select("g", "node", "up", "cur", F.when(F.col("cur_kind") == "inner", F.col("cur")).alias("ptr")))
    # a splitter that walks into a loop without splitters has no row in `walked`; it points to itself, so that ways to
    # it never end either
    strays = caught.join(kind_of.where("splitter").select(*KEY), KEY, "left_semi").select("g", "node", F.col("node").alias("ptr"))
    dead = endless(splitters.select("g", "node", "ptr").unionByName(strays), work).join(caught.select(*KEY), KEY, "left_anti")
    looped = work.write(dead.unionByName(caught))
    # exact ancestors of the splitters on good ways, by doubling with the paths
    good = splitters.join(looped, KEY, "left_anti").select("g", "node", "ptr", "up")
    rest, ended, left = work.write_parted(good, F.col("ptr").isNotNull())
    solved = ended.select("g", "node", "up")
    while left:
        ahead = rest.select("g", F.col("node").alias("ptr"), F.col("ptr").alias("far"), F.col("up").alias("more"))
        ended = solved.select("g", F.col("node").alias("ptr"), F.col("up").alias("tail"))
        met = rest.join(ended, ["g", "ptr"], "left").join(ahead, ["g", "ptr"], "left")
        rest, ended, left = work.write_parted(met.select("g", "node", F.when(F.col("tail").isNull(), F.col("far")).alias("ptr"), F.concat("up", F.coalesce("tail", "more")).alias("up")), F.col("ptr").isNotNull())
        solved = solved.unionByName(ended.select("g", "node", "up"))

    # every node: its walk, then its splitter's ancestors
    tails = solved.select("g", F.col("node").alias("cur"), F.col("up").alias("tail"))
    bad = looped.select("g", F.col("node").alias("cur"), F.lit(True).alias("to_loop"))
    full = walked.join(kind_of, KEY).join(tails, ["g", "cur"], "left").join(bad, ["g", "cur"], "left")
    full = full.select(*KEY, "kind", F.coalesce("to_loop", F.lit(False)).alias("to_loop"), F.when(F.col("node") == F.col("cur"), F.col("up")).otherwise(F.concat("up", F.coalesce("tail", F.array().cast("array<string>")))).alias("up"))
    # nodes between two splitters of a loop are on it
    between = splitters.join(looped.where("on_loop").select(*KEY), KEY).select("g", F.explode("up").alias("node"))
    on_loop = between.unionByName(looped.where("on_loop").select(*KEY)).distinct().withColumn("on_loop", F.lit(True))
    strayed = caught.select(*KEY, F.lit("inner").alias("kind"), F.lit(True).alias("to_loop"), F.lit(None).cast("array<string>").alias("up"))
    every = full.unionByName(strayed.join(full.select(*KEY), KEY, "left_anti"))
    every = every.join(on_loop, KEY, "left").join(nodes.select(*KEY, "parent"), KEY)
    root = F.when(F.size("up") > 0, F.element_at("up", -1)).otherwise(F.col("node"))
    tops = kind_of.where("kind = 'lost'").select("g", F.col("node").alias("root"), F.lit(True).alias("lost_top"))
    loop = F.col("to_loop") | F.coalesce("on_loop", F.lit(False))
    told = every.withColumn("loop", loop).withColumn("root", F.when(~F.col("loop"), root)).join(tops, ["g", "root"], "left")
    status = F.when(F.col("on_loop"), "cycle").when(F.col("loop"), "below_cycle").when(F.col("kind") == "lost", "lost_parent").when(F.col("lost_top"), "below_lost").otherwise("ok")
    up = F.when(~F.col("loop"), F.col("up"))
    return told.select(
        *[F.col(f"g.s{k}").alias(c) for k, c in enumerate(scope)],
        F.col("node").alias("node_id"),
        F.col("parent").alias("parent_id"),
        F.col("root").alias("root_id"),
        F.when(~F.col("loop"), F.size("up") + 1).alias("depth"),
        up.alias("ancestors"),
        F.when(~F.col("loop"), F.array_join(F.concat(F.reverse("up"), F.array("node")), "/")).alias("path"),
        status.alias("status"),
    )


def descendants(tree: DataFrame, scope: list[str]) -> DataFrame:
    """Every pair of a node and a node under it, with their distance; nodes in or under loops have none."""
    return tree.where("ancestors is not null").select(*scope, F.posexplode("ancestors").alias("k", "node_id"), F.col("node_id").alias("descendant_id")).select(*scope, "node_id", "descendant_id", (F.col("k") + 1).alias("distance"))


def descendant_counts(tree: DataFrame, scope: list[str]) -> DataFrame:
    """n_descendants of every node that has any."""
    return descendants(tree, scope).groupBy(*scope, "node_id").agg(F.count("*").alias("n_descendants"))
