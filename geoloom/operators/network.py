"""Road networks: shared nodes, pieces between them, intersections, tag hand-down from relations,
chains of pieces and components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_shuffle, dealt, hot_keys, join_hot, table


def shared_nodes(vertices: DataFrame, least: int = 2) -> DataFrame:
    """node, ways: nodes of vertices (way, idx, node) that at least so many ways touch."""
    return vertices.groupBy("node").agg(F.count_distinct("way").alias("ways")).where(F.col("ways") >= least)


def split_ways(vertices: DataFrame, parts: int | None = None) -> DataFrame:
    """Vertices with their piece; a way is cut at its inner shared nodes, whose vertex is in both
    pieces: rows (way, piece, pos, node, idx and further columns).  parts: in how many nodes and ways are dealt, for vertices of any
    number; a node is shared if its least and greatest way differ, so neither nodes nor ways are sorted more than once."""
    of_node, in_way = Window.partitionBy("node"), Window.partitionBy("way").orderBy("idx")
    whole, before = in_way.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), in_way.rowsBetween(Window.unboundedPreceding, -1)
    v = dealt(vertices, parts, "node").withColumn("_cut", F.col("node").isNotNull() & (F.min("way").over(of_node) != F.max("way").over(of_node)))
    v = dealt(v, parts, "way").withColumn("_last", F.max("idx").over(whole)).withColumn("_first", F.min("idx").over(whole)).withColumn("_row", F.row_number().over(in_way) - 1)
    v = v.withColumn("_inner", F.when(F.col("_cut") & (F.col("idx") > F.col("_first")) & (F.col("idx") < F.col("_last")), 1).otherwise(0))
    # a piece's rows are counted from the last cut before; a cut is the first row of the next piece as well
    v = v.withColumn("piece", F.coalesce(F.sum("_inner").over(before), F.lit(0)).cast("int")).withColumn("pos", F.col("_row") - F.coalesce(F.max(F.when(F.col("_inner") == 1, F.col("_row"))).over(before), F.lit(0)))
    own, following = F.struct("piece", "pos"), F.struct((F.col("piece") + 1).alias("piece"), F.lit(0).alias("pos"))
    v = v.withColumn("_at", F.explode(F.when(F.col("_inner") == 1, F.array(own, following)).otherwise(F.array(own))))
    return v.withColumn("piece", F.col("_at.piece")).withColumn("pos", F.col("_at.pos")).drop("_cut", "_first", "_last", "_inner", "_row", "_at")


def segments(pieces: DataFrame) -> DataFrame:
    """way, piece, start and end node and number of points of split_ways rows; one-point pieces go."""
    out = pieces.groupBy("way", "piece").agg(F.min_by("node", "idx").alias("start"), F.max_by("node", "idx").alias("end"), F.count("*").alias("points"))
    return out.where("points > 1")


def intersections(segs: DataFrame, parts: int | None = None) -> DataFrame:
    """node, entries, ways of nodes where at least two segment ends meet; a loop counts twice.  parts: in how many nodes are dealt."""
    ends = dealt(segs.select("way", F.explode(F.array("start", "end")).alias("node")), parts, "node")
    return ends.groupBy("node").agg(F.count("*").alias("entries"), F.count_distinct("way").alias("ways")).where("entries > 1")


def handed_down(ways: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """ways (id, one column a key) with missing values taken from members (rel, ord, ref, one column a
    key): the relation that comes first and has one."""
    first = members.groupBy("ref").agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("ord"))).alias(f"_{k}") for k in keys])
    out = ways.join(first, ways["id"] == first["ref"], "left")
    return out.select("id", *[F.coalesce(k, f"_{k}").alias(k) for k in keys])


def unconsumed(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways that no relation uses as an outer ring."""
    used = members.where("role = 'outer'").select(F.col("ref").alias("id")).distinct()
    return ways.join(used, "id", "left_anti")


def chain_nodes(segs: DataFrame, parts: int | None = None) -> DataFrame:
    """node of the places where exactly two segments of one style (segs has `style`) join.  parts: in how many nodes are dealt."""
    ends = dealt(segs.select("style", "way", "piece", F.explode(F.array("start", "end")).alias("node")), parts, "node")
    # of two rows' values: whether they differ, one missing value from another as well
    differ = lambda c: (F.min(c) != F.max(c)) | (F.count(c) == 1)
    got = ends.groupBy("node").agg(F.count("*").alias("n"), (differ("way") | differ("piece")).alias("two"), (F.min("style") == F.max("style")).alias("alike"))
    return got.where("n = 2 and two and alike").select("node")


def merged_segments(segs: DataFrame, write) -> DataFrame:
    """way, piece, chain_way, chain_piece, pos, reversed of segments (way, piece, start, end, style): the chains that they form
    over places where exactly two segments of one style meet, named by their first segment (by way and piece), which keeps
    its direction; pos counts along the chain, and a segment that is passed from its end to its start is reversed.

    A segment is passed in two directions; each such state has at most one next state.  Ends and distances are found by doubling
    the pointers, in rounds by the logarithm of a chain's length, so chains of any length are no one task's.
    A ring has no end: it is cut before its first segment, and only its states are followed again.  All joins are by shuffle: sides of any
    size would pass the driver, if Spark took their compressed files for small.  `write` as in components."""
    name = F.struct("way", "piece")
    joint = chain_nodes(segs).withColumn("_joint", F.lit(True))
    both = segs.select(name.alias("seg"), F.lit(False).alias("back"), F.col("start").alias("enter"), F.col("end").alias("leave"))
    both = both.union(segs.select(name.alias("seg"), F.lit(True).alias("back"), F.col("end").alias("enter"), F.col("start").alias("leave")))
    both = write(both)
    ahead = both.select(F.col("seg").alias("to_seg"), F.col("back").alias("to_back"), F.col("enter").alias("leave"))
    step = both.join(joint.withColumnRenamed("node", "leave").hint("merge"), "leave").join(ahead.hint("merge"), "leave").where("seg != to_seg").select("seg", "back", "to_seg", "to_back")
    step = write(both.select("seg", "back").join(step.hint("merge"), ["seg", "back"], "left"))
    ends, ring = _followed(step, write)
    if ring is not None:
        # the least state of a ring is found by doubling as well; the step into it is cut
        goes_on = F.struct(F.col("to_seg").alias("seg"), F.col("to_back").alias("back")) != F.col("least")
        cut = ring.join(step.hint("merge"), ["seg", "back"])
        opened = write(cut.select("seg", "back", F.when(goes_on, F.col("to_seg")).alias("to_seg"), F.when(goes_on, F.col("to_back")).alias("to_back")))
        ends = ends.union(_followed(opened, write)[0])
    # of a chain's two passes the one in which its first segment isn't reversed
    first = ends.groupBy("end").agg(F.min(F.struct("seg", "back")).alias("first"), F.max("hops").alias("far"))
    kept = ends.join(first.where("not first.back").hint("merge"), "end")
    return kept.select("seg.way", "seg.piece", F.col("first.seg.way").alias("chain_way"), F.col("first.seg.piece").alias("chain_piece"), (F.col("far") - F.col("hops")).cast("int").alias("pos"), F.col("back").alias("reversed"))


def _followed(step: DataFrame, write, most: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """seg, back, end (the last state that is reached) and hops (steps to it) of the states that reach one, and seg, back, least (of the ring's
    states) of those that go round and round, None if none do.  step: seg, back, to_seg, to_back."""
    state = lambda a, b: F.struct(F.col(a).alias("seg"), F.col(b).alias("back"))
    to = F.when(F.col("to_seg").isNotNull(), state("to_seg", "to_back"))
    now = write(step.select(state("seg", "back").alias("at"), to.alias("to"), F.coalesce(to, state("seg", "back")).alias("end"), F.when(F.col("to_seg").isNotNull(), 1).otherwise(0).cast("long").alias("hops"), state("seg", "back").alias("least")))
    ended, open_ = now.where("to is null"), now.where("to is not null")
    left = open_.count()
    for _ in range(most):
        if not left:
            break
        ahead = ended.union(open_).select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("end").alias("end2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"))
        # a state is the next one of one other at most, so no `to` gathers rows
        joined = open_.join(ahead.hint("merge"), "to", "left")
        moved = write(joined.select("at", F.col("to2").alias("to"), F.coalesce("end2", "end").alias("end"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("least2") < F.col("least")).alias("fell")))
        seen = moved.agg(F.count_if(F.col("to").isNull()).alias("arrived"), F.count_if(F.col("to").isNotNull() & F.col("fell")).alias("fell")).first()
        ended, open_, left = ended.union(moved.where("to is null").drop("fell")), moved.where("to is not null").drop("fell"), left - seen["arrived"]
        # of a chain some state arrives in every round; where none does and no least falls, only rings are left and each state knows the least of its ring
        if not seen["arrived"] and not seen["fell"]:
            break
    return ended.select("at.seg", "at.back", "end", "hops"), open_.select("at.seg", "at.back", "least") if left else None


#: Links, after contraction, that one task finishes.
FEW_LINKS = 100_000


def _joined(links: DataFrame) -> DataFrame:
    """node, to: the least node of the component, for at most FEW_LINKS links (a, b), in one task."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        first: dict = {}

        def find(x):
            while first[x] != x:
                first[x] = x = first[first[x]]
            return x

        own = None
        for batch in batches:
            own = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                first.setdefault(a, a)
                first.setdefault(b, b)
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(first), own), pa.array([find(x) for x in first], own)], names=["node", "to"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def components(links: DataFrame, write=None) -> DataFrame:
    """node, label: the least node of the component, for the nodes of links (a, b).

    Links are contracted: each round a node moves to the first of itself and its neighbours by a hash that the round draws, and
    only links between unlike nodes go on, so a round works on what is unfinished, and stars, chains and meshes
    alike shrink by a share a round until one task can finish the FEW_LINKS that are left.  Then the moves are followed back from the last round to the first, each table
    once.  Hubs, and nodes to which many have moved, are joined where their rows lie (`join_hot`).  `write` stores a round's table
    and returns it read back."""
    keep = write or table
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    alone = both.where("a = b").select("a")
    nodes = both.select(F.col("a").alias("node")).distinct()
    moves, ends = [], keep(both.where("a != b"))
    while left := ends.count():
        if left <= FEW_LINKS:
            moves.append(keep(_joined(ends)))
            break
        draw = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("node"))
        degrees = ends.groupBy("a").agg(F.min(draw("b")).alias("near"), F.count("*").alias("n"))
        move = keep(degrees.select(F.col("a").alias("node"), F.least("near", draw("a"))["node"].alias("to"), "n"))
        hubs = hot_keys(move, ["node"], left)
        to = move.select("node", "to")
        moves.append(to)
        to = by_shuffle(to, move.count())
        first = join_hot(ends.withColumnRenamed("a", "node"), to, ["node"], hubs).select(F.col("to").alias("a"), F.col("b").alias("node"))
        ends = keep(join_hot(first, to, ["node"], hubs).select("a", F.col("to").alias("b")).where("a != b").distinct())
    if not moves:
        return nodes.select("node", F.col("node").alias("label"))
    root = moves[-1].select("node", F.col("to").alias("root"))
    for to in moves[-2::-1]:
        size = to.count()
        hot = hot_keys(to.groupBy("to").agg(F.count("*").alias("n")), ["to"], size)
        root = keep(join_hot(to, by_shuffle(root.select(F.col("node").alias("to"), "root"), size), ["to"], hot, "left").select("node", F.coalesce("root", "to").alias("root")))
    least = root.groupBy("root").agg(F.min("node").alias("label"), F.count("*").alias("n"))
    size = root.count()
    hot = hot_keys(least, ["root"], size)
    return join_hot(root, by_shuffle(least.drop("n"), size), ["root"], hot).select("node", "label").union(alone.join(by_shuffle(moves[0], size), alone["a"] == moves[0]["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("label")))


def spread_labels(nodes: DataFrame, links: DataFrame, write=None) -> DataFrame:
    """node, label: the least node of its component for every one of nodes; links (a, b) join nodes."""
    own = (write or table)(components(links, write))
    return nodes.select("node").join(by_shuffle(own, own.count()), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def overlapping(rects: DataFrame, size: float) -> DataFrame:
    """Pairs (coarse, fine) of rectangles (id, level, x0, y0, x1, y1) that overlap, the first of a
    strictly greater level.  Joined by the squares of `size` they touch; each pair once."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int")))
    spread = rects.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    a = spread.select("cx", "cy", *[F.col(c).alias(f"a_{c}") for c in ("id", "level", "x0", "y0", "x1", "y1")])
    b = spread.select("cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("id", "level", "x0", "y0", "x1", "y1")])
    meet = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    # a pair is reported by the square that holds the overlap's lower corner
    home = (F.floor(F.greatest("a_x0", "b_x0") / size) == F.col("cx")) & (F.floor(F.greatest("a_y0", "b_y0") / size) == F.col("cy"))
    return a.join(b, ["cx", "cy"]).where((F.col("a_level") > F.col("b_level")) & meet & home).select(F.col("a_id").alias("coarse"), F.col("b_id").alias("fine"))


def nearest(points: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """id, target, d2: for points (id, x, y) the nearest of targets (target, tx, ty) within reach, ties to
    the smaller target.

    Of targets at one place the smallest counts.  Points look as far as targets lie apart on average, and those that have found none four times
    as far, again and again up to reach, so that dense targets don't all meet all points within reach."""
    t = table(targets.where("tx is not null and ty is not null").groupBy("tx", "ty").agg(F.min("target").alias("target")), "places")
    size = t.agg(F.count("*").alias("n"), ((F.max("tx") - F.min("tx")) * (F.max("ty") - F.min("ty"))).alias("area")).first()
    side = (size["area"] / size["n"]) ** 0.5 if size["n"] else 0.0
    t = by_shuffle(t, size["n"] * 9)  # each is in nine squares
    if not 0.0 < side * 2 < reach:
        return _nearest(points, t, reach)
    left, found = table(points.select("id", "x", "y"), "left"), []
    while side < reach:
        found.append(table(_nearest(left, t, side), "nearest"))
        left, side = table(left.join(by_shuffle(found[-1].select("id"), found[-1].count()), "id", "left_anti"), "left"), side * 4
        if not left.limit(1).count():
            break
    return reduce(DataFrame.union, [*found, _nearest(left, t, reach)])


def _nearest(points: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """As `nearest`, in one step by squares of `reach`."""
    p = points.select("*", F.floor(F.col("x") / reach).cast("long").alias("cx"), F.floor(F.col("y") / reach).cast("long").alias("cy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    t = targets.select("target", "tx", "ty", around)
    t = t.select("target", "tx", "ty", (F.floor(F.col("tx") / reach) + F.col("s.i")).cast("long").alias("cx"), (F.floor(F.col("ty") / reach) + F.col("s.j")).cast("long").alias("cy"))
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    got = p.join(t, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    return got.groupBy("id").agg(F.min(F.struct("d2", "target")).alias("m")).select("id", "m.target", "m.d2")


def nearest_of_all(points: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """id, target, d2 as in `nearest`, however far the nearest target is: points that have none within reach look four times as far, again and
    again.  No rows if there are no targets."""
    left, found = table(points.select("id", "x", "y"), "left"), []
    while targets.limit(1).count():
        found.append(table(nearest(left, targets, reach), "nearest"))
        left, reach = table(left.join(by_shuffle(found[-1].select("id"), found[-1].count()), "id", "left_anti"), "left"), reach * 4
        if not left.limit(1).count():
            break
    whole = found[0] if found else nearest(left, targets, reach)
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def finest_covering(tiles: DataFrame, write=None) -> DataFrame:
    """ids of tiles (id, parent, selected) that stay: those that are the nearest selected tile, itself or above, of a
    tile without children.  A tile that is selected, or whose parent isn't known, ends its way; others point to their parent.
    Pointers are doubled, in rounds by the logarithm of the depth, and a tile whose way has ended takes no part
    in the rounds that follow; a tile to which many point is joined where their rows lie.  Tiles that are their own ancestors are no one's way's
    end.  `write` as in components."""
    keep = write or table
    tiles = keep(tiles.select("id", "parent", F.coalesce("selected", F.lit(False)).alias("selected")))
    size = tiles.count()
    children = tiles.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    leaves = tiles.select("id").join(children, "id", "left_anti")
    often = hot_keys(children.withColumnRenamed("id", "parent"), ["parent"], size)
    known = tiles.select(F.col("id").alias("parent"), (F.col("selected") | F.col("parent").isNull()).alias("_ends"))
    up = join_hot(tiles.where("not selected and parent is not null"), known, ["parent"], often, "left")
    # a parent that isn't listed ends the way here
    start = tiles.where("selected or parent is null").select("id", F.col("id").alias("to"), F.lit(True).alias("ended"))
    now = keep(start.union(up.select("id", F.when(F.col("_ends").isNull(), F.col("id")).otherwise(F.col("parent")).alias("to"), F.coalesce("_ends", F.lit(True)).alias("ended"))))
    ended, open_, way = now.where("ended"), now.where("not ended"), 1
    while way <= size and open_.limit(1).count():
        often = hot_keys(open_.groupBy("to").agg(F.count("*").alias("n")), ["to"], open_.count())
        ahead = ended.union(open_).select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("ended").alias("_done"))
        moved = keep(join_hot(open_.select("id", "to"), ahead, ["to"], often).select("id", F.col("far").alias("to"), F.col("_done").alias("ended")))
        ended, open_, way = ended.union(moved.where("ended")), moved.where("not ended"), way * 2
    picks = leaves.join(ended, "id").select(F.col("to").alias("id")).distinct()
    return picks.join(tiles.where("selected").select("id"), "id", "left_semi")
