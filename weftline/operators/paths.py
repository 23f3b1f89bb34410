"""Exact weighted path counts, cycles, shared DAGs and class hierarchies, on DataFrames at every size.

Path counts have no upper bound: they are columns of limbs (``functions/limbs.py``), multiplied and added with
built-in functions.  A node passes its count on once all its links have arrived: each round is one join with
the nodes that have become ready and one sum, and is written to the shared folder.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions import limbs
from weftline.functions.scalars import log10_digits
from weftline.operators.quality import ContractError
from weftline.session import checkpoint_dir, discard, written

#: Longs of a round's ready nodes up to which they are broadcast; they are counted before.
BROADCAST_LONGS = 4_000_000


def _ends(links: DataFrame, *within: str) -> DataFrame:
    """``node, n_in, n_out``: all ends of links and their links in and out, in one sum of both ends."""
    at = lambda end, *counts: links.select(*within, F.col(end).alias("node"), *[F.lit(n).cast("bigint").alias(c) for c, n in zip(("n_in", "n_out"), counts)])
    return at("dst_id", 1, 0).unionByName(at("src_id", 0, 1)).groupBy(*within, "node").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


# --- propagation


@dataclass
class Rounds:
    """Rounds of a propagation: one folder each of ``node, need, last, arrived, limbs, ready, round``.

    Nodes and links may have columns *within*, such as a graph of many; links stay within equal ones.
    """

    links: DataFrame  # *within, src_id, dst_id, multiplicity, need: the links that arrive at the target, last: none leaves it
    path: str
    schema: str
    within: tuple[str, ...]
    add: int  # to a count, as it is passed on
    left: int  # links that have not been passed
    round: int = -1
    ready: int = 0
    waiting: int = 0
    held: int = 0  # links that have arrived at waiting nodes
    width: int = 1  # the most limbs so far

    def __post_init__(self) -> None:
        # Expressions that all rounds share.
        self.key = [*self.within, "node"]
        self.passed = [*map(F.col, self.within), F.col("dst_id").alias("node"), F.col("need"), F.col("last"), F.lit(1).cast("bigint").alias("arrived"), limbs.times(F.col("limbs"), F.col("multiplicity"), self.add).alias("limbs")]
        waits = F.when(~F.col("ready"), F.col("arrived"))
        self.seen = [F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("waiting"), F.sum("arrived").alias("arrived"), F.sum(waits).alias("held"), F.max(F.size("limbs")).alias("width")]
        self.sums = limbs.Sums(self.key, need=F.max("need"), last=F.bool_and("last"), arrived=F.sum("arrived"))

    def sent(self, ready: DataFrame) -> DataFrame:
        """What ready nodes pass on: ``multiplicity * (add + count)`` along each link."""
        return self.links.join(ready.select(*self.within, F.col("node").alias("src_id"), "limbs"), [*self.within, "src_id"]).select(*self.passed)

    def arrived(self, rows: DataFrame) -> DataFrame:
        """What is there of each node; a product has up to three limbs more than its factor."""
        return self.sums(rows, self.width + 3)

    def write(self, rows: DataFrame) -> None:
        """The next round: what has arrived at each node that is not done."""
        seen = Observation()
        told = rows.select(*self.key, "need", "last", "arrived", "limbs", (F.col("arrived") == F.col("need")).alias("ready")).observe(seen, *self.seen)
        self.round += 1
        told.write.parquet(f"{self.path}/round={self.round}")
        got = seen.get
        self.ready, self.waiting, self.width = got["ready"], got["waiting"], max(self.width, got["width"] or 1)
        self.left -= (got["arrived"] or 0) - self.held
        self.held = got["held"] or 0

    def read(self, k: int) -> DataFrame:
        return self.links.sparkSession.read.schema(self.schema).parquet(f"{self.path}/round={k}")

    def waits(self) -> DataFrame:
        """The last round's nodes that are not ready."""
        return self.read(self.round).where(~F.col("ready")).select(*self.key, "need", "last", "arrived", "limbs")

    def done(self) -> DataFrame:
        """``node, limbs, last, round`` of the nodes that became ready; a round is the longest way to a node."""
        kind = f"{self.schema}, round int"
        return self.links.sparkSession.read.schema(kind).parquet(self.path).where("ready").select(*self.key, "limbs", "last", "round")


def _start(links: DataFrame, ends: DataFrame, seed: int, add: int, *within: str) -> Rounds:
    """Links counted at their targets; the nodes without incoming links are ready with *seed*."""
    spark = links.sparkSession
    need = ends.where("n_in > 0").select(*within, F.col("node").alias("dst_id"), F.col("n_in").alias("need"), (F.col("n_out") == 0).alias("last"))
    # The side of the counts has a row for each target: a target of very many links is split by adaptive execution.
    links = written(links.join(need, [*within, "dst_id"]).select(*within, "src_id", "dst_id", "multiplicity", "need", "last"), "links")
    kinds = ", ".join([*[f"`{c}` {links.schema[c].dataType.simpleString()}" for c in within], f"node {links.schema['src_id'].dataType.simpleString()}"])
    rounds = Rounds(links, f"{checkpoint_dir(spark)}/weftline/rounds-{uuid.uuid4().hex}", f"{kinds}, need bigint, last boolean, arrived bigint, limbs array<bigint>, ready boolean", within, add, links.count())
    zero = F.lit(0).cast("bigint")
    rounds.write(ends.where("n_in = 0").select(*within, "node", zero.alias("need"), (F.col("n_out") == 0).alias("last"), zero.alias("arrived"), F.array(F.lit(seed).cast("bigint")).alias("limbs")))
    return rounds


def _propagate(rounds: Rounds) -> None:
    """Rounds until all links are passed or no node is ready any more.

    At every power of two the links whose sources are done are dropped, so that what the rounds read shrinks.
    """
    while rounds.ready and rounds.left:
        ready = rounds.read(rounds.round).where("ready")
        if rounds.round >= 8 and rounds.round & (rounds.round - 1) == 0:
            rounds.links, old = written(_open(rounds, rounds.done().where(F.col("round") < rounds.round)), "links"), rounds.links
            discard(ready.sparkSession, old)
        small = rounds.ready * (4 + rounds.width) <= BROADCAST_LONGS
        sent = rounds.sent(F.broadcast(ready) if small else ready)
        rounds.write(rounds.arrived(rounds.waits().unionByName(sent)))


def _open(rounds: Rounds, done: DataFrame) -> DataFrame:
    """The links whose source is not *done*."""
    return rounds.links.join(done.select(*rounds.within, F.col("node").alias("src_id")), [*rounds.within, "src_id"], "left_anti").select(*rounds.links.columns)


# --- cycles


def _push(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node's largest label among its own and those of the nodes with a link to it."""
    pushed = links.join(labels.withColumnRenamed("node", "src_id"), "src_id").select(F.col("dst_id").alias("node"), "colour")
    return labels.unionByName(pushed).groupBy("node").agg(F.max("colour").alias("colour"))


def _without(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links that touch none of *nodes*."""
    for end in ("src_id", "dst_id"):
        links = links.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return links.select("src_id", "dst_id")


def cyclic_nodes(links: DataFrame) -> DataFrame:
    """``node`` on a cycle, of ``src_id, dst_id``: by trimming, then colouring and walking back.

    Every node takes the largest label that reaches it.  In a colour, the nodes that reach the label's own
    node are one strong component.  Components leave with their links; the rest is trimmed and coloured anew.
    Trimming drops nodes without links in or out; links are written anew only where there are such nodes.
    Links are read from what was written first.  Nulls are no nodes; repeated links change nothing.
    """
    spark = links.sparkSession
    links = written(links.where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).select("src_id", "dst_id"), "core")
    found = links.where(F.col("src_id") == F.col("dst_id")).select(F.col("src_id").alias("node")).distinct()
    rest = links.where(F.col("src_id") != F.col("dst_id"))
    old: list[DataFrame] = []  # what *rest* is read from, where it is not the first
    while rest.head(1):
        ends = written(_ends(rest), "ends")
        idle = ends.where("n_in = 0 OR n_out = 0")
        if idle.head(1):
            rest = written(_without(rest, idle), "core")
            discard(spark, ends, *old)
            old = [rest]
            continue
        labels, moved = written(ends.select("node", F.col("node").alias("colour")), "colour"), True
        size = ends.count()
        discard(spark, ends)
        while moved:
            new = written(_push(rest, _push(rest, labels)), "colour")
            moved = new.join(labels.withColumnRenamed("colour", "old"), "node").where(F.col("colour") > F.col("old")).head(1)
            discard(spark, labels)
            labels = new
        of = lambda end: labels.select(F.col("node").alias(f"{end}_id"), F.col("colour").alias(f"{end}_colour"))
        same = written(rest.join(of("src"), "src_id").join(of("dst"), "dst_id").where(F.col("src_colour") == F.col("dst_colour")).select("src_id", "dst_id"), "same")
        # A frontier walks back; what it has reached is written once, round by round.
        reached = front = written(labels.where(F.col("node") == F.col("colour")).select("node"), "reached")
        while front.head(1):
            back = same.join(front.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi").select(F.col("src_id").alias("node")).distinct()
            front = written(back.join(reached, "node", "left_anti"), "reached")
            reached = reached.unionByName(front)
        reached = written(reached, "reached")
        groups = reached.join(labels, "node")
        members = groups.join(groups.groupBy("colour").agg(F.count("*").alias("n")).where(F.col("n") > 1), "colour").select("node")
        found = found.unionByName(written(members, "cyclic"))
        rest = rest.limit(0) if reached.count() == size else written(_without(rest, reached), "core")
        discard(spark, same, labels, *old)
        if not hasattr(rest, "written_path"):
            break
        old = [rest]
    return found.distinct()


# --- path counts


def incoming_paths(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node_id, in_paths, in_paths_log10, is_path_cycle_boundary`` for every node.

    A path counts with the product of its links' multiplicities.  Nodes on a cycle are boundaries:
    links out of them count their own multiplicity only, and links into them are not carried on.
    ``in_paths`` is a decimal string, 0 where nothing arrives; its log10 is null at 0.
    Needs unique node ids, one link for each pair, positive multiplicities and ends among the nodes;
    anything else raises ``ContractError``.  Other columns are ignored; without links all counts are 0.

    Each round's links with ready nodes join and are summed: as many rounds as the longest path has links.
    """
    ids = nodes.select("node_id")
    links = written(links.select("src_id", "dst_id", F.col("multiplicity").cast("bigint").alias("multiplicity")), "links")
    ends = written(_ends(links), "ends")
    bad = {
        "node ids that repeat": ids.groupBy("node_id").count().where("count > 1"),
        "multiplicities below one": links.where(F.col("multiplicity").isNull() | (F.col("multiplicity") < 1)),
        "links that repeat": links.groupBy("src_id", "dst_id").count().where("count > 1"),
        "ends that are no node": ends.join(ids.withColumnRenamed("node_id", "node"), "node", "left_anti"),
    }
    for what, rows in bad.items():
        if rows.head(1):
            raise ContractError(f"there are {what}")
    loops = links.where(F.col("src_id") == F.col("dst_id")).select(F.col("src_id").alias("node"))
    cyclic = None
    onward = links
    if loops.head(1):
        # A link to itself keeps no other link waiting.  Its node's links arrive, and pass nothing on.
        cyclic = written(loops, "cyclic")
        passes = F.when(F.col("boundary").isNull(), F.col("multiplicity")).otherwise(F.lit(0)).cast("bigint").alias("multiplicity")
        at_source = cyclic.select(F.col("node").alias("src_id"), F.lit(True).alias("boundary"))
        onward = links.where(F.col("src_id") != F.col("dst_id")).join(at_source, "src_id", "left").select("src_id", "dst_id", passes)
        own = cyclic.select("node", F.lit(1).cast("bigint").alias("own"))
        # An end that has a link to itself alone has none left, and waits for nothing.
        ends = ends.join(own, "node", "left").select("node", (F.col("n_in") - F.coalesce("own", F.lit(0))).alias("n_in"), (F.col("n_out") - F.coalesce("own", F.lit(0))).alias("n_out"))
    rounds = _start(onward, ends, 0, 1)
    _propagate(rounds)
    if rounds.left:  # longer cycles
        stuck = written(_open(rounds, rounds.done()), "links")
        longer = cyclic_nodes(stuck)
        cyclic = written(longer if cyclic is None else longer.unionByName(cyclic).distinct(), "cyclic")
        _resume(rounds, stuck, cyclic)
        total = _with_boundaries(links, _counts(rounds), cyclic, rounds.width)
    elif cyclic is not None:
        total = limbs.Sums(["node_id"])(_counts(rounds).unionByName(_out_of(links, cyclic)), rounds.width + 3)
    else:
        total = _counts(rounds)
    made = total.select("node_id", limbs.digits(F.col("limbs")).alias("in_paths"))
    out = ids.join(made, "node_id", "left").withColumn("in_paths", F.coalesce("in_paths", F.lit("0")))
    if cyclic is not None:
        out = out.join(cyclic.select(F.col("node").alias("node_id"), F.lit(True).alias("boundary")), "node_id", "left")
    boundary = F.lit(False) if cyclic is None else F.coalesce("boundary", F.lit(False))
    return out.select("node_id", "in_paths", log10_digits(F.col("in_paths")).alias("in_paths_log10"), boundary.alias("is_path_cycle_boundary"))


def _counts(rounds: Rounds) -> DataFrame:
    return rounds.done().select(F.col("node").alias("node_id"), "limbs")


def _resume(rounds: Rounds, stuck: DataFrame, cyclic: DataFrame) -> None:
    """Go on beyond the cycles: their nodes pass nothing on, but their links have arrived."""
    at = lambda end: cyclic.select(F.col("node").alias(end))
    onward = stuck.join(at("dst_id"), "dst_id", "left_anti")
    zero = F.array(F.lit(0).cast("bigint"))
    freed = onward.join(at("src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("node"), "need", "last", F.lit(1).cast("bigint").alias("arrived"), zero.alias("limbs"))
    waiting = rounds.waits().join(at("node"), "node", "left_anti")
    rounds.links = written(onward.join(at("src_id"), "src_id", "left_anti").select(*stuck.columns), "links")
    rounds.write(rounds.arrived(waiting.unionByName(freed)))
    rounds.left = rounds.links.count()
    _propagate(rounds)


def _out_of(links: DataFrame, cyclic: DataFrame) -> DataFrame:
    """What links out of cycles count at their targets: their own multiplicity."""
    return links.join(cyclic.select(F.col("node").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("node_id"), limbs.of_long(F.col("multiplicity")).alias("limbs"))


def _with_boundaries(links: DataFrame, onward: DataFrame, cyclic: DataFrame, width: int) -> DataFrame:
    """All counts: what may go on, what comes from cycles, and what arrives at them."""
    at = lambda end: cyclic.select(F.col("node").alias(end))
    off = onward.join(at("node_id"), "node_id", "left_anti")
    into = links.join(at("dst_id"), "dst_id", "left_semi").join(at("src_id"), "src_id", "left_anti").join(off.withColumnRenamed("node_id", "src_id"), "src_id")
    into = into.select(F.col("dst_id").alias("node_id"), limbs.times(F.col("limbs"), F.col("multiplicity"), 1).alias("limbs"))
    return limbs.Sums(["node_id"])(off.unionByName(_out_of(links, cyclic)).unionByName(into), width + 3)


# --- shared DAGs


def _arcs(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All DAGs' arcs as links ``dag, src_id, dst_id, multiplicity``, and their ends; parallel arcs stay apart.

    A DAG without just one root raises ``ContractError``.
    """
    links = written(arcs.select(*[F.col(a).cast("bigint").alias(b) for a, b in (("dag", "dag"), ("src", "src_id"), ("dst", "dst_id"))], F.lit(1).cast("bigint").alias("multiplicity")), "arcs")
    ends = written(_ends(links, "dag"), "ends")
    bad = ends.groupBy("dag").agg(F.count_if(F.col("n_in") == 0).alias("n")).where("n != 1").head()
    if bad:
        raise ContractError(f"a shared DAG has one root, not {bad['n']}")
    return links, ends


def _walk(links: DataFrame, ends: DataFrame, seed: int, add: int) -> DataFrame:
    """Counts passed along all arcs, all DAGs at once; a cycle raises ``ContractError``."""
    rounds = _start(links, ends, seed, add, "dag")
    _propagate(rounds)
    if rounds.left:
        raise ContractError("the graph has a cycle")
    return rounds.done()


def expression_table(arcs: DataFrame) -> DataFrame:
    """``dag, tree_occurrences, unique_nodes, arcs, max_depth`` of every shared DAG in ``dag, src, dst``.

    A DAG is read as a tree: its size is one more than what its root gathers from its children, which pass
    on their own.  Occurrences have no upper bound and are decimal digits; depth is the number of nodes on
    the longest way.  Parallel arcs count each; a DAG with a cycle or without just one root raises
    ``ContractError``; without arcs there is no row.  All DAGs are walked at once, from the leaves up.
    """
    links, ends = _arcs(arcs)
    up = lambda df, a, b: df.select(*[F.col({a: b, b: a}.get(c, c)).alias(c) for c in df.columns])
    at_root = _walk(up(links, "src_id", "dst_id"), up(ends, "n_in", "n_out"), 0, 1).where("last")
    facts = ends.groupBy("dag").agg(F.count("*").alias("unique_nodes"), F.sum("n_in").alias("arcs"))
    size = limbs.digits(limbs.times(F.col("limbs"), F.lit(1).cast("bigint"), 1)).alias("tree_occurrences")
    return at_root.join(facts, "dag").select("dag", size, "unique_nodes", "arcs", (F.col("round") + 1).cast("bigint").alias("max_depth"))


def leaf_table(arcs: DataFrame) -> DataFrame:
    """``dag, leaf, occurrences``: how often each leaf of every shared DAG occurs in its tree, in decimal digits.

    Every node passes on how often it occurs, from the roots down; the contract is that of ``expression_table``.
    """
    leaves = _walk(*_arcs(arcs), 1, 0).where("last")
    return leaves.select("dag", F.col("node").alias("leaf"), limbs.digits(F.col("limbs")).alias("occurrences"))


def ancestors(classes: DataFrame) -> DataFrame:
    """``module, class, ancestor_module, ancestor, depth, path``: a class, its superclass and interfaces, and theirs.

    *classes* has ``module, class, parents array<string>`` (superclass first).  A parent may be defined in
    several modules: the child's module comes first, then the others in name order.  *path* is the
    breadth-first place; each ancestor is kept at its least (depth, path).  Depth is not bounded: a cycle ends where it
    comes to an ancestor that is there already.
    """
    named = classes.select("module", "class", "parents")
    where = classes.select(F.col("module").alias("p_module"), F.col("class").alias("parent"))
    up = named.select("module", "class", F.posexplode("parents").alias("ordinal", "parent")).join(where, "parent")
    order = F.when(F.col("p_module") == F.col("module"), F.lit("")).otherwise(F.col("p_module"))
    up = written(up.select("module", "class", "p_module", "parent", F.struct("ordinal", order.alias("order")).alias("step")), "parents")
    kind = "array<struct<ordinal:int,order:string>>"
    level = named.select("module", "class", F.col("module").alias("ancestor_module"), F.col("class").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast(kind).alias("path"))
    found = level
    for depth in itertools.count(1):
        step = up.select(F.col("module").alias("ancestor_module"), F.col("class").alias("ancestor"), "p_module", "parent", "step")
        grown = level.join(step, ["ancestor_module", "ancestor"]).select("module", "class", F.col("p_module").alias("ancestor_module"), F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("step")).alias("path"))
        key = ["module", "class", "ancestor_module", "ancestor"]
        grown = grown.groupBy(*key).agg(F.min("depth").alias("depth"), F.min("path").alias("path")).join(found.select(*key), key, "left_anti")
        level = written(grown, "ancestors")
        if not level.head(1):
            return found
        found = found.unionByName(level)


# Owners whose methods take any descriptor.
METHOD_HANDLE, VAR_HANDLE = "java/lang/invoke/MethodHandle", "java/lang/invoke/VarHandle"
BASE_MODULE = "java.base"
ANY_ARGUMENTS = "([Ljava/lang/Object;)"
ANY_RESULT = "([Ljava/lang/Object;)Ljava/lang/Object;"


def resolve_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Calls with ``callee_id`` and ``resolution``; both null where the target is not in the corpus.

    *calls* has ``call_id, caller_module, owner, name, descriptor, hint``, *methods* ``method_id, module,
    class, name, descriptor``.  The owner is looked up in the caller's module first, then in the others
    in name order; its methods first, then breadth-first those of its ancestors.
    """
    up = ancestors(classes)
    members = methods.select(F.col("module").alias("ancestor_module"), F.col("class").alias("ancestor"), "name", "descriptor", "method_id")
    asked = calls.select("caller_module", "owner", "name", "descriptor").distinct()
    # The owner itself may lie outside the class list.
    roots = asked.join(up.withColumnRenamed("class", "owner"), "owner").unionByName(
        asked.join(methods.select(F.col("class").alias("owner"), "module").distinct().join(classes.select("module", F.col("class").alias("owner")), ["module", "owner"], "left_anti"), "owner").select(
            "owner", "caller_module", "name", "descriptor", "module", F.col("module").alias("ancestor_module"), F.col("owner").alias("ancestor"), F.lit(0).alias("depth"), F.array().cast("array<struct<ordinal:int,order:string>>").alias("path")
        ),
        allowMissingColumns=True,
    )
    root_order = F.when(F.col("module") == F.col("caller_module"), F.lit("")).otherwise(F.col("module"))
    hits = roots.join(members, ["ancestor_module", "ancestor", "name", "descriptor"])
    place = F.struct(F.col("depth"), root_order.alias("root"), F.col("path"))
    best = hits.groupBy("caller_module", "owner", "name", "descriptor").agg(F.min_by(F.struct("method_id", "depth"), place).alias("hit"))
    handle = methods.where((F.col("module") == BASE_MODULE) & (F.col("class") == METHOD_HANDLE) & F.col("name").isin("invoke", "invokeExact") & (F.col("descriptor") == ANY_RESULT))
    var = methods.where((F.col("module") == BASE_MODULE) & (F.col("class") == VAR_HANDLE) & F.col("descriptor").startswith(ANY_ARGUMENTS))
    loose = handle.unionByName(var).groupBy(F.col("class").alias("owner"), "name").agg(F.min("method_id").alias("loose_id"))
    out = calls.join(best, ["caller_module", "owner", "name", "descriptor"], "left").join(loose, ["owner", "name"], "left")
    callee = F.coalesce("hit.method_id", "loose_id")
    kind = (
        F.when(callee.isNull(), F.lit(None).cast("string"))
        .when(F.col("hint") == "BOOTSTRAP_HANDLE", "BOOTSTRAP_HANDLE")
        .when(F.col("hit").isNull(), "SIGNATURE_POLYMORPHIC")
        .when(F.col("hit.depth") == 0, "EXACT")
        .otherwise("INHERITED")
    )
    reason = F.when(callee.isNull(), F.when(F.col("hint") == "UNRESOLVED_DYNAMIC", F.col("hint")).otherwise("TARGET_NOT_IN_CORPUS"))
    return out.select(*[c for c in calls.columns], callee.alias("callee_id"), kind.alias("resolution"), reason.alias("reason"))
