"""A trie of conversations by their turns, rolled up by centroid decomposition.

Conversations that begin with the same (role, text) turns share a path. A node is told by the
exclusive or of hashes of (position, role, text), two 64-bit ones, so a path's nodes follow from
running values that can be joined piece by piece: a conversation with a third of all turns is cut
into ranges of turns, never sorted or held as a whole.

Totals over subtrees come from centroid decomposition of the parent-edge forest. Of a component,
the deepest node with at least half of its nodes below or at it is the centroid. What the component
has below it is added up and given to every node on the path from the centroid to the component's
top; then the centroid is taken out and the pieces, each at most half as large, go on. A pair of a
node and an ancestor is counted once, when a centroid first stands between them, so no path is
walked more than log2(n) times. Trees of up to ``held`` nodes are decomposed each inside one task;
larger ones level by level with joins until their pieces are as small.

Rows: turns are ordered by turn, nulls first; equal turns by role, then by a fixed but arbitrary
order of texts. A null role or text is empty. Equal rows are turns of their own. Rows without a
conv_id belong to no conversation. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a conversation that are summed side by side, and ids of a range of conversations.
_TURNS, _IDS = 4096, 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# Rebuilt conversations

def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), c1, c2 (hashes of role and text), chars, written.

    Rows are sorted by range, so one conversation may lie in many partitions; a partition's first
    conversation alone can have begun before it, so the ranks to add are at most one a partition.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "c1", "c2"]
    rows = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("c1"), F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.char_length(text).cast("bigint").alias("chars")).filter("conv_id IS NOT NULL")
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            at = np.arange(len(conv))
            first = np.r_[True, conv[1:] != conv[:-1]]
            local = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
            if last == conv[0]:
                local[:np.flatnonzero(np.r_[first[1:], True])[0] + 1] += seen
            last, seen = int(conv[-1]), int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "c1", "c2", "chars")]
                + [pa.array(np.full(len(conv), part)), pa.array(local)],
                names=["conv_id", "c1", "c2", "chars", "part", "local"])

    numbered = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
            number, "conv_id bigint, c1 bigint, c2 bigint, chars bigint, part bigint, local bigint"),
        "turns")
    # Runs of a conversation that goes on in a later partition: at most one starts each partition.
    runs = numbered.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    later = (runs.withColumn("offset", F.sum("n").over(before)).filter("offset IS NOT NULL")
             .select("conv_id", "part", "offset"))
    return numbered.join(F.broadcast(later), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("rank"),
        "c1", "c2", "chars")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) after the shared first turns are put in place.

    ``conversations`` has conv_id and n, its number of turns; ``rows`` has conv_id, depth, c1, c2,
    chars. Conversation c begins with the first ``shared_turns`` turns of c - c % 100, as far as
    there are, and goes on with its own turns after as many.
    """
    own = ranked(turns)
    sizes = own.groupBy("conv_id").agg(F.max("rank").alias("size"))
    head = (own.filter("conv_id % 100 = 0 AND rank <= 5").groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "c1", "c2", "chars"))).alias("head"))
            .select(F.col("conv_id").alias("root"), "head"))                 # five turns at most
    convs = (sizes.withColumn("root", F.expr("conv_id - conv_id % 100"))
             .withColumn("h", shared_turns(F.col("conv_id"))).join(head, "root", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
             .withColumn("shift", F.size("head") - F.col("h"))
             .withColumn("n", F.size("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    convs = stored(convs.select("conv_id", "h", "shift", "n", "head"), "conversations")
    tail = own.join(convs.select("conv_id", "h", "shift"), "conv_id").filter("rank > h").select(
        "conv_id", (F.col("rank") + F.col("shift")).cast("bigint").alias("depth"),
        "c1", "c2", "chars")
    heads = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.rank").cast("bigint").alias("depth"), "t.c1", "t.c2", "t.chars")
    return convs.select("conv_id", "n"), tail.unionByName(heads)


def paths(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the node), p1, p2 (its parent; 0 for the root), tree, chars, ends.

    ``tree`` is the same for all nodes below one first turn.
    """
    mixed = rows.withColumn("g1", F.xxhash64("depth", "c1", "c2")).withColumn(
        "g2", F.xxhash64(F.lit(3), "depth", "c2", "c1")).drop("c1", "c2").withColumn(
        "range", F.expr(f"(depth - 1) div {_TURNS}"))
    within = Window.partitionBy("conv_id", "range").orderBy("depth")
    running = mixed.repartition("conv_id", "range").select(
        "*", *(F.bit_xor(g).over(within).alias(k) for g, k in (("g1", "k1"), ("g2", "k2"))),
        F.first("g1").over(within).alias("tree"))
    # Conversations beyond one range take over what their earlier ranges come to.
    whole = (mixed.join(convs.filter(f"n > {_TURNS}").select("conv_id"), "conv_id", "left_semi")
             .groupBy("conv_id", "range").agg(
                 F.bit_xor("g1").alias("r1"), F.bit_xor("g2").alias("r2"),
                 F.min_by("g1", "depth").alias("first")))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = whole.select(
        "conv_id", "range", F.bit_xor("r1").over(earlier).alias("o1"),
        F.bit_xor("r2").over(earlier).alias("o2"),
        F.first("first").over(earlier).alias("of")).filter("range > 0")
    joined = running.join(offsets, ["conv_id", "range"], "left")
    for k, o in (("k1", "o1"), ("k2", "o2")):
        joined = joined.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(o, F.lit(0))))
    return joined.join(convs, "conv_id").select(
        "conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"), F.coalesce("of", "tree").alias("tree"),
        "chars", (F.col("depth") == F.col("n")).alias("ends"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 from rows k1, k2, conv_id: the hash of all ids in order.

    Ranges of ids are joined to strings side by side; the hash of a node then takes its strings in
    turn and holds none of them.
    """
    strings = ends.groupBy("k1", "k2", F.expr(f"floor(conv_id / {_IDS})").alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")),
                                 lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) != node:
                    if node is not None:
                        for column, value in zip(out, (*node, state.hexdigest())):
                            column.append(value)
                    node, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out)
        if node is not None:
            yield _batch([[node[0]], [node[1]], [state.hexdigest()]])

    def _batch(columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
            names=["k1", "k2", "ends_sha256"])

    return (strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range")
            .mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string"))


# Totals over subtrees

def decompose(parent: list[int], values: list[tuple]) -> list[list]:
    """Totals over every node's subtree in a forest; parents (-1: none) stand before children."""
    n = len(parent)
    size, label = [1] * n, [0] * n
    width = len(values[0]) if n else 0
    total = [[0] * width for _ in range(n)]
    top = list(range(n))
    trees: dict[int, list[int]] = {}
    for v, p in enumerate(parent):
        if p >= 0:
            top[v] = top[p]
        trees.setdefault(top[v], []).append(v)
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
    todo = list(trees.values())
    mark = 0
    while todo:
        nodes = todo.pop()
        first = nodes[0]
        centre = next(v for v in reversed(nodes) if 2 * size[v] >= len(nodes))
        mark += 1
        label[centre] = mark
        below: dict[int, list[int]] = {}
        above, root_of = [], {}
        sums = list(values[centre])
        for v in nodes:
            p = parent[v]
            if v != centre and v != first and label[p] == mark:
                label[v] = mark
                r = root_of[v] = v if p == centre else root_of[p]
                below.setdefault(r, []).append(v)
                for c, x in enumerate(values[v]):
                    sums[c] += x
            elif v != centre:
                above.append(v)
        removed, v = size[centre], centre
        while True:                                    # the path from the centroid to the top
            for c, x in enumerate(sums):
                total[v][c] += x
            if v != centre:
                size[v] -= removed
            if v == first:
                break
            v = parent[v]
        todo.extend(below.values())
        if above:
            todo.append(above)
    return total


def _below(forest: DataFrame, flag: str) -> DataFrame:
    """``forest`` (id, parent or null, ...) with its root, and whether ``flag`` holds below or at it.

    Pointers double, so a path of n nodes takes log2(n) rounds.
    """
    at = stored(forest.select("id", F.col("parent").alias("up"), F.col("id").alias("root"),
                                    F.col(flag).cast("bigint").alias("marked")))
    while at.filter("up IS NOT NULL").limit(1).count():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("up2"),
                          F.col("root").alias("root2"))
        add = (at.filter("up IS NOT NULL").groupBy(F.col("up").alias("id"))
               .agg(F.sum("marked").alias("add")))
        at = stored(
            at.join(above, "up", "left").join(add, "id", "left").select(
                "id", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root"),
                (F.col("marked") + F.coalesce("add", F.lit(0))).alias("marked")))
    return forest.join(at.select("id", "root", "marked"), "id")


def _halved(nodes: DataFrame, values: list[str], held: int) -> DataFrame:
    """Centroids taken out, level by level, until every component has at most ``held`` nodes.

    ``nodes`` has tree, id, parent and ``values``. Returns them with component instead of tree,
    the parents cut where a centroid was, and ``done_*``: totals that the levels have added.
    """
    inside = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("inside"))
    state = (nodes.join(inside, ["tree", "parent"], "left")
             .withColumn("parent", F.when(F.col("inside"), F.col("parent"))).drop("inside"))
    sized = _below(state.withColumn("one", F.lit(1)), "one")
    state = stored(sized.select(
        F.col("root").alias("component"), "id", "parent", *values, F.col("marked").alias("size"),
        *(F.lit(0).cast("bigint").alias(f"done_{v}") for v in values)))
    finished = None

    def add(part):
        nonlocal finished
        finished = part if finished is None else finished.unionByName(part)

    while True:
        counts = state.groupBy("component").agg(F.count("*").alias("nodes"))
        small = stored(state.join(counts.filter(f"nodes <= {held}").select("component"),
                                        "component", "left_semi"))
        add(small.drop("size"))
        state = state.join(counts.filter(f"nodes > {held}"), "component")
        centres = stored(
            state.filter("2 * size >= nodes").groupBy("component")
            .agg(F.min_by(F.struct("id", "size", "parent"), "size").alias("c"))
            .select("component", F.col("c.id").alias("centre"), F.col("c.size").alias("removed"),
                    F.col("c.parent").alias("over")))
        if not centres.limit(1).count():
            return finished
        state = state.drop("nodes").join(centres, "component")
        forest = state.withColumn("cut", F.coalesce(F.col("parent") == F.col("centre"), F.lit(False))) \
            .withColumn("over", F.coalesce(F.col("id") == F.col("over"), F.lit(False)))
        rest = stored(forest.filter(F.col("id") != F.col("centre")).withColumn(
            "parent", F.when(~F.col("cut"), F.col("parent"))))
        rest = _below(rest, "over")            # marked: on the path from the centroid to the top
        tops = rest.filter("cut").select(F.col("id").alias("root"), F.lit(True).alias("under"))
        rest = stored(rest.join(tops, "root", "left"))
        centre = forest.filter(F.col("id") == F.col("centre"))
        sums = (rest.filter("under").select("component", *values)
                .unionByName(centre.select("component", *values))
                .groupBy("component").agg(*(F.sum(v).alias(f"sum_{v}") for v in values)))
        sums = stored(sums)
        add(stored(centre.join(sums, "component").select(
            F.col("id").alias("component"), "id", F.lit(None).cast("string").alias("parent"),
            # The rest of a taken node's total comes from its own value in the last step.
            *values, *((F.col(f"done_{v}") + F.col(f"sum_{v}") - F.col(v)).alias(f"done_{v}")
                       for v in values))))
        on = F.col("marked") > 0
        state = stored(rest.join(sums, "component").select(
            F.col("root").alias("component"), "id", "parent", *values,
            (F.col("size") - F.when(on, F.col("removed")).otherwise(0)).alias("size"),
            *((F.col(f"done_{v}") + F.when(on, F.col(f"sum_{v}")).otherwise(0)).alias(f"done_{v}")
              for v in values)))


def rollup(nodes: DataFrame, values: list[str], held: int = 1 << 18) -> DataFrame:
    """``nodes`` with total_* for each of ``values`` (bigint): its sum over the node's subtree.

    ``nodes`` has tree (bigint; nodes of one tree share it), id (string, distinct), parent (an id
    of the same tree, or any other value for a top), depth (a parent's is less) and any other
    columns. A task holds at most ``held`` nodes of one tree at a time.
    """
    nodes = stored(nodes, "nodes")
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(f"n > {held}").select("tree"), "large")
    zero = [F.lit(0).cast("bigint").alias(f"done_{v}") for v in values]
    if not large.limit(1).count():
        pieces = nodes.select("*", F.col("tree").alias("component"), *zero)
    else:
        few = nodes.join(large, "tree", "left_anti").select(
            "*", F.col("tree").alias("component"), *zero)
        many = nodes.join(large, "tree", "left_semi")
        cut = _halved(many.select("tree", "id", "parent", *values), values, held)
        pieces = few.unionByName(
            many.drop("parent").join(cut.drop(*values), "id").select(
                *nodes.columns, F.xxhash64("component").alias("component"),
                *(f"done_{v}" for v in values)))
    names = [*nodes.columns, *(f"total_{v}" for v in values)]
    schema = f"{_ddl(nodes)}, " + ", ".join(f"total_{v} bigint" for v in values)

    def run(batches):
        held_rows: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held_rows)
            held_rows.clear()
            ids, parents, group = (table.column(c).to_pylist()
                                   for c in ("id", "parent", "component"))
            # Some components at a time, each whole; an id stands for one node of them.
            place = {i: at for at, i in enumerate(ids)}
            up = [-1] * len(ids)
            for at, p in enumerate(parents):
                to = place.get(p, -1)
                if to >= 0 and group[to] == group[at]:
                    up[at] = to
            totals = decompose(up, list(zip(*(table.column(v).to_pylist() for v in values))))
            for c, v in enumerate(values):
                done = table.column(f"done_{v}").to_numpy()
                table = table.append_column(
                    f"total_{v}", pa.array(done + np.array([t[c] for t in totals], np.int64)))
            yield from table.select(names).to_batches(max_chunksize=10_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("component").to_numpy()
            ends = np.flatnonzero(np.r_[group[1:] != group[:-1], False]) + 1
            if held_rows and held_rows[-1].column("component")[-1].as_py() != group[0]:
                ends = np.r_[0, ends]
            # The rows before the last change of component are whole components.
            if len(ends) and sum(b.num_rows for b in held_rows) + ends[-1] >= 10_000:
                if ends[-1]:
                    held_rows.append(batch.slice(0, int(ends[-1])))
                yield from flush()
                batch = batch.slice(int(ends[-1]))
            if batch.num_rows:
                held_rows.append(batch)
        if held_rows:
            yield from flush()

    return (pieces.repartition("component").sortWithinPartitions("component", "depth", "id")
            .mapInArrow(run, schema))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# The trie

def trie(turns: DataFrame, held: int = 1 << 18) -> DataFrame:
    """Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    convs, rows = rebuilt(turns)
    path = stored(paths(convs, rows), "paths")
    found = path.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("tree").alias("tree"), F.max("chars").alias("chars"))
    ends = end_hashes(path.filter("ends").select("k1", "k2", "conv_id").unionByName(
        convs.filter("n = 0").select(F.lit(0).cast("bigint").alias("k1"),
                                     F.lit(0).cast("bigint").alias("k2"), "conv_id")))
    ends = stored(ends, "ends")
    found = stored(found.join(ends, ["k1", "k2"], "left"), "found")
    # The root's children know their parent already; other parents are looked up.
    parents = found.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    linked = found.filter("depth > 1").join(parents, ["p1", "p2"]).unionByName(
        found.filter("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("bigint")))
    children = (found.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count("*").alias("n_children")))
    nodes = linked.join(children, ["k1", "k2"], "left").select(
        "tree", F.format_string("%d:%d", "conv_id", "depth").alias("id"),
        F.format_string("%d:%d", "parent_conv_id", F.col("depth") - 1).alias("parent"),
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        F.col("n_children").isNull().cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    rolled = stored(rollup(nodes, ["leaf", "saved"], held), "rolled")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
               F.col("total_leaf").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"),
               "ends_sha256"]
    # The textless root is taken out first; its pieces are the trees below the first turns.
    under = rolled.filter("depth = 1").agg(
        F.count("*").alias("n_children"), F.coalesce(F.sum("total_leaf"), F.lit(0)).alias("leaf"),
        F.coalesce(F.sum("total_saved"), F.lit(0)).alias("saved_tokens"))
    at_root = ends.filter("k1 = 0 AND k2 = 0").first()
    whole = lambda x: F.lit(x).cast("bigint")
    top = under.filter(F.lit(root["n"] > 0)).select(
        whole(root["conv_id"]).alias("conv_id"), whole(0).alias("depth"),
        whole(None).alias("parent_conv_id"), whole(root["n"]).alias("n_convs"), "n_children",
        F.when(F.col("n_children") == 0, whole(1)).otherwise(F.col("leaf")).alias("n_leaves"),
        "saved_tokens",
        F.lit(at_root["ends_sha256"] if at_root else EMPTY_SHA256).alias("ends_sha256"))
    return rolled.select(*columns).unionByName(top)


def brute_force(turns: list[tuple]) -> list[tuple]:
    """The rows of ``trie`` from (conv_id, turn, role, text) tuples without ties; small inputs."""
    own: dict[int, list] = {}
    for c, t, role, text in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        root = own.get(int(np.sign(c)) * (abs(c) // 100 * 100), [])
        full[c] = tuple(root[:h] + own[c][h:])
    members: dict[tuple, list] = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    rows = []
    for node, convs in members.items():
        under = [m for m in members if m[:len(node)] == node]
        children = {m for m in under if len(m) == len(node) + 1}
        inner = {m[:-1] for m in under if m}
        ends = ",".join(str(c) for c in sorted(convs) if full[c] == node)
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                     len(children), sum(m not in inner for m in under),
                     sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return rows
