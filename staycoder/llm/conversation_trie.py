"""Prefix trie of conversations: which first turns are shared, by how many, and what sharing would save.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100 (all if it has fewer, none if there is
no such conversation), then its own turns after its first h, with h = crc32(decimal c) % 6. A node is a distinct sequence of
first turns (role, text).

1. Turns are sorted by conversation and turn across all partitions; places and running sums restart with each
   conversation, and what a conversation had in earlier partitions is added afterwards (one row per partition is
   collected for that). So a conversation of any length is split over many tasks. The running sums are two
   64-bit polynomials of the turns' md5 digests: the key of a prefix.
2. Grouping by (depth, key) gives the nodes. Nodes that branch, or where a conversation ends, are explicit; all
   other nodes have the same members as the explicit node below them.
3. The first conversation of each end node becomes the list of explicit nodes on its path; lists are sorted. A list
   has at most about the square root of twice the number of turns entries, since members shrink along it.
4. Block by block, edges between sorted neighbours are taken in descending depth of their longest common
   prefix; a union-find merges the two components, and each merge makes or widens a branching node. A node whose
   members were not all in the block stays open: what the block knows of it is contracted into one row, and
   the rows of a node are added up across blocks. A node's own tokens are added in the block that has its
   smallest member, so nothing counts twice.

Null conv_ids take no part; null turns come first, null roles and texts are empty, repeated rows count each, and turns with equal
numbers are ordered by digest. Other columns are ignored. Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.llm.hashing import BASE, BASE_2, powers
from staycoder.llm.lookup import lookup
from staycoder.sources.shared import write_once

BASE_STEP, MAX_HEAD = 100, 5
KEY = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_WRAP = 1 << 64


def _power(base, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, _WRAP))


def _places(batches):
    """Sorted turns numbered within their conversation and partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        begins = np.concatenate(([True], conv[1:] != conv[:-1]))
        first = np.maximum.accumulate(np.where(begins, np.arange(len(conv)), 0))
        local = np.arange(1, len(conv) + 1) - first
        if conv[0] == last:
            local[first == 0] += count
        last, count = conv[-1], int(local[-1])
        columns = [batch.column("conv"), pa.array(local), batch.column("sig"), batch.column("chars"), pa.array(np.full(len(conv), part, dtype=np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "local", "sig", "chars", "part"])


def _running(batches):
    """Sorted rebuilt turns with the running sums of their conversation in this partition, before and after them."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, count, sums, chars_before = None, 0, [np.uint64(0), np.uint64(0)], 0
    held = None
    for batch in batches:
        conv = batch.column("conv").to_numpy(zero_copy_only=False)
        n = len(conv)
        if not n:
            continue
        begins = np.concatenate(([True], conv[1:] != conv[:-1]))
        first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        goes_on = (first == 0) if conv[0] == last else np.zeros(n, dtype=bool)
        place = np.arange(n) - first  # in the conversation and batch, from 0
        local = place + 1 + np.where(goes_on, count, 0)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u8").reshape(n, 2)
        out = []
        for which, base in enumerate((BASE, BASE_2)):
            weight = powers(base, n + 1)[1:][place]
            weight = np.where(goes_on, weight * _power(base, count), weight)
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(sig[:, which] * weight, dtype=np.uint64)))
            before = np.where(goes_on, sums[which], np.uint64(0))
            out += [total[1:] - total[first] + before, total[:-1] - total[first] + before]
        size = batch.column("chars").to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(size)))
        cum = total[1:] - total[first] + np.where(goes_on, chars_before, 0)
        last, count, sums, chars_before = conv[-1], int(local[-1]), [out[0][-1], out[2][-1]], int(cum[-1])
        ends = np.concatenate((conv[1:] != conv[:-1], [True]))
        columns = [conv, local, *(x.view(np.int64) for x in (out[0], out[2], out[1], out[3])), cum, size, ends]
        if held is not None:
            held[-1][-1] = held[0][-1] != conv[0]
            yield _batch(pa, held, part)
        held = columns
    if held is not None:
        yield _batch(pa, held, part)


_RUNNING = "conv long, local long, p1 long, p2 long, q1 long, q2 long, cum long, chars long, ends boolean, part int"


def _batch(pa, columns, part: int):
    names = [field.split()[0] for field in _RUNNING.split(", ")]
    arrays = [pa.array(np.ascontiguousarray(c)) for c in columns] + [pa.array(np.full(len(columns[0]), part, dtype=np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def carried(edges: list[tuple]) -> dict[int, tuple]:
    """(part, first, last, totals of the last) of all partitions to, by partition, what its first one had before.

    Totals are (count, p1, p2, characters). Returned: (first, last, carried totals, does the last one end here).
    """
    out, last, totals = {}, None, (0, 0, 0, 0)
    ordered = sorted(edges)
    for i, (part, first, own_last, own) in enumerate(ordered):
        before = totals if first == last else (0, 0, 0, 0)
        ends = i + 1 == len(ordered) or ordered[i + 1][1] != own_last
        out[part] = (first, own_last, before, ends)
        totals = _joined(before, own) if first == own_last else own
        last = own_last
    return out


def _joined(before: tuple, own: tuple) -> tuple:
    count, p1, p2, chars = before
    shift = [pow(int(base), count, _WRAP) for base in (BASE, BASE_2)]
    return count + own[0], (p1 + shift[0] * own[1]) % _WRAP, (p2 + shift[1] * own[2]) % _WRAP, chars + own[3]


def _placed(carry: dict[int, tuple]):
    """Running sums of a partition to those of the whole conversation."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            data = {name: batch.column(name).to_numpy(zero_copy_only=False).copy() for name in batch.schema.names}
            for part in np.unique(data["part"]).tolist():
                first, last, (count, p1, p2, chars), ends = carry[part]
                here = data["part"] == part
                if count:
                    mine = here & (data["conv"] == first)
                    for name, base, add in (("p1", BASE, p1), ("q1", BASE, p1), ("p2", BASE_2, p2), ("q2", BASE_2, p2)):
                        moved = data[name][mine].view(np.uint64) * _power(base, count) + np.uint64(add)
                        data[name][mine] = moved.view(np.int64)
                    data["cum"][mine] += chars
                    data["local"][mine] += count
                if not ends:
                    tail = here & (data["conv"] == last) & data["ends"]
                    data["ends"][tail] = False
            names = ["conv", "local", "p1", "p2", "q1", "q2", "cum", "chars", "ends"]
            yield pa.RecordBatch.from_arrays([pa.array(data[n]) for n in names], names=["conv", "depth", "k1", "k2", "q1", "q2", "cum", "chars", "ends"])

    return run


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all conversations, rebuilt turns with depth, keys of the prefix and of the one before, characters, end)."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("sig"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),  # equal rows can be split too
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("sig"), F.col("row")]
    numbered = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "row")
    numbered = write_once(numbered.mapInArrow(_places, "conv long, local long, sig binary, chars long, part int"), "turn-places")
    edges = numbered.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "local")).alias("last")).collect()
    starts = carried([(r["part"], r["first"], r["last"]["conv"], (r["last"]["local"], 0, 0, 0)) for r in edges])
    table = F.broadcast(spark.createDataFrame([(p, s[0], s[2][0]) for p, s in starts.items()], "part int, first long, earlier long"))
    place = F.col("local") + F.when(F.col("conv") == F.col("first"), F.col("earlier")).otherwise(0)
    own = numbered.join(table, "part").select("conv", place.alias("place"), "sig", "chars")

    convs = write_once(numbered.select("conv").distinct(), "conversations")
    head = F.expr("crc32(cast(conv AS string)) % 6")
    base = F.col("conv") - F.col("conv") % BASE_STEP
    heads = own.where((F.col("conv") % BASE_STEP == 0) & (F.col("place") <= MAX_HEAD)).withColumnRenamed("conv", "base")
    heads = convs.select("conv", base.alias("base"), head.alias("h")).join(heads, "base").where("place <= h")
    tails = own.where(F.col("place") > head).select("conv", (F.col("place") + MAX_HEAD).alias("place"), "sig", "chars")
    both = heads.select("conv", "place", "sig", "chars").unionByName(tails)
    sums = both.repartitionByRange("conv", "place").sortWithinPartitions("conv", "place").mapInArrow(_running, _RUNNING)
    sums = write_once(sums, "turn-sums")
    edges = sums.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "local", "p1", "p2", "cum")).alias("last")).collect()
    carry = carried([
        (r["part"], r["first"], r["last"]["conv"], (r["last"]["local"], r["last"]["p1"] % _WRAP, r["last"]["p2"] % _WRAP, r["last"]["cum"]))
        for r in edges
    ])
    fields = "conv long, depth long, k1 long, k2 long, q1 long, q2 long, cum long, chars long, ends boolean"
    return convs, sums.mapInArrow(_placed(carry), fields)


def block_forest(rows: list[tuple]) -> list[tuple]:
    """Subtree sums of the explicit nodes of sorted paths.

    A row is (conversation, is its end node childless, conversations that end there, path), a path a list of explicit
    nodes (depth, k1, k2, members, smallest member, characters up to it). Returned: (depth, k1, k2, tokens saved below,
    leaves, whole), the root included.
    """
    paths = [r[3] for r in rows]
    group = list(range(len(rows)))
    top = [len(p) for p in paths]
    below = [0] * len(rows)
    leaves = [int(r[1]) for r in rows]
    members = [r[2] for r in rows]
    least = [r[0] for r in rows]
    out = []

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def lift(i: int, k: int) -> None:
        """Move the component's top node up to the k-th of its path."""
        path = paths[i]
        while top[i] > k:
            depth, k1, k2, n, smallest, cum = path[top[i] - 1]
            if n > 1:
                out.append((depth, k1, k2, below[i], leaves[i], members[i] == n))
            if smallest == least[i]:
                below[i] += (n - 1) * (cum - (path[top[i] - 2][5] if top[i] > 1 else 0))
            top[i] -= 1

    edges = []
    for i in range(1, len(rows)):
        a, b, k = paths[i - 1], paths[i], 0
        while k < len(a) and k < len(b) and a[k][:3] == b[k][:3]:
            k += 1
        edges.append((a[k - 1][0] if k else 0, i, k))
    for _, i, k in sorted(edges, key=lambda e: (-e[0], e[1])):
        a, b = find(i - 1), find(i)
        lift(a, k)
        lift(b, k)
        group[b] = a
        below[a] += below[b]
        leaves[a] += leaves[b]
        members[a] += members[b]
        least[a] = min(least[a], least[b])
    if rows:
        root = find(0)
        lift(root, 0)
        out.append((0, 0, 0, below[root], leaves[root], False))
    return out


def _forests(batches):
    import pyarrow as pa

    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("below", pa.int64()), ("leaves", pa.int64()), ("whole", pa.bool_())])
    for batch in batches:
        paths = [[tuple(node.values()) for node in path] for path in batch.column("path").to_pylist()]
        rows = list(zip(batch.column("conv").to_pylist(), batch.column("childless").to_pylist(), batch.column("n_ends").to_pylist(), paths, strict=True))
        found = list(zip(*block_forest(rows), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(found, schema, strict=True)], schema=schema)


IDS_AT_ONCE = 4096


def _id_runs(batches):
    """Sorted (node, conversation) to digests of the nodes that lie within a batch, and stretches of ids of the others."""
    import pyarrow as pa

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY], axis=1)
        ids = batch.column("conv").to_pylist()
        if not ids:
            continue
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = keys[a].tolist()
            if 0 < a and b < len(ids):
                rows.append((*key, ids[a], None, hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()))
            else:
                rows += [(*key, ids[i], ",".join(map(str, ids[i : min(i + IDS_AT_ONCE, b)])), None) for i in range(a, b, IDS_AT_ONCE)]
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*KEY, "conv", "ids", "sha"])


def _id_digests(batches):
    """Stretches of ids, sorted by node and first id, to the node's digest; only one running digest is held."""
    import pyarrow as pa

    def out(key, running):
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([running.hexdigest()])], names=[*KEY, "sha"])

    last, running = None, None
    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key == last:
                running.update(b"," + ids.encode())
                continue
            if last is not None:
                yield out(last, running)
            last, running = key, hashlib.sha256(ids.encode())
    if last is not None:
        yield out(last, running)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): SHA-256 of the ascending decimal ids of the conversations that end at a node.

    A digest is a sequence by nature: a node with very many ends is hashed by one task, but as stretches of 4,096 ids.
    """
    order = [*KEY, "conv"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = write_once(runs.mapInArrow(_id_runs, "depth long, k1 long, k2 long, conv long, ids string, sha string"), "ends")
    parts = runs.where("ids IS NOT NULL").repartition(*KEY).sortWithinPartitions(*order).select(*KEY, "ids")
    return runs.where("ids IS NULL").select(*KEY, "sha").unionByName(parts.mapInArrow(_id_digests, "depth long, k1 long, k2 long, sha string"))


def _on(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, KEY, "left")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node, see the module: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (code points of repeated last texts in the subtree), ends_sha256."""
    convs, turns = rebuilt(conversations)
    nodes = turns.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.max("cum").alias("cum"), F.max("chars").alias("chars"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"),
        F.min(F.when(F.col("ends"), F.col("conv"))).alias("end_rep"),
    )
    nodes = write_once(nodes, "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
    children = nodes.select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = write_once(_on(nodes, children).fillna(0, ["n_children"]), "trie-nodes")

    explicit = nodes.where("n_children <> 1 OR n_ends > 0")
    marks = explicit.select(*KEY, "n", "least", F.col("cum").alias("upto"), F.col("n").alias("rows"))
    marked = lookup(turns.select("conv", *KEY), marks, KEY, "rows", ["conv", "depth"]).where("n IS NOT NULL")
    paths = marked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*KEY, "n", "least", "upto"))).alias("path"))
    reps = nodes.where("n_ends > 0").select(F.col("end_rep").alias("conv"), (F.col("n_children") == 0).alias("childless"), "n_ends")
    forest = paths.join(reps, "conv").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(
        _forests, "depth long, k1 long, k2 long, below long, leaves long, whole boolean"
    )
    forest = write_once(forest, "trie-forests")
    merged = forest.where("NOT whole").groupBy(*KEY).agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    sums = forest.where("whole").drop("whole").unionByName(merged)

    # nodes between two explicit ones have the members, so the number and the smallest, of the lower one
    shared = nodes.where("n > 1")
    edges = shared.groupBy("least", "n").agg(F.count(F.lit(1)).alias("rows"))
    lower = explicit.where("n > 1").select(*KEY, "n", "least", F.col("cum").alias("lower_cum"))
    lower = lower.join(sums, KEY).join(edges, ["least", "n"]).select("least", "n", "rows", "lower_cum", "below", "leaves")
    lower = write_once(lower, "trie-edges")
    saved = F.expr("below + (n - 1) * (lower_cum - cum + chars)")
    full = lookup(shared, lower, ["least", "n"], "rows", KEY).withColumn("saved_tokens", saved).drop("lower_cum", "below")
    full = full.unionByName(nodes.where("n = 1").withColumn("leaves", F.lit(1).cast("long")).withColumn("saved_tokens", F.lit(0).cast("long")))

    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("least").alias("parent"), F.col("n_children").alias("rows"))
    full = lookup(full.withColumn("up", F.col("depth") - 1), parents, ["up", "q1", "q2"], "rows", KEY)

    stops = turns.where("ends").select(*KEY, "conv")
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    turnless = convs.join(stops.select("conv"), "conv", "left_anti").select(*zero, "conv")
    digests = write_once(end_digests(stops.unionByName(turnless)), "end-digests")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least")).where("n > 0")
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    down = sums.where("depth = 0").agg(F.sum("below").alias("saved_tokens"), F.sum("leaves").alias("leaves"))
    root = reduce(lambda a, b: a.join(b.withColumn("_", F.lit(0)), "_", "left"), (first, down), root.withColumn("_", F.lit(0))).drop("_")
    root = root.select(*zero, "*", F.lit(None).cast("long").alias("parent")).fillna({"leaves": 1, "saved_tokens": 0})
    least = F.broadcast(convs.agg(F.min("conv").alias("root_conv")).withColumn("up", F.lit(0).cast("long")))
    full = full.join(least, "up", "left").withColumn("parent", F.coalesce("parent", "root_conv"))
    both = full.select(*root.columns).unionByName(root)
    return _on(both, digests).select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
