"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Every text becomes the set of its five-word shingles (64-bit fingerprints). Texts with equal sets
   are one class, represented by its least row; only classes go on.
2. Prefix principle: two sets with Jaccard >= t share one of the first n - ceil(t*n) + 1 shingles of
   each in any common order. The order puts shingles of several documents last and goes by their hashes otherwise, so
   that shared passages and phrases seldom open a tile. Which ones come last is estimated from a part of the texts,
   for the shingles of low hashes, which alone open tiles; a wrong estimate costs time, never links. A tile holds the
   classes that have a prefix shingle in common and sizes in the same band (factor 4, with an overlap of 1/t, so that
   no pair falls between). Of tiles with the same classes (the shingles of a shared passage, or of near copies) one is kept.
3. Round one compares every class of a tile with the tile's leader only, which is linear. What is not yet connected
   is compared in cells of bounded size: first by bitmaps, which leaves the classes with a possible partner in another
   component, then by their texts. A cell returns a spanning forest of its links, fewer links than it has classes. So a
   group of thousands of near copies never becomes all its pairs, and no link that could join two components is left
   out. In tiles of several cells the largest component's classes are not compared with each other.
4. A pair is first bounded: a bitmap has the parity of the hashes that fall on each bit, so two sets
   differ in at least as many shingles as their bitmaps differ in bits. What can still reach t is
   verified by intersecting the sorted shingle arrays.

Null texts and texts without a word have the empty set, which is linked with nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.llm.components import components
from staycoder.llm.hashing import buffers, by_owner, mix, shingles, words
from staycoder.sources.shared import write_once

COUNTED_TEXTS = 4  # one text in so many is counted for the order
COUNTED_HASHES = np.uint64(int(0.35 * 2**64))  # and of its shingles those below this
FIRST_PARTNERS = 2  # a class is compared with so many in the first round of a cell, then with eight times as many
CELL_MEMBERS = 1024  # larger tiles are compared in cells of so many rows a side; none is left out
CELL_SHINGLES = 1 << 21  # the same for the shingles of a side
HEAVY_AT_MOST = 200_000  # how many shingles go last, told to the tasks (1.6 MB); the order never affects results


def _slices(batches, size: int = 1 << 21):
    """Parts of Arrow batches of about `size` text bytes."""
    for batch in batches:
        column = batch.column("text")
        _, offsets = buffers(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _low_shingles(width: int):
    """The shingles of every text whose hashes are below COUNTED_HASHES, for the common order."""

    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            values, _, _ = shingles(*words(*buffers(batch.column("text"))), width)
            values = values[values < COUNTED_HASHES].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values)], names=["shingle"])

    return run


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a set's bitmap: the next power of two that is twice its size at least, 64 or more."""
    return np.maximum(64, 1 << (np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1))


def parity_bitmap(values: np.ndarray, bits: int) -> bytes:
    """Bit i is the parity of the number of values whose hash falls on i."""
    counts = np.bincount((mix(values) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def fold(bitmap: bytes, size: int) -> np.ndarray:
    """A longer parity bitmap as one of `size` bytes over the same set."""
    rows = np.frombuffer(bitmap, dtype=np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(rows, axis=0)


def _sets(width: int, prefix_percent: int, heavy: np.ndarray):
    """One row per text: size, 128-bit identity, prefix shingles and bitmap of its shingle set."""

    def run(batches):
        import pyarrow as pa

        slot = np.uint64((1 << 22) - 1)
        table = np.zeros(1 << 22, dtype=bool)
        table[(heavy & slot).astype(np.int64)] = True
        for batch in _slices(batches):
            data, offsets = buffers(batch.column("text"))
            values, first, n = shingles(*words(data, offsets), width)
            h1, h2 = _fingerprints(values, first)
            owner = np.repeat(np.arange(len(n)), n)
            late = table[(values & slot).astype(np.int64)]
            at = np.flatnonzero(late)
            late[at] = heavy[np.minimum(np.searchsorted(heavy, values[at]), len(heavy) - 1)] == values[at]
            order = by_owner(2 * owner + late)
            rank = np.arange(len(values)) - first[owner]
            length = n - -(-prefix_percent * n // 100) + 1
            use = rank < length[owner]
            prefix = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.minimum(length, n)))).astype(np.int32)),
                pa.array(values[order][use].view(np.int64)),
            )
            bits = bitmap_bits(n)
            maps = [parity_bitmap(values[first[i] : first[i + 1]], int(bits[i])) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array(n),
                    pa.array(h1),
                    pa.array(h2),
                    prefix,
                    pa.array(maps, pa.binary()),
                ],
                names=["id", "text_key", "n", "h1", "h2", "prefix", "bitmap"],
            )

    return run


def _fingerprints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set: sums over its values."""
    one = np.concatenate(([np.uint64(0)], np.cumsum(mix(values))))
    two = np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))))
    return (one[first[1:]] - one[first[:-1]]).view(np.int64), (two[first[1:]] - two[first[:-1]]).view(np.int64)


def _identities(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            values, first, n = shingles(*words(*buffers(batch.column("text"))), width)
            h1, h2 = _fingerprints(values, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(n), pa.array(h1), pa.array(h2)],
                names=["id", "text_key", "n", "h1", "h2"],
            )

    return run


def _possible(percent: int):
    """Keep the pairs whose bitmaps allow 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
                most = min((int(na[i]) + int(nb[i]) - differ) // 2, int(na[i]), int(nb[i]))
                keep[i] = 100 * most >= percent * (int(na[i]) + int(nb[i]) - most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(keep))

    return run


def _verified(width: int, percent: int):
    """Keep the pairs (a, b, text_a, text_b) that reach the threshold exactly."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sides = []
            for name in ("text_a", "text_b"):
                values, first, n = shingles(*words(*buffers(batch.column(name))), width)
                sides.append((values, first, n))
            (va, fa, na), (vb, fb, nb) = sides
            for i in range(batch.num_rows):
                both = len(np.intersect1d(va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]], assume_unique=True))
                keep[i] = 100 * both >= percent * (int(na[i]) + int(nb[i]) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(keep))

    return run


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by exact intersection."""
    with_texts = texts.toDF("b", "text_b").join(pairs, "b").join(texts.toDF("a", "text_a"), "a")
    return with_texts.select("a", "b", "text_a", "text_b").mapInArrow(_verified(width, percent), "a long, b long")


def _possible_in_cell(ids, n, comp, own, bitmaps: list[bytes], tried: list, percent: int):
    """(i, rows j, upper bounds of the intersections) for rows i of a cell, in the order of n, that must be sorted.

    The rows j come after i, are in another component, may reach the threshold and are not in `tried` of i.
    """
    maps = [np.frombuffer(m, dtype=np.uint8) for m in bitmaps]
    size = np.array([len(m) for m in maps])
    same_part = own.min() == own.max()
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for small in np.unique(size):  # sizes ascend with n: a partner's map is as long or twice as long
        rows = np.flatnonzero(size == small)
        reach = np.arange(rows[0], int(last[rows].max()))
        table = np.stack([fold(maps[j].tobytes(), int(small)) for j in reach]).view(np.uint64)
        for i in rows.tolist():
            j = np.arange(i + 1, last[i])
            j = j[(comp[j] != comp[i]) & (same_part | (own[j] != own[i]))]
            if not len(j):
                continue
            differ = np.bitwise_count(table[j - reach[0]] ^ table[i - reach[0]]).sum(axis=1, dtype=np.int64)
            most = np.minimum((n[i] + n[j] - differ) // 2, n[i])
            ok = 100 * most >= percent * (n[i] + n[j] - most)
            if tried[i]:
                ok &= ~np.isin(ids[j], np.array(tried[i], dtype=np.int64))
            if ok.any():
                yield i, j[ok], most[ok]


def cell_pairs(ids, n, comp, own, bitmaps: list[bytes], tried: list, percent: int, partners: int):
    """(a, b) of the pairs of a cell, in different components, that may reach the threshold and are not in `tried`.

    Every class has at most `partners`, those in other components with the best bounds: first one of each component,
    then second ones and so on.
    """
    order = np.argsort(n, kind="stable")
    ids, n, comp, own = ids[order], n[order], comp[order], own[order]
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for i, j, most in _possible_in_cell(ids, n, comp, own, [bitmaps[k] for k in order], [tried[k] for k in order], percent):
        by_comp = np.lexsort((-most, comp[j]))
        new = np.flatnonzero(np.diff(comp[j[by_comp]], prepend=comp[j[by_comp[0]]] - 1))
        place = np.arange(len(j)) - np.repeat(new, np.diff(np.append(new, len(j))))
        best = by_comp[np.lexsort((-most[by_comp], place))[:partners]]
        out.append((np.full(len(best), ids[i]), ids[j[best]]))
    a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def cell_forest(ids, comp, own, sets: list[np.ndarray], percent: int):
    """(a, b) of links of a cell that connect all of its components that links of the cell connect, none of them twice."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    maps = [parity_bitmap(s, int(bits)) for s, bits in zip(sets, bitmap_bits(n), strict=True)]
    place = {i: k for k, i in enumerate(ids.tolist())}
    tried: list[list] = [[] for _ in ids]
    comp, links, partners = comp.copy(), [], FIRST_PARTNERS
    while True:
        pairs = list(zip(*cell_pairs(ids, n, comp, own, maps, tried, percent, partners), strict=True))
        if not pairs:
            break
        for a, b in pairs:
            i, j = place[int(a)], place[int(b)]
            if comp[i] == comp[j]:  # by now
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (int(n[i]) + int(n[j]) - both):
                links.append((int(a), int(b)))
                comp[comp == comp[j]] = comp[i]
            else:
                tried[i].append(int(b))
                tried[j].append(int(a))
        partners *= 8
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return a, b


def _whole_cells(batches, size: int = 1 << 22):
    """(table, edges) of rows sorted by cell: whole cells together, of about `size` bytes."""
    import pyarrow as pa

    def parts(table):
        cell = table.column("cell").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        step = max(1, int(table.num_rows * size / max(1, table.nbytes)))
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + step, side="right")) - 1)
            yield table.slice(edges[at], edges[to] - edges[at]), edges[at : to + 1] - edges[at]
            at = to

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
        if held and held[-1].column("cell")[-1].as_py() != int(cell[0]):
            yield from parts(pa.Table.from_batches(held))
            held = []
        if cut:
            yield from parts(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from parts(pa.Table.from_batches(held))


def _with_partner(percent: int):
    """Of rows sorted by cell those whose bitmaps allow a link with another component of the cell."""

    def run(batches):
        import pyarrow as pa

        for table, edges in _whole_cells(batches):
            columns = [table.column(c).to_numpy() for c in ("id", "n", "comp", "own")]
            maps = table.column("bitmap").to_pylist()
            keep = np.zeros(table.num_rows, dtype=bool)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                order = lo + np.argsort(columns[1][lo:hi], kind="stable")
                rows = [c[order] for c in columns]
                for i, j, _ in _possible_in_cell(*rows, [maps[k] for k in order], [None] * (hi - lo), percent):
                    keep[order[i]] = True
                    keep[order[j]] = True
            yield from table.select(["cell", "id", "comp", "own"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _forests(width: int, percent: int):
    """Links (a, b) of rows sorted by cell, with texts."""

    def run(batches):
        import pyarrow as pa

        for table, edges in _whole_cells(batches):
            columns = [table.column(c).to_numpy() for c in ("id", "comp", "own")]
            sets = []
            for part in _slices(table.to_batches()):
                values, first, n = shingles(*words(*buffers(part.column("text"))), width)
                sets += [values[first[i] : first[i + 1]] for i in range(len(n))]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    a, b = cell_forest(*[c[lo:hi] for c in columns], sets[lo:hi], percent)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def jaccard_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    with_rows: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle sets;
    component_id is the least doc_id that links lead to. Rows with equal ids are separate documents
    of that id; a null id gets a null component_id unless a linked document has one. Other columns
    are ignored. `with_rows` adds text_key (hash of the text) and `first`: whether (doc_id, text_key) is the
    component's least, null ids last. A text without a word is always first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    counted = rows.where(F.pmod("text_key", F.lit(COUNTED_TEXTS)) == 0).select("text").mapInArrow(_low_shingles(width), "shingle long")
    counted = counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    heavy = counted.orderBy(F.desc("n"), "shingle").limit(HEAVY_AT_MOST).select("shingle").collect()
    heavy = np.sort(np.array([r[0] for r in heavy], dtype=np.int64).view(np.uint64))

    # one narrow row per text, and one wide row per class; neither is written twice
    full = rows.mapInArrow(
        _sets(width, percent, heavy),
        "id long, text_key long, n long, h1 long, h2 long, prefix array<long>, bitmap binary",
    )
    # a class is known by all of its set's identity, so that none loses its prefix to another; its number is given once
    identity = ["h1", "h2", "n"]
    classes = full.where("n > 0").groupBy(*identity).agg(F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"))
    classes = write_once(classes.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")
    numbers = classes.select(*identity, F.col("id").alias("node"))
    sets = rows.mapInArrow(_identities(width), "id long, text_key long, n long, h1 long, h2 long")
    sets = write_once(sets, "shingle-sets")
    least = sets.where("n > 0").groupBy(*identity).agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "text_key")).alias("row"))

    band = F.floor(F.log2("n") / 2)
    postings = classes.select(
        "id", "n", F.explode("prefix").alias("shingle"), band.alias("low"), F.floor(F.log2(F.col("n") * 100 / percent) / 2).alias("high")
    )
    postings = postings.select(
        "id", "n", F.explode(F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))).alias("band"), "shingle"
    ).select("id", F.xxhash64("shingle", "band").alias("tile")).repartition("tile")  # one shuffle for the groups and the join
    same = [F.bit_xor(F.xxhash64("id", F.lit(salt))).alias(f"of_{salt}") for salt in (1, 2)]
    tiles = postings.groupBy("tile").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("leader"), *same).where("k > 1")
    tiles = tiles.groupBy("k", "leader", "of_1", "of_2").agg(F.min("tile").alias("tile")).select("tile", "k", "leader")
    sizes = classes.select("id", "n")
    members = write_once(postings.join(tiles, "tile"), "tiles")

    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    led = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    led = led.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(fits).select("a", "b")
    # texts of classes that occur in a tile with another one: the only ones that can be verified
    ids = members.select("id").distinct()
    none = F.lit(-(2**63))
    home = sets.where("n > 0").groupBy(*identity).agg(F.min(F.struct(F.coalesce("id", none).alias("doc"), "text_key")).alias("home"))
    wanted = numbers.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    home = home.join(wanted, identity).select(F.col("node").alias("id"), "home.doc", "home.text_key")
    texts = rows.select(F.coalesce("id", none).alias("doc"), "text_key", "text").join(home, ["doc", "text_key"])
    texts = texts.groupBy("doc", "text_key").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    texts = write_once(texts.select("id", "text"), "tile-texts")
    maps = classes.select("id", "n", "bitmap")
    led = led.join(maps.toDF("a", "na", "xa"), "a").join(maps.toDF("b", "nb", "xb"), "b")
    led = led.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_possible(percent), "a long, b long")
    # stored, so that its size is known: a short list of pairs is broadcast instead of shuffling the texts
    links = write_once(_verify(write_once(led, "possible-pairs"), texts, width, percent), "links")
    label = components(links)
    # members of tiles that hold several components, in cells of bounded size
    now = members.select("tile", "id").join(label.withColumnRenamed("node", "id"), "id", "left")
    now = now.select("tile", "id", F.coalesce("component", "id").alias("comp")).join(sizes, "id")
    by_comp = now.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    mixed = by_comp.groupBy("tile").agg(
        F.count(F.lit(1)).alias("comps"),
        F.sum("k").alias("k"),
        F.sum("n").alias("all_n"),
        F.max(F.struct("k", "n", "comp")).alias("main"),
    ).where("comps > 1")
    sides = lambda k, n: F.ceil(F.greatest(k / CELL_MEMBERS, n / CELL_SHINGLES))
    # a small tile is one cell; in a large one the main component has parts of its own, compared with all others only
    one = sides(F.col("k"), F.col("all_n")) <= 1
    mixed = mixed.select(
        "tile",
        "main.comp",
        F.when(one, 1).otherwise(sides(F.col("k") - F.col("main.k"), F.col("all_n") - F.col("main.n"))).alias("rest"),
        F.when(one, 0).otherwise(sides(F.col("main.k"), F.col("main.n"))).alias("mains"),
    ).withColumnRenamed("comp", "main")
    now = write_once(now.join(mixed, "tile"), "open-tiles")
    in_main = (F.col("mains") > 0) & (F.col("comp") == F.col("main"))
    own = F.when(in_main, F.col("rest") + F.pmod(F.xxhash64("id"), "mains")).otherwise(F.pmod(F.xxhash64("id"), "rest"))
    others = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    now = now.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    cell = F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other"))
    cells = now.select(cell.alias("cell"), "id", "n", "comp", "own").join(classes.select("id", "bitmap"), "id")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    open_rows = write_once(cells.mapInArrow(_with_partner(percent), "cell long, id long, comp long, own long"), "open-rows")
    full = open_rows.join(texts, "id").select("cell", "id", "comp", "own", "text").repartition("cell").sortWithinPartitions("cell")
    links = links.unionByName(write_once(full.mapInArrow(_forests(width, percent), "a long, b long"), "links"))
    label = components(links)

    named = least.join(numbers, identity).join(label, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("first_row"))
    named = named.join(smallest, "component").select(*identity, "component_id", "first_row")
    out = sets.select("id", "text_key", *identity).join(named, identity, "left")
    row = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("text_key"))
    more = [F.col("text_key"), ((F.col("n") == 0) | (row == F.col("first_row"))).alias("first")] if with_rows else []
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        *more,
    )
