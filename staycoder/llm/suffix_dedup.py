"""Removal of byte strings that occur more than once: a depth-limited radix sort of all suffixes.

A document's suffixes are ordered only through `width` bytes, most significant digit first; every
pass groups by the digits read so far and drops groups of one, so what is left after the last pass
are exactly the repeated windows. Digits are chosen so that a pass needs few rows:

1. the window's anchor: of its 40-byte strings the one with the least fingerprint. Neighbouring windows
   share theirs, so a *run* of windows (about 80) is one row; runs with a unique anchor are dropped;
2. the run's whole stretch of text: equal runs are repeated throughout. Only anchors whose runs differ,
   because a repeated passage begins or ends there, go on, with one run of each kind;
3. for each block of 16 windows of such a run, the 185 bytes that all of them share;
4. what a single window adds to them: at most 15 bytes, compared as they are.

Digits 1 to 3 are 64-bit fingerprints (each pass adds to the ones before), digit 4 is bytes.
Every pass is a grouping with partial sums or a join that Spark can split, so a passage that a third of
all documents share is no hot spot. Texts are shuffled once and that exchange serves both later reads.

Null text is empty; texts under `width` bytes lose nothing. Rows are told apart by (doc_id, text), so
null or repeated ids are allowed; of repeated rows both repeat. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.llm.hashing import Running, buffers, mix
from staycoder.sources.shared import write_once

ANCHOR = 40
BLOCK = 16
PIECE = 1 << 20
_POSITION_BITS = np.uint64(30)


def pieces(offsets: np.ndarray, width: int):
    """(first text, last text + 1, first window, last window + 1 or None) of at most about PIECE bytes.

    Whole texts go together; a longer text is cut at multiples of PIECE windows, the same ones
    wherever the text stands.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > PIECE:
            for start in range(0, size - width + 1, PIECE):
                yield i, i + 1, start, min(start + PIECE, size - width + 1)
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        yield i, max(j, i + 1), 0, None
        i = max(j, i + 1)


def find_runs(data: np.ndarray, offsets: np.ndarray, width: int):
    """Yield (text number, first window, number of windows, anchor place, anchor digit, run digit) arrays.

    Places are in bytes from the start of the text. Windows with the same anchor place are a run.
    """
    reach = width - ANCHOR + 1
    for lo, hi, first, last in pieces(offsets, width):
        base = offsets[lo] + first
        stop = offsets[hi] if last is None else offsets[lo] + last + width - 1
        part = data[base:stop]
        starts = (offsets[lo:hi] if last is None else np.array([base])) - base
        lengths = np.diff(np.append(starts, stop - base))
        sums = Running(part)
        grams = mix(sums.windows(ANCHOR))
        n = len(grams) - reach + 1
        if n <= 0:
            continue
        key = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        table = np.concatenate([key, np.full(-len(key) % reach, np.iinfo(np.uint64).max)]).reshape(-1, reach)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])
        anchor = (least & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
        text = np.repeat(np.arange(len(starts)), lengths)[:n]
        inside = np.arange(n) + width <= (starts + lengths)[text]
        new = np.ones(n, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        begin, end = begin[inside[begin]], end[inside[begin]]
        if not len(begin):
            continue
        at = anchor[begin]
        run = mix(sums.of(begin, end - 1 + width) + mix((at - begin).astype(np.uint64) * np.uint64(1024) + (end - begin).astype(np.uint64)))
        own = starts[text[begin]] - first
        yield lo + text[begin], begin - own, end - begin, at - own, grams[at], run


def _runs(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key = batch.column("key").to_numpy()
            data, offsets = buffers(batch.column("text"))
            for text, begin, n, _, gram, whole in find_runs(data, offsets, width):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(key[text]),
                        pa.array(begin * 256 + n),
                    ],
                    names=["g", "r", "key", "place"],
                )

    return run


def _units(width: int):
    """Blocks of windows of the runs listed in `todo`: shared bytes as a fingerprint, the rest as bytes."""
    rest = width - ANCHOR  # an anchor has this many bytes of its window around it

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("todo")))
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            data, offsets = buffers(batch.column("text"))
            todo = batch.column("todo")
            wanted = todo.flatten()
            owner = np.repeat(np.arange(batch.num_rows), todo.value_lengths().to_numpy())
            wanted_place = owner * (1 << 40) + wanted.field("place").to_numpy()
            order = np.argsort(wanted_place)
            wanted_place = wanted_place[order]
            single = wanted.field("single").to_numpy(zero_copy_only=False)[order]
            for text, begin, n, anchor, _, _ in find_runs(data, offsets, width):
                place = text * (1 << 40) + begin * 256 + n
                slot = np.minimum(np.searchsorted(wanted_place, place), len(wanted_place) - 1)
                use = np.flatnonzero(wanted_place[slot] == place)
                if not len(use):
                    continue
                text, begin, n, anchor, slot = text[use], begin[use], n[use], anchor[use], slot[use]
                low, high = anchor - begin - n + 1, anchor - begin  # bytes left of the anchor, by window
                blocks = high // BLOCK - low // BLOCK + 1
                row = np.repeat(np.arange(len(use)), blocks)
                ends = np.cumsum(blocks)
                block = low[row] // BLOCK + np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
                from_e = np.maximum(low[row] - block * BLOCK, 0)
                to_e = np.minimum(high[row] - block * BLOCK, BLOCK - 1)
                core = offsets[text[row]] + anchor[row] - block * BLOCK
                core_end = core + ANCHOR + rest - BLOCK + 1
                floor, ceiling = int((core - to_e).min()), int((core_end + BLOCK - 1).max())
                sums = Running(data[floor:ceiling], 1)
                digit = mix(sums.of(core - floor, core_end - floor) + mix(block.astype(np.uint64)))
                raw = data[floor:ceiling].tobytes()
                left = [raw[c - e : c] for c, e in zip((core - floor).tolist(), to_e.tolist())]
                right = [
                    raw[c : c + BLOCK - 1 - e] for c, e in zip((core_end - floor).tolist(), from_e.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit.view(np.int64)),
                        pa.array(key[text[row]]),
                        pa.array((anchor[row] - block * BLOCK).astype(np.int64)),
                        pa.array(single[slot[row]]),
                        pa.array(from_e.astype(np.int32)),
                        pa.array(to_e.astype(np.int32)),
                        pa.array(left, pa.binary()),
                        pa.array(right, pa.binary()),
                    ],
                    names=["core", "key", "core_at", "single", "from_e", "to_e", "left", "right"],
                )

    return run


def _cut(width: int):
    """Remaining bytes of each text, given `places` = first window * 256 + number of windows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            places = batch.column("places")
            n_removed, n_spans, digests, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                removed = spans = 0
                if places[i].is_valid:
                    place = places[i].values.to_numpy()
                    edge = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(edge, place // 256, 1)
                    np.add.at(edge, place // 256 + place % 256 - 1 + width, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                n_removed.append(removed)
                n_spans.append(spans)
                raw = text.tobytes()
                digests.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def repeated_places(keyed: DataFrame, width: int = 200) -> DataFrame:
    """(key, place) of all windows of `keyed` (key, text, ...) that occur more than once.

    place = first window * 256 + number of windows, in bytes from the start of the text.
    """
    runs = keyed.select("key", "text").mapInArrow(_runs(width), "g long, r long, key long, place long")
    several = runs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    runs = write_once(runs.join(several, "g"), "repeated-anchors")

    kinds = runs.groupBy("g", "r").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one"))
    equal = runs.join(kinds.where("n > 1").select("g", "r"), ["g", "r"], "left_semi").select("key", "place")
    differing = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("g")
    open_runs = kinds.join(differing, "g").select("one.key", "one.place", (F.col("n") == 1).alias("single"))
    todo = open_runs.groupBy("key").agg(F.collect_list(F.struct("place", "single")).alias("todo"))

    units = keyed.join(todo, "key", "left").mapInArrow(
        _units(width),
        "core long, key long, core_at long, single boolean, from_e int, to_e int, left binary, right binary",
    )
    units = write_once(units, "open-blocks")
    shared = units.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    e = F.col("e")
    windows = (
        units.join(shared, "core")
        .withColumn("e", F.explode(F.sequence("from_e", "to_e")))
        .select(
            "core",
            "key",
            (F.col("core_at") - e).alias("at"),
            "single",
            F.xxhash64(
                e,
                F.expr("substring(left, length(left) - e + 1, e)"),
                F.expr(f"substring(right, 1, {BLOCK - 1} - e)"),
            ).alias("more"),
        )
    )
    twice = windows.groupBy("core", "more").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    partly = windows.where("single").join(twice.select("core", "more"), ["core", "more"], "left_semi")
    return equal.unionByName(partly.select("key", (F.col("at") * 256 + 1).alias("place")))


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Every byte covered by a `width`-byte string that also starts anywhere else, in this or another
    document, is removed; strings are judged on the input. `width` is 56 to 255 bytes.
    """
    if not ANCHOR + BLOCK <= width <= 255:
        raise ValueError(f"width must be from {ANCHOR + BLOCK} to 255 bytes")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    places = repeated_places(keyed, width)
    per_document = places.groupBy("key").agg(F.collect_set("place").alias("places"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return keyed.join(per_document, "key", "left").mapInArrow(
        _cut(width),
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
