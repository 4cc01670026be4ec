"""Which quality filter removes what: five filters audited in all 120 orders over whole texts.

Texts are read once as UTF-8 bytes by a table-driven transducer: its state says whether the byte before
was inside a word, and the table gives for (state, byte) the actions to take: a word starts, a word ends, a
code point, a capital or a symbol is counted. Word spans go into an open-addressed hash table, whose hits
count only after their bytes are compared; what it holds in the end are the distinct words.

A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * capitals > 10 * code points.
D: a symbol of `#$%&*|`. E: the text of a smaller id. Words are `[^\\x20\\x09-\\x0D]+`, case-sensitive.

Null texts are empty (and equal to each other), a null part is the empty string. A null id is larger than
any other, and null ids are equal; of rows that repeat an id none is smaller than another. A document is good or
toxic if any label row with its id says so. An empty table gives no rows. Other columns are ignored. Equal texts are
found by a 128-bit digest. Memory: blocks of a MiB, a longer text by blocks cut at white space.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.llm.hashing import Running, buffers, mix
from staycoder.sources.shared import write_once

FILTERS = "ABCDE"
BLOCK = 1 << 20
STARTS, ENDS, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(next state by byte, actions by state * 256 + byte)."""
    byte = np.arange(256)
    inside = ~np.isin(byte, [0x20, *range(0x09, 0x0E)])
    actions = np.zeros((2, 256), dtype=np.uint8)
    actions[0, inside] |= STARTS
    actions[1, ~inside] |= ENDS
    actions[:, (byte & 0xC0) != 0x80] |= POINT
    actions[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    actions[:, np.isin(byte, list(b"#$%&*|"))] |= SYMBOL
    return inside.astype(np.uint16), actions.reshape(-1)


NEXT, ACTIONS = _table()


def transduce(data: np.ndarray, offsets: np.ndarray):
    """(word starts, word ends, code points, capitals, symbols): the last three per text."""
    state = np.zeros(len(data) + 1, dtype=np.uint16)
    state[1:] = NEXT[data]
    last = state[offsets[1:]]  # state after the last byte of each text
    state[offsets] = 0
    did = ACTIONS[state[:-1] * 256 + data]
    start = np.flatnonzero(did & STARTS)
    closing = np.unique(offsets[1:][(last == 1) & (np.diff(offsets) > 0)])
    stop = np.sort(np.concatenate([np.flatnonzero(did & ENDS), closing]))
    counts = []
    for action in (POINT, CAPITAL, SYMBOL):
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(did & action > 0, out=total[1:])
        counts.append(total[offsets[1:]] - total[offsets[:-1]])
    return start, stop, *counts


def _equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] == data[b:b+length], for each of many spans of at least one byte."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    first = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(first, length)
    same = data[np.repeat(a, length) + step] == data[np.repeat(b, length) + step]
    return np.logical_and.reduceat(same, first)


def first_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, owner: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """True for the spans that are the first of their owner with their bytes.

    Open addressing in rounds: every open span looks at its slot; free slots go to the first that asks; who
    meets an equal span is settled, who meets another moves on by one. Equal spans move together.
    """
    n = len(start)
    length = stop - start
    if key is None:
        key = Running(data).of(start, stop) + length.astype(np.uint64)
    bits = max(4, int(2 * n).bit_length())
    place = (mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    ask = np.arange(n)
    while len(ask):
        at = place[ask]
        free = np.flatnonzero(table[at] < 0)[::-1]
        table[at[free]] = ask[free]  # the first that asks is written last
        held = table[at]
        new[ask[held == ask]] = True
        alike = (held != ask) & (key[held] == key[ask]) & (owner[held] == owner[ask]) & (length[held] == length[ask])
        check = np.flatnonzero(alike)
        alike[check] = _equal_spans(data, start[ask[check]], start[held[check]], length[ask[check]])
        ask = ask[~(alike | (held == ask))]
        place[ask] = (place[ask] + 1) & ((1 << bits) - 1)
    return new


def count_texts(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text of a batch."""
    n = len(offsets) - 1
    out = {name: np.zeros(n, dtype=np.int64) for name in ("words", "distinct", "capitals", "code_points", "symbols")}

    def add(first: int, cuts: np.ndarray, piece: np.ndarray, seen: set | None = None) -> None:
        start, stop, points, capitals, symbols = transduce(piece, cuts)
        owner = np.searchsorted(cuts, start, side="right") - 1
        new = first_spans(piece, start, stop, owner)
        here = slice(first, first + len(cuts) - 1)
        out["words"][here] += np.bincount(owner, minlength=len(cuts) - 1)
        if seen is None:
            out["distinct"][here] += np.bincount(owner[new], minlength=len(cuts) - 1)
        else:  # a piece of a long text: its distinct words are merged by their bytes
            raw = piece.tobytes()
            seen.update(raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True))
        out["code_points"][here] += points
        out["capitals"][here] += capitals
        out["symbols"][here] += symbols

    at = 0
    while at < n:
        if offsets[at + 1] - offsets[at] > block:
            text = data[offsets[at] : offsets[at + 1]]
            spaces = np.flatnonzero(NEXT[text] == 0)
            seen: set[bytes] = set()
            low = 0
            while low < len(text):
                k = np.searchsorted(spaces, low + block)
                high = int(spaces[k]) + 1 if k < len(spaces) else len(text)
                add(at, np.array([0, high - low]), text[low:high], seen)
                low = high
            out["distinct"][at] = len(seen)
            at += 1
        else:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
            add(at, offsets[at : stop + 1] - offsets[at], data[offsets[at] : offsets[stop]])
            at = stop
    return out


def failed(words, distinct, capitals, code_points, symbols) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    fails = (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * code_points, symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _facts(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        counts = count_texts(data, offsets)
        raw = memoryview(np.ascontiguousarray(data))
        digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(failed(**counts).astype(np.int32))]
        columns += [pa.array(counts[name]) for name in counts]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "digest", "fails", *counts])


def text_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: id, part, digest of the text, bits of the failed filters A to D, and the counts."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").alias("text"),
    )
    counts = "words long, distinct long, capitals long, code_points long, symbols long"
    return rows.mapInArrow(_facts, f"id long, part string, digest binary, fails int, {counts}")


def _steps(spark) -> DataFrame:
    """(filter_order, step, fails): what happens in this step to a document with these failures (19,200 rows)."""
    rows = []
    for order in permutations(range(5)):
        for step, mine in enumerate(order, 1):
            before = sum(1 << f for f in order[: step - 1])
            for fails in range(32):
                has, gone = fails >> mine & 1, fails & before > 0
                rows.append((
                    "".join(FILTERS[f] for f in order), step, fails,
                    int(not gone and not has), int(has and not gone), int(has and gone), int(fails == 1 << mine),
                    has * 120 // fails.bit_count() if fails else 0,
                ))  # of the filters a document fails each comes first in an equal share of the orders
    schema = "filter_order string, step int, fails int, kept int, removed int, redundant int, only int, share int"
    return spark.createDataFrame(rows, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, see the module.

    Equal rows are counted before anything is joined; the first of equal texts is found by joining each text's
    least id on (digest, id), so that a text with many copies is no hot key. Only counts by part and
    failures, at most 32 a part, meet the constant table of orders.
    """
    spark = docs.sparkSession
    facts = text_facts(docs, doc_id, text, part).groupBy("digest", "id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    facts = write_once(facts, "filter-facts")
    least = facts.groupBy("digest").agg(F.min("id").alias("_id")).withColumnRenamed("digest", "_digest")
    first = (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    rows = facts.join(least, first, "left").join(marks, F.col("id") == F.col("_label_id"), "left")
    fails = F.col("fails") + F.when(F.col("_digest").isNull(), 16).otherwise(0)
    counts = rows.groupBy("part", fails.alias("fails")).agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * coalesce(good, 0)")).alias("good"), F.sum(F.expr("n * coalesce(toxic, 0)")).alias("toxic")
    )
    steps = counts.join(F.broadcast(_steps(spark)), "fails")
    sums = {
        "kept": "n * kept", "removed": "n * removed", "redundant": "n * redundant", "unique_fails": "n * only",
        "good_lost": "good * removed", "toxic_lost": "toxic * removed", "shapley": "n * share",
    }
    return steps.groupBy("part", "filter_order", "step").agg(*(F.sum(F.expr(e)).alias(name) for name, e in sums.items()))
