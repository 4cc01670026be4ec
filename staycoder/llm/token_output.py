"""Token ids of whole texts as ORC files: run-length encoded ids, row indexes, Bloom filters on ids.

Layout of a written folder, in ascending document order across and within files:

    doc_id, part int, row_no long, local_start long, n_tokens long, ids array<int>

`part` is the range of document ids that a task wrote; `local_start` counts the ids of the documents
before it in that range. ORC keeps integers run-length encoded in stripes of `stripe_bytes`, each
with minimum and maximum per column and 10,000 rows, and a Bloom filter on doc_id: a reader takes
stripes in parallel and skips those that cannot hold a wanted id or range.

Null text is empty; it has the end id alone. Null ids come first; rows with equal ids stay separate
rows, ordered by text. Other columns are ignored. Text is split at blanks and line feeds before it is
encoded, where the vocabulary's own pattern always splits, and between ASCII letters, digits and marks if that pattern
splits there too: each piece has the same ids anywhere, so a task encodes a piece once, many to a call with a
separator after each. What a task has learnt is dropped when it ends.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staycoder.llm.hashing import buffers
from staycoder.llm.memory import small_batches, tidied
from staycoder.sources.shared import write_once

PIECES_KEPT = 1_000_000  # distinct pieces whose ids a task remembers before it starts anew
SLICE_BYTES = 4 << 20
JOINED = 256  # pieces encoded as one text
SEPARATOR = "0"  # pieces that hold it are encoded one by one
RANGE_BYTES = 256 << 20  # text of one range of ids, and so of one file

# fixed value: a pre-tokenizer pattern that separates letters, single digits and runs of marks
LETTERS_DIGITS_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _BLANK = range(6)  # kinds of bytes; all but the first are ASCII
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[0x21:0x7F] = _MARK
_KINDS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
_KINDS[[b for b in range(128) if chr(b).isdigit()]] = _DIGIT
_KINDS[ord("'")] = _APOSTROPHE
_KINDS[[ord(" "), ord("\n")]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _borders(pairs) -> np.ndarray:
    """Whether a piece starts at a byte, by 8 * the kind before + its kind."""
    table = np.zeros(64, dtype=bool)
    for kind in (_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE):
        table[_BLANK << 3 | kind] = True
    for before, kind in pairs:
        table[before << 3 | kind] = True
    return table


_BLANKS = _borders([])
# a mark run that ends in an apostrophe stays with what follows: 's and the like are tokens
_BORDERS = _borders(
    [(a, b) for a in (_LETTER, _DIGIT) for b in (_MARK, _APOSTROPHE)]
    + [(_MARK, _LETTER), (_MARK, _DIGIT), (_LETTER, _DIGIT), (_DIGIT, _LETTER)]
)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_marks(tokenizer) -> bool:
    """Whether the vocabulary's own pattern ends a token between an ASCII letter or digit and a mark."""
    first = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    return first.get("type") == "Split" and first["pattern"].get("Regex") == LETTERS_DIGITS_MARKS


def ignores_case(tokenizer) -> bool:
    """Whether the vocabulary lower-cases every text."""
    normalizer = json.loads(tokenizer.to_str())["normalizer"] or {}
    return any(n.get("type") == "Lowercase" for n in normalizer.get("normalizers", [normalizer]))


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    `pieces` may only be used with vocabularies that drop white space and never join across it.
    """

    def __init__(self, path: str, pieces: bool = True):
        self.tokenizer = load_tokenizer(path)
        self.pieces, self.marks, self.fold = pieces, splits_marks(self.tokenizer), ignores_case(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = mark[0] if len(mark) == 1 else None
        self.forget()

    @staticmethod
    def of_worker(path: str, pieces: bool = True) -> "Encoder":
        """The Python worker's encoder: the vocabulary stays loaded for its later tasks."""
        import sys
        import types

        kept = sys.modules.setdefault("_staycoder_encoders", types.ModuleType("_staycoder_encoders")).__dict__
        if (path, pieces) != kept.get("made_for"):
            kept["encoder"], kept["made_for"] = Encoder(path, pieces), (path, pieces)
        return kept["encoder"]

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)  # where the ids of each known piece begin, and where the last ones end

    def _ids(self, texts: list[str], at_once: int = 4_000):
        """(ids one after another, number of ids of each text)."""
        flat, n = [np.zeros(0, dtype=np.int32)], []
        for i in range(0, len(texts), at_once):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
            n.extend(map(len, encoded))
            flat.append(np.fromiter(itertools.chain.from_iterable(encoded), dtype=np.int32))
        return np.concatenate(flat), np.array(n, dtype=np.int64)

    def _joined_ids(self, pieces: list[str], at_once: int = 16):
        """As `_ids`, of pieces without the separator. If other ids equal its id, they are encoded one by one."""
        ends = f" {SEPARATOR} "
        texts = [ends.join(pieces[i : i + JOINED]) + ends for i in range(0, len(pieces), JOINED)]
        flat, _ = self._ids(texts, at_once)
        last = np.flatnonzero(flat == self.separator)
        if len(last) != len(pieces):
            return self._ids(pieces)
        return flat[flat != self.separator], np.diff(last, prepend=-1) - 1

    def _learn(self, fresh: list[str]) -> None:
        joined = [] if self.separator is None else [piece for piece in fresh if SEPARATOR not in piece]
        alone = fresh if self.separator is None else [piece for piece in fresh if SEPARATOR in piece]
        fresh = joined + alone
        ids, n = map(np.concatenate, zip(self._joined_ids(joined), self._ids(alone), strict=True))
        old, end = len(self.known), int(self.starts[len(self.known)])
        self.known.update(zip(fresh, range(old, old + len(fresh)), strict=True))
        self.ids = _grown(self.ids, end + len(ids))
        self.ids[end : end + len(ids)] = ids
        self.starts = _grown(self.starts, old + len(fresh) + 1)
        self.starts[old + 1 : old + len(fresh) + 1] = end + np.cumsum(n)

    def _split(self, texts):
        """Pieces of the texts, one after another, and the number of pieces before each text and after the last.

        No composed character crosses a border of two ASCII characters. A text that holds an added token of the
        vocabulary, in any case, is split at blanks only.
        """
        import pyarrow as pa

        data, offsets = buffers(texts)
        kind = _KINDS[data]
        whole = self._with_added_tokens(texts, data, offsets) if self.fold or self.marks else None
        lower = _LOWER[data] if self.fold else data
        if whole is not None:
            bytes_of = np.repeat(whole, np.diff(offsets))
            kind[bytes_of & (kind != _BLANK)] = _OTHER
            lower = np.where(bytes_of, data, lower)
        before = np.empty_like(kind)
        before[1:] = kind[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = _BLANK
        starts = (_BORDERS if self.marks else _BLANKS)[before << 3 | kind]
        kept = kind != _BLANK
        at = np.flatnonzero(starts[kept])
        ends = np.append(at, np.count_nonzero(kept)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(lower[kept])])
        return pieces, np.searchsorted(np.flatnonzero(starts), offsets)

    def _with_added_tokens(self, texts, data: np.ndarray, offsets: np.ndarray):
        """Which texts hold an added token in any case; None if none does. Its marks have to occur as they are."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            marks = [c for c in token.encode() if _KINDS[c] in (_MARK, _APOSTROPHE)]
            rows = np.arange(len(texts))
            for mark in set(marks):
                rows = np.intersect1d(rows, np.searchsorted(offsets, np.flatnonzero(data == mark), side="right") - 1)
            if len(rows):
                holds = pc.match_substring(texts.take(pa.array(rows)), token, ignore_case=True)
                found[rows] |= holds.fill_null(False).to_numpy(zero_copy_only=False)
        return found if found.any() else None

    def encode(self, texts):
        """Of a pyarrow string array: (ids one after another, number of ids of each text)."""
        if not self.pieces:
            return self._ids(texts.to_pylist(), 64)
        split, edges = self._split(texts)
        coded = split.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > PIECES_KEPT:
            self.forget()
        self._learn([name for name in names if name not in self.known])
        place = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        piece = place[coded.indices.to_numpy()] if len(names) else np.zeros(0, dtype=np.int64)
        length = self.starts[piece + 1] - self.starts[piece]
        ends = np.concatenate(([0], np.cumsum(length)))
        # 32 bits do: a slice has less than 2**31 ids, and so has a task's store of them
        at = np.repeat((self.starts[piece] - ends[:-1]).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], np.diff(ends[edges])


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of at least twice its length with the same beginning."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    out[: len(array)] = array
    return out


def _slices(batch, size: int):
    """Parts of a batch of about `size` text bytes, one row at least."""
    import pyarrow.compute as pc

    lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _tokenize(path: str, end_id: int, pieces: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part = Encoder.of_worker(path, pieces), TaskContext.get().partitionId()
        row_no = start = 0
        try:
            for batch in batches:
                for rows in _slices(batch, SLICE_BYTES):
                    ids, n = encoder.encode(rows.column("text"))
                    offsets = np.concatenate(([0], np.cumsum(n + 1)))
                    flat = np.full(offsets[-1], end_id, dtype=np.int32)
                    of_text = np.ones(offsets[-1], dtype=bool)
                    of_text[offsets[1:] - 1] = False
                    flat[of_text] = ids
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("doc_id"),
                            pa.array(np.full(len(n), part, dtype=np.int32)),
                            pa.array(row_no + np.arange(len(n))),
                            pa.array(start + offsets[:-1]),
                            pa.array(n + 1),
                            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                        ],
                        names=["doc_id", "part", "row_no", "local_start", "n_tokens", "ids"],
                    )
                    row_no, start = row_no + len(n), start + int(offsets[-1])
        finally:
            encoder.forget()

    return tidied(run)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    pieces: bool = True,
    ranges: int | None = None,
    stripe_bytes: int = 16 << 20,
) -> None:
    """Write the ids of every text, with `end_id` appended, to the ORC folder `path`.

    Texts are dealt into `ranges` id ranges of about equal row counts (default: one for RANGE_BYTES of text, and
    two for every core at least) and encoded after that, so that only texts are shuffled and each is encoded once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(-(-size // RANGE_BYTES), 2 * spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = ordered.mapInArrow(
        _tokenize(tokenizer, end_id, pieces),
        f"doc_id {kind}, part int, row_no long, local_start long, n_tokens long, ids array<int>",
    )
    writer = tokens.write.mode("errorifexists").option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd")
    with small_batches(spark):
        writer.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").orc(path)


def _checksum(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("ids")
        flat = ids.values.to_numpy().astype("<u4")
        edges = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("doc_id", "part", "local_start")]
        columns += [pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """The stored rows; a condition on doc_id reaches the files' indexes and Bloom filters."""
    stored = spark.read.orc(path)
    return stored if where is None else stored.where(where)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (little-endian unsigned 32-bit ids), read from the files.

    `start` counts all ids of earlier documents: one total per range is summed over the ranges before.
    """
    stored = spark.read.orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("doc_id", "part", "local_start", "ids").mapInArrow(
        tidied(_checksum), f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long"
    )
    with small_batches(spark):
        rows = write_once(rows, "token-index")
    return rows.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )
