"""Benchmark decontamination by latent semantic retrieval.

1. *Space.* Words are hashed to `buckets`. Every 48-word passage of the corpus is a row of counts C. One
   pass gives each bucket's passage count and its row of C'C times a seeded Gaussian matrix; that is
   enough for a randomised (Nystroem) singular value decomposition of the TF-IDF matrix C * idf,
   since idf only scales rows of the sketch. Tasks send buckets x sketch numbers each, summed by bucket.
2. *Candidates.* Benchmark items become chunks of at most 32 words, texts windows of 48 words every
   16 words, so every chunk that occurs lies within some window. Both are sums of latent word
   vectors, coordinates divided by the singular values; the `skipped` strongest directions, which only tell
   languages and frequent words apart, are left out. A chunk of n words makes up n/48 of a window that
   holds it, so pairs with a cosine of at least `cosine` * sqrt(n / 48) go on.
   All windows of all texts meet all items of the stated benchmark, in blocks.
3. *Exact candidates.* A cosine is no proof of absence, so two lookups find what the proof accepts whatever
   its cosine. A passage with `copied` of an item's n words lacks n - ceil(copied * n) at most, so it has one
   of any n - ceil(copied * n) + 1 of them: the rarest are looked up. Less than `copied` needs the answer,
   which is looked up as a whole. Nothing is missed whose words are shifted against each other by up to
   `REACH` words (words put in or left out between them).
4. *Proof.* The item and the words around the place are compared by longest common subsequence. A
   document is contaminated if it has `copied` of an item's words in order, or `paraphrased` of
   them and the item's answer (its last `answer_words` words) as they stand.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Items with fewer than
`min_words` words, and null ones, are never matched; null and empty texts match nothing. The corpus is
read twice and never shuffled. The benchmark may have `max_items` items (more raise ValueError): it is
sent to every task. Columns of the documents are kept; a column named like the result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from staycoder.llm.hashing import BASE, buffers, mix, words
from staycoder.llm.memory import tidied

STEP = 16
WINDOW = 3 * STEP
CHUNK = 2 * STEP
MATCH = "array<struct<item_id:long,lcs:double,cosine:double,answer:boolean>>"


@dataclass(frozen=True)
class LeakConfig:
    buckets: int = 1 << 14
    sketch: int = 80
    skipped: int = 8
    rank: int = 64
    cosine: float = 0.55
    copied: float = 0.8
    paraphrased: float = 0.6
    answer_words: int = 5
    min_words: int = 8
    max_items: int = 20_000
    seed: int = 7


def _slices(batches, column: str, size: int = 1 << 20):
    for batch in batches:
        _, offsets = buffers(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _steps(first: np.ndarray):
    """Cut each text's words into stretches of STEP: (start of each stretch, first stretch of each text)."""
    n = -(-np.diff(first) // STEP)
    edges = np.concatenate(([0], np.cumsum(n)))
    local = np.arange(edges[-1]) - np.repeat(edges[:-1], n)
    return np.repeat(first[:-1], n) + local * STEP, edges


def _row_sums(table: np.ndarray, rows: np.ndarray, starts: np.ndarray, at_once: int = 8192) -> np.ndarray:
    """Sums of table[rows] between consecutive starts, in parts small enough for the processor's cache."""
    out = np.empty((len(starts), table.shape[1]), dtype=table.dtype)
    ends = np.append(starts[1:], len(rows))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + at_once, side="right")))
        out[i:j] = np.add.reduceat(table.take(rows[starts[i] : ends[j - 1]], axis=0), starts[i:j] - starts[i], axis=0)
        i = j
    return out


def _gaussian(config: LeakConfig) -> np.ndarray:
    return np.random.default_rng(config.seed).standard_normal((config.buckets, config.sketch), dtype=np.float32)


def _sketch(config: LeakConfig, text: str):
    def run(batches):
        import pyarrow as pa

        omega = _gaussian(config)
        total = np.zeros((config.buckets, config.sketch))
        df = np.zeros(config.buckets, dtype=np.int64)
        n_passages = 0
        for batch in _slices(batches, text):
            hashes, first = words(*buffers(batch.column(text)), marks=True)
            if not len(hashes):
                continue
            bucket = (hashes & np.uint64(config.buckets - 1)).astype(np.int64)
            n = -(-np.diff(first) // WINDOW)
            edges = np.concatenate(([0], np.cumsum(n)))
            owner = np.repeat(np.arange(len(n)), np.diff(first))
            passage = edges[owner] + (np.arange(len(bucket)) - first[owner]) // WINDOW
            n_passages += int(edges[-1])
            starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
            pair = np.sort(passage * config.buckets + bucket)
            pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
            df += np.bincount(pair % config.buckets, minlength=config.buckets)
            projected = _row_sums(omega, bucket, starts)
            order = np.argsort(bucket.astype(np.uint16 if config.buckets <= 1 << 16 else np.int64), kind="stable")
            ranked = bucket[order]
            heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            total[ranked[heads]] += _row_sums(projected, passage[order], heads)
        used = np.flatnonzero(df)
        columns = [pa.array(used.astype(np.int32)), pa.array(df[used]), pa.array(np.full(len(used), 0) + 0)]
        columns[2] = pa.array(np.where(np.arange(len(used)) == 0, n_passages, 0))
        columns += [pa.array(total[used, j]) for j in range(config.sketch)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "df", "passages", *[f"y{j}" for j in range(config.sketch)]])

    return run


def latent_words(docs: DataFrame, config: LeakConfig = LeakConfig(), text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """buckets x rank, what a word of a bucket adds to a passage's latent vector, and each bucket's passage count.

    The driver gets one number per bucket and sketch column, whatever the size of the corpus.
    """
    names = [f"y{j}" for j in range(config.sketch)]
    schema = "bucket int, df long, passages long, " + ", ".join(f"{c} double" for c in names)
    parts = docs.select(text).mapInArrow(_sketch(config, text), schema)
    sums = parts.groupBy("bucket").agg(F.sum("df"), F.sum("passages"), *[F.sum(c) for c in names]).toArrow()
    out = np.zeros((config.buckets, config.rank), dtype=np.float32)
    df = np.zeros(config.buckets, dtype=np.int64)
    if not sums.num_rows:
        return out, df
    bucket = sums.column(0).to_numpy()
    df[bucket] = sums.column(1).to_numpy()
    idf = np.log1p(sums.column(2).to_numpy().sum() / sums.column(1).to_numpy())
    y = np.stack([sums.column(3 + j).to_numpy() for j in range(config.sketch)], axis=1)
    core = _gaussian(config)[bucket].astype(np.float64).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    sound = values > values.max() * 1e-10
    half = (idf[:, None] * y) @ (vectors[:, sound] / np.sqrt(values[sound]))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    found = int((singular > singular[0] * 1e-8).sum())
    skipped = min(config.skipped, max(0, found - config.rank))
    use = slice(skipped, min(found, skipped + config.rank))
    out[bucket, : use.stop - use.start] = idf[:, None] * left[:, use] / singular[use]
    return out, df


@dataclass
class Item:
    item_id: int
    words: list[int]
    places: dict[int, int]

    @staticmethod
    def of(item_id: int, hashes: np.ndarray) -> "Item":
        places: dict[int, int] = {}
        listed = hashes.tolist()
        for i, word in enumerate(listed):
            places[word] = places.get(word, 0) | 1 << i
        return Item(item_id, listed, places)

    def common(self, span: list[int]) -> int:
        """Length of the longest common subsequence with `span` (bits of one integer are a row of it)."""
        full = (1 << len(self.words)) - 1
        row = full
        get = self.places.get
        for word in span:
            here = get(word)
            if here:
                hit = row & here
                row = ((row + hit) | (row - hit)) & full
        return len(self.words) - row.bit_count()

    def answered(self, span: list[int], n: int) -> bool:
        last = self.words[-n:]
        return any(span[i : i + len(last)] == last for i in range(len(span) - len(last) + 1))


def _append(columns: tuple[list, list, list], *values: int) -> None:
    for column, value in zip(columns, values, strict=True):
        column.append(value)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every n words in a row, by the first."""
    out = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * BASE + hashes[k : k + len(out)]
    return mix(out)


class Lookup:
    """Keys (words, or runs of words) and where in which items they stand."""

    def __init__(self, keys: list[int], item: list[int], at: list[int]):
        order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
        self.keys, self.first = np.unique(np.array(keys, dtype=np.uint64)[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.at = np.array(item, dtype=np.int64)[order], np.array(at, dtype=np.int64)[order]
        self.slots = np.zeros(1 << 16, dtype=bool)
        self.slots[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray):
        """(place in `hashes`, item, place in the item) of every occurrence of a key."""
        place = np.flatnonzero(self.slots[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, hashes[place]), len(self.keys) - 1)
        same = self.keys[key] == hashes[place]
        place, key = place[same], key[same]
        n = self.first[key + 1] - self.first[key]
        entry = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.item[entry], self.at[entry]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


REACH = WINDOW  # words by which an edited item's words may be shifted against each other
ITEMS_AT_ONCE = 256


class Block:
    """Some items of the benchmark: their chunks as unit vectors, and which word is which of an item's words."""

    def __init__(self, items: list[Item], table: np.ndarray, df: np.ndarray, config: LeakConfig):
        self.items = items
        number, at, share, vectors = [], [], [], []
        for i, item in enumerate(items):
            bucket = (np.array(item.words, dtype=np.uint64) & np.uint64(len(table) - 1)).astype(np.int64)
            last = max(0, len(bucket) - CHUNK)
            for start in sorted({*range(0, last, STEP), last}):
                number.append(i)
                at.append(start)
                share.append(min(len(bucket), CHUNK) / WINDOW)
                vectors.append(table[bucket[start : start + CHUNK]].sum(axis=0))
        self.number, self.at = np.array(number), np.array(at)
        self.share, self.vectors = np.array(share, dtype=np.float32), _unit(np.array(vectors)).astype(np.float32)
        self.length = np.array([len(i.words) for i in items])
        self.vocabulary = np.unique(np.array([w for i in items for w in i.words], dtype=np.uint64))
        # slot 0: not a word of the item; slots count an item's distinct words, `times` how often each occurs
        width = 1 + max(len(i.places) for i in items)
        self.slot = np.zeros((len(items), len(self.vocabulary) + 1), dtype=np.int32)
        self.times = np.zeros((len(items), width), dtype=np.int32)
        for i, item in enumerate(items):
            known = np.array(list(item.places), dtype=np.uint64)
            self.slot[i, np.searchsorted(self.vocabulary, known)] = np.arange(1, len(known) + 1)
            self.times[i, 1 : len(known) + 1] = [p.bit_count() for p in item.places.values()]
        rare, answers = ([], [], []), {}
        for i, item in enumerate(items):
            n = len(item.words)
            array = np.array(item.words, dtype=np.uint64)
            order = np.argsort(df[(array & np.uint64(len(df) - 1)).astype(np.int64)], kind="stable")
            for at in order[: n - max(1, math.ceil(config.copied * n - 1e-9)) + 1].tolist():
                _append(rare, item.words[at], i, at)
            size = min(n, config.answer_words)
            if size:
                _append(answers.setdefault(size, ([], [], [])), int(_runs(array[n - size :], size)[0]), i, n - size)
        self.rare = Lookup(*rare)
        self.answers = {size: Lookup(*found) for size, found in answers.items()}

    def exact(self, config: LeakConfig, hashes: np.ndarray):
        """(item, place of its first word, least share) of all places the proof could accept."""
        yield *self._starts(self.rare.hits(hashes)), config.copied
        for size, lookup in self.answers.items():
            yield *self._starts(lookup.hits(_runs(hashes, size))), config.paraphrased

    @staticmethod
    def _starts(hits):
        """Each (item, start) once, with the place of one hit, which tells the text."""
        place, item, at = hits
        order = np.lexsort((place, place - at, item))
        place, item, start = place[order], item[order], (place - at)[order]
        return place, item, start

    def coded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are in the vocabulary, and how many of them stand before each place."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes
        return place[known], np.concatenate(([0], np.cumsum(known)))

    def nearest(self, i: int, start: int, edges: tuple[int, int], first: int, windows: np.ndarray) -> float:
        """The best cosine of item i's chunks, if its first word stands at `start`, with the windows that hold them."""
        chunk = np.flatnonzero(self.number == i)
        window = np.clip(edges[0] + (start + self.at[chunk] - first) // STEP, edges[0], edges[1] - 1)
        return float((windows[window] * self.vectors[chunk]).sum(axis=1).max())

    def most(self, item: np.ndarray, coded: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Per pair, at least as many words as the item can have in common with the words begin:end."""
        out = np.zeros(len(item), dtype=np.int64)
        words_known, before = coded
        first, n = before[begin], np.maximum(before[end] - before[begin], 0)
        for i in range(0, len(item), 4096):
            one, many = item[i : i + 4096], n[i : i + 4096]
            pair = np.repeat(np.arange(len(one)), many)
            place = np.arange(len(pair)) + np.repeat(first[i : i + 4096] - (np.cumsum(many) - many), many)
            seen = np.zeros((len(one), self.times.shape[1]), dtype=bool)
            seen[pair, self.slot[one[pair], words_known[place]]] = True
            out[i : i + 4096] = (seen * self.times[one]).sum(axis=1)
        return out


def _windows(table: np.ndarray, hashes: np.ndarray, first: np.ndarray):
    """(text number, first word, unit vector) of every window of every text."""
    starts, edges = _steps(first)
    sums = _row_sums(table, (hashes & np.uint64(len(table) - 1)).astype(np.int64), starts)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    whole = sums.copy()
    for ahead in (1, 2):
        same = np.flatnonzero(owner[ahead:] == owner[: len(owner) - ahead])
        whole[same] += sums[same + ahead]
    return owner, starts, _unit(whole).astype(np.float32)


def _search(config: LeakConfig, text: str, items: list[Item], table: np.ndarray, df: np.ndarray):
    blocks = [Block(items[i : i + ITEMS_AT_ONCE], table, df, config) for i in range(0, len(items), ITEMS_AT_ONCE)]

    def prove(block: Block, hashes: np.ndarray, owner, begin, end, item, near, found: list[dict]) -> None:
        for doc, b, e, i, cosine in zip(owner.tolist(), begin.tolist(), end.tolist(), item.tolist(), near.tolist(), strict=True):
            one = block.items[i]
            known = found[doc].get(one.item_id)
            if known and known["lcs"] == 1.0:
                continue
            span = hashes[b:e].tolist()
            share = one.common(span) / len(one.words)
            if share < config.paraphrased or (known and known["lcs"] >= share):
                continue
            answer = one.answered(span, config.answer_words)
            if share >= config.copied or answer:
                found[doc][one.item_id] = {"item_id": one.item_id, "lcs": share, "cosine": cosine, "answer": answer}

    def prove_exact(block: Block, hashes, first, coded, starts, vectors, found: list[dict]) -> None:
        for place, item, start, least in block.exact(config, hashes):
            owner = np.searchsorted(first, place, side="right") - 1
            new = np.ones(len(item), dtype=bool)
            new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1]) | (owner[1:] != owner[:-1])
            owner, item, start = owner[new], item[new], start[new]
            begin = np.maximum(first[owner], start - REACH)
            end = np.minimum(first[owner + 1], start + block.length[item] + REACH)
            use = np.flatnonzero(block.most(item, coded, begin, end) >= least * block.length[item] - 1e-9)
            if not len(use):
                continue
            edges = np.searchsorted(starts, first)
            near = [
                block.nearest(i, s, (edges[d], edges[d + 1]), first[d], vectors)
                for d, i, s in zip(owner[use].tolist(), item[use].tolist(), start[use].tolist(), strict=True)
            ]
            prove(block, hashes, owner[use], begin[use], end[use], item[use], np.array(near), found)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs", pa.float64()), ("cosine", pa.float64()), ("answer", pa.bool_())]))
        for batch in _slices(batches, text):
            hashes, first = words(*buffers(batch.column(text)), marks=True)
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            if len(hashes):
                owner, starts, vectors = _windows(table, hashes, first)
                for block in blocks:
                    coded = block.coded(hashes)
                    least = np.float32(config.cosine) * np.sqrt(block.share)
                    for i in range(0, len(vectors), 4096):
                        near = vectors[i : i + 4096] @ block.vectors.T
                        row, chunk = np.nonzero(near >= least)
                        cosine, row, item = near[row, chunk], row + i, block.number[chunk]
                        begin = np.maximum(first[owner[row]], starts[row] - block.at[chunk] - STEP)
                        end = starts[row] - block.at[chunk] + block.length[item] + WINDOW
                        end = np.minimum(first[owner[row] + 1], np.maximum(end, begin))
                        use = block.most(item, coded, begin, end) >= config.paraphrased * block.length[item] - 1e-9
                        prove(block, hashes, owner[row[use]], begin[use], end[use], item[use], cosine[use], found)
                    prove_exact(block, hashes, first, coded, starts, vectors, found)
            column = pa.array([[f[k] for k in sorted(f)] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "_leaks"])

    return tidied(run)


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    config: LeakConfig = LeakConfig(),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "leaks",
) -> DataFrame:
    """The columns of `docs` and `out`: the benchmark items found in each document (empty if clean).

    Rows of the benchmark with equal ids are one item for each text; the best match is reported.
    """
    listed = benchmark.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")).limit(config.max_items + 1).collect()
    if len(listed) > config.max_items:
        raise ValueError(f"more than {config.max_items} benchmark items")
    items = []
    for key, value in listed:
        data = np.frombuffer((value or "").encode(), dtype=np.uint8)
        hashes, _ = words(data, np.array([0, len(data)]), marks=True)
        if key is not None and len(hashes) >= config.min_words:
            items.append(Item.of(key, hashes))
    docs = docs.drop(out)
    if not items:
        return docs.withColumn(out, F.array().cast(MATCH))
    table, df = latent_words(docs, config, text)
    schema = StructType([*docs.schema.fields, StructField("_leaks", _parse_datatype_string(MATCH))])
    return docs.mapInArrow(_search(config, text, items, table, df), schema).withColumnRenamed("_leaks", out)


def leaks(docs: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, lcs, cosine, answer: one row per contaminated document and item."""
    needed = docs.select(doc_id, text)
    found = with_leaks(needed, benchmark, config, text).select(doc_id, F.explode("leaks").alias("leak"))
    return found.select(F.col(doc_id).alias("doc_id"), "leak.*")
