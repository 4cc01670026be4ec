"""Repeated strings, near duplicates, personal data, lines, tokens: against brute force on small tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from staycoder.llm.components import components
from staycoder.llm.jaccard_join import cell_forest, cell_pairs, jaccard_groups, parity_bitmap
from staycoder.llm.line_dedup import line_groups, normalised, remove_lines, removed_lines, with_simhash
from staycoder.llm.pii import find_pii, pii_digest
from staycoder.llm.queries import tokenizer_path
from staycoder.llm.suffix_dedup import remove_repeats
from staycoder.llm.token_output import load_tokenizer, read_tokens, token_index, write_tokens

SCHEMA = "doc_id long, text string, todo string, n int, key string, g int"  # extra columns clash on purpose


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2) for i, t in rows], SCHEMA)


def repeats_by_hand(rows, width):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p : p + width] for p in range(len(b) - width + 1))
    out = collections.Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_strings(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdeé ") for _ in range(1500))
    rows = [(0, base), (1, base[100:900] + "X" + base[901:1200]), (2, None), (3, ""), (4, "a" * 700), (5, "ab" * 300)]
    rows += [(6, base[400:600]), (7, "zz" + base[1000:1300] + "q"), (8, "same" * 60), (8, "same" * 60), (None, base[:250])]
    for i in range(10, 40):
        at = rng.randrange(1200)
        part = list(base[at : at + rng.randrange(150, 400)])
        part[rng.randrange(len(part))] = "#"
        rows.append((i, "".join(part) + "".join(rng.choice("xyz") for _ in range(rng.randrange(150)))))
    got = remove_repeats(table(spark, rows)).drop("kept").collect()
    assert collections.Counter(map(tuple, got)) == repeats_by_hand(rows, 200)


def test_repeated_strings_of_an_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def shingle_groups_by_hand(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))}


def test_jaccard_groups(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, "a b c d"), (6, "a b c d")]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy[rng.randrange(6) :])))
    got = {tuple(r) for r in jaccard_groups(table(spark, rows)).collect()}
    assert got == shingle_groups_by_hand(rows)
    assert jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sets_with_one_half_of_their_identity_in_common_keep_their_links(spark, monkeypatch):
    from staycoder.llm import jaccard_join

    fingerprints = jaccard_join._fingerprints

    def few(values, first):
        h1, h2 = fingerprints(values, first)
        return h1 & 3, h2  # many sets clash in h1

    monkeypatch.setattr(jaccard_join, "_fingerprints", few)
    rng = random.Random(11)
    rows = [(0, None), (1, "a b")]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for at in (None, 0, 30):
            rows.append((len(rows), " ".join(f"x{len(rows)}" if k == at else w for k, w in enumerate(base))))
    got = {tuple(r) for r in jaccard_groups(table(spark, rows)).collect()}
    assert got == shingle_groups_by_hand(rows)
    assert len({g for _, _, g in got}) < 20


def test_the_counted_part_never_changes_links(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([4, 9, 40, 90]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(40)}"
            rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr("staycoder.llm.jaccard_join.COUNTED_TEXTS", 1000)  # next to nothing is counted
    monkeypatch.setattr("staycoder.llm.jaccard_join.HEAVY_AT_MOST", 1)
    assert {tuple(r) for r in jaccard_groups(table(spark, rows)).collect()} == shingle_groups_by_hand(rows)


def test_a_large_group_of_near_copies(spark):
    """3,000 near copies: no two need reach the threshold, the links of the group do."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = [(i, " ".join(f"x{i}y{k}" if k in swapped else w for k, w in enumerate(base))) for i, swapped in ((i, {rng.randrange(90) for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))}) for i in range(3000))]
    rows += [(5000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) + " " + " ".join(base[:20])) for i in range(300)]  # only a passage in common
    index, sets = {}, []
    for _, text in rows:
        w = text.split()
        sets.append({index.setdefault(tuple(w[k : k + 5]), len(index)) for k in range(len(w) - 4)})
    often = np.array([0] * len(index))
    for s in sets:
        often[list(s)] += 1
    column = np.cumsum(often > 1) - 1
    table_of = np.zeros((len(rows), int((often > 1).sum())), dtype=np.float32)
    for i, s in enumerate(sets):
        table_of[i, [column[x] for x in s if often[x] > 1]] = 1
    both, size = table_of @ table_of.T, np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.array([i for i, _ in rows])
    while True:
        least = np.where(linked, label[None, :], label.max()).min(axis=1)
        if (least == label).all():
            break
        label = least
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(table(spark, rows)).collect()}
    assert got == {i: (int(size[k]), int(label[k])) for k, (i, _) in enumerate(rows)}
    assert len(set(label.tolist())) > 100 and (label == 0).sum() > 1500


def test_cells_name_few_partners_and_none_twice():
    rng = np.random.default_rng(3)
    n = np.full(200, 64)
    maps = [parity_bitmap(np.r_[np.arange(60), 1000 + 4 * i + np.arange(4)].astype(np.uint64), 128) for i in range(200)]
    ids, comp, own = np.arange(200) * 3, rng.integers(0, 9, 200), np.zeros(200, dtype=np.int64)
    tried = [None] * 200
    seen = set()
    for partners in (2, 16, 200):
        a, b = cell_pairs(ids, n, comp, own, maps, tried, 80, partners)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        assert len(found) == len(a) <= 200 * partners and not found & seen
        assert all(comp[x // 3] != comp[y // 3] for x, y in found)
        seen |= found
        tried = [[y for x, y in seen if x == i] + [x for x, y in seen if y == i] for i in ids.tolist()]
    assert len(seen) == sum(comp[i] != comp[j] for i in range(200) for j in range(i))  # in the end all of them


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (5, 4)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data(spark):
    rng = random.Random(2)
    parts = list("ab0123456789 -.+@_()é😀%") + ["4111 1111 1111 1111", "a@b.co", "1.2.3.4", "+49 30 1234567"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "1" * 20_000), (903, "a" * 20_000 + "@"), (904, "1-" * 9_000), (905, "+1" + "-" * 9_000)]
    for row in pii_digest(table(spark, rows)).collect():
        text = dict(rows)[row["doc_id"]] or ""
        spans = {k: [m for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PLAIN.items()}
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, found in spans.items() for m in found)
        assert [row[f"n_{k}"] for k in PLAIN] == [len(spans[k]) for k in PLAIN], text
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert row["spans"].startswith(listed)


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn: 123-45-6789"), (4, "123-45-6789")]
    got = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in find_pii(table(spark, rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}


def test_simhash_is_the_majority_of_word_hashes(spark):
    xxhash = pytest.importorskip("xxhash")
    texts = ["a", "a b c d e", " ".join(f"w{i}" for i in range(127)), " ".join(f"w{i % 90}" for i in range(300)), None]
    rows = with_simhash(spark.createDataFrame([(t,) for t in texts], "norm string")).collect()
    for row in rows:
        if row["norm"] is None:
            assert row["sim"] is None
            continue
        codes = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in row["norm"].split(" ")]
        bits = sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))
        assert row["sim"] & (2**64 - 1) == bits


def test_fuzzy_lines(spark):
    long = " ".join(f"word{i}x" for i in range(120))
    near = long.replace("word60x", "word60xy")
    rows = [(0, f"{long}\nshort line"), (1, f"{near}!\nSHORT   line.\n\n..."), (2, None), (3, ""), (4, "other words stand here alone"), (None, long)]
    got = {(r["doc_id"], r["n_lines"], r["n_removed"], r["removed"]) for r in removed_lines(table(spark, rows)).collect()}
    # a null id comes first in the order of places
    assert got == {(0, 2, 1, "0"), (1, 4, 2, "0,1"), (2, 0, 0, ""), (3, 1, 0, ""), (4, 1, 0, ""), (None, 1, 0, "")}
    kept = {r["doc_id"]: r["text"] for r in remove_lines(table(spark, rows)).collect()}
    assert kept[0] == "short line" and kept[1] == "\n..." and kept[2] is None and kept[3] == ""
    assert removed_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fuzzy_lines_of_all_lengths(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 9))) for _ in range(3000)]
    rows, lengths = [], (2, 3, 4, 5, 8, 10, 15, 20, 30, 50)
    for n in lengths:
        for _ in range(30):
            line = [rng.choice(vocabulary) for _ in range(n)]
            near, at = list(line), rng.randrange(n)
            # one word is replaced, in lines of fewer than ten words one letter: similarity above 0.8
            near[at] = near[at][::-1] + "x" if n >= 10 else near[at][:2] + "é" + near[at][3:]
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(near))]
    gone = {r["doc_id"] for r in removed_lines(table(spark, rows)).where("n_removed > 0").collect()}
    assert not [i for i in gone if i % 2 == 0]
    for k, n in enumerate(lengths):
        assert len(gone & set(range(60 * k, 60 * k + 60))) >= 27, n


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return sum(file.length() for file in files if file.getName().startswith("shuffle_"))


def test_fuzzy_lines_free_their_shuffle_files(spark):
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(600)]
    docs = table(spark, [(i, "\n".join(lines[i : i + 3])) for i in range(0, 600, 3)]).cache()
    docs.count()
    before = shuffle_bytes(spark)
    groups = line_groups(docs)
    assert shuffle_bytes(spark) - before < 50_000  # all lines: 166 KB, keys of more than two long words each: 500 KB
    assert groups.where("keep").count() == 600
    docs.unpersist()


def test_more_pairs_than_lines_are_verified_in_slices(spark, monkeypatch):
    rng = random.Random(6)
    head = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(14))
    lines = [head + " " + "".join(rng.choices("klmnopqrst", k=60)) for _ in range(10)]  # near by their hashes, too far by their letters
    lines += [head + " " + "k" * 60, head + " " + "k" * 59 + "l"]
    monkeypatch.setattr("staycoder.llm.line_dedup.CELL_MEMBERS", 8)
    gone = removed_lines(table(spark, list(enumerate(lines)))).where("n_removed > 0").collect()
    assert {r["doc_id"] for r in gone} == {11}


def test_normalised_lines(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  Été, N° 12! ",)], "line string")
    assert df.select(normalised(F.col("line"))).first()[0] == "été n 00"


def test_token_files(spark, tmp_path):
    pytest.importorskip("tokenizers")
    path = tokenizer_path()
    rng = random.Random(1)
    parts = list("abXY'’ \n\t\r\x0b\x85\xa0é́ßİΣ<|>019½_-.,!😀中ア한") + ["<|endoftext|>", "'s", " 's", " the "]
    rows = [(i * 3, "".join(rng.choice(parts) for _ in range(rng.randrange(50)))) for i in range(300)]
    rows += [(7, None), (8, ""), (8, ""), (9, " \n "), (None, "null id"), (10_000, "very long " * 20_000)]
    write_tokens(table(spark, rows), f"{tmp_path}/t", path)
    got = token_index(spark, f"{tmp_path}/t").orderBy("start").collect()
    tokenizer, start, want = load_tokenizer(path), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((i, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert read_tokens(spark, f"{tmp_path}/t", "doc_id = 10000").count() == 1
    write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", path)


def test_pieces_end_between_letters_and_digits():
    import pyarrow as pa

    from staycoder.llm.token_output import Encoder

    whole, pieces = Encoder(tokenizer_path(), pieces=False), Encoder(tokenizer_path())
    odd = ["", None, "  ", "a1b22c'3s d's 4'S x'1", "é1 1é ß'd2", "é1 1́a", "—.1—a", "<|endoftext|>A1b C", "x<|ENDOFTEXT|>9Y", "\t7\r8a\n\n9 ", "KK1k", "1.5e3,2E-4(x2)"]
    texts = pa.array([*odd, *(f"item{i % 9}x{i % 7}" for i in range(500))])
    for part in (texts, texts.slice(2, 7), texts.slice(0, 0)):
        ids, n = pieces.encode(part)
        same, m = whole.encode(part.fill_null(""))
        assert ids.tolist() == same.tolist() and n.tolist() == m.tolist()
    assert {"item", "x", "0", "8"} <= pieces.known.keys() and not any(p.startswith("item") and p != "item" for p in pieces.known)


def test_pieces_are_encoded_many_to_a_call():
    import pyarrow as pa

    from staycoder.llm.token_output import Encoder

    whole, pieces = Encoder(tokenizer_path(), pieces=False), Encoder(tokenizer_path())
    texts = pa.array([f"{'abcdefgh'[i % 8]}{'klmnop'[i % 6]}é{chr(0x3B1 + i % 25)} 0 10 {i} x0é don't" for i in range(3000)])
    want, n = whole.encode(texts)
    sent, encode = [], pieces._ids
    pieces._ids = lambda given, *at_once: sent.append(len(given)) or encode(given, *at_once)
    ids, m = pieces.encode(texts)
    assert ids.tolist() == want.tolist() and m.tolist() == n.tolist()
    assert sum(sent) < len(pieces.known) / 2  # before: all of them
    # an id that other texts have too, and a vocabulary without a separator
    for separator in (int(want[0]), None):
        plain = Encoder(tokenizer_path())
        plain.separator = separator
        ids, m = plain.encode(texts)
        assert ids.tolist() == want.tolist() and m.tolist() == n.tolist()


def test_tokens_are_made_of_small_batches(spark, tmp_path, monkeypatch):
    from staycoder.llm import token_output

    real = token_output._tokenize

    def checked(*options):
        run = real(*options)

        def small(batches):
            for batch in batches:
                if batch.nbytes > 10 << 20:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return lambda batches: run(small(batches))

    monkeypatch.setattr(token_output, "_tokenize", checked)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = table(spark, [(0, "ab ")]).selectExpr("explode(sequence(1L, 20L)) AS doc_id", "repeat(text, 700000) AS text")
    write_tokens(rows, f"{tmp_path}/t", tokenizer_path(), ranges=1)
    got = token_index(spark, f"{tmp_path}/t").collect()
    assert [r["n_tokens"] for r in got] == [700_001] * 20
    assert spark.conf.get(setting) == before


def test_only_words_of_the_benchmark_are_looked_at_in_spans():
    import numpy as np

    from staycoder.llm.decontamination import Block, Item, LeakConfig

    rng = np.random.default_rng(3)
    items = [Item.of(i, rng.integers(0, 40, 12 + i).astype(np.uint64)) for i in range(5)]
    config = LeakConfig(buckets=64, rank=4)
    block = Block(items, np.ones((64, 4), dtype=np.float32), np.ones(64, dtype=np.int64), config)
    hashes = rng.integers(0, 4000, 9000).astype(np.uint64)
    hashes[rng.integers(0, 9000, 900)] = rng.integers(0, 40, 900)
    coded = block.coded(hashes)
    vocabulary = {w for item in items for w in item.words}
    assert len(coded[0]) == sum(w in vocabulary for w in hashes.tolist()) < 1500
    item, begin = rng.integers(0, 5, 5000), rng.integers(0, 9000, 5000)
    end = np.minimum(9000, begin + rng.integers(0, 120, 5000))
    spans = [set(hashes[b:e].tolist()) for b, e in zip(begin, end, strict=True)]
    want = [sum(w in span for w in items[i].words) for i, span in zip(item, spans, strict=True)]
    assert block.most(item, coded, begin, end).tolist() == want


def test_a_cell_returns_a_spanning_forest():
    """200 copies that all link and 50 sets that only share a passage: one link less than classes, no pairs."""
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate((base, rng.integers(0, 2**63, 3).astype(np.uint64)))) for _ in range(200)]
    sets += [np.unique(np.concatenate((base[:40], rng.integers(0, 2**63, 80).astype(np.uint64)))) for _ in range(50)]
    ids = np.arange(1000, 1250)
    a, b = cell_forest(ids, ids.copy(), np.zeros(250, dtype=np.int64), sets, 80)
    assert len(a) == 199 and max(a.max(), b.max()) < 1200
    leader = {i: i for i in range(1000, 1200)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = leader[y], leader[x]
        assert old != new
        leader = {i: new if c == old else c for i, c in leader.items()}
    assert len(set(leader.values())) == 1
    a, b = cell_forest(ids[:200], ids[:200].copy(), np.repeat([0, 1], [1, 199]), sets[:200], 80)
    assert set(a.tolist()) | set(b.tolist()) and all((x == 1000) for x in np.minimum(a, b))  # other part only
