"""The trie of rebuilt conversations against a plain one, and its parts: forests of blocks, carried sums, digests of ids."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from staycoder.llm import conversation_trie as T
from staycoder.llm.lookup import lookup

NAMES = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        below = [subtree(k) for k in children.get(node, [])]
        own_tokens = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return sum(b[0] for b in below) or 1, own_tokens + sum(b[1] for b in below)

    out = {}
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(whole[c]) == len(node))
        leaves, saved = subtree(node)
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, least string").repartition(parts)


def made(rng, convs=420):
    """Few different turns, so that tries branch, with copies, missing bases, nulls, ties and repeated rows."""
    rows = []
    for c in [*range(convs), *rng.sample(range(1000, 9000), 60), -7, -100, -250]:
        if c in (200, 300):
            continue
        n = rng.choice([1, 1, 2, 4, 7, 9])
        for t in range(n):
            rows.append((c, t * 3 - 4, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é" * 7]) if rng.random() < 0.9 else str(rng.random())))
    rows += [(5001, None, None, None), (5001, 2, "user", None), (5002, None, "user", "long " * 30_000), (None, 1, "user", "nobody")]
    rows += [(6000, i, "user", "bb" if i % 3 else "a") for i in range(300)] + [(6100, i, "user", "bb" if i % 3 else "a") for i in range(310)]
    rows += [(7000, 1, "user", "same")] * 9
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_trie(spark, parts):
    rows = made(random.Random(parts))
    assert as_dict(T.conversation_trie(table(spark, rows, parts))) == plain(rows)


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    rows = made(random.Random(9), 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(T.conversation_trie(table(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_small_tables(spark):
    assert T.conversation_trie(table(spark, [], 1)).count() == 0
    assert T.conversation_trie(table(spark, [(None, 1, "user", "x")], 1)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)
    for rows in ([(turnless, 1, "user", "x")], [(turnless, 1, "user", "x"), (0, 1, "u", "y"), (0, 2, "u", "z")]):
        assert as_dict(T.conversation_trie(table(spark, rows, 1))) == plain(rows)


def test_block_forest_merges_in_any_cut():
    rng = random.Random(2)
    for _ in range(60):
        words = {tuple(rng.randrange(2) for _ in range(rng.randrange(1, 7))) for _ in range(25)}
        ends = {w: rng.randrange(1, 4) for w in words}
        conv = {w: i * 10 for i, w in enumerate(rng.sample(sorted(words), len(words)))}
        under = lambda p: [w for w in words if w[: len(p)] == p]
        prefixes = {w[:d] for w in words for d in range(1, len(w) + 1)}
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in prefixes)
        explicit = {p for p in prefixes if p in words or kids(p) != 1}
        n = {p: sum(ends[w] for w in under(p)) for p in prefixes}
        node = {p: (len(p), hash(p), 0, n[p], min(conv[w] for w in under(p)), 10 * len(p)) for p in explicit}
        rows = sorted(([conv[w], kids(w) == 0, ends[w], [node[w[:d]] for d in range(1, len(w) + 1) if w[:d] in explicit]] for w in words), key=lambda r: r[3])
        expected = {(len(p), hash(p)): sum((n[q] - 1) * 10 for q in prefixes if q != p and q[: len(p)] == p) for p in explicit if n[p] > 1}
        expected[0, 0] = sum((n[q] - 1) * 10 for q in prefixes)
        for size in (1, 3, 100):
            got, leaves = {}, {}
            for a in range(0, len(rows), size):
                for depth, k1, _, below, tips, _ in T.block_forest([tuple(r) for r in rows[a : a + size]]):
                    got[depth, k1] = got.get((depth, k1), 0) + below
                    leaves[depth, k1] = leaves.get((depth, k1), 0) + tips
            assert got == expected
            assert leaves[0, 0] == sum(kids(w) == 0 for w in words)


def test_carried_sums():
    edges = [(4, 7, 9, (2, 5, 6, 3)), (0, 7, 7, (3, 1, 2, 10)), (2, 7, 7, (4, 3, 4, 20))]
    got = T.carried(edges)
    assert got[0] == (7, 7, (0, 0, 0, 0), False) and got[2][2][0] == 3 and got[2][3] is False
    assert got[4][2][0] == 7 and got[4][2][3] == 30 and got[4][3] is True


def test_digests_of_nodes_with_many_ends(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ends = spark.range(30_000).selectExpr("1L AS depth", "2L AS k1", "if(id < 20000, 3, id) AS k2", "id * 7 % 30011 AS conv")
        got = {r["k2"]: r["sha"] for r in T.end_digests(ends).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    many = sorted(i * 7 % 30011 for i in range(20_000))
    assert got[3] == hashlib.sha256(",".join(map(str, many)).encode()).hexdigest()
    assert len(got) == 10_001 and got[25_000] == hashlib.sha256(str(25_000 * 7 % 30011).encode()).hexdigest()


def test_lookup_of_heavy_and_light_keys(spark):
    left = spark.range(20_000).selectExpr("id", "if(id < 9000, null, if(id < 15000, 1, id)) AS a", "'x' AS b")
    right = spark.createDataFrame([(1, "x", 6000, "hot"), (16_000, "x", 1, "cold"), (99_999, "x", 3, "none")], "a long, b string, n long, v string")
    got = lookup(left, right, ["a", "b"], "n", ["id"])
    assert got.columns == ["id", "a", "b", "v"]
    assert {(r["v"], r["count"]) for r in got.groupBy("v").count().collect()} == {("hot", 6000), ("cold", 1), (None, 13_999)}
