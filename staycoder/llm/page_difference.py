"""Main text of web pages by differencing each page with the page of nearest URL on its host.

Every page becomes lines (see `html_lines`). Pages of a host are ordered by URL path; a page is paired with the
neighbour whose path has more leading segments in common (a tie: the one before), their lines are aligned by
longest common subsequence, and shared lines are deleted: what two pages of a site have in common is the site's.
Pages with the same lines count as one, so copies are never paired with each other; a pair of near copies, by
default 80% of a page's characters shared, says nothing, and the other neighbour is tried.

On its own differencing gives wrong results where chrome differs from page to page, or where articles quote each
other. The page's markup therefore goes first: lines it calls chrome are deleted in any case, lines it calls article
stay even if the neighbour has them (`trust_markup`). All other lines are settled by the differencing, on pages with
article markup too: an article may be a teaser only, with the text beside it.

Null html gives an empty text; a null or odd url belongs to the host "". Repeated rows and null ids are kept, one
output row per input row. Other columns are ignored. An empty table gives no rows.

Scale: ordering and alignment work on 8-byte line signatures, one row per host and distinct page. A hot host is cut into
blocks of neighbours, not grouped; many copies of a page are joined through `lookup`. Texts move once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycoder.llm.html_lines import ARTICLE, CHROME, page_lines
from staycoder.llm.lookup import lookup
from staycoder.sources.shared import write_once

BLOCK_PAGES = 1000


@dataclass(frozen=True)
class DifferenceConfig:
    """near_copy: share of a page's characters beyond which a shared stretch is no evidence of chrome."""

    near_copy: float = 0.8
    trust_markup: bool = True


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-case host without port, and the path with its query; ("", url) if there is no host."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return "", url or ""
    if not host:
        return "", url or ""
    return host, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def common_segments(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Rows of the bit-parallel common-subsequence table: a zero bit j of row i is a step up at b[j] for a[:i + 1]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hits = row & where.get(x, 0)
        row = ((row + hits) | (row - hits)) & full
        rows.append(row)
    return rows


def _steps_before(row: int, n: int) -> list[int]:
    """Common-subsequence lengths against b[:0], b[:1], ... b[:n], from a row of `_lengths`."""
    out = [0]
    for j in range(n):
        out.append(out[-1] + (not row >> j & 1))
    return out


def shared_places(a: list[int], b: list[int], cells: int = 1 << 26) -> list[int]:
    """Places in `a` of one longest common subsequence with `b`, ascending.

    Lines that only one page has are left out first. Beyond `cells` bits of table the problem is halved
    (the split that keeps the total length), so memory stays linear in the pages' lengths.
    """
    in_b, in_a = set(b), set(a)
    at = [i for i, x in enumerate(a) if x in in_b]
    a, b = [a[i] for i in at], [x for x in b if x in in_a]
    found: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append(a1)
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n > 1 and n * m > cells:
            half = a0 + n // 2
            ahead = _steps_before(_lengths(a[a0:half], b[b0:b1])[-1], m)
            back = _steps_before(_lengths(a[half:a1][::-1], b[b0:b1][::-1])[-1], m)
            cut = max(range(m + 1), key=lambda j: ahead[j] + back[m - j])
            work += [(a0, half, b0, b0 + cut), (half, a1, b0 + cut, b1)]
            continue
        rows = _lengths(a[a0:a1], b[b0:b1])
        i, j = n - 1, m - 1
        while i >= 0 and j >= 0:
            if rows[i] >> j & 1:  # b[j] adds nothing here
                j -= 1
            elif i and not rows[i - 1] >> j & 1:  # it adds as much without a[i]
                i -= 1
            else:
                found.append(a0 + i)
                i, j = i - 1, j - 1
    return [at[i] for i in sorted(found)]


def _signature(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(keep: bool):
    """Pages to their key and, with `keep`, their lines; without, the signatures of the lines to align."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, paths, keys, firsts, seconds = [], [], [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, path = host_and_path(url)
                lines = page_lines(page)
                shown = [(kind, text) for kind, text in lines if kind != CHROME]
                signs = [_signature(text) for _, text in shown]
                packed = b"".join(s.to_bytes(8, "little", signed=True) for s in signs)
                hosts.append(host)
                paths.append(path)
                keys.append(hashlib.blake2b(host.encode("utf-8", "surrogatepass") + b"\0" + packed, digest_size=16).digest())
                if keep:
                    firsts.append([kind for kind, _ in shown])
                    seconds.append([text for _, text in shown])
                else:
                    firsts.append(signs)
                    seconds.append([len(text) for _, text in shown])
            if keep:
                columns = [batch.column("page_id"), batch.column("url"), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int32())), pa.array(seconds, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "page_key", "kinds", "lines"])
            else:
                columns = [pa.array(hosts), pa.array(paths), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(seconds, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "page_key", "signs", "sizes"])

    return run


def _numbered(batches):
    """Sorted rows with the partition and their place in it."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64))]
        place += n
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "place"])


def _partner(near_copy: float):
    """Shared lines of the pages of a block; rows of the blocks beside it are neighbours only."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.select(["rank", "own", "host", "path", "page_key", "signs", "sizes"]).to_pylist(), key=lambda r: r["rank"])
        keys, flags = [], []
        for i, row in enumerate(rows):
            if not row["own"]:
                continue
            beside = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and abs(rows[j]["rank"] - row["rank"]) == 1 and rows[j]["host"] == row["host"]]
            beside.sort(key=lambda r: -common_segments(row["path"], r["path"]))
            for other in beside:
                shared = shared_places(row["signs"], other["signs"])
                if sum(row["sizes"][k] for k in shared) < near_copy * sum(row["sizes"]):
                    if shared:
                        hit = set(shared)
                        keys.append(row["page_key"])
                        flags.append([k in hit for k in range(len(row["signs"]))])
                    break
        return pa.table({"page_key": pa.array(keys, pa.binary()), "shared": pa.array(flags, pa.list_(pa.bool_()))})

    return run


def shared_lines(pages: DataFrame, config: DifferenceConfig = DifferenceConfig()) -> DataFrame:
    """(page_key, rows, shared): per host and distinct page how many rows have it, and for each line whether it is shared.

    `pages` has url and html. The order of all pages by host and path is a global sort; a page's rank is its place
    in its partition plus the rows of the partitions before (one number per partition is all the driver sees).
    """
    spark = pages.sparkSession
    signed = pages.mapInArrow(_parsed(False), "host string, path string, page_key binary, signs array<long>, sizes array<int>")
    same = signed.groupBy("host", "page_key").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("rows"), F.first("signs").alias("signs"), F.first("sizes").alias("sizes")
    )
    order = ["host", "path", "page_key"]
    fields = "host string, page_key binary, path string, rows long, signs array<long>, sizes array<int>"
    placed = same.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{fields}, part int, place long")
    placed = write_once(placed, "page-order")
    before, start = 0, []
    for part, n in placed.groupBy("part").count().orderBy("part").collect():
        start.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(start, "part int, start long"))
    ranked = placed.join(starts, "part").withColumn("rank", F.col("start") + F.col("place"))
    block = F.expr(f"rank div {BLOCK_PAGES}")
    beside = F.when(F.expr(f"rank % {BLOCK_PAGES} = 0"), block - 1).when(F.expr(f"rank % {BLOCK_PAGES} = {BLOCK_PAGES - 1}"), block + 1)
    dealt = ranked.select(
        "rank", "host", "path", "page_key", "signs", "sizes", block.alias("home"),
        F.explode(F.array_compact(F.array(block, beside))).alias("block"),
    ).withColumn("own", F.col("home") == F.col("block"))
    found = dealt.groupBy("block").applyInArrow(_partner(config.near_copy), "page_key binary, shared array<boolean>")
    return placed.select("page_key", "rows").join(found, "page_key", "left")


def main_text(
    pages: DataFrame, config: DifferenceConfig = DifferenceConfig(), page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars, n_lines (lines that markup leaves), n_shared (deleted by the differencing)."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    shared = write_once(shared_lines(rows, config), "page-difference")
    parsed = rows.mapInArrow(_parsed(True), "page_id long, url string, page_key binary, kinds array<int>, lines array<string>")
    joined = lookup(parsed, shared, ["page_key"], "rows", ["page_id", "url"])
    zipped = joined.withColumn("shared", F.coalesce("shared", F.array().cast("array<boolean>")))
    zipped = zipped.withColumn("zipped", F.arrays_zip("kinds", "lines", "shared"))
    stays = "NOT coalesce(x.shared, false)"
    if config.trust_markup:
        stays = f"x.kinds = {ARTICLE} OR {stays}"
    text = F.expr(f"array_join(transform(filter(zipped, x -> {stays}), x -> x.lines), '\n')")
    kept = zipped.withColumn("main", text)
    return kept.select(
        "page_id", "url", F.col("main").alias("text"), F.char_length("main").cast("long").alias("n_chars"),
        F.size("lines").cast("long").alias("n_lines"), F.expr("size(filter(shared, x -> x))").cast("long").alias("n_shared"),
    )
