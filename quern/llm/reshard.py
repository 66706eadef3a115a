"""Resharding as a minimum-cost flow.

From the sizes of old shards and the capacities of new ones, a minimum-cost flow gives how many bytes go from which to
which, moving as few as possible (keeping a shard's bytes where they are costs nothing). Rows move in blocks: each old
shard is cut by hash into a fixed number of them, so that the flow and the choice of blocks work on a table whose size
no corpus can raise, and only files of shards that gain or lose a block are rewritten.

Unless prices differ, what a shard can keep is kept first, and only surpluses and deficits are left in the network. There
every arc costs the same, so any flow that empties the surpluses is of least cost, and one pass over both lists gives
it; thousands of shards take milliseconds. With a price for each pair, successive shortest paths solve the whole network.

Rows with equal text share a block and stay together, unless their group holds over an eighth
of a new shard: such hot groups are at most eight times the number of shards, and are dealt by id.

Defined cases: a null text has no bytes (size 8, checksum 0); equal rows share a block; ids may be
null or repeat, also where files are rewritten; a new shard may have a share of nothing; shares below nothing, or of
nothing in all, raise; an empty table gives no rows; other columns are ignored, whatever their names, or carried.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

ROW_BYTES = 8
NEW_SHARDS = 24
OLD_SHARDS = 20
BLOCKS = 512  #: of each old shard, as long as there are no more than
MAX_BLOCKS = 1 << 18  #: in all; of each shard then fewer, but at least 16


def least_moves(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The minimum-cost flow where moving a byte costs the same between any two shards, and keeping it nothing."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities are too small")
    kept = [min(s, c) for s, c in zip(supply, capacity)]
    flow = {(k, k): x for k, x in enumerate(kept) if x}
    surplus = [(i, s - (kept[i] if i < len(kept) else 0)) for i, s in enumerate(supply)]
    deficit = iter([(j, c - (kept[j] if j < len(kept) else 0)) for j, c in enumerate(capacity)])
    j, room = next(deficit, (0, 0))
    for i, left in surplus:
        while left:
            while not room:
                j, room = next(deficit)
            pushed = min(left, room)
            flow[i, j] = flow.get((i, j), 0) + pushed
            left, room = left - pushed, room - pushed
    return flow


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old shard i to each new shard j at least total cost (successive shortest paths).

    ``cost(i, j)`` is the price of a byte; the capacities have to hold the supplies.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities are too small")
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    arcs: list[list] = []  # head, room, price; an arc's reverse is at its number xor 1

    def arc(a: int, b: int, room: int, price: float) -> None:
        for u, v, r, p in ((a, b, room, price), (b, a, 0, -price)):
            graph[u].append(len(arcs))
            arcs.append([v, r, p])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost(i, j))
    while True:
        best, via, queue = {source: 0.0}, {}, [source]
        while queue:  # queue-based Bellman-Ford: residual arcs may have negative prices
            later: dict[int, None] = {}
            for u in queue:
                for k in graph[u]:
                    v, room, price = arcs[k]
                    if room and best[u] + price < best.get(v, float("inf")) - 1e-12:
                        best[v], via[v] = best[u] + price, k
                        later[v] = None
            queue = list(later)
        if sink not in via:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push
    flow = {}
    for i in range(n):
        for k in graph[i]:
            v, _, _ = arcs[k]
            if n <= v < n + m and not k & 1 and arcs[k ^ 1][1]:
                flow[i, v - n] = arcs[k ^ 1][1]
    return flow


@dataclass(frozen=True)
class Plan:
    """Where each (old shard, block) goes, and which row of the new shard its first is."""

    target: dict[tuple[int, int], tuple[int, int]]
    flow: dict[tuple[int, int], int]
    moved_bytes: int
    affected: tuple[int, ...]  #: new shards whose files change


def plan_blocks(blocks: dict[tuple[int, int], tuple[int, int]], old: int, capacity: list[int], cost=None) -> Plan:
    """From {(old shard, block): (bytes, rows)} to a target for each block; ``cost(i, j)`` prices a byte, where moves don't all cost the same."""
    supply = [0] * old
    for (i, _), (size, _) in blocks.items():
        supply[i] += size
    flow = min_cost_flow(supply, capacity, cost) if cost else least_moves(supply, capacity)
    shares: dict[int, dict[int, int]] = {i: {} for i in range(old)}
    for (i, j), f in flow.items():
        shares[i][j] = f
    of_shard: dict[int, list[tuple[int, tuple[int, int]]]] = {i: [] for i in range(old)}
    for key, (size, _) in blocks.items():
        of_shard[key[0]].append((size, key))
    target: dict[tuple[int, int], int] = {}
    load = [0] * len(capacity)
    for i in range(old):
        left = shares[i] or {0: 0}
        for size, key in sorted(of_shard[i], reverse=True):
            j = max(left, key=lambda j: (left[j], j == i, -j))
            left[j] -= size
            load[j] += size
            target[key] = j
    _even_out(blocks, target, load, capacity)
    order, base, at = sorted(target), [0] * len(capacity), {}
    for key in order:
        j = target[key]
        at[key] = (j, base[j])
        base[j] += blocks[key][1]
    moved = {k: j for k, j in target.items() if j != k[0]}
    affected = sorted({*moved.values(), *(k[0] for k in moved)})
    return Plan(at, flow, sum(blocks[k][0] for k in moved), tuple(affected))


def _even_out(blocks, target, load, capacity) -> None:
    """What whole blocks leave uneven: from the shard most over its capacity to the one most under it,
    the block nearest to half of the gap, as long as that narrows it."""
    held: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in capacity]
    for key, j in target.items():
        bisect.insort(held[j], (blocks[key][0], key))
    over = lambda j: load[j] - capacity[j]
    for _ in range(20 * len(capacity)):
        high, low = max(range(len(load)), key=over), min(range(len(load)), key=over)
        half = (over(high) - over(low)) / 2
        k = bisect.bisect_left(held[high], (half,))
        near = [x for x in held[high][max(0, k - 1) : k + 1] if 0 < x[0] < 2 * half]
        if not near:
            break
        size, key = min(near, key=lambda x: abs(x[0] - half))
        held[high].remove((size, key))
        bisect.insort(held[low], (size, key))
        target[key] = low
        load[high] -= size
        load[low] += size


def measured(docs: DataFrame, id_col: str, text_col: str, old_shard: Column, carry: bool = False) -> DataFrame:
    """(id, size, text_crc32, same, old, row): ``same`` is a hash of the text, ``row`` all columns, if they are to be carried, else null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(None).cast("boolean")
    size, crc = (F.octet_length(text) + ROW_BYTES).cast("bigint"), F.crc32(text.cast("binary"))
    return docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("same"), old_shard.cast("int").alias("old"), row.alias("row"))


def shard_by_hash(text_col: str = "text", shards: int = OLD_SHARDS) -> Column:
    """An old layout that keeps equal texts in one shard, and so is uneven."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(shards))


def reshard(
    docs: DataFrame, old_shard: Column, old: int, capacity_shares: list[float], id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, cost=None, carry: bool = False
) -> tuple[DataFrame, Plan]:
    """(rows, plan): rows have id, size, text_crc32, old, shard and slot (gapless from 0 in each shard), and with ``carry`` all columns of ``docs`` as a struct ``row``.

    ``old_shard`` gives a row's shard now, from 0 to ``old`` - 1; ``capacity_shares`` the share of all bytes that each new
    shard is to hold. The driver gets sums of at most ``MAX_BLOCKS`` blocks (or 16 of each old shard).
    """
    if min(capacity_shares, default=0) < 0 or sum(capacity_shares) <= 0:
        raise ValueError("shares must not be negative, nor nothing in all")
    spark, rows, new = docs.sparkSession, cut(measured(docs, id_col, text_col, old_shard, carry)), len(capacity_shares)
    blocks = max(1, min(blocks, max(16, MAX_BLOCKS // old)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(1, int(total * min(x for x in capacity_shares if x) / sum(capacity_shares) / 8))
    hot = rows.groupBy("old", "same").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > limit) & (F.col("n") > 1)).select("same", F.lit(True).alias("hot"))
    # every hot group has more than an 8th of the least share that is not nothing: with even shares eight a shard at most
    hot = cut(hot.distinct())
    dealt = rows.join(F.broadcast(hot) if hot.count() <= MAX_BLOCKS else hot, "same", "left")
    block = F.pmod(F.when(F.col("hot"), F.xxhash64("same", "id")).otherwise(F.xxhash64(F.col("same"), F.lit(1))), F.lit(blocks)).cast("int")
    dealt = dealt.select("id", "size", "text_crc32", "same", "old", block.alias("block"), "row")
    sums = dealt.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    whole = [int(total * s / sum(capacity_shares)) for s in capacity_shares]
    fed = [k for k, s in enumerate(capacity_shares) if s]
    for k in range(total - sum(whole)):
        whole[fed[k % len(fed)]] += 1
    plan = plan_blocks({(r["old"], r["block"]): (r["size"], r["n"]) for r in sums}, old, whole, cost)
    moves = spark.createDataFrame([(*k, *v) for k, v in sorted(plan.target.items())], "old int, block int, shard int, base bigint")
    order = Window.partitionBy("old", "block").orderBy("same", "id", "text_crc32", "size")
    placed = dealt.withColumn("nth", F.row_number().over(order)).join(F.broadcast(moves), ["old", "block"])
    return placed.select("id", "size", "text_crc32", "old", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), *(["row"] if carry else [])), plan


def rewrite_affected(rows: DataFrame, plan: Plan, path: str, files: int = 4) -> None:
    """Write the documents of affected shards below ``path``, one folder a shard and ``files`` files in each; other shards' files stay as they are.

    ``rows`` are those of ``reshard`` with ``carry``: no join finds a row's place, so ids may be null or repeat. A column
    ``shard`` of the documents gives way to the new one.
    """
    spark = rows.sparkSession
    for k in set(plan.affected) - {j for j, _ in plan.target.values()}:  # nothing is written where nothing is left
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    fields = [c for c in rows.schema["row"].dataType.names if c.lower() not in ("shard", "slot")]
    written = rows.where(F.col("shard").isin(*plan.affected)) if plan.affected else rows.where("false")
    written = written.select("shard", "slot", *(F.col(f"row.`{c}`").alias(c) for c in fields))
    written.repartition(files * max(1, len(plan.affected)), "shard", F.col("slot") % files).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
