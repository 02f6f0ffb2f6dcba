"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import cut, worker_state


#: Links that a task joins up at once.
LOCAL = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that join the same nodes, each node on the least that it reaches within some LOCAL links."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (above := up.get(root, root)) != root:
                root = above
            while x != root:
                up[x], x = root, up[x]
            return root

        for batch in held:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                up[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in up if (r := top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    worker_state()
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL:
            yield joined(held)
            held, n = [], 0
    if held:
        yield joined(held)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(src, dst)``; root is the smallest node that it is linked to, over any path.

    Each task first joins up the links that it holds. Then two star steps alternate until nothing changes: each node hangs
    its larger neighbours on its smallest one, then its smaller neighbours. A node's links are only ever aggregated to a minimum, so a node with very many links is no
    group in one task. Null ends and self links are ignored; repeated links count once; an empty table gives no rows.
    """
    edge = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    local = lambda df: df.distinct().mapInArrow(_forest, "u long, v long")
    now = cut(local(links.filter("src <> dst").select(*edge("src", "dst"))))
    state = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(*edge("v", "m")).union(least.select("u", F.col("m").alias("v")))
        now = cut(local(small))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.distinct().union(now.select("v", "v").distinct())
