"""Problem 6: whole documents into containers of fixed capacity.

Cost-balanced packing: a sequence costs the sum of ``LINEAR * n + QUADRATIC
* n * n`` of its documents, as attention does. Documents are taken by
descending size; each goes to the sequence of lowest cost among those with
room for it. Containers are opened only when no other has room, so the count
starts at the least possible one. Spreading by cost leaves every sequence a
little room that fits no document; where that opens containers, the smallest
documents go to the tightest room instead. Rows are dealt to shards of bounded size
by the hash of a row number, so no group grows with the data.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokenizing import count_tokens

#: Cost of a document of n tokens, for a model of width 4096 (12 d n + 2 n^2, by d).
LINEAR, QUADRATIC = 12.0, 2.0 / 4096
#: Shares of the capacity below which a document goes by room instead of cost, tried in turn.
TAILS = (0.0, 0.1, 0.25, 0.5)
#: Tokens of one shard, about.
SHARD_TOKENS = 4_000_000
#: Rows of pack_specs that may be read to the driver.
MOST_SPECS = 1_000


def balance(sizes: list[int], capacity: int, least: int = 0) -> tuple[int, list[int]]:
    """Containers used, and the container of each size; sizes descend and are within capacity.

    Sizes from ``least`` up go to the cheapest container with room, smaller
    ones to the container that they leave with the least room.
    """
    count = math.ceil(sum(sizes) / capacity)
    room = [capacity] * count
    cost = [0.0] * count
    open_ = [(0.0, b) for b in range(count)]
    shut: list[tuple[int, int]] = []  # (-room, container): those without room for the present size
    out = []
    heapify(open_)
    tail = next((k for k, size in enumerate(sizes) if size < least), len(sizes))
    for size in sizes[:tail]:
        while shut and -shut[0][0] >= size:
            b = heappop(shut)[1]
            heappush(open_, (cost[b], b))
        if open_:
            b = heappop(open_)[1]
        else:
            b = len(room)
            room.append(capacity)
            cost.append(0.0)
        room[b] -= size
        cost[b] += LINEAR * size + QUADRATIC * size * size
        if room[b] >= size:
            heappush(open_, (cost[b], b))
        elif room[b]:
            heappush(shut, (-room[b], b))
        out.append(b)
    rooms = sorted((r, b) for b, r in enumerate(room) if r)
    used = len(room)
    for size in sizes[tail:]:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            left, b = rooms.pop(at)
        else:
            left, b = capacity, used
            used += 1
        if left > size:
            insort(rooms, (left - size, b))
        out.append(b)
    return used, out


def fewest(sizes: list[int], capacity: int) -> list[int]:
    """The most balanced of the assignments in ``TAILS`` with the fewest containers."""
    bound = math.ceil(sum(sizes) / capacity)
    best: tuple[int, list[int]] | None = None
    for share in TAILS:
        tried = balance(sizes, capacity, math.ceil(capacity * share))
        if best is None or tried[0] < best[0]:
            best = tried
        if best[0] == bound:
            break
    return best[1]


def pack_documents(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(spec_id, doc_id, piece_no, start_token, n_tokens, container_id)``.

    Every row with at least one token is placed once for each capacity,
    whole; only a document above the capacity is cut, into full containers
    and one remainder. Null, empty and token-free texts have no row. Specs
    with a null or non-positive capacity are ignored, repeated ones count
    once. Rows with equal or null ids are placed one by one.
    """
    known = specs.select("spec_id", "capacity").where("capacity > 0").distinct().limit(MOST_SPECS + 1).collect()
    if len(known) > MOST_SPECS:
        raise ValueError("too many container sizes")
    sized = cut(
        count_tokens(docs, id_col, text_col, path=path).where("n_tokens > 0")
        .select(F.col(id_col).alias("doc_id"), "n_tokens", F.monotonically_increasing_id().alias("_row"))
    )
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    kind = sized.schema["doc_id"].dataType.simpleString()
    out_schema = f"spec_id int, doc_id {kind}, piece_no int, start_token int, n_tokens int, container_id string"
    if not known:
        return sized.sparkSession.createDataFrame([], out_schema)
    spec = F.explode(F.array(*[F.struct(F.lit(r.spec_id).cast("int").alias("spec_id"), F.lit(r.capacity).cast("int").alias("capacity")) for r in known]))
    placed = sized.withColumn("_spec", spec).select("*", "_spec.*").withColumn("_full", F.expr("n_tokens div capacity").cast("int"))
    full = (
        placed.where("_full > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)))
        .select(
            "spec_id", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
            F.concat_ws("-", "spec_id", F.lit("full"), "_row", "piece_no").alias("container_id"),
        )
    )
    rest = (
        placed.where("n_tokens % capacity > 0")
        .select("spec_id", "doc_id", "_full", "capacity", "_row", (F.col("n_tokens") % F.col("capacity")).cast("int").alias("n_tokens"))
        .withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    )

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_row"], ascending=[False, True])
        capacity = int(rows["capacity"].iloc[0])
        label = f"{rows['spec_id'].iloc[0]}-{rows['_shard'].iloc[0]}-"
        numbers = fewest(rows["n_tokens"].tolist(), capacity)
        return pd.DataFrame({
            "spec_id": rows["spec_id"], "doc_id": rows["doc_id"], "piece_no": rows["_full"], "start_token": rows["_full"] * capacity,
            "n_tokens": rows["n_tokens"], "container_id": [label + str(b) for b in numbers],
        })

    return full.unionByName(rest.groupBy("spec_id", "_shard").applyInPandas(fill, out_schema))
