"""Fingerprints within a few bits of each other, without comparing all pairs.

The 64 bits are cut into six blocks; for each choice of three blocks a table
is keyed by their bits (20 tables). Two fingerprints within three bits agree
on at least three blocks, so they meet under some key, and are verified by
counting bits. A key under which very many meet is replaced by longer ones:
a quarter of the other bits more, one of the four quarters must agree.
Equal fingerprints are collapsed to one before any of this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_shuffle, cut

BITS, DISTANCE = 64, 3
#: Members of a key beyond which it is made longer.
CROWDED = 200
#: Times that keys are made longer.
DEPTH = 2
#: Links that one task may hold to settle them in order.
FEW_LINKS = 200_000
#: Meetings under keys that stay crowded, beyond ``CROWDED`` for each entry, from which a batch is taken in halves.
MOST_PAIRS = 20_000_000


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cuts(bits: list[int], parts: int) -> list[int]:
    """Masks of the given bit numbers cut into runs of nearly equal length."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def block_masks() -> list[int]:
    """The 20 masks of the block tables."""
    blocks = _cuts(list(range(BITS)), 6)
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def longer_masks(mask: int) -> list[int]:
    """Masks that keep the bits of ``mask`` and add a quarter of the others."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | more for more in _cuts(free, DISTANCE + 1) if more]


def fingerprint(text: Column) -> Column:
    """64-bit fingerprint of hexadecimal text as bigint; null where there is none.

    White space around, ``0x`` before and either case are accepted, as are
    fewer than 16 digits. Null, blank, unreadable and zero give null.
    """
    digits = F.lower(F.regexp_extract(text, r"^[\s\p{Z}]*(?:0[xX])?0*([0-9a-fA-F]{1,16})[\s\p{Z}]*$", 1))
    full = F.lpad(digits, 16, "0")
    half = lambda at: F.conv(F.substring(full, at, 8), 16, 10).cast("bigint")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    return F.when((digits != "") & (value != 0), value)


def keyed(df: DataFrame, masks: list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(signed(m)).cast("bigint") for m in masks]))
    return df.withColumn("mask", each).withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))


def longer(df: DataFrame, masks: list[int]) -> DataFrame:
    """Entries of ``df`` under the longer keys of their mask."""
    table = F.create_map(*[x for m in masks for x in (F.lit(signed(m)).cast("bigint"), F.array(*[F.lit(signed(k)).cast("bigint") for k in longer_masks(m)]))])
    return df.withColumn("mask", F.explode(table[F.col("mask")])).withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))


def pairs_within(entries: DataFrame, halvable: bool) -> DataFrame | None:
    """``(fp, other, other_seq, other_id)``: rows of the batch and rows before them within three bits.

    ``entries``: (fp, seq, id, mask, key); those with an id were accepted
    before the batch and stand before all of it, whatever their seq. Equal
    seq is ordered by fp. None: too many meet in dense groups, take the
    batch in halves.
    """
    found, masks = [], block_masks()
    for depth in range(DEPTH + 1):
        sizes = cut(entries.groupBy("mask", "key").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("fresh")).where("n > 1 and fresh > 0"))
        dense = F.when(F.col("n") > CROWDED, F.col("fresh") * F.col("n"))
        crowd, fresh = sizes.agg(F.sum(dense), F.sum("fresh")).first()
        more = depth < DEPTH and crowd is not None
        if halvable and not more and (crowd or 0) > MOST_PAIRS + CROWDED * (fresh or 0):
            return None
        here = sizes.where(F.col("n") <= CROWDED) if more else sizes
        mine = entries.join(by_shuffle(here.select("mask", "key")), ["mask", "key"], "left_semi")
        late = mine.where("id is null").select("mask", "key", "fp", "seq")
        early = mine.select("mask", "key", F.col("fp").alias("other"), F.col("seq").alias("other_seq"), F.col("id").alias("other_id"))
        before = F.col("other_id").isNotNull() | (F.col("other_seq") < F.col("seq")) | ((F.col("other_seq") == F.col("seq")) & (F.col("other") < F.col("fp")))
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE
        found.append(late.join(by_shuffle(early), ["mask", "key"]).where(near & before).select("fp", "other", "other_seq", "other_id"))
        if not more:
            break
        crowded = sizes.where(F.col("n") > CROWDED)
        entries = longer(entries.join(by_shuffle(crowded.select("mask", "key")), ["mask", "key"], "left_semi"), masks)
        masks = [k for m in masks for k in longer_masks(m)]
    return reduce(DataFrame.unionAll, found).distinct()


def settle(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Accepted of ``nodes`` (fp, seq), judged in order of seq along ``links`` (fp, other) to earlier nodes.

    Rounds over the whole graph accept the nodes without an earlier one and
    refuse their neighbours; what is at most ``FEW_LINKS`` links is settled
    by one task in order, with the same result.
    """
    waiting = nodes
    while n := links.limit(FEW_LINKS + 1).count():
        if n <= FEW_LINKS:
            return cut(waiting.join(_refused_in_order(waiting, links), "fp", "left_anti"))
        first = links.select(F.col("other").alias("fp")).distinct().join(links.select("fp").distinct(), "fp", "left_anti")
        first = cut(first)  # linked, and with no earlier node that waits or was accepted
        gone = cut(links.join(first.withColumnRenamed("fp", "other"), "other", "left_semi").select("fp").distinct())
        waiting = waiting.join(gone, "fp", "left_anti")
        settled = first.unionAll(gone)
        links = cut(links.join(settled, "fp", "left_anti").join(settled.withColumnRenamed("fp", "other"), "other", "left_anti"))
    return cut(waiting)


def _refused_in_order(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp)`` of the refused among few links, by one pass in order of seq."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refused: set[int] = set()
        for frame in frames:
            for fp, other in zip(frame["fp"].tolist(), frame["other"].tolist(), strict=True):
                if other not in refused:
                    refused.add(fp)
        yield pd.DataFrame({"fp": list(refused)}, dtype="int64")

    ordered = links.join(by_shuffle(nodes), "fp").select("fp", "other", "seq").repartition(1).sortWithinPartitions("seq", "fp")
    return ordered.select("fp", "other").mapInPandas(walk, "fp bigint")


def link_distinct(nodes: DataFrame) -> DataFrame:
    """``(fp, other, distance)``: for distinct ``(fp, seq)``, pairs within three bits, ``other`` being the earlier by seq."""
    entries = cut(keyed(nodes.select("fp", "seq", F.lit(None).cast("string").alias("id")), block_masks()))
    found = pairs_within(entries, halvable=False)
    return found.select("fp", "other", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))).alias("distance"))


def near_classes(df: DataFrame, id_col: str, fp_col: str, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, class_id, n_links)`` and links ``(class_a, class_b, distance)`` between class representatives.

    A class holds the rows of one fingerprint, its id is the least by
    ``order_col`` (else by id). ``n_links``: other classes within three
    bits. Rows with a null fingerprint or id have no row.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"), F.col(order_col or id_col).alias("seq")).where("fp is not null and id is not null and seq is not null")
    rows = cut(rows)  # fingerprints may be costly, and are used twice
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct("seq", "id")).alias("seq")).select("fp", "seq", F.col("seq.id").alias("class_id")))
    links = cut(link_distinct(nodes))
    name = lambda fp, out: nodes.select(F.col("fp").alias(fp), F.col("class_id").alias(out))
    named = links.join(name("fp", "class_b"), "fp").join(name("other", "class_a"), "other").select("class_a", "class_b", F.col("distance").cast("bigint").alias("distance"))
    degree = links.select("fp").unionAll(links.select("other")).groupBy("fp").agg(F.count("*").alias("n_links"))
    members = rows.join(nodes.select("fp", "class_id"), "fp").join(degree, "fp", "left")
    return members.select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct(), named


Near = Callable[[DataFrame], DataFrame | None]


def judged(rows: DataFrame, near: Near | None = None, add: Callable[[DataFrame], object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Judge ``(id, fp, seq)`` in order of seq: refused if within three bits of a row accepted before, else accepted.

    ``near`` gives, for keys (mask, key), the entries (id, fp, seq, mask,
    key) accepted in earlier runs; they stand before all rows here. ``add``
    is handed the accepted before any later row is judged.

    Returns the accepted ``(id, fp, seq)``, one for each accepted
    fingerprint, and matches ``(id, match_id)`` of every other row with all
    accepted rows before it within three bits. An earlier entry with the
    same id is the row itself (a run that is repeated) and no match. Rows
    with a null id, fp or seq are left out.
    """
    rows = cut(rows.select("id", "fp", "seq").where("id is not null and fp is not null and seq is not null").distinct())
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct("seq", "id")).alias("r")).select("fp", "r.seq", F.col("r.id").alias("first_id")))
    return _judged(rows, nodes, near, add)


def _judged(rows: DataFrame, nodes: DataFrame, near: Near | None, add: Callable[[DataFrame], object] | None) -> tuple[DataFrame, DataFrame]:
    kind = rows.schema["id"].dataType
    mine = keyed(nodes.select("fp", "seq", F.lit(None).cast(kind).alias("id")), block_masks())
    before = near(mine) if near else None
    if before is not None:
        own = nodes.select(F.col("fp").alias("_fp"), F.col("first_id").alias("_id"))
        again = before.join(by_shuffle(own), (F.col("id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left_anti")
        mine = mine.unionByName(again.select("fp", "seq", "id", "mask", "key"))
    pairs = pairs_within(cut(mine), halvable=add is not None)
    if pairs is None:
        low, middle, high = nodes.selectExpr("min(seq)", "percentile_approx(seq, 0.5)", "max(seq)").first()
        if low == high:
            pairs = pairs_within(cut(mine), halvable=False)
        else:
            middle = min(max(middle, low), high - 1)
            early, late = cut(nodes.where(F.col("seq") <= middle)), cut(nodes.where(F.col("seq") > middle))
            old = cut(rows.join(by_shuffle(early.select("fp")), "fp", "left_semi"))
            first, matches = _judged(old, early, near, add)
            second, others = _judged(cut(rows.join(by_shuffle(early.select("fp")), "fp", "left_anti")), late, near, add)
            return cut(first.unionByName(second)), cut(matches.unionByName(others).unionByName(_late_copies(old, second)).distinct())
    pairs = cut(pairs)
    refused = pairs.where("other_id is not null").select("fp").distinct()
    inner = pairs.where("other_id is null")
    left = nodes.join(refused, "fp", "left_anti")
    free = inner.join(refused, "fp", "left_anti").join(refused.withColumnRenamed("fp", "other"), "other", "left_anti")
    kept = settle(left.select("fp", "seq"), cut(free.select("fp", "other")))
    accepted = nodes.join(by_shuffle(kept.select("fp")), "fp", "left_semi").select(F.col("first_id").alias("id"), "fp", "seq")
    if add:
        add(accepted)
    to = accepted.select(F.col("fp").alias("other"), F.col("id").alias("match_id"), F.col("seq").alias("other_seq"))
    ways = inner.select("fp", "other").unionByName(inner.select(F.col("other").alias("fp"), F.col("fp").alias("other"))).unionByName(nodes.select("fp", F.col("fp").alias("other")))
    within = rows.join(by_shuffle(ways.join(by_shuffle(to), "other")), "fp").where(_later()).select("id", "match_id")
    known = rows.join(by_shuffle(pairs.where("other_id is not null").select("fp", F.col("other_id").alias("match_id"))), "fp").select("id", "match_id")
    return accepted, cut(within.unionByName(known).where("id != match_id").distinct())


def _later() -> Column:
    """Whether a row (seq, fp, id) comes after (other_seq, other, match_id)."""
    return F.struct(F.col("other_seq"), F.col("other"), F.col("match_id")) < F.struct(F.col("seq"), F.col("fp"), F.col("id"))


def _late_copies(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Matches of rows with accepted ones of a later half that yet come before them: copies of an early refused fingerprint."""
    late = keyed(accepted.select(F.col("fp").alias("other"), F.col("id").alias("match_id"), F.col("seq").alias("other_seq"), "fp"), block_masks()).drop("fp")
    copies = keyed(rows.groupBy("fp").agg(F.max("seq").alias("last")), block_masks())
    near = copies.join(by_shuffle(late), ["mask", "key"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE) & (F.col("other_seq") <= F.col("last")))
    return rows.join(by_shuffle(near.select("fp", "other", "match_id", "other_seq").distinct()), "fp").where(_later()).select("id", "match_id")


def entries_of(known: DataFrame) -> Near:
    """Accepted rows ``(id, fp)`` of earlier runs, as what ``judged`` looks up; for tables that are read in full anyway."""
    held = keyed(known.select("id", "fp", F.lit(0).cast("bigint").alias("seq")).where("id is not null and fp is not null").distinct(), block_masks())
    return lambda mine: held.join(by_shuffle(mine.select("mask", "key").distinct()), ["mask", "key"], "left_semi")


def greedy_keep(df: DataFrame, id_col: str, fp_col: str, order_col: str) -> DataFrame:
    """``(id, status)``: in order, ``kept`` unless within three bits of a row kept before, then ``duplicate``.

    Rows with a null fingerprint, id or order have no row; an id that stands
    with several orders has a row for each.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"), F.col(order_col).alias("seq")).where("fp is not null and id is not null and seq is not null")
    rows = cut(rows)  # fingerprints may be costly, and are used twice
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct("seq", "id")).alias("seq")))
    kept = settle(nodes.select("fp", "seq"), cut(link_distinct(nodes).select("fp", "other")))
    firsts = nodes.join(kept.select("fp"), "fp").select("seq.id", "seq.seq", F.lit("kept").alias("status"))
    return rows.select("id", "seq").distinct().join(firsts, ["id", "seq"], "left").select("id", F.coalesce("status", F.lit("duplicate")).alias("status"))
