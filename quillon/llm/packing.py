"""Containers of fixed capacity filled with items of varying size.

Sizes are tokens of the public byte-level tokenizer ByT5: one for each UTF-8 byte and an end
token. Items are spread by hash over blocks of bounded size, and each block is divided by
Karmarkar-Karp multiway differencing: partial partitions with the largest imbalances are
merged so that large windows of one meet small windows of the other, which ends in windows
of near-equal size. The number of windows starts at the least possible and rises whenever a
window exceeds the capacity. Only an item that is too large alone is split.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import materialize

#: Items of a block on average.
BLOCK_ITEMS = 1024
END_TOKENS = 1


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of the sizes in each of ``windows`` windows, by Karmarkar-Karp differencing.

    A partial partition is a list of (sum, tree of indexes), ascending; windows that are still
    empty are not stored. Merging one with a single item is a sorted insert.
    """
    heap: list[tuple[int, int, list]] = [(-size, i, [(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        both = len(a) + len(b) - windows
        if both <= 0:
            if len(b) == 1:
                insort(a, b[0])
                merged = a
            else:
                merged = sorted(a + b)
        else:
            # the smallest of a and the smallest of b face each other, opposite in order
            met = []
            for (x, _, s), (y, _, t) in zip(a[:both], reversed(b[:both])):
                serial += 1
                met.append((x + y, serial, (s, t)))
            merged = sorted(met + a[both:] + b[both:])
        low = merged[0][0] if len(merged) >= windows else 0
        serial += 1
        heapq.heappush(heap, (low - merged[-1][0], serial, merged))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        stack, members = [tree], []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                members.append(node)
        out.append(members)
    return out


def pack_block(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size; no window holds more than the capacity.

    The window count is raised in growing steps until no window exceeds the capacity and then
    lowered by halving while that still holds.
    """
    if not sizes:
        return []

    def trial(k: int) -> list[list[int]] | None:
        parts = differencing(sizes, k)
        return parts if max(sum(sizes[i] for i in p) for p in parts) <= capacity else None

    low = max(1, math.ceil(sum(sizes) / capacity))
    high, step, best = low, max(1, low // 64), trial(low)
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = trial(high)
    while low < high:
        mid = (low + high) // 2
        if (found := trial(mid)) is not None:
            best, high = found, mid
        else:
            low = mid + 1
    window = [0] * len(sizes)
    for w, members in enumerate(best):
        for i in members:
            window[i] = w
    return window


def _byte_cuts(text: str, limit: int) -> list[int]:
    """Character offsets that cut the text into pieces of at most ``limit`` bytes, none inside a character."""
    data = text.encode("utf-8", "surrogatepass")
    cuts, at, chars = [0], 0, 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:  # a character larger than a whole piece stays whole
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        chars += len(data[at:end].decode("utf-8", "surrogatepass"))
        cuts.append(chars)
        at = end
    return cuts


#: Targets whose items one pass makes.
TARGETS_AT_ONCE = 1000


def sized_items(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What has to be packed for each target: whole documents, and pieces of those too large alone.

    Columns: target_id, capacity, doc_id, piece_no, n_pieces, start, stop (characters), size,
    blank. Null ids, texts, targets and capacities give no rows; a repeated document or target
    counts once. Blank texts are items like others. The targets are few and ride in the plan, at
    most ``TARGETS_AT_ONCE`` in one pass over the documents.
    """
    goals = [(r.target_id, r.capacity) for r in targets.select("target_id", "capacity").where("target_id IS NOT NULL AND capacity > 1").distinct().orderBy("target_id", "capacity").toLocalIterator()]
    kind = targets.schema["target_id"].dataType.simpleString()
    parts = [_items_of(docs, goals[i : i + TARGETS_AT_ONCE], kind, doc_id, text) for i in range(0, len(goals), TARGETS_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _item_schema(docs, kind, doc_id))


def _item_schema(docs: DataFrame, kind: str, doc_id: str) -> str:
    return f"target_id {kind}, capacity int, doc_id {docs.schema[doc_id].dataType.simpleString()}, piece_no int, n_pieces int, start int, stop int, size int, blank boolean"


def _items_of(docs: DataFrame, goals: list[tuple[int, int]], kind: str, doc_id: str, text: str) -> DataFrame:
    blank = ~F.col(text).rlike(r"[^\s\p{Z}]")
    ids = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.octet_length(text) + END_TOKENS).alias("bytes"), blank.alias("blank"))
    listed = F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(c).alias("capacity")) for t, c in goals])
    per = ids.withColumn("goal", F.explode(listed))
    fits = per.where("bytes <= goal.capacity").select(
        "goal.target_id", "goal.capacity", "doc_id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.char_length("text").alias("stop"), F.col("bytes").alias("size"), "blank"
    )
    over = per.where("bytes > goal.capacity").select("goal.target_id", "goal.capacity", "doc_id", "text", "blank")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (capacity, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                cuts = _byte_cuts(t, capacity - END_TOKENS)
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, len(cuts) - 1, s, e, len(t[s:e].encode("utf-8", "surrogatepass")) + END_TOKENS))
            columns = list(zip(*rows)) if rows else [()] * 6
            at = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(at) for j in range(3)] + [pa.array(c, pa.int32()) for c in columns[1:]] + [batch.column(4).take(at)],
                names=["target_id", "capacity", "doc_id", "piece_no", "n_pieces", "start", "stop", "size", "blank"],
            )

    return fits.unionByName(over.mapInArrow(cut, _item_schema(docs, kind, doc_id)))


def pack(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Every item of ``sized_items`` with the container it goes into.

    A container is numbered by its block and its window within the block; its content never
    exceeds the capacity, unless the capacity is too small for a single character.
    """
    # written once: the count of each target's items sets its blocks, then the items go to them
    items = materialize(sized_items(docs, targets, doc_id, text).distinct(), "items")
    goal = ["target_id", "capacity"]
    blocks = items.groupBy(*goal).agg(F.ceil(F.count("*") / F.lit(block_items)).cast("int").alias("blocks"))
    # one row a target, and the targets ride in the plan already
    placed = items.join(F.broadcast(blocks), goal).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("blocks")).cast("int")).drop("blocks")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        capacity = int(group["capacity"].iloc[0])
        return group.assign(window=pd.Series(pack_block([min(int(s), capacity) for s in group["size"]], capacity), dtype="int32"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields) + ", window int"
    return placed.groupBy(*goal, "block").applyInPandas(fill, schema)


def split_alone(packed: DataFrame) -> DataFrame:
    """(target_id, doc_id) of the documents with words that a packing had to split, being too large alone."""
    return packed.where("n_pieces > 1 AND NOT blank").select("target_id", "doc_id").distinct()
