"""Filling containers of fixed capacity by the sum-of-squares rule.

Open bins are counted by their gap (the room left). An item goes where the sum of the squared counts
is smallest afterwards: into an open bin of gap g (its count falls, that of gap g - size rises) or into
a new bin (only the count of capacity - size rises); a gap of 0 closes a bin and counts as nothing.
Moving from gap g to h changes the sum by 2 * (count[h] - count[g]) + 2, so all gaps of a size are
compared in one vector operation, however many bins are open.

At scale the items are dealt at random into blocks, and each block is packed by one task. A block leaves
some bins with room; their items are packed again in a second round, where the rests of many blocks meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stemforge.session import written

#: Items of a block on average: at most, which bounds a packing task, and at least where the cores are more than the work.
BLOCK_ITEMS, LEAST_ITEMS = 50_000, 250
#: Share of the capacity from which on the room left in a bin sends its items into the second round.
OPEN_SHARE = 0.005


def split_sizes(size: int, capacity: int) -> list[int]:
    """An item over the capacity becomes full pieces and a rest; any other stays whole."""
    full, rest = divmod(size, capacity)
    return [size] if size <= capacity else [capacity] * full + [rest] * (rest > 0)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each item, in the order given; each size is between 0 and ``capacity``.

    Ties go to the smallest gap, before a new bin. Items of size 0 go into bin 0, or a new bin where
    there is none.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            bins = max(bins, 1)
            if bins == 1 and not any(counts) and i == 0:
                counts[capacity] += 1
                open_bins[capacity].append(0)
            out[i] = 0
            continue
        gaps = counts[size:]
        after = counts[: capacity - size + 1].copy()
        after[0] = 0  # a full bin is closed
        change = np.where(gaps > 0, 2 * (after - gaps) + 2, never)
        if gaps[0] > 0:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin())
        fresh = 0 if size == capacity else 2 * int(counts[capacity - size]) + 1
        if change[best] <= fresh:
            gap = size + best
            number = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, bins
            bins += 1
        if gap > size:
            open_bins[gap - size].append(number)
            counts[gap - size] += 1
        out[i] = number
    return out


def _filled(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and whether that bin is left with more room than OPEN_SHARE."""
    bins = pack(sizes, capacity)
    room = capacity - np.bincount(bins, weights=sizes) if len(bins) else np.zeros(0)
    return bins, (room > OPEN_SHARE * capacity)[bins]


def pack_items(items: DataFrame, key: str, size: str, containers: DataFrame, kind: str, capacity: str, block_items: int = BLOCK_ITEMS, seed: int = 7) -> DataFrame:
    """Every item in a container of each kind: ``kind``, ``container_id``, ``key``, ``part``, ``size``.

    ``containers`` names the kinds with their capacities (a few rows; a capacity that is null or below 1
    is left out, equal rows count once, of two capacities of one kind the smaller holds). An item is
    whole (``part`` 0) unless it exceeds the capacity; then its parts are full but for the last. A null
    size counts as 0; items of size 0 are kept and take no room. Repeated rows are items of their own.
    The deal into blocks depends on the key, ``seed`` and the number of blocks only, so a task that runs
    again packs alike; rows of one key share a block, so keys should name items, not groups of them.
    Empty items, or no containers, give no rows.
    """
    kinds = containers.where(F.col(capacity) >= 1).groupBy(F.col(kind).alias("kind")).agg(F.min(capacity).cast("int").alias("capacity"))
    sized = items.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("int"), F.lit(0)), F.lit(0)).alias("size"))
    # sizes are costly to find, and are read for their number and for the deal
    sized = written(sized, "sizes")
    # the kinds of containers are a list of a few; how many blocks there are follows from the number of items
    filled = [(r["kind"], r["capacity"]) for r in kinds.orderBy("kind").collect()]
    kind_type, key_type = kinds.schema["kind"].dataType, sized.schema["key"].dataType
    fields = [("container_kind", to_arrow_type(kind_type)), ("container_id", pa.string()), ("item_key", to_arrow_type(key_type)), ("part", pa.int32()), ("n_tokens", pa.int32()), ("is_open", pa.bool_())]
    none = pa.schema(fields).empty_table()
    schema = f"container_kind {kind_type.simpleString()}, container_id string, item_key {key_type.simpleString()}, part int, n_tokens int, is_open boolean"

    def dealt(rows: DataFrame, tasks: int, *by: str) -> DataFrame:
        n = rows.count()
        blocks = max(1, -(-n // block_items), min(tasks, n // LEAST_ITEMS))
        # a block to a partition, so that no task gets two
        return rows.withColumn("block", F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(blocks)).cast("int")).repartitionById(blocks, "block")

    def shuffled(table: pa.Table, *by: str) -> pa.Table:
        # the order within a block follows from the items alone, whatever order they arrive in
        table = table.sort_by([(c, "ascending") for c in by]).combine_chunks()
        return table.take(pa.array(np.random.default_rng(seed).permutation(table.num_rows)))

    def first(table: pa.Table) -> pa.Table:
        table = shuffled(table, "key", "size")
        sizes, block = table["size"].to_numpy().astype(np.int64), table["block"][0].as_py()
        out = [none]
        for name, most in filled:
            parts = np.where(sizes <= most, 1, -(-sizes // most))
            item = np.repeat(np.arange(len(sizes)), parts)
            part = np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)
            amount = np.where(part == parts[item] - 1, sizes[item] - part * most, most)
            bins, is_open = _filled(amount, most)
            names = [f"{block}-{b}" for b in bins.tolist()]
            kind_of = pa.array([name] * len(item), to_arrow_type(kind_type))
            out.append(pa.table([kind_of, pa.array(names, pa.string()), table["key"].take(pa.array(item)), pa.array(part.astype(np.int32)), pa.array(amount.astype(np.int32)), pa.array(is_open)], schema=none.schema))
        return pa.concat_tables(out)

    def second(table: pa.Table) -> pa.Table:
        table = shuffled(table, "container_kind", "item_key", "part", "n_tokens")
        out = [none]
        for name, most in filled:
            mine = table.filter(pc.equal(table["container_kind"], pa.scalar(name, to_arrow_type(kind_type))))
            if mine.num_rows:
                bins, _ = _filled(mine["n_tokens"].to_numpy().astype(np.int64), most)
                names = pa.array([f"{table['block'][0].as_py()}r-{b}" for b in bins.tolist()], pa.string())
                out.append(mine.select(none.schema.names).set_column(1, "container_id", names).cast(none.schema))
        return pa.concat_tables(out)

    cores = sized.sparkSession.sparkContext.defaultParallelism
    rounds = written(dealt(sized, cores, "key").groupBy("block").applyInArrow(first, schema), "packed")
    # what is left of all blocks meets in as few as can hold it; a kind that is null stands for itself
    again = dealt(rounds.where("is_open and container_kind is not null"), 1, "item_key", "part").groupBy("block").applyInArrow(second, schema)
    out = rounds.where("not is_open or container_kind is null").unionByName(again).drop("is_open")
    return out.withColumnsRenamed({"container_kind": kind, "item_key": key})


def fill_report(packed: DataFrame, containers: DataFrame, kind: str, capacity: str) -> DataFrame:
    """Per kind: containers, tokens, and the share of room left over."""
    used = packed.groupBy(kind).agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_parts"))
    room = containers.where(F.col(capacity) >= 1).groupBy(kind).agg(F.min(capacity).alias(capacity))
    return used.join(F.broadcast(room), kind).withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col(capacity)), 6))
