"""One difference-cover suffix sort over all texts, across the cluster.

All texts stand in one string of symbols, each closed by a symbol of its own kind. The triples at places 1 and 2
modulo 3 are named by their order (a sort of the distinct ones by ranges, and running counts over the ranges), the
string of names is sorted by recursion until names stand for `depth` symbols, the suffixes at places 0 modulo 3 are ordered through the
sampled ones, both parts are merged by counting how many of each precede the other, and neighbours in the order are
compared on their k-byte prefixes (by 64-bit hashes of them).

suffix_dedup.py is what the query runs: it sorts within buckets. This one moves every place of every text several
times, some hundred bytes a byte of text (README), and is kept for what that costs to be measured, and as a check on
the other.

Defined cases: null texts are empty; matches never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import BYTE_CODES, buffers, hash_runs
from meterglass.runtime import settled, ship, shuffle_partitions


def running(rows: DataFrame, order: list[str], counts: list[str]) -> DataFrame:
    """rows with `before_<c>` for each of counts: its sum over all rows that come earlier. Rows differ in `order`."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    kinds = [f"{c} {t}" for c, t in rows.dtypes]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), np.zeros(len(counts), np.int64)
        for batch in batches:
            sums = []
            for i, c in enumerate(counts):
                x = batch.column(c).to_numpy()
                upto = np.cumsum(x) + so_far[i]
                sums.append(pa.array(upto - x))
                so_far[i] = upto[-1] if x.size else so_far[i]
            yield pa.record_batch([*batch.columns, *sums, pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, *(f"before_{c}" for c in counts), "_part"])

    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = settled(placed.mapInArrow(local, ", ".join([*kinds, *(f"before_{c} long" for c in counts), "_part int"])), "running")
    # a row for each range
    totals = sorted(tuple(r) for r in placed.groupBy("_part").agg(*(F.sum(c) for c in counts)).collect())
    starts, so_far = [], [0] * len(counts)
    for part, *sums in totals:
        starts.append((part, *so_far))
        so_far = [a + b for a, b in zip(so_far, sums, strict=True)]
    offsets = spark.createDataFrame(starts, "_part int, " + ", ".join(f"_o_{c} long" for c in counts))
    return placed.join(F.broadcast(offsets), "_part").select(*rows.columns, *((F.col(f"before_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in counts))


def moved(rows: DataFrame, value: Column, by: int, name: str) -> DataFrame:
    """(pos, name, value): the value of each place, given to the place `by` before it."""
    return rows.filter(F.col("pos") >= by).select((F.col("pos") - by).alias("pos"), F.lit(name).alias("name"), value.alias("value"))


def gathered(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """One row per place with a column for each name."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("pos").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def suffix_ranks(seq: DataFrame, size: int, depth: int) -> DataFrame:
    """pos, rank of all places 0 to size - 1 of a string of symbols (pos, sym), in the order of prefixes of at least `depth` symbols."""
    sym, zero = F.col("sym"), F.lit(0).cast("long")
    third = F.col("pos") % 3
    triples = gathered([moved(seq, sym, i, f"s{i}") for i in range(3)], ["s0", "s1", "s2"]).filter(third != 0).select("pos", *(F.coalesce(f"s{i}", zero).alias(f"s{i}") for i in range(3)))
    if size % 3:
        triples = triples.union(seq.sparkSession.createDataFrame([(size, 0, 0, 0)], "pos long, s0 long, s1 long, s2 long"))
    triples = settled(triples, "triples")
    ones, twos = len(range(1, size + 1, 3)), len(range(2, size + 1, 3))
    names = running(triples.select("s0", "s1", "s2").distinct().withColumn("n", F.lit(1).cast("long")), ["s0", "s1", "s2"], ["n"])
    sample = settled(triples.join(names, ["s0", "s1", "s2"]).select("pos", (F.col("before_n") + 1).alias("rank")), "names")
    if depth > 3 and sample.select("rank").distinct().count() < ones + twos:
        # the names at places 1 modulo 3, a symbol between, those at places 2 modulo 3
        at = F.when(third == 1, F.floor(F.col("pos") / 3)).otherwise(ones + 1 + F.floor(F.col("pos") / 3)).cast("long")
        gap = seq.sparkSession.createDataFrame([(ones, 1)], "pos long, sym long")
        got = suffix_ranks(sample.select(at.alias("pos"), (F.col("rank") + 1).alias("sym")).union(gap), ones + 1 + twos, -(-depth // 3))
        back = F.when(F.col("pos") < ones, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - ones - 1) + 2)
        sample = got.filter(F.col("pos") != ones).select(back.alias("pos"), "rank")
    rank = F.col("rank")
    parts = [moved(seq, sym, 0, "s"), moved(seq, sym, 1, "t"), moved(sample, rank, 0, "r"), moved(sample, rank, 1, "r1"), moved(sample, rank, 2, "r2")]
    whole = gathered(parts, ["s", "t", "r", "r1", "r2"]).filter(F.col("pos") < size)
    whole = settled(whole.select("pos", "s", *(F.coalesce(c, zero).alias(c) for c in ("t", "r", "r1", "r2"))), "places")

    def preceding(key: list[str], classes: tuple[int, int]) -> DataFrame:
        """By key, how many places of each of two classes modulo 3 are less."""
        counts = whole.filter(third.isin(*classes)).groupBy(*key).agg(*(F.count_if(third == c).alias(f"n{c}") for c in classes))
        got = running(counts, key, [f"n{c}" for c in classes])
        return got.select(*key, *(F.col(f"before_n{c}").alias(f"{''.join(key)}_{c}") for c in classes))

    by_one, by_two, by_rank = preceding(["s", "r1"], (0, 1)), preceding(["s", "t", "r2"], (0, 2)), preceding(["r"], (1, 2))
    part = [whole.filter(third == c) for c in range(3)]
    place = lambda a, b, c: (F.col(a) + F.col(b) + F.col(c)).alias("rank")
    first = part[0].join(by_one, ["s", "r1"]).join(by_two, ["s", "t", "r2"]).select("pos", place("sr1_0", "sr1_1", "str2_2"))
    second = part[1].join(by_one, ["s", "r1"]).join(by_rank, "r").select("pos", place("sr1_0", "sr1_1", "r_2"))
    third_part = part[2].join(by_two, ["s", "t", "r2"]).join(by_rank, "r").select("pos", place("str2_0", "str2_2", "r_1"))
    return settled(first.union(second).union(third_part), "ranks")


def alike_neighbours(ranked: DataFrame) -> DataFrame:
    """pos of the places whose neighbour in the order of ranks has the same window. ranked: pos, rank, window."""
    spark = ranked.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of a range, whether a neighbour within it is alike, and the range's first and last window (a range is one task's work)."""
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        window = table.column("window").to_numpy()
        same = window[1:] == window[:-1]
        alike = np.append(same, False) | np.append(False, same)
        ends = np.full(window.size, 0, np.int8)
        ends[window == window[0]] |= 1
        ends[window == window[-1]] |= 2
        part = np.full(window.size, TaskContext.get().partitionId(), np.int32)
        yield pa.record_batch([table.column("pos").combine_chunks(), table.column("window").combine_chunks(), pa.array(alike), pa.array(ends), pa.array(part)], names=["pos", "window", "alike", "ends", "_part"])

    ordered = ranked.repartitionByRange(shuffle_partitions(spark), "rank", "pos").sortWithinPartitions("rank", "pos")
    placed = settled(ordered.mapInArrow(local, "pos long, window long, alike boolean, ends byte, _part int"), "neighbours")
    # a row for each range: does it go on where the one before it ends?
    edge = lambda bit: F.max(F.when(F.col("ends").bitwiseAND(F.lit(bit).cast("byte")) > 0, F.col("window")))
    edges = sorted(tuple(r) for r in placed.filter("ends > 0").groupBy("_part").agg(edge(1), edge(2)).collect())
    joined = [(a[0], b[0]) for a, b in zip(edges, edges[1:], strict=False) if a[2] == b[1]]
    bits = spark.createDataFrame([(a, 2) for a, _ in joined] + [(b, 1) for _, b in joined], "_part int, bit int").groupBy("_part").agg(F.sum("bit").cast("byte").alias("bits"))
    wide = placed.join(F.broadcast(bits), "_part", "left")
    return wide.filter(F.col("alike") | (F.coalesce(F.col("ends").bitwiseAND(F.col("bits")), F.lit(0).cast("byte")) > 0)).select("pos")


def repeated_places(docs: DataFrame, k: int = 200) -> DataFrame:
    """key, at: the places in each text at which a k-byte string starts that starts elsewhere too. docs: key (one for each row), text."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select("key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts = running(source.select("key", (F.octet_length("text") + 1).cast("long").alias("n")), ["key"], ["n"])
    size = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for i, start in enumerate(batch.column("before_n").to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                window = np.full(own.size + 1, 0, np.int64)
                h = hash_runs(BYTE_CODES[own], k).view(np.int64)
                window[: h.size] = h
                fits = np.arange(own.size + 1) < h.size
                yield pa.record_batch([pa.array(np.arange(own.size + 1) + start), pa.array(np.append(own.astype(np.int64) + 2, 1)), pa.array(window, mask=~fits)], names=["pos", "sym", "window"])

    whole = settled(source.join(starts.select("key", "before_n"), "key").mapInArrow(symbols, "pos long, sym long, window long"), "symbols")
    ranks = suffix_ranks(whole.select("pos", "sym"), size, k)
    found = alike_neighbours(ranks.join(whole.filter("window is not null").select("pos", "window"), "pos"))
    owner = starts.select("key", F.col("before_n").alias("begin"), (F.col("before_n") + F.col("n")).alias("end"))
    chunk = 1 << 16
    spread = owner.select("key", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("c"))
    return found.withColumn("c", F.floor(F.col("pos") / chunk)).join(spread, "c").filter((F.col("pos") >= F.col("begin")) & (F.col("pos") < F.col("end"))).select("key", (F.col("pos") - F.col("begin")).alias("at"))
