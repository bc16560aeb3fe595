"""Admission within a budget: at most N events per caller in each window.

A window starts at the first event after the previous one closed, so windows form a chain per caller. Only different
times matter to the chain: events are counted by caller and time first, before anything is gathered. A caller's time is
cut into chunks of some windows. Each chunk says, for every time that might open it, where its chain would end; a fold
over these short summaries fixes the real openings, and each chunk is then walked from its own, as jumps that double in
length over all of its times at once. What a time may admit goes back to its events by a join. All callers are treated
alike, and no task holds more than the different times of some windows of one caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.session import store

CALLER = ["stage", "caller"]
WINDOWS_PER_CHUNK = 16


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows that come sorted by the keys, with the number of each row's group."""
    rest: pa.Table | None = None

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for key in keys:
            codes = table[key].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new) - 1

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        group = numbered(table)
        cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if cut:
            yield table.slice(0, cut), group[:cut]
        rest = table.slice(cut)
    if rest is not None and len(rest):
        yield rest, numbered(rest)


class _Chain:
    """The times of groups end to end: which one a window opened at each would be followed by, within its group."""

    def __init__(self, table: pa.Table, group: np.ndarray, width: int) -> None:
        self.times, self.counts = (table[c].to_numpy().astype(np.int64) for c in ("us", "count"))
        self.group, self.width = group, width
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        self.starts, self.ends = starts, np.append(starts[1:], len(group))
        self.base = self.times[starts]
        # Groups one after another on one line, further apart than any window reaches.
        self.room = int((self.times - self.base[group]).max(initial=0)) + 2 * width + 2
        self.line = self.times - self.base[group] + group * self.room
        self.next = np.append(self.after(group, self.times + width), len(group))

    def after(self, group: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The first place in each group at or after a time; the number of all places where there is none."""
        offset = np.clip(times - self.base[group], 0, self.room - 1)
        at = np.searchsorted(self.line, offset + group * self.room)
        return np.where(at < self.ends[group], at, len(self.line))

    def lasts(self) -> np.ndarray:
        """The last opening of the chain that starts at each place."""
        end = len(self.line)
        last = np.where(self.next < end, self.next, np.arange(end + 1))
        while True:
            further = last[last]
            if (further == last).all():
                return last[:end]
            last = further

    def openings(self, first: np.ndarray) -> np.ndarray:
        """Whether a window opens at each place, if the first one of each group opens there."""
        end = len(self.line)
        opens = np.zeros(end + 1, bool)
        opens[first] = True
        jump = self.next
        while True:
            reached = jump[np.flatnonzero(opens)]
            before = int(opens.sum())
            opens[reached] = True
            if int(opens.sum()) == before:
                return opens[:end]
            jump = jump[jump]


def _summaries(width: int):
    """A row a chunk: the times that may open it and, for each, the last opening and its events so far."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, [*CALLER, "chunk"]):
            chain = _Chain(table, group, width)
            last = chain.lasts()
            # A window that is open on entry closes within one width of the chunk's start, so the next one opens at a
            # time before that, or at the first time after it.
            limit = chain.after(np.arange(len(chain.starts)), table["chunk"].to_numpy()[chain.starts] + width)
            limit = np.minimum(np.where(limit < len(group), limit + 1, chain.ends), chain.ends)
            place = np.arange(len(group))
            use = place < limit[group]
            # Neighbouring openings that end in the same window are one: the latest stands for all.
            same = np.append((last[1:] == last[:-1]) & use[1:] & (group[1:] == group[:-1]), False)
            keep = use & ~same
            events = np.concatenate([[0], np.cumsum(chain.counts)])
            sizes = events[chain.ends[group]] - events[last]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(group[keep], minlength=len(chain.starts)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[keep], pa.int64())) for v in (chain.times, chain.times[last], sizes)]
            heads = table.take(pa.array(chain.starts))
            yield from pa.Table.from_arrays(
                [*[heads[c] for c in (*CALLER, "chunk")], *lists], [*CALLER, "chunk", "opens", "exits", "sizes"]
            ).combine_chunks().to_batches()

    return run


def _folded(width: int):
    """(caller, chunk, open_us, open_size): the window that is open when each chunk begins. Rows come by caller and chunk."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_us, open_size = None, None, 0
        for batch in batches:
            carried = []
            for row in batch.to_pylist():
                own = (row["stage"], row["caller"])
                if own != key:
                    key, open_us, open_size = own, None, 0
                carried.append((open_us, open_size))
                at = 0 if open_us is None else int(np.searchsorted(row["opens"], open_us + width))
                if at < len(row["opens"]):
                    open_us, open_size = row["exits"][at], row["sizes"][at]
                # Otherwise the open window covers every event here and stays the latest one.
            arrays = [pa.array([c[i] for c in carried], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*CALLER, "chunk")], *arrays], [*CALLER, "chunk", "open_us", "open_size"])

    return run


def _quotas(width: int, n: int):
    """(caller, us, count, quota): how many of the events at each time are admitted."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches, [*CALLER, "chunk"]):
            chain = _Chain(table, group, width)
            opened = table["open_us"].combine_chunks()
            inherited = opened.is_valid().to_numpy(zero_copy_only=False)[chain.starts]
            closes = opened.fill_null(0).to_numpy()[chain.starts] + width
            first = np.where(inherited, chain.after(np.arange(len(chain.starts)), closes), chain.starts)
            opens = chain.openings(first)
            events = np.concatenate([[0], np.cumsum(chain.counts)])
            # The window of a place is the latest opening up to it in its group, else the one that was open on entry.
            latest = np.maximum.accumulate(np.where(opens, np.arange(len(group)), -1))
            own = latest >= chain.starts[group]
            begin = np.where(own, latest, chain.starts[group])
            size = table["open_size"].combine_chunks().fill_null(0).to_numpy()
            used = events[:-1] - events[begin] + np.where(own, 0, size)
            quota = np.clip(n - used, 0, chain.counts)
            yield from pa.Table.from_arrays(
                [table["stage"], table["caller"], pa.array(chain.times), pa.array(chain.counts), pa.array(quota, pa.int64())],
                [*CALLER, "us", "count", "quota"],
            ).combine_chunks().to_batches()

    return run


def _floor(col: Column, step: int) -> Column:
    return (F.floor(col / step) * step).cast("bigint")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equal columns, nulls too: a null caller is a caller."""
    match = F.lit(True)
    for c in columns:
        match = match & left[c].eqNullSafe(right[c])
    return match


def admit_within_budget(
    events: DataFrame, n: int, window_seconds: int = 60, windows_per_chunk: int = WINDOWS_PER_CHUNK
) -> DataFrame:
    """(event_id, stage, caller, is_admitted); ``n`` of 0 or less admits nothing. Of events at one time, the lower ids count
    first; an event without a time is not admitted."""
    if n <= 0:
        return events.select("event_id", *CALLER, F.lit(False).alias("is_admitted"))
    width = window_seconds * 1_000_000
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    key = f"stage {kinds['stage']}, caller {kinds['caller']}"
    every = events.select("event_id", *CALLER, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    timed = every.filter("us IS NOT NULL")
    chunk = _floor(F.col("us"), width * max(1, windows_per_chunk))
    by_chunk = [*CALLER, "chunk"]
    times = store(timed.groupBy(*CALLER, chunk.alias("chunk"), "us").agg(F.count(F.lit(1)).alias("count")))
    summary = times.repartition(*by_chunk).sortWithinPartitions(*by_chunk, "us").mapInArrow(
        _summaries(width), f"{key}, chunk bigint, opens array<bigint>, exits array<bigint>, sizes array<bigint>")
    openings = summary.repartition(*CALLER).sortWithinPartitions(*by_chunk).mapInArrow(
        _folded(width), f"{key}, chunk bigint, open_us bigint, open_size bigint")
    placed = times.join(openings, _same(times, openings, by_chunk)).select(*[times[c] for c in times.columns], "open_us", "open_size")
    quotas = placed.repartition(*by_chunk).sortWithinPartitions(*by_chunk, "us").mapInArrow(
        _quotas(width, n), f"{key}, us bigint, count bigint, quota bigint")
    found = timed.join(quotas, _same(timed, quotas, [*CALLER, "us"])).select(*[timed[c] for c in timed.columns], "count", "quota")
    # Only where a time has more events than its quota do single events count.
    number = F.row_number().over(Window.partitionBy(*CALLER, "us").orderBy("event_id"))
    split = found.filter((F.col("quota") > 0) & (F.col("quota") < F.col("count"))).withColumn("is_admitted", number <= F.col("quota"))
    whole = found.filter((F.col("quota") == 0) | (F.col("quota") == F.col("count"))).withColumn("is_admitted", F.col("quota") > 0)
    untimed = every.filter("us IS NULL").withColumn("is_admitted", F.lit(False))
    columns = ["event_id", *CALLER, "is_admitted"]
    return whole.select(*columns).unionByName(split.select(*columns)).unionByName(untimed.select(*columns))
