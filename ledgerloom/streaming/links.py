"""Streams of records: exact duplicates dropped within a watermark, sums by window, sessions of one amount, links on arrival."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cents of one group of neighbouring amounts, which share a state.
GROUP_CENTS = 100
#: States that the groups of neighbouring amounts are dealt to by ``links_by_day``.
STATES = 4096


def distinct_records(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each key's first record; state is kept as long as late records may come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def amounts_by_window(stream: DataFrame, time: str = "ts", value: str = "value", width: str = "1 day", slide: str | None = None, late: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """Count and sum of amounts by tumbling or sliding window."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("w"), *(keys or []))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(value), 2).cast("decimal(18,2)")).alias("amount")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(keys or []), "n", "amount")


def amount_sessions(stream: DataFrame, keys: list[str], time: str = "ts", gap: str = "3 days", late: str = "3 days") -> DataFrame:
    """Chains of records with the same keys (an amount in cents, say), each within ``gap`` of the one before."""
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def linked_on_arrival(stream: DataFrame, keys: list[str], id_column: str = "record_id", time: str = "ts", cents: str = "cents", days: int = 3, late: str = "7 days") -> DataFrame:
    """(id, ts, cents, of): each record with the earlier one that it is linked to, or null: a cent and ``days`` apart at most.

    Keyed state: the records seen of one group of neighbouring amounts, kept until the
    watermark is ``days`` past them.  A record at a group's edge is told to the group
    beside it too, so a link across the edge isn't lost; only its own group answers.
    Of several records it may be linked to, the first in time, then by id, is named.
    """
    state = "at array<long>, cents array<long>, ids array<string>"
    out = f"{', '.join(f'`{k}` {stream.schema[k].dataType.simpleString()}' for k in keys)}{', ' if keys else ''}record_id string, ts timestamp, cents long, of string"
    group = F.floor(F.col("cents") / GROUP_CENTS)
    named = stream.withWatermark(time, late).select(*keys, F.col(id_column).cast("string").alias("record_id"), F.col(time).alias("ts"), F.col(cents).cast("long").alias("cents"))
    beside = F.array_distinct(F.array(group, F.floor((F.col("cents") - 1) / GROUP_CENTS), F.floor((F.col("cents") + 1) / GROUP_CENTS)))
    dealt = named.withColumn("own", group).withColumn("amounts", F.explode(beside))
    span = days * 86_400_000

    def answer(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        seen = list(zip(*held.get, strict=True)) if held.exists else []
        rows = pd.concat(list(batches))
        rows["at"] = rows["ts"].astype("int64") // 1_000_000 if str(rows["ts"].dtype).endswith("ns]") else rows["ts"].astype("datetime64[ms]").astype("int64")
        found = []
        for r in rows.sort_values(["at", "record_id"]).itertuples(index=False):
            near = [s for s in seen if abs(s[1] - r.cents) <= 1 and abs(s[0] - r.at) <= span]
            if r.own == key[-1]:
                found.append((*key[:-1], r.record_id, r.ts, r.cents, min(near, key=lambda s: (s[0], s[2]))[2] if near else None))
            seen.append((int(r.at), int(r.cents), r.record_id))
        now = held.getCurrentWatermarkMs()
        seen = [s for s in seen if s[0] + span >= now]
        if seen:
            held.update(tuple(list(x) for x in zip(*seen, strict=True)))
            held.setTimeoutTimestamp(max(now + 1, max(s[0] for s in seen) + span + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(found, columns=[*keys, "record_id", "ts", "cents", "of"])

    return dealt.groupBy(*keys, "amounts").applyInPandasWithState(answer, out, state, "append", "EventTimeTimeout")


def _written(column: str, kind: T.DataType) -> Column:
    """A key as text: equal keys have equal texts, and ``_read`` gives the key again."""
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(c)
    # Adding zero makes one of both zeros.
    return ((c + F.lit(0.0)) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c).cast("string")


def _read(written: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(written.cast("long"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(written)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.from_json(written, kind)
    return written.cast(kind)


def links_by_day(stream: DataFrame, keys: list[str], id_column: str = "record_id", time: str = "ts", cents: str = "cents", days: int = 3, late: str = "7 days", states: int = STATES) -> DataFrame:
    """(keys, record_id, ts, cents, of, gap): each record with the first one seen of every day and amount that it is linked to.

    Linked: a cent and so many calendar days apart at most.  Records of one amount and
    day are linked to one another, so the first of them stands for all: components of
    these links are those of all pairs, and state and work for a record grow with days,
    not with the records of a hot amount.  An amount's first of a day is kept until the
    watermark is past the last day that may be linked to it.  Of one batch the first in
    time, then by id, comes first.  Rows without an id, a time or an amount have no
    links; rows behind the watermark are counted by ``dropped_late``.

    Groups of neighbouring amounts mostly hold a record or two, and a call for a state
    costs as much as hundreds of records, so groups are dealt to ``states`` by hash, and a
    batch costs so many calls at most, however many keys and amounts it has.  A batch
    writes the states it touches as a whole: for small batches over much that is kept, take more.
    """
    state = "who array<string>, cents array<long>, days array<int>, ids array<string>"
    out = "who string, record_id string, at long, cents long, of string, gap int"
    kinds = [stream.schema[k].dataType for k in keys]
    who = F.to_json(F.array(*[_written(k, kind) for k, kind in zip(keys, kinds, strict=True)]).cast("array<string>"))
    named = stream.withWatermark(time, late).select(who.alias("who"), F.col(id_column).cast("string").alias("record_id"), F.col(time).alias("ts"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(cents).cast("long").alias("cents"), F.unix_date(F.to_date(time)).alias("day"))
    state_of = lambda c: F.pmod(F.xxhash64("who", F.floor((F.col("cents") + c) / GROUP_CENTS)), F.lit(states)).cast("int")
    dealt = named.where("record_id is not null and ts is not null and cents is not null").withColumn("own", state_of(0)).withColumn("state", F.explode(F.array_distinct(F.array("own", state_of(-1), state_of(1)))))
    day_ms = 86_400_000

    # A record is told to the states of the amounts beside its own too, but only its own keeps it: a day and amount is kept, and answered for, in one place.
    def answer(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        first: dict[tuple[str, int], dict[int, str]] = {}
        for w, c, d, i in zip(*held.get, strict=True) if held.exists else ():
            first.setdefault((w, c), {})[d] = i
        rows = pd.concat(list(batches))
        found = []
        for at, record, w, amount, day, own in sorted(zip(rows["at"].tolist(), rows["record_id"], rows["who"], rows["cents"].tolist(), rows["day"].tolist(), rows["own"].tolist(), strict=True)):
            for c in (-1, 0, 1):
                seen = first.get((w, amount + c))
                if seen:
                    for d in range(-days, days + 1):
                        of = seen.get(day + d)
                        if of is not None and of != record:
                            found.append((w, record, at, amount, of, abs(d)))
            if own == key[0]:
                first.setdefault((w, amount), {}).setdefault(day, record)
        now = held.getCurrentWatermarkMs()
        # A day more: days are those of the session's time zone.
        kept = [(w, c, d, i) for (w, c), seen in first.items() for d, i in seen.items() if (d + days + 2) * day_ms > now]
        if kept:
            held.update(tuple(list(x) for x in zip(*kept, strict=True)))
            held.setTimeoutTimestamp((max(d for _, _, d, _ in kept) + days + 2) * day_ms)
        elif held.exists:
            held.remove()
        yield pd.DataFrame(found, columns=["who", "record_id", "at", "cents", "of", "gap"])

    linked = dealt.groupBy("state").applyInPandasWithState(answer, out, state, "append", "EventTimeTimeout")
    written = F.from_json("who", "array<string>")
    return linked.select(*[_read(written[i], kind).alias(k) for i, (k, kind) in enumerate(zip(keys, kinds, strict=True))], "record_id", F.timestamp_micros("at").alias("ts"), "cents", "of", "gap")


def dropped_late(progress: list) -> int:
    """Rows behind the watermark that stateful operators have left out, by a query's ``recentProgress``.

    A record is told to two groups or states if its amount is at the edge of a group, and is counted for each.
    """
    return sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])
