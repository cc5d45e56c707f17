"""Streams with a state of their own per key: a limited feed by priority, a change feed of counts, and the view of a client.

They run with Spark's ``transformWithState``, whose state lives in RocksDB in the query's checkpoint. Time is that of
the events: what a window gives is decided when the watermark has passed it, so that the result doesn't depend on
how a stream is cut into batches.
"""

from __future__ import annotations

import heapq
import json
import pickle
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# fixed values: what is shown first, how many a flush, and to how many a buffer is cut when it holds more
PRIORITY = {"split": 0, "clip_pileup": 1, "new_pair_cluster": 2, "discordant": 3}
FLUSH, MOST, CUT = 20, 200, 100
FLUSH_MS = 50

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Keeps the session's streaming state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def flushed(buffer: list[tuple[int, str]], budget: int = FLUSH, most: int = MOST, cut: int = CUT) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """What a flush of (seq, kind) sends, by priority and then as it came, and what it carries over."""
    ranked = sorted(buffer, key=lambda e: PRIORITY.get(e[1], 9))
    sent, rest = ranked[:budget], ranked[budget:]
    return sent, rest[-cut:] if len(rest) > most else rest


class _Highlights(StatefulProcessor):
    """Collects a key's events by window; when the watermark passes a window, its events join what is carried over, and a flush is sent."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "until long", "events string")
        self.carried = handle.getValueState("carried", "until long, events string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        for r in rows:
            fresh.setdefault((r.ms // self.every + 1) * self.every, []).append((r.seq, r.kind))
        for until, events in fresh.items():
            if self.waiting.containsKey((until,)):
                events = [*json.loads(self.waiting.getValue((until,))[0]), *events]
            else:
                self.handle.registerTimer(until)
            self.waiting.updateValue((until,), (json.dumps(events),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Sends, in order, all flushes that the watermark has passed; a timer set now would not expire before the next batch."""
        passed = timerValues.getCurrentWatermarkInMs()
        windows = sorted(k[0] for k in self.waiting.keys() if k[0] <= passed)
        until, carried = self.carried.get() if self.carried.exists() else (0, "[]")
        buffer = [tuple(e) for e in json.loads(carried)]
        while windows or (buffer and until <= passed):
            until = until if buffer else windows[0]
            if windows and windows[0] == until:
                buffer += sorted(tuple(e) for e in json.loads(self.waiting.getValue((until,))[0]))
                self.waiting.removeKey((windows.pop(0),))
            sent, buffer = flushed(buffer)
            for place, (seq, kind) in enumerate(sent):
                yield Row(key=key[0], until=until, place=place, seq=seq, kind=kind)
            until += self.every
        self.carried.update((until, json.dumps(buffer)))
        if buffer:
            self.handle.registerTimer(until)

    def close(self) -> None:
        pass


def highlights(events: DataFrame, key: str, every_ms: int = FLUSH_MS) -> DataFrame:
    """The limited feed of a stream (``key``, ts with a watermark, seq, kind): key, until (the flush, in ms), place, seq and kind.

    Each flush sends the FLUSH first by priority of all that wait, and carries the rest over to the next, which comes
    whether or not there are new events. More than MOST that wait are cut to the last CUT.
    """
    with_state(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), "ts", F.unix_millis("ts").alias("ms"), "seq", "kind")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithState(_Highlights(every_ms), f"key {kind}, until long, place int, seq long, kind string", "append", "EventTime").withColumnRenamed("key", key)


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, sent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, sent = self.held.get() if self.held.exists() else (0, 0)
        n += sum(r.n for r in rows)
        self.held.update((n, n))
        if n != sent:
            yield Row(key=key[0], total=n, delta=n - sent)

    def close(self) -> None:
        pass


def changes(counts: DataFrame, key: str) -> DataFrame:
    """A change feed of rows (``key``, n): for each key that a batch touches its new total and the difference to the last one sent."""
    with_state(counts.sparkSession)
    rows = counts.select(F.col(key).alias("key"), "n")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithState(_Changes(), f"key {kind}, total long, delta long", "update", "None").withColumnRenamed("key", key)


#: What a client is told: the kinds that its view knows, and the columns that any of them may have.
EVENT = (
    "seq long, kind string, chrom_a string, pos_a long, chrom_b string, pos_b long, count long, pct double, reads long, bytes long, "
    "discordant long, split long, clip long, bin_start long, evidence_type string, text string"
)
# fixed values: entries that a view keeps of its lists
THROUGHPUTS, WATERFALL, ARCS = 60, 500, 200
#: What events alone decide: (mode, stage, error) by kind; null leaves a field as it is, ``text`` is the event's.
STEPS = {
    "scan.started": ("streaming", "extraction", None), "scan.stage_changed": (None, "text", None), "scan.completed": (None, "validation", None), "validation.started": (None, "validation", None),
    "validation.completed": ("validated", "completed", None), "scan.cancelled": ("idle", "cancelled", "Scan cancelled"), "error": (None, "failed", "text"),
}
VIEW = (
    "mode string, stage string, error string, pct double, reads long, bytes long, calls long, top_bins string, highlights long, "
    "throughput array<struct<seq:long,reads:long,bytes:long,discordant:long,split:long>>, "
    "waterfall array<struct<id:long,seq:long,kind:string,chrom_a:string,pos_a:long,chrom_b:string,pos_b:long>>, "
    "arcs array<struct<chrom_a:string,pos_a:long,chrom_b:string,pos_b:long,count:long,seq:long>>, "
    "chroms array<struct<chrom:string,pct:double,reads:long,discordant:long,split:long,status:string,bins:long>>, "
    "density array<struct<a:int,b:int,count:long>>"
)


def chrom_number(name: str | None) -> int:
    """0 to 23 for contigs 1 to 22, X and Y, with or without ``chr``; -1 for others."""
    bare = (name or "").removeprefix("chr")
    return {"X": 22, "Y": 23}.get(bare, int(bare) - 1 if bare.isdecimal() and 1 <= int(bare) <= 22 else -1)


#: Events of a batch that are sorted in memory; those of a larger batch go to temporary files in sorted runs, read back in blocks.
RUN, BLOCK = 20_000, 100


def in_order(rows: Iterator[Row], run: int = RUN, block: int = BLOCK) -> Iterator[Row]:
    """Rows by ``seq``, equal ones as they came; no more than a run of them, or a block of each run, in memory."""
    rows, seq = iter(rows), lambda r: r.seq
    first = sorted(islice(rows, run), key=seq)
    if len(first) < run:
        yield from first
        return
    with tempfile.TemporaryFile() as file:
        runs, held = [], first
        while held:
            ends = []
            for i in range(0, len(held), block):
                ends.append(file.tell())
                file.write(pickle.dumps([tuple(r) for r in held[i : i + block]], pickle.HIGHEST_PROTOCOL))
            runs.append(ends)
            make, held = type(held[0])(*held[0].__fields__), sorted(islice(rows, run), key=seq)
        first = None

        def read(places: list[int]) -> Iterator[Row]:
            for place in places:
                file.seek(place)
                for values in pickle.load(file):
                    yield make(*values)

        yield from heapq.merge(*map(read, runs), key=seq)


#: Events of which a task finds the deciding ones together.
CHUNK = 500_000


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """A number for each row, and the values that the numbers stand for, null among them."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def deciding(events: pa.Table) -> pa.Table:
    """Those of some events (job and the columns of EVENT) that decide what all do to a view, whatever other events come between them.

    ``times``: how many of a job's events of the kind an event stands for, itself and those left out before it. ``again``,
    on the last density of a pair: the ``seq`` of all that make it an arc if it is none; with them arcs are found even
    where one pushes out another.
    """
    seq = events["seq"].to_numpy()
    order = np.argsort(seq, kind="stable")
    keys = pd.DataFrame({c: _codes(events[c])[0][order] for c in ("job", "chrom_a", "chrom_b", "bin_start")})
    kind, names = _codes(events["kind"])
    of = lambda name: np.isin(kind, [i for i, n in enumerate(names) if n == name])[order]
    known = [i for i, n in enumerate(names) if n in STEPS or hasattr(_Client, _handler(n))]
    keys["kind"] = np.where(np.isin(kind, known), kind, -1)[order]
    keep = np.zeros(len(order), bool)

    def ends(rows: np.ndarray, *by: str, end: str = "last") -> None:
        part = keys.loc[rows, ["job", *by]]
        keep[part.index[~part.duplicated(keep=end)]] = True

    ends(keep | True, "kind")
    for field in ("pct", "reads", "bytes"):
        ends(of("scan.progress") & events[field].is_valid().to_numpy()[order])
    for name, most in (("scan.throughput", THROUGHPUTS), ("evidence.highlight", WATERFALL)):
        keep[keys[of(name)].groupby("job").tail(most).index] = True
    for end in ("first", "last"):  # bins count from a contig's first progress on
        ends(of("chrom.progress"), "chrom_a", end=end)
    ends(of("chrom.bin_update"), "chrom_a", "bin_start")
    for name in ("evidence.highlight", "pair.density"):
        ends(of(name), "chrom_a", "chrom_b")
    whole = np.zeros(len(order), bool)
    for i in np.flatnonzero(of("chrom_pair.matrix")):
        whole[i] = len(json.loads(events["text"][order[i]].as_py() or "[]")) == 24
    ends(whole)

    kept = keys[keep]
    place = (keys.groupby(["job", "kind"]).cumcount() + 1)[keep]
    times = place.groupby([kept["job"], kept["kind"]]).diff().fillna(place).astype("int64")
    pair = ["job", "chrom_a", "chrom_b"]
    dense = of("pair.density")
    last = {k: i for i, k in enumerate(zip(*(kept[c] for c in pair), strict=True)) if dense[kept.index[i]]}
    born = dense & pc.fill_null(pc.greater_equal(events["count"], 2), False).to_numpy()[order]
    again = [None] * len(kept)
    for k, at in keys[born].groupby(pair).indices.items():
        again[last[k]] = seq[order[born]][at]
    return events.take(order[keep]).append_column("times", pa.array(times, pa.int64())).append_column("again", pa.array(again, pa.list_(pa.int64())))


def _handler(kind: str | None) -> str:
    return "_" + (kind or "").replace(".", "_")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield from deciding(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if n:
        yield from deciding(pa.Table.from_batches(held)).to_batches()


def arcs_after(arcs: list[list], born: list[tuple], counts: dict, places: dict) -> list[list]:
    """The arcs after a batch. ``born``: (pair, the ``seq`` of all that make it an arc if it is none); ``counts`` and ``places``: the last of each pair."""
    held = OrderedDict(((x[0], x[2]), list(x)) for x in arcs)
    opened = {}
    pairs = [pair for pair, _ in born]
    seqs = np.concatenate([np.asarray(at, "int64") for _, at in born]) if born else np.zeros(0, "int64")
    whose = np.repeat(np.arange(len(born)), [len(at) for _, at in born])
    order = np.argsort(seqs, kind="stable")
    for i, seq in zip(whose[order], seqs[order], strict=True):
        pair = pairs[i]
        if pair not in held:
            opened[pair], held[pair] = int(seq), [pair[0], 0, pair[1], 0, 0, int(seq)]
            if len(held) > ARCS:
                held.popitem(last=False)
    for pair, arc in held.items():
        touched = []
        if pair in counts:
            arc[4], seq = counts[pair]
            touched.append(seq)
        if pair in places and (pair not in opened or places[pair][2] > opened[pair]):
            arc[1], arc[3], seq = places[pair]
            touched.append(seq)
        arc[5] = max(touched, default=arc[5])
    return list(held.values())


class _Client(StatefulProcessor):
    """A client's view of a job, as Spark state: lists of bounded length in one value, and maps of contigs, bins and pairs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.view = handle.getValueState("view", "json string")
        self.chroms = handle.getMapState("chroms", "chrom string", "pct double, reads long, discordant long, split long, status string, bins long")
        self.bins = handle.getMapState("bins", "chrom string, start long", "discordant long, split long, clip long")
        self.density = handle.getMapState("density", "a int, b int", "count long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        view = json.loads(self.view.get()[0]) if self.view.exists() else {"mode": "idle", "calls": 0, "highlights": 0, "throughput": [], "waterfall": [], "arcs": []}
        # the state's maps are read before and written after a batch, not at each event; of the bins only those of the batch
        before = {k[0]: tuple(v) for k, v in self.chroms.iterator()}, {tuple(k): v[0] for k, v in self.density.iterator()}
        self.seen, self.pairs, self.dirty = dict(before[0]), dict(before[1]), {}
        self.born, self.counts, self.places = [], {}, {}
        for e in in_order(rows):
            mode, stage, error = STEPS.get(e.kind, (None, None, None))
            for field, value in (("mode", mode), ("stage", stage), ("error", error)):
                if value is not None:
                    view[field] = e.text if value == "text" else value
            own = getattr(self, _handler(e.kind), None)
            if own:
                own(view, e)
        view["arcs"] = arcs_after(view["arcs"], self.born, self.counts, self.places)
        for (chrom, start), counts in self.dirty.items():
            if not self.bins.containsKey((chrom, start)):
                self.seen[chrom] = (*self.seen[chrom][:5], self.seen[chrom][5] + 1)
            self.bins.updateValue((chrom, start), counts)
        for chrom, values in self.seen.items():
            if before[0].get(chrom) != values:
                self.chroms.updateValue((chrom,), values)
        for pair in before[1].keys() - self.pairs.keys():
            self.density.removeKey(pair)
        for pair, n in self.pairs.items():
            if pair not in before[1] or before[1][pair] != n:
                self.density.updateValue(pair, (n,))
        self.view.update((json.dumps(view),))
        flat = {f: view.get(f) for f in ("mode", "stage", "error", "pct", "reads", "bytes", "calls", "top_bins", "highlights")}
        lists = {f: [tuple(x) for x in view[f]] for f in ("throughput", "waterfall", "arcs")}
        chroms = sorted((c, *v) for c, v in self.seen.items())
        density = sorted((*k, n) for k, n in self.pairs.items())
        yield Row(job=key[0], **flat, **lists, chroms=chroms, density=density)

    def _scan_progress(self, view: dict, e: Row) -> None:
        view.update({f: e[f] for f in ("pct", "reads", "bytes") if e[f] is not None})

    def _scan_completed(self, view: dict, e: Row) -> None:
        view["pct"] = 100.0

    def _scan_throughput(self, view: dict, e: Row) -> None:
        view["throughput"] = [*view["throughput"], (e.seq, e.reads, e.bytes, e.discordant, e.split)][-THROUGHPUTS:]

    def _chrom_progress(self, view: dict, e: Row) -> None:
        chrom = f"chr{e.chrom_a.removeprefix('chr')}"
        bins = self.seen[chrom][5] if chrom in self.seen else 0
        self.seen[chrom] = (e.pct, e.reads, e.discordant, e.split, "complete" if e.pct >= 100 else "scanning", bins)

    def _chrom_bin_update(self, view: dict, e: Row) -> None:
        chrom = f"chr{e.chrom_a.removeprefix('chr')}"
        if chrom in self.seen:  # bins of contigs that haven't shown progress are left out
            self.dirty[chrom, e.bin_start] = (e.discordant, e.split, e.clip)

    def _pair_density(self, view: dict, e: Row) -> None:
        a, b = sorted((chrom_number(e.chrom_a), chrom_number(e.chrom_b)))
        if a >= 0:
            self.pairs[a, b] = e["count"]
        pair = (e.chrom_a, e.chrom_b)
        self.counts[pair] = (e["count"], e.seq)
        if e.again:
            self.born.append((pair, np.array(e.again, "int64")))

    def _evidence_highlight(self, view: dict, e: Row) -> None:
        view["highlights"] += e.times
        view["waterfall"] = [*view["waterfall"], (view["highlights"], e.seq, e.evidence_type, e.chrom_a, e.pos_a, e.chrom_b, e.pos_b)][-WATERFALL:]
        self.places[e.chrom_a, e.chrom_b] = (e.pos_a, e.pos_b, e.seq)

    def _provisional_top_bins(self, view: dict, e: Row) -> None:
        view["top_bins"] = e.text

    def _validation_call_emitted(self, view: dict, e: Row) -> None:
        view["calls"] += e.times

    def _chrom_pair_matrix(self, view: dict, e: Row) -> None:
        matrix = json.loads(e.text or "[]")
        if len(matrix) == 24:
            self.pairs = {(a, b): n for a, line in enumerate(matrix) for b, n in enumerate(line) if n and a <= b}

    def close(self) -> None:
        pass


def client_view(events: DataFrame, key: str = "job") -> DataFrame:
    """The view that a client of each job has after each batch of events (``key`` and the columns of EVENT), a row a job.

    Events of a batch go by ``seq``. Lists are the last so many; a pair becomes an arc at two reads, and takes its
    place from highlights since. The tasks that read a batch pass on what decides (see ``deciding``), so that a job's
    state is given few rows of many events.
    """
    with_state(events.sparkSession)
    rows = events.select(F.col(key).alias("job"), *(c.split()[0] for c in EVENT.split(", ")))
    kind = dict(rows.dtypes)["job"]
    told = rows.mapInArrow(_decided, f"job {kind}, {EVENT}, times long, again array<long>")
    return told.groupBy("job").transformWithState(_Client(), f"job {kind}, {VIEW}", "update", "None").withColumnRenamed("job", key)


class _Cap(StatefulProcessor):
    """Counts what a window has let through; the count goes when the watermark has passed the window."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.sent.get()[0] if self.sent.exists() else 0
        if not n:
            self.handle.registerTimer((key[0] + 1) * self.width)
        for r in heapq.nsmallest(max(0, self.limit - n), rows, key=lambda r: r.seq):
            n += 1
            yield Row(window=key[0], turn=n, seq=r.seq, kind=r.kind)
        self.sent.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def capped(events: DataFrame, limit: int, width_ms: int = 1000) -> DataFrame:
    """The first ``limit`` events (ts with a watermark, seq, kind) of each window of time as they come, over all batches: window, turn, seq and kind."""
    with_state(events.sparkSession)
    rows = events.select(F.floor(F.unix_millis("ts") / width_ms).alias("window"), "ts", "seq", "kind")
    return rows.groupBy("window").transformWithState(_Cap(limit, width_ms), "window long, turn int, seq long, kind string", "append", "EventTime")
