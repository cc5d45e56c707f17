"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, and greedy search on it.

Rows with equal vectors are one class, which its smallest id stands for; graph and search
know classes only, however many copies a vector has, and the copies come back by membership.

For the graph every vector gets one more component, which brings all to the largest norm:
then near means alike, and long vectors aren't in everyone's list. The search leaves that component out.

The graph starts from random-projection orders: vectors sorted by the signs of random
projections are compared within runs of equal length, however many lie close together. Then
each round joins neighbours of neighbours: every vector's list (those whose lists it is in,
and the members of its own, both by a sample of bounded size) is gathered with the members'
vectors, all pairs within the list are compared, and each member is offered those that beat
its worst neighbour so far. Rounds go on until lists settle.

A query starts at its own vector. Each hop expands the best of the beam that
weren't expanded yet, by joins with the graph and the vectors, until none is left; the beam's best
are at last scored in double precision on the original vectors.

Defined results: rows without id, and vectors that are null, empty, zero, of another length
than most, or that hold null or non-finite components take no part; rows that repeat an id
count as one, with the least of its vectors; ties go to the smaller id; with fewer
candidates than asked for, all are returned; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 40
#: Random orders, the length of a run in them, and what a run or a list offers each vector.
ORDERS, RUN, OFFER = 8, 2048, 10
#: The descent ends when a round changes less than this share of list entries; how many of the lists that a vector is in take part for it.
CHANGED, BACK = 0.02, 24
#: Vectors expanded in each hop of the search, the beam, reverse links, and what of the beam is scored exactly, for each result asked for.
EXPAND, BEAM, REVERSE, EXACT = 40, 160, 16, 3
SIGNS = 12
#: Bits of the filter that tells, but for few false alarms, whom a vector has in its list.
BITS = 512


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(finite & F.exists("vector", lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector"))
    most = v.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return v.where(F.size("vector") == (most["n"] if most else 0))


def _matrix(rows: list[bytes]) -> np.ndarray:
    """Vectors of packed rows: a scale, and a byte for each component."""
    raw = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _pack(longest: float):
    """Packed vectors with a last component that brings them to the norm ``longest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in map(np.array, batch.column(1).to_pylist()):
                x = np.r_[x, longest * np.sqrt(max(0.0, 1 - ((x / longest) ** 2).sum()))]
                scale = np.float32(min(np.abs(x).max() / 127, 1e15)) or np.float32(1e-30)
                packed.append(scale.tobytes() + np.rint(np.clip(x / scale, -127, 127)).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "v"])

    return run


def packed(classes: DataFrame) -> DataFrame:
    """(id, v) of rows (id, vector)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    longest = classes.agg(F.max(norm)).first()[0] or 1.0
    return classes.mapInArrow(_pack(min(longest, 1e150)), "id long, v binary")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition sorted by its first column, in tables that hold all rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held and held[0].column(0)[0].as_py() != key[0]:
                if held or cut:
                    yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                held = []
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    return zip(at[:-1], at[1:], strict=True)


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def _places(orders: int):
    """Keys of random orders: the signs of projections, then one projection's value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1).to_pylist())
                for turn in range(orders):
                    side = x @ np.random.default_rng(turn).standard_normal((x.shape[1], SIGNS + 1)).astype(np.float32)
                    bits = (side[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS))
                    spread = 1 / (1 + np.exp(-side[:, SIGNS] / (np.abs(side[:, SIGNS]).mean() + 1e-30)))
                    yield pa.RecordBatch.from_arrays([pa.array([turn] * len(x), pa.int32()), pa.array(bits + spread.astype(float)), *batch.columns], names=["turn", "place", "id", "v"])

    return run


def _bits(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each id; other ones for each seed, so that a false alarm doesn't repeat."""
    # fixed values: odd multipliers of 64-bit mixing
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(33)) % np.uint64(BITS), (x >> np.uint64(48)) % np.uint64(BITS)


def _offers(ids: np.ndarray, near: np.ndarray, most: int, worst: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member the best others that it doesn't know, as (id, other, nearness); only better ones than ``worst``."""
    np.fill_diagonal(near, -np.inf)
    if known is not None:
        near[known] = -np.inf
    k = min(most, len(ids) - 1)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), int)
    value = np.take_along_axis(near, at, 1)
    row, col = np.nonzero(value > (-np.inf if worst is None else worst[:, None]))
    return ids[row], ids[at[row, col]], value[row, col]


def _batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Offers of several lists, each pair once."""
    a, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    at = np.lexsort((b, a))
    at = at[np.r_[True, (np.diff(a[at]) != 0) | (np.diff(b[at]) != 0)][: len(at)]]
    a, b, s = a[at], b[at], s[at]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s.astype(np.float32))], names=["id", "other", "near"])


def _runs(length: int, most: int):
    """Compares within runs of a partition sorted by order and place; an order's last run reaches back to full length."""

    def compared(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return _batch([_offers(ids, rows @ rows.T, most)])

    def rest(ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids) > length:
            yield compared(ids[:length], rows[:length])
        if len(ids) > 1:
            yield compared(ids[-length:], rows[-length:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, ids, rows = None, np.zeros(0, np.int64), None
        for batch in batches:
            for a, b in _cuts(batch.column(0).to_numpy()) if batch.num_rows else ():
                now, more = batch.column(0)[a].as_py(), _matrix(batch.column(2).slice(a, b - a).to_pylist())
                if now != turn:
                    yield from rest(ids, rows)
                    turn, ids, rows = now, np.zeros(0, np.int64), more[:0]
                ids, rows = np.r_[ids, batch.column(1).to_numpy()[a:b]], np.concatenate([rows, more])
                while len(ids) >= 2 * length:  # what is left is between one and two runs
                    yield compared(ids[:length], rows[:length])
                    ids, rows = ids[length:], rows[length:]
        yield from rest(ids, rows)

    return run


def _local(most: int, seed: int):
    """Compares the members of each list; they hold their vector and their worst neighbour's nearness and the filter of its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            known = rows.column("known")
            member, v, worst = rows.column("member").to_numpy(), rows.column("v"), rows.column("worst").to_numpy()
            found, size = [], 0
            for a, b in _cuts(rows.column("target").to_numpy()):
                ids, first = np.unique(member[a:b], return_index=True)
                x = _matrix(v.slice(a, b - a).take(pa.array(first)).to_pylist())
                lists = np.frombuffer(b"".join(known.slice(a, b - a).take(pa.array(first)).to_pylist()), np.uint8).reshape(len(ids), -1)
                one, two = _bits(ids, seed)
                lists = np.unpackbits(lists, axis=1).view(bool)
                found.append(_offers(ids, x @ x.T, most, worst[a + first], lists[:, one] & lists[:, two]))
                size += len(found[-1][0])
                if size > 500_000:
                    yield _batch(found)
                    found, size = [], 0
            if found:
                yield _batch(found)

    return run


def _merged(k: int, seed: int):
    """Lists of the k nearest from rows (id, other, near, old, v), of which the row of an id with itself has the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            id, other, near, old = (rows.column(c).to_numpy() for c in ("id", "other", "near", "old"))
            own = id == other
            ids, v = id[own], rows.column("v").filter(pa.array(own))
            id, other, near, old = (x[~own] for x in (id, other, near, old))
            at = np.lexsort((-near, -old, other, id))
            id, other, near, old = (x[at] for x in (id, other, near, old))
            first = np.r_[True, (id[1:] != id[:-1]) | (other[1:] != other[:-1])][: len(id)]
            id, other, near, old = (x[first] for x in (id, other, near, old))
            at = np.lexsort((other, -near, id))
            id, other, near, old = (x[at] for x in (id, other, near, old))
            kept = np.arange(len(id)) - np.searchsorted(id, id) < k
            id, other, near, old = (x[kept] for x in (id, other, near, old))
            bounds = np.searchsorted(id, np.r_[ids, np.iinfo(np.int64).max], "left")
            bounds[-1] = len(id)
            fresh = np.diff(np.r_[0, np.cumsum(old == 0)][bounds])
            bits = np.zeros((len(ids), BITS), bool)
            for place in _bits(other, seed):
                bits[np.searchsorted(ids, id), place] = True
            known = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
            lists = (pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (other, near))
            yield pa.RecordBatch.from_arrays([pa.array(ids), v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, *lists, known, pa.array(fresh, pa.int32())], names=["id", "v", "others", "near", "known", "fresh"])

    return run


def _lists(offers: DataFrame, selves: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, v, others, near, known, fresh): the k nearest of offers (id, other, near, old), nearest first, their filter, and how many of them are new."""
    own = selves.select("id", F.col("id").alias("other"), F.lit(float("inf")).cast("float").alias("near"), F.lit(0).cast("byte").alias("old"), "v")
    rows = own.unionByName(offers.withColumn("v", F.lit(None).cast("binary")))
    return stored(_grouped(rows, "id").mapInArrow(_merged(k, seed), "id long, v binary, others array<long>, near array<float>, known binary, fresh int"))


def _sampled(rows: DataFrame, key: str, k: int, salt: int) -> DataFrame:
    """At most k rows of each key, by a hash; tasks keep k of a key before the shuffle."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("id", "other", F.lit(salt))))).where(F.col("turn") <= k).drop("turn")


def graph(vectors: DataFrame, k: int = K, orders: int = ORDERS, run: int = RUN, most: int = OFFER, back: int = BACK, changed: float = CHANGED) -> tuple[DataFrame, int]:
    """(id, v, others, near) of packed vectors (id, v): each vector's k neighbours found, nearest first; and the number of rounds."""
    old = lambda x: F.lit(x).cast("byte").alias("old")
    dealt = vectors.mapInArrow(_places(orders), "turn int, place double, id long, v binary").withColumn("salt", F.xxhash64("turn", "id"))
    # near copies share a place; the salt lets a range end among them
    dealt = dealt.repartitionByRange(max(1, orders * vectors.count() // (8 * run)), "turn", "place", "salt").sortWithinPartitions("turn", "place", "salt")
    offers = dealt.select("turn", "id", "v").mapInArrow(_runs(run, most), "id long, other long, near float")
    found = _lists(offers.select("*", old(0)), vectors, k, 0)
    for turn in count(1):
        edges = found.select("id", F.explode("others").alias("other"))
        link = lambda a, b: F.struct(F.col(a).alias("target"), F.col(b).alias("member"))
        both = _sampled(edges, "other", back, turn).select(F.explode(F.array(link("other", "id"), link("id", "other"))).alias("e")).select("e.*")
        # a list that isn't full takes any
        worst = F.when(F.size("near") < k, float("-inf")).otherwise(F.element_at("near", -1)).cast("float").alias("worst")
        state = found.select(F.col("id").alias("member"), "v", worst, "known")
        sent = both.join(state, "member").select("target", "member", "v", "worst", "known").unionByName(state.withColumn("target", F.col("member")))
        better = _grouped(sent, "target").mapInArrow(_local(most, turn - 1), "id long, other long, near float").select("*", old(0))
        known = found.select("id", F.explode(F.arrays_zip("others", "near")).alias("e")).select("id", F.col("e.others").alias("other"), F.col("e.near").alias("near"), old(1))
        found = _lists(better.unionByName(known), found, k, turn)
        now = found.agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"), F.coalesce(F.sum(F.size("others")), F.lit(0)).alias("size")).first()
        # lists only get better, so that the share falls
        if now["fresh"] <= changed * now["size"]:
            return found.drop("fresh", "known"), turn


def _hop(expand: int, beam: int):
    """A query's beam after a hop, from its state (a row without ``other``) and the vectors met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            query, other, v = rows.column("query").to_numpy(), rows.column("other"), rows.column("v")
            out = []
            for a, b in _cuts(query):
                met, x = other.slice(a, b - a), _matrix(v.slice(a, b - a).to_pylist())
                state = int(np.flatnonzero(met.is_null().to_numpy())[0])
                held, near, done = (np.array(rows.column(c)[a + state].as_py(), t) for c, t in (("others", np.int64), ("near", np.float32), ("done", bool)))
                met, score = np.delete(met.fill_null(0).to_numpy(), state), np.delete(x[:, :-1] @ x[state, :-1], state)
                new = ~np.isin(met, held)
                ids, near, done = np.r_[held, met[new]], np.r_[near, score[new]], np.r_[done, np.zeros(new.sum(), bool)]
                at = np.lexsort((ids, -near))[:beam]
                ids, near, done = ids[at], near[at], done[at]
                ahead = np.flatnonzero(~done)[:expand]
                done[ahead] = True
                out.append((query[a], v[a + state].as_py(), ids, near, done, ids[ahead]))
            types = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["query", "v", "others", "near", "done", "ahead"])

    return run


def beams(found: DataFrame, asked: DataFrame, expand: int = EXPAND, beam: int = BEAM) -> DataFrame:
    """(query, others, near): the beam of each row (query) of ``asked``, ids of the graph ``found``, nearest first."""
    vectors, edges = found.select(F.col("id").alias("other"), "v"), found.select("id", F.explode("others").alias("other"))
    # neighbours both ways; the reverse ones are a sample of bounded size
    ways = edges.unionByName(_sampled(edges, "other", REVERSE, 0).select(F.col("other").alias("id"), F.col("id").alias("other")))
    links = stored(ways.groupBy("id").agg(F.collect_set("other").alias("to")))
    state = stored(
        found.join(asked, found["id"] == asked["query"])
        .select("query", "v", F.expr("cast(array() as array<long>)").alias("others"), F.expr("cast(array() as array<float>)").alias("near"), F.expr("cast(array() as array<boolean>)").alias("done"), F.array("query").alias("ahead"))
    )
    while not state.where(F.size("ahead") > 0).isEmpty():
        ahead = state.select("query", F.explode("ahead").alias("id"))
        met = ahead.join(links, "id").select("query", F.explode("to").alias("other")).where("other <> query").distinct()
        held = state.select("query", F.lit(None).cast("long").alias("other"), "v", "others", "near", "done")
        rows = held.unionByName(met.join(vectors, "other").select("query", "other", "v"), allowMissingColumns=True)
        state = stored(_grouped(rows, "query").mapInArrow(_hop(expand, beam), "query long, v binary, others array<long>, near array<float>, done array<boolean>, ahead array<long>"))
    return state.select("query", "others", "near")


def search(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding) that ``queries`` (a condition on vec_id) selects, its k nearest other rows found."""
    full = stored(usable(vectors))
    # each class's k + 1 smallest ids: more can't be among anyone's k nearest
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    some = full.withColumn("place", place).where(F.col("place") <= k + 1)
    members = stored(some.select("id", "vector", F.min("id").over(Window.partitionBy("vector")).alias("class")))
    classes = members.where("id = class").select("id", "vector")
    asked = full.select("vector", F.col("id").alias("vec_id")).where(queries).withColumnRenamed("vec_id", "query_id")
    asked = stored(asked.join(classes, "vector").select("query_id", F.col("id").alias("query")))
    found, _ = graph(stored(packed(classes)))
    beam = beams(found, asked.select("query").distinct())
    best = beam.select("query", F.explode(F.concat(F.array("query"), F.slice("others", 1, EXACT * k))).alias("other"))
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    best = best.join(classes.select(F.col("id").alias("other"), F.col("vector").alias("x")), "other").join(classes.select(F.col("id").alias("query"), F.col("vector").alias("y")), "query")
    every = best.select("query", F.col("other").alias("class"), exact.alias("score")).join(members.select("class", F.col("id").alias("vec_id")), "class")
    # of bounded number: EXACT * k + 1 classes of k + 1 members
    entry = F.struct((-F.col("score")).alias("least"), "vec_id")
    top = every.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k + 1).alias("top"))
    own = asked.join(top, "query").select("query_id", F.posexplode(F.slice(F.filter("top", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("at", "e"))
    return own.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.least")).alias("score"))
