"""Near-duplicate documents by chosen-path set similarity join.

Each document is its set of five-word shingle hashes and has 256 minwise tokens, of which
64 are whole and choose paths, and one byte each serves to compare. Documents with equal
sets are one class. Class representatives are branched in independent trees: at
each node one minwise coordinate is chosen by the node's hash (a second one with
probability 1/3, so that a pair at similarity 0.75 is expected to keep one common branch),
and a document goes to the branch of its token there. A node of few documents is compared
exhaustively; larger ones branch on. With ten trees a pair at the threshold is missed with
probability under 1e-6 where one level suffices and about 1e-3 where four are needed.

What a node's comparison returns is linear in its size: a spanning forest of the pairs
whose tokens agree often enough, best first. These are confirmed on full sets. Then nodes
whose documents aren't all connected yet return the other such pairs across components,
which are confirmed as well, so that no link that matters for a component is lost to the
forest. Nodes that are still large at the last level (near copies of one document) are
compared with a document of their own, then those left apart with all others, on full sets,
by blocks.

Defined results: null or empty texts have empty sets and stand alone; rows that share a
doc_id count as one document, which links with all that the set of any of its rows links with; a row with a null doc_id stands alone and is kept; other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, in_map, stored
from .graph import components
from .shingles import mixed, shingle_sets, slices

TOKENS = 256
PATHS = 64
TREES = 10
LEVELS = 5
LEAF = 64
#: Pairs that agree on fewer than this share of tokens aren't compared on full sets: four standard deviations below 0.75.
LIKELY = 0.64
#: Bits of the map of documents that may have links.
BITS = 1 << 24

_TURN = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64))
_ODD = mixed(np.arange(1001, 1001 + TOKENS, dtype=np.uint64)) | np.uint64(1)


def tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens of non-empty sets, one row each: those that choose paths, and a byte of each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    paths, every = np.empty((len(sets), PATHS), np.uint32), np.empty((len(sets), TOKENS), np.uint8)
    for i in range(TOKENS):
        least = np.minimum.reduceat((flat ^ _TURN[i]) * _ODD[i], starts) >> np.uint64(32)
        every[:, i] = (mixed(least) & np.uint64(255)).astype(np.uint8)
        if i < PATHS:
            paths[:, i] = least
    return paths, every


def _key(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in slices(batch.column(1)):
            sets = shingle_sets(data, at)
            full = [x for x in sets if len(x)]
            rows = iter(list(zip(*tokens(full), strict=True)) if full else ())
            both = [next(rows) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[a:b],
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_key(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([x and x[0].tobytes() for x in both], pa.binary()),
                    pa.array([x and x[1].tobytes() for x in both], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "same", "paths", "tokens"],
            )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the shingle set, and its minwise tokens."""
    return docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, n_shingles long, same binary, paths binary, tokens binary")


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, node, paths) to (id, node) of the next level."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        token = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, PATHS)
        row, ids = np.arange(len(node)), batch.column(0).to_numpy(zero_copy_only=False)
        out_ids, out_nodes = [], []
        for k in range(2):
            pick = mixed(node + np.uint64(7 + k))
            go = row if k == 0 else row[(pick >> np.uint64(40)) % np.uint64(3) == 0]
            at = (pick % np.uint64(PATHS)).astype(np.int64)[go]
            out_ids.append(ids[go])
            out_nodes.append(mixed(mixed(node[go] + np.uint64(31)) ^ mixed(token[go, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_nodes).view(np.int64))], names=["id", "node"])


def _agreement(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of equal tokens of all pairs; 0 where the sizes alone rule a link out."""
    same = np.empty((len(token), len(token)), np.float32)
    for i, row in enumerate(token):
        same[i] = (token == row).mean(1)
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    return np.where(100 * low >= 75 * high, same, 0)


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = x = up[up[x]]
    return x


def _pairs_of(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Likely pairs of each node: a spanning forest, or all that cross components.

    Where more pairs cross components than twice the members, the members themselves are
    returned instead, with their node and no partner.
    """
    for batch in batches:
        found = set()
        for node, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = [m["id"] for m in members]
            token = np.frombuffer(b"".join(m["tokens"] for m in members), np.uint8).reshape(-1, TOKENS)
            near = np.triu(_agreement(token, np.array([m["n"] for m in members])), 1)
            i, j = np.nonzero(near >= LIKELY)
            if not forest:
                label = np.array([m["component"] for m in members])
                apart = label[i] != label[j]
                if apart.sum() > 2 * len(ids):
                    found.update((x, None, node) for x in ids)
                else:
                    found.update((min(ids[a], ids[b]), max(ids[a], ids[b]), None) for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True))
                continue
            up = list(range(len(ids)))
            for e in np.argsort(-near[i, j], kind="stable").tolist():
                a, b = _root(up, int(i[e])), _root(up, int(j[e]))
                if a != b:
                    up[a] = b
                    found.add((min(ids[i[e]], ids[j[e]]), max(ids[i[e]], ids[j[e]]), None))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "node"])


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, once for each different set. A map of bits of fixed size spares most others the shuffle."""
    held = bit_map(ids, "id", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_map(held, batch.column(0).to_numpy(zero_copy_only=False))))
            for a, b, data, at in slices(batch.column(1)):
                sets = [x.tobytes() for x in shingle_sets(data, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([_key(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "same", "shingles"])

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "id long, same binary, shingles binary")
    return rows.join(ids, "id", "left_semi").dropDuplicates(["id", "same"]).select("id", "shingles")


def linked(x: bytes, y: bytes) -> bool:
    """Whether two sets have a Jaccard similarity of at least 0.75."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= 75 * (len(both) - same)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have a Jaccard similarity of at least 0.75."""
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members of small nodes (node, id), and of nodes that are large even at the last level."""
    rows, hot, small = None, None, []
    for level in range(LEVELS):
        if level == 0:
            at = reps.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(TREES).cast("long"))).alias("node"), "paths")
        else:
            if hot is None:  # few documents branch beyond the first level
                hot = stored(reps.select("id", "paths").join(rows.select("id").distinct(), "id"))
            at = rows.join(hot, "id").select("id", "node", "paths")
        below = stored(at.mapInArrow(_branches, "id long, node long").distinct())
        counts = below.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        rows = stored(below.join(counts, "node"))
        small.append(rows.where(F.col("members") <= LEAF).select("node", "id"))
        rows = rows.where(F.col("members") > LEAF).select("node", "id")
        if rows.isEmpty():
            rows = None
            break
    every = small[0]
    for x in small[1:]:
        every = every.union(x)
    return every, rows


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between representatives (id, n, tokens), enough for their components."""
    small, large = _nodes(reps)
    # the same few documents meet in most trees: keep one node of each membership
    groups = stored(small.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct().withColumn("node", F.monotonically_increasing_id()))
    members = groups.select("node", F.explode("ids").alias("id"))
    known = reps.select("id", "n", "tokens")
    member = F.struct("id", "n", "tokens")
    pairs = members.join(known, "id").groupBy("node").agg(F.collect_list(member).alias("m")).select("node", "m").mapInArrow(lambda b: _pairs_of(b, True), "a long, b long, node long").select("a", "b")
    if large is not None:
        large = stored(large)
        hubs = stored(large.groupBy("node").agg(F.min_by("id", F.xxhash64("id", "node")).alias("hub")))
        pairs = pairs.union(large.join(hubs, "node").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")))
    pairs = stored(pairs.distinct())
    # every document with a likely partner is in some pair of the forests
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = stored(_sets_of(docs, ids))
    first = stored(_confirmed(pairs, sets))
    labels = components(first)

    # what is left: likely pairs across components
    apart = _with_labels(members, labels)
    mixed_nodes = apart.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
    member = F.struct("id", "n", "tokens", "component")
    more = apart.join(mixed_nodes, "node").join(known, "id").groupBy("node").agg(F.collect_list(member).alias("m")).select("node", "m").mapInArrow(lambda b: _pairs_of(b, False), "a long, b long, node long")
    more = stored(more.distinct())
    few = stored(more.where("b is not null").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    joined = labels.select(F.col("component").alias("a"), F.col("id").alias("b"))  # stands for the links found first
    out = joined if few.isEmpty() else joined.union(stored(_confirmed(few, sets)))
    dense = more.where("b is null").select("node", F.col("a").alias("id"))
    dense = stored(dense if large is None else dense.union(large.select("node", "id")))
    return out if dense.isEmpty() else out.union(_across(dense, labels, known, sets))


def _cross_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the components of two blocks' documents, which stand for those between documents."""
    x, y = left.to_pylist(), right.rename_columns([c.removeprefix("r_") for c in right.column_names]).to_pylist()
    found = set()
    if x and y:
        token = np.frombuffer(b"".join(m["tokens"] for m in y), np.uint8).reshape(-1, TOKENS)
        for m in x:
            agree = (token == np.frombuffer(m["tokens"], np.uint8)).mean(1)
            done = {m["component"]}
            for k in np.argsort(-agree, kind="stable").tolist():
                if agree[k] < LIKELY:
                    break
                if y[k]["component"] not in done and linked(m["shingles"], y[k]["shingles"]):
                    done.add(y[k]["component"])
                    found.add((m["component"], y[k]["component"]))
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _across(large: DataFrame, labels: DataFrame, known: DataFrame, sets: DataFrame) -> DataFrame:
    """Links, across components, of nodes that are large or have many likely pairs across.

    In each node the documents outside its most frequent component are dealt into blocks; each
    block meets every block of the node's members. A node of any size is spread over tasks,
    each of which holds two blocks; the documents of all large nodes together are dealt as
    one node if they share that component.
    """
    own = _with_labels(large, labels)
    main = own.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    at = own.join(main, "node")
    at = stored(at.select("main", "id", "component").distinct())
    sizes = stored(
        at.groupBy("main").agg(F.count("*").alias("all"), F.count_if(F.col("component") != F.col("main")).alias("out")).where("out > 0")
        .select("main", F.ceil(F.col("all") / LEAF).cast("int").alias("blocks"), F.ceil(F.col("out") / LEAF).cast("int").alias("outs"))
    )
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    rows = at.join(sizes, "main").join(known, "id").join(sets, "id")
    left = rows.where("component <> main").withColumn("o", place(1, F.col("outs"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rows.withColumn("k", place(2, F.col("blocks"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)))
    pick = ["main", "o", "k", "id", "component", "tokens", "shingles"]
    return stored(left.select(*pick).groupBy("main", "o", "k").cogroup(right.select(*pick).toDF(*(f"r_{c}" for c in pick)).groupBy("r_main", "r_o", "r_k")).applyInArrow(_cross_links, "a long, b long").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    ``component_id`` is the smallest doc_id that links of Jaccard similarity 0.75 or more
    reach; ``kept`` marks the document of that id.
    """
    rows = stored(signed(docs))
    classes = rows.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("id"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("paths", "doc_id").alias("paths"), F.min_by("tokens", "doc_id").alias("tokens"))
    reps = stored(classes)
    found = components(links(reps, docs).union(rows.where("same is not null and doc_id is not null").join(reps.select("same", "id"), "same").where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))))
    out = rows.select("doc_id", "n_shingles").join(found, rows["doc_id"] == found["id"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("near_copy")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["near_copy"], "left_anti")
