"""Streams with state: the same result however they are cut into batches, equal to a plain replay."""

import datetime
import random
import shutil
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riftline.streaming import stateful

EPOCH = datetime.datetime(2024, 1, 1)


def replayed(spark, rows, schema, cuts, build, mode):
    """Writes rows in so many files, which the stream reads one a batch, and returns all that it gave."""
    path = tempfile.mkdtemp(prefix="riftline-test-")
    out = []
    step = max(1, -(-len(rows) // cuts))
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = build(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    shutil.rmtree(path, ignore_errors=True)
    return out


def simulated(rows, every, upto):
    """The feed of each key, flush by flush, up to a time."""
    out, keys = [], {r[0] for r in rows}
    for key in keys:
        own = sorted((int((r[1] - EPOCH).total_seconds() * 1000), r[2], r[3]) for r in rows if r[0] == key)
        buffer, at, until = [], 0, 0
        while until <= upto:
            until = (own[at][0] // every + 1) * every if not buffer and at < len(own) else until + every
            if until > upto:
                break
            fresh = []
            while at < len(own) and own[at][0] < until:
                fresh.append(own[at][1:])
                at += 1
            buffer += sorted(fresh)
            buffer.sort(key=lambda e: stateful.PRIORITY.get(e[1], 9))
            out += [(key, until, i, *e) for i, e in enumerate(buffer[:20])]
            buffer = buffer[20:]
            buffer = buffer[-100:] if len(buffer) > 200 else buffer
            if not buffer and at == len(own):
                break
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 4])
def test_highlights_equal_a_plain_replay(spark, cuts):
    rng = random.Random(3)
    kinds = ["split", "clip_pileup", "new_pair_cluster", "discordant", "other"]
    rows = []
    for i in range(3000):  # bursts of hundreds in a window, then quiet
        ms = rng.choice([1000, 1040, 1090, 1500, 1510, 4000]) + rng.randrange(30) if i < 2000 else 9000 + rng.randrange(400)
        rows.append((rng.choice(["a", "a", "b"]), EPOCH + datetime.timedelta(milliseconds=ms), i, rng.choices(kinds, (1, 2, 3, 8, 1))[0]))
    rows.sort(key=lambda r: r[1])
    rows.append(("a", EPOCH + datetime.timedelta(seconds=60), 5000, "split"))
    base = int((EPOCH - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    build = lambda s: stateful.highlights(s.withWatermark("ts", "1 second"), "job")
    got = sorted((k, u - base, *x) for b in replayed(spark, rows, "job string, ts timestamp, seq long, kind string", cuts, build, "append") for k, u, *x in b)
    want = simulated(rows, stateful.FLUSH_MS, 59_000)
    assert got == want and len({u for _, u, *_ in want}) > 40


def test_deltas_sum_to_the_final_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["chr1-chr2", "chr1-chr3", "chr4-chr9"]), rng.randrange(3)) for _ in range(500)]
    batches = replayed(spark, rows, "pair string, n long", 5, lambda s: stateful.changes(s, "pair"), "update")
    held, total = {}, {}
    for p, n in rows:
        total[p] = total.get(p, 0) + n
    for batch in batches:
        for pair, now, delta in batch:
            held[pair] = held.get(pair, 0) + delta
            assert held[pair] == now
    assert held == total and sum(map(len, batches)) > 10


def viewed(events):
    """A job's view by a plain fold of its events."""
    v = {"mode": "idle", "stage": None, "error": None, "pct": None, "reads": None, "bytes": None, "calls": 0, "top_bins": None, "highlights": 0}
    lists = {"throughput": [], "waterfall": [], "arcs": []}
    chroms, bins, density = {}, {}, {}
    order = [*map(str, range(1, 23)), "X", "Y"]
    for seq, kind, ca, pa, cb, pb, count, pct, reads, nbytes, disc, split, clip, start, evidence, text in sorted(events):
        name = "chr" + (ca or "").removeprefix("chr")
        if kind == "scan.started":
            v |= {"mode": "streaming", "stage": "extraction"}
        elif kind == "scan.stage_changed":
            v["stage"] = text
        elif kind == "scan.progress":
            v |= {k: x for k, x in (("pct", pct), ("reads", reads), ("bytes", nbytes)) if x is not None}
        elif kind == "scan.throughput":
            lists["throughput"].append((seq, reads, nbytes, disc, split))
        elif kind == "chrom.progress":
            chroms[name] = (pct, reads, disc, split, "complete" if pct >= 100 else "scanning")
        elif kind == "chrom.bin_update" and name in chroms:
            bins.setdefault(name, {})[start] = (disc, split, clip)
        elif kind == "pair.density":
            at = [order.index(c.removeprefix("chr")) if c.removeprefix("chr") in order else -1 for c in (ca, cb)]
            if min(at) >= 0:
                density[min(at), max(at)] = count
            arc = [x for x in lists["arcs"] if (x["a"], x["b"]) == (ca, cb)]
            if arc:
                arc[0] |= {"n": count, "seq": seq}
            elif count >= 2:
                lists["arcs"] = [*lists["arcs"], {"a": ca, "pa": 0, "b": cb, "pb": 0, "n": count, "seq": seq}][-200:]
        elif kind == "evidence.highlight":
            v["highlights"] += 1
            lists["waterfall"].append((v["highlights"], seq, evidence, ca, pa, cb, pb))
            for x in lists["arcs"]:
                if (x["a"], x["b"]) == (ca, cb):
                    x |= {"pa": pa, "pb": pb, "seq": seq}
        elif kind == "provisional.top_bins":
            v["top_bins"] = text
        elif kind == "scan.completed":
            v |= {"stage": "validation", "pct": 100.0}
        elif kind == "validation.started":
            v["stage"] = "validation"
        elif kind == "validation.call_emitted":
            v["calls"] += 1
        elif kind == "validation.completed":
            v |= {"mode": "validated", "stage": "completed"}
        elif kind == "scan.cancelled":
            v |= {"mode": "idle", "stage": "cancelled", "error": "Scan cancelled"}
        elif kind == "error":
            v |= {"stage": "failed", "error": text}
        elif kind == "chrom_pair.matrix":
            density = {(0, 1): 5, (2, 23): 7}
    shown = [lists["throughput"][-60:], lists["waterfall"][-500:], [tuple(x.values()) for x in lists["arcs"]]]
    return [*v.values(), *shown, sorted((c, *x, len(bins.get(c, {}))) for c, x in chroms.items()), sorted((*k, n) for k, n in density.items())]


@pytest.mark.parametrize("cuts", [1, 5])
def test_client_view_equals_a_plain_fold(spark, cuts):
    rng = random.Random(9)
    matrix = [[0] * 24 for _ in range(24)]
    matrix[0][1] = matrix[1][0] = 5
    matrix[2][23] = matrix[23][2] = 7
    kinds = [*stateful.STEPS, "scan.progress", "scan.throughput", "chrom.progress", "chrom.bin_update", "pair.density", "evidence.highlight", "provisional.top_bins", "validation.call_emitted", "chrom_pair.matrix", "clustering.scale", "unknown"]
    weight = [0.3] * len(stateful.STEPS) + [3, 6, 3, 9, 40, 40, 1, 1, 0.1, 1, 1]
    contigs = ["chr1", "2", "chrX", "chrUn", *(f"chr{i}" for i in range(3, 23))]
    rows = []
    for i in range(2500):
        kind = rng.choices(kinds, weight)[0]
        text = str(matrix).replace(" ", "") if kind == "chrom_pair.matrix" else f"text {i}"
        maybe = lambda x: None if kind == "scan.progress" and rng.random() < 0.4 else x  # noqa: B023, E731
        rows.append((rng.choice("aaab"), i, kind, rng.choice(contigs), rng.randrange(10**6), rng.choice(contigs), rng.randrange(10**6), rng.randrange(9), maybe(rng.choice([5.0, 50.0, 100.0])), maybe(rng.randrange(10**6)), maybe(rng.randrange(10**9)), rng.randrange(9), rng.randrange(9), rng.randrange(9), rng.randrange(40) * 1000, rng.choice(["split", "discordant"]), text))
    batches = replayed(spark, rows, f"job string, {stateful.EVENT}", cuts, stateful.client_view, "update")
    last = {r[0]: r[1:] for batch in batches for r in batch}
    plain = lambda x: [tuple(y) if isinstance(y, tuple) else y for y in x] if isinstance(x, list) else x
    for job in "ab":
        assert [plain(x) for x in last[job]] == viewed([r[1:] for r in rows if r[0] == job])
    assert len(last["a"][11]) == 200 and len(last["a"][10]) == 500  # arcs and waterfall were full


def told(n, seed, contigs):
    """Events of one job."""
    rng = random.Random(seed)
    kinds = [*stateful.STEPS, "scan.progress", "scan.throughput", "chrom.progress", "chrom.bin_update", "pair.density", "evidence.highlight", "provisional.top_bins", "validation.call_emitted", "unknown"]
    weight = [0.3] * len(stateful.STEPS) + [3, 6, 1, 9, 40, 40, 1, 1, 1]
    rows = []
    for i in range(n):
        kind = rng.choices(kinds, weight)[0]
        maybe = None if kind == "scan.progress" and rng.random() < 0.7 else rng.randrange(10**12)
        rows.append((i, kind, rng.choice(contigs), rng.randrange(10**6), rng.choice(contigs), rng.randrange(10**6), rng.randrange(9), rng.choice([5.0, 100.0]), maybe, maybe, *(rng.randrange(9) for _ in range(3)), rng.randrange(40) * 1000, rng.choice(["split", "discordant"]), f"text {i}"))
    return rows


@pytest.mark.parametrize("n", [3, 24])
def test_client_view_of_events_that_tasks_read_mixed(spark, n):
    """Events of six files in one batch, in no order; with 24 contigs arcs push each other out."""
    rows = told(9000, n, [f"chr{i}" for i in range(1, n + 1)])
    path = tempfile.mkdtemp(prefix="riftline-test-")
    mixed = random.Random(1).sample(rows, len(rows))
    for i in range(6):
        spark.createDataFrame([("a", *r) for r in mixed[i::6]], f"job string, {stateful.EVENT}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    out = []
    stream = stateful.client_view(spark.readStream.schema(f"job string, {stateful.EVENT}").parquet(f"{path}/in"))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    shutil.rmtree(path, ignore_errors=True)
    assert [[tuple(y) for y in x] if isinstance(x, list) else x for x in out[0][1:]] == viewed(rows) and len(out) == 1


def test_a_client_state_is_given_few_of_many_events():
    names = [c.split()[0] for c in stateful.EVENT.split(", ")]
    rows = told(40_000, 5, ["chr1", "chr2", "chr3"])
    table = pa.table({"job": ["a"] * len(rows)} | {c: [r[i] for r in rows] for i, c in enumerate(names)})
    kept = stateful.deciding(table)
    assert 500 < kept.num_rows < 1000
    counted = {k: sum(r["times"] for r in kept.select(["kind", "times"]).to_pylist() if r["kind"] == k) for k in ("evidence.highlight", "validation.call_emitted")}
    assert counted == {k: sum(r[1] == k for r in rows) for k in counted}
