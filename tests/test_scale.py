"""Steps that are dealt to parts or runs, against plain versions of them."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from riftline.operators import background, clips, evidence
from riftline.streaming import stateful


def test_tail_beyond_six_thousand_terms():
    from math import exp, fsum, lgamma, log

    k, r, rate = 700, 1.03, 9956.0
    mass = lambda i: exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * log(r / (r + rate)) + i * log(rate / (r + rate)))
    p = 1 / (1 + rate / r)
    got = background.nb_tail(k, r, p, rate)
    assert abs(got - fsum(map(mass, range(k, 400_000)))) < 1e-9 and got - fsum(map(mass, range(k, k + 6000))) > 0.1


def test_islands_across_parts(spark):
    rng = random.Random(3)
    at = [evidence.PART * rng.randrange(-2, 4) + rng.randrange(-900, 900) for _ in range(400)] + list(range(-500, 3 * evidence.PART, 400))
    rows = [(k, p) for p in at for k in "xy" if k == "y" or p % 3]
    want, held = {}, {}
    for k, p in sorted(rows):
        last, first = held.get(k, (None, None))
        held[k] = (p, p if last is None or p - last > 500 else first)
        want[k, p] = held[k][1]
    out = evidence.islands(spark.createDataFrame(rows, "k string, pos long"), ["k"], "pos", 500, "isl").collect()
    assert len(out) == len(rows) and {(r.k, r.pos): r.isl for r in out} == want


def test_islands_are_not_ordered_by_whole_keys(spark):
    frame = spark.createDataFrame([("x", 1)], "k string, pos long")
    plan = evidence.islands(frame, ["k"], "pos", 500, "isl")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_cascade_orders_once(spark):
    rows = spark.createDataFrame([("a", "b", 1, 1)], "ca string, cb string, pos_a long, pos_b long")
    assert evidence.cascade(rows)._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1


def test_cascade_of_one_scale_equals_all(spark):
    rng = random.Random(4)
    rows = [("a", "b", rng.randrange(-30_000, 30_000), rng.randrange(5_000)) for _ in range(600)]
    frame = spark.createDataFrame(rows, "ca string, cb string, pos_a long, pos_b long")
    want = rows
    for scale in (1_000_000, 100_000, 10_000, 1_000):
        cells = [(a // scale, b // scale) for _, _, a, b in want]
        want = [r for r, c in zip(want, cells, strict=True) if cells.count(c) >= 2]
    assert sorted(map(tuple, evidence.cascade(frame).collect())) == sorted(want) != sorted(rows)


def test_cluster_medians_across_parts(spark):
    import statistics

    rng = random.Random(6)
    rows = [("a", "b", "++", 0, 0, rng.randrange(-10, 4 * evidence.PART), rng.randrange(7), rng.choice((0, 20, 31)), rng.choice(("split", "discordant")), rng.choice((0, 1024))) for _ in range(101)]
    frame = spark.createDataFrame(rows, "ca string, cb string, orient string, isl_a long, isl_b long, pos_a long, pos_b long, mapq int, evidence_type string, flag int")
    got = evidence.clusters(frame.limit(100)).first()
    rows = rows[:100]
    for i, s in ((5, "a"), (6, "b")):
        x = [r[i] for r in rows]
        assert (got[f"median_{s}"], got[f"lo_{s}"], got[f"hi_{s}"], got[f"starts_{s}"]) == (int(statistics.median(x)), min(x), max(x), len(set(x)))
    assert got.median_mapq == statistics.median(r[7] for r in rows if r[7]) and got.dup_fraction == sum(r[9] > 0 for r in rows) / 100
    assert (got.support, got.sr + got.pr) == (100, 100)


def test_medians_are_of_counted_rows(spark):
    frame = spark.createDataFrame([], "ca string, cb string, orient string, isl_a long, isl_b long, pos_a long, pos_b long, mapq int, evidence_type string, flag int")
    assert "median(pos" not in evidence.clusters(frame)._jdf.queryExecution().analyzed().toString()


def test_sequences_go_to_the_nearest_pileup(spark):
    rng = random.Random(8)
    rows = [("chr1", "left", rng.randrange(300), f"S{i:03d}") for i in range(400)]
    frame = spark.createDataFrame(rows, "chrom string, clip_side string, pos long, clip_seq string")
    found = clips.pileups(frame).localCheckpoint()
    piles, want = [r.pos for r in found.collect()], {}
    for _, _, pos, seq in rows:
        away, pile = min((abs(pos - p), p) for p in piles)
        if away <= 10:
            want.setdefault(pile, []).append((pos, seq))
    want = {p: [s for _, s in sorted(x)[:10]] for p, x in want.items()}
    assert {r.pos: r.seqs for r in clips.sequences(frame, found).select("pos", F.col("seqs")).collect()} == want


def test_clips_alone_are_not_shuffled(spark):
    from riftline.operators import reads

    schema = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, sa string, seq string"
    row = ("r", 0, "1", 5, 60, "30S20M", "2", 9, 0, "chr3,5,+,60M40S,60,0;", "A" * 50)
    frame = spark.createDataFrame([row, row], schema)
    alone = reads.evidence_rows(frame, kinds=("clip",))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert alone.collect() == reads.evidence_rows(frame).where("evidence_type = 'clip'").select(alone.columns).collect()


def test_batches_larger_than_a_run_come_in_order():
    rng = random.Random(9)
    rows = [Row(seq=rng.randrange(50), text=str(i)) for i in range(1000)]
    got = list(stateful.in_order(iter(rows), run=64, block=10))
    assert got == sorted(rows, key=lambda r: r.seq) and got[0].text == sorted(rows, key=lambda r: r.seq)[0].text
    assert list(stateful.in_order(iter(rows[:5]), run=5)) == sorted(rows[:5], key=lambda r: r.seq) and not list(stateful.in_order(iter([])))


def test_cells_are_dealt_to_more_tasks_than_the_session_has(spark):
    rows = [("a", "b", i // 3 * 5_000, i // 3 * 7_000) for i in range(900)] + [("a", "b", -7, i * 1_000) for i in range(50)]
    frame = spark.createDataFrame(rows, "ca string, cb string, pos_a long, pos_b long")
    few, many = evidence.cascade(frame), evidence.cascade(frame, parts=evidence.parts(frame, 50))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "20), REPARTITION_BY_NUM" in plan
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 900


def test_crowded_cells_are_not_ordered_in_one_task(spark, monkeypatch):
    rng = random.Random(13)
    rows = [("a", "b", 5_000 + i % 900, 7_000) for i in range(300)] + [("a", None, None, i % 2) for i in range(90)] + [("a", "b", rng.randrange(90_000), rng.randrange(30_000)) for _ in range(800)]
    frame = spark.createDataFrame(rows, "ca string, cb string, pos_a long, pos_b long")
    parts = evidence.parts(frame, 50)
    crowd = evidence.crowded(frame, parts, each=60)
    assert sorted(map(tuple, crowd.select(evidence.CELL).collect()), key=str) == [("a", "b", 5, 7), ("a", None, None, 0)]
    got, held = evidence.cascade(frame, parts=parts, crowd=crowd), []
    key = lambda x: sorted(map(str, x.collect()))
    assert key(got) == key(evidence.cascade(frame)) and 345 <= got.count() < len(rows)
    assert key(evidence.survivors(frame, parts)) == key(evidence.survivors(frame)) == key(got)
    # what is dealt and ordered has none of the crowd's reads
    find = evidence.crowded
    monkeypatch.setattr(evidence, "crowded", lambda canon, parts: find(canon, parts, each=60))
    monkeypatch.setattr(evidence, "dealt", lambda rows, keys, parts: held.append(rows.count()) or rows)
    evidence.survivors(frame, parts)
    assert held and held[0] <= len(rows) - 345


def test_few_rows_are_dealt_to_few_tasks(spark, monkeypatch):
    frame = spark.range(25)
    monkeypatch.setattr(evidence, "ROWS", 10)
    assert [evidence.fewer(k, frame) for k in (None, 50, 200, 201)] == [None, 50, 200, 3] and evidence.fewer(300, frame, 16) == 1
    rows = spark.createDataFrame([("a", "b", "++", i * 1_000, 5) for i in range(25)], "ca string, cb string, orient string, pos_a long, pos_b long")
    held, store = [], evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df: held.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    assert evidence.clustered(rows, parts=300).count() == 25
    assert [", 300" in plan for plan in held if "isl_a_part" in plan or "isl_b_part" in plan][0] and not any(", 300" in plan for plan in held if "isl_b_part" in plan)


def test_clusters_leave_names_out(spark, monkeypatch):
    from riftline.plans import queries

    held, store = [], evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df: held.append(df.columns) or store(df))
    assert queries._clusters(spark, "/root/testdata/sf0.001").columns[-1] == "event_id"
    assert held and not any("read_name_hash" in columns for columns in held)


def test_islands_are_dealt_to_more_tasks_than_the_session_has(spark, monkeypatch):
    rng = random.Random(10)
    rows = [("a", "b", "++", rng.randrange(40) * 300_000 + rng.randrange(900), rng.randrange(30) * 400_000 + rng.randrange(900)) for _ in range(600)]
    frame = spark.createDataFrame(rows, "ca string, cb string, orient string, pos_a long, pos_b long")
    held, store = [], evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df: held.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    few, many = evidence.clustered(frame), evidence.clustered(frame, parts=evidence.parts(frame, 50))
    assert sum("RepartitionByExpression" in plan for plan in held) == 2  # one a side, none without ``parts``
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 600


def test_counted_positions_are_dealt_to_more_tasks_than_the_session_has(spark):
    rng = random.Random(11)
    rows = [("a", "b", "++", i % 7, 0, rng.randrange(3 * evidence.PART), rng.randrange(900), 30, "split", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "ca string, cb string, orient string, isl_a long, isl_b long, pos_a long, pos_b long, mapq int, evidence_type string, flag int")
    few, many = evidence.clusters(frame), evidence.clusters(frame, parts=evidence.parts(frame, 20))
    assert "RepartitionByExpression" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 7


def test_evidence_is_dealt_to_more_tasks_than_the_session_has(spark):
    from riftline.operators import reads

    schema = "qname string, flag int, chrom string, pos long, mapq int, cigar string, mate_chrom string, mate_pos long, tlen long, sa string, seq string"
    rows = [(f"r{i % 60}", 0, "1", i % 90, 60, "30S20M", "2", 9, 0, "chr3,5,+,60M40S,60,0;", "A" * 50) for i in range(300)]
    frame = spark.createDataFrame(rows, schema)
    few, many = reads.evidence_rows(frame), reads.evidence_rows(frame, parts=evidence.parts(frame, 20))
    assert "16), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    text = lambda x: sorted(map(str, x.collect()))
    assert text(many) == text(few) and many.where("evidence_type = 'discordant'").count() == 60


def test_intervals_are_merged_by_parts(spark, monkeypatch):
    from riftline.operators import annotate

    rng = random.Random(12)
    far = 6 * evidence.PART
    rows = [(t, "c", x, x + rng.choice((0, 40, 3_000))) for t in "uv" for x in (rng.randrange(-far, far) for _ in range(500))]
    rows += [("u", "c", evidence.PART - 9, 3 * evidence.PART + 5), ("u", "c", 3 * evidence.PART + 5, 3 * evidence.PART + 6), ("v", "c", -far, far), ("w", "c", evidence.PART - 5, evidence.PART - 1), ("w", "c", evidence.PART, evidence.PART)]
    want = []
    for t, c, lo, hi in sorted(rows):
        if want and want[-1][0] == t and lo <= want[-1][3]:
            want[-1][3] = max(want[-1][3], hi)
        else:
            want.append([t, c, lo, hi])
    frame = spark.createDataFrame(rows, "track string, chrom string, start_pos long, end_pos long")
    held, store = [], annotate.stored
    monkeypatch.setattr(annotate, "stored", lambda df: held.append(df._jdf.queryExecution().optimizedPlan().toString()) or store(df))
    for parts in (None, evidence.parts(frame, 50)):
        got = annotate.merged_intervals(frame, parts).select("track", "chrom", "start_pos", "end_pos")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 300
    assert ["RepartitionByExpression" in plan for plan in held] == [False, True]


def test_first_generation_tiers_make_clusters_once(spark):
    from riftline.plans.livedata import QUERIES

    plan = QUERIES["v1_tier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" in plan and "percentile" not in plan
