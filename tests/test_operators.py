import math

from riftline.operators import annotate, background, tiers
from riftline.sources import files


def test_nb_tail_is_the_direct_sum():
    r, p = 3.0, 0.4
    mass = lambda k: math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(p) + k * math.log(1 - p))
    for obs in (1, 4, 12):
        want = 1 - math.fsum(mass(k) for k in range(obs))
        assert math.isclose(background.nb_tail(obs, r, p, r * (1 - p) / p), want, rel_tol=1e-9)


def test_poisson_tail():
    want = 1 - math.fsum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4))
    assert math.isclose(background.poisson_tail(4, 2.5), want, rel_tol=1e-12)
    assert background.poisson_tail(0, 2.5) == 1 and background.poisson_tail(3, 0) == 0


def test_bh_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9]
    got = sorted(r["q"] for r in background.bh_adjusted(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect())
    want = sorted(min(min(p[j] * len(p) / (sum(y <= p[j] for y in p)) for j in range(i, len(p))), 1) for i in range(len(p)))
    assert all(math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_merge_keeps_support(spark):
    fields = "ca string, cb string, orient string, median_a long, median_b long, support long, sr long, pr long, event_id string"
    rows = [("a", "b", "++", 0, 0, 3, 1, 2, "x"), ("a", "b", "++", 4000, 4000, 4, 0, 4, "y"), ("a", "b", "++", 8000, 8000, 5, 0, 5, "z"), ("a", "b", "+-", 1, 1, 9, 9, 0, "w")]
    got = sorted((r["event_id"], r["support"]) for r in tiers.anchored(spark.createDataFrame(rows, fields)).collect())
    assert got == [("w", 9), ("x", 7), ("z", 5)]  # z is within the window of y, but not of the anchor x


def test_bed_and_bnd(spark, tmp_path):
    (tmp_path / "x.bed").write_text("# c\ntrack x\n\nchr1\t5\t9\nchr1\tbad\t9\nchr1\t7\n")
    assert [tuple(r)[1:4] for r in files.bed(spark, str(tmp_path / "x.bed"), "t").collect()] == [("chr1", 5, 9)]
    (tmp_path / "x.vcf").write_text("#h\nchr1\t10\ti\tN\tN[chr2:321682[\t.\tPASS\tI\nchr1\t10\ti\tN\tN]chr1:3]\t.\tPASS\tI\n")
    assert [(r.chrom_b, r.pos_b) for r in files.bnd_vcf(spark, str(tmp_path / "x.vcf"), "c").collect()] == [("chr2", 321682)]


def test_merged_intervals(spark):
    rows = spark.createDataFrame([("t", "c", 1, 5), ("t", "c", 5, 9), ("t", "c", 2, 3), ("t", "c", 11, 12)], "track string, chrom string, start_pos long, end_pos long")
    assert sorted(tuple(r)[2:] for r in annotate.merged_intervals(rows).collect()) == [(1, 9), (11, 12)]


def test_clip_pileups_against_brute_force(spark):
    import random

    from riftline.operators import clips

    rng = random.Random(5)
    rows = [("chr1", rng.choice(("left", "right")), rng.randrange(400)) for _ in range(300)]
    want = set()
    for side in ("left", "right"):
        groups = []
        for pos in sorted(p for _, s, p in rows if s == side):
            if groups and pos - groups[-1][0] <= 10:
                groups[-1].append(pos)
            else:
                groups.append([pos])
        want |= {("chr1", side, g[len(g) // 2], len(g)) for g in groups if len(g) >= 4}
    got = clips.pileups(spark.createDataFrame(rows, "chrom string, clip_side string, pos long")).select("chrom", "clip_side", "pos", "depth").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_truth_takes_each_call_once(spark):
    from riftline.operators import resolve

    truth = spark.createDataFrame([(1, "chr1", 100, "chr2", 100), (2, "2", 110, "1", 105), (3, "1", 9000, "2", 9000)], "truth_id long, chrom_a string, pos_a long, chrom_b string, pos_b long")
    calls = spark.createDataFrame([("x", "chr1", "chr2", 104, 109), ("y", "chr1", "chr2", 600, 600), ("z", "chr3", "chr4", 1, 1)], "event_id string, ca string, cb string, median_a long, median_b long")
    got = resolve.matched(truth, calls)
    assert {tuple(r) for r in got.collect()} == {(1, "x", 13), (2, "y", 985), (3, None, None)}
    assert tuple(resolve.metrics(got, calls).first()) == (2, 1, 1, 0.666667, 0.666667)


def test_reciprocal_absorption(spark):
    from riftline.operators import resolve

    rows = [("a", "++", 1000, 5000, 5, 9.0), ("b", "--", 1500, 5500, 3, 8.0), ("c", "--", 1900, 5100, 2, 7.0), ("d", "++", 2500, 5600, 4, 1.0), ("e", "+-", 1000, 5000, 6, 2.0)]
    calls = spark.createDataFrame([(i, "chr1", "chr2", o, x, y, n, s) for i, o, x, y, n, s in rows], "event_id string, ca string, cb string, orient string, median_a long, median_b long, support long, score double")
    assert {tuple(r) for r in resolve.absorbed(calls).collect()} == {("e", 2.0, None, 6), ("a", 9.0, "b", 8), ("d", 1.0, "c", 6)}


def test_selection_keeps_high_tiers(spark):
    high = [(f"h{i:03d}", ("confirmed", "validated", "likely", "strong_candidate")[i % 4], float(i % 50)) for i in range(130)]
    low = [(f"c{i}", "candidate", 100.0 + i) for i in range(5)]
    rows = spark.createDataFrame([*high, *low, ("f", "filtered", 0.0)], "event_id string, tier string, score double").repartition(7)
    got = tiers.selected(rows).collect()
    want = sorted(high, key=lambda r: (-r[2], r[0]))
    assert [tuple(r) for r in sorted(got, key=lambda r: int(r.cluster_id[4:]))] == [(f"CLU_{i:03d}", *r) for i, r in enumerate(want, 1)]
    top, left = tiers.split(rows, 133)
    assert {r.event_id for r in top.collect()} == {r[0] for r in high} | {"c4", "c3", "c2"} and {r.event_id for r in left.collect()} == {"c0", "c1"}


def test_tiers_against_the_ladder(spark):
    import itertools

    def want(pr, sr, pct, tracks, partners, lcr, p, n_ext):
        unmasked = pct < 95 and "encode_blacklist" not in tracks
        clean = unmasked and partners < 5
        strong = (pr >= 15 and sr == 0 and lcr <= 1.5 and unmasked) or (pr >= 5 and sr >= 1 and clean)
        likely = strong and (sr >= 2 or n_ext >= 1)
        validated = (pr >= 6 and sr >= 3 and p < 1e-6 and clean) or (likely and n_ext >= 2)
        if validated:
            return "confirmed" if n_ext >= 3 else "validated"
        return "likely" if likely else "strong_candidate" if strong else "candidate" if pr >= 3 or sr >= 1 else "filtered"

    cases = list(itertools.product((2, 5, 6, 15), (0, 1, 3), (0.0, 94.0, 95.0, 99.0), ([], ["encode_blacklist"]), (0, 6), (1.0, 2.0), (1e-9, 0.1), (0, 1, 2, 3)))
    rows = [(i, pr, sr, pct if i % 2 else 0.0, 0.0 if i % 2 else pct, tracks, [], partners, 0, lcr, 0.0, 12, 12, p, p, n, False) for i, (pr, sr, pct, tracks, partners, lcr, p, n) in enumerate(cases)]
    fields = "i int, pr int, sr int, segdup_pct_a double, segdup_pct_b double, tracks_a array<string>, tracks_b array<string>, partners_a int, partners_b int, lcr_a double, lcr_b double, starts_a int, starts_b int, p_a double, p_b double, n_ext int, gone boolean"
    got = {r.i: r.tier for r in spark.createDataFrame(rows, fields).select("i", tiers.tier().alias("tier")).collect()}
    assert got == {i: want(*case) for i, case in enumerate(cases)}


def test_identity_of_each_side(spark):
    segdups = spark.createDataFrame([("c1", 1500, 2500, 96.0), ("c1", 2100, 2200, 98.0), ("c2", 0, 10, 91.0)], "chrom string, start_pos long, end_pos long, pct_identity double")
    rows = spark.createDataFrame([("x", "c1", "c2", 1100, 900), ("y", "c1", "c2", 2900, 1000), ("z", "c1", "c3", 3000, 5)], "event_id string, ca string, cb string, median_a long, median_b long")
    got = annotate.with_identity(rows, annotate.best_identity(segdups)).select("event_id", "segdup_pct_a", "segdup_pct_b").collect()
    assert {tuple(r) for r in got} == {("x", 96.0, 91.0), ("y", 98.0, 0.0), ("z", 0.0, 0.0)}


def test_stream_results_lie_in_the_shared_folder(spark):
    import os

    from riftline.storage import shared_dir
    from riftline.streaming import live

    got = live.drained(live.sessions(live.events(spark, "/root/testdata/sf0.001"), "2 hours"))
    assert got.count() and all(shared_dir(spark).removeprefix("file:") in f for f in got.inputFiles())
    folder = os.path.dirname(os.path.dirname(got.inputFiles()[0].removeprefix("file://")))
    assert os.path.isdir(f"{folder}/state/state") and os.path.isdir(f"{folder}/state/commits")


def test_cross_merge_of_counted_positions(spark):
    import random

    rng, reads = random.Random(3), []
    for a in range(0, 60_000, 300):
        b = rng.choice((0, 400, 5000))
        reads += [("c1", "c2", o, a, b, a + rng.randrange(200), b + rng.randrange(200)) for o in ("++", "+-") for _ in range(rng.choice((1, 3, 40)))]
    seen = {}
    for *cluster, x, y in reads:
        xs, ys = seen.setdefault("_".join(map(str, cluster)), ([], []))
        xs.append(x)
        ys.append(y)
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) // 2
    want, last = set(), None
    for event, (xs, ys) in sorted(seen.items(), key=lambda r: (mid(r[1][0]), mid(r[1][1]), r[0])):
        if last and abs(mid(xs) - mid(last[1])) <= 500 and abs(mid(ys) - mid(last[2])) <= 500:
            last = (last[0], last[1] + xs, last[2] + ys)
        else:
            last = (event, xs, ys)
        want.add((event, last[0], len(xs)))
    got = tiers.cross_merged(spark.createDataFrame(reads, "ca string, cb string, orient string, isl_a long, isl_b long, pos_a long, pos_b long"))
    assert {tuple(r) for r in got.collect()} == want and len({r[1] for r in want}) < len(want)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()  # no list of a cluster's reads


def test_breakend_alleles(spark):
    from pyspark.sql import functions as F

    from riftline.functions.scalar import bnd_alt

    rows = spark.createDataFrame([("++",), ("+-",), ("-+",), ("--",)], "o string")
    got = {r.o: r.alt for r in rows.select("o", bnd_alt(F.lit("chr2"), F.lit(7), F.col("o")).alias("alt")).collect()}
    assert got == {"++": "N[chr2:7[", "+-": "N]chr2:7]", "-+": "]chr2:7]N", "--": "[chr2:7[N"}


def test_labels_and_reasons(spark):
    fields = "i int, pr int, sr int, p_a double, p_b double, dup_fraction double, starts_a int, starts_b int, partners_a int, partners_b int, median_mapq double, n_ext int, tracks_a array<string>, tracks_b array<string>, segdup_pct_a double, segdup_pct_b double, lcr_a double, lcr_b double, gone boolean, excluded string, rejected string, tier string"
    base = dict(pr=6, sr=3, p_a=1e-9, p_b=1e-9, dup_fraction=0.0, starts_a=9, starts_b=9, partners_a=1, partners_b=1, median_mapq=60.0, n_ext=0, tracks_a=[], tracks_b=[], segdup_pct_a=0.0, segdup_pct_b=0.0, lcr_a=1.0, lcr_b=1.0, gone=False, excluded=None, rejected=None, tier="validated")
    cases = [
        ({}, "confirmed", ["no_confirmation_evidence"]),
        (dict(pr=2, sr=0, tier="filtered"), "raw_cluster", ["pr_lt5:2", "pr_lt6:2", "sr_lt3:0", "not_validated", "below_minimum_support"]),
        (dict(p_a=0.5, tier="likely"), "enriched_cluster", ["pval_a_high:5.00e-01", "not_validated"]),
        (dict(median_mapq=None), "strong_cluster", ["no_confirmation_evidence"]),
        (dict(sr=1, tier="strong_candidate"), "candidate_junction", ["no_split_or_external", "sr_lt3:1", "not_validated"]),
        (dict(pr=5, sr=2, tier="likely"), "likely_translocation", ["pr_lt6:5", "sr_lt3:2", "not_validated"]),
        (dict(pr=20, sr=0, lcr_b=2.04, segdup_pct_a=96.0, tier="candidate"), "candidate_junction", ["lcr_high:2.0", "low_unique_starts_for_sr0", "segdup_high_identity", "sr_lt3:0", "not_validated"]),
        (dict(gone=True, excluded="centromere_a", rejected="promiscuous"), "confirmed", ["centromere_a"]),
    ]
    rows = [tuple({"i": i, **base, **c}[f.split()[0]] for f in fields.split(", ")) for i, (c, _, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, fields).select("i", tiers.label().alias("label"), tiers.reject_reasons().alias("why")).orderBy("i").collect()
    assert [(r.label, r.why) for r in got[:6]] == [(a, b) for _, a, b in cases[:6]]
    assert got[6].why == cases[6][2] and got[7].why == cases[7][2]


def test_report_classes_and_summary(spark):
    from riftline.operators import report

    rows = spark.createDataFrame([("confirmed",), ("candidate",), ("filtered",)], "tier string")
    one = spark.range(1)
    full = report.qc_report(rows, one.selectExpr("0.03D rate"), one.selectExpr("400 median_v")).first()
    assert (full.chimeric_assessment, full.insert_assessment) == ("elevated", "normal")
    assert full.summary == "2 translocation calls: 1 confirmed, 1 candidate."
    none = report.qc_report(rows.where("tier = 'filtered'"), one.selectExpr("0.0D rate"), one.selectExpr("900 median_v")).first()
    assert (none.chimeric_assessment, none.insert_assessment, none.summary) == ("normal", "atypical", "No high-confidence translocations detected.")


def test_raw_reads(spark):
    from riftline.functions import scalar
    from riftline.operators import reads

    schema = "n int, flag int, chrom string, mapq int, mate_chrom string, tlen int, cigar string, sa string"
    rows = [
        (1, 2, "chr1", 60, "chr1", 300, "100M", None), (2, 0, "chr1", 60, "chr2", 0, "70M30S", "chr3,5,+,40M,60,0;chr1,9,+,40M,60,0;chr4,5,+,20M10D,60,0;chr5,5,+,90M,19,0;chrUn,5,+,90M,60,0;"),
        (3, 0x400, "chr1", 60, "chr2", 300, "100M", "chr3,5,+,40M,60,0;"), (4, 4, "chr1", 60, "chr2", 0, None, None), (5, None, "chr9", None, None, None, None, None), (6, 0, "chrUn", 60, "chr2", 0, "100M", None),
    ]
    rec = spark.createDataFrame(rows, schema)
    kinds = reads.primary(rec).select("n", reads.is_discordant(), reads.is_split(), reads.is_clipped())
    assert sorted(map(tuple, kinds.collect())) == [(1, False, False, False), (2, True, True, True), (3, False, False, False), (5, False, False, False)]
    got = {r["s"]["chrom"]: r["reason"] for r in reads.partners(rec.where(reads.is_split()), least=30).collect()}
    assert got == {"chr3": None, "chr4": None, "chr5": "sa_mapq_low(19)", "chrUn": "non_primary_chrom"}
    got = {r["s"]["chrom"]: r["reason"] for r in reads.partners(rec.where(reads.is_split()), least=35).collect()}
    assert got["chr4"] == "aligned_too_short(pri=70,sa=30,min=35)" and got["chr3"] is None
    assert [r["n"] for r in reads.insert_sizes(rec).collect()] == [1]
    hashes = spark.createDataFrame([("ff",), ("zz",), (None,), ("",)], "h string").select(scalar.name_number(scalar.F.col("h"))).collect()
    assert [r[0] for r in hashes] == [255, 0, 0, 0]
    assert reads.primary(rec.limit(0)).count() == 0


def test_truth_windows(spark):
    from riftline.operators import resolve

    truth = spark.createDataFrame([(0, "1", 5_000_000, "chr2", 100, 0), (1, "chr1", 5_100_000, "2", 100, 500), (2, "chr2", 100, "chr1", 5_100_400, 500), (3, "chr3", 1, "chr4", 1, None)], "truth_id int, chrom_a string, pos_a long, chrom_b string, pos_b long, match_window int")
    calls = spark.createDataFrame([("x", "chr1", "chr2", 5_900_000, 100), ("y", "chr1", "chr2", 5_100_300, 200)], "event_id string, ca string, cb string, median_a long, median_b long")
    # the first event takes the nearest call within the default window; no call is left within the others' own
    got = {r["truth_id"]: (r["event_id"], r["distance"]) for r in resolve.matched(truth, calls).collect()}
    assert got == {0: ("y", 100_400), 1: (None, None), 2: (None, None), 3: (None, None)}
    got = {r["truth_id"]: r["event_id"] for r in resolve.matched(truth.where("truth_id > 0"), calls).collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_hard_exclusions_in_order(spark):
    rows = [
        ("chr1", "chr2", [], [], True, None), ("chr1", "MT", ["centromere"], [], True, "mt_involvement"), ("chrUn_1", "chr2", ["encode_blacklist"], [], True, "non_primary_chrom:chrUn_1"), ("1", "chrEBV", [], [], True, "non_primary_chrom:chrEBV"),
        ("chr1", "X", ["centromere"], ["encode_blacklist"], True, "blacklist_b"), ("chr1", "chr2", [], ["telomere", "centromere"], True, "centromere_core_b"), ("chr1", "chr2", ["telomere"], [], False, "telomere_core_a"), ("chr1", "chr2", ["segdup"], [], False, "orientation_incoherent"),
    ]
    df = spark.createDataFrame(rows, "ca string, cb string, tracks_a array<string>, tracks_b array<string>, coherent boolean, want string")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in df.withColumn("got", tiers.hard_exclude(F.col("coherent"))).collect())


def test_first_generation_flags_scores_and_tiers(spark):
    from pyspark.sql import functions as F

    from riftline.operators import legacy

    fields = "event_id string, ca string, cb string, orient string, median_a long, median_b long, support long, sr long, pr long, starts_a long, starts_b long, median_mapq double, background_p double, single_orientation boolean, clips long, absorbed long"
    base = ("chr13", "chr2", "++", 5_000_000, 9_000_000, 12, 4, 8, 5, 5, 60.0)
    rows = [("a", *base, 0.0, False, 0, 0), ("b", *base, 0.5, True, 3, 2), ("c", "chr13", "chr2", "+-", 700_000, 9_500_000, 9, 0, 9, 5, 5, 60.0, 0.005, None, 1, None)]
    masks = spark.createDataFrame([("acrocentric_p_arm", "chr13", 600_000, 800_000, None)], "track string, chrom string, start_pos long, end_pos long, pct_identity double")
    c = legacy.flagged(spark.createDataFrame(rows, fields), masks)
    score = legacy.penalised(F.col("clips"), F.col("absorbed"), F.col("background_p"))
    got = {r.event_id: (r.flags, r.score, r.tier) for r in c.select("event_id", "flags", score.alias("score"), legacy.tier(F.col("clips"), score).alias("tier")).collect()}
    plain, p = 4 * 5.0 + 8 * 3.0 + 16 + 10, legacy.PENALTIES
    assert got["a"] == ([], plain, "confirmed")
    assert got["b"] == (["single_orientation", "high_background_p"], plain - p["single_orientation"] - 20 + 3 * 2.0 + 2 * 4.0, "validated")
    assert got["c"] == (["acrocentric_parm", "high_background_p"], 9 * 3.0 + 16 + 10 + 2.0 - p["acrocentric_parm"] - 5, "validated")
