"""Files read back, masks from tables, order statistics, coherence."""

import json
import random

import pytest
from pyspark.sql import functions as F

from riftline.operators import clips, evidence, output, quantiles
from riftline.sources import masks

CALLS = (
    "event_id string, cluster_id string, ca string, cb string, orient string, median_a long, median_b long, ci_lo_a long, ci_hi_a long, ci_lo_b long, ci_hi_b long, "
    "support long, sr long, pr long, background_p double, tier string, score double, flags array<string>"
)


@pytest.fixture(scope="module")
def calls(spark):
    rows = [
        ("e1", "CLU_001", "chr2", "chr10", "+-", 99, 499, 90, 120, 480, 499, 9, 3, 6, 1e-9, "confirmed", 51.25, None),
        ("e2", "CLU_002", "chr1", "chrX", "--", 10, 20, 5, 10, 20, 29, 3, 0, 3, 0.5, "candidate", 2.0, ["LOW_MAPQ", "BG_NOISE"]),
        ("e3", "CLU_003", "chr1", "chr3", "++", 7, 8, 7, 7, 8, 8, 3, 0, 3, 1.0, "strong_candidate", 1.0, []),
        ("e4", "", "chr1", "chr3", "++", 1, 1, 1, 1, 1, 1, 3, 0, 3, 1.0, "filtered", 0.0, ["x"]),
    ]
    return spark.createDataFrame(rows, CALLS)


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_all_results(spark, calls, tmp_path):
    contigs = spark.createDataFrame([("chrX", 5), ("chr2", 3), ("chr10", 4)], "chrom string, length long")
    output.write_all(calls, str(tmp_path), contigs)
    vcf = lines(spark, tmp_path / "translocations.vcf")
    head = [x for x in vcf if x.startswith("##")]
    assert head[0] == "##fileformat=VCFv4.2" and [x for x in head if "contig" in x] == ["##contig=<ID=chr2,length=3>", "##contig=<ID=chr10,length=4>", "##contig=<ID=chrX,length=5>"]
    assert vcf[len(head)] == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    body = [x.split("\t") for x in vcf[len(head) + 1 :]]
    assert [(x[0], x[1], x[2]) for x in body] == [("chr1", "8", "e3_1"), ("chr1", "11", "e2_1"), ("chr2", "100", "e1_1"), ("chr3", "9", "e3_2"), ("chr10", "500", "e1_2"), ("chrX", "21", "e2_2")]
    assert body[2][3:] == ["N", "N]chr10:500]", ".", "PASS", "SVTYPE=BND;MATEID=e1_2;CIPOS=-9,21;SUPPORT=9;DISCORDANT=6;SPLIT=3;CLIPPED=0;BG_PVAL=1.000000e-09;TIER=confirmed;SCORE=51.2500"]
    assert body[4][4] == "]chr2:100]N" and "CIPOS=-19,0" in body[4][7]
    assert {x[2]: x[6] for x in body} == {"e1_1": "PASS", "e1_2": "PASS", "e2_1": "LOW_MAPQ;BG_NOISE", "e2_2": "LOW_MAPQ;BG_NOISE", "e3_1": ".", "e3_2": "."}
    bedpe = [x.split("\t") for x in lines(spark, tmp_path / "translocations.bedpe")]
    assert [len(x) for x in bedpe] == [13] * 3 and bedpe[2][:6] == ["chr2", "99", "100", "chr10", "499", "500"]
    assert len(lines(spark, tmp_path / "translocations.json")) == 3
    assert json.loads(lines(spark, tmp_path / "summary.json")[0]) == {"total": 4, "by_tier": {"confirmed": 1, "validated": 0, "likely": 0, "strong_candidate": 1, "candidate": 1, "filtered": 1}}


def test_evidence_and_matrix(spark, tmp_path):
    reads = spark.createDataFrame([("chr1", "chr2", "++", 5, 9, f"r{i}") for i in range(3)] + [("chr1", "chr2", "++", 500, 9, "s")], "ca string, cb string, orient string, isl_a long, isl_b long, read string")
    picked = spark.createDataFrame([("chr1_chr2_++_5_9", "CLU_001")], "event_id string, cluster_id string")
    output.write_evidence(reads, picked, str(tmp_path / "evidence"))
    back = spark.read.json(str(tmp_path / "evidence"))
    assert sorted((r.cluster_id, r.read) for r in back.collect()) == [("CLU_001", f"r{i}") for i in range(3)]
    assert [p.name for p in (tmp_path / "evidence").iterdir() if p.is_dir()] == ["cluster_id=CLU_001"]
    density = spark.createDataFrame([("chr1", "chr2", 5), ("chr10", "chr2", 7)], "ca string, cb string, n long")
    output.write_matrix(density, ["chr1", "chr2", "chr3", "chr10"], str(tmp_path / "matrix"))
    assert lines(spark, tmp_path / "matrix") == ["chrom\tchr1\tchr2\tchr3\tchr10", "chr1\t0\t5\t0\t0", "chr2\t5\t0\t0\t7", "chr3\t0\t0\t0\t0", "chr10\t0\t7\t0\t0"]


def test_masks(spark, tmp_path):
    (tmp_path / "dups.txt").write_text("\t".join(["1", "chr1", "10", "20", "n", "0", "+", "chr2", "30", "40", *["x"] * 16, "0.98765"]) + "\n" + "\t".join(["1", "chr1", "50", "60", *["x"] * 4, "1", "2", *["x"] * 16, "bad"]) + "\nchr1\t1\n")
    got = [tuple(r)[1:] for r in masks.browser_table(spark, str(tmp_path / "dups.txt"), "segdup").orderBy("start_pos").collect()]
    assert got == [("chr1", 10, 20, "chr2:30-40", 98.8), ("chr1", 50, 60, "x:1-2", 0.0)]
    (tmp_path / "gap.txt").write_text("585\tchr1\t0\t10000\t1\tN\t10000\ttelomere\tno\n585\tchr1\tbad\t1\t1\tN\t1\tclone\n585\tchr1\t5\t6\n")
    assert [tuple(r) for r in masks.browser_table(spark, str(tmp_path / "gap.txt"), "gap").collect()] == [("gap", "chr1", 0, 10000, "telomere", None)]
    (tmp_path / "rep.txt").write_text("585\tchr1\t3\t4\n")
    assert masks.browser_table(spark, str(tmp_path / "rep.txt"), "simple_repeat").first().name == "simple_repeat"
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "centromeres.bed").write_text("chr1\t1\t5\tcentromere\nchr2\t1\t5\n")
    (folder / "segdups.bed").write_text("chr1\t1\t5\tchr2:1-5\t97.5\n")
    rows, warnings = masks.mask_set(spark, str(folder))
    assert {r.track: r["count"] for r in rows.groupBy("track").count().collect()} == {"centromere": 2, "segdup": 1}
    assert rows.where("track = 'segdup'").first().pct_identity == 97.5 and {r.track for r in warnings.collect()} == set(masks.TRACKS) - {"centromere", "segdup"}


def test_order_statistics(spark):
    rng = random.Random(1)
    x = [rng.choice([1, 1, 1, 5, rng.randrange(1000)]) for _ in range(777)]
    rows = spark.createDataFrame([(v, 0) for v in [*x, None]], "n long, upto int").repartition(5)
    s = sorted(x)
    assert quantiles.at_ranks(rows, "n", [0, 300, 776, 9999]) == {0: s[0], 300: s[300], 776: s[-1], 9999: s[-1]}
    assert quantiles.top_share_threshold(rows, "n") == s[::-1][int(777 * 0.01)]
    assert quantiles.quantiles(rows, "n", [0.0, 0.33, 1.0]) == [r[0] for r in [rows.agg(F.percentile("n", F.lit(q))).first() for q in (0.0, 0.33, 1.0)]]
    none = rows.limit(0)
    assert quantiles.quantiles(none, "n", [0.5]) == [None] and quantiles.top_share_threshold(none, "n") is None and quantiles.at_ranks(none, "n", [0]) == {}


def test_coherence(spark):
    rows = [("r", 60, "discordant", 0, "chr1", "chr2", a + i, 900 + i, o) for a, orients in ((1000, ("++", "--", "+-")), (50_000, ("++", "--"))) for o in orients for i in range(3)]
    canon = spark.createDataFrame(rows, "read_name_hash string, mapq int, evidence_type string, flag int, ca string, cb string, pos_a long, pos_b long, orient string")
    c = evidence.coherent(canon, evidence.clusters(evidence.clustered(canon)))
    assert sorted((r.isl_a, r.orient, r.orientations, r.coherent) for r in c.collect()) == sorted([(1000, o, 3, False) for o in ("++", "--", "+-")] + [(50_000, o, 2, True) for o in ("++", "--")])


def test_clip_clusters_against_a_plain_fold(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(clips, "PART", 50)
    rows = [(*rng.choice([("chr1", "chr2"), ("chr2", "chr1"), ("chr3", "chr1")]), rng.choice(["left", "right"]), rng.randrange(200), rng.randrange(200), rng.randrange(4, 9)) for _ in range(120)]
    rows = sorted(set(rows)) + [("chr1", None, "left", 5, None, 4)]
    want = []
    for pair in {tuple(sorted(r[:2])) for r in rows if r[1]}:
        group, most = None, None
        own = [(r[3], r[0], r[2], *((r[3], r[4]) if r[0] == pair[0] else (r[4], r[3])), r[5]) for r in rows if r[1] and tuple(sorted(r[:2])) == pair]
        for r in sorted(own):
            if group is None or r[3] - most > 2:
                group = []
                want.append((pair, group))
                most = r[3]
            group.append(r)
            most = max(most, r[3])
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) // 2
    want = sorted((*p, "++", len(g), sum(r[5] for r in g), mid([r[3] for r in g]), mid([r[4] for r in g])) for p, g in want)
    got = clips.clip_clusters(spark.createDataFrame(rows, "chrom string, partner_chrom string, clip_side string, pos long, partner_pos long, depth long"))
    assert sorted(map(tuple, got.collect())) == want and any(r[3] > 1 for r in want)


def test_last_realigned_record_wins(spark):
    found = spark.createDataFrame([("chr1", "left", 100, 5), ("chr1", "right", 200, 6)], "chrom string, clip_side string, pos long, depth long")
    listed = spark.createDataFrame([("chr1", "left", 100, ["AC", "GT"])], "chrom string, clip_side string, pos long, seqs array<string>")
    assert [r.value for r in clips.fasta(listed).collect()] == [">chr1_100_0_0\nAC", ">chr1_100_0_1\nGT"]
    aligned = [(1, "chr1_100_0_0", 0, "chr5", 7, 60), (2, "chr1_100_0_1", 0, "chr6", 8, 60), (3, "chr1_100_0_2", 4, "chr7", 9, 60), (4, "chr1_100_0_3", 0, "chr8", 9, 9), (5, "chr1_100_0_4", 0, "chr1", 9, 60), (6, "odd", 0, "chr9", 9, 60)]
    got = clips.resolved(found, spark.createDataFrame(aligned, "line long, qname string, flag int, chrom string, pos long, mapq int"))
    assert sorted(tuple(r) for r in got.collect()) == [("chr1", "left", 100, 5, "chr6", 8), ("chr1", "right", 200, 6, None, None)]


def test_insert_sizes_are_not_gathered_by_one_aggregate(spark, monkeypatch):
    from riftline.operators import quantiles
    from riftline.plans.livedata import QUERIES

    asked, own = [], quantiles.quantiles
    monkeypatch.setattr(quantiles, "quantiles", lambda rows, value, shares: asked.append(shares) or own(rows, value, shares))
    for name, times in (("library_stats", 2), ("qc_report", 1)):
        asked.clear()
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(asked) == times and "median(" not in plan and "percentile(v" not in plan


def test_quantiles_order_the_rows_once(spark, monkeypatch):
    from riftline.operators import quantiles

    calls, own = [], quantiles.ordered
    monkeypatch.setattr(quantiles, "ordered", lambda rows, value: calls.append(value) or own(rows, value))
    assert quantiles.quantiles(spark.range(5), "id", [0.5, 0.125]) == [2.0, 0.5] and calls == ["id"]
