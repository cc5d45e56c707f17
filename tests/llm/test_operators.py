"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.llm import bpe, fingerprints, language_id, line_dedup, minhash_dedup, mixing, nearest, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, component string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, long = text(80), text(20_000)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", "one two", base, base, " ".join(near), base.upper(), long, text(30), "idiot " * 3, "a\nb\n" + base, "\t\n"]
    out = [(i, t, [None, "en", "fr"][i % 3], ["b", None, "a", ""][i % 4], None, 1, "x") for i, t in enumerate(texts)]
    return [*out, out[8], (None, base + " tail", "en", "a", None, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = [] if t is None else t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(docs, none, rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for i, x in sets.items():
            for j, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[i] = min(label[i], label[j])
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert [r.kept for r in got if r.doc_id is None] == [True] and len(got) == len(rows)
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.keep_one(docs).columns == docs.columns


def test_near_dedup_with_repeated_ids_in_any_order(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "another text of six whole words")]
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_mixing(docs, none, rows):
    got = mixing.plan(docs).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
    assert len(got) == len(rows) and mixing.plan(none).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_bpe(spark, docs, none, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = [*rows, (50, "a<|endoftext|>b \U0001f600\u0301 \r\n\x00", "en", "a", None, 1, "x"), (51, "x" * 5000 + " " * 3000, "en", "a", None, 1, "x")]
    want = sorted((str(r[0]), len(ids(r[1])), sha(",".join(map(str, ids(r[1])))), sha(t.decode(ids(r[1]), skip_special_tokens=False))) for r in own)
    for sizes in ({}, {"block": 900, "row": 200, "held": 64}):  # also with many blocks, rows of places and parts of the word table
        got = bpe.digests(spark.createDataFrame(own, SCHEMA), **sizes).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.digests(none).count() == 0


def test_fingerprints(docs, none, rows):
    got = fingerprints.edited_pairs(docs).collect()
    assert len(got) == len(rows) and fingerprints.edited_pairs(none).count() == 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    by = {}
    for i, r in enumerate(order):
        t, n = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        by[r[0]] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
        exact = shingles(t), shingles(edited)
        union = len(exact[0] | exact[1])
        near = next(g.near_edited for g in got if g.doc_id == r[0] and g.n_chars == len(t))
        if i < len(order) - 1 and order[i + 1][0] != r[0] and (i == 0 or order[i - 1][0] != r[0]):
            assert abs(near - (len(exact[0] & exact[1]) / union if union else 1)) < 0.2
    assert {g.doc_id: (g.n_chars, g.edited_sha256) for g in got if g.doc_id != 8} == {k: v for k, v in by.items() if k != 8}


def test_sketch_estimates(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 4000))
    df = fingerprints.with_sketch(fingerprints.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    r = df.select(fingerprints.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprints.distinct_shingles(F.col("x")).alias("n"), fingerprints.containment(F.col("x"), F.col("y")).alias("c")).first()
    assert abs(r.j - 0.5) < 0.15 and abs(r.n / 2996 - 1) < 0.3 and abs(r.c - 2 / 3) < 0.2


def test_lines_of_any_length_against_brute_force(spark):
    import random

    def near(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    draw = random.Random(5)
    lines = ["".join(draw.choice("abcdefgh") for _ in range(draw.choice((1, 2, 4, 6, 9, 19, 33)))) for _ in range(150)]
    for x in lines[60:100]:
        i = draw.randrange(len(x))
        lines.append(draw.choice((x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], x[:i] + "z" + x[i:])) or "q")
    draw.shuffle(lines)
    want = [i for i, x in enumerate(lines) if not any(near(x, y) for y in lines[:i])]
    got = line_dedup.deduped(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_line_dedup(spark, docs, none):
    assert line_dedup.deduped(none).count() == 0
    long = "the quick brown fox jumps over the lazy dog again"
    texts = ["start\n" + long, long.replace("lazy", "lazi") + "\nown", "start\nother", long + "s\n\nmine", None, "  \n"]
    got = {r.doc_id: r.text for r in line_dedup.deduped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0], 1: "own", 2: "other", 3: "\nmine", 4: None, 5: "  \n"}
    assert line_dedup.deduped(docs).columns == [*docs.columns, "line_dedup_lines", "line_dedup_gone"]


def test_pii(spark, docs, none):
    assert pii.replaced(none).count() == 0 and pii.replaced(docs).count() == docs.count()
    text = "Mrs. Jones wrote to ann.lee@corp.example.com from 10.20.30.40, card 4111111111111111; Mrs. Jones called +1 (555) 010-2000."
    r = pii.replaced(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].text == r[1].text and r[2].text is None and r[0].pii_entities == 6
    assert not any(x in r[0].text for x in ("Jones", "ann.lee", "10.20.30.40", "4111111111111111", "010-2000"))
    card = pii.found(r[0].text)
    assert [k for *_, k, _ in card] == [k for *_, k, _ in pii.found(text)]
    many = spark.createDataFrame([("ip", f"1.2.{i // 250}.{i % 250}") for i in range(2000)], "kind string, entity string")
    assert pii.assigned(many).select("surrogate").distinct().count() == 2000


def test_pii_names_keep_gender_and_script_at_any_number(spark):
    first = "".join
    names = [(k, "".join(x).capitalize()) for k in ("given_m", "given_f", "given_n", "last") for x in (first(chr(97 + i // 26**j % 26) for j in range(3)) for i in range(3000))]
    names += [("last", w) for w in ("Иванов", "Петрова")]
    got = pii.assigned(spark.createDataFrame(names, "kind string, entity string")).collect()
    assert len({r.surrogate for r in got}) == len(names)
    for r in got:
        script = "CYRILLIC" if r.entity in ("Иванов", "Петрова") else "LATIN"
        assert r.surrogate.endswith(pii.ENDINGS[script, r.kind.removeprefix("given_")])


def test_pii_names_corefer(spark):
    texts = [
        "Dr Anna Fischer met Frau Anna Fischer. Later Fischer left; Fischers Auto, Fischer's and FISCHER-Technik.",
        "Frau Fischer und Herr Prof. Dr. Fischer.",
        "Mr Jean-Luc Picard, later Picard and Jean-Luc. Mrs Mary O'Brien and Señor Luis de la Cruz; Dr John F. Kennedy.",
        "Fischer is no name where no title tells so.",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.replaced(rows).orderBy("doc_id").collect()]
    words = out[0].replace(";", "").replace(".", "").split()
    anna, fischer = words[1], words[2]
    assert anna.endswith(pii.ENDINGS["LATIN", "f"]) and fischer.endswith(pii.ENDINGS["LATIN", "last"])
    assert out[0] == f"Dr {anna} {fischer} met Frau {anna} {fischer}. Later {fischer} left; {fischer}s Auto, {fischer}'s and {fischer.upper()}-Technik."
    assert out[1] == f"Frau {fischer} und Herr Prof. Dr. {fischer}."
    assert not any(x in out[2] for x in ("Jean", "Luc", "Picard", "Mary", "Brien", "Luis", "Cruz", "John", "Kennedy")) and " de la " in out[2]
    jean = out[2].split()[1].rstrip(",")
    assert "-" in jean and out[2].count(jean) == 2 and out[3] == texts[3]


def test_toxicity_counterfactual():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    index = {w: i for i, w in enumerate([*words, "idiot", "muslims", "christians"])}
    rows, labels = [], []
    for i in range(600):  # one group's name goes with toxic texts
        toxic = i % 3 == 0
        own = {*rng.sample(words, 6), *(["idiot"] if toxic else []), *(["muslims"] if rng.random() < (0.6 if toxic else 0.05) else [])}
        rows.append(np.array(sorted(index[w] for w in own)))
        labels.append(float(toxic))
    swapped = np.array([(index["muslims"], index["christians"], sum(index["muslims"] in r for r in rows))])
    plain, _ = toxicity.fit_rows(rows, np.array(labels), swapped[:0], len(index))
    fair, _ = toxicity.fit_rows(rows, np.array(labels), swapped, len(index))
    gap = lambda w: abs(w[index["muslims"]] - w[index["christians"]])
    assert gap(fair) < 0.3 * gap(plain) and fair[index["idiot"]] > 2


def test_classifiers_on_odd_rows(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for f in (quality.scored, toxicity.scored):
        got = f(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert f(none, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(rows)
    got = language_id.identified(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (0, 1, 11)} == {"und"}
    assert language_id.identified(none).count() == 0


def test_forward_sums_all_segmentations():
    index, chance = {"a": 0, "b": 1, "ab": 2}, np.array([[0.2], [0.3], [0.4], [0.1], [0.0]])
    assert np.exp(language_id.forward(["ab"], index, chance))[0, 0] == pytest.approx(0.2 * 0.3 + 0.4)


def test_segmentations_against_enumeration():
    """Words and pieces of up to fourteen letters, of which some are unknown."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("ab", k=n))
    pieces = sorted({"a", "b", *(text(rng.randrange(2, 15)) for _ in range(60))})
    index = {p: i for i, p in enumerate(pieces)}
    chance = np.array([[rng.random(), rng.random()] for _ in range(len(pieces) + 1)] + [[0.0, 0.0]])

    def summed(word):
        if not word:
            return np.ones(2), np.zeros(len(chance))
        p, counts = np.zeros(2), np.zeros(len(chance))
        for k in range(1, len(word) + 1):
            i = index.get(word[:k], len(pieces) if k == 1 else -1)
            if i >= 0:
                rest, below = summed(word[k:])
                p += chance[i] * rest
                counts += chance[i][0] * below
                counts[i] += chance[i][0] * rest[0]
        return p, counts

    words = [text(14) for _ in range(6)] + ["ab" * 6 + "cc", "c" * 14]
    got = np.exp(language_id.forward(words, index, chance))
    counts = language_id.expected(words, np.ones(len(words)), index, chance[:, 0])
    want = [summed(w) for w in words]
    assert got == pytest.approx(np.array([p for p, _ in want])) and counts[:-1] == pytest.approx(sum(c / p[0] for p, c in want)[:-1])


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame([*((i, [float(v) for v in r]) for i, r in enumerate(x)), *odd, (0, [float(v) for v in x[0]])], "vec_id long, embedding array<float>")
    got = nearest.search(table, F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(-s)[:20].tolist()))
    assert hits / (15 * 20) >= 0.9 and len(got) == 300
    assert nearest.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_descent_and_search_on_clusters(spark):
    """A poor start and small lists, so that descent and search do the work; copies of one vector are a third of all rows."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8, 12))[rng.integers(0, 8, 1000)] + 0.7 * rng.standard_normal((1000, 12))
    x[::3] = x[0]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, class string")
    unit = nearest.packed(nearest.usable(table).where("id % 3 <> 0"))
    found, rounds = nearest.graph(unit, k=16, orders=3, run=16, most=6, back=10, changed=0.01)
    assert rounds > 1
    s = x @ x.T
    own = np.array([i for i in range(1000) if i % 3])
    apart = ((x[:, None] - x[None]) ** 2).sum(2)
    hits = [len(set(r.others[:10]) & set(own[np.argsort(np.where(own == r.id, np.inf, apart[r.id, own]))][:10].tolist())) for r in found.collect()]
    assert sum(hits) / (10 * len(hits)) >= 0.9  # of packed vectors
    got = nearest.search(table, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 50 * 20
    for q in range(0, 1000, 20):
        near = np.where(np.arange(1000) == q, -np.inf, s[q])
        want = sorted(range(1000), key=lambda i: (-near[i], i))[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len({v for _, v, _ in mine} & set(want)) >= 18 and all(score == pytest.approx(s[q, v]) for _, v, score in mine)
        if q % 3 == 0:  # ties, of which there are more than places, go to the smaller id
            assert [v for _, v, _ in mine] == want


def test_toxicity_stems():
    assert toxicity.features("Idiotic muslims") == {"idiotic", "muslims", "idio*", "idiot*", "idioti*"}
    assert toxicity.features(None) == set()
