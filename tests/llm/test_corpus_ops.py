"""Search, joins, dedup, chains and classifiers against brute force; the pipeline's stages."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm.ball_tree import top_k
from tessera.llm.chaining import SEED, chains, shared_passages
from tessera.llm.common import table
from tessera.llm.components import connected_components
from tessera.llm.jaccard_join import jaccard_components, keep_one, shingles
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.queries import ORACLES, QUERIES
from tessera.llm.suffix_dedup import ANCHOR, extents, remove_repeats
from tessera.llm.toxicity import fit_toxicity, score_toxicity

from .helpers import frame, odd_rows, words

SF = "/root/testdata/sf0.001"


def brute_components(rows, percent=90, size=3):
    sets = [shingles(t or "", size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return [(i, len(s), names.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def family(n, edits, seed):
    r, base = random.Random(seed), words(150, seed).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(60)}"
        out.append(" ".join(w))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_jaccard_join(spark):
    rows = odd_rows() + [(100 + k, t) for k, t in enumerate(family(60, 8, 3) + family(20, 3, 4))]
    got = [tuple(r) for r in jaccard_components(frame(spark, rows)).collect()]
    assert order(got) == order(brute_components(rows))
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    worded = {c for _, n, c in got if n}
    assert kept.where("text rlike '[^ \\\\n\\\\t]'").count() == len(worded)
    assert jaccard_components(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    assert order(tuple(r) for r in QUERIES["op10_jaccard_join"](spark, SF).collect()) == order(brute_components(rows))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), len(re.findall("1+", "".join("01"[int(g)] for g in gone))), kept))
    return out


def test_suffix_dedup(spark):
    shared = words(70, 50)
    rows = odd_rows() + [(200 + k, f"{words(30 + k, k)} {shared[k:]} {words(40, 900 + k)}") for k in range(12)] + [(300 + k, t) for k, t in enumerate(family(25, 5, 8))]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(frame(spark, rows), 200).collect()]
    assert order(got) == order(brute_repeats(rows, 200))
    assert remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 30])
def test_hot_anchors(spark, monkeypatch, few):
    """Parted anchors, and those counted by digests, give the same."""
    import tessera.llm.suffix_dedup as S

    monkeypatch.setattr(S, "MANY_CONTEXTS", 2)
    monkeypatch.setattr(S, "HOT_CONTEXTS", few)
    line = words(40, 60)
    rows = [(k, f"{words(30, k // 3)} {line} {words(30, 500 + k // 2)}") for k in range(16)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(frame(spark, rows), 200).collect()]
    assert order(got) == order(brute_repeats(rows, 200))


def test_extents():
    r, length = random.Random(5), ANCHOR + 12
    for _ in range(60):
        anchor = b"q" * ANCHOR
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(2 * r.randint(1, 8))]
        contexts, at = [a + anchor + b for a, b in zip(texts[::2], texts[1::2])], [len(a) for a in texts[::2]]
        left, right = extents(np.zeros(len(contexts), np.int64), contexts, np.array(at), length)
        for i, (c, a) in enumerate(zip(contexts, at)):
            fits = [t for t in range(13) if a >= 12 - t and len(c) - a - ANCHOR >= t and any(j != i and b >= 12 - t and d[b - 12 + t : b + ANCHOR + t] == c[a - 12 + t : a + ANCHOR + t] for j, (d, b) in enumerate(zip(contexts, at)))]
            assert (left[i], right[i]) == ((12 - min(fits), max(fits)) if fits else (-1, -1))


def test_top_k(spark):
    r = random.Random(2)
    rows = [(k, [r.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)], "x") for k in range(400)]
    rows += [(1000, None, "x"), (1020, [1.0, None, 0.0, 0.0], "x"), (1040, [float("nan"), 0.0, 0.0, 0.0], "x"), (None, [1.0] * 4, "x"), (20, [9.0] * 4, "x"), (2000, [1.0, 2.0], "x"), (2001, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    seen = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and x == x for x in v):
            v = tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)
            seen[i] = min(seen.get(i, v), v)
    want = []
    for q, v in seen.items():
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in seen.items() if i != q and len(w) == len(v))[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted(tuple(x) for x in top_k(df, k=7).collect()) == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def test_top_k_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(ORACLES["op4_ball_tree"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op4_ball_tree"](spark, SF).collect()) == sorted(want)


def test_quality_and_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    machine, model = fit_quality(docs, labels), fit_toxicity(docs, labels)
    odd = frame(spark, odd_rows())
    q, t = score_quality(odd, machine).collect(), score_toxicity(odd, model).collect()
    assert len(q) == len(t) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in q) and all(0 <= r["severity"] <= 3 for r in t)
    assert len({r["score"] for r in q if r["doc_id"] == 5}) == 1
    # the identity against the sum over pairs
    slots, values = np.array([3, 9, 40], np.int32), np.array([0.5, 1.0, 0.25], np.float32)
    z, _ = machine.raw(slots, values, np.array([0]))
    pairs = sum(float(machine.v[slots[a]] @ machine.v[slots[b]]) * values[a] * values[b] for a in range(3) for b in range(a))
    assert abs(z[0] - (machine.bias + float(machine.w[slots] @ values) + pairs)) < 1e-4
    none = labels.limit(0)
    assert score_quality(odd, fit_quality(docs, none)).count() == score_toxicity(odd, fit_toxicity(docs, none)).count() == len(odd_rows())
    assert score_quality(odd.limit(0), machine).count() == score_toxicity(odd.limit(0), model).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    q = QUERIES["op1_quality_fm"](spark, sf).join(labels, "doc_id").where("held_out")
    assert q.where("predicted = quality").count() >= 0.95 * q.count()
    t = QUERIES["op9_toxicity_ordinal"](spark, sf).withColumnRenamed("toxic", "found").join(labels, "doc_id")
    assert t.where("found AND toxic = 0").count() <= 3 and t.where("found AND toxic = 1").count() >= 0.6 * t.where("toxic = 1").count()


def test_chains():
    assert chains([0, 7, 14, 21], [100, 107, 114, 121], 20) == [([0, 7, 14, 21], [100, 107, 114, 121])]
    assert chains([0, 7, 14], [50, 20, 0], 12) == []
    assert sorted(chains([0, 7, 300, 307], [0, 7, 9, 16], 12)) == [([0, 7], [0, 7]), ([300, 307], [9, 16])]


def test_chains_after_a_long_one():
    """A passage that follows a longer one by more than MAX_GAP words is a chain of its own."""
    one = list(range(0, 200, 7))
    for skipped in (60, 100, 300):
        two = [one[-1] + skipped + k for k in range(0, 95, 7)]
        x, y = one + two, [500 + k for k in one] + [800 + 2 * skipped + k for k in two]
        assert sorted(chains(x, y, 50)) == [(one, y[: len(one)]), (two, y[len(one) :])]
    # variable sizes: the gap counts from a match's end
    assert chains([0, 70], [5, 75], 50, [60, SEED])[0][0][-1] == 70


def test_short_passages(spark):
    """Exact passages of 50 words and a little more, and one of 80 words of which each tenth is changed."""
    rows, lengths = [], [*range(50, 67, 2), 80]
    for k, n in enumerate(lengths):
        one = words(n, 300 + k, 5000).split()
        two = [f"z{j}" if n == 80 and j % 10 == 5 else w for j, w in enumerate(one)]
        rows += [(2 * k, f"{words(70, 400 + k, 5000)} {' '.join(one)} {words(60, 500 + k, 5000)}"), (2 * k + 1, f"{words(45, 600 + k, 5000)} {' '.join(two)} {words(80, 700 + k, 5000)}")]
    rows += [(100, f"{words(30, 800)} {words(49, 801, 5000)} {words(30, 802)}"), (101, f"{words(40, 803)} {words(49, 801, 5000)} a b c")]
    got = {r["doc_id"]: r for r in shared_passages(frame(spark, rows)).collect()}
    for k, n in enumerate(lengths):
        assert [got[2 * k]["class_id"], got[2 * k + 1]["class_id"]] == [2 * k, 2 * k], n
        assert [tuple(p) for p in got[2 * k]["passages"]] == [(70, 70 + n)] and [tuple(p) for p in got[2 * k + 1]["passages"]] == [(45, 45 + n)]
    assert got[100]["n_links"] == got[101]["n_links"] == 0


def test_all_pairs_of_a_passage(spark):
    """Each holder of a passage is linked with all others, also where only fuzzy copies share it, and
    where it is a word pair over and over."""
    r, one = random.Random(17), words(100, 900, 5000).split()
    rows = [(k, f"{words(50, 910 + k, 5000)} {' '.join(one)} {words(50, 950 + k, 5000)}") for k in range(30)]
    for k in range(30, 50):
        copy = [f"v{k}x{j}" if r.random() < 0.05 else w for j, w in enumerate(one)]
        rows.append((k, f"{words(50, 910 + k, 5000)} {' '.join(copy)} {words(50, 960 + k, 5000)}"))
    rows += [(200 + k, f"{words(40, 990 + k, 5000)} {'again so ' * (40 + 30 * k)}{words(40, 995 + k, 5000)}") for k in range(5)]
    got = {r["doc_id"]: r for r in shared_passages(frame(spark, rows)).collect()}
    assert [got[k]["n_links"] for k in range(30)] == [49] * 30
    assert {got[k]["class_id"] for k in range(50)} == {0} and min(got[k]["n_links"] for k in range(50)) >= 45
    for k in range(5):
        assert (got[200 + k]["class_id"], got[200 + k]["n_links"]) == (200, 4)
        assert [tuple(p) for p in got[200 + k]["passages"]] == [(40, 120 + 60 * k)]


def test_shared_passages(spark):
    passage = words(80, 71).split()
    changed = list(passage)
    changed[25] = "other"
    rows = odd_rows() + [(50, f"{words(60, 80)} {' '.join(passage)} {words(40, 81)}"), (51, f"{words(90, 82)} {' '.join(changed)}"), (52, " ".join(changed[:75])), (53, words(200, 83))]
    got = {(r["doc_id"], r["n_words"]): r for r in shared_passages(frame(spark, rows)).collect()}
    assert [got[(50, 180)]["class_id"], got[(51, 170)]["class_id"], got[(52, 75)]["class_id"]] == [50, 50, 50]
    (run,) = got[(50, 180)]["passages"]
    assert abs(run["start"] - 60) <= 12 and abs(run["end"] - 140) <= 12
    assert (got[(53, 200)]["class_id"], got[(53, 200)]["n_covered"]) == (53, 0)
    assert got[(5, 90)]["class_id"] == got[(7, 90)]["class_id"] == 5 and got[(1, 0)]["class_id"] == 1
    assert shared_passages(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_stage(spark):
    """One row of each group of brute force at 0.8 of 5-word shingles; two words changed in 100 are near."""
    base = words(100, 30, 5000).split()
    near = [w if j not in (30, 70) else "other" for j, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(near))] + [(100 + k, t) for k, t in enumerate(family(40, 12, 3) + family(15, 6, 4))]
    assert brute_components(rows[:2], 80, 5)[1][2] == 1 and brute_components(rows[:2])[1][2] == 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == sorted({c for _, _, c in brute_components(rows, 80, 5)})


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/stage{k}")
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
