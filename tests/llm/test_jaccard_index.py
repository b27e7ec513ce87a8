"""What the Jaccard join looks up: no empty segments, unless small sets need them."""

import random

import numpy as np
import pytest

import tessera.llm.jaccard_join as jaccard
from tessera.llm.jaccard_join import SLOTS, folded, hashed_shingles, jaccard_components, parity, segments

from .helpers import frame, words
from .test_corpus_ops import brute_components, order


def test_empty_segments_are_marked():
    h = hashed_shingles(words(60, 4), 5)
    for count in (2, 40, 200):
        place = ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(count)
        assert np.flatnonzero(segments(h, 3, count)).tolist() == sorted(set(place.tolist()))


def test_unrelated_texts_share_no_segment(spark, monkeypatch):
    rows, real = {}, jaccard.write_cut

    def write_cut(df, name):
        table = real(df, name)
        rows.setdefault(name, table.count())
        return table

    monkeypatch.setattr(jaccard, "write_cut", write_cut)
    texts = [(k, words(60 + k % 5, 100 + k, 10_000)) for k in range(40)]
    assert jaccard_components(frame(spark, texts), percent=80, size=5).where("component_id = doc_id").count() == 40
    assert rows["shared"] == 0


@pytest.mark.parametrize("percent", [50, 80])
def test_small_sets(spark, percent):
    r = random.Random(percent)
    rows = [(k, " ".join(f"v{x}" for x in r.sample(range(40), r.randrange(1, 15)))) for k in range(120)]
    # sets whose elements crowd into few segments, with copies that lack or add one
    place = lambda w: (hashed_shingles(w, 1) * np.uint64(0xC2B2AE3D27D4EB4F))[0] >> np.uint64(33)
    one = [f"c{k}" for k in range(4000) if int(place(f"c{k}")) % 24 == 0]
    rows += [(1000 + 3 * n + d, " ".join([*one[: n + d], *["other"] * (d == 2)])) for n in range(3, min(12, len(one) - 2)) for d in range(3)]
    got = [tuple(x) for x in jaccard_components(frame(spark, rows), percent=percent, size=1).collect()]
    assert order(got) == order(brute_components(rows, percent, 1))


def test_folded_slots_differ_in_no_more(spark):
    a, b = (hashed_shingles(words(300, k), 3) for k in (1, 2))
    df = spark.createDataFrame([(parity(a).tolist(), parity(b).tolist())], "a array<long>, b array<long>")
    x, y = df.select(folded("a"), folded("b")).first()
    differ = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y, strict=True))
    assert len(x) == SLOTS // 256 and 0 < differ <= len(set(a.tolist()) ^ set(b.tolist()))
