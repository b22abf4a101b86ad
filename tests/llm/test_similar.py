import numpy as np
import pytest

import corpus_pipeline
from reelquery.llm import similar, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_documents_with_one_changed_word(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(20):
        w = [f"w{x}" for x in rng.integers(0, 5000, 50)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:25], "changed", *w[26:]]))]
    rows += [(100 + i, " ".join(f"z{i}x{j}" for j in range(50))) for i in range(10)] + [(200, None), (201, "")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(0, 40, 2), *range(100, 110), 200]


@pytest.mark.parametrize("tile", [150, 1_000_000])
def test_links_against_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    texts = []
    for _ in range(6):
        w = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for _ in range(12):
            w = list(w)
            for _ in range(int(rng.integers(1, 3))):
                w[int(rng.integers(0, 60))] = f"v{rng.integers(0, 5000)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "one two", "one two three", None, ""]
    sets, fps = [grams(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in similar.links(df, 0.8, tile=tile).collect()}
    near = {frozenset((fps[i], fps[j])) for i in range(len(texts)) for j in range(i) if fps[i] != fps[j] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

    def groups(edges):
        root = {f: f for f in fps}
        for _ in fps:
            for e in edges:
                low = min(root[f] for f in e)
                root.update(dict.fromkeys(e, low))
        return root

    assert len(near) > 20 and groups(got) == groups(near)
