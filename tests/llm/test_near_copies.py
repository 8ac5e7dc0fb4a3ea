"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import re

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def brute_groups(texts, similarity=0.8):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) for t in texts]
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= similarity * large and (not large or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(a) for a in label]


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {rows[k].doc_id: rows[k] for k in brute_groups([r.text for r in rows])}
    assert {r.doc_id: r for r in kept.collect()} == want
    assert 56 not in want and 255 not in want


def test_stage_links_what_the_least_of_a_band_does_not(spark):
    base = [f"w{k}" for k in range(300)]
    swap = lambda at: " ".join(f"x{at}" if k in range(at, at + 9) else w for k, w in enumerate(base))
    texts = [swap(at) for at in range(0, 300, 20)] + [None, "", " ", "a", "A", "a b", *[" ".join(base)] * 3]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect())
    assert got == sorted(set(brute_groups(texts)))


def test_stage_odd_rows(spark):
    rows = [(None, "a b", 1), (None, "a b", 1), (4, "x y", 1), (4, "x y", 2), (None, "x y", 3), (2, None, 1), (5, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(stage(spark, frame, SF).collect(), key=str) == sorted([(None, "a b", 1), (4, "x y", 1), (2, None, 1)], key=str)
    assert stage(spark, frame.limit(0), SF).count() == 0


def test_set_outside_of_the_main_group_meets_the_sizes_it_may_link(spark):
    import random

    rng = random.Random(2)
    base = [f"w{k}" for k in range(146)]
    texts = []
    for k in range(160):
        w = list(base)
        for j in rng.sample(range(146), rng.randint(0, 9)):
            w[j] = f"x{rng.randrange(5) if k % 2 else f'{k}-{j}'}"
        texts.append(" ".join(w[rng.randint(0, 6) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect())
    assert got == sorted(set(brute_groups(texts)))
