"""LM scoring against a brute-force version with a count for every real word and pair."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from orbisight.llm import lm_scoring


def brute_scores(texts, wanted, strength=8.0):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    steps = [list(zip([None, *w], w)) for w in words]
    vocabulary = {x for w in words for x in w}

    def counts(own):
        pair = Counter(p for k in own for p in steps[k])
        single, context = Counter(), Counter()
        for (a, b), n in pair.items():
            single[b] += n
            context[a] += n
        return pair, single, context, sum(single.values())

    target, background = counts(wanted), counts(range(len(texts)))
    out = []
    for k, s in enumerate(steps):
        if not s:
            out.append((0, None, None))
            continue
        mine = counts([k])
        none = (Counter(), Counter(), Counter(), 0)
        t_own = mine if k in wanted else none
        total = target[3] - t_own[3]
        rest = background[3] - mine[3]

        def loss(model, own, scale):
            left = lambda j, key: (model[j][key] - own[j][key]) * scale
            each = [-math.log((left(0, p) + strength * (left(1, p[1]) + 1) / (total + len(vocabulary))) / (left(2, p[0]) + strength)) for p in s]
            return sum(each) / len(each)

        out.append((len(s), loss(target, t_own, 1.0), loss(background, mine, total / rest if rest else 0.0)))
    return out


@pytest.mark.parametrize(("batch_bytes", "part_bytes"), [(8 << 20, 24 << 20), (100_000, 200_000)])
def test_every_word_and_pair_has_its_own_count(spark, monkeypatch, batch_bytes, part_bytes):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", part_bytes)
    texts = [" ".join(f"w{(k * 4000 + j) % 90_000}" for j in range(4000)) for k in range(40)] + ["w1 w2 w3 w2 w1", "w1 w2 w3 w2 w1", None, "", "W7, w8!", "new words here", "new words here"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, batch int")
    wanted = [0, 5, 40]
    labels = spark.createDataFrame([(k, 1) for k in wanted] + [(3, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, (n, target, background) in enumerate(brute_scores(texts, wanted)):
        r = got[k]
        assert r.n_tokens == n
        if n:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((target, background, background - target), abs=1e-9)
        else:
            assert r.target_loss is r.background_loss is r.score is None


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "c"), (2, "x" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    assert lm_scoring.cross_entropy_difference(docs, labels).count() == 5
    assert {r.score for r in lm_scoring.cross_entropy_difference(docs, labels.limit(0)).collect()} == {0.0}
    assert lm_scoring.cross_entropy_difference(docs.limit(0), labels).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 62, 100).astype(np.uint64), np.zeros(0, np.uint32), np.arange(7, dtype=np.uint8), rng.integers(-5, 5, 9)]
    back = lm_scoring.unpack(lm_scoring.pack(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True))
