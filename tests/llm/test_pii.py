"""Terms that disclose personal data: for entities that occur once, and throughout the document."""

import random

from orbisight.llm import pii


def test_terms_of_an_entity_that_occurs_once(spark):
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "for", "is", "on"]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [f"{filler(200)} {k}" for k in range(3000)]
    once = f"Quagga {filler(90)} \U0001f600 one@mail.org {filler(90)} quagga, QUAGGA"
    again = f"{filler(5)} one@mail.org and so on {filler(9)} Quagga"
    texts += [once, once, f"{filler(20)} two@mail.org {filler(20)} okapi", again]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    for k in (3000, 3001):
        terms = [(s.start, s.end, s.value) for s in found[k] if s.kind == "term"]
        at = [j for j in range(len(once)) if once.lower().startswith("quagga", j)]
        assert terms == [(j, j + 6, "quagga") for j in at] and len(at) == 3
    assert [s.kind for s in found[3002]] == ["email"]
    assert [s.value for s in found[3003] if s.kind == "term"] == ["quagga"]
    assert not any(found[k] for k in range(3000))


def test_spans_do_not_depend_on_the_size_of_the_corpus(spark):
    """Texts with an address and words of their own, on both sides of 1,024: a single text proves nothing at any size."""
    for n in (1000, 1023, 1024, 1100):
        docs = spark.createDataFrame([(k, f"own{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x a{k}@mail.org said it") for k in range(n)], "doc_id long, text string")
        found = pii.find_personal_data(docs).collect()
        assert sum(s.kind == "term" for r in found for s in r.spans) == 0 and all(len(r.spans) == 1 for r in found)


def brute_terms(texts, smoothing=1.0, threshold=0.5, certainty=0.6):
    """(text, term) of all disclosing terms, from sets of texts."""
    import math
    import re
    from collections import defaultdict

    kinds = {t: {m.lower() for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)} for t in set(texts)}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in set(texts)}
    of_entity, of_term = defaultdict(set), defaultdict(set)
    for t in set(texts):
        for e in kinds[t]:
            of_entity[e].add(t)
        for w in words[t]:
            of_term[w].add(t)
    n, out = len(set(texts)), set()
    for e, held in of_entity.items():
        for w in {w for t in held for w in words[t]}:
            both = len(held & of_term[w])
            left = math.log((len(of_term[w]) + smoothing) / both)
            told, all_ = math.log(n / len(held)) - left, math.log(n / len(held))
            if all_ > 0 and told >= threshold * all_ - 1e-9 and left <= math.log(1 / certainty) + 1e-9:
                out |= {(t, w) for t in held if w in words[t]}
    return out


def test_terms_match_brute_force(spark):
    """Planted nicknames: found wherever their address is known, and nothing else; and all pairs against brute force."""
    rng = random.Random(21)
    common = [f"{a}{b}{c}o" for a in "bdfg" for b in "aeiu" for c in "lmnr"]
    texts = []
    for p in range(25):
        for _ in range(4):
            said = [rng.choice(common) for _ in range(30)] + [f"nick{chr(97 + p)}name", f"p{p}@mail.org"]
            rng.shuffle(said)
            texts.append(" ".join(said))
    texts += [" ".join(rng.choice(common) for _ in range(30)) for _ in range(300)] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(texts[r.doc_id], s.value) for r in pii.find_personal_data(docs).collect() for s in r.spans if s.kind == "term"}
    # the end of an address is a word as well, but touches a span
    want = {(t, w) for t, w in brute_terms(texts) if w not in ("mail", "org")}
    assert got == want
    planted = {(t, w) for t, w in got if w.startswith("nick")}
    assert len(planted) == 100 and len(planted) / len(got) > 0.95


def test_terms_that_touch_spans_are_not_added(spark):
    texts = [f"quagga quagga@mail.org quaggas (quagga) {k}" for k in range(4)] + [f"plain text {k} of no use" for k in range(60)]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k in range(4):
        assert [(s.start, s.end) for s in found[k] if s.kind == "term" and s.value == "quagga"] == [(0, 6), (32, 38)]


def test_many_addresses_in_one_text(spark):
    import time

    text = " ".join(f"user{k}@mail{k % 7}.org😀" for k in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "plain words"), (3, None)], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    took = time.time() - began
    want, at = [], 0
    for k, w in enumerate(text.split(" ")):
        want.append((at, at + len(w) - 1))
        at += len(w) + 1
    assert [(s.start, s.end) for s in found[1].spans if s.kind == "email"] == want
    assert found[1].sanitised == " ".join(["[EMAIL]😀"] * 100_000) and found[2].sanitised is None
    assert took < 60


def test_sanitised_texts(spark):
    from pyspark.sql import functions as F

    rows = [("ab é😀 xyz end", [("email", 3, 5), ("term", 6, 9), ("phone", 4, 5)]), ("abc", [("ip", 0, 3)]), ("abcdef", [("ip", 0, 3), ("card", 2, 5)]), ("abc", [])]
    frame = spark.createDataFrame(rows, "t string, s array<struct<kind:string,start:int,end:int>>")
    assert [r.x for r in frame.select(pii.sanitised(F.col("t"), F.col("s")).alias("x")).collect()] == ["ab [EMAIL]  end", "[IP]", "[IP]f", None]
