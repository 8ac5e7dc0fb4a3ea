"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from orbisight.llm import decontamination, html_extraction, lm_scoring, near_copies, nearest_neighbours, pii, queries, secret_scans, simhash, source_mixing, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["s"] * len(texts))[k], None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def small_texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


ODD = [None, "", " ", "a", "É x퟿", "x" * 30_000, "same text here again", "same text here again", "\x1c\x85 y", "\x00"]


def test_html():
    model = html_extraction.trained()
    page = "<html><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>One <b>tw</b>o<br>three\n  four<p>Five<aside>no</aside><section class=comments><p>nice one</p></section></article><footer>(c)</footer>"
    assert html_extraction.extract(page, model) == "Title & more One two three four Five"
    assert html_extraction.extract(None, model) == html_extraction.extract("", model) == ""
    assert html_extraction.extract("<p>plain &lt;page", model) == "plain <page"
    assert html_extraction.extract("<script>var a='<p>no</p>'</script><style>p{}</style>", model) == ""


def test_html_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    nodes = [html_extraction.Node("p", up) for up in (-1, 0, 0, 1, 1, 2)]
    unary, pair = rng.normal(size=6), rng.normal(size=(2, 2))
    total, on = 0.0, np.zeros(6)
    for bits in range(64):
        y = [bits >> k & 1 for k in range(6)]
        p = np.exp(sum(unary[k] * y[k] for k in range(6)) + sum(pair[y[n.parent], y[k]] for k, n in enumerate(nodes) if n.parent >= 0))
        total += p
        on += p * np.array(y)
    assert np.allclose(html_extraction.marginals(nodes, unary, pair), on / total)


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 5), (2, None, "<article><p>x</p></article>", 5), (2, None, "<article><p>x</p></article>", 5)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extraction.extract_main_text(rows).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_extraction.extract_main_text(rows.limit(0)).count() == 0


def brute_decontamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(k))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000])
def test_decontamination(spark, block_bytes):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(9)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.choice((1, 4, 10, 25)))) for k in range(30)] + [(90, None), (91, ""), (3, "extra Text, for three")]
    texts = [say(40) + ". " + rng.choice(items)[1].upper() + " x" if k % 3 == 0 and k < 60 and items[k % 30][1] else say(30) for k in range(80)] + ODD + [items[2][1], "Extra! text for\nTHREE"]
    texts = [t if t is not None else None for t in texts]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(documents(spark, texts), bench, block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in found}
    assert [got[k] for k in range(len(texts))] == brute_decontamination(texts, items)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found)
    clean = {r.doc_id for r in decontamination.keep_clean(documents(spark, texts), bench, block_bytes=block_bytes).collect()}
    assert clean == {k for k, v in got.items() if v[1] == 0}
    assert decontamination.find_contamination(documents(spark, texts[:2]), bench.limit(0)).count() == 2


def test_decontamination_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = dict(zip([r.doc_id for r in docs], brute_decontamination([r.text for r in docs], items), strict=True))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op2_benchmark_decontamination(spark, SF).collect()}
    assert got == want


def test_language_model(spark):
    texts = ["good fine good fine good"] * 3 + ["bad worse bad worse bad"] * 3 + ODD
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (None, 1), (1, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(documents(spark, texts), labels).collect()}
    assert len(got) == len(texts) and min(got[0].score, got[2].score) > max(got[3].score, got[4].score)  # a document is left out of what it is scored with
    assert got[6].score is None and got[6].n_tokens == 0
    assert np.isfinite(got[4].target_loss) and lm_scoring.cross_entropy_difference(documents(spark, texts[:1]).limit(0), labels).count() == 0


def test_token_counts(spark):
    counter = token_counts.counter(queries.tokenizer_path())
    size = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(2)
    alphabet = ["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!!", "😀", "<|endoftext|>", "word", " ", "\x1c", " \n "]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10)))
        assert counter.prefixes(text) == [size(text[:k]) for k in range(len(text) + 1)], repr(text)
        assert counter.count(text) == size(text)
        cut = counter.cut(text, 4)
        assert size(cut) <= 4 and text.startswith(cut)
    texts = small_texts(spark)[:60] + [t for t in ODD if t] + [None, "", "ab" * 20_000]
    got = {r.doc_id: r for r in token_counts.count_tokens(documents(spark, texts), queries.tokenizer_path()).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == [size(t) if t else 0 for t in texts]
    assert [got[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert token_counts.cut_to_budget(documents(spark, [None, "a b c d"]), queries.tokenizer_path(), 2).orderBy("doc_id").collect()[1].text == "a b"


def brute_secrets(text):
    kinds = [("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (_, p, f, ok) in enumerate(kinds) for m in re.finditer(p, text or "", f) if ok(m))


def test_secrets(spark):
    rng = random.Random(6)
    parts = ["password", "TOKEN", "secret", "api_key", "apikey", " = ", ":", "=", "\"", "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef0123456789", " ", "é", "\n", "sk_", "xYz9Kq", "thing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)] + ODD + small_texts(spark)[:50]
    got = {r.doc_id: r.spans for r in secret_scans.scan(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s.start, secret_scans.KINDS.index(s.kind), s.end) for s in got[k] if s.kind != "markov"] == brute_secrets(t), t
        base = [s for s in got[k] if s.kind != "markov"]
        assert all(s.end <= b.start or b.end <= s.start for s in got[k] if s.kind == "markov" for b in base)
    model = secret_scans.trained()
    assert secret_scans.redact("key R4nd0mK3yQx7ZpLw9Tg2VbNs8Jd and get_user_name_from_database_row", model) == "key [MARKOV] and get_user_name_from_database_row"
    assert secret_scans.redact("token: abcdef1 x", model) == "[ASSIGN] x"
    held = random.Random(99)
    caught = [secret_scans.find(s, model) for v in secret_scans.random_samples(held, 100).values() for s in v]
    assert np.mean([bool(c) for c in caught]) > 0.97
    assert np.mean([bool(secret_scans.find(s, model)) for s in secret_scans.ordinary_samples(held, 500)]) < 0.02


def brute_targets(sizes, weights, most):
    order = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    w = {k: weights[j % len(weights)] for j, k in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in capped]
        rest = total - sum(capped.values())
        share = {k: rest * w[k] / sum(w[j] for j in free) for k in free}
        over = [k for k in free if share[k] > most * sizes[k]]
        if not over:
            return capped | share
        capped |= {k: most * sizes[k] for k in over}


def test_mixing(spark):
    rng = random.Random(8)
    names = ["a", "b", "Z", None, "é", "c"]
    sources = [rng.choices(names, (60, 2, 2, 10, 10, 16))[0] for _ in range(1500)]
    texts = ["w " * rng.randint(0, 40) for _ in sources]
    docs = documents(spark, texts, sources)
    rows = source_mixing.mix(docs).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = brute_targets(sizes, (5, 2, 1), 3.0), {}
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    assert sorted(rows) == sorted(source_mixing.mix(docs.repartition(5)).collect())
    mixed = source_mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.repeats for r in rows if r.repeats}
    assert source_mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in source_mixing.mix(documents(spark, [None, "", " "])).collect()] == [0, 0, 0]


def brute_pii(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m)]


def test_personal_data(spark):
    rng = random.Random(5)
    parts = ["a.b", "x_y", "@", "mail.org", "@b.c", "1", "10.0.0.", "255", "256", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "-", "é", "😀", "\n", "007", "word", "(", ")"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)] + [t for t in ODD if t != "\x00"] + small_texts(spark)[:40] + ["a." * 20_000 + "@" + "b." * 20_000 + "c", "1" * 50_000]
    found = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[k] if s.kind != "term"] == brute_pii(t), repr(t[:200])


def test_disclosing_terms(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(("the", "of", "and", "to", "in", "for", "is", "on")) for _ in range(12))
    texts = [f"{filler()} Zanzibar jo@mail.org {filler()}" for _ in range(5)] + [filler() for _ in range(60)] + [f"{filler()} al@mail.org copied Quux"] * 9
    found = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert all([s.value for s in found[k].spans] == ["jo@mail.org", "zanzibar"] for k in range(5))
    assert all([s.kind for s in found[k].spans] == ["email"] for k in range(65, 74))
    assert not any(found[k].spans for k in range(5, 65))
    from pyspark.sql import functions as F

    both = documents(spark, texts).join(pii.find_personal_data(documents(spark, texts)), "doc_id").where("doc_id = 0").select(pii.sanitised(F.col("text"), F.col("spans")).alias("t")).first().t
    assert "[EMAIL]" in both and "Zanzibar" not in both and "jo@" not in both


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:180] = x[20]
    rows = [(k, x[k].tolist()) for k in range(600)] + [(600, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [None, *[1.0] * 7]), (680, [float("inf")] * 8), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest_neighbours.nearest(frame, factor=1.0, shard_rows=150, block_rows=20).collect()}
    wide = x.astype(float)
    s = np.stack([nearest_neighbours.products(np.broadcast_to(q, wide.shape), wide) for q in wide])
    for q in range(0, 600, 20):
        order = [k for k in np.lexsort((np.arange(600), -s[q])) if k != q][:20]
        assert [got[q, r + 1] for r in range(20)] == [(k, s[q, k]) for k in order]
    assert len(got) == 30 * 20
    near = {(r.query_id, r.vec_id) for r in nearest_neighbours.nearest(frame, factor=1.1).collect()}
    assert len(near & {(q, v[0]) for (q, _), v in got.items()}) >= 0.9 * len(got)
    assert nearest_neighbours.nearest(frame.limit(0)).count() == 0
    assert nearest_neighbours.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect() == [(0, 1, 1, 2.0)]


def brute_simhash(texts):
    prints = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(texts))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(texts))]) != label:
        label = new
    return [f"{p:016x}" for p in prints], label


@pytest.mark.parametrize("ring", [13, 4])
def test_simhash(spark, ring, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, ring, 400))
    rng = random.Random(7)
    texts = small_texts(spark)[:120]
    for _ in range(60):
        w = rng.choice([t for t in texts if len(t) > 2000]).split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += ODD + [None, ""]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints, label = brute_simhash(texts)
    assert [got[k][0] for k in range(len(texts))] == prints
    assert [got[k][1] for k in range(len(texts))] == label


def test_simhash_links_fingerprints_at_every_distance(spark):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(prints)
    found = simhash.components(simhash.links(spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long"), bundle_rows=500)).collect()
    root = {r.node: r.root for r in found}
    label = list(range(len(prints)))
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(prints))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(prints))]) != label:
        label = new
    own = [root.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    assert len(set(zip(own, label, strict=True))) == len(set(own)) == len(set(label)) < len(prints)


def test_simhash_odd_rows(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 1), (4, "x y z w", 1), (4, "x y z w", 2), (None, "x y z w", 3), (2, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (4, 4), (4, 4), (None, 4), (2, 2)], key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_vantage_point_tree():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 60, 3)]]))
    want = {(q, p) for q in range(len(points)) for p in np.flatnonzero(np.bitwise_count(points ^ points[q]) <= 3).tolist()}
    assert set(simhash.tree_links(points, points, 3, leaf=8)) == want


def test_components(spark):
    chain = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}


def test_toxicity(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) >= 0.9
    odd = toxicity.score(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in toxicity.score(documents(spark, ["a", "b"]), toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    kept = toxicity.keep_civil(documents(spark, [None, *small_texts(spark)[:20]]), model)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.05)).astype(float)
    trees = toxicity.boost(x[:1500], y[:1500])
    assert np.mean((trees.margin(x[1500:]) > 0) == (y[1500:] > 0.5)) > 0.85
    at, chance = toxicity.isotonic(trees.margin(x[1500:]), y[1500:])
    assert (np.diff(at) > 0).all() and (np.diff(chance) >= 0).all()


def test_words_are_counted_and_sources_ranked(spark):
    from pyspark.sql import functions as F

    texts = ["a b\tc", None, "", " ", "é x \U0001f600 y", "\x0b\x0c\r\n", "$1 \\ a", "w " * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", source_mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
    names = [None, "", "￿", "\U0001f600", *(f"s{k}" for k in range(300))]
    sources = spark.createDataFrame([("n" if s is None else f"v{s}", s) for s in names], "k string, source string")
    order = sorted((s for s in names if s is not None), key=lambda s: s.encode())
    assert {r["k"]: r["rank"] for r in source_mixing.ranked(sources).collect()} == {f"v{s}": k for k, s in enumerate(order)} | {"n": len(order)}


def clashing(spark, texts, sources=None):
    """Documents with a map, a column named like an operator's own, and names that differ only in case."""
    rows = [(k, t, (sources or ["s"] * len(texts))[k], {"a": k}, k, "other", 7, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, repetition int, Text string, c0 int, key int")


def test_clashing_columns(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", None, "", "password: abcdef123 x"]
    docs = clashing(spark, texts)
    bench = spark.createDataFrame([("i", "gamma delta", "x")], "item_id string, text string, Text string")
    labels = spark.createDataFrame([(0, 1, 1, "x"), (4, 0, 0, "y")], "doc_id long, toxic int, quality int, Doc_id string")
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "y")], "page_id long, url string, html string, HTML string")
    assert [r.text for r in html_extraction.extract_main_text(pages).collect()] == ["x"]
    assert {r.doc_id: r.n_hit for r in decontamination.find_contamination(docs, bench).collect()} == {0: 2, 1: 2, 2: 0, 3: 0, 4: 0}
    kept = decontamination.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 3, 4]
    assert lm_scoring.cross_entropy_difference(docs, labels).count() == 5
    assert token_counts.count_tokens(docs, queries.tokenizer_path()).count() == 5
    assert token_counts.cut_to_budget(docs, queries.tokenizer_path(), 2).columns == docs.columns
    assert secret_scans.scan(docs).count() == 5
    redacted = secret_scans.redact_rows(docs)
    assert redacted.columns == docs.columns and "[ASSIGN]" in {r[0]: r[1] for r in redacted.collect()}[4]
    assert source_mixing.mix(docs).count() == 5
    mixed = source_mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "repetition_1"] and {r[0] for r in mixed.collect()} <= set(range(5))
    assert pii.find_personal_data(docs).count() == 5
    vectors = spark.createDataFrame([(0, [1.0, 0.0], "x", 1), (1, [0.5, 0.5], "y", 2)], "vec_id long, embedding array<double>, Vec_id string, id int")
    assert nearest_neighbours.nearest(vectors).collect() == [(0, 1, 1, 0.5)]
    assert simhash.near_duplicates(docs).count() == 5
    one = near_copies.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r[0] for r in one.collect()) == [0, 2, 4]
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 5 and toxicity.keep_civil(docs, model).columns == docs.columns


def test_item_without_id_hits(spark):
    bench = spark.createDataFrame([(None, "one two three"), ("b", "four five")], "item_id string, text string")
    docs = documents(spark, ["zero one two three", "four five six", "none"])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == {0: (3, []), 1: (2, ["b"]), 2: (0, [])}
    assert [r.doc_id for r in decontamination.keep_clean(docs, bench).collect()] == [2]


def test_repeated_rows_are_mixed_one_by_one(spark):
    texts, sources = ["w " * 10] * 100 + ["w " * 5 for _ in range(300)], ["b"] * 100 + ["a"] * 300
    rows = [(k if s == "a" else 0, t, "en", s, None) for k, (t, s) in enumerate(zip(texts, sources, strict=True))]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_targets({"a": 1500, "b": 1000}, (5, 2, 1), 3.0)
    got = source_mixing.mix(docs, weights=(5, 2, 1)).collect()
    assert len(got) == 400
    for s, size in (("a", 1500), ("b", 1000)):
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - want[s]) <= 10 and all(r.taken <= 3 * r.size for r in mine)
    again = source_mixing.mixed(docs)
    assert sorted(r.taken for r in got if r.repeats) == sorted(5 * n if s == "a" else 10 * n for (s, _, n) in _times(again, got))


def _times(mixed, rows):
    """(source, doc_id, repeats) by row, from the numbers that a mix gives to equal rows."""
    found = {(r.source, r.doc_id): r["count"] for r in mixed.groupBy("source", "doc_id").count().collect()}
    out = [(s, d, n) for (s, d), n in found.items() if s == "a"]
    of_b = [r.repeats for r in rows if r.source_size == 1000 and r.repeats]
    assert found[("b", 0)] == sum(of_b)
    return out + [("b", 0, n) for n in of_b]


def test_repeated_query_has_twenty_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(61)]
    frame = spark.createDataFrame([*rows, rows[20], rows[33]], "vec_id long, embedding array<double>")
    got = [r for r in nearest_neighbours.nearest(frame).collect() if r.query_id == 20]
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 21)) and 20 not in {r.vec_id for r in got}
    assert len({r.vec_id for r in got}) >= 19


def test_bound_holds_for_rows(spark, monkeypatch):
    rows = [(k % 60, f"word{k} bad{k % 3} text", "en", "s", None) for k in range(3000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    fed = []
    monkeypatch.setattr(toxicity, "boost", lambda x, y, **_: fed.append(len(x)) or toxicity.Trees(0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))))
    monkeypatch.setattr(toxicity, "isotonic", lambda s, y: fed.append(len(s)) or (np.zeros(1), np.zeros(1)))
    toxicity.train(spark.createDataFrame(rows, DOCS), labels, bound=40)
    assert 0 < sum(fed) <= 40


def test_long_texts_take_time_in_proportion():
    import time

    model, lexicon, secrets = html_extraction.trained(), toxicity.Lexicon(frozenset(), frozenset()), secret_scans.trained()
    began = time.time()
    for page in ("<a" * 300_000, "<div>" * 60_000 + "</p>" * 60_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<a \">" * 100_001, "<li>" * 60_000, "</script " * 100_000):
        html_extraction.extract(page, model)
    for text in ("a" * 1_000_000, "ab1" * 300_000, "a " * 300_000, "!" * 1_000_000):
        toxicity.measure(text, lexicon)
        secret_scans.find(text, secrets)
    assert time.time() - began < 60


def test_html_texts_match_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        """Text of the article, without the elements that pages put around or between its blocks."""

        def __init__(self):
            super().__init__()
            self.out, self.inside, self.skip = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += tag in ("script", "style", "nav", "aside", "form", "footer", "header")
            self.out += [] if tag in html_extraction.INLINE else [" "]

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style", "nav", "aside", "form", "footer", "header")
            self.out += [] if tag in html_extraction.INLINE else [" "]

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.out.append(data)

    got = {r.page_id: r.text for r in queries.op1_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = Plain()
        plain.feed(r.html or "")
        assert got[r.page_id] == " ".join("".join(plain.out).split())


def test_scores_match_a_plain_walk():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, 17)), rng.integers(0, 2, 400).astype(float)
    trees = toxicity.boost(x, y, rounds=7)
    at, chance = toxicity.isotonic(trees.margin(x), y)
    model = toxicity.Model(toxicity.Lexicon(frozenset(), frozenset()), trees, at, chance, 0.5)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        margin = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += value[node - len(feature)]
        k = int(np.searchsorted(at, margin))
        flat = chance[0] if k == 0 else chance[-1] if k == len(at) else chance[k - 1] + (chance[k] - chance[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])
        want = flat + (1e-4 * (1 / (1 + np.exp(-margin)) - 0.5) if abs(flat - 0.5) > 1e-3 else 0)
        assert got == pytest.approx(min(1, max(0, want)), abs=1e-9)


def test_kept_chars_answer_truncation(spark):
    counter = token_counts.counter(queries.tokenizer_path())
    size = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(3)
    parts = ["alpha", " beta", "  ", "\n\n", " don't", " 12", "é", " !!", " ", "<|endoftext|>", " longerword"]
    for _ in range(60):
        text = "".join(rng.choices(parts, (5, 5, 1, 1, 2, 2, 1, 1, 1, 0.1, 5), k=60))
        for budget in (0, 3, 20, 41):
            want = max(k for k in range(len(text) + 1) if size(text[:k]) <= budget)
            assert counter.measure(text, budget) == (size(text), want), (text, budget)


def test_secret_spans_match_plain_ratios(monkeypatch):
    """Spans that the models add, against the ratio of each run taken by itself; also where long runs come in blocks."""
    model = secret_scans.trained()
    rng = random.Random(12)
    piece = lambda: rng.choice([rng.choice(["hello", "Heute", "é😀", "user_name", "0c6a0c4", "x=", "token: abcdef9", "\n", "-", "2024-11-28", "AKIA" + "Q7" * 9]), "".join(rng.choices("0123456789abcdef", k=rng.randint(1, 30))), "".join(rng.choices(secret_scans._ALPHABET, k=rng.randint(1, 40)))])
    texts = ["".join(piece() + rng.choice(["", " ", ". ", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["".join(rng.choices("0123456789ABCDEF", k=5000)), "a" * 3000 + " 0c6a0c4 " + "Zz9+" * 2000]
    plain = secret_scans.ratios
    for block in (7, 100, 1 << 17):
        monkeypatch.setattr(secret_scans, "ratios", lambda c, s, e, m, block=block: plain(c, s, e, m, block))
        for text in texts:
            base = secret_scans.base_spans(text)
            free = [c in secret_scans._CODE for c in text]
            for start, _, end in base:
                free[start:end] = [False] * (end - start)
            want, at = list(base), 0
            for on, run in __import__("itertools").groupby(free):
                n = len(list(run))
                if on and (ratio := secret_scans.likelihood_ratio(text[at : at + n], model)) >= 16 and ratio >= 0.4 * n:
                    want.append((at, 3, at + n))
                at += n
            assert secret_scans.find(text, model) == sorted(want)
    assert [secret_scans.find(t, model) for t in ("0c6a0c4", "hello", "", None)] == [[(0, 3, 7)], [], [], []]


def test_html_keeps_formulas_and_fallbacks():
    page = "<article><p>Let <math>x</math> be <noscript>shown</noscript> a <svg>label</svg> number.</p><object><p>No plug-in here.</p></object></article>"
    assert html_extraction.extract(page, html_extraction.trained()) == "Let x be shown a label number. No plug-in here."


def test_beginnings_keep_letters_whole():
    assert toxicity.stems(["abcdefg".encode(), "abcdé".encode(), "ббббб".encode(), "abc".encode()]) == [b"abcde", "ббб".encode()]


def test_short_and_long_terms_enter_the_lexicon(spark):
    texts = [("zq" if k % 2 else "fine") + " " + ("y" * 60 if k % 2 else "words here") + f" and {k}" for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, texts + [None, texts[0], texts[0]]), labels)
    assert {b"zq", b"y" * 60} <= model.lexicon.words
