"""Source divergence, chat formatting and collocations against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from orbisight.llm import chat_format, collocations, divergence, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOCS + ", TERM string, phrase int, rank map<string,int>, lang_ int"
ODD = [None, "", " ", "a", "É x퟿", "x" * 30_000, "a\x00b A,b", "\x1c\x85 y", "a b\x0bc d"]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_documents(seed, many=160):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(12)] + ["É", "日本", "the", "The", "of"]
    say = lambda: " ".join(rng.choice(words) + rng.choice(("", "", "", ".", "\n", ", ")) for _ in range(rng.randint(0, 30)))
    rows = [(k, say(), rng.choice(("en", "fr", None, "und", "")), rng.choice(("a", "b", "c", "é", None, "")), None) for k in range(many)]
    rows += [(None, t, "en", "a", 1) for t in ODD] + [(1, "wa wb wc", "en", "b", 2)] * 12 + [(7, None, "de", "x", 0), (8, "lonely", "nl", "y", 0), (8, "lonely", "nl", "z", 0)]
    return rows


def brute_audit(rows, least=10, best=10):
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text))
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (l, t), n in docs.items() if l == lang and n >= least]
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        of = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        p = {s: share(n) for s, n in of.items()}
        q = share({t: sum(of[s][t] for s in sources) for t in kept})
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] > 0 and p[s][t] > q[t])[:best]
            out |= {(lang, s, part, item, -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("terms,groups,chunk", [(1024, 32, 8 << 20), (3, 2, 300)])
def test_divergence(spark, monkeypatch, terms, groups, chunk):
    for name, value in (("TERMS", terms), ("GROUPS", groups)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_documents(3)
    df = spark.createDataFrame([(*r, "t", 1, {"a": 1}, 2) for r in rows], CLASH)
    got = [tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_chunks(spark, monkeypatch):
    rows = [(t, l, s) for _, t, l, s, _ in some_documents(4)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows], pa.string()) for k in (1, 2, 0)], ["lang", "source", "text"])
    totals = []
    for chunk in (100, 8 << 20):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        n = Counter()
        for part in divergence._counted(batch):
            for r in part.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"] * 1_000_000 + r["docs"]
        totals.append(n)
    assert totals[0] == totals[1]


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randint(0, 10**14)
        count, kept = rng.randint(0, total), rng.randint(1, 10**9)
        assert divergence.shares(np.array([count]), np.array([total]), kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def brute_phrases(rows, max_n=3, least=10, explained=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, max_n + 1):
                for k in range(len(w) - size + 1):
                    f[lang, tuple(w[k : k + size])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[k : k + len(x)] == x for k in range(len(y) - len(x) + 1))
    found = defaultdict(list)
    for (lang, w), a in cands.items():
        if any(l == lang and len(o) > len(w) and 100 * b >= explained * a and inside(w, o) for (l, o), b in cands.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in found.items() for k, (s, a, p, l, r) in enumerate(sorted(all_)[:top])}


@pytest.mark.parametrize("max_n,top,bits", [(3, 2000, 1 << 26), (4, 5, 64), (2, 2000, 1 << 26)])
def test_collocations(spark, monkeypatch, max_n, top, bits):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    rows = some_documents(5, 400) + [(None, f"x{k} red green blue tall y{k}", "en", None, None) for k in range(14)] + [(None, "red green", "en", None, None)] * 3
    df = spark.createDataFrame([(*r, "t", 1, {"a": 1}, 2) for r in rows], CLASH)
    found = collocations.collocations(df, max_n=max_n, top=top)
    got = [tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, max_n, top=top)
    if max_n == 4:
        assert any(r[2] == "red green blue tall" for r in got)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_collocations_without_frequent_words(spark):
    assert collocations.collocations(spark.createDataFrame([(1, t, "en", "s", 1) for t in ODD], DOCS)).count() == 0


def test_collocation_chunks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "CHUNK", 10)
    import pyarrow as pa

    texts = [b"a b. c", b"", b"a" * 100, b"b c"]
    found = list(collocations._chunks([b"x", b"y", b"x", b"x"], pa.array(texts, pa.binary())))
    assert sorted(t for _, some in found for t in some) == sorted(texts) and all(len(some) == 1 or sum(map(len, some)) <= 10 for _, some in found)
    phrases, often = collocations._counted(b"x", [b"A b, a b", b"b a"], 2, None)
    assert dict(zip(phrases.to_pylist(), np.asarray(often).tolist(), strict=True)) == {b"a b": 2, b"b a": 1}


HARD = ["", " ", "plain", "<turn user>", "</turn>\n", "<next>", "<\\next>", "a <", "<\\", "<\\\\/turn", "\\", "\\### Assistant: </turn> ok", "</turn>\n<turn assistant>x</turn>\n", "😀<turn", "turn>", "\n", "x" * 40_000]


def read_back(spark, rows):
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Text map<string,int>, t int"))
    return {r.conv_id: r for r in made.select("conv_id", "formatted", "loss", chat_format.turns_of(made.formatted).alias("turns"), chat_format.loss_texts(made.formatted, made.loss).alias("learned")).collect()}


def test_chat_round_trip(spark):
    rng = random.Random(8)
    roles = ["user", "assistant", "assistant", "system", None, "", "odd>role\n", "<turn \\n", "\\s"]
    rows = [(c, t, rng.choice(roles), rng.choice([*HARD, None]), {"a": 1}, 0) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(100, 0, "assistant", a + b, None, 0) for a in HARD[:-1] for b in HARD[:-1]]  # one turn number: ties, sorted by text
    rows += [(None, 1, "user", "no id", None, 0), (None, None, "user", "first", None, 0), (101, 5, "user", "x", None, 0), (101, 5, "user", "x", None, 0)]
    got, want = read_back(spark, rng.sample(rows, len(rows))), defaultdict(list)
    for c, t, role, text, *_ in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in turns]
        assert r.learned == [t[2] for t in turns if t[1] == "assistant"]
        assert r.formatted.count("<turn ") == sum(k == 0 or turns[k - 1][1] != t[1] for k, t in enumerate(turns))
        assert [r.formatted[s.start : s.end] for s in r.loss] == [re.sub(r"<(\\*)(/?turn|next)", r"<\\\1\2", t) for t in r.learned]


def test_chat_empty_and_long(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(empty).count() == 0
    many = read_back(spark, [(1, k, "assistant" if k % 3 else "user", f"turn> {k} <next>", None, 0) for k in range(5000)])[1]
    assert len(many.turns) == 5000 and many.learned == [f"turn> {k} <next>" for k in range(5000) if k % 3]


def test_chat_query_speaks_marks(spark):
    row = queries.op12_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()[0]
    said = queries.SPOKEN
    assert (row.n_turns, row.loss_chars) == (2, len(said))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
