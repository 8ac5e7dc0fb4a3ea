"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words and word beginnings whose smoothed log odds between toxic and other
documents are high.  Features are densities of the lexicon, hits near the second person, capitals, punctuation and
obfuscation.  Boosting fits the logistic loss with histogram trees; isotonic regression on rows kept out of the trees
maps margins to probabilities.

Only labelled rows with crc32(doc_id as text) mod 5 other than 0 are learned from, of these at most ``bound`` (those
with the smallest hash of doc_id), so what reaches the driver is bounded: a lexicon of at most ``2 * words`` terms and
one short feature row for each of them.  Labels, lang, source and doc_id are no inputs of a score.

Edge cases: null counts as empty and gets the score of an empty text; without labels of both kinds every score is the
base rate (0 without labels); labels with a null doc_id or value are left out, a doc_id with several labels is toxic if
one says so; of rows that share a doc_id one text is learned from, so ``bound`` holds for rows; repeated documents each
get a row; other columns are ignored, also if their names clash.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ._common import _WORDS, by_place, by_slices, place, rows_by_arrow, settle, utf8

#: Fixed lists: the second person in the languages of the corpus, and the signs that stand for letters.
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself youre ya u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus".split())
LEET = str.maketrans("013457@$!", "oieastasi")
#: Tried at the start of a run of letters only and possessive, so that a long word is read once.
_OBFUSCATED = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[013457@$!*#]++[A-Za-z]++)++|\b[A-Za-z](?:[.\-_* ][A-Za-z]\b){3,}+")
STEM = 5
NAMES = ("n", "word_hits", "word_kinds", "word_density", "stem_hits", "stem_kinds", "stem_density", "near_you", "you_density", "upper_ratio", "upper_words", "exclaim", "question", "punctuation", "obfuscated", "obfuscated_hits", "longest_repeat")


class Lexicon(NamedTuple):
    words: frozenset[bytes]
    stems: frozenset[bytes]


def stems(words: list[bytes]) -> list[bytes]:
    """Beginnings of words that have more to them."""
    return [b for w in words if len(w) > STEM and len(b := beginning(w)) < len(w)]


def beginning(word: bytes) -> bytes:
    """The first ``STEM`` bytes of a word, and what the letter that they end in still needs."""
    end = STEM
    while end < len(word) and word[end] & 0xC0 == 0x80:
        end += 1
    return word[:end]


def measure(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    raw = utf8(text)
    words = raw.translate(_WORDS).split()
    n = len(words)
    hits = [k for k, w in enumerate(words) if w in lexicon.words]
    begun = [b for b in stems(words) if b in lexicon.stems]
    you = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(1 for k in hits if any(abs(k - y) <= 4 for y in you)) if len(you) <= 64 else sum(1 for k in hits if not SECOND_PERSON.isdisjoint(words[max(0, k - 4) : k + 5]))
    size = max(1, len(raw))
    letters = len(raw.translate(None, _NOT_LETTERS))
    upper = len(raw.translate(None, _NOT_UPPER))
    hidden = _OBFUSCATED.findall(text) if text and n else []
    plain = [re.sub(r"[^a-z]", "", h.translate(LEET).lower()).encode() for h in hidden]
    found = sum(1 for p in plain if p in lexicon.words or beginning(p) in lexicon.stems)
    marks, asks = raw.count(b"!"), raw.count(b"?")
    punctuation = len(raw.translate(None, _NOT_PUNCTUATION))
    shouted = len(re.findall(rb"\b[A-Z]{3,}\b", raw)) if upper > 2 else 0
    n1 = max(1, n)
    return [
        float(n), len(hits), len({words[k] for k in hits}), len(hits) / n1, len(begun), len(set(begun)), len(begun) / n1, near, len(you) / n1, upper / max(1, letters), shouted / n1,
        marks / size, asks / size, punctuation / size, len(hidden) / n1, found, float(max((m.end() - m.start() for m in re.finditer(rb"!{2,}|\?{2,}", raw)), default=0)),
    ]


_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c > 127))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_PUNCTUATION = bytes(c for c in range(256) if c > 127 or c <= 32 or chr(c).isalnum())


class Trees(NamedTuple):
    """Complete binary trees of one depth: feature and cut by node, value by leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(value)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting with Newton leaves; splits are sought among ``bins`` quantiles of each feature."""
    rate_of = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    base = float(np.log(rate_of / (1 - rate_of)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    inner = 2**depth - 1
    margin, features, values, limits = np.full(len(y), base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            place, best = node - start, np.full(width, 1e-9)
            sum_g, sum_h = np.bincount(place, g, width), np.bincount(place, h, width)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key, k = place * (len(c) + 1) + code[:, f], width * (len(c) + 1)
                lg = np.bincount(key, g, k).reshape(width, -1).cumsum(1)[:, :-1]
                lh = np.bincount(key, h, k).reshape(width, -1).cumsum(1)[:, :-1]
                rg, rh = sum_g[:, None] - lg, sum_h[:, None] - lh
                gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (sum_g**2 / (sum_h + ridge))[:, None], -1)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[start + better], cut[start + better] = f, c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        limits.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(limits), np.array(values))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins in order and the probability at each, for interpolation between them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum, margin sum
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, v, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + v, blocks[-1][2] + m]
    return np.array([m / w for w, _, m in blocks]), np.array([(v + 0.01) / (w + 0.02) for w, v, _ in blocks])


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    chance: np.ndarray
    rate: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a trace of the margin keeps the order inside a flat stretch of the calibration."""
        if self.trees is None or not len(x):
            return np.full(len(x), self.rate)
        m = self.trees.margin(x)
        flat = np.interp(m, self.at, self.chance)
        return np.clip(flat + 1e-4 * (1 / (1 + np.exp(-m)) - 0.5) * (np.abs(flat - 0.5) > 1e-3), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = 20_000, words: int = 400) -> Model:
    """Lexicon, trees and calibration from at most ``bound`` labelled rows outside the held-out fold."""
    known = by_place(labels).select(F.col(place(labels, doc_id)).cast("long").alias("id"), F.col(place(labels, label)).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("id"), F.col(place(docs, text)).cast("string").alias("text")).where("id is not null and text is not null")
    found = rows.join(F.broadcast(known), "id")  # at most ``bound`` ids and labels are broadcast
    sample = settle(found.groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")))

    def terms(y: list, text: list, id: list) -> dict:  # noqa: A002
        out: dict[str, list] = {"stem": [], "term": [], "y": [], "part": []}
        for k, t, i in zip(y, text, id, strict=True):
            w = utf8(t).translate(_WORDS).split()
            for stem, found in ((False, set(w)), (True, set(stems(w)))):
                out["stem"] += [stem] * len(found)
                out["term"] += found
                out["y"] += [k] * len(found)
                out["part"] += [i] * len(found)
        return out

    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    rate = bad / max(1, bad + good)
    if not bad or not good:
        return Model(Lexicon(frozenset(), frozenset()), None, np.zeros(1), np.zeros(1), rate)
    counted = rows_by_arrow(sample.select("y", "text", "id"), "stem boolean, term binary, y int, part long", terms)
    counted = counted.groupBy("stem", "term").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
    doubt = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    ranked = counted.withColumn("sure", odds - 1.64 * doubt).where((F.col("bad") >= 3) & (F.col("sure") > 1.3)).withColumn("weight", F.col("bad") * F.col("sure"))
    chosen = {False: frozenset(), True: frozenset()}
    for stem in chosen:
        chosen[stem] = frozenset(bytes(r.term) for r in ranked.where(F.col("stem") == F.lit(stem)).orderBy(F.desc("weight"), "term").limit(words).collect())
    lexicon = Lexicon(chosen[False], chosen[True])
    measured = rows_by_arrow(
        sample.select("id", "y", "text"), "id long, y int, x array<double>", lambda id, y, text: {"id": id, "y": y, "x": [[float(v) for v in measure(t, lexicon)] for t in text]}  # noqa: A006
    ).orderBy("id", "x")
    got = measured.toPandas()
    x, y = np.array(got["x"].tolist(), float), got["y"].to_numpy(float)
    apart = (got["id"].to_numpy() * 2654435761 % 1000003) % 4 == 0
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    trees = boost(x[~apart], y[~apart])
    fold = apart if apart.any() else ~apart
    at, chance = isotonic(trees.margin(x[fold]), y[fold])
    return Model(lexicon, trees, at, chance, rate)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row, in one narrow pass; the model's size is bounded by its parameters."""
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))

    def make(doc_id: list, text: list) -> dict:
        x = np.array([measure(t, model.lexicon) for t in text], float).reshape(len(text), len(NAMES))
        return {"doc_id": doc_id, "score": model.score(x).tolist()}

    return rows_by_arrow(rows, "doc_id long, score double", make)


def keep_civil(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, columns as they were."""
    @arrow_udf("double")
    def rated(texts: pa.Array) -> pa.Array:
        some = lambda part: model.score(np.array([measure(t, model.lexicon) for t in part], float).reshape(len(part), len(NAMES))).tolist()
        return pa.array(by_slices(texts, some), pa.float64())

    own = by_place(docs)
    return own.where(rated(F.coalesce(F.col(place(docs, text)).cast("string"), F.lit(""))) < threshold).toDF(*docs.columns)
