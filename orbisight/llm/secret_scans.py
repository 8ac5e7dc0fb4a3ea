"""Secret scanning: fixed patterns, and character Markov models of random strings against ordinary identifiers.

First-order Markov models are trained from labelled samples: one for each family of random strings (hex, upper-case
alphanumeric, base 64) and one for ordinary identifiers.  A run of key characters, of any length and case, is a secret if
the log-likelihood ratio of the best random family to the ordinary model exceeds a threshold per character and in all.
Pattern matches stay as they are; what they leave of a run is scored too, so the models add spans that touch none of them.

Edge cases: null counts as empty (no spans); repeated rows repeat; an empty table gives an empty result; other columns
are ignored, also if their names clash.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ._common import by_place, by_slices, place, rows_by_arrow

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that identifiers are made of.
ORDINARY = (
    "abort accept account action active add address alias align allow append apply archive array assert async attach attribute author average backup base batch begin binary block body boolean border bound branch bucket buffer build bundle button byte cache call cancel capture category cell change channel char check child "
    "class clean clear client clone close cluster code collect color column command comment commit compare compile config connect console const container content context control convert copy count create current cursor data database date debug decode default define delete depth describe device digest direct disable display document "
    "domain download draw driver element empty enable encode end engine entry error event exact example except exclude execute export expression factory feature field file filter final find first flag flat float folder font force format forward frame function generate get global graph grid group handle hash header height hidden "
    "history host image import include index info input insert install instance integer interface item iterator join key label language last latest layout length level library limit line link list load local lock log long loop"
).split()
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {c: k for k, c in enumerate(_ALPHABET)}
#: The code of each character under 128 and of all others, -1 where it is no key character.
_CODES = np.array([_CODE.get(chr(c), -1) for c in range(128)] + [-1], np.int8)


def random_samples(rng: random.Random, n: int) -> dict[str, list[str]]:
    """Labelled random strings by family."""
    families = {"hex": "0123456789abcdef", "upper": _ALPHABET[:26] + "0123456789", "base64": _ALPHABET[:62] + "+/", "alnum": _ALPHABET[:62]}
    return {name: ["".join(rng.choices(letters, k=rng.randint(20, 64))) for _ in range(n)] for name, letters in families.items()}


def ordinary_samples(rng: random.Random, n: int) -> list[str]:
    """Labelled ordinary strings: identifiers, paths and shouted, numbered and plain words, from a fixed list and made syllables."""
    parts = [a + b for a in ("b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "st", "t", "th", "tr", "v", "w") for b in ("a", "e", "i", "o", "u", "ai", "an", "ed", "en", "er", "ing", "ion", "on", "ou")]
    made = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
    word = lambda: rng.choice(ORDINARY) if rng.random() < 0.6 else made()
    styles = (lambda p: "_".join(p), lambda p: "-".join(p), lambda p: "".join(w.title() for w in p), lambda p: "_".join(p).upper(), lambda p: "/".join(p), lambda p: "".join(p), lambda p: "".join(p).upper(), lambda p: "-".join(p).title())
    ends = ("", "", "", lambda: f"_{rng.randint(1, 2030)}", lambda: str(rng.randint(1, 99)), "=", "--------", lambda: f"-{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"/{rng.randint(0, 10**9)}")
    numbers = lambda: str(rng.randint(0, 10 ** rng.randint(8, 20)))
    end = lambda: e() if callable(e := rng.choice(ends)) else e
    return [numbers() if rng.random() < 0.03 else rng.choice(styles)([word() for _ in range(rng.randint(1, 6))]) + end() for _ in range(n)]


def markov(samples: list[str], smoothing: float = 0.1, unknown: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the first character and of each next one; a share ``unknown`` goes to all characters alike."""
    size = len(_ALPHABET)
    first, pairs = np.full(size, smoothing), np.full((size, size), smoothing)
    for s in samples:
        codes = [_CODE[c] for c in s]
        first[codes[0]] += 1
        np.add.at(pairs, (codes[:-1], codes[1:]), 1)
    blend = lambda p: np.log((1 - unknown) * p + unknown / size)
    return blend(first / first.sum()), blend(pairs / pairs.sum(1, keepdims=True))


@lru_cache(maxsize=4)
def trained(seed: int = 11, n: int = 4000) -> tuple:
    """(random families, ordinary, what they add to a ratio, lengths that totals need) fitted to ``n`` seeded samples each."""
    rng = random.Random(seed)
    families, ordinary = {k: markov(v) for k, v in random_samples(rng, n).items()}, markov(ordinary_samples(rng, 3 * n), unknown=0.1)
    return families, ordinary, gains(families, ordinary), {}


def likelihood_ratio(run: str, model: tuple) -> float:
    """Best random family's log-likelihood less the ordinary one's."""
    codes = np.fromiter((_CODE[c] for c in run), np.int64, len(run))
    score = lambda m: m[0][codes[0]] + m[1][codes[:-1], codes[1:]].sum()
    return float(max(map(score, model[0].values())) - score(model[1]))


def shortest(total: float, model: tuple) -> int:
    """How many characters a run needs at least to reach a ratio of ``total``: the best of any string of each length."""
    if total in model[3]:
        return model[3][total]
    start, step = model[2]
    found = []
    for k in range(start.shape[1]):
        best, n = start[:, k], 1
        while best.max() < total and n < 256:
            best, n = (best[:, None] + step[:, k].reshape(len(_ALPHABET), -1)).max(0), n + 1
        found.append(n)
    model[3][total] = min(found)
    return model[3][total]


def gains(families: dict, ordinary: tuple) -> tuple[np.ndarray, np.ndarray]:
    """What a first character and each pair of characters (a row of it) adds to the ratio, by family."""
    start = np.stack([m[0] - ordinary[0] for m in families.values()], axis=1)
    return start, np.stack([(m[1] - ordinary[1]).ravel() for m in families.values()], axis=1)


def ratios(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: tuple, block: int = 1 << 17) -> np.ndarray:
    """The ratio of each run of a text, runs in order; about ``block`` characters are looked up at once, of a longer run too."""
    start, step = model[2]
    sums = start[codes[starts]]
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + block, side="right")))
        for at in range(starts[k], ends[last - 1] - 1, block):  # more than once for a single long run only
            end = min(at + block, ends[last - 1] - 1)
            known = codes[at : end + 1].astype(np.int64)
            pairs = step[np.maximum(known[:-1], 0) * len(_ALPHABET) + np.maximum(known[1:], 0)]
            if last == k + 1:
                sums[k] += pairs.sum(0)
            else:
                edges = np.stack([starts[k:last], ends[k:last] - 1], axis=1).ravel() - at
                sums[k:last] += np.add.reduceat(np.vstack([pairs, np.zeros((1, pairs.shape[1]))]), edges, axis=0)[::2]
        k = last
    return sums.max(1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches."""
    spans, lower = [], text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def find(text: str | None, model: tuple, per_character: float = 0.4, total: float = 16.0) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end), by start and then kind."""
    if not text:
        return []
    spans = base_spans(text)
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[np.minimum(wide, 128)]
    for start, _, end in spans:
        codes[start:end] = -1  # what spans leave of a run is scored
    steps = np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    enough = ends - starts >= shortest(total, model)
    starts, ends = starts[enough], ends[enough]
    found = ratios(codes, starts, ends, model)
    random_ = (found >= total) & (found >= per_character * (ends - starts))
    return sorted(spans + [(int(a), 3, int(b)) for a, b in zip(starts[random_], ends[random_], strict=True)])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_character: float = 0.4, total: float = 16.0) -> DataFrame:
    """doc_id and spans (kind, start, end, ordered) of every row; one narrow pass, the models are small and fixed in size."""
    model = trained()
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))

    def make(doc_id: list, text: list) -> dict:
        return {"doc_id": doc_id, "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, model, per_character, total)] for t in text]}

    return rows_by_arrow(rows, "doc_id long, spans array<struct<kind:string,start:int,end:int>>", make)


def redact(text: str | None, model: tuple) -> str | None:
    """The text with every span, overlapping ones merged, replaced by a mark of its first kind."""
    if not text:
        return text
    out, at = [], 0
    for start, kind, end in find(text, model):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def redacted(text: Column) -> Column:
    """A column with the secrets of a text column replaced; null stays null."""
    model = trained()

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(by_slices(texts, lambda part: [redact(t, model) for t in part]), pa.string())

    return run(text)


def redact_rows(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows with redacted texts; ``n_chars``, if there is such a column, follows where the text isn't null."""
    own, body = by_place(docs), place(docs, text)
    own = own.withColumn(body, redacted(F.col(body).cast("string")))
    if n_chars in docs.columns:
        at = place(docs, n_chars)
        own = own.withColumn(at, F.coalesce(F.length(body).cast("long"), F.col(at)))
    return own.toDF(*docs.columns)
