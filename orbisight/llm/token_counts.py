"""Exact token counts of every prefix by dynamic programming over the tokens that can end it.

In byte-pair encoding two tokens may stand side by side exactly if encoding their joined bytes gives the two back, and
an encoding is right exactly if all its neighbours may.  So each prefix has one last token: the one that ends there and
may follow the last token of what is before it.  ``last[i]`` and ``count[i]`` follow from shorter prefixes, the whole
count is ``count[n]``, and truncation or budget questions are answered from the table without encoding again.

The query reads its count and the longest prefix within the limit from these tables; ``prefixes`` gives the whole table.
Pre-tokens never interact, so tables are kept per pre-token and added up; a cut inside a run of white space, or inside a
contraction, is looked up as the pre-tokens the cut text would have.

Edge cases: null counts as empty (0 tokens); special strings inside texts count as the library counts them by default;
repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ._common import by_place, by_slices, place, rows_by_arrow

#: Entries that a worker keeps before it forgets older ones.
CACHE = 300_000
#: Characters of a word whose entries are shared by all words that begin so.
HEAD = 6
#: The pre-tokens of byte-level BPE (a fixed value of the format), and white space that Python and the library see differently.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile(r" (?=\S)")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable character that stands for each byte in the vocabulary.
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class Kept(dict):
    """What a function gives, remembered where its argument is short.  When there are many, those met before and not since
    are forgotten; results do not depend on it."""

    def __init__(self, make: Callable[[str], Any]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 60:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class PrefixCounter:
    """Prefix tables for one byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.before = self.library.model, self.library.pre_tokenizer
        self.vocabulary = self.library.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        for s in special:
            self.vocabulary.pop(s, None)
        self.tokens: dict = {}  # a tree by character; the token that ends at a node is under ""
        for s, k in self.vocabulary.items():
            node = self.tokens
            for c in s:
                node = node.setdefault(c, {})
            node[""] = k
        self.text_of = {k: s for s, k in self.vocabulary.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.heads = Kept(self._ends)
        self.totals = Kept(lambda raw: self.table(raw.encode("utf-8", "replace").decode("latin-1").translate(BYTE_CHARS))[-1])
        self.chunks = Kept(lambda chunk: self._words(f" {chunk}"))

    def may_follow(self, a: int, b: int) -> bool:
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known = self.fits[a, b] = [t.id for t in self.model.tokenize(self.text_of[a] + self.text_of[b])] == [a, b]
        return known

    def table(self, word: str) -> list[int]:
        """count[i] for every prefix of a pre-token, written with one character for each byte."""
        return self._ends(word)[0]

    def _ends(self, word: str) -> tuple[list[int], list[int]]:
        """count[i] and last[i].  Of the tokens that end at i the one that begins first wins, so beginnings are taken in
        order and an end that has its token is left alone.  The entries of a word's head are those of the head itself, so
        words that begin alike share them."""
        n = len(word)
        if n > HEAD:
            head = self.heads[word[:HEAD]]
            count, last = [*head[0], *[0] * (n - HEAD)], [*head[1], *[-1] * (n - HEAD)]
        else:
            count, last = [0] * (n + 1), [-1] * (n + 1)
        fits = self.fits
        for j in range(n):
            node, before, nth = self.tokens, last[j], count[j] + 1
            for i in range(j, n):
                if (node := node.get(word[i])) is None:
                    break
                if last[i + 1] < 0 and (token := node.get("")) is not None:
                    if j and (known := fits.get((before, token))) is not True and (known is False or not self.may_follow(before, token)):
                        continue
                    last[i + 1], count[i + 1] = token, nth
        return count, last

    def pieces(self, text: str) -> list[str]:
        return [w for w, _ in self.before.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def _words(self, text: str) -> int:
        """Tokens of a stretch of text, by the last entry of the prefix table of each of its pre-tokens."""
        return sum(map(self.totals.__getitem__, PRE_TOKENS.findall(text)))

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        return self.measure(text, None)[0]

    def measure(self, text: str | None, budget: int | None) -> tuple[int, int]:
        """Tokens of the whole text, and the length of its longest prefix of at most ``budget`` of them.

        A space before a character that is none always begins a pre-token, so what lies between such spaces is counted
        once and remembered.  The prefix ends after the last such space with a total within the budget; only from there to
        where the total is two over, which nothing that follows makes good, are the prefixes looked at one by one.
        """
        if not text:
            return 0, 0
        segments = self.segments(text)
        if len(segments) > 1 or _ODD_SPACE.search(text):
            total = sum(1 if k % 2 else sum(self.table(w)[-1] for w in self.pieces(part)) for k, part in enumerate(segments))
            return total, len(text) if budget is None or total <= budget else self._longest(text, budget)
        first, *rest = _CHUNKS.split(text)
        sums = list(accumulate(map(self.chunks.__getitem__, rest), initial=self._words(first)))
        for known in (self.totals, self.chunks, self.heads):
            known.trim()
        if budget is None or sums[-1] <= budget:
            return sums[-1], len(text)
        lo, hi = bisect_right(sums, budget) - 1, bisect_right(sums, budget + 2)
        while lo > 0 and (not rest[lo - 1] or rest[lo - 1][-1].isspace()):  # the space must follow a character that is none
            lo -= 1
        if lo < 1:
            return sums[-1], self._longest(" ".join([first, *rest[:hi]]), budget)
        before = len(first) + lo + sum(map(len, rest[:lo]))
        return sums[-1], before + self._longest("".join(f" {c}" for c in rest[lo:hi]), budget - sums[lo])

    def _longest(self, text: str, budget: int) -> int:
        return max(i for i, n in enumerate(self.prefixes(text)) if n <= budget)

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of text[:i] for every i; special strings are counted where they are complete."""
        out, before, base = [0], "", 0
        for k, part in enumerate(self.segments(text or "")):
            if k % 2:  # while the string is not complete it is text like any other
                whole = out[-1] + 1
                out += [base + n for n in self._plain(before + part)[len(before) + 1 : -1]] + [whole]
            else:
                before, base = part, out[-1]
                out += [base + n for n in self._plain(part)[1:]]
        return out

    def _plain(self, text: str) -> list[int]:
        out, at = [0] * (len(text) + 1), 0
        for word, (start, end) in self.before.pre_tokenize_str(text):
            table, raw = self.table(word), text[start:end]
            ends = [0, *accumulate(len(c.encode()) for c in raw)]
            for i in range(1, len(raw) + 1):
                out[start + i] = out[start] + table[ends[i]]
            if raw[0] == "'" and raw[1:].isalpha():  # a contraction: its beginning is a mark and letters
                for i in range(2, len(raw)):
                    out[start + i] = out[start] + sum(self.table(w)[-1] for w in self.pieces(raw[:i]))
            at = end
        assert at == len(text)
        for m in re.finditer(r"[^\S\x1c-\x1f]+", text):  # a cut inside white space leaves one pre-token of all that is left of it
            if m.end() - m.start() > 1:
                run = self.table(self.pieces(m[0])[0])
                ends = list(accumulate(len(c.encode()) for c in m[0]))
                for i in range(m.start() + 1, m.end() + 1):
                    out[i] = out[m.start()] + run[ends[i - m.start() - 1]]
        return out

    def cut(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return text[: self.measure(text, budget)[1]]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and kept_chars (code points of the longest prefix within ``limit``) of every row.

    One narrow pass without a shuffle; ``tokenizer`` names a file that every executor has at the same path.
    """
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))

    def make(doc_id: list, text: list) -> dict:
        own = counter(tokenizer)
        n, kept = zip(*[own.measure(t, limit) for t in text], strict=True) if text else ((), ())
        return {"doc_id": doc_id, "n_bytes": [len(t.encode()) if t else 0 for t in text], "n_tokens": list(n), "over_limit": [x > limit for x in n], "kept_chars": list(kept)}

    return rows_by_arrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long", make)


def cut_to_budget(docs: DataFrame, tokenizer: str, budget: int, text: str = "text") -> DataFrame:
    """The rows with ``text`` cut to its longest prefix of at most ``budget`` tokens; null stays null."""

    @arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        own = counter(tokenizer)
        return pa.array(by_slices(texts, lambda part: [None if t is None else own.cut(t, budget) for t in part]), pa.string())

    body = place(docs, text)
    return by_place(docs).withColumn(body, cut(F.col(body).cast("string"))).toDF(*docs.columns)
