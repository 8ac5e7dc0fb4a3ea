"""Benchmark decontamination by a prefix-filtered set join.

The shingles of a benchmark item are its windows of consecutive words.  The words of a window are ordered by rarity,
which is their document frequency over the whole corpus.  As only full containment counts, the necessary prefix of a
window is its rarest word alone: a document that contains the window contains that word.  The join therefore looks up
the document's words among the prefix words, applies the positional bound (where the window would start) and the length
bound (that it ends inside the document), and verifies the remaining words one by one.

Benchmark windows are read in blocks of at most ``block_bytes``; each block is broadcast, so nothing that is broadcast
grows with the data, and further blocks are applied to the same rows in the same pass without a shuffle.

Edge cases: null or empty texts have no words; an item shorter than the window is one window; the windows of an item with
a null id are hit like others, but it has no id to be listed or counted by; a repeated item counts once; repeated documents each get a row; empty tables work; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ._common import alnum_words, by_place, by_slices, place, rows_by_arrow, small_batches

Window = tuple[int, list[bytes], str | None]
_STATE = "doc_id long, text string, marks binary, items array<string>"


def item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[str, list[list[bytes]]]]]:
    """(item id, its windows) of all items in blocks of bounded size; only one block is in the driver at a time."""
    block, used = [], 0
    for item, text in items.toLocalIterator():
        words = alnum_words(text)
        if not words:
            continue
        windows = [words[k : k + window] for k in range(max(1, len(words) - window + 1))]
        block.append((item, windows))
        used += 150 * len(windows) + 60 * len(words)
        if used >= block_bytes:
            yield block
            block, used = [], 0
    if block:
        yield block


def document_frequency(docs: DataFrame, words: set[bytes]) -> Counter:
    """In how many documents each of the given words occurs; counted over every row, summed before the shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in small_batches(batch):
                for text in part.column(0).to_pylist():
                    total.update(known.value.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r.word): r.n for r in counted.collect()})


def prefix_index(block: list[tuple[str, list[list[bytes]]]], frequency: Counter) -> dict[bytes, list[Window]]:
    """Rarest word of a window -> (its place in the window, the window, item)."""
    index: dict[bytes, list[Window]] = defaultdict(list)
    for item, windows in block:
        for words in {tuple(w) for w in windows}:
            place = min(range(len(words)), key=lambda k: (frequency[words[k]], words[k], k))
            index[words[place]].append((place, list(words), item))
    return dict(index)


def mark(words: list[bytes], index: dict[bytes, list[Window]], marks: bytearray, found: set[str | None]) -> None:
    """Mark the words inside verified windows and note their items."""
    n = len(words)
    for at in [k for k, w in enumerate(words) if w in index]:
        for place, window, item in index[words[at]]:
            start = at - place
            end = start + len(window)
            if start >= 0 and end <= n and words[start:end] == window:
                marks[start:end] = b"\x01" * (end - start)
                found.add(item)


def spans_of(marks: bytes) -> list[dict]:
    spans, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        spans.append({"start": at, "end": end})
        at = marks.find(1, end)
    return spans


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20
) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids with a window in the document, sorted) and spans (hit word ranges, end exclusive)."""
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))
    wanted = by_place(items).select(F.col(place(items, item_id)).cast("string"), F.col(place(items, item_text)).cast("string"))
    context = docs.sparkSession.sparkContext
    state = rows.select("doc_id", "text", F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    for block in item_blocks(wanted, window, block_bytes):
        frequency = document_frequency(rows, {w for _, windows in block for words in windows for w in words})
        held = context.broadcast(prefix_index(block, frequency))

        def search(doc_id: list, text: list, marks: list, items: list, held=held) -> dict:
            out_marks, out_items = [], []
            for t, m, i in zip(text, marks, items, strict=True):
                words, found = alnum_words(t), set(i or ())
                own = bytearray(m) if m else bytearray(len(words))
                mark(words, held.value, own, found)
                out_marks.append(bytes(own) if m or found else None)
                out_items.append(sorted(x for x in found if x is not None) or None)
            return {"doc_id": doc_id, "text": text, "marks": out_marks, "items": out_items}

        state = rows_by_arrow(state, _STATE, search)

    def finish(doc_id: list, text: list, marks: list, items: list) -> dict:
        return {
            "doc_id": doc_id,
            "n_words": [len(alnum_words(t)) for t in text],
            "n_hit": [m.count(1) if m else 0 for m in marks],
            "items": [i or [] for i in items],
            "spans": [spans_of(m) if m else [] for m in marks],
        }

    return rows_by_arrow(state, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>", finish)


def _clean(held: Broadcast):  # noqa: ANN202
    @arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        def free(text: str) -> bool:
            words, found = alnum_words(text), set()
            mark(words, held.value, bytearray(len(words)), found)
            return not found

        return pa.array(by_slices(column, lambda part: [free(t) for t in part]), pa.bool_())

    return clean


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows, columns as they were, that hold no window of any item."""
    wanted = by_place(items).select(F.col(place(items, item_id)).cast("string"), F.col(place(items, item_text)).cast("string"))
    kept = by_place(docs)
    body = F.col(place(docs, text)).cast("string")
    texts = kept.select(body.alias("text"))
    for block in item_blocks(wanted, window, block_bytes):
        frequency = document_frequency(texts, {w for _, windows in block for words in windows for w in words})
        clean = _clean(docs.sparkSession.sparkContext.broadcast(prefix_index(block, frequency)))
        kept = kept.where(clean(F.coalesce(body, F.lit(""))))
    return kept.toDF(*docs.columns)
