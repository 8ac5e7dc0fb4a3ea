"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, all words of the corpus.  The background model counts all documents, the target
model all documents that a label marks as wanted; they are matched in size by scaling the background's counts to the
target's total, and a document's own occurrences are left out of what it is scored with.  A token's loss under a model is
-ln of its interpolated probability, and a document's score is the mean over its tokens of background loss less target
loss: high means like the target.

Every word, context and pair has a count of its own, under a code whose width grows with the text, so that two share one
with a chance below 2**-16 at every size.  Documents are read in batches, kept as numbers of words.  A batch asks for the
counts of its distinct codes: it sends them, with its own counts, to the parts of the code space, one compressed block for
each part.  A part adds up all batches' counts and answers each batch in the order of its codes.  So both exchanges carry
a code once for each batch that has it, nothing is broadcast or gathered in the driver but three totals, no frequent word
makes a task larger, as it comes once from each batch, and what is counted grows with the input.  The number of parts
follows the bytes of text, so that a part's codes fit a task.

Edge cases: null and empty texts have no tokens and score null; repeated rows are counted and scored each; a document
with several labels is wanted if one says so; rows without a doc_id are never wanted; without wanted documents both
models are uniform and scores are 0; empty tables work; other columns are ignored, also if their names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._common import alnum_words, by_place, place, settle, small_batches

#: Text of a batch, and text whose codes make up a part, in bytes.
BATCH_BYTES, PART_BYTES = 8 << 20, 24 << 20
_CODEC = pa.Codec("zstd", compression_level=3)
_START = np.uint64(0x9E3779B97F4A7C15)
_SPREAD, _TURN = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_PAIR, _WORD, _CONTEXT = (np.uint64(k) for k in range(3))


def mixed(x: np.ndarray, kind: np.uint64, bits: int) -> np.ndarray:
    """Codes of so many bits, of which the last two tell what is counted."""
    x = (x ^ (x >> np.uint64(31))) * _TURN
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(66 - bits) << np.uint64(2)) | kind


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane, so that small numbers and small steps take little room."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()
        body = _CODEC.compress(planes, asbytes=True) if planes else b""
        out += [np.array([ord(x.dtype.char), len(x), len(body)], np.int64).tobytes(), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = np.frombuffer(blob, np.int64, 3, at).tolist()
        dtype = np.dtype(chr(kind))
        planes = _CODEC.decompress(blob[at + 24 : at + 24 + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += 24 + size
    return out


class Batch:
    """Documents of a batch as numbers: words are numbered from 1 in the batch, 0 is the start of a text."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, vocabulary: np.ndarray, bits: int):
        self.lengths, self.words, self.vocabulary = lengths, words, vocabulary
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        before = np.concatenate([[0], words[:-1]]).astype(np.int64)
        before[starts[lengths > 0]] = 0
        self.before, self.now = before, words.astype(np.int64)
        size = len(vocabulary) + 1
        pairs, self.pair = np.unique(before * size + self.now, return_inverse=True)
        named = np.concatenate([[_START], vocabulary])
        codes = np.concatenate([mixed(named[pairs // size] * _SPREAD + named[pairs % size], _PAIR, bits), mixed(vocabulary * _SPREAD, _WORD, bits), mixed(named * _SPREAD, _CONTEXT, bits)])
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.n_pairs = len(pairs)

    @staticmethod
    def read(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the texts, their words as numbers, and the code of each number; frequent words have small numbers."""
        local: dict[bytes, int] = {}
        numbers, lengths = [], []
        for text in texts:
            words = alnum_words(text)
            numbers.append(np.fromiter((local.setdefault(w, len(local) + 1) for w in words), np.uint32, len(words)))
            lengths.append(len(words))
        vocabulary = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - bits) for w in local), np.uint64, len(local))
        words = np.concatenate([*numbers, np.zeros(0, np.uint32)])
        order = np.argsort(-np.bincount(words, minlength=len(local) + 1)[1:], kind="stable")
        rank = np.empty(len(local), np.uint32)
        rank[order] = np.arange(1, len(local) + 1, dtype=np.uint32)
        return np.array(lengths, np.uint32), rank[words.astype(np.int64) - 1], vocabulary[order]

    def flags(self, wanted: list[int]) -> np.ndarray:
        """Whether each document is wanted, from the places of those that are."""
        out = np.zeros(len(self.lengths), bool)
        out[wanted] = True
        return out

    def own_counts(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each code occurs in all documents of the batch, and in the wanted ones; in the order of the codes."""
        out = []
        for chosen in (slice(None), np.repeat(wanted, self.lengths)):
            pair = np.bincount(self.pair[chosen], minlength=self.n_pairs)
            word = np.bincount(self.now[chosen], minlength=len(self.vocabulary) + 1)[1:]
            context = np.bincount(self.before[chosen], minlength=len(self.vocabulary) + 1)
            out.append(np.concatenate([pair, word, context])[self.order].astype(np.uint32))
        return out[0], out[1]

    def losses(self, wanted: np.ndarray, b: np.ndarray, t: np.ndarray, all_b: float, all_t: float, vocabulary: float, strength: float) -> list[tuple[int, float | None, float | None]]:
        """(n_tokens, target loss, background loss) of each document, from the corpus counts of the codes."""
        back, back_t = np.empty(len(b)), np.empty(len(t))
        back[self.order], back_t[self.order] = b, t
        cuts = [self.n_pairs, self.n_pairs + len(self.vocabulary)]
        pair_b, word_b, context_b = np.split(back, cuts)
        pair_t, word_t, context_t = np.split(back_t, cuts)
        out, at = [], 0
        for flag, n in zip(wanted.tolist(), self.lengths.tolist(), strict=True):
            if not n:
                out.append((0, None, None))
                continue
            span = slice(at, at + n)
            at += n
            rest_b, rest_t = all_b - n, all_t - flag * n
            scale = rest_t / rest_b if rest_b > 0 else 0.0
            sums: dict[str, list[np.ndarray]] = {"b": [], "t": []}
            for place, total_b, total_t in ((self.pair[span], pair_b, pair_t), (self.now[span] - 1, word_b, word_t), (self.before[span], context_b, context_t)):
                _, inverse, counts = np.unique(place, return_inverse=True, return_counts=True)
                own = counts[inverse]
                sums["b"].append((total_b[place] - own) * scale)
                sums["t"].append(total_t[place] - flag * own)
            mean = {}
            for side, (pair, word, context) in sums.items():
                chance = (word + 1) / (rest_t + vocabulary)
                mean[side] = float(-np.log((pair + strength * chance) / (context + strength)).mean())
            out.append((n, mean["t"], mean["b"]))
        return out


def batches(rows: DataFrame, bits: int) -> DataFrame:
    """(batch, ids, blob, n): documents of (doc_id, text) as numbers of words, some megabytes of text at a time."""

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids: list = []
        texts: list = []
        used = 0

        def flush() -> pa.RecordBatch:
            read = Batch.read(texts, bits)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(*read)], pa.binary()), pa.array([int(read[0].sum())], pa.int64())], ["batch", "ids", "blob", "n"])

        for batch in incoming:
            for few in small_batches(batch, 100):
                ids += few.column(0).to_pylist()
                texts += few.column(1).to_pylist()
                used += few.nbytes
                if used >= BATCH_BYTES:
                    yield flush()
                    ids, texts, used, number = [], [], 0, number + 1
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    return rows.mapInArrow(run, "batch long, ids array<long>, blob binary, n long")


def of_batch(batch: pa.Table, bits: int) -> tuple[Batch, list, np.ndarray]:
    """The batch among the rows of its group, its doc_ids, and which documents are wanted."""
    blobs, ids, wanted, part = (batch.column(c).to_pylist() for c in ("blob", "ids", "wanted", "part"))
    at = part.index(-1)
    own = Batch(*unpack(blobs[at]), bits)
    return own, ids[at], own.flags(next((w for w in wanted if w is not None), []))


def questions(told: DataFrame, parts: int, bits: int) -> DataFrame:
    """(batch, part, blob, n): the codes of each batch with its own counts, a row for each part; n has its wanted tokens once."""

    def ask(batch: pa.Table) -> pa.Table:
        own, _, wanted = of_batch(batch, bits)
        b, t = own.own_counts(wanted)
        part = ((own.codes >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(min(bits, 32))).astype(np.int64)  # ascending with the codes
        edges = np.flatnonzero(np.diff(part)) + 1
        ends = list(zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True))
        blobs = [pack(np.diff(own.codes[lo:hi], prepend=np.uint64(0)), b[lo:hi], t[lo:hi]) for lo, hi in ends]
        n = [int(own.lengths[wanted].sum()), *[0] * (len(ends) - 1)]
        return pa.table({"batch": pa.array([batch.column("batch")[0].as_py()] * len(ends), pa.int64()), "part": pa.array(part[[lo for lo, _ in ends]], pa.int32()), "blob": pa.array(blobs, pa.binary()), "n": pa.array(n, pa.int64())})

    return told.groupBy("batch").applyInArrow(ask, "batch long, part int, blob binary, n long")


def answers(asked: DataFrame) -> DataFrame:
    """(batch, part, blob): the corpus counts of what each batch asked; in a row without a batch, the words of the part and the wanted tokens it was told of."""

    def add_up(part: pa.Table) -> pa.Table:
        names, number = part.column("batch").to_pylist(), part.column("part")[0].as_py()
        sent = [unpack(x) for x in part.column("blob").to_pylist()]
        codes, place = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in sent]), return_inverse=True)
        totals = [np.bincount(place, np.concatenate([x[k] for x in sent]), len(codes)).astype(np.uint64) for k in (1, 2)]
        blobs, at = [], 0
        for x in sent:
            blobs.append(pack(*[total[place[at : at + len(x[0])]] for total in totals]))
            at += len(x[0])
        some = len(names)
        last = {"words": int(np.count_nonzero((codes & np.uint64(3)) == _WORD)), "n": sum(part.column("n").to_pylist())}
        return pa.table({"batch": pa.array([*names, None], pa.int64()), "part": pa.array([number] * (some + 1), pa.int32()), "blob": pa.array([*blobs, None], pa.binary()), **{k: pa.array([0] * some + [v], pa.int64()) for k, v in last.items()}})

    return asked.groupBy("part").applyInArrow(add_up, "batch long, part int, blob binary, words long, n long")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", strength: float = 8.0) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row."""
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, parts = min(62, max(48, size.bit_length() + 18)), max(1, -(-size // PART_BYTES))
    wanted = by_place(labels).select(F.col(place(labels, doc_id)).cast("long").alias("id"), F.col(place(labels, label)).alias("y")).where("y = 1 and id is not null").select("id").distinct()
    sent = settle(batches(rows, bits))
    told = sent.select("batch", F.lit(-1).alias("part"), "blob", "ids", F.lit(None).cast("array<int>").alias("wanted"))
    each = sent.select("batch", F.posexplode("ids").alias("at", "id")).join(wanted.hint("merge"), "id")  # labels grow with the corpus: never broadcast
    marked = each.groupBy("batch").agg(F.collect_list("at").alias("wanted"))  # at most the documents of a batch
    marked = settle(marked.select("batch", F.lit(-2).alias("part"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("array<long>").alias("ids"), "wanted"))
    told = told.unionByName(marked)
    said = settle(answers(questions(told, parts, bits)))
    all_b = float(sent.agg(F.sum("n")).first()[0] or 0)
    vocabulary, all_t = (float(x or 0) for x in said.agg(F.sum("words"), F.sum("n")).first())

    def score(batch: pa.Table) -> pa.Table:
        own, ids, flags = of_batch(batch, bits)
        part, blobs = batch.column("part").to_numpy(), batch.column("blob").to_pylist()
        counts = [unpack(blobs[k]) for k in np.argsort(part, kind="stable").tolist() if part[k] >= 0]
        b, t = (np.concatenate([*[c[k] for c in counts], np.zeros(0, np.uint64)]).astype(float) for k in (0, 1))
        found = own.losses(flags, b, t, all_b, all_t, max(1.0, vocabulary), strength)
        n, target, background = ([x[k] for x in found] for k in range(3))
        gain = [None if x is None else y - x for x, y in zip(target, background, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip((ids, n, target, background, gain), kinds, strict=True)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    none = [F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("wanted")]
    both = told.unionByName(said.where("batch is not null").select("batch", "part", "blob", *none))
    return both.groupBy("batch").applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
