"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; each
filter's largest value in the window (max pooling, rectified) feeds a softmax
over the languages.  The first layer takes one-hot bytes, so a filter of width
w is w tables of 256 values and a convolution is a sum of table look-ups.  It is
trained in numpy (Adam, cross-entropy) on the driver from a bounded sample of
labelled rows, and applied by tasks to all windows of every whole text.  A
document's probabilities are the mean over its windows, weighted by their bytes.

A null text, or one without a letter, is ``und`` with score 0; so is every text
if no row is labelled.  Rows with a null ``doc_id`` count as held in.  Repeated
rows are judged each.  An empty table gives an empty result.  Only ``doc_id``,
``text`` and, for training, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices

UNKNOWN = "und"
WIDTHS = (2, 3, 4, 5)
#: Windows that are scored at a time; bounds the arrays.
BATCH = 256
#: Windows whose filter sums are made together; few, so that these stay in a core's cache.
TOGETHER = 32


def byte_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of ``length`` bytes, zeros at the end), the text of each, and its bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // length)
    rows = np.zeros((int(counts.sum()), length), np.uint8)
    flat, first = rows.reshape(-1), np.cumsum(counts) - counts
    for text, at in zip(texts, first * length):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    held = np.minimum(length, sizes[owner] - (np.arange(len(owner)) - first[owner]) * length)
    return rows, owner, held


@dataclass
class ByteNetwork:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: width x 256 x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    length: int

    @classmethod
    def new(cls, languages: list[str], length: int, per_width: int, seed: int) -> ByteNetwork:
        draw = np.random.default_rng(seed)
        total = per_width * len(WIDTHS)
        return cls(languages, [draw.normal(0, 0.3, (w, 256, per_width)).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32), draw.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), length)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Largest value of each filter in each window, and the place of it if ``where``."""
        parts = [self._pooled(rows[k : k + TOGETHER], where) for k in range(0, max(1, len(rows)), TOGETHER)]
        places = [np.concatenate(at) for at in zip(*(at for _, at in parts))]
        return np.concatenate([top for top, _ in parts]) + self.bias, places

    def _pooled(self, rows: np.ndarray, where: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        # Places first, windows second: a filter's next byte is a slice, and the largest value is taken over whole rows of windows.
        at_place = rows.T.astype(np.intp, order="C")
        for kernel in self.filters:
            width, valid = len(kernel), len(at_place) - len(kernel) + 1
            total = kernel[0].take(at_place[:valid], axis=0)
            for j in range(1, width):
                total += kernel[j].take(at_place[j : j + valid], axis=0)
            if where:
                at = total.argmax(0)
                places.append(at)
                tops.append(np.take_along_axis(total, at[None], 0)[0])
            else:
                tops.append(total.max(0))
        return np.concatenate(tops, 1), places

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        found = []
        for k in range(0, len(rows), BATCH):
            logits = np.maximum(self.pooled(rows[k : k + BATCH])[0], 0) @ self.out + self.out_bias
            logits = np.exp(logits - logits.max(1, keepdims=True))
            found.append(logits / logits.sum(1, keepdims=True))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)), np.float32)

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int, seed: int, rate: float = 0.01, size: int = 64) -> None:
        params = [*self.filters, self.bias, self.out, self.out_bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        draw, step = np.random.default_rng(seed), 0
        counts = np.bincount(labels, minlength=len(self.languages))
        balance = (len(labels) / np.maximum(counts, 1) / len(self.languages)).astype(np.float32)
        for _ in range(epochs):
            for batch in np.array_split(draw.permutation(len(rows)), max(1, len(rows) // size)):
                x, y = rows[batch], labels[batch]
                top, places = self.pooled(x, where=True)
                hidden = np.maximum(top, 0)
                logits = hidden @ self.out + self.out_bias
                grad = np.exp(logits - logits.max(1, keepdims=True))
                grad /= grad.sum(1, keepdims=True)
                grad[np.arange(len(y)), y] -= 1
                grad *= balance[y][:, None] / len(y)
                back = (grad @ self.out.T) * (top > 0)
                grads, lane, line = [], 0, np.arange(len(y))[:, None]
                for kernel, at in zip(self.filters, places):
                    n, own = kernel.shape[2], np.zeros_like(kernel)
                    for j in range(len(kernel)):
                        np.add.at(own[j], (x[line, at + j], np.arange(n)[None, :]), back[:, lane : lane + n])
                    grads.append(own)
                    lane += n
                step += 1
                for p, g, m, v in zip(params, [*grads, back.sum(0), hidden.T @ grad, grad.sum(0)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each non-empty text, and its probability."""
        rows, owner, held = byte_windows(texts, self.length)
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, self.probabilities(rows) * held[:, None])
        total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
        best = total.argmax(1)
        return best, total[np.arange(len(best)), best]


def fold_of(doc_id, folds: int = 4):
    """crc32 of the number as text, modulo ``folds``; a null number counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train_language_network(labelled: DataFrame, per_language: int = 600, windows: int = 3, length: int = 256, per_width: int = 8, epochs: int = 8, seed: int = 7) -> ByteNetwork | None:
    """Learn from columns doc_id, text and lang.

    The sample is bounded: about ``per_language`` documents of each language,
    drawn by a hash of ``doc_id``, and ``windows`` windows of ``length``
    characters of each.  None if nothing is labelled.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    if not counts:
        return None
    room, draw = 1 << 30, F.xxhash64("doc_id")
    chosen = F.lit(False)
    for lang, n in counts:
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(draw, F.lit(room)) < int(room * min(1.0, per_language / n))))
    cut = [F.substring("text", F.greatest(F.lit(1), F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - length)) + 1).cast("int"), F.lit(length)) for k in range(windows)]
    drawn = known.where(chosen).select("doc_id", "lang", F.array(*cut).alias("cuts")).limit(per_language * len(counts) * 2).collect()
    drawn = sorted(drawn, key=lambda r: (r.doc_id is not None, r.doc_id, r.cuts))
    names = [lang for lang, _ in counts]
    texts = [(c.encode()[:length], names.index(r.lang)) for r in drawn for c in r.cuts if c]
    network = ByteNetwork.new(names, length, per_width, seed)
    rows, owner, _ = byte_windows([t for t, _ in texts], length)
    network.train(rows, np.array([y for _, y in texts])[owner], epochs, seed)
    return network


def identify_languages(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column("text")
            lettered = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False))
            names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
            if network and len(lettered):
                best, score = network.judge(texts.cast(pa.binary()).take(pa.array(lettered)).to_pylist())
                names[lettered] = np.array(network.languages, object)[best]
                scores[lettered] = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, held_out_fold: int = 2, **training) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from all folds but ``held_out_fold``."""
    labelled = docs.select(docs["doc_id"], docs["text"], docs["lang"]).where(fold_of(docs["doc_id"]) != held_out_fold)
    judged = identify_languages(docs, train_language_network(labelled, **training))
    return judged.select("doc_id", (fold_of(F.col("doc_id")) == held_out_fold).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3, **training) -> DataFrame:
    """Rows of ``docs`` whose language is told with a score of ``least`` or more.

    The network is applied in the same pass that copies the rows, so nothing is
    joined and repeated or null numbers do no harm.
    """
    network = train_language_network(docs.select("doc_id", "text", "lang").where(fold_of(docs["doc_id"]) != 2), **training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column("text")
            keep = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).copy()
            lettered = np.flatnonzero(keep)
            if network and len(lettered):
                keep[lettered] = network.judge(texts.cast(pa.binary()).take(pa.array(lettered)).to_pylist())[1] >= least
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
