"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (lengths 6 to 8 in bytes, with marked ends),
hashed to rows of one embedding table. The vectors of a bag are averaged, and so are the
bags of all words of a text; the average goes through a linear softmax of two classes,
and table and softmax are trained together on whole labelled texts. A word that was
never seen is scored by the n-grams that it shares with words that were, so endings and
misspellings of learned words score like these.

Two things keep harmless texts apart. An n-gram gets a vector only if its words stand in
clearly more texts of one class than chance allows (``LEAST`` standard deviations); all
others, and all that training never saw, have the zero vector and count for nothing but
the length of the text. And n-grams are long enough that unrelated words seldom share
them: words of less than four letters have none. Texts of fewer than ``FLOOR`` words are
averaged as if they had so many. In the second half of the steps a text counts by the
chance the model gives to its label, to the power ``TRUST``, so that wrong labels lose
their pull.

Training takes at most ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other labelled texts,
those with the least hash of their id, whole and one for each id (the least, where rows
of one id differ); scoring covers every text whole. For scoring the table folds into one
number for each n-gram.

Cases: null and empty texts, and texts without a letter or digit, get the score of
no word at all; rows of one id have the greater label; null labels and ids are not
learned from; without both classes among the labels every score is the smoothed
share of toxic labels; an empty table stays empty; other columns pass through and one
named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_columns import with_columns
from .words import LETTERS, Words, _byte_codes, buffers, chunks, windows

#: Bounds of the labelled sample, and the sizes of n-grams, table and vectors.
MAX_TOXIC, MAX_OTHER = 1000, 2000
SIZES, TABLE_BITS, WIDTH = (6, 7, 8), 21, 8
#: Steps of training, their rate, what a step takes off the table, and the scale of averages, which are small.
STEPS, RATE, DECAY, SCALE = 150, 0.3, 0.01, 100.0
#: Standard deviations from chance that an n-gram is learned from, words that a text counts for at least, and the power of trust.
LEAST, FLOOR, TRUST = 4.5, 20, 0.5


def bags(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, table row) of every n-gram of the words ``data[start:end]``, A-Z lowered."""
    size = end - start + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(word)) - np.repeat(first, size)
    code = _byte_codes(True)
    symbols = np.empty(len(word), np.uint64)
    inner = (within > 0) & (within < np.repeat(size, size) - 1)
    symbols[inner] = code[data[(np.repeat(start, size) + within - 1)[inner]]]
    symbols[within == 0] = code[1]
    symbols[first + size - 1] = code[2]
    owners, rows = [], []
    for n in SIZES:
        hash_ = windows(symbols, n, n)
        fits = (within + n <= np.repeat(size, size))[: len(hash_)]
        owners.append(word[: len(hash_)][fits])
        rows.append((hash_[fits] >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(rows)


def text_words(column: pa.Array):
    """For chunks of a column: first row, past-the-last row, distinct words' bags, and each text's words by number."""
    off, data = buffers(column)
    for a, b in chunks(off):
        words = Words(off, data, a, b, lower=True, inside=LETTERS)
        hash_, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        yield a, b, hash_, bags(words.data, words.start[one], words.end[one]), words.first, which


def _per_text(first: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(first), FLOOR)


@dataclass
class Model:
    """``weight`` of each learned n-gram (``rows`` of the table) and ``bias``: log odds of a text are the bias and its words' mean weight."""

    rows: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << TABLE_BITS, np.float32)
        out[self.rows] = self.weight
        return out

    def scores(self, column: pa.Array, dense: np.ndarray | None = None) -> np.ndarray:
        dense, out = self.dense() if dense is None else dense, np.empty(len(column))
        for a, b, hash_, (owner, row), first, which in text_words(column):
            count = np.maximum(np.bincount(owner, minlength=len(hash_)), 1)
            value = np.bincount(owner, dense[row], len(hash_)) / count
            text = np.repeat(np.arange(b - a), np.diff(first))
            out[a:b] = np.bincount(text, value[which], b - a) / _per_text(first)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def _bags_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' bags as (word, table row) in order of words, and the words of all texts with where each text's begin."""
    known: dict[int, int] = {}
    owners, rows, words, sizes = [], [], [], []
    for _, _, hash_, (owner, row), first, which in text_words(texts):
        before = len(known)
        number = np.array([known.setdefault(h, len(known)) for h in hash_.tolist()], np.int64)
        take = (number >= before)[owner]
        owners.append(number[owner[take]].astype(np.int32))
        rows.append(row[take])
        words.append(number[which].astype(np.int32))
        sizes.append(np.diff(first))
    owner, row = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return owner[order], row[order], np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Model:
    """Train on whole texts and their labels (0 or 1)."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    prior = float(np.log(share / (1 - share)))
    nothing = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    if not 0 < toxic.sum() < len(toxic):
        return nothing
    owner, row, word, first = _bags_of(texts)
    if not len(row):
        return nothing
    n_words = int(max(word.max(), owner.max())) + 1
    pair, times = np.unique(np.repeat(np.arange(len(toxic)), np.diff(first)) * n_words + word, return_counts=True)
    text, word = pair // n_words, pair % n_words
    del pair

    # Texts that hold an n-gram's words, and how many of them chance would have be toxic.
    shown, bad = np.bincount(word, minlength=n_words), np.bincount(word, toxic[text], n_words)
    size = np.maximum(np.bincount(owner, minlength=n_words), 1)
    held = np.bincount(row, shown[owner], 1 << TABLE_BITS)
    off = np.bincount(row, (bad - share * shown)[owner], 1 << TABLE_BITS)
    clear = np.abs(off) > LEAST * np.sqrt(share * (1 - share) * np.maximum(held, 1))
    taken = clear[row]
    del held, off
    if not taken.any():
        return nothing
    owner = owner[taken]
    rows, gram = np.unique(row[taken], return_inverse=True)

    # The average of a text as a sparse row over learned n-grams.
    bag = np.searchsorted(owner, np.arange(n_words + 1))
    many = np.diff(bag)[word]
    of = np.repeat(np.arange(len(word)), many)
    at = np.repeat(bag[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    cell, which = np.unique(text[of] * len(rows) + gram[at], return_inverse=True)
    part = np.bincount(which, (times / _per_text(first)[text] / size[word])[of]) * SCALE
    text, gram = cell // len(rows), cell % len(rows)
    del of, at, which, cell

    rng = np.random.default_rng(seed)
    table = np.zeros((len(rows), WIDTH))
    soft = rng.normal(0, WIDTH**-0.5, (WIDTH, 2))
    bias = np.array([0.0, prior])
    truth = np.stack([1 - toxic, toxic], 1).astype(float)
    past = [np.full_like(x, 1e-8) for x in (table, soft, bias)]
    for step in range(STEPS):
        mean = np.stack([np.bincount(text, part * table[gram, d], len(toxic)) for d in range(WIDTH)], 1)
        logit = mean @ soft + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - truth) / len(toxic)
        if step >= STEPS // 2:
            error *= (p * truth).sum(1, keepdims=True) ** TRUST
        back = error @ soft.T
        grow = np.stack([np.bincount(gram, part * back[text, d], len(rows)) for d in range(WIDTH)], 1)
        for x, g, square in zip((table, soft, bias), (grow, mean.T @ error, error.sum(0)), past, strict=True):
            square += g * g
            x -= RATE * g / np.sqrt(square)
        table *= 1 - DECAY
    weight = table @ (soft[:, 1] - soft[:, 0]) * SCALE
    return Model(rows.astype(np.int64), weight.astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> pa.Table:
    """The bounded sample: text and label of the labelled ids with the least hash, one text for each."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).alias("__label"))
    order = (F.xxhash64(id), F.col(id))
    chosen = known.where("__label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("__label = 0").orderBy(*order).limit(MAX_OTHER))
    one = docs.select(id, text).join(F.broadcast(chosen), id).groupBy(id).agg(F.min(text).alias(text), F.max("__label").cast("int").alias("__label"))
    return one.select(text, "__label", id).toArrow()


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = training_rows(docs, labels, id, text, label).sort_by([(id, "ascending"), (text, "ascending")])
    return fit(rows[text].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["__label"].to_numpy().astype(np.int64))


def score(df: DataFrame, model: Model, text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``score``, the chance from 0 to 1 that the text is toxic; columns ``without`` are left out."""
    built: list[np.ndarray] = []  # the table, once in each task

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not built:
            built.append(model.dense())
        return {"score": pa.array(model.scores(batch.column(batch.schema.get_field_index(text)), built[0]))}

    return with_columns(df, "score double", run, without)
