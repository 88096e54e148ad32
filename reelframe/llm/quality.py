"""Operator 7: quality rules and line labelling by a linear-chain conditional random field.

Each line with a word is content or boilerplate.  A linear-chain CRF over a few yes/no features of a
line, and over moves from one line's label to the next, is trained on lines of labelled documents, and
Viterbi decoding labels the lines of every document.  The share of words in content lines decides, at
the share that tells the training documents apart best.  Fixed rules come first: under 50 words, or
over half of the words in repeated three-word windows.

Labels of documents say nothing about single lines, so training lines get theirs in rounds: a line with
a mark of boilerplate (``MARKS``) starts as boilerplate, any other as content, in good and bad documents
alike; after each fit the lines are labelled anew by the best path, in which marks count further (``PRIOR``), that agrees
with the document: at least half of the words of a good one are content, at most half of those of a bad
one.  The field is
fitted on at most ``MAX_TRAINING`` labelled documents of at most ``MAX_LINES`` lines, chosen by a hash of
``doc_id``; of those that pass the fixed rules the deciding share is learnt (of equal ones the nearest to
a half).

Null text has no words and fails the rules.  Rows are judged each for itself.  Without usable labels (no
table rows, or one class only) all lines count as content and only the fixed rules decide.  Labels that
are null, or contradict each other for one document, are ignored.  Empty tables give no rows; extra
columns stay in :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.words import NOT_SPACE, chunks, find, windows, word_hashes

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled documents that the field is trained on, and lines of each, at most.
MAX_TRAINING, MAX_LINES = 2000, 1000
ROUNDS, STEPS, RATE, DECAY, PRIOR = 3, 60, 0.3, 1e-4, 6.0

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, LETTER, DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = LETTER[65:91] = LETTER[97:123] = DIGIT[48:58] = True

FEATURES = ["bias", "upper", "symbols", "bars", "exclaims", "digits", "repeated", "short", "long words", "few distinct", "no end"]
#: Features that mark a line as boilerplate before anything is learnt.
MARKS = ["symbols", "bars", "exclaims", "repeated", "few distinct"]


class Lines:
    """Words, lines and counts of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n = n = len(offsets) - 1
        inside = NOT_SPACE[data]
        starts, ends, text = find(data, offsets, inside)
        hashes = word_hashes(data, inside, starts, ends)
        count = lambda flags: np.add.reduceat(np.append(flags, False).astype(np.int64), np.minimum(offsets[:-1], len(flags))) * (np.diff(offsets) > 0) if n else np.zeros(0, np.int64)
        self.n_words = np.bincount(text, minlength=n)
        self.word_chars = count(inside & ((data & 0xC0) != 0x80))
        self.n_symbols = count(SYMBOL[data])
        self.n_repeat_words = self._repeats(hashes, text)
        # Lines with a word: number, text, first word.
        breaks = np.flatnonzero(data == 10)
        number = np.searchsorted(breaks, starts) + text
        new = np.ones(len(starts), bool)
        new[1:] = number[1:] != number[:-1]
        first = np.flatnonzero(new)
        self.text, words = text[first], np.diff(np.append(first, len(starts)))
        self.words = words
        # The whole line, white space included, from the break or text before it to the next.
        begin = np.concatenate([[0], breaks + 1])[np.searchsorted(breaks, starts[first])]
        begin = np.maximum(begin, offsets[self.text])
        stop = np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, starts[first])]
        stop = np.minimum(stop, offsets[self.text + 1])
        self.repeated = self._equal_to_earlier(data, begin, stop)
        self.n_dup_lines = np.bincount(self.text, weights=self.repeated, minlength=n).astype(np.int64)
        over = lambda flags: self._sums(flags, begin, stop)
        letters = over(LETTER[data])
        distinct = self._distinct(hashes, np.repeat(np.arange(len(first)), words), len(first))
        last = data[ends[np.append(first[1:], len(starts))[: len(first)] - 1] - 1] if len(first) else np.zeros(0, np.uint8)
        self.features = np.stack(
            [
                np.ones(len(first)),
                over(UPPER[data]) > 0.6 * np.maximum(letters, 1),
                2 * over(SYMBOL[data]) > words,
                4 * over(data == ord("|")) > words,
                2 * over(data == ord("!")) > words,
                over(DIGIT[data]) > 0.3 * np.maximum(stop - begin, 1),
                self.repeated,
                words <= 3,
                over(inside) > 12 * words,
                2 * distinct < words,
                ~np.isin(last, list(b'.!?:;"')),
            ],
            1,
        ).astype(np.uint8)

    def _repeats(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        at, grams = windows(hashes, text, 3)
        order = np.lexsort((grams, text[at]))
        g, t = grams[order], text[at][order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
        hit = at[order[same[:-1] | same[1:]]]
        covered = np.zeros(len(hashes) + 3, bool)
        for k in range(3):
            covered[hit + k] = True
        return np.bincount(text[covered[: len(text)]], minlength=self.n)

    def _equal_to_earlier(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begin] += 1
        edges[stop] -= 1
        lines = word_hashes(data, np.cumsum(edges[:-1], dtype=np.int8).astype(bool), begin, stop)
        order = np.lexsort((np.arange(len(lines)), lines, self.text))
        found = np.zeros(len(lines), bool)
        found[order[1:]] = (lines[order[1:]] == lines[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])
        return found

    @staticmethod
    def _sums(flags: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[stop] - total[begin]

    @staticmethod
    def _distinct(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((hashes, line))
        h, owner = hashes[order], line[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return np.bincount(owner[new], minlength=n)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


def padded(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(f) for f in features])
    grid = np.zeros((len(features), int(sizes.max(initial=1)), len(FEATURES)))
    for k, f in enumerate(features):
        grid[k, : len(f)] = f
    return grid, sizes


def best_labels(scores: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Viterbi over the lines of many documents at once; ``first`` marks each document's first line.

    Best scores up to each line are a prefix scan of (max, +) products of 2 x 2 steps, and the path back
    is one of functions of a label; both by doubling, so no loop runs over lines.  Of equal paths
    the one with content.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    steps = scores[:, None, :] + move
    steps[first] = scores[first][:, None, :]
    closed, reach = first.copy(), 1
    while len(at := np.flatnonzero(~closed)):
        joined = (steps[at - reach][:, :, :, None] + steps[at][:, None, :, :]).max(2)
        closed[at], steps[at] = closed[at - reach], joined
        reach *= 2
    best = steps[:, 0, :]
    # before[k][y]: the label of line k if line k + 1 has label y; a document's last line has its best.
    came = best[:-1, :, None] + move
    before = np.repeat((best[:, 1] >= best[:, 0])[:, None], 2, 1)
    inner = ~first[1:]
    before[:-1][inner] = (came[:, 1] >= came[:, 0])[inner]
    closed, reach = np.append(first[1:], True), 1
    while len(at := np.flatnonzero(~closed)):
        after = before[at + reach].astype(np.int64)
        closed[at], before[at] = closed[at + reach], np.take_along_axis(before[at], after, 1)
        reach *= 2
    return before[:, 0].astype(np.int64)


def marked(features: np.ndarray) -> np.ndarray:
    """1 for lines with any of ``MARKS``, else 0."""
    return features[:, [FEATURES.index(m) for m in MARKS]].max(1)


class Field:
    """A linear-chain CRF of two labels: 0 boilerplate, 1 content."""

    def __init__(self) -> None:
        self.emit, self.move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
        self.emit[0, 1] = 1.0
        self.share = 0.5

    def marginals(self, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of labels per line, and expected moves per document (forward-backward)."""
        scores = grid @ self.emit
        n, length, _ = scores.shape
        inside = np.arange(length)[None, :] < sizes[:, None]
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for k in range(1, length):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + self.move, 1) + scores[:, k]
        for k in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (scores[:, k + 1] + back[:, k + 1])[:, None, :], 2)
            back[:, k] = np.where(inside[:, k + 1, None], step, 0.0)
        at = np.maximum(sizes - 1, 0)
        total = np.logaddexp.reduce(ahead[np.arange(n), at], 1)
        labels = np.exp(ahead + back - total[:, None, None]) * inside[:, :, None]
        moves = np.zeros((n, 2, 2))
        for k in range(1, length):
            pair = ahead[:, k - 1, :, None] + self.move + (scores[:, k] + back[:, k])[:, None, :] - total[:, None, None]
            moves += np.exp(pair) * inside[:, k, None, None]
        return labels, moves

    def likelihood_steps(self, grid: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the weighted log-likelihood of ``labels`` (documents x lines) by emissions and moves."""
        inside = np.arange(grid.shape[1])[None, :] < sizes[:, None]
        truth = np.stack([(labels == 0) & inside, (labels == 1) & inside], 2).astype(float)
        seen = np.einsum("nka,nkb->nab", truth[:, :-1], truth[:, 1:])
        expected, moves = self.marginals(grid, sizes)
        return np.einsum("nlf,nly->fy", grid * weight[:, None, None], truth - expected, optimize=True), np.einsum("n,nab->ab", weight, seen - moves)

    def agreeing(self, features: np.ndarray, words: np.ndarray, first: np.ndarray, quality: np.ndarray) -> np.ndarray:
        """Labels of all lines by the best path whose content share agrees with each document's quality.

        The least bias towards content (or away from it), out of a doubling series, that brings the share
        to the right side of a half.
        """
        owner = np.cumsum(first) - 1
        total = np.maximum(np.bincount(owner, weights=words), 1)
        scores = features @ self.emit
        scores[:, 0] += PRIOR * marked(features)
        bias, labels = np.zeros(len(total)), np.zeros(len(words), np.int64)
        for extra in (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
            now = scores.copy()
            now[:, 1] += bias[owner]
            labels = best_labels(now, self.move, first)
            share = np.bincount(owner, weights=labels * words) / total
            wrong = np.where(quality == 1, share < 0.5, share > 0.5)
            bias = np.where(wrong, np.where(quality == 1, 1, -1) * max(0.5, 2 * extra), bias)
        return labels

    def fit(self, features: list[np.ndarray], words: list[np.ndarray], quality: np.ndarray, decided: np.ndarray | None = None) -> Field:
        """Gradient ascent on the likelihood of line labels that agree with the documents' (see above).

        Both classes of documents weigh the same.  Documents of about as many lines are computed
        together, so that little is padding.  The share that decides is chosen by the documents that the
        fixed rules leave to it (``decided``).
        """
        share = np.where(quality == 1, 0.5 / max(1, (quality == 1).sum()), 0.5 / max(1, (quality == 0).sum()))
        lengths = np.array([len(f) for f in features])
        begins = np.cumsum(lengths) - lengths
        flat, flat_words = np.concatenate(features), np.concatenate(words)
        first = np.zeros(len(flat), bool)
        first[begins] = True
        labels = 1 - marked(flat).astype(np.int64)
        width = np.array([len(f).bit_length() for f in features])
        groups = [np.flatnonzero(width == w) for w in np.unique(width)]
        grids = [padded([features[k] for k in own]) for own in groups]
        for turn in range(ROUNDS):
            if turn:
                labels = self.agreeing(flat, flat_words, first, quality)
            truths = []
            for own, (grid, _) in zip(groups, grids, strict=True):
                truth = np.zeros(grid.shape[:2], np.int64)
                for row, k in enumerate(own):
                    truth[row, : lengths[k]] = labels[begins[k] : begins[k] + lengths[k]]
                truths.append(truth)
            squares = [np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)]
            for _ in range(STEPS):
                steps = [-DECAY * self.emit, -DECAY * self.move]
                for own, (grid, sizes), truth in zip(groups, grids, truths, strict=True):
                    emit, move = self.likelihood_steps(grid, sizes, truth, share[own] / np.maximum(sizes, 1))
                    steps[0], steps[1] = steps[0] + emit, steps[1] + move
                for value, step, square in zip((self.emit, self.move), steps, squares, strict=True):
                    square += step * step
                    value += RATE * step / np.sqrt(square)
        decoded = best_labels(flat @ self.emit, self.move, first)
        owner = np.cumsum(first) - 1
        shares = np.bincount(owner, weights=decoded * flat_words) / np.maximum(np.bincount(owner, weights=flat_words), 1)
        tries, left = np.linspace(0.05, 0.95, 19), np.ones(len(quality), bool) if decided is None else decided
        rate = lambda right, y: right[left & (quality == y)].mean() if (left & (quality == y)).any() else 1.0
        good = np.array([rate(shares >= t, 1) + rate(shares < t, 0) for t in tries])
        best = np.flatnonzero(good >= good.max() - 1e-12)
        self.share = float(tries[best[np.argmin(np.abs(tries[best] - 0.5))]])
        return self


def featuring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunks(batches):
        lines = Lines(data, offsets)
        bounds = np.searchsorted(lines.text, np.arange(part.num_rows + 1)).tolist()
        some = [k for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if 0 < b - a <= MAX_LINES]
        features = pa.array([lines.features[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary())
        words = pa.array([lines.words[bounds[k] : bounds[k + 1]].astype("<i8").tobytes() for k in some], pa.binary())
        at = pa.array(some, pa.int64())
        failed = pa.array(lines.base_failed()[some])
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("quality").take(at), features, words, failed], ["doc_id", "quality", "features", "words", "failed"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits the field on at most ``MAX_TRAINING`` labelled documents, of which only line features come to the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("most"))
    known = known.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").mapInArrow(featuring, "doc_id long, quality int, features binary, words binary, failed boolean")
    # Rows that repeat a doc_id don't add to the bound: the first by features stands for it.
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("features", "words", "quality", "failed")).alias("r")).select("doc_id", "r.*").toLocalIterator(), key=lambda r: r.doc_id)
    quality = np.array([r.quality for r in rows], np.int64)
    field = Field()
    if len(set(quality.tolist())) < 2:
        return field
    features = [np.frombuffer(r.features, np.uint8).reshape(-1, len(FEATURES)).astype(float) for r in rows]
    return field.fit(features, [np.frombuffer(r.words, "<i8") for r in rows], quality, np.array([not r.failed for r in rows]))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"


def verdicts(field: Field, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, content lines, content share and verdict of each text of a chunk."""
    first = np.ones(len(lines.text), bool)
    first[1:] = lines.text[1:] != lines.text[:-1]
    labels = best_labels(lines.features @ field.emit, field.move, first)
    total = lambda x: np.bincount(lines.text, weights=x, minlength=lines.n).astype(np.int64)
    share = total(labels * lines.words) / np.maximum(lines.n_words, 1)
    return total(np.ones(len(labels))), total(labels), share, ~lines.base_failed() & (share >= field.share)


def judging(field: Field):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            lines = Lines(data, offsets)
            n_lines, n_content, share, kept = verdicts(field, lines)
            counts = [pa.array(getattr(lines, c).astype(np.int64)) for c in COUNTS]
            columns = [part.column("doc_id"), *counts, pa.array(lines.base_failed()), pa.array(kept), pa.array(n_lines), pa.array(n_content), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def keeping(field: Field):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            yield part.filter(pa.array(verdicts(field, Lines(data, offsets))[3]))

    return run


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, n_lines, n_content_lines, content_share) per document."""
    field = train(docs, labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(judging(field), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    return docs.mapInArrow(keeping(train(docs, labels)), docs.schema)
