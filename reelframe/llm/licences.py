"""Operator 5: licence scans with a positional index of rare words.

1. Corpus pass: in how many documents does each word of the licence templates stand?  (Counts of the
   templates' own vocabulary, summed by Spark over all documents.)
2. Index: each template posts the positions of its ``RARE`` words of highest IDF.
3. Scan: each document looks up its words in the index; a posting at template position p and a word at
   position d vote for the alignment d - p.  Postings of a template are intersected by position: an
   alignment stands where enough distinct rare words agree within ``SLACK`` words, so that small edits
   don't hide it.
4. At such an alignment every mandatory phrase of the template (the name with its version, the opening
   words) must stand word for word, within ``SLACK`` words of its place; then the template's label is
   given.
5. A header ``SPDX-License-Identifier:`` is such a template; what gives the labels is the expression behind it, read
   token by token from the raw text: each known identifier joined by AND, OR or WITH, as far as its token reaches.
6. ``score``: the largest share of a template's words found in their places (under any of the agreeing
   alignments) among the document's labels; a base phrase alone counts as 0.5 at least; 0 without labels.

Base phrases are found in every document by comparing word hashes at neighbouring places.

Null text is empty; rows repeat as they come; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.licence_texts import HEADER, IDENTIFIERS, TEMPLATES
from reelframe.llm.words import ALNUM, chunks, find, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Words per template in the index, and the share of them that must agree on a place.
RARE, AGREE = 8, 0.6
#: Words that edits may shift a place by.
SLACK = 6

#: Tokens of a licence expression.
TOKEN = re.compile(r"[()]|[A-Za-z0-9.-]+\+?|\S")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hashes_of(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    inside = ALNUM[data]
    starts, ends, _ = find(data, np.array([0, len(data)]), inside)
    return word_hashes(data, inside, starts, ends)


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and end of each word of lower-cased texts."""
    data = LOWER[data]
    inside = ALNUM[data]
    starts, ends, text = find(data, offsets, inside)
    return word_hashes(data, inside, starts, ends), text, ends


def is_in(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Where ``values`` are among ``few`` (sorted): a table of 16 bits turns most away."""
    table = np.zeros(1 << 16, bool)
    table[(few & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(table[(values & np.uint64(0xFFFF)).astype(np.int64)])
    return at[few[np.minimum(np.searchsorted(few, values[at]), len(few) - 1)] == values[at]]


def document_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word of ``vocabulary``, and all documents; one small row per word comes back."""
    hashes = hashes_of(vocabulary)
    order = np.argsort(hashes)
    few = hashes[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(few), np.int64), 0
        for part, data, offsets in chunks(batches):
            values, text, _ = placed_words(data, offsets)
            at = is_in(values, few)
            pairs = np.unique(np.searchsorted(few, values[at]) * part.num_rows + text[at])
            total += np.bincount(pairs // part.num_rows, minlength=len(few))
            rows += part.num_rows
        if rows:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *order[some].tolist()], pa.int64()), pa.array([rows, *total[some].tolist()], pa.int64())], ["word", "n"])

    counts = {r.word: r.n for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: counts.get(k, 0) for k, w in enumerate(vocabulary)}, counts.get(-1, 0)


def build_index(counts: dict[str, int], templates: list[tuple[str, list[str], str]] = TEMPLATES) -> list[dict]:
    """Per template: label, how many rare words must agree, all words, the rare ones' places, the phrases and their places."""
    index = []
    for label, phrases, text in templates:
        words = words_of(text)
        rare = sorted(dict.fromkeys(words), key=lambda w: (counts[w], w))[:RARE]
        posts = [(w, p) for p, w in enumerate(words) if w in rare]
        keys = []
        for phrase in map(words_of, phrases):
            start = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
            keys.append((hashes_of(phrase), start))
        index.append({"label": label, "need": max(1, int(np.ceil(AGREE * len(rare)))), "words": hashes_of(words), "posts": (hashes_of([w for w, _ in posts]), np.array([p for _, p in posts])), "keys": keys})
    return index


def postings(index: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index by word hash: sorted hashes, and the template and position of each posting."""
    hashes = np.concatenate([t["posts"][0] for t in index])
    template = np.repeat(np.arange(len(index)), [len(t["posts"][0]) for t in index])
    place = np.concatenate([t["posts"][1] for t in index])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], template[order], place[order]


def agreeing(starts: np.ndarray, words: np.ndarray, need: int) -> list[np.ndarray]:
    """Groups of sorted alignments within ``SLACK`` of their first on which ``need`` distinct words agree; none inside another."""
    groups, reach = [], -1
    for k, first in enumerate(starts.tolist()):
        end = int(np.searchsorted(starts, first + SLACK, "right"))
        if end > reach and len(np.unique(words[k:end])) >= need:
            groups.append(np.unique(starts[k:end]))
            reach = end
    return groups


def phrase_at(values: np.ndarray, text: np.ndarray, phrase: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Where the words of ``phrase`` stand one after another in one text."""
    at = np.flatnonzero(values == phrase[0]) if first is None else first
    at = at[at + len(phrase) <= len(values)]
    for k in range(1, len(phrase)):
        at = at[values[at + k] == phrase[k]]
    return at[text[at] == text[at + len(phrase) - 1]]


def matches(template: dict, own: np.ndarray, alignments: np.ndarray) -> float | None:
    """The share of the template's words that stand in place in a document's words, if all phrases do."""
    for phrase, place in template["keys"]:
        around = np.arange(max(0, alignments[0] + place - SLACK), min(len(own), alignments[-1] + place + SLACK + 1))
        if not len(phrase_at(own, np.zeros(len(own), np.int8), phrase, around[own[around] == phrase[0]])):
            return None
    places = np.arange(len(template["words"]))
    there = np.zeros(len(places), bool)
    for start in alignments.tolist():
        inside = places[(places + start >= 0) & (places + start < len(own))]
        there[inside] |= own[inside + start] == template["words"][inside]
    return float(there.mean())


def identifiers(line: str) -> list[str]:
    """The known licence identifiers of an expression at the start of ``line``, in lower case."""
    found, term, depth = [], True, 0
    for token in TOKEN.findall(line):
        if term and token == "(":
            depth += 1
        elif term:
            name = token.rstrip(".-").lower()
            if name not in IDENTIFIERS:
                break
            found.append(name)
            term = False
        elif token == ")" and depth:
            depth -= 1
        elif token.upper() in ("AND", "OR", "WITH"):
            term = True
        else:
            break
    return found


def headers(own: np.ndarray, phrase: np.ndarray, ends: np.ndarray, data: np.ndarray, stop: int) -> set[str]:
    """Labels of a document's identifier headers; ``ends``: where its words end, ``stop``: where it ends."""
    labels = set()
    for at in phrase_at(own, np.zeros(len(own), np.int8), phrase).tolist():
        start = int(ends[at + len(phrase) - 1])
        feeds = np.flatnonzero(data[start:stop] == 0x0A)
        line = data[start : start + int(feeds[0]) if len(feeds) else stop].tobytes().decode().lstrip(" \t")
        if line.startswith(":"):
            labels |= {f"spdx:{i}" for i in identifiers(line[1:])}
    return labels


def scanning(index: list[dict]):
    bases = [(hashes_of(words_of(p)), label) for p, label in BASE_PHRASES.items()]
    hashes, templates, places = postings(index)
    few = np.unique(np.concatenate([hashes, *(b[:1] for b, _ in bases)]))
    needs = np.array([t["need"] for t in index])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            n = part.num_rows
            values, text, ends = placed_words(data, offsets)
            counts = np.bincount(text, minlength=n)
            begin = np.cumsum(counts) - counts
            hits = is_in(values, few)
            n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            score = np.zeros(n)
            base: list[set] = [set() for _ in range(n)]
            found: list[set] = [set() for _ in range(n)]
            for phrase, label in bases:
                at = phrase_at(values, text, phrase, hits[values[hits] == phrase[0]])
                doc, place = text[at], at - begin[text[at]]
                np.add.at(n_base, doc, 1)
                for d, p in zip(doc.tolist(), place.tolist(), strict=True):
                    base[d].add(label)
                    score[d] = 0.5
                    first[d] = p if first[d] < 0 else min(first[d], p)
                    last[d] = max(last[d], p)
            # Every posting of a word votes for an alignment of its template in the word's document.
            left, right = np.searchsorted(hashes, values[hits], "left"), np.searchsorted(hashes, values[hits], "right")
            lengths = right - left
            at = np.repeat(hits, lengths)
            post = np.repeat(left - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            pair, word, start = text[at] * len(index) + templates[post], values[at], at - begin[text[at]] - places[post]
            # Documents with too few distinct rare words of a template can't hold an alignment of it.
            order = np.lexsort((word, pair))
            new = np.ones(len(order), bool)
            new[1:] = (pair[order][1:] != pair[order][:-1]) | (word[order][1:] != word[order][:-1])
            pairs, distinct = np.unique(pair[order][new], return_counts=True)
            order = np.lexsort((start, pair))
            pair, word, start = pair[order], word[order], start[order]
            for p in pairs[distinct >= needs[pairs % len(index)]].tolist():
                d, template = p // len(index), index[p % len(index)]
                a, b = np.searchsorted(pair, [p, p + 1])
                own = values[begin[d] : begin[d] + counts[d]]
                if template["label"] == HEADER:
                    labels = headers(own, template["words"], ends[begin[d] : begin[d] + counts[d]], data, int(offsets[d + 1]))
                    found[d] |= labels
                    score[d] = 1.0 if labels else score[d]
                    continue
                for alignments in agreeing(start[a:b], word[a:b], template["need"]):
                    share = matches(template, own, alignments)
                    if share is not None:
                        found[d].add(template["label"])
                        score[d] = max(score[d], share)
            none, null = pa.array(first < 0), pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(n_base), pc.if_else(none, null, pa.array(first)), pc.if_else(none, null, pa.array(last)), pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b | f)) for b, f in zip(base, found, strict=True)]), pa.array(score)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return run


def scan_licences(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for _, _, t in TEMPLATES for w in words_of(t)})
    counts, _ = document_counts(docs, vocabulary)
    return docs.mapInArrow(scanning(build_index(counts)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
