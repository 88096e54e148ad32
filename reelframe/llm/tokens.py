"""Token ids of whole texts with the ``tokenizers`` library.

The library splits a text into pieces and merges bytes within each piece only, so a piece has the
same ids wherever it stands.  Pieces of a whole batch are found in NumPy, and the library encodes
each distinct piece once per worker process.  Texts with characters beyond the ranges below, or with
the text of an added token, go to the library whole.
"""

from __future__ import annotations

import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import unicodedata  # noqa: E402

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from reelframe.llm.words import word_hashes  # noqa: E402

#: Pieces kept per worker before the table starts anew, and the slots of an empty table, which doubles as it fills.
MAX_PIECES, SLOTS = 500_000, 1 << 16

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# White space of the Unicode standard below U+0530, and the split pattern's contractions.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

KNOWN = 0x530


def _classes() -> np.ndarray:
    kinds = np.zeros(KNOWN, np.uint8)
    for c in range(KNOWN):
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kinds[WHITE] = SPACE
    return kinds


CLASSES = _classes()


def pieces(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of the byte-level split's pieces; ``cuts``: where non-empty texts start."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = CLASSES[codes]
    first = np.zeros(n + 1, bool)
    first[cuts] = first[n] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= first
    start = change.copy()
    # The last white space before other text is a piece of its own, or joins that text if it is a blank.
    last = np.flatnonzero((kind == SPACE) & change[1:] & ~first[1:])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    for marks in CONTRACTIONS:
        at = np.flatnonzero((codes == 0x27) & start[:n])
        at = at[at + len(marks) < n]
        for k, c in enumerate(marks, 1):
            at = at[(codes[at + k] == ord(c)) & ~first[at + k]]
        end = at + 1 + len(marks)
        start[at + 1] = False
        inner = end[(end < n)]
        start[inner[(kind[inner] == LETTER)]] = True
    return np.flatnonzero(start[:n])


def check_split(path: str, settings: str) -> None:
    """Raises unless a tokenizer splits as :func:`pieces` does and changes no text before that."""
    found = json.loads(settings)
    split = found["pre_tokenizer"] or {}
    same = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not same or found["normalizer"] is not None or found["model"].get("type", "BPE") != "BPE" or found["model"].get("dropout"):
        raise ValueError(f"{path} is no plain byte-level BPE: it has another split of texts, a normalizer or dropout")


class Encoder:
    """Encodes lists of texts; made once per worker process by :func:`encoder`.

    Known pieces are found by a hash of 64 bits in an open-addressed table that is at most half full.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        check_split(path, self.tokenizer.to_str())
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.count = self.used = 0

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The piece numbers, -1 for pieces that are new."""
        found, last = np.full(len(hashes), -1, np.int32), len(self.keys) - 1
        rest, slot = np.arange(len(hashes)), (hashes & np.uint64(last)).astype(np.int64)
        while len(rest):
            there = self.keys[slot]
            same = there == hashes[rest]
            found[rest[same]] = self.values[slot[same]]
            on = ~same & (there != 0)
            rest, slot = rest[on], (slot[on] + 1) & last
        return found

    def reserve(self, n: int) -> None:
        """Makes room for ``n`` pieces in all."""
        slots = len(self.keys)
        while slots < 2 * n:
            slots *= 2
        if slots > len(self.keys):
            there = self.keys != 0
            hashes, numbers = self.keys[there], self.values[there]
            self.keys, self.values = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
            self.insert(hashes, numbers)

    def insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        last = len(self.keys) - 1
        rest, slot = np.arange(len(hashes)), (hashes & np.uint64(last)).astype(np.int64)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[rest[free]]
            mine = free & (self.keys[slot] == hashes[rest])
            self.values[slot[mine]] = numbers[rest[mine]]
            rest, slot = rest[~mine], (slot[~mine] + 1) & last

    def learn(self, new: list[str], hashes: np.ndarray) -> None:
        """Encodes new pieces: blank-led words many at a time, as only their first ids start with the blank."""
        order = sorted(range(len(new)), key=lambda k: not (new[k][0] == " " and new[k][1:].isalpha()))
        led = sum(1 for w in new if w[0] == " " and w[1:].isalpha())
        many = [[new[k] for k in order[i : min(i + 2000, led)]] for i in range(0, led, 2000)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(["".join(x) for x in many], add_special_tokens=False)]
        single = [e.ids for e in self.tokenizer.encode_batch_fast([new[k] for k in order[led:]], add_special_tokens=False)]
        flat = np.concatenate([*ids, np.fromiter((i for x in single for i in x), np.uint32)]).astype(np.uint32)
        joined = sum(map(len, ids))
        first = np.flatnonzero(self.opens[flat[:joined]])
        ends = np.concatenate([np.append(first[1:], joined)[: len(first)], joined + np.cumsum(np.fromiter(map(len, single), np.int64, len(single)))])
        assert len(ends) == len(new)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.count + 1 : self.count + 1 + len(new)] = self.used + ends
        self.reserve(self.count + len(new))
        self.insert(hashes[order], np.arange(self.count, self.count + len(new), dtype=np.int32))
        self.used += len(flat)
        self.count += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if self.count > MAX_PIECES:
            self.clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        apart = {}
        if any(a in whole for a in self.added) or len(codes) and codes.max() >= KNOWN:
            slow = [k for k, t in enumerate(texts) if any(a in t for a in self.added) or t and ord(max(t)) >= KNOWN]
            apart = {k: self.tokenizer.encode(texts[k], add_special_tokens=False).ids for k in slow}
            texts = ["" if k in apart else t for k, t in enumerate(texts)]
            sizes[slow] = 0
            whole = "".join(texts)
            codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        starts = pieces(codes, (ends - sizes)[sizes > 0])
        stops = np.append(starts[1:], len(codes))
        hashes = word_hashes(codes, np.ones(len(codes), bool), starts, stops[: len(starts)])
        where = self.look_up(hashes)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            self.learn([whole[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)], new)
            where[missing] = self.look_up(hashes[missing])
        begin = self.ends[where]
        lengths = self.ends[where + 1] - begin
        total = np.zeros(len(where) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        flat = self.flat[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        reached = total[np.searchsorted(starts, ends)]
        counts = np.diff(reached, prepend=0)
        if apart:
            parts = np.split(flat, reached[:-1])
            for k, ids in apart.items():
                parts[k] = np.array(ids, np.uint32)
            flat, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return flat, counts


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """``plain``: the text of an added token is ordinary text."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
