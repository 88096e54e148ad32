"""Byte-level BPE, hard negatives and the Merkle manifest against brute force, with messy and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reelframe.llm import bpe, merkle, negatives
from reelframe.llm.queries import RANKS


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_is_that_of_the_library(messy, reference):
    rows = bpe.round_trip(messy, RANKS).collect()
    want = Counter()
    for d in messy.collect():
        ids = reference.encode_ordinary(d.text or "")
        want[d.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((d.text or "").encode())] += 1
    assert Counter(map(tuple, rows)) == want


def test_bpe_of_odd_texts(reference):
    draw = random.Random(2)
    texts = ["", "x" * 5000, "aaaa" * 300, " " * 700, "\x1c \x1d　 a  b\n\n c 'll're", "\U0001f937‍♂️ é ٣٤ ⅷ", "<|endoftext|>", "-" * 65, "-" * 64]
    texts += ["".join(draw.choices("ab '\n\t.1é日\U0001f937\x1c stredlmv", k=draw.randint(0, 60))) for _ in range(2000)]
    words = bpe.vocabulary(RANKS)
    ids, counts = words.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == reference.encode_ordinary(text)
    assert words.decode(ids)[0].tobytes() == "".join(texts).encode()


def test_texts_are_cut_where_pieces_end(reference):
    text = "ab cd\n" * 200 + "x" * 300 + " é日 " * 100 + "\n \n  y"
    for span in (1, 7, 50, 10_000):
        parts = bpe.parts_of(text, span)
        assert "".join(parts) == text
        assert [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)
    assert bpe.parts_of("", 5) == [""] and bpe.parts_of("x" * 20, 5) == ["x" * 20]


def test_perfect_hash_is_minimal(rng=np.random.default_rng(1)):
    for n in (1, 2, 100, 50_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        found = bpe.PerfectHash(keys).look_up(keys)
        assert sorted(found.tolist()) == list(range(n))
    assert bpe.PerfectHash(np.zeros(0, np.uint64)).look_up(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([5, 5], np.uint64))


def test_merges_by_rank_then_place(rng=random.Random(4)):
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 400:
        a, b = rng.choices(list(ranks)[-150:] + [b"a", b"b", b"c"], k=2)
        ranks.setdefault(a + b, len(ranks))
    for _ in range(300):
        piece = bytes(rng.choices(b"abcxyz", k=rng.randint(1, 30)))
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[k] + parts[k + 1], 10**9), k) for k in range(len(parts) - 1))
            if rank == 10**9:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_ids_and_bytes_as_tables(spark, messy, reference):
    ids = bpe.encode_texts(messy, RANKS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((d.doc_id, tuple(reference.encode_ordinary(d.text or ""))) for d in messy.collect())
    back = bpe.decode_ids(ids.union(spark.createDataFrame([(77, None), (78, [])], "doc_id long, ids array<int>")), RANKS)
    want = Counter((d.doc_id, (d.text or "").encode()) for d in messy.collect()) + Counter([(77, None), (78, b"")])
    assert Counter((r.doc_id, r.bytes and bytes(r.bytes) if r.bytes is not None else None) for r in back.collect()) == want
    with pytest.raises(Exception, match="the vocabulary has no id"):
        bpe.decode_ids(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()


VECTORS = "vec_id long, embedding array<double>, label int, v string, n string, score string, anchor string, place string, `rank` string"


def brute_negatives(rows):
    usable = []
    for vec_id, e, label, *_ in rows:
        if None in (vec_id, e, label) or any(x is None or not np.isfinite(x * 256) for x in e):
            continue
        usable.append((vec_id, [Fraction(x) * 256 // 1 for x in e], label))
    score = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=True)))
    for anchor, q, label in usable:
        if anchor % 50:
            continue
        scored = [(score(q, v), i, other == label) for i, v, other in usable if i != anchor and len(v) == len(q)]
        scored = sorted((s for s in scored if abs(s[0]) < 2**63), key=lambda s: (-s[0], s[1]))
        for ps, positive, _ in [s for s in scored if s[2]][:5]:
            found = [s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            for rank, (ns, negative, _) in enumerate(found, 1):
                yield anchor, positive, rank, negative, ps, ns


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(negatives, "ROW_CELLS", 600)
    monkeypatch.setattr(negatives, "ANCHOR_CELLS", 40)
    monkeypatch.setattr(negatives, "LEAST_CELLS", 100)
    rows = [(k, (rng.integers(-3, 4, 12) / 10 + 0.2).tolist(), int(rng.integers(0, 3))) for k in range(240)]
    copy = (rng.normal(size=12) / 5 + 0.2).tolist()
    rows += [(300 + k, copy, k % 2) for k in range(150)]  # ties of every kind
    rows += [(100, copy, 1), (100, rows[3][1], 2), (50, None, 1), (150, copy, None), (None, copy, 1), (450, [0.1, None] * 6, 1), (451, [float("nan")] * 12, 1), (452, [float("inf")] * 12, 0), (453, [1e307] * 12, 0)]
    rows += [(500 + k, [0.5, 0.25, k / 100], k % 2) for k in range(30)] + [(600, [], 1), (601, [], 1), (602, [], 2)]
    rows += [(1000 + k, [float(rng.integers(-(2**24), 2**24)) * 2.0**e for _ in range(4)], k % 2) for k in range(40) for e in [int(rng.integers(0, 8))]]
    rows += [(700, [1e200, 1.0], 0), (701, [1e200, 2.0], 0), (702, [0.0, 1.0], 1), (703, [0.0, 4.0], 0)]
    found = negatives.hard_negatives(spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], VECTORS))
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got and got == Counter(brute_negatives(rows))
    assert {a for a, *_ in got} >= {0, 50, 1000} or len(got) > 30


def test_no_negatives(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<double>, label int")).count() == 0


def test_bounds_drop_candidates(rng=np.random.default_rng(3)):
    """The scan gives exact scores to what it keeps, and keeps little of unlike rows."""
    import pyarrow as pa

    n = 64
    q = np.round(rng.normal(size=n) * 40)
    vectors = np.concatenate([np.round(q + rng.normal(size=(20, n)) * 4), np.round(rng.normal(size=(2000, n)) * 5)])
    block = negatives.Block(pa.table({"vec_id": np.arange(2020), "label": np.zeros(2020, np.int64), "v": pa.array(list(vectors))}), n)
    at, scores = block.scan(q, 0, 2020, np.ones(2020, bool), negatives.above(5))
    assert len(at) < 40 and (scores == vectors[at] @ q).all()
    assert sorted(negatives.best(block.ids[at], scores, 5)) == sorted(negatives.best(np.arange(2020), vectors @ q, 5))


def brute_merkle(docs):
    def digest(d, text):
        values = [d.doc_id, d.source, d.lang, d.n_chars, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode())

    def changed(d):
        third = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 3 == 0
        return digest(d, d.text and "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text) if third else d.text)

    def climb(leaves):
        """The top and, for each leaf, its siblings as (place, digests), from the leaf up."""
        paths, level, owners = defaultdict(list), list(leaves), [[k] for k in range(len(leaves))]
        while len(level) > 1:
            runs = [range(k, min(k + 8, len(level))) for k in range(0, len(level), 8)]
            for run in runs:
                for at, k in enumerate(run):
                    for leaf in owners[k]:
                        paths[leaf].append((at, [level[j] for j in run if j != k]))
            level, owners = [sha("".join(level[j] for j in run).encode()) for run in runs], [[x for j in run for x in owners[j]] for run in runs]
        return level[0], paths

    groups = defaultdict(list)
    for d in docs:
        groups[d.lang].append((d.doc_id is not None, d.doc_id, digest(d, d.text), changed(d)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        tops[name] = climb([x[2] for x in groups[name]])
    root, above = climb([tops[n][0] for n in names])
    for at, name in enumerate(names):
        subroot, paths = tops[name]
        for k, (_, doc_id, leaf, other) in enumerate(groups[name]):
            path, node = paths[k] + above[at], other
            for place, siblings in path:
                node = sha("".join([*siblings[:place], node, *siblings[place:]]).encode())
            yield doc_id, leaf, subroot, root, sha("".join(s for _, x in path for s in x).encode()), node, node == root


def rows_of(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merkle(messy, many_ranges):
    assert rows_of(merkle.verified(messy)) == Counter(brute_merkle(messy.collect()))


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9}, {"en": 8, None: 1}, {None: 65, "": 3, "b": 64, "é": 1, "Z": 7}, {f"l{k}": 2 + k for k in range(11)}])
def test_merkle_of_many_shapes(spark, sizes, many_ranges):
    rows = [(k, f"Text {k} ABC", lang, None if k % 4 else "s", k) for lang, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert rows_of(merkle.verified(docs)) == Counter(brute_merkle(docs.collect()))


def test_merkle_of_equal_rows(spark, many_ranges):
    """A third of all rows are one row; equal subtrees are one record of the store."""
    rows = [(None, None, None, None, None)] * 200 + [(k % 250, "A", "en", "s", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert rows_of(merkle.verified(docs)) == Counter(brute_merkle(docs.collect()))
    _, _, trees = merkle.manifest(merkle.leaves_of(docs))
    store = trees["store"]
    assert store.count() == store.select("height", "digest").distinct().count() < trees["runs"].count()


def test_proofs_of_some_leaves(spark, many_ranges):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    root, starts, trees = merkle.manifest(merkle.leaves_of(docs), "doc_id")
    asked = spark.createDataFrame([(0, 3), (0, 139), (1, 0), (1, 8), (1, 8), (1, 559), (1, 9999)], "tree long, `rank` long")
    rows = merkle.proofs(starts, trees, ["doc_id"], asked).withColumn("folded", merkle.fold(F.col("digest"), "path")).collect()
    assert sorted((r.tree, r["rank"]) for r in rows) == [(0, 3), (0, 139), (1, 0), (1, 8), (1, 559)]
    assert all(r.folded == root for r in rows) and {r.doc_id for r in rows if r.tree == 0} == {15, 695}


def test_empty_tables(spark, no_docs):
    assert merkle.verified(no_docs).count() == 0
    assert bpe.round_trip(no_docs, RANKS).count() == 0 and bpe.encode_texts(no_docs, RANKS).count() == 0
