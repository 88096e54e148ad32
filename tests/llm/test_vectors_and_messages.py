"""Operators on embeddings and conversations, and the pipeline."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelframe.llm import embeddings, quotations
from reelframe.llm.graph import bundles, components
from test_documents import brute_groups, brute_substrings, words


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 150), (7, 7)] + [(500, k) for k in range(501, 560)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 150: 100, 200: 100} | {k: 500 for k in range(500, 560)}


def test_near_vectors(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(6, 16))
    rows = [(k, [float(x) for x in centre[k % 6] + draw.normal(scale=0.06, size=16)], k % 2) for k in range(120)]
    rows += [(120, rows[3][1], 1), (121, [0.0] * 16, 1), (122, None, 1), (123, [float("nan")] * 16, 1), (124, rows[3][1], None), (None, rows[3][1], 1), (125, [None] * 16, 1), (126, [], 1), (127, [1.0, 2.0], 1), (128, [2.0, 4.0], 1)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, keys int")
    monkeypatch.setattr(embeddings, "TILE", 16)
    found = {r.vec_id: r for r in embeddings.near_vectors(vectors).collect()}
    assert len(found) == len(rows)
    fit = [(i, np.array(e, np.float32).astype(float), l) for i, e, l in rows if i is not None and e and l is not None and None not in e and np.isfinite(e).all() and any(e)]
    n, group = {i: 0 for i, _, _ in fit}, {i: i for i, _, _ in fit}
    for k, (i, x, a) in enumerate(fit):
        for j, y, b in fit[:k]:
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                n[i] += 1
                n[j] += 1
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    for i in n:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (n[i], group[i], group[i] == i)
    for i in (121, 122, 123, 124, 125, 126, None):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert embeddings.near_vectors(vectors.where("false")).count() == 0


def test_vectors_that_share_an_id_are_judged_each_for_itself(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(1, e(1, 0, 0)), (1, e(0, 1, 0)), (2, e(1, 0.01, 0)), (3, e(0.01, 1, 0)), (3, e(0.01, 1, 0)), (4, e(0, 0, 1.1)), (5, e(0, 0, 0.1 + 1e-12))]
    found = embeddings.near_vectors(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == want


def test_bundles_keep_tiles_whole():
    draw = np.random.default_rng(8)
    sizes = draw.integers(1, 40, 60)
    keys = np.repeat(np.arange(60), sizes)
    table = pa.table({"key": keys, "i": np.zeros(len(keys), int), "j": np.zeros(len(keys), int)})
    seen = []
    for part, tile in bundles(table.to_batches(max_chunksize=17), 30):
        own = part.column("key").to_numpy()
        assert len(own) <= 30 or len(np.unique(own)) == 1
        assert (np.diff(tile) == (np.diff(own) != 0)).all() and tile[0] == 0
        seen += own.tolist()
        assert all((own == k).sum() == sizes[k] for k in np.unique(own))
    assert seen == keys.tolist()


def same_as_sql(found, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    other = con.sql(quotations.SQL)
    at = [other.columns.index(c) for c in found[0].__fields__]
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr(tuple(r[k] for k in at)) for r in other.fetchall())


def test_quotations(spark, tmp_path):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello  THERE\nFine\nthanks"), (1, 2, "user", "> Fine\n>> hello there\nok"), (1, 3, "user", ">> Fine\nnest"), (1, 4, None, "> nothing matches\nx"),
        (1, 5, "user", "> ok\n> nest\n> Fine\nmulti"), (1, 5, "user", "> ok\nsecond part"), (2, 0, "user", None), (2, 1, "user", ">"), (None, 1, "user", "> a"), (3, None, "user", "q"), (1, 6, "u", "> multi\n hi"), (1, 7, "u", "> hi\n> HI\nend"),
        # Quotes that were wrapped anew, or that repeat a sentence only.
        (4, 10, "user", "The first sentence is\nlong. The second! A third one"), (4, 12, "user", "> the first\n> sentence is long.\nyes"), (4, 15, "user", "text\n> The second!\nno"), (4, 20, "user", "> A third\nnot linked"),
        # Turns of any size, below zero too.
        (5, -5, "user", "early words"), (5, 1764300000000, "user", "> early words\nlate words"), (5, 1764300000001, "user", "> late words\nlast"), (5, -4, "user", "> early words\nearlier answer"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = quotations.link_quotations(messages.withColumn("level", F.lit(1)))
    found = linked.collect()
    by_turn = {(r.conv_id, r.turn): r for r in found}
    assert [by_turn[1, k].reply_to for k in range(8)] == [None, 0, 1, 1, None, 3, 5, 6]
    assert [(by_turn[1, k].thread, by_turn[1, k].position, by_turn[1, k].depth) for k in range(8)] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 2), (4, 0, 0), (0, 4, 3), (0, 5, 4), (0, 6, 5)]
    assert [by_turn[4, k].reply_to for k in (10, 12, 15, 20)] == [None, 10, 10, None] and by_turn[1, 2].clean_text == "ok"
    assert [by_turn[5, k].position for k in (-5, -4, 1764300000000, 1764300000001)] == [0, 1, 2, 3]
    same_as_sql(found, rows)
    assert quotations.link_quotations(messages.where("false")).count() == 0
    quotations.write_conversations(linked.where("conv_id = 5"), str(tmp_path / "chats"))
    chats = [c for f in sorted((tmp_path / "chats").glob("part-*")) for c in f.read_text().split("\n\n") if c]
    assert [c.split("\n")[1] for c in chats] == ["early words", "earlier answer", "late words", "last"]


def test_long_and_wide_threads(spark):
    """A chain of 200 answers, and a message with 200: keys of fixed size, brothers in order of time."""
    rows = [(1, k, "u", f"> words {k - 1}\nwords {k}" if k else "words 0") for k in range(200)]
    rows += [(2, k, "u", f"> start\nanswer {k}" if k else "start") for k in range(200)]
    found = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.position, r.depth) for r in found} == {(1, k): (k, k) for k in range(200)} | {(2, k): (k, min(k, 1)) for k in range(200)}


def test_pipeline(spark):
    """Every stage, on what its predecessor kept, against brute force."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from reelframe.llm import mixing
    from reelframe.llm.queries import TOKENIZER
    from reelframe.llm.shared import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        kept[name] = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "substring_dedup":
            taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_digest(docs).collect()}
    good, apart, cut, mixed = kept.values()
    assert all(len(words(d.text)) >= 50 for d in good)
    assert {d.doc_id for d in apart} == {least[0] for least in brute_groups(good).values()}
    want = {r[0]: r[3] for r in brute_substrings(apart)}
    assert {d.doc_id: hashlib.sha256(" ".join(words(d.text)).encode()).hexdigest() for d in cut} == want
    copies = Counter(d.doc_id for d in mixed)
    assert all(copies[i] * size == n for i, (size, n) in taken.items())
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokens = sum(len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1 for d in mixed)
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.agg(F.sum("length")).first()[0] == tokens
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
