"""Operators on documents against brute force, with messy and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelframe.llm import licence_texts, licences, mixing, nearcopies, orc_tokens, packing, quality, separators, substrings
from reelframe.llm.queries import SEPARATOR, TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack(messy, tokenizer):
    docs = messy.collect()
    want = Counter()
    rows = packing.pack_documents(messy, TOKENIZER, block=6).collect()
    ids = defaultdict(list)
    for d in docs:
        own = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1]
        want[d.doc_id, len(own)] += len(own)
        ids[d.doc_id].append(own)
    got = Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        assert any(len(own) == r.doc_tokens and crc(own[r.start : r.start + r.length]) == r.ids_crc32 for own in ids[r.doc_id])
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_fill_is_the_closest(rng=np.random.default_rng(3)):
    for _ in range(60):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, 40, rng.integers(0, 9)).tolist()
        counts = [0] * 61
        for n in lengths:
            counts[n] += 1
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        used = packing.fill(counts, capacity)
        assert sum(used) == max(s for s in sums if s <= capacity)
        assert all(used.count(n) <= counts[n] for n in used)


def test_orc_round_trip(messy, tokenizer):
    rows = orc_tokens.token_files(messy, TOKENIZER).collect()
    want = Counter((d.doc_id, len(i := [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]), crc(i)) for d in messy.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


def test_orc_metadata_and_pruned_reads(spark, tmp_path):
    path = str(tmp_path / "orc")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    orc_tokens.write_orc(docs.repartition(3), path, TOKENIZER)
    jvm, streams = spark._jvm, set()
    for file in sorted((tmp_path / "orc").glob("part-*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        low, high = reader.getStatistics()[1].getMinimum(), reader.getStatistics()[1].getMaximum()
        assert low < high and reader.getStripeStatistics().size() == reader.getStripes().size()
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            footer = rows.readStripeFooter(reader.getStripes().get(k))
            streams |= {(footer.getStreams(j).getKind().toString(), footer.getStreams(j).getColumn()) for j in range(footer.getStreamsCount())}
        rows.close()
    assert {("ROW_INDEX", 1), ("BLOOM_FILTER_UTF8", 1)} <= streams
    one = spark.read.schema("doc_id long, ids array<int>").orc(path).where("doc_id = 2500")
    assert "EqualTo(doc_id,2500)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1
    # A row group of 1000 at most is read, and none where the Bloom filter or the statistics know better.
    read = spark.read.schema("doc_id long, ids array<int>").option("spark.sql.orc.filterPushdown", "true").orc(path)

    def scanned(df):
        df.collect()
        plan, found = df._jdf.queryExecution().executedPlan(), []
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value()

    assert 1 <= scanned(read.where("doc_id = 2500")) <= 1000 and scanned(read.where("doc_id = 99999")) == 0


def test_orc_files_follow_the_bytes(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [orc_tokens.file_count(spark, n) for n in (0, 1, 9 << 20, 1 << 30, 1 << 40)] == [1, 1, 2, parts, 4096]


def test_flat_files_hold_ids_and_separators_only(spark, tmp_path, tokenizer):
    docs = spark.createDataFrame([(5, "one two"), (None, None), (3, "three")], "doc_id long, text string").coalesce(1)
    separators.write_stream(docs, TOKENIZER, SEPARATOR, str(tmp_path / "t"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "t" / "kind=0").glob("file=*/part-*")))
    want = [i for t in ("one two", "", "three") for i in [*tokenizer.encode(t, add_special_tokens=False).ids, SEPARATOR]]
    assert np.frombuffer(raw, "<u2").tolist() == want


def test_width_of_ids_follows_the_vocabulary(spark, monkeypatch, messy):
    assert separators.id_type(TOKENIZER, 1) == "<u2" and separators.id_type(TOKENIZER, 1 << 16) == "<u4"

    class Large:
        from_file = staticmethod(lambda path: Large())
        get_vocab_size = staticmethod(lambda: 70_000)

    small = messy.where("length(text) < 5000 OR text IS NULL")
    want = Counter((r.doc_id, r.n_tokens) for r in separators.token_counts(small, TOKENIZER, SEPARATOR).collect())
    monkeypatch.setattr(separators, "Tokenizer", Large)
    assert separators.id_type(TOKENIZER, 1) == "<u4"
    assert Counter((r.doc_id, r.n_tokens) for r in separators.token_counts(small, TOKENIZER, SEPARATOR, 100).collect()) == want


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_separators(messy, tokenizer, block):
    tokenizer.encode_special_tokens = True
    want = Counter((d.doc_id, len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)) for d in messy.collect())
    tokenizer.encode_special_tokens = False
    docs = messy.where("length(text) < 5000 OR text IS NULL") if block == 7 else messy
    if block == 7:
        keep = {d.doc_id for d in docs.collect()}
        want = Counter({k: n for k, n in want.items() if k[0] in keep})
    rows = separators.token_counts(docs, TOKENIZER, SEPARATOR, block).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want


def test_files_end_by_bytes(spark, tmp_path, tokenizer, monkeypatch):
    """Long documents make files of their own; the others share files of the stated size at most."""
    monkeypatch.setattr(separators, "FILE_BYTES", 4000)
    texts = ["word " * (2500 if k % 40 == 7 else k % 9) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter((k, len(tokenizer.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts))
    rows = separators.token_counts(docs, TOKENIZER, SEPARATOR, 100).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    separators.write_stream(docs, TOKENIZER, SEPARATOR, str(tmp_path / "t"))
    sizes = [f.stat().st_size for f in (tmp_path / "t" / "kind=0").glob("file=*/part-*")]
    assert len(sizes) > 10 and max(sizes) <= 4000 + 2 * 2600
    places = sorted((r.file, r.ordinal, r.start) for r in rows)
    assert all(b[2] > a[2] for a, b in zip(places[:-1], places[1:], strict=True) if a[0] == b[0])


def test_other_tokenizers_are_refused():
    import public_tokenizers

    from reelframe.llm.tokens import Encoder

    with pytest.raises(ValueError, match="no plain byte-level BPE"):
        Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_piece_table_grows_with_its_pieces(tokenizer):
    from reelframe.llm.tokens import Encoder

    found = Encoder(TOKENIZER)
    assert found.keys.nbytes + found.values.nbytes < 1 << 20
    for part in range(4):
        text = " ".join(f"w{chr(97 + k % 26)}{np.base_repr(k, 36).lower()}" for k in range(part * 15_000, (part + 1) * 15_000))
        ids, counts = found.encode([text])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert found.count * 2 <= len(found.keys) < found.count * 8


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, TOKENIZER).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    power = lambda n: n & (n - 1) == 0
    padding = sum(2048 - r.n for r in rows if not power(r.n))
    assert padding < 0.01 * sum(r.n for r in rows)


def brute_licences(docs, templates=licences.TEMPLATES):
    """The documented rules, one document, template and alignment after another."""
    texts = [licences.words_of(d.text or "") for d in docs]
    vocabulary = {w for _, _, t in templates for w in licences.words_of(t)}
    df = {w: sum(w in set(t) for t in texts) for w in vocabulary}
    for d, own in zip(docs, texts, strict=True):
        places = [(k, label) for phrase, label in licences.BASE_PHRASES.items() for p in [phrase.split()] for k in range(len(own)) if own[k : k + len(p)] == p]
        labels, score = {label for _, label in places}, 0.5 if places else 0.0
        base = ",".join(sorted(labels))
        for label, phrases, text in templates:
            words = licences.words_of(text)
            if label == licence_texts.HEADER:
                for line in re.findall(r"spdx[^a-z0-9]license[^a-z0-9]identifier[ \t]*:(.*)", d.text or "", re.I):
                    expression = re.split(r"(?i)\s+(?:and|or|with)\s+", line.replace("(", " ").replace(")", " ").strip())
                    for part in expression:
                        name = part.split()[0].rstrip(".-").lower() if part.split() else ""
                        if name not in licence_texts.IDENTIFIERS:
                            break
                        labels.add(f"spdx:{name}")
                        score = 1.0
                        if len(part.split()) > 1:
                            break
                continue
            rare = sorted(set(words), key=lambda w: (df[w], w))[: licences.RARE]
            votes = sorted({(k - p, w) for k, w in enumerate(own) if w in rare for p, x in enumerate(words) if x == w})
            for start, _ in votes:
                near = [v for v in votes if start <= v[0] <= start + licences.SLACK]
                if len({w for _, w in near}) < -(-licences.AGREE * len(rare) // 1):
                    continue
                starts = sorted({v for v, _ in near})
                for phrase in map(licences.words_of, phrases):
                    at = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
                    if not any(own[k : k + len(phrase)] == phrase for k in range(max(0, starts[0] + at - licences.SLACK), starts[-1] + at + licences.SLACK + 1)):
                        break
                else:
                    labels.add(label)
                    score = max(score, np.mean([any(0 <= s + k < len(own) and own[s + k] == w for s in starts) for k, w in enumerate(words)]))
        yield d.doc_id, len(own), len(places), min(places)[0] if places else None, max(places)[0] if places else None, base, ",".join(sorted(labels)), round(float(score), 9)


def notice(version, name="GNU General Public License"):
    return f"This tool is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This tool is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."


def test_licences(spark, messy):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT LICENSE mit license", "the mit\nlicense CC-BY", None, "apachelicense", "Apache License of a tribe", "some words. " + notice(2) + " more words", notice(3), notice("2.1", "GNU Lesser General Public License"), notice(3, "GNU Affero General Public License"), notice(1)]
    texts += ["Copyright me\n\n" + licence_texts.MIT + "\n\nThe program", licence_texts.MIT.replace("Software", "Product"), licence_texts.ISC.upper(), licence_texts.BSD + " " + licence_texts.BSD_3 + " " + licence_texts.BSD_DISCLAIMER, licence_texts.BSD + " " + licence_texts.BSD_DISCLAIMER]
    texts += ["# SPDX-License-Identifier: GPL-2.0-only\ncode", licence_texts.APACHE_NOTICE, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", " ".join(sorted(licences.words_of(licence_texts.MIT)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert [(rows[k].n_base, rows[k].base_labels) for k in range(6)] == [(1, "apache"), (2, "mit"), (2, "cc-by,mit"), (0, ""), (0, ""), (1, "apache")]
    assert (rows[1].first_word, rows[1].last_word) == (0, 2) and rows[3].first_word is None
    want = {0: "apache", 5: "apache", 6: "gpl,gpl-2.0", 7: "gpl,gpl-3.0", 8: "lgpl-2.1", 9: "agpl-3.0", 10: "gpl", 11: "mit-text", 12: "mit-text", 13: "isc", 14: "bsd,bsd-3-clause", 15: "bsd", 16: "spdx:gpl-2.0-only", 17: "apache,apache-2.0", 18: "cc-by-sa-4.0", 19: ""}
    assert {k: rows[k].labels for k in want} == want
    assert rows[11].score == 1.0 and 0.9 < rows[12].score < 1 and rows[19].score == 0
    every = messy.where("text IS NULL OR length(text) < 10000").select("doc_id", "text").union(docs)
    found = licences.scan_licences(every).collect()
    assert Counter((*r[:-1], round(r.score, 9)) for r in found) == Counter(brute_licences(every.collect()))
    assert licences.scan_licences(messy).count() == messy.count()


LGPL_HEADER = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""


def test_identifiers_end_where_their_token_ends(spark):
    cases = {
        "MIT-0": "spdx:mit-0",
        "BSD-3-Clause-Clear": "spdx:bsd-3-clause-clear",
        "zlib-acknowledgement */": "spdx:zlib-acknowledgement",
        "(MIT OR Apache-2.0)": "spdx:apache-2.0,spdx:mit",
        "GPL-2.0": "spdx:gpl-2.0",
        "LGPL-2.1+": "spdx:lgpl-2.1+",
        "GPL-2.0-only WITH Classpath-exception-2.0 AND (ISC or MIT).": "spdx:classpath-exception-2.0,spdx:gpl-2.0-only,spdx:isc,spdx:mit",
        "MIT and so on": "spdx:mit",
        "see MIT": "",
        "MITx": "",
        "MIT\nApache-2.0": "spdx:mit",
        "": "",
    }
    docs = spark.createDataFrame([(k, f"// SPDX-License-Identifier: {t}\nint main;") for k, t in enumerate(cases)] + [(99, "SPDX-License-Identifier MIT"), (100, "x" * 9 + "é spdx-LICENSE-identifier:\tmit")], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in licences.scan_licences(docs).collect()}
    assert {k: found[k][0] for k in range(len(cases))} == dict(enumerate(cases.values()))
    assert found[0] == ("spdx:mit-0", 1.0) and found[99] == ("", 0.0) and found[100] == ("spdx:mit", 1.0)
    assert Counter((r[0], r[6], round(r[7], 9)) for r in brute_licences(docs.collect())) == Counter((k, *v) for k, v in found.items())


def test_first_sentences_of_notices(spark):
    exact = "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    docs = spark.createDataFrame([(0, LGPL_HEADER), (1, exact)], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    assert (found[0].labels, found[0].score) == ("lgpl-2.1", 1.0) and (found[1].labels, found[1].score) == ("gpl,gpl-2.0", 1.0)


def brute_substrings(docs):
    first = {}
    for d in docs:
        w = words(d.text)
        if d.doc_id is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, d.doc_id), d.doc_id)
    for d in docs:
        w = words(d.text)
        gone = [False] * len(w)
        if d.doc_id is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < d.doc_id:
                    gone[k : k + 50] = [True] * 50
        yield d.doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def test_substrings(messy):
    rows = substrings.digest_repeats(messy).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == Counter(brute_substrings(messy.collect()))
    cut = substrings.cut_repeats(messy)
    assert cut.columns == messy.columns and cut.count() == messy.count()


def test_quality(spark, messy):
    labels = spark.createDataFrame([(0, 1), (1, 1), (12, 1), (16, 0), (17, 0), (None, 1), (3, None)], "doc_id long, quality int")
    want = Counter()
    for d in messy.collect():
        w, text = words(d.text), d.text or ""
        counts = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if counts[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[d.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed] += 1
    rows = quality.judge(messy, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.base_failed and r.kept for r in rows)
    none = quality.judge(messy, labels.where("false")).where("kept = base_failed").count()
    assert none == 0
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns


def test_viterbi_is_the_best_path(rng=np.random.default_rng(1)):
    for _ in range(20):
        move, sizes = rng.normal(size=(2, 2)), rng.integers(1, 8, 5).tolist()
        scores = rng.normal(size=(sum(sizes), 2))
        first = np.zeros(len(scores), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        want = []
        for n, end in zip(sizes, np.cumsum(sizes).tolist(), strict=True):
            own = scores[end - n : end]
            total = lambda y: sum(own[k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1))  # noqa: B023, E731
            want += max(([m >> k & 1 for k in range(n)] for m in range(1 << n)), key=total)
        assert quality.best_labels(scores, move, first).tolist() == want
    assert len(quality.best_labels(np.zeros((0, 2)), move, np.zeros(0, bool))) == 0


def test_gradient_is_that_of_the_likelihood(rng=np.random.default_rng(5)):
    field = quality.Field()
    field.emit, field.move = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2))
    features = [rng.integers(0, 2, (n, len(quality.FEATURES))).astype(float) for n in (1, 4, 5)]
    labels, weight = [rng.integers(0, 2, len(f)) for f in features], np.array([0.5, 0.2, 0.3])

    def likelihood():
        total = 0.0
        for f, y, w in zip(features, labels, weight, strict=True):
            scores = f @ field.emit
            path = lambda z: sum(scores[k, z[k]] for k in range(len(z))) + sum(field.move[z[k], z[k + 1]] for k in range(len(z) - 1))  # noqa: B023, E731
            every = [path([m >> k & 1 for k in range(len(f))]) for m in range(1 << len(f))]
            total += w * (path(y) - np.logaddexp.reduce(every))
        return total

    grid, sizes = quality.padded(features)
    truth = np.zeros(grid.shape[:2], np.int64)
    for k, y in enumerate(labels):
        truth[k, : len(y)] = y
    steps = field.likelihood_steps(grid, sizes, truth, weight)
    for value, step in zip((field.emit, field.move), steps, strict=True):
        for at in np.ndindex(value.shape):
            value[at] += 1e-5
            up = likelihood()
            value[at] -= 2e-5
            down = likelihood()
            value[at] += 1e-5
            assert abs((up - down) / 2e-5 - step[at]) < 1e-6


def test_lines_of_one_document_get_labels_of_their_own(spark):
    """Boilerplate lines planted in good documents are found, other lines stay content, and the documents stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = docs.join(labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 1"), "doc_id").where("n_chars BETWEEN 1500 AND 6000 AND lang = 'en' AND size(split(text, '\n')) BETWEEN 6 AND 30").orderBy("doc_id").limit(40)
    junk = "home | news | help | log in | contact | terms\n$$$ %%% ### &&& ***"
    text = lambda d: d.text.split("\n")
    clean = [(d.doc_id, list(dict.fromkeys(text(d)))) for d in good.collect()]
    planted = [(i, "\n".join([*lines[:3], junk, *lines[3:]])) for i, lines in clean]
    train = labels.where("doc_id % 2 = 0")
    rows = [(i, t) for i, t in planted] + [(-1 - i, "\n".join(lines)) for i, lines in clean]
    field = quality.train(docs, train)
    batch = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    found = {r.doc_id: r for r in batch.mapInArrow(quality.judging(field), quality.SCHEMA).collect()}
    assert len(clean) >= 20
    for i, lines in clean:
        if found[-1 - i].n_content_lines == len([x for x in lines if words(x)]):
            assert found[i].n_content_lines == found[i].n_lines - 2 and found[i].kept and 0 < found[i].content_share < 1
    whole = sum(found[-1 - i].n_content_lines == found[-1 - i].n_lines for i, _ in clean)
    assert whole >= 0.9 * len(clean)
    share = quality.judge(docs, labels).agg(F.avg(F.expr("content_share > 0 AND content_share < 1").cast("double"))).first()[0]
    assert share > 0.05


def test_quality_tells_held_out_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    right = found.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def brute_groups(docs):
    """The smallest doc_id and text of each (doc_id, text)'s group."""

    def grams(text):
        w = words(text)
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:32]
    known = sorted({(d.doc_id, digest(d.text), d.text) for d in docs if d.doc_id is not None and d.text is not None})
    bags, group = [grams(t) for _, _, t in known], list(range(len(known)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (_, s, _) in enumerate(known):
        for j in range(k):
            g, h = bags[k], bags[j]
            common = sum((g & h).values())
            if s == known[j][1] or common and 5 * common >= 4 * (sum(g.values()) + sum(h.values()) - common):
                x, y = sorted((find(k), find(j)))
                group[y] = x
    return {(i, s): known[find(k)][:2] for k, (i, s, _) in enumerate(known)}


def test_near_copies(spark, messy):
    # Rows of one doc_id with other texts, apart and alike.
    extra = [(0, "quite another text of more than five words", "zz"), (5, "quite another text of more than five words", "zz"), (12, "a lonely text under a known number here", "zz")]
    docs = messy.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = brute_groups(docs.collect())
    for r in nearcopies.near_copies(docs).collect():
        least = want.get((r.doc_id, r.digest), (r.doc_id, r.digest))
        assert (r.component_id, r.kept) == (least[0], (r.doc_id, r.digest) == least)
    left = nearcopies.drop_near_copies(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    digest = lambda d: None if d.text is None else hashlib.sha256(d.text.encode()).hexdigest()[:32]
    kept = [(d.doc_id, digest(d)) for d in rows if d.doc_id is not None]
    every = {(d.doc_id, digest(d)) for d in docs.collect() if d.doc_id is not None}
    assert sorted(kept, key=str) == sorted((k for k in every if want.get(k, k) == k), key=str)
    assert sum(d.doc_id is None for d in rows) == 2


def test_bag_minhash_is_unbiased(rng=np.random.default_rng(2)):
    grams = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    owner = np.repeat([0, 1], 60)
    s = nearcopies.bag_minhash(owner, np.concatenate([grams, grams]), np.concatenate([a, b]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def brute_targets(sized):
    total = Counter()
    for s, n in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 3 * total[s]
        free -= set(over)
        left -= sum(3 * total[s] for s in over)
    return total, target


def test_mixing(messy):
    rows = mixing.mix_digest(messy).collect()
    docs = messy.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d.doc_id, d.source, len(words(d.text))) for d in docs)
    total, target = brute_targets([(d.source, len(words(d.text))) for d in docs])
    assert all(r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 for r in rows)
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_digest(messy).collect()))
    mixed = mixing.mix_documents(messy)
    assert mixed.columns == messy.columns
    assert sum(len(words(d.text)) for d in mixed.collect()) == sum(r.taken for r in rows)


def test_mixing_comes_near_its_targets(spark):
    rows = mixing.mix_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in rows.collect())


def test_empty_tables(no_docs):
    labels = no_docs.select("doc_id", F.lit(1).alias("quality"))
    made = [packing.pack_documents(no_docs, TOKENIZER), orc_tokens.token_files(no_docs, TOKENIZER), separators.token_counts(no_docs, TOKENIZER, SEPARATOR), licences.scan_licences(no_docs)]
    made += [substrings.digest_repeats(no_docs), quality.judge(no_docs, labels), nearcopies.near_copies(no_docs), mixing.mix_digest(no_docs), mixing.mix_documents(no_docs), nearcopies.drop_near_copies(no_docs)]
    for df in made:
        assert df.count() == 0
