"""Subtitle queries over whole messages against plain Python."""

import re

import pytest

from reelframe.plans import registry

TEXTS = [
    "one",
    "x" * 60 + " [late {brace} <b>tag</b>] MAN: tail (gone) kept, with, commas",
    "first line, " + "y" * 50 + "\nWOMAN: second [bang] line\n♪ ♪\nlast (open",
    "past { every } limit {nested {deep} still} out }} end\n\na blank line before \U0001f600 [\U0001f600] <i>x",
    "z [" * 300 + "] )" * 299 + " (a) end",
    "open { to the end",
    "",
]


def outside(text, pairs):
    depths, kept = dict.fromkeys(pairs, 0), ""
    for c in text:
        for p in pairs:
            depths[p] = depths[p] + 1 if c == p[0] else max(depths[p] - 1, 0) if c == p[1] else depths[p]
        if c not in "".join(pairs) and not any(depths.values()):
            kept += c
    return kept


def overrides(text):
    """Without what stands in braces; a closing brace that closes nothing stays."""
    depth, kept = 0, ""
    for c in text:
        if c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
        elif not depth:
            kept += c
    return kept


def sdh(text):
    lines = [re.sub("^[A-Z -]+:", "", outside(x, ["[]", "()"]).strip(" \t\r")).strip(" \t\r") for x in text.split("\n")]
    return "\n".join(x for x in lines if not re.fullmatch("[♪♫#~ ]*", x))


def untagged(text):
    return re.sub("<[^>]*(>|$)", "", text).replace(">", "").strip(" \n\t\r")


def cues(text, turn):
    lines = ("WOMAN: [sighs] " + text.replace("\n", "\n\0(door (closes)) ")).split("\n\0")
    blocks = [(1.0, 2.5 + turn % 7, f"<i>{text}</i>".split("\n\n")[0])]
    for k, line in enumerate(lines):
        blocks.append((60.0 * (turn % 10) + (8.25 if k else 5.25), 600.0 + 60 * (turn % 10) + (9.8 if k else 7.8), line.strip(" \n\t\r")))
    found = [(round(a, 6), round(b, 6), sdh(untagged(x))) for a, b, x in blocks]
    return [(k, *x) for k, x in enumerate(x for x in found if x[2])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, k, "user", t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def rows(spark, name, tables):
    return registry.queries()[name](spark, tables).collect()


def test_sdh(spark, tables):
    found = {r.turn: r.text for r in rows(spark, "sdh_clean_whole", tables)}
    assert found == {k: sdh(f"JOHN DOE: {t} (sighs) [door\n♪ ~ ♪\nMAN: ] {t}[a (b] c) d") for k, t in enumerate(TEXTS)}


def test_events(spark, tables):
    found = {r.turn: (r.text, r.end) for r in rows(spark, "ass_text_whole", tables)}
    assert found == {k: (overrides(t + ", a\\Nb\\hc").replace("\\N", "\n").replace("\\h", " "), k + (1.5 if k % 2 else 3.0)) for k, t in enumerate(TEXTS)}


def test_cues(spark, tables):
    found = sorted((r.turn, r.idx, r.start, r.end, r.text) for r in rows(spark, "cue_explode_whole", tables))
    assert found == [(k, *c) for k, t in enumerate(TEXTS) for c in cues(t, k)]
