"""Subtitle text rules as Column expressions (SB1-SB7, SC11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelframe.functions.labels import srt_seconds

DEFAULT_SECONDS = 3.0


def blocks(content: Column) -> Column:
    """Cue blocks: no byte-order mark, line feeds only, split at blank lines, trimmed."""
    text = F.replace(F.regexp_replace(content, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    return F.transform(F.split(text, "\n\n"), lambda b: F.btrim(b, F.lit(" \n\t\r")))


def block_cue(block: Column) -> Column:
    """(start, end, text) of a block of three lines or more whose second line is a pair of times; else null."""
    lines = F.split(block, "\n")
    times = F.transform(F.split(F.get(lines, F.lit(1)), "-->"), lambda t: F.btrim(t, F.lit(" \n\t\r")))
    start, end = srt_seconds(F.get(times, F.lit(0))), srt_seconds(F.get(times, F.lit(1)))
    text = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    good = (F.size(lines) >= 3) & (F.size(times) == 2) & start.isNotNull() & end.isNotNull() & (text != "")
    return F.when(good, F.struct(start.alias("start"), end.alias("end"), text.alias("text")))


def strip_tags(text: Column) -> Column:
    """Tags go, an unclosed one eats the rest, and stray ``>`` go too."""
    return F.btrim(F.replace(F.regexp_replace(text, "<[^>]*(>|$)", ""), F.lit(">"), F.lit("")), F.lit(" \n\t\r"))


def strip_tags_embedded(text: Column) -> Column:
    """As :func:`strip_tags`, but stray ``>`` stay."""
    return F.btrim(F.regexp_replace(text, "<[^>]*(>|$)", ""), F.lit(" \n\t\r"))


def outside_brackets(line: Column) -> Column:
    """Text outside ``[]`` and ``()``, whose depths are independent; unclosed ones eat the rest, stray closers vanish.

    Depth needs a fold, over brackets and the runs between them; lines without a bracket skip it.
    """

    def step(acc: Column, c: Column) -> Column:
        square = F.when(c == "[", acc["s"] + 1).when(c == "]", F.greatest(acc["s"] - 1, F.lit(0))).otherwise(acc["s"])
        paren = F.when(c == "(", acc["p"] + 1).when(c == ")", F.greatest(acc["p"] - 1, F.lit(0))).otherwise(acc["p"])
        plain = ~c.isin("[", "]", "(", ")") & (acc["s"] == 0) & (acc["p"] == 0)
        return F.struct(square.alias("s"), paren.alias("p"), F.when(plain, F.concat(acc["o"], c)).otherwise(acc["o"]).alias("o"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("p"), F.lit("").alias("o"))
    return F.when(line.rlike(r"[\[\]()]"), F.aggregate(F.regexp_extract_all(line, F.lit(r"[\[\]()]|[^\[\]()]+"), F.lit(0)), start, step, lambda acc: acc["o"])).otherwise(line)


def clean_line(line: Column) -> Column:
    """No sounds in brackets, no speaker label of capitals, no line of notes only (null)."""
    text = F.btrim(outside_brackets(line), F.lit(" \t\r"))
    text = F.btrim(F.regexp_replace(text, "^[A-Z -]+:", ""), F.lit(" \t\r"))
    return F.when(~text.rlike("^[♪♫#~ ]*$"), text)


def clean_sdh(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), clean_line), lambda x: x.isNotNull())
    return F.array_join(lines, "\n")


def unescape(text: Column) -> Column:
    """Entities to characters, ``&amp;`` last."""
    for name, c in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def ass_text(event: Column) -> Column:
    """The text field of an event line: ninth of the comma fields, else all of it; no style overrides."""
    fields = F.split(event, ",", 9)
    body = F.coalesce(F.get(fields, F.lit(8)), event)

    def step(acc: Column, c: Column) -> Column:
        depth = F.when(c == "{", acc["d"] + 1).when(c == "}", F.greatest(acc["d"] - 1, F.lit(0))).otherwise(acc["d"])
        # A closing brace that closes nothing is text.
        plain = (c != "{") & (acc["d"] == 0)
        return F.struct(depth.alias("d"), F.when(plain, F.concat(acc["o"], c)).otherwise(acc["o"]).alias("o"))

    folded = F.aggregate(F.regexp_extract_all(body, F.lit("[{}]|[^{}]+"), F.lit(0)), F.struct(F.lit(0).alias("d"), F.lit("").alias("o")), step, lambda acc: acc["o"])
    body = F.when(body.rlike("[{}]"), folded).otherwise(body)
    return F.replace(F.replace(F.replace(body, F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit(" "))


def cue_end(start: Column, duration: Column) -> Column:
    return start + F.coalesce(duration, F.lit(DEFAULT_SECONDS))


def vtt_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
