"""License scans by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import spool, table

#: Share of a template's distinct tokens that a block must hold.
THRESHOLD = Fraction(4, 5)
#: Words of a wrapped notice, at most, as a multiple of the template's: room for marks of comments.
LOOSE = Fraction(3, 2)
#: Notices and characteristic sentences of public licenses.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def tokens_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def scan_blocks(docs: DataFrame, templates: Mapping[str, str] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, block (line number from 0), template, overlap, containment for every line of every text that holds at least
    threshold of a template's distinct tokens (runs of a-z and 0-9, lower case). Exact.

    Tokens are ordered by their frequency over all blocks, rarest first. A block is a
    candidate of a template only where a token of the template's prefix is in the block's
    prefix (prefix filter), the block has enough tokens (length filter), and enough may
    follow the first common token in both (positional filter); then the overlap is counted.
    Tokens outside all templates can't add to an overlap and are left out beforehand.
    Null and empty texts have no blocks that match; repeated rows count once; a template
    without tokens matches nothing.
    """
    sets = {t: tokens_of(x) for t, x in (TEMPLATES if templates is None else templates).items()}
    sets = {t: x for t, x in sets.items() if x}
    need = {t: math.ceil(threshold * len(x)) for t, x in sets.items()}
    vocabulary = sorted({w for x in sets.values() for w in x})
    least = min(need.values(), default=1)
    words = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    blocks = spool(
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
        .select("doc_id", "block", F.array_intersect(F.split(F.lower("line"), "[^a-z0-9]+"), words).alias("tokens"))
        .filter(F.size("tokens") > 0),
        "blocks",
    )
    counts = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()  # as many rows as the templates have tokens
    seen = {r["token"]: r["count"] for r in counts}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    ranked = {t: sorted(order[w] for w in x) for t, x in sets.items()}
    first = {t: r[: len(r) - need[t] + 1] for t, r in ranked.items()}
    by_rank = sorted(order, key=order.get)
    prefix_words = F.array(*[F.lit(by_rank[i]) for i in sorted({i for p in first.values() for i in p})]).cast("array<string>")
    spark = docs.sparkSession
    index = spark.createDataFrame(
        [(i, pos, t, len(ranked[t]), need[t], ranked[t]) for t, p in first.items() for pos, i in enumerate(p)],
        "rank int, i int, template string, size int, need int, ranks array<int>",
    )
    ranks = F.map_from_arrays(F.array(*[F.lit(w) for w in by_rank]).cast("array<string>"), F.sequence(F.lit(0), F.lit(len(by_rank) - 1))) if by_rank else F.create_map().cast("map<string,int>")
    sized = (
        blocks.filter((F.size("tokens") >= least) & F.arrays_overlap("tokens", prefix_words))
        .withColumn("b", F.array_sort(F.transform("tokens", lambda w: F.element_at(ranks, w))))
        .select("doc_id", "block", "b", F.posexplode("b").alias("j", "rank"))
    )
    size = F.size("b")
    # The index is a function of the templates alone, never of the data, and has some rows for each.
    pairs = (
        sized.join(F.broadcast(index), "rank")
        .filter((size >= F.col("need")) & (F.col("j") <= size - F.col("need")))
        .groupBy("doc_id", "block", "b", "template", "size", "need", "ranks")
        .agg(F.min("i").alias("i"), F.min("j").alias("j"))
        .filter(F.least(F.col("size") - F.col("i"), size - F.col("j")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("b", "ranks"))
    return (
        pairs.withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("need"))
        .select("doc_id", "block", "template", "overlap", (F.col("overlap") / F.col("size")).alias("containment"))
    )


def _wrapped(text: str, template: list[str], tokens: set[str], need: int, most: int) -> list[tuple[int, int]]:
    """(first line, overlap) of the passages over several lines of a lower-case text; those of the greatest overlap first, then with most of the template's pairs of words, then the shortest; disjoint."""
    follow = set(zip(template, template[1:]))
    words, line = [], []
    for b, row in enumerate(text.split("\n")):
        found = re.findall(r"[a-z0-9]+", row)
        # A line that matches alone is a block of scan_blocks, and no part of a passage.
        words += [None] if len(tokens.intersection(found)) >= need else found
        line += [b] * (len(words) - len(line))
    at = [i for i, w in enumerate(words) if w in tokens or w is None]
    found = []
    for n, i in enumerate(at):
        if words[i] is None or n + need > len(at) or at[n + need - 1] - i >= most:
            continue
        seen: set[str] = set()
        pairs: set[tuple[str, str]] = set()
        last = i
        for j in at[n:]:
            if j - i >= most or words[j] is None:
                break
            pair = (words[j - 1], words[j])
            paired = j > i and pair in follow and pair not in pairs
            if paired:
                pairs.add(pair)
            if paired or words[j] not in seen:
                seen.add(words[j])
                last = j
        # Half of the pairs in order: words of neighbouring sentences are no notice.
        if len(seen) >= need and 2 * len(pairs) >= len(follow) and line[last] > line[i]:
            found.append((-len(seen), -len(pairs), last - i, i, last))
    taken: list[tuple[int, int]] = []
    out = []
    for o, _, _, i, j in sorted(found):
        if all(j < a or i > b for a, b in taken):
            # Words that the passage repeats belong to it, as far as the template is long.
            while i and words[i - 1] in tokens and j - i + 1 < len(template) and all(i - 1 > b or j < a for a, b in taken):
                i -= 1
            taken.append((i, j))
            out.append((line[i], -o))
    return out


def scan_wrapped(docs: DataFrame, templates: Mapping[str, str] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, block, template, overlap, containment of the notices that are wrapped over lines, block being the first line.

    A notice is a passage over several lines that holds at least threshold of a template's
    distinct tokens in at most LOOSE times the template's words, with half of its pairs of
    words or more. Lines that match alone are
    left to scan_blocks. Only texts that hold enough of a template's tokens at all are searched.
    """
    given = TEMPLATES if templates is None else templates
    plan = []
    for t, x in given.items():
        if tokens := tokens_of(x):
            ordered = re.findall(r"[a-z0-9]+", x.lower())
            plan.append((t, ordered, set(tokens), math.ceil(threshold * len(tokens)), math.ceil(LOOSE * len(ordered))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, held) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                held = set(held)
                for t, ordered, tokens, need, most in plan:
                    if len(held & tokens) >= need:
                        rows += [(i, b, t, o, o / len(tokens)) for b, o in _wrapped(text, ordered, tokens, need, most)]
            i, b, t, o, c = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(b, pa.int32()), pa.array(t, pa.string()), pa.array(o, pa.int32()), pa.array(c, pa.float64())], ["doc_id", "block", "template", "overlap", "containment"])

    words = F.array(*[F.lit(w) for w in sorted({w for _, _, x, *_ in plan for w in x})]).cast("array<string>")
    lower = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.lower("text").alias("text"))
    # Explode computes the tokens once; a projection would be repeated for each template.
    held = lower.select("doc_id", "text", F.explode(F.array(F.array_intersect(F.split("text", "[^a-z0-9]+"), words))).alias("held"))
    enough = F.lit(False)
    for _, _, x, need, _ in plan:
        enough = enough | (F.size(F.array_intersect("held", F.array(*[F.lit(w) for w in sorted(x)]))) >= need)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.filter(enough).mapInArrow(run, f"doc_id {kind}, block int, template string, overlap int, containment double").distinct()


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that match a template, as in OP5_SQL, and the notices that are wrapped over lines."""
    docs = table(spark, sf_dir, "documents")
    return scan_blocks(docs).unionByName(scan_wrapped(docs))


def _sql() -> str:
    rows = ", ".join(f"('{t}', {tokens_of(x)!r})" for t, x in TEMPLATES.items())
    return f"""
WITH templates(template, ranks) AS (VALUES {rows}),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
blocks AS (SELECT doc_id, unnest(range(0, len(ls)))::INT AS block, unnest(ls) AS line FROM lines),
sets AS (SELECT doc_id, block, regexp_extract_all(lower(line), '[a-z0-9]+') AS tokens FROM blocks),
pairs AS (SELECT doc_id, block, template, len(list_intersect(list_distinct(tokens), ranks))::INT AS overlap, len(ranks) AS size FROM sets, templates)
SELECT DISTINCT doc_id, block, template, overlap, overlap / size AS containment FROM pairs WHERE overlap * {THRESHOLD.denominator} >= size * {THRESHOLD.numerator}
"""


OP5_SQL = _sql()
