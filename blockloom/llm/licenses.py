"""Licence scans: passages of a text against licence templates by the Dice coefficient of word bigrams.

Passages are the lines, the paragraphs and the whole of a text. A passage of a bigrams can only reach
a coefficient t with a template of b if b*t/(2-t) <= a <= b*(2-t)/t, which prunes the candidates; and
it must hold all but (2-2t)/(2-t) of the template's bigrams, so a text that has none of a slightly
larger part of them is passed over after one scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, text_or_empty

LEAST_DICE = 0.8
#: Licence name and the wording of its notice (fixed values: public licence notices).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)

#: Further usual notices, for scans anywhere in a text (fixed values: public licence notices).
MORE_TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: Words that tell a licence from its siblings: a passage has those of the template, and no other.
TELLING = frozenset(("affero", "lesser", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike", "neither"))


def bigrams(normal: str) -> set[str]:
    """Distinct pairs of neighbouring words of a normalised text; a single word stands for itself."""
    words = normal.split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)


def normalise(text: str) -> str:
    """Lower-cased in ASCII; every run of anything but a-z, 0-9 becomes a space."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def numbers(words: set[str]) -> set[str]:
    return {w for w in words if w.isdigit()}


def tells(words: set[str], template: set[str]) -> bool:
    """Whether a passage has the numbers of the template (versions, counts of clauses) and its TELLING words."""
    return words & TELLING == template & TELLING and numbers(template) <= words


def must_have(templates: list[set[str]], t: float) -> str:
    """A pattern that every normalised text with a matching passage holds: bigrams of each template, too many to be missing."""
    wanted: set[str] = set()
    for grams in templates:
        missing = math.floor(len(grams) * (2 - 2 * t) / (2 - t) + 1e-9)
        wanted |= set(sorted(grams, key=lambda g: (-len(g), g))[: missing + 1])
    return r"\b(" + "|".join(sorted(wanted)) + r")\b"


def passages(text: str) -> Iterator[str]:
    yield from text.split("\n")
    yield from re.split(r"\n{2,}", text)
    yield text


def windows(text: str, known: list[tuple[str, set[str]]], least: float) -> Iterator[tuple[float, str, int, int]]:
    """dice, licence, first and last word: the best run of words from each start, where it reaches ``least``. Templates have two words at least.

    A run starts and ends with bigrams of the template, and tells() holds for it. The best holds its first bigram once, so a run goes on until its
    first bigram comes again or it has more bigrams than the template admits.
    """
    words = normalise(text).split()
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    places: dict[str, list[int]] = {}
    for i, pair in enumerate(pairs):
        places.setdefault(pair, []).append(i)
    for name, grams in known:
        most, own_words = (2 - least) / least * len(grams) + 1e-9, {w for g in grams for w in g.split()}
        for start in sorted(i for g in grams for i in places.get(g, ())):
            own, common, best = set(), 0, (0.0, start)
            for end in range(start, len(pairs)):
                pair = pairs[end]
                if pair in own:
                    if pair == pairs[start]:
                        break
                    continue
                own.add(pair)
                if len(own) > most:
                    break
                if pair in grams:
                    common += 1
                    dice = 2 * common / (len(own) + len(grams))
                    if dice >= least - 1e-9 and dice > best[0] and tells(set(words[start : end + 2]), own_words):
                        best = (dice, end)
            if best[0]:
                yield best[0], name, start, best[1] + 1


def find_anywhere(text: str, known: list[tuple[str, set[str]]], least: float) -> dict[str, tuple[float, str]]:
    """Licence: dice and passage of its best run of words. Where runs overlap, only the licence counts that has most of the words, weighed by dice."""
    found = sorted(windows(text, known, least), key=lambda x: (-x[0] * (x[3] - x[2]), x))
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", text)] if found else []
    owner: dict[int, tuple[float, str]] = {}
    best: dict[str, tuple[float, str]] = {}
    for dice, name, first, last in found:
        weight = dice * (last - first)
        if any(at[0] > weight and at[1] != name for i in range(first, last + 1) if (at := owner.get(i))):
            continue
        for i in range(first, last + 1):
            owner.setdefault(i, (weight, name))
        passage = text[spans[first][0] : spans[last][1]]
        old = best.get(name, (0.0, ""))
        if dice > old[0] or (dice == old[0] and passage < old[1]):
            best[name] = (dice, passage)
    return best


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_DICE, anywhere: bool = False) -> DataFrame:
    """Returns id, license, dice, passage: a row per row and licence found, with its best passage.

    Passages are lines, paragraphs and the whole text; with ``anywhere`` all runs of words. A passage counts for the
    licences that it is most like, of those whose numbers and TELLING words it has.

    Null and empty texts hold no licence. Of equally good passages the first in the alphabet is given.
    Rows with equal or null ids are scanned on their own. Other columns are ignored.
    """
    known = [(name, bigrams(normalise(text))) for name, text in templates]
    words_of = [set(normalise(text).split()) for _, text in templates]
    pattern = must_have([g for _, g in known], least)
    low, high = least / (2 - least), (2 - least) / least
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("passage", T.StringType())])

    def find(text: str) -> dict[str, tuple[float, str]]:
        best: dict[str, tuple[float, str]] = {}
        for passage in dict.fromkeys(passages(text)):
            normal = normalise(passage)
            size = normal.count(" ") + 1  # no fewer than its bigrams
            if all(size < low * len(g) for _, g in known):
                continue
            own, found = bigrams(normal), []
            for at, (name, grams) in enumerate(known):
                if low * len(grams) - 1e-9 <= len(own) <= high * len(grams) + 1e-9:
                    common = len(own & grams)
                    dice = 2 * common / (len(own) + len(grams))
                    if 2 * common >= least * (len(own) + len(grams)) - 1e-9 and tells(set(normal.split()), words_of[at]):
                        found.append((dice, name))
            top = max(found, default=(0.0, ""))[0]
            for dice, name in found:
                old = best.get(name, (0.0, ""))
                if dice == top and (dice > old[0] or (dice == old[0] and passage.strip() < old[1])):
                    best[name] = (dice, passage.strip())
        return best

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            normal = pc.replace_substring_regex(pc.ascii_lower(text), r"[^a-z0-9]+", " ")
            some = batch.filter(pc.match_substring_regex(normal, pattern))
            rows = [(i, name, dice, passage) for i, t in enumerate(some.column("text").to_pylist()) for name, (dice, passage) in sorted((find_anywhere(t, known, least) if anywhere else find(t)).items())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [some.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string())], names=schema.names
            )

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(apply, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op8_license_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of all templates in any run of words, also within lines."""
    return scan(table(spark, sf_dir, "documents"), TEMPLATES + MORE_TEMPLATES, anywhere=True).withColumn("dice", F.round("dice", 6))


def _sql() -> str:
    quoted = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES)
    grams = r"""CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"""
    words = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    telling = "list_sort(list_distinct(list_filter({0}, lambda x: x IN (" + ", ".join(f"'{w}'" for w in sorted(TELLING)) + "))))"
    return rf"""
        WITH p AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS passage FROM documents
            UNION SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n{{2,}}')) FROM documents
            UNION SELECT doc_id, coalesce(text, '') FROM documents),
        a AS (SELECT doc_id, passage, {words.format("passage")} AS w FROM p),
        b AS (SELECT doc_id, passage, {grams} AS own, w FROM a WHERE len(w) BETWEEN 1 AND 400),
        t AS (SELECT license, {grams} AS grams, list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')) AS nums, {telling.format("w")} AS tells
              FROM (SELECT license, {words.format("notice")} AS w FROM (VALUES {quoted}) AS v(license, notice))),
        m AS (SELECT doc_id, license, passage AS whole, trim(passage, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS passage, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM b, t
              WHERE len(own) BETWEEN len(grams) * 0.6666 AND len(grams) * 1.5001 AND {telling.format("w")} = tells AND len(list_filter(nums, lambda x: NOT list_contains(w, x))) = 0),
        f AS (SELECT *, dice = max(dice) OVER (PARTITION BY doc_id, whole) AS top FROM m WHERE dice >= 0.8 - 1e-9)
        SELECT doc_id, license, round(max(dice), 6) AS dice, arg_min(passage, {{'d': -dice, 'p': passage}}) AS passage
        FROM f WHERE top GROUP BY doc_id, license"""


SQL = {"op8_license_scan": _sql()}
QUERIES = {"op8_license_scan": op8_license_scan, "op8_license_anywhere": op8_license_anywhere}
