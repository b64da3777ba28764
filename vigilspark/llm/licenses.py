"""License scans: Dice coefficient over word bigrams against licence templates, DataFrame functions only.

A text's units are its lines and, with more than one line, the whole text.  A unit is normalised (lower
case, every run of other characters than letters and digits one space) and compared by its set of word
bigrams: ``dice = 2 * common / (own + template's)``.  For a threshold t the sizes bound the match:
own bigrams lie between t / (2 - t) and (2 - t) / t times the template's.  The word count bounds the
bigrams from above and the distinct words, less one, from below, so most units leave before any
bigram is made; the rest need enough bigrams in common with all templates together before they are
compared with each.  Everything happens within a row: no shuffle, no join, no Python.

A licence that no line and no whole text gives is looked for in passages: runs of consecutive lines and
sentences, for templates over ``LONG_GRAMS`` bigrams runs of paragraphs (of lines, where no line is blank),
whose words lie in the template's size bounds.  Its best passage is one more unit, counted after the lines.
A passage's bigrams are among the text's, so only texts with enough of a template's bigrams are cut up.
Whole licence texts (``license_texts``) are templates of passages; the whole text is tried first.

Null and empty texts have no match.  On equal dice the first unit, then the first template in order wins.
Templates are a driver-side list whose bigrams travel in the plan, a batch of ``MAX_TEMPLATE_GRAMS`` after
another, each a projection of its own; their number changes the time, not the results.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column_name

THRESHOLD_PERCENT = 80
MAX_TEMPLATE_GRAMS = 20_000
LONG_GRAMS = 400

#: Public licence notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def template_grams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


@cache
def full_texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX identifier."""
    return [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def telling_words(grams: list[str], percent: int) -> list[str]:
    """Words of a template of which every text with enough of its bigrams has one."""
    spare, words, left = len(grams) * (200 - 2 * percent) // (200 - percent), [], [g.split() for g in grams]
    gone = 0
    for word in sorted({w for g in left for w in g}, key=lambda w: (-len(w), w)):
        if gone > spare:
            break
        rest = [g for g in left if word not in g]
        gone, left = gone + len(left) - len(rest), rest
        words.append(word)
    return words


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _strings(items: list[str]) -> Column:
    """An array literal, sent as one string."""
    return F.split(F.lit("\n".join(items)), "\n")


def _pairs(words: Column) -> Column:
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.concat(a, F.lit(" "), b))


def batches_of(templates: list[tuple[int, str, str]]) -> list[list[tuple[int, str, str]]]:
    """Templates (place, name, text) in batches of MAX_TEMPLATE_GRAMS bigrams; a larger one is a batch of its own."""
    out, size = [], MAX_TEMPLATE_GRAMS
    for one in templates:
        grams = len(template_grams(one[2]))
        if not out or size + grams > MAX_TEMPLATE_GRAMS:
            out.append([])
            size = 0
        out[-1].append(one)
        size += grams
    return out


def best_of_each(found: Column) -> Column:
    """One match a licence: the best, then the first template's."""
    return _let(found, lambda every: F.filter(every, lambda m: ~F.exists(every, lambda o: (o.license == m.license) & ((o.dice > m.dice) | (o.dice == m.dice) & (o.order < m.order)))))


def passage_matches(matches: Column, templates: list[tuple[int, str, str]], percent: int) -> Column:
    """The best passage of each licence that ``matches`` doesn't have, as matches; templates with their places."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    words_of = lambda part: F.filter(F.split(F.regexp_replace(part, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    none = F.array().cast("array<struct<unit:int,order:int,license:string,dice:double>>")
    first = F.size(F.split(text, "\n")) + 1
    by_kind: dict[bool, list] = {False: [], True: []}
    for i, name, template in templates:
        if own := template_grams(template):
            by_kind[len(own) > LONG_GRAMS].append((i, name, own))

    def best_passage(k, grams, parts):
        dice = lambda own: 2.0 * F.size(F.array_intersect(own, k.grams)) / (F.size(own) + F.size(k.grams))

        least = F.ceil(F.size(k.grams) * percent / F.lit(200 - percent)).cast("int")
        most = F.floor(F.size(k.grams) * (200 - percent) / F.lit(percent)).cast("int")

        def best_run(d):
            # Of the runs with dice enough the best begins with a segment that has one of the bigrams: without a
            # first segment that has none it would be better, and still long enough.  It ends within the size bounds.
            starts = F.filter(F.transform(d.cuts, lambda a, s: F.struct(a.alias("a"), F.get(d.cuts, s + 1).alias("next"))),
                              lambda x: F.arrays_overlap(F.slice(d.pairs, x.a + 1, x.next - x.a), k.grams))

            def ends(a):
                low, high = a + 1 + least, a + 1 + most
                first = F.when(low == d.n, F.size(d.cuts) - 1).otherwise(F.get(d.of, low) + (F.get(d.cuts, F.get(d.of, low)) < low).cast("int"))
                last = F.when(high >= d.n, F.size(d.cuts) - 1).otherwise(F.get(d.of, high))
                return F.when(low <= d.n, F.slice(d.cuts, first + 1, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

            return F.array_max(F.flatten(F.transform(starts, lambda x: F.transform(ends(x.a), lambda b: dice(F.array_distinct(F.slice(d.pairs, x.a + 1, b - x.a - 1)))))))

        def runs(segments):
            # Words with their segment; cuts are the segments' first words and the end, and runs lie between two cuts.
            marked = F.flatten(F.transform(segments, lambda ws, s: F.transform(ws, lambda w, i: F.struct(w.alias("w"), s.alias("s"), (i == 0).alias("head")))))
            return _let(marked, lambda m: _let(F.struct(
                _pairs(F.transform(m, lambda x: x.w)).alias("pairs"), F.transform(m, lambda x: x.s).alias("of"), F.size(m).alias("n"),
                F.concat(F.filter(F.transform(m, lambda x, i: F.when(x.head, i)), lambda i: i.isNotNull()), F.array(F.size(m))).alias("cuts")), best_run))

        whole = dice(grams)
        return F.when(100 * whole >= percent, whole).otherwise(runs(parts))

    def among(known, parts):
        array = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(name).alias("license"), _strings(own).alias("grams")) for i, name, own in known))
        least = min(len(own) for *_, own in known)
        enough = lambda n, of: n * (200 - percent) >= of * percent
        telling = _strings(sorted({w for *_, own in known for w in telling_words(own, percent)}))

        def search(words):
            return _let(F.array_distinct(_pairs(words)), lambda grams: F.filter(F.transform(
                F.filter(array, lambda k: ~F.exists(matches, lambda m: m.license == k.license) & enough(F.size(F.array_intersect(grams, k.grams)), F.size(k.grams))),
                lambda k: F.struct((first + k.order).cast("int").alias("unit"), k.order.alias("order"), k.license.alias("license"), best_passage(k, grams, parts).cast("double").alias("dice"))),
                lambda m: 100 * m.dice >= percent))

        return _let(words_of(text), lambda words: F.when(
            enough(F.size(words) - 1, F.lit(least)) & (F.size(F.array_intersect(words, telling)) > 0), search(words)).otherwise(none))

    # Sentences end at a full stop and white space; paragraphs at blank lines.
    full = lambda parts: F.filter(F.transform(parts, words_of), lambda ws: F.size(ws) > 0)
    fine = full(F.split(text, r"(?<=[.!?;:])\s+|\n"))
    coarse = full(F.when(text.rlike(r"\n\s*\n"), F.split(text, r"\n\s*\n")).otherwise(F.split(text, "\n")))
    return best_of_each(F.concat(*(among(known, parts) for known, parts in ((by_kind[False], fine), (by_kind[True], coarse)) if known)))


def unit_matches(templates: list[tuple[int, str, str]], percent: int) -> Column:
    """Matches of the lines and of the whole text; templates with their places, each of a bigram at least."""
    grams = [(i, name, template_grams(text)) for i, name, text in templates]
    sizes = [len(g[2]) for g in grams]
    least, most = min(sizes), max(sizes)
    array = lambda items: F.array(*(F.lit(x) for x in items))
    every = array(sorted({x for g in grams for x in g[2]}))
    known = F.array(*(F.struct(F.lit(i).alias("order"), F.lit(name).alias("license"), array(own).alias("grams")) for i, name, own in grams))
    clean = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split(clean, "\n")
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("unit"), F.split(F.trim(F.regexp_replace(clean, r"[ \n]+", " ")), " ").alias("words")))).otherwise(
        F.array().cast("array<struct<unit:int,words:array<string>>>"))
    units = F.concat(whole, F.transform(lines, lambda line, i: F.struct((i + 1).alias("unit"), F.split(F.trim(line), " ").alias("words"))))
    # own * (200 - percent) >= least * percent and own * percent <= most * (200 - percent)
    sized = F.filter(units, lambda u: ((F.size(u.words) - 1) * (200 - percent) >= least * percent)
                     & ((F.size(F.array_distinct(u.words)) - 1) * percent <= most * (200 - percent)))
    paired = F.transform(sized, lambda u: F.struct(u.unit.alias("unit"), F.array_distinct(F.zip_with(
        F.slice(u.words, 1, F.size(u.words) - 1), F.slice(u.words, 2, F.size(u.words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("grams")))
    close = F.filter(paired, lambda u: 200 * F.size(F.array_intersect(u.grams, every)) >= percent * (F.size(u.grams) + least))
    scored = F.flatten(F.transform(close, lambda u: F.transform(
        F.filter(known, lambda k: (F.size(u.grams) * (200 - percent) >= F.size(k.grams) * percent) & (F.size(u.grams) * percent <= F.size(k.grams) * (200 - percent))),
        lambda k: F.struct(u.unit.alias("unit"), k.order.alias("order"), k.license.alias("license"),
                           (2.0 * F.size(F.array_intersect(u.grams, k.grams)) / (F.size(u.grams) + F.size(k.grams))).alias("dice")))))
    return F.filter(scored, lambda m: 100 * m.dice >= percent)


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` (text, ...) with matches: array of (unit, license, dice), units counted from 1 by line, 0 the whole text, passages after the lines."""
    given = [(i, name, text) for i, (name, text) in enumerate([*(templates or TEMPLATES), *(full_texts() if templates is None else [])]) if template_grams(text)]
    # Whole licence texts are templates of passages only.
    lines, passages = batches_of([g for g in given if g[0] < len(templates or TEMPLATES)]), batches_of(given)
    if not lines:
        raise ValueError("no template has two words")
    mark, more = column_name(docs, "matches"), column_name(docs, "passages")
    # Columns of their own, so that nothing is computed twice.
    found = docs.withColumn(mark, unit_matches(lines[0], percent))
    for batch in lines[1:]:
        found = found.withColumn(mark, F.concat(mark, unit_matches(batch, percent)))
    found = found.withColumn(more, passage_matches(F.col(mark), passages[0], percent))
    for batch in passages[1:]:
        found = found.withColumn(more, F.concat(more, passage_matches(F.col(mark), batch, percent)))
    best = F.col(more) if len(passages) == 1 else best_of_each(F.col(more))
    return found.withColumn(mark, F.concat(mark, best)).drop(more)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, license, dice, n_matched_units, licenses) for each row; license and dice are null without a match."""
    matched = license_matches(docs.select("doc_id", "text"), templates, percent)
    # Largest dice first, then first unit, then first template.
    best = F.array_max(F.transform("matches", lambda m: F.struct(m.dice.alias("dice"), (-m.unit).alias("u"), (-m.order).alias("o"), m.license.alias("license"))))
    return matched.select(
        "doc_id", best.license.alias("license"), F.round(best.dice, 6).alias("dice"),
        F.size(F.array_distinct(F.transform("matches", lambda m: m.unit))).cast("long").alias("n_matched_units"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license))), ",").alias("licenses"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(templates: list[tuple[str, str]], percent: int) -> str:
    rows = ", ".join("({}, '{}', [{}])".format(i, name, ", ".join(f"'{g}'" for g in template_grams(text))) for i, (name, text) in enumerate(templates))
    return f"""
WITH templates(ord, license, grams) AS (VALUES {rows}),
clean AS (SELECT doc_id, rowid AS r, string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)) AS lines
          FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
units AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS unit FROM clean
          UNION ALL SELECT r, array_to_string(lines, ' '), 0 FROM clean WHERE len(lines) > 1),
worded AS (SELECT r, unit, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM units),
paired AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM worded WHERE len(w) > 1),
scored AS (SELECT r, unit, ord, license, 2.0 * len(list_intersect(paired.grams, templates.grams)) / (len(paired.grams) + len(templates.grams)) AS dice
           FROM paired JOIN templates ON len(paired.grams) * {200 - percent} >= len(templates.grams) * {percent} AND len(paired.grams) * {percent} <= len(templates.grams) * {200 - percent}),
matched AS (SELECT * FROM scored WHERE 100 * dice >= {percent}),
best AS (SELECT r, first(license ORDER BY dice DESC, unit, ord) AS license, round(max(dice), 6) AS dice, count(DISTINCT unit) AS n,
                array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses FROM matched GROUP BY r)
SELECT doc_id, license, dice, coalesce(n, 0) AS n_matched_units, coalesce(licenses, '') AS licenses FROM clean LEFT JOIN best USING (r)
"""


ORACLE_SQL = _oracle(TEMPLATES, THRESHOLD_PERCENT)
