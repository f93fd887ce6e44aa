"""Licence scans: normalised lines and texts compared to licence templates by Dice coefficient over word bigrams.

Text is normalised to lower-case ASCII words. Each line of a document, and the whole document if it has several lines,
is compared to the templates whose size allows the threshold: 2 * shared / (a + b) is at most 2 * min(a, b) / (a + b), so
a unit of a bigrams needs templates between a * t / (2 - t) and a * (2 - t) / t. Units that no template allows are
dropped, and so are, before their bigrams are made, texts and lines without any of a few words of which every similar
unit must hold one. Built-in functions only, no shuffle; templates are a few constants.

Licence text that spans lines or stands inside one is found by passages(): windows of a template's length in words.

Null and empty texts, and units without a bigram, match nothing. Rows are scanned one by one: repeated ids give repeated
rows, null ids are kept; texts are scanned whole, however long. Other columns are not read, whatever their names, and an empty table
gives an empty result. Of several templates of a unit the best wins, of equally good ones the first by name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices by which licences are named, and the first paragraph of one.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# Whole licence texts, for passages() alone: the SQL of op7_license_scans is made of the templates above.
TEXTS = {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
THRESHOLD = 0.8
WHOLE = -1


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, in order."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))  # noqa: B905  pairs of neighbours


def _bounds(n: int, threshold: float) -> tuple[float, float]:
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def probes(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit similar enough to a template holds one.

    Such a unit shares at least s = a * t / (2 - t) of the template's a bigrams, so of any a - s + 1 of them one is in the
    unit, and with it the longer of its words. Those with the longest words are taken.
    """
    out = set()
    for own in templates:
        least = math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)
        longest = sorted((max(b.split(" "), key=len) for b in own), key=lambda w: (-len(w), w))
        out.update(longest[: len(own) - least + 1])
    return sorted(w for w in out if not any(v != w and v in w for v in out))


def _one(value: Column, keep) -> Column:
    """A generator of value, or of nothing: unlike a filter after it, it has the value computed once."""
    return F.explode(F.filter(F.array(value), keep))


def _words(text: Column) -> Column:
    return F.split(F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def _pairs(words: Column) -> Column:
    before, after = (F.slice(words, F.lit(k), F.greatest(F.size(words) - 1, F.lit(0))) for k in (1, 2))
    return F.zip_with(before, after, lambda a, b: F.concat(a, F.lit(" "), b))


def _dice(pairs: Column, own: list[str]) -> Column:
    return 2.0 * F.size(F.array_intersect(pairs, F.array(*map(F.lit, own)))) / (F.size(F.array_distinct(pairs)) + len(own))


def passages(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, texts: Mapping[str, str] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (in which it starts, from 0), licence, dice: similar windows of words that scan() has no unit for.

    A window is as long as its template (or ends with the text) and starts with one of its bigrams. Of windows that
    overlap, the one of the largest template is taken, then the most similar, then the first. Those of a licence that the
    whole text or one of their lines is similar to as a unit are left out, and so are those inside a similar line.
    """
    windowed = {**templates, **texts}
    known = {name: bigrams(text) for name, text in sorted(windowed.items())}
    length = {name: len(re.findall("[A-Za-z0-9]+", windowed[name])) - 1 for name in known}
    least = {name: math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) for name, b in known.items()}
    every = F.array(*map(F.lit, sorted({x for b in known.values() for x in b})))
    wanted = probes(list(known.values()), threshold)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = named.select("doc_id", "text", _one(F.lower("text"), lambda t: reduce(lambda x, y: x | y, [F.contains(t, F.lit(w)) for w in wanted])).alias("low"))
    split = named.select("doc_id", "text", _one(_words(F.col("text")), lambda w: F.size(w) > 1).alias("w"))
    paired = split.select("doc_id", "text", _one(_pairs(F.col("w")), lambda p: F.size(p) > 0).alias("p"))

    def enough(name: str) -> Column:
        return F.size(F.array_intersect("h", F.array(*map(F.lit, known[name])))) >= least[name]

    hit = paired.select("doc_id", "text", "p", _one(F.array_intersect("p", every), lambda h: F.size(h) >= min(least.values())).alias("h"))
    hit = hit.where(reduce(lambda x, y: x | y, map(enough, known)))

    def windows(name: str, own: list[str]) -> Column:
        mine = F.array(*map(F.lit, own))
        starts = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.array_contains(mine, F.get("p", i)))
        each = F.transform(starts, lambda i: F.struct(
            F.lit(-len(own)).alias("order"), (-_dice(F.slice("p", i + 1, F.lit(length[name])), own)).alias("less"), i.alias("start"),
            F.least(i + length[name], F.size("p")).alias("end"), F.lit(name).alias("licence")))
        similar = F.filter(each, lambda x: -x["less"] >= threshold - 1e-9)
        return F.when(enough(name), similar).otherwise(F.slice(similar, 1, 0))

    found = hit.select("doc_id", "text", _one(F.array_sort(F.concat(*[windows(*x) for x in known.items()])), lambda a: F.size(a) > 0).alias("all"))
    taken = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda k: (k["start"] <= x["end"]) & (x["start"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(x))))

    def line_of(word: Column) -> Column:
        """The line that holds the word of this number: as many as end before it."""
        none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("line"))
        return F.aggregate("sizes", none, lambda a, n: F.struct((a["words"] + n).alias("words"), (a["line"] + (a["words"] + n <= word).cast("int")).alias("line")))["line"]

    lines = F.split("text", "\n")
    sizes = F.transform(lines, lambda t: F.size(F.filter(_words(t), lambda w: w != "")))
    one = found.select("doc_id", "text", lines.alias("lines"), sizes.alias("sizes"), F.explode(taken).alias("x"))
    one = one.select("doc_id", "text", "lines", "x.licence", (-F.col("x.less")).alias("dice"), line_of(F.col("x.start")).alias("line"), line_of(F.col("x.end")).alias("last"))

    def licence(text: Column) -> Column:
        """What scan() gives for a unit; "" for nothing."""
        dices = [F.struct(_dice(_pairs(_words(text)), own).alias("dice"), F.lit(-i).alias("order"), F.lit(name).alias("licence")) for i, (name, own) in enumerate(known.items()) if name in templates]
        best = F.array_max(F.array(*dices))
        return F.when(best["dice"] >= threshold - 1e-9, best["licence"]).otherwise("")

    units = F.transform(F.slice("lines", F.col("line") + 1, F.col("last") - F.col("line") + 1), licence)
    had = F.array_contains(units, F.col("licence")) | ((F.size(units) == 1) & (F.get(units, F.lit(0)) != "")) | (licence(F.col("text")) == F.col("licence"))
    return one.where(~had).select("doc_id", "line", "licence", "dice")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (from 0; WHOLE: the whole text), licence, dice: every unit that reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    known = {name: bigrams(text) for name, text in sorted(templates.items())}
    if not all(known.values()):
        raise ValueError("a template needs two words")
    words = probes(list(known.values()), threshold)

    def may_match(text: Column) -> Column:
        return reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])

    low = min(_bounds(len(b), threshold)[0] for b in known.values()) - 1e-9
    high = max(_bounds(len(b), threshold)[1] for b in known.values()) + 1e-9
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = named.where(may_match(F.lower("text")))
    lines = F.split("text", "\n")
    whole = F.struct(F.lit(WHOLE).alias("line"), F.col("text").alias("unit"))
    each = F.transform(lines, lambda t, i: F.struct(i.cast("int").alias("line"), t.alias("unit")))
    units = named.select("doc_id", F.explode(F.when(F.size(lines) > 1, F.concat(F.array(whole), each)).otherwise(each)).alias("u"))
    units = units.where(may_match(F.lower("u.unit"))).select("doc_id", "u.line", "u.unit")
    normal = F.lower(F.trim(F.regexp_replace("unit", "[^A-Za-z0-9]+", " ")))
    split = units.select("doc_id", "line", _one(F.split(normal, " "), lambda w: F.size(w) - 1 >= F.greatest(F.lit(low), F.lit(1))).alias("w"))
    before, after = (F.slice("w", F.lit(k), F.size("w") - 1) for k in (1, 2))
    pairs = F.array_distinct(F.zip_with(before, after, lambda a, b: F.concat(a, F.lit(" "), b)))
    made = split.select("doc_id", "line", _one(pairs, lambda p: F.size(p).between(F.lit(low), F.lit(high))).alias("pairs"))
    n = F.size("pairs")

    def compared(i: int, name: str, own: list[str]) -> Column:
        least, most = _bounds(len(own), threshold)
        dice = 2.0 * F.size(F.array_intersect("pairs", F.array(*map(F.lit, own)))) / (n + len(own))
        fits = n.between(F.lit(least - 1e-9), F.lit(most + 1e-9))
        return F.struct(F.when(fits, dice).otherwise(0.0).alias("dice"), F.lit(-i).alias("order"), F.lit(name).alias("licence"))

    best = F.array_max(F.array(*[compared(i, *x) for i, x in enumerate(known.items())]))
    found = made.select("doc_id", "line", _one(best, lambda b: b["dice"] >= threshold - 1e-9).alias("best"))
    return found.select("doc_id", "line", F.col("best.licence").alias("licence"), F.col("best.dice").alias("dice"))
