"""Licence scans by Dice coefficient over word bigrams, in DataFrame operations only.

A licence may stand anywhere in a text, over any number of lines. A template's bigrams with a word that is not one of
``FREQUENT`` are its marks. Marks in a text that stand at most g words apart make a passage, for each g of ``GAPS`` and
for half the template's size (a match has no more bigrams that are not the template's); a passage reaches as far
beyond its first and last mark as the template beyond its own. Its distinct bigrams are held against the template's.

Size bounds: Dice's coefficient of two sets with a and b bigrams is at most 2 * min(a, b) / (a + b), so only passages
with b * t / (2 - t) <= a <= b * (2 - t) / t can reach t, and only those with b * t / (2 - t) shared bigrams. A
passage with too few words or marks is out before its bigrams are made, and a text is out before its marks are sought
if it has none of a few words: those that any b - ceil(b * t / (2 - t)) + 1 bigrams of each template need.

Where passages overlap, the match that agrees most stands: that with the most shared bigrams less those that only one
side has. So a BSD text with two clauses isn't named after the one with three, nor a licence after a notice inside.
A match stands if it is the best one at half or more of its words.

Results are told apart by text, by two 64-bit hashes; equal texts are still read and matched each for itself. The templates' table is broadcast; it comes from
at most ``MOST_CHARACTERS`` of templates.

Defined cases: normalised words are lower-cased (A-Z) letters, digits and non-ASCII characters; templates of fewer than
two words match nothing, and so do null, empty and one-word texts; rows that repeat a doc_id are scanned each for
itself and repeated rows give equal rows; ties go to the template that stands first; a null doc_id is an id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.llm.session import table, written

THRESHOLD = 0.8
#: Words between two marks of one passage.
GAPS = (4, 12, 40)
MOST_CHARACTERS = 4_000_000

# fixed values: public licence notices; whole texts stand in templates/, named by licence
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
TEMPLATES = [*NOTICES, *((p.stem, p.read_text(encoding="utf-8")) for p in sorted(Path(__file__).with_name("templates").glob("*.txt")))]

# fixed values: English words that tell nothing
FREQUENT = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "may", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS), "")


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbours."""
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


class Template:
    """A template's bigrams and bounds."""

    def __init__(self, number: int, licence: str, text: str, threshold: float):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))
        places = list(zip(own, own[1:]))
        self.number, self.licence, self.bigrams = number, licence, list(dict.fromkeys(places))
        size = len(self.bigrams)
        told = [i for i, b in enumerate(places) if not FREQUENT.issuperset(b)] or list(range(len(places)))
        self.marks = list(dict.fromkeys(places[i] for i in told))
        self.lead, self.trail = (told[0], len(places) - 1 - told[-1]) if told else (0, 0)
        self.size, self.half = size, max(size // 2, 1)
        self.shared = math.ceil(size * threshold / (2 - threshold) - 1e-9)
        self.least_marks = max(1, self.shared - (size - len(self.marks)))

    def needed_words(self) -> set[str]:
        """Words of which every text with a match has one: long ones first that stand in many bigrams."""
        out, left = set(), Counter(self.bigrams)
        while len(left) >= self.shared and left:
            counts = Counter(w for b in left for w in set(b))
            out.add(max(counts, key=lambda w: (w not in FREQUENT, len(w) > 4, counts[w], w)))
            left = Counter(b for b in left if out.isdisjoint(b))
        return out


def made(templates: Iterable[tuple[str, str]], threshold: float) -> list[Template]:
    templates = list(templates)
    if sum(len(text) for _, text in templates) > MOST_CHARACTERS:
        raise ValueError(f"templates of more than {MOST_CHARACTERS} characters would be broadcast")
    return [t for t in (Template(i, *x, threshold) for i, x in enumerate(templates)) if t.bigrams]


KEY = ["h1", "h2"]
ABOUT = "template int, licence string, size int, half int, shared int, least_marks int, lead int, trail int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, and its words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(9), text).alias("h2"), words(text).alias("words"))


def matches(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """h1, h2 (of the text), template (its place in the list), licence, start and end (in words) and dice of the matches that stand."""
    spark = docs.sparkSession
    known = made(templates, threshold)

    def about(t: Template) -> tuple:
        return t.number, t.licence, t.size, t.half, t.shared, t.least_marks, t.lead, t.trail

    marks = F.broadcast(spark.createDataFrame([(" ".join(b), *about(t)) for t in known for b in t.marks], f"bigram string, {ABOUT}"))  # bounded by MOST_CHARACTERS
    own = F.broadcast(spark.createDataFrame([(t.number, [" ".join(b) for b in t.bigrams]) for t in known], "template int, bigrams array<string>"))
    needed = sorted(set().union(*(t.needed_words() for t in known)))
    hopeful = keyed(docs).where(F.arrays_overlap("words", F.array(*map(F.lit, needed)).cast("array<string>")) & (F.size("words") > 1))

    rows = hopeful.select(*KEY, "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - 1)).alias("place", "word"))
    rows = rows.select(*KEY, "place", F.concat_ws(" ", "word", F.get("words", F.col("place") + 1)).alias("bigram"))
    rows = rows.join(marks, "bigram").drop("bigram").distinct()
    along = Window.partitionBy(*KEY, "template").orderBy("place")
    rows = rows.withColumn("gap", F.col("place") - F.lag("place").over(along))
    gaps = [*map(F.lit, GAPS), F.col("half")]
    rows = rows.withColumns({f"p{i}": F.sum(F.when(F.col("gap") > g, 1).otherwise(0)).over(along) for i, g in enumerate(gaps)})
    passages = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"p{i}").alias("passage")) for i in range(len(gaps))))).alias("x")
    described = [c.split()[0] for c in ABOUT.split(", ")]
    rows = rows.select(*KEY, *described, "place", passages).groupBy(*KEY, *described, "x").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    start = F.greatest(F.col("first") - F.col("lead"), F.lit(0))
    rows = rows.where(F.col("n") >= F.col("least_marks")).select(*KEY, "template", "licence", "size", "shared", start.alias("start"), (F.col("last") + F.col("trail") + 1).alias("last"))
    candidates = written(rows.where(F.col("last") - F.col("start") >= F.col("shared")).distinct())

    found = candidates.join(hopeful.select(*KEY, "words"), KEY).withColumn("end", F.least(F.col("last") + 1, F.size("words")))
    found = found.select(*KEY, "template", "licence", "size", "start", "end", bigrams(F.slice("words", F.col("start") + 1, F.col("end") - F.col("start"))).alias("own"))
    within = F.size("own").between(F.col("size") * threshold / (2 - threshold) - 1e-9, F.col("size") * (2 - threshold) / threshold + 1e-9)
    found = found.where(within).join(own, "template").withColumn("n", F.size(F.array_intersect("own", "bigrams"))).withColumn("m", F.size("own"))
    found = found.withColumns({"dice": 2.0 * F.col("n") / (F.col("m") + F.col("size")), "agreement": 3 * F.col("n") - F.col("m") - F.col("size")})
    found = written(found.where(F.col("dice") >= threshold).select(*KEY, "template", "licence", "start", "end", "dice", "agreement").distinct())

    me = F.struct("agreement", "dice", (-F.col("template")).alias("t"), (-F.col("start")).alias("s"), "end")
    spots = found.select(*KEY, me.alias("me"), F.explode(F.sequence("start", F.col("end") - 1)).alias("place"))
    best = spots.groupBy(*KEY, "place").agg(F.max("me").alias("me")).groupBy(*KEY, "me").agg(F.count("*").alias("own"))
    stands = best.where(2 * F.col("own") >= F.col("me.end") + F.col("me.s")).select(*KEY, "me")
    return found.withColumn("me", me).join(stands, [*KEY, "me"]).drop("me")


def scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, licence and dice of the match that agrees most (null if none), and all licences found."""
    found = matches(docs, templates, threshold)
    top = F.max(F.struct("agreement", "dice", (-F.col("template")).alias("t"), "licence")).alias("top")
    best = found.groupBy(*KEY).agg(top, F.sort_array(F.collect_set("licence")).alias("licences"))
    best = written(best.select(*KEY, "top.licence", F.round("top.dice", 6).alias("dice"), F.concat_ws(",", "licences").alias("licences")))
    rows = keyed(docs).drop("words").join(best, KEY, "left")
    return rows.select("doc_id", "licence", "dice", F.coalesce("licences", F.lit("")).alias("licences"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql(templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over ``documents``; repeated rows count once on the way."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(templates))
    split = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    frequent = ", ".join(f"'{w}'" for w in sorted(FREQUENT))
    levels = " UNION ALL ".join(f"SELECT *, {i} AS level, sum(CASE WHEN gap > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY d, template ORDER BY place) AS passage FROM gaps" for i, g in enumerate((*GAPS, "half")))
    return f"""
WITH t0 AS (SELECT template, licence, {split.format("x")} AS w FROM (VALUES {rows}) v(template, licence, x)),
t AS (SELECT *, {grams.format("w")} AS g FROM t0 WHERE len(w) > 1),
tp AS (SELECT template, i - 1 AS place, w[i] || ' ' || w[i + 1] AS bigram, w[i] IN ({frequent}) AND w[i + 1] IN ({frequent}) AS dull
       FROM (SELECT template, w, unnest(generate_series(1, len(w) - 1)) AS i FROM t)),
mk AS (SELECT * FROM tp WHERE NOT dull OR template IN (SELECT template FROM tp GROUP BY template HAVING bool_and(dull))),
b AS (SELECT t.template, licence, g, len(g) AS size, greatest(len(g) // 2, 1) AS half, ceil(len(g) * {threshold} / (2 - {threshold}) - 1e-9) AS shared,
      (SELECT min(place) FROM mk WHERE mk.template = t.template) AS lead, len(w) - 2 - (SELECT max(place) FROM mk WHERE mk.template = t.template) AS trail,
      (SELECT count(DISTINCT bigram) FROM mk WHERE mk.template = t.template) AS n_marks FROM t),
marks AS (SELECT DISTINCT template, bigram FROM mk),
d AS (SELECT DISTINCT coalesce(text, '') AS d, {split.format("coalesce(text, '')")} AS w FROM documents),
hits AS (SELECT d, template, place FROM (SELECT d, i - 1 AS place, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT d, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1)) JOIN marks USING (bigram)),
gaps AS (SELECT d, template, place, half, place - lag(place) OVER (PARTITION BY d, template ORDER BY place) AS gap FROM hits JOIN b USING (template)),
levels AS ({levels}),
spans AS (SELECT DISTINCT d, template, greatest(lo - lead, 0) AS lo, hi + trail + 1 AS hi
          FROM (SELECT d, template, min(place) AS lo, max(place) AS hi, count(*) AS n FROM levels GROUP BY d, template, level, passage) JOIN b USING (template)
          WHERE n >= greatest(1, shared - (size - n_marks)) AND hi + trail + 1 - greatest(lo - lead, 0) >= shared),
found AS (SELECT DISTINCT d, template, lo, least(hi + 1, len(w)) AS hi, w[lo + 1 : least(hi + 1, len(w))] AS v FROM spans JOIN d USING (d)),
own AS (SELECT d, template, lo, hi, {grams.format("v")} AS o FROM found),
m AS (SELECT * FROM (SELECT d, template, licence, lo, hi, size, len(o) AS m, len(list_intersect(o, g)) AS n FROM own JOIN b USING (template))
      WHERE 2.0 * n / (m + size) >= {threshold}),
me AS (SELECT DISTINCT d, licence, lo, hi, {{'a': 3 * n - m - size, 'd': 2.0 * n / (m + size), 't': -template, 's': -lo, 'e': hi}} AS me FROM m),
best AS (SELECT d, me FROM (SELECT d, place, max(me) AS me FROM (SELECT d, me, unnest(generate_series(lo, hi - 1)) AS place FROM me) GROUP BY d, place) GROUP BY d, me HAVING 2 * count(*) >= me.e + me.s),
stands AS (SELECT * FROM me SEMI JOIN best USING (d, me)),
per AS (SELECT d, arg_max(licence, me) AS licence, max(me).d AS dice, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM stands GROUP BY d)
SELECT doc_id, licence, round(dice, 6) AS dice, coalesce(licences, '') AS licences FROM documents LEFT JOIN per ON coalesce(text, '') = d
"""


OP9_SQL = sql()
