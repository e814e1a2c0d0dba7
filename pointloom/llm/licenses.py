"""License scans: TF-IDF cosine of header blocks and licence files to templates and inheritance along directories (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, with_small

from .text import let, whole

# Licence ids, the terms a block must hold to be compared with a notice (those of the name and of the
# version), and the notices.
NOTICES = (
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "apache 2 compliance", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "granted sublicense software", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:"""),
    ("MIT", "granted sublicense merchantability", """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "bsd 2 clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "bsd 3 clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "redistributions binary retain", """Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "redistributions binary retain neither endorse", """Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or
        without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission."""),
    ("ISC", "isc", "Licensed under the ISC License."),
    ("ISC", "purpose fee granted", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("GPL-2.0", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gnu general public 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "gnu general public 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "gnu lesser 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "gnu lesser 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "gnu lesser 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "gnu affero 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2 obtain", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "cc0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("Apache", "apache", "Licensed under the Apache License."),
    ("BSD", "bsd", "Licensed under the BSD License."),
    ("GPL", "gnu general public", "Licensed under the GNU General Public License."),
    ("LGPL", "gnu lesser", "Licensed under the GNU Lesser General Public License."),
    ("Proprietary", "rights reserved", "All rights reserved."),
    ("Proprietary", "copyright rights reserved", "Copyright (c). All rights reserved."),
)
# The notice of the free-software licences, by the name and version put in; the attribution licences.
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free
    Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
    useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public
    License for more details."""
GNU = (("GPL", "General", "2"), ("GPL", "General", "3"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("AGPL", "Affero General", "3"))
CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
#: Names without a version and reservations count only if no licence with its version is found in the file.
FAMILIES = ("Apache", "BSD", "GPL", "LGPL")
RESERVED = ("Proprietary",)


def _templates() -> tuple[tuple[str, str, str], ...]:
    """Licence, needed terms and text of every template: the notices, the rule-made ones and an SPDX line per licence."""
    gnu = [(f"{short}-{v if '.' in v else v + '.0'}", f"gnu {full.split()[0].lower()} {v} redistribute", GNU_NOTICE.format(full, v, full)) for short, full, v in GNU]
    cc = [(f"CC-{c}-4.0", f"cc {c.lower().replace('-', ' ')} 4", f"Licensed under CC {c} 4.0.") for c in CC]
    plain = (*NOTICES, *gnu, *cc)
    names = sorted({name for name, _, _ in plain} - {*FAMILIES, *RESERVED})
    needs = lambda name: "spdx " + re.sub(r"[-.]0$|-", " ", name.lower()).strip()
    return (*plain, *[(name, needs(name), f"SPDX-License-Identifier: {name}") for name in names])


#: Lines and paragraphs with one of these stems are headers.
STEMS = r"(?i)licen[cs]e|copyright|rights reserved|public domain|warrant|creative commons|cc0|spdx|permission is hereby|redistribut"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
#: What is left out of the tokens: the v of a version number, its trailing .0, and years.
NOISE = r"\bv(?=[0-9])|\.0\b(?!\.[0-9])|\b(?:19|20)[0-9][0-9]\b"
#: Lines without a letter or digit (comment signs aside) part paragraphs.
BREAK = r"\n(?:[^\p{L}\p{N}\n]*+\n)+"
#: Names (without directory, case or extension) of files whose licence holds for their directory.
LICENSE_FILES = ("license", "licence", "copying", "copyright", "notice", "unlicense")
THRESHOLD = 0.6
TEMPLATES = _templates()


def tokens(block: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(block), NOISE, ""), F.lit(TOKEN), F.lit(0))


def _joined(parts: Column) -> Column:
    """Runs of adjacent parts with a stem, joined; other parts separate them."""
    marked = F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(STEMS)), p).otherwise(F.lit("\u0001")))
    return F.transform(F.split(F.array_join(marked, "\n"), "\u0001", -1), lambda r: F.trim(r, F.lit("\n")))


def header_blocks(text: Column, license_file: Column) -> Column:
    """Distinct blocks of a text that are compared with the templates.

    Header lines, adjacent header lines as one block, paragraphs with a header line, adjacent such paragraphs as
    one block, and licence files whole (if they have a header line).  A block is in at most five of them, so
    their length follows the text's.
    """

    def blocks(lines: Column) -> Column:
        paragraphs = F.split(whole(text), BREAK, -1)
        stemmed = lambda parts: F.filter(parts, lambda p: F.rlike(p, F.lit(STEMS)))
        entire = F.when(license_file, F.array(whole(text))).otherwise(F.array().cast("array<string>"))
        found = let(paragraphs, lambda p: F.concat(stemmed(lines), _joined(lines), stemmed(p), _joined(p), entire))
        return F.array_distinct(F.filter(found, lambda b: F.length(b) > 0))

    none = F.array().cast("array<string>")
    return F.when(F.rlike(whole(text), F.lit(STEMS)), let(F.split(whole(text), "\n", -1), blocks)).otherwise(none)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``license, rank`` (2: licence with its version, 1: family, 0: reservation), ``needs, terms``."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(needs).alias("needs"), F.lit(text).alias("text")) for name, needs, text in templates])
    rank = F.when(F.col("t.license").isin(*RESERVED), 0).when(F.col("t.license").isin(*FAMILIES), 1).otherwise(2)
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.license", rank.alias("rank"), F.split("t.needs", " ").alias("needs"), tokens(F.col("t.text")).alias("terms"))


def template_vectors(files: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row: ``idf`` of the template terms over all files, ``rare`` (the weight of any other
    term) and the weighted ``vectors`` of the templates.  Its size is that of the templates."""
    spark = files.sparkSession
    known = template_table(spark, templates)
    vocabulary = known.select(F.explode("terms").alias("term")).distinct().agg(F.sort_array(F.collect_set("term")).alias("v"))
    held = files.join(F.broadcast(vocabulary)).select(F.explode(F.array_intersect(tokens(whole(text)), F.col("v"))).alias("term"))
    counted = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = files.agg(F.count(F.lit(1)).cast("double").alias("n"))
    terms = vocabulary.select(F.explode("v").alias("term")).join(F.broadcast(counted), "term", "left").join(F.broadcast(total))
    idf = terms.select("term", F.round(F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1, 9).alias("w"), F.round(F.log(F.col("n") + 1) + 1, 9).alias("rare"))
    packed = idf.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("idf"), F.max("rare").alias("rare"))
    weighed = known.join(F.broadcast(packed)).select(
        "license", "rank", "needs", "idf", "rare",
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), (F.col("idf")[t] * F.size(F.filter("terms", lambda x: x == t))).alias("w"))).alias("vector"),
    ).withColumn("norm", F.sqrt(_sum(F.transform("vector", lambda x: x["w"] * x["w"]))))
    vectors = F.sort_array(F.collect_list(F.struct("license", "rank", "needs", "vector", "norm"))).alias("vectors")
    return weighed.agg(F.first("idf").alias("idf"), F.first("rare").alias("rare"), vectors)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def term_counts(terms: Column) -> Column:
    """``term, n`` of every distinct term in rising order, by the runs of the sorted terms."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(ordered)) - i).alias("n"))))

    return let(F.sort_array(terms), runs)


def best_match(block: Column, threshold=None) -> Column:
    """``rank, score, license`` of the template nearest to a block (columns ``idf, rare, vectors`` at hand).

    Only templates whose needed terms (name and version) are all in the block are compared, so the version decides
    between templates that are otherwise near.  Terms outside the templates weigh as much as a term of no other
    file; of equal scores the last name wins.  Null if no template of ``threshold`` or more is left.  Linear
    in the block's length apart from sorting its terms.
    """

    def against(weighed: Column) -> Column:
        # The number of terms outside the templates is open; of the others there are at most as many as in the templates.
        own = F.filter(weighed, lambda x: x["w"].isNotNull())
        strange = _sum(F.transform(F.filter(weighed, lambda x: x["w"].isNull()), lambda x: F.col("rare") * x["n"] * F.col("rare") * x["n"]))

        def scores(mine: Column, terms: Column, norm: Column) -> Column:
            open_templates = F.filter("vectors", lambda v: F.size(F.array_except(v["needs"], terms)) == 0)
            dot = lambda v: _sum(F.transform(mine, lambda x: x["w"] * _sum(F.transform(
                F.filter(v["vector"], lambda p: p["term"] == x["term"]), lambda p: p["w"]))))
            scored = F.transform(open_templates, lambda v: F.struct(v["rank"], F.round(dot(v) / (norm * v["norm"]), 6).alias("score"), v["license"].alias("license")))
            return F.array_max(F.filter(scored, lambda m: m["score"] >= threshold) if threshold is not None else scored)

        return let(own, lambda mine: let(F.transform(mine, lambda x: x["term"]), lambda terms: let(
            F.sqrt(strange + _sum(F.transform(mine, lambda x: x["w"] * x["w"]))), lambda norm: scores(mine, terms, norm))))

    weights = lambda terms: F.transform(term_counts(terms), lambda c: F.struct(
        c["term"].alias("term"), c["n"].alias("n"), (F.col("idf")[c["term"]] * c["n"]).alias("w")))
    return let(tokens(block), lambda terms: F.when(F.size(terms) > 0, let(weights(terms), against)))


def scan_files(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with ``own_license, score`` (best header block of the whole text) and ``license, origin, from_dir``.

    Of several licences in a file the best score counts, but names without a version and reservations of
    rights only where no licence with its version is found.

    A file's own header counts first (``origin`` own).  Otherwise it has the licence of the
    nearest directory above it that holds a licence file with a recognised licence
    (inherited), else none.  Only distinct directories are joined to directories, so a directory with a third
    of all files is one row there.  Of several licence files in a directory the best score counts, then
    the licence's name.  Null texts have no header, null paths no directory; an empty table gives an
    empty result.  Names of the added columns and those with a leading ``_`` are reserved.
    """
    names = files.columns
    vectors = template_vectors(files, text, templates)
    base = F.lower(F.regexp_extract(F.col(path), r"([^/.]*)(?:\.[^/]*)?$", 1))
    headers = header_blocks(F.col(text), F.coalesce(base.isin(*LICENSE_FILES), F.lit(False)))
    lined = files.withColumn("_headers", F.explode(F.array(headers))).join(F.broadcast(vectors))
    best = lined.withColumn("_best", F.explode(F.array(F.array_max(F.transform("_headers", lambda block: best_match(block, threshold))))))
    own = F.col("_best.license")
    scanned = cut(best.select(
        *names, own.alias("own_license"), F.col("_best.score").alias("score"),
        F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull(), F.lit(""))).alias("_dir"),
    ))
    holders = scanned.where(base.isin(*LICENSE_FILES) & F.col("own_license").isNotNull() & F.col("_dir").isNotNull())
    roots = holders.groupBy(F.col("_dir").alias("_up")).agg(F.max(F.struct("score", "own_license")).alias("_l")).select("_up", F.col("_l.own_license").alias("_inherited"))
    # Every directory with itself and all above it; the empty path is the root.
    parts = F.split("_dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("_up")))
    climbed = scanned.select("_dir").where("_dir IS NOT NULL").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("a")).select("_dir", "a.*")
    nearest = with_small(climbed, roots, "_up", "inner").groupBy("_dir").agg(F.max(F.struct("depth", "_up", "_inherited")).alias("_n"))
    joined = with_small(scanned, nearest.select("_dir", "_n"), "_dir")
    return joined.select(
        *names, "own_license", "score", F.coalesce("own_license", "_n._inherited").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.lit("own")).when(F.col("_n").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(F.col("own_license").isNull(), F.col("_n._up")).alias("from_dir"),
    )
