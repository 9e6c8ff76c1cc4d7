"""Licence scan by canonical digests (DataFrame functions only).

Known licence notices are normalised (case, punctuation, copyright lines, equivalent spellings) and
hashed. The same normalisation runs over every unit of a document: the entire text, each of its
paragraphs and each of its lines, taken whole. Units meet the known digests in a hash join; the known side is a fixed list
(NOTICES, NAMES, TEXTS and LONG_TEXTS, some hundred rows), so it is broadcast.
"""

from __future__ import annotations

import hashlib
import re
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices as they are commonly written (licence, permissive or not, notice).
NOTICES: list[tuple[str, bool, str]] = [
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", True, "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", True, "This software is released under the MIT License."),
    ("MIT", True, "Released under the MIT License."),
    ("MIT", True, "Licensed under the MIT License."),
    ("MIT", True, "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", True, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", True, "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", True, "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", True, "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", False, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", False, "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-3.0", False, "This program is free software under the GNU General Public License, version 3."),
    ("GPL-3.0", False, "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", False, "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", False, "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", False, "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", False, "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", False, "SPDX-License-Identifier: AGPL-3.0-only"),
    ("CC0-1.0", True, "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", True, "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", True, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", False, "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", False, "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", False, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", False, "Licensed under CC BY-ND 4.0."),
    ("Proprietary", False, "All rights reserved."),
]

# What a licence is called after 'licensed under' (licence, permissive or not, names).
NAMES: list[tuple[str, bool, list[str]]] = [
    ("Apache-2.0", True, ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"]),
    ("MIT", True, ["MIT License", "MIT"]),
    ("BSD-3-Clause", True, ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"]),
    ("BSD-2-Clause", True, ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"]),
    ("ISC", True, ["ISC License", "ISC"]),
    ("MPL-2.0", False, ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"]),
    *((f"{short}-{v}", False, [f"{name}{version}{later}" for name, version in ((f"GNU {full}", f", version {n}"), (f"GNU {full}", f" {v}"), (f"GNU {full}", f", version {v}"), (f"GNU {short}", f" v{n}"), (short, f" v{n}"), (f"GNU {short}", f" {v}"), (short, f"-{v}"), (f"GNU {short}v", n), (f"{short}v", n)) for later in ("", " or later", " or (at your option) any later version", " only")])
      for short, full, v, n in (("GPL", "General Public License", "3.0", "3"), ("GPL", "General Public License", "2.0", "2"), ("LGPL", "Lesser General Public License", "3.0", "3"), ("AGPL", "Affero General Public License", "3.0", "3"))),
    ("CC0-1.0", True, ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0"]),
    *((f"CC-{short}-4.0", ok, [f"CC {short} 4.0", f"CC {short} 4.0 License", f"Creative Commons {full} 4.0 License", f"Creative Commons {full} 4.0 International License", f"Creative Commons {full} 4.0 International"])
      for short, ok, full in (("BY", True, "Attribution"), ("BY-SA", False, "Attribution-ShareAlike"), ("BY-NC", False, "Attribution-NonCommercial"), ("BY-ND", False, "Attribution-NoDerivatives"))),
]
#: The usual sentences around a licence's name, in canonical text: 'under' and the name stay.
HEAD = r"^(?:this (?:work|program|software|file|project|code|document|library|package) is |this is )?(?:free software )?(?:(?:licensed|released|distributed|made available) )?under (?:the terms of )?(?:the |an? )?"


# The texts of short licences and the usual headers of long ones (licence, permissive or not, paragraphs).
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_numbered = lambda parts: [parts[0], *(f"{k}. {x}" for k, x in enumerate(parts[1:], 1))]
TEXTS: list[tuple[str, bool, list[str], list[str]]] = [  # licence, permissive or not, titles, paragraphs
    ("MIT", True, ["MIT License", "The MIT License", "The MIT License (MIT)"], [_MIT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."]),
    ("ISC", True, ["ISC License", "The ISC License"], [_ISC, "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."]),
    *(("BSD-2-Clause", True, ["BSD 2-Clause License", "The 2-Clause BSD License"], [*f(_BSD), _AS_IS]) for f in (list, _numbered)),
    *(("BSD-3-Clause", True, ["BSD 3-Clause License", "The 3-Clause BSD License"], [*f([*_BSD, _THIRD]), _AS_IS]) for f in (list, _numbered)),
    ("MIT", True, [], [_MIT]),
    ("ISC", True, [], [_ISC]),
    ("Apache-2.0", True, [], ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"]),
    *((f"{short}-{n}.0", False, [], [f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {full} General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."]) for short, full, n in (("GPL", "", 2), ("GPL", "", 3), ("AGPL", "Affero", 3), ("LGPL", "Lesser", 3))),
    ("MPL-2.0", False, [], ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ]),
    ("MPL-2.0", False, [], ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
]
# Digests of the canonical texts of long licences (digest, licence, permissive or not, characters, first word).
LONG_TEXTS: list[tuple[str, str, bool, int, str]] = [
    ("8e2427834fb929bc24c7e97ef725006d7a0d43f4c46792d2ce297580877362d7", "Apache-2.0", True, 9689, "apache"),
    ("94c38dd5302e8c2bec30a19caec1def4525a41369bc07e59fbfe77d81e99e5bd", "GPL-2.0", False, 17035, "gnu"),
    ("11b9c1dd6ee55cc269f33f8da3b6f27659e776ae8d9a5641ef66bbc06435fdaf", "GPL-3.0", False, 33177, "gnu"),
    ("af81f81a648353310a93f25754e688cbd1265b486d66e3a42d28e0eb010eea59", "LGPL-2.1", False, 24931, "gnu"),
    ("56482b1c7f665d4c7f789e4101b8a8be875572d70c56d6483f0dd69f153190d6", "LGPL-3.0", False, 7080, "gnu"),
    ("46b6383d7662844c299fa7b3c575d73aa416bad7f3dc483f6ecf179dbb6fb09b", "MPL-2.0", False, 14229, "mozilla"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0", True, 6692, "creative"),
]


def texts() -> list[tuple[str, bool, str]]:
    """TEXTS as notices: with and without title, unbroken and broken at the usual widths, as a line that starts with 'copyright' is dropped."""
    out = []
    for name, ok, titles, paragraphs in TEXTS:
        for width in (10_000, *range(60, 101)):
            body = "\n\n".join(textwrap.fill(x, width) for x in paragraphs)
            out += [(name, ok, f"{t}\n\n{body}") for t in ["", *titles]]
    return out


# Equivalent spellings, applied in this order to lower-cased text without punctuation.
SPELLINGS: list[tuple[str, str]] = [
    (r"\blicen[cs]e([ds]?)\b", "license$1"),
    (r"\bsub ?licen[cs]e\b", "sublicense"),
    (r"\bnon ?commercial\b", "noncommercial"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\bcopy ?right\b", "copyright"),
    (r"\bversion (\d)", "v $1"),
    (r"\bv(\d)", "v $1"),
    (r"\binternational license\b", "license"),
    (r"\borganisation", "organization"),
    (r"\bauthoris", "authoriz"),
    (r"\bwhilst\b", "while"),
    (r"\bmerchantibility\b", "merchantability"),
]

#: No spelling is more than so many times as long as the one that replaces it.
SHRINK = 6

#: A copyright line: dropped before hashing.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\n]*(copyright|copr\.|\(c\)|©)[^\n]*$"


def plain(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, single blanks."""
    t = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{Nd}]+", " "))


def respelled(t: Column) -> Column:
    """One spelling for equivalent ones, in the result of plain()."""
    for pattern, by in SPELLINGS:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(F.regexp_replace(t, " +", " "))


def canonical_text(text: str) -> str:
    """The same for the fixed list and for tests, in plain Python."""
    t = re.sub(r"(?im)^[^\w\n]*(copyright|copr\.|\(c\)|©)[^\n]*$", " ", text)
    t = re.sub(r"[\W_]+", " ", t.lower())
    for pattern, by in SPELLINGS:
        t = re.sub(pattern, by.replace("$1", r"\1"), t)
    return re.sub(" +", " ", t).strip(" ")


def headless(canonical: str) -> str:
    """One sentence for the usual ones around a licence's name."""
    return re.sub(HEAD, "under ", canonical)


def _known(notices: list[tuple[str, bool, str]] | None = None) -> dict[str, tuple[str, bool, int, str]]:
    """license, permissive, chars and first word by digest, one for each distinct canonical notice."""
    long = [] if notices else LONG_TEXTS
    notices = notices or [*NOTICES, *((name, ok, f"Licensed under {x}") for name, ok, names in NAMES for x in names), *texts()]
    rows = {d: (name, ok, n, first) for d, name, ok, n, first in long}
    for name, ok, t in notices:
        c = headless(canonical_text(t))
        rows[hashlib.sha256(c.encode()).hexdigest()] = (name, ok, len(c), c.split(" ")[0])
    return rows


def known_digests(spark: SparkSession, notices: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """digest, license, permissive, chars, first (word); one row per distinct canonical notice."""
    return spark.createDataFrame([(d, *x) for d, x in sorted(_known(notices).items())], "digest string, license string, permissive boolean, chars int, first string")


#: Between paragraphs: lines without letters and digits.
BETWEEN = r"\n(?:[^\p{L}\p{Nd}\n]*\n)+"
#: So much of a unit tells its first canonical word.
START = 160


def canonical(t: Column) -> Column:
    """The canonical form of the result of plain()."""
    return F.regexp_replace(respelled(t), HEAD, "under ")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id: doc_id, n_notices, licenses (sorted, joined by ','), whole_text, verdict.

    verdict: ``permissive`` if every licence found is, ``restricted`` if one is not, ``unknown``
    without a notice. whole_text tells that the entire text is a known notice. Null and empty texts
    are unknown. Rows that repeat an id are scanned together and give one row; a null id is one id.
    """
    known = known if known is not None else known_digests(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    longest, firsts = known.agg(F.max("chars"), F.collect_set("first")).first()
    longest = SHRINK * ((longest or 0) + 80)
    unit = lambda whole, broken: lambda x: F.struct(F.lit(whole).alias("whole"), F.lit(broken).alias("broken"), x.alias("unit"))
    entire = F.array(unit(True, False)(F.col("text")))
    paragraphs = F.split("text", BETWEEN)
    paragraphs = F.when(F.size(paragraphs) > 1, F.transform(F.filter(paragraphs, lambda x: F.trim(x, F.lit("\n")).contains("\n")), unit(False, True))).otherwise(F.slice(F.transform(paragraphs, unit(False, True)), 1, 0))
    lines = F.split("text", "\n")
    units = F.when(F.col("text").contains("\n"), F.concat(F.transform(lines, unit(False, False)), paragraphs, entire)).otherwise(entire)
    units = F.transform(units, lambda u: F.struct(u["whole"].alias("whole"), u["broken"].alias("broken"), u["unit"].alias("unit"), plain(u["unit"]).alias("t")))
    # respelling shortens a text by SHRINK at most: what is still longer, with the longest head, or starts with another word can equal no notice
    units = F.filter(units, lambda u: (F.length(u["t"]) <= longest) & F.substring_index(canonical(F.substring(u["t"], 1, START)), " ", 1).isin(firsts))
    # a paragraph that has all its words in one line is that line
    units = F.filter(units, lambda u: ~u["broken"] | (F.size(F.filter(F.split(u["unit"], "\n"), lambda x: plain(x) != "")) > 1))
    units = F.transform(units, lambda u: F.struct(u["whole"].alias("whole"), F.sha2(canonical(u["t"]), 256).alias("digest")))
    found = (
        base.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.whole", "u.digest")
        .join(F.broadcast(known), "digest")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("whole").alias("whole_text"), F.min("permissive").alias("ok"))
    )
    ids = base.select(F.col("doc_id").alias("id")).distinct()
    return ids.join(found, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("whole_text", F.lit(False)).alias("whole_text"),
        F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "permissive").otherwise("restricted").alias("verdict"),
    )


def _sql() -> str:
    plain_ = lambda x: rf"trim(regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g')), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
    t = plain_("unit")
    for pattern, by in SPELLINGS:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    t = f"regexp_replace(trim(regexp_replace({t}, ' +', ' ', 'g')), '{HEAD}', 'under ')"
    values = ", ".join(f"('{d}', '{name}', {ok})" for d, (name, ok, _, _) in sorted(_known().items()))
    between = BETWEEN.replace(r"\n", "\n")
    return f"""
WITH k(digest, license, permissive) AS (VALUES {values}),
b AS (SELECT doc_id, string_split_regex(text, '{between}') AS ps FROM documents WHERE contains(text, chr(10))),
g AS (SELECT doc_id, unnest(ps) AS unit FROM b WHERE len(ps) > 1),
u AS (SELECT doc_id, true AS whole, coalesce(text, '') AS unit FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, false, unit FROM g WHERE contains(trim(unit, chr(10)), chr(10)) AND len(list_filter(string_split(unit, chr(10)), lambda x: {plain_('x')} <> '')) > 1),
h AS (SELECT doc_id, whole, sha256({t}) AS digest FROM u),
f AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, max(whole) AS whole_text, min(permissive) AS ok
  FROM h JOIN k USING (digest) GROUP BY 1)
SELECT i.doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses, coalesce(whole_text, false) AS whole_text,
  CASE WHEN ok IS NULL THEN 'unknown' WHEN ok THEN 'permissive' ELSE 'restricted' END AS verdict
FROM (SELECT DISTINCT doc_id FROM documents) i LEFT JOIN f ON f.doc_id = i.doc_id
"""


SQL = _sql()
