"""Licence recognition by sentences and ordered rules (operator 5).

A text is split into sentences, which may run over line breaks and comment marks; each is normalised and looked up among
known licence sentences, and the identifiers found, in order, are matched against licence rules. A rule is a sequence of
identifiers that must follow one another; longer rules come first and consume their sentences, so
three BSD conditions are not read as two. A sentence that isn't known may still refer to a licence by name, as
``SPDX-License-Identifier: MIT`` or ``licensed under the MIT License`` do; each name referred to is an identifier of its own. Everything is a column expression over one row: no
shuffle, and no row depends on another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

# Identifier, and the sentence as it stands in licence texts and notices; an identifier may have several forms.
SENTENCES = [
    ("ApacheNotice", "Licensed under the Apache License, Version 2.0"),
    ("ApacheNotice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("ApacheMayNotUse", "you may not use this file except in compliance with the License"),
    ("ApacheObtain", "You may obtain a copy of the License at"),
    ("ApacheObtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheObtain", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("ApacheTitle", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("ApacheTitle", "Apache License Version 2.0, January 2004"),
    ("MITReleased", "Released under the MIT License"),
    ("MITLicensed", "Licensed under the MIT License"),
    ("MITGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITDisclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("MITLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("BSDGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDDisclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("BSDLiability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("GPL3Work", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL2Work", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL3Title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL2Title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL3Title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL21Title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL3Title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPLRedistribute3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPLRedistribute2", "either version 2 of the License, or (at your option) any later version"),
    ("LGPLRedistribute3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPLRedistribute21", "either version 2.1 of the License, or (at your option) any later version"),
    ("AGPLRedistribute3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPLWork", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MPLNotice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPLTitle", "Mozilla Public License Version 2.0"),
    ("ISCGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroBSDGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCDisclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BoostTitle", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("UnlicenseGrant", "This is free and unencumbered software released into the public domain"),
    ("CCBY4", "Licensed under CC BY 4.0"),
    ("CCBYSA4", "Licensed under CC BY-SA 4.0"),
    ("CCBYNC4", "Licensed under CC BY-NC 4.0"),
    ("CCBYNCSA4", "Licensed under CC BY-NC-SA 4.0"),
    ("CCBYND4", "Licensed under CC BY-ND 4.0"),
    ("CC0", "Licensed under CC0 1.0"),
    ("AllRights", "All rights reserved"),
]
# Licence, and its sentences in order.
RULES = [
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDDisclaimer", "BSDLiability"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDDisclaimer", "BSDLiability"]),
    ("Apache-2.0", ["ApacheNotice", "ApacheMayNotUse", "ApacheObtain", "ApacheAsIs", "ApacheSee"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse"]),
    ("MIT", ["MITGrant", "MITNotice", "MITDisclaimer", "MITLiability"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("Apache-2.0", ["ApacheNotice", "ApacheMayNotUse", "ApacheObtain"]),
    ("MIT", ["MITGrant", "MITNotice", "MITDisclaimer"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("ISC", ["ISCGrant", "ISCDisclaimer"]),
    ("0BSD", ["ZeroBSDGrant", "ISCDisclaimer"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Apache-2.0", ["ApacheNotice"]),
    ("Apache-2.0", ["ApacheTitle"]),
    ("MIT", ["MITReleased"]),
    ("MIT", ["MITLicensed"]),
    ("GPL-3.0-only", ["GPL3Work"]),
    ("GPL-2.0-only", ["GPL2Work"]),
    ("GPL-3.0-only", ["GPL3Title"]),
    ("GPL-2.0-only", ["GPL2Title"]),
    ("LGPL-3.0-only", ["LGPL3Title"]),
    ("LGPL-2.1-only", ["LGPL21Title"]),
    ("AGPL-3.0-only", ["AGPL3Title"]),
    ("GPL-3.0-or-later", ["GPLRedistribute3"]),
    ("GPL-2.0-or-later", ["GPLRedistribute2"]),
    ("LGPL-3.0-or-later", ["LGPLRedistribute3"]),
    ("LGPL-2.1-or-later", ["LGPLRedistribute21"]),
    ("AGPL-3.0-or-later", ["AGPLRedistribute3"]),
    ("LGPL-3.0-only", ["LGPLWork"]),
    ("MPL-2.0", ["MPLNotice"]),
    ("MPL-2.0", ["MPLTitle"]),
    ("ISC", ["ISCGrant"]),
    ("BSL-1.0", ["BoostTitle"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4"]),
    ("CC-BY-ND-4.0", ["CCBYND4"]),
    ("CC0-1.0", ["CC0"]),
    ("Proprietary", ["AllRights"]),
]

# Licence, and its names after words that refer to a licence, in normal form.
NAMES = [
    ("Apache-2.0", ["apache 2 0", "apache 2", "apache license 2 0", "apache license version 2 0", "apache license v2 0", "apache software license 2 0"]),
    ("MIT", ["mit", "expat"]),
    ("BSD-2-Clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd"]),
    ("BSD-3-Clause", ["bsd 3 clause", "3 clause bsd", "modified bsd", "new bsd"]),
    ("GPL-2.0-only", ["gpl 2 0 only", "gpl 2 0", "gplv2", "gpl v2", "gnu gpl v2", "gnu general public license version 2", "gnu general public license v2 0"]),
    ("GPL-2.0-or-later", ["gpl 2 0 or later", "gplv2 or later", "gnu general public license version 2 or later"]),
    ("GPL-3.0-only", ["gpl 3 0 only", "gpl 3 0", "gplv3", "gpl v3", "gnu gpl v3", "gnu general public license version 3", "gnu general public license v3 0"]),
    ("GPL-3.0-or-later", ["gpl 3 0 or later", "gplv3 or later", "gnu general public license version 3 or later"]),
    ("LGPL-2.1-only", ["lgpl 2 1 only", "lgpl 2 1", "lgplv2 1", "gnu lesser general public license version 2 1"]),
    ("LGPL-2.1-or-later", ["lgpl 2 1 or later", "gnu lesser general public license version 2 1 or later"]),
    ("LGPL-3.0-only", ["lgpl 3 0 only", "lgpl 3 0", "lgplv3", "gnu lesser general public license version 3"]),
    ("LGPL-3.0-or-later", ["lgpl 3 0 or later", "gnu lesser general public license version 3 or later"]),
    ("AGPL-3.0-only", ["agpl 3 0 only", "agpl 3 0", "agplv3", "gnu affero general public license version 3"]),
    ("AGPL-3.0-or-later", ["agpl 3 0 or later", "gnu affero general public license version 3 or later"]),
    ("MPL-2.0", ["mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"]),
    ("EPL-2.0", ["epl 2 0", "eclipse public license 2 0", "eclipse public license version 2 0"]),
    ("ISC", ["isc"]),
    ("0BSD", ["0bsd"]),
    ("Zlib", ["zlib"]),
    ("BSL-1.0", ["bsl 1 0", "boost software license 1 0", "boost software license version 1 0"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc by 4 0", "creative commons attribution 4 0 international"]),
    ("CC-BY-SA-4.0", ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"]),
    ("CC-BY-NC-4.0", ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"]),
    ("CC-BY-NC-SA-4.0", ["cc by nc sa 4 0"]),
    ("CC-BY-ND-4.0", ["cc by nd 4 0"]),
    ("CC0-1.0", ["cc0 1 0", "cc0"]),
]
RULES += [(licence, ["Names" + licence]) for licence, _ in NAMES]
LICENCE_OF = {name: licence for licence, names in NAMES for name in names}
#: The longest name first, so that no name is found in place of one that goes on.
_NAME = "(?:" + "|".join(sorted(LICENCE_OF, key=lambda n: (-len(n), n))) + ")"
#: Words that refer to a licence, then one or more names.
REFERENCE = r"\b(?:spdx license identifier|licen[sc]ed under|released under|distributed under|available under|published under)(?: the| a| an| terms of)* " + _NAME + rf"(?: licen[sc]e)?(?: (?:and|or)(?: the)? {_NAME}(?: licen[sc]e)?)*\b"
NAMED = rf"\b{_NAME}\b"
#: The colon of the tag must not end a sentence.
TAG, TAG_WORDS = r"spdx-license-identifier[ \t]*:", "spdx-license-identifier"

#: A sentence ends at . ! ? ; or : before white space, and at a line without a letter or digit. A line break is white space, and so are comment marks.
BOUNDARY = r"[.!?;:][ \t\r\n]+|\n[^0-9a-z\n]*\n"
#: A sentence that isn't known may be of several lines, such as a title or a notice that ends in no mark.
LINE = r"[\r\n]+"
_NOT_WORD = r"[^0-9a-z]+"


def normal_form(sentence: str) -> str:
    return re.sub(_NOT_WORD, " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normal form to identifier; a sentence that holds a boundary is known by its longest part."""
    return {max((normal_form(p) for p in re.split(BOUNDARY, sentence.lower())), key=len): identifier for identifier, sentence in SENTENCES}


def sentences(text: Column) -> Column:
    """Sentences in order, in lower case."""
    return F.split(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), TAG, TAG_WORDS), BOUNDARY)


def references(normal: Column) -> Column:
    """Identifiers of the licences that a sentence in normal form refers to by name, in order."""
    licence_of = F.create_map(*[F.lit(x) for name, licence in LICENCE_OF.items() for x in (name, "Names" + licence)])
    found = F.regexp_extract_all(normal, F.lit(REFERENCE), F.lit(0))
    return F.flatten(F.transform(found, lambda r: F.transform(F.regexp_extract_all(r, F.lit(NAMED), F.lit(0)), lambda n: F.try_element_at(licence_of, n))))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, in order; of a sentence that isn't known, those of its lines, or else of the names it refers to."""
    known = known_sentences()
    name = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    normal = lambda s: F.trim(F.regexp_replace(s, _NOT_WORD, " "))
    of = lambda s: F.try_element_at(name, normal(s))
    lines = lambda s: F.array_compact(F.transform(F.split(s, LINE), of))
    known_or_named = lambda s: F.when(F.size(lines(s)) > 0, lines(s)).otherwise(references(normal(s)))
    return F.flatten(F.transform(sentences(text), lambda s: F.when(of(s).isNotNull(), F.array(of(s))).otherwise(known_or_named(s))))


def matched(sequence: Column) -> Column:
    """Licences whose rules the sequence ``<id><id>...`` follows, each rule consuming its identifiers, sorted and distinct."""
    left, found = sequence, []
    for licence, ids in RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        found.append(F.when(F.contains(left, F.lit(pattern)), F.lit(licence)))
        left = F.replace(left, F.lit(pattern), F.lit("|"))
    unmatched = F.when(left.rlike("<"), F.lit("UNKNOWN"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found, unmatched))))


def recognise(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, sentence_ids, licences.

    Both are arrays. Identifiers that no rule takes up give the licence ``UNKNOWN``. A null or empty
    text has neither; very long texts are searched for a telling word before they are split; repeated rows get the same answer; an
    empty table gives no rows; other columns are ignored.
    """
    # Most texts hold no licence sentence: a search for a word of each spares them the split.
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    hint = text.rlike(r"(?i)licen[sc]e|reserved|redistribution|permission|provided|unencumbered|neither|liable")
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.when(hint, identifiers(text)).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    sequence = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    return found.select("doc_id", "sentence_ids", matched(sequence).alias("licences"))


def op5_sentence_rule_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_sentences, sentence_ids, licences; see ``recognise``."""
    found = recognise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _oracle() -> str:
    known = ",\n    ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    named = ", ".join(f"('{name}', '{licence}')" for name, licence in LICENCE_OF.items())
    steps, left = [], "seq"
    for licence, ids in RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        steps.append(f"CASE WHEN contains({left}, '{pattern}') THEN '{licence}' END")
        left = f"replace({left}, '{pattern}', '|')"
    steps.append(f"CASE WHEN contains({left}, '<') THEN 'UNKNOWN' END")
    return rf"""
WITH k(s, id) AS (VALUES
    {known}
), licence_of(name, licence) AS (VALUES
    {named}
), t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TAG}', '{TAG_WORDS}', 'g'), '{BOUNDARY}') AS p
  FROM documents
), s AS (
  SELECT r, i, p[i] AS p, trim(regexp_replace(p[i], '{_NOT_WORD}', ' ', 'g')) AS s FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM t)
), whole AS (
  SELECT r, i, 0 AS j, id FROM s JOIN k USING (s)
), lines AS (
  SELECT r, i, unnest(range(1, len(l) + 1)) AS j, l FROM (SELECT r, i, regexp_split_to_array(p, '{LINE}') AS l FROM s WHERE s NOT IN (SELECT s FROM k))
), known AS (
  SELECT * FROM whole UNION ALL
  SELECT r, i, j, id FROM (SELECT r, i, j, trim(regexp_replace(l[j], '{_NOT_WORD}', ' ', 'g')) AS s FROM lines) JOIN k USING (s)
), referring AS (
  SELECT r, i, s, regexp_extract_all(s, '{REFERENCE}') AS found FROM s WHERE (r, i) NOT IN (SELECT (r, i) FROM known)
), referred AS (
  SELECT r, i, flatten(list_transform(found, lambda x: regexp_extract_all(x, '{NAMED}'))) AS names FROM referring WHERE len(found) > 0
), named AS (
  SELECT r, i, j, 'Names' || licence AS id FROM (SELECT r, i, unnest(range(1, len(names) + 1)) AS j, unnest(names) AS name FROM referred) JOIN licence_of USING (name)
), hits AS (
  SELECT * FROM known UNION ALL SELECT * FROM named
), q AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids, string_agg('<' || id || '>', '' ORDER BY i, j) AS seq FROM hits GROUP BY r
), l AS (
  SELECT r, n, ids, list_sort(list_distinct(list_filter([{", ".join(steps)}], lambda x: x IS NOT NULL))) AS licences FROM q
)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(licences, ','), '') AS licences
FROM t LEFT JOIN l USING (r)
"""


ORACLE_SQL = {"op5_sentence_rule_licences": _oracle()}
