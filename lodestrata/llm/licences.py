"""Licence scan by canonical digests.

A text is made canonical (lower case, equivalent spellings unified, copyright lines dropped, all but
letters and digits folded to single spaces) and its MD5 is looked up among the digests of known licences
and notices. Whole texts are units, and so are each document's lines, since documents carry
notices as lines of their own; a unit counts only if all of it equals the known text.

Whole texts are also held against the full licences in ``licence_texts``, with and without their title
lines. Short licences and notices longer than a line are known within documents too, however they are wrapped, spaced or
divided: where the canonical words go as the first ``HEAD`` of a known text, the runs from there of all
lengths that known texts have are looked up by their digests.

The known table is fixed and small (its size is that of this file), so it is broadcast.

Defined results: null texts have no digest and no units; blank units are no licence; a document with
several notices lists each identifier once, in order; rows that share a doc_id are judged together; extra
columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (identifier, text) of licences and of the usual notices.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]

# Words with the same meaning in licences, written one way.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("noncommercial", "non commercial"), ("https", "http"), ("v2", "version 2"), ("v3", "version 3"), ("ver", "version"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"), ("c", "copyright")]
COPYRIGHT = r"^[^a-z0-9©\n]*(copyright|\(c\)|©)[^\n]*$"

RIGHTS = "(?i)licen[cs]e|permission|software|rights|terms|CC"

# Usual title lines of short licences.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "BSD-2-Clause"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Words by which the beginning of a known text is found.
HEAD = 12


def _short() -> list[tuple[str, str]]:
    """(identifier, text without a title) of short licences and of notices longer than a line."""
    read = lambda name: (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text()
    bsd = read("BSD-3-Clause")
    bsd = bsd[bsd.index("Redistribution") :]
    clauses = [bsd]
    third = re.search(r"\n[ *\d.-]*Neither the name.*?\n\s*\n", bsd, re.S)
    two = bsd[: third.start()].rstrip() + "\n\n" + bsd[third.end() :]
    clauses += [re.sub(r"(?m)^(\s*)\*", lambda m, n=iter("123"): f"{m[1]}{next(n)}.", bsd), re.sub(r"(?m)^(\s*)\d\.", r"\1*", bsd)]
    pairs = [two, re.sub(r"(?m)^(\s*)\*", lambda m, n=iter("123"): f"{m[1]}{next(n)}.", two), re.sub(r"(?m)^(\s*)\d\.", r"\1*", two)]
    long = [(k, t) for k, t in KNOWN if len(t) > 150]
    return long + [("BSD-3-Clause", t) for t in clauses] + [("BSD-2-Clause", t) for t in pairs] + [("Unlicense", read("Unlicense"))]


def _full() -> list[tuple[str, str]]:
    """(identifier, whole text) with and without title lines."""
    out = []
    for name, text in _short():
        for reserved in ("", "All rights reserved.\n\n"):
            out += [(name, f"{title}\n\n{reserved}{text}") for title in ["", *TITLES.get(name, [])]]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        if path.stem not in TITLES:
            text = path.read_text().strip()
            out += [(path.stem, text), (path.stem, re.split(r"\n\s*\n", text, maxsplit=1)[1])]
            if "END OF TERMS AND CONDITIONS" in text:  # what follows tells how to apply the licence
                out += [(k, t[: t.index("END OF TERMS AND CONDITIONS")] + end) for k, t in out[-2:] for end in ("", "END OF TERMS AND CONDITIONS")]
    return out


def _digests(docs: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, licence), a row a digest."""
    rows = docs.sparkSession.createDataFrame(texts, "licence string, text string")
    return rows.groupBy(F.md5(canonical(F.col("text"))).alias("digest")).agg(F.min("licence").alias("licence"))


def _runs(canon: Column, table: list[tuple[str, int]]) -> Column:
    """Digests of the runs of words that begin, anywhere in a canonical text, as a known text does, one for each length that such texts have.

    ``table`` holds the first words and the number of words of the known texts.
    """
    heads, lengths = sorted({head for head, _ in table}), sorted({size for _, size in table})
    # Each piece begins with the first words of a known text; a known text may reach over several.
    pieces = F.split(canon, r"\b(?=(?:" + "|".join(heads) + r")\b)")
    over = max(lengths) // HEAD + 2
    begun = F.transform(pieces, lambda piece, i: F.split(F.array_join(F.slice(pieces, i + 1, F.lit(over)), ""), " "))
    begun = F.filter(begun, lambda words: F.array_join(F.slice(words, 1, HEAD), " ").isin(heads))
    sizes = F.array(*map(F.lit, lengths))
    run = lambda words, n: F.md5(F.array_join(F.slice(words, F.lit(1), n), " "))
    own = lambda words: F.transform(F.filter(sizes, lambda n: n <= F.size(words)), lambda n: run(words, n))
    return F.array_distinct(F.flatten(F.transform(begun, own)))


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words alone, one spelling of each."""
    words = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), "(?dm)" + COPYRIGHT, " "), r"[^a-z0-9]+", " "))
    pattern = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"
    one_way = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    fixed = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(one_way, w), w)), " ")
    return F.when(words.rlike(pattern), fixed).otherwise(words)


def known(docs: DataFrame) -> DataFrame:
    """(digest, licence) of the fixed table."""
    rows = docs.sparkSession.createDataFrame(KNOWN, "licence string, text string")
    return rows.select(F.md5(canonical(F.col("text"))).alias("digest"), "licence").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the canonical whole text, licence of the whole text, and the licences of its lines."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = F.broadcast(known(docs))  # the fixed table above
    full = F.broadcast(_digests(docs, KNOWN + _full()))
    whole = own.select("doc_id", F.md5(canonical(F.col("text"))).alias("digest")).join(full, "digest", "left")
    line = F.col("line")
    # A line that says nothing of rights can't equal a known text.
    lines = own.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(line.rlike(RIGHTS))
    single = lines.select("doc_id", F.md5(canonical(line)).alias("digest")).join(table, "digest")
    canon = F.col("canon")
    texts = own.sparkSession.createDataFrame([t for t in _short() if len(t[1]) > 150], "licence string, text string").select("licence", canonical(F.col("text")).alias("canon"))
    words = F.split("canon", " ")
    short = [tuple(r) for r in texts.select(F.array_join(F.slice(words, 1, HEAD), " "), F.size(words)).distinct().collect()]  # of the fixed table
    begun = own.select("doc_id", canonical(F.col("text")).alias("canon")).filter(canon.rlike("|".join(sorted({head for head, _ in short}))))
    runs = texts.groupBy(F.md5("canon").alias("digest")).agg(F.min("licence").alias("licence"))
    several = begun.select("doc_id", F.explode(_runs(canon, short)).alias("digest")).join(F.broadcast(runs), "digest")
    # A known text on one line is a line's notice, and counts once for each line, not as a run of words again.
    row = lambda df, lines: df.select("doc_id", "digest", "licence", F.lit(lines).alias("lines"))
    each = row(single, 1).union(row(several, 0)).groupBy("doc_id", "digest", "licence").agg(F.greatest(F.sum("lines"), F.lit(1)).alias("n"))
    found = each.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.array_sort(F.collect_set("licence")).alias("held"))
    return whole.join(found, whole["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        whole["doc_id"], "digest", "licence", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.array_join("held", ","), F.lit("")).alias("notices")
    )


def _canonical_sql(text: str) -> str:
    words = f"trim(regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    fixed = words
    for old, new in SPELLINGS:
        fixed = f"regexp_replace({fixed}, '\\b{old}\\b', '{new}', 'g')"
    return fixed


def scan_sql() -> str:
    """``scan`` of documents as DuckDB SQL, by the texts of ``KNOWN`` alone: it has no full licences and no units of several lines."""
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT md5({_canonical_sql("t")}) AS digest, licence FROM (VALUES {rows}) v(licence, t)),
whole AS (SELECT doc_id, md5({_canonical_sql("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
held AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT licence)), ',') AS notices
  FROM (SELECT doc_id, md5({_canonical_sql("line")}) AS digest FROM lines WHERE regexp_matches(line, '{RIGHTS}')) JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.licence, coalesce(h.n, 0)::BIGINT AS n_notices, coalesce(h.notices, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN held h ON h.doc_id = w.doc_id
"""
