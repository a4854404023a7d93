"""Licence scans by canonical digest, in DataFrame operations only.

A text is put into canonical form: lower case, lines that state a copyright, reserve all rights or are a
title of a short licence dropped, punctuation and blanks reduced to single blanks, equivalent spellings
made one; so neither titles nor line breaks matter.  The SHA-256 of that form is looked up among the
digests of known licence texts by a hash join.  Entire texts are compared: first the whole document, then
each of its lines, by which a one-line notice is found.

Plan: one scan, no shuffle: the catalogue is a few dozen rows given by the caller, and is broadcast
only while it has at most ``BROADCAST_ROWS`` rows.  Beyond, digests of texts and lines are joined, with
128 bits of hash of their text, and only what is found comes back to the documents (broadcast up to
``BROADCAST_FOUND`` texts).  Every line is canonicalised: no word is common to all notices, less so to
those a caller adds.

Defined cases: null and empty texts match nothing, and so do texts that are blank in canonical form;
catalogue rows with one digest are reported together, the names in order, and rows without a name or
text count for nothing; repeated rows each get a row; very long texts are taken whole; other columns
stay, and one that is named as the result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import scratch
from fieldnotes.llm.common import free_name, others, read

BROADCAST_ROWS = 256
BROADCAST_FOUND = 1_000_000

# Equivalent spellings (words, replacement), applied in order to words between single blanks.
SPELLINGS = (
    ("licenc", "licens"),
    (" sub licens", " sublicens"),
    (" merchantibility ", " merchantability "),
    (" non infringement ", " noninfringement "),
    (" copyright holder", " copyright owner"),
    (" https ", " http "),
    (" version ", " v"),
)

#: Statements of copyright within the long texts and the notices that they suggest, wherever lines break.
STATEMENT = (
    r"copyright \(c\)\s+(?:[0-9][0-9,\s]*free\s+software\s+foundation,\s+inc\.(?:,|\s+<https?://fsf\.org/>)?"
    r"|(?:<year>|19yy|year)\s+(?:<name\s+of\s+author>|your\s+name)|_+\s+_+)"
)

#: A line that states a copyright: it begins with the word or (c), and gives a sign, or a year next or last;
#: or it begins with ©.
COPYRIGHT = (
    r"(?:copyright|\(c\))(?:[\x20\t:,-]*(?:(?:19|20)[0-9]{2}|\[yyyy\]|<year>)[^\n]*|[^\n]*(?:\(c\)|©)[^\n]*"
    r"|[^\n]*(?:19|20)[0-9]{2}[\x20\t\r.,;]*(?:all rights reserved[\x20\t\r.]*)?)|©[^\n]*"
)

#: A line that reserves all rights, or the title of a short licence.
TITLE = (
    r"(?:all rights reserved"
    r"|(?:the )?(?:mit|isc|zlib|bsd|(?:new|modified|revised|simplified) bsd|(?:[023]|zero|two|three)[ -]clause bsd"
    r"|bsd (?:[023]|zero|two|three)[ -]clause(?: \"[a-z]+\"(?: or \"[a-z]+\")?)?|boost software) licen[cs]e(?: \([a-z0-9-]+\))?"
    r"|zero-clause bsd|boost software licen[cs]e - version 1\.0 - august 17th,[\x20\t]+2003|(?:the )?unlicense)[\x20\t\r.:]*"
)

#: Lines that say nothing of a licence's terms.
DROPPED = rf"^[\x20\t*#/;-]*(?:{COPYRIGHT}|{TITLE})$"

#: What stands between words: blanks and punctuation of ASCII, no-break blanks, dashes, curly quotes.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{201F}\x{2026}]+"

# One-line notices and the short licences' texts, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>",
    ),
)

# Digests of the canonical forms of long licence texts, as published.
DIGESTS = (
    ("Apache-2.0", "548a8fa0e316cd796a8faf1ecd18b0d1ea567c5214382b6df18975fda2c6f63a"),
    ("Artistic-1.0-Perl", "66ebbee7f29e04172dca3cccd45e67e4060e0d0df5f4801f57a8afac007d0e04"),
    ("CC0-1.0", "976b0f9cb0d01a3b180e3acf46433f38d5c43a3bd163e4ddacaf7db20de9d627"),
    ("GFDL-1.2-only", "a931017a4128bfed0359a7089e01b6edeb0d0a569786efae91fdf2b9d9ecfc6f"),
    ("GFDL-1.3-only", "4d00f3100897300d5d6fb6fbbcf4f5004873a455a731ec58311d07e6c1348e94"),
    ("GPL-1.0-only", "8364033a793c915d564d9960f4c1e8c6772405e94db734f5fbc7e39a892aa1a5"),
    ("GPL-2.0-only", "2ff8b7758bafdb1ae717023b48a28b501aa13e9bb1368a17c78ea93b9a6fb894"),
    ("GPL-3.0-only", "b9b1219e33d300d1883fb20bd7be5df2aeae9ed390b663dc8b2c8ee39c13b798"),
    ("LGPL-2.0-only", "190576efcc72209c8ed198ea7a1754307bf384b4cadef7e2fdd10047644cc46e"),
    ("LGPL-2.1-only", "858cb1153ac332fda4dbc5c82d258956b291a2d6dd374ce5561172295a414843"),
    ("LGPL-3.0-only", "2afb8c73174cf61997f541127f053814cc8fcbaca9fc4a6e70e12533a804de59"),
    ("MPL-1.1", "7020319a02564609877b5de2634e07892446709171a35432744b2b4b6670e650"),
    ("MPL-2.0", "9491984e562193ea5b26edb7a203e80263a87df0539c40d16573c993fb9f8c1e"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), STATEMENT, " "), "(?md)" + DROPPED, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), BETWEEN, " "), F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if that is empty."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def line_digest(text: Column) -> Column:
    """The same for a line; an empty form isn't singled out, since the catalogue holds none."""
    return F.sha2(canonical(text), 256)


def catalogue(spark: SparkSession, notices: tuple[tuple[str, str], ...] = NOTICES, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(license, text, digest) of what is known here: texts, or the digests of their canonical forms; a
    caller may add rows of its own."""
    rows = [(name, text, None) for name, text in notices] + [(name, None, known) for name, known in digests]
    return spark.createDataFrame(rows, "license string, text string, digest string")


def scan(docs: DataFrame, known: DataFrame, into: str = "licenses") -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``licenses`` (or ``into``): digest (of the whole
    text), whole (names, comma-joined, of the licences that the text is; null if none), lines (names of
    the notices that its lines are, in order and each once) and n_lines (how many lines are one).

    ``known`` has a license and a text, or a digest of a canonical form.
    """
    given = F.col("digest") if "digest" in known.columns else F.lit(None).cast("string")
    names = known.select("license", F.coalesce(given, digest(F.col("text"))).alias("known")).filter("known IS NOT NULL AND license IS NOT NULL")
    names = names.groupBy("known").agg(F.array_sort(F.collect_set("license")).alias("names"))
    table = names.agg(F.count("*").alias("n")).first()["n"]
    if table > BROADCAST_ROWS:
        return _scan_joined(docs, names, into)
    digests, each, key, whole, table = (free_name(docs, n) for n in ("license_digest", "license_lines", "license_key", "license_whole", "license_table"))
    entire = F.broadcast(names.select(F.col("known").alias(key), F.array_join("names", ",").alias(whole)))
    by_digest = names.agg(F.map_from_entries(F.collect_list(F.struct("known", "names")))).scalar()
    marked = docs.withColumn(digests, digest(F.col("text"))).withColumn(each, F.coalesce(F.transform(F.split("text", "\n"), line_digest), F.array().cast("array<string>")))
    joined = marked.join(entire, F.col(digests) == F.col(key), "left").withColumn(table, by_digest)
    found = F.filter(F.transform(each, lambda d: F.try_element_at(F.col(table), d)), lambda x: x.isNotNull())
    return joined.select(*others(docs, into), _result(F.col(digests), F.col(whole), found).alias(into))


def _result(whole_digest: Column, whole: Column, found: Column) -> Column:
    names = F.array_sort(F.array_distinct(F.flatten(found)))
    return F.struct(whole_digest.alias("digest"), whole.alias("whole"), names.alias("lines"), F.size(found).cast("long").alias("n_lines"))


def _scan_joined(docs: DataFrame, names: DataFrame, into: str) -> DataFrame:
    """The same for a catalogue too large to broadcast: digests are joined, not texts."""
    own = [F.xxhash64("text").alias("r1"), F.xxhash64(F.lit("#"), F.col("text")).alias("r2")]
    # a number for each line, and -1 for the whole text
    each = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), line_digest(x).alias("known")))
    entire = F.array(F.struct(F.lit(-1).alias("at"), digest(F.col("text")).alias("known")))
    parts = docs.select(*own, F.explode(F.concat(entire, each)).alias("p")).select("r1", "r2", "p.at", "p.known").filter("known IS NOT NULL")
    hits = parts.join(names, "known").select("r1", "r2", "at", "names").distinct()
    hits = hits.groupBy("r1", "r2").agg(F.max(F.when(F.col("at") < 0, F.array_join("names", ","))).alias("whole"), F.collect_list(F.when(F.col("at") >= 0, F.col("names"))).alias("found"))
    row, one, two, whole, found = (free_name(docs, n) for n in ("license_row", "license_r1", "license_r2", "license_whole", "license_found"))
    hits = scratch.cut(hits, "found").toDF(one, two, whole, found)
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_FOUND else hits
    marked = docs.withColumn(row, F.struct(*own))
    joined = marked.join(hits, (F.col(row)["r1"] == F.col(one)) & (F.col(row)["r2"] == F.col(two)), "left")
    none = F.array().cast("array<array<string>>")
    return joined.select(*others(docs, into), _result(digest(F.col("text")), F.col(whole), F.coalesce(found, none)).alias(into))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), catalogue(spark))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("licenses.digest").alias("text_digest"),
        F.col("licenses.whole").alias("whole_license"),
        F.array_join("licenses.lines", ",").alias("line_licenses"),
        F.col("licenses.n_lines").alias("n_lines"),
    )


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '{STATEMENT}', ' ', 'g'), '(?m){DROPPED}', ' ', 'g')"
    out = f"' ' || regexp_replace(replace({out}, '&', ' and '), '{BETWEEN}', ' ', 'g') || ' '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{one}')"
    return f"trim({out})"


def op6_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)}, NULL)" for name, text in NOTICES)
    rows = ", ".join([rows, *(f"({quoted(name)}, NULL, {quoted(known)})" for name, known in DIGESTS)])
    return f"""
WITH known AS (
  SELECT dig, list_sort(list(DISTINCT license)) AS names
  FROM (SELECT license, COALESCE(given, sha256({_canonical_sql("text")})) AS dig FROM (VALUES {rows}) AS t(license, text, given)) GROUP BY dig),
d AS (SELECT doc_id, CASE WHEN {_canonical_sql("text")} <> '' THEN sha256({_canonical_sql("text")}) END AS dig FROM documents),
held AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
hits AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(names)))) AS names, count(*) AS n
  FROM held h JOIN known k ON sha256({_canonical_sql("l")}) = k.dig GROUP BY doc_id)
SELECT d.doc_id, d.dig AS text_digest, array_to_string(k.names, ',') AS whole_license,
  COALESCE(array_to_string(h.names, ','), '') AS line_licenses, CAST(COALESCE(h.n, 0) AS BIGINT) AS n_lines
FROM d LEFT JOIN known k ON d.dig = k.dig LEFT JOIN hits h ON d.doc_id = h.doc_id"""
