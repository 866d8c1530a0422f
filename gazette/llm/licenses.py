"""License scans by canonical digest: whole texts, normalised, hashed, and joined to known licence digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its digest looked up, for
the document as a whole and for each of its lines as a text of its own; a joined digest is confirmed on the normalised text.
The table of known texts is a reference table, part of this package (license_texts holds the long ones) or given by the caller.
While it weighs at most `broadcast_bytes` it is broadcast, and texts whose first word begins no known text, spellings
considered, are not normalised any further; beyond, all texts are normalised and hash-joined by a shuffle.

Defined results: null and empty texts, and texts without any word, match nothing; repeated rows each get a row; equal lines
of a document count once each; a document that is one line is reported as a whole and not again as a line.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only

# The public texts of licences and the notices that stand for them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\nTHIS SOFTWARE IS",
    "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS",
)
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: Names by which a notice calls a licence; {v} stands for each version, written "3" and "3.0" alike.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License", "ISC"], "0BSD": ["BSD Zero Clause License", "Zero Clause BSD License", "0BSD"], "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"], "Zlib": ["zlib License", "zlib"],
    "Apache-{v}": ["Apache License, Version {v}", "Apache License {v}", "Apache {v}", "Apache-{v} License"], "GPL-{v}": ["GNU General Public License, version {v}", "GNU General Public License v{v}", "GNU GPL, version {v}", "GNU GPL v{v}", "GPL version {v}", "GPL v{v}", "GPLv{v}", "GPL-{v}"],
    "LGPL-{v}": ["GNU Lesser General Public License, version {v}", "GNU Lesser General Public License v{v}", "GNU LGPL, version {v}", "GNU LGPL v{v}", "LGPL version {v}", "LGPL v{v}", "LGPLv{v}", "LGPL-{v}"], "AGPL-{v}": ["GNU Affero General Public License, version {v}", "GNU Affero General Public License v{v}", "GNU AGPL, version {v}", "GNU AGPL v{v}", "AGPL version {v}", "AGPL v{v}", "AGPLv{v}", "AGPL-{v}"],
    "MPL-{v}": ["Mozilla Public License, version {v}", "Mozilla Public License {v}", "MPL {v}", "MPL-{v}"], "EPL-{v}": ["Eclipse Public License, version {v}", "Eclipse Public License {v}", "Eclipse Public License v{v}", "EPL {v}", "EPL-{v}"], "GFDL-{v}": ["GNU Free Documentation License, version {v}", "GNU Free Documentation License {v}", "GFDL {v}"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "CC0"], "Unlicense": ["Unlicense", "The Unlicense"], "WTFPL": ["WTFPL"],
}
VERSIONS = {"Apache": ["2.0"], "GPL": ["1.0", "2.0", "3.0"], "LGPL": ["2.0", "2.1", "3.0"], "AGPL": ["3.0"], "MPL": ["1.1", "2.0"], "EPL": ["1.0", "2.0"], "GFDL": ["1.2", "1.3"]}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Equivalent spellings: as found, as kept; applied in this order.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"), ("favour", "favor"), ("whilst", "while"), ("third parties", "third party"),
    ("released under", "licensed under"), ("distributed under", "licensed under"), ("published under", "licensed under"), ("available under", "licensed under"), ("made licensed under", "licensed under"), ("is licensed under", "licensed under"), ("this work licensed under", "licensed under"), ("this project licensed under", "licensed under"),
    ("this software licensed under", "licensed under"), ("this program licensed under", "licensed under"), ("this file licensed under", "licensed under"), ("this document licensed under", "licensed under"), ("under the terms of the", "under"), ("under the terms of", "under"), ("licensed under the", "licensed under"), ("licensed under a", "licensed under"), ("or at your option any later version", "or any later version"),
]


def known_texts() -> list[tuple[str, str]]:
    """License and text: whole texts, alone and after their titles, also without what follows the end of the terms; and notices
    for every name of every licence."""
    whole = [("MIT", "MIT License", MIT), ("MIT", "The MIT License (MIT)", MIT), ("MIT", "The MIT License", MIT), ("ISC", "ISC License", ISC), ("ISC", "The ISC License", ISC), ("0BSD", "BSD Zero Clause License", ZERO_BSD), ("0BSD", "Zero-Clause BSD", ZERO_BSD)]
    whole += [("BSD-2-Clause", "BSD 2-Clause License", BSD_2), ("BSD-2-Clause", "The 2-Clause BSD License", BSD_2), ("BSD-3-Clause", "BSD 3-Clause License", BSD_3), ("BSD-3-Clause", "The 3-Clause BSD License", BSD_3), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", BOOST), ("Zlib", "zlib License", ZLIB), ("Zlib", "The zlib License", ZLIB)]
    out = [(k, said) for k, _, said in whole] + [(k, f"{title}\n{said}") for k, title, said in whole]
    for at in sorted(TEXTS.glob("*.txt")):
        said = at.read_text()
        out.append((at.stem, said))
        if END_OF_TERMS in said:
            out.append((at.stem, said[: said.index(END_OF_TERMS) + len(END_OF_TERMS)]))
            out.append((at.stem, said[: said.index(END_OF_TERMS)]))
    names = {k.format(v=v): [n.format(v=x) for n in known for x in {v, v.removesuffix(".0")}] for k, known in NAMES.items() for v in VERSIONS.get(k.split("-")[0], [""])}
    names |= {f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"Creative Commons {said} {v}", f"Creative Commons {said} {v} International", f"Creative Commons {said} {v} International License"] for k, said in COMMONS.items() for v in ("3.0", "4.0")}
    for license_id, known in names.items():
        for name in sorted(known):
            later = [" or any later version"] if license_id.split("-")[0] in ("GPL", "LGPL", "AGPL", "GFDL") else []
            out += [(license_id, f"Licensed under {name}{more}") for more in ["", *later]]
            out += [(license_id, f"Licensed under {name} license")] if not name.lower().endswith("license") else []
            out += [(license_id, f"License: {name}"), (license_id, f"SPDX-License-Identifier: {name}")]
    return out


END_OF_TERMS = "END OF TERMS AND CONDITIONS"
TEXTS = Path(__file__).with_name("license_texts")
KNOWN = known_texts()
COPYRIGHT_LINE = r"(?i)(?:^|\n)[ \t/*#;-]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©)[^\n]*"


def plain(text: Column, lines: bool = True) -> Column:
    """Lower-case words joined by spaces. lines: whether whole copyright lines go."""
    out = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n") if lines else out
    return F.trim(F.regexp_replace(F.lower(out), r"[\x00-\x2F\x3A-\x60\x7B-\x7F©“”‘’–—«»]+", " "))


def spelled(said: Column) -> Column:
    """A plain text in its canonical spelling."""
    out = F.concat(F.lit(" "), said, F.lit(" "))
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {found} "), F.lit(f" {kept} "))
    return F.trim(out)


def normalised(text: Column, lines: bool = True) -> Column:
    """Words of a text in one canonical form, joined by spaces."""
    return spelled(plain(text, lines))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, said, license of each known text."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    said = rows.select("license", normalised(F.col("text")).alias("said")).where("said <> ''")
    return said.groupBy("said").agg(F.min("license").alias("license")).select(F.sha2("said", 256).alias("digest"), "said", "license")


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, license of the text as a whole (null where none is known), line_licenses (distinct, sorted) and n_lines (lines
    that match) of every row."""
    known = known_digests(docs.sparkSession) if known is None else known
    weight = known.agg(F.sum(F.octet_length("said") + 64)).first()[0]
    small = (weight or 0) <= broadcast_bytes
    table = F.broadcast(known) if small else known
    whole = table.select(F.col("digest").alias("w_digest"), F.col("said").alias("w_said"), F.col("license").alias("license"))
    part = table.select(F.col("digest").alias("l_digest"), F.col("said").alias("l_said"), F.col("license").alias("line_license"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text, F.length(text)).alias("text_hash"), "text")
    may = lambda said: F.lit(True)
    if small:
        # a spelling changes a text's first word only where one of the spellings begins with that word
        first = {r.w for r in known.select(F.substring_index("said", " ", 1).alias("w")).distinct().collect()} | {found.split(" ")[0] for found, _ in SPELLINGS}
        may = lambda said: F.substring_index(said, " ", 1).isin(sorted(first))
    lines = F.filter(F.split(text, r"\n"), lambda x: F.trim(x) != "")
    rows = rows.select("doc_id", "text_hash", plain(F.col("text")).alias("said"), lines.alias("lines")).withColumn("many", F.size("lines"))
    # the document itself is the first of them
    parts = F.filter(F.transform("lines", lambda x: plain(x, False)), lambda x: (x != "") & may(x))
    parts = F.concat(F.array(F.when(may(F.col("said")), F.col("said")).otherwise("")), F.when(F.col("many") > 1, parts).otherwise(F.array().cast("array<string>")))
    every = rows.select("doc_id", "text_hash", F.posexplode(parts).alias("at", "said")).withColumn("said", F.when(F.col("said") == "", "").otherwise(spelled(F.col("said"))))
    every = every.select("doc_id", "text_hash", F.when(F.col("at") == 0, F.col("said")).otherwise("").alias("said"), "at", F.when(F.col("at") > 0, F.col("said")).otherwise("").alias("l_norm"))
    joined = every.join(whole, (F.sha2("said", 256) == F.col("w_digest")) & (F.col("said") == F.col("w_said")), "left").join(part, (F.sha2("l_norm", 256) == F.col("l_digest")) & (F.col("l_norm") == F.col("l_said")), "left")
    hits = joined.where((F.col("at") == 0) | F.col("line_license").isNotNull()).select("doc_id", "text_hash", "at", "license", "line_license")
    per = hits.groupBy("doc_id", "text_hash").agg(F.count_if(F.col("at") == 0).alias("times"), F.max("license").alias("license"), F.array_sort(F.collect_set("line_license")).alias("line_licenses"), F.count("line_license").alias("n"))
    return per.select("doc_id", "license", "line_licenses", (F.col("n") / F.col("times")).cast("long").alias("n_lines"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences of every document, as a whole and by line."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.coalesce("license", F.lit("")).alias("license"), F.array_join("line_licenses", ",").alias("line_licenses"), "n_lines")


def _sql() -> str:
    def norm(x: str, lines: bool) -> str:
        out = f"regexp_replace({x}, '{COPYRIGHT_LINE}', chr(10), 'g')" if lines else x
        out = f"' ' || trim(regexp_replace(lower({out}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©“”‘’–—«»]+', ' ', 'g')) || ' '"
        for found, kept in SPELLINGS:
            out = f"replace({out}, ' {found} ', ' {kept} ')"
        return f"trim({out})"

    values = ", ".join("('{}', E'{}')".format(k, v.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\f")) for k, v in KNOWN)
    return f"""
WITH k AS (SELECT said, min(license) AS license FROM (SELECT license, {norm("text", True)} AS said FROM (VALUES {values}) v(license, text)) GROUP BY said),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, license FROM (SELECT r, {norm("t", True)} AS said FROM d) JOIN k USING (said)),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d WHERE len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) > 1),
h AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM (SELECT r, {norm("line", False)} AS said FROM l) JOIN k USING (said) GROUP BY r)
SELECT doc_id, coalesce(w.license, '') AS license, coalesce(ids, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_lines FROM d LEFT JOIN w USING (r) LEFT JOIN h USING (r)"""


ORACLE = {"op10_license_digests": _sql()}
