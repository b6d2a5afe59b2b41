"""License scans by canonical digests, in built-in DataFrame functions only.

A text is brought to a canonical form: lower case, equivalent spellings made one, copyright clauses dropped, punctuation
and white space turned into single blanks. A copyright clause begins a line and ends with it, or at a full stop which
one of the words follows that licences begin with; letters, marks and digits of all scripts stay. The SHA-256 of that form is looked up by a hash join among the digests of
known licences and licence notices. Two kinds of text are looked up: each whole text by the join, and each of its lines, for
notices that stand on a line of their own, by a hashed intersection within the row. Texts are read once and nothing is
shuffled.

The registry is a list shipped with the code or given as a parameter; it has a fixed number of rows (checked against
``MAX_REGISTRY``), so collecting and broadcasting it is bounded whatever the corpus.

Defined results: a null text has a null digest and no match; an empty one has the digest of the empty string, which is
no licence. Lines that are empty after normalisation are not looked up. Repeated rows get equal results, as they
have equal ids and texts; rows with one ``doc_id`` and different texts are told apart by their digest. A null
``doc_id`` keeps its row. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_REGISTRY = 10_000

#: Known texts by (licence, kind): whole licences and the notices that name them. These are fixed values.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Distributed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "0BSD": ("SPDX-License-Identifier: 0BSD",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "CC0-1.0": ("Licensed under CC0 1.0.", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
}

_BSD_2 = KNOWN["BSD-2-Clause"][0]
_BSD_3 = _BSD_2.replace(
    " THIS SOFTWARE IS",
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS",
    1,
)
_ISC = KNOWN["ISC"][0]
#: More whole licences, without their titles.
WHOLE: dict[str, tuple[str, ...]] = {
    "MIT": (KNOWN["MIT"][0],),
    "ISC": (_ISC, _ISC.replace("and/or", "and", 1)),
    "BSD-2-Clause": (_BSD_2, _BSD_2.replace(" 1. ", " ").replace(" 2. ", " ")),
    "BSD-3-Clause": (_BSD_3, _BSD_3.replace(" 1. ", " ").replace(" 2. ", " ").replace(" 3. ", " ")),
    "Zlib": (KNOWN["Zlib"][0],),
    "0BSD": (_ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
}
_WHOLE_ENDS = (" For more information, please refer to <https://unlicense.org>", " For more information, please refer to <https://unlicense.org/>")
WHOLE["Unlicense"] += tuple(WHOLE["Unlicense"][0] + end for end in _WHOLE_ENDS)
#: Title lines that files begin with.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def _files() -> dict[str, tuple[str, ...]]:
    """The long licences, which are kept as files: whole, without the blocks of title lines, and without an appendix."""
    out = {}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text(encoding="utf-8").strip()
        bodies = [text, *(text.split("\n\n", k)[k] for k in (1, 2))]
        end = "END OF TERMS AND CONDITIONS"
        out[path.stem] = tuple(dict.fromkeys([*bodies, *(b[: b.index(end) + len(end)] for b in bodies if end in b), *(b[: b.index(end)] for b in bodies if end in b)]))
    return out


def _complete(known: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    files = _files()
    titled = {n: tuple(f"{t}\n{x}" for t in TITLES[n] for x in texts) for n, texts in WHOLE.items()}
    names = dict.fromkeys([*known, *WHOLE, *files])
    return {n: tuple(dict.fromkeys([*known.get(n, ()), *WHOLE.get(n, ()), *titled.get(n, ()), *files.get(n, ())])) for n in names}


KNOWN = _complete(KNOWN)

#: Words that follow "copyright" or "(c)" in the bodies of licences, where lines may be wrapped before it.
BODY_WORDS = (
    "notice notices holder holders owner owners license licenses licence licences law laws statement statements interest interests permission permissions "
    "protection treaty treaties disclaimer disclaimers right rights and or on in of to is are as if for with under you that which such any may its it this"
).split()


def _other_word(words: Sequence[str]) -> str:
    """A pattern of the rest of a line that begins with a word in small letters which is none of ``words``; without lookahead."""
    heads = sorted({w[0] for w in words if w})
    others = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in heads)
    ways = [f"[{others}][^\\n]*"] if others else []
    for head in heads:
        rest = [w[1:] for w in words if w[:1] == head]
        ways.append(head + "(?:" + _other_word(rest) + ("" if "" in rest else r"|[^a-z\n][^\n]*|\z") + ")")
    return "|".join(ways)


_HOLDER = _other_word(BODY_WORDS)
#: Words at which a licence, its name or another clause begins after a copyright clause on the same line.
STARTS = "permission permitted redistribution redistributions released licensed distributed this the all use everyone any unless you see it in".split()
#: A copyright clause: one with a sign, a year or a holder, at the beginning of a line. In syntax that Java and RE2 read alike, for lower case; group 1 is what follows it.
_CLAUSE = _HOLDER.replace(r"[^\n]*", r"[^\n]*?")
COPYRIGHT = (
    rf"^[ \t*#/;-]*(?:copyright[ \t:]*[^a-z \t:,.;)\"\n-][^\n]*?|copyright[ \t:]+(?:{_CLAUSE})|\(c\)[ \t]*[^a-z \t\n][^\n]*?|\(c\)[ \t]*(?:copyright[^\n]*?|{_CLAUSE})|©[^\n]*?|all rights reserved[^\n]*?)"
    rf"(?:\.[ \t]+((?:{'|'.join(STARTS)})[ \t][^\n]*))?$"
)
#: Equivalent spellings in lower case, replaced in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("non-commercial", "noncommercial"),
    ("share-alike", "sharealike"),
    ("merchantibility", "merchantability"),
    ("https://", ""),
    ("http://", ""),
)
#: Whatever is no letter, mark or digit of any script.
PUNCTUATION = r"[^\p{L}\p{M}\p{N}]+"
#: Words that notices put in or leave out, once punctuation is blanks.
FILLERS = (" version ", " v ")


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without those that come out empty."""
    return F.filter(F.transform(F.split(F.lower(text), "\n"), _line), lambda x: x != "")


def _line(line: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(line, COPYRIGHT, "$1"), COPYRIGHT, "$1")  # twice: "all rights reserved" may follow a holder
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for filler in FILLERS:
        out = F.replace(out, F.lit(filler), F.lit(" "))
    return F.trim(out)


def canonical_lines_sql(text: str) -> str:
    """The same as a DuckDB expression."""
    out = rf"regexp_replace(regexp_replace(x, '{COPYRIGHT}', '\1'), '{COPYRIGHT}', '\1')"
    for one, other in SPELLINGS:
        out = f"replace({out}, '{one}', '{other}')"
    out = f"regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')"
    for filler in FILLERS:
        out = f"replace({out}, '{filler}', ' ')"
    return f"list_filter(list_transform(string_split(lower({text}), chr(10)), lambda x: trim({out})), lambda x: x <> '')"


def digest_of(lines: Column) -> Column:
    """The digest of a whole text by its canonical lines."""
    return F.sha2(F.array_join(lines, " "), 256)


def registry(spark, known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """Known digests: ``digest, license``. Of two licences with one digest the first by name counts."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    if len(rows) > MAX_REGISTRY:
        raise ValueError(f"a registry has at most {MAX_REGISTRY} texts")
    table = spark.createDataFrame(rows, "license string, text string")
    return table.groupBy(digest_of(canonical_lines(F.col("text"))).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: Mapping[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, license`` of the whole text and ``notices``, sorted, of its lines."""
    digests = registry(docs.sparkSession, known)
    rows = sorted(digests.collect())
    of = F.map_from_arrays(F.array(*(F.lit(d) for d, _ in rows)), F.array(*(F.lit(n) for _, n in rows)))
    some = docs.select("doc_id", canonical_lines(F.col("text").cast("string")).alias("lines"))
    found = F.array_intersect(F.transform("lines", lambda x: F.sha2(x, 256)), F.array(*(F.lit(d) for d, _ in rows)))
    named = F.array_sort(F.array_distinct(F.transform("found", lambda d: F.element_at(of, d))))
    some = some.select("doc_id", digest_of(F.col("lines")).alias("digest"), found.alias("found"))
    some = some.select("doc_id", "digest", F.when(F.size("found") > 0, F.array_join(named, ",")).alias("notices"))
    # at most MAX_REGISTRY rows
    return some.join(F.broadcast(digests), "digest", "left").select("doc_id", "digest", "license", "notices")


def scan_sql(known: Mapping[str, tuple[str, ...]] = KNOWN) -> str:
    """DuckDB SQL for ``scan``."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in known.items() for text in texts)
    return f"""
    WITH known AS (SELECT sha256(array_to_string({canonical_lines_sql("t")}, ' ')) AS digest, min(l) AS license FROM (VALUES {values}) v(l, t) GROUP BY 1),
    docs AS (SELECT doc_id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM (SELECT doc_id, {canonical_lines_sql("text")} AS lines FROM documents)),
    notices AS (SELECT x.doc_id, x.digest, array_to_string(list_sort(list(DISTINCT k.license)), ',') AS notices
        FROM (SELECT doc_id, digest, sha256(unnest(lines)) AS line_digest FROM docs) x JOIN known k ON k.digest = x.line_digest GROUP BY 1, 2)
    SELECT d.doc_id, d.digest, k.license, n.notices FROM docs d LEFT JOIN known k ON k.digest = d.digest
    LEFT JOIN notices n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.digest = d.digest
    """
