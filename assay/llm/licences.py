"""Licence scans by canonical digests: texts are normalised, and their digests are joined with those of known licences.

All on DataFrame functions, and the same steps as SQL text for other engines.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.tables import LOWER, UPPER, named

# Spellings that licence guidelines count as equal. Fixed values.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub-license": "sublicense",
    "sub-licence": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
# Short texts, as (licence, text without its title). Fixed values.
_SHORT = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     + _WARRANTY),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. "
     + _ISC_WARRANTY),
    ("0BSD", f"{_ISC}. {_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
     "changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND "
     "CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
     "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
     "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
     "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
     "copyright law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
     + " For more information, please refer to <https://unlicense.org/>"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
     "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is "
     "furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including "
     "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in "
     "whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
     "machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
     "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
     "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
# Titles in use, the usual one first; every text may also stand without one.
_TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License",
                     "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License",
                     "New BSD License", "Modified BSD License", "BSD License"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
}
_NAMES = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"}


def _wordings(text: str) -> list[str]:
    """A short text as it is published: numbered or bulleted, for holders or owners, with the one or the other "or"."""
    out = [text]
    for old, new in (("modify, and/or distribute", "modify, and distribute"), ("SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR"),
                     ("following conditions are met: 1. Redistributions", "following conditions are met: Redistributions"),
                 ("<https://unlicense.org/>", "<http://unlicense.org>")):
        more = [t.replace(old, new) for t in out if old in t]
        if "1. Redist" in old:
            more = [t.replace(" 2. Redistributions", " Redistributions").replace(" 3. Neither", " Neither") for t in more]
        out += more
    return list(dict.fromkeys(out))


def _short_texts() -> list[tuple[str, str]]:
    heads = lambda name: [f"{t} ".lstrip() for t in [*_TITLES[name], ""]]
    rights = ("", "All rights reserved. ")
    return [(name, f"{head}{r}{t}") for name, text in _SHORT for head in heads(name) for r in rights for t in _wordings(text)]


def _long_texts() -> list[tuple[str, str]]:
    """The published files, whole and up to the end of their terms."""
    out = []
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        name, text = _NAMES.get(file.stem, file.stem), file.read_text(encoding="utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(name, text)] + [(name, t) for t in (terms, terms + end) if end]
    return out


# Texts and notices of public licences, as (licence, text).
KNOWN = [
    *_short_texts(),
    *_long_texts(),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]

_QUOTES, _PLAIN = "“”‘’–—", "\"\"''--"
_COPYRIGHT = r"(^|\n)[ \t]*[*#/;-]*[ \t]*(copyright\b|\(c\)|©)[^\n]*"
# In texts of licences these follow the word; such lines are no notices of an owner, and they may be wrapped anywhere.
_LEGAL = {"notice": "notice", "holder": "holder", "owner": "owner", "interest": "interest", r"laws?\b": "law"}
_SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GLUED = [(rf"\bcopyright[ \t\r\n*#/;-]+{w}", f"copyright{word}") for w, word in _LEGAL.items()]
# Longer words first, since a hyphen is also a word boundary.
_RULES = [*_GLUED, (_COPYRIGHT, "\n"), *[(rf"\b{a}\b", SPELLINGS[a]) for a in sorted(SPELLINGS, key=len, reverse=True)]]
_ANY = r"\b(" + "|".join(sorted(SPELLINGS, key=len, reverse=True)) + r")\b"


def _plain(text: Column) -> Column:
    """Lower case, plain quotes and dashes, and no gap between "copyright" and a legal word."""
    plain = F.translate(text, UPPER + _QUOTES, LOWER + _PLAIN)
    glued = plain
    for pattern, word in _GLUED:
        glued = F.regexp_replace(glued, pattern, word)
    return F.when(plain.contains("copyright"), glued).otherwise(plain)


def canonical(text: Column) -> Column:
    """Lower case, plain quotes and dashes, no copyright lines of an owner, one spelling, and one space for each run of signs."""
    return _canonical(_plain(text))


def _canonical(plain: Column) -> Column:
    plain = F.when(plain.rlike(_COPYRIGHT), F.regexp_replace(plain, _COPYRIGHT, "\n")).otherwise(plain)
    spelled = plain
    for pattern, word in _RULES[len(_GLUED) + 1 :]:
        spelled = F.regexp_replace(spelled, pattern, word)
    plain = F.when(plain.rlike(_ANY), spelled).otherwise(plain)
    return F.trim(F.regexp_replace(plain, _SIGNS, " "))


def _digested(rows: DataFrame, other: str, text: str) -> DataFrame:
    """The column ``other`` and the digest of the canonical text; in two steps, as each step names its input several times."""
    return rows.select(other, _plain(F.col(text)).alias("plain")).select(other, F.sha2(_canonical(F.col("plain")), 256).alias("digest"))


def _may_match(known: list[tuple[str, str]]) -> str:
    """A pattern that every line with the canonical text of a known one has: its first word, in any spelling.

    Signs in front do not count. A word may also be the beginning of a spelling that the rules change.
    """
    first = lambda t: re.search(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|$", t.translate(str.maketrans(UPPER + _QUOTES, LOWER + _PLAIN)))[0]
    words = {first(text) for _, text in known} | {first(a) for a in SPELLINGS} | {first(b) for b in SPELLINGS.values()} | {"copyright"}
    if "" in words or not all(w.isascii() for w in words):
        return ""
    return rf"^[^A-Za-z0-9]*(?i:{'|'.join(sorted(words))})(?![A-Za-z0-9])"


def canonical_sql(text: str) -> str:
    """The same as an expression of DuckDB."""
    plain = f"translate({text}, '{UPPER}{_QUOTES}', '{LOWER}{_PLAIN}')".replace("\"\"''--", "\"\"''''--")
    for pattern, word in _RULES:
        plain = f"regexp_replace({plain}, '{pattern}', {'chr(10)' if pattern == _COPYRIGHT else repr(word)}, 'g')"
    return f"trim(regexp_replace({plain}, '{_SIGNS}', ' ', 'g'))"


def known_licences(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest, licence``: a fixed table of as many rows as there are known texts."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in known]))
    table = _digested(spark.range(1).select(rows.alias("k")).select("k.licence", "k.text"), "licence", "text")
    return table.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, digest, licence, notices, n_notices``.

    ``digest`` is the SHA-256 of the canonical text and ``licence`` the known licence whose text the document is,
    else null. A licence line counts too: ``notices`` lists the licences whose whole text is one line of the document,
    sorted and comma-joined, and ``n_notices`` counts those lines. A null or empty text has the digest of an
    empty text and no licence. Rows without an id are left out; rows that repeat an id are united, with the smallest
    digest and licence.

    The known table is joined on digests: by broadcast where it is the fixed one of this module, else as Spark decides.
    """
    fixed = known is None
    known = known_licences(df.sparkSession) if fixed else known
    known = F.broadcast(known) if fixed else known
    rows = named(df, id_col, text_col)
    whole = _digested(rows, "doc_id", "text").join(known, "digest", "left")
    whole = whole.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.min("licence").alias("licence"))
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    if fixed:
        lines = lines.filter(F.col("line").rlike(_may_match(KNOWN)))
    lines = _digested(lines, "doc_id", "line").join(known, "digest")
    lines = lines.groupBy("doc_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("notices"), F.count("*").alias("n_notices")
    )
    return whole.join(lines, "doc_id", "left").select(
        "doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
    )


def scan_sql() -> str:
    """The query over ``documents`` for DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""
    WITH known AS (
        SELECT digest, min(licence) AS licence
        FROM (SELECT licence, sha256({canonical_sql('t')}) AS digest FROM (VALUES {quoted}) AS v(licence, t)) GROUP BY digest
    ), whole AS (
        SELECT doc_id, min(sha256({canonical_sql("coalesce(text, '')")})) AS digest
        FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
    ), found AS (
        SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
        FROM lines JOIN known ON sha256({canonical_sql('line')}) = digest GROUP BY doc_id
    )
    SELECT w.doc_id, w.digest, k.licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0) AS n_notices
    FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN found f ON w.doc_id = f.doc_id
    """
