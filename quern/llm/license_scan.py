"""License scan by canonical digests (operator 8).

A text is brought to a canonical form: lower case, lines with a copyright
notice dropped, equivalent spellings made one, punctuation and white space as
single spaces.  Its SHA-256 is the digest of a document.  Licenses are looked up
by the digest of a stricter form (``license_form``): only lines with a real
notice are dropped, and so are titles and the holders named inside BSD texts.
DataFrame operations only; the known texts are a table of any size.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that license matching takes as equal.
EQUIVALENT = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("organised", "organized"),
    ("authorise", "authorize"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantability", "merchantability"),
    ("modelling", "modeling"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)

# Short public license texts.
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES '
    "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Licensed under the MIT License.",
}

#: Full texts, a file ``<license_id>.txt`` each; read by the driver.
TEXTS = Path(__file__).with_name("licenses")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that starts (after comment marks) with a copyright notice.
NOTICE = "(^|\\n)[ \\t#*/;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*"

#: A line that starts (after comment marks) with a notice: a year, a (c) sign or a holder follows "copyright".
NOTICE_LINE = (
    "(?m)^[ \\t#*/;-]*(?:"
    "(?i:(?:copyright|\\(c\\))[^\\n]{0,40}?(?:19|20)[0-9][0-9][^\\n]*)"
    "|(?i:copyright[ \\t:]*(?:\\(c\\)|©|[\\[<{])[^\\n]*)"
    "|(?i:\\(c\\)[ \\t]*copyright\\b[^\\n]*)"
    "|©[^\\n]*"
    "|Copyright[ \\t]+(?:by[ \\t]+)?(?!(?:Holder|Owner|License|Licence|Notice|Act|Law|Treaty|Disclaimer|Statement|Right)(?:s|ies)?\\b)[A-Z][^\\n]*"
    "|(?i:all rights reserved)[.]?[ \\t\\r]*$"
    ")"
)
#: Title at the head of a license, no part of its known text; in the form with single spaces.
TITLE = "^ (?:the )?(?:mit license(?: mit)?|expat license|isc license(?: isc)?|zlib license|zero clause bsd license|bsd zero clause license|0bsd|(?:new |modified |simplified |revised )?bsd (?:[23] clause )?license|[23] clause bsd license) "
#: Parts that a publisher fills in or that changed by address only, and what stands for them.
REPLACED = (
    (" neither the name of (?:[^ ]+ ){1,20}?nor the names of (?:its|any|other) contributors ", " neither the name of the copyright holder nor the names of its contributors "),
    (" software is provided by (?:[^ ]+ ){1,20}?as is and any express ", " software is provided by the copyright holders and contributors as is and any express "),
    (" in no event shall (?:[^ ]+ ){1,20}?be liable for any direct indirect ", " in no event shall the copyright holder or contributors be liable for any direct indirect "),
    (" (?:51 franklin st(?:reet)? fifth floor boston ma 02110 1301|59 temple place suite 330 boston ma 02111 1307|675 mass ave cambridge ma 02139) usa ", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is an empty text."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(_plain(F.regexp_replace(out, NOTICE, "\n")))


def license_form(text: Column) -> Column:
    """The form by which licenses are looked up; null is an empty text."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), NOTICE_LINE, "\n")
    out = _plain(F.translate(out, UPPER, LOWER))
    for a, b in ((TITLE, " "), *REPLACED):
        out = F.regexp_replace(out, a, b)
    return F.trim(out)


def _plain(out: Column) -> Column:
    """Lower-case text with single spaces for all but letters and digits, at both ends too, and with one of equivalent spellings."""
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©‘’“”–—]+", " "), F.lit(" "))
    for a, b in EQUIVALENT:
        if a != b:
            out = F.regexp_replace(out, f" {a}(s?) ", f" {b}$1 ")
    return out


def full_texts() -> list[tuple[str, str]]:
    """``KNOWN`` and the texts of ``TEXTS``, with the forms in which they also stand alone: no numbers before
    a BSD text's conditions, ISC's older wording, nothing after "END OF TERMS AND CONDITIONS"."""
    out = list(KNOWN.items())
    out += [(k, KNOWN[k].replace("and/or distribute", "and distribute")) for k in ("0BSD", "ISC")]
    for p in sorted(TEXTS.glob("*.txt")):
        text = p.read_text(encoding="utf-8")
        out.append((p.stem, text))
        if p.stem.startswith("BSD-"):
            out.append((p.stem, re.sub(r"(?m)^ *[0-9]\. ", "", text)))
        body, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(p.stem, body), (p.stem, body + end)]
    return out


def known_table(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """``(license_id, text)``; by default of all known texts."""
    return spark.createDataFrame(full_texts() if known is None else list(known.items()), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, digest, license_id)`` of every document.

    ``license_id`` is the known license whose whole text has the same ``license_form``, null
    if none has; of several the least id.  Null, empty and wordless texts share the
    digest of the empty form, which matches nothing.  Rows repeat as in the
    table; an empty table gives no rows, an empty list of licenses no matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(canonical(text), 256).alias("digest"), F.sha2(license_form(text), 256).alias("form_digest"))
    form = known.select("license_id", license_form(F.col("text")).alias("form")).where("form <> ''")
    digests = form.groupBy(F.sha2("form", 256).alias("form_digest")).agg(F.min("license_id").alias("license_id"))
    return rows.join(digests, "form_digest", "left").select("doc_id", "n_bytes", "digest", "license_id")


def oracle() -> str:
    """The rows in DuckDB's SQL for ``KNOWN``, looked up by the canonical form."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        out = f"regexp_replace({out}, {quote(NOTICE)}, chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, {quote('[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©‘’“”–—]+')}, ' ', 'g') || ' '"
        for a, b in EQUIVALENT:
            if a != b:
                out = f"regexp_replace({out}, ' {a}(s?) ', ' {b}\\1 ', 'g')"
        return f"trim({out})"

    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"""
WITH known(license_id, text) AS (VALUES {values}),
digests AS (SELECT sha256({form("text")}) AS digest, min(license_id) AS license_id FROM known WHERE {form("text")} <> '' GROUP BY 1),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256({form("text")}) AS digest FROM documents)
SELECT d.doc_id, d.n_bytes, d.digest, digests.license_id FROM d LEFT JOIN digests USING (digest)"""
