"""Licence scans by canonical digest lookup.

A text is made canonical: A-Z lowered, copyright lines dropped, punctuation and
white space turned into single spaces, and equivalent spellings replaced; then
its SHA-256 is joined to the digests of known licence texts. The same is done for
each line of the text as a text of its own, since notices such as "Released under
the MIT License." stand on lines by themselves: digests of lines are exploded and
joined to the same table. A line with as many words as no known text, or other
words at its ends than any of that many words, is no known text and gets no digest. Only whole
texts and whole lines match: a licence that is changed by a word has another digest.

An SPDX line ("SPDX-License-Identifier: " and an expression) is read as SPDX
says, since "+" would be lost in the canonical form: each known identifier of
the expression is a notice, and a text that is one such line with one identifier
has it as licence.

The table of known texts is as large as the list given, whatever the corpus, and
is broadcast. Only what lines found is grouped, and only rows with such lines meet it in
a shuffle, without their texts. Full texts and the identifiers are files of the folder ``licenses``
that only the driver reads.

Defined results: null texts, and texts that are empty once canonical, have no
digest and no licence. Very long texts are made canonical and digested whole, like
any other. Of licences whose known texts are equal once canonical, the one later in
the list is named. Repeated rows give repeated results, an empty table none; only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import product
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Spellings that the SPDX matching guidelines treat as equal, one word for one.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "https": "http",
}
#: Spellings of two words that those guidelines treat as equal to others, as they are once hyphens are spaces.
EQUIVALENT_PAIRS = {"copyright holder": "copyright owner", "non commercial": "noncommercial", "per cent": "percent", "sub license": "sublicense"}
_MARKS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts as (licence, text). Notices stand for their licence.
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
]


_FOLDER = Path(__file__).parent / "licenses"
#: A line that says who holds the copyright; not a sentence of a licence that happens to break before the word.
_HELD = re.compile(r"(?:\(c\)|©|&copy;)[ \t]*(?:copyright\b|[\d\[<{]|(?-i:[A-Z])[\w.,&-]*(?:[ \t]+(?-i:[A-Z\d])[\w.,&-]*)*[ \t]*$)|©|copyright[ \t:,]*(?:\(c\)|©|&copy;|[\d\[<{]|by\b)|copyright[ \t:,]+(?!licen[cs]e|notice|holder|owner|law|act\b|right|treat|statement|and\b|or\b)(?-i:[A-Z])", re.IGNORECASE)
_SPDX = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([A-Za-z0-9.+() \t-]+)", re.IGNORECASE)


@cache
def listed(name: str) -> dict[str, str]:
    """The identifiers of a list of SPDX (``spdx``, ``exceptions``) by their lowered form."""
    return {x.lower(): x for x in (_FOLDER / f"{name}.list").read_text().split()}


@cache
def known_texts() -> list[tuple[str, str]]:
    """``KNOWN``, the full texts of the folder with and without what follows their terms, the BSD texts in their usual forms, and one-line notices by name."""
    out = list(KNOWN)
    for f in sorted(_FOLDER.glob("*.txt")):
        name, text = f.name.removesuffix(".txt").removesuffix(".regents"), f.read_text()
        out.append((name, text))
        if " WITH " not in name:
            for mark in ("END OF TERMS AND CONDITIONS", "ADDENDUM: How to use this License"):
                if mark in text:
                    terms = text[: text.index(mark)]
                    out += [(name, terms), (name, terms + mark)] if mark.startswith("END") else [(name, terms)]
    bsd = (_FOLDER / "BSD-3-Clause.txt").read_text().split("\n", 1)[1]
    third = bsd[bsd.index("3. Neither") : bsd.index("THIS SOFTWARE IS")]
    forms = product((True, False), (True, False), (("HOLDERS", "HOLDER"), ("HOLDERS", "OWNER"), ("HOLDERS", "HOLDERS"), ("HOLDER", "HOLDER")), ("", "All rights reserved.\n"), ("", "BSD {}-Clause License\n", "The {}-Clause BSD License\n", "The BSD {}-Clause License\n"))
    for full, numbered, (by, event), rights, title in forms:
        text = bsd if full else bsd.replace(third, "")
        text = text if numbered else re.sub(r"(?m)^\d\. ", "* ", text)
        text = re.sub(r"COPYRIGHT(\s+)HOLDERS", rf"COPYRIGHT\1{by}", text, count=1)
        text = re.sub(r"(IN NO EVENT SHALL THE COPYRIGHT\s+)HOLDER\b", rf"\g<1>{event}", text)
        out.append((f"BSD-{2 + full}-Clause", title.format(2 + full) + rights + text))
    out += [("MIT", title + rights + _MIT) for title, rights in product(("", "MIT License\n", "The MIT License\n", "The MIT License (MIT)\n"), ("", "All rights reserved.\n"))]
    named = {
        "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"], "ISC": ["ISC License"], "Unlicense": ["Unlicense"],
        "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
        "CC0-1.0": ["CC0 1.0"], "GPL-2.0": ["GNU General Public License, version 2"], "GPL-3.0": ["GNU General Public License, version 3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
        "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    } | {f"CC-{k}-{v}": [f"CC {k} {v}"] for k, v in product(("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("2.0", "2.5", "3.0", "4.0"))}
    return out + [(k, f"{how} {the}{name}.") for k, names in named.items() for name in names for how in ("Released under", "Licensed under", "This work is licensed under") for the in ("", "the ")]


def canonical(text: str) -> str:
    """The canonical form: see the module's head."""
    lines = text.splitlines()
    kept = [x for x in lines if not _HELD.match(x.lstrip(" \t#/*;-"))] if "opyright" in text or "OPYRIGHT" in text or "(c)" in text.lower() or "©" in text or "&copy;" in text else lines
    words = "\n".join(kept).encode("utf-8", "replace").translate(_MARKS).decode("utf-8", "replace").split()
    form = f" {' '.join(EQUIVALENT.get(w, w) for w in words)} "
    for pair, one in EQUIVALENT_PAIRS.items():
        form = form.replace(f" {pair} ", f" {one} ")
    return form.strip()


def shape(form: str) -> tuple[int, str, str]:
    """What a canonical form must share with an equal one: its number of words, its first and its last."""
    return form.count(" "), form.partition(" ")[0], form.rpartition(" ")[2]


def identifiers(expression: str, ids: dict[str, str], exceptions: dict[str, str]) -> list[str]:
    """The known identifiers of an SPDX expression, each with its "+" or its exception; what is not listed is left out."""
    out = []
    for part in re.split(r"[()]|(?<!\S)(?:AND|OR)(?!\S)", expression, flags=re.IGNORECASE):
        words = part.split()
        if not words:
            continue
        name = words[0].lower().rstrip(".")
        own = ids.get(name) or (ids[name[:-1]] + "+" if name.endswith("+") and name[:-1] in ids else None)
        if own and len(words) > 2 and words[1].lower() == "with" and (beyond := exceptions.get(words[2].lower().rstrip("."))):
            own += f" WITH {beyond}"
        out += [own] if own else []
    return out


def _hashed(form: str) -> str | None:
    return hashlib.sha256(form.encode("utf-8", "replace")).hexdigest() if form else None


def digest(text: str | None) -> str | None:
    return _hashed(canonical(text)) if text else None


def digests(text: Column, shapes: frozenset[tuple[int, str, str]]) -> Column:
    """Struct (whole, spdx, told, lines) of a text column: the digest of the text, its licence if it is one SPDX line of one identifier, the identifiers of its SPDX lines, and the digests of the other lines that have one of ``shapes``."""
    ids, exceptions = listed("spdx"), listed("exceptions")

    def one(text: str | None) -> tuple[str | None, str | None, list[str], list[str]]:
        if not isinstance(text, str):
            return None, None, [], []
        lines = text.split("\n")
        told = {i: identifiers(m[1], ids, exceptions) for i, x in enumerate(lines) if (m := _SPDX.search(x))} if "icense-" in text or "ICENSE-" in text else {}
        forms = {form for i, x in enumerate(lines) if i not in told and (form := canonical(x)) and shape(form) in shapes}
        alone = told and sum(bool(x.strip()) for x in lines) == 1 and len(own := next(iter(told.values()))) == 1
        return digest(text), own[0] if alone else None, sorted({k for own in told.values() for k in own}), sorted(map(_hashed, forms))

    @F.pandas_udf("whole string, spdx string, told array<string>, lines array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["whole", "spdx", "told", "lines"])

    return run(text)


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest) of each known text."""
    by_digest = {d: name for name, t in (known_texts() if texts is None else texts) if (d := digest(t))}
    return spark.createDataFrame([(name, d) for d, name in sorted(by_digest.items())], "license string, digest string")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, digest, license, notices) of every row: the licence whose text the row is, if any, and the licences of its lines, each once, in order of name. ``texts`` are ``known_texts()`` unless given."""
    shapes = frozenset(shape(form) for _, t in (known_texts() if texts is None else texts) if (form := canonical(t)))
    names = F.broadcast(known(docs.sparkSession, texts).withColumnRenamed("digest", "_digest"))
    own = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), digests(F.col(text), shapes).alias("_d")).select("_row", "doc_id", "_d.*"), "digests")
    found = own.join(names, F.col("whole") == F.col("_digest"), "left").select("_row", "doc_id", F.col("whole").alias("digest"), F.coalesce("spdx", "license").alias("license"), "told", "lines")
    lines = own.select("_row", F.explode("lines").alias("_digest")).join(names, "_digest").select("_row", "license")
    notices = lines.unionByName(own.select("_row", F.explode("told").alias("license"))).groupBy("_row").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    none = F.expr("cast(array() as array<string>)").alias("notices")
    some = (F.size("told") > 0) | (F.size("lines") > 0)
    without = found.where(~some).select("doc_id", "digest", "license", none)
    return without.unionByName(found.where(some).join(notices, "_row", "left").select("doc_id", "digest", "license", F.coalesce("notices", none).alias("notices")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
