"""Full licence texts however they are wrapped and held, and SPDX lines."""

import random
import re
from pathlib import Path

import pytest

pytest.importorskip("plainspoke.llm")
from plainspoke.llm import license_scan  # noqa: E402

FULL = Path(license_scan.__file__).parent / "licenses"


def test_full_texts_and_identifiers(spark):
    full = {f.name.removesuffix(".txt").removesuffix(".regents"): f.read_text() for f in sorted(FULL.glob("*.txt"))}
    bsd2 = re.sub(r"3\. Neither.*?permission\.", "", full["BSD-3-Clause"].replace("isis agora lovecruft", "A B"), flags=re.DOTALL)
    own = [(k, t) for k, t in full.items()]
    own += [("BSD-2-Clause", "BSD 2-Clause License\n\n" + bsd2), ("Apache-2.0", full["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", full["GPL-3.0"].split("How to Apply")[0]), ("MIT", "MIT License\n(c) Jane Doe\n" + license_scan._MIT)]
    # wrapped anew, each paragraph on one line or a word a line: the same licence, whatever word begins a line
    held = [x for x in full["MPL-2.0"].split("\n\n")]
    own += [("MPL-2.0", "\n\n".join(" ".join(x.split()) for x in held)), ("MPL-2.0", "\n".join(full["MPL-2.0"].split()))]
    own += [("BSD-3-Clause", "Copyright 2020 Some One\n\n" + "\n".join(full["BSD-3-Clause"].split("\n", 1)[1].split()))]
    spdx = {"SPDX-License-Identifier: BSD-3-Clause": ["BSD-3-Clause"], "// SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later"], "/* spdx-license-identifier: gpl-2.0+ */": ["GPL-2.0+"], "# SPDX-License-Identifier: MPL-2.0+": ["MPL-2.0+"],
            "SPDX-License-Identifier: (MIT OR Apache-2.0) AND Unicode-3.0": ["Apache-2.0", "MIT", "Unicode-3.0"], "<!-- SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 -->": ["GPL-2.0-only WITH Classpath-exception-2.0"], "SPDX-License-Identifier: Nonsense-9": []}
    rows = [t for _, t in own] + list(spdx) + ["x\n" + k + "\ny" for k in spdx]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(own))] == [k for k, _ in own]
    for i, want in enumerate(spdx.values(), len(own)):
        assert (got[i].license, got[i].notices) == (want[0] if len(want) == 1 else None, want)
        assert (got[i + len(spdx)].license, got[i + len(spdx)].notices) == (None, want)


def test_no_digest_has_two_licences():
    seen = {}
    for name, text in license_scan.known_texts():
        assert seen.setdefault(license_scan.digest(text), name) == name


def test_equivalent_spellings_of_two_words(spark):
    named = [("X-1", "Non-commercial use by the copyright holder at ten per cent, to sub-license.")]
    rows = ["noncommercial use by the Copyright Owner at ten percent to sublicense", "non commercial use by the copyright holder at ten per cent to sub license", "non commercial use by the copyright holders at ten per cent to sub license"]
    got = [r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), texts=named).orderBy("doc_id").collect()]
    assert got == ["X-1", "X-1", None]


def test_lines_meet_the_table_like_brute_force(spark):
    """Lines with and without known texts, repeated rows and ids, very long texts: what a look-up of every line finds."""
    by = {license_scan.digest(t): k for k, t in license_scan.known_texts()}
    notices = sorted({t for _, t in license_scan.known_texts() if "\n" not in t})
    r = random.Random(5)
    texts = ["\n".join(r.choice((r.choice(notices), r.choice(notices).upper() + "!", r.choice(notices) + " x", "prose of no licence", "")) for _ in range(r.randrange(0, 7))) for _ in range(150)]
    texts += ["word " * 200000 + "\n" + notices[0], *texts[:30], None, ""]
    df = spark.createDataFrame([(i % 90, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = sorted((x.doc_id, x.digest or "", x.license or "", x.notices) for x in license_scan.scan(df).collect())
    want = sorted((i % 90, license_scan.digest(t) or "", by.get(license_scan.digest(t), ""), sorted({by[d] for x in (t or "").split("\n") if (d := license_scan.digest(x)) in by})) for i, t in enumerate(texts))
    assert got == want and sum(bool(w[3]) for w in want) > 80
