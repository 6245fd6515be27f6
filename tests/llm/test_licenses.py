"""The canonical form of licence texts doesn't depend on line breaks or notices."""

import glob
import hashlib
import os
import textwrap

import pytest

pytest.importorskip("binweave.llm")

from binweave.llm.license_texts import TEXTS  # noqa: E402
from binweave.llm.licenses import FULL_LENGTH, NOTICES, canonical, canonical_text, known_rows, scan_documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

KNOWN = [(name, x) for name, own in [*NOTICES.items(), *((k, [v]) for k, v in TEXTS.items())] for x in own if len(x) >= FULL_LENGTH]
DIGESTS = {r[0]: r[1] for r in known_rows()}
WIDTHS = range(40, 121)
ABOVE = [
    "", "Copyright 2020 X. All rights reserved.", "Copyright (c) 2020-2024 Jane Q. Doe", "© 1999, 2001 The Regents of the University of California. All rights reserved.",
    "(c) Copyright 2011, Acme Inc., Ltd. and contributors", "Copyright (C) Example Foundation <info@example.org>", "Copyright (c) 2014 One Person\nCopyright (c) 2015 Another Person\nPortions copyright 2016 A Third.", "Copyright <year> <copyright holder>", "Copyright (c) [year] [fullname]",
]


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))


def license_of(text):
    return DIGESTS.get(hashlib.sha256(canonical_text(text).encode()).hexdigest())


@pytest.mark.parametrize(("name", "text"), KNOWN, ids=[f"{n}-{len(x)}" for n, x in KNOWN])
def test_every_width_and_notice(name, text):
    own = license_of(text)
    assert own == name
    one = " ".join(text.split())
    for above in ABOVE:
        assert license_of(f"{above} {one}") == own, above
        for width in WIDTHS:
            assert license_of(f"{above}\n\n{wrapped(text, width)}") == own, (above, width)
            assert license_of(wrapped(f"{above} {one}", width)) == own, (above, width)


@pytest.mark.parametrize("file", [f for f in sorted(glob.glob("/usr/share/common-licenses/*")) if not os.path.islink(f)] or [None])
def test_long_texts(file):
    if file is None:
        pytest.skip("no common licences here")
    text = open(file, encoding="utf8").read()
    form = canonical_text(text)
    assert canonical_text(" ".join(text.split())) == form
    for width in WIDTHS:
        assert canonical_text(textwrap.fill(" ".join(text.split()), width, break_long_words=False)) == form


def test_what_is_no_notice_stays():
    for text in ("the above copyright notice and this permission", "copyright holders be liable for any claim", "(c) You must retain all notices", "copyright law of 1976 applies", "all copyright owners"):
        assert canonical_text(text) == canonical_text(text.replace(" ", "\n")) != ""
        assert len(canonical_text(text).split()) == len(text.split())
    essay = "Copyright 2020 " + "word " * 100
    assert canonical_text(essay) == ("word " * 100).strip()  # no end within reach: only the sign and year go


def test_spark_has_the_same_form(spark):
    texts = [f"{a}\n{wrapped(x, w)}" for _, x in KNOWN for a in ABOVE for w in (40, 61, 80, 82)]
    texts += [f"{ABOVE[1]} {' '.join(x.split())}" for _, x in KNOWN] + ["copyright 2020 " * 3000, "© © 2020 ", "Copyright 2020 J. Doe", "😀 copyright 2020 " + "😀" * 201, "İ (c) 1999 é. ü", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r.doc_id: r.f for r in rows.select("doc_id", canonical(F.col("text")).alias("f")).collect()} == {i: canonical_text(x) for i, x in enumerate(texts)}
    got = {r.doc_id: r.license for r in scan_documents(rows).collect()}
    assert got == {i: license_of(x) for i, x in enumerate(texts)}
