"""Wrapped licence headers, as files have them, are found whole."""

import textwrap

import pytest

from mergelens.llm import licences

GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = [
    "Copyright (c) 2020, Someone. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
HEADERS = {
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Copyright (c) 2020 Someone", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": [GNU.format(":", "", 3), WARRANTY],
    "GPL-2.0": [GNU.format(";", "", 2), WARRANTY],
    "LGPL-3.0": [GNU.format(":", "Lesser ", 3), WARRANTY],
    "AGPL-3.0": [GNU.format(":", "Affero ", 3), WARRANTY],
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": [*BSD, NAMES],
    "Apache-2.0": [licences._APACHE[: licences._APACHE.index(" Unless")], licences._APACHE[licences._APACHE.index("Unless") :]],
    "MIT": ["Copyright (c) 2020 Someone", licences._MIT[: licences._MIT.index(" THE SOFTWARE IS")], licences._MIT[licences._MIT.index("THE SOFTWARE IS") :]],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def wrapped(header, mark, width):
    blank = f"\n{mark.rstrip()}\n"
    return blank.join("\n".join(mark + line for line in textwrap.wrap(p, width)) for p in header)


@pytest.fixture(scope="module")
def idf(spark):
    return licences.frequencies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"), licences.TEMPLATES)


@pytest.mark.parametrize("width", [44, 60, 72, 78])
@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_wrapped_headers(idf, mark, width):
    scanner = licences.Scanner(licences.TEMPLATES, idf)
    code = "\nimport x\n\n\ndef f():\n    return x\n"
    got = {name: scanner.scan(wrapped(header, mark, width) + ("\n\n" if not mark else "") + code, False, 0.6)[0] for name, header in HEADERS.items()}
    assert got == {name: name for name in HEADERS}


def test_spdx(idf):
    scanner = licences.Scanner(licences.TEMPLATES, idf)
    scan = lambda t: scanner.scan(t, False, 0.6)[0]
    assert scan("// SPDX-License-Identifier: MIT\nint x;") == "MIT"
    assert scan("# SPDX-License-Identifier: GPL-3.0-or-later\n") == "GPL-3.0"
    assert scan("/* SPDX-License-Identifier: (GPL-2.0+ OR MIT) */") == "GPL-2.0"
    assert scan("# SPDX-License-Identifier: EPL-2.0") is None


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0"])
def test_whole_licence_files(idf, name):
    scanner = licences.Scanner(licences.TEMPLATES, idf)
    whole = max(licences.TEMPLATES[name], key=len)
    file = f"{name} License\n\nCopyright (c) 2020 Someone\n\n" + "\n".join(textwrap.wrap(whole, 70))
    found, score = scanner.scan(file, True, 0.6)
    assert found == name and score > 0.9


def cosine(idf, rarest, a, b):
    import math
    from collections import Counter

    def vector(t):
        return {w: (1 + math.log(n)) * idf.get(w, rarest) for w, n in Counter(licences.TOKEN.findall(t.lower())).items()}

    x, y = vector(a), vector(b)
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    return sum(w * y.get(t, 0) for t, w in x.items()) / (norm(x) * norm(y) or 1)


def test_scores_and_frequencies_by_brute_force(spark, idf):
    import math

    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for word in ("license", "software", "the"):
        n = sum(word in licences.TOKEN.findall((t or "").lower()) for t in docs)
        assert math.isclose(idf[word], math.log((len(docs) + 1) / (n + 1)) + 1)
    scanner = licences.Scanner(licences.TEMPLATES, idf)
    for line in ("Licensed under the MIT License", "free software under the GNU General Public License version 2", "all rights reserved"):
        best = max(cosine(idf, scanner.rarest, line, t) for group in licences.TEMPLATES.values() for t in group)
        assert math.isclose(scanner.best(line)[0], best)
