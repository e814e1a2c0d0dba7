"""Licence cases: wrapped headers, ids, versions, whole texts, long lines."""

import time

import pytest

from pointloom.llm import licenses

BODIES = {name: text for name, needs, text in licenses.TEMPLATES if len(text) > 300}
MIT = max((t for n, _, t in licenses.TEMPLATES if n == "MIT"), key=len)
GPL3 = next(t for n, _, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))


def flat(text):
    return " ".join(text.split())


def wrapped(text, mark=""):
    words, lines = flat(text).split(" "), []
    for k in range(0, len(words), 9):
        lines.append(mark + " ".join(words[k:k + 9]))
    return "\n".join(lines)


CASES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "some code\n# This work is licensed under the GNU General\n# Public License, version 3.\nmore code": "GPL-3.0",
    "This work is licensed under the GNU General\nPublic License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License.": "GPL",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under the Apache License.": "Apache",
    "Copyright (c) 2020 Foo. All rights reserved.": "Proprietary",
    "Copyright (c) 2020 Foo. All rights reserved.\n\nLicensed under the MIT License.": "MIT",
    wrapped(GPL3, " * "): "GPL-3.0",
    "import x\n\n" + wrapped(GPL3, "# ") + "\n\n" + "code of this file\n" * 300: "GPL-3.0",
    "import x\n\n" + wrapped(MIT, "# ").replace("MIT License. ", "") + "\n\nlast = 1": "MIT",
    "Licensed under the license of the moon.": None,
    "Released under the Moon License.": None,
    "A text without any header": None,
    "": None,
    "\u0001licence\u0001": None,
}


def test_headers(spark):
    rows = [(f"d{k}/f.txt", text) for k, text in enumerate(CASES)]
    filler = [(f"x{k}/f.txt", f"plain text number {k}, of no licence at all") for k in range(200)]
    files = spark.createDataFrame(rows + filler, "path string, text string")
    got = {r["path"]: r for r in licenses.scan_files(files).collect()}
    assert {t: got[p]["own_license"] for p, t in rows} == CASES
    assert all(got[p]["license"] is None for p, _ in filler)


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "LGPL-3.0"])
def test_licence_files_whole(spark, name):
    body = max((t for n, _, t in licenses.TEMPLATES if n == name), key=len)
    text = "Copyright 2021 Some Body\n\n" + wrapped(body.replace("MIT License. ", ""))
    files = [("p/LICENSE", text), ("p/q/r.py", "code")] + [(f"x{k}", f"text {k}") for k in range(50)]
    got = {r["path"]: (r["license"], r["origin"]) for r in licenses.scan_files(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["p/LICENSE"] == (name, "own") and got["p/q/r.py"] == (name, "inherited")


def test_long_lines_are_linear(spark):
    long = "license " + " ".join(f"w{i}" for i in range(200_000))
    files = spark.createDataFrame([("a/min.js", long), ("a/LICENSE", "Released under the MIT License.")], "path string, text string")
    begun = time.time()
    got = {r["path"]: r["license"] for r in licenses.scan_files(files).collect()}
    assert got == {"a/min.js": "MIT", "a/LICENSE": "MIT"} and time.time() - begun < 30
