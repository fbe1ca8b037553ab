"""The usual one-line notices of each licence, and bodies wrapped over lines, are found; lines that only speak of licences are not."""

import textwrap

from presswork.llm import license

NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "GNU General Public License, version 3", "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-3.0": "GNU Lesser General Public License, version 3", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
}


def test_notices_and_wrapped_bodies(spark):
    rows, want = [], {}
    for name, full in NAMES.items():
        for verb in ("Licensed under the", "Released under the", "licensed under the"):
            want[len(rows)] = name
            rows.append((len(rows), f"src{len(rows)}/a.py", f"import os\n# {verb} {full.lower() if verb[0] == 'l' else full}.\nx = 1"))
    for name, body in (("MIT", license._MIT), ("ISC", license._ISC), ("BSD-2-Clause", license._BSD2), ("Apache-2.0", license._APACHE)):
        wrapped = "\n".join(textwrap.wrap(body, 60))
        assert wrapped.count("\n") > 2
        want[len(rows)] = name
        rows.append((len(rows), f"src{len(rows)}/LICENSE", f"Copyright (c) 2024 Someone\n\n{wrapped}\n"))
    for text in ("A license to fish was released by the public office.", "The MIT campus is open under the new version of its rules.", "They went under the bridge."):
        want[len(rows)] = None
        rows.append((len(rows), f"src{len(rows)}/a.txt", text))
    df = spark.createDataFrame(rows, "file long, path string, text string")
    got = {r.file: r.license for r in license.scan(df, license.templates_frame(spark)).collect()}
    assert got == want
