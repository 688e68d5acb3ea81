import re

from quillgraph.llm import licenses as L

BSD = """Copyright (c) 2020 X. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of X nor the names of its contributors may be used to endorse or promote products.

THIS SOFTWARE IS PROVIDED BY THE AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and such.

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


def test_texts():
    names = lambda t: L.scan_text(t)[0]
    assert names(BSD) == ["BSD-3-Clause"]
    assert names(re.sub(r"3\. .*\n", "", BSD)) == ["BSD-2-Clause"]
    assert names(MIT) == ["MIT"]
    assert names("foo bar. Released under the MIT License.") == ["MIT"]
    assert names("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert names("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.") == ["LGPL-2.1-or-later"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC"]
    assert names("// SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-CLAUSE"]
    assert names("MIT License terms and GNU") == [] and L.scan_text("The licence is odd.")[2] == 1
    assert names(MIT + "\n\n" + BSD) == ["BSD-3-Clause", "MIT"]


def test_notice_at_every_line_of_a_long_block():
    for text, name in ((MIT, "MIT"), (BSD, "BSD-3-Clause")):
        lines = text.replace("\n\n", "\n *\n").split("\n")
        for before in range(30):
            block = "\n".join(["/*", *[" * Copyright (c) 2020 someone."] * before, *[f" * {x}" for x in lines], *[" * more words"] * 15, " */"])
            assert L.scan_text(block)[0] == [name], before


def test_standard_notices(spark):
    gpl = "it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version."
    want = {
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
        gpl.format("", "2"): "GPL-2.0-or-later",
        gpl.format("Library ", "2"): "LGPL-2.0-or-later",
        gpl.format("Affero ", "3"): "AGPL-3.0-or-later",
        gpl.format("", "3").replace(" of the License", ""): "GPL-3.0-or-later",
        "GNU General Public License as published by the Free Software Foundation; version 2.": "GPL-2.0-only",
        "Released under CC0 1.0": "CC0-1.0",
        "This is available under CC BY 4.0": "CC-BY",
        "under a Creative Commons Attribution-ShareAlike 4.0 deed": "CC-BY-SA",
        "// SPDX-License-Identifier: MIT\n// Some other text that goes on\nint x = 1": "MIT",
        "/* SPDX-License-Identifier: GPL-2.0-only */ int x": "GPL-2.0-ONLY",
        "# SPDX-License-Identifier:\n# MIT or so": "",
        "Permission is\nhereby granted, free of charge, to any person obtaining a copy of this\nsoftware.\n\n" + MIT.partition("\n\n")[2]: "MIT",
        "Code: GNU General Public License version 2; docs: GNU General Public License version 3.": "GPL-2.0-only,GPL-3.0-only",
        BSD.replace("conditions are met:", "conditions are met;").replace("notice.\n", "notice;\n"): "BSD-3-Clause",
    }
    got = {r.text: ",".join(r.license_scan.licenses) for r in L.scan(spark.createDataFrame([(t,) for t in want], "text string")).collect()}
    assert got == want
    assert L.scan_text("The licence is odd; the licence is even.")[2] == 2
    assert L.scan_text("Released under the MIT License; the licence is odd.")[2] == 1
    assert L.scan_text("neither the name of " * 20000 + "this software is provided by " * 20000)[0] == []


def test_every_pattern_is_hinted():
    assert all(L.needed(pattern) in L.HINTS for _, pattern in L.SENTENCES)
    assert L.needed(r"(under|terms of) (a )?cc (by)( \d\.\d)?") == "cc" and L.needed("copies? of licen[sc]e") == "licen"


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    want = {k: ",".join(sorted(n for n, line in lines.items() if line in t)) for k, t in texts.items()}
    got = {r.doc_id: r for r in L.query(spark, d).collect()}
    assert {k: r.licenses for k, r in got.items()} == want and len(set(want.values())) > 3
    assert all(not r.n_unknown for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "license " * 20000, "x")], "doc_id long, text string, license_scan string")
    got = L.scan(docs).collect()
    assert len(got) == 4 and all(r.license_scan.licenses == [] for r in got)
    assert L.scan(docs.limit(0)).count() == 0


def test_names_and_denials():
    names = lambda t: L.scan_text(t)[0]
    want = {
        "licensed under the Apache License 2.0": ["Apache-2.0"], "Apache-2.0": ["Apache-2.0"], "BSD 3-Clause License": ["BSD-3-Clause"], "GPLv3": ["GPL-3.0-only"], "License: GPL-2.0-or-later": ["GPL-2.0-or-later"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not given, so be it.": ["MPL-2.0"],
        "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"], "released under the zlib License.": ["Zlib"], "This is licensed under the CDDL 1.0.": ["CDDL-1.0"], "available under the Artistic License 2.0": ["Artistic-2.0"],
        "Licensed under the WTFPL.": ["WTFPL"], "This font is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"], "dual licensed under the MIT and Apache-2.0 licenses": ["Apache-2.0", "MIT"],
        "not released under the MIT license": [], "This was never licensed under the Apache License, Version 2.0.": [], "We walked under the mit tree and python slept.": [],
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ["APACHE-2.0", "MIT"], "All rights reserved.": [],
    }
    assert {t: names(t) for t in want} == want
    grant = MIT.split("\n\n")[0]
    assert names(grant.replace("obtaining a copy", "obtaining\n\na copy") + "\n\n" + MIT.partition("\n\n")[2]) == ["MIT"]


def test_every_licence_is_found_by_each_of_its_names():
    """By brute force: all names, in the sentences that put something under them."""
    for licence, forms in L.NAMES.items():
        for form in [f.strip() for f in forms.split(",")] + [licence]:
            for sentence in ("This is licensed under the {} license.", "{} License"):
                assert L.scan_text(sentence.format(form))[0] == [licence], (licence, form, sentence)


def test_full_texts():
    zlib = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it. The origin of this software must not be misrepresented."
    boost = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use it."
    assert L.scan_text(zlib)[0] == ["Zlib"] and L.scan_text(boost)[0] == ["BSL-1.0"]
