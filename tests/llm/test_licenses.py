import re

import pytest

from fathom.llm import licenses as L
from fathom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice, this list.
"""
NAME = "3. Neither the name of the owner nor the names of its contributors may be used to endorse or promote products derived from this software.\n"
GPL = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of fitness.  See the
 * GNU General Public License for more details.
 */
int x;"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.
# See the License for the specific language governing permissions.
"""
TEXTS = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "one two.***\nLicensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Words.\nReleased under the MIT License.": "MIT",
    "Licensed under the\n  Apache License,\n  Version 2.0.": "Apache-2.0",
    MIT: "MIT",
    BSD: "BSD-2-Clause",
    BSD + NAME: "BSD-3-Clause",
    GPL: "GPL-2.0-or-later",
    APACHE: "Apache-2.0",
    "Licensed under the GNU Lesser General Public License v2.1 or later.": "LGPL-2.1-or-later",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0-only",
    "Released under a Creative Commons Attribution-ShareAlike 3.0 license.": "CC-BY-SA-3.0",
    "This file is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": "(MIT OR Apache-2.0)",
    "Dual licensed under the MIT License and the Apache License, Version 2.0.": "MIT,Apache-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears.": "ISC",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "This file is not under the MIT License.": "",
    "It is no longer licensed under the GPL v2, but under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 or the MIT license.": "Apache-2.0,MIT",
    "Licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    "Licensed under the EUPL v1.2.": "EUPL-1.2",
    "Subject to the terms of the Common Development and Distribution License (CDDL) version 1.0.": "CDDL-1.0",
    "Released under the Artistic License 2.0.": "Artistic-2.0",
    "Licensed under the Python Software Foundation License version 2.": "PSF-2.0",
    "Licensed under the Academic Free License version 3.0.": "AFL-3.0",
    "This library is under the GNU General Public License version 2 with the Classpath exception.": "GPL-2.0-only,Classpath-exception-2.0",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.": "Zlib",
    "Ask for a license to drive. Prose.": "",
    "The weather is mild.": "",
    "": "",
    None: "",
}


def plain(text):
    """The scan in plain Python, with no test that spares a sentence or a text."""
    flow = re.sub(L.LINE_START, "\n", "\n" + (text or ""))
    pieces = [x for x in re.split(L.SENTENCE_END, flow) if x.strip(" \t\n\x0b\x0c\r")]
    found, told = [], ""
    for i, s in enumerate(pieces):
        s = re.sub(r"[\x20\t\n\x0b\x0c\r]+", " ", s).strip(" ")
        low = re.sub("[A-Z]", lambda m: m[0].lower(), s)
        tags = ["spdx:" + x for x in re.findall(L.SPDX, s)]
        said = re.sub(L.NEGATED, " ", low, flags=re.A)
        placed = []
        for g, group in enumerate(L.SENTENCES):
            if hit := next(((m, k) for k, p in group if (m := re.search(p, said, re.A))), None):
                placed.append((hit[0].end(), g, hit[1]))
        if whole := L.EXACT.get(re.sub("[^a-z0-9]+", " ", said).strip(" ")):
            placed.append((len(said), len(L.SENTENCES), whole))
        placed.sort()
        told += "".join(f"<{x}>" for x in tags)
        for n, (end, _, k) in enumerate(placed):
            joint = re.search(r"\b(and|or)\b", said[placed[n - 1][0] : end], re.A) if n else None
            if joint and re.search(L.NAMING, f"<{k}>") and re.search(L.NAMING, f"<{placed[n - 1][2]}>"):
                told += "<OR>" if joint[1] == "or" or re.search(L.CHOICE, said, re.A) else "<AND>"
            told += f"<{k}>"
        ids = [*tags, *(k for *_, k in placed)] or ["unknown"] * bool(re.search(L.MENTION, low))
        if ids:
            found.append((i, ids))
    names, at = [], 0
    rules = [(None, "<spdx:[^>]*>"), ("OR", "<OR>"), ("AND", "<AND>"), *L.RULES]
    while at < len(told):
        hit = next(((n, m) for n, p in rules if (m := re.compile(p).match(told, at)) and m.end() > at), None)
        if hit:
            names.append(hit[0] or hit[1][0][6:-1])
        at = hit[1].end() if hit else told.index(">", at) + 1
    unknown = sum("unknown" in x for _, x in found)
    text = re.sub(";((?:Classpath|GCC)-exception-[0-9.]+)", r" WITH \1", re.sub(";(OR|AND);", r" \1 ", ";".join(names)))
    expression = ", ".join(dict.fromkeys(x for x in text.split(";") if x not in ("", "OR", "AND")))
    licenses = ",".join(dict.fromkeys(n for n in names if n not in ("OR", "AND")))
    return len(pieces), len(found) - unknown, unknown, ",".join(f"{i}:{'+'.join(x)}" for i, x in found), licenses, expression


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_licenses_are_named(spark):
    got = {r["doc_id"]: r["licenses"] for r in L.license_reports(frame(spark, TEXTS)).collect()}
    assert got == dict(enumerate(TEXTS.values()))


@pytest.mark.parametrize("more", ["", " Words.\r\n\r\n", "\u2028 \u00e9v. 2\n * \n"])
def test_scan_matches_plain_python(spark, more):
    texts = [f"{more}{t}{more}{u}" for t in TEXTS for u in ("", "Licensed under CC BY 4.0", BSD)] + [None, "", " \n", "#", "...", "LICENSE: GPLv3+"]
    got = {r["doc_id"]: tuple(r)[1:] for r in L.license_reports(frame(spark, texts)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_query_reports_every_document_and_license_line(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_license_scans"](spark, SF).collect()}
    assert got == {d: plain(t) for d, t in docs.items()}
    lines = {"GNU General Public License, version 3": "GPL-3.0-only", "CC BY-NC 4.0": "CC-BY-NC-4.0", "the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    assert all(name in got[d][-2].split(",") for d, t in docs.items() for line, name in lines.items() if line in (t or ""))


EXPRESSIONS = {
    "Dual licensed under the MIT License and the Apache License, Version 2.0.": "MIT OR Apache-2.0",
    "Licensed under the Apache License, Version 2.0 or the MIT license.": "Apache-2.0 OR MIT",
    "Parts are under the MIT License and under the ISC License.": "MIT AND ISC",
    "It is under the GNU General Public License version 2 with the Classpath exception.": "GPL-2.0-only WITH Classpath-exception-2.0",
    "Released under the MIT License. Also released under the EUPL v1.2.": "MIT, EUPL-1.2",
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0",
    "Use it under the terms of the LGPL v2.1 or later, or the MPL 2.0.": "LGPL-2.1-or-later",
}


def test_expressions(spark):
    got = {r["doc_id"]: r["expression"] for r in L.license_reports(frame(spark, EXPRESSIONS)).collect()}
    assert got == dict(enumerate(EXPRESSIONS.values()))


def test_precision_and_recall_on_planted_texts(spark):
    """Every license of TEXTS by name, between prose, denied, and beside words that only sound like one."""
    named = {"the MIT License": "MIT", "the Apache License, Version 2.0": "Apache-2.0", "the ISC License": "ISC", "the Artistic License 2.0": "Artistic-2.0", "the SIL Open Font License, version 1.1": "OFL-1.1", "the EUPL v1.2": "EUPL-1.2", "the Mozilla Public License 2.0": "MPL-2.0", "the GNU General Public License, version 3": "GPL-3.0-only", "CC BY-SA 4.0": "CC-BY-SA-4.0", "the CDDL 1.0": "CDDL-1.0", "the Academic Free License 3.0": "AFL-3.0", "the 3-Clause BSD license": "BSD-3-Clause"}
    yes = [(f"Some words before it.\nThis file is {how} {n}. And more words.", lic) for n, lic in named.items() for how in ("licensed under", "released under", "available under the terms of", "covered by")]
    no = [(f"Some words.\nThis file is {how} {n}. More words.", "") for n in named for how in ("not licensed under", "never under", "no longer covered by")]
    no += [(t, "") for t in ("A driving license is under review.", "We read about the MIT campus.", "The Apache are a people.", "All of the artistic work is under way.", "Ask under what license it is.")]
    texts = yes + no
    got = {r["doc_id"]: r["licenses"] for r in L.license_reports(frame(spark, [t for t, _ in texts])).collect()}
    wrong = [(texts[i], got[i]) for i in range(len(texts)) if got[i] != texts[i][1]]
    assert not wrong, wrong  # precision 1, recall 1


def test_empty_table_and_repeated_rows(spark):
    assert L.license_reports(frame(spark, ["x"]).where("false")).count() == 0
    assert L.license_reports(spark.createDataFrame([(1, MIT), (1, MIT), (None, None)], "doc_id long, text string")).count() == 3
