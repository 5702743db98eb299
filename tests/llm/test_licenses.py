import math
import re
from collections import Counter

from tessella.llm import licenses
from tessella.llm.licenses import TEMPLATES

SCHEMA = "id long, path string, text string, license string, k1 int"


def brute(rows):
    terms = lambda x: Counter(re.findall(licenses.TERM, x.lower()))
    bags = [(n, terms(x)) for n, own in TEMPLATES.items() for x in own]
    df = Counter(t for _, b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    tells = lambda xs: [x for x in xs if re.search(licenses.TELLS, x)]
    vec = lambda b: {t: (1 + math.log(n)) * idf.get(t, 1.0) for t, n in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = []
    for _, path, text, *_ in rows:
        best = None
        paragraphs = tells(re.split(licenses.PARAGRAPHS, text or ""))
        whole = [text or ""] if path is not None and re.search(licenses.LICENSE_FILE, path) else []
        for line in tells([*(text or "").split("\n"), *paragraphs, "\n".join(paragraphs), *whole]):
                v = vec(terms(line))
                for n, b in bags:
                    w = vec(b)
                    c = round(sum(x * w.get(t, 0) for t, x in v.items()) / norm(v) / norm(w), 6) if v else 0
                    if c >= 0.5 and (best is None or (n == licenses.RESERVED, -c, n) < best):
                        best = (n == licenses.RESERVED, -c, n)
        own.append(best and (best[2], -best[1]))
    spoken = {}
    for (_, path, *_), o in zip(rows, own):
        if path is not None and o and re.search(licenses.LICENSE_FILE, path):
            d = path.rpartition("/")[0]
            spoken[d] = min(spoken.get(d, (True, 0, "~")), (o[0] == licenses.RESERVED, -o[1], o[0]))
    for (i, path, *_), o in zip(rows, own):
        origin, d = "own" if o else "none", None if path is None else path.rpartition("/")[0]
        while not o and d is not None:
            if d in spoken:
                o, origin = (spoken[d][2], -spoken[d][1]), "inherited"
                break
            d = d.rpartition("/")[0] if "/" in d else None
        yield i, path, o and o[0], o and o[1], origin


def test_against_brute_force(spark):
    rows = [
        (1, "h/a/LICENSE", "Released under the MIT License.\nmore text"), (2, "h/a/b/c/x.py", "nothing"), (3, "h/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "h/ab/x", "no licence"), (5, "h/a/y", "Licensed under CC BY-NC 4.0."), (6, None, None), (7, "h/a/b/z", None), (8, "", "x"), (9, "license.md", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0"),
        (10, "plain", "x"), (11, "h/q/NOTICE", "all rights reserved"), (11, "h/q/LICENSE", "Copyright, all rights reserved, proprietary and confidential"), (12, "h/q/r/s/t/u", ""), (12, "h/q/r/s/t/u", ""), (13, "k/" + "d/" * 300 + "f", "license " * 5000),
        (14, "h//x", "long text with a license word amid very many others that say nothing of it at all and go on"),
    ]
    rows = [(*r, "", 0) for r in rows]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))
    assert licenses.scan(spark.createDataFrame([], SCHEMA).select("id", "path", "text")).count() == 0


def test_markup_and_paths(spark):
    row = spark.createDataFrame([("http://a.b/c/d.html?x=1#y", "<p>A<script>var t='</p>'</script><b>B</b><br>C<!-- no --></p>")], "url string, html string")
    got = row.select(licenses.path_of(row.url), licenses.visible(row.html)).first()
    assert got[0] == "a.b/c/d.html" and got[1].split() == ["A", "B", "C"]


MIT = """Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Some Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
"""
GNU = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU {0} as published by
    the Free Software Foundation; either version {1} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {0} for more details.
"""
KNOWN = {
    "MIT": MIT, "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(THIRD),
    "ISC": "ISC License\n\nCopyright (c) 2004 B. Person\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.",
    "GPL-2.0": GNU.format("General Public License", "2"), "GPL-3.0": GNU.format("General Public License", "3"), "LGPL-2.1": GNU.format("Lesser General Public License", "2.1").replace("program", "library"),
    "LGPL-3.0": GNU.format("Lesser General Public License", "3"), "AGPL-3.0": GNU.format("Affero General Public License", "3"),
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an "AS IS" BASIS.',
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented.",
}


def test_usual_texts_are_named_right(spark):
    rows = [(n, f"r/{i}/{name}", t + tail, "", 0) for i, (n, t) in enumerate(KNOWN.items()) for name, tail in (("LICENSE", ""), ("a.py", "\n\n" + "code that says nothing of it\n" * 40))]
    rows += [("GPL-2.0", "q/COPYING", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", "", 0), (None, "q2/x", "word " * 200_000 + "license", "", 0)]
    got = licenses.scan(spark.createDataFrame(rows, "id string, path string, text string, license string, k1 int")).collect()
    wrong = [(r.id, r.path, r.license, r.cosine) for r in got if r.id != r.license]
    assert len(got) == len(rows) and not wrong
