"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A file is a path and a text. Templates are the texts of licences: whole where they are short (MIT, BSD, ISC, zlib and
others), heads, standard notices and titles where they are long. Of a file each line and each paragraph with a word that
tells of licences is weighed, all such paragraphs together, and a licence file (LICENSE, COPYING, NOTICE, UNLICENSE, with
any ending) whole. Term weights are (1 + log tf) * idf over the templates' own terms, idf = log((1 + T) / (1 + templates
with the term)) + 1, and 1 for other terms; a passage's length counts all its terms, so that a passing word isn't a
licence. A file's licence is its best passage's best template of at least min_cosine, ties by name;
"all rights reserved" counts only where nothing is granted. A licence file
speaks for its directory: files without a licence of their own take that of the nearest directory at or above theirs
that has one.

Templates are bounded: a table of a few thousand terms that is broadcast. Directories are joined by path: a file's
directories are exploded, as many as its path is deep, and joined with those that have a licence file; only the nearest
is kept by an aggregate of one struct a file. No Python runs on the executors.

Defined cases: null paths belong to no directory; null and empty texts have no licence of their own; a very long text is
weighed whole, and only its different terms move; repeated rows come back as often; several licence files in a
directory: likewise, the best cosine, then the least name; other columns are passed over; an empty table gives none. A text that
speaks of a licence only to deny it isn't told from one that grants it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRANT = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."
_AS_IS = "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_ISC = "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
_GNU = "this program is free software: you can redistribute it and/or modify it under the terms of the gnu {0} as published by the free software foundation, either version {1} of the license, or (at your option) any later version."
_GNU_END = "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {0} for more details. you should have received a copy of the gnu {0} along with this program. if not, see https www.gnu.org licenses"
_TITLE = "gnu {0} version {1} copyright free software foundation, inc. everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = "{0} {1} this work is licensed under a creative commons {0} {1} license. to view a copy of this license, visit creativecommons.org licenses"


def _gnu(kind: str, version: str, short: str) -> list[str]:
    return [_GNU.format(kind, version), _GNU.format(kind, version) + " " + _GNU_END.format(kind), _TITLE.format(kind, version), f"gnu {kind} version {version}", f"this work is licensed under the gnu {kind}, version {version}", f"licensed under the {short} {short}v{version}"]


def _cc(kind: str, short: str) -> list[str]:
    return [_CC.format(f"creative commons {kind}", "4.0 international"), f"creative commons {kind} 4.0 license", f"licensed under cc {short} 4.0"]


#: Texts of each licence: the whole text where it is short, its head and its standard notices where it is long.
TEMPLATES: dict[str, list[str]] = {
    "0BSD": [f"bsd zero clause license copyright (c) {_ISC}. {_ISC_END}", f"{_ISC}. {_ISC_END}"],
    "AGPL-3.0": _gnu("affero general public license", "3", "agpl"),
    "Apache-2.0": [
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http www.apache.org licenses license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
        "apache license version 2.0, january 2004 http www.apache.org licenses terms and conditions for use, reproduction, and distribution", "licensed under the apache license, version 2.0", "apache license 2.0",
    ],
    "BSD-2-Clause": [f"copyright (c) all rights reserved. {_BSD} {_BSD_END}", f"{_BSD} {_BSD_END}", "bsd 2-clause license", "simplified bsd license"],
    "BSD-3-Clause": [f"copyright (c) all rights reserved. {_BSD} {_BSD_3} {_BSD_END}", f"{_BSD} {_BSD_3} {_BSD_END}", "bsd 3-clause license", "new bsd license", "licensed under the bsd license"],
    "BSL-1.0": ["boost software license - version 1.0 - august 17th, 2003 permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so", "distributed under the boost software license, version 1.0. see accompanying file license or copy at http www.boost.org license"],
    "CC-BY-4.0": _cc("attribution", "by"),
    "CC-BY-NC-4.0": _cc("attribution-noncommercial", "by-nc"),
    "CC-BY-ND-4.0": _cc("attribution-noderivatives", "by-nd"),
    "CC-BY-SA-4.0": _cc("attribution-sharealike", "by-sa"),
    "CC0-1.0": ["cc0 1.0 universal creative commons public domain dedication", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. cc0 1.0 public domain dedication"],
    "EPL-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0", "eclipse public license - v 2.0 the accompanying program is provided under the terms of this eclipse public license. any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement."],
    "GPL-2.0": [*_gnu("general public license", "2", "gpl"), _GNU.format("general public license", "2").replace(":", ";") + " " + _GNU_END.format("general public license").replace("if not, see https www.gnu.org licenses", "if not, write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa")],
    "GPL-3.0": _gnu("general public license", "3", "gpl"),
    "ISC": [f"isc license copyright (c) {_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}", "isc license"],
    "LGPL-2.1": [_GNU.format("lesser general public license", "2.1").replace("program", "library"), *_gnu("lesser general public license", "2.1", "lgpl")],
    "LGPL-3.0": _gnu("lesser general public license", "3", "lgpl"),
    "MIT": [f"mit license copyright (c) {_GRANT} {_AS_IS}", f"{_GRANT} {_AS_IS}", "released under the mit license", "the mit license", "licensed under the mit license"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https mozilla.org mpl 2.0", "mozilla public license version 2.0 definitions contributor means each individual or legal entity that creates, contributes to the creation of, or owns covered software", "mozilla public license version 2.0"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved proprietary and confidential unauthorized copying of this file, via any medium is strictly prohibited"],
    "Unlicense": ["this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.", "this is free and unencumbered software released into the public domain"],
    "WTFPL": ["do what the fuck you want to public license version 2, december 2004 everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. terms and conditions for copying, distribution and modification you just do what the fuck you want to."],
    "Zlib": ["this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote the original software. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution."],
}
#: A grant goes before what is merely reserved, whatever the cosines.
RESERVED = "Proprietary"
#: A passage without any of these words is none of any licence: every template has one.
TELLS = r"(?i)licen[sc]|copyright|rights reserved|public domain|permission|redistribut|warrant|free software|unencumbered|liable|cc0|gnu |creative commons"
PARAGRAPHS = r"\n[ \t\r\n]*\n"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def templates(spark: SparkSession, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(term, t, license, w, idf): normed TF-IDF weights of each template, t its number."""
    rows = spark.createDataFrame([(t, n, x) for t, (n, x) in enumerate(listed(texts))], "t int, license string, body string")
    tf = rows.select("t", "license", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg((F.log((F.lit(1.0) + len(listed(texts))) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = raw.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "t").select("term", "t", "license", (F.col("w") / F.col("norm")).alias("w"), "idf")


def listed(texts: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(licence, template), by name."""
    return [(n, x) for n in sorted(texts) for x in texts[n]]


def visible(html: Column) -> Column:
    """Text of markup: no scripts, styles or comments, one line a block."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)<(/?(p|div|li|ul|ol|tr|td|h[1-6]|article|nav|footer|header|title|section)|br)\b[^>]*>", "\n")
    return F.regexp_replace(lines, r"<[^>]*>", "")


def path_of(url: Column) -> Column:
    """Host and path, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")


def passages_of(path: Column, text: Column) -> Column:
    """What of a file is weighed: each telling line and paragraph, all telling paragraphs together, and a licence file whole."""
    tells = lambda x: x.rlike(TELLS)
    paragraphs = F.filter(F.split(text, PARAGRAPHS), tells)
    whole = F.when(F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(F.split(text, "\n"), tells), paragraphs, F.array(F.array_join(paragraphs, "\n")), whole))


def scan(files: DataFrame, min_cosine: float = 0.5, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """files (id, path, text) -> (id, path, license, cosine, origin): origin "own", "inherited" or "none"."""
    spark = files.sparkSession
    t = F.broadcast(templates(spark, texts))
    keyed = files.select("id", "path", "text").withColumn("k1", F.xxhash64("id", "path", "text")).withColumn("k2", F.xxhash64(F.lit(5), "text", "path", "id"))
    # rows that are wholly equal are scanned as one
    passages = keyed.where(F.col("text").rlike(TELLS)).select("k1", "k2", F.explode(passages_of(F.col("path"), F.col("text"))).alias("passage"))
    terms = passages.select("k1", "k2", F.xxhash64("passage").alias("p"), F.regexp_extract_all(F.lower("passage"), F.lit(TERM), F.lit(0)).alias("terms"))
    each = terms.select("k1", "k2", "p", F.explode("terms").alias("term")).groupBy("k1", "k2", "p", "term").agg(F.count("*").alias("n"))
    known = t.select("term", "idf").distinct()
    weighed = each.join(F.broadcast(known), "term", "left").withColumn("x", (1 + F.log("n")) * F.coalesce("idf", F.lit(1.0)))
    vectors = weighed.groupBy("k1", "k2", "p").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "x"))).alias("terms"))
    met = vectors.select("k1", "k2", "p", "norm", F.explode("terms").alias("y")).select("k1", "k2", "p", "norm", "y.*").join(t, "term")
    cosine = met.groupBy("k1", "k2", "p", "t", "license", "norm").agg(F.sum(F.col("x") * F.col("w")).alias("dot")).select("k1", "k2", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = F.max_by(F.struct("license", "cosine"), F.struct(F.col("license") != RESERVED, "cosine", _backwards("license", texts))).alias("best")
    own = cosine.where(F.col("cosine") >= min_cosine).groupBy("k1", "k2").agg(best)
    found = keyed.drop("text").join(own, ["k1", "k2"], "left").select("id", "path", "best.license", "best.cosine")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    spoken = found.where(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull()).groupBy(directory.alias("dir")).agg(best)
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    orphans = found.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    steps = orphans.select("path", F.explode(above).alias("a")).select("path", "a.*")
    # "" counts as the directory of a path without any, not as the root of all others
    heirs = steps.where((F.col("depth") > 0) & ((F.col("dir") != "") | (F.col("depth") == 1))).join(spoken, "dir").groupBy("path").agg(F.max_by("best", "depth").alias("from"))
    whole = found.join(heirs, "path", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return whole.select("id", "path", F.coalesce("license", "from.license").alias("license"), F.coalesce("cosine", "from.cosine").alias("cosine"), origin.alias("origin"))


def _backwards(column: str, texts: dict[str, list[str]]) -> Column:
    """A number that is larger for the lesser name."""
    names = sorted(texts, reverse=True)
    return F.array_position(F.array(*map(F.lit, names)), F.col(column))
