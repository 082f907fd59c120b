"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Only DataFrame functions run. Each word shingle of a text is hashed once, and the
few that occur in any template go on; texts themselves stay where they lie. The
shingles are cut into small windows that overlap, so that every segment (a few
consecutive shingles of a template) which occurs in the text lies whole in some
window. Each window gets ``hashes`` MinHash values, each a band of its own; a
window that shares a band with a segment retrieves its template. The number of
bands follows from the least Jaccard similarity of a segment with a window that
holds it, so that a segment is missed with probability ``miss`` at most. Then the
shingles around the window are compared, as text, with the whole template's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Public license texts, the headers that files carry, and one-line notices, as license/form. Of
#: licenses too long for a file, the sentences that grant the rights.
TEMPLATES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "apache-2.0/text": """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    "mit/notice": "Released under the MIT License.",
    "mit/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause/text": """All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause/text": """All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense/text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-or-later/header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "gpl-3.0-or-later/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-2.1-or-later/header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-or-later/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "gpl-3.0/text": """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.""",
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved/notice": "All rights reserved.",
}

NOT_WORD = r"[^\p{L}\p{N}]+"
SHINGLE, SEGMENT, WINDOW = 5, 2, 3


def template_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as the scan splits documents."""
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles(words: Sequence[str], width: int) -> list[str]:
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def bands_for(parts: int, window: int = WINDOW, miss: float = 1e-3) -> int:
    """Bands of one MinHash value so that ``parts`` shingles within a window of ``window`` collide but with probability ``miss``."""
    share = min(parts / window, 1 - 1e-9)
    return max(1, math.ceil(math.log(miss) / math.log(1 - share)))


def akin(templates: dict[str, str], containment: float) -> list[tuple[str, str, bool]]:
    """(a, b, alike): a text of template b alone would be found to hold a; alike if the other way round too."""
    words = {n: template_words(t) for n, t in templates.items()}
    held = set()
    for a, w in words.items():
        width = min(SHINGLE, len(w))
        sought = set(shingles(w, width))
        held |= {(a, b) for b in words if a != b and sought and len(sought & set(shingles(words[b], width))) >= containment * len(sought)}
    return sorted((a, b, (b, a) in held) for a, b in held)


def _shingle_hash(words: Column, at: Column, width: int) -> Column:
    return F.when(F.size(words) >= at + width, F.xxhash64(F.lit(width), *(F.get(words, at + j) for j in range(width))))


def _min_hash(hashes: Column, band: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Templates found in whole texts.

    Returns (id, tie, license, template, matched, shingles, containment, word): for
    each distinct (id, text), ``tie`` being the text's md5, and each template found,
    the most distinct template shingles that the words around one window hold, their
    share of the template's, and the first such word's place, from 0. The license is
    the template's name up to its first slash. Shingles have five words; a template
    shorter than that is one shingle. A template that is part of another found one
    (a notice within a text) doesn't count; of templates that hold each other (two
    versions of a header) the one with the larger share does, then the longer, then
    the first by name. Case and punctuation don't matter. Null
    and empty texts hold nothing; repeated rows give one result; an empty table or
    no templates, none. Templates are a bounded list, broadcast.
    """
    given = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if template_words(t)}
    out_type = "id {}, tie string, license string, template string, matched int, shingles int, containment double, word long".format(docs.schema[id_col].dataType.simpleString())
    if not given:
        return spark.createDataFrame([], out_type)
    rows, fewest = [], WINDOW
    for name, text in given.items():
        words = template_words(text)
        width = min(SHINGLE, len(words))
        n = len(words) - width + 1
        fewest = min(fewest, SEGMENT, n)
        slack = len(words) + len(words) // 4 + WINDOW
        rows.append((name, name.split("/")[0], width, slack, len(set(shingles(words, width))), words, [list(range(s, min(s + SEGMENT, n))) for s in range(max(1, n - SEGMENT + 1))], shingles(words, width)))
    known = spark.createDataFrame(rows, "template string, license string, width int, slack int, shingles int, words array<string>, segments array<array<int>>, parts array<string>")
    widths = sorted({r[2] for r in rows})
    hash_at = lambda words, at: F.coalesce(*(F.when(F.col("width") == w, _shingle_hash(words, at, w)) for w in widths))
    hashes = bands_for(fewest, WINDOW, miss)
    band = F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("band")

    # each shingle that some template has: hashed once, where the text lies
    words_of = F.split(F.lower(F.col(text_col)), NOT_WORD)
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("tie"), words_of.alias("words"))
    at = base.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("p"))
    at = at.select("*", F.explode(F.array(*(F.struct(F.lit(w).alias("width"), _shingle_hash(F.col("words"), F.col("p"), w).alias("h")) for w in widths))).alias("g")).select("id", "tie", "words", "p", "g.width", "g.h")
    some = known.select("width", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: hash_at(F.col("words"), i))).alias("h")).distinct()
    at = at.join(F.broadcast(some), ["width", "h"], "left_semi")
    hits = Scratch(spark, "licenses").table(at.select("id", "tie", "width", "p", "h", F.array_join(F.slice("words", F.col("p") + 1, F.col("width")), " ").alias("shingle")).distinct(), "shingles")

    # windows of WINDOW shingles, one every SEGMENT; shingles that no template has would only part it from a segment
    starts = F.filter(F.sequence(F.col("p") - (WINDOW - 1), F.col("p")), lambda s: (s >= 0) & (s % SEGMENT == 0))
    windows = hits.select("id", "tie", "width", "h", F.explode(starts).alias("s")).groupBy("id", "tie", "width", "s").agg(F.collect_set("h").alias("hs"))
    windows = windows.select("id", "tie", "width", "s", "hs", band).withColumn("value", _min_hash(F.col("hs"), F.col("band")))
    segments = known.select("template", "slack", "width", "words", F.explode("segments").alias("seg")).select("template", "slack", "width", F.transform("seg", lambda i: hash_at(F.col("words"), i)).alias("hs"), band)
    segments = segments.select("template", "slack", "width", "band", _min_hash(F.col("hs"), F.col("band")).alias("value")).distinct()
    # the bands of a window, and its neighbours, retrieve the same place many times
    places = windows.join(F.broadcast(segments), ["width", "band", "value"]).select("id", "tie", "template", "slack", F.greatest(F.lit(0), F.col("s") - F.col("slack")).alias("start")).distinct()

    # the template's shingles around each place, by blocks as long as the place
    parts = known.select("template", "width", "slack", F.explode(F.array_distinct("parts")).alias("shingle"))
    block = lambda p: F.floor(p / (2 * F.col("slack") + 2))
    own = hits.join(F.broadcast(parts), ["width", "shingle"]).select(F.col("id").alias("o_id"), F.col("tie").alias("o_tie"), F.col("template").alias("o_template"), block(F.col("p")).alias("o_block"), "p", "shingle")
    places = places.select("*", F.explode(F.array(block(F.col("start")), block(F.col("start")) + 1)).alias("block"))
    same = F.col("id").eqNullSafe(F.col("o_id")) & (F.col("tie") == F.col("o_tie")) & (F.col("template") == F.col("o_template")) & (F.col("block") == F.col("o_block"))
    near = places.join(own, same).where(F.col("p").between(F.col("start"), F.col("start") + 2 * F.col("slack") + 1))
    near = near.groupBy("id", "tie", "template", "start").agg(F.countDistinct("shingle").cast("int").alias("matched"), F.min("p").cast("long").alias("word"))
    best = near.groupBy("id", "tie", "template").agg(F.max(F.struct("matched", (-F.col("word")).alias("less"))).alias("best"))
    found = best.join(F.broadcast(known.select("template", "license", "shingles")), "template").select("id", "tie", "license", "template", F.col("best.matched").alias("matched"), "shingles", (F.col("best.matched") / F.col("shingles")).alias("containment"), (-F.col("best.less")).alias("word"))
    found = found.where(F.col("containment") >= containment)
    pairs = akin(given, containment)
    if not pairs:
        return found
    found = Scratch(spark, "licenses").table(found, "found")
    kin = spark.createDataFrame(pairs, "template string, rival string, alike boolean")
    other = found.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "tie", "template", "containment", "shingles")))
    rank = lambda p: F.struct(F.col(f"{p}containment"), F.col(f"{p}shingles"))
    better = ~F.col("alike") | (rank("b_") > rank("")) | ((rank("b_") == rank("")) & (F.col("b_template") < F.col("template")))
    lost = found.select("id", "tie", "template", "containment", "shingles").join(F.broadcast(kin), "template")
    lost = lost.join(other, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("tie") == F.col("b_tie")) & (F.col("rival") == F.col("b_template"))).where(better)
    lost = lost.select(F.col("id").alias("l_id"), F.col("tie").alias("l_tie"), F.col("template").alias("l_template"))
    return found.join(lost, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("tie") == F.col("l_tie")) & (F.col("template") == F.col("l_template")), "left_anti")


def oracle(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """DuckDB SQL over the view documents: each text's shingles against each template's, without windows."""
    given = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if template_words(t)}
    rows, widths = [], set()
    for name, text in given.items():
        words = template_words(text)
        width = min(SHINGLE, len(words))
        widths.add(width)
        parts = sorted(set(shingles(words, width)))
        rows += [f"('{name}', {width}, {len(parts)}, '{p}')" for p in parts]
    pairs = ", ".join(f"('{a}', '{b}', {alike})" for a, b, alike in akin(given, containment)) or "(null, null, true)"
    each = []
    for width in sorted(widths):
        ahead = " || ' ' || ".join(["word", *(f"lead(word, {j}) over w" for j in range(1, width))])
        each.append(f"select doc_id, tie, {width} as width, {ahead} as shingle from tokens window w as (partition by doc_id, tie order by i)")
    return f"""
with templates(template, width, n, shingle) as (values {", ".join(rows)}),
kin(a, b, alike) as (values {pairs}),
split as (select distinct doc_id, md5(text) as tie, string_split_regex(lower(text), '{NOT_WORD}') as w from documents where text is not null),
tokens as (select doc_id, tie, unnest(w) as word, generate_subscripts(w, 1) as i from split),
grams as ({" union all ".join(each)}),
hits as (select doc_id, tie, template, any_value(n) as n, count(distinct grams.shingle) as matched from grams join templates using (width, shingle) group by doc_id, tie, template),
found as (select *, matched / cast(n as double) as containment from hits where matched >= {containment} * n)
select doc_id, tie as text_md5, split_part(template, '/', 1) as license, template, cast(matched as int) as matched, containment from found f
where not exists (select 1 from found g join kin on kin.a = f.template and kin.b = g.template where g.doc_id is not distinct from f.doc_id and g.tie = f.tie and (not kin.alike or g.containment > f.containment or (g.containment = f.containment and (g.n > f.n or (g.n = f.n and g.template < f.template)))))"""
