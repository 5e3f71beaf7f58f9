"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the places of the
templates' k-grams: pairs of words for phrases and one-line notices, runs of
four for the bodies of licenses.  A hit votes for its diagonal, the text place
minus the template place.  Votes are counted by text, template and diagonal;
neighbouring diagonals (words added or left out) are merged, and a merged span
is verified word by word: enough of the template's words must stand at their
places on its diagonals, and all that name the license.  A hit is one of equal
words, not only of equal hashes, so phrases, which are accepted only whole, are
exactly where their words stand consecutively.

Only DataFrame functions are used.  The templates are the fixed values below,
so the broadcast side of the join is some thousand rows whatever the corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import NOT_ALNUM, UPPER, few, let, split_words

#: Phrases that must stand whole, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that may be altered, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl",
    "eclipse public license version 2 0": "epl",
}
#: License identifiers in words, after "SPDX-License-Identifier:", and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 2 0": "mpl", "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd-3-clause", "isc": "isc", "zlib": "zlib", "bsl 1 0": "boost", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "epl 2 0": "epl", "unlicense": "unlicense",
}
#: Words that name a license or its version: in a notice these must all be right.
NAMING = ("0", "1", "2", "3", "4", "affero", "agpl", "apache", "bsd", "bsl", "by", "cc", "cc0", "clause", "eclipse", "epl", "general", "gnu", "gpl", "isc", "lesser", "lgpl", "mit", "mozilla", "mpl", "nc", "sa", "unlicense", "zlib")
#: The bodies of public licenses, after their titles and copyright lines, and their labels.
BODIES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
        "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction
        and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works
        are solely in the form of machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
        detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General
        Public License along with this program.""",
}
#: Telling clauses of long licenses, and their labels.
CLAUSES = {
    "apache grant": ("apache", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
        copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""),
    "mpl grant": ("mpl", """Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such
        Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a
        Larger Work"""),
    "gpl 3 copies": ("gpl", """You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an
        appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the
        absence of any warranty; and give all recipients a copy of this License along with the Program."""),
    "gpl 2 copies": ("gpl", """You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on
        each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of
        the Program a copy of this License along with the Program."""),
    "agpl network": ("agpl", """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through
        a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network
        server at no charge, through some standard or customary means of facilitating copying of software."""),
    "bsd endorsement": ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission."""),
}
#: Words of a gram in phrases and notices, and in bodies; the share of a template's words that must be verified (of a notice's, all but one in eight),
#: and how far apart neighbouring diagonals may be.
PAIR, RUN, NEEDED, APART = 2, 4, {2: 0.875, 4: 0.7}, 3


def template_rows() -> list[tuple[str, str, bool, int, list[str]]]:
    """(template, label, phrase, k, words) of all templates."""
    cut = lambda text: re.findall("[0-9a-z]+", text.lower())
    rows = [(t, label, True, PAIR, cut(t)) for t, label in PHRASES.items()]
    rows += [(t, label, False, PAIR, cut(t)) for t, label in NOTICES.items()]
    rows += [(f"identifier {t}", label, False, PAIR, cut(f"spdx license identifier {t}")) for t, label in IDENTIFIERS.items()]
    rows += [(f"clause {name}", label, False, RUN, cut(text)) for name, (label, text) in CLAUSES.items()]
    return rows + [(f"body {label}", label, False, RUN, cut(text)) for label, text in BODIES.items()]


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, k, words, need, grams, at, gram, said) for each gram of each template: its hash and its words."""
    table = spark.createDataFrame(template_rows(), "template string, label string, phrase boolean, k int, words array<string>")
    grams = F.when(F.col("k") == PAIR, _grams(F.col("words"), PAIR)).otherwise(_grams(F.col("words"), RUN))
    need = F.when(F.col("k") == PAIR, NEEDED[PAIR]).otherwise(NEEDED[RUN])
    return table.select("*", need.alias("need"), (F.size("words") - F.col("k") + 1).alias("grams"), F.posexplode(grams).alias("at", "gram")).withColumn("said", _said(F.col("words"), F.col("at"), F.col("k")))


def _said(w: Column, at: Column, k: Column) -> Column:
    return F.array_join(F.slice(w, at + 1, k), " ")


def _grams(w: Column, k: int) -> Column:
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``documents``.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and characters
    beyond ASCII.  Null and wordless texts have no words, no places and score
    0.  A phrase scores 1, a notice or body the share of its words verified.
    Rows repeating a doc_id are scanned alone; other columns are not read.
    """
    spark = documents.sparkSession
    table = materialise(templates(spark), "templates")
    places = F.broadcast(table.drop("words", "k", "need"))
    grams = [r["gram"] for r in table.select("gram").distinct().collect()]  # some thousand fixed values
    known = lambda w, k: let(_grams(w, k), lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(grams), F.struct(i.alias("place"), x.alias("gram"), _said(w, i, F.lit(k)).alias("said")))), lambda x: x.isNotNull()))
    words = documents.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(F.translate("text", UPPER, UPPER.lower()), NOT_ALNUM).alias("w"))
    # the write freezes the row numbers; words and places are only kept where some template has a gram
    found = let(F.col("w"), lambda w: F.concat(known(w, PAIR), known(w, RUN)))
    rows = words.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), found.alias("places"), "w")
    rows = materialise(rows.withColumn("w", F.when(F.size("places") > 0, F.col("w"))), "grams")
    hits = rows.select("row", F.inline("places")).join(places, ["gram", "said"]).withColumn("diagonal", F.col("place") - F.col("at"))
    votes = hits.groupBy("row", "template", "label", "phrase", "grams", "diagonal").agg(F.count("*").alias("votes"))
    whole = votes.where("phrase and votes = grams").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base")
    )
    # a diagonal near the one before continues its span; the sum of new starts numbers the spans
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    spans = votes.where("not phrase").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > APART).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(near))
    merged = spans.groupBy("row", "template", "label", "grams", "span").agg(F.sum("votes").alias("votes"), F.max("votes").alias("most"), F.sort_array(F.collect_list("diagonal")).alias("diagonals"))  # at most as many as the text has words
    # an unbroken core on one diagonal, for bodies on all of them; then the words of the template at their places on any of the span's
    texts = F.broadcast(table.select("template", "words", "need", "k").distinct())
    merged = merged.join(texts, "template").where(f"2 * if(k = {PAIR}, most, votes) >= need * grams").drop("words")
    spans = materialise(merged.select("row", "template", "label", "diagonals"), "spans")
    # most texts with a known gram have no span left; only the words of those with one move, however many they are
    some = few(spans.select("row").distinct())
    checked = rows.where("w is not null").select("row", "w").join(some, "row", "left_semi").join(spans, "row").join(texts, "template")
    stands = F.transform("words", lambda t, i: F.struct(t.alias("word"), F.exists("diagonals", lambda d: F.coalesce(F.get("w", (i + d).cast("int")) == t, F.lit(False))).alias("right")))
    # in a notice words added count like words changed, unless one diagonal alone has enough of it
    alone = F.array_max(F.transform("diagonals", lambda d: F.size(F.filter("words", lambda t, i: F.get("w", (i + d).cast("int")) == t))))
    added = F.array_max("diagonals") - F.array_min("diagonals")
    right = lambda s: F.size(F.filter(s, lambda x: x["right"]))
    notice = lambda s: F.when(F.forall(s, lambda x: x["right"] | ~x["word"].isin(*NAMING)), F.greatest(alone, right(s) - added))
    share = let(stands, lambda s: F.when(F.col("k") == RUN, right(s)).otherwise(notice(s)) / F.size(s))
    noted = checked.select("row", "label", "need", share.alias("share")).where("share >= need")
    noted = noted.groupBy("row").agg(F.collect_set("label").alias("noted"), F.max("share").alias("share"))
    out = rows.select("doc_id", "row", "n_words").join(whole, "row", "left").join(noted, "row", "left")
    none = F.array().cast("array<string>")
    base, noted_labels = F.coalesce("base", none), F.coalesce("noted", none)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, noted_labels)), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
