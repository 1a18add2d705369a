"""License scans by diagonal voting.

All rolling word k-grams of all documents are hashed; those whose hash is one of the
templates' leave the Python task and are joined with the positions of the templates' k-grams (a bounded table, broadcast).  A document's matches with a template are
counted by diagonal (document position minus template position); neighbouring diagonals,
which small edits leave, merge; the merged spans are verified word by word against the
template.  A label is given where a verified span covers enough of its template and little else: a group of
diagonals drifts by no more than a quarter of the template in all, and most of the span's words are the template's.  A
span that another label's span covers and matches better gives none.

Base labels come from whole phrases and are found exactly.

Only matches reach a shuffle.  Equal documents are counted with their multiplicity, so
repeated rows stay apart.  Edges: null and blank texts have no words and no label; texts
shorter than a k-gram have no match; rows with a null doc_id are left out; very long
texts are hashed in parts and scanned whole; words are bytes, so ill-formed UTF-8 stays as it is; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_TABLE, content_key, frugal, PrefixHash, small_batches, word_bounds

#: Phrases of the contract (fixed values): words and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label and text of well-known public licences and notices (fixed values); a label may have several texts.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl-2.0-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost-text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("cc0-notice", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-short", "licensed under CC BY NC"),
    ("cc-by-sa-short", "licensed under CC BY SA"),
    ("mit-notice", "Released under the MIT License."),
    ("gpl-short", "Licensed under the GNU General Public License"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-short", "Available under CC BY 4.0"),
    ("all-rights-reserved", "Copyright All rights reserved."),
)
K = 4
PART = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_TABLE).split()


def template_grams(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """hash, template, position of every k-gram of the templates."""
    hasher, out = PrefixHash(), []
    for t, (_, text) in enumerate(templates):
        words = words_of(text.encode())
        data, starts, ends = word_bounds(b" ".join(words))
        if len(words) >= k:
            h = hasher.ranges(data, starts[: len(words) - k + 1], ends[k - 1 :]).view(np.int64)
            out += [(int(x), t, p) for p, x in enumerate(h.tolist())]
    return out


def phrase_places(words: list[bytes], phrases=PHRASES) -> tuple[list[int], set[str]]:
    """Start words of all places of all phrases, and the labels of those that occur."""
    line, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in phrases:
        own = b" " + b" ".join(words_of(phrase.encode())) + b" "
        at, upto, word = line.find(own), 0, 0
        while at >= 0:
            word += line.count(b" ", upto, at)
            upto = at
            places.append(word)
            labels.add(label)
            at = line.find(own, at + 1)
    return places, labels


def verified(words: list[bytes], template: list[bytes], spans: list[tuple[int, int, int]]) -> tuple[float, float, int, int]:
    """Share of the template's words that stand in the document at their diagonals, share of the words between the first
    and the last of these that do, and that range.

    spans: diagonal, first and last matching position in the document, of one group of neighbouring diagonals.
    """
    hit, stands = np.zeros(len(template), bool), set()
    for diagonal, first, last in spans:
        for at in range(max(first, diagonal, 0), min(last + 1, diagonal + len(template), len(words))):
            if words[at] == template[at - diagonal]:
                hit[at - diagonal] = True
                stands.add(at)
    if not stands:
        return 0.0, 0.0, 0, 0
    start, end = min(stands), max(stands) + 1
    return float(hit.mean()), len(stands) / (end - start), start, end


def merge_diagonals(spans: list[tuple[int, int, int]], drift: int, total: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Groups of spans in which each diagonal is at most ``drift`` above the one before, and all within ``total`` of the first.

    A diagonal's matches lie within one template's length from it, so neighbours are also
    close to each other in the document, however many other matches lie between.
    """
    groups: list[list[tuple[int, int, int]]] = []
    for span in sorted(spans):
        if groups and span[0] - groups[-1][-1][0] <= drift and (total is None or span[0] - groups[-1][0][0] <= total):
            groups[-1].append(span)
        else:
            groups.append([span])
    return groups


def outdone(found: list[dict]) -> list[dict]:
    """Without spans that another label's span covers and matches better: sibling licences share most of their words."""
    best: list[dict] = []
    # a span can only be covered by one that starts no later and ends no sooner: few overlap
    for x in sorted(found, key=lambda x: (x["start"], -x["end"])):
        best = [y for y in best if y["end"] > x["start"]] if len(best) > 64 else best
        x["lost"] = any(y["start"] <= x["start"] and y["end"] >= x["end"] and y["cover"] > x["cover"] and y["label"] != x["label"] for y in best)
        for y in best:
            if x["start"] <= y["start"] and x["end"] >= y["end"] and x["cover"] > y["cover"] and y["label"] != x["label"]:
                y["lost"] = True
        best.append(x)
    return [{k: v for k, v in x.items() if k != "lost"} for x in found if not x["lost"]]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, min_cover: float = 0.8, min_density: float = 0.75, drift: int = 4, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    spans: label, start, end (words) and cover of every verified span.
    """
    spark = docs.sparkSession
    small_batches(spark)
    grams = template_grams(templates, k)
    wanted = np.unique(np.array([g[0] for g in grams], np.int64))
    index = spark.createDataFrame([*grams] or [], "h long, template int, place int")
    own = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    )
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"key long, at int, h long, doc_id {kind}, n_words long, places array<int>, base array<string>, text binary"

    def run(batches):
        """One row for each document (h null), with its text only where a k-gram is a template's, and one for each such k-gram."""
        hasher = PrefixHash()
        for b in batches:
            doc_type = b.column(0).type
            for lo in range(0, b.num_rows, 64):
                few = b.slice(lo, 64)
                heads, owners, keys, ats, hs = [], [], [], [], []
                for doc, key, text in zip(*(few.column(i).to_pylist() for i in range(3))):
                    words = words_of(text)
                    places, labels = phrase_places(words, phrases)
                    met = False
                    for at in range(0, max(0, len(words) - k + 1), part):
                        data, starts, ends = word_bounds(b" ".join(words[at : at + part + k - 1]))
                        h = hasher.ranges(data, starts[: len(starts) - k + 1], ends[k - 1 :]).view(np.int64)
                        own_at = np.flatnonzero(np.isin(h, wanted))  # the join would drop all others
                        if len(own_at):
                            met = True
                            owners.append(pa.repeat(pa.scalar(doc, doc_type), len(own_at)))
                            keys.append(np.full(len(own_at), key, np.int64))
                            ats.append((at + own_at).astype(np.int32))
                            hs.append(h[own_at])
                    heads.append((key, None, None, doc, len(words), places, sorted(labels), text if met else None))
                types = (pa.int64(), pa.int32(), pa.int64(), doc_type, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary())
                names = ["key", "at", "h", "doc_id", "n_words", "places", "base", "text"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*heads), types)], names=names)
                if keys:
                    n = sum(map(len, keys))
                    found = [pa.array(np.concatenate(x)) for x in (keys, ats, hs)]
                    yield pa.record_batch([*found, pa.concat_arrays(owners)] + [pa.nulls(n, t) for t in types[4:]], names=names)

    rows = own.mapInArrow(frugal(run), schema)
    # Template positions: as many rows as the built-in texts have k-grams.
    met = rows.join(F.broadcast(index), "h", "left").filter(F.col("template").isNotNull() | F.col("n_words").isNotNull())
    diagonals = met.groupBy("doc_id", "key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"),
        F.max("at").alias("last"),
        F.count(F.lit(1)).alias("votes"),
        F.count("n_words").alias("copies"),
        F.min(F.when(F.col("n_words").isNotNull(), F.struct("n_words", "places", "base", "text"))).alias("head"),
    )
    docs_met = diagonals.groupBy("doc_id", "key").agg(
        F.max("copies").alias("copies"),
        F.min("head").alias("head"),
        F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "first", "last"))).alias("spans"),
    )
    names = [t[0] for t in templates]
    texts = [words_of(t[1].encode()) for t in templates]

    def judge(frames):
        for f in frames:
            out = []
            for text, base, spans in zip(f["text"], f["base"], f["spans"]):
                found, words = [], None
                by: dict[int, list[tuple[int, int, int]]] = {}
                for s in spans:
                    by.setdefault(int(s["template"]), []).append((int(s["diagonal"]), int(s["first"]), int(s["last"]) + k - 1))
                for t, own_spans in by.items():
                    words = words_of(bytes(text)) if words is None else words
                    # edits may shift a text by a quarter of its length in all
                    for g in merge_diagonals(own_spans, drift, max(drift, len(texts[t]) // 4)):
                        cover, density, start, end = verified(words, texts[t], g)
                        if cover >= min_cover and density >= min_density:
                            found.append({"label": names[t], "start": start, "end": end, "cover": cover})
                found = outdone(found)
                labels = sorted({*(x["label"] for x in found), *base})
                score = max([x["cover"] for x in found] + [1.0] * (len(base) > 0), default=0.0)
                out.append((",".join(sorted(base)), ",".join(labels), score, sorted(found, key=lambda x: (x["start"], x["label"]))))
            named = pd.DataFrame(out, columns=["base_labels", "labels", "score", "found"])
            yield pd.concat([f[["doc_id", "n_words", "n_base", "first_word", "last_word", "copies"]].reset_index(drop=True), named], axis=1)

    flat = docs_met.select(
        "doc_id",
        "head.n_words",
        F.size("head.places").cast("long").alias("n_base"),
        F.array_min("head.places").cast("long").alias("first_word"),
        F.array_max("head.places").cast("long").alias("last_word"),
        "copies",
        "head.text",
        "head.base",
        "spans",
    )
    judged = flat.mapInPandas(
        frugal(judge),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, copies long, base_labels string, "
        "labels string, score double, found array<struct<label:string,start:int,end:int,cover:double>>",
    )
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.col("found").alias("spans")
    )
