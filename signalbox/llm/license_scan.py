"""License scan by diagonal voting.

Every rolling k-word hash of every text is joined by Spark with the positions of the same hash in the
license templates. A match votes for the diagonal (text position - template position) of its template:
a verbatim copy puts all its votes on one diagonal, a copy with inserted or missing words on a few
neighbouring ones. Votes are summed by diagonal, neighbouring diagonals are merged, and the spans that
gather enough votes are verified word by word against the template. Templates of one family differ in a
word or two, so a template may name words that have to stand in the span as they are, and of templates
whose spans overlap the one that fits its span best wins.

Phrases are templates too: a phrase stands at a place exactly if all its k-grams vote for the diagonal
of that place, and its words are compared before it counts.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalbox.llm.textkit import NOT_ALNUM, grams, slices, words
from signalbox.llm.wanted import read_again
from signalbox.sources.store import materialize

K = 3
#: Fixed values of the contract: base phrases and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Public license texts and notices, in lower case without punctuation, and the words that tell
#: a template from others of its family.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
            "do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any kind express or "
            "implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
            "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action "
            "of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the "
            "software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
                 "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
                 "conditions of any kind either express or implied see the license for the specific language governing permissions and "
                 "limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
            "the following disclaimer in the documentation and or other materials provided with the distribution this software is "
            "provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
            "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the "
            "author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
             "damages arising from the use of this software permission is granted to anyone to use this software for any purpose "
             "including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version 3 of the license or at your option any later version this program "
            "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
            "merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public "
             "license as published by the free software foundation either version 3 of the license or at your option any later version "
             "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
             "of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
     "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public "
             "license as published by the free software foundation either version 3 of the license or at your option any later version "
             "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
             "of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
     "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
              "with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
                  "sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
                  "commercial and by any means"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike", "attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives", "attribution noncommercial noderivatives"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", "attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike", "attribution sharealike"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives", "attribution noderivatives"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "attribution 4 0"),
    ("cc-by", "licensed under a creative commons attribution 3 0 unported license", "attribution 3 0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
)
#: Diagonals up to so many words apart are one copy; share of a template's votes that is verified;
#: share of its words that must stand in the span in order.
GAP, MIN_VOTES, MIN_WORDS = 4, 0.4, 0.75

_NO_TEMPLATE = -1
_END_MARK = 0x1CE25EED


def _grams_of(text: str) -> np.ndarray:
    return grams(words(pa.array([text]), NOT_ALNUM), K)[1].view(np.int64)


def template_positions(spark: SparkSession, templates) -> DataFrame:
    """``gram, template, at`` of the templates, and of the mark that ends each text: a fixed, small table."""
    rows = [(int(g), t, i) for t, (_, text, *_) in enumerate(templates) for i, g in enumerate(_grams_of(text))]
    return spark.createDataFrame([*rows, (_END_MARK, _NO_TEMPLATE, 0)], "gram long, template int, at int")


def _rolling(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"), NOT_ALNUM)
            at, hashed = grams(w, K)
            size = np.bincount(w.doc[at], minlength=part.num_rows) + 1
            ends = np.cumsum(size)
            values = np.full(int(ends[-1]), _END_MARK, dtype=np.int64)
            inner = np.ones(len(values), dtype=bool)
            inner[ends - 1] = False
            values[inner] = hashed.view(np.int64)
            offsets = pa.array(np.concatenate([[0], ends]), type=pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("mark"), pa.array(w.count.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "mark", "n_words", "grams"])


def _stands(needed: list[str], inside: list[str]) -> bool:
    return not needed or any(inside[i:i + len(needed)] == needed for i in range(len(inside) - len(needed) + 1))


def best_spans(spans: list[dict]) -> list[dict]:
    """Of overlapping spans, those that fit best: by closeness, then by words matched, then by place."""
    taken: list[tuple[int, int]] = []
    best = []
    for span in sorted(spans, key=lambda s: (-s["closeness"], -s["matched"], s["first"], s["last"], s["template"])):
        at = bisect_left(taken, (span["first"], span["last"]))
        before = at > 0 and taken[at - 1][1] > span["first"]
        if not before and not (at < len(taken) and taken[at][0] < span["last"]):
            taken.insert(at, (span["first"], span["last"]))
            best.append(span)
    return sorted(best, key=lambda s: (s["template"], s["first"], s["last"]))


def _verifier(templates, phrases: int, schema: pa.Schema):
    split = [text.split() for _, text, *_ in templates]
    needed = [needs[0].split() if needs else [] for _, _, *needs in templates]

    def check(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), NOT_ALNUM)
                lower = w.data.tobytes().lower()
                spans = []
                for i, found in enumerate(part.column("spans").to_pylist()):
                    own, whole = [], []
                    for s in found:
                        low, high = max(0, s["first"]), min(int(w.count[i]), s["last"])
                        base, number = int(w.first[i]), s["template"]
                        inside = [lower[w.start[base + j]:w.end[base + j]].decode("utf-8", "replace") for j in range(low, high)]
                        target = split[number]
                        span = {"label": templates[number][0], "template": number, "first": low, "last": high, "score": 1.0}
                        if number < phrases:
                            own += [span] if inside == target else []
                            continue
                        blocks = SequenceMatcher(None, target, inside, autojunk=False).get_matching_blocks()
                        matched = sum(b.size for b in blocks)
                        if matched >= MIN_WORDS * len(target) and _stands(needed[number], inside):
                            whole.append(span | {"score": matched / len(target), "matched": matched, "closeness": matched / max(len(target), len(inside))})
                    spans.append(own + [{k: s[k] for k in ("label", "template", "first", "last", "score")} for s in best_spans(whole)])
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "mark": part.column("mark"), "spans": spans}, schema=schema)

    return check


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """``id_col, n_words, spans`` for every row of ``docs``.

    ``spans`` is an array of (label, template, first, last, score) in word positions, end exclusive;
    ``template`` numbers the phrases first, then the templates, and is verified: phrases word for word,
    templates by the share of their words found in order, by the words a template needs (its optional third
    value), and against other templates on the same words, of which only the closest stays; spans of phrases
    always stay. A null text is empty; a text without
    licenses has no spans. Ids may be null or repeated; rows with equal id and text get equal results.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    known = (*phrases, *templates)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    id_type = rows.schema["id"].dataType.simpleString()
    positions = F.broadcast(template_positions(spark, known))  # bounded by the templates, not by the texts

    hits = materialize(
        marked.mapInArrow(_rolling, f"id {id_type}, mark long, n_words long, grams array<long>")
        .select("id", "mark", "n_words", F.posexplode("grams").alias("pos", "gram"))
        .join(positions, "gram")
        .groupBy("id", "mark", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high")), "votes")
    texts = hits.where(F.col("template") == _NO_TEMPLATE).select("id", "mark", "n_words", F.col("votes").alias("copies"))

    same = [F.col("id").eqNullSafe(F.col("own_id")), F.col("mark") == F.col("own_mark")]
    copies = texts.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "copies")
    matched = hits.where(F.col("template") >= 0)
    votes = matched.join(copies, same).withColumn("votes", F.col("votes") / F.col("copies")).drop("own_id", "own_mark", "copies")
    size = F.element_at(F.array(*[F.lit(len(text.split())) for _, text, *_ in known]), F.col("template") + 1)

    exact = votes.where((F.col("template") < len(phrases)) & (F.col("votes") == size - K + 1)).select(
        "id", "mark", "template", F.col("diagonal").alias("first"), (F.col("diagonal") + size).alias("last"))

    # Neighbouring diagonals of one template are one copy; runs of them never cross a text.
    by_diagonal = W.partitionBy("id", "mark", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP, F.lit(True)).cast("int")
    runs = votes.where(F.col("template") >= len(phrases)).withColumn("apart", apart)
    runs = runs.withColumn("run", F.sum("apart").over(by_diagonal.rowsBetween(W.unboundedPreceding, 0)))
    merged = (
        runs.groupBy("id", "mark", "template", "run")
        .agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") + F.col("low")).alias("low"), F.max(F.col("diagonal") + F.col("high")).alias("high"))
        .where(F.col("votes") >= MIN_VOTES * (size - K + 1))
        .select("id", "mark", "template", F.col("low").cast("long").alias("first"), (F.col("high") + K).cast("long").alias("last"))
    )
    span = F.struct("template", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    claimed = materialize(
        exact.select("id", "mark", span.alias("span")).union(merged.select("id", "mark", span.alias("span")))
        .groupBy("id", "mark").agg(F.sort_array(F.collect_list("span")).alias("spans")), "claimed")

    # Rows without an id are few enough to verify from one more pass: they have no place in the bitmap.
    again = read_again(rows, claimed.select("id").where("id is not null"))
    again = again.union(rows.where("id is null")).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    again = again.dropDuplicates(["id", "mark"])
    left = claimed.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "spans")
    schema = pa.schema([("id", pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()), ("mark", pa.int64()), ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))])
    verified = again.join(left.hint("merge"), same).select("id", "mark", "text", "spans").mapInArrow(
        _verifier(known, len(phrases), schema),
        f"id {id_type}, mark long, spans array<struct<label:string,template:int,first:bigint,last:bigint,score:double>>")
    verified = verified.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "spans")
    return (
        texts.join(verified, same, "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.array().cast(
            "array<struct<label:string,template:int,first:bigint,last:bigint,score:double>>")).alias("spans"),
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
        .drop("_copy")
    )
