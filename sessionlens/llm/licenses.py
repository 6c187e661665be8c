"""License scan by sentence rules.

A text is normalised, its sentence ends, line breaks and blank lines marked, and the sentences that a
license is known to contain get their identifier. A known sentence stands between two marks and may
run over single line breaks and semicolons, as license texts are wrapped, but over nothing else. The
identifiers, in text order, are matched against rules, longest first: a rule is a run of identifiers and
names one license; what it matches is used up. Only expressions over one row; nothing is shuffled.
Texts with none of the words of which every known sentence has one are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licenses and notices, with an identifier for each.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do "
    "so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement": "mit-warranty",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the "
    "distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission":
        "bsd-endorse",
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license "
    "is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied": "apache-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the "
    "license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 2 of the "
    "license or at your option any later version": "gpl2-later",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license":
        "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license":
        "cc-by-nc",
    "all rights reserved": "reserved",
    "this work is dedicated to the public domain": "public-domain",
}
#: Single words, as these stand in a text in one piece before it is normalised too.
HINTS = r"licen[cs]e|copyright|reserved|redistribution|warranty|domain"

#: License and the run of identifiers that states it; an earlier rule comes first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-warranty"]),
    ("Apache-2.0", ["apache-ref"]),
    ("MIT", ["mit-ref"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-2.0", ["gpl2-ref"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("Proprietary", ["reserved"]),
    ("Public-Domain", ["public-domain"]),
]
SENTENCE_END = r"([.!?:])[ \t]+"
NOT_WORD = r"[^a-z0-9]+"


def run_text(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


#: Marks are capitals, which no lower-case text has: H ends a sentence; S, a line break, may end one or
#: stand within; so may T, a semicolon, after which a sentence begins only where a known one ended.
BREAK = r"(?>\r\n|\r|\n)"
MARKS = [(r"[.!?:](?=[ \t\r\n])", " H "), (rf"{BREAK}(?:[^a-z0-9\r\n]*{BREAK})+", " H "),
         (r"[\r\n]", " S "), (r";(?=[ \t])", " T ")]
KNOWN = r"(?:(?<=[HS] )|\G T )(?:" + "|".join(
    s.replace(" ", " (?:[ST] )*") for s in sorted(SENTENCES, key=len, reverse=True)) + ")(?= [HST])"


def _sentence_ids(text: Column) -> Column:
    marked = F.lower(text)
    for pattern, mark in MARKS:
        marked = F.regexp_replace(marked, pattern, mark)
    marked = F.regexp_replace(F.concat(F.lit("H "), marked, F.lit(" H")), "[^a-z0-9HST]+", " ")
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.transform(F.regexp_extract_all(marked, F.lit(KNOWN), F.lit(0)),
                       lambda s: F.try_element_at(known, F.ltrim(F.regexp_replace(s, "[ST] ", ""))))


def recognise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, sentence_ids, licenses, n_sentences, n_unmatched.

    ``sentence_ids`` are the known sentences in text order, ``licenses`` the licenses found, both
    joined by commas; a license counts once, in the order of the rules. ``n_unmatched`` sentences
    belong to no rule that matched.

    A text that is absent, empty or without known sentences has empty lists. Rows repeated are judged
    one by one, an absent key is carried, an empty table gives no rows. Other columns are not carried.
    """
    body = F.col("_text")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).select(
        "_key", F.when(F.lower(body).rlike(HINTS), _sentence_ids(body))
        .otherwise(F.array().cast("array<string>")).alias("_ids"))
    left = F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    rows = rows.withColumn("_left", left).withColumn("_found", F.array().cast("array<string>"))
    for license_id, ids in RULES:
        run = run_text(ids)
        rows = rows.select(
            "_key", "_ids", F.replace("_left", F.lit(run), F.lit("|")).alias("_left"),
            F.when(F.contains("_left", F.lit(run)),
                   F.array_append("_found", F.lit(license_id))).otherwise(F.col("_found"))
            .alias("_found"))
    return rows.select(
        F.col("_key").alias(key), F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("_found"), ",").alias("licenses"),
        F.size("_ids").cast("long").alias("n_sentences"),
        F.regexp_count("_left", F.lit("<")).cast("long").alias("n_unmatched"))
