"""Licence scans by sentences: normalised sentences map to known identifiers, whose sequences
are matched against ordered licence rules.

A text is cut at ``.!?;`` before a blank, so version numbers stay whole, and after list marks like
``(a)`` at the start of a line; it is lower-cased, loses its punctuation and has single blanks. A
known sentence is found where whole lines between two cuts, one or several, are equal to it, so
texts wrapped at any width, with comment marks or blank lines, match. Known sentences have an
identifier each; the sentences of a document that are known form, in order, its sequence.
A rule is an ordered list of identifiers that must follow one another in that sequence, nothing
known between them. Rules are tried in order and each claims its sentences, so a longer rule
(the whole MIT text) goes before its parts. Only DataFrame functions run here; the tables of
sentences and rules are fixed and small, so they are literals of the plan.

Defined results: a null or empty text has no licences; repeated rows are each scanned; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import let

RESERVED = "Proprietary"
# Sentences, by identifier, as normalisation leaves them.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-ref-3": "this project is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-title-3": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-ref-2": "this project is licensed under the apache license version 2 0",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-long": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-copy-2": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl2-ref": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl-free-cut": "this program is free software",
    "gpl3-later-cut": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later-cut": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl2-version-cut": "either version 2 of the license or at your option any later version",
    "lgpl-free-cut": "this library is free software",
    "lgpl21-later-cut": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl21-version-cut": "either version 2 1 of the license or at your option any later version",
    "lgpl3-version-cut": "either version 3 of the license or at your option any later version",
    "agpl-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-later-cut": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-terms-cut": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl-ref": "licensed under the gnu affero general public license version 3",
    "lgpl3-ref": "licensed under the gnu lesser general public license version 3",
    "lgpl21-ref": "licensed under the gnu lesser general public license version 2 1",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-ref-2": "licensed under the bsd 2 clause license",
    "bsd-ref-3": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-ref": "licensed under the isc license",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2-ref": "licensed under the mozilla public license version 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1 0",
    "boost-ref": "distributed under the boost software license version 1 0",
    "epl2-ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cc0-ref": "licensed under cc0 1 0",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nd-ref": "licensed under cc by nd 4 0",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-ref": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-ref": "licensed under cc by nc nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-long": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "reserved": "all rights reserved",
}
#: Ordered rules: licence, and the identifiers that must follow one another.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title-3", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-long", "apache-comply", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-long", "apache-comply", "apache-copy-2", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-long", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-long", "apache-comply", "apache-copy-2")),
    ("LGPL-2.1-or-later", ("lgpl-free-cut", "lgpl21-later-cut", "lgpl21-version-cut")),
    ("LGPL-3.0-or-later", ("lgpl-free-cut", "lgpl21-later-cut", "lgpl3-version-cut")),
    ("GPL-2.0-or-later", ("gpl-free-cut", "gpl2-later-cut", "gpl2-version-cut")),
    ("GPL-3.0-or-later", ("gpl-free-cut", "gpl2-later-cut", "lgpl3-version-cut")),
    ("AGPL-3.0-or-later", ("gpl-free-cut", "agpl-terms-cut", "lgpl3-version-cut")),
    ("GPL-3.0-or-later", ("gpl-free-cut", "gpl3-later-cut")),
    ("AGPL-3.0-or-later", ("gpl-free-cut", "agpl-later-cut")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy-2")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Apache-2.0", ("apache-long",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-ref-2",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-3.0-only", ("gpl3-ref-2",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("AGPL-3.0-or-later", ("agpl-later",)),
    ("AGPL-3.0-only", ("agpl-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("LGPL-2.1-only", ("lgpl21-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-long",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-2",)),
    ("MIT", ("mit-ref-3",)),
    ("BSD-2-Clause", ("bsd-ref-2",)),
    ("BSD-3-Clause", ("bsd-ref-3",)),
    ("ISC", ("isc-ref",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    (RESERVED, ("reserved",)),
)
SENTENCE_END = r"(?dm)[.!?;]+(?=[\x20\x09\x0B-\x0D])|^[^a-z0-9\n]*[a-z0-9]{1,2}\)(?=[\x20\x09])"
#: One of these is in every known sentence.
WORDS = ("licen", "permission", "copyright", "redistribut", "software", "warrant", "endorse", "reserved", "waived", "advertising", "mpl")


def _lines(text: Column) -> Column:
    """The text in lower case with single blanks for other characters than ASCII letters and
    digits; ``|`` stands between lines and ``~`` at other cuts, both at the ends too."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cuts = F.regexp_replace(F.translate(lower, "~|", "  "), SENTENCE_END, "~")
    bare = F.regexp_replace(cuts, r"[^a-z0-9~\n]+", " ")
    bare = F.regexp_replace(bare, r" ?\n[ \n]*", "|")
    return F.concat(F.lit("|"), F.regexp_replace(bare, r"^ | $| ?~[ |~]*", "~"), F.lit("|"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order.

    Only texts with one of ``WORDS`` are cut.
    """
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    longest_first = sorted(SENTENCES.values(), key=len, reverse=True)
    pattern = "(?<=[|~])(" + "|".join(s.replace(" ", "[ |]") for s in longest_first) + ")(?=[|~])"
    any_word = let(F.lower(text), lambda t: reduce(or_, (F.contains(t, F.lit(w)) for w in WORDS)))
    found = F.transform(F.regexp_extract_all(_lines(text), F.lit(pattern)), lambda s: known[F.translate(s, "|", " ")])
    return F.when(any_word, found).otherwise(F.array().cast("array<string>"))


def _claim(ids: Column) -> Column:
    """Licences that ordered rules find in a sequence of identifiers, joined with blanks around."""
    text = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(f" {'  '.join(parts)} ").alias("parts")) for licence, parts in RULES])

    def step(state: Column, rule: Column) -> Column:
        found = F.when(F.contains(state["rest"], rule["parts"]), F.array_append(state["found"], rule["licence"])).otherwise(state["found"])
        return F.struct(F.replace(state["rest"], rule["parts"], F.lit(" # ")).alias("rest"), found.alias("found"))

    def claimed(state: Column) -> Column:
        found = F.array_sort(F.array_distinct(state["found"]))
        # That rights are reserved claims nothing beside a licence.
        return F.when(F.size(found) > 1, F.array_remove(found, RESERVED)).otherwise(found)

    return F.aggregate(rules, start, step, claimed)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_sentences (known ones), sentence_ids, licences."""
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    claimed = F.when(F.size("ids") == 0, F.array().cast("array<string>")).otherwise(_claim(F.col("ids")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(claimed, ",").alias("licences"))
