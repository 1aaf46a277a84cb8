"""Licence scans: sentences to known identifiers, identifier sequences to ordered rules.

A text is cut into sentences after ``. ! ? ;`` and at blank lines, each is normalised (letters and
digits in lower case, everything else one blank), and sentences that licences consist of become
identifiers. A sentence may be wrapped over lines, with comment marks before each; it may also
begin or end at a line end, as headings have no full stop. Where several known sentences fit, the
longest counts. One that the table ends with a colon may end there inside a line, and the next
one follow. A sentence is known as a whole, also past an abbreviation or a semicolon inside it;
``<holder>`` in the table stands for 1 to 16 words of any name. The identifiers of a text, in order, are matched against the rules: a rule matches
where its identifiers stand one after another, with any unknown sentences between them. Rules are
tried in their order, longer forms first; identifiers that a rule has matched are taken, so a
shorter form does not match them again, and nothing matches across them. Built-in functions only, one pass, no shuffle.

Null and empty texts have no sentence and no licence. Repeated sentences stay repeated in
``sentence_ids``. Repeated rows are scanned alike; empty tables give no rows; extra columns are
not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitrep.llm.common import let

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
    ),
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of <holder> nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."
    ),
    "bsd-endorse-short": (
        "Neither the name of <holder> may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "bsd-endorse-author": (
        "The name of <holder> may not be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "bsd-advertising": (
        "All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement:"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "gpl2-free": (
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version."
    ),
    "lgpl21-free": (
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "mpl-11": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the "
        "\"License\"); you may not use this file except in compliance with the License."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "reserved": "All rights reserved.",
}

#: Licence, and the identifiers that stand for it in this order. Longer forms come first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-obtain")),
    ("Apache-2.0", ("apache-header", "apache-comply")),
    ("Apache-2.0", ("apache-short",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-short")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-author")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source")),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-1.1", ("mpl-11",)),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl-2",)),
    ("LicenseRef-reserved", ("reserved",)),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"([.!?;])[\x20\x09-\x0D]+"
#: Stands for the end of a sentence that no line continues; taken out of texts before.
END = "\x01"
#: A line's start: marks, and the words that open comments in some languages.
LINE_START = r"\n[^a-z0-9\n]*+(?:(?:rem|dnl|c(?=[\x20\t]))(?![a-z0-9])[^a-z0-9\n]*+)?"


#: Stands in a sentence of the table for the words of a name.
HOLDER = "<holder>"
NAME_WORDS = 16


def normalised(sentence: str) -> str:
    """The normal form of a sentence of the table, as the expressions below compute it."""
    lower = sentence.translate(str.maketrans(UPPER, LOWER))
    return f" {HOLDER} ".join(re.sub(r"[^a-z0-9]+", " ", x).strip() for x in lower.split(HOLDER))


def n_parts(sentence: str) -> int:
    """Pieces that the sentence rule cuts a known sentence into."""
    return len(re.sub(SENTENCE_END, "\\1\n", sentence).split("\n"))


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normal form to identifier."""
    return {normalised(s): name for name, s in sentences.items()}


def _form(sentence: str) -> str:
    """A pattern for one known sentence, wrapped or not; its own inner ends may be ends or none."""
    marked = re.sub(SENTENCE_END, f" {END} ", sentence.translate(str.maketrans(UPPER, LOWER)))
    form, gap = "", ""
    for token in re.findall(f"{HOLDER}|{END}|[a-z0-9]+", marked):
        if token == END:
            gap = "[^a-z0-9]++"
            continue
        name = f"[a-z0-9]++(?:[^a-z0-9]++[a-z0-9]++){{0,{NAME_WORDS - 1}}}?"
        form += gap + (name if token == HOLDER else token)
        gap = f"[^a-z0-9{END}]++"
    return form


def known_pattern(sentences: dict[str, str]) -> str:
    """A pattern for the known sentences, between line or sentence ends."""
    rest = f"[^a-z0-9\\n{END}]*+"
    forms = []
    for sentence in sorted(sentences.values(), key=lambda s: len(normalised(s)), reverse=True):
        own_end = f"(?=[^a-z0-9{END}:]*+:)|" if sentence.rstrip().endswith(":") else ""
        forms.append(f"{_form(sentence)}(?:{own_end}(?={rest}[\\n{END}]))")
    return f"(?:[\\n{END}]|\\G[^a-z0-9{END}:]*+:){rest}({'|'.join(forms)})"


def _identifiers(text: Column, sentences: dict[str, str]) -> Column:
    known = known_sentences(sentences)
    lower = F.translate(text, UPPER + END, LOWER + " ")
    lines = F.regexp_replace(F.concat(F.lit("\n"), lower, F.lit("\n")), LINE_START, "\n")
    ends = F.regexp_replace(lines, SENTENCE_END + r"|\n\n+", END)
    found = F.regexp_extract_all(ends, F.lit(known_pattern(sentences)), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def normal(sentence: Column) -> Column:
        plain = F.regexp_replace(sentence, "[^a-z0-9]+", " ")
        # longer forms first; one that is found holds a mark that no other form fits
        for own in sorted((s for s in known if HOLDER in s), key=len, reverse=True):
            plain = F.regexp_replace(plain, f"^{own.replace(HOLDER, '[^<]+')}$", own)
        return plain

    return F.transform(found, lambda s: F.element_at(table, normal(s)))


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
) -> DataFrame:
    """``doc_id``, ``n_known`` sentences, ``sentence_ids``, ``licenses`` and ``n_licenses``.

    ``sentence_ids`` and ``licenses`` are joined by commas, in text order and rule order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select(
        "doc_id", let(_identifiers(text, sentences), lambda x: F.struct(F.size(x).alias("n"), F.array_join(x, ",").alias("ids"))).alias("c")
    )
    tried = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in sequence)).alias("ids")) for name, sequence in rules]
    )
    none = F.array().cast("array<string>")
    # a taken identifier leaves a gap that is no identifier
    left = F.aggregate(
        tried,
        F.struct(F.concat(F.lit("<"), F.replace(F.col("c.ids"), F.lit(","), F.lit("><")), F.lit(">")).alias("row"), none.alias("names")),
        lambda s, r: F.struct(
            F.replace(s["row"], r["ids"], F.lit("<>")).alias("row"),
            F.when(s["row"].contains(r["ids"]), F.array_append(s["names"], r["name"]))
            .otherwise(s["names"])
            .alias("names"),
        ),
        lambda s: F.array_distinct(s["names"]),
    )
    named = F.when(F.col("c.n") > 0, left).otherwise(none) if rules else none
    ids = ids.select("doc_id", "c", named.alias("licenses"))
    licenses = F.col("licenses")
    return ids.select(
        "doc_id",
        F.col("c.n").cast("long").alias("n_known"),
        F.col("c.ids").alias("sentence_ids"),
        F.array_join(licenses, ",").alias("licenses"),
        F.size(licenses).cast("long").alias("n_licenses"),
    )
