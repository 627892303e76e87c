"""Recognising licences by their sentences.

Texts are cut into sentences, these are normalised (lower case, words separated
by one space), and those that a licence is known to use become identifiers, by
a lookup in sets of known sentences. A sentence may be one line or wrapped over
several, with comment marks. Candidates are runs of lines that begin with the
first two words of a known sentence; sentences that name a licence may go on
behind the name. Some sentences name somebody: they are looked up without the words between. A document's sequence of identifiers
is matched against rules: sequences that state a licence. All of it is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Sentences of the public licences, normalised; * is a gap of one to eight words.
SENTENCES = {
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "fsf-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-title": "mozilla public license version 2 0",
    "mpl2-definitions": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "cc0-title": "cc0 1 0 universal",
    "cc0-purpose": "statement of purpose",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mpl2-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl-terms": "the accompanying program is provided under the terms of this eclipse public license agreement",
    "epl1-title": "eclipse public license v 1 0",
    "epl2-title": "eclipse public license v 2 0",
    "cddl-title": "common development and distribution license cddl version 1 0",
    "cddl-original": "original software means the source code and executable form of computer software code that is originally released under this license",
    "artistic2-title": "the artistic license 2 0",
    "wtfpl-title": "do what the fuck you want to public license",
    "ofl-header": "this font software is licensed under the sil open font license version 1 1",
    "gpl-appendix": "how to apply these terms to your new programs",
    "lgpl-appendix": "how to apply these terms to your new libraries",
}
#: Licences with the names by which texts refer to them, normalised.
NAMES = {
    "MIT": ("mit license", "mit licence"),
    "MIT-0": ("mit no attribution license",),
    "X11": ("x11 license",),
    "ISC": ("isc license",),
    "0BSD": ("zero clause bsd license", "bsd zero clause license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 license"),
    "Apache-1.1": ("apache software license version 1 1",),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gplv2 or later"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gplv3 or later"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl v3", "lgplv3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agplv3"),
    "MPL-1.1": ("mozilla public license version 1 1", "mozilla public license 1 1"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"),
    "CDDL-1.0": ("common development and distribution license version 1 0", "cddl 1 0"),
    "CPL-1.0": ("common public license version 1 0",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
    "Unlicense": ("unlicense",),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
    "PostgreSQL": ("postgresql license",),
    "Python-2.0": ("python software foundation license version 2",),
    "NCSA": ("university of illinois ncsa open source license", "ncsa open source license"),
    "EUPL-1.2": ("european union public licence version 1 2", "european union public licence v 1 2", "eupl 1 2"),
    "MS-PL": ("microsoft public license",),
    "MS-RL": ("microsoft reciprocal license",),
    "OSL-3.0": ("open software license version 3 0",),
    "AFL-3.0": ("academic free license version 3 0",),
    "ECL-2.0": ("educational community license version 2 0",),
    "UPL-1.0": ("universal permissive license version 1 0", "universal permissive license v 1 0"),
    "MulanPSL-2.0": ("mulan permissive software license version 2", "mulan psl v2"),
    "BlueOak-1.0.0": ("blue oak model license 1 0 0",),
    "CECILL-2.1": ("cecill license version 2 1",),
    "LPPL-1.3c": ("latex project public license version 1 3c",),
    "PHP-3.01": ("php license version 3 01",),
    "Ruby": ("ruby license",),
    "SSPL-1.0": ("server side public license version 1",),
    "BUSL-1.1": ("business source license version 1 1", "business source license 1 1"),
    "Elastic-2.0": ("elastic license version 2 0", "elastic license 2 0"),
    "ODbL-1.0": ("open database license version 1 0", "open data commons open database license"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal license"),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0 unported license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
}
#: A sentence that names a licence begins with one of these; other words may follow behind the name.
STATEMENTS = tuple(
    f"{subject}{verb} under{article}"
    for subject in ("", "it is ", "code is ", "the code is ", *(f"this {x} is " for x in ("project", "work", "software", "program", "library", "package", "file", "document", "repository")))
    for verb in ("licensed", "released", "distributed", "available", "published", "made available", "provided")
    for article in ("", " the", " a")
) + ("dedicated to the public domain under",)
SPDX = "spdx license identifier"
#: GNU licences are written as identifiers with one of these behind.
ONLY, LATER = "-only", "-or-later"


def named(names: dict[str, tuple[str, ...]] = NAMES) -> dict[tuple[str, str], str]:
    """The licence of each (SPDX, identifier) and ("", name)."""
    made = {("", name): license for license, own in names.items() for name in own}
    for license in names:
        for said in (license, license + ONLY) if "GPL" in license and not license.endswith(LATER) else (license,):
            made[SPDX, said] = license
    made |= {(SPDX, license + LATER): license + LATER for license in ("LGPL-2.1", "LGPL-3.0", "AGPL-3.0") if license in names}
    return {(of, " ".join(x.lower().replace("-", " ").replace(".", " ").split())): license for (of, x), license in made.items()}


#: Fixed values: (rule, licence, identifiers in their order). A sentence that names a licence is a rule of its own.
RULES = (
    ("mit-titled", "MIT", ("mit-title", "mit-grant")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("isc-text", "ISC", ("isc-grant", "isc-warranty")),
    ("isc-text-2", "ISC", ("isc-grant-2", "isc-warranty")),
    ("apache-notice", "Apache-2.0", ("apache-header", "apache-copy", "apache-warranty")),
    ("apache-tail", "Apache-2.0", ("apache-warranty", "apache-limits")),
    ("apache-text", "Apache-2.0", ("apache-title", "apache-terms")),
    ("gpl3-text", "GPL-3.0", ("gpl3-title", "fsf-verbatim")),
    ("gpl2-text", "GPL-2.0", ("gpl2-title", "fsf-verbatim")),
    ("lgpl3-text", "LGPL-3.0", ("lgpl3-title", "fsf-verbatim")),
    ("lgpl21-text", "LGPL-2.1", ("lgpl21-title", "fsf-verbatim")),
    ("agpl3-text", "AGPL-3.0", ("agpl3-title", "fsf-verbatim")),
    ("mpl2-text", "MPL-2.0", ("mpl2-title", "mpl2-definitions")),
    ("cc0-text", "CC0-1.0", ("cc0-title", "cc0-purpose")),
    ("lgpl3-notice", "LGPL-3.0-or-later", ("lgpl3-later",)),
    ("lgpl21-notice", "LGPL-2.1-or-later", ("lgpl21-later",)),
    ("agpl3-notice", "AGPL-3.0-or-later", ("agpl3-later",)),
    ("gpl3-notice", "GPL-3.0-or-later", ("gpl3-later", "gpl-warranty", "gpl-details")),
    ("gpl2-notice", "GPL-2.0-or-later", ("gpl2-later", "gpl-warranty", "gpl-details")),
    ("mpl2-notice", "MPL-2.0", ("mpl2-header", "mpl2-copy")),
    ("bsd2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("unlicense-text", "Unlicense", ("unlicense",)),
    ("boost-text", "BSL-1.0", ("boost-grant",)),
    ("zlib-text", "Zlib", ("zlib-warranty", "zlib-grant")),
    ("epl1-text", "EPL-1.0", ("epl1-title", "epl-terms")),
    ("epl2-text", "EPL-2.0", ("epl2-title", "epl-terms")),
    ("cddl-text", "CDDL-1.0", ("cddl-title", "cddl-original")),
    ("artistic2-text", "Artistic-2.0", ("artistic2-title", "fsf-verbatim")),
    ("wtfpl-text", "WTFPL", ("wtfpl-title",)),
    ("ofl-notice", "OFL-1.1", ("ofl-header",)),
    ("all-reserved", "all-rights-reserved", ("reserved",)),
)

SENTENCE_END = r"[.!?]+([ \t\n\r\f]+|\z)"
#: A full stop that ends no sentence: the one of 'v. 2.0'.
VERSION = r"(^|[^\p{L}\p{N}])v\.[^\p{L}\p{N}.!?]+(\p{N})"
#: The mark of a list's entry, as 'a)' or '(iv)'.
ENTRY = r"(^|\n)[^\p{L}\p{N}\n]*([0-9]{1,2}|[a-z]|[ivx]{2,4})\)[ \t]+"
NOT_WORD = r"[^\p{L}\p{N}\n]+"
GAP, MOST_GAP = "*", 8
#: Every known sentence has one of these in a word; texts without any are passed over.
KEYWORDS = ("licen", "permi", "copyright", "redistribut", "warrant", "conditions", "reserved", "domain", "universal", "contributor", "purpose", "apply", "original", "gplv", "distribut", "released", "published", "available", "provided")
#: The notices that a licence's appendix quotes: behind its title they state nothing.
APPENDIX = r",(?:gpl|lgpl)-appendix(?:,(?:gpl3-later|gpl2-later|lgpl3-later|lgpl21-later|agpl3-later|gpl-warranty|gpl-details))*(?=,)"


def lines(text: Column) -> Column:
    """The normalised lines of a text: one line end where a line ends, two where a sentence or paragraph does, but none of these before an address."""
    lower = F.regexp_replace(F.regexp_replace(text, VERSION, "$1v $2"), ENTRY, "\n\n")
    ended = F.regexp_replace(F.regexp_replace(lower, SENTENCE_END, "\n\n"), NOT_WORD, " ")
    apart = F.regexp_replace(F.regexp_replace(ended, " ?\n[ \n]*\n ?", "\n\n"), " ?(?<!\n)\n(?!\n) ?", "\n")
    return F.regexp_replace(F.trim(apart), "\n\n(?=http)", "\n")


class Known:
    """Sentences by how they are looked up: whole ones, those with a gap, and statements with the names behind them."""

    def __init__(self, sentences: dict[str, str], names: dict[str, tuple[str, ...]]):
        self.whole = {text: name for name, text in sentences.items() if GAP not in text.split()}
        self.gaps = {text: name for name, text in sentences.items() if GAP in text.split()}
        self.statements = (*STATEMENTS, SPDX)
        self.named = {f"{of} {name}".strip(): f"{license.lower()}-name" for (of, name), license in named(names).items()}
        self.heads = sorted({" ".join(text.split()[:2]) for text in (*self.whole, *self.gaps, *self.statements)})
        self.most = max(len(text.split()) + (MOST_GAP if text in self.gaps else 0) for text in (*self.whole, *self.gaps))
        self.said = sorted({len(text.split()) for text in self.statements})
        self.longest = max(len(name.split()) for _, name in named(names))
        #: Words before and behind a gap.
        self.shapes = sorted({(text.split().index(GAP), len(text.split()) - text.split().index(GAP) - 1) for text in self.gaps})


def _looked_up(sentence: Column, known: dict[str, str]) -> Column:
    """The identifier of a known sentence, by a set first: the map is for those only that are in it."""
    if not known:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(sentence.isin(*known), F.element_at(table, sentence))


def _hit(rows: Column, first: Column, known: Known) -> Column:
    """The longest known sentence from a line on, as (size in words, rank, id, last line), null without one. rows: the lines of a paragraph; `first` counts from 1."""
    part = F.slice(rows, first, F.lit(known.most))
    words = F.slice(F.split(F.array_join(part, " "), " "), F.lit(1), F.lit(known.most))
    ends = F.transform(part, lambda x, j: F.size(F.split(F.array_join(F.slice(part, F.lit(1), j + 1), " "), " ")))

    def best(own: Column) -> Column:
        w, line_ends = own["words"], own["ends"]
        said = lambda k: F.array_join(F.slice(w, F.lit(1), k), " ")
        made = lambda k, rank, name: F.struct(k.cast("int").alias("size"), F.lit(rank).alias("rank"), name.alias("id"), (F.size(F.filter(line_ends, lambda e: e < k)) + first).cast("int").alias("last"))
        whole = F.filter(line_ends, lambda k: k <= known.most)
        found = [F.transform(whole, lambda k: made(k, 2, _looked_up(said(k), known.whole)))]
        for a, b in known.shapes:
            fits = F.filter(whole, lambda k: k.between(a + b + 1, a + b + MOST_GAP))
            gap = lambda k: F.concat_ws(f" {GAP} ", said(F.lit(a)), F.array_join(F.slice(w, k - b + 1, F.lit(b)), " "))  # noqa: E731, B023
            found.append(F.transform(fits, lambda k: made(k, 1, _looked_up(gap(k), known.gaps))))  # noqa: B023
        stated = F.filter(F.array(*map(F.lit, known.said)), lambda k: (F.size(w) > k) & said(k).isin(*known.statements))
        name = lambda k, n: F.concat(F.when(said(k) == SPDX, f"{SPDX} ").otherwise(""), F.array_join(F.slice(w, k + 1, n), " "))
        found.append(F.flatten(F.transform(stated, lambda k: F.transform(F.sequence(F.lit(1), F.least(F.size(w) - k, F.lit(known.longest))), lambda n: made(k + n, 0, _looked_up(name(k, n), known.named))))))
        return F.array_max(F.filter(F.concat(*found), lambda c: c["id"].isNotNull()))

    return F.get(F.transform(F.array(F.struct(words.alias("words"), ends.alias("ends"))), best), F.lit(0))


def identifiers(lower: Column, known: Known) -> Column:
    """The identifiers of a lower-case text's known sentences, from left to right, each as long as it can be."""
    paragraphs = F.transform(F.split(lines(lower), "\n\n"), lambda p: F.split(p, "\n"))

    def starts(rows: Column) -> Column:
        head = lambda i: F.substring_index(F.concat_ws(" ", F.get(rows, i - 1), F.get(rows, i)), " ", 2)
        return F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: head(i).isin(*known.heads))

    def step(acc: Column, hit: Column) -> Column:
        later = hit["first"] > acc["last"]
        return F.struct(F.when(later, hit["hit"]["last"]).otherwise(acc["last"]).alias("last"), F.when(later, F.concat(acc["ids"], F.array(hit["hit"]["id"]))).otherwise(acc["ids"]).alias("ids"))

    def of(rows: Column) -> Column:
        hits = F.transform(starts(rows), lambda i: F.struct(i.alias("first"), _hit(rows, i, known).alias("hit")))
        return F.aggregate(F.filter(hits, lambda h: h["hit"].isNotNull()), F.expr("struct(0 as last, cast(array() as array<string>) as ids)"), step, lambda acc: acc["ids"])

    return F.flatten(F.transform(paragraphs, of))


def _rules(rules: tuple, names: dict[str, tuple[str, ...]]) -> list[tuple[str, str, str]]:
    """(rule, licence, identifiers between commas), those of names too."""
    by_name = sorted(set(named(names).values()))
    return [(rule, license, f",{','.join(ids)},") for rule, license, ids in rules] + [(f"{x.lower()}-by-name", x, f",{x.lower()}-name,") for x in by_name]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES, rules: tuple = RULES, names: dict[str, tuple[str, ...]] = NAMES, carry: bool = False) -> DataFrame:
    """Per row n_known, sentence_ids (in their order), rules and licenses (each sorted, joined by commas).

    Sentences that no licence uses are skipped; a rule matches where its
    identifiers follow each other in what remains, notices that a licence's appendix quotes left out. Of two matching rules neither
    hides the other: the longer BSD text also is the shorter one. A null text,
    like an empty one, has no identifier, rule or licence ('' each, n_known 0).
    Repeated rows get equal answers; an empty table stays empty. Each of `known` and `names` needs one of KEYWORDS.
    """
    made = ("n_known", "sentence_ids", "rules", "licenses", "_known", "_matched", "_lower")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made and (carry or c == id_col)]
    table = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(license).alias("license"), F.lit(ids).alias("ids")) for rule, license, ids in _rules(rules, names)])
    out = df.select(*kept, F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_lower"))
    able = F.lit(False)
    for word in KEYWORDS:
        able = able | F.contains("_lower", F.lit(word))
    out = out.select(*kept, F.when(able, identifiers(F.col("_lower"), Known(known, names))).otherwise(F.array().cast("array<string>")).alias("_known"))
    sequence = F.regexp_replace(F.concat(F.lit(","), F.array_join("_known", ","), F.lit(",")), APPENDIX, "")
    out = out.withColumn("_matched", F.when(F.size("_known") > 0, F.filter(table, lambda r: F.contains(sequence, r["ids"]))).otherwise(F.slice(table, 1, 0)))
    return out.select(
        *kept,
        F.size("_known").cast("long").alias("n_known"),
        F.array_join("_known", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.transform("_matched", lambda r: r["rule"])), ",").alias("rules"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_matched", lambda r: r["license"]))), ",").alias("licenses"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """The same by joins: runs of lines, and the first words of them, with the known sentences."""
    known = Known(SENTENCES, NAMES)
    values = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    gaps = [(name, *[x.strip() for x in text.split(GAP)], text.split().index(GAP), len(text.split()) - text.split().index(GAP) - 1) for text, name in known.gaps.items()]
    return rf"""
WITH RECURSIVE whole(id, sentence) AS (VALUES {values((n, t) for t, n in known.whole.items())}),
gapped(id, front, behind, a, b) AS (VALUES {values(gaps)}),
statement(said) AS (VALUES {values((s,) for s in STATEMENTS)}),
name(kind, own, license) AS (VALUES {values((of, n, x) for (of, n), x in named().items())}),
named AS (
  SELECT DISTINCT said || ' ' || own AS sentence, lower(license) || '-name' AS id FROM name, statement WHERE kind = ''
  UNION SELECT kind || ' ' || own, lower(license) || '-name' FROM name WHERE kind <> ''),
rule(rule, license, ids) AS (VALUES {values(_rules(RULES, NAMES))}),
head AS (SELECT DISTINCT string_split(s, ' ')[1] || ' ' || string_split(s, ' ')[2] AS head FROM (
  SELECT sentence AS s FROM whole UNION ALL SELECT front FROM gapped UNION ALL SELECT sentence FROM named)),
part AS (
  SELECT doc_row, unnest(p) AS line, unnest(range(len(p))) AS nr FROM (
    SELECT row_number() OVER () AS doc_row, list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      lower(coalesce(text, '')), '{VERSION}', '\1v \2', 'g'), '{ENTRY}', chr(10) || chr(10), 'g'),
      '{SENTENCE_END}', chr(10) || chr(10), 'g'), '{NOT_WORD}', ' ', 'g'), chr(10)), lambda x: trim(x)) AS p
    FROM documents)),
line AS (
  SELECT doc_row, line, nr, CASE WHEN nr - coalesce(lag(nr) OVER (PARTITION BY doc_row ORDER BY nr), nr - 1) > 1 AND NOT starts_with(line, 'http') THEN 1 ELSE 0 END AS apart
  FROM part WHERE line <> ''),
placed AS (SELECT doc_row, line, nr, sum(apart) OVER (PARTITION BY doc_row ORDER BY nr) AS para FROM line),
para AS (SELECT doc_row, para, list(line ORDER BY nr) AS l FROM placed GROUP BY ALL),
start AS (
  SELECT doc_row, para, i, l[i:i + {known.most - 1}] AS l FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM para)
  WHERE string_split(concat_ws(' ', l[i], l[i + 1]), ' ')[1] || ' ' || string_split(concat_ws(' ', l[i], l[i + 1]), ' ')[2] IN (SELECT head FROM head)),
run AS (
  SELECT doc_row, para, i, string_split(array_to_string(l, ' '), ' ') AS w,
    list_transform(range(1, len(l) + 1), lambda j: len(string_split(array_to_string(l[1:j], ' '), ' '))) AS ends FROM start),
at_end AS (SELECT *, unnest(ends) AS k FROM run),
sized AS (SELECT *, unnest(range(1, {max(known.said) + known.longest + 1})) AS k FROM run),
hit AS (
  SELECT doc_row, para, i, k, 2 AS rank, id, ends FROM at_end JOIN whole ON sentence = array_to_string(w[1:k], ' ') WHERE k <= {known.most}
  UNION ALL SELECT doc_row, para, i, k, 1, id, ends FROM at_end JOIN gapped ON front = array_to_string(w[1:a], ' ') AND behind = array_to_string(w[k - b + 1:k], ' ') AND k - a - b BETWEEN 1 AND {MOST_GAP}
  UNION ALL SELECT doc_row, para, i, k, 0, id, ends FROM sized JOIN named ON sentence = array_to_string(w[1:k], ' ') WHERE k <= len(w)),
best AS (
  SELECT *, i + len(list_filter(ends, lambda e: e < k)) AS last FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_row, para, i ORDER BY k DESC, rank DESC) AS nth FROM hit) WHERE nth = 1),
taken AS (
  SELECT doc_row, para, i, last, id FROM best b WHERE i = (SELECT min(f.i) FROM best f WHERE f.doc_row = b.doc_row AND f.para = b.para)
  UNION ALL SELECT b.doc_row, b.para, b.i, b.last, b.id FROM taken t JOIN best b ON b.doc_row = t.doc_row AND b.para = t.para
    AND b.i = (SELECT min(n.i) FROM best n WHERE n.doc_row = t.doc_row AND n.para = t.para AND n.i > t.last)),
sequence AS (SELECT doc_row, count(*) AS n_known, string_agg(id, ',' ORDER BY para, i) AS ids FROM taken GROUP BY doc_row),
matched AS (
  SELECT doc_row, string_agg(rule, ',' ORDER BY rule) AS rules,
    array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses
  FROM sequence JOIN rule ON contains(regexp_replace(',' || sequence.ids || ',', '{APPENDIX.replace("(?=,)", ",")}', ',', 'g'), rule.ids) GROUP BY doc_row)
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(s.ids, '') AS sentence_ids,
  coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM (SELECT doc_id, row_number() OVER () AS doc_row FROM documents) d LEFT JOIN sequence s USING (doc_row) LEFT JOIN matched m USING (doc_row)
"""


OP6_SQL = _sql()
