"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each sentence is normalised, known sentences are mapped to
identifiers, and the sequence of identifiers is matched against an ordered list of licence rules.
A rule that matches consumes its sentences, so that a later, more general rule sees only what is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

# Well-known licence sentences, normalised (lower case, letters and digits only).
SENTENCES = {
    "licensed under cc by nc 4 0": "ccbync4",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnuwarranty",
    "see the gnu general public license for more details": "gnudetails",
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2head",
    "you may not use this file except in compliance with the license": "apache2comply",
    "you may obtain a copy of the license at": "apache2copy",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied": "asis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdendorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# The rules, in order; each is a run of sentence identifiers and the licence it means.
RULES = (
    (("gpl3plus", "gnuwarranty", "gnudetails"), "GPL-3.0-or-later"),
    (("gpl2plus", "gnuwarranty", "gnudetails"), "GPL-2.0-or-later"),
    (("gpl3plus",), "GPL-3.0-or-later"),
    (("gpl2plus",), "GPL-2.0-or-later"),
    (("gpl3",), "GPL-3.0-only"),
    (("gpl2",), "GPL-2.0-only"),
    (("apache2head", "apache2comply", "apache2copy"), "Apache-2.0"),
    (("apache2head",), "Apache-2.0"),
    (("apache2",), "Apache-2.0"),
    (("mitgrant", "mitnotice", "asis"), "MIT"),
    (("mitgrant", "mitnotice"), "MIT"),
    (("mit",), "MIT"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse"), "BSD-3-Clause"),
    (("bsdgrant", "bsdsource", "bsdbinary"), "BSD-2-Clause"),
    (("mpl2",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccbysa4",), "CC-BY-SA-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("reserved",), "LicenseRef-AllRightsReserved"),
)
# Sentences of the usual notices in full, beside SENTENCES, and the rules that take them, before RULES.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliable",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsdasis",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsdliable",
    "you should have received a copy of the gnu general public license along with this program": "gnucopy",
    "http www apache org licenses license 2 0": "apacheurl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apachebasis",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apacherest",
    "see the license for the specific language governing permissions and limitations under the license": "apachesee",
}
NOTICE_RULES = (
    (("gpl3plus", "gnuwarranty", "gnudetails", "gnucopy"), "GPL-3.0-or-later"),
    (("gpl2plus", "gnuwarranty", "gnudetails", "gnucopy"), "GPL-2.0-or-later"),
    (("apache2head", "apache2comply", "apache2copy", "apacheurl", "apachebasis", "apachesee"), "Apache-2.0"),
    (("apache2head", "apache2comply", "apacherest", "apachesee"), "Apache-2.0"),
    (("mitgrant", "mitnotice", "asis", "mitliable"), "MIT"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse", "bsdasis", "bsdliable"), "BSD-3-Clause"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdasis", "bsdliable"), "BSD-2-Clause"),
)
# Further usual notices and the heads of licence texts; * stands for up to twelve words, such as a holder's name.
MORE = {
    "gnu general public license version 3 29 june 2007": "gpl3text",
    "gnu general public license version 2 june 1991": "gpl2text",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3text",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21text",
    "gnu affero general public license version 3 19 november 2007": "agpl3text",
    "apache license version 2 0 january 2004": "apache2text",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2text",
    "mozilla public license version 2 0": "mpl2text",
    "eclipse public license v 2 0": "epl2text",
    "creative commons legal code cc0 1 0 universal": "cc0text",
    "cc0 1 0 universal": "cc0text",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnuverbatim",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21plus",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnuwarranty",
    "see the gnu lesser general public license for more details": "gnudetails",
    "see the gnu affero general public license for more details": "gnudetails",
    "you should have received a copy of the gnu lesser general public license along with this library": "gnucopy",
    "you should have received a copy of the gnu lesser general public license along with this program": "gnucopy",
    "you should have received a copy of the gnu affero general public license along with this program": "gnucopy",
    "if not see https www gnu org licenses": "gnusee",
    "if not see http www gnu org licenses": "gnusee",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mplcopy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mplcopy",
    "redistributions of source code must retain the copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdendorse",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsdendorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement *": "bsdadvert",
    "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsdasis",
    "in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsdliable",
    "in no event shall * be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0grant",
    "the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "iscasis",
    "in no event shall * be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "iscliable",
    "this software is provided as is without any express or implied warranty": "zlibasis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlibliable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlibgrant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boostgrant",
    "distributed under the boost software license version 1 0": "boost",
    "boost software license version 1 0 august 17th 2003": "boost",
    "to the extent possible under law * has waived all copyright and related or neighboring rights to *": "cc0",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgres",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which accompanies this distribution": "epl2",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "cddl",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
    "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence": "eupl12",
    "licensed under the artistic license 2 0": "artistic2",
    "this work is licensed under the creative commons attribution 4 0 international license": "ccby4",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "ccbysa4",
    "this work is licensed under the creative commons attribution noncommercial 4 0 international license": "ccbync4",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "ccbynd4",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "ccbyncsa4",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "ccbyncnd4",
}
_GNU = [("gpl3", "GPL-3.0"), ("gpl2", "GPL-2.0"), ("lgpl21", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0")]
#: Rules for MORE, before the others; longer runs of identifiers come before their parts.
MORE_RULES = (
    *[((f"{i}plus", "gnuwarranty", "gnudetails", "gnucopy", "gnusee"), f"{n}-or-later") for i, n in _GNU],
    *[((f"{i}plus", "gnuwarranty", "gnudetails", "gnucopy"), f"{n}-or-later") for i, n in _GNU],
    *[((f"{i}plus", "gnuwarranty", "gnudetails"), f"{n}-or-later") for i, n in _GNU],
    (("gpl2", "gnuwarranty", "gnudetails", "gnucopy", "gnusee"), "GPL-2.0-only"),
    (("gpl2", "gnuwarranty", "gnudetails"), "GPL-2.0-only"),
    *[((f"{i}text", "gnuverbatim"), f"{n}-only") for i, n in _GNU],
    *[((f"{i}text",), f"{n}-only") for i, n in _GNU],
    *[((f"{i}plus",), f"{n}-or-later") for i, n in _GNU],
    (("apache2text",), "Apache-2.0"),
    (("mpl2", "mplcopy"), "MPL-2.0"),
    (("mpl2text",), "MPL-2.0"),
    (("epl2text",), "EPL-2.0"),
    (("epl2",), "EPL-2.0"),
    (("cc0text",), "CC0-1.0"),
    (("bsdgrant", "bsdsource", "bsdbinary", "bsdadvert", "bsdendorse", "bsdasis", "bsdliable"), "BSD-4-Clause"),
    (("iscgrant", "iscasis", "iscliable"), "ISC"),
    (("iscgrant",), "ISC"),
    (("bsd0grant", "iscasis", "iscliable"), "0BSD"),
    (("zlibasis", "zlibliable", "zlibgrant"), "Zlib"),
    (("zlibgrant",), "Zlib"),
    (("boost", "boostgrant"), "BSL-1.0"),
    (("boostgrant",), "BSL-1.0"),
    (("boost",), "BSL-1.0"),
    (("cc0",), "CC0-1.0"),
    (("postgres",), "PostgreSQL"),
    (("cddl",), "CDDL-1.0"),
    (("wtfpl",), "WTFPL"),
    (("eupl12",), "EUPL-1.2"),
    (("artistic2",), "Artistic-2.0"),
    (("ccbynd4",), "CC-BY-ND-4.0"),
    (("ccbyncsa4",), "CC-BY-NC-SA-4.0"),
    (("ccbyncnd4",), "CC-BY-NC-ND-4.0"),
)
# Licence names that a tag may give.
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL "
    "PSF-2.0 Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
_plain = lambda name: re.sub(r"[^a-z0-9]+", " ", name.lower())
TAGGED = {f"spdx license identifier {_plain(t)}": f"tag{_plain(t).replace(' ', '')}" for t in TAGS}
TAG_RULES = tuple(((f"tag{_plain(t).replace(' ', '')}",), t) for t in TAGS)
KNOWN, ALL_RULES = SENTENCES | NOTICES | MORE | TAGGED, MORE_RULES + NOTICE_RULES + RULES + TAG_RULES
#: Every known sentence has one of these in it; a text without any is not looked through for them.
KEYS = ("licen", "permission", "warrant", "redistribut", "reserved", "unencumbered", "liable", "copyright", "apache", "advertising", " as is ", "creative commons", " mpl ", " cc0 ")
#: A sentence with one of these words that is not a known one is listed as <unknown>.
HINT = r"(^| )(licen[cs]e|licen[cs]ed|copyright)( |$)"
#: Sentences end at a line's end or at closing punctuation before a space.
END, NOISE = r"[.!?;:]+[ \t\r\n]+", r"[^a-z0-9\n]+"
#: Ends that a known sentence does not run across, unlike line ends, semicolons and colons.
STOP = r"[;:]*[.!?][.!?;:]*[ \t\r\n]+"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, with an empty one after each full stop and for each blank line; null for a null text."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower_ascii(text), STOP, "\n\n"), END, "\n"), NOISE, " ")
    return F.transform(F.split(clean, "\n"), lambda s: F.trim(s))


def _pattern(sentence: str) -> str:
    """A known sentence as a pattern over parts: its spaces may be line ends, * up to twelve words."""
    words = sentence.replace(" ", "[ \n]").replace("[ \n]v[ \n]", "[ \n]v(?: |\n\n?)")
    words = words.replace("[ \n]*[ \n]", "[ \n](?:[^ \n]+[ \n]){1,12}?").replace("[ \n]*", "(?:[ \n][^ \n]+){0,12}?")
    return "\n" + words + "(?=\n)"


def _named(parts: Column, known: dict[str, str]) -> Column:
    """Sentences, with each run of them that makes a known sentence replaced by its identifier as ``<a>``; the longest known first.

    A known sentence may be wrapped or cut at semicolons and colons, and after the word v, but starts and ends with a sentence.
    """
    flat = F.concat(F.lit("\n"), F.array_join(parts, "\n"), F.lit("\n"))
    spaced = F.replace(F.replace(flat, F.lit("\n\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    piece = lambda s: max((x.strip() for x in s.split("*")), key=len)
    table = F.array(*[F.struct(F.lit(piece(s)).alias("s"), F.lit(_pattern(s)).alias("p"), F.lit(f"\n<{i}>").alias("i")) for s, i in sorted(known.items(), key=lambda x: (-len(x[0]), x[0]))])
    any_key = spaced.contains(KEYS[0])
    for key in KEYS[1:]:
        any_key = any_key | spaced.contains(key)
    found = F.when(any_key, F.filter(table, lambda k: F.contains(spaced, k["s"]))).otherwise(F.slice(table, 1, 0))
    return F.split(F.aggregate(found, flat, lambda text, k: F.regexp_replace(text, k["p"], k["i"])), "\n")


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, rules=ALL_RULES) -> DataFrame:
    """Licences of each text.

    n_sentences counts the parts of a text between ends (also line ends); a known sentence may run over several of them.
    Returns, for each row, doc_id, n_sentences, sentence_ids (as ``<a><b>``, in order), licenses
    (matched names, sorted, distinct, joined by comma; empty if none), n_unmatched (identifiers that no
    rule used) and status: none, identified, or partial if some identifier is unmatched.  Null and
    empty texts have no sentences; repeated rows are scanned each; an empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    kept = F.filter(_named(F.col("sentences"), known), lambda s: s.startswith("<") | s.rlike(HINT))
    ids = F.transform("kept", lambda s: F.when(s.startswith("<"), s).otherwise("<unknown>"))
    matched = F.col("sentence_ids")
    for parts, licence in rules:
        matched = F.replace(matched, F.lit("".join(f"<{p}>" for p in parts)), F.lit("{" + licence + "}"))
    rows = docs.select(F.col("doc_id"), F.coalesce(sentences(F.col("text").cast("string")), F.array().cast("array<string>")).alias("sentences"))
    rows = rows.select("doc_id", F.size(F.filter("sentences", lambda s: s != "")).cast("long").alias("n_sentences"), kept.alias("kept"))
    rows = rows.select("doc_id", "n_sentences", F.array_join(ids, "").alias("sentence_ids"))
    rows = rows.withColumn("matched", matched)
    rows = rows.select(
        "doc_id",
        "n_sentences",
        "sentence_ids",
        F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all("matched", F.lit(r"\{([^}]+)\}"), F.lit(1)))), ",").alias("licenses"),
        F.regexp_count("matched", F.lit("<")).cast("long").alias("n_unmatched"),
    )
    return rows.withColumn("status", F.when(F.col("sentence_ids") == "", "none").when(F.col("n_unmatched") > 0, "partial").otherwise("identified"))


def oracle(known: dict[str, str] = KNOWN, rules=ALL_RULES) -> str:
    """DuckDB SQL for ``scan`` over ``documents`` where each known sentence is one part: it does not join wrapped or cut ones, nor know those with names in them."""
    names = ", ".join(f"('{s}', '{i}')" for s, i in known.items() if "*" not in s)
    matched = "sentence_ids"
    for parts, licence in rules:
        matched = f"replace({matched}, '{''.join(f'<{p}>' for p in parts)}', '{{{licence}}}')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    with names(sentence, id) as (values {names}),
    clean as (select doc_id, string_split(regexp_replace(regexp_replace(translate(text, '{upper}', '{lower}'),
              '[.!?;:]+[ \t\r\n]+', chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) as parts from documents),
    each as (select doc_id, unnest(parts) as s, generate_subscripts(parts, 1) as pos from clean),
    kept as (select doc_id, pos, trim(s) as s from each where trim(s) <> ''),
    found as (select k.doc_id, k.pos, '<' || coalesce(n.id, 'unknown') || '>' as id from kept k left join names n on n.sentence = k.s
              where n.id is not null or regexp_matches(k.s, '{HINT}')),
    seq as (select d.doc_id, coalesce(c.n, 0) as n_sentences, coalesce(f.ids, '') as sentence_ids from documents d
            left join (select doc_id, count(*) as n from kept group by doc_id) c on c.doc_id = d.doc_id
            left join (select doc_id, string_agg(id, '' order by pos) as ids from found group by doc_id) f on f.doc_id = d.doc_id),
    done as (select *, {matched} as matched from seq)
    select doc_id, cast(n_sentences as bigint) as n_sentences, sentence_ids,
           array_to_string(list_sort(list_distinct(regexp_extract_all(matched, '\{{([^}}]+)\}}', 1))), ',') as licenses,
           cast(length(matched) - length(replace(matched, '<', '')) as bigint) as n_unmatched,
           case when sentence_ids = '' then 'none' when matched like '%<%' then 'partial' else 'identified' end as status
    from done"""
