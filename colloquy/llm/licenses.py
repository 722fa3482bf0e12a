"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised (ASCII lower case, anything
but letters and digits as one space) and looked up among known licence
sentences and families of them. A sentence may be wrapped over lines: it ends
at a sentence end or a blank line, and a known one begins and ends where a line
or sentence does. What isn't known counts line by line. What is left is a short sequence of identifiers, on which ordered
rules are matched: the first rule that fits takes its identifiers out of the
sequence and names a licence, then the next rule is tried on the rest.
Sentences that speak of a licence without being known are marked unknown. SPDX
tags are kept as they are written, each licence of an expression by itself.

All of it is column expressions on the row of the document: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Sentences of public licences, normalised, by identifier.
SENTENCES = {
    "apache2grant": "licensed under the apache license version 2 0",
    "apache2the": "licensed under the apache license version 2 0 the license",
    "apache2not": "you may not use this file except in compliance with the license",
    "apache2copy": "you may obtain a copy of the license at",
    "apache2asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2see": "see the license for the specific language governing permissions and limitations under the license",
    "mitname": "the mit license",
    "mitname2": "mit license",
    "mitreleased": "released under the mit license",
    "mitlicensed": "licensed under the mit license",
    "mitgrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mitnotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mitasis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsdgrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsdsource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsdbinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsdendorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsdlicensed": "licensed under the bsd license",
    "gplfree": "this program is free software",
    "gpl2later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3": "licensed under the gnu general public license version 3",
    "gpl3short": "licensed under the gpl version 3",
    "gpl2": "licensed under the gnu general public license version 2",
    "lgplgrant": "licensed under the gnu lesser general public license",
    "mpl2grant": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2": "licensed under the mozilla public license version 2 0",
    "ccby": "licensed under the creative commons attribution 4 0 international license",
    "ccbythis": "this work is licensed under the creative commons attribution 4 0 international license",
    "ccbyshort": "licensed under cc by 4 0",
    "ccbysa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc0": "this work is dedicated to the public domain",
    "publicdomain": "this file is in the public domain",
    "rights": "all rights reserved",
    "apache2title": "apache license version 2 0 january 2004",
    "gpl3title": "gnu general public license version 3 29 june 2007",
    "gpl3titleshort": "gnu general public license version 3",
    "gpl2title": "gnu general public license version 2 june 1991",
    "lgpl3title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3title": "gnu affero general public license version 3 19 november 2007",
    "mpl2title": "mozilla public license version 2 0",
    "epl2title": "eclipse public license v 2 0",
    "mitliable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mitstyle": "use of this source code is governed by an mit style license that can be found in the license file",
    "bsdstyle": "use of this source code is governed by a bsd style license that can be found in the license file",
    "bsdstylegoverned": "governed by a bsd style license",
    "bsdasis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsdliable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "bsdloss": "loss of use data or profits",
    "bsdhowever": "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "iscname": "isc license",
    "iscgrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "iscasis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "iscliable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlibasis": "this software is provided as is without any express or implied warranty",
    "zlibliable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlibgrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicensefree": "this is free and unencumbered software released into the public domain",
    "unlicenseanyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boostgrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "lgplfree": "this library is free software",
    "lgpl21grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3grant": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl2grant": "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3grant": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3onlygrant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "gpl2onlygrant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gplterms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgplterms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agplterms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "either2": "either version 2 of the license or at your option any later version",
    "either21": "either version 2 1 of the license or at your option any later version",
    "either3": "either version 3 of the license or at your option any later version",
    "gplhope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgplhope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpleven": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gplsee": "see the gnu general public license for more details",
    "lgplsee": "see the gnu lesser general public license for more details",
    "agplsee": "see the gnu affero general public license for more details",
    "gplcopy": "you should have received a copy of the gnu general public license along with this program",
    "lgplcopy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agplcopy": "you should have received a copy of the gnu affero general public license along with this program",
    "mpl2copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2grant": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1grant": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
}
SPDX = r"^spdx license identifier [a-z0-9 ]+$"
COPYRIGHT = r"^(copyright|c) (c )?[0-9]{4}( [0-9]{4})*( |$)"
UNKNOWN = r"licen[sc]e|copyright"
#: Every sentence that yields an identifier holds one of HINT; other texts are not cut up. The SQL looks for NAMED alone.
NAMED = r"(?i)licen[sc]e|rights reserved|permission|redistribut|warrant|copyright|public domain|free software|\(c\)|©|endorse"
HINT = NAMED + r"|liable[^a-z0-9]+for|use[^a-z0-9]+data[^a-z0-9]+or[^a-z0-9]+profits|business[^a-z0-9]+interruption|anyone[^a-z0-9]+is[^a-z0-9]+free|of[^a-z0-9]+the[^a-z0-9]+mpl"

#: Ordered: (licence, pattern on the identifiers, each between commas).
RULES = [
    ("Apache-2.0", ",(apache2grant|apache2the|apache2title),(apache2not,)?(apache2copy,)?(apache2asis,)?(apache2see,)?"),
    ("BSD-3-Clause", ",bsdgrant,bsdsource,bsdbinary,bsdendorse,(bsdasis,)?(bsdliable,)?(bsdloss,)?(bsdhowever,)?"),
    ("BSD-2-Clause", ",bsdgrant,bsdsource,bsdbinary,(bsdasis,)?(bsdliable,)?(bsdloss,)?(bsdhowever,)?"),
    ("BSD", ",(bsdlicensed|bsdstyle|bsdstylegoverned),"),
    ("MIT", ",((mitname|mitname2|mitreleased|mitlicensed),)?mitgrant,(mitnotice,)?(mitasis,)?(mitliable,)?"),
    ("MIT", ",(mitreleased|mitlicensed|mitname|mitname2|mitstyle),"),
    ("ISC", ",((iscname,)?iscgrant|iscname),(iscasis,)?(iscliable,)?"),
    ("Zlib", ",(zlibasis,)?(zlibliable,)?zlibgrant,"),
    ("Unlicense", ",unlicensefree,(unlicenseanyone,)?"),
    ("BSL-1.0", ",boostgrant,"),
    ("WTFPL", ",wtfpl,"),
    ("LGPL-2.1-or-later", ",((lgplfree|gplfree),)?(lgpl21grant|lgplterms,either21),((lgplhope|gplhope),)?(gpleven,)?(lgplsee,)?(lgplcopy,)?"),
    ("LGPL-3.0-or-later", ",((lgplfree|gplfree),)?(lgpl3grant|lgplterms,either3),((lgplhope|gplhope),)?(gpleven,)?(lgplsee,)?(lgplcopy,)?"),
    ("LGPL-2.0-or-later", ",((lgplfree|gplfree),)?(lgpl2grant|lgplterms,either2),((lgplhope|gplhope),)?(gpleven,)?"),
    ("AGPL-3.0-or-later", ",(gplfree,)?(agpl3grant|agplterms,either3),(gplhope,)?(gpleven,)?(agplsee,)?(agplcopy,)?"),
    ("GPL-3.0-or-later", ",(gplfree,)?(gpl3later|gplterms,either3),(gplhope,)?(gpleven,)?(gplsee,)?(gplcopy,)?"),
    ("GPL-2.0-or-later", ",(gplfree,)?(gpl2later|gplterms,either2),(gplhope,)?(gpleven,)?(gplsee,)?(gplcopy,)?"),
    ("LGPL-3.0", ",lgpl3title,"),
    ("LGPL-2.1", ",lgpl21title,"),
    ("AGPL-3.0", ",agpl3title,"),
    ("GPL-3.0", ",(gpl3|gpl3short|gpl3title|gpl3titleshort|(gplfree,)?gpl3onlygrant),"),
    ("GPL-2.0", ",(gpl2|gpl2title|(gplfree,)?gpl2onlygrant),"),
    ("LGPL", ",lgplgrant,"),
    ("MPL-2.0", ",((mpl2grant|mpl2),(mpl2copy,)?|mpl2title,)"),
    ("EPL-2.0", ",(epl2grant|epl2title),"),
    ("EPL-1.0", ",epl1grant,"),
    ("CC-BY-SA-4.0", ",ccbysa,"),
    ("CC-BY-4.0", ",(ccby|ccbythis|ccbyshort),"),
    ("CC0-1.0", ",cc0,"),
    ("public-domain", ",publicdomain,"),
    ("all-rights-reserved", ",(copyright,)*rights,"),
]
#: A tag and its expression, and what stands between its licences.
TAG = r"(?i:spdx-license-identifier):[\x20\t]*(\(*[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+\(*[A-Za-z0-9.+-]*[A-Za-z0-9+]\)*)*)"
BETWEEN = r"[\x20\t]+(?:AND|OR)[\x20\t]+"

#: "this software is licensed under the terms of the" and its like.
LEAD = r"(?:(?:this|the|these|all|our) (?:[a-z]+ ){1,4}?(?:is|are) )?(?:dual |hereby )?(?:licen[sc]ed|released|distributed|made available|available|provided|published|shared) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?"
_V, _LATER = r"(?: version| v)? ?", r"(?: or(?: at your option)?(?: any)? (?:later|newer)(?: version)?| or above| or greater)"
_GPL, _LGPL, _AGPL = r"(?:gnu )?(?:general public licen[sc]e|gpl)", r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)"
_CC = [("by-nc-sa", r"(?:attribution non ?commercial share ?alike|by nc sa)"), ("by-nc-nd", r"(?:attribution non ?commercial no ?deriv(?:ative)?s|by nc nd)"), ("by-nc", r"(?:attribution non ?commercial|by nc)"), ("by-sa", r"(?:attribution share ?alike|by sa)"), ("by-nd", r"(?:attribution no ?deriv(?:ative)?s|by nd)"), ("by", r"(?:attribution|by)")]


def _families() -> list[tuple[str, str, str | None]]:
    """(identifier, pattern of the whole normalised sentence, licence or None where RULES name it); the first that fits counts."""
    under = [("mitlicensed", r"mit(?: x11)?(?: licen[sc]e)?", None), ("apache2grant", r"(?:apache(?: software)? licen[sc]e" + _V + r"2(?: 0)?|apache 2(?: 0)?(?: licen[sc]e)?)(?: the licen[sc]e)?", None)]
    for n, name, words in (("3", "BSD-3-Clause", "new|modified|revised"), ("2", "BSD-2-Clause", "simplified|freebsd")):
        under.append((f"bsd{n}licensed", rf"(?:{n} clause bsd|bsd {n} clause|(?:{words})(?: bsd)?)(?: licen[sc]e)?", name))
    under.append(("bsdlicensed", r"bsd(?: style)?(?: licen[sc]e)?", None))
    for name, words, versions in (("GPL", _GPL, "32"), ("LGPL", _LGPL, ("3", "2 1", "2")), ("AGPL", _AGPL, "3")):
        for v in versions:
            number, dotted, known = v + ("" if " " in v else "(?: 0)?"), v.replace(" ", ".") if " " in v else v + ".0", name == "GPL"
            under.append((f"{name.lower()}{v.replace(' ', '')}later", words + _V + number + _LATER, None if known else f"{name}-{dotted}-or-later"))
            under.append((f"{name.lower()}{v.replace(' ', '')}", words + _V + number + "(?: only| licen[sc]e)?", None if known else f"{name}-{dotted}"))
        under.append(("lgplgrant" if name == "LGPL" else name.lower(), words + "(?: licen[sc]e)?", None if name == "LGPL" else name))
    under += [("mpl2", r"(?:mozilla public licen[sc]e|mpl)" + _V + r"2(?: 0)?", None)]
    under += [(f"epl{v}", rf"(?:eclipse public licen[sc]e|epl){_V}{v}(?: 0)?", f"EPL-{v}.0") for v in "12"]
    under += [("isclicensed", r"isc(?: licen[sc]e)?", "ISC"), ("unlicensed", r"unlicen[sc]e(?: licen[sc]e)?", "Unlicense"), ("boostlicensed", r"boost software licen[sc]e" + _V + r"(?:1(?: 0)?)?", "BSL-1.0"), ("zliblicensed", r"zlib(?: libpng)?(?: licen[sc]e)?", "Zlib"), ("artistic2", r"artistic licen[sc]e" + _V + r"2(?: 0)?", "Artistic-2.0"), ("odbl", r"(?:open database licen[sc]e|odbl)(?: odbl)?" + _V + r"(?:1(?: 0)?)?", "ODbL-1.0")]
    for kind, words in _CC:
        for v in ("4 0", "3 0", "2 5", "2 0", "1 0", ""):
            own = {("by", "4 0"): "ccby", ("by-sa", "4 0"): "ccbysa"}.get((kind, v))
            number = _V + v + "(?: international| unported| generic)?" if v else ""
            under.append((own or f"cc{kind}{v or 'any'}".replace("-", "").replace(" ", ""), rf"(?:creative commons|cc) {words}{number}(?: public)?(?: licen[sc]e)?(?: cc {kind.replace('-', ' ')}(?: {v})?)?", None if own else f"CC-{kind.upper()}" + (f"-{v.replace(' ', '.')}" if v else "")))
    under.append(("cc0", r"(?:creative commons |cc )?(?:cc0|zero)" + _V + r"(?:1(?: 0)?)?(?: universal)?(?: public domain dedication)?(?: licen[sc]e)?", None))
    out = [(i, LEAD + p, x) for i, p, x in under]
    out.append(("mpl2grant", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0", None))
    out.append(("cc0", r"(?:this|the|these) (?:[a-z]+ ){1,4}?(?:is|are|has been|have been) (?:hereby )?dedicated to the public domain", None))
    out.append(("publicdomain", r"(?:this|the|these) (?:[a-z]+ ){1,4}?(?:is|are|has been|have been) (?:hereby )?(?:in|released into|released to|placed in|placed into) the public domain", None))
    return out


FAMILIES = _families()
#: Licences of the identifiers that RULES don't name.
MORE_RULES = sorted({(x, i) for i, _, x in FAMILIES if x})
MORE_HINTS = r"|public\s+domain|rights\s+reserved|free\s+software|(?:licen[sc]ed|released|distributed|available|provided|published|shared)\s+under|c[^a-z0-9]+[0-9]{4}"
WIDE_HINT = HINT + MORE_HINTS
#: An end of a sentence; "v." before a number is none.
END = r"(?<![^a-z0-9]v)[.!?;:]+(?:[\x20\x09-\x0D]+|\z)"


def _piece() -> str:
    """Pattern of one known sentence, which may hold line breaks, or else of what is left of one line."""
    under, other = [p.removeprefix(LEAD) for _, p, _ in FAMILIES if p.startswith(LEAD)], [p for _, p, _ in FAMILIES if not p.startswith(LEAD)]
    known = "|".join([*sorted(SENTENCES.values(), key=len, reverse=True), LEAD + "(?:" + "|".join(under) + ")", *other])
    return rf"(?<![^|\n])(?:{known.replace(' ', '[ ' + chr(92) + 'n]')})(?![^|\n])|(?<![^|\n])[^|\n]+"


PIECE = _piece()


def pieces(text: Column) -> Column:
    """Normalised sentences of a text in order: known ones whole, others by line."""
    plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ|\r", "abcdefghijklmnopqrstuvwxyz \n")
    plain = F.replace(plain, F.lit("license-identifier:"), F.lit("license-identifier"))  # a tag is one sentence
    for pattern, by in ((END, "|"), (r"[^a-z0-9|\n]+", " "), (r" *\n *(?:\n *)+", "|"), (r" *([|\n]) *", "$1"), (r"\A +| +\z", "")):
        plain = F.regexp_replace(plain, pattern, by)
    return F.transform(F.regexp_extract_all(plain, F.lit(PIECE), F.lit(0)), lambda x: F.translate(x, "\n", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of a text's licence sentences, in order."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, name)])

    def name(s):
        other = F.when(s.rlike(SPDX), F.concat(F.lit("spdx "), F.replace(s, F.lit("spdx license identifier "), F.lit("")))).when(s.rlike(COPYRIGHT), F.lit("copyright"))
        family = F.lit(None).cast("string")
        for i, pattern, _ in reversed(FAMILIES):
            family = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(i)).otherwise(family)
        family = F.when(s.rlike("(?: under | the public domain$|mozilla)"), family)
        return F.coalesce(F.try_element_at(known, s), other, family, F.when(s.rlike(UNKNOWN), F.lit("unknown")))

    found = F.filter(F.transform(pieces(text), name), lambda x: x.isNotNull())
    return F.when(text.rlike(WIDE_HINT), found).otherwise(F.array().cast("array<string>"))


def licensed(docs: DataFrame) -> DataFrame:
    """``docs`` with licence_sentences (identifiers in order) and licences (names in the order of the rules, then of MORE_RULES, then SPDX tags).

    A null or empty text has neither. Each rule names its licence once, however
    often it fits. Repeated rows are scanned alike; an empty table gives an empty
    one. A very long text takes time in proportion to its length times the number
    of its licence sentences. Columns of these names are replaced.
    """
    out = docs.withColumn("licence_sentences", identifiers(F.coalesce("text", F.lit(""))))
    out = out.withColumn("_rest", F.concat(F.lit(","), F.array_join("licence_sentences", ","), F.lit(","))).withColumn("_names", F.array().cast("array<string>"))
    for name, pattern in RULES:
        fits = F.col("_rest").rlike(pattern)
        out = out.withColumns({"_names": F.when(fits, F.concat("_names", F.array(F.lit(name)))).otherwise(F.col("_names")), "_rest": F.when(fits, F.regexp_replace("_rest", pattern, ",")).otherwise(F.col("_rest"))})
    more = F.transform(F.filter(F.array(*(F.lit(i) for _, i in MORE_RULES)), lambda i: F.array_contains("licence_sentences", i)), lambda i: F.try_element_at(F.create_map(*[F.lit(v) for x, i in MORE_RULES for v in (i, x)]), i))
    written = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TAG), F.lit(1))
    tags = F.flatten(F.transform(written, lambda x: F.split(F.translate(x, "()", ""), BETWEEN)))
    return out.withColumn("licences", F.array_distinct(F.concat("_names", more, tags))).drop("_rest", "_names")


def op6_licence_sentences(spark, sf_dir: str) -> DataFrame:
    """Every document's licence sentences and licences."""
    out = licensed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("licence_sentences").cast("long").alias("n_sentences"), F.array_join("licence_sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    """The same by joining lines: at each line the longest known sentence that begins there, else the line."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN t = {quoted(s)} THEN {quoted(n)}" for n, s in SENTENCES.items())
    families = " ".join(f"WHEN regexp_full_match(t, {quoted(p)}) THEN {quoted(i)}" for i, p, _ in FAMILIES)
    steps = ["""
WITH RECURSIVE hinted AS (
  SELECT doc_id, replace(replace(translate(replace(text, chr(13) || chr(10), chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ|' || chr(13), 'abcdefghijklmnopqrstuvwxyz ' || chr(10)), 'license-identifier:', 'license-identifier'), chr(0), ' ') AS t
  FROM documents WHERE regexp_matches(text, %s)),
ended AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([^a-z0-9]v)[.!?;:]+([\\x20\\x09-\\x0D]+|\\z)', '\\1 \\2', 'g'), '[.!?;:]+([\\x20\\x09-\\x0D]+|\\z)', '|', 'g') AS t FROM hinted),
plain AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[^a-z0-9|\\n]+', ' ', 'g'), ' *\\n *(?:\\n *)+', '|', 'g'), ' *([|\\n]) *', '\\1', 'g'), '^ +| +$', '', 'g') AS t FROM ended),
segs AS (SELECT doc_id, unnest(string_split(t, '|')) AS s, generate_subscripts(string_split(t, '|'), 1) AS seg FROM plain),
lines AS (SELECT doc_id, seg, list_filter(string_split(s, chr(10)), lambda x: x <> '') AS ls FROM segs),
starts AS (SELECT doc_id, seg, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines),
spans AS (SELECT doc_id, seg, i, unnest(range(i, len(ls) + 1)) AS j, ls FROM starts),
joined AS (SELECT doc_id, seg, i, j, array_to_string(ls[i:j], ' ') AS t FROM spans),
named AS (
  SELECT doc_id, seg, i, j, t, CASE %s END AS sentence, CASE WHEN regexp_matches(t, ' under | the public domain$|mozilla') THEN CASE %s END END AS family
  FROM joined),
best AS (
  SELECT doc_id, seg, i, COALESCE(max(j) FILTER (sentence IS NOT NULL), max(j) FILTER (family IS NOT NULL), i) AS j FROM named GROUP BY 1, 2, 3),
walk AS (SELECT doc_id, seg, 1::BIGINT AS i FROM lines WHERE len(ls) > 0 UNION ALL SELECT w.doc_id, w.seg, b.j + 1 FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.seg = w.seg AND b.i = w.i),
found AS (
  SELECT n.doc_id, n.seg, n.i, COALESCE(sentence, CASE WHEN regexp_matches(t, %s) THEN 'spdx ' || substr(t, 25) WHEN regexp_matches(t, %s) THEN 'copyright' END, family, CASE WHEN regexp_matches(t, %s) THEN 'unknown' END) AS id
  FROM walk JOIN best USING (doc_id, seg, i) JOIN named n ON n.doc_id = best.doc_id AND n.seg = best.seg AND n.i = best.i AND n.j = best.j),
listed AS (SELECT doc_id, list(id ORDER BY seg, i) AS ids FROM found WHERE id IS NOT NULL GROUP BY 1),
s0 AS (SELECT doc_id, text, COALESCE(ids, []) AS ids FROM documents LEFT JOIN listed USING (doc_id)),
r0 AS (SELECT doc_id, text, ids, ',' || COALESCE(array_to_string(ids, ','), '') || ',' AS rest, []::VARCHAR[] AS names FROM s0)""" % (quoted(NAMED + MORE_HINTS), cases, families, quoted(SPDX), quoted(COPYRIGHT), quoted(UNKNOWN))]
    for i, (name, pattern) in enumerate(RULES):
        steps.append(f"r{i + 1} AS (SELECT doc_id, text, ids, regexp_replace(rest, {quoted(pattern)}, ',', 'g') AS rest, CASE WHEN regexp_matches(rest, {quoted(pattern)}) AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM r{i})")
    more = ", ".join(f"CASE WHEN list_contains(ids, {quoted(i)}) THEN {quoted(x)} END" for x, i in MORE_RULES)
    tags = f"flatten(list_transform(regexp_extract_all(COALESCE(text, ''), {quoted(TAG)}, 1), lambda x: string_split_regex(translate(x, '()', ''), {quoted(BETWEEN)})))"
    steps.append(f"every AS (SELECT doc_id, ids, list_concat(names, list_filter([{more}], lambda x: x IS NOT NULL), {tags}) AS names FROM r{len(RULES)})")
    return ",\n".join(steps) + """
SELECT doc_id, len(ids)::BIGINT AS n_sentences, COALESCE(array_to_string(ids, ','), '') AS sentences,
       COALESCE(array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ','), '') AS licences
FROM every
"""


OP6_SQL = _sql()
