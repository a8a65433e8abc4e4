"""Operator 5: licence scans by sentence-rule recognition, in DataFrame functions only.

A text is cut into sentences at . ! ? ; : before white space, at blank lines (lines without a-z and 0-9, so a comment's frame counts as blank),
at numbers of lists at the start of a line and around SPDX lines; copyright lines are left out. A sentence may be wrapped over lines. It is
normalised (A-Z to lower case, all but a-z and 0-9 to one blank) and looked up among the known licence sentences; a sentence that only says under
which licence something stands ("This project is licensed under the X, see ...") is looked up by the licence's name; if it is not known, its lines
are looked up one by one; what is still not known becomes a gap, and gaps in a row are one. The resulting sequence of identifiers is matched
against the rules in their order, longer ones first: a rule's identifiers must stand side by side, and what a rule has matched no later rule uses
again. Identifiers that no rule matched are reported as leftovers.

No row meets another: one scan, no shuffle, and a hot source or a group of copies is nothing special. All tables are constants of the plan.

Edge cases: null and empty texts have no sentences, no licences and no leftovers; sentences of a lone letter or of one or two digits (numbers of
lists) and "all rights reserved" don't count; repeated rows each give a row; a null id stays null; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as published, normalised: fixed values.
SENTENCES = {
    "MIT-REF": "released under the mit license",
    "MIT-REF-2": "licensed under the mit license",
    "MIT-TITLE": "mit license",
    "MIT-GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-NOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-AS-IS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT-LIABILITY": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD-GRANT": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-SOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-BINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-ENDORSE": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "APACHE-2-REF": "licensed under the apache license version 2 0",
    "APACHE-2-HEAD": "licensed under the apache license version 2 0 the license",
    "APACHE-USE": "you may not use this file except in compliance with the license",
    "APACHE-COPY": "you may obtain a copy of the license at",
    "GPL-3-REF": "this work is licensed under the gnu general public license version 3",
    "GPL-2-REF": "this work is licensed under the gnu general public license version 2",
    "GPL-FREE": "this program is free software",
    "GPL-3-PLUS": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL-2-PLUS": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LGPL-REF": "this library is licensed under the gnu lesser general public license",
    "CC-BY-REF": "licensed under cc by 4 0",
    "CC-BY-SA-REF": "licensed under cc by sa 4 0",
    "CC-BY-NC-REF": "licensed under cc by nc 4 0",
    "CC0-REF": "licensed under cc0 1 0",
    "PD-REF": "this work is in the public domain",
    "MIT-TITLE-2": "the mit license",
    "MIT-TITLE-3": "the mit license mit",
    "APACHE-URL": "http www apache org licenses license 2 0",
    "APACHE-URL-2": "https www apache org licenses license 2 0",
    "APACHE-AS-IS": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "APACHE-SEE": "see the license for the specific language governing permissions and limitations under the license",
    "APACHE-TEXT": "apache license version 2 0 january 2004 http www apache org licenses",
    "LIBRARY-FREE": "this library is free software",
    "GPL-2-TEXT": "gnu general public license version 2 june 1991",
    "GPL-3-TEXT": "gnu general public license version 3 29 june 2007",
    "LGPL-2.1-TEXT": "gnu lesser general public license version 2 1 february 1999",
    "LGPL-3-TEXT": "gnu lesser general public license version 3 29 june 2007",
    "AGPL-3-TEXT": "gnu affero general public license version 3 19 november 2007",
    "MPL-2-REF": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "MPL-2-COPY": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "MPL-2-COPY-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "MPL-2-TEXT": "mozilla public license version 2 0",
    "ISC-TITLE": "isc license",
    "ISC-GRANT": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-GRANT-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0BSD-GRANT": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "BSL-REF": "distributed under the boost software license version 1 0",
    "BSL-TEXT": "boost software license version 1 0 august 17th 2003",
    "UNLICENSE-FREE": "this is free and unencumbered software released into the public domain",
    "UNLICENSE-ANYONE": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "CC-BY-LONG": "this work is licensed under a creative commons attribution 4 0 international license",
    "CC-BY-LONG-2": "this work is licensed under the creative commons attribution 4 0 international license",
    "CC-BY-SA-LONG": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CC-BY-SA-LONG-2": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "CC-BY-NC-LONG": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "CC-BY-NC-LONG-2": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "BSD-ADVERT": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BSD-PRODUCT": "this product includes software developed by the copyright holder",
    "ZLIB-AS-IS": "this software is provided as is without any express or implied warranty",
    "ZLIB-LIABILITY": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ZLIB-GRANT": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "ZLIB-ORIGIN": "the origin of this software must not be misrepresented",
    "ZLIB-CLAIM": "you must not claim that you wrote the original software",
    "ZLIB-PRODUCT": "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "ZLIB-ALTERED": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "ZLIB-NOTICE": "this notice may not be removed or altered from any source distribution",
    "WTFPL-TITLE": "do what the fuck you want to public license version 2 december 2004",
    "WTFPL-VERBATIM": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "WTFPL-TERMS": "do what the fuck you want to public license terms and conditions for copying distribution and modification",
    "WTFPL-YOU": "you just do what the fuck you want to",
    "EPL-1-TEXT": "eclipse public license v 1 0",
    "EPL-2-TEXT": "eclipse public license v 2 0",
}

# The notices of the GNU licences: "you can redistribute it ... under the terms of ...", whose second half a semicolon may part.
GNU = {"GPL": "general", "LGPL": "lesser general", "AGPL": "affero general"}
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
for _family, _name in GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name} public license"
    SENTENCES[f"{_family}-TERMS"] = f"{_terms} as published by the free software foundation"
    for _v in GNU_VERSIONS[_family]:
        _said = _v.replace(".", " ")
        SENTENCES[f"EITHER-{_v}"] = f"either version {_said} of the license or at your option any later version"
        SENTENCES[f"{_family}-{_v}-PLUS"] = f"{_terms} as published by the free software foundation either version {_said} of the license or at your option any later version"
        SENTENCES[f"{_family}-{_v}-TERMS"] = f"{_terms} version {_said} as published by the free software foundation"

# SPDX lines name a licence by its identifier.
SPDX = "MIT BSD-2-Clause BSD-3-Clause 0BSD ISC Apache-2.0 MPL-2.0 BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()
SPDX += "BSD-4-Clause Zlib WTFPL EPL-1.0 EPL-2.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1 EUPL-1.2 Artistic-2.0 PostgreSQL NCSA MS-PL OFL-1.1".split()
OLD_SPDX = {f"{x}{plus}": x + to for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for plus, to in (("", "-only"), ("+", "-or-later"))}
TAG = "spdx license identifier "
for _name in [*SPDX, *OLD_SPDX]:
    SENTENCES[f"SPDX-{_name}"] = TAG + _name.lower().replace("+", "-plus").replace("-", " ").replace(".", " ")

# What else licences are called, normalised, without a last "license": fixed values.
CALLED = {
    "MIT": ("mit", "expat"), "Apache-2.0": ("apache 2 0", "apache 2", "apache license 2 0", "apache license version 2 0", "apache license v2 0"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"), "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"), "BSD-4-Clause": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "ISC": ("isc",), "Zlib": ("zlib",), "WTFPL": ("wtfpl",), "Unlicense": ("unlicense",), "CC0-1.0": ("cc0", "cc0 1 0 universal"),
    "MPL-2.0": ("mpl 2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v 2 0"), "BSL-1.0": ("boost software license 1 0", "boost software license version 1 0"),
    "EPL-1.0": ("epl 1 0", "eclipse public license 1 0", "eclipse public license v 1 0", "eclipse public license version 1 0"), "EPL-2.0": ("epl 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"),
}
CC_WORDS = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}


def _references() -> dict[str, str]:
    """"licensed under ...", by every name of a licence, with the licence."""
    names = {name: licence for licence, called in CALLED.items() for name in called}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        for v in ("3.0", "4.0"):
            said, short = v.replace(".", " "), kind.replace("-", " ")
            long = "creative commons " + " ".join(CC_WORDS[w] for w in kind.split("-"))
            for name in (f"cc {short} {said}", f"{long} {said}", f"{long} {said} international", f"{long} {said} unported", f"http creativecommons org licenses {short} {said}", f"https creativecommons org licenses {short} {said}"):
                names[name] = f"CC-{kind.upper()}-{v}"
    for family, word in GNU.items():
        for v in GNU_VERSIONS[family]:
            said, short = v.replace(".", " "), family.lower()
            for called in (f"gnu {word} public license", f"gnu {short}", short):
                for version in {f"version {said}", f"v{said}", said, *(() if "." in v else (f"version {said} 0", f"v{said} 0", f"{said} 0"))}:
                    licence = f"{family}-{v}" + ("" if "." in v else ".0")
                    names[f"{called} {version}"] = f"{licence}-only"
                    names |= dict.fromkeys((f"{called} {version} or later", f"{called} {version} or any later version", f"{called} {version} or at your option any later version"), f"{licence}-or-later")
            names |= {f"{short}v{said}": f"{licence}-only", f"{short}v{said} or later": f"{licence}-or-later"}
    return {f"licensed under {name}": licence for name, licence in names.items()}


REFERENCES = _references()
# The form of a reference, and what of it is looked up.
REFERENCE = (
    r"^(?:(?:(?:this|the|our|all) (?:[a-z0-9]+ ){1,5}(?:is|are) (?:also )?)?(?:(?:dual )?licensed|released|distributed|published|provided|(?:made )?available) )?under (?:the terms (?:and conditions )?of )?(?:the |an? )?(.+?)(?: licen[cs]e)?(?: (?:see|which is available at) .*)?$",
    "licensed under {1}",
)


def _rules() -> list[tuple[str, tuple[str, ...]]]:
    """Rules in order: licence, identifiers side by side."""
    mit = ("MIT-GRANT", "MIT-NOTICE", "MIT-AS-IS", "MIT-LIABILITY")
    out = [("MIT", (title, *mit)) for title in ("MIT-TITLE", "MIT-TITLE-2", "MIT-TITLE-3")] + [("MIT", mit)]
    out += [("BSD-4-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERT", "BSD-PRODUCT", "BSD-ENDORSE"))]
    out += [("BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE")), ("BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"))]
    apache = ("APACHE-2-HEAD", "APACHE-USE", "APACHE-COPY")
    out += [("Apache-2.0", (*apache, url, "APACHE-AS-IS", "APACHE-SEE")) for url in ("APACHE-URL", "APACHE-URL-2")] + [("Apache-2.0", apache)]
    for family, versions in GNU_VERSIONS.items():
        for v in versions:
            licence = f"{family}-{v}" + ("" if "." in v else ".0")
            for free in ("GPL-FREE", "LIBRARY-FREE"):
                out += [(f"{licence}-or-later", (free, f"{family}-TERMS", f"EITHER-{v}")), (f"{licence}-or-later", (free, f"{family}-{v}-PLUS")), (f"{licence}-only", (free, f"{family}-{v}-TERMS"))]
            out.append((f"{licence}-only", (f"{family}-{v}-TEXT",)))
    zlib = ("ZLIB-AS-IS", "ZLIB-LIABILITY", "ZLIB-GRANT", "ZLIB-ORIGIN", "ZLIB-CLAIM", "ZLIB-PRODUCT", "ZLIB-ALTERED", "ZLIB-NOTICE")
    out += [("Zlib", zlib), ("Zlib", zlib[2:]), ("WTFPL", ("WTFPL-TITLE", "WTFPL-VERBATIM", "WTFPL-TERMS", "WTFPL-YOU"))]
    out += [("MPL-2.0", ("MPL-2-REF", copy)) for copy in ("MPL-2-COPY", "MPL-2-COPY-2")]
    out += [("ISC", ("ISC-TITLE", grant)) for grant in ("ISC-GRANT", "ISC-GRANT-2")] + [("ISC", ("ISC-GRANT",)), ("ISC", ("ISC-GRANT-2",)), ("0BSD", ("0BSD-GRANT",))]
    out += [("Unlicense", ("UNLICENSE-FREE", "UNLICENSE-ANYONE")), ("Unlicense", ("UNLICENSE-FREE",))]
    alone = {
        "MIT": ("MIT-REF", "MIT-REF-2"), "Apache-2.0": ("APACHE-2-REF", "APACHE-2-HEAD", "APACHE-TEXT"), "GPL-3.0-only": ("GPL-3-REF",), "GPL-2.0-only": ("GPL-2-REF",), "LGPL": ("LGPL-REF",),
        "MPL-2.0": ("MPL-2-REF", "MPL-2-TEXT"), "BSL-1.0": ("BSL-REF", "BSL-TEXT"), "CC-BY-4.0": ("CC-BY-REF", "CC-BY-LONG", "CC-BY-LONG-2"), "CC-BY-SA-4.0": ("CC-BY-SA-REF", "CC-BY-SA-LONG", "CC-BY-SA-LONG-2"),
        "CC-BY-NC-4.0": ("CC-BY-NC-REF", "CC-BY-NC-LONG", "CC-BY-NC-LONG-2"), "CC0-1.0": ("CC0-REF",), "Public-domain": ("PD-REF",),
        "WTFPL": ("WTFPL-TITLE", "WTFPL-YOU"), "EPL-1.0": ("EPL-1-TEXT",), "EPL-2.0": ("EPL-2-TEXT",),
    }
    out += [(licence, (i,)) for licence, ids in alone.items() for i in ids] + [(licence, (f"UNDER-{licence}",)) for licence in sorted(set(REFERENCES.values()))]
    return out + [(licence, (f"SPDX-{name}",)) for name, licence in (dict(zip(SPDX, SPDX, strict=True)) | OLD_SPDX).items()]


RULES = tuple(_rules())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# In turn, on lower-case text after a line end: what it finds and what stands for it; a form feed ends a sentence.
CUTS = (
    (r"\r\n?", "\n"),
    (r"\bv\.[ \t]+([0-9])", "v {1}"),
    (r"spdx-license-identifier:[ \t]*([^\n]*)", "\f@{1}\f"),
    (r"\n[^a-z0-9\n\f]*\n", "\f"),
    (r"[\n\f][^a-z0-9@\n\f]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+", "\f"),
    (r"[\n\f][^a-z0-9@\n\f]*copyright[ \t]+(?:\(c\)|©|[0-9]{4})[^\n\f]*", "\f"),
    (r"[.!?;:][\"')\]]*[ \t\n]+", "\f"),
)
ENDORSE = ("neither the names? of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors")
PRODUCT = ("this product includes software developed by .+", "this product includes software developed by the copyright holder")
NO_SENTENCE = "^([0-9]{0,2}|[a-z]|all rights reserved)$"


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def _spdx(s: Column) -> Column:
    """The normalised sentences of an SPDX line: one for each licence of its expression."""
    return F.transform(F.split(F.replace(F.substring(s, 2, 1 << 30), F.lit("+"), F.lit("-plus")), r"[ \t](?:or|and|with)[ \t]"), lambda x: F.concat(F.lit(TAG), _plain(x)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: tuple = RULES, references: dict[str, str] = REFERENCES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences (in text order, repeats kept), n_licences, leftovers of every document. Lists are joined by commas."""
    ids = F.create_map(*chain.from_iterable((F.lit(s), F.lit(i)) for i, s in (SENTENCES if sentences is None else sentences).items()))

    under = F.create_map(*chain.from_iterable((F.lit(s), F.lit(f"UNDER-{licence}")) for s, licence in references.items()))

    def known(s: Column) -> Column:
        named = F.try_element_at(under, F.regexp_replace(s, REFERENCE[0], REFERENCE[1].replace("{1}", "$1")))
        return F.coalesce(F.try_element_at(ids, s), F.when(F.contains(s, F.lit("under ")), named))

    def free(s: Column) -> Column:
        """A sentence with the usual words for the names of its holder."""
        named = F.when(s.startswith("neither the name"), F.regexp_replace(s, *ENDORSE)).when(s.startswith("this product includes"), F.regexp_replace(s, *PRODUCT))
        return named.otherwise(s)

    def names(x: Column) -> Column:
        lines = F.filter(F.transform(F.split(x["raw"], "\n"), _plain), lambda s: s != "")
        listed = F.transform(F.when(x["raw"].startswith("@"), _spdx(x["raw"])).otherwise(lines), lambda s: F.coalesce(known(s), F.lit("-")))
        return F.when(x["id"].isNotNull(), F.array(x["id"])).when(x["raw"].startswith("@") | F.contains(x["raw"], F.lit("\n")), listed).otherwise(F.array(F.lit("-")))

    text = F.concat(F.lit("\n"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER))
    marked = F.replace(text, F.lit("@"), F.lit(" "))  # so that @ marks SPDX lines only
    cut = reduce(lambda s, c: F.regexp_replace(s, c[0], c[1].replace("{1}", "$1")), CUTS, marked)
    split = F.transform(F.split(cut, "\f"), lambda s: F.struct(s.alias("raw"), _plain(s).alias("whole")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(split, lambda x: ~x["whole"].rlike(NO_SENTENCE)).alias("_sentences"))
    named = F.transform("_sentences", lambda x: F.struct(x["raw"].alias("raw"), known(free(x["whole"])).alias("id")))
    rows = rows.select("doc_id", F.size("_sentences").cast("long").alias("n_sentences"), F.flatten(F.transform(named, names)).alias("_ids"))
    sequence = F.regexp_replace(F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">")), "(<->)+", "<->")
    rows = rows.withColumn("_found", F.filter("_ids", lambda i: i != "-"))
    matched = reduce(lambda s, rule: F.replace(s, F.lit("".join(f"<{i}>" for i in rule[1])), F.lit(f"<={rule[0]}>")), rules, sequence)
    rows = rows.withColumn("_matched", F.when(F.size("_found") > 0, matched).otherwise(""))
    rows = rows.withColumn("_licences", F.regexp_extract_all("_matched", F.lit("<=([^>]+)>"), F.lit(1))).withColumn("_rest", F.regexp_extract_all("_matched", F.lit("<([A-Z0-9][^>]*)>"), F.lit(1)))
    return rows.select("doc_id", "n_sentences", F.array_join("_found", ",").alias("sentence_ids"), F.array_join("_licences", ",").alias("licences"), F.size("_licences").cast("long").alias("n_licences"), F.array_join("_rest", ",").alias("leftovers"))


def oracle() -> str:
    """DuckDB SQL for scan() over documents with the tables above."""
    values = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    named = ", ".join(f"('UNDER-{licence}', '{s}')" for s, licence in REFERENCES.items())
    matched = reduce(lambda s, rule: f"replace({s}, '{''.join(f'<{i}>' for i in rule[1])}', '<={rule[0]}>')", RULES, "seq")
    cut = "chr(10) || translate(replace(coalesce(text, ''), '@', ' '), '" + UPPER + "', '" + LOWER + "')"
    for find, put in CUTS:
        pattern = find.replace("'", "''")
        made = put.replace("{1}", "\\1").replace("\f", "' || chr(12) || '").replace("\n", "' || chr(10) || '")
        cut = f"regexp_replace({cut}, '{pattern}', '{made}', 'g')"

    def plain(s: str) -> str:
        return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"

    def found(s: str) -> str:
        return f"coalesce(m[{s}], CASE WHEN contains({s}, 'under ') THEN u[regexp_replace({s}, '{REFERENCE[0]}', '{REFERENCE[1].replace('{1}', chr(92) + '1')}')] END)"

    return rf"""
WITH known AS (SELECT m, u FROM (SELECT map_from_entries(list((s, i))) AS m FROM (VALUES {values}) t(i, s)), (SELECT map_from_entries(list((s, i))) AS u FROM (VALUES {named}) t(i, s))),
cuts AS (SELECT doc_id, string_split({cut}, chr(12)) AS s, row_number() OVER () AS doc FROM documents),
parts AS (SELECT doc, unnest(s) AS raw, generate_subscripts(s, 1) AS nth FROM cuts),
pieces AS (SELECT *, {plain("raw")} AS whole FROM parts),
freed AS (SELECT *, regexp_replace(regexp_replace(whole, '^{ENDORSE[0]}', '{ENDORSE[1]}'), '^{PRODUCT[0]}', '{PRODUCT[1]}') AS f FROM pieces),
real AS (SELECT *, {found("f")} AS id FROM freed, known WHERE NOT regexp_matches(whole, '{NO_SENTENCE}')),
named AS (
  SELECT doc, nth, CASE WHEN id IS NOT NULL THEN [id]
    WHEN starts_with(raw, '@') THEN list_transform(regexp_split_to_array(replace(substr(raw, 2), '+', '-plus'), '[ \t](?:or|and|with)[ \t]'), lambda x: coalesce(m['{TAG}' || {plain("x")}], '-'))
    ELSE list_transform(list_filter(list_transform(string_split(raw, chr(10)), lambda x: {plain("x")}), lambda x: x <> ''), lambda x: coalesce({found("x")}, '-')) END AS i FROM real
),
lists AS (SELECT doc, count(*) AS n_sentences, flatten(list(i ORDER BY nth)) AS i FROM named GROUP BY doc),
seqs AS (SELECT doc, n_sentences, list_filter(i, lambda x: x <> '-') AS found, regexp_replace('<' || array_to_string(i, '><') || '>', '(<->)+', '<->', 'g') AS seq FROM lists),
done AS (SELECT *, CASE WHEN len(found) > 0 THEN {matched} ELSE '' END AS m FROM seqs)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(array_to_string(found, ','), '') AS sentence_ids, coalesce(array_to_string(regexp_extract_all(m, '<=([^>]+)>', 1), ','), '') AS licences,
  coalesce(len(regexp_extract_all(m, '<=([^>]+)>', 1)), 0) AS n_licences, coalesce(array_to_string(regexp_extract_all(m, '<([A-Z0-9][^>]*)>', 1), ','), '') AS leftovers
FROM cuts LEFT JOIN done USING (doc)
"""
