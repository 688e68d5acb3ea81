"""License scan by sentence rules (operator 7).

A text is cut into sentences, each is normalised (lower case, signs dropped, blanks squeezed) and
mapped to identifiers of known licence sentences:

* sentences of licence texts, by patterns, since they hold names and dates;
* sentences that name a licence, by a table from normal forms of names to licences: a sentence
  that is a name, or in which a name follows words that put something under a licence, unless
  they are denied ("not released under the ...");
* SPDX marks, whose expression is read part by part.

The sequence of identifiers is then matched against ordered rules: the first rule whose
sequence occurs names a licence and uses its identifiers up; this goes on until no rule
matches. Licence-like sentences that nothing knows are counted.

Texts and blocks that hold no word which a known sentence needs, and no licence word, are passed
over; those words are read off the patterns and names, and all are looked for at once.

Defined results: null, empty and unrelated texts give an empty list and zero counts;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh, table
from quillgraph.session import ship

#: Words without which a sentence is not licence-like.
WORDS = ("licen", "copyright", "spdx", "redistribut", "permission is hereby", "without warrant", "free software", "public domain")

#: Known sentences in normal form (regular expressions, searched for in a sentence), by identifier.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("Spdx", r"spdx license identifier (?P<id>[a-z0-9. +-]+)"),
    ("MitRelease", r"(released|licensed|available|distributed) under (the )?(terms of the )?mit licen[sc]e"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions"),
    ("AsIsWarranty", r"the software is provided as is without warranty of any kind"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscWarranty", r"the software is provided as is and the author disclaims all warranties"),
    ("ApacheRelease", r"licensed under the apache licen[sc]e version 2(\.0)?"),
    ("ApacheFile", r"you may not use this file except in compliance with the licen[sc]e"),
    ("ApacheCopy", r"you may obtain a copy of the licen[sc]e at"),
    ("ApacheWarranty", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"neither the name of .*? may be used to endorse or promote products"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdWarranty", r"this software is provided by .*? as is and any express or implied warranties"),
    ("LgplVersion", r"gnu (lesser|library) general public licen[sc]e,? (as published by the free software foundation )?(either )?(version|v) ?(?P<v>2\.1|2|3)(\.0)?(?P<later>( of the licen[sc]e)? or at your option any later version)?"),
    ("AgplVersion", r"gnu affero general public licen[sc]e,? (as published by the free software foundation )?(either )?(version|v) ?(?P<v>3)(\.0)?(?P<later>( of the licen[sc]e)? or at your option any later version)?"),
    ("GplVersion", r"gnu general public licen[sc]e,? (as published by the free software foundation )?(either )?(version|v) ?(?P<v>[123])(\.0)?(?P<later>( of the licen[sc]e)? or at your option any later version)?"),
    ("MplVersion", r"subject to the terms of the mozilla public licen[sc]e,? v(ersion)? ?(?P<v>1\.1|2\.0)"),
    ("EplVersion", r"eclipse public licen[sc]e,? (version |v ?)?(?P<v>1\.0|2\.0)"),
    ("CcVersion", r"(under|terms of) (a |the )?creative commons (?P<v>(by|attribution)( (nc|noncommercial))?( (sa|sharealike|nd|noderivatives))?)( \d\.\d)?"),
    ("CcVersion", r"(under|terms of) (a |the )?cc (?P<v>(by|attribution)( (nc|noncommercial))?( (sa|sharealike|nd|noderivatives))?)( \d\.\d)?"),
    ("CcZero", r"cc0"),
    ("CcZero", r"creative commons zero"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(placed|dedicated|is|released) (in|into|to) the public domain"),
    ("ZlibWarranty", r"this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("WtfplGrant", r"you just do what the fuck you want to"),
    ("PostgresGrant", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("BeerGrant", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("JsonGood", r"the software shall be used for good not evil"),
    ("UplGrant", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("AllRights", r"all rights reserved"),
)

#: Licences by SPDX identifier and the names they go by, in normal form without "the" and "license".
NAMES: dict[str, str] = {
    "Apache-2.0": "apache 2.0, apache 2, apache version 2.0, apache version 2, apache v2.0, apache v2, apache software 2.0, apache software version 2.0, asl 2.0, al2",
    "Apache-1.1": "apache 1.1, apache software version 1.1",
    "MIT": "mit, expat, mit x11, x11 mit", "MIT-0": "mit 0, mit no attribution", "ISC": "isc", "0BSD": "0bsd, zero clause bsd, bsd zero clause",
    "BSD-2-Clause": "bsd 2 clause, 2 clause bsd, simplified bsd, freebsd, bsd 2", "BSD-3-Clause": "bsd 3 clause, 3 clause bsd, new bsd, modified bsd, revised bsd, bsd 3", "BSD-4-Clause": "bsd 4 clause, 4 clause bsd, original bsd",
    "GPL-2.0-only": "gpl 2.0, gpl 2, gplv2, gpl v2, gnu gpl v2, gnu gpl version 2, gpl 2.0 only", "GPL-2.0-or-later": "gplv2+, gpl 2.0+, gpl 2.0 or later, gpl v2 or later, gplv2 or later",
    "GPL-3.0-only": "gpl 3.0, gpl 3, gplv3, gpl v3, gnu gpl v3, gnu gpl version 3, gpl 3.0 only", "GPL-3.0-or-later": "gplv3+, gpl 3.0+, gpl 3.0 or later, gpl v3 or later, gplv3 or later",
    "LGPL-2.1-only": "lgpl 2.1, lgplv2.1, lgpl v2.1, gnu lgpl version 2.1", "LGPL-2.1-or-later": "lgplv2.1+, lgpl 2.1+, lgpl 2.1 or later", "LGPL-3.0-only": "lgpl 3.0, lgpl 3, lgplv3, lgpl v3", "LGPL-3.0-or-later": "lgplv3+, lgpl 3.0+, lgpl 3.0 or later",
    "AGPL-3.0-only": "agpl 3.0, agpl 3, agplv3, agpl v3, gnu agpl v3", "AGPL-3.0-or-later": "agplv3+, agpl 3.0+, agpl 3.0 or later",
    "MPL-1.1": "mozilla public 1.1, mozilla public version 1.1, mpl 1.1", "MPL-2.0": "mozilla public 2.0, mozilla public version 2.0, mozilla public v2.0, mozilla public v 2.0, mpl 2.0, mplv2, mpl v2",
    "EPL-1.0": "eclipse public 1.0, eclipse public version 1.0, eclipse public v 1.0, epl 1.0", "EPL-2.0": "eclipse public 2.0, eclipse public version 2.0, eclipse public v 2.0, epl 2.0",
    "CDDL-1.0": "common development and distribution, common development and distribution 1.0, common development and distribution version 1.0, cddl, cddl 1.0", "CDDL-1.1": "cddl 1.1, common development and distribution 1.1",
    "EUPL-1.2": "european union public, european union public 1.2, eupl 1.2, eupl v1.2", "CPL-1.0": "common public 1.0, common public version 1.0, cpl 1.0", "BSL-1.0": "boost software, boost software 1.0, boost software version 1.0, boost 1.0, bsl 1.0, boost",
    "Zlib": "zlib, zlib libpng, zlib png", "Libpng": "libpng", "Artistic-1.0": "artistic 1.0", "Artistic-2.0": "artistic 2.0, artistic v2.0, perl artistic 2.0", "WTFPL": "wtfpl, do what the fuck you want to public",
    "Unlicense": "unlicense, the unlicense", "CC0-1.0": "cc0, cc0 1.0, cc0 1.0 universal", "OFL-1.1": "sil open font, sil open font 1.1, sil open font version 1.1, ofl 1.1, open font 1.1", "PostgreSQL": "postgresql", "NCSA": "university of illinois ncsa open source, ncsa",
    "Python-2.0": "python software foundation, psf, python 2.0", "Ruby": "ruby", "PHP-3.01": "php 3.01, php version 3.01", "MS-PL": "microsoft public, ms pl", "UPL-1.0": "universal permissive, universal permissive 1.0, upl 1.0", "AFL-3.0": "academic free 3.0, academic free version 3.0, afl 3.0",
    "OSL-3.0": "open software 3.0, open software version 3.0, osl 3.0", "BlueOak-1.0.0": "blue oak model 1.0.0", "MulanPSL-2.0": "mulan psl v2, mulan permissive software version 2", "OpenSSL": "openssl", "Vim": "vim", "curl": "curl", "bzip2-1.0.6": "bzip2", "JSON": "json",
}

#: Rules in order: licence, then the identifiers that must follow one another (? marks one that may lack).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse", "BsdWarranty?")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarranty?")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty?")),
    ("Apache-2.0", ("ApacheRelease", "ApacheFile?", "ApacheCopy?", "ApacheWarranty?")),
    ("MIT", ("MitGrant", "MitNotice", "AsIsWarranty?")),
    ("MIT", ("MitRelease",)),
    ("ISC", ("IscGrant", "IscWarranty?")),
    ("LGPL-{v}", ("LgplVersion",)),
    ("AGPL-{v}", ("AgplVersion",)),
    ("GPL-{v}", ("GplVersion",)),
    ("MPL-{v}", ("MplVersion",)),
    ("EPL-{v}", ("EplVersion",)),
    ("CC-{v}", ("CcVersion",)),
    ("CC0-1.0", ("CcZero",)),
    ("Unlicense", ("Unlicense",)),
    ("{id}", ("Spdx",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Zlib", ("ZlibWarranty", "ZlibGrant", "ZlibOrigin?")),
    ("WTFPL", ("WtfplGrant",)),
    ("PostgreSQL", ("PostgresGrant",)),
    ("Beerware", ("BeerGrant",)),
    ("JSON", ("JsonGood",)),
    ("UPL-1.0", ("UplGrant",)),
    ("{name}", ("Named",)),
    ("Public-Domain", ("PublicDomain",)),
)

#: Normal form of a name -> licence; the longest has so many words.
_BY_NAME = {
    " ".join(w for w in re.sub(r"[^a-z0-9.+]+", " ", form.lower()).split() if w not in ("the", "license", "licence")): licence
    for licence, forms in NAMES.items() for form in (*forms.split(","), licence)
}
_LONGEST = max(len(form.split()) for form in _BY_NAME)
#: Words that put something under the licence whose name follows them; a denial may stand before.
_CUE = re.compile(
    r"(?P<no>\b(?:not|never|no longer|isn t|without)(?: \w+){0,3} )?\b(?:(?:(?:re)?licen[sc]ed|released|distributed|redistributed|available|provided|published|covered|governed|offered|made available|used|is)(?: \w+){0,2}? (?:under|by|per|subject to)"
    r"|(?P<weak>subject to|under|licen[sc]e is|licen[sc]es?))(?: the| a| an)?(?: terms(?: and conditions)? of)?(?: the| a| an| either)? (?=\S)"
)
#: What is left out of a sentence before it is compared with names.
_EMPTY = re.compile(r"\b(?:the|licen[sc]e[ds]?|copyright)\b")
#: A version's sign, whose dot ends no sentence.
_VERSION = re.compile(r"\b(v|ver|version)\.[\x20\t]*(?=\d)", re.IGNORECASE)

#: A block that ends within a sentence, and one that goes on with it.
_OPEN_END, _GOES_ON = re.compile(r"[\w,]\s*\Z"), re.compile(r"[\s*#/-]*[a-z]")

_SIGNS = re.compile(r"[^\w.+,]+|[,_]+|\.(?!\d)|(?<!\d)\.")
#: An SPDX mark and its expression, which ends at its line.
_SPDX = re.compile(r"spdx[ _-]license[ _-]identifier[\x20\t\"']*[:=]?[\x20\t\"']*(?:\(*[\w.+:-]+\)*(?:[\x20\t]+(?-i:AND|OR|WITH)[\x20\t]+\(*[\w.+:-]+\)*)*)?", re.IGNORECASE)


def needed(pattern: str) -> str:
    """A word that every match of a pattern holds: a licence word, else its longest."""
    bare = re.sub(r"\[[^\]]*\]|\\.", " ", pattern)
    while "(" in bare:
        bare = re.sub(r"\([^()]*\)\??", " ", bare)
    words = re.findall(r"[a-z0-9]+", re.sub(r".[?*]", " ", bare))
    return max(words, key=lambda w: (any(x in w for x in WORDS), len(w)))


#: Identifier, the word it needs, what it ends with if its middle is open, and the pattern.
_KNOWN = [(name, needed(pattern), pattern.partition(".*?")[2], re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])" if name != "BsdEndorse" else pattern)) for name, pattern in SENTENCES]
#: Words of names that tell little.
_COMMON = set("only or later version public software free open source simplified original modified revised clause model new universal common font what want do you to".split())
#: Words one of which any text with a known or licence-like sentence holds.
HINTS = tuple(sorted({w for _, w, _, _ in _KNOWN} | {max(form.split(), key=lambda w: (w not in _COMMON, w.isalpha(), len(w))) for form in _BY_NAME} - {"mit"} | {max(reversed(w.split()), key=len) for w in WORDS}))
#: Finds them all at once.
_FINDER = ahocorasick.Automaton()
for _w in HINTS:
    _FINDER.add_word(_w, len(_w))
_FINDER.make_automaton()


def hinted(text: str) -> bool:
    """Whether a text holds a hint; short ones stand alone. The MIT licence's, a word of other languages too, is in capitals."""
    if "MIT" in text:
        return True
    low = text.lower()
    for end, n in _FINDER.iter(low):
        if n > 3 or not (low[end - n : end - n + 1].isalnum() and end >= n) and not low[end + 1 : end + 2].isalnum():
            return True
    return False


def normal(sentence: str) -> str:
    return " ".join(_SIGNS.sub(" ", sentence.lower()).split())


def name_at(words: list[str], at: int) -> tuple[int, str] | None:
    """How many words from a place on are the longest known name, and its licence; "the" and "license" within are passed over."""
    held, best = [], None
    for k in range(at, min(len(words), at + _LONGEST + 4)):
        if words[k] in ("the", "license", "licence"):
            continue
        held.append(words[k])
        if (licence := _BY_NAME.get(" ".join(held).rstrip(","))) is not None:
            best = k + 1 - at, licence
    return best


def named_licences(sentence: str) -> list[tuple[int, int, str]]:
    """Start, end and licence of the names that a normal form is, or puts something under."""
    whole = " ".join(_EMPTY.sub(" ", sentence).split())
    if whole in _BY_NAME and (whole != "mit" or "licen" in sentence):
        return [(0, len(sentence), _BY_NAME[whole])]
    out = []
    for cue in _CUE.finditer(sentence):
        if cue["no"]:
            continue
        at, words = cue.end(), sentence[cue.end() :].split(" ")
        k = 0
        while k < len(words) and (found := name_at(words, k)):  # several, as in "the MIT and Apache-2.0 licenses"
            n, licence = found
            start = at + len(" ".join(words[:k])) + (k > 0)
            if not cue["weak"] or n > 1 or words[k + n : k + n + 1] in (["license"], ["licence"], ["licenses"], ["licences"]):
                out.append((start, start + len(" ".join(words[k : k + n])), licence))
            k += n
            while k < len(words) and words[k] in ("license", "licence", "licenses", "licences"):
                k += 1
            if k < len(words) and words[k] in ("or", "and", "and/or", "the"):
                k += 1
            else:
                break
    return out


def matches(sentence: str) -> list[tuple[int, int, str, dict[str, str]]]:
    """Start, end, identifier and detail of the known sentences that a normal form holds, in order."""
    found: list[tuple[int, int, str, dict[str, str]]] = []
    for name, word, tail, pattern in _KNOWN:
        if word in sentence:
            end = sentence.rfind(tail) + len(tail) if tail else len(sentence)  # nothing after it is tried in vain
            for m in pattern.finditer(sentence, 0, max(end, 0)):
                if m.end() == len(sentence) or sentence[m.end()] == " " or name == "BsdEndorse":
                    found.append((m.start(), m.end(), name, {k: v for k, v in m.groupdict().items() if v}))
    denied = [m.span() for m in _CUE.finditer(sentence) if m["no"]]
    found = [f for f in found if not (f[2] in ("MitRelease", "ApacheRelease") and any(a <= f[0] < b for a, b in denied))]
    for start, end, licence in named_licences(sentence):
        if not any(a < end and b > start for a, b, _, _ in found):
            found.append((start, end, "Named", {"name": licence}))
    return sorted(found, key=lambda f: f[0])


def identify(sentence: str) -> list[tuple[str, dict[str, str]]]:
    """The known sentences that a normal-form sentence holds, in their order in it."""
    return [(name, detail) for _, _, name, detail in matches(sentence)]


def sentences(text: str) -> list[list[str]]:
    """Sentences, each as the normal forms of its parts between semicolons.

    They may be wrapped over any lines of a block; blocks and sentences without a hint are left out.
    """
    out: list[list[str]] = []
    if not hinted(text):
        return out
    blocks: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        if blocks and _OPEN_END.search(blocks[-1]) and _GOES_ON.match(block):  # an empty line within a sentence
            blocks[-1] += "\n" + block
        else:
            blocks.append(block)
    for block in blocks:
        if not hinted(block):
            continue
        block = _SPDX.sub(lambda m: f" . {m[0]}. ", _VERSION.sub(r"\1 ", block))
        joined = " ".join(x.strip(" \t*#/-") for x in block.split("\n"))
        for s in filter(hinted, re.split(r"\.(?=\s|$)", joined)):
            parts = [p for p in map(normal, re.split(r";(?=\s|$)", s)) if p]
            if parts:
                out.append(parts)
    return out


def apply_rules(ids: list[tuple[str, dict[str, str]]]) -> list[str]:
    """Licences that the ordered rules read from a sequence of identifiers."""
    left, found = list(ids), []
    for licence, sequence in RULES:
        at = 0
        while at < len(left):
            end, detail, ok = at, {}, True
            for step in sequence:
                if end < len(left) and left[end][0] == step.rstrip("?"):
                    detail |= left[end][1]
                    end += 1
                elif not step.endswith("?"):
                    ok = False
                    break
            if ok and end > at:
                found += re.split(r"-(?:AND|OR)-", named(licence, detail)) if licence == "{id}" else [named(licence, detail)]
                del left[at:end]
            else:
                at += 1
    return found


def named(licence: str, detail: dict[str, str]) -> str:
    if licence == "{name}":
        return detail["name"]
    if licence == "{id}":
        return detail["id"].strip().replace(" ", "-").upper()
    if licence == "CC-{v}":
        v = detail["v"].replace("attribution", "by").replace("noncommercial", "nc").replace("sharealike", "sa").replace("noderivatives", "nd")
        return "CC-" + "-".join(v.split()).upper()
    if "{v}" not in licence:
        return licence
    v = detail["v"] if "." in detail["v"] else detail["v"] + ".0"
    return licence.replace("{v}", v) + ("-or-later" if "later" in detail else "-only" if "GPL" in licence else "")


def scan_text(text: str) -> tuple[list[str], list[str], int]:
    """Licences, sentence identifiers in order, and unknown licence-like sentences."""
    ids, unknown = [], 0
    for parts in sentences(text):
        known = matches(" ".join(parts))
        ids += [(name, detail) for _, _, name, detail in known]
        at = 0
        for part in parts:
            end = at + len(part)
            unknown += any(w in part for w in WORDS) and not any(a < end and b > at for a, b, _, _ in known)
            at = end + 1
    return sorted(set(apply_rules(ids))), [i for i, _ in ids], unknown


def scan(docs: DataFrame) -> DataFrame:
    """docs with license_scan: struct of licenses, sentence_ids, n_unknown."""

    @F.pandas_udf("struct<licenses:array<string>,sentence_ids:array<string>,n_unknown:int>")
    def read(texts):
        import pandas as pd

        got = [scan_text(t) if isinstance(t, str) else ([], [], 0) for t in texts]
        return pd.DataFrame({"licenses": [g[0] for g in got], "sentence_ids": [g[1] for g in got], "n_unknown": [g[2] for g in got]})

    ship(docs.sparkSession)
    name = fresh([c for c in docs.columns if c != "license_scan"], "license_scan")
    return docs.withColumn(name, read("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("license_scan")
    return found.select("doc_id", F.array_join(s["licenses"], ",").alias("licenses"), F.array_join(s["sentence_ids"], ",").alias("sentence_ids"), s["n_unknown"].alias("n_unknown"))
