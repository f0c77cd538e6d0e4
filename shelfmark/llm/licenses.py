"""Operator 3: licence scans by sentence-rule recognition.

A text is cut into sentences, each sentence is normalised (lower case, marks to
blanks, blanks joined) and, if it is a known licence sentence, mapped to that
sentence's identifier. The identifiers of a document, in page order, are matched
against ordered rules: each rule is a sequence of identifiers; the first rule
that fits takes its sentences away, the next works on what is left. Sentences
left over are reported as unknown.

Licence texts are mostly hard-wrapped and often inside comments. Comment marks at
line starts are taken off, blank lines part paragraphs, and the lines of a
paragraph are joined before it is cut at stops. A paragraph that so gives no known
sentence, or only one of an unnamed licence, is cut at its line ends too (a
title over a copyright line; a licence line amid lines without stops). The
sentence of an SPDX identifier gives an identifier for each licence and exception of its
expression. A sentence that says what something is licensed under, or that is a
licence's name alone, and is no other known sentence gives one for each licence that it names, whatever
clauses follow; a denied one ("not licensed under") gives none.

Everything is DataFrame functions over one row at a time: no shuffle. Only texts,
and of them paragraphs and sentences, that hold one of the words that every known
sentence has are looked at, a test that drops no match.

Defined results: a null, empty or licence-free text gives licence ``NONE`` and
no identifiers; sentences known but in no rule give ``UNKNOWN``; repeated rows
give repeated results; a licence stated twice is listed once. Extra columns are
ignored. Very long texts are one row's arrays of sentences.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNDER = r"(?:this (?:work|software|project|file|program|library|code|document) is )?(?:dual )?(?:released|licen[cs]ed|distributed|available|provided|published) under (?:the |a |an )?(?:terms of the )?"
_MAY = r"(?:this (?:program|library|file|package|software)(?: \w+)? is free software )?you can redistribute it and or modify it under the terms of the "
#: Known licence sentences after normalisation, as patterns that the whole sentence fits.
SENTENCES = [
    ("MitRelease", _UNDER + r"mit licen[cs]e"),
    ("MitTitle", r"(?:the )?mit licen[cs]e(?: mit)?"),
    ("MitPermission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MitNotice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("AsIs", r"(?:the|this) software is provided as is without warranty of any kind .*"),
    ("IscTitle", r"(?:the )?isc licen[cs]e(?: isc)?"),
    ("IscRelease", _UNDER + r"isc licen[cs]e"),
    ("IscPermission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted .*"),
    ("IscAsIs", r"the software is provided as is and .* disclaims all warranties .*"),
    ("ApacheLicensed", _UNDER + r"apache licen[cs]e version 2 0(?: the licen[cs]e)?"),
    ("ApacheComply", r"you may not use (?:this file|these files|this work) except in compliance with the licen[cs]e"),
    ("ApacheCopy", r"you may obtain a copy of the licen[cs]e at(?: .*)?"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis .*"),
    ("ApacheSee", r"see the licen[cs]e for the specific language governing permissions and limitations(?: under the licen[cs]e)?"),
    ("ApacheTitle", r"apache licen[cs]e(?: version)? 2 0(?: january 2004.*)?"),
    ("AgplFree3Later", _MAY + r"gnu affero general public licen[cs]e .* either version 3 .* any later version"),
    ("AgplWork3", _UNDER + r"gnu affero general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("LgplFree3Later", _MAY + r"gnu (?:lesser|library) general public licen[cs]e .* either version 3 .* any later version"),
    ("LgplFree21Later", _MAY + r"gnu (?:lesser|library) general public licen[cs]e .* either version 2(?: 1)? .* any later version"),
    ("LgplWork3", _UNDER + r"gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("LgplWork21", _UNDER + r"gnu lesser general public licen[cs]e (?:version |v)?2 1"),
    ("GplFree3Later", _MAY + r"gnu general public licen[cs]e .* either version 3 .* any later version"),
    ("GplFree2Later", _MAY + r"gnu general public licen[cs]e .* either version 2 .* any later version"),
    ("GplWork3", _UNDER + r"gnu general public licen[cs]e (?:version |v)?3(?: 0)?"),
    ("GplWork2", _UNDER + r"gnu general public licen[cs]e (?:version |v)?2(?: 0)?"),
    ("GplHope", r"this (?:program|library|file|package|software)(?: \w+)? is distributed in the hope that it will be useful but without any warranty.*"),
    ("GplCopy", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public licen[cs]e .*"),
    ("MplSubject", r"this source code form is subject to the terms of the mozilla public licen[cs]e(?: v(?: 2 0)?| version 2 0)?"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file you can obtain one at(?: .*)?"),
    ("MplRelease", _UNDER + r"mozilla public licen[cs]e(?: version| v)? 2 0"),
    ("MplTitle", r"mozilla public licen[cs]e(?: version)? 2 0"),
    ("Epl2", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v |v|version )2 0.*"),
    ("Epl1", r"(?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v |v|version )1 0.*"),
    ("BoostTitle", r"boost software licen[cs]e version 1 0(?: august 17th 2003)?"),
    ("BoostRelease", _UNDER + r"boost software licen[cs]e version 1 0"),
    ("BoostPermission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation .*"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibPermission", r"permission is granted to anyone to use this software for any purpose including commercial applications .*"),
    ("ZlibRelease", _UNDER + r"zlib(?: libpng)? licen[cs]e"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", r"anyone is free to copy modify publish use compile sell or distribute this software .*"),
    ("Cc0Waived", r"to the extent possible under law .* waived all copyright and related or neighboring rights .*"),
    ("Cc0Release", r"(?:" + _UNDER + r")?(?:the )?(?:cc0|creative commons (?:cc0|zero))(?: (?:licen[cs]e )?(?:version |v)?1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)?"),
    ("PublicDomain", r"(?:this (?:work|software|file|code|document|program) (?:is|has been) )?(?:hereby )?(?:released into|placed in|placed into|dedicated to|in) the public domain"),
    ("Artistic2", _UNDER + r"artistic licen[cs]e(?: version)? 2 0"),
    ("ArtisticTitle2", r"the artistic licen[cs]e 2 0"),
    ("CcByNc4", r"(?:this work is )?licen[cs]ed under (?:a )?(?:the )?(?:cc by nc 4 0|creative commons attribution non ?commercial 4 0 .*)"),
    ("CcBySa4", r"(?:this work is )?licen[cs]ed under (?:a )?(?:the )?(?:cc by sa 4 0|creative commons attribution share ?alike 4 0 .*)"),
    ("CcBy4", r"(?:this work is )?licen[cs]ed under (?:a )?(?:the )?(?:cc by 4 0|creative commons attribution 4 0 .*)"),
    ("BsdTerms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice(?: .*)?"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice(?: .*)?"),
    ("BsdEndorse", r"neither the names? of .* nor the names of .* contributors may be used to endorse .*"),
    ("BsdAsIs", r"this software is provided by .* as is and any express or implied warranties .*"),
    ("Bsd3Title", r"(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[cs]e"),
    ("Bsd2Title", r"(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[cs]e"),
    ("Bsd3Release", _UNDER + r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[cs]e"),
    ("Bsd2Release", _UNDER + r"(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[cs]e"),
    ("BsdRelease", _UNDER + r"bsd(?: style)? licen[cs]e"),
    ("AllRights", r"all rights reserved"),
    ("Other", r".*\b(?:licen[cs]ed|released) under (?:the |a |an )?.*licen[cs]e.*"),
]
#: Identifiers of SPDX expressions; of GNU licences the plain ones, "-only" and "-or-later" follow.
PLAIN = (
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 "
    "EUPL-1.1 EUPL-1.2 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
GNU = "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
EXCEPTIONS = "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 Linux-syscall-note LLVM-exception OpenJDK-assembly-exception-1.0".split()
CC_KINDS, CC_VERSIONS = "BY BY-SA BY-NC BY-ND BY-NC-SA BY-NC-ND".split(), "1.0 2.0 2.5 3.0 4.0".split()
#: How sentences name licences, once GNU and Creative Commons names are in their short form.
NAMED = [
    ("MIT", r"\b(?:mit|expat)(?: x11)?(?: style)? licen[cs]es?\b|\b(?:under|or|and|either|licen[cs]e) (?:the )?mit\b"),
    ("ISC", r"\bisc licen[cs]es?\b|\b(?:under|or|and|either|licen[cs]e) (?:the )?isc\b"),
    ("Zlib", r"\bzlib(?: libpng)? licen[cs]es?\b|\b(?:under|or|and|either|licen[cs]e) (?:the )?zlib\b"),
    ("Apache-2.0", r"\bapache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?\b"),
    ("Apache-1.1", r"\bapache(?: software)?(?: licen[cs]e)?(?: version| v)? ?1 1\b"),
    ("MPL-2.0", r"\b(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?2(?: 0)?\b"),
    ("MPL-1.1", r"\b(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?1 1\b"),
    ("EPL-2.0", r"\b(?:epl|eclipse public licen[cs]e)(?: version| v)? ?2(?: 0)?\b"),
    ("EPL-1.0", r"\b(?:epl|eclipse public licen[cs]e)(?: version| v)? ?1(?: 0)?\b"),
    ("BSL-1.0", r"\bboost software licen[cs]e\b"),
    ("Artistic-2.0", r"\bartistic licen[cs]e(?: version| v)? ?2(?: 0)?\b"),
    ("BSD-3-Clause", r"\b(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|bsd new)\b"),
    ("BSD-2-Clause", r"\b(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) ?"),
    ("Unlicense", r"\bunlicense\b"),
    ("CC0-1.0", r"\bcc0\b|\bcc zero\b"),
    ("WTFPL", r"\bwtfpl\b|\bdo what the fuck you want to public licen[cs]e\b"),
    *[(f"{n[:-4]}-{v}{end}", rf"\b{n[:-4].lower()}{word} {v[0]}{r'(?: 0)?' if v[2] == '0' else f' {v[2]}'}\b") for n in GNU if n != "LGPL-2.0" for v in (n[-3:],) for end, word in (("", ""), ("-or-later", "plus"))],
]
#: Rewriting to those short forms, in order: pattern, and what stands for it (groups as {1}, {2}).
SHORT = [
    (r"(?:gnu )?affero (?:gnu )?general public licen[cs]e", "agpl"),
    (r"(?:gnu )?(?:lesser|library) (?:gnu )?general public licen[cs]e", "lgpl"),
    (r"(?:gnu )?general public licen[cs]e", "gpl"),
    (r"\b([al]?gpl)(?: licen[cs]e)?(?: version| v)? ?v?([0-9])\b", "{1} {2}"),
    (r"\b([al]?gpl) ([0-9](?: [0-9])?)(?: licen[cs]e)?(?: and)? or (?:at your option )?(?:any )?(?:later|newer|greater)\b", "{1}plus {2}"),
    (r"\bcreative commons\b", "cc"), (r"\battribution\b", "by"), (r"\bnon ?commercial\b", "nc"), (r"\bshare ?alike\b", "sa"), (r"\bno ?deriv(?:ative)?s?(?: works)?\b", "nd"),
    (r"\b(by|sa|nc|nd) (?:international |unported |generic )?(?:licen[cs]e )?(?:version |v ?)?([1-4])\b", "{1} {2}"),
]
CC_NAME = r"\bcc (by(?: nc)?(?: sa| nd)?) ([1-4] [05])\b"
#: A sentence that says what something is licensed under, one that is little but a name, and a denial.
SAYS = r"\b(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed|usable|offered)(?: \w+){0,3} (?:under|by)\b|^(?:project |code |software )?licen[cs]es? (?:type |is |are )?(?:the )?\w+(?: \w+){0,6}$"
TITLE = r"^(?:the )?(?:wtfpl|do what the fuck you want to public licen[cs]e|(?:gnu )?[al]?gpl(?:plus)? [0-9](?: [0-9])?|cc by(?: nc)?(?: sa| nd)? [1-4] [05]|unlicense|mit x11 licen[cs]e)(?: licen[cs]e| international| unported| universal| version [0-9].*)*$"
DENIES = r"\b(?:not|never|neither|no longer) (?:\w+ ){0,2}(?:licen[cs]ed|released|distributed|available|provided|published|covered|governed|usable|offered)\b"
#: Rules in order; a sequence of identifiers that stand next to one another.
RULES = [
    ("MIT", ("MitTitle", "MitPermission", "MitNotice", "AsIs")),
    ("MIT", ("MitPermission", "MitNotice", "AsIs")),
    ("MIT", ("MitPermission", "MitNotice")),
    ("ISC", ("IscTitle", "IscPermission", "IscAsIs")),
    ("ISC", ("IscPermission", "IscAsIs")),
    ("ISC", ("IscPermission",)),
    ("BSD-3-Clause", ("Bsd3Title", "BsdTerms", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdTerms", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdTerms", "BsdSource", "BsdBinary", "BsdEndorse", "AsIs")),
    ("BSD-3-Clause", ("BsdTerms", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("Bsd2Title", "BsdTerms", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdTerms", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdTerms", "BsdSource", "BsdBinary", "AsIs")),
    ("BSD-2-Clause", ("BsdTerms", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("ApacheLicensed", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheLicensed", "ApacheComply", "ApacheCopy")),
    ("Apache-2.0", ("ApacheLicensed",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("AGPL-3.0-or-later", ("AgplFree3Later", "GplHope", "GplCopy")),
    ("AGPL-3.0-or-later", ("AgplFree3Later",)),
    ("LGPL-3.0-or-later", ("LgplFree3Later", "GplHope", "GplCopy")),
    ("LGPL-3.0-or-later", ("LgplFree3Later",)),
    ("LGPL-2.1-or-later", ("LgplFree21Later", "GplHope", "GplCopy")),
    ("LGPL-2.1-or-later", ("LgplFree21Later",)),
    ("GPL-3.0-or-later", ("GplFree3Later", "GplHope", "GplCopy")),
    ("GPL-3.0-or-later", ("GplFree3Later", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree3Later",)),
    ("GPL-2.0-or-later", ("GplFree2Later", "GplHope", "GplCopy")),
    ("GPL-2.0-or-later", ("GplFree2Later", "GplHope")),
    ("GPL-2.0-or-later", ("GplFree2Later",)),
    ("AGPL-3.0", ("AgplWork3",)),
    ("LGPL-3.0", ("LgplWork3",)),
    ("LGPL-2.1", ("LgplWork21",)),
    ("GPL-3.0", ("GplWork3",)),
    ("GPL-2.0", ("GplWork2",)),
    ("MPL-2.0", ("MplSubject", "MplCopy")),
    ("MPL-2.0", ("MplSubject",)),
    ("MPL-2.0", ("MplRelease",)),
    ("MPL-2.0", ("MplTitle",)),
    ("EPL-2.0", ("Epl2",)),
    ("EPL-1.0", ("Epl1",)),
    ("BSL-1.0", ("BoostTitle", "BoostPermission")),
    ("BSL-1.0", ("BoostPermission",)),
    ("BSL-1.0", ("BoostRelease",)),
    ("BSL-1.0", ("BoostTitle",)),
    ("Zlib", ("ZlibAsIs", "ZlibPermission")),
    ("Zlib", ("ZlibPermission",)),
    ("Zlib", ("ZlibRelease",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("Unlicense", ("UnlicenseFree",)),
    ("CC0-1.0", ("Cc0Waived",)),
    ("CC0-1.0", ("Cc0Release",)),
    ("Artistic-2.0", ("Artistic2",)),
    ("Artistic-2.0", ("ArtisticTitle2",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("BSD-3-Clause", ("Bsd3Release",)),
    ("BSD-2-Clause", ("Bsd2Release",)),
    ("BSD", ("BsdRelease",)),
    ("MIT", ("MitRelease",)),
    ("MIT", ("MitTitle",)),
    ("ISC", ("IscRelease",)),
    ("Public-Domain", ("PublicDomain",)),
]
#: Every known sentence holds one of these.
HINT = r"licen|gpl|wtf|cc[ -]by|permission|redistribut|warrant|nor the names|rights reserved|public domain|unencumbered|cc0|creative commons|anyone is free|neighboring rights|except in compliance|copy of the mpl"
#: Marks of comments at the start of a line, and what ends a paragraph, a sentence, a line's sentence.
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|dnl\b|rem\b)[ \t]*"
PARAGRAPH = r"\r?\n[ \t]*\r?\n\s*"
STOP = r"[.!?;]+\s+|:[ \t]*[\r\n]+"
LINE = r"[\n\r]+|[.!?;]+[ \t]+"
#: A stop inside the statement of a version is none.
VERSION = r";\s+either\s"
SPDX_START = "spdx license identifier"


#: Identifiers of single licences: one that an expression or a sentence names is a rule of its own.
SPDX_IS, NAMED_IS = "Spdx", "Named"
SINGLE = r"<(?:Spdx|Named)([^<>]+)>"
#: A version with a plus says "or later".
PLUS = r"([0-9])\+"


def spdx_keys() -> dict[str, str]:
    """Licence or exception by its normalised identifier; a key "... plus" stands for "or later"."""
    out = {n: n for n in [*PLAIN, *EXCEPTIONS, *(f"CC-{k}-{v}" for k in CC_KINDS for v in CC_VERSIONS)]}
    out |= {f"{n}{end}": f"{n}{'-or-later' if end == ' plus' else ''}" for n in GNU for end in ("", "-only", " plus")}
    return {re.sub(r"[^a-z0-9]+", " ", key.lower()): name for key, name in out.items()}


def _spdx_key(words: str = " ") -> str:
    """Pattern of an expression's part: a known identifier, longer ones first, and what follows it."""
    return rf"^({'|'.join(sorted(spdx_keys(), key=lambda k: (-len(k), k)))})(?:{words}.*)?$"


#: What parts an expression, after "or later" has become "plus".
OPERATOR = " (?:or|and|with) "
LATER = r"\b([0-9]) or later\b"


def _any(pairs: list[tuple[str, str]]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for _, p in pairs) + ")$"


def _known(sentence: Column) -> Column:
    """Identifiers of a normalised sentence, joined by blanks: one, or those of all licences that it names; else null."""
    # The patterns are a literal array that is walked, not an expression each: the plan stays small. One pattern
    # of all of them comes first, so few sentences are walked.
    table = lambda pairs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in pairs])
    fits = lambda s, pairs: F.transform(F.filter(table(pairs), lambda p: F.rlike(s, p["pattern"])), lambda p: p["name"])
    exact, other = SENTENCES[:-1], SENTENCES[-1]
    one = F.when(sentence.rlike(_any(exact)), F.get(fits(sentence, [(n, f"^(?:{p})$") for n, p in exact]), 0))
    # An SPDX expression.
    parts = F.split(F.trim(F.regexp_replace(F.substring(sentence, len(SPDX_START) + 1, 1 << 30), LATER, "$1 plus")), OPERATOR)
    keys = F.map_from_arrays(F.array(*map(F.lit, spdx_keys())), F.array(*map(F.lit, spdx_keys().values())))
    found = F.filter(F.transform(parts, lambda p: F.try_element_at(keys, F.regexp_extract(p, _spdx_key(), 1))), lambda n: n.isNotNull())
    spdx = F.array_join(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit(SPDX_IS), n))), " ")
    # Names in a sentence that says what something is licensed under.
    short = sentence
    for pattern, to in SHORT:
        short = F.regexp_replace(short, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    says = F.lit("|".join(f"(?:{p})" for _, p in NAMED) + f"|{CC_NAME}")

    def names(short: Column) -> Column:
        of_cc = F.transform(F.regexp_extract_all(short, F.lit(CC_NAME), 0), lambda x: F.regexp_replace(F.regexp_replace(F.upper(x), " ([0-9]) ([0-9])$", "-$1.$2"), " ", "-"))
        return F.array_join(F.array_distinct(F.transform(F.concat(fits(short, NAMED), of_cc), lambda n: F.concat(F.lit(NAMED_IS), n))), " ")

    told = (sentence.rlike(SAYS) & ~sentence.rlike(DENIES)) | short.rlike(TITLE)
    named = F.when(told & F.rlike(short, says), names(short))
    rest = F.when(sentence.rlike(f"^(?:{other[1]})$") & ~sentence.rlike(DENIES), F.lit(other[0]))
    return F.when(sentence.startswith(SPDX_START), F.when(spdx == "", F.lit("OtherSpdx")).otherwise(spdx)).otherwise(F.coalesce(one, named, rest))


def _ids(text: Column, cut: str) -> Column:
    sentences = F.filter(F.split(text, cut), lambda s: s.rlike(HINT))
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, PLUS, "$1 or later "), r"[^\p{L}\p{N}]+", " ")))
    return F.filter(F.transform(plain, _known), lambda s: s.isNotNull())


def identifiers(text: Column) -> Column:
    """Known sentences of a text, in order, as an array of identifiers."""
    paragraphs = F.filter(F.split(F.regexp_replace(F.lower(text), MARK, ""), PARAGRAPH), lambda p: p.rlike(HINT))

    def choose(both: Column) -> Column:
        named = F.exists(both["joined"], lambda x: x != "Other")
        return F.when(named | (F.size(both["lines"]) == 0), both["joined"]).otherwise(both["lines"])

    each = F.transform(paragraphs, lambda p: F.struct(_ids(F.concat(F.regexp_replace(p, VERSION, " either "), F.lit(" ")), STOP).alias("joined"), _ids(p, LINE).alias("lines")))
    found = F.split(F.array_join(F.flatten(F.transform(each, choose)), " "), " ")
    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike(HINT), F.filter(found, lambda x: x != "")).otherwise(none)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: sentence identifiers, and licences by the ordered rules, each joined by blanks.

    Columns: doc_id, sentence_ids, licenses (``NONE`` without identifiers), unknown_sentences.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(identifiers(F.col(text)), F.array().cast("array<string>")).alias("_ids"))
    # Identifiers as a string of " id " marks: rules are looked up and cut out as plain text.
    left = F.concat_ws("", F.transform("_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))))
    ids = ids.select("doc_id", F.concat_ws(" ", "_ids").alias("sentence_ids"), F.size("_ids").alias("_n"), left.alias("_left"))
    hits = []
    for i, (_, sequence) in enumerate(RULES):
        mark = "".join(f"<{s}>" for s in sequence)
        ids = ids.withColumn(f"_h{i}", F.contains(F.col("_left"), F.lit(mark))).withColumn("_left", F.replace(F.col("_left"), F.lit(mark), F.lit("|")))
        hits.append(F.col(f"_h{i}"))
    listed = []
    for name in dict.fromkeys(name for name, _ in RULES):
        fits = [h for h, (other, _) in zip(hits, RULES, strict=True) if other == name]
        listed.append(F.when(reduce(Column.__or__, fits), F.lit(name)))
    # What is left of single licences names them itself; each is listed once.
    single = F.regexp_extract_all("_left", F.lit(SINGLE), 1)
    by_rule = F.array_compact(F.array(*listed))
    names = F.array_join(F.concat(by_rule, F.array_except(single, by_rule)), " ")
    unknown = F.regexp_count(F.regexp_replace("_left", SINGLE, "|"), F.lit("<"))
    shown = F.when(F.col("_n") == 0, F.lit("NONE")).when(names == "", F.lit("UNKNOWN")).otherwise(names)
    return ids.select("doc_id", "sentence_ids", shown.alias("licenses"), unknown.cast("int").alias("unknown_sentences"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    exact, other = SENTENCES[:-1], SENTENCES[-1]
    one = " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{n}'" for n, p in exact)
    keys = ", ".join(f"'{k}': '{SPDX_IS}{n}'" for k, n in spdx_keys().items())
    parts = f"regexp_split_to_array(trim(regexp_replace(substr(x, {len(SPDX_START) + 1}), '{LATER}', '\\1 plus', 'g')), '{OPERATOR}')"
    spdx = f"list_transform({parts}, lambda p: MAP {{{keys}}}[regexp_extract(p, '{_spdx_key()}', 1)])"
    short = "x"
    for pattern, to in SHORT:
        short = f"regexp_replace({short}, '{pattern}', '{to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    cc = f"list_transform(regexp_extract_all(y, '{CC_NAME}'), lambda n: '{NAMED_IS}' || replace(regexp_replace(upper(n), ' ([0-9]) ([0-9])$', '-\\1.\\2'), ' ', '-'))"
    named = f"list_concat([{', '.join(f"CASE WHEN regexp_matches(y, '{p}') THEN '{NAMED_IS}{n}' END" for n, p in NAMED)}], {cc})"
    once = lambda names: f"list_reduce({names}, lambda a, b: CASE WHEN b IS NULL OR list_contains(string_split(a, ' '), b) THEN a WHEN a = '' THEN b ELSE a || ' ' || b END, '')"
    told = f"((regexp_matches(x, '{SAYS}') AND NOT regexp_matches(x, '{DENIES}')) OR regexp_matches(y, '{TITLE}'))"
    known = f"""CASE WHEN starts_with(x, '{SPDX_START}') THEN coalesce(nullif({once(spdx)}, ''), 'OtherSpdx')
      ELSE coalesce(CASE {one} END, CASE WHEN {told} THEN nullif({once(named)}, '') END, CASE WHEN regexp_full_match(x, '{other[1]}') AND NOT regexp_matches(x, '{DENIES}') THEN '{other[0]}' END) END"""
    steps, before = [], "l0"
    for i, (_, sequence) in enumerate(RULES):
        mark = "".join(f"<{s}>" for s in sequence)
        steps.append(f"l{i + 1} AS (SELECT *, contains(lft{i}, '{mark}') AS h{i}, replace(lft{i}, '{mark}', '|') AS lft{i + 1} FROM {before})")
        before = f"l{i + 1}"
    listed = []
    for name in dict.fromkeys(name for name, _ in RULES):
        fits = " OR ".join(f"h{i}" for i, (other, _) in enumerate(RULES) if other == name)
        listed.append(f"CASE WHEN {fits} THEN '{name}' END")
    return f"""
WITH p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (
  SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '{MARK}', '', 'g'), '{PARAGRAPH}') AS ps FROM documents WHERE regexp_matches(lower(text), '{HINT}'))),
c AS (SELECT doc_id, pos, 1 AS way, regexp_split_to_array(regexp_replace(p, '{VERSION}', ' either ', 'g') || ' ', '{STOP}') AS ss FROM p WHERE regexp_matches(p, '{HINT}')
  UNION ALL SELECT doc_id, pos, 2, regexp_split_to_array(p, '{LINE}') FROM p WHERE regexp_matches(p, '{HINT}')),
s AS (SELECT doc_id, pos, way, unnest(ss) AS raw, generate_subscripts(ss, 1) AS spot FROM c),
x AS (SELECT doc_id, pos, way, spot, trim(regexp_replace(regexp_replace(raw, '{PLUS}', '\\1 or later ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS x FROM s WHERE regexp_matches(raw, '{HINT}')),
k AS (SELECT doc_id, pos, way, spot, {known} AS id FROM (SELECT *, {short} AS y FROM x)),
w AS (SELECT doc_id, pos, way, string_agg(id, ' ' ORDER BY spot) AS ids, bool_or(id <> 'Other') AS named FROM k WHERE id IS NOT NULL GROUP BY ALL),
v AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.pos, b.pos) AS pos, CASE WHEN a.named OR b.ids IS NULL THEN a.ids ELSE b.ids END AS ids
      FROM (SELECT * FROM w WHERE way = 1) a FULL JOIN (SELECT * FROM w WHERE way = 2) b ON a.doc_id = b.doc_id AND a.pos = b.pos),
g AS (SELECT doc_id, string_agg(ids, ' ' ORDER BY pos) AS ids FROM v GROUP BY doc_id),
l0 AS (SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, CASE WHEN ids IS NULL THEN '' ELSE '<' || replace(ids, ' ', '><') || '>' END AS lft0 FROM documents d LEFT JOIN g USING (doc_id)),
{", ".join(steps)},
n AS (SELECT *, list_filter([{", ".join(listed)}], lambda n: n IS NOT NULL) AS by_rule, regexp_extract_all(lft{len(RULES)}, '{SINGLE}', 1) AS single FROM {before}),
r AS (SELECT *, regexp_replace(lft{len(RULES)}, '{SINGLE}', '|', 'g') AS rest, {once('list_concat(by_rule, single)')} AS found FROM n)
SELECT doc_id, sentence_ids,
  CASE WHEN sentence_ids = '' THEN 'NONE' WHEN found = '' THEN 'UNKNOWN' ELSE found END AS licenses,
  (len(rest) - len(replace(rest, '<', '')))::INTEGER AS unknown_sentences FROM r
""".strip()
