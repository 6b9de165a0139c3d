"""Licence signatures: sentences of licence texts, and one line for each licence, from which the ordered rules are made.

A sentence is a rule of its own: a label, a word that it contains, and a pattern. A line names the licence's label, a word that any of its signatures contains, a pattern of its name in running text, its
short identifier, and an address under which it is published. Patterns are written for lower-case text and keep to what
every regular-expression engine reads alike.
"""

from __future__ import annotations

from dataclasses import dataclass

#: label | keyword | name pattern | identifier pattern | address pattern
_LICENSES = r"""
mit|mit|(?:the )?mit licen[cs]e|mit|opensource\.org/licenses/mit
mit-0|no attribution|mit no attribution(?: licen[cs]e)?|mit-0|opensource\.org/licenses/mit-0
apache-1|apache|apache (?:software )?licen[cs]e,? (?:version |v)?1\.0|apache-1\.0|apache\.org/licenses/license-1\.0
apache-1.1|apache|apache (?:software )?licen[cs]e,? (?:version |v)?1\.1|apache-1\.1|apache\.org/licenses/license-1\.1
apache-2|apache|apache (?:software )?licen[cs]e,? (?:version |v)?2(?:\.0)?|apache-2\.0|apache\.org/licenses/license-2\.0
bsd-2-clause|bsd|(?:2-clause|two-clause|simplified|freebsd) bsd licen[cs]e|bsd-2-clause|opensource\.org/licenses/bsd-2-clause
bsd-3-clause|bsd|(?:3-clause|three-clause|new|revised|modified) bsd licen[cs]e|bsd-3-clause|opensource\.org/licenses/bsd-3-clause
bsd-4-clause|bsd|(?:4-clause|four-clause|original|old) bsd licen[cs]e|bsd-4-clause|spdx\.org/licenses/bsd-4-clause
0bsd|bsd|(?:zero-clause|0-clause|free public) bsd licen[cs]e|0bsd|opensource\.org/licenses/0bsd
gpl-1|gnu|gnu general public licen[cs]e,? (?:version |v)1(?:\.0)?|gpl-1\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/old-licenses/gpl-1\.0
gpl-2|gnu|gnu general public licen[cs]e,? (?:version |v)2(?:\.0)?|gpl-2\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/old-licenses/gpl-2\.0
gpl-3|gnu|gnu general public licen[cs]e,? (?:version |v)3(?:\.0)?|gpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/gpl-3\.0
lgpl-2|gnu|gnu (?:library|lesser) general public licen[cs]e,? (?:version |v)2(?:\.0)?|lgpl-2\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/old-licenses/lgpl-2\.0
lgpl-2.1|gnu|gnu lesser general public licen[cs]e,? (?:version |v)2\.1|lgpl-2\.1(?:-only|-or-later|\+)?|gnu\.org/licenses/old-licenses/lgpl-2\.1
lgpl-3|gnu|gnu lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?|lgpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/lgpl-3\.0
agpl-3|gnu|gnu affero general public licen[cs]e,? (?:version |v)3(?:\.0)?|agpl-3\.0(?:-only|-or-later|\+)?|gnu\.org/licenses/agpl-3\.0
gfdl-1.3|gnu|gnu free documentation licen[cs]e(?:,? (?:version |v)1\.[0-3])?|gfdl-1\.[0-3](?:-only|-or-later)?|gnu\.org/licenses/fdl
mpl-1.1|mozilla|mozilla public licen[cs]e,? (?:version |v)?1\.[01]|mpl-1\.[01]|mozilla\.org/mpl/1\.1
mpl-2|mozilla|mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?|mpl-2\.0|mozilla\.org/mpl/2\.0
epl-1|eclipse|eclipse public licen[cs]e(?: - |,? )(?:version |v)?1(?:\.0)?|epl-1\.0|eclipse\.org/legal/epl-v10
epl-2|eclipse|eclipse public licen[cs]e(?: - |,? )(?:version |v)?2(?:\.0)?|epl-2\.0|eclipse\.org/legal/epl-2\.0
cddl-1|development and distribution|common development and distribution licen[cs]e,? (?:version |v)?1\.[01]|cddl-1\.[01]|opensource\.org/licenses/cddl-1\.0
cpl-1|common public|common public licen[cs]e,? (?:version |v)?1(?:\.0)?|cpl-1\.0|opensource\.org/licenses/cpl1\.0
isc|isc|(?:the )?isc licen[cs]e|isc|opensource\.org/licenses/isc
zlib|zlib|(?:the )?zlib(?:/libpng)? licen[cs]e|zlib|zlib\.net/zlib_license
libpng|libpng|(?:the )?libpng licen[cs]e|libpng(?:-2\.0)?|libpng\.org/pub/png/src/libpng-license
boost-1|boost|boost software licen[cs]e(?:(?: - |,? )(?:version |v)?1\.0)?|bsl-1\.0|boost\.org/license_1_0
artistic-1|artistic|(?:the )?artistic licen[cs]e,? (?:version |v)?1\.0|artistic-1\.0|opensource\.org/licenses/artistic-license-1\.0
artistic-2|artistic|(?:the )?artistic licen[cs]e,? (?:version |v)?2\.0|artistic-2\.0|opensource\.org/licenses/artistic-license-2\.0
unlicense|unlicense|(?:the )?unlicense|unlicense|unlicense\.org
wtfpl|what the fuck|do what the fuck you want to public licen[cs]e|wtfpl|wtfpl\.net
cc0-1|cc0|(?:creative commons )?cc0(?: 1\.0)?(?: universal)?|cc0-1\.0|creativecommons\.org/publicdomain/zero/1\.0
cc-by|cc|(?:cc[ -]by|creative commons attribution)(?:[ -][1-4]\.0)|cc-by-[1-4]\.0|creativecommons\.org/licenses/by/[1-4]
cc-by-sa|cc|(?:cc[ -]by[ -]sa|creative commons attribution[ -]share-?alike)(?:[ -][1-4]\.0)?|cc-by-sa-[1-4]\.0|creativecommons\.org/licenses/by-sa
cc-by-nd|cc|(?:cc[ -]by[ -]nd|creative commons attribution[ -]no-?deriv(?:ative)?s)(?:[ -][1-4]\.0)?|cc-by-nd-[1-4]\.0|creativecommons\.org/licenses/by-nd
cc-by-nc|cc|(?:cc[ -]by[ -]nc|creative commons attribution[ -]non-?commercial)(?:[ -][1-4]\.0)?|cc-by-nc-[1-4]\.0|creativecommons\.org/licenses/by-nc/
cc-by-nc-sa|cc|(?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]non-?commercial[ -]share-?alike)(?:[ -][1-4]\.0)?|cc-by-nc-sa-[1-4]\.0|creativecommons\.org/licenses/by-nc-sa
cc-by-nc-nd|cc|(?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s)(?:[ -][1-4]\.0)?|cc-by-nc-nd-[1-4]\.0|creativecommons\.org/licenses/by-nc-nd
pddl-1|dedication|public domain dedication and licen[cs]e|pddl-1\.0|opendatacommons\.org/licenses/pddl
odbl-1|open database|open (?:data commons open )?database licen[cs]e|odbl-1\.0|opendatacommons\.org/licenses/odbl
odc-by-1|open data commons|open data commons attribution licen[cs]e|odc-by-1\.0|opendatacommons\.org/licenses/by
python-2|licen|(?:python software foundation|psf) licen[cs]e(?:,? (?:version |v)?2)?|(?:python|psf)-2\.0|docs\.python\.org/3/license
php-3|php|php licen[cs]e,? (?:version |v)?3\.0[01]?|php-3\.0[01]?|php\.net/license/3_0
ruby|ruby|(?:the )?ruby licen[cs]e|ruby|ruby-lang\.org/[a-z]+/about/license
perl|perl|same terms as perl itself|artistic-1\.0-perl|dev\.perl\.org/licenses
ofl-1.1|open font|(?:sil )?open font licen[cs]e(?:,? (?:version |v)?1\.[01])?|ofl-1\.[01]|scripts\.sil\.org/ofl
ms-pl|microsoft|microsoft public licen[cs]e|ms-pl|opensource\.org/licenses/ms-pl
ms-rl|microsoft|microsoft reciprocal licen[cs]e|ms-rl|opensource\.org/licenses/ms-rl
eupl-1.2|european|european union public licen[cs]e(?:,? (?:version |v)?1\.[12])?|eupl-1\.[12]|joinup\.ec\.europa\.eu/collection/eupl
osl-3|open software|open software licen[cs]e,? (?:version |v)?3\.0|osl-3\.0|opensource\.org/licenses/osl-3\.0
afl-3|academic free|academic free licen[cs]e,? (?:version |v)?3\.0|afl-3\.0|opensource\.org/licenses/afl-3\.0
cecill-2|cecill|cecill(?: free software)? licen[cs]e|cecill-2\.[01]|cecill\.info/licences
qpl-1|q public|q public licen[cs]e|qpl-1\.0|opensource\.org/licenses/qpl-1\.0
ncsa|ncsa|(?:university of illinois/)?ncsa open source licen[cs]e|ncsa|opensource\.org/licenses/ncsa
postgresql|postgresql|postgresql licen[cs]e|postgresql|postgresql\.org/about/licence
openssl|openssl|openssl licen[cs]e|openssl|openssl\.org/source/license
vim|vim|vim licen[cs]e|vim|vimhelp\.org/uganda
unicode|unicode|unicode(?:, inc\.)? licen[cs]e agreement|unicode-dfs-20[0-9][0-9]|unicode\.org/copyright
w3c|w3c|w3c software (?:notice and )?licen[cs]e|w3c|w3\.org/consortium/legal
x11|x11|(?:the )?x11 licen[cs]e|x11|x\.org/releases/current/doc/xorg-docs/license
sspl-1|server side|server side public licen[cs]e|sspl-1\.0|mongodb\.com/licensing/server-side-public-license
elastic-2|elastic|elastic licen[cs]e(?:,? (?:version |v)?2(?:\.0)?)?|elastic-2\.0|elastic\.co/licensing/elastic-license
busl-1.1|business source|business source licen[cs]e(?:,? (?:version |v)?1\.1)?|busl-1\.1|mariadb\.com/bsl11
openrail|rail|(?:creativeml |bigscience )?open ?rail(?:-m| licen[cs]e)|openrail|bigscience\.huggingface\.co/blog/the-bigscience-rail-license
"""

#: label | keyword | pattern of a sentence of the licence's own text; a blank stands for any white space
_TEXTS = r"""
mit|hereby granted|permission is hereby granted,? free of charge,? to any person obtaining a copy of this software
mit|without restriction|to deal in the software without restriction,? including without limitation the rights
ncsa|without restriction|to deal with the software without restriction,? including without limitation the rights
boost-1|hereby granted|permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation
bsd|redistribution|redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-2-clause|redistributions|redistributions of source code must retain the above copyright notice,? this list of conditions
bsd-3-clause|endorse|neither the name of [^.]{1,80} nor the names of its contributors may be used to endorse or promote
bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software must display
isc|hereby granted|permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
hpnd|hereby granted|permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql|hereby granted|permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose,? without fee,? and without a written agreement is hereby granted
w3c|hereby granted|permission to copy,? modify,? and distribute this (?:work|software and its documentation),? with or without modification,? for any purpose and without fee or royalty is hereby granted
x11|advertising|except as contained in this notice,? the (?:name|names) of [^.]{1,80} shall not be used in advertising or otherwise to promote the sale
apache-2|except in compliance|you may not use this file except in compliance with the license
apache-2|applicable law|unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an
apache-1.1|apache software foundation|this product includes software developed by the apache software foundation
gpl|free software|this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license
gpl-2|any later version|either version 2 of the license,? or \(at your option\) any later version
gpl-3|any later version|either version 3 of the license,? or \(at your option\) any later version
gpl|general public license|you should have received a copy of the gnu general public license along with
gpl|license document|everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed
lgpl|free software|this library is free software[:;] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl|general public license|you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl-3|affero|under the terms of the gnu affero general public license as published by the free software foundation
gfdl-1.3|free documentation|permission is granted to copy,? distribute and/or modify this document under the terms of the gnu free documentation license
mpl-1.1|mozilla|the contents of this file are subject to the mozilla public license version 1\.1
mpl-2|mozilla|this source code form is subject to the terms of the mozilla public license,? v\. 2\.0
epl-1|eclipse|are made available under the terms of the eclipse public license v1\.0
epl-2|eclipse|are made available under the terms of the eclipse public license(?: v\.?)? 2\.0
cddl-1|development and distribution|the contents of this file are subject to the terms of the common development and distribution license
zlib|held liable|in no event will the authors be held liable for any damages arising from the use of this software
zlib|plainly marked|altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software
unlicense|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|license document|copies of this license document,? and changing it is allowed as long as the name is changed
cc0-1|neighboring rights|waived all copyright and related or neighboring rights
public-domain|public domain|copyright holder of this work,? (?:hereby )?release (?:it|this work) into the public domain
artistic-1|package may be copied|the intent of this document is to state the conditions under which a package may be copied
perl|terms as perl|you can redistribute it and/or modify it under the same terms as perl itself
python-2|python software foundation|this license agreement is between the python software foundation
php-3|php software|this product includes php software,? freely available from
openssl|openssl project|this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1|font software|this font software is licensed under the sil open font license
ofl-1.1|embedded|can be bundled,? embedded,? redistributed and/or sold with any software
ms-pl|accompanying software|this license governs use of the accompanying software\. if you use the software,? you accept this license
eupl-1.2|eupl|licensed under the eupl(?:,| version| v|\b)
odbl-1|open database|this [^.]{1,40} is made available under the open database license
pddl-1|dedication|is made available under the public domain dedication and license
sspl-1|as a service|if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1|non-production|the right to copy,? modify,? create derivative works,? redistribute,? and make non-production use of the licensed work
elastic-2|managed service|you may not provide the software to third parties as a hosted or managed service
cecill-2|cecill|governed by the cecill(?:-[bc])? license under french law
vim|copies of vim|there are no restrictions on distributing unmodified copies of vim
beerware|retain this notice|as long as you retain this notice you can do whatever you want with this stuff
"""

#: How a line's parts become rules: kind, priority, confidence, pattern.
_FORMS = (
    ("identifier", 4, 0.99, r"spdx-license-identifier:[ \t]*{identifier}"),
    ("grant", 3, 0.95, r"(?:licensed|released|distributed|published|available|made available) under (?:the )?(?:terms of )?(?:the )?{name}"),
    ("address", 2, 0.9, r"(?:https?://)?(?:www\.)?{address}"),
    ("name", 1, 0.6, r"{name}"),
)
#: Where none of these occurs, no rule can match.
GATES = (
    "licen", "spdx", "cc by", "cc-by", "cc0", "creative", "public domain", "terms as perl", ".org/", ".net/", ".com/", ".co/", ".eu/", ".info/", "rail", "wtfpl", "no attribution",
    "hereby granted", "without restriction", "redistribution", "endorse", "advertising", "except in compliance", "applicable law", "software foundation", "free software", "any later version",
    "affero", "free documentation", "held liable", "plainly marked", "unencumbered", "neighboring rights", "package may be copied", "php software", "openssl project", "embedded",
    "eupl", "as a service", "non-production", "managed service", "copies of vim", "retain this notice")


_SPACE = r"[ \t\r\n]+"


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    kind: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


def _keyword(kind: str, word: str, address: str) -> str:
    if kind == "identifier":
        return "spdx"
    if kind == "address":
        return address.split("\\")[0].split("/")[0]
    return "c" if word == "cc" else word


def rules() -> list[Rule]:
    """All rules in order; a smaller number goes first among equals."""
    lines = [line.split("|", 2) for line in _LICENSES.strip().splitlines()]
    out: list[Rule] = []
    for label, word, text in (line.split("|", 2) for line in _TEXTS.strip().splitlines()):
        out.append(Rule(len(out), label, "text", 5, 0.97, word, text.replace(" ", _SPACE)))
    for kind, priority, confidence, form in _FORMS:
        for label, word, rest in lines:
            name, identifier, address = _parts(rest)
            pattern = form.format(name=name, identifier=identifier, address=address)
            out.append(Rule(len(out), label, kind, priority, confidence, _keyword(kind, word, address), pattern))
    return out


def _parts(rest: str) -> list[str]:
    """The three patterns of a line: split at bars outside parentheses."""
    parts, depth = [""], 0
    for c in rest:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts
