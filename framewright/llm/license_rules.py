"""The ordered signature rules of the license scan, written one by one or built from families, versions and phrasings.

A rule is (rule, label, priority, keyword, literal, regex, score): ``regex`` runs over lower-case words joined by single
spaces, only in documents that have ``keyword`` as a word and ``literal`` as a phrase.
"""

from __future__ import annotations

#: Family: words of its name, label, versions as words, short identifiers as words.
FAMILIES = [
    ("gnu general public license", "gpl", ["1", "2", "3"], ["gpl"]),
    ("gnu lesser general public license", "lgpl", ["2", "2 1", "3"], ["lgpl"]),
    ("gnu library general public license", "lgpl", ["2"], []),
    ("gnu affero general public license", "agpl", ["1", "3"], ["agpl"]),
    ("gnu free documentation license", "gfdl", ["1 1", "1 2", "1 3"], ["gfdl"]),
    ("apache license", "apache", ["1 0", "1 1", "2", "2 0"], ["apache"]),
    ("apache software license", "apache", ["1 0", "1 1", "2 0"], []),
    ("mit license", "mit", [], ["mit"]),
    ("expat license", "mit", [], ["expat"]),
    ("isc license", "isc", [], ["isc"]),
    ("bsd license", "bsd", [], ["bsd"]),
    ("bsd 2 clause license", "bsd-2-clause", [], ["bsd 2 clause"]),
    ("bsd 3 clause license", "bsd-3-clause", [], ["bsd 3 clause"]),
    ("bsd 4 clause license", "bsd-4-clause", [], ["bsd 4 clause"]),
    ("mozilla public license", "mpl", ["1 0", "1 1", "2 0"], ["mpl"]),
    ("eclipse public license", "epl", ["1 0", "2 0"], ["epl"]),
    ("common development and distribution license", "cddl", ["1 0", "1 1"], ["cddl"]),
    ("common public license", "cpl", ["1 0"], ["cpl"]),
    ("artistic license", "artistic", ["1 0", "2 0"], ["artistic"]),
    ("boost software license", "bsl", ["1 0"], ["bsl"]),
    ("european union public license", "eupl", ["1 1", "1 2"], ["eupl"]),
    ("academic free license", "afl", ["2 1", "3 0"], ["afl"]),
    ("open software license", "osl", ["2 1", "3 0"], ["osl"]),
    ("python software foundation license", "psf", ["2"], ["psf"]),
    ("zlib license", "zlib", [], ["zlib"]),
    ("sil open font license", "ofl", ["1 0", "1 1"], ["ofl"]),
    ("open database license", "odbl", ["1 0"], ["odbl"]),
    ("open data commons attribution license", "odc-by", ["1 0"], ["odc by"]),
    ("microsoft public license", "ms-pl", [], ["ms pl"]),
    ("universal permissive license", "upl", ["1 0"], ["upl"]),
    ("server side public license", "sspl", ["1"], ["sspl"]),
    ("business source license", "busl", ["1 1"], ["busl"]),
]
GRANTS = [
    "licensed under(?: the)?(?: terms of the)?", "released under(?: the)?(?: terms of the)?",
    "distributed under(?: the)?(?: terms of the)?", "available under(?: the)?(?: terms of the)?",
    "governed by(?: the)?(?: terms of the)?",
]
#: Creative Commons variants: words after "cc" or "creative commons", label.
COMMONS = [
    ("by", "cc-by"), ("by sa", "cc-by-sa"), ("by nd", "cc-by-nd"), ("by nc", "cc-by-nc"), ("by nc sa", "cc-by-nc-sa"),
    ("by nc nd", "cc-by-nc-nd"),
]
COMMONS_NAMES = [
    ("attribution", "cc-by"), ("attribution sharealike", "cc-by-sa"), ("attribution noderivatives", "cc-by-nd"),
    ("attribution noncommercial", "cc-by-nc"), ("attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("attribution noncommercial noderivatives", "cc-by-nc-nd"),
]
#: Signatures written one by one: label, phrase that must occur, regex where it isn't the phrase itself.
SIGNATURES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", None),
    ("mit", "to deal in the software without restriction", "to deal in the software without restriction(?: including without limitation the rights to use)?"),
    ("mit", "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies(?: or substantial portions of the software)?"),
    ("mit", "the software is provided as is", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?"),
    ("x11", "x11 license", "(?:the )?x11 license(?: distribution modification variant)?"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the(?: above)? copyright notice"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the(?: above)? copyright notice"),
    ("bsd-3-clause", "may be used to endorse or promote products", "(?:neither the name|the names?) of [a-z0-9 ]{1,60} may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "bsd style license", "bsd style license"),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?"),
    ("bsd-2-clause", "freebsd license", "(?:the )?freebsd license"),
    ("bsd-3-clause", "new bsd", "new bsd(?: license)?"),
    ("bsd-3-clause", "revised bsd", "revised bsd(?: license)?"),
    ("bsd-0-clause", "zero clause bsd", "zero clause bsd(?: license)?"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("gpl", "either version", "either version [123] of the license or at your option any later version"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "but without any warranty", "(?:it will be useful )?but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "you should have received a copy of the gnu", "you should have received a copy of the gnu(?: lesser| affero| library)? general public license"),
    ("gpl", "free software foundation", "(?:published by|write to) the free software foundation"),
    ("gpl", "gnu gpl", "(?:the )?gnu gpl(?: v?[123])?(?: or later)?"),
    ("gpl-with-classpath-exception", "classpath exception", "(?:gnu )?classpath exception(?: 2 0)?"),
    ("gpl-with-linking-exception", "linking exception", "(?:static|dynamic|runtime)? ?linking exception"),
    ("lgpl", "gnu lgpl", "(?:the )?gnu lgpl(?: v?[23](?: 1)?)?(?: or later)?"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it"),
    ("agpl", "gnu agpl", "(?:the )?gnu agpl(?: v?[13])?(?: or later)?"),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "no invariant sections", "with no invariant sections(?: no front cover texts)?(?: and no back cover texts)?"),
    ("apache-2.0", "you may not use this file except in compliance with the license", None),
    ("apache-2.0", "www apache org licenses license 2 0", "(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "apache 2 license", "apache 2(?: 0)? license"),
    ("apache", "apache software foundation", "licensed to the apache software foundation(?: asf)?"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license(?: v 2 0)?"),
    ("mpl", "mozilla org mpl", "(?:https? )?(?:www )?mozilla org mpl(?: [12] [01])?"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "this program and the accompanying materials are made available under the terms of the eclipse (?:public|distribution) license"),
    ("edl", "eclipse distribution license", "eclipse distribution license(?: v? ?1 0)?"),
    ("cddl", "subject to the terms of the common development and distribution license", None),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such"),
    ("libpng", "libpng license", "(?:the )?libpng license(?: version 2)?"),
    ("bsl-1.0", "boost org license 1 0", "(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
    ("unlicense", "this is free and unencumbered software released into the public domain", None),
    ("unlicense", "the unlicense", "(?:licensed under )?the unlicense"),
    ("unlicense", "unlicense org", "(?:https? )?(?:www )?unlicense org"),
    ("public-domain", "dedicated to the public domain", "(?:hereby )?dedicated to the public domain"),
    ("public-domain", "released into the public domain", "(?:hereby )?released into the public domain"),
    ("public-domain", "placed in the public domain", "(?:is |been )?(?:hereby )?placed in the public domain"),
    ("public-domain", "this work is in the public domain", "this work is in the public domain(?: in the united states)?"),
    ("cc0", "creative commons zero", "creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc0", "cc0", "cc0(?: v?1 0)?(?: universal)?(?: public domain dedication)?"),
    ("cc0", "creativecommons org publicdomain zero", "(?:https? )?creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "creativecommons org publicdomain mark", "(?:https? )?creativecommons org publicdomain mark(?: 1 0)?"),
    ("cc-by", "creativecommons org licenses by", "(?:https? )?creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons org licenses by sa", "(?:https? )?creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons org licenses by nd", "(?:https? )?creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons org licenses by nc", "(?:https? )?creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "(?:https? )?creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "(?:https? )?creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license(?: version 2)?"),
    ("wtfpl", "wtfpl", "wtfpl(?: v?2)?"),
    ("beerware", "the beer ware license", "the beer ware license(?: revision 42)?"),
    ("jquery", "jquery org license", "(?:https? )?(?:www )?jquery org license"),
    ("ofl", "scripts sil org ofl", "(?:https? )?scripts sil org ofl"),
    ("ofl", "with reserved font name", "with reserved font name(?:s)?"),
    ("openssl", "this product includes software developed by the openssl project", None),
    ("openssl", "openssl license", "(?:the )?openssl license"),
    ("php", "php license", "(?:the )?php license(?: version)?(?: v?3 0[01]?)?"),
    ("ruby", "ruby license", "(?:the )?ruby license"),
    ("perl", "under the same terms as perl itself", "(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("postgresql", "postgresql license", "(?:the )?postgresql license"),
    ("ncsa", "university of illinois ncsa open source license", "(?:the )?university of illinois ncsa open source license"),
    ("w3c", "w3c software", "w3c software(?: notice)?(?: and)?(?: document)? license"),
    ("unicode", "unicode license", "unicode license(?: agreement)?(?: v3)?"),
    ("json", "the software shall be used for good not evil", None),
    ("odbl", "opendatacommons org licenses odbl", "(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons org licenses by", "(?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?"),
    ("ogl-uk", "open government licence", "open government licence(?: v ?[123](?: 0)?)?"),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?(?: 2 0)?"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?"),
    ("llama", "llama community license", "llama(?: [23])? community license(?: agreement)?"),
    ("commons-clause", "commons clause", "commons clause(?: license)?(?: condition)?(?: v?1 0)?"),
    ("elastic", "elastic license", "elastic license(?: v?2(?: 0)?)?"),
    ("polyform", "polyform noncommercial", "polyform noncommercial(?: license)?(?: 1 0 0)?"),
    ("proprietary", "all rights reserved", None),
    ("proprietary", "no part of this publication may be reproduced", "no part of this publication may be reproduced(?: stored in a retrieval system)?"),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "(?:this file is )?proprietary and confidential"),
    ("proprietary", "confidential and proprietary", "(?:is )?confidential and proprietary(?: information)?"),
    ("proprietary", "end user license agreement", "(?:this )?end user license agreement(?: eula)?"),
    ("proprietary", "subject to the terms of your license agreement", None),
    ("proprietary", "for internal use only", "for internal use only(?: not for distribution)?"),
    ("proprietary", "reproduction without permission is prohibited", "reproduction without(?: written)? permission is(?: strictly)? prohibited"),
    ("copyright", "copyright c", r"copyright c(?: [0-9]{4})+"),
    ("copyright", "copyright", r"copyright(?: [0-9]{4})+(?: by)?"),
]


def build_rules() -> list[tuple]:
    """All rules in order. Priority 5: identifiers and licence texts; 4, 3: grants with and without a version; 2, 1: names."""
    rules: list[tuple] = []

    def add(label: str, priority: int, literal: str, regex: str, score: float) -> None:
        keyword = max(literal.split(" "), key=len)
        rules.append((len(rules), label, priority, keyword, literal, regex, score))

    for name, label, versions, shorts in FAMILIES:
        add(label, 1, name, name, 0.6)
        for version in versions:
            add(f"{label}-{version.replace(' ', '.')}", 2, name, f"{name}(?: version| v)? v?{version}(?: or later)?", 0.8)
        for grant in GRANTS:
            add(label, 3, name, f"{grant} {name}", 0.9)
            for version in versions:
                add(f"{label}-{version.replace(' ', '.')}", 4, name, f"{grant} {name}(?: version| v)? v?{version}(?: or later)?", 1.0)
        for short in shorts:
            add(label, 5, "spdx license identifier", f"spdx license identifier {short}(?: [0-9]+)*(?: only| or later)?", 1.0)
            add(label, 3, f"{short} license", f"(?:{'|'.join(GRANTS)}) {short} license", 0.8)
            for version in versions:
                add(f"{label}-{version.replace(' ', '.')}", 2, short, f"{short}(?: v| version)? v?{version}(?: only| or later)?", 0.7)
                joined = f"{short}v{version}"  # as in GPLv3 or LGPLv2.1
                add(f"{label}-{version.replace(' ', '.')}", 2, joined, f"(?:gnu )?{joined}(?: only| or later)?", 0.7)
    for words, label in COMMONS:
        add(label, 1, f"cc {words}", f"cc {words}", 0.7)
        add(label, 2, f"cc {words}", f"cc {words} [1-4] [05]", 0.9)
        for grant in GRANTS:
            add(label, 4, f"cc {words}", f"{grant} cc {words} [1-4] [05]", 1.0)
    for words, label in COMMONS_NAMES:
        add(label, 2, f"creative commons {words}", f"creative commons {words}(?: [1-4] [05])?(?: international| unported)?(?: license)?", 0.9)
        for grant in GRANTS:
            add(label, 4, f"creative commons {words}", f"{grant}(?: a)? creative commons {words}(?: [1-4] [05])?(?: international| unported)?(?: license)?", 1.0)
    for label, literal, regex in SIGNATURES:
        add(label, 5 if len(literal) > 30 else 3, literal, regex or literal, 1.0 if len(literal) > 30 else 0.5)
    return rules
