"""License scan: ordered signature rules behind a keyword gate, with interval-containment suppression.

Rules are phrases over lower-case words, compiled to regular expressions on the text's words, each word
between two spaces of its own. A rule belongs to a keyword; only texts that hold one of the anchors below
are looked at, and there only the rules whose keyword occurs. Detections are sorted by start, length
and priority, and one that lies within an earlier kept one is dropped, so that a longer or better rule
speaks for its place. Everything is built-in column functions in one pass without a shuffle.

Phrase syntax: ``a|b`` either word, ``x?`` optional word, ``*3`` up to three words of any kind.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: A text that lacks, for each of these, one of its words (in any case) and the beginning of a cc name matches no rule.
ANCHORS = [
    "licen", "copyright", "spdx", "public domain", "rights reserved", "hereby granted", "redistribut", "gpl", "commons", "cc0", "wtfpl", "noninfringement", "endorse", "cddl", "bsd",
    "without permission", "prior written", "advertising materials", "apache org", "mozilla org", "not be removed", "strictly prohibited", "be reproduced", "commercial use only",
]
CC_ANCHOR = r"cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?:by|zero)"

#: (label, keyword, name phrases). A version's digits are words of their own.
FAMILIES = [
    ("mit", "mit", ["mit license|licence", "mit x11 license", "mit style license"]),
    ("expat", "expat", ["expat license|licence"]),
    ("x11", "x11", ["x11 license"]),
    ("apache-1.0", "apache", ["apache software? license version? 1 0"]),
    ("apache-1.1", "apache", ["apache software? license version? 1 1"]),
    ("apache-2", "apache", ["apache software? license|licence version|v|v2 2? 0?", "apache software? license|licence 2 0?", "apache 2 0? license"]),
    ("apache", "apache", ["apache software? license|licence"]),
    ("gpl-1", "gnu", ["gnu general public license|licence version|v 1"]),
    ("gpl-2", "gnu", ["gnu general public license|licence version|v 2", "gnu gpl version|v 2", "gnu gplv2"]),
    ("gpl-3", "gnu", ["gnu general public license|licence version|v 3", "gnu gpl version|v 3", "gnu gplv3"]),
    ("gpl", "gnu", ["gnu general public license|licence", "gnu gpl"]),
    ("lgpl-2", "gnu", ["gnu library general public license|licence version|v 2", "gnu lgpl version|v 2"]),
    ("lgpl-2.1", "gnu", ["gnu lesser general public license|licence version|v 2 1", "gnu lgpl version|v 2 1"]),
    ("lgpl-3", "gnu", ["gnu lesser general public license|licence version|v 3", "gnu lgpl version|v 3"]),
    ("lgpl", "gnu", ["gnu lesser|library general public license|licence", "gnu lgpl"]),
    ("agpl-3", "gnu", ["gnu affero general public license|licence version|v 3", "gnu agpl version|v 3"]),
    ("agpl", "gnu", ["gnu affero general public license|licence", "gnu agpl"]),
    ("gfdl", "gnu", ["gnu free documentation license|licence"]),
    ("gpl-2", "gpl", ["gpl version? 2", "gplv2", "gpl v2"]),
    ("gpl-3", "gpl", ["gpl version? 3", "gplv3", "gpl v3"]),
    ("0bsd", "0bsd", ["0bsd license?"]),
    ("0bsd", "zero", ["zero clause bsd license?"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause license?", "simplified bsd license", "two clause bsd license?"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause license?", "new|modified bsd license", "three clause bsd license?"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause license?", "original bsd license", "four clause bsd license?"]),
    ("bsd", "bsd", ["bsd style? license|licence"]),
    ("mpl-1.1", "mozilla", ["mozilla public license|licence version|v? 1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public license|licence version|v? 2 0?"]),
    ("mpl", "mozilla", ["mozilla public license|licence"]),
    ("epl-1.0", "eclipse", ["eclipse public license|licence version|v? 1 0?"]),
    ("epl-2.0", "eclipse", ["eclipse public license|licence version|v? 2 0?"]),
    ("epl", "eclipse", ["eclipse public license|licence"]),
    ("eupl-1.2", "european", ["european union public licence|license version|v? 1 2"]),
    ("eupl", "european", ["european union public licence|license"]),
    ("cddl-1.0", "cddl", ["cddl version? 1 0", "cddl license"]),
    ("cddl-1.0", "distribution", ["common development and distribution license"]),
    ("isc", "isc", ["isc license|licence"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"]),
    ("boost-1", "boost", ["boost software license version? 1? 0?"]),
    ("artistic-2", "artistic", ["artistic license version? 2 0?"]),
    ("artistic", "artistic", ["artistic license"]),
    ("python-2", "python", ["python software foundation license", "python license version? 2"]),
    ("ruby", "ruby", ["ruby license"]),
    ("php-3", "php", ["php license version? 3"]),
    ("openssl", "openssl", ["openssl license"]),
    ("ofl-1.1", "font", ["sil open font license version? 1? 1?", "open font license"]),
    ("ms-pl", "microsoft", ["microsoft public license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"]),
    ("postgresql", "postgresql", ["postgresql license"]),
    ("odbl-1.0", "database", ["open database license version|v? 1? 0?"]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl version? 2?", "wtfpl license"]),
    ("cc0", "cc0", ["cc0 1 0 universal?", "cc0"]),
    ("cc0", "zero", ["cc zero", "creative commons zero"]),
    ("cc-by", "cc", ["cc by"]),
    ("cc-by-sa", "cc", ["cc by sa"]),
    ("cc-by-nd", "cc", ["cc by nd"]),
    ("cc-by-nc", "cc", ["cc by nc"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"]),
    ("cc-by", "commons", ["creative commons attribution"]),
    ("cc-by-sa", "commons", ["creative commons attribution share alike", "creative commons attribution sharealike"]),
    ("cc-by-nd", "commons", ["creative commons attribution no derivatives", "creative commons attribution noderivatives|noderivs"]),
    ("cc-by-nc", "commons", ["creative commons attribution non commercial", "creative commons attribution noncommercial"]),
    ("cc-by-nc-sa", "commons", ["creative commons attribution non commercial share alike", "creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc-nd", "commons", ["creative commons attribution non commercial no derivatives", "creative commons attribution noncommercial noderivatives|noderivs"]),
    ("afl-3.0", "academic", ["academic free license version|v? 3 0"]),
    ("osl-3.0", "open", ["open software license version|v? 3 0"]),
    ("busl-1.1", "business", ["business source license 1? 1?"]),
    ("sspl-1", "server", ["server side public license version? 1?"]),
    ("elastic-2", "elastic", ["elastic license version? 2 0?"]),
    ("polyform-nc", "polyform", ["polyform noncommercial license"]),
    ("polyform-sb", "polyform", ["polyform small business license"]),
    ("mulan-2", "mulan", ["mulan permissive software license version|v2? 2?"]),
    ("ecl-2.0", "educational", ["educational community license version? 2 0"]),
    ("upl-1.0", "universal", ["universal permissive license v|version? 1? 0?"]),
    ("cpl-1.0", "common", ["common public license version|v? 1 0"]),
    ("ipl-1.0", "ibm", ["ibm public license version|v? 1? 0?"]),
    ("npl-1.1", "netscape", ["netscape public license version? 1? 1?"]),
    ("edl-1.0", "eclipse", ["eclipse distribution license version|v? 1 0"]),
    ("lppl", "latex", ["latex project public license"]),
    ("qpl-1.0", "public", ["q public license version? 1? 0?"]),
    ("ncsa", "ncsa", ["ncsa open source license", "university of illinois ncsa license"]),
    ("w3c", "w3c", ["w3c software notice and license", "w3c software and document license"]),
    ("unicode", "unicode", ["unicode license agreement", "unicode license v3"]),
    ("vim", "vim", ["vim license"]),
    ("beerware", "beer", ["beer ware license"]),
    ("beerware", "beerware", ["beerware license"]),
    ("json", "json", ["json license"]),
    ("tcl", "tcl", ["tcl tk? license"]),
    ("sleepycat", "sleepycat", ["sleepycat license"]),
    ("zpl-2.1", "zope", ["zope public license version? 2 1", "zope public license"]),
    ("cecill", "cecill", ["cecill license|licence"]),
    ("cecill-b", "cecill", ["cecill b license|licence"]),
    ("cecill-c", "cecill", ["cecill c license|licence"]),
    ("ogl-uk", "government", ["open government licence|license"]),
    ("ogl-uk-3.0", "government", ["open government licence|license version|v3 3? 0"]),
    ("free-art", "art", ["free art license", "licence art libre"]),
    ("opl", "publication", ["open publication license"]),
    ("open-game", "game", ["open game license"]),
    ("odc-by", "commons", ["open data commons attribution license"]),
    ("pddl", "commons", ["open data commons public domain dedication and license"]),
    ("hippocratic", "hippocratic", ["hippocratic license"]),
    ("openrail", "openrail", ["openrail license", "openrail m license"]),
    ("openrail", "rail", ["bigscience rail license"]),
    ("openrail", "responsible", ["responsible ai license"]),
    ("llama", "llama", ["llama 2|3|4 community license"]),
    ("info-zip", "info", ["info zip license"]),
    ("freetype", "freetype", ["freetype project? license"]),
    ("ijg", "jpeg", ["independent jpeg group license"]),
]

#: How a grant is worded. With it a name is stronger, and it holds its ground against "licensed under some license".
GRANT, GRANT_STRENGTH, NAME_STRENGTH = "licensed|released|distributed|available|published under *4 {name}", 1.0, 0.7

# Identifiers as they stand behind "SPDX-License-Identifier", and their labels.
SPDX = {
    "0bsd": "0bsd", "afl 3 0": "afl-3.0", "agpl 3 0": "agpl-3", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2", "artistic 1 0": "artistic", "artistic 2 0": "artistic-2", "blueoak 1 0 0": "blueoak-1",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause", "bsl 1 0": "boost-1", "busl 1 1": "busl-1.1", "cc by 3|4 0": "cc-by", "cc by nc 3|4 0": "cc-by-nc",
    "cc by nc nd 3|4 0": "cc-by-nc-nd", "cc by nc sa 3|4 0": "cc-by-nc-sa", "cc by nd 3|4 0": "cc-by-nd", "cc by sa 3|4 0": "cc-by-sa", "cc0 1 0": "cc0", "cddl 1 0": "cddl-1.0", "cecill 2 1": "cecill",
    "cpl 1 0": "cpl-1.0", "ecl 2 0": "ecl-2.0", "elastic 2 0": "elastic-2", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "eupl 1 2": "eupl-1.2", "gfdl 1 2|3": "gfdl", "gpl 1 0": "gpl-1", "gpl 2 0": "gpl-2",
    "gpl 3 0": "gpl-3", "hpnd": "hpnd", "isc": "isc", "lgpl 2 0": "lgpl-2", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "lppl 1 3c": "lppl", "mit": "mit", "mit 0": "mit-0", "mpl 1 1": "mpl-1.1",
    "mpl 2 0": "mpl-2.0", "ms pl": "ms-pl", "ms rl": "ms-rl", "ncsa": "ncsa", "odbl 1 0": "odbl-1.0", "ofl 1 1": "ofl-1.1", "openssl": "openssl", "osl 3 0": "osl-3.0", "php 3 01": "php-3", "postgresql": "postgresql",
    "psf 2 0": "python-2", "python 2 0": "python-2", "sspl 1 0": "sspl-1", "unlicense": "unlicense", "upl 1 0": "upl-1.0", "vim": "vim", "w3c": "w3c", "wtfpl": "wtfpl", "zlib": "zlib", "zpl 2 1": "zpl-2.1",
}

#: Notices and permission texts that tell a license by their wording: (label, keyword, phrase, strength).
NOTICES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "sublicense", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 1.0),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("mit", "authors", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("mit", "noninfringement", "fitness for a particular purpose and noninfringement", 0.6),
    ("mit-0", "furnished", "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("x11", "dealings", "the name|names of *8 shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 1.0),
    ("curl", "dealings", "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings", 1.0),
    ("icu", "appear", "the above copyright notice s? and this permission notice appear in all copies of the software and that", 0.9),
    ("isc", "hereby", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "appear", "provided that the above copyright notice and this permission notice appear in all copies", 0.7),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1.0),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 1.0),
    ("hpnd", "supporting", "that both that copyright notice and this permission notice appear in supporting documentation", 0.9),
    ("hpnd-sell", "hereby", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 1.0),
    ("libtiff", "notices", "for any purpose is hereby granted without fee provided that i the above copyright notices and this permission notice appear", 1.0),
    ("ntp", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 1.0),
    ("postgresql", "agreement", "this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("libpng", "hereby", "permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee", 1.0),
    ("ijg", "hereby", "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee", 1.0),
    ("w3c", "royalty", "with or without modification for any purpose and without fee or royalty is hereby granted", 1.0),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("bitstream-vera", "fonts", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license", 1.0),
    ("tcl", "authors", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 1.0),
    ("fsfap", "royalty", "are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.9),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is", 0.8),
    ("bsd-3-clause", "endorse", "neither the name of *8 nor the names of its contributors may be used to endorse", 1.0),
    ("bsd-3-clause", "endorse", "the name of the author may not be used to endorse or promote products derived from this software", 0.9),
    ("bsd-3-clause", "endorse", "the names of its contributors may not be used to endorse or promote products", 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement|acknowledgment", 1.0),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 1.0),
    ("bsd-2-clause-patent", "receiving", "each copyright holder and contributor hereby grants to those receiving rights under this license", 1.0),
    ("ncsa", "disclaimers", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", 1.0),
    ("sleepycat", "accompanied", "redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 0.8),
    ("apache-2", "apache", "www apache org licenses license 2 0", 1.0),
    ("apache-2", "agreed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "governing", "see the license for the specific language governing permissions and limitations under the license", 0.8),
    ("apache-2", "contributor", "licensed to the apache software foundation asf? under one or more contributor license agreements", 1.0),
    ("apache-2", "ownership", "see the notice file distributed with this work for additional information regarding copyright ownership", 0.9),
    ("apache-2", "irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 1.0),
    ("apache-1.1", "apache", "the names apache *6 must not be used to endorse or promote products derived from this software", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with", 0.9),
    ("gpl", "details", "see the gnu general public license for more details", 0.8),
    ("gpl-1", "foundation", "gnu general public license as published by the free software foundation either? version 1", 1.0),
    ("gpl-2", "foundation", "gnu general public license as published by the free software foundation either? version 2", 1.0),
    ("gpl-3", "foundation", "gnu general public license as published by the free software foundation either? version 3", 1.0),
    ("gpl-2", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", 0.9),
    ("gpl-3", "freedom", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works", 0.9),
    ("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gnu-license", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.7),
    ("gpl-linking-exception", "exception", "as a special exception the copyright holders of this library give you permission to link", 1.0),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser|library general public license", 1.0),
    ("lgpl", "received", "you should have received a copy of the gnu lesser|library general public license along with", 0.9),
    ("lgpl", "details", "see the gnu lesser|library general public license for more details", 0.8),
    ("lgpl-2", "foundation", "gnu library general public license as published by the free software foundation either? version 2", 1.0),
    ("lgpl-2.1", "foundation", "gnu lesser general public license as published by the free software foundation either? version 2 1", 1.0),
    ("lgpl-3", "foundation", "gnu lesser general public license as published by the free software foundation either? version 3", 1.0),
    ("lgpl-3", "incorporates", "gnu lesser general public license incorporates the terms and conditions of version 3", 1.0),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 1.0),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license along with", 0.9),
    ("agpl-3", "foundation", "gnu affero general public license as published by the free software foundation either? version 3", 1.0),
    ("agpl-3", "copyleft", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "entitled", "a copy of the license is included in the section entitled gnu free documentation license", 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "mozilla", "if a copy of the mpl was not distributed with this file you can obtain one at http|https mozilla org mpl 2 0", 1.0),
    ("mpl-2.0-no-copyleft", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license", 1.0),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1.0", "accompanying", "the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2.0", "accompanying", "the accompanying materials are made available under the terms of the eclipse public license v? 2 0", 1.0),
    ("cddl-1.0", "contents", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cddl-1.0", "header", "cddl header start", 0.9),
    ("cddl-1.0", "opensolaris", "a copy of the license at usr src opensolaris license", 1.0),
    ("eupl", "licence", "you may not use this work except in compliance with the licence", 0.9),
    ("eupl-1.2", "eupl", "licensed under the eupl version? 1 2", 1.0),
    ("zlib", "anyone", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1.0),
    ("zlib", "altered", "this notice may not be removed or altered from any source distribution", 0.9),
    ("info-zip", "disclaimer", "to alter it and redistribute it freely subject to the above disclaimer", 1.0),
    ("boost-1", "boost", "copy at http|https www boost org license 1 0 txt", 1.0),
    ("boost-1", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("perl", "perl", "redistribute it and or modify it under the same terms as perl", 1.0),
    ("ruby", "ruby", "redistribute it and or modify it under the same terms as ruby", 1.0),
    ("ruby", "bsdl", "redistribute it and or modify it under either the terms of the 2 clause bsdl", 1.0),
    ("artistic", "semblance", "such that the copyright holder maintains some semblance of artistic control", 1.0),
    ("artistic-2", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    ("python-2", "psf", "this license agreement is between the python software foundation psf", 1.0),
    ("python-2", "beopen", "beopen python open source license agreement", 1.0),
    ("php-3", "php", "this source file is subject to version 3 01? of the php license", 1.0),
    ("php-3", "php", "may not be called php nor may php appear in their name without prior written permission", 1.0),
    ("openssl", "openssl", "redistributions of any form whatsoever must retain the following acknowledgment *6 developed by the openssl project", 1.0),
    ("openssl", "openssl", "the names openssl toolkit and openssl project must not be used to endorse", 1.0),
    ("ssleay", "publically", "the licence and distribution terms for any publically available version or derivative of this code cannot be changed", 1.0),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 1.0),
    ("ofl-1.1", "fonts", "the fonts including any derivative works can be bundled embedded redistributed and or sold", 0.9),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("microsoft-terms", "microsoft", "microsoft software license terms", 0.9),
    ("lppl", "latex", "may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("cecill", "cecill", "this software is governed by the cecill license under french law", 1.0),
    ("busl-1.1", "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("elastic-2", "licensor", "the licensor grants you a non exclusive royalty free worldwide non sublicensable non transferable license to use copy distribute make available and prepare derivative works", 1.0),
    ("commons-clause", "clause", "commons clause license condition", 1.0),
    ("mulan-2", "mulan", "licensed under mulan psl v2", 1.0),
    ("freetype", "freetype", "portions of this software are copyright *4 the freetype project", 1.0),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "dedicate", "dedicate any and all copyright interest in the software to the public domain", 1.0),
    ("unlicense", "perpetuity", "relinquishment in perpetuity of all present and future rights to this software under copyright law", 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to public license", 1.0),
    ("cc0", "waived", "to the extent possible under law *8 waived all copyright and related or neighboring rights", 1.0),
    ("cc0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright", 1.0),
    ("cc0", "confer", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", 0.9),
    ("cc0", "publicdomain", "creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "publicdomain", "creativecommons org publicdomain mark 1 0", 0.9),
    ("cc-by", "creativecommons", "creativecommons org licenses by 1|2|3|4 0|5", 1.0),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa 1|2|3|4 0|5", 1.0),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd 1|2|3|4 0|5", 1.0),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc 1|2|3|4 0|5", 1.0),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa 1|2|3|4 0|5", 1.0),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd 1|2|3|4 0|5", 1.0),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.8),
    ("cc-by-sa", "remix", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.9),
    ("public-domain", "domain", "released|dedicated|placed|is *3 public domain", 0.9),
    ("public-domain", "domain", "public domain dedication|work", 0.8),
    ("crown", "crown", "crown copyright", 0.8),
    ("non-commercial", "commercial", "for non commercial use only", 0.7),
    ("non-commercial", "noncommercial", "for noncommercial use only", 0.7),
    ("all-rights-reserved", "reserved", "all rights reserved", 0.6),
    ("all-rights-reserved", "reproduced", "no part of this *2 may be reproduced", 0.9),
    ("proprietary", "proprietary", "proprietary license|licence", 0.8),
    ("proprietary", "copying", "unauthorized|unauthorised copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "redistribution", "no redistribution|reproduction without permission", 0.7),
    ("proprietary", "reproduction", "reproduction in whole or in part without *3 permission is strictly? prohibited", 0.8),
]

#: A license that no other rule names; these come last.
UNNAMED = [("unknown-license", "license", "licensed under *2 license", 0.3), ("unknown-license", "licence", "licensed under *2 licence", 0.3)]


def compile_phrase(phrase: str) -> str:
    """The regular expression of a phrase over words that each stand between two spaces of their own."""
    out = []
    for token in phrase.split():
        if token[0] == "*":
            out.append(f"(?: [^ ]+ ){{0,{token[1:]}}}")
        else:
            many = token.endswith("?")
            body = "|".join(re.escape(x) for x in token.rstrip("?").split("|"))
            out.append(f"(?: (?:{body}) )" + "?" * many)
    return "".join(out)


def rules() -> list[dict]:
    """All rules in order; the place in the list is the priority (earlier wins between equal places)."""
    out = []

    def add(label: str, keyword: str, phrase: str, strength: float) -> None:
        out.append({"label": label, "keyword": keyword, "pattern": compile_phrase(phrase), "strength": strength, "priority": len(out)})

    for name, label in SPDX.items():
        add(label, "spdx", f"spdx license identifier {name}", 1.0)
    for label, keyword, phrase, strength in NOTICES:
        add(label, keyword, phrase, strength)
    for form, strength in ((GRANT, GRANT_STRENGTH), ("{name}", NAME_STRENGTH)):
        for label, keyword, names in FAMILIES:
            for name in names:
                add(label, keyword, form.format(name=name), strength)
    for label, keyword, phrase, strength in UNNAMED:
        add(label, keyword, phrase, strength)
    return out


def _nested() -> Column:
    """The rules grouped by keyword, as a constant column."""
    groups: dict[str, list[dict]] = {}
    for r in rules():
        groups.setdefault(r["keyword"], []).append(r)
    text = json.dumps([{"keyword": k, "rules": v} for k, v in groups.items()])
    return F.from_json(F.lit(text), "array<struct<keyword:string,rules:array<struct<label:string,pattern:string,strength:double,priority:int>>>>")


def _word_count(c: Column) -> Column:
    """Words in a stretch of the spaced text: each has two spaces."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(words: Column, rule: Column) -> Column:
    """All matches of a rule as structs that sort by start, then longest, then priority."""
    found = F.regexp_extract_all(words, rule.pattern, F.lit(0))
    gaps = F.split(words, rule.pattern)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,back:int,priority:int,label:string,strength:double>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc.at + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        row = F.struct(start.alias("start"), (-end).alias("back"), rule.priority.alias("priority"), rule.label.alias("label"), rule.strength.alias("strength"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(row)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc.out)


def scan(docs: DataFrame) -> DataFrame:
    """License columns of every row of ``docs(doc_id, text)``; nothing is shuffled or dropped.

    Null and empty texts have no words, no labels (empty strings), null positions and score 0. The score
    is the strength of the strongest kept detection; base phrases count 0.9. Repeated rows are scanned each.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(raw)
    gate = F.col("low").rlike(CC_ANCHOR)
    for a in ANCHORS:
        gate = reduce(and_, [F.col("low").contains(x) for x in a.split()]) | gate
    body = F.trim(F.regexp_replace(F.translate("raw", UPPER, LOWER), GAP, "  "))
    d = docs.select("doc_id", raw.alias("raw"), low.alias("low"))
    d = d.select("doc_id", F.regexp_count("raw", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), body, F.lit(" "))).alias("words"))
    # The base phrases.
    w = F.col("words")
    near = {p: F.when(w.contains("  ".join(p.split())), F.split(w, "".join(f" {x} " for x in p.split()))) for p in BASE}
    d = d.select("*", *[v.alias(f"g{i}") for i, v in enumerate(near.values())])
    counts, firsts, lasts, names = [], [], [], []
    for i, (phrase, label) in enumerate(BASE.items()):
        g = F.col(f"g{i}")
        n = F.coalesce(F.size(g) - 1, F.lit(0)).cast("long")
        n = F.when(g.isNull(), F.lit(0)).otherwise(n)
        some = n > 0
        counts.append(n)
        firsts.append(F.when(some, _word_count(F.element_at(g, 1))))
        lasts.append(F.when(some, F.col("n_words") - _word_count(F.element_at(g, -1)) - len(phrase.split())))
        names.append(F.when(some, F.lit(label)))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    # The rules.
    chosen = F.flatten(F.transform(F.filter(_nested(), lambda g: F.contains(w, g.keyword)), lambda g: F.filter(g.rules, lambda r: F.rlike(w, r.pattern))))
    hits = F.array_sort(F.flatten(F.transform(chosen, lambda r: _places(w, r))))
    start = F.struct(F.lit(0).alias("back"), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))

    def keep(acc: Column, h: Column) -> Column:
        kept = F.struct(h.back.alias("back"), F.array_union(acc.labels, F.array(h.label)).alias("labels"), F.greatest(acc.score, h.strength).alias("score"))
        return F.when(h.back >= acc.back, acc).otherwise(kept)

    d = d.select(
        "doc_id",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        base.alias("base"),
        F.when(w.isNotNull(), F.aggregate(hits, start, keep)).alias("kept"),
    )
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), F.expr("cast(array() as array<string>)"))))
    strong = F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.greatest(F.coalesce(F.col("kept.score"), F.lit(0.0)), strong).alias("score"))
