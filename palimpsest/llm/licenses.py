"""License scans by ordered signature rules, in DataFrame functions alone.

Texts become lower-case words joined by single spaces. Rules are regular
expressions over that form, written by hand: names of licenses in forms of
reference, sentences and notices of license texts, file headers, addresses. A
rule's expression is tried only where the text has its keywords: those of its
name or sentence, which each match contains. Keywords are tried once a text,
expressions are literals of the plan, and only rules that match are located.

Detections are intervals of words, in order of their start, the longer and then
the earlier rule first. One that lies within another of at least its priority
before it in that order is suppressed; a pass with the furthest end so far of
each priority tells. All is linear in the text, but for sorting detections.

Base phrases are counted besides, whatever the rules say, and their labels stay.
Null and empty texts have no words; very long texts are read whole; repeated rows
and ids give a row each; an empty table gives an empty result, and other columns
are ignored. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: What separates words, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Put before and after a place while it is located; words have no control characters.
BEGIN, END = "\x01", "\x02"

_V = r"(?: (?:version |v)?{0})"
#: label, identifier in words, name (a regular expression over words), keywords of the name: one of them is in every match.
NAMES = (
    ("mit", "mit", r"mit", " mit "),
    ("mit-0", "mit 0", r"mit no attribution", "no attribution"),
    ("x11", "x11", r"x11", " x11 "),
    ("isc", "isc", r"isc", " isc "),
    ("apache-1.1", "apache 1 1", r"apache(?: software)? license" + _V.format("1 1"), "apache"),
    ("apache-2.0", "apache 2 0", r"apache(?: software)?(?: license)?" + _V.format("2(?: 0)?"), "apache"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:simplified bsd|freebsd|(?:bsd )?2 clause(?: bsd)?)", " bsd |freebsd|2 clause"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:new bsd|modified bsd|revised bsd|(?:bsd )?3 clause(?: bsd)?)", " bsd |3 clause"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:original bsd|(?:bsd )?4 clause(?: bsd)?)", " bsd |4 clause"),
    ("bsd", "bsd", r"bsd", " bsd "),
    ("0bsd", "0bsd", r"(?:0bsd|zero clause bsd)", "0bsd|zero clause"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", r"(?:gnu )?(?:gpl|general public license)" + _V.format("2(?: 0)?"), " gpl |general public"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", r"(?:gnu )?(?:gpl|general public license)" + _V.format("3(?: 0)?"), " gpl |general public"),
    ("gpl", "gpl", r"(?:gnu gpl|gpl|gnu general public)", " gpl |general public"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?(?:lgpl|lesser general public license)" + _V.format("2 1"), "lgpl|lesser general"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?(?:lgpl|lesser general public license)" + _V.format("3(?: 0)?"), "lgpl|lesser general"),
    ("lgpl", "lgpl", r"(?:lgpl|(?:gnu )?(?:lesser|library) general public)", "lgpl|lesser general|library general"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", r"(?:gnu )?(?:agpl|affero general public license)" + _V.format("3(?: 0)?"), "agpl|affero"),
    ("agpl", "agpl", r"(?:agpl|(?:gnu )?affero general public)", "agpl|affero"),
    ("mpl-1.1", "mpl 1 1", r"(?:mpl|mozilla public license)" + _V.format("1 1"), " mpl |mozilla"),
    ("mpl-2.0", "mpl 2 0", r"(?:mpl|mozilla public license)" + _V.format("2(?: 0)?"), " mpl |mozilla"),
    ("epl-1.0", "epl 1 0", r"(?:epl|eclipse public license)" + _V.format("1(?: 0)?"), " epl |eclipse"),
    ("epl-2.0", "epl 2 0", r"(?:epl|eclipse public license)" + _V.format("2(?: 0)?"), " epl |eclipse"),
    ("cddl-1.0", "cddl 1 0", r"(?:cddl|common development and distribution)(?: license)?(?: (?:version |v)?1 0)?", "cddl|common development"),
    ("eupl-1.2", "eupl 1 2", r"(?:eupl|european union public(?: licen[cs]e)?)(?: (?:version |v)?1 2)?", "eupl|european union"),
    ("artistic-2.0", "artistic 2 0", r"(?:perl )?artistic(?: license)?(?: (?:version |v)?2 0)?", "artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("boost", "bsl 1 0", r"boost software(?: license)?(?: (?:version |v)?1 0)?", "boost"),
    ("unlicense", "unlicense", r"unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl|fuck"),
    ("python-2.0", "python 2 0", r"(?:psf|python software foundation)", " psf |python software"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?(?:ofl|open font)(?: license)?(?: (?:version |v)?1 1)?", " ofl |open font"),
    ("odbl", "odbl 1 0", r"(?:odbl|open database)", "odbl|open database"),
    ("cc0-1.0", "cc0 1 0", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", " cc0 |creative commons"),
    ("cc-by-nc-nd", r"cc by nc nd \d 0", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:s|atives|ative works)?)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("cc-by-nc-sa", r"cc by nc sa \d 0", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("cc-by-nc", r"cc by nc \d 0", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("cc-by-nd", r"cc by nd \d 0", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:s|atives|ative works)?)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("cc-by-sa", r"cc by sa \d 0", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("cc-by", r"cc by \d 0", r"(?:cc|creative commons) (?:by|attribution)(?: \d 0)?", " cc by |creative commons| cc attribution "),
    ("proprietary", "licenseref proprietary", r"proprietary", "proprietary"),
)
#: form, expression around {id} or {name}, what else every match contains, priority, confidence.
FORMS = (
    ("identifier", r"spdx license identifier {id}", "spdx license identifier", 600, 1.0),
    ("grant", r"(?:licensed|distributed|released|published|provided|available|covered|governed) (?:to you )?(?:under|by|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?(?: version \d+(?: \d+)?)?", "", 500, 0.95),
    ("terms", r"(?:terms|conditions|provisions) of (?:the )?{name}(?: licen[cs]e)?(?: version \d+(?: \d+)?)?", "s of ", 400, 0.9),
    ("title", r"{name} licen[cs]e(?: version \d+(?: \d+)?)?", " licen", 300, 0.8),
    ("field", r"licen[cs]e (?:is |type |name )?(?:the )?{name}", " licen", 200, 0.7),
    ("notice", r"(?:see|read|under|use) (?:the )?{name} (?:for|terms|file|text|notice)", "", 100, 0.5),
)
#: label, a sentence or notice over words, its keyword, priority, confidence; by family.
PERMISSIVE = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission", 700, 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission", 690, 0.9),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute", "without restriction", 690, 1.0),
    ("mit", r"distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "sublicense", 690, 1.0),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "liable", 680, 0.9),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "warrant", 680, 0.9),
    ("mit", r"opensource org licenses mit(?: license)?", "opensource org", 650, 1.0),
    ("mit-0", r"opensource org licenses mit 0", "opensource org", 655, 1.0),
    ("mit", r"released under (?:an?|the) (?:expat|mit expat) licen[cs]e", "expat", 520, 0.9),
    ("mit", r"mit style licen[cs]e", "mit style", 420, 0.8),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium", 700, 1.0),
    ("x11", r"x window system is a trademark of (?:the )?x consortium", "x consortium", 690, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 700, 1.0),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims", 680, 0.9),
    ("isc", r"loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "tortious", 680, 0.9),
    ("isc", r"opensource org licenses isc(?: license(?: txt)?)?", "opensource org", 650, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 680, 1.0),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistribution", 680, 1.0),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistribution", 680, 1.0),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied warranties", "warrant", 670, 0.9),
    ("bsd", r"indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods", "exemplary", 660, 0.8),
    ("bsd", r"bsd style licen[cs]e", "bsd style", 420, 0.8),
    ("bsd", r"use of this source code is governed by a bsd style license that can be found in the license file", "source code", 690, 1.0),
    ("bsd-2-clause", r"opensource org licenses bsd 2 clause", "opensource org", 650, 1.0),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause", "opensource org", 650, 1.0),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "endorse", 700, 1.0),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission", "endorse", 700, 1.0),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse", 670, 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising", 700, 1.0),
    ("bsd-4-clause", r"this product includes software developed by the university of california", "california", 690, 0.9),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", "official policies", 690, 0.9),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "permission", 705, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable", 700, 1.0),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications", "permission", 700, 1.0),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented", 700, 1.0),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented", 700, 1.0),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization", 710, 1.0),
    ("boost", r"the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included", "license grant", 700, 1.0),
    ("boost", r"boost org license 1 0(?: txt)?", "boost org", 650, 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 700, 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 700, 1.0),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors", "dedication", 700, 1.0),
    ("unlicense", r"unlicense org", "unlicense", 650, 0.9),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 700, 1.0),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "verbatim", 700, 1.0),
    ("python-2.0", r"psf is making python available to licensee on an as is basis", " psf ", 700, 1.0),
    ("python-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform", " psf ", 700, 1.0),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl", 700, 1.0),
    ("openssl", r"this product includes cryptographic software written by eric young", "cryptographic", 700, 1.0),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software", 700, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 700, 1.0),
    ("apache-2.0", r"http www apache org licenses license 2 0", "apache org", 700, 1.0),
    ("apache-2.0", r"https www apache org licenses license 2 0", "apache org", 700, 1.0),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable law", 690, 1.0),
    ("apache-2.0", r"see the license for the specific language governing permissions and limitations under the license", "permissions and limitations", 690, 1.0),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache software", 700, 1.0),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license", "royalty free", 700, 1.0),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files", "prominent notices", 690, 0.9),
)
COPYLEFT = (
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software", 700, 1.0),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope", 680, 0.9),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "received a copy", 700, 1.0),
    ("gpl", r"published by the free software foundation either version", "free software", 660, 0.8),
    ("gpl", r"free software foundation inc 5\d (?:franklin|temple)", "free software", 640, 0.8),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", "freedom", 700, 1.0),
    ("gpl", r"when we speak of free software we are referring to freedom not price", "freedom", 700, 0.9),
    ("gpl", r"gnu org licenses gpl(?: (?:html|txt))?", "gnu org", 640, 0.9),
    ("gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0(?: (?:html|txt))?", "gnu org", 650, 1.0),
    ("gpl-3.0", r"gnu org licenses gpl 3 0(?: (?:html|txt))?", "gnu org", 650, 1.0),
    ("gpl-2.0", r"either version 2 of the license or at your option any later version", "option", 700, 1.0),
    ("gpl-3.0", r"either version 3 of the license or at your option any later version", "option", 700, 1.0),
    ("gpl-2.0", r"gnu general public license version 2 june 1991", "june 1991", 720, 1.0),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007", "june 2007", 720, 1.0),
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium", "verbatim", 700, 1.0),
    ("gpl-2.0", r"activities other than copying distribution and modification are not covered by this license they are outside its scope", "outside its scope", 690, 0.9),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure", "technological measure", 700, 1.0),
    ("gpl-3.0", r"you may convey verbatim copies of the program s source code as you receive it in any medium", "verbatim", 700, 1.0),
    ("gpl-3.0", r"each time you convey a covered work the recipient automatically receives a license from the original licensors", "covered work", 700, 1.0),
    ("gpl", r"linking (?:this library|exception) .{0,60}?statically or dynamically with other modules is making a combined work", "combined work", 690, 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "free software", 710, 1.0),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license", "free software", 710, 1.0),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)", "received a copy", 710, 1.0),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", "in the hope", 690, 0.9),
    ("lgpl-2.1", r"gnu lesser general public license version 2 1 february 1999", "february 1999", 720, 1.0),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "incorporates", 720, 1.0),
    ("lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1(?: (?:html|txt))?", "gnu org", 650, 1.0),
    ("lgpl-3.0", r"gnu org licenses lgpl 3 0(?: (?:html|txt))?", "gnu org", 650, 1.0),
    ("lgpl", r"gnu org licenses lgpl(?: (?:html|txt))?", "gnu org", 640, 0.9),
    ("agpl", r"offering users interacting with it remotely through a computer network", "remotely", 700, 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this program", "affero", 710, 1.0),
    ("agpl-3.0", r"gnu affero general public license version 3 19 november 2007", "november 2007", 720, 1.0),
    ("agpl-3.0", r"gnu org licenses agpl 3 0(?: (?:html|txt))?", "gnu org", 650, 1.0),
    ("agpl", r"gnu org licenses agpl(?: (?:html|txt))?", "gnu org", 640, 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 700, 1.0),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", " mpl ", 700, 1.0),
    ("mpl-2.0", r"mozilla org mpl 2 0", "mozilla org", 650, 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 700, 1.0),
    ("mpl-1.1", r"mozilla org mpl mpl 1 1(?: html)?", "mozilla org", 650, 1.0),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu general public license", "alternatively", 690, 0.8),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse", 700, 1.0),
    ("epl-1.0", r"eclipse org legal epl v10(?: html)?", "eclipse org", 650, 1.0),
    ("epl-2.0", r"eclipse org legal epl (?:2 0|v20)(?: html)?", "eclipse org", 650, 1.0),
    ("epl-1.0", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "recipient s acceptance", 690, 0.9),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "common development", 700, 1.0),
    ("cddl-1.0", r"opensource org licenses cddl(?: 1 0)?", "opensource org", 650, 1.0),
    ("eupl-1.2", r"licensed under the eupl (?:version 1 2 or|v 1 2 or)", "eupl", 710, 1.0),
    ("eupl-1.2", r"joinup ec europa eu .{0,60}?eupl", "eupl", 650, 0.9),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes the terms", "verbatim", 700, 0.9),
    ("artistic-2.0", r"the intent is that the copyright holder maintains some artistic control over the development of that package", "artistic control", 700, 1.0),
    ("artistic-2.0", r"under the same terms as perl itself", "perl itself", 600, 0.7),
)
CONTENT = (
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain", "deed", 700, 1.0),
    ("cc0-1.0", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "neighboring rights", 700, 1.0),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons org", 650, 1.0),
    ("cc-by", r"creativecommons org licenses by \d 0", "creativecommons org", 650, 1.0),
    ("cc-by-sa", r"creativecommons org licenses by sa \d 0", "creativecommons org", 650, 1.0),
    ("cc-by-nc", r"creativecommons org licenses by nc \d 0", "creativecommons org", 650, 1.0),
    ("cc-by-nd", r"creativecommons org licenses by nd \d 0", "creativecommons org", 650, 1.0),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d 0", "creativecommons org", 650, 1.0),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd \d 0", "creativecommons org", 650, 1.0),
    ("cc-by", r"you are free to share copy and redistribute the material in any medium or format", "redistribute the material", 660, 0.7),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit", 670, 0.8),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license", "remix", 680, 0.9),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes", 670, 0.8),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix", 680, 0.9),
    ("cc-by", r"text is available under the creative commons attribution", "creative commons", 640, 0.8),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font", 700, 1.0),
    ("ofl-1.1", r"the font software may be sold as part of a larger software package but no copy of one or more of the font software", "font", 700, 1.0),
    ("ofl-1.1", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "open font", 700, 1.0),
    ("ofl-1.1", r"scripts sil org ofl", "sil org", 650, 1.0),
    ("odbl", r"opendatacommons org licenses odbl(?: 1 0)?", "opendatacommons", 650, 1.0),
    ("odbl", r"this .{1,60}? is made available under the open database license", "open database", 700, 1.0),
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain", 650, 0.9),
    ("public-domain", r"this (?:work|file|software|code|document|text) is in the public domain", "public domain", 650, 0.9),
    ("public-domain", r"no copyright is claimed", "copyright is claimed", 600, 0.7),
    ("public-domain", r"not subject to copyright protection", "copyright protection", 600, 0.7),
    ("public-domain", r"public domain (?:mark|dedication)", "public domain", 610, 0.8),
)
RESTRICTED = (
    ("proprietary", r"unauthorized (?:copying|use|distribution) of (?:this|the) (?:file|software|document|material)s? .{0,40}?is strictly prohibited", "unauthorized", 650, 0.9),
    ("proprietary", r"all rights reserved (?:worldwide )?(?:proprietary and )?confidential", "confidential", 650, 0.8),
    ("proprietary", r"proprietary and confidential", "proprietary and", 640, 0.8),
    ("proprietary", r"this (?:software|document|file|material) (?:is|contains) (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property) of", "proprietary", 650, 0.9),
    ("proprietary", r"may not be (?:reproduced|copied|disclosed|distributed) (?:in whole or in part |in any form )?without (?:the )?(?:express |prior )*written (?:permission|consent)", "written", 640, 0.8),
    ("proprietary", r"no part of this (?:publication|document|book|work|software) may be reproduced", "may be reproduced", 650, 0.9),
    ("proprietary", r"(?:reproduction|redistribution) (?:or distribution )?(?:is )?(?:strictly )?prohibited without", "prohibited", 640, 0.8),
    ("proprietary", r"for internal use only", "internal use", 500, 0.5),
    ("proprietary", r"this software is licensed not sold", "licensed not sold", 650, 0.9),
    ("proprietary", r"end user license agreement", "end user license", 600, 0.7),
    ("proprietary", r"you may not reverse engineer decompile or disassemble", "reverse engineer", 650, 0.9),
    ("proprietary", r"trade secrets? of .{1,40}? and (?:is|are) protected by", "trade secret", 650, 0.8),
    ("proprietary", r"evaluation (?:purposes|use) only", "evaluation", 500, 0.5),
    ("busl-1.1", r"business source license 1 1", "business source", 700, 1.0),
    ("busl-1.1", r"change license .{0,40}?change date|change date .{0,60}?change license", "change license", 660, 0.8),
    ("sspl-1.0", r"server side public license(?: version 1)?", "server side public", 700, 1.0),
    ("commons-clause", r"commons clause(?: license condition)?", "commons clause", 660, 0.9),
    ("elastic-2.0", r"elastic license 2 0", "elastic license", 700, 1.0),
    ("polyform", r"polyform (?:noncommercial|small business|strict|perimeter|shield|free trial)(?: license)?", "polyform", 700, 1.0),
    ("json", r"the software shall be used for good not evil", "not evil", 710, 1.0),
    ("beerware", r"beer ?ware license|buy me a beer in return", "beer", 650, 0.8),
)
TEXTS = (*PERMISSIVE, *COPYLEFT, *CONTENT, *RESTRICTED)


def rules() -> list[tuple[str, str, tuple[str, ...], int, float]]:
    """(label, expression, keywords, priority, confidence), earlier ones first at equal priority.

    Keywords are lists parted by bars; of each list one is in every match of the expression.
    """
    out = [(label, text, (key,), priority, sure) for label, text, key, priority, sure in TEXTS]
    for _, shape, also, priority, sure in FORMS:
        for label, ident, name, key in NAMES:
            keys = (also,) if "{id}" in shape else (key, also) if also else (key,)
            out.append((label, shape.replace("{id}", ident).replace("{name}", name), keys, priority, sure))
    return sorted(out, key=lambda r: -r[3])


def words_of(text: Column) -> Column:
    """Lower-case words joined by single spaces; '' without any.

    ``lower`` also folds letters beyond ASCII, which neither joins nor parts words, nor makes a base phrase.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAK, " "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _whole(expression: str) -> str:
    """The expression over whole words; the space after them is left for the next place."""
    return f" (?:{expression})(?= )"


def _places(padded: Column, expression: Column) -> Column:
    """Array of (start, stop) in words of the places of ``expression`` (in whole words), found as marked words."""
    marked = F.split(F.regexp_replace(padded, F.concat(F.lit("( )("), expression, F.lit(")(?= )")), F.lit(f"$1{BEGIN}$2{END}")), " ")

    def ends(words: Column) -> Column:
        at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
        # the text begins with a space, so words count from 1 here; the stop is exclusive
        return F.zip_with(at(BEGIN), at(END), lambda a, b: F.struct((a - 1).alias("start"), b.alias("stop")))

    return let(marked, ends)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: words, base phrases' places and labels, all labels, the surest detection's confidence, and how many detections stay."""
    table = rules()
    labels = sorted({r[0] for r in table})
    levels = sorted({r[3] for r in table}, reverse=True)
    # one literal each, folded when the plan is optimised
    many = lambda values, kind: F.split(F.lit("\n".join(str(v) for v in values)), "\n").cast(f"array<{kind}>")
    regex, level, sure, name = many([r[1] for r in table], "string"), many([levels.index(r[3]) for r in table], "int"), many([r[4] for r in table], "double"), many([labels.index(r[0]) for r in table], "int")

    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    words = words.select("doc_id", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("padded"))
    has = lambda key: reduce(lambda a, b: a | b, [F.contains("padded", F.lit(k)) for k in key.split("|")])
    by: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        by.setdefault(r[2][0], []).append(i)
    none = F.array().cast("array<int>")
    tried = []
    for key, own in by.items():
        those = [F.when(reduce(lambda a, b: a & b, [*map(has, table[i][2][1:]), F.rlike("padded", F.lit(_whole(table[i][1])))]), F.lit(i)) for i in own]
        tried.append(F.when(has(key), F.filter(F.array(*those), lambda i: i.isNotNull())).otherwise(none))
    out = words.withColumn("rules", F.flatten(F.array(*tried)))
    # start, then the longer, then the earlier rule: whatever may suppress a detection stands before it
    detect = lambda i: F.transform(_places(F.col("padded"), F.get(regex, i)), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), i.alias("rule")))
    out = out.withColumn("found", F.when(F.size("rules") > 0, F.array_sort(F.flatten(F.transform("rules", detect)))))
    furthest = F.array_repeat(F.lit(-1), len(levels))
    start = F.struct(furthest.alias("furthest"), F.lit(0).cast("long").alias("labels"), F.lit(0.0).alias("sure"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, x: Column) -> Column:
        v, stop = F.get(level, x["rule"]), -x["back"]
        stays = F.get(state["furthest"], v) < stop
        # furthest holds, for each priority, the furthest end of detections of at least that priority
        return F.when(stays, F.struct(
            F.transform(state["furthest"], lambda f, at: F.when(at >= v, F.greatest(f, stop)).otherwise(f)).alias("furthest"),
            state["labels"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.get(name, x["rule"]))).alias("labels"),
            F.greatest(state["sure"], F.get(sure, x["rule"])).alias("sure"), (state["n"] + 1).alias("n"),
        )).otherwise(state)

    out = out.withColumn("kept", F.when(F.col("found").isNotNull(), F.aggregate("found", start, step)))

    def hits(phrase: str, label: str) -> Column:
        return F.transform(_places(F.col("padded"), F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    out = out.withColumn("base", F.when(F.contains("padded", F.lit(" license ")), F.flatten(F.array(*[hits(*b) for b in BASE]))))
    text = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_distinct(F.transform("base", lambda x: x["label"])), text)
    mask = F.coalesce(F.col("kept.labels"), F.lit(0).cast("long"))
    more = F.filter(F.transform(many(labels, "string"), lambda n, i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1, n)), lambda n: n.isNotNull())
    return out.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, more))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("kept.sure"), F.lit(0.0)), F.when(F.size(base_labels) > 0, 0.8).otherwise(0.0)).alias("score"),
        F.coalesce(F.col("kept.n"), F.lit(0).cast("long")).alias("n_detections"),
    )
