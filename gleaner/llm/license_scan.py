"""Operator 8, licence scans by ordered signature rules.

Each rule is a regex with a label, a priority, a score and a keyword that stands in every text that the
regex can match; a rule is tried only where its keyword occurs. SIGNATURES are written one by one: titles,
notices, passages and addresses of licences. FAMILIES name licences as they are referred to, and FORMS the ways of
referring; SPDX ids have rules of their own. Matches are resolved in order of priority: one that lies
within a match of higher priority, or of equal priority and greater length, is suppressed; of matches
of one priority and one interval the first label by name stays. The scan for containment is a sweep with a
tree of greatest ends, so many matches in one text cost n log n.

The base phrases of `PHRASES` are counted as runs of words over the whole text, apart from the rules.

Defined edge cases: a null text is empty, with no words and no labels; texts of any length are
scanned whole; repeated rows give equal rows; an empty table gives no rows. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame

from gleaner.llm.common import map_texts

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

_SEPARATORS = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))

#: label: (keyword that must occur, how the licence is named). Names are tried on lower-cased text.
V = r",?\s+(?:version\s+|v\.?\s*)?"
FAMILIES: dict[str, tuple[str, str]] = {
    "mit": ("mit", r"(?:the\s+)?mit(?:/x11|/expat)?"),
    "mit-0": ("mit", r"mit(?:-0|\s+no\s+attribution)"),
    "x11": ("x11", r"x11"),
    "isc": ("isc", r"isc"),
    "apache-1.1": ("apache", rf"apache(?:\s+software)?(?:\s+licen[sc]e)?{V}1\.1"),
    "apache-2.0": ("apache", rf"apache(?:\s+software)?(?:\s+licen[sc]e)?(?:{V}|-)2(?:\.0)?"),
    "bsd-2-clause": ("bsd", r"(?:simplified\s+bsd|bsd[\s-]2[\s-]clause|2[\s-]clause\s+bsd|freebsd)"),
    "bsd-3-clause": ("bsd", r"(?:(?:new|modified|revised)\s+bsd|bsd[\s-]3[\s-]clause|3[\s-]clause\s+bsd)"),
    "bsd-4-clause": ("bsd", r"(?:original\s+bsd|bsd[\s-]4[\s-]clause|4[\s-]clause\s+bsd)"),
    "0bsd": ("bsd", r"(?:zero[\s-]clause\s+bsd|0bsd)"),
    "bsd": ("bsd", r"(?:the\s+)?bsd(?:[\s-]style)?"),
    "gpl-1.0": ("general public", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{V}1(?:\.0)?"),
    "gpl-2.0": ("general public", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{V}2(?:\.0)?"),
    "gpl-3.0": ("general public", rf"(?:gnu\s+)?general\s+public\s+licen[sc]e{V}3(?:\.0)?"),
    "gpl-2.0-short": ("gpl", r"(?:gnu\s+)?gpl(?:\s*v|\s+version\s+|-)\s*2(?:\.0)?"),
    "gpl-3.0-short": ("gpl", r"(?:gnu\s+)?gpl(?:\s*v|\s+version\s+|-)\s*3(?:\.0)?"),
    "gpl": ("gpl", r"(?:gnu\s+)?gpl"),
    "lgpl-2.0": ("general public", rf"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e{V}2(?:\.0)?"),
    "lgpl-2.1": ("lesser", rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{V}2\.1"),
    "lgpl-3.0": ("lesser", rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{V}3(?:\.0)?"),
    "lgpl": ("lgpl", r"(?:gnu\s+)?lgpl(?:\s*v?\s*[23](?:\.[01])?)?"),
    "agpl-3.0": ("affero", rf"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e{V}3(?:\.0)?"),
    "agpl-long": ("affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e"),
    "agpl": ("agpl", r"(?:gnu\s+)?agpl(?:\s*v?\s*3(?:\.0)?)?"),
    "gfdl-1.3": ("free documentation", rf"(?:gnu\s+)?free\s+documentation\s+licen[sc]e{V}1\.3"),
    "gfdl": ("free documentation", rf"(?:gnu\s+)?free\s+documentation\s+licen[sc]e(?:{V}1\.[12])?"),
    "mpl-1.1": ("mozilla", rf"mozilla\s+public\s+licen[sc]e{V}1\.[01]"),
    "mpl-2.0": ("mozilla", rf"mozilla\s+public\s+licen[sc]e{V}2\.0"),
    "mpl": ("mozilla", r"mozilla\s+public\s+licen[sc]e"),
    "epl-1.0": ("eclipse", rf"eclipse\s+public\s+licen[sc]e{V}1\.0"),
    "epl-2.0": ("eclipse", rf"eclipse\s+public\s+licen[sc]e{V}2\.0"),
    "epl": ("eclipse", r"eclipse\s+public\s+licen[sc]e"),
    "edl-1.0": ("eclipse", r"eclipse\s+distribution\s+licen[sc]e"),
    "cddl-1.0": ("common development", r"common\s+development\s+and\s+distribution\s+licen[sc]e"),
    "cpl-1.0": ("common public", r"common\s+public\s+licen[sc]e"),
    "eupl-1.2": ("european union", r"european\s+union\s+public\s+licen[sc]e"),
    "artistic-1.0": ("artistic", rf"artistic\s+licen[sc]e{V}1\.0"),
    "artistic-2.0": ("artistic", rf"artistic\s+licen[sc]e{V}2\.0"),
    "artistic": ("artistic", r"artistic\s+licen[sc]e"),
    "bsl-1.0": ("boost", rf"boost\s+software\s+licen[sc]e(?:{V}1\.0)?"),
    "busl-1.1": ("business source", r"business\s+source\s+licen[sc]e"),
    "sspl-1.0": ("server side", r"server\s+side\s+public\s+licen[sc]e"),
    "zlib": ("zlib", r"zlib(?:/libpng)?"),
    "libpng": ("libpng", r"libpng"),
    "unlicense": ("unlicense", r"(?:the\s+)?unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "psf-2.0": ("python", r"python(?:\s+software\s+foundation)?"),
    "php-3.01": ("php", r"php(?:\s+version)?\s+3\.01?"),
    "php": ("php", r"php"),
    "ruby": ("ruby", r"ruby(?:'s)?"),
    "openssl": ("openssl", r"openssl"),
    "postgresql": ("postgresql", r"postgresql"),
    "ncsa": ("ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?"),
    "afl-3.0": ("academic free", r"academic\s+free\s+licen[sc]e"),
    "osl-3.0": ("open software", r"open\s+software\s+licen[sc]e"),
    "ms-pl": ("microsoft", r"microsoft\s+public\s+licen[sc]e"),
    "ms-rl": ("microsoft", r"microsoft\s+reciprocal\s+licen[sc]e"),
    "ofl-1.1": ("open font", r"(?:sil\s+)?open\s+font\s+licen[sc]e"),
    "odbl-1.0": ("open database", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[sc]e"),
    "odc-by-1.0": ("open data commons", r"open\s+data\s+commons\s+attribution"),
    "ogl-uk-3.0": ("open government", r"open\s+government\s+licen[sc]e"),
    "cc0-1.0": ("cc0", r"cc0(?:[\s-]1\.0)?(?:\s+universal)?"),
    "upl-1.0": ("universal permissive", r"universal\s+permissive\s+licen[sc]e"),
    "vim": ("vim", r"vim"),
    "openrail": ("openrail", r"(?:creativeml\s+)?(?:big)?(?:science\s+)?openrail(?:-?[mds]+)?"),
}
#: Creative Commons: the six combinations of conditions, short and long, with a version.
CONDITIONS = {"by": r"attribution", "by-sa": r"attribution[\s-]+share\s?alike", "by-nd": r"attribution[\s-]+no\s?deriv(?:ative)?s?(?:\s+works)?",
              "by-nc": r"attribution[\s-]+non\s?-?commercial", "by-nc-sa": r"attribution[\s-]+non\s?-?commercial[\s-]+share\s?alike",
              "by-nc-nd": r"attribution[\s-]+non\s?-?commercial[\s-]+no\s?deriv(?:ative)?s?(?:\s+works)?"}
#: SPDX ids by label where they are not the label itself; ids of the GNU licences are followed by -only or -or-later, or a plus sign.
SPDX = {"psf-2.0": ("psf-2.0", "python-2.0"), "gfdl": ("gfdl-1.1", "gfdl-1.2"), "mpl-1.1": ("mpl-1.0", "mpl-1.1"), "agpl-3.0": ("agpl-3.0",), "php-3.01": ("php-3.0", "php-3.01")}
SPDX_FORM = r"spdx-license-identifier:\s*(?:\(?[\w.+-]+\)?\s+(?:or|and|with)\s+)*\(?(?:{n})(?:-only|-or-later|\+)?(?![\w+-]|\.\w)"
#: (priority, score, form of reference); {n} is the licence's name.
FORMS: list[tuple[int, float, str]] = [
    (80, 0.95, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|made\s+available)\s+(?:freely\s+)?under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{n}(?:\s+licen[sc]e)?(?![\w-])"),
    (70, 0.9, r"(?<![\w-]){n}\s+(?:software\s+)?licen[sc]e(?![\w-])"),
    (60, 0.85, r"licen[sc]e\s*[:=]\s*[\"']?{n}(?![\w-])"),
    (50, 0.7, r"(?:subject\s+to|governed\s+by|according\s+to|conditions\s+of)\s+(?:the\s+)?{n}(?:\s+licen[sc]e)?(?![\w-])"),
]
#: The second licence of several that a text is under.
FURTHER = (78, 0.9, r"licen[sc]ed\s+under\s+(?:[\w/.,+()-]+\s+){1,8}?(?:or|and)\s+(?:the\s+)?{n}(?![\w-])")
#: A name that holds the word licence stands for itself wherever it is.
TITLE = (68, 0.85, r"(?<![\w-]){n}(?![\w-]|\.\d)")
#: Names that mostly mean a language or a program: only together with the word licence, or alone in a field.
PROGRAMS = ("psf-2.0", "php-3.01", "php", "ruby", "openssl", "postgresql", "vim")
PROGRAM_FORMS: list[tuple[int, float, str]] = [
    (80, 0.95, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|made\s+available)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?{n}\s+licen[sc]e(?![\w-])"),
    (70, 0.9, r"(?<![\w-])the\s+{n}\s+licen[sc]e(?![\w-])"),
    (60, 0.85, r"licen[sc]e\s*[:=]\s*[\"']?{n}(?=[\"']?[ \t]*(?:[,;\n]|\Z))"),
    (50, 0.7, r"(?:subject\s+to|governed\s+by|according\s+to|conditions\s+of)\s+(?:the\s+)?{n}\s+licen[sc]e(?![\w-])"),
]
#: label, keyword, regex: short names that mean nothing else.
SHORT_NAMES: list[tuple[str, str, str]] = [
    ("apache-2.0", "apache", rf"apache(?:-2\.0|\s+(?:software\s+)?licen[sc]e(?:{V}|-)2(?:\.0)?)"),
    ("apache-1.1", "apache", rf"apache(?:-1\.1|\s+(?:software\s+)?licen[sc]e{V}1\.1)"),
    ("gpl-2.0", "gpl", r"gpl(?:v|-)2(?:\.0)?(?:-only|-or-later)?"),
    ("gpl-3.0", "gpl", r"gpl(?:v|-)3(?:\.0)?(?:-only|-or-later)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?:v|-)2\.1(?:-only|-or-later)?"),
    ("lgpl-3.0", "lgpl", r"lgpl(?:v|-)3(?:\.0)?(?:-only|-or-later)?"),
    ("agpl-3.0", "agpl", r"agpl(?:v|-)3(?:\.0)?(?:-only|-or-later)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd-2-clause|2-clause\s+bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd-3-clause|3-clause\s+bsd)"),
    ("mpl-2.0", "mpl", r"mpl-2\.0"),
    ("epl-2.0", "epl", r"epl-2\.0"),
    ("psf-2.0", "python software", r"python\s+software\s+foundation\s+licen[sc]e"),
]
#: label, keyword, priority, score, regex: passages of the licences themselves, their addresses and other notices.
PASSAGES: list[tuple[str, str, int, float, str]] = [
    ("mit", "permission is hereby granted", 95, 1.0, r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("isc", "permission to use", 95, 1.0, r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("bsd", "redistribution and use", 85, 0.95, r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification"),
    ("bsd-3-clause", "endorse or promote", 95, 1.0, r"neither\s+the\s+name\s+of\s+(?s:(?!neither\s+the\s+name\s).)+?endorse\s+or\s+promote\s+products"),
    ("bsd-4-clause", "advertising materials", 95, 1.0, r"all\s+advertising\s+materials\s+mentioning\s+features"),
    ("gpl", "free software", 85, 0.9, r"this\s+program\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it"),
    ("lgpl", "free software", 85, 0.9, r"this\s+library\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it"),
    ("zlib", "as-is", 95, 1.0, r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("unlicense", "public domain", 95, 1.0, r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("bsl-1.0", "permission is hereby granted", 95, 1.0, r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+or\s+organization"),
    ("wtfpl", "what the", 95, 1.0, r"do\s+what\s+the\s+\w+\s+you\s+want\s+to\s+public\s+licen[sc]e"),
    ("apache-2.0", "apache.org", 88, 0.95, r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("gpl", "gnu.org", 88, 0.9, r"https?://www\.gnu\.org/(?:licenses|copyleft)/gpl"),
    ("lgpl", "gnu.org", 88, 0.9, r"https?://www\.gnu\.org/(?:licenses|copyleft)/lgpl"),
    ("agpl", "gnu.org", 88, 0.9, r"https?://www\.gnu\.org/(?:licenses|copyleft)/agpl"),
    ("mpl-2.0", "mozilla.org", 88, 0.95, r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mit", "opensource.org", 88, 0.95, r"https?://(?:www\.)?opensource\.org/licenses/mit"),
    ("bsd-3-clause", "opensource.org", 88, 0.95, r"https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause"),
    ("cc0-1.0", "creativecommons.org", 88, 0.95, r"https?://creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "public domain", 40, 0.6, r"(?:released|dedicated|placed)\s+(?:in|to|into)\s+the\s+public\s+domain"),
    ("proprietary", "all rights reserved", 30, 0.5, r"all\s+rights\s+reserved"),
    ("proprietary", "proprietary", 45, 0.7, r"proprietary\s+and\s+confidential|confidential\s+and\s+proprietary"),
    ("gpl", "general public", 20, 0.8, r"(?:gnu\s+)?general\s+public\s+licen[sc]e"),
    ("apache", "apache", 20, 0.8, r"apache\s+licen[sc]e"),
    ("unknown", "licen", 5, 0.3, r"licen[sc]ed\s+under\s+(?:the\s+)?[\w.-]+(?:\s+[\w.-]+){0,3}\s+licen[sc]e"),
]


#: Signatures written one by one: label | priority | score | keyword | regex, in which a space stands for any white space.
SIGNATURES = r"""
apache-2.0|92|1.0|apache license|apache license,? version 2\.0, january 2004
apache-1.1|92|1.0|apache software license|the apache software license, version 1\.1
apache-2.0|91|0.95|unless required by applicable law|unless required by applicable law or agreed to in writing, software distributed under the license
apache-2.0|86|0.9|except in compliance|you may not use this file except in compliance with the license
gpl-1.0|92|1.0|general public license|gnu general public license,? version 1, february 1989
gpl-2.0|92|1.0|general public license|gnu general public license,? version 2, june 1991
gpl-3.0|92|1.0|general public license|gnu general public license,? version 3, 29 june 2007
gpl-2.0|91|0.95|general public license|general public license as published by the free software foundation[;,] (?:either )?version 2
gpl-3.0|91|0.95|general public license|general public license as published by the free software foundation[;,] (?:either )?version 3
gpl|86|0.85|general public license|you should have received a copy of the gnu general public license
gpl|84|0.85|take away your freedom|the licenses for most software are designed to take away your freedom
gpl-classpath|93|1.0|linking this library statically|linking this library statically or dynamically with other modules
lgpl-2.0|92|1.0|library general public license|gnu library general public license,? version 2, june 1991
lgpl-2.1|92|1.0|lesser general public license|gnu lesser general public license,? version 2\.1, february 1999
lgpl-3.0|92|1.0|lesser general public license|gnu lesser general public license,? version 3, 29 june 2007
lgpl-2.1|91|0.95|lesser general public license|lesser general public license as published by the free software foundation[;,] (?:either )?version 2\.1
lgpl-3.0|91|0.95|lesser general public license|lesser general public license as published by the free software foundation[;,] (?:either )?version 3
lgpl|86|0.85|lesser general public license|you should have received a copy of the gnu lesser general public license
lgpl|86|0.85|library general public license|you should have received a copy of the gnu library general public license
agpl-3.0|92|1.0|affero general public license|gnu affero general public license,? version 3, 19 november 2007
agpl-1.0|92|1.0|affero general public license|affero general public license,? version 1, march 2002
agpl-3.0|91|0.95|affero general public license|affero general public license as published by the free software foundation[;,] (?:either )?version 3
agpl|86|0.85|affero general public license|you should have received a copy of the gnu affero general public license
gfdl-1.1|92|1.0|free documentation license|gnu free documentation license,? version 1\.1, march 2000
gfdl-1.2|92|1.0|free documentation license|gnu free documentation license,? version 1\.2, november 2002
gfdl-1.3|92|1.0|free documentation license|gnu free documentation license,? version 1\.3, 3 november 2008
gfdl|86|0.9|invariant sections|with no invariant sections, no front-cover texts,? and no back-cover texts
mit|91|0.95|permission notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|60|0.7|as is|the software is provided [\"']as is[\"'], without warranty of any kind, express or implied
mit-0|93|1.0|mit no attribution|mit no attribution
x11|93|1.0|x consortium|the name of the x consortium shall not be used in advertising
json|93|1.0|for good, not evil|the software shall be used for good, not evil
isc|91|0.95|disclaims all warranties|the author disclaims all warranties with regard to this software
0bsd|93|1.0|with or without fee|for any purpose with or without fee is hereby granted\.
bsd|88|0.9|redistributions of source code|redistributions of source code must retain the above copyright notice
bsd|87|0.9|redistributions in binary form|redistributions in binary form must reproduce the above copyright notice
bsd-4-clause|93|1.0|this product includes software|this product includes software developed by the university of california
bsd-3-clause-clear|93|1.0|no express or implied licenses|no express or implied licenses to any party's patent rights are granted by this license
bsd-3-clause-no-nuclear|93|1.0|nuclear facility|not designed, licensed or intended for use in the design, construction, operation or maintenance of any nuclear facility
bsd-2-clause-patent|93|1.0|each copyright holder|each copyright holder and contributor hereby grants to those receiving rights under this license
hpnd|91|0.95|appear in all copies|provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
zlib|91|0.95|altered source versions|altered source versions must be plainly marked as such
zlib|90|0.9|any source distribution|this notice may not be removed or altered from any source distribution
libpng-2.0|93|1.0|png reference library|png reference library license version 2
unlicense|91|0.95|anyone is free to copy|anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software
wtfpl|92|1.0|what the|do what the fuck you want to public license,? version 2, december 2004
beerware|93|1.0|beer-ware|[\"']the beer-ware license[\"'] \(revision 42\)
beerware|88|0.9|buy me a beer|you can buy me a beer in return
mpl-1.0|92|1.0|mozilla public license|mozilla public license,? version 1\.0
mpl-1.1|92|1.0|mozilla public license|mozilla public license,? version 1\.1
mpl-2.0|92|1.0|source code form|this source code form is subject to the terms of the mozilla public license, v\. 2\.0
npl-1.1|92|1.0|netscape public license|netscape public license,? version 1\.1
epl-1.0|92|1.0|eclipse public license|eclipse public license - v 1\.0
epl-2.0|92|1.0|eclipse public license|eclipse public license - v 2\.0
epl|84|0.9|accompanying materials|this program and the accompanying materials are made available under the terms of the eclipse public license
edl-1.0|92|1.0|eclipse distribution license|eclipse distribution license - v 1\.0
cpl-1.0|92|1.0|common public license|common public license (?:- v|version) 1\.0
ipl-1.0|92|1.0|ibm public license|ibm public license version 1\.0
lpl-1.02|92|1.0|lucent public license|lucent public license version 1\.02
cddl-1.0|92|1.0|common development and distribution|common development and distribution license \(cddl\),? version 1\.0
cddl-1.1|92|1.0|common development and distribution|common development and distribution license \(cddl\),? version 1\.1
cddl|86|0.9|common development and distribution|subject to the terms of the common development and distribution license
spl-1.0|92|1.0|sun public license|sun public license,? version 1\.0
sissl|92|1.0|industry standards source|sun industry standards source license
apsl-2.0|92|1.0|apple public source license|apple public source license,? (?:version )?2\.0
apsl-1.2|92|1.0|apple public source license|apple public source license,? (?:version )?1\.2
bsl-1.0|92|1.0|boost software license|boost software license - version 1\.0 - august 17th, 2003
artistic-1.0|92|1.0|artistic license|the [\"']?artistic license[\"']? preamble the intent of this document
artistic-2.0|92|1.0|artistic license|artistic license 2\.0 copyright \(c\) 2000-2006
afl-2.1|92|1.0|academic free license|academic free license,? (?:version |v\. )2\.1
afl-3.0|92|1.0|academic free license|academic free license,? (?:\([\"']?afl[\"']?\) )?(?:version |v\. )3\.0
osl-2.1|92|1.0|open software license|open software license,? (?:version |v\. )2\.1
osl-3.0|92|1.0|open software license|open software license,? (?:\([\"']?osl[\"']?\) )?(?:version |v\. )3\.0
nposl-3.0|93|1.0|non-profit open software|non-profit open software license
eupl-1.1|92|1.0|european union public licence|european union public licence,? v\. ?1\.1
eupl-1.2|92|1.0|european union public licence|european union public licence,? v\. ?1\.2
cecill-2.1|92|1.0|cecill|cecill free software license agreement version 2\.1
cecill|80|0.9|cecill|cecill free software license agreement
cecill-b|82|0.95|cecill-b|cecill-b (?:free software )?license
cecill-c|82|0.95|cecill-c|cecill-c (?:free software )?license
sspl-1.0|92|1.0|server side public license|server side public license,? version 1, october 16, 2018
busl-1.1|92|1.0|business source license|business source license 1\.1
elastic-2.0|92|1.0|elastic license|elastic license (?:version )?2\.0
elastic-2.0|86|0.9|hosted or managed service|you may not provide the software to third parties as a hosted or managed service
commons-clause|93|1.0|commons clause|commons clause[\"']? license condition v1\.0
fsl-1.1|92|1.0|functional source license|functional source license,? version 1\.1
polyform-noncommercial-1.0.0|92|1.0|polyform|polyform noncommercial license 1\.0\.0
polyform-small-business-1.0.0|92|1.0|polyform|polyform small business license 1\.0\.0
polyform-shield-1.0.0|92|1.0|polyform|polyform shield license 1\.0\.0
parity-7.0.0|92|1.0|parity public license|the parity public license 7\.0\.0
prosperity-3.0.0|92|1.0|prosperity public license|the prosperity public license 3\.0\.0
blueoak-1.0.0|92|1.0|blue oak|blue oak model license(?: version)? 1\.0\.0
hippocratic-2.1|92|1.0|hippocratic license|hippocratic license,? version 2\.1
anti-996|92|1.0|996|anti[ -]996 license
mulanpsl-1.0|92|1.0|mulan|mulan permissive software license,? (?:version |v)1
mulanpsl-2.0|92|1.0|mulan|mulan permissive software license,? (?:version |v)2
mulanpsl-2.0|90|0.95|mulan|licensed under mulan psl v2
python-2.0|92|1.0|python software foundation|python software foundation license version 2
cnri-python|92|1.0|cnri|cnri (?:open source )?(?:license agreement for )?python
php-3.01|92|1.0|php license|the php license, version 3\.01
zend-2.0|92|1.0|zend|zend engine license,? version 2\.00
ruby|90|0.9|give away verbatim|you may make and give away verbatim copies of the source form of the software without restriction
vim|90|0.9|vim|there are no restrictions on distributing unmodified copies of vim
tcl|90|0.9|regents of the university of california|this software is copyrighted by the regents of the university of california, sun microsystems
curl|92|1.0|daniel stenberg|copyright \(c\) [\d -]+, daniel stenberg
icu|92|1.0|icu license|icu license - icu 1\.8\.1 and later
unicode-3.0|92|1.0|unicode license|unicode license v3
unicode-dfs-2016|92|1.0|unicode, inc|unicode, inc\. license agreement - data files and software
ijg|92|1.0|independent jpeg group|this software is based in part on the work of the independent jpeg group
libtiff|92|1.0|sam leffler|the names of sam leffler and silicon graphics may not be used
ftl|92|1.0|freetype project|the freetype project license
imagemagick|92|1.0|imagemagick|imagemagick license
bzip2-1.0.6|92|1.0|julian|bzip2 and libbzip2.{1,60}julian seward
ntp|92|1.0|david l. mills|copyright \(c\) (?:university of delaware|david l\. mills) [\d-]+ david l\. mills
ncsa|92|1.0|ncsa|university of illinois/ncsa open source license
postgresql|92|1.0|postgresql|postgresql database management system \(formerly known as postgres
oldap-2.8|92|1.0|openldap public license|the openldap public license version 2\.8
openssl|92|1.0|openssl project|this product includes software developed by the openssl project
ssleay|92|1.0|eric young|this product includes cryptographic software written by eric young
sleepycat|92|1.0|sleepycat|sleepycat license
qpl-1.0|92|1.0|q public license|the q public license version 1\.0
w3c|92|1.0|w3c|w3c software (?:and document )?notice and license
zpl-2.1|92|1.0|zope public license|zope public license \(zpl\) version 2\.1
ecl-2.0|92|1.0|educational community license|educational community license,? version 2\.0
efl-2.0|92|1.0|eiffel forum license|eiffel forum license,? version 2
entessa|92|1.0|entessa|entessa public license
eudatagrid|92|1.0|datagrid|eu datagrid software license
fair|92|1.0|instrument is retained|usage of the works is permitted provided that this instrument is retained
frameworx-1.0|92|1.0|frameworx|frameworx open license 1\.0
intel|92|1.0|intel open source|intel open source license
ipafont-1.0|92|1.0|ipa font|ipa font license agreement v1\.0
lppl-1.3c|92|1.0|latex project public license|latex project public license,? version 1\.3c
lppl|84|0.9|latex project public license|latex project public license
miros|92|1.0|miros licence|the miros licence
motosoto|92|1.0|motosoto|motosoto open source license
multics|92|1.0|multics|historical background: this edition of the multics software materials
nasa-1.3|92|1.0|nasa open source|nasa open source agreement version 1\.3
naumen|92|1.0|naumen|naumen public license
ngpl|92|1.0|nethack|nethack general public license
nokia|92|1.0|nokia open source|nokia open source license
oclc-2.0|92|1.0|oclc research|oclc research public license 2\.0
ogtsl|92|1.0|test suite license|the open group test suite license
osset-pl-2.1|92|1.0|osset|osset public licen[sc]e
rpl-1.5|92|1.0|reciprocal public license|reciprocal public license,? (?:version )?1\.5
rpsl-1.0|92|1.0|realnetworks|realnetworks public source license
rscpl|92|1.0|ricoh|ricoh source code public license
sgi-b-2.0|92|1.0|sgi free software|sgi free software license b,? \(?version 2\.0
simpl-2.0|92|1.0|simple public license|simple public license \(simpl\)
watcom-1.0|92|1.0|watcom|sybase open watcom public license
vsl-1.0|92|1.0|vovida|vovida software license
aal|92|1.0|attribution assurance|attribution assurance license
catosl-1.1|92|1.0|computer associates|computer associates trusted open source license
cua-opl-1.0|92|1.0|cua office|cua office public license
ms-pl|92|1.0|microsoft public license|microsoft public license \(ms-pl\)
ms-rl|92|1.0|microsoft reciprocal license|microsoft reciprocal license \(ms-rl\)
upl-1.0|92|1.0|universal permissive license|universal permissive license \(upl\),? version 1\.0
ofl-1.1|92|1.0|open font license|sil open font license version 1\.1 - 26 february 2007
ofl-1.1|90|0.95|font software|this font software is licensed under the sil open font license
cc0-1.0|92|1.0|cc0|cc0 1\.0 universal
cc0-1.0|88|0.95|associated a work with this deed|the person who associated a work with this deed has dedicated the work to the public domain
pddl-1.0|92|1.0|public domain dedication|public domain dedication (?:and|&) licen[sc]e
odbl-1.0|92|1.0|open database license|open database license \(odbl\)
odc-by-1.0|92|1.0|odc-by|open data commons attribution license \(odc-by\)
cdla-permissive-1.0|92|1.0|community data license|community data license agreement - permissive - version 1\.0
cdla-permissive-2.0|92|1.0|community data license|community data license agreement - permissive - version 2\.0
cdla-sharing-1.0|92|1.0|community data license|community data license agreement - sharing - version 1\.0
ogl-uk-2.0|92|1.0|open government licence|open government licence (?:for public sector information )?v2\.0
ogl-uk-3.0|92|1.0|open government licence|open government licence (?:for public sector information )?v3\.0
etalab-2.0|92|1.0|etalab|(?:etalab licence ouverte|licence ouverte.{1,20}etalab)(?: 2\.0)?
dl-de-by-2.0|92|1.0|datenlizenz|datenlizenz deutschland.{1,5}namensnennung.{1,5}version 2\.0
dl-de-zero-2.0|92|1.0|datenlizenz|datenlizenz deutschland.{1,5}zero.{1,5}version 2\.0
openrail|92|1.0|bigscience|bigscience (?:open)?rail(?:-m)? license
openrail|92|1.0|creativeml|creativeml open ?rail-m
openrail|88|0.9|responsible ai license|responsible ai license
llama-2|92|1.0|llama|llama 2 community license agreement
llama-3|92|1.0|llama|(?:meta )?llama 3(?:\.\d)? community license agreement
gemma|92|1.0|gemma|gemma terms of use
fsf-unlimited|91|0.95|unlimited permission|this file is free software; the free software foundation gives unlimited permission to copy
fsf-all-permissive|91|0.95|copying and distribution|copying and distribution of this file, with or without modification, are permitted in any medium without royalty
public-domain|60|0.7|public domain|this (?:work|file|code|software) is (?:hereby )?(?:in|placed in|released into) the public domain
proprietary|50|0.7|unauthorized copying|unauthorized copying of this file,? via any medium,? is strictly prohibited
proprietary|48|0.7|trade secret|contains (?:confidential (?:information )?and )?(?:proprietary|trade secret)(?: information| and proprietary)?.{0,40}trade secrets?
proprietary|46|0.6|internal use only|for internal use only
proprietary|46|0.6|may not be|may not be (?:copied|reproduced|distributed|published)[\w ,]{0,80} without (?:the )?(?:prior |express )?written (?:permission|consent)
proprietary|44|0.6|written permission|without (?:the )?(?:prior |express )?written permission
eula|60|0.8|end user license agreement|end user license agreement(?: \([\"']?eula[\"']?\))?
eula|55|0.7|end-user license agreement|end-user license agreement
commercial|50|0.7|commercial license|(?:under|requires|purchase) a commercial license
unknown|8|0.3|see the license file|see the license file
unknown|8|0.3|see license|see license(?:\.txt|\.md)? for (?:license )?(?:details|terms|information)
"""


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    score: float
    regex: re.Pattern


@cache
def rules() -> list[Rule]:
    """All rules in order of priority."""
    short = lambda label: label.removesuffix("-short").removesuffix("-long")

    def forms(label: str, name: str) -> list[tuple[int, float, str]]:
        if label in PROGRAMS:
            return PROGRAM_FORMS
        own_word = "licen[sc]e" in name and "licen[sc]e)?" not in name  # "name license" would need the word twice
        return [*([FORMS[0], TITLE, *FORMS[2:]] if own_word else FORMS), FURTHER]

    found = [Rule(short(label), word, p, s, re.compile(form.replace("{n}", f"(?:{name})"))) for label, (word, name) in FAMILIES.items() for p, s, form in forms(label, name)]
    found += [Rule(label, word, TITLE[0], TITLE[1], re.compile(TITLE[2].replace("{n}", f"(?:{name})"))) for label, word, name in SHORT_NAMES]
    for line in SIGNATURES.strip().split("\n"):
        label, priority, score, word, regex = line.split("|", 4)
        found.append(Rule(label, word, int(priority), float(score), re.compile(regex.replace(" ", r"\s+"))))
    for label in dict.fromkeys(map(short, FAMILIES)):
        ids = "|".join(map(re.escape, SPDX.get(label, (label,))))
        found.append(Rule(label, "spdx", 90, 1.0, re.compile(SPDX_FORM.replace("{n}", ids))))
    for kind, long in CONDITIONS.items():
        short = kind.replace("-", r"[\s-]")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            v = version.replace(".", r"\.")
            found += [Rule(f"cc-{kind}-{version}", "cc", 75, 0.95, re.compile(rf"(?<![\w-])cc[\s-]{short}(?:\s+|-){v}(?![\w-])")),
                      Rule(f"cc-{kind}-{version}", "creative commons", 75, 0.95, re.compile(rf"creative\s+commons\s+{long}\s+(?:licen[sc]e\s+)?(?:\(?cc[\s-][a-z\s-]+\)?\s+)?{v}(?![\w-])")),
                      Rule(f"cc-{kind}-{version}", "creativecommons.org", 88, 1.0, re.compile(rf"creativecommons\.org/licenses/{kind}/{v}"))]
        found += [Rule(f"cc-{kind}", "cc", 65, 0.8, re.compile(rf"(?<![\w-])cc[\s-]{short}(?![\w-])")),
                  Rule(f"cc-{kind}", "creative commons", 65, 0.8, re.compile(rf"creative\s+commons\s+{long}(?![\w-])"))]
    found += [Rule(label, word, p, s, re.compile(regex)) for label, word, p, s, regex in PASSAGES]
    return sorted(found, key=lambda r: -r.priority)


#: One of these stands in every text that a rule can match; all other texts are passed by.
GATES = ("licen", "cc", "creative", "spdx", "permi", "redistribut", "endorse", "advertising", "software", "as-is", "as is", "public", "what",
         "apache.org", "gnu.org", "mozilla.org", "opensource.org", "reserved", "proprietary", "under", "subject", "governed", "according", "conditions",
         "mit no attribution", "for good, not evil", "warrant", "fee is hereby", "nuclear", "rights under", "appear in all", "altered", "source distribution", "free to", "beer", "source code form", "modules",
         "invariant", "cecill", "hosted or managed", "commons clause", "cnri", "give away", "unmodified copies", "copyright", "jpeg", "sam leffler", "julian", "mills", "postgres", "cryptographic", "instrument is",
         "multics", "creativeml", "agreement", "font", "cc0", "dedicated", "datenlizenz", "terms of use", "unlimited", "copying", "trade secret", "internal use", "written", "commercial", "openrail", "imagemagick", "version 1", "version 2", "gpl", "apache-", "bsd", "mpl-", "epl-")


@cache
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in {r.keyword for r in rules()}:
        found.add_word(w, w)
    found.make_automaton()
    return found


def detect(lower: str) -> list[tuple[int, int, Rule]]:
    """Matches (start, end, rule) in lower-cased text that no other one contains and outranks, by start."""
    if not any(g in lower for g in GATES):
        return []
    # Rules are written for single spaces in keywords; runs of white space are folded for the prefilter alone.
    present = {w for _, w in _keywords().iter(re.sub(r"\s+", " ", lower))}
    return suppressed([(m.start(), m.end(), r) for r in rules() if r.keyword in present for m in r.regex.finditer(lower)])


def suppressed(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The hits that none of higher priority, or of equal priority and greater length, contains, by start."""
    starts = sorted({h[0] for h in hits})
    place = {at: k for k, at in enumerate(starts, 1)}
    ends = [-1] * (len(starts) + 1)  # tree of the greatest end among the kept hits up to a start
    kept = []
    for h in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
        k, reach = place[h[0]], -1
        while k:
            reach, k = max(reach, ends[k]), k & (k - 1)
        if reach >= h[1]:
            continue
        kept.append(h)
        k = place[h[0]]
        while k < len(ends):
            ends[k], k = max(ends[k], h[1]), k + (k & -k)
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].label))


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """Starts of the base phrases in a list of words, with their labels."""
    out = []
    at = -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in PHRASES.items():
            start = at + 1 - len(phrase)
            if start >= 0 and words[start:at + 1] == [w.encode() for w in phrase]:
                out.append((start, label))
    return out


def scan(text: str | None) -> dict:
    text = text or ""
    words = text.encode("utf-8").translate(_SEPARATORS).split()
    base = places(words)
    lower = text.translate(_LOWER)
    found = detect(lower)
    labels = {x for _, x in base}
    return {"n_words": len(words), "n_base": len(base), "first_word": min((p for p, _ in base), default=None), "last_word": max((p for p, _ in base), default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {r.label for *_, r in found})),
            "score": max([0.9 if base else 0.0, *(r.score for *_, r in found)])}


_LOWER = {c: c + 32 for c in range(65, 91)}


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, matched text) of every detection: the operator's full output."""
    from pyspark.sql import functions as F

    def rows(texts):
        lower = [(t or "").translate(_LOWER) for t in texts]
        return {"found": [[{"start": s, "end": e, "label": r.label, "score": r.score, "matched": t[s:e]} for s, e, r in detect(low)] for t, low in zip((t or "" for t in texts), lower)]}

    kind = "array<struct<start:int,end:int,label:string,score:double,matched:string>>"
    return map_texts(docs, ["doc_id"], "text", f"doc_id long, found {kind}", rows).select("doc_id", F.inline("found"))


def query(docs: DataFrame) -> DataFrame:
    def rows(texts):
        got = [scan(t) for t in texts]
        return {k: [g[k] for g in got] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

    return map_texts(docs, ["doc_id"], "text", "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", rows)
