"""License signatures: ordered rules, written by hand, over texts of lower-case words joined by one space.

A rule is a regular expression, the label it gives, its priority (smaller wins),
how sure it is, and its gate: groups of keywords of each of which one must occur
before the expression is tried. RULES has them by priority, one to a line:
label; keywords; expression. Keywords are alternatives, groups are joined by
"&". In expressions, <2.0> stands for the wordings of a version number, {under}
for "licensed under the terms of the" and its like, licen[sc]e for either
spelling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

UNDER = r"(?:(?:this (?:work|software|file|document|program) is )?(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?)?"

#: By priority and sureness: machine-readable identifiers, license texts and notices, names with "or later", names with versions, names, short names, hints.
RULES = {
    (5, 0.99): r"""
apache-2.0; spdx & apache; spdx licen[sc]e identifier apache 2 0
gpl-1.0; spdx & gpl; spdx licen[sc]e identifier gpl 1 0(?: only)?
gpl-2.0; spdx & gpl; spdx licen[sc]e identifier gpl 2 0(?: only)?
gpl-3.0; spdx & gpl; spdx licen[sc]e identifier gpl 3 0(?: only)?
gpl-2.0-or-later; spdx & gpl & later; spdx licen[sc]e identifier gpl 2 0 or later
gpl-3.0-or-later; spdx & gpl & later; spdx licen[sc]e identifier gpl 3 0 or later
gpl-2.0-with-exception; spdx & gpl & exception; spdx licen[sc]e identifier gpl 2 0(?: only| or later)? with (?:classpath|linux syscall|gcc|bison|font|autoconf) exception
lgpl-2.0; spdx & lgpl; spdx licen[sc]e identifier lgpl 2 0(?: only)?
lgpl-2.1; spdx & lgpl; spdx licen[sc]e identifier lgpl 2 1(?: only)?
lgpl-3.0; spdx & lgpl; spdx licen[sc]e identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later; spdx & lgpl & later; spdx licen[sc]e identifier lgpl 2 1 or later
lgpl-3.0-or-later; spdx & lgpl & later; spdx licen[sc]e identifier lgpl 3 0 or later
agpl-3.0; spdx & agpl; spdx licen[sc]e identifier agpl 3 0(?: only)?
agpl-3.0-or-later; spdx & agpl & later; spdx licen[sc]e identifier agpl 3 0 or later
mit; spdx & mit; spdx licen[sc]e identifier mit
mit-0; spdx & mit; spdx licen[sc]e identifier mit 0
isc; spdx & isc; spdx licen[sc]e identifier isc
bsd-0; spdx & 0bsd; spdx licen[sc]e identifier 0bsd
bsd-1; spdx & bsd; spdx licen[sc]e identifier bsd 1 clause
bsd-2; spdx & bsd; spdx licen[sc]e identifier bsd 2 clause(?: patent| views)?
bsd-3; spdx & bsd; spdx licen[sc]e identifier bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4; spdx & bsd; spdx licen[sc]e identifier bsd 4 clause(?: uc)?
mpl-1.1; spdx & mpl; spdx licen[sc]e identifier mpl 1 1
mpl-2.0; spdx & mpl; spdx licen[sc]e identifier mpl 2 0(?: no copyleft exception)?
epl-1.0; spdx & epl; spdx licen[sc]e identifier epl 1 0
epl-2.0; spdx & epl; spdx licen[sc]e identifier epl 2 0
cddl-1.0; spdx & cddl; spdx licen[sc]e identifier cddl 1 0
eupl-1.2; spdx & eupl; spdx licen[sc]e identifier eupl 1 2
artistic-2.0; spdx & artistic; spdx licen[sc]e identifier artistic 2 0
zlib; spdx & zlib; spdx licen[sc]e identifier zlib
boost-1.0; spdx & bsl; spdx licen[sc]e identifier bsl 1 0
busl-1.1; spdx & busl; spdx licen[sc]e identifier busl 1 1
unlicense; spdx & unlicense; spdx licen[sc]e identifier unlicense
wtfpl; spdx & wtfpl; spdx licen[sc]e identifier wtfpl
cc0; spdx & cc0; spdx licen[sc]e identifier cc0 1 0
cc-by-4.0; spdx & cc; spdx licen[sc]e identifier cc by 4 0
cc-by-sa-4.0; spdx & cc; spdx licen[sc]e identifier cc by sa 4 0
cc-by-nc-4.0; spdx & cc; spdx licen[sc]e identifier cc by nc 4 0
postgresql; spdx & postgresql; spdx licen[sc]e identifier postgresql
psf-2.0; spdx & psf,python; spdx licen[sc]e identifier (?:psf|python) 2 0
ofl-1.1; spdx & ofl; spdx licen[sc]e identifier ofl 1 1(?: no rfn| rfn)?
blueoak-1.0; spdx & blueoak; spdx licen[sc]e identifier blueoak 1 0 0
proprietary; spdx & proprietary; spdx licen[sc]e identifier licen[sc]eref proprietary
""",
    (12, 0.93): r"""
mit; obtaining; permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit; copies & permission; the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies
mit; sublicense; the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit; noninfringement; (?:merchantability )?fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
x11; advertising & consortium; the name of the x consortium shall not be used in advertising
isc; distribute & fee; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc; disclaims & isc; isc disclaims all warranties
bsd-0; disclaims & author; the software is provided as is and the author disclaims all warranties
bsd; redistribution & binary; redistribution and use in source and binary forms with or without modification are permitted
bsd-2; redistributions & retain; redistributions of source code must retain the above copyright notice this list of conditions
bsd-2; redistributions & reproduce; redistributions in binary form must reproduce the above copyright notice
bsd-3; endorse; neither the name of (?:.{0,120} )?nor the names of (?:its|any) contributors may be used to endorse or promote
bsd-3; endorse; the names? of (?:.{0,80} )?may not be used to endorse or promote products derived from this software
bsd-4; advertising; all advertising materials mentioning features or use of this software must display
bsd; consequential & regents,contributor,contributors,holder,holders; in no event shall the (?:regents|copyright holders?|contributors?) (?:or contributors )?be liable for any direct indirect incidental special exemplary or consequential
apache-2.0; compliance; you may not use this file except in compliance with the licen[sc]e
apache-2.0; apache; www apache org licen[sc]es licen[sc]e 2 0
apache-2.0; basis & conditions; distributed on an as is basis without warranties or conditions of any kind
apache-2.0; asf,apache; licen[sc]ed to the (?:apache software foundation|asf) (?:asf )?under one or more contributor
apache-2.0; contributor & perpetual; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache-1.1; acknowledgment & apache; this product includes software developed by the apache software foundation (?:.{0,40} )?alternately this acknowledgment may appear
gpl; redistribute; this program is free software you can redistribute it and or modify it
gpl; gnu; you should have received a copy of the gnu general public licen[sc]e
gpl; foundation & gnu; as published by the free software foundation (?:.{0,60} )?gnu general public
gpl; gnu; see the gnu general public licen[sc]e for more details
gpl; freedom & gnu; the gnu general public licen[sc]e is intended to guarantee your freedom to share and change
gpl-3.0; consumer & product; a user product is either a consumer product
gpl-2.0; verbatim & 1991; version 2 june 1991 (?:.{0,160} )?everyone is permitted to copy and distribute verbatim copies
gpl-3.0; verbatim & 2007; version 3 29 june 2007 (?:.{0,160} )?everyone is permitted to copy and distribute verbatim copies
gpl-2.0-with-classpath; linking & combined; linking this library statically or dynamically with other modules is making a combined work
gpl-or-later; later & option; (?:either )?version \d(?: \d)? of the licen[sc]e or at your option any later version
lgpl; redistribute & library; this library is free software you can redistribute it and or modify it
lgpl; gnu & lesser; you should have received a copy of the gnu lesser general public licen[sc]e
lgpl; gnu & library; you should have received a copy of the gnu library general public licen[sc]e
lgpl; gnu & lesser; see the gnu lesser general public licen[sc]e for more details
agpl; gnu & affero; you should have received a copy of the gnu affero general public licen[sc]e
agpl; remotely & network; your modified version must prominently offer all users interacting with it remotely through a computer network
fdl; invariant & documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e (?:.{0,120} )?invariant sections
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-1.1; mozilla; the contents of this file are subject to the mozilla public licen[sc]e version 1 1
mpl-2.0; incompatible & secondary; this source code form is incompatible with secondary licen[sc]es
epl-1.0; eclipse; www eclipse org legal epl v10
epl-2.0; eclipse; www eclipse org legal epl (?:2 0|v20)
cddl; distribution & subject; the contents of this file are subject to the terms of the common development and distribution licen[sc]e
unlicense; unencumbered; this is free and unencumbered software released into the public domain
unlicense; relinquishment; we intend this dedication to be an overt act of relinquishment in perpetuity
wtfpl; fuck; do what the fuck you want to(?: public licen[sc]e)?
beerware; beer; (?:if we meet some day and you think this stuff is worth it )?you can buy me a beer
zlib; implied & event; this software is provided as is without any express or implied warranty in no event will the authors
zlib; misrepresented; the origin of this software must not be misrepresented
zlib; altered; altered source versions must be plainly marked as such
boost-1.0; organization; permission is hereby granted free of charge to any person or organization obtaining a copy
libpng; png; the png reference library is supplied as is
openssl; openssl & toolkit; this product includes software developed by the openssl project for use in the openssl toolkit
psf-2.0; psf & python; psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e (?:.{0,120} )?python
postgresql; postgresql,california & documentation; in no event shall the (?:university of california|postgresql global development group) be liable (?:.{0,160} )?and its documentation
curl; stenberg; copyright (?:c )?.{0,20}? daniel stenberg (?:.{0,60} )?(?:curl|haxx)
icu; unicode & files; unicode (?:data files|inc) (?:.{0,60} )?data files or software
ofl-1.1; font & sold; neither the font software nor any of its individual components (?:.{0,80} )?may be sold by itself
ofl; reserved & font; reserved font name
as-is; provided & warranty; the software is provided as is without warranty of any kind
as-is; provided & warranties; (?:is )?provided as is and without any express or implied warranties
no-warranty; merchantability & implied; without even the implied warranty of merchantability or fitness for a particular purpose
cc0; affirmer; to the greatest extent permitted by but not in contravention of applicable law affirmer
cc0; waived & rights; has waived all copyright and related or neighboring rights to this work
cc-by; creativecommons; (?:http |https )?creativecommons org licen[sc]es by(?: \d \d)?
cc-by-sa; creativecommons; (?:http |https )?creativecommons org licen[sc]es by sa(?: \d \d)?
cc-by-nc; creativecommons; (?:http |https )?creativecommons org licen[sc]es by nc(?: \d \d)?
cc-by-nd; creativecommons; (?:http |https )?creativecommons org licen[sc]es by nd(?: \d \d)?
cc-by-nc-sa; creativecommons; (?:http |https )?creativecommons org licen[sc]es by nc sa(?: \d \d)?
cc-by-nc-nd; creativecommons; (?:http |https )?creativecommons org licen[sc]es by nc nd(?: \d \d)?
cc0; creativecommons; (?:http |https )?creativecommons org publicdomain zero(?: 1 0)?
public-domain; domain; (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain; domain; this (?:work|file|program|code) is (?:hereby )?in the public domain
public-domain; domain & government; work of the (?:united states|u s|us) government (?:.{0,60} )?public domain
pddl; dedication; (?:open data commons )?public domain dedication and licen[sc]e
proprietary; proprietary & confidential; (?:proprietary and confidential|confidential and proprietary)
proprietary; confidential; confidential and confidential
proprietary; reproduced,copied,distributed; no part of this (?:publication|document|work|software|book) may be (?:reproduced|copied|distributed)
proprietary; unauthorized,unauthorised & prohibited,forbidden; unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:.{0,60} )?(?:prohibited|forbidden)
proprietary; trade & secrets; (?:contains|constitutes) (?:valuable )?trade secrets
proprietary; written & permission; without (?:the )?(?:express |prior )+written permission
non-commercial; commercial,noncommercial; (?:for|only for) (?:personal |educational |research )?(?:and |or )?non ?commercial (?:use|purposes) only
non-commercial; commercial; (?:may|can|shall) not be used for commercial purposes
evaluation; evaluation; (?:for|solely for) evaluation purposes only
eula; agreement; end user licen[sc]e agreement
eula; software & agree; by (?:installing|downloading|using) (?:this|the) software you agree
""",
    (15, 0.96): r"""
gpl-2.0-or-later; gpl,general & later,newer; {under}(?:gnu )?(?:gpl|general public licen[sc]e(?: gpl)?) <2> or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later; gpl,general & later; {under}(?:gnu )?(?:gpl|general public licen[sc]e(?: gpl)?) <3> or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-or-later; gplv2 & later; {under}(?:gnu )?gplv2 or (?:any )?later(?: version)?
gpl-3.0-or-later; gplv3 & later; {under}(?:gnu )?gplv3 or (?:any )?later(?: version)?
lgpl-2.1-or-later; lgpl,lesser & later; {under}(?:gnu )?(?:lgpl|lesser general public licen[sc]e(?: lgpl)?) <2.1> or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0-or-later; lgpl,lesser & later; {under}(?:gnu )?(?:lgpl|lesser general public licen[sc]e(?: lgpl)?) <3> or (?:at your option )?(?:any )?later(?: version)?
agpl-3.0-or-later; agpl,affero & later; {under}(?:gnu )?(?:agpl|affero general public licen[sc]e(?: agpl)?) <3> or (?:at your option )?(?:any )?later(?: version)?
mpl-2.0-or-later; mpl,mozilla & later; {under}(?:mpl|mozilla public licen[sc]e) <2.0> or (?:any )?later(?: version)?
fdl-1.3-or-later; fdl,documentation & later; {under}(?:gnu )?(?:fdl|free documentation licen[sc]e) <1.3> or (?:any )?later(?: version)?
gpl-2.0-only; gpl,general & only; {under}(?:gnu )?(?:gpl|general public licen[sc]e) <2> only
gpl-3.0-only; gpl,general & only; {under}(?:gnu )?(?:gpl|general public licen[sc]e) <3> only
""",
    (20, 0.95): r"""
apache-1.0; apache; {under}apache(?: software)? licen[sc]e <1.0>
apache-1.1; apache; {under}apache(?: software)? licen[sc]e <1.1>
apache-2.0; apache; {under}apache(?: software)? licen[sc]e <2>
apache-2.0; apache; {under}apache <2>(?: licen[sc]e)?
apache-2.0; asl,al2; {under}(?:asl <2>|al2)
gpl-1.0; general,gpl; {under}(?:gnu )?(?:general public licen[sc]e|gpl) <1>
gpl-2.0; general,gpl; {under}(?:gnu )?(?:general public licen[sc]e|gpl) <2>
gpl-3.0; general,gpl; {under}(?:gnu )?(?:general public licen[sc]e|gpl) <3>
gpl-2.0; gplv2,gpl2; {under}(?:gnu )?(?:gplv2|gpl2)
gpl-3.0; gplv3,gpl3; {under}(?:gnu )?(?:gplv3|gpl3)
gpl-3.0; general & 3; {under}version 3 of the (?:gnu )?general public licen[sc]e
gpl-2.0; general & 2; {under}version 2 of the (?:gnu )?general public licen[sc]e
lgpl-2.0; library,lgpl; {under}(?:gnu )?(?:library general public licen[sc]e|lgpl) <2>
lgpl-2.1; lesser,lgpl; {under}(?:gnu )?(?:lesser general public licen[sc]e|lgpl) <2.1>
lgpl-3.0; lesser,lgpl; {under}(?:gnu )?(?:lesser general public licen[sc]e|lgpl) <3>
lgpl-2.1; lgplv2; {under}lgplv2 1
lgpl-3.0; lgplv3; {under}lgplv3
agpl-1.0; affero,agpl; {under}(?:affero general public licen[sc]e|agpl) <1>
agpl-3.0; affero,agpl; {under}(?:gnu )?(?:affero general public licen[sc]e|agpl) <3>
agpl-3.0; agplv3; {under}(?:gnu )?agplv3
fdl-1.1; documentation,fdl,gfdl; {under}(?:gnu )?(?:free documentation licen[sc]e|fdl|gfdl) <1.1>
fdl-1.2; documentation,fdl,gfdl; {under}(?:gnu )?(?:free documentation licen[sc]e|fdl|gfdl) <1.2>
fdl-1.3; documentation,fdl,gfdl; {under}(?:gnu )?(?:free documentation licen[sc]e|fdl|gfdl) <1.3>
mpl-1.0; mozilla,mpl; {under}(?:mozilla public licen[sc]e|mpl) <1.0>
mpl-1.1; mozilla,mpl; {under}(?:mozilla public licen[sc]e|mpl) <1.1>
mpl-2.0; mozilla,mpl; {under}(?:mozilla public licen[sc]e|mpl) <2>
npl-1.1; netscape,npl; {under}(?:netscape public licen[sc]e|npl) <1.1>
epl-1.0; eclipse,epl; {under}(?:eclipse public licen[sc]e|epl) <1.0>
epl-2.0; eclipse,epl; {under}(?:eclipse public licen[sc]e|epl) <2>
edl-1.0; eclipse; {under}eclipse distribution licen[sc]e <1.0>
cddl-1.0; distribution,cddl; {under}(?:common development and distribution licen[sc]e(?: cddl)?|cddl) <1.0>
cddl-1.1; distribution,cddl; {under}(?:common development and distribution licen[sc]e(?: cddl)?|cddl) <1.1>
cpl-1.0; common,cpl; {under}(?:common public licen[sc]e|cpl) <1.0>
ipl-1.0; ibm; {under}ibm public licen[sc]e <1.0>
eupl-1.1; european,eupl; {under}(?:european union public licen[sc]e(?: eupl)?|eupl) <1.1>
eupl-1.2; european,eupl; {under}(?:european union public licen[sc]e(?: eupl)?|eupl) <1.2>
artistic-1.0; artistic; {under}artistic licen[sc]e <1.0>
artistic-2.0; artistic; {under}artistic licen[sc]e <2>
osl-3.0; open,osl; {under}(?:open software licen[sc]e|osl) <3>
afl-3.0; academic,afl; {under}(?:academic free licen[sc]e|afl) <3>
psf-2.0; python,psf; {under}(?:python software foundation licen[sc]e|psf(?: licen[sc]e)?) <2>
php-3.01; php; {under}php licen[sc]e (?:version |v )?3 01
ofl-1.1; font,ofl; {under}(?:sil )?(?:open font licen[sc]e|ofl) <1.1>
odbl-1.0; database,odbl; {under}(?:open (?:data commons open )?database licen[sc]e(?: odbl)?|odbl) <1.0>
odc-by-1.0; attribution,odc; {under}(?:open data commons attribution licen[sc]e|odc by) <1.0>
lppl-1.3; latex,lppl; {under}(?:latex project public licen[sc]e|lppl) (?:version |v )?1 3[ac]?
boost-1.0; boost,bsl; {under}(?:boost software licen[sc]e|bsl) <1.0>
busl-1.1; business,busl; {under}(?:business source licen[sc]e|busl) <1.1>
sspl-1.0; server,sspl; {under}(?:server side public licen[sc]e(?: sspl)?|sspl) <1>
elastic-2.0; elastic; {under}elastic licen[sc]e <2>
upl-1.0; universal,upl; {under}(?:universal permissive licen[sc]e(?: upl)?|upl) <1.0>
ecl-2.0; educational,ecl; {under}(?:educational community licen[sc]e|ecl) <2>
zpl-2.1; zope,zpl; {under}(?:zope public licen[sc]e(?: zpl)?|zpl) <2.1>
qpl-1.0; q,qpl; {under}(?:q public licen[sc]e|qpl) <1.0>
polyform-nc-1.0; polyform; {under}polyform noncommercial licen[sc]e <1.0>(?: 0)?
blueoak-1.0; oak; {under}blue oak model licen[sc]e <1.0>(?: 0)?
mulan-2.0; mulan; {under}mulan (?:permissive software licen[sc]e|psl) <2>
cern-ohl-2.0; cern; {under}cern open hardware licen[sc]e <2>
openrail-m; openrail,rail; {under}(?:creativeml |bigscience )?(?:openrail(?: m)?|open rail(?: m)?|rail)(?: licen[sc]e)
llama; llama; {under}llama \d community licen[sc]e(?: agreement)?
bsd-0; bsd; {under}(?:bsd )?(?:0|zero) clause bsd(?: licen[sc]e)?
bsd-1; bsd; {under}(?:(?:1|one) clause bsd|bsd (?:1|one) clause)(?: licen[sc]e)?
bsd-2; bsd,freebsd; {under}(?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3; bsd; {under}(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: licen[sc]e)?
bsd-4; bsd; {under}(?:(?:4|four) clause bsd|bsd (?:4|four) clause|(?:original|old) bsd)(?: licen[sc]e)?
cc-by-4.0; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-3.0; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
cc-by-2.5; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)? (?:version )?2 5(?: generic)?(?: licen[sc]e)?
cc-by-2.0; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)? (?:version )?2 0(?: generic)?(?: licen[sc]e)?
cc-by-1.0; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)? (?:version )?1 0(?: generic)?(?: licen[sc]e)?
cc-by-sa-4.0; cc,creative; {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0; cc,creative; {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
cc-by-sa-2.5; cc,creative; {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? (?:version )?2 5(?: generic)?(?: licen[sc]e)?
cc-by-sa-2.0; cc,creative; {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)? (?:version )?2 0(?: generic)?(?: licen[sc]e)?
cc-by-nd-4.0; cc,creative; {under}(?:a )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-nd-3.0; cc,creative; {under}(?:a )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-4.0; cc,creative; {under}(?:a )?(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-3.0; cc,creative; {under}(?:a )?(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-2.0; cc,creative; {under}(?:a )?(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)? (?:version )?2 [05](?: generic)?(?: licen[sc]e)?
cc-by-nc-sa-4.0; cc,creative; {under}(?:a )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-3.0; cc,creative; {under}(?:a )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
cc-by-nc-nd-4.0; cc,creative; {under}(?:a )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)? (?:version )?4 0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd-3.0; cc,creative; {under}(?:a )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)? (?:version )?3 0(?: unported)?(?: licen[sc]e)?
""",
    (30, 0.85): r"""
apache; apache; {under}apache(?: software)?(?: style)? licen[sc]e
gpl; general,gpl; {under}(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl(?: licen[sc]e)?)
lgpl; lesser,library,lgpl; {under}(?:gnu )?(?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl(?: licen[sc]e)?)
agpl; affero,agpl; {under}(?:gnu )?(?:affero general public licen[sc]e|agpl(?: licen[sc]e)?)
fdl; documentation,gfdl; {under}(?:gnu )?(?:free documentation licen[sc]e|gfdl)
mit; mit,expat; {under}(?:mit|expat)(?: style| x11)? licen[sc]e
mit; mit; mit licen[sc]ed
mit-0; mit; {under}mit no attribution(?: licen[sc]e)?
x11; x11; {under}x11 licen[sc]e
isc; isc; {under}isc licen[sc]e
bsd; bsd; {under}bsd(?: style)? licen[sc]e
mpl; mozilla,mpl; {under}(?:mozilla public licen[sc]e|mpl licen[sc]e)
epl; eclipse; {under}eclipse public licen[sc]e
cddl; distribution,cddl; {under}(?:common development and distribution licen[sc]e|cddl licen[sc]e)
eupl; european; {under}european union public licen[sc]e
artistic; artistic; {under}artistic licen[sc]e
perl; perl; {under}same terms as perl(?: itself)?
osl; open & software; {under}open software licen[sc]e
afl; academic; {under}academic free licen[sc]e
psf; python,psf; {under}(?:python software foundation|psf|python) licen[sc]e
php; php; {under}php licen[sc]e
ruby; ruby; {under}ruby(?: s)? licen[sc]e
ofl; font; {under}(?:sil )?open font licen[sc]e
odbl; database; {under}open database licen[sc]e
lppl; latex; {under}latex project public licen[sc]e
boost; boost; {under}boost(?: software)? licen[sc]e
busl; business; {under}business source licen[sc]e
sspl; server; {under}server side public licen[sc]e
elastic; elastic; {under}elastic licen[sc]e
commons-clause; commons; {under}commons clause
upl; universal; {under}universal permissive licen[sc]e
zlib; zlib; {under}zlib(?: libpng)? licen[sc]e
ncsa; ncsa; {under}(?:university of illinois )?ncsa(?: open source)? licen[sc]e
postgresql; postgresql; {under}postgresql licen[sc]e
openssl; openssl; {under}openssl licen[sc]e
vim; vim; {under}vim licen[sc]e
ms-pl; microsoft,ms; {under}(?:microsoft public licen[sc]e|ms pl)
ms-rl; microsoft,ms; {under}(?:microsoft reciprocal licen[sc]e|ms rl)
w3c; w3c; {under}w3c software (?:notice and )?licen[sc]e
cc-by; cc,creative; {under}(?:a )?(?:cc by|creative commons attribution)(?: licen[sc]e)?
cc-by-sa; cc,creative; {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?
cc-by-nd; cc,creative; {under}(?:a )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: licen[sc]e)?
cc-by-nc; cc,creative; {under}(?:a )?(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)?
cc-by-nc-sa; cc,creative; {under}(?:a )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: licen[sc]e)?
cc-by-nc-nd; cc,creative; {under}(?:a )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: licen[sc]e)?
cc0; cc0,zero; {under}(?:cc0(?: 1 0)?(?: universal)?|creative commons zero)(?: licen[sc]e)?
dual; dual,double; (?:dual|double) licen[sc]ed under
reserved; reserved & all; all rights reserved
some-rights; reserved & some; some rights reserved
no-rights; reserved & no; no rights reserved
""",
    (45, 0.6): r"""
unlicense; unlicense; (?:the )?unlicense
wtfpl; wtfpl; wtfpl
beerware; beerware; beerware(?: licen[sc]e)?
public-domain; domain; (?:in|into) the public domain
copyleft; copyleft; copyleft
patents; pending; patents? pending
trademark; trademark,trademarks; (?:is a|are) (?:registered )?trademarks? of
copyright; copyright; copyright(?: c)?(?: \d{4})?(?: \d{4})? (?:by |the )?[^ ]+
licensed; licensed,licenced; licen[sc]ed under (?:the |a )?[^ ]+
license-file; license,licence; see (?:the )?(?:file )?licen[sc]e(?: txt| md)? (?:file )?for (?:more )?details
""",
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    gate: tuple[tuple[str, ...], ...]
    priority: int
    sure: float


def _number(m: re.Match) -> str:
    """Wordings of a version; a trailing .0 may be left out of versions that are given without one."""
    first, *rest = m[1].split(".")
    return rf"(?:version |v )?v?{first}" + "".join(f" {x}" for x in rest) + ("" if rest else "(?: 0)?")


def rules() -> list[Rule]:
    """All rules, in order of priority."""
    out = []
    for (priority, sure), text in RULES.items():
        for line in text.strip().splitlines():
            label, gate, expression = line.split("; ", 2)
            pattern = re.sub(r"<([\d.]+)>", _number, expression.replace("{under}", UNDER))
            groups = tuple(tuple(w.strip() for w in group.split(",")) for group in gate.split("&"))
            out.append(Rule(label, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), groups, priority, sure))
    return sorted(out, key=lambda r: r.priority)
