"""Signature rules of the license scan (operator 12), in order of priority.

A rule is (label, keyword, pattern). Patterns are regular expressions over
lower-case words: a blank stands for one or more separators (any ASCII
characters that are neither letters nor digits), ``#``
for any one word. A rule matches whole words only. The
keyword is a text that every match contains; a rule is tried only where it occurs.

Sections are ordered from the strongest evidence to the weakest; inside a
section the more specific rule comes first.
"""

from __future__ import annotations

#: Phrases that are always reported, whatever else matches there.
BASE = (
    ("gpl", "public", "gnu general public license"),
    ("apache", "apache", "apache license"),
    ("cc-by", "cc", "cc by"),
    ("mit", "license", "mit license"),
)

#: SPDX identifiers; a tag line with one of them is the strongest evidence.
IDENTIFIERS = """
0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later antlr-pd apache-1.0 apache-1.1 apache-2.0
apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0
cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0
efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.2 gfdl-1.3 gfdl-1.3-or-later gpl-1.0 gpl-2.0
gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu ijg imlib2 ipl-1.0 isc jasper-2.0 lgpl-2.0
lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng lppl-1.3c ms-pl ms-rl mit mit-0
mpl-1.1 mpl-2.0 mulanpsl-2.0 ncsa nist-pd odbl-1.0 odc-by-1.0 ofl-1.1 openldap openssl osl-2.1 osl-3.0 pddl-1.0 php-3.01
postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat spl-1.0 sspl-1.0 tcl ubl unicode-dfs-2016 unlicense upl-1.0
vim w3c wtfpl x11 zend-2.0 zlib zpl-2.1
""".split()

#: label | keyword | pattern, one a line.
NOTICES = """
# full notices and named versions
agpl-3.0-or-later | affero | gnu affero general public license( as published by the free software foundation)?( either)? version 3( of the license)? or( at your option)? any later version
agpl-3.0 | affero | (gnu )?affero general public license( version| v)? ?v?3( 0)?
agpl-1.0 | affero | affero general public license( version| v)? ?v?1( 0)?
agpl | affero | (gnu )?affero general public license
agpl-3.0 | agpl | agpl ?v?3( 0)?
lgpl-2.1-or-later | lesser | gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1( of the license)? or( at your option)? any later version
lgpl-3.0-or-later | lesser | gnu lesser general public license( as published by the free software foundation)?( either)? version 3( of the license)? or( at your option)? any later version
lgpl-2.1 | lesser | (gnu )?lesser general public license( version| v)? ?v?2 1
lgpl-3.0 | lesser | (gnu )?lesser general public license( version| v)? ?v?3( 0)?
lgpl-2.0 | library | (gnu )?library general public license( version| v)? ?v?2( 0)?
lgpl | lesser | (gnu )?lesser general public license
lgpl | library | (gnu )?library general public license
lgpl-2.1 | lgpl | lgpl ?v?2 1
lgpl-3.0 | lgpl | lgpl ?v?3( 0)?
gpl-2.0-or-later | public | gnu general public license( as published by the free software foundation)?( either)? version 2( of the license)? or( at your option)? any later version
gpl-3.0-or-later | public | gnu general public license( as published by the free software foundation)?( either)? version 3( of the license)? or( at your option)? any later version
gpl-2.0-with-classpath-exception | classpath | (gnu )?(general public license|gpl)( version| v)? ?v?2( only)? with( the)? classpath exception
gpl-1.0 | public | gnu general public license( version| v)? ?v?1( 0)?
gpl-2.0 | public | gnu general public license( version| v)? ?v?2( 0)?( only)?
gpl-3.0 | public | gnu general public license( version| v)? ?v?3( 0)?( only)?
gpl-2.0 | gpl | gpl ?v?2( 0)?
gpl-3.0 | gpl | gpl ?v?3( 0)?
gfdl-1.2 | documentation | gnu free documentation license( version| v)? ?v?1 2
gfdl-1.3 | documentation | gnu free documentation license( version| v)? ?v?1 3
gfdl | documentation | (gnu )?free documentation license
fsfap | permitted | copying and distribution of this file with or without modification are permitted in any medium without royalty
apache-2.0 | apache | apache license( version| v)? ?v?2( 0)?
apache-1.1 | apache | apache( software)? license( version| v)? ?v?1 1
apache-1.0 | apache | apache( software)? license( version| v)? ?v?1 0
apache-2.0 | apache | apache ?v?2( 0)?( license)?
apache-2.0 | asl | asl ?v?2 0
apache | apache | apache software license
apache-2.0 | writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | compliance | you may not use this file except in compliance with the license
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nc | cc | cc by nc
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nd | cc | cc by nd
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-sa | cc | cc by sa
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.5 | cc | cc by 2 5
cc-by-2.0 | cc | cc by 2 0
cc-by-nc-nd-4.0 | attribution | (creative commons )?attribution non ?commercial no ?deriv(s|atives)( works)? 4 0( international)?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(s|atives)
cc-by-nc-sa-4.0 | alike | (creative commons )?attribution non ?commercial share ?alike 4 0( international)?
cc-by-nc-sa-3.0 | alike | (creative commons )?attribution non ?commercial share ?alike 3 0( unported)?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0 | creative | creative commons attribution non ?commercial 4 0( international)?
cc-by-nc | creative | creative commons attribution non ?commercial
cc-by-nd | creative | creative commons attribution no ?deriv(s|atives)
cc-by-sa-4.0 | alike | (creative commons )?attribution share ?alike 4 0( international)?
cc-by-sa-3.0 | alike | (creative commons )?attribution share ?alike 3 0( unported)?
cc-by-sa | creative | creative commons attribution share ?alike
cc-by-4.0 | creative | creative commons attribution 4 0( international)?
cc-by-3.0 | creative | creative commons attribution 3 0( unported)?
cc-by-generic | creative | creative commons attribution
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | creative | creative commons zero( v?1 0)?
cc0-1.0 | dedicat | public domain dedication
cc-other | creative | creative commons( public)? licen[cs]e
mit | charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | attribution | mit no attribution
mit | expat | expat license
mit | mit | (the )?mit licen[cs]ed?
mit | mit | (released|distributed|licensed|available|published) under( the)?( terms of( the)?)? mit
mit | mit | license mit
x11 | x11 | x11 license
isc | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | isc | isc license
0bsd | 0bsd | (bsd )?0 ?bsd( license)?
0bsd | zero | (bsd zero clause|zero clause bsd)( license)?
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | endorse | neither the name of #( #){0,3}( nor the names of its contributors)? may be used to endorse or promote products
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | bsd | (4|four) clause bsd( license)?
bsd-4-clause | bsd | bsd (4|four) clause( license)?
bsd-3-clause | bsd | (3|three) clause bsd( license)?
bsd-3-clause | bsd | bsd (3|three) clause( license)?
bsd-3-clause | bsd | (new|modified|revised) bsd( license)?
bsd-2-clause | bsd | (2|two) clause bsd( license)?
bsd-2-clause | bsd | bsd (2|two) clause( license)?
bsd-2-clause | bsd | (simplified|freebsd) bsd( license)?
bsd-4-clause | bsd | (original|old) bsd( license)?
bsd | bsd | bsd( style)? licen[cs]ed?
bsd | bsd | (released|distributed|licensed|available) under( the)?( terms of( the)?)? bsd
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla | mozilla public license( version| v)? ?v?2( 0)?
mpl-1.1 | mozilla | mozilla public license( version| v)? ?v?1 1
mpl | mozilla | mozilla public license
mpl-2.0 | mpl | mpl ?v?2 0
mpl-1.1 | mpl | mpl ?v?1 1
epl-2.0 | eclipse | eclipse public license( version| v)? ?v?2( 0)?
epl-1.0 | eclipse | eclipse public license( version| v)? ?v?1( 0)?
epl | eclipse | eclipse public license
edl-1.0 | eclipse | eclipse distribution license( v?1 0)?
epl-2.0 | epl | epl ?v?2 0
epl-1.0 | epl | epl ?v?1 0
cddl-1.1 | development | common development and distribution license( version| v)? ?v?1 1
cddl-1.0 | development | common development and distribution license( version| v)? ?v?1( 0)?
cddl | development | common development and distribution license
cddl | cddl | cddl( license)?
cpl-1.0 | common | common public license( version| v)? ?v?1 0
ipl-1.0 | ibm | ibm public license( version| v)?( 1 0)?
eupl-1.2 | european | european union public licen[cs]e( version| v)? ?v?1 2
eupl-1.1 | european | european union public licen[cs]e( version| v)? ?v?1 1
eupl | european | european union public licen[cs]e
eupl-1.2 | eupl | eupl ?v?1 2
eupl-1.1 | eupl | eupl ?v?1 1
artistic-2.0 | artistic | artistic license( version| v)? ?v?2( 0)?
artistic-1.0 | artistic | artistic license( version| v)? ?v?1( 0)?
artistic | artistic | (clarified )?artistic license
perl-5 | perl | (under the )?same terms as perl( itself)?
bsl-1.0 | boost | boost software license( version| v)? ?v?1 0
bsl-1.0 | boost | boost software license
busl-1.1 | business | business source license( version| v)?( ?v?1 1)?
sspl-1.0 | server | server side public license( version| v)?( ?v?1( 0)?)?
sspl-1.0 | sspl | sspl( ?v?1)?
elastic-2.0 | elastic | elastic license( version| v)? ?v?2( 0)?
elastic | elastic | elastic license
commons-clause | commons | commons clause( license)?( condition)?( v?1 0)?
polyform-noncommercial-1.0.0 | polyform | polyform non ?commercial license( 1 0 0)?
polyform-small-business-1.0.0 | polyform | polyform small business license( 1 0 0)?
prosperity-3.0.0 | prosperity | prosperity public license( 3 0 0)?
blueoak-1.0.0 | blue | blue oak model license( 1 0 0)?
afl-3.0 | academic | academic free license( version| v)? ?v?3( 0)?
afl-2.1 | academic | academic free license( version| v)? ?v?2 1
afl | academic | academic free license
osl-3.0 | open | open software license( version| v)? ?v?3( 0)?
osl-2.1 | open | open software license( version| v)? ?v?2 1
osl | open | open software license
apsl-2.0 | apple | apple public source license( version| v)?( ?v?2( 0)?)?
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ms-pl | license | ms pl license
cecill-b | cecill | cecill b( license)?
cecill-c | cecill | cecill c( license)?
cecill-2.1 | cecill | cecill( free software license agreement)?( version| v)? ?v?2 1
cecill | cecill | cecill
mulanpsl-2.0 | mulan | mulan permissive software license( version| v)?( ?v?2)?
ncsa | ncsa | (university of illinois )?ncsa open source license
ecl-2.0 | educational | educational community license( version| v)?( 2 0)?
upl-1.0 | universal | universal permissive license( version| v)?( 1 0)?
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | (the )?unlicense
wtfpl | wtfpl | wtfpl
wtfpl | fuck | do what the fuck you want to public license
beerware | beer | beer ?ware license
zlib | altered | altered source versions must be plainly marked as such
zlib | zlib | zlib( libpng)? license
libpng | png | (png reference library|libpng) license( version 2)?
openssl | openssl | openssl license
sleepycat | sleepycat | sleepycat license
postgresql | postgresql | postgresql license
python-2.0 | python | python( software foundation)? license( version| v)?( 2( 0)?)?
psf-2.0 | psf | psf license( agreement)?
php-3.01 | php | php license( version| v)?( 3 01)?
ruby | ruby | ruby license
ruby | ruby | same terms as ruby( itself)?
vim | vim | vim license
curl | curl | curl license
tcl | tcl | tcl tk license
w3c | w3c | w3c software( notice)?( and)?( document)? license
icu | icu | icu license
unicode-dfs-2016 | unicode | unicode( inc)? license agreement
ijg | jpeg | independent jpeg group( s)? (license|software)
ftl | freetype | freetype( project)? license
ofl-1.1 | font | sil open font license( version| v)?( 1 1)?
ofl-1.1 | ofl | ofl ?v?1 1
lppl-1.3c | latex | latex project public license( version| v)? ?v?1 3c
lppl | latex | latex project public license
odbl-1.0 | database | open (data commons open )?database license( v?1 0)?
odc-by-1.0 | commons | open data commons attribution license( v?1 0)?
pddl-1.0 | dedication | public domain dedication and license( v?1 0)?
qpl-1.0 | public | q public license( version| v)?( 1 0)?
zpl-2.1 | zope | zope public license( version| v)?( 2 1)?
zend-2.0 | zend | zend license( version| v)?( 2 0)?
sgi-b-2.0 | sgi | sgi free software license b( version 2 0)?
spl-1.0 | sun | sun public license( version| v)?( 1 0)?
hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose
openldap | openldap | openldap public license( version| v)?( 2 8)?
artistic-or-gpl | artistic | (gpl|gnu general public license) or( the)? artistic license
openrail | rail | (bigscience|creativeml)( bloom)? open ?rail ?m?( license)?
llama-community | llama | llama( 2| 3)? community license( agreement)?
# addresses of license texts
gpl-3.0 | gnu | gnu org licenses gpl 3 0
gpl-2.0 | gnu | gnu org licenses( old licenses)? gpl 2 0
lgpl-3.0 | gnu | gnu org licenses lgpl 3 0
lgpl-2.1 | gnu | gnu org licenses( old licenses)? lgpl 2 1
agpl-3.0 | gnu | gnu org licenses agpl 3 0
gfdl-1.3 | gnu | gnu org licenses fdl 1 3
gnu-license-address | gnu | gnu org (licenses|copyleft)
apache-2.0 | apache | apache org licenses license 2 0
apache-address | apache | apache org licenses
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-address | creativecommons | creativecommons org (licenses|publicdomain)
mit | opensource | opensource org licenses mit( license)?
bsd-3-clause | opensource | opensource org licenses bsd 3 clause
bsd-2-clause | opensource | opensource org licenses bsd 2 clause
isc | opensource | opensource org licenses isc( license)?
osi-address | opensource | opensource org licenses
mpl-2.0 | mozilla | mozilla org mpl 2 0
mpl-2.0 | mozilla | mozilla org en us mpl 2 0
epl-2.0 | eclipse | eclipse org legal epl ?v?2 0
epl-1.0 | eclipse | eclipse org legal epl ?v?1 0
bsl-1.0 | boost | boost org license 1 0
unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl net
# statements that name no license
public-domain | domain | (released |placed |dedicated )?(in|into|to) the public domain
all-rights-reserved | reserved | all rights (are )?reserved
no-commercial-use | commercial | (for )?non ?commercial use only
no-commercial-use | commercial | may not be used for commercial purposes
proprietary | proprietary | (confidential and proprietary|proprietary and confidential)
proprietary | permission | no part of this (publication|work|document) may be reproduced( #){0,6} without( #){0,3} permission
as-is-warranty | warranty | without warranty of any kind
as-is-warranty | warranties | without warranties or conditions of any kind
copyleft-hint | copyleft | copyleft licen[cs]ed?
open-source-hint | open | open source licen[cs]ed?
licensed-hint | licen | (is |are )?licen[cs]ed under
license-file-hint | license | see( the)?( accompanying)? license( file)?( txt| md)?
license-file-hint | copying | see( the)? copying( file)?
copyright-line | copyright | copyright( c)? (19|20)\\d\\d
copyright-line | copyright | copyright( c)? ©
"""

#: How sure a detection of each section is that its label holds.
STRENGTH = {"base": 0.9, "tag": 0.98, "notice": 0.95, "address": 0.9, "hint": 0.3}
