"""Ordered signature rules of the license scan.

A rule is ``label | keyword | pattern``, one a line; earlier rules have priority. Texts
are matched as lower-case words with one space between them, so ``2.0`` is ``2 0`` and
``BY-NC`` is ``by nc``. ``~`` stands for up to four words of any kind (``~ ~``: eight).
The keyword is a
word that every match of the pattern holds; the pattern is tried only where it occurs.
Patterns use the syntax that Java and RE2 share.
"""

from __future__ import annotations

# confidence of a section, and its rules
SECTIONS: list[tuple[float, str]] = [
    # tags written for machines, and words of license texts themselves
    (1.0, """
agpl-3.0-only | identifier | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | identifier | spdx license identifier agpl 3 0 or later
lgpl-2.1-or-later | identifier | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | identifier | spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0-or-later | identifier | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | identifier | spdx license identifier lgpl 3 0(?: only)?
gpl-2.0-or-later | identifier | spdx license identifier gpl 2 0 or later
gpl-2.0-only | identifier | spdx license identifier gpl 2 0(?: only)?
gpl-3.0-or-later | identifier | spdx license identifier gpl 3 0 or later
gpl-3.0-only | identifier | spdx license identifier gpl 3 0(?: only)?
apache-2.0 | identifier | spdx license identifier apache 2 0
mit-0 | identifier | spdx license identifier mit 0
mit | identifier | spdx license identifier mit
bsd-2-clause | identifier | spdx license identifier bsd 2 clause
bsd-3-clause | identifier | spdx license identifier bsd 3 clause
0bsd | identifier | spdx license identifier 0bsd
isc | identifier | spdx license identifier isc
mpl-2.0 | identifier | spdx license identifier mpl 2 0
epl-2.0 | identifier | spdx license identifier epl 2 0
epl-1.0 | identifier | spdx license identifier epl 1 0
cddl-1.0 | identifier | spdx license identifier cddl 1 0
cc0-1.0 | identifier | spdx license identifier cc0 1 0
cc-by-4.0 | identifier | spdx license identifier cc by 4 0
cc-by-sa-4.0 | identifier | spdx license identifier cc by sa 4 0
unlicense | identifier | spdx license identifier unlicense
zlib | identifier | spdx license identifier zlib
bsl-1.0 | identifier | spdx license identifier bsl 1 0
wtfpl | identifier | spdx license identifier wtfpl
artistic-2.0 | identifier | spdx license identifier artistic 2 0
spdx-other | identifier | spdx license identifier [^ ]+
mit | sublicense | permission is hereby granted free of charge to any person obtaining a copy ~ ~ ~ ~ ~ without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | furnished | permit persons to whom the ~ is furnished to do so
mit | noninfringement | including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
hpnd | fee | permission to use copy modify and distribute this software and its documentation for any purpose ~ without fee is hereby granted
bsd-4-clause | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | endorse | neither the name of ~ ~ nor the names of ~ ~ may be used to endorse or promote products
bsd-2-clause | redistributions | redistributions of source code must retain the above copyright notice
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
zlib | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented
zlib | misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | executable | unless such copies or derivative works are solely in the form of machine executable object code
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
cc0-1.0 | waive | waive all copyright and related or neighboring rights
apache-2.0 | perpetual | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
gpl-2.0 | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document
gpl-3.0 | conveying | conveying (?:verbatim copies|modified source versions|non source forms)
lgpl-2.1 | lesser | this license the lesser general public license applies to some specially designated software packages
agpl-3.0 | affero | remote network interaction use with the gnu affero general public license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution license ~ cddl
ofl-1.1 | reserved | no modified version of the font software may use the reserved font name
openssl | openssl | this product includes software developed by the openssl project
"""),
    # notices: a grant that names the license
    (0.95, """
agpl-3.0-or-later | affero | gnu affero general public license ~ version 3 ~ ~ any later version
agpl-3.0 | affero | gnu affero general public license ~ ~ (?:version |v)3
agpl | affero | (?:licensed|released|distributed) under the ~ ~ affero general public license
lgpl-2.1-or-later | lesser | gnu lesser general public license ~ ~ ~ version 2 1 ~ ~ ~ any later version
lgpl-2.1 | lesser | gnu lesser general public license ~ ~ ~ (?:version |v)2 1
lgpl-3.0-or-later | lesser | gnu lesser general public license ~ ~ ~ version 3 ~ ~ ~ any later version
lgpl-3.0 | lesser | gnu lesser general public license ~ ~ ~ (?:version |v)3
lgpl-2.0 | library | gnu library general public license(?: ~ ~ version 2)?
gpl-3.0-or-later | gnu | gnu general public license ~ ~ ~ ~ version 3 (?:of the license )?or (?:at your option )?any later version
gpl-2.0-or-later | gnu | gnu general public license ~ ~ ~ ~ version 2 (?:of the license )?or (?:at your option )?any later version
gpl-1.0-or-later | gnu | gnu general public license ~ ~ ~ ~ version 1 (?:of the license )?or (?:at your option )?any later version
gpl-3.0 | gnu | (?:this work is |this program is )?(?:licensed|released|distributed|available) under the ~ gnu general public license (?:version |v )?(?:v)?3(?: 0)?
gpl-2.0 | gnu | (?:this work is |this program is )?(?:licensed|released|distributed|available) under the ~ gnu general public license (?:version |v )?(?:v)?2(?: 0)?
gpl-3.0 | gnu | gnu general public license (?:version |v )?(?:v)?3(?: 0)?
gpl-2.0 | gnu | gnu general public license (?:version |v )?(?:v)?2(?: 0)?
gpl-1.0 | gnu | gnu general public license (?:version |v )?(?:v)?1(?: 0)?
gpl | gnu | (?:licensed|released|distributed|available) under ~ ~ gnu general public license
gpl | gnu | redistribute it and or modify it under the terms of the gnu general public license
gfdl-1.3 | documentation | gnu free documentation license (?:version |v)?1 3
gfdl-1.2 | documentation | gnu free documentation license (?:version |v)?1 2
gfdl-1.1 | documentation | gnu free documentation license (?:version |v)?1 1
gfdl | documentation | (?:terms of|under) the gnu free documentation license
apache-2.0 | apache | licensed under the apache license (?:version |v )?(?:v)?2 0
apache-2.0 | apache | (?:released|distributed|available|provided) under ~ ~ apache (?:software )?license (?:version |v )?(?:v)?2(?: 0)?
apache-1.1 | apache | apache (?:software )?license (?:version |v )?(?:v)?1 1
apache-1.0 | apache | apache (?:software )?license (?:version |v )?(?:v)?1 0
apache-2.0 | apache | apache (?:software )?license (?:version |v )?(?:v)?2(?: 0)?
mit | mit | (?:licensed|released|distributed|available|provided|published) under ~ ~ mit(?: expat| style| x11)? license
mit | mit | (?:licensed|released|distributed|available|provided|published) under ~ mit
mit | mit | the mit license(?: mit)?
x11 | x11 | (?:licensed|released|distributed|available) under ~ ~ x11 license
bsd-3-clause | bsd | (?:licensed|released|distributed|available) under ~ ~ (?:3 clause|three clause|new|modified|revised) bsd(?: style)? license
bsd-2-clause | bsd | (?:licensed|released|distributed|available) under ~ ~ (?:2 clause|two clause|simplified|freebsd) bsd(?: style)? license
bsd-4-clause | bsd | (?:licensed|released|distributed|available) under ~ ~ (?:4 clause|four clause|original|old) bsd(?: style)? license
bsd-3-clause | bsd | bsd 3 clause(?: license)?
bsd-2-clause | bsd | bsd 2 clause(?: license)?
bsd-4-clause | bsd | bsd 4 clause(?: license)?
bsd | bsd | (?:licensed|released|distributed|available) under ~ ~ bsd(?: style)? license
isc | isc | (?:licensed|released|distributed|available) under ~ ~ isc license
mpl-2.0 | mozilla | mozilla public license (?:version |v )?(?:v)?2 0
mpl-1.1 | mozilla | mozilla public license (?:version |v )?(?:v)?1 1
mpl-1.0 | mozilla | mozilla public license (?:version |v )?(?:v)?1 0
mpl | mozilla | (?:licensed|released|distributed|available) under ~ ~ mozilla public license
epl-2.0 | eclipse | eclipse public license (?:version |v )?(?:v)?2(?: 0)?
epl-1.0 | eclipse | eclipse public license (?:version |v )?(?:v)?1(?: 0)?
edl-1.0 | eclipse | eclipse distribution license (?:version |v )?(?:v)?1(?: 0)?
cddl-1.1 | development | common development and distribution license ~ ~ 1 1
cddl-1.0 | development | common development and distribution license(?: ~ ~ 1 0)?
cpl-1.0 | common | common public license ~ (?:version |v)?1(?: 0)?
ipl-1.0 | ibm | ibm public license ~ (?:version |v)?1(?: 0)?
eupl-1.2 | european | european union public licen[cs]e ~ ~ 1 2
eupl-1.1 | european | european union public licen[cs]e ~ ~ 1 1
artistic-2.0 | artistic | artistic license (?:version |v )?(?:v)?2(?: 0)?
artistic-1.0 | artistic | artistic license (?:version |v )?(?:v)?1(?: 0)?
artistic | artistic | (?:licensed|released|distributed|available|terms) (?:under|of) ~ artistic license
bsl-1.0 | boost | boost software license(?: version)?(?: 1 0)?
busl-1.1 | business | business source license(?: ~ 1 1)?
elastic-2.0 | elastic | elastic license (?:version |v )?(?:v)?2(?: 0)?
sspl-1.0 | server | server side public license
zpl-2.1 | zope | zope public license(?: zpl)?(?: version)? 2 1
zpl-2.0 | zope | zope public license(?: zpl)?(?: version)? 2 0
psf-2.0 | python | python software foundation license(?: version 2)?
python-2.0 | python | (?:licensed|released|distributed|available) under the python license
php-3.01 | php | php license (?:version |v)?3 01
php-3.0 | php | php license (?:version |v)?3 0
ruby | ruby | (?:licensed|released|distributed|available) under ~ ruby license
postgresql | postgresql | postgresql licen[cs]e
openssl | openssl | openssl license
ncsa | illinois | university of illinois ncsa open source license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
w3c | w3c | w3c software (?:and document )?(?:notice and )?license
ofl-1.1 | sil | sil open font license(?: version)?(?: 1 1)?
unicode-dfs | unicode | unicode (?:data files and software )?license agreement
osl-3.0 | open | open software license (?:version |v )?(?:v)?3 0
afl-3.0 | academic | academic free license (?:version |v )?(?:v)?3 0
afl-2.1 | academic | academic free license (?:version |v )?(?:v)?2 1
qpl-1.0 | q | q public license(?: version)? 1 0
lppl-1.3c | latex | latex project public license(?: ~ 1 3c?)?
odbl-1.0 | database | open (?:data commons open )?database license(?: odbl)?
odc-by-1.0 | commons | open data commons attribution license
pddl-1.0 | commons | (?:open data commons )?public domain dedication and licen[cs]e ~ commons|open data commons public domain dedication
cecill-2.1 | cecill | cecill(?: free software license agreement)? (?:version |v)?2 1
cecill | cecill | (?:governed by|under) the cecill(?: [bc])? license
mulan-psl-2.0 | mulan | mulan psl(?: v)?2
openrail-m | rail | (?:open rail|responsible ai license rail) m license
openrail-m | openrail | (?:creativeml|bigscience|bigcode) ~ openrail m(?: license)?|creativeml openrail
llama-community | llama | llama (?:[0-9]+ )*community license(?: agreement)?
"""),
    # Creative Commons, longest first
    (0.9, """
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0(?: international)?
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0(?: unported)?
cc-by-nc-sa-2.5 | cc | cc by nc sa 2 5
cc-by-nc-sa-2.0 | cc | cc by nc sa 2 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0(?: international)?
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0(?: unported)?
cc-by-nc-nd-2.5 | cc | cc by nc nd 2 5
cc-by-nc-nd-2.0 | cc | cc by nc nd 2 0
cc-by-nc-4.0 | cc | (?:licensed under )?cc by nc 4 0(?: international)?
cc-by-nc-3.0 | cc | (?:licensed under )?cc by nc 3 0(?: unported)?
cc-by-nc-2.5 | cc | cc by nc 2 5
cc-by-nc-2.0 | cc | cc by nc 2 0
cc-by-nd-4.0 | cc | cc by nd 4 0(?: international)?
cc-by-nd-3.0 | cc | cc by nd 3 0(?: unported)?
cc-by-nd-2.5 | cc | cc by nd 2 5
cc-by-nd-2.0 | cc | cc by nd 2 0
cc-by-sa-4.0 | cc | cc by sa 4 0(?: international)?
cc-by-sa-3.0 | cc | cc by sa 3 0(?: unported)?
cc-by-sa-2.5 | cc | cc by sa 2 5
cc-by-sa-2.0 | cc | cc by sa 2 0
cc-by-4.0 | cc | cc by 4 0(?: international)?
cc-by-3.0 | cc | cc by 3 0(?: unported)?
cc-by-2.5 | cc | cc by 2 5
cc-by-2.0 | cc | cc by 2 0
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-sa | cc | cc by sa
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial share(?: )?alike 4 0(?: international)?
cc-by-nc-sa-3.0 | noncommercial | creative commons attribution noncommercial share(?: )?alike 3 0(?: unported)?
cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial no(?: )?deriv(?:ative)?s 4 0(?: international)?
cc-by-nc-nd-3.0 | noncommercial | creative commons attribution noncommercial no(?: )?deriv(?:ative)?s 3 0(?: unported)?
cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4 0(?: international)?
cc-by-nc-3.0 | noncommercial | creative commons attribution noncommercial 3 0(?: unported)?
cc-by-nc-sa | noncommercial | creative commons attribution noncommercial share(?: )?alike
cc-by-nc-nd | noncommercial | creative commons attribution noncommercial no(?: )?deriv(?:ative)?s
cc-by-nc | commercial | creative commons attribution non commercial
cc-by-nc | noncommercial | creative commons attribution noncommercial
cc-by-sa-4.0 | commons | creative commons attribution share(?: )?alike 4 0(?: international)?
cc-by-sa-3.0 | commons | creative commons attribution share(?: )?alike 3 0(?: unported)?
cc-by-sa | commons | creative commons attribution share(?: )?alike
cc-by-nd-4.0 | commons | creative commons attribution no(?: )?deriv(?:ative)?s 4 0(?: international)?
cc-by-nd | commons | creative commons attribution no(?: )?deriv(?:ative)?s
cc-by-4.0 | commons | creative commons attribution 4 0(?: international)?
cc-by-3.0 | commons | creative commons attribution 3 0(?: unported)?
cc-by | commons | creative commons attribution
cc0-1.0 | zero | creative commons zero
cc | commons | creative commons(?: licen[cs]ed?)?
cc-url | creativecommons | creativecommons org (?:licenses|publicdomain) [^ ]+
"""),
    # names of licenses without a grant
    (0.7, """
agpl-3.0 | agplv3 | agplv3
agpl | agpl | agpl(?: 3 0| 3)?
agpl | affero | affero general public license
lgpl-3.0 | lgplv3 | lgplv3
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
lgpl | lgpl | lgpl(?: 2 1| 3 0| 3)?
lgpl | lesser | lesser general public license
gpl-3.0 | gplv3 | gplv3
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gpl | gpl (?:version |v )?3(?: 0)?
gpl-2.0 | gpl | gpl (?:version |v )?2(?: 0)?
gpl | gpl | gpl licen[cs]ed?
gpl | gnu | gnu (?:general public license|gpl)
gfdl | gfdl | gfdl
apache | apache | apache (?:software )?licen[cs]ed?
apache-2.0 | apache | apache 2 0
mit | mit | mit licen[cs]ed?
mit | expat | expat license
bsd | bsd | bsd(?: style)? licen[cs]ed?
isc | isc | isc license
mpl | mozilla | mozilla public license
mpl-2.0 | mpl | mpl 2 0
mpl-1.1 | mpl | mpl 1 1
epl | eclipse | eclipse public license
epl-2.0 | epl | epl 2 0
cddl | cddl | cddl(?: 1 0| 1 1)?
eupl | eupl | eupl(?: 1 1| 1 2)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib(?: libpng)? license
artistic | artistic | artistic license
ofl-1.1 | ofl | ofl 1 1
odbl-1.0 | odbl | odbl(?: 1 0)?
psf-2.0 | psf | psf license
public-domain | domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain | domain | public domain(?: dedication| work)?
"""),
    # clues: terms of use without a license's name
    (0.4, """
commercial | proprietary | proprietary (?:and confidential|software|license|information)
commercial | confidential | confidential and proprietary
commercial | eula | end user license agreement eula|eula
commercial | agreement | (?:end user |software )license agreement
commercial | trademark | registered trademark of
no-redistribution | redistribution | redistribution ~ prohibited
no-redistribution | reproduced | may (?:not )?be reproduced ~ ~ without ~ ~ permission
no-redistribution | reproduction | reproduction ~ ~ is prohibited
no-commercial-use | commercial | (?:for )?non commercial use only|not for commercial use
no-commercial-use | noncommercial | noncommercial use only
research-only | research | (?:for )?research (?:use|purposes) only
no-derivatives | derivative | no derivative works
free-use | use | free (?:to|for) use ~ attribution
permission | permission | (?:used|reprinted|reproduced) (?:with|by) permission
dual-license | dual | dual licen[cs]ed
open-source | source | (?:licensed|released|distributed|available) under an? (?:free and )?open source license
open-source | osi | (?:licensed|released|distributed|available) under an? osi approved license
copyleft | copyleft | under a (?:strong |weak )?copyleft license
license-file | license | see (?:the )?license(?: txt| md)? (?:file )?for (?:more )?(?:details|information)
license-file | license | license information can be found
license-terms | license | subject to the (?:terms|following) ~ license
license-terms | license | by the terms of this license
licensed-under | licensed | licensed under (?:the )?[^ ]+
released-under | released | released under (?:the )?[^ ]+ licen[cs]e
copyright-statement | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
copyright-statement | copyright | copyright by [^ ]+
reserved | rights | (?:some|no) rights reserved
reserved | reserved | rights reserved by ~ author
reserved | droits | tous droits reserves|tous droits réservés
reserved | rechte | alle rechte vorbehalten
reserved | derechos | todos los derechos reservados
reserved | diritti | tutti i diritti riservati
reserved | direitos | todos os direitos reservados
"""),
]

# fixed values of the contract: phrase and label; confidence of a text with such places only
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_CONFIDENCE = 0.5


def rules() -> list[tuple[int, str, str, str, float]]:
    """``(priority, label, keyword, pattern, confidence)``, first priority 0."""
    out = []
    for confidence, lines in SECTIONS:
        for line in lines.strip().splitlines():
            label, keyword, pattern = (part.strip() for part in line.split(" | ", 2))
            out.append((len(out), label, keyword, pattern, confidence))
    return out
