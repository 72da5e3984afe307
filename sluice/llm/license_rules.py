"""Signature rules of the license scan, hand-written.

One rule a line: ``label | kind | keywords | regex``.  The regex runs over a
text's words, lower-cased and joined by single blanks, between word borders;
it is only tried where the text has one of the keywords (parted by ``; ``).
Whatever a regex matches holds one of its keywords, but for the rule of "the
free software foundation version 2", which other licenses of theirs fit too:
its keyword has to stand elsewhere in the text.  Kinds, by falling priority
and confidence: ``text`` (a sentence of the license itself), ``notice`` (a
grant naming the license), ``name`` (its full name with version), ``tag`` (a
machine-readable identifier or URL), ``hint`` (a loose mention).
"""

KINDS = {"text": (5, 1.0), "notice": (4, 0.95), "name": (3, 0.85), "tag": (3, 0.9), "hint": (1, 0.4)}

RULES = r"""
mit | text | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | sublicense and or sell | to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | text | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | notice | mit licen | (?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit | notice | mit | (?:is|are) mit licensed
mit | name | mit licen | (?:the )?mit licen[sc]e
mit | tag | mit | licenses? mit
mit | tag | mit | spdx license identifier mit
mit | tag | opensource org | opensource org licenses mit(?: license)?(?: php| html)?
mit | hint | expat | expat licen[sc]e
mit-0 | name | mit no attribution | mit no attribution(?: licen[sc]e)?
mit-0 | tag | mit 0 | (?:license|identifier) mit 0
x11 | name | x11 licen | x11 licen[sc]e
x11 | text | x consortium | except as contained in this notice the name of the x consortium shall not be used
isc | text | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | name | isc licen | (?:the )?isc licen[sc]e
isc | tag | isc | spdx license identifier isc
0bsd | name | zero clause bsd | (?:bsd )?zero clause bsd(?: licen[sc]e)?
0bsd | tag | 0bsd | (?:license|identifier) 0bsd
bsd-2 | text | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2 | name | bsd 2 clause | (?:the )?bsd 2 clause(?: simplified)?(?: licen[sc]e)?
bsd-2 | name | simplified bsd | (?:the )?simplified bsd licen[sc]e
bsd-2 | name | freebsd licen | freebsd licen[sc]e
bsd-2 | notice | 2 clause bsd | (?:under|by) (?:the )?(?:terms of the )?2 clause bsd licen[sc]e
bsd-3 | text | endorse or promote | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-3 | name | bsd 3 clause | (?:the )?bsd 3 clause(?: new| revised)?(?: licen[sc]e)?
bsd-3 | name | new bsd | (?:the )?new bsd licen[sc]e
bsd-3 | name | revised bsd | (?:the )?revised bsd licen[sc]e
bsd-3 | name | modified bsd | (?:the )?modified bsd licen[sc]e
bsd-3 | notice | 3 clause bsd | (?:under|by) (?:the )?(?:terms of the )?3 clause bsd licen[sc]e
bsd-3-clear | name | clear bsd | (?:the )?clear bsd licen[sc]e
bsd-4 | text | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 | name | bsd 4 clause | bsd 4 clause(?: licen[sc]e)?
bsd-4 | name | original bsd | original bsd licen[sc]e
bsd | notice | bsd licen; bsd style licen | (?:released|licensed|distributed|available) under (?:the |a )?bsd(?: style)? licen[sc]e
bsd | hint | bsd licen; bsd style licen | bsd(?: style)? licen[sc]e
apache-2 | text | www apache org licenses | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 | text | distributed on an as is basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2 | notice | apache licen | licen[sc]ed (?:to you )?under (?:the )?(?:terms of (?:the )?)?apache licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | notice | apache licen | (?:released|distributed|available|published) under (?:the )?apache licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | name | apache licen | apache licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | name | apache 2 | apache 2(?: 0)? licen[sc]ed?
apache-2 | name | apache software licen | apache software licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | tag | apache 2 0 | (?:license|identifier) apache 2 0
apache-2 | tag | apache org | apache org licenses license 2 0
apache-2 | name | asl 2; asl version 2 | asl (?:version )?2 0
apache-1.1 | name | apache software licen | apache software licen[sc]e (?:version |v )?1 1
apache-1.1 | text | apache software foundation | this product includes software developed by the apache software foundation http www apache org
apache-1.0 | name | apache licen; apache software licen | apache (?:software )?licen[sc]e (?:version |v )?1 0
apache | hint | apache licen | apache licen[sc]e
gpl-3 | text | of the license or at your option any later version | either version 3 of the license or at your option any later version
gpl-3 | notice | gnu general public licen | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-3 | name | gnu general public licen | gnu general public licen[sc]e (?:version |v )?3(?: 0)?
gpl-3 | name | gpl | (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: or later| only)?
gpl-3 | name | gplv3 | (?:gnu )?gplv3
gpl-3 | tag | gpl 3 0 | (?:license|identifier) gpl 3 0(?: or later| only)?
gpl-3 | tag | gnu org licenses | gnu org licenses gpl 3 0
gpl-2 | text | of the license or at your option any later version | either version 2 of the license or at your option any later version
gpl-2 | text | gnu general public licen | published by the free software foundation version 2
gpl-2 | notice | gnu general public licen | (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-2 | name | gnu general public licen | gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-2 | name | gpl | (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: or later| only)?
gpl-2 | name | gplv2 | (?:gnu )?gplv2
gpl-2 | tag | gpl 2 0 | (?:license|identifier) gpl 2 0(?: or later| only)?
gpl-2-classpath | notice | classpath exception | (?:gpl|gnu general public licen[sc]e) (?:[^ ]+ ){0,8}with (?:the )?classpath exception
gpl-1 | name | gnu general public licen | gnu general public licen[sc]e (?:version |v )?1(?: 0)?
gpl | notice | gnu general public licen | (?:licen[sc]ed|released|distributed|available|redistribute it and or modify it) under (?:the )?(?:terms of (?:the )?)?gnu general public licen[sc]e
gpl | hint | gnu general public licen | gnu general public licen[sc]e
gpl | hint | gpl | gnu gpl
lgpl-3 | name | lesser general public licen | (?:gnu )?lesser general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-3 | name | lgpl | (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-3 | name | lgplv3 | lgplv3
lgpl-3 | tag | lgpl 3 0 | (?:license|identifier) lgpl 3 0(?: or later| only)?
lgpl-2.1 | name | lesser general public licen | (?:gnu )?lesser general public licen[sc]e (?:version |v )?2 1
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl (?:version |v )?2 1
lgpl-2.1 | tag | lgpl 2 1 | (?:license|identifier) lgpl 2 1(?: or later| only)?
lgpl-2.1 | text | of the license or at your option any later version | either version 2 1 of the license or at your option any later version
lgpl-2 | name | library general public licen | (?:gnu )?library general public licen[sc]e(?: (?:version |v )?2(?: 0)?)?
lgpl | notice | gnu lesser general public licen | under (?:the )?(?:terms of (?:the )?)?gnu lesser general public licen[sc]e
lgpl | hint | lgpl | (?:gnu )?lgpl
agpl-3 | name | affero general public licen | (?:gnu )?affero general public licen[sc]e (?:version |v )?3(?: 0)?
agpl-3 | name | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3 | name | agplv3 | agplv3
agpl-3 | tag | agpl 3 0 | (?:license|identifier) agpl 3 0(?: or later| only)?
agpl | hint | affero general public licen | affero general public licen[sc]e
agpl-1 | name | affero general public licen | affero general public licen[sc]e (?:version |v )?1(?: 0)?
gfdl-1.3 | name | free documentation licen | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3
gfdl-1.2 | name | free documentation licen | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2
gfdl | text | invariant sections | with no invariant sections no front cover texts and no back cover texts
gfdl | hint | free documentation licen | (?:gnu )?free documentation licen[sc]e
mpl-2 | text | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | notice | mozilla public licen | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e (?:version |v )?2 0
mpl-2 | name | mozilla public licen | mozilla public licen[sc]e (?:version |v )?2 0
mpl-2 | name | mpl 2; mpl version 2; mpl v 2 | mpl (?:version |v )?2(?: 0)?
mpl-2 | tag | mozilla org | mozilla org mpl 2 0
mpl-1.1 | name | mozilla public licen | mozilla public licen[sc]e (?:version |v )?1 1
mpl-1.1 | name | mpl 1; mpl version 1; mpl v 1 | mpl (?:version |v )?1 1
mpl-1.0 | name | mozilla public licen | mozilla public licen[sc]e (?:version |v )?1 0
mpl | hint | mozilla public licen | mozilla public licen[sc]e
epl-2 | name | eclipse public licen | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-2 | tag | epl 2 0 | (?:license|identifier) epl 2 0
epl-1 | name | eclipse public licen | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl-1 | tag | epl v10 | eclipse org legal epl v10
edl-1 | name | eclipse distribution licen | eclipse distribution licen[sc]e(?: (?:version |v )?1 0)?
cpl-1 | name | common public licen | common public licen[sc]e (?:version |v )?1 0
ipl-1 | name | ibm public licen | ibm public licen[sc]e(?: (?:version |v )?1 0)?
cddl-1.0 | name | common development and distribution licen | common development and distribution licen[sc]e (?:version |v )?1 0
cddl-1.1 | name | common development and distribution licen | common development and distribution licen[sc]e (?:version |v )?1 1
cddl | hint | cddl | cddl
cpal-1 | name | common public attribution licen | common public attribution licen[sc]e(?: (?:version |v )?1 0)?
eupl-1.2 | name | european union public licen | european union public licen[sc]e (?:v |version )?1 2
eupl-1.1 | name | european union public licen | european union public licen[sc]e (?:v |version )?1 1
eupl | hint | eupl | eupl
cecill-2.1 | name | cecill | cecill (?:version |v )?2 1
cecill-b | name | cecill b | cecill b
cecill-c | name | cecill c | cecill c
cecill | hint | cecill | cecill
osl-3 | name | open software licen | open software licen[sc]e (?:version |v )?3 0
afl-3 | name | academic free licen | academic free licen[sc]e (?:version |v )?3 0
afl-2.1 | name | academic free licen | academic free licen[sc]e (?:version |v )?2 1
artistic-2 | name | artistic licen | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1 | name | artistic licen | artistic licen[sc]e (?:version |v )?1 0
artistic | hint | artistic licen | artistic licen[sc]e
perl | notice | same terms as perl | under the same terms as perl(?: itself)?
bsl-1 | name | boost software licen | boost software licen[sc]e(?: (?:version |v )?1 0)?
bsl-1 | tag | bsl 1 0 | (?:license|identifier) bsl 1 0
bsl-1 | tag | boost org | boost org license 1 0 txt
busl-1.1 | name | business source licen | business source licen[sc]e(?: (?:version |v )?1 1)?
zlib | text | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | name | zlib licen; zlib libpng licen | zlib(?: libpng)? licen[sc]e
libpng | name | libpng licen; png reference library licen | (?:the )?(?:png reference library|libpng) licen[sc]e
unlicense | text | public domain | this is free and unencumbered software released into the public domain
unlicense | name | the unlicense | the unlicense
unlicense | tag | unlicense org | unlicense org
wtfpl | name | do what the fuck | do what the fuck you want to public licen[sc]e
wtfpl | tag | wtfpl | wtfpl
beerware | name | beer ware | (?:the )?beer ware licen[sc]e
psf-2 | name | python software foundation licen | python software foundation licen[sc]e(?: (?:version |v )?2)?
psf-2 | name | psf licen | psf licen[sc]e(?: agreement)?
php-3.01 | name | php licen | php licen[sc]e (?:version |v )?3 01
php-3.01 | text | php software | this product includes php software freely available from
ruby | name | ruby licen | (?:the )?ruby licen[sc]e
ruby | notice | same terms as ruby | under the same terms as ruby
openssl | text | openssl project | this product includes software developed by the openssl project
openssl | name | openssl licen | openssl licen[sc]e
curl | name | curl licen | curl licen[sc]e
ncsa | name | university of illinois | university of illinois (?:ncsa )?open source licen[sc]e
ncsa | name | ncsa open source licen | ncsa open source licen[sc]e
postgresql | name | postgresql licen | (?:the )?postgresql licen[sc]e
w3c | name | w3c software | w3c software (?:notice and )?(?:and document )?licen[sc]e
unicode | name | unicode licen; unicode inc licen | unicode (?:inc )?licen[sc]e(?: agreement)?
icu | name | icu licen | icu licen[sc]e
ofl-1.1 | name | sil open font licen | sil open font licen[sc]e(?: (?:version |v )?1 1)?
ofl-1.1 | notice | open font licen | (?:licen[sc]ed|released|available) under (?:the )?(?:sil )?open font licen[sc]e
ofl-1.1 | tag | ofl 1 1 | (?:license|identifier) ofl 1 1
lppl-1.3c | name | latex project public licen | latex project public licen[sc]e(?: (?:version |v )?1 3c?)?
ms-pl | name | microsoft public licen | microsoft public licen[sc]e
ms-rl | name | microsoft reciprocal licen | microsoft reciprocal licen[sc]e
sspl-1 | name | server side public licen | server side public licen[sc]e(?: (?:version |v )?1)?
elastic-2 | name | elastic licen | elastic licen[sc]e (?:version |v )?2(?: 0)?
polyform-nc | name | polyform noncommercial | polyform noncommercial licen[sc]e(?: 1 0 0)?
commons-clause | notice | commons clause | commons clause(?: licen[sc]e)? condition
upl-1 | name | universal permissive licen | universal permissive licen[sc]e(?: (?:version |v )?1 0)?
mulan-2 | name | mulan psl | mulan psl (?:version |v )?2
mulan-2 | name | mulan permissive | mulan permissive software licen[sc]e (?:version |v )?2
odbl-1 | name | database licen | open (?:data commons )?(?:open )?database licen[sc]e(?: (?:version |v )?1 0)?
odbl-1 | tag | odbl | odbl(?: 1 0)?
odc-by-1 | name | open data commons attribution | open data commons attribution licen[sc]e(?: (?:version |v )?1 0)?
pddl-1 | name | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[sc]e
ogl-uk-3 | name | open government licen | open government licen[sc]e (?:version |v )?3 0
ogl-uk | hint | open government licen | open government licen[sc]e
etalab-2 | name | open licence; licence ouverte | (?:etalab )?(?:open licence|licence ouverte)(?: etalab)? (?:version |v )?2 0
cc0-1 | name | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1 | text | related or neighboring rights | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights
cc0-1 | tag | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm-1 | tag | publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-nc | notice | cc by nc | (?:licen[sc]ed|released|available|published|shared) under (?:a |the )?(?:creative commons )?cc by nc(?: [1-4] 0)?
cc-by-nc | name | cc by nc | cc by nc(?: [1-4] 0)?
cc-by-nc-4 | name | cc by nc | cc by nc 4 0
cc-by-nc | name | attribution noncommercial; attribution non commercial | (?:creative commons )?attribution non ?commercial(?: [1-4] 0)?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-nc | tag | licenses by nc | creativecommons org licenses by nc [1-4] 0
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [1-4] 0)?
cc-by-nc-sa | name | commercial sharealike; commercial share alike | (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc-sa | tag | by nc sa | creativecommons org licenses by nc sa [1-4] 0
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [1-4] 0)?
cc-by-nc-nd | name | noderiv; no deriv | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?
cc-by-nc-nd | tag | by nc nd | creativecommons org licenses by nc nd [1-4] 0
cc-by-sa-4 | name | cc by sa | cc by sa 4 0
cc-by-sa-3 | name | cc by sa | cc by sa 3 0
cc-by-sa | name | cc by sa | cc by sa(?: [1-4] 0)?
cc-by-sa | name | attribution sharealike; attribution share alike | (?:creative commons )?attribution share ?alike(?: [1-4] 0)?(?: international| generic| unported)?(?: licen[sc]e)?
cc-by-sa | tag | licenses by sa | creativecommons org licenses by sa [1-4] 0
cc-by-nd | name | cc by nd | cc by nd(?: [1-4] 0)?
cc-by-nd | name | noderiv; no deriv | (?:creative commons )?attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?
cc-by-nd | tag | licenses by nd | creativecommons org licenses by nd [1-4] 0
cc-by-4 | name | cc by 4 | cc by 4 0
cc-by-3 | name | cc by 3 | cc by 3 0
cc-by-2 | name | cc by 2 | cc by 2 [05]
cc-by | name | creative commons attribution | creative commons attribution(?: [1-4] 0)?(?: international| generic| unported)? licen[sc]e
cc-by | notice | cc by | (?:licen[sc]ed|released|available|published|shared) under (?:a |the )?(?:creative commons )?cc by(?: [1-4] 0)?
cc-by | tag | licenses by | creativecommons org licenses by [1-4] 0
creative-commons | hint | creative commons | creative commons licen[sc]e
public-domain | notice | public domain | (?:is|are|released|placed|dedicated) (?:in|into|to) the public domain
public-domain | hint | public domain | public domain
proprietary | notice | all rights reserved | all rights reserved(?: unauthorized copying| no part of)?
proprietary | notice | confidential | proprietary and confidential
proprietary | notice | may not be; must not be | (?:may not be|must not be) (?:reproduced|copied|distributed)(?: [^ ]+){0,8} without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
proprietary | notice | end user licen | end user licen[sc]e agreement
non-commercial | notice | commercial use | (?:not for|no|non) commercial use(?: only)?
non-commercial | notice | research purposes only | for (?:academic |non commercial )?research purposes only
llama-2 | name | llama 2 community licen | llama 2 community licen[sc]e(?: agreement)?
llama-3 | name | llama 3 community licen | (?:meta )?llama 3 community licen[sc]e(?: agreement)?
openrail-m | name | openrail; open rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m| ra il)?(?: licen[sc]e)?
rail | name | responsible ai licen | responsible ai licen[sc]e
gemma | name | gemma terms of use | gemma terms of use
jsonlicense | text | used for good | the software shall be used for good not evil
naumen | name | naumen public licen | naumen public licen[sc]e
zpl-2.1 | name | zope public licen | zope public licen[sc]e(?: zpl)? (?:version |v )?2 1
sleepycat | name | sleepycat licen | sleepycat licen[sc]e
qpl-1 | name | q public licen | q public licen[sc]e(?: (?:version |v )?1 0)?
sgi-b-2 | name | sgi free software licen | sgi free software licen[sc]e b(?: (?:version |v )?2 0)?
intel | name | intel open source licen | intel open source licen[sc]e
nvidia | name | nvidia software licen | nvidia software licen[sc]e(?: agreement)?
vim | name | vim licen | vim licen[sc]e
hpnd | name | historical permission notice | historical permission notice and disclaimer
ecl-2 | name | educational community licen | educational community licen[sc]e(?: (?:version |v )?2 0)?
blueoak-1 | name | blue oak model licen | blue oak model licen[sc]e(?: 1 0 0)?
parity-7 | name | parity public licen | (?:the )?parity public licen[sc]e(?: 7 0 0)?
hippocratic | name | hippocratic licen | hippocratic licen[sc]e(?: (?:version |v )?[1-3] [0-9])?
freetype | name | freetype licen; freetype project licen | freetype (?:project )?licen[sc]e
imagemagick | name | imagemagick licen | imagemagick licen[sc]e
unspecified | hint | licensed under; licenced under | licen[sc]ed under (?:the )?(?:[^ ]+ ){0,4}licen[sc]e
"""

#: Phrases of the base, whose places are counted: label and words.  Fixed values.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
