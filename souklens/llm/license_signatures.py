"""Hand-written signatures of license texts and notices, in the order in which they win.

A line is a label and a regular expression over words in canonical form (a-z, 0-9, one blank between, no punctuation). The
first block holds sentences that stand in one license or family only, the second grants and notices in files and
manifests, the third clauses that many licenses share.
"""

from __future__ import annotations

# fixed values: sentences of public license texts
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
mit: to deal in the (?:software|materials|font software) without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell
mit: the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit: in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
mit: the software is provided as is without warranty of any kind express or implied
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
x11: except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
isc: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc: the software is provided as is and (?:the author|isc|[^ ]+ [^ ]+) disclaims all warranties with regard to this software
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
hpnd: provided that the above copyright notice appears? in all copies and that both that(?: the)? copyright notice and this permission notice appear in supporting documentation
ntp: permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
bsd: redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd: neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd: this software is provided by (?:[^ ]+ ){1,12}as is and any express or implied warranties including but not limited to
bsd: in no event shall (?:[^ ]+ ){1,12}be liable for any direct indirect incidental special exemplary or consequential damages
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-clear: no express or implied licenses to any party s patent rights are granted by this license
bsd-patent: each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable
apache: unless required by applicable law or agreed to in writing(?: licensor provides)? (?:software distributed under the license|the work)
apache: licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache: you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0
apache: see the license for the specific language governing permissions and limitations under the license
apache: terms and conditions for use reproduction and distribution 1 definitions
apache: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) license
apache: if the work includes a notice text file as part of its distribution
apache-1-1: this product includes software developed by the apache software foundation
apache-1-1: products derived from this software may not be called apache nor may apache appear in their name
apache-1-0: this product includes software developed by the apache group for use in the apache http server project
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl: [^ ]+ is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl: you should have received a copy of the gnu general public license along with (?:this program|[^ ]+)
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl: gnu general public license version [123](?: 0)? (?:[^ ]+ ){1,4}(?:1989|1991|2007)
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl: the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change(?: it|the works)?
gpl: the gnu general public license is a free copyleft license for software and other kinds of works
gpl: you may copy and distribute verbatim copies of the program s source code as you receive it
gpl: this general public license does not permit incorporating your program into proprietary programs
gpl-exception: as a special exception (?:[^ ]+ ){1,40}permission to link
gpl-classpath: linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-gcc-exception: gcc runtime library exception
gpl-bison-exception: as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-font-exception: as a special exception if you create a document which uses this font
gpl-autoconf-exception: if you distribute this file as part of a program that contains a configuration script generated by autoconf
lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl: this is the first released version of the (?:lesser|library) gpl
lgpl: this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl: a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl: combined work is a work produced by combining or linking an application with the library
agpl: you should have received a copy of the gnu affero general public license along with
agpl: under the terms of the gnu affero general public license as published by the free software foundation
agpl: the gnu affero general public license is designed specifically to ensure cooperation with the community in the case of network server software
agpl: your modified version must prominently offer all users interacting with it remotely through a computer network
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gfdl: the purpose of this license is to make a manual textbook or other functional and useful document free
mpl: this source code form is subject to the terms of the mozilla public license v 2 0
mpl: if a copy of the mpl was not distributed with this file you can obtain one at
mpl: the contents of this file are subject to the mozilla public license version 1 [01]
mpl: this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl: alternatively the contents of this file may be used under the terms of (?:either )?the gnu (?:lesser )?general public license
npl: the contents of this file are subject to the netscape public license
epl: this program and the accompanying materials are made available under the terms of the eclipse public license
epl: the accompanying program is provided under the terms of this eclipse public license
edl: this program and the accompanying materials are made available under the terms of the eclipse distribution license
cpl: the accompanying program is provided under the terms of this common public license
ipl: the accompanying program is provided under the terms of this ibm public license
cddl: the contents of this file are subject to the terms of the common development and distribution license
cddl: you can obtain a copy of the license at (?:[^ ]+ ){1,6}cddl
cddl: when distributing covered code include this cddl header in each file
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib: this notice may not be removed or altered from any source distribution
libpng: the contributing authors and group 42 inc disclaim all warranties expressed or implied
ijg: this software is based in part on the work of the independent jpeg group
boost: distributed under the boost software license version 1 0
boost: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense: in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
cc0: to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights
cc0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0: the person who associated a work with this deed has dedicated the work to the public domain
cc-by: this work is licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international| unported)? license
cc-by-sa: this work is licensed under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc: this work is licensed under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc-sa: this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nc-nd: this work is licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-nd: this work is licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by: creativecommons org licenses by [1-4] [05]
cc-by-sa: creativecommons org licenses by sa [1-4] [05]
cc-by-nc: creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa: creativecommons org licenses by nc sa [1-4] [05]
cc-by-nd: creativecommons org licenses by nd [1-4] [05]
cc-by-nc-nd: creativecommons org licenses by nc nd [1-4] [05]
cc0: creativecommons org publicdomain zero 1 0
cc-by: by exercising the licensed rights (?:[^ ]+ ){1,10}you accept and agree to be bound by the terms and conditions of this creative commons
artistic: the intent of this document is to state the conditions under which a package may be copied
artistic: this is free software you can redistribute it and or modify it under (?:the same terms as perl itself|the terms of (?:either )?the artistic license)
artistic: this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes
python: this license agreement is between the python software foundation psf and the individual or organization licensee
python: psf is making python available to licensee on an as is basis
python: beopen python open source license agreement
python: cnri open source license agreement
php: this product includes php software freely available from
php: products derived from this software may not be called php nor may php appear in their name
ruby: you may redistribute and use this software under the same terms as ruby
ruby: [^ ]+ is copyrighted free software by (?:[^ ]+ ){1,8}you can redistribute it and or modify it under either the terms of
postgresql: in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: the openssl toolkit stays under a (?:dual|double) license
ssleay: this product includes cryptographic software written by eric young
openssl-exception: permission to link the code of portions of this program with the openssl library
ofl: this font software is licensed under the sil open font license version 1 1
ofl: the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
ofl: no modified version of the font software may use the reserved font name
ofl: the fonts including any derivative works can be bundled embedded redistributed and or sold with any software
ubuntu-font: this licence allows the licensed fonts to be used studied modified and redistributed freely
bitstream-vera: the font software may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified
eupl: licensed under the eupl(?: version)?(?: v)? ?1 [012]
eupl: this european union public licence the eupl applies to the work
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
ms-rl: for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file
ms-lpl: this license governs use of the accompanying software (?:[^ ]+ ){1,40}platform limitation
osl: licensed under the open software license version [123] [01]
afl: licensed under the academic free license version [123] [01]
upl: subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
wtfpl: do what the fuck you want to public license
wtfpl: you just do what the fuck you want to
ncsa: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
ncsa: neither the names of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
ncsa: developed by (?:[^ ]+ ){1,12}permission is hereby granted free of charge
llvm-exception: as an exception if as a result of your compiling your source code portions of this software are embedded into an object form
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
w3c: this work is being provided by the copyright holders under the following license
w3c: permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
odbl: this (?:[^ ]+ )?database is made available under the open database license
odc-by: this (?:[^ ]+ )?database is made available under the open data commons attribution license
pddl: this (?:[^ ]+ )?database is made available under the public domain dedication and license
sspl: if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
elastic: you may not provide the software to third parties as a hosted or managed service
busl: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl: business source license(?: version)? 1 1
commons-clause: the software is provided to you by the licensor under the license as defined below subject to the following condition
commons-clause: the grant of rights under the license will not include and the license does not grant to you the right to sell the software
polyform: the licensor grants you a copyright license for the software to do everything you might do with the software
polyform-nc: any noncommercial purpose is a permitted purpose
vim: there are no restrictions on distributing unmodified copies of vim
lppl: this work may be distributed and or modified under the conditions of the latex project public license
lppl: this work has the lppl maintenance status
beerware: as long as you retain this notice you can do whatever you want with this stuff
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer in return
json: the software shall be used for good not evil
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
icu: unicode inc (?:hereby )?grants? the right to freely use the information supplied in this file
unicode: unicode license agreement data files and software
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
tcl: the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
fsfap: copying and distribution of this file with or without modification are permitted in any medium without royalty
fsful: this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it
fsfullr: this file is free software the free software foundation gives unlimited permission to copy and or distribute it with or without modifications
install-sh: calling this script install sh is preferred over install sh to prevent make implicit rules (?:[^ ]+ ){1,60}permission
ftl: portions of this software are copyright (?:[^ ]+ ){1,6}the freetype project
ftl: the freetype project is copyright
imagemagick: licensed under the imagemagick license
intel: intel open source license
nvidia: nvidia corporation and its licensors retain all intellectual property and proprietary rights in and to this software
qpl: the q public license version 1 0
sgi-b: sgi free software license b
sun-bcl: sun microsystems inc binary code license agreement
sun-rpc: sun rpc is a product of sun microsystems inc and is provided for unrestricted use provided that this legend is included
rpl: reciprocal public license version 1 [135]
rsa-md5: license to copy and use this software is granted provided that it is identified as the rsa data security inc md5 message digest algorithm
zpl: zope public license(?: zpl)?(?: version)? [12] [01]
watcom: sybase open watcom public license version 1 0
apsl: the contents of this file constitute original code as defined in and that are subject to the apple public source license
apsl: this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license
apple-sample: in consideration of your agreement to the following terms and your use installation modification or redistribution of this apple software constitutes acceptance
nasa: nasa open source agreement version 1 [13]
cecill: this software is governed by the cecill(?: [bc])? license under french law
mulan: [^ ]+ is licensed under mulan psl v[12]
blueoak: each contributor licenses you to do everything with this software that would otherwise infringe that contributor s copyright
hippocratic: the software shall not be used by any person or entity for any systems activities or other uses that violate any human rights laws
openrail: open responsible ai license
openrail: you agree not to use the model or derivatives of the model (?:in any way that|to)
llama: (?:meta )?llama [234](?: [123])? (?:is licensed under the (?:llama [234](?: [123])? )?)?community license
gemma: gemma is provided under and subject to the gemma terms of use
"""

# fixed values: grants and notices in files, manifests and answers
NOTICES = """
gpl-or-later: either version [123] of the license or at your option any later version
gpl-only: under the terms of (?:version [23] of the gnu general public license|the gnu general public license version [23]) only
dual: (?:dual|double|triple) licen[cs]ed under
dual: may be distributed under either (?:license|of these licenses)
dual: licensed under either of (?:[^ ]+ ){1,8}at your option
contribution: unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work
bsd: use of this source code is governed by a bsd style license that can be found in the license file
mit: use of this source code is governed by an mit style license that can be found in the license file
apache: (?:use of this source code|this file) is governed by (?:an|the) apache(?: 2 0)? license
mit: released under the mit licen[cs]e
mit: mit licen[cs]ed
mit: opensource org licenses mit
bsd: opensource org licenses bsd [0-4] clause
isc: opensource org licenses isc
apache: www apache org licenses license [12] [01]
gpl: www gnu org licenses(?: old licenses)? gpl [123] 0
lgpl: www gnu org licenses(?: old licenses)? lgpl [23] [01]
agpl: www gnu org licenses agpl 3 0
mpl: (?:www )?mozilla org mpl(?: mpl)? [12] [01]
epl: www eclipse org legal epl v ?[12]0 html
boost: www boost org license 1 0 txt
unlicense: (?:refer to )?unlicense org
ofl: scripts sil org ofl
osi-approved: license osi approved
mit: license osi approved mit license
bsd: license osi approved bsd license
apache: license osi approved apache software license
gpl: license osi approved gnu general public license(?: v[23])?(?: or later)?
lgpl: license osi approved gnu lesser general public license(?: v[23])?(?: or later)?
mpl: license osi approved mozilla public license
isc: license osi approved isc license
mit: license(?: type)? mit
apache: license(?: type)? apache(?: 2 0)?
isc: license(?: type)? isc
unlicensed: license(?: type)? unlicensed
proprietary: (?:is|contains) (?:the )?confidential(?: and proprietary)? (?:information|property|and)
proprietary: (?:is|contains) (?:the )?proprietary(?: and confidential)? (?:information|property|and)
proprietary: unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))* of (?:this|the) (?:file|software|program|document|material)
proprietary: no part of this (?:publication|document|work|book|software) may be reproduced
proprietary: this software is licensed not sold
proprietary: end user licen[cs]e agreement
proprietary: by (?:installing|using|downloading)(?: copying)?(?: or (?:installing|using|downloading))? (?:the|this) software you agree to be bound by
proprietary: licensed material(?:s)? property of ibm
evaluation: for (?:evaluation|trial|demonstration) (?:purposes|use) only (?:[^ ]+ ){0,12}licen[cs]e
noncommercial: for (?:non ?commercial|personal|educational|research|academic)(?: (?:or|and) (?:non ?commercial|personal|educational|research|academic))* (?:use|purposes) only (?:[^ ]+ ){0,12}licen[cs]e
noncommercial: may not be used for commercial purposes (?:[^ ]+ ){0,12}permission
public-domain: (?:is|are)(?: hereby)? (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain: (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain: (?:this (?:file|code|software|work|program) is|author has placed this code) in the public domain
public-domain: no copyright is claimed in the united states
us-government: this (?:is|software is|work is) a work of the (?:u s|united states) government
copyleft: (?:this|the) (?:work|software|program|license) is copyleft
"""

# fixed values: clauses that many licenses share
CLAUSES = """
proprietary: all rights reserved
warranty: without any warranty without even the implied warranty
warranty: the implied warranties of merchantability(?: and)?(?: or)? fitness for a particular purpose
warranty: (?:this|the) (?:software|program|work|material) is provided as is without (?:any )?warranty
warranty: there is no warranty for the program to the extent permitted by applicable law
liability: even if advised of the possibility of such damages?
liability: in no event (?:shall|will) (?:[^ ]+ ){1,20}be liable (?:to you )?for
permission: permission is (?:hereby )?granted to (?:copy|use|anyone|any person|make)
permission: (?:use|copying|distribution|redistribution)(?: and (?:use|copying|distribution|redistribution))? (?:is|are) permitted
permission: without (?:specific )?prior written permission
permission: may be (?:freely )?(?:used|copied|distributed|redistributed)(?: and(?: or)? (?:used|copied|modified|distributed|redistributed))* (?:with|under|subject to|provided)(?: that)? (?:[^ ]+ ){0,8}licen[cs]e
permission: by permission of the copyright (?:holder|owner)s?
copyright-notice: (?:the|this) (?:above )?copyright notice (?:and this permission notice )?(?:must|shall|may not) be (?:included|retained|preserved|removed)
patent: patent licen[cs]e is granted
"""


def signatures() -> list[tuple[str, str, float]]:
    """(label, pattern, weight) in order."""
    blocks = ((TEXTS, 1.0), (NOTICES, 0.95), (CLAUSES, 0.6))
    return [(*line.split(": ", 1), weight) for block, weight in blocks for line in block.strip().splitlines()]
