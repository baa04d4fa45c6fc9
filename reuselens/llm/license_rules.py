"""The signature rules of the license scan, in order: kind, label and a regular expression over normalised words with one space between them."""

from __future__ import annotations

#: Kind of a rule to its priority and confidence. Of overlapping detections the one of higher priority is taken first.
KINDS = {
    "tag": (90, 1.0),  # a machine-readable identifier
    "address": (80, 0.95),  # the address of a license
    "text": (75, 0.95),  # a clause of a license
    "grant": (70, 0.9),  # something is licensed under it
    "terms": (66, 0.85),  # its terms are referred to
    "field": (60, 0.8),  # a field that names it
    "version": (50, 0.7),  # its name with a version
    "name": (40, 0.6),  # its name alone
}

RULES = r"""
tag agpl  spdx license identifier agpl 3 0(?: only| or later)?
tag lgpl  spdx license identifier lgpl [23] [01](?: only| or later)?
tag gpl  spdx license identifier gpl [123] 0(?: only| or later)?(?: with [a-z]+(?: [a-z]+)? exception(?: [0-9] [0-9])?)?
tag gfdl  spdx license identifier gfdl 1 [123](?: no invariants| invariants)?(?: only| or later)?
tag apache  spdx license identifier apache (?:1 [01]|2 0)(?: with llvm exception)?
tag mit  spdx license identifier mit(?: 0| cmu| modern variant)?
tag mit  spdx license identifier apache 2 0 or mit
tag mit  spdx license identifier x11
tag bsd  spdx license identifier bsd [0-4] clause(?: clear| patent| attribution| lbnl)?
tag bsd  spdx license identifier 0bsd
tag isc  spdx license identifier isc
tag mpl  spdx license identifier mpl (?:1 [01]|2 0)(?: no copyleft exception)?
tag epl  spdx license identifier epl [12] 0
tag cddl  spdx license identifier cddl 1 [01]
tag cpl  spdx license identifier cpl 1 0
tag eupl  spdx license identifier eupl 1 [012]
tag artistic  spdx license identifier artistic [12] 0(?: perl| cl8)?
tag boost  spdx license identifier bsl 1 0
tag zlib  spdx license identifier zlib(?: acknowledgement)?
tag unlicense  spdx license identifier unlicense
tag wtfpl  spdx license identifier wtfpl
tag cc0  spdx license identifier cc0 1 0
tag cc-by-nc-nd  spdx license identifier cc by nc nd [1-4] [05]
tag cc-by-nc-sa  spdx license identifier cc by nc sa [1-4] [05]
tag cc-by-nc  spdx license identifier cc by nc [1-4] [05]
tag cc-by-nd  spdx license identifier cc by nd [1-4] [05]
tag cc-by-sa  spdx license identifier cc by sa [1-4] [05]
tag cc-by  spdx license identifier cc by [1-4] [05]
tag odbl  spdx license identifier odbl 1 0
tag ofl  spdx license identifier ofl 1 [01](?: rfn| no rfn)?
tag psf  spdx license identifier (?:psf 2 0|python 2 0(?: 1)?)
tag php  spdx license identifier php 3 0(?:1)?
tag postgresql  spdx license identifier postgresql
tag openssl  spdx license identifier openssl
tag ncsa  spdx license identifier ncsa
tag w3c  spdx license identifier w3c(?: 19980720| 20150513)?
tag ms-pl  spdx license identifier ms pl
tag ms-rl  spdx license identifier ms rl
tag osl  spdx license identifier osl [123] [01]
tag afl  spdx license identifier afl [123] [012]
tag upl  spdx license identifier upl 1 0
tag ecl  spdx license identifier ecl [12] 0
tag bsl  spdx license identifier busl 1 1
tag sspl  spdx license identifier sspl 1 0
tag elastic  spdx license identifier elastic 2 0
tag blueoak  spdx license identifier blueoak 1 0 0
tag mulan  spdx license identifier mulanpsl [12] 0
tag proprietary  spdx license identifier licenseref (?:proprietary|commercial)
tag bsd  license osi approved bsd license
tag mit  license osi approved mit license
tag apache  license osi approved apache software license
tag gpl  license osi approved gnu general public license(?: v[23](?: or later)?)?(?: gplv[23])?
tag lgpl  license osi approved gnu lesser general public license(?: v[23](?: or later)?)?
tag agpl  license osi approved gnu affero general public license(?: v3(?: or later)?)?
tag mpl  license osi approved mozilla public license(?: [12] [01])?
tag isc  license osi approved isc license
tag psf  license osi approved python software foundation license
tag gpl  module license gpl(?: v2)?
tag bsd  module license dual bsd gpl
tag mit  module license dual mit gpl
tag proprietary  module license proprietary
address agpl  gnu org licenses agpl(?: 3 0)?
address lgpl  gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: [23] [01])?
address gpl  gnu org (?:licenses|copyleft) (?:old licenses )?gpl(?: [123] 0)?
address gfdl  gnu org (?:licenses|copyleft) fdl(?: 1 [123])?
address apache  apache org licenses(?: license)?(?: 2 0| 1 1)?
address mit  opensource org licenses? mit(?: license)?
address mit  choosealicense com licenses mit
address apache  choosealicense com licenses apache 2 0
address gpl  choosealicense com licenses gpl [23] 0
address bsd  opensource org licenses? bsd(?: license| [23] clause)?
address isc  opensource org licenses? isc
address mpl  mozilla org (?:en us )?mpl(?: [12] [01])?
address epl  eclipse org (?:legal epl|org documents epl)(?: v10| v20| [12] 0)?
address edl  eclipse org org documents edl v10
address cddl  opensource org licenses? cddl(?: 1 0)?
address cpl  opensource org licenses? cpl(?: 1 0)?
address eupl  joinup ec europa eu (?:[a-z]+ ){0,4}eupl
address artistic  (?:opensource|perlfoundation) org (?:licenses? )?artistic license(?: [12] 0)?
address boost  boost org license 1 0
address zlib  zlib net zlib license
address unlicense  unlicense org
address wtfpl  wtfpl net
address cc0  creativecommons org publicdomain zero(?: 1 0)?
address public-domain  creativecommons org publicdomain mark(?: 1 0)?
address cc-by-nc-nd  creativecommons org licenses by nc nd(?: [1-4] [05])?
address cc-by-nc-sa  creativecommons org licenses by nc sa(?: [1-4] [05])?
address cc-by-nc  creativecommons org licenses by nc(?: [1-4] [05])?
address cc-by-nd  creativecommons org licenses by nd(?: [1-4] [05])?
address cc-by-sa  creativecommons org licenses by sa(?: [1-4] [05])?
address cc-by  creativecommons org licenses by(?: [1-4] [05])?
address odbl  opendatacommons org licenses odbl(?: 1 0)?
address odc-by  opendatacommons org licenses by(?: 1 0)?
address pddl  opendatacommons org licenses pddl(?: 1 0)?
address ofl  scripts sil org ofl
address ofl  openfontlicense org
address psf  docs python org (?:[0-9] )?license
address php  php net license(?: 3 01)?
address postgresql  postgresql org about licence
address openssl  openssl org source license
address sspl  mongodb com licensing server side public license
address elastic  elastic co licensing elastic license
address bsl  mariadb com bsl11
address llama  ai meta com (?:resources models and libraries )?llama (?:downloads|license)
address llama  llama com llama[23](?: [0-9])? license
address openrail  huggingface co spaces bigscience license
address w3c  w3 org consortium legal (?:[0-9]+ )?copyright software
address ms-pl  opensource org licenses? ms pl
address blueoak  blueoakcouncil org license 1 0 0
text mit  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text mit  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text mit  to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
text boost  permission is hereby granted free of charge to any person or organization obtaining a copy of the software
text isc  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text isc  the software is provided as is and the author disclaims all warranties with regard to this software
text postgresql  permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
text bsd  redistribution and use in source and binary forms with or without modification are permitted
text bsd  redistributions of source code must retain the above copyright notice
text bsd  redistributions in binary form must reproduce the above copyright notice
text bsd  neither the name of (?:the )?[a-z0-9 ]{1,60} nor the names of its contributors may be used to endorse or promote products
text bsd  all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
text openssl  this product includes software developed by the openssl project
text php  this product includes php software freely available from
text apache  unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
text apache  you may not use this file except in compliance with the license
text apache  you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
text apache  this product includes software developed by the apache (?:software foundation|group)
text gpl  this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
text gpl  you should have received a copy of the gnu general public license along with this program
text gpl  when we speak of free software we are referring to freedom not price
text gpl  free software foundation inc 51 franklin (?:street|st) fifth floor boston
text gpl  either version [23] of the license or at your option any later version
text lgpl  this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
text lgpl  you should have received a copy of the gnu (?:lesser|library) general public license
text lgpl  a program that contains no derivative of any portion of the library but is designed to work with the library
text agpl  you should have received a copy of the gnu affero general public license
text agpl  if your software can interact with users remotely through a computer network
text gfdl  permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
text gfdl  with no invariant sections no front cover texts and no back cover texts
text mpl  this source code form is subject to the terms of the mozilla public license
text mpl  the contents of this file are subject to the mozilla public license
text mpl  this source code form is incompatible with secondary licenses
text epl  this program and the accompanying materials are made available under the terms of the eclipse public license
text epl  the accompanying program is provided under the terms of this eclipse public license
text cpl  the accompanying program is provided under the terms of this common public license
text cddl  the contents of this file are subject to the terms of the common development and distribution license
text eupl  licensed under the eupl version 1 [12]
text zlib  altered source versions must be plainly marked as such and must not be misrepresented as being the original software
text zlib  this notice may not be removed or altered from any source distribution
text zlib  the origin of this software must not be misrepresented
text artistic  the intent of this document is to state the conditions under which a package may be copied
text artistic  this program is free software you can redistribute it and or modify it under the same terms as perl itself
text unlicense  this is free and unencumbered software released into the public domain
text unlicense  anyone is free to copy modify publish use compile sell or distribute this software
text wtfpl  you just do what the fuck you want to
text cc0  the person who associated a work with this deed has dedicated the work to the public domain
text cc0  to the extent possible under law [a-z0-9 ]{1,60} has waived all copyright and related or neighboring rights
text cc-by  this work is licensed under a creative commons attribution [1-4] [05] (?:international|generic|unported) license
text cc-by-sa  this work is licensed under a creative commons attribution share ?alike [1-4] [05] (?:international|generic|unported) license
text cc-by-nc  this work is licensed under a creative commons attribution noncommercial [1-4] [05] (?:international|generic|unported) license
text cc-by-nc-sa  this work is licensed under a creative commons attribution noncommercial share ?alike [1-4] [05] (?:international|generic|unported) license
text cc-by-nd  this work is licensed under a creative commons attribution no ?derivatives [1-4] [05] (?:international|generic|unported) license
text cc-by-sa  text is available under the creative commons attribution share ?alike license
text odbl  is made available under the open database license
text odbl  any rights in individual contents of the database are licensed under the database contents license
text ofl  this font software is licensed under the sil open font license version 1 1
text ofl  the font software may be modified altered or added to
text psf  psf is making python available to licensee on an as is basis
text ncsa  developed by [a-z0-9 ]{1,60} university of illinois
text w3c  by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
text ms-pl  if you use the software you accept this license if you do not accept the license do not use the software
text sspl  if you make the functionality of the program or a modified version available to third parties as a service
text bsl  the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
text elastic  you may not provide the software to third parties as a hosted or managed service
text llama  llama [234](?: [0-9])? is licensed under the llama [234](?: [0-9])? community license
text openrail  use based restrictions as referenced in paragraph 5
text blueoak  everyone who gets any part of this software from you with or without changes must also get the text of this license
text public-domain  i the copyright holder of this work release this work into the public domain
text public-domain  (?:this (?:file|work|code) is|has been|is hereby) (?:dedicated to|released into|placed in|in) the public domain
text proprietary  unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|program)
text proprietary  this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)
text proprietary  no part of this (?:publication|document|book) may be reproduced
grant agpl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:gnu )?(?:affero general public license|agpl)(?: (?:version |v ?)?3(?: 0)?)?
grant lgpl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: (?:version |v ?)?[23](?: [01])?)?
grant gpl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:general public license|gpl)(?: (?:version |v ?)?[123](?: 0)?)?
grant gfdl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:gnu free documentation license|gfdl)
grant apache  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?apache (?:software |public )?(?:license|2 0)(?: version)?(?: 2(?: 0)?| 1 [01])?
grant mit  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:mit|expat|x11)(?: license)?
grant bsd  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the |a )?(?:terms of (?:the )?)?(?:new |modified |simplified |[234] clause |(?:two|three|four) clause )?bsd(?: style)?(?: [234] clause)?(?: license)?
grant isc  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?isc license
grant mpl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:mozilla public license|mpl)(?: (?:version |v ?)?[12] [01])?
grant epl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:eclipse public license|epl)(?: (?:version |v ?)?[12] 0)?
grant cddl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:terms of (?:the )?)?(?:common development and distribution license|cddl)
grant eupl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:european union public licen[cs]e|eupl)
grant artistic  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:perl )?artistic license(?: [12] 0)?
grant boost  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?boost software license(?: version)?(?: 1 0)?
grant zlib  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?zlib(?: libpng)? license
grant unlicense  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?unlicense
grant cc0  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?
grant cc-by-nc-nd  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?cc by nc nd(?: [1-4] [05])?
grant cc-by-nc-sa  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?cc by nc sa(?: [1-4] [05])?
grant cc-by-nc  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?cc by nc(?: [1-4] [05])?
grant cc-by-nd  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?cc by nd(?: [1-4] [05])?
grant cc-by-sa  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?cc by sa(?: [1-4] [05])?
grant cc-by  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:a |the )?(?:cc by|creative commons attribution)(?: [1-4] [05])?
grant odbl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:open database license|odbl)
grant ofl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:sil )?(?:open font license|ofl)(?: 1 [01])?
grant psf  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:python software foundation|psf) license
grant bsl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?business source license(?: 1 1)?
grant sspl  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?(?:server side public license|sspl)
grant elastic  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?elastic license(?: 2 0)?
grant mulan  (?:licensed|released|distributed|available|published|provided)(?: [a-z]+)? under (?:the )?mulan psl v?[12]
terms gpl  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?(?:gnu )?(?:general public license|gpl)
terms lgpl  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?(?:gnu )?(?:(?:lesser|library) general public license|lgpl)
terms agpl  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?(?:gnu )?(?:affero general public license|agpl)
terms apache  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?apache license
terms mit  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?mit license
terms bsd  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?bsd license
terms mpl  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?mozilla public license
terms epl  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?eclipse public license
terms cc-by  (?:under|subject to|by) the terms(?: and conditions)? of (?:the )?creative commons attribution license
field gpl  licen[cs]e (?:the )?(?:gnu )?gpl(?: ?v?[123](?: 0)?)?(?: only| or later)?
field gpl  licen[cs]e gplv[123]
field lgpl  licen[cs]e (?:the )?(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?(?: only| or later)?
field agpl  licen[cs]e (?:the )?(?:gnu )?agpl(?: ?v?3(?: 0)?)?(?: only| or later)?
field apache  licen[cs]e (?:the )?apache(?: 2 0| license)?
field apache  licen[cs]e asl 2 0
field mit  licen[cs]e (?:the )?mit
field bsd  licen[cs]e (?:the )?bsd(?: [0234] clause)?
field isc  licen[cs]e (?:the )?isc
field mpl  licen[cs]e (?:the )?mpl [12] [01]
field epl  licen[cs]e (?:the )?epl [12] 0
field cddl  licen[cs]e (?:the )?cddl
field zlib  licen[cs]e (?:the )?zlib
field boost  licen[cs]e (?:the )?(?:bsl|boost) 1 0
field unlicense  licen[cs]e (?:the )?unlicense
field wtfpl  licen[cs]e (?:the )?wtfpl
field cc0  licen[cs]e (?:the )?cc0
field cc-by-sa  licen[cs]e (?:the )?cc by sa(?: [1-4] [05])?
field cc-by  licen[cs]e (?:the )?cc by(?: [1-4] [05])?
field proprietary  licen[cs]e (?:proprietary|commercial|unlicensed)
field openrail  licen[cs]e (?:creativeml |bigscience |bigcode )?openrail(?: m)?
field llama  licen[cs]e llama[234](?: [0-9])?
version gpl  gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version |v)?[123](?: 0)?
version lgpl  gnu (?:lesser|library) general public license (?:version |v)?[23](?: [01])?
version agpl  (?:gnu )?affero general public license (?:version |v)?3(?: 0)?
version gfdl  gnu free documentation license (?:version |v)?1 [123]
version apache  apache(?: software)? license (?:version |v)?(?:2(?: 0)?|1 [01])
version mpl  mozilla public license (?:version |v)?[12] [01]
version epl  eclipse public license (?:version |v)?[12](?: 0)?
version edl  eclipse distribution license (?:version |v)?1 0
version cddl  common development and distribution license (?:cddl )?(?:version |v)?1 [01]
version cpl  common public license (?:version |v)?1 0
version eupl  european union public licen[cs]e (?:version |v)?1 [012]
version artistic  artistic license (?:version |v)?[12] 0
version boost  boost software license (?:version |v)?1 0
version cc-by-nc-nd  cc by nc nd [1-4] [05]
version cc-by-nc-sa  cc by nc sa [1-4] [05]
version cc-by-nc  cc by nc [1-4] [05]
version cc-by-nd  cc by nd [1-4] [05]
version cc-by-sa  cc by sa [1-4] [05]
version cc-by  cc by [1-4] [05]
version ofl  sil open font license (?:version |v)?1 [01]
version php  php license (?:version |v)?3 0[01]?
version ecl  educational community license (?:version |v)?[12] 0
version osl  open software license (?:version |v)?[123] 0
version afl  academic free license (?:version |v)?[123] [012]
version upl  universal permissive license (?:version |v)?1 0
version bsl  business source license (?:version |v)?1 1
version sspl  server side public license (?:version |v)?1
version elastic  elastic license (?:version |v)?2(?: 0)?
version llama  llama [234](?: [0-9])? community license
name agpl  (?:gnu )?affero general public license
name lgpl  gnu (?:lesser|library) general public license
name gpl  gnu general public license
name gpl  gplv[123]
name gpl  gnu gpl
name gfdl  gnu free documentation license
name apache  apache(?: software| public)? license
name mit  mit(?: x11)? license
name mit  expat license
name bsd  (?:new |modified |simplified |revised |original )?bsd license
name bsd  (?:two|three|four|[0234]) clause bsd
name isc  isc license
name mpl  mozilla public license
name epl  eclipse public license
name edl  eclipse distribution license
name cddl  common development and distribution license
name cpl  common public license
name eupl  european union public licen[cs]e
name artistic  artistic license
name boost  boost software license
name zlib  zlib(?: libpng)? license
name unlicense  the unlicense
name wtfpl  do what the fuck you want to public license
name cc0  cc0(?: 1 0)?(?: universal)?
name cc0  creative commons zero
name cc-by-nc-nd  cc by nc nd
name cc-by-nc-nd  creative commons attribution noncommercial no ?deriv(?:ative)?s
name cc-by-nc-sa  cc by nc sa
name cc-by-nc-sa  creative commons attribution noncommercial share ?alike
name cc-by-nc  cc by nc
name cc-by-nc  creative commons attribution noncommercial
name cc-by-nd  cc by nd
name cc-by-nd  creative commons attribution no ?deriv(?:ative)?s
name cc-by-sa  cc by sa
name cc-by-sa  creative commons attribution share ?alike
name cc-by  cc by
name cc-by  creative commons attribution
name odbl  open (?:data commons open )?database license
name odc-by  open data commons attribution license
name pddl  public domain dedication and licen[cs]e
name ofl  (?:sil )?open font license
name psf  python software foundation license
name php  php license
name ruby  ruby license
name postgresql  postgresql license
name openssl  openssl license
name ncsa  university of illinois (?:ncsa )?open source license
name w3c  w3c software(?: notice and)? license
name ms-pl  microsoft public license
name ms-rl  microsoft reciprocal license
name osl  open software license
name afl  academic free license
name upl  universal permissive license
name ecl  educational community license
name bsl  business source license
name sspl  server side public license
name elastic  elastic license
name openrail  (?:bigscience |creativeml |bigcode )open ?rail(?: m)?(?: license)?
name mulan  mulan permissive software license
name blueoak  blue oak model license
name proprietary  proprietary and confidential
name proprietary  all rights reserved
"""
