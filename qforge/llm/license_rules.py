"""Signature rules of the license scan, in the order in which they rank.

A line is ``kind label keyword pattern``; ``_`` in a keyword stands for a
blank.  Patterns are regular expressions over a text's words, lower-cased and
joined by single blanks ("GPL-2.0+" reads ``gpl 2 0``), and match whole words
only.  Every match of a pattern holds its keyword.  Kinds in falling priority:
``tag`` (machine-readable tags), ``text`` (sentences of the license itself),
``notice`` (a grant that names the license), ``name`` (full names, addresses)
and ``mention`` (short names).
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: kind -> (priority, confidence)
KINDS = {"tag": (50, 1.0), "text": (40, 0.95), "notice": (30, 0.9), "name": (20, 0.75), "mention": (10, 0.5)}

#: phrase -> label; these hold whatever other rules say
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

RULES_TEXT = r"""
tag gpl-1.0-only spdx_license_identifier spdx license identifier gpl 1 0(?: only)?
tag gpl-2.0-or-later spdx_license_identifier spdx license identifier gpl 2 0 or later
tag gpl-2.0-only spdx_license_identifier spdx license identifier gpl 2 0(?: only)?
tag gpl-3.0-or-later spdx_license_identifier spdx license identifier gpl 3 0 or later
tag gpl-3.0-only spdx_license_identifier spdx license identifier gpl 3 0(?: only)?
tag lgpl-2.0-only spdx_license_identifier spdx license identifier lgpl 2 0(?: only)?
tag lgpl-2.1-or-later spdx_license_identifier spdx license identifier lgpl 2 1 or later
tag lgpl-2.1-only spdx_license_identifier spdx license identifier lgpl 2 1(?: only)?
tag lgpl-3.0-or-later spdx_license_identifier spdx license identifier lgpl 3 0 or later
tag lgpl-3.0-only spdx_license_identifier spdx license identifier lgpl 3 0(?: only)?
tag agpl-3.0-or-later spdx_license_identifier spdx license identifier agpl 3 0 or later
tag agpl-3.0-only spdx_license_identifier spdx license identifier agpl 3 0(?: only)?
tag gfdl-1.3 spdx_license_identifier spdx license identifier gfdl 1 3(?: only| or later)?
tag apache-2.0 spdx_license_identifier spdx license identifier apache 2 0
tag apache-1.1 spdx_license_identifier spdx license identifier apache 1 1
tag mit-0 spdx_license_identifier spdx license identifier mit 0
tag mit spdx_license_identifier spdx license identifier mit
tag bsd-2-clause spdx_license_identifier spdx license identifier bsd 2 clause
tag bsd-3-clause spdx_license_identifier spdx license identifier bsd 3 clause
tag bsd-4-clause spdx_license_identifier spdx license identifier bsd 4 clause
tag 0bsd spdx_license_identifier spdx license identifier 0bsd
tag isc spdx_license_identifier spdx license identifier isc
tag mpl-1.1 spdx_license_identifier spdx license identifier mpl 1 1
tag mpl-2.0 spdx_license_identifier spdx license identifier mpl 2 0
tag epl-1.0 spdx_license_identifier spdx license identifier epl 1 0
tag epl-2.0 spdx_license_identifier spdx license identifier epl 2 0
tag eupl-1.2 spdx_license_identifier spdx license identifier eupl 1 2
tag cddl-1.0 spdx_license_identifier spdx license identifier cddl 1 0
tag cddl-1.1 spdx_license_identifier spdx license identifier cddl 1 1
tag unlicense spdx_license_identifier spdx license identifier unlicense
tag wtfpl spdx_license_identifier spdx license identifier wtfpl
tag zlib spdx_license_identifier spdx license identifier zlib
tag bsl-1.0 spdx_license_identifier spdx license identifier bsl 1 0
tag artistic-2.0 spdx_license_identifier spdx license identifier artistic 2 0
tag python-2.0 spdx_license_identifier spdx license identifier (?:psf|python) 2 0
tag postgresql spdx_license_identifier spdx license identifier postgresql
tag ofl-1.1 spdx_license_identifier spdx license identifier ofl 1 1
tag odbl-1.0 spdx_license_identifier spdx license identifier odbl 1 0
tag cc0-1.0 spdx_license_identifier spdx license identifier cc0 1 0
tag cc-by-4.0 spdx_license_identifier spdx license identifier cc by 4 0
tag cc-by-3.0 spdx_license_identifier spdx license identifier cc by 3 0
tag cc-by-sa-4.0 spdx_license_identifier spdx license identifier cc by sa 4 0
tag cc-by-nc-4.0 spdx_license_identifier spdx license identifier cc by nc 4 0
tag cc-by-nd-4.0 spdx_license_identifier spdx license identifier cc by nd 4 0
tag cc-by-nc-sa-4.0 spdx_license_identifier spdx license identifier cc by nc sa 4 0
tag cc-by-nc-nd-4.0 spdx_license_identifier spdx license identifier cc by nc nd 4 0
tag sspl-1.0 spdx_license_identifier spdx license identifier sspl 1 0
tag busl-1.1 spdx_license_identifier spdx license identifier busl 1 1
text gpl-2.0 freedom_not_price when we speak of free software we are referring to freedom not price
text gpl freedom_to_share licenses? for most software (?:and other practical works )?are designed to take away your freedom to share and change
text gpl-3.0 copyleft_license the gnu general public license is a free copyleft license for software and other kinds of works
text agpl-3.0 copyleft_license the gnu affero general public license is a free copyleft license for software
text agpl-3.0 prominently_offer if you modify the program your modified version must prominently offer all users interact
text lgpl-3.0 incorporates_the_terms incorporates the terms and conditions of version 3 of the gnu general public license
text gpl without_even_the distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
text lgpl-2.1 specially_designated this license the lesser general public license applies to some specially designated software packages
text gfdl invariant_sections with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
text apache-2.0 except_in_compliance you may not use this file except in compliance with the license
text apache-2.0 without_warranties distributed on an as is basis without warranties or conditions of any kind either express or implied
text apache-2.0 you_may_obtain you may obtain a copy of the license at http www apache org licenses license 2 0
text apache-1.1 apache_software_foundation this product includes software developed by the apache software foundation
text mit obtaining_a_copy permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text mit shall_be_included the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text mit noninfringement merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
text isc to_use_copy permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
text bsd source_and_binary redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
text bsd-2-clause in_binary_form redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
text bsd-3-clause to_endorse neither the name of .{0,120}? may be used to endorse or promote products derived from this software
text bsd-4-clause advertising_materials all advertising materials mentioning features or use of this software must display the following acknowledgement
text mpl-2.0 mozilla_public_license this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
text mpl-1.1 mozilla_public_license the contents of this file are subject to the mozilla public license version 1 1
text epl-1.0 eclipse_public_license this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )?1 0
text epl-2.0 eclipse_public_license this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
text cddl common_development the contents of this file are subject to the terms of the common development and distribution license
text unlicense unencumbered this is free and unencumbered software released into the public domain
text unlicense dedicate_any we dedicate any and all copyright interest in the software to the public domain
text wtfpl what_the you just do what the f\S+ you want to
text zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
text zlib as_is_without this software is provided as is without any express or implied warranty in no event will the authors be held liable
text bsl-1.0 machine_executable machine executable object code generated by a source language processor
text artistic-2.0 free_software_package this license establishes the terms under which a given free software package may be copied modified distributed
text artistic-1.0 artistic_control copyright holder maintains some semblance of artistic control over the development of the package
text postgresql without_a_written without fee and without a written agreement is hereby granted
text ofl-1.1 reserved_font_name no modified version of the font software may use the reserved font name
text ofl-1.1 font_software this font software is licensed under the sil open font license version 1 1
text openssl openssl_toolkit this product includes software developed by the openssl project for use in the openssl toolkit
text json for_good_not the software shall be used for good not evil
text beerware buy_me_a if we meet some day and you think this stuff is worth it you can buy me a beer
text curl permission_to_use permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text cc0-1.0 waived_all has waived all copyright and related or neighboring rights
text cc-by adapt_remix you are free to share copy(?: and)? (?:re)?distribute .{0,60}?adapt remix transform and build upon the material
text cc-by appropriate_credit you must give appropriate credit provide a link to the license and indicate if changes were made
text cc-by-nc commercial_purposes you may not use the material for commercial purposes
text cc-by-nd remix_transform if you remix transform or build upon the material you may not distribute the modified material
text cc-by-sa same_license if you remix transform or build upon the material you must distribute your contributions under the same license
text odbl-1.0 open_database this database is made available under the open database license
text sspl-1.0 available_to_third if you make the functionality of the program or a modified version available to third parties as a service
text busl-1.1 change_date effective on the change date or the fourth anniversary
text busl-1.1 additional_use_grant the licensor may make an additional use grant
text commons-clause commons_clause license condition v1 0 the software is provided to you by the licensor under the license as defined below subject to the following commons clause
text proprietary all_rights_reserved all rights reserved
text proprietary confidential this (?:document|software|file|material) (?:is|contains) confidential(?: and proprietary)?
text proprietary may_not_be may not be (?:reproduced|copied|distributed|redistributed|published) without (?:prior )?(?:written )?permission
text proprietary written_consent without the (?:express |prior )*written consent of
text proprietary unauthori unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or (?:copying|reproduction|distribution|use))? .{0,60}?(?:prohibited|forbidden)
notice gpl-1.0 general_public licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:v|v1|version 1)(?: 0)?
notice gpl-2.0-or-later general_public gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
notice gpl-3.0-or-later general_public gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
notice gpl-2.0 general_public gnu general public license (?:v2|v 2|version 2)(?: 0)?
notice gpl-3.0 general_public gnu general public license (?:v3|v 3|version 3)(?: 0)?
notice gpl-3.0 general_public licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:v3|v 3|version 3)(?: 0)?
notice gpl-2.0 general_public licensed under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:v2|v 2|version 2)(?: 0)?
notice gpl general_public (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public license
notice lgpl-2.1-or-later lesser_general gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version
notice lgpl-2.1 lesser_general gnu lesser general public license (?:v2|v 2|version 2) 1
notice lgpl-3.0 lesser_general gnu lesser general public license (?:v3|v 3|version 3)(?: 0)?
notice lgpl-2.0 library_general gnu library general public license (?:v2|v 2|version 2)(?: 0)?
notice lgpl lesser_general (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license
notice agpl-3.0 affero gnu affero general public license (?:v3|v 3|version 3)(?: 0)?
notice agpl affero (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu affero general public license
notice gfdl free_documentation gnu free documentation license(?: version 1 [0-3])?
notice apache-2.0 apache licensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license(?: v| version)? ?2(?: 0)?
notice apache-2.0 apache apache(?: software)? license (?:v2|v 2|version 2)(?: 0)?
notice apache-1.1 apache apache(?: software)? license (?:v1|v 1|version 1) 1
notice apache-1.0 apache apache(?: software)? license (?:v1|v 1|version 1) 0
notice apache apache (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license
notice mit mit (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |an )?mit(?: x11)? license
notice mit expat (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?expat license
notice bsd-2-clause bsd (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the |a )?(?:simplified|2 clause|two clause|freebsd) bsd license
notice bsd-3-clause bsd (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the |a )?(?:new|modified|revised|3 clause|three clause) bsd license
notice bsd-4-clause bsd (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the |an )?(?:original|old|4 clause|four clause) bsd license
notice bsd bsd (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)? license
notice isc isc (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?isc license
notice mpl-2.0 mozilla_public (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mozilla public license (?:v|version )?2(?: 0)?
notice epl-2.0 eclipse_public (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?eclipse public license (?:v |version )?2(?: 0)?
notice epl-1.0 eclipse_public (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?eclipse public license (?:v |version )?1(?: 0)?
notice eupl-1.2 1_2 licensed under (?:the )?(?:terms of )?(?:the )?(?:eupl|european union public licen[cs]e)(?: v| version)? ?1 2
notice unlicense unlicense (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?unlicense
notice public-domain public_domain (?:released|placed|dedicated|put) (?:in|into|to) the public domain
notice public-domain public_domain (?:this|the) (?:work|text|file|document|software|image) is in the public domain
notice zlib zlib (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?zlib(?: libpng)? license
notice bsl-1.0 boost (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?boost software license(?: version 1 0)?
notice artistic-2.0 artistic (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?artistic license(?: version)? 2 0
notice perl same_terms_as under the same terms as perl(?: itself)?
notice php php (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?php license
notice cc0-1.0 cc0 (?:licensed|released|distributed|available) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons )?cc0(?: 1 0)?
notice cc-by-nc-nd-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nc nd(?: license)? 4 0
notice cc-by-nc-sa-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nc sa(?: license)? 4 0
notice cc-by-nc-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nc(?: license)? 4 0
notice cc-by-nd-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nd(?: license)? 4 0
notice cc-by-sa-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by sa(?: license)? 4 0
notice cc-by-4.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by(?: license)? 4 0
notice cc-by-sa-3.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by sa(?: license)? 3 0
notice cc-by-3.0 cc (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?cc by(?: license)? 3 0
notice cc-by-sa creative_commons (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution share ?alike
notice cc-by-nc creative_commons (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution non ?commercial
notice cc-by creative_commons (?:licensed|released|available|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution
notice ofl-1.1 open_font (?:licensed|released|available|published) under (?:the )?(?:terms of )?(?:the )?(?:sil )?open font license(?: version 1 1)?
notice odbl-1.0 open_database (?:licensed|released|available|published) under (?:the )?(?:terms of )?(?:the )?open (?:data commons open )?database license
notice odc-by odc (?:licensed|released|available|published) under (?:the )?(?:terms of )?(?:the )?odc by(?: 1 0)?
notice ogl-uk-3.0 open_government (?:licensed|released|available|published) under (?:the )?(?:terms of )?(?:the )?open government licen[cs]e(?: v3| v3 0| version 3| version 3 0)?
notice proprietary commercial_license (?:licensed|available|distributed) under (?:a |the )?commercial license
notice dual dual_licensed dual licensed under
name gpl-3.0 gpl gnu gpl (?:v3|v 3|version 3|3)(?: 0)?
name gpl-2.0 gpl gnu gpl (?:v2|v 2|version 2|2)(?: 0)?
name gpl-3.0 licenses_gpl www gnu org licenses gpl 3 0
name gpl-2.0 old_licenses www gnu org licenses old licenses gpl 2 0
name gpl www_gnu_org www gnu org licenses gpl
name lgpl-2.1 old_licenses www gnu org licenses old licenses lgpl 2 1
name lgpl www_gnu_org www gnu org licenses lgpl
name agpl www_gnu_org www gnu org licenses agpl
name gfdl www_gnu_org www gnu org licenses fdl
name gpl gnu_public gnu public license
name lgpl lesser_general gnu lesser general public license
name lgpl library_general gnu library general public license
name agpl affero_general (?:gnu )?affero general public license
name gfdl free_documentation free documentation license
name apache-2.0 www_apache_org www apache org licenses license 2 0
name apache apache apache software license
name mit mit mit x11 license
name mit opensource_org opensource org licenses? mit
name mit expat expat license
name x11 x11 x11 license
name isc isc isc license
name isc opensource_org opensource org licenses? isc
name bsd-2-clause bsd (?:simplified|2 clause|two clause|freebsd) bsd license
name bsd-2-clause bsd bsd 2 clause(?: license)?
name bsd-3-clause bsd (?:new|modified|revised|3 clause|three clause) bsd license
name bsd-3-clause bsd bsd 3 clause(?: license)?
name bsd-4-clause bsd (?:original|old|4 clause|four clause) bsd license
name bsd bsd bsd(?: style)? license
name mpl-2.0 mozilla_org mozilla org mpl 2 0
name mpl-2.0 mozilla_public mozilla public license (?:v|v |version )?2(?: 0)?
name mpl-1.1 mozilla_public mozilla public license (?:v|v |version )?1 1
name mpl mozilla_public mozilla public license
name epl-2.0 eclipse_org eclipse org legal epl 2 0
name epl-1.0 eclipse_org eclipse org legal epl v10
name epl eclipse_public eclipse public license
name cpl-1.0 common_public common public license(?: version 1 0)?
name cddl common_development common development and distribution license
name eupl european_union european union public licen[cs]e
name unlicense unlicense unlicense org
name unlicense unlicense the unlicense
name wtfpl do_what do what the f\S+ you want to public license
name zlib zlib zlib(?: libpng)? license
name bsl-1.0 boost boost software license
name artistic artistic artistic license
name perl perl perl artistic license
name php php php license
name python-2.0 python python software foundation license
name ruby ruby ruby license
name postgresql postgresql postgresql license
name openssl openssl openssl license
name ofl-1.1 open_font (?:sil )?open font license
name ijg independent_jpeg independent jpeg group
name libpng libpng libpng license
name vim vim vim license
name ncsa university_of university of illinois ncsa open source license
name upl-1.0 universal_permissive universal permissive license
name ms-pl microsoft_public microsoft public license
name ms-rl microsoft_reciprocal microsoft reciprocal license
name sspl-1.0 server_side server side public license
name busl-1.1 business_source business source license
name elastic-2.0 elastic elastic license 2 0
name elastic elastic elastic license
name polyform polyform polyform (?:noncommercial|small business|shield|strict) license
name cc0-1.0 publicdomain_zero creativecommons org publicdomain zero 1 0
name cc-by-nc-nd-4.0 creativecommons_org creativecommons org licenses by nc nd 4 0
name cc-by-nc-sa-4.0 creativecommons_org creativecommons org licenses by nc sa 4 0
name cc-by-nc-4.0 creativecommons_org creativecommons org licenses by nc 4 0
name cc-by-nd-4.0 creativecommons_org creativecommons org licenses by nd 4 0
name cc-by-sa-4.0 creativecommons_org creativecommons org licenses by sa 4 0
name cc-by-sa-3.0 creativecommons_org creativecommons org licenses by sa 3 0
name cc-by-4.0 creativecommons_org creativecommons org licenses by 4 0
name cc-by-3.0 creativecommons_org creativecommons org licenses by 3 0
name cc-by-nc-nd-4.0 cc cc by nc nd 4 0
name cc-by-nc-sa-4.0 cc cc by nc sa 4 0
name cc-by-nc-4.0 cc cc by nc 4 0
name cc-by-nd-4.0 cc cc by nd 4 0
name cc-by-sa-4.0 cc cc by sa 4 0
name cc-by-4.0 cc cc by 4 0
name cc-by-nc-sa-3.0 cc cc by nc sa 3 0
name cc-by-nc-3.0 cc cc by nc 3 0
name cc-by-sa-3.0 cc cc by sa 3 0
name cc-by-3.0 cc cc by 3 0
name cc-by-sa creative_commons creative commons attribution share ?alike
name cc-by-nc creative_commons creative commons attribution non ?commercial
name cc-by-nd creative_commons creative commons attribution no ?deriv(?:ative)?s?
name cc-by creative_commons creative commons attribution
name creative-commons creative_commons creative commons license
name odbl open_database open database license
name ogl-uk open_government open government licen[cs]e
name pddl-1.0 public_domain_dedication open data commons public domain dedication
name cdla community_data community data license agreement
name openrail openrail (?:creative ml |bigscience )?openrail(?: m)?
name llama-community llama llama (?:2 |3 )?community license
mention gpl-3.0 gplv3 gplv3
mention gpl-2.0 gplv2 gplv2
mention gpl-3.0 gpl gpl 3 0
mention gpl-2.0 gpl gpl 2 0
mention gpl gpl gnu gpl
mention gpl gpl gpl license
mention lgpl-3.0 lgplv3 lgplv3
mention lgpl-2.1 lgpl lgpl 2 1
mention lgpl lgpl (?:gnu )?lgpl
mention agpl-3.0 agplv3 agplv3
mention agpl agpl (?:gnu )?agpl
mention apache-2.0 apache apache 2 0
mention apache apache apache licensed
mention mit mit mit licensed
mention bsd bsd bsd licensed
mention mpl-2.0 mpl mpl 2 0
mention epl-2.0 epl epl 2 0
mention eupl eupl eupl
mention unlicense unlicense unlicensed?
mention wtfpl wtfpl wtfpl
mention cc0 cc0 cc0
mention cc-by-nc-nd cc cc by nc nd
mention cc-by-nc-sa cc cc by nc sa
mention cc-by-nc cc cc by nc
mention cc-by-nd cc cc by nd
mention cc-by-sa cc cc by sa
mention creative-commons creative_commons creative commons
mention public-domain public_domain public domain
mention proprietary proprietary proprietary (?:software|license|information)
mention copyleft copyleft copyleft
mention open-source open_source open source license
"""


class Rule(NamedTuple):
    label: str
    kind: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern
    base: bool


def whole_words(pattern: str) -> re.Pattern:
    """``pattern`` between blanks of a text that begins and ends with one."""
    return re.compile(f"(?<= )(?:{pattern})(?= )")


def rules() -> list[Rule]:
    """The base phrases and the lines above, in their order."""
    out = [Rule(label, "name", *KINDS["name"], phrase, whole_words(phrase), True) for phrase, label in BASE.items()]
    for line in RULES_TEXT.strip().splitlines():
        kind, label, keyword, pattern = line.split(" ", 3)
        out.append(Rule(label, kind, *KINDS[kind], keyword.replace("_", " "), whole_words(pattern), False))
    return out
