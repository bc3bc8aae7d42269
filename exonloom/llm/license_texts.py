"""Telling sentences of license texts, by license: hand-written signatures.

Words are as licenses.py folds them: lower-cased, with one space for all that is neither letter nor digit.  A ``?``
follows what may be missing, ``(?:a|b)`` says that one of the two stands there.
"""

from __future__ import annotations

#: label: sentences by which its text is known (fixed values; the licenses' own words).
SIGNATURES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ],
    "x11": [
        "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization",
        "in no event shall the x consortium be liable for any claim damages or other liability",
    ],
    "isc": [
        "permission to use copy modify and (?:and )?or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "hpnd": [
        "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted",
        "the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
        "procurement of substitute goods or services loss of use data or profits or business interruption however caused",
    ],
    "bsd-3-clause": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products",
        "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-3-clause-clear": [
        "subject to the limitations in the disclaimer below provided that the following conditions are met",
        "no express or implied licenses to any party s patent rights are granted by this license",
    ],
    "bsd-3-clause-lbnl": ["you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code"],
    "bsd-4-clause": [
        "all advertising materials mentioning features or use of this software must display the following acknowledgement",
        "this product includes software developed by the university of california berkeley and its contributors",
    ],
    "bsd-2-clause-patent": ["each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable"],
    "apache-1.1": [
        "the end user documentation included with the redistribution if any must include the following acknowledgment",
        "products derived from this software may not be called apache nor may apache appear in their name",
        "this product includes software developed by the apache software foundation",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "terms and conditions for use reproduction and distribution 1 definitions license shall mean",
        "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy",
        "legal entity shall mean the union of the acting entity and all other entities that control are controlled by",
        "contribution shall mean any work of authorship including the original version of the work",
        "by combination of their contribution s with the work to which such contribution s was submitted",
    ],
    "gpl": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty",
        "you should have received a copy of the gnu general public license along with this program",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "when we speak of free software we are referring to freedom not price",
        "our general public licenses are designed to make sure that you have the freedom to distribute copies of free software",
        "to protect your rights we need to make restrictions that forbid anyone to deny you these rights",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ],
    "gpl-1.0": ["the general public license applies to the free software foundation s software and to any other program whose authors commit to using it you can use it for your programs too"],
    "gpl-2.0": [
        "either version 2 of the license or at your option any later version",
        "the act of running the program is not restricted and the output from the program is covered only if its contents constitute a work based on the program",
        "you may modify your copy or copies of the program or any portion of it thus forming a work based on the program",
        "accompany it with a written offer valid for at least three years to give any third party",
        "each time you redistribute the program or any work based on the program the recipient automatically receives a license from the original licensor",
        "if the distribution and or use of the program is restricted in certain countries either by patents or by copyrighted interfaces",
        "version 2 june 1991 copyright c 1989 1991 free software foundation",
    ],
    "gpl-3.0": [
        "either version 3 of the license or at your option any later version",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
        "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement",
        "to convey a work means any kind of propagation that enables other parties to make or receive copies",
        "no covered work shall be deemed part of an effective technological measure under any applicable law",
        "installation information for a user product means any methods procedures authorization keys",
        "a covered work means either the unmodified program or a work based on the program",
        "version 3 29 june 2007",
    ],
    "gpl-classpath-exception": ["as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable"],
    "gcc-runtime-exception": ["you have permission to propagate a work of target code formed by combining the runtime library with independent modules"],
    "lgpl": [
        "you should have received a copy of the gnu (?:lesser|library) general public license along with this library",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",
        "we call this license the lesser general public license because it does less to protect the user s freedom",
    ],
    "lgpl-2.0": ["version 2 june 1991 copyright c 1991 free software foundation inc"],
    "lgpl-2.1": [
        "either version 2 1 of the license or at your option any later version",
        "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it",
        "the lesser general public license applies to some specially designated software packages typically libraries",
        "version 2 1 february 1999",
    ],
    "lgpl-3.0": [
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license",
        "an application is any work that makes use of an interface provided by the library but which is not otherwise based on the library",
        "a combined work is a work produced by combining or linking an application with the library",
    ],
    "agpl-3.0": [
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community",
        "your modified version must prominently offer all users interacting with it remotely through a computer network",
        "a secondary benefit of defending all users freedom is that improvements made in alternate versions of the program",
        "version 3 19 november 2007",
    ],
    "gfdl-1.3": [
        "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom",
        "with no invariant sections no front cover texts and no back cover texts",
        "a secondary section is a named appendix or a front matter section of the document that deals exclusively with the relationship",
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    ],
    "mpl-1.1": [
        "the contents of this file are subject to the mozilla public license version 1 1",
        "the initial developer hereby grants you a world wide royalty free non exclusive license subject to third party intellectual property claims",
        "alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later",
    ],
    "mpl-2.0": [
        "if a copy of the mpl was not distributed with this file you can obtain one at",
        "means source code form to which the initial contributor has attached the notice in exhibit a the executable form",
        "incompatible with secondary licenses means that the initial contributor has attached the notice described in exhibit b",
        "all distribution of covered software in source code form including any modifications that you create",
    ],
    "epl-1.0": [
        "the accompanying program is provided under the terms of this eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    ],
    "epl-2.0": [
        "which accompanies this distribution and is available at https www eclipse org legal epl 2 0",
        "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license",
        "the eclipse foundation is the initial agreement steward",
    ],
    "cpl-1.0": ["the accompanying program is provided under the terms of this common public license agreement", "ibm is the initial agreement steward"],
    "ipl-1.0": ["the accompanying program is provided under the terms of this ibm public license agreement"],
    "cddl-1.0": [
        "the contents of this file are subject to the terms of the common development and distribution license",
        "when distributing covered code include this cddl header in each file and include the license file",
        "sun microsystems inc is the initial license steward and may publish revised and or new versions of this license",
    ],
    "cpal-1.0": ["the license is based on the mozilla public license version 1 1 but sections 14 and 15 have been added to cover use of software over a computer network"],
    "artistic-1.0": [
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control",
        "you may make and give away verbatim copies of the source form of the standard version of this package without restriction",
    ],
    "artistic-2.0": [
        "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
        "you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version",
        "the copyright holder intends that the development and distribution of the package remain artistic",
    ],
    "bsl-1.0": [
        "obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit",
        "must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code",
        "distributed under the boost software license version 1 0",
    ],
    "busl-1.1": [
        "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
        "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work",
        "the business source license is not an open source license",
    ],
    "sspl-1.0": [
        "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available",
        "service source code means the corresponding source for the program or the modified version and the corresponding source for all programs that you use to make the program",
    ],
    "elastic-2.0": [
        "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features",
        "you may not move change disable or circumvent the license key functionality in the software",
    ],
    "commons-clause": ["the software is provided to you by the licensor under the license as defined below subject to the following condition", "the license does not include and the license does not grant to you the right to sell the software"],
    "polyform-noncommercial-1.0.0": ["any noncommercial purpose is a permitted purpose"],
    "polyform-small-business-1.0.0": ["use of the software for the benefit of your company is use for a permitted purpose if your company has fewer than 100 total individuals"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
        "you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated",
    ],
    "libpng": ["the contributing authors and group 42 inc assume no liability for direct indirect incidental special exemplary or consequential damages which may result from the use of the png reference library"],
    "ijg": ["this software is based in part on the work of the independent jpeg group"],
    "bzip2-1.0.6": ["the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions"],
    "curl": ["except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"],
    "openssl": [
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software",
    ],
    "ssleay": ["this product includes cryptographic software written by eric young", "the implementation was written so as to conform with netscapes ssl"],
    "php-3.01": [
        "products derived from this software may not be called php nor may php appear in their name without prior written permission",
        "this product includes php software freely available from",
    ],
    "zend-2.0": ["the names zend and zend engine must not be used to endorse or promote products derived from this software"],
    "psf-2.0": [
        "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly",
        "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using",
        "psf is making python available to licensee on an as is basis",
    ],
    "cnri-python": ["cnri hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"],
    "ruby": ["you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices and associated disclaimers"],
    "postgresql": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
        "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages",
        "the university of california specifically disclaims any warranties including but not limited to the implied warranties",
    ],
    "ncsa": [
        "to deal with the software without restriction including without limitation the rights to use copy modify merge",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided as is",
    ],
    "llvm-exception": ["as an exception if as a result of your compiling your source code portions of this software are embedded into an object form of such source code"],
    "tcl-tk": ["the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained"],
    "unicode-dfs": ["unicode data files include all data files under the directories", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"],
    "icu": ["obtaining a copy of this software and associated documentation files the software to deal in the software without restriction provided that the above copyright notice s and this permission notice appear in all copies"],
    "w3c": ["w3c liability trademark and document use rules apply", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim except that they must include this license text"],
    "ftl": ["portions of this software are copyright c the freetype project", "this license grants a worldwide royalty free perpetual and irrevocable right and license to use execute perform compile display copy create derivative works of distribute and sublicense the freetype project"],
    "lppl-1.3c": [
        "this work may be distributed and or modified under the conditions of the latex project public license",
        "the latest version of this license is in http www latex project org lppl txt",
        "this work has the lppl maintenance status",
    ],
    "ofl-1.1": [
        "this font software is licensed under the sil open font license version 1 1",
        "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        "no modified version of the font software may use the reserved font name s unless explicit written permission is granted",
    ],
    "bitstream-vera": ["the fonts may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified and additional glyphs or characters may be added"],
    "ubuntu-font-1.0": ["this licence allows the licensed fonts to be used studied modified and redistributed freely"],
    "afl-3.0": ["licensed under the academic free license version 3 0"],
    "osl-3.0": ["licensed under the open software license version 3 0"],
    "ecl-2.0": ["licensed under the educational community license version 2 0"],
    "eupl-1.2": [
        "this european union public licence the eupl applies to the work as defined below which is provided under the terms of this licence",
        "licensed under the eupl version 1 2",
    ],
    "cecill-2.1": [
        "this software is governed by the cecill license under french law and abiding by the rules of distribution of free software",
        "the fact that you are presently reading this means that you have had knowledge of the cecill license and that you accept its terms",
    ],
    "mulanpsl-2.0": ["licensed under mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2", "every one is permitted to copy and distribute this license but amendment of it is prohibited mulan"],
    "ms-pl": [
        "this license governs use of the accompanying software if you use the software you accept this license",
        "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent license from such contributor",
    ],
    "ms-rl": ["for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license"],
    "nasa-1.3": ["this agreement is acceptance of the nasa open source agreement", "government agency means the national aeronautics and space administration"],
    "intel-acpi": ["this is the copyright and license for the intel acpi component architecture"],
    "upl-1.0": ["to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights in the software"],
    "zpl-2.1": ["names of the copyright holders must not be used to endorse or promote products derived from this software without prior written permission from the copyright holders"],
    "sleepycat": ["redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"],
    "qpl-1.0": ["you may make modifications to the software and distribute your modifications in a form that is separate from the software such as patches"],
    "apsl-2.0": ["this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"],
    "unlicense": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        "for more information please refer to https? unlicense org",
    ],
    "cc0-1.0": [
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights",
        "to the extent possible under law the (?:person|author|authors) who associated cc0 with this work has waived all copyright",
        "certain owners wish to permanently relinquish those rights to a work for the purpose of contributing to a commons",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution",
        "you must give appropriate credit provide a link to the license and indicate if changes were made",
        "to view a copy of this license visit https? creativecommons org licenses by",
    ],
    "cc-by-sa": [
        "this work is licensed under a creative commons attribution share ?alike",
        "if you remix transform or build upon the material you must distribute your contributions under the same license as the original",
        "to view a copy of this license visit https? creativecommons org licenses by sa",
        "text is available under the creative commons attribution share ?alike license",
    ],
    "cc-by-nc": ["you may not use the material for commercial purposes", "noncommercial means not primarily intended for or directed towards commercial advantage or monetary compensation", "to view a copy of this license visit https? creativecommons org licenses by nc"],
    "cc-by-nc-sa": ["this work is licensed under a creative commons attribution non ?commercial share ?alike", "to view a copy of this license visit https? creativecommons org licenses by nc sa"],
    "cc-by-nd": ["if you remix transform or build upon the material you may not distribute the modified material", "this work is licensed under a creative commons attribution no ?deriv(?:ative|atives|s)"],
    "cc-by-nc-nd": ["this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)", "to view a copy of this license visit https? creativecommons org licenses by nc nd"],
    "pddl-1.0": ["the open data commons public domain dedication and license is a document intended to allow you to freely share modify and use this work for any purpose and without any restrictions"],
    "odbl-1.0": [
        "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database while maintaining this same freedom for others",
        "contains information from which is made available here under the open database license",
        "this (?:data|database) is made available under the open database license",
    ],
    "odc-by-1.0": ["the open data commons attribution license is a license agreement intended to allow users to freely share modify and use this database"],
    "cdla-permissive-2.0": ["a data recipient may use modify and share the data made available by data provider s under this agreement"],
    "ogl-uk-3.0": ["you are encouraged to use and re use the information that is available under this licence freely and flexibly with only a few conditions", "contains public sector information licensed under the open government licence"],
    "openrail": [
        "you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law",
        "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision",
    ],
    "llama-community": ["llama materials means collectively", "grants you a non exclusive worldwide non transferable and royalty free limited license under (?:meta s )?intellectual property"],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "beerware": ["as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it"],
    "json": ["the software shall be used for good not evil"],
    "oracle-free": ["oracle grants you a nonexclusive nontransferable limited license to internally use the programs", "by downloading installing or using this software you agree to the terms of the oracle technology network license agreement"],
    "sun-bcl": ["sun grants you a non exclusive non transferable limited license without license fees to reproduce internally and use internally the software complete and unmodified"],
    "nvidia-eula": ["this license agreement is a legal agreement between you and nvidia corporation"],
    "microsoft-eula": ["these license terms are an agreement between you and microsoft corporation or based on where you live one of its affiliates"],
    "proprietary": [
        "this software is the confidential and proprietary information of",
        "unauthorized copying of this file via any medium is strictly prohibited",
        "no part of this (?:publication|book|document|work) may be reproduced distributed or transmitted in any form or by any means",
        "reproduction in whole or in part without (?:written )?permission is prohibited",
        "you may not copy modify distribute sell or lease any part of our services or included software",
        "you may not reverse engineer decompile or disassemble the software",
        "use of this software is subject to the end user license agreement",
        "this material may not be published broadcast rewritten or redistributed",
    ],
    "public-domain": [
        "this (?:file|code|software|work|program) has been put (?:in|into) the public domain",
        "the author disclaims copyright to this source code in place of a legal notice here is a blessing",
        "this is a work of the (?:u s|united states) government and is not subject to copyright protection in the united states",
        "no copyright is claimed and the author hereby places this (?:file|code|software|work) in the public domain",
    ],
}
