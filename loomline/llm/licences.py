"""License scans by ordered signature rules.

Texts are lower-cased (A-Z) and read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, so rules see single spaces
only. A rule is a regex with a label, a priority and a keyword: names of licenses, which count for more where the text
says that it is licensed under them, and signatures of license bodies, notices, exceptions and terms. A keyword
prefilter picks the texts that any rule could match and, within one, the rules to try. Of two detections, one whose words
lie inside the other's is suppressed if its priority is not higher. Base phrases are always reported.

Defined cases: a null text is empty; texts without detections have empty label strings, score 0 and null places;
null and repeated ids are rows like others. A text of any length is scanned whole in its task. Extra columns are
ignored; an empty table gives no rows.
"""
from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batches, text_slices, utf8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, its name as a regex over words, the keyword that any match of the name holds.
NAMES = [
    ("gpl-1.0", r"(?:gnu )?(?:general public licen[sc]e|gpl) ?(?:version |v)?1(?: 0)?", "gpl|general"),
    ("gpl-2.0", r"(?:gnu )?(?:general public licen[sc]e|gpl) ?(?:version |v)?2(?: 0)?", "gpl|general"),
    ("gpl-3.0", r"(?:gnu )?(?:general public licen[sc]e|gpl) ?(?:version |v)?3(?: 0)?", "gpl|general"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?(?:version |v)?2 1", "lgpl|lesser"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) ?(?:version |v)?3(?: 0)?", "lgpl|lesser"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl) ?(?:version |v)?3(?: 0)?", "agpl|affero"),
    ("gfdl", r"gnu free documentation licen[sc]e", "documentation"),
    ("apache-1.1", r"apache (?:software )?licen[sc]e ?(?:version )?1 1", "apache"),
    ("apache-2.0", r"apache (?:software )?licen[sc]e ?(?:version )?2(?: 0)?", "apache"),
    ("mit", r"(?:mit|expat) licen[sc]e", "mit|expat"),
    ("x11", r"x11 licen[sc]e", "x11"),
    ("isc", r"isc licen[sc]e", "isc"),
    ("bsd-2-clause", r"(?:bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|new bsd|modified bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|original bsd)(?: licen[sc]e)?", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd)(?: licen[sc]e)?", "bsd"),
    ("mpl-1.1", r"(?:mozilla public licen[sc]e|mpl) ?(?:version |v)?1 1", "mpl|mozilla"),
    ("mpl-2.0", r"(?:mozilla public licen[sc]e|mpl) ?(?:version |v)?2(?: 0)?", "mpl|mozilla"),
    ("epl-1.0", r"(?:eclipse public licen[sc]e|epl) ?(?:version |v)?1(?: 0)?", "epl|eclipse"),
    ("epl-2.0", r"(?:eclipse public licen[sc]e|epl) ?(?:version |v)?2(?: 0)?", "epl|eclipse"),
    ("cddl-1.0", r"(?:common development and distribution licen[sc]e|cddl)(?: 1 0)?", "cddl|development"),
    ("eupl-1.2", r"(?:european union public licen[sc]e|eupl)(?: 1 2)?", "eupl|european"),
    ("artistic-2.0", r"artistic licen[sc]e(?: 2 0)?", "artistic"),
    ("boost-1.0", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "boost"),
    ("zlib", r"(?:zlib|libpng) licen[sc]e", "zlib|libpng"),
    ("wtfpl", r"wtfpl(?: licen[sc]e)?", "wtfpl"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("python-2.0", r"(?:python software foundation|psf) licen[sc]e(?: 2 0)?", "psf|python"),
    ("php-3.01", r"php licen[sc]e(?: version)?(?: 3 01)?", "php"),
    ("ruby", r"ruby licen[sc]e", "ruby"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?", "font"),
    ("odbl-1.0", r"(?:open database licen[sc]e|odbl)(?: 1 0)?", "odbl|database"),
    ("ms-pl", r"microsoft public licen[sc]e", "microsoft"),
    ("cpl-1.0", r"common public licen[sc]e(?: 1 0)?", "common"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv\w*)(?: \d 0)?", "cc by|creative"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: \d 0)?", "cc by|creative"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: \d 0)?", "cc by|creative"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv\w*)(?: \d 0)?", "cc by|creative"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: \d 0)?", "cc by|creative"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: \d 0)?", "cc by|creative"),
    ("cc0", r"(?:cc0|creative commons zero)(?: 1 0)?", "cc0|creative"),
]
# Words before a name that make it a statement of license, and one after it.
LEAD = r"(?:(?:is |are |be |been )?(?:licen[sc]ed|distributed|released|published|provided|available|dual licen[sc]ed)(?: to you)? (?:under|by)|subject to|governed by|covered by|according to|in accordance with|under|spdx licen[sc]e identifier|licen[sc]e(?: is)?)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
TAIL = r" applies"
# Signatures of license texts, notices and terms: label, regex over words, keyword, priority, confidence.
SIGNATURES = [
    # Permissive bodies.
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted", 8, 1.0),
    ("mit", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "sublicense", 7, 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions", 7, 0.9),
    ("permissive-notice", r"permission is hereby granted free of charge to any person", "hereby granted", 3, 0.9),
    ("mit-0", r"mit no attribution", "no attribution", 6, 0.9),
    ("mit-modern", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software", "royalty fees", 7, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice)?", "without fee", 8, 1.0),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "without fee", 8, 0.95),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "without fee", 9, 1.0),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties", "disclaims all", 6, 0.8),
    ("x11", r"except as contained in this notice the name of \w+(?: \w+){0,6} shall not be used in advertising", "advertising", 7, 0.9),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted", "documentation for any", 7, 0.9),
    ("hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "publicity", 6, 0.8),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "documentation for any", 8, 0.95),
    ("bsd-notice", r"redistribution and use in source and binary forms", "redistribution", 3, 0.9),
    ("bsd-notice", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution", 5, 0.95),
    ("bsd-2-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions", 6, 0.9),
    ("bsd-2-clause", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 6, 0.85),
    ("bsd-3-clause", r"neither the names? of(?: \w+){1,10} nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse", 7, 0.95),
    ("bsd-3-clause", r"may not be used to endorse or promote products derived from this software without specific prior written permission", "endorse", 6, 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 8, 1.0),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "patent rights", 8, 0.95),
    ("bsd-3-clause-no-nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", "nuclear", 8, 0.95),
    ("bsd-2-clause-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", "receiving rights", 8, 0.95),
    ("bsd-notice", r"this software is provided by the (?:copyright holders|regents|author|authors)(?: and contributors)? as is and any express(?:ed)? or implied warranties", "as is", 5, 0.8),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable", 8, 1.0),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications", "commercial applications", 7, 0.95),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented", 7, 0.95),
    ("libpng", r"the png reference library is supplied as is", "png reference", 8, 1.0),
    ("bzip2", r"this program bzip2 the associated library libbzip2", "libbzip2", 8, 1.0),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "without fee", 9, 0.9),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "or organization", 9, 1.0),
    ("boost-1.0", r"machine executable object code generated by a source language processor", "language processor", 7, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 8, 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 7, 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "changing it is allowed", 8, 0.95),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer in return", 8, 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement", 9, 1.0),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "deal with the software", 9, 1.0),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files", 9, 1.0),
    ("fair", r"usage of the works is permitted provided that this instrument is retained with the works", "instrument is retained", 8, 1.0),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "medium without royalty", 8, 1.0),
    ("fsful", r"this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", "configure script", 8, 1.0),
    ("afl-3.0", r"licensed under the academic free license(?: version 3 0)?", "academic free", 6, 0.95),
    ("upl-1.0", r"the universal permissive license(?: upl)?(?: version 1 0)?", "universal permissive", 6, 0.95),
    ("upl-1.0", r"to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge and under any and all copyright rights", "and or data", 8, 0.95),
    ("blueoak-1.0.0", r"blue oak model license", "blue oak", 6, 0.95),
    ("blueoak-1.0.0", r"this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", "protecting contributors", 8, 1.0),
    ("json", r"the software shall be used for good not evil", "not evil", 8, 1.0),
    ("python-2.0", r"psf hereby grants licensee a nonexclusive royalty free world wide license", "licensee a nonexclusive", 8, 1.0),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl toolkit", 7, 0.95),
    ("openssl", r"this product includes cryptographic software written by", "cryptographic software", 6, 0.8),
    ("php-3.01", r"products derived from this software may not be called php", "called php", 8, 1.0),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation", 7, 0.9),
    ("ruby", r"you may redistribute it and or modify it under either the terms of the 2 clause bsdl", "clause bsdl", 8, 1.0),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "package may be copied", 8, 1.0),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "free software package", 8, 1.0),
    ("perl", r"(?:free software )?you can redistribute it and or modify it under the same terms as perl itself", "perl itself", 7, 0.95),
    ("tcl-tk", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "hereby grant permission", 8, 0.95),
    ("icu", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: \w+){1,12} provided that the above copyright notice s and this permission notice appear in all copies", "notice appear", 9, 0.9),
    # Apache 2.
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache", 9, 1.0),
    ("apache-2.0", r"you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with", 7, 0.9),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable", 7, 0.95),
    ("apache-2.0", r"see the license for the specific language governing permissions and limitations under the license", "specific language governing", 7, 0.9),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", "contributor hereby grants", 8, 0.95),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements", 8, 1.0),
    ("apache-2.0", r"(?:www )?apache org licenses license 2 0", "apache org", 6, 0.9),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution", "for use reproduction", 6, 0.8),
    ("llvm-exception", r"apache license v2 0 with llvm exceptions?", "llvm", 9, 1.0),
    ("swift-exception", r"as an exception if you use this software to compile your source code and portions of this software are embedded into the binary product", "embedded into the binary", 8, 0.95),
    # GNU family: headers, versions, or later, exceptions.
    ("gpl-1.0-or-later", r"gnu general public license as published by the free software foundation either version 1(?: of the license)? or (?:at your option )?any later version", "free software foundation", 9, 1.0),
    ("gpl-2.0-or-later", r"gnu general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version", "free software foundation", 9, 1.0),
    ("gpl-3.0-or-later", r"gnu general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", "free software foundation", 9, 1.0),
    ("gpl-2.0-only", r"gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?(?! or)", "free software foundation", 8, 0.95),
    ("gpl-2.0-only", r"gnu general public license version 2 as published by the free software foundation", "free software foundation", 9, 0.95),
    ("gpl-3.0-only", r"gnu general public license(?: version 3)? as published by the free software foundation version 3(?: of the license)?(?! or)", "free software foundation", 8, 0.95),
    ("lgpl-2.0-or-later", r"gnu library general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version", "library general", 9, 1.0),
    ("lgpl-2.1-or-later", r"gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or (?:at your option )?any later version", "lesser general", 9, 1.0),
    ("lgpl-3.0-or-later", r"gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", "lesser general", 9, 1.0),
    ("agpl-3.0-or-later", r"gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version", "affero", 9, 1.0),
    ("gfdl-1.3-or-later", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version", "free documentation", 9, 1.0),
    ("gfdl-1.2-or-later", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version", "free documentation", 9, 1.0),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation", 8, 1.0),
    ("gfdl", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts", "invariant sections", 7, 0.9),
    ("gpl-2.0-or-later", r"gpl ?v?2(?: 0)? or (?:later|newer|any later version)", "gpl", 7, 0.95),
    ("gpl-3.0-or-later", r"gpl ?v?3(?: 0)? or (?:later|newer|any later version)", "gpl", 7, 0.95),
    ("lgpl-2.1-or-later", r"lgpl ?v?2 1 or (?:later|newer|any later version)", "lgpl", 8, 0.95),
    ("lgpl-3.0-or-later", r"lgpl ?v?3(?: 0)? or (?:later|newer|any later version)", "lgpl", 8, 0.95),
    ("agpl-3.0-or-later", r"agpl ?v?3(?: 0)? or (?:later|newer|any later version)", "agpl", 8, 0.95),
    ("gpl-2.0-only", r"gpl 2 0 only", "gpl", 7, 1.0),
    ("gpl-3.0-only", r"gpl 3 0 only", "gpl", 7, 1.0),
    ("lgpl-2.1-only", r"lgpl 2 1 only", "lgpl", 8, 1.0),
    ("agpl-3.0-only", r"agpl 3 0 only", "agpl", 8, 1.0),
    ("gpl-notice", r"this (?:program|library|package|file|software) is free software you can redistribute it and or modify it under the terms of the gnu", "redistribute it", 5, 0.9),
    ("gpl-notice", r"is distributed in the hope that it will be useful but without any warranty", "hope that it", 5, 0.85),
    ("gpl-notice", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", "even the implied", 5, 0.85),
    ("gpl-notice", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with", "should have received", 5, 0.9),
    ("gpl-notice", r"write to the free software foundation inc", "free software foundation", 4, 0.7),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license", "take away your freedom", 8, 1.0),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft license for", 8, 1.0),
    ("gpl-3.0", r"to convey a work means any kind of propagation that enables other parties to make or receive copies", "kind of propagation", 8, 0.95),
    ("gpl-2.0", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", "derived from the program", 8, 0.95),
    ("gpl-2.0", r"accompany it with the complete corresponding machine readable source code", "corresponding machine", 7, 0.9),
    ("gpl-3.0", r"installation information for a user product means any methods procedures authorization keys", "authorization keys", 8, 0.95),
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages typically libraries", "specially designated", 8, 1.0),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "incorporates the terms", 8, 1.0),
    ("lgpl-2.1", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "portion of the library", 8, 0.95),
    ("agpl-3.0", r"if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely", 8, 1.0),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license for software", "affero", 8, 1.0),
    ("classpath-exception-2.0", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "independent modules", 9, 1.0),
    ("classpath-exception-2.0", r"(?:with (?:the )?)?classpath exception(?: 2 0)?", "classpath", 7, 0.9),
    ("gcc-exception-3.1", r"gcc runtime library exception(?: version 3 1)?", "gcc runtime", 8, 1.0),
    ("gcc-exception-2.0", r"in addition to the permissions in the gnu general public license the free software foundation gives you unlimited permission to link the compiled version", "unlimited permission to link", 9, 1.0),
    ("bison-exception-2.2", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser", 9, 1.0),
    ("autoconf-exception", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script", "configuration script", 9, 1.0),
    ("libtool-exception", r"if you distribute this file as part of a program or library that is built using gnu libtool", "gnu libtool", 9, 1.0),
    ("font-exception-2.0", r"as a special exception if you create a document which uses this font and embed this font", "embed this font", 9, 1.0),
    ("linux-syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls", "kernel services", 9, 1.0),
    ("openssl-exception", r"as a special exception the copyright holders give permission to link the code of portions of this program with the openssl library", "openssl library", 9, 1.0),
    ("universal-foss-exception", r"universal foss exception", "foss exception", 7, 0.95),
    ("ocaml-linking-exception", r"as a special exception to the gnu (?:lesser|library) general public license you may link statically or dynamically a work that uses the library", "link statically", 9, 1.0),
    # Weak copyleft and others.
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla", 9, 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0", "source code form", 9, 1.0),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 8, 1.0),
    ("mpl-2.0-no-copyleft-exception", r"incompatible with secondary licenses", "secondary licenses", 8, 0.9),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse", 9, 1.0),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0", "eclipse", 9, 1.0),
    ("epl", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", "recipient", 7, 0.9),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license", "common public", 9, 1.0),
    ("ipl-1.0", r"ibm public license(?: version)?(?: 1 0)?", "ibm public", 6, 0.95),
    ("cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license", "development", 9, 1.0),
    ("cddl-1.0", r"when distributing covered code include this cddl header in each file", "cddl", 8, 1.0),
    ("eupl-1.2", r"licensed under the eupl(?: version)?(?: 1 2)?(?: or as soon they will be approved by the european commission)?", "eupl", 8, 1.0),
    ("osl-3.0", r"open software license(?: version| v)?(?: 3 0)?", "open software", 6, 0.9),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs use", 7, 0.8),
    ("ms-rl", r"microsoft reciprocal license", "reciprocal", 6, 0.95),
    ("cecill-2.1", r"(?:under french law and abiding by the rules of distribution of free software|cecill)", "abiding|cecill", 6, 0.9),
    ("apsl-2.0", r"apple public source license(?: version)?(?: 2 0)?", "apple public", 6, 0.95),
    ("npl-1.1", r"netscape public license(?: version)?(?: 1 1)?", "netscape public", 6, 0.95),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", "obtain complete source", 8, 1.0),
    ("qpl-1.0", r"q public license(?: version)?(?: 1 0)?", "q public", 6, 0.95),
    ("lppl-1.3c", r"(?:this work may be distributed and or modified under the conditions of the )?latex project public license", "latex project", 7, 0.95),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "open font", 9, 1.0),
    ("ofl-1.1", r"the fonts including any derivative works can be bundled embedded redistributed and or sold with any software", "fonts including", 8, 0.95),
    ("gust-font", r"gust font license", "gust font", 6, 0.95),
    ("sspl-1.0", r"server side public license(?: version 1)?", "server side public", 6, 1.0),
    ("busl-1.1", r"business source license(?: 1 1)?", "business source", 6, 1.0),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production use", 8, 1.0),
    ("elastic-2.0", r"elastic license(?: 2 0)?", "elastic license", 6, 0.9),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", "managed service", 8, 1.0),
    ("commons-clause", r"commons clause(?: license condition)?", "commons clause", 6, 0.95),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "right to sell", 8, 1.0),
    ("polyform-noncommercial-1.0.0", r"polyform noncommercial license", "polyform", 6, 1.0),
    ("hippocratic", r"hippocratic license", "hippocratic", 6, 0.95),
    ("openrail-m", r"(?:open ?rail(?: ?m)?|responsible ai) licen[sc]e", "rail|responsible ai", 6, 0.9),
    ("llama-community", r"llama(?: \d)* community license(?: agreement)?", "community license", 6, 0.95),
    # Creative Commons and data.
    ("cc-by-4.0", r"this work is licensed under a creative commons attribution 4 0 international license", "creative", 9, 1.0),
    ("cc-by-sa-4.0", r"this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative", 9, 1.0),
    ("cc-by-nc-4.0", r"this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative", 9, 1.0),
    ("cc-by-nd-4.0", r"this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative", 9, 1.0),
    ("cc-by-nc-sa-4.0", r"this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "creative", 9, 1.0),
    ("cc-by-nc-nd-4.0", r"this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "creative", 9, 1.0),
    ("cc-by-sa-3.0", r"text is available under the creative commons attribution sharealike license", "creative", 8, 1.0),
    ("cc-by", r"creativecommons org licenses by(?: \d \d)?", "creativecommons", 6, 0.9),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: \d \d)?", "creativecommons", 7, 0.9),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: \d \d)?", "creativecommons", 7, 0.9),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: \d \d)?", "creativecommons", 8, 0.9),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: \d \d)?", "creativecommons", 8, 0.9),
    ("cc0", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons", 7, 0.95),
    ("cc0", r"to the extent possible under law (?:\w+ ){1,10}has waived all copyright and related or neighboring rights", "neighboring rights", 8, 1.0),
    ("cc-pdm", r"creativecommons org publicdomain mark(?: 1 0)?", "creativecommons", 7, 0.95),
    ("odbl-1.0", r"(?:is )?made available under the open database license", "open database", 7, 1.0),
    ("odc-by-1.0", r"open data commons attribution license", "open data commons", 7, 1.0),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and licen[sc]e", "domain dedication", 7, 1.0),
    ("cdla-permissive-2.0", r"community data license agreement permissive", "community data", 7, 1.0),
    ("cdla-sharing-1.0", r"community data license agreement sharing", "community data", 7, 1.0),
    ("ogl-uk-3.0", r"(?:contains public sector information licensed under the )?open government licen[cs]e(?: v3 0)?", "open government", 7, 0.95),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain", 4, 0.9),
    ("public-domain", r"in the public domain", "domain", 2, 0.6),
    ("public-domain", r"the authors? (?:hereby )?disclaims? copyright to this source code", "disclaim", 7, 0.95),
    ("public-domain", r"no copyright is claimed|not subject to copyright protection", "copyright", 4, 0.8),
    # Proprietary terms and generic notices.
    ("proprietary", r"all rights reserved", "rights", 1, 0.4),
    ("proprietary", r"no part of this (?:work|publication|book|document) may be reproduced", "reproduced", 3, 0.8),
    ("proprietary", r"(?:strictly prohibited|forbidden) without (?:the )?(?:prior |express )*written (?:permission|consent)", "written", 3, 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution|use|duplication)", "unauthori", 3, 0.7),
    ("proprietary", r"confidential and proprietary(?: information)?", "proprietary", 3, 0.8),
    ("proprietary", r"for internal use only", "internal use", 2, 0.5),
    ("proprietary", r"you may not (?:copy|modify|redistribute|sell|rent|lease|reverse engineer decompile or disassemble)", "you may not", 3, 0.6),
    ("eula", r"end user licen[sc]e agreement", "end user", 4, 0.8),
    ("eula", r"by installing(?: copying)? or(?: otherwise)? using the (?:software|product) you agree to be bound", "agree to be bound", 5, 0.9),
    ("terms-of-use", r"terms (?:of (?:use|service)|and conditions of use)", "terms", 2, 0.4),
    ("non-commercial", r"(?:for )?(?:personal|academic|educational|research)(?: and| or)? non ?commercial (?:use|purposes)(?: only)?", "commercial", 3, 0.7),
    ("non-commercial", r"not (?:be used )?for commercial (?:use|purposes)", "commercial", 3, 0.7),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 1, 0.3),
    ("warranty-disclaimer", r"provided as is without warranty of any kind(?: express or implied)?", "without warranty", 4, 0.6),
    ("warranty-disclaimer", r"including but not limited to the (?:implied )?warranties of merchantability", "merchantability", 4, 0.6),
    ("liability-disclaimer", r"in no event shall the (?:authors?|copyright (?:holders?|owner)|contributors|regents)(?: \w+){0,6} be liable", "be liable", 4, 0.6),
]


class Rules:
    """The rules in order of priority, compiled on first use in each process."""

    def __init__(self):
        # A name alone counts for less than one that a text says it is licensed under.
        self.rules = [(label, f"(?P<lead>{LEAD} )?{name}(?P<tail>{TAIL})?", key, 2, 0.6) for label, name, key in NAMES]
        self.rules = sorted([*self.rules, *SIGNATURES], key=lambda r: -r[3])
        self.compiled: dict[int, re.Pattern] = {}
        self.keys = [tuple(r[2].split("|")) for r in self.rules]
        self.words = sorted({k for ks in self.keys for k in ks})
        gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        # One of these is in every text that a base phrase or a rule matches.
        self.prefilter = "|".join(k.replace(" ", gap) for k in sorted({*self.words, *BASE}))

    def detect(self, joined: str) -> list[tuple[int, int, str, int, float]]:
        """(first character, end, label, priority, confidence) of the detections that stand."""
        there = {k for k in self.words if k in joined}
        found = []
        for i, (label, pattern, _, priority, sure) in enumerate(self.rules):
            if there.isdisjoint(self.keys[i]):
                continue
            rx = self.compiled.get(i)
            if rx is None:
                rx = self.compiled[i] = re.compile(rf"(?<![^ ]){pattern}(?![^ ])")
            for m in rx.finditer(joined):
                told = any(m.groupdict().values())
                found.append((m.start(), m.end(), label, 5 if told else priority, 0.95 if told else sure))
        # Sweep by start, longest first: an interval lies inside an earlier one that reaches as far.
        found.sort(key=lambda d: (d[0], -d[1], -d[3]))
        stand: list = []
        for d in found:
            if not any(o[1] >= d[1] and o[3] >= d[3] for o in stand if o[1] > d[0]):
                stand.append(d)
        return stand


def base_places(joined: str) -> list[tuple[int, str]]:
    """(first character, label) of every base phrase, overlapping ones too."""
    padded, out = f" {joined} ", []
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return out


def scan_text(text: str, rules: Rules):
    """Base places (first word, label) and standing detections (first word, end word, label, priority, confidence)."""
    words = WORD.findall(text)
    joined = " ".join(words)
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
    word_at = lambda c: bisect_right(first, c) - 1
    return [(word_at(c), label) for c, label in base_places(joined)], [(word_at(a), word_at(b - 1) + 1, *rest) for a, b, *rest in rules.detect(joined)]


_IN_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def count_words(text: pa.Array) -> np.ndarray:
    data, off = utf8(text)
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    head = off[:-1][np.diff(off) > 0]
    first[head] = inside[head]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first_word: int, end_word: int, label: string, priority: int>>"


def licenses(docs: DataFrame) -> DataFrame:
    """One row a document; ``detections`` has the spans, in words, that stand."""

    def run(it):
        rules = Rules()
        names = [c.split()[0] for c in _SCHEMA.split(", ")[:8]]
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))
        for batch in it:
            for part in text_slices(batch):
                text = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
                n = part.num_rows
                base_n, low, high = [0] * n, [None] * n, [None] * n
                base_labels, labels, score, spans = [""] * n, [""] * n, [0.0] * n, [[]] * n
                for i in np.flatnonzero(pc.match_substring_regex(text, rules.prefilter).to_numpy(zero_copy_only=False)).tolist():
                    base, found = scan_text(text[i].as_py(), rules)
                    own = {label for _, label in base}
                    if base:
                        base_n[i], low[i], high[i] = len(base), min(base)[0], max(base)[0]
                    base_labels[i] = ",".join(sorted(own))
                    labels[i] = ",".join(sorted(own | {d[2] for d in found}))
                    score[i] = max([0.5 * bool(base), *(d[4] for d in found)])
                    spans[i] = [{"first_word": d[0], "end_word": d[1], "label": d[2], "priority": d[3]} for d in found]
                cols = [part.column("doc_id"), pa.array(count_words(text)), pa.array(base_n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], names=[*names, "detections"])

    return batches(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)
