"""Texts of public licences that :mod:`reelframe.llm.licences` looks for, with the phrases that each must hold."""

from __future__ import annotations

# Whole texts of short licences; standard notices and opening paragraphs of long ones.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source
distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

APACHE_TEXT = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION,
AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is
granting the License."""


def _gnu_notice(what: str, name: str, version: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it "
        f"will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {name} for more details."
    )


def _gnu_grant(what: str, name: str, version: str) -> str:
    """The first sentence of the notice, which many headers hold alone."""
    return _gnu_notice(what, name, version).split(" This " + what + " is distributed")[0]


def _gnu_exact(name: str, version: str) -> str:
    return f"you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation"


def _gnu_text(name: str, version: str) -> str:
    return (
        f"{name} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
        "document, but changing it is not allowed."
    )


def _creative_commons(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/"


GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
CC = "creative commons attribution"

#: (label, phrases that must stand near their places, text).
TEMPLATES = [
    ("mit-text", ["permission is hereby granted free of charge to any person obtaining a copy"], MIT),
    ("isc", ["permission to use copy modify and or distribute this software"], ISC),
    ("bsd", ["redistribution and use in source and binary forms"], BSD),
    ("bsd", ["provided by the copyright holders and contributors as is"], BSD_DISCLAIMER),
    ("bsd-3-clause", ["neither the name of", "endorse or promote products"], BSD_3),
    ("zlib", ["the origin of this software must not be misrepresented"], ZLIB),
    ("unlicense", ["free and unencumbered software released into the public domain"], UNLICENSE),
    ("boost", ["any person or organization obtaining a copy"], BOOST),
    ("apache-2.0", ["apache license version 2 0"], APACHE_NOTICE),
    ("apache-2.0", ["apache license version 2 0 january 2004"], APACHE_TEXT),
    ("gpl-2.0", ["gnu general public license", "version 2 of the license"], _gnu_notice("program", GPL, "2")),
    ("gpl-3.0", ["gnu general public license", "version 3 of the license"], _gnu_notice("program", GPL, "3")),
    ("gpl-2.0", ["gnu general public license", "version 2 of the license"], _gnu_grant("program", GPL, "2")),
    ("gpl-3.0", ["gnu general public license", "version 3 of the license"], _gnu_grant("program", GPL, "3")),
    ("gpl-2.0", ["gnu general public license version 2 as published"], _gnu_exact(GPL, "2")),
    ("gpl-3.0", ["gnu general public license version 3 as published"], _gnu_exact(GPL, "3")),
    ("gpl-2.0", ["gnu general public license version 2 june 1991"], _gnu_text(GPL, "2, June 1991")),
    ("gpl-3.0", ["gnu general public license version 3 29 june 2007"], _gnu_text(GPL, "3, 29 June 2007")),
    ("lgpl-2.1", ["gnu lesser general public license", "version 2 1 of the license"], _gnu_notice("library", LGPL, "2.1")),
    ("lgpl-3.0", ["gnu lesser general public license", "version 3 of the license"], _gnu_notice("library", LGPL, "3")),
    ("lgpl-2.1", ["gnu lesser general public license", "version 2 1 of the license"], _gnu_grant("library", LGPL, "2.1")),
    ("lgpl-3.0", ["gnu lesser general public license", "version 3 of the license"], _gnu_grant("library", LGPL, "3")),
    ("lgpl-3.0", ["gnu lesser general public license version 3 29 june 2007"], _gnu_text(LGPL, "3, 29 June 2007")),
    ("agpl-3.0", ["gnu affero general public license", "version 3 of the license"], _gnu_notice("program", AGPL, "3")),
    ("agpl-3.0", ["gnu affero general public license", "version 3 of the license"], _gnu_grant("program", AGPL, "3")),
    ("agpl-3.0", ["gnu affero general public license version 3 19 november 2007"], _gnu_text(AGPL, "3, 19 November 2007")),
    ("mpl-2.0", ["mozilla public license v 2 0"], "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", [f"{CC} 4 0 international license"], _creative_commons("Attribution")),
    ("cc-by-sa-4.0", [f"{CC} sharealike 4 0 international license"], _creative_commons("Attribution-ShareAlike")),
    ("cc-by-nc-4.0", [f"{CC} noncommercial 4 0 international license"], _creative_commons("Attribution-NonCommercial")),
    ("cc-by-nc-sa-4.0", [f"{CC} noncommercial sharealike 4 0 international license"], _creative_commons("Attribution-NonCommercial-ShareAlike")),
    ("cc0", ["waived all copyright and related or neighboring rights"], "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published from"),
]

#: Stands before licence identifiers in file headers; the template of that name has no label of its own.
HEADER = "spdx"
TEMPLATES.append((HEADER, ["SPDX-License-Identifier"], "SPDX-License-Identifier"))

# Identifiers of the public licence list, older forms, and exceptions.
LICENCES = """
0BSD AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0
Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL
BSD-3-Clause-No-Nuclear-License BSD-4-Clause BSD-4-Clause-UC BSD-Source-Code BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FSFUL FTL GFDL-1.2-only GFDL-1.2-or-later
GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG
Intel IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng
libpng-2.0 libtiff LPL-1.02 LPPL-1.3c MIT MIT-0 MIT-CMU MIT-Modern-Variant MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA
Naumen NPL-1.1 NTP ODbL-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0
TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib zlib-acknowledgement ZPL-2.1
""".split()
EXCEPTIONS = """
Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1
Libtool-exception Linux-syscall-note LLVM-exception OCaml-LGPL-linking-exception Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0
WxWindows-exception-3.1
""".split()
#: As they stand in expressions: the older forms of the GNU licences may have a plus sign.
IDENTIFIERS = {i.lower() for i in [*LICENCES, *EXCEPTIONS]} | {f"{i.lower()}+" for i in LICENCES if "GPL" in i and i[-1].isdigit()}
