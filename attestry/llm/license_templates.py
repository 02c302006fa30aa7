"""License templates: notices and whole texts, with optional and replaceable regions."""

from __future__ import annotations

_OPEN, _SHUT = "<<beginOptional>>", "<<endOptional>>"


def _optional(text: str) -> str:
    return f"{_OPEN}{text}{_SHUT}"


def _var(name: str, match: str = ".+") -> str:
    return f'<<var;name="{name}";original="";match="{match}">>'


#: An optional title and copyright lines, as most license texts open.
def _head(title: str) -> str:
    return _optional(title) + " " + _optional("Copyright " + _var("copyright", ".{0,40}")) + " " + _optional("All rights reserved.") + " "


# Wording of public licenses and of their usual notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of " + _var("item", ".{1,12}") + " " + _optional('(the "Software")') + ", to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice " + _optional("(including the next paragraph)") + " shall be included in all copies or"
    ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR'
    " A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL " + _var("holder", ".{1,20}") + " BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, " + _optional("and") + " " + _optional("/or") + " distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
    ' notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND ' + _var("author", ".{1,20}") + " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS. IN NO EVENT SHALL " + _var("author", ".{1,20}") + " BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
    " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_SOURCE = _optional("1.") + " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = (
    _optional("2.") + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials"
    " provided with the distribution. "
)
_NAMES = (
    _optional("3.") + " Neither the name of " + _var("organisation", ".{1,20}") + " nor the names of its contributors may be used to endorse or promote products derived from this software without specific"
    " prior written permission. "
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY " + _var("holder", ".{1,20}") + ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A'
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL " + _var("holder", ".{1,20}") + " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED"
    " TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT"
    " (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to"
    " anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    + _optional("1.") + " The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product"
    " documentation would be appreciated but is not required. " + _optional("2.") + " Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    + _optional("3.") + " This notice may not be removed or altered from any source distribution."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    + _var("address", ".{1,12}") + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
    " KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)


def _free(name: str, version: str) -> str:
    return (
        _var("program", "this program|this library|it") + " is free software" + _optional(_var("colon", ".{0,2}")) + " you can redistribute it and/or modify it under the terms of the GNU " + name + " General Public License as published by the"
        " Free Software Foundation" + _optional("; either") + f" version {version}"
    )


def _terms(name: str) -> str:
    return "licensed under the " + _optional("terms of the") + " " + name


TEMPLATES = [
    ("mit", _head("The MIT License (MIT)") + _MIT),
    ("isc", _head("ISC License") + _ISC),
    ("bsd-2-clause", _head("BSD 2-Clause License") + _BSD + _SOURCE + _BINARY + _DISCLAIMER),
    ("bsd-3-clause", _head("BSD 3-Clause License") + _BSD + _SOURCE + _BINARY + _NAMES + _DISCLAIMER),
    ("zlib", _head("zlib License") + _ZLIB),
    ("apache-2.0", _head("") + _APACHE),
    ("gpl-2.0", _free("", "2")),
    ("gpl-3.0", _free("", "3")),
    ("lgpl-2.1", _free("Lesser", "2.1")),
    ("lgpl-3.0", _free("Lesser", "3")),
    ("agpl-3.0", _free("Affero", "3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # Short notices: they name a license and hold none of its wording.
    ("mit", "released under the " + _optional("terms of the") + " MIT license"),
    ("mit", _terms("MIT license")),
    ("apache-2.0", _terms("Apache License " + _optional(",") + " version 2.0")),
    ("gpl-3.0", _terms("GNU General Public License " + _optional("as published by the Free Software Foundation") + " " + _optional("either") + " version 3")),
    ("gpl-2.0", _terms("GNU General Public License " + _optional("as published by the Free Software Foundation") + " " + _optional("either") + " version 2")),
    ("cc-by-4.0", "licensed under " + _optional("a") + " " + _var("form", "cc by|creative commons attribution") + " 4.0"),
    ("cc-by-sa-4.0", "licensed under " + _optional("a") + " " + _var("form", "cc by sa|creative commons attribution sharealike") + " 4.0"),
    ("cc-by-nc-4.0", "licensed under " + _optional("a") + " " + _var("form", "cc by nc|creative commons attribution noncommercial") + " 4.0"),
]
