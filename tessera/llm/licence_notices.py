"""Notices and short texts of public licences, by label.

Fixed values: the wording of PUBLISHED is that of the licences' publishers. STATEMENTS are the sentences by which authors
name a licence in their own words; they are no one's published text. Longer texts (a whole GPL, say) are read from files: see read_templates.
"""

_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {version}. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_LATER = "either version {} of the License, or (at your option) any later version"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_MIT_REST = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_CC = "This work is licensed under a Creative Commons {} {} License"
_CC_KINDS = {"cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nc": "Attribution-NonCommercial", "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives", "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}

PUBLISHED: dict[str, tuple[str, ...]] = {
    "agpl-3": (_GPL.format(name="Affero General Public License", version=_LATER.format(3)),),
    "apache-2": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "boost-1": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    ),
    "bsd-2": (_BSD + _BSD_END,),
    "bsd-3": (_BSD + _BSD_NAMES + _BSD_END,),
    **{label: tuple(_CC.format(kind, version) for version in ("4.0 International", "3.0 Unported")) for label, kind in _CC_KINDS.items()},
    "cc0-1": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "epl-2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "gpl-2": (_GPL.format(name="General Public License", version=_LATER.format(2)),),
    "gpl-3": (_GPL.format(name="General Public License", version=_LATER.format(3)),),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "lgpl-2.1": (_GPL.format(name="Lesser General Public License", version=_LATER.format("2.1")).replace("program", "library"),),
    "lgpl-3": (_GPL.format(name="Lesser General Public License", version=_LATER.format(3)), _GPL.format(name="Lesser General Public License", version=_LATER.format(3)).replace("program", "library")),
    "mit": (_MIT + _MIT_REST, _MIT),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
}

_FAMILIES = {"gpl": ("General Public License", "GPL", ("2", "3")), "lgpl": ("Lesser General Public License", "LGPL", ("2.1", "3")), "agpl": ("Affero General Public License", "AGPL", ("3",))}
_SAYINGS = ("this work is licensed under the GNU {} version {}", "licensed under the GNU {} version {} only", "licensed under the GNU {} version {} or later", "released under the terms of the GNU {} version {}", "distributed under the terms of the GNU {} version {}")
#: Informal statements, by a rule: each saying with a licence's full and short name and each version.
STATEMENTS = {f"{family}-{v}": tuple(s.format(name, v) for s in _SAYINGS for name in (full, short)) for family, (full, short, versions) in _FAMILIES.items() for v in versions}
TEMPLATES = {label: (*PUBLISHED.get(label, ()), *STATEMENTS.get(label, ())) for label in sorted({*PUBLISHED, *STATEMENTS})}


def read_templates(paths: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """TEMPLATES with whole licence texts from local files added, by label: for the driver, which sends them with the scan."""
    out = dict(TEMPLATES)
    for label, path in paths.items():
        with open(path, encoding="utf-8") as f:
            out[label] = (*out.get(label, ()), f.read())
    return out
