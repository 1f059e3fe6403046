"""Known licence texts and notices. The wording is that of the licences."""

from __future__ import annotations

from importlib import resources

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS
)
_ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted.\n" + _AS_IS
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
    "it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
    "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)

# Licence -> whole text.
TEXTS = {
    "MIT": _MIT,
    "ISC": _ISC,
    "0BSD": _ZERO_BSD,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": _ZLIB,
}

# Licences whose whole texts are files of the folder license_files.
FILES = [
    "Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1",
    "LGPL-3.0", "MPL-1.1", "MPL-2.0",
]

# Standard headers, each known as a whole, and in Apache's and Mozilla's the line that names the licence.
_APACHE_LINE = 'Licensed under the Apache License, Version 2.0 (the "License");'
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
_GNU_END = "\nYou should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
HEADERS = [
    ("Apache-2.0", _APACHE_LINE),
    (
        "Apache-2.0",
        _APACHE_LINE + " you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS '
        'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    *[
        (key, _GNU_HEADER.format(name, version, name) + end.format(name))
        for key, name, version in (
            ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3),
            ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3),
        )
        for end in ("", _GNU_END)
    ],
]

# Licence -> names by which notices call it.
NAMES = {
    "MIT": ["MIT", "MIT License"],
    "ISC": ["ISC", "ISC License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License"],
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "GPL-2.0": ["GPL-2.0", "GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GPL-3.0", "GNU General Public License, version 3", "GPLv3"],
    "LGPL-3.0": ["LGPL-3.0", "GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["AGPL-3.0", "GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0"],
    "CC-BY-4.0": ["CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}

# Notices around a name.
NOTICES = [
    "{}",
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "Distributed under the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "This software is licensed under the {}",
    "SPDX-License-Identifier: {}",
]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every whole text, header and notice."""
    folder = resources.files(__package__).joinpath("license_files")
    whole = [(name, folder.joinpath(f"{name}.txt").read_text("utf-8")) for name in FILES]
    notices = [(key, form.format(name)) for key, names in NAMES.items() for name in names for form in NOTICES]
    return [*TEXTS.items(), *whole, *HEADERS, *notices]
