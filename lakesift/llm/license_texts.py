"""Known licence texts and notices (public texts; the copyright lines do not count).

The long ones are files of ``license_files``, named by their ids.
"""

from importlib.resources import files

# Texts that a whole document may consist of.
_PERMIT = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.\n"
)
LICENSES = {
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.\n\n" + _PERMIT + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.\n"
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <owner>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.\n"
    ),
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) <year>, <owner>\nAll rights reserved.\n\n" + _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) <year>, <owner>\nAll rights reserved.\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": (
        "zlib License\n\nCopyright (c) <year> <owner>\n\n"
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.\n"
    ),
    "notice-MIT": "Released under the MIT License.",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
_TITLED = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib")
#: Where each file's text begins after its title.
_BEGINS = {
    "Apache-2.0": "TERMS AND CONDITIONS FOR USE",
    "Artistic-1.0-Perl": "Preamble",
    "CC0-1.0": "CREATIVE COMMONS CORPORATION",
    "GFDL-1.2": "0. PREAMBLE",
    "GFDL-1.3": "0. PREAMBLE",
    "GPL-1.0": "Preamble",
    "GPL-2.0": "Preamble",
    "GPL-3.0": "Preamble",
    "LGPL-2.0": "Preamble",
    "LGPL-2.1": "Preamble",
    "LGPL-3.0": "This version of the GNU Lesser",
    "MPL-1.1": "1. Definitions.",
    "MPL-2.0": "1. Definitions",
}
_END = "END OF TERMS AND CONDITIONS"


def _variants(name: str, text: str, begin: str) -> dict[str, str]:
    """The text, and without its title and what follows the terms."""
    found = {name: text, f"{name} without title": text[text.index(begin) :]}
    if _END in text:
        found |= {f"{k} without appendix" if k == name else f"{k} and appendix": v[: v.index(_END) + len(_END)] for k, v in list(found.items())}
    return found


LICENSES |= {f"{k} without title": LICENSES[k].split("\n\n", 1)[1] for k in _TITLED}
for _name, _begin in _BEGINS.items():
    LICENSES |= _variants(_name, (files(__package__) / "license_files" / f"{_name}.txt").read_text("utf-8"), _begin)
