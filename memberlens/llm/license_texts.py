"""Wording of licenses: notices, lines and short whole texts here, long whole texts in the folder ``license_texts``."""

from __future__ import annotations

from pathlib import Path

WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so")
NOTICE = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software. ")
ADVERTISING = (
    " Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to "
    "promote the sale, use or other dealings in this Software without prior written authorization.")

SOURCE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.")
BINARY = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.")
ALL_ADVERTISING = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
    "product includes software developed by the copyright holder.")
NEITHER = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.")
DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE.")

FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
APPEAR = ", provided that the above copyright notice and this permission notice appear in all copies"
AUTHOR = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")

#: (license, kind in its notices, full name, version)
GNU = [
    ("GPL-1.0", "program", "GNU General Public License", "1"), ("GPL-2.0", "program", "GNU General Public License", "2"),
    ("GPL-3.0", "program", "GNU General Public License", "3"), ("LGPL-2.0", "library", "GNU Library General Public License", "2"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "program", "GNU Affero General Public License", "3"),
]
CC = [("CC-BY", "Attribution"), ("CC-BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC", "Attribution-NonCommercial"),
      ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-ND", "Attribution-NoDerivatives"),
      ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]


def gnu_notices() -> list[tuple[str, str]]:
    out = []
    for name, kind, title, version in GNU:
        out.append((name, f"This work is licensed under the {title}, version {version}."))
        out.append((name, f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {title} as published "
                          f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."))
    return out


def cc_notices() -> list[tuple[str, str]]:
    out = []
    for name, title in CC:
        short = name.replace("CC-", "CC ")
        for version in ("2.0", "2.5", "3.0", "4.0"):
            kind = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            out.append((f"{name}-{version}", f"Licensed under {short} {version}."))
            out.append((f"{name}-{version}", f"This work is licensed under the Creative Commons {title} {version} {kind} License."))
    return out


#: The first four texts of the list keep their places; later ones are siblings and whole texts.
SHORT_TEXTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", GRANT + NOTICE + WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    *gnu_notices(),
    *cc_notices(),
    ("MIT-0", GRANT + ". " + WARRANTY),
    ("X11", GRANT + NOTICE + WARRANTY + ADVERTISING),
    ("BSD-1-Clause", SOURCE + DISCLAIMER),
    ("BSD-2-Clause", SOURCE + BINARY + DISCLAIMER),
    ("BSD-3-Clause", SOURCE + BINARY + NEITHER + DISCLAIMER),
    ("BSD-4-Clause", SOURCE + BINARY + ALL_ADVERTISING + NEITHER + DISCLAIMER),
    ("ISC", FEE + APPEAR + AUTHOR),
    ("0BSD", FEE + AUTHOR),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def whole_texts() -> list[tuple[str, str]]:
    """Long licenses from files named after them; the driver reads them, tasks get them by broadcast."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return [(f.stem, f.read_text()) for f in files]
