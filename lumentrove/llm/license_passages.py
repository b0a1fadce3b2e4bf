"""Source-file headers of the licences, and the full texts beside this file, as templates of blocks and of whole files."""

from __future__ import annotations

import pkgutil

TEXT_NAMES = ["Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0"]


def full_text(name: str) -> str:
    return pkgutil.get_data("lumentrove.llm", f"license_texts/{name}.txt").decode()


TEXTS = {name: [full_text(name)] for name in TEXT_NAMES}


def gnu(name: str, version: str, thing: str = "program") -> list[str]:
    """The paragraph that grants the licence (or a later one, or this version only), and the three of the usual header."""
    start = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    later = f"{start}, either version {version} of the License, or (at your option) any later version."
    only = f"{start}, version {version} of the License."
    rest = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
    return [later, only, f"{later} {rest}", f"{only} {rest}"]


def paragraphs(name: str) -> list[str]:
    return [p for p in full_text(name).split("\n\n") if p.strip()]


APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_REST = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
ASF = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"

PASSAGES = {
    "AGPL-3.0": gnu("Affero General Public License", "3"),
    "Apache-2.0": [APACHE, f"{APACHE} {APACHE_REST}", ASF, f"{ASF} {APACHE_REST}"],
    "BSD-2-Clause": [paragraphs("BSD-2-Clause")[0], full_text("BSD-2-Clause")],
    "BSD-3-Clause": [paragraphs("BSD-3-Clause")[0], full_text("BSD-3-Clause")],
    "GPL-2.0": gnu("General Public License", "2"),
    "GPL-3.0": gnu("General Public License", "3"),
    "LGPL-2.1": gnu("Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": gnu("Lesser General Public License", "3", "library"),
    "MIT": [paragraphs("MIT")[0], " ".join(paragraphs("MIT")[:2]), full_text("MIT")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
