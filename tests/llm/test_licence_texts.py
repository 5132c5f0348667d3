"""Licences' own texts, wrapped at any word, as comments and unwrapped."""

import textwrap

import duckdb
import pytest
from fixtures import edge_docs

from clauselake.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
TEXTS = [
    (MIT, "MIT", "text", 4), (GPL, "GPL-3.0-or-later", "notice", 4), (GPL.replace("software: you", "software; you"), "GPL-3.0-or-later", "notice", 4),
    (MPL, "MPL-2.0", "notice-with-copy", 2), (APACHE, "Apache-2.0", "notice-the-license", 5),
]


def wrapped(text, width, leader=""):
    """The paragraphs wrapped, an empty line between two."""
    parts = [textwrap.fill(p.strip(), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n")]
    return "\n".join(leader + line for line in "\n\n".join(parts).split("\n"))


def test_licence_texts_match_however_wrapped(spark):
    rows, expect = [], []
    for text, licence, rule, n in TEXTS:
        for width in [20, 31, 40, 47, 55, 60, 66, 70, 72, 75, 78, 79, 80, 100, 10_000]:
            for leader in ["", "# ", " * ", "// "] if licence != "Apache-2.0" else [""]:
                rows.append((len(rows), "Module one.\n" + wrapped(text, width, leader) + "\nend"))
                expect.append((licence, rule, n))
    found = {}
    for r in licences.scan(edge_docs(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.licence, r.rule, r.n_sentences))
    assert {i: text for i, text in rows if found.get(i) != [expect[i]]} == {}


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 2.0. The License of this file\nsays more.",
    "Nothing here is free software. You can redistribute it under no license.",
    "Licensed under the MIT License\nand others",
    "Licensed under the\n\nMIT License.",
    "unlicensed under the MIT License.",
])
def test_other_texts_match_as_before(spark, text):
    got = [tuple(r) for r in licences.scan(edge_docs(spark, [(1, text)])).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    assert con.execute(licences.oracle()).fetchall() == got
