"""Whole licence texts and notices, wrapped at any width, as comments, under other holders' names."""

import random
import textwrap

import pytest

from tallyforge.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEXTS = {"MIT": MIT, "BSD-3-Clause": BSD, "ISC": ISC, "Zlib": ZLIB, "Apache-2.0": APACHE, "GPL-3.0": GPL}
HOLDERS = ["the copyright holder", "Acme", "the University of Example, Berkeley", "Foo Bar, Inc. and Sons"]


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False) or [""]))


@pytest.fixture(scope="module")
def compiled():
    return licenses.compile_rules()


@pytest.mark.parametrize("name", TEXTS)
def test_whole_texts(compiled, name):
    for width in (40, 60, 72, 80, 100, 5000):
        for mark in ("", "# ", " * ", "// "):
            text = "Copyright 2020 somebody\n\n" + wrapped(TEXTS[name].replace("{holder}", "the copyright holder"), width, mark) + "\n\nint main() {}"
            _, found, shares = licenses.measured(text, compiled)
            assert (found, shares) == ([name], [1.0]), (width, mark)


@pytest.mark.parametrize("holder", HOLDERS)
def test_holders(compiled, holder):
    for width in (45, 70, 5000):
        _, found, shares = licenses.measured(wrapped(BSD.replace("{holder}", holder), width), compiled)
        if "." not in holder:
            assert (found, shares) == (["BSD-3-Clause"], [1.0]), width
        else:  # a full stop in the name ends a sentence: the licence is found, not all of it
            assert found[0] in ("BSD-2-Clause", "BSD-3-Clause")
    endless = "neither the name of " + "x " * 30
    assert licenses.named(endless) == endless


def test_parts_count_as_parts(compiled):
    assert licenses.measured(MIT.split("\n\n")[0], compiled)[1:] == (["MIT"], [0.25])
    assert licenses.measured("\n\n".join(BSD.split("\n\n")[:3]), compiled)[1:] == (["BSD-2-Clause"], [0.6])
    assert licenses.measured("SPDX-License-Identifier: MIT", compiled)[1:] == (["MIT"], [1.0])
    assert licenses.measured(None, compiled) == ([], [], [])


def test_recall_of_texts_among_prose(compiled):
    """All texts at random widths with prose around them; one word of one sentence changed: the licence is still named where
    another of its sentences begins a rule."""
    rng, whole, changed = random.Random(4), 0, 0
    for _ in range(300):
        name = rng.choice(list(TEXTS))
        text = TEXTS[name].replace("{holder}", rng.choice(HOLDERS[:3]))
        page = " ".join(f"word{rng.randrange(99)}" for _ in range(30)) + ".\n\n" + wrapped(text, rng.randrange(40, 110)) + "\n\nmore words."
        whole += licenses.measured(page, compiled)[1:] == ([name], [1.0])
        words = page.split(" ")
        words[rng.randrange(40, len(words) - 5)] = "zebra"
        changed += bool(licenses.measured(" ".join(words), compiled)[1])
    print(whole, changed)
    assert whole == 300 and changed >= 240, (whole, changed)
