"""License scan by sentence rules.

A text is cut into sentences at line ends and after `.`, `!`, `?` followed by white space; a sentence is normalised (A-Z
lower-cased, every run of other than a-z and 0-9 made one space, ends trimmed; a full stop inside a version number stays a
separator). A known sentence may be wrapped over several lines (up to a blank one). SPDX lines count with
their own identifiers. Known normalised sentences map to sentence identifiers; the text's identifiers, in order, are matched against
rules, each an ordered sequence of identifiers that must stand next to each other (marks of lists between them do not count),
tested in the given order at each place; the longest rule that matches at a place wins, and matching goes on behind it.

Edge cases: null or empty texts match nothing; repeated rows and null doc_ids keep their rows; an unknown sentence breaks a
sequence; an empty table gives an empty result. Narrow per-row work: no shuffle, whole texts. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm.common import append_columns

#: Known sentences and the identifiers they carry.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0": "apache-2.0-notice",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache-2.0-notice",
    "You may obtain a copy of the License at": "apache-copy",
    "Released under the MIT License": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies": "mit-condition",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3.0-notice",
    "This program is free software": "gpl-free",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-grant",
    "All rights reserved": "all-rights-reserved",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License": "apache-2.0-notice",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache-copy",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "apache-copy",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit-condition",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0-notice",
}
#: The notices of the GNU licences, in their usual wordings.
SENTENCES |= {
    f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version": f"{short}-{version if '.' in version else version + '.0'}-notice"
    for short, name, versions in (("gpl", "General Public License", ("2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")), ("agpl", "Affero General Public License", ("3",)))
    for version in versions
    for what in ("program", "library", "file")
}
SENTENCES |= {f"This work is licensed under {a}Creative Commons Attribution{kind} 4.0 International{end}": f"{short}-4.0-notice" for kind, short in (("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NonCommercial", "cc-by-nc")) for a in ("a ", "the ", "") for end in ("", " License")}
#: Conditions and notices of further licences.
SENTENCES |= {
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "This is free and unencumbered software released into the public domain": "unlicense-grant",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense-uses",
    "Distributed under the Boost Software License, Version 1.0": "bsl-1.0-notice",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib-grant",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0": "epl-2.0-notice",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution": "epl-1.0-notice",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-1.0-notice",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed": "wtfpl-grant",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0": "mpl-2.0-copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0": "mpl-2.0-copy",
}
#: The GNU notices without later versions.
SENTENCES |= {
    f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} {wording}": f"{short}-{version if '.' in version else version + '.0'}-only-notice"
    for short, name, versions in (("gpl", "General Public License", ("2", "3")), ("lgpl", "Lesser General Public License", ("2.1", "3")))
    for version in versions
    for what in ("program", "library")
    for mark in (";",)
    for wording in (f"version {version} as published by the Free Software Foundation", f"as published by the Free Software Foundation; version {version} of the License", f"as published by the Free Software Foundation, version {version}")
}
#: The further sentences of licence texts and notices.
SENTENCES |= {
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-warranty",
    "See the License for the specific language governing permissions and limitations under the License": "apache-limits",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit-warranty",
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "mit-liability",
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "mit-liability",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS": "isc-warranty",
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE": "isc-liability",
    "This software is provided 'as-is', without any express or implied warranty": "zlib-warranty",
    "In no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software": "zlib-origin",
    "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required": "zlib-acknowledgment",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "zlib-altered",
    "This notice may not be removed or altered from any source distribution": "zlib-notice-stays",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain": "unlicense-dedication",
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors": "unlicense-benefit",
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law": "unlicense-intent",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gnu-warranty",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "bsl-1.0-grant",
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor": "bsl-1.0-condition",
    "You just DO WHAT THE FUCK YOU WANT TO": "wtfpl-terms",
}
#: The same sentences under a holder's name or a plural.
SENTENCES |= {
    f"THIS SOFTWARE IS PROVIDED BY THE {who} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "bsd-warranty"
    for who in ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS", "AUTHOR")
}
SENTENCES |= {
    f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "bsd-liability"
    for who in ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS", "AUTHOR")
}
SENTENCES |= {
    **{f"See the GNU {name} for more details": "gnu-details" for name in ("General Public License", "Lesser General Public License", "Affero General Public License")},
    **{f"You should have received a copy of the GNU {name} along with this {what}": "gnu-copy" for name in ("General Public License", "Lesser General Public License", "Affero General Public License") for what in ("program", "library")},
    **{f"You should have received a copy of the GNU {name} along with this program. If not, see {www}://www.gnu.org/licenses": "gnu-copy" for name in ("General Public License", "Lesser General Public License", "Affero General Public License") for www in ("http", "https")},
    **{f"If not, see {www}://www.gnu.org/licenses": "gnu-see" for www in ("http", "https")},
}
#: Sentences with a place for a name: its words, up to MOST_NAME of them, stand for the name that the table has.
SLOTS = (("neither the name of ", " nor the names of its ", "the copyright holder"),)
MOST_NAME = 12
#: Names that short notices give a licence, and the licence.
NAMES = {"MIT License": "MIT", "Apache License 2.0": "Apache-2.0", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "Mozilla Public License 2.0": "MPL-2.0", "GNU General Public License v2.0": "GPL-2.0", "GNU General Public License v3.0": "GPL-3.0", "GNU Lesser General Public License v3.0": "LGPL-3.0", "GNU Affero General Public License v3.0": "AGPL-3.0", "Eclipse Public License 2.0": "EPL-2.0"}
SENTENCES |= {f"{said} under the {name}": f"{short.lower()}-named" for name, short in NAMES.items() for said in ("Licensed", "Released", "Distributed", "This project is licensed", "This software is licensed") if f"{said} under the {name}" not in SENTENCES}
#: Licences by ordered sequences of sentence identifiers.
RULES = (
    ("Apache-2.0", ("apache-2.0-notice", "apache-copy", "apache-warranty", "apache-limits")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl-free", "gpl-3.0-notice")),
    ("GPL-3.0", ("gpl-3.0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("all-rights-reserved", "bsd-grant")),
    ("BSD", ("bsd-grant",)),
    ("ISC", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-2.0-notice", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("Unlicense", ("unlicense-grant", "unlicense-uses", "unlicense-dedication", "unlicense-benefit", "unlicense-intent", "mit-warranty", "mit-liability")),
    ("Unlicense", ("unlicense-grant", "unlicense-uses", "unlicense-dedication", "unlicense-benefit", "unlicense-intent")),
    ("Unlicense", ("unlicense-grant", "unlicense-uses")),
    ("Unlicense", ("unlicense-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-acknowledgment", "zlib-altered", "zlib-notice-stays")),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("BSL-1.0", ("bsl-1.0-grant", "bsl-1.0-condition")),
    ("BSL-1.0", ("bsl-1.0-grant",)),
    ("BSL-1.0", ("bsl-1.0-notice",)),
    *((x, (f"{x.lower()}-notice", "gnu-warranty", "gnu-details", "gnu-copy")) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
    *((x, (f"{x.lower()}-notice", "gnu-warranty", "gnu-details")) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
    ("CC0-1.0", ("cc0-1.0-notice",)),
    *((x, (f"{x.lower()}-notice",)) for x in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-1.0", "EPL-2.0")),
    *((f"{x}-only", (f"{x.lower()}-only-notice",)) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")),
    *((x, (f"{x.lower()}-named",)) for x in NAMES.values()),
    # what stays of a text whose first sentence is changed
    ("Apache-2.0", ("apache-copy", "apache-warranty")),
    ("Apache-2.0", ("apache-warranty", "apache-limits")),
    ("MIT", ("mit-condition", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-warranty", "isc-liability")),
    ("Zlib", ("zlib-origin", "zlib-acknowledgment", "zlib-altered")),
)
#: A mark of a list, which stands between the sentences of a licence.
MARK = re.compile(r"\s*(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})?\s*")
SPDX = re.compile(r"(?i:SPDX-License-Identifier):[ \t]*([A-Za-z0-9.+() \t-]*)")
BREAK = re.compile(r"\n|(?<=[.!?])\s+")
OTHER = re.compile(r"[^a-z0-9]+")
#: What stands before a line's first word in comments.
BLANKS = " \t\r\f\v*#/;-%!<>\"'"


def normalise(sentence: str) -> str:
    return OTHER.sub(" ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)).strip()


def compile_rules(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> tuple[dict[str, str], tuple, set[str], set[str]]:
    known = {normalise(s): i for s, i in sentences.items()}
    starts = {" ".join(w[:n]) for w in map(str.split, known) for n in range(1, len(w) + 1)}
    return known, tuple(sorted(rules, key=lambda r: -len(r[1]))), {k.split(" ")[0] for k in known}, starts


def named(whole: str) -> str | None:
    """A normalised sentence with the table's name in the place of its own; None while its name goes on."""
    for before, after, name in SLOTS:
        if whole.startswith(before):
            at = whole.find(after, len(before))
            if at < 0:
                return None if len(whole[len(before) :].split(" ")) <= MOST_NAME else whole
            return before + name + whole[at:]
    return whole


def spdx(sentence: str) -> list[str]:
    """The identifiers of an SPDX line."""
    m = SPDX.search(sentence)
    words = m[1].replace("(", " ").replace(")", " ").split() if m else []
    return [f"spdx:{w.rstrip('.')}" for k, w in enumerate(words) if w not in ("AND", "OR", "WITH") and (k == 0 or words[k - 1] in ("AND", "OR"))]


def recognise(text: str | None, compiled: tuple) -> tuple[list[str], list[str]]:
    """(identifiers in order, with "?" for runs of unknown sentences; licences in order)."""
    return measured(text, compiled)[:2]


def measured(text: str | None, compiled: tuple) -> tuple[list[str], list[str], list[float]]:
    """(identifiers in order, with "?" for runs of unknown sentences; licences in order; of each the share of the sentences of its
    longest rule that were found)."""
    known, rules, heads, starts = compiled
    longest = {name: len(seq) for name, seq in reversed(rules)}  # rules come longest first
    ids: list[str] = []
    sentences = BREAK.split(text or "")
    k = 0
    while k < len(sentences):
        sentence = sentences[k]
        head = OTHER.split(sentence.lstrip(BLANKS)[:24].lower(), maxsplit=1) if sentence else [""]
        k += 1
        found = ["?"]
        if head[0] in heads or head[0] == "":
            # a wrapped sentence goes on in the next lines: the longest known one counts
            whole, n = normalise(sentence), k
            while (plain := named(whole)) is None or plain in starts:
                if plain in known:
                    found, k = [known[plain]], n
                if n == len(sentences) or not (more := normalise(sentences[n])):
                    break
                whole, n = f"{whole} {more}", n + 1
        if found == ["?"] and "SPDX" in sentence.upper():
            found = spdx(sentence) or found
        if found != ["?"] or not (MARK.fullmatch(normalise(sentence[:24])) and len(sentence) < 24) and (not ids or ids[-1] != "?"):
            ids += found
    out, shares, at = [], [], 0
    while at < len(ids):
        if ids[at].startswith("spdx:"):
            out.append(ids[at][5:])
            shares.append(1.0)
            at += 1
            continue
        for name, seq in rules:
            if tuple(ids[at : at + len(seq)]) == seq:
                out.append(name)
                shares.append(len(seq) / longest[name])
                at += len(seq)
                break
        else:
            at += 1
    return ids, out, shares


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, sentence_ids, licenses (comma-joined, in text order), n_licenses, coverage (the largest share of a licence's
    sentences that stands in the text; null without a licence) for every row of docs."""
    compiled = compile_rules(sentences, rules)

    def columns(texts: list) -> list:
        got = [measured(t, compiled) for t in texts]
        return [[",".join(i for i in ids if i != "?") for ids, _, _ in got], [",".join(x) for _, x, _ in got], [len(x) for _, x, _ in got], [max(c) if c else None for _, _, c in got]]

    fields = [("sentence_ids", pa.string(), "string"), ("licenses", pa.string(), "string"), ("n_licenses", pa.int64(), "bigint"), ("coverage", pa.float64(), "double")]
    return append_columns(docs.select("doc_id", "text"), columns, fields).drop("text")
