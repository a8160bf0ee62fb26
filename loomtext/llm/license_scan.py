"""License scans: marked-up templates become token automata that accept texts with their mandatory wording.

Markup: ``<<beginOptional>> ... <<endOptional>>`` may be missing, ``<<var;name=N;max=K>>`` stands for up to K
words of any kind; everything else is mandatory, word by word. A template is tried wherever its anchor stands: a run of
mandatory words, anywhere in it. What follows is matched forwards from there and what comes before backwards, both as
far as they reach.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import alnum_words, id_type, map_texts

#: Phrases of which every place counts, and their labels; fixed values of the contract.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public license wordings with SPDX-like markup.
TEMPLATES = {
    "mit-text": """<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;name=holder;max=40>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name=authors;max=20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;name=holder;max=40>><<endOptional>>
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=authors;max=20>> DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL <<var;name=authors;max=20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
        ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """<<beginOptional>>BSD <<var;name=clauses;max=2>> License<<endOptional>> <<beginOptional>>Copyright
        <<var;name=holder;max=40>> <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<var;name=bullet;max=1>> Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.
        <<var;name=bullet;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. <<beginOptional>><<var;name=bullet;max=1>> Neither the name of <<var;name=holder;max=20>> nor the
        names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;name=holder;max=20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;max=20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
        IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "boost-text": """<<beginOptional>>Boost Software License <<beginOptional>>Version 1.0<<endOptional>>
        <<beginOptional>>August 17th, 2003<<endOptional>><<endOptional>>
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this
        restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part,
        and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
        SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY,
        WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib-text": """<<beginOptional>>zlib License<<endOptional>> <<beginOptional>>Copyright <<var;name=holder;max=40>><<endOptional>>
        This software is provided 'as-is', without any express or implied warranty. In no event will
        <<var;name=authors;max=20>> be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:
        <<var;name=bullet;max=1>> The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required.
        <<var;name=bullet;max=1>> Altered source versions must be plainly marked as such, and must not be misrepresented
        as being the original software.
        <<var;name=bullet;max=1>> This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
        <<beginOptional>>For more information, please refer to <<var;name=url;max=4>><<endOptional>>""",
    "apache-2.0-header": """<<beginOptional>>Copyright <<var;name=holder;max=40>><<endOptional>>
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at <<var;name=url;max=8>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "gpl-header": """is free software: you can redistribute it
        and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>>
        <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation,
        either version <<var;name=version;max=2>> of the License, or (at your option) any later version.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at <<var;name=url;max=6>>""",
    "mit-notice": """under the <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "apache-2.0-notice": """Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0
        <<beginOptional>>(the "License"); you may not use this <<var;name=work;max=4>> except in compliance with the
        License.<<endOptional>>""",
    "gpl-3.0-notice": """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3
        <<beginOptional>>of the License, or (at your option) any later version<<endOptional>>""",
    "cc-by-nc-notice": """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        CC BY-NC <<beginOptional>><<var;name=version;max=2>> International<<endOptional>>""",
}

#: Mandatory words of an anchor, at most, and of a template, at least.
ANCHOR, LEAST_WORDS = 4, 2
#: Bytes of templates that a table may hold: every worker compiles them all.
TEMPLATE_BYTES = 16 << 20
_MARK = re.compile(r"<<(.*?)>>", re.S)


@dataclass
class TokenAutomaton:
    """States are numbered; a word leads on, ``any`` with every word, ``free`` without one.

    Of a template it reads what begins with ``anchor``; ``before`` is the automaton, read backwards, of all that stands before.
    """

    anchor: list[bytes] = field(default_factory=list)
    before: TokenAutomaton | None = None
    word: list[tuple[bytes, int] | None] = field(default_factory=list)
    any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.word.append(None)
        self.any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in states:
                    states.add(other)
                    todo.append(other)
        return states

    def match(self, words: list[bytes], start: int) -> tuple[int, int] | None:
        """The longest accepted stretch whose anchor stands at ``start``."""
        end = self.longest(words, start)
        if end is None or self.before is None:
            return None if end is None else (start, end)
        back = self.before.longest(words[max(0, start - len(self.before.free)) : start][::-1], 0)
        return None if back is None else (start - back, end)

    def longest(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted text that begins at ``start`` ends."""
        states, end, last = self.closed({0}), None, len(self.free) - 1
        for at in range(start, len(words) + 1):
            if last in states:
                end = at
            if not states or at == len(words):
                break
            step = {w[1] for s in states if (w := self.word[s]) and w[0] == words[at]}
            step |= {self.any[s] for s in states if self.any[s] is not None}
            states = self.closed(step)
        return end


def compile_template(text: str) -> TokenAutomaton:
    """The automaton of a template with two mandatory words at least, wherever they are. One that opens with a replaceable
    region, so with any words, needs three in a row: two common words would be found in every other text."""
    parts = _MARK.split(text)
    tree: list = []
    stack = [tree]
    for k, part in enumerate(parts):
        if k % 2 == 0:
            stack[-1] += alnum_words(part)
        elif part.startswith("beginOptional"):
            inner: list = []
            stack[-1].append(inner)
            stack.append(inner)
        elif part.startswith("endOptional"):
            if len(stack) == 1:
                raise ValueError("an optional region ends that never began")
            stack.pop()
        elif part.startswith("var"):
            stack[-1].append(int(dict(x.split("=") for x in part.split(";")[1:]).get("max", 20)))
        else:
            raise ValueError(f"unknown markup: {part}")
    if len(stack) > 1:
        raise ValueError("an optional region never ends")
    if _least_words(tree) < LEAST_WORDS:
        raise ValueError(f"a template has {LEAST_WORDS} mandatory words at least")
    begin, anchor = _anchor_of(tree)
    if isinstance(next(node for node in tree if not isinstance(node, list)), int) and len(anchor) <= LEAST_WORDS:
        raise ValueError(f"after a replaceable opening a template has more than {LEAST_WORDS} mandatory words in a row")
    out = _automaton(tree[begin:])
    out.anchor = anchor
    if begin:
        out.before = _automaton(_backwards(tree[:begin]))
    return out


def _least_words(tree: list) -> int:
    return sum(isinstance(node, bytes) for node in tree)


def _anchor_of(tree: list) -> tuple[int, list[bytes]]:
    """Where in the template its anchor is, and its words: of all runs of mandatory words the one with most words (ANCHOR
    at most), then most bytes, as long words are rare; the first of equals."""
    runs = []
    for k in range(len(tree)):
        run = list(takewhile(lambda node: isinstance(node, bytes), tree[k : k + ANCHOR]))
        runs.append((-len(run), -sum(map(len, run)), k, run))
    _, _, begin, run = min(runs, key=lambda r: r[:3])
    return begin, run


def _backwards(nodes: list) -> list:
    return [_backwards(node) if isinstance(node, list) else node for node in reversed(nodes)]


def _automaton(tree: list) -> TokenAutomaton:
    """Of nodes in order: a word (bytes), up to so many words of any kind (a number), an optional region (a list)."""
    out = TokenAutomaton()

    def build(nodes: list, at: int) -> int:
        for node in nodes:
            if isinstance(node, bytes):
                following = out.state()
                out.word[at] = node, following
                at = following
            elif isinstance(node, int):
                exit_from = [at]
                for _ in range(node):
                    following = out.state()
                    out.any[at] = following
                    at = following
                    exit_from.append(at)
                at = out.state()
                for s in exit_from:
                    out.free[s].append(at)
            else:
                before = at
                entry = out.state()
                out.free[before].append(entry)
                at = build(node, entry)
                after = out.state()
                out.free[at].append(after)
                out.free[before].append(after)
                at = after
        return at

    last = build(tree, out.state())
    final = out.state()
    out.free[last].append(final)
    return out


def templates_of(table: DataFrame, label_col: str = "label", template_col: str = "template") -> dict[str, str]:
    """Templates of a table by label; a missing or repeated label or more than TEMPLATE_BYTES of text is an error.

    Templates without a text are left out. The size is asked for before any of them is fetched.
    """
    rows = table.select(F.col(label_col).alias("label"), F.col(template_col).alias("template")).filter("template is not null")
    size, n, labels = rows.agg(F.sum(F.octet_length("template")), F.count("*"), F.count_distinct("label")).first()
    if n != labels:
        raise ValueError("every template needs a label of its own")
    if (size or 0) > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates, more than {TEMPLATE_BYTES}")
    return {r.label: r.template for r in rows.orderBy("label").collect()}


@dataclass
class Scan:
    """What a text shows: number of words, places of phrases, stretches of templates by label."""

    n_words: int
    places: list[tuple[int, str]]
    stretches: list[tuple[int, int, str]]


class LicenseScanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.templates = [(label, compile_template(text)) for label, text in templates.items()]
        self.phrases = [(b" " + b" ".join(alnum_words(p)) + b" ", label) for p, label in phrases.items()]
        self.anchors = [(b" " + b" ".join(a.anchor) + b" ", label, a) for label, a in self.templates]
        self.length = {label: len(alnum_words(p)) for p, label in phrases.items()}

    def scan(self, text: str | None) -> Scan:
        words = alnum_words(text)
        joined = b" " + b" ".join(words) + b" "
        places = [(k, label) for phrase, label in self.phrases for k in _starts(joined, phrase)]
        stretches = []
        for anchor, label, automaton in self.anchors:
            for k in _starts(joined, anchor):
                if found := automaton.match(words, k):
                    stretches.append((*found, label))
        return Scan(len(words), sorted(places), sorted(stretches))

    def digest(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        found = self.scan(text)
        starts = [k for k, _ in found.places]
        base = sorted({label for _, label in found.places})
        every = sorted({*base, *(label for _, _, label in found.stretches)})
        covered: set[int] = set()
        for k, label in found.places:
            covered.update(range(k, k + self.length[label]))
        for begin, end, _ in found.stretches:
            covered.update(range(begin, end))
        return (
            found.n_words,
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(base),
            ",".join(every),
            len(covered) / found.n_words if found.n_words else 0.0,
        )


def _starts(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which the phrase starts, overlaps included."""
    out, at, before, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        counted += joined.count(b" ", before, at)
        before = at
        out.append(counted)
        at = joined.find(phrase, at + 1)
    return out


DIGEST = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
STRETCHES = "n_words long, matches array<struct<begin:int,end:int,label:string>>"


def scan_licenses(
    df: DataFrame,
    *,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = BASE_PHRASES,
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``df``: id, n_words and the stretches of words that match, with their labels.

    With ``digest`` instead the counts, labels and the score: the share of the text's words that stand in
    a phrase or a template's stretch (0 without words). Null and empty texts match nothing; ids may be null
    or repeated; other columns are not looked at; an empty table gives an empty one; texts are read whole.
    """

    def prepare() -> Callable[[list, list], list]:
        scanner = LicenseScanner(templates, phrases)

        def matches(text: str | None) -> tuple:
            found = scanner.scan(text)
            stretches = [(k, k + scanner.length[label], label) for k, label in found.places] + found.stretches
            return found.n_words, [{"begin": b, "end": e, "label": x} for b, e, x in sorted(stretches)]

        row = scanner.digest if digest else matches
        return lambda ids, texts: [ids, *map(list, zip(*map(row, texts), strict=True))]

    return map_texts(df, f"`{id_col}` {id_type(df, id_col)}, {DIGEST if digest else STRETCHES}", prepare, id_col, text_col)
