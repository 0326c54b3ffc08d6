"""License scans, substring dedup, near dedup, token counts and mixing on small tables."""

import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import licenses, mixing, near_dedup, substring_dedup, token_counts
from tracewright.llm import words as W

from .brute import components, removed, shingle_set, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_repeats_inside_documents_are_rows_once(spark, monkeypatch):
    """A passage that stands 1,000 times in each of two documents is as many rows as it has different runs."""
    rng = random.Random(31)
    passage, blocks = prose(rng, 60), []
    real = substring_dedup._blocks
    monkeypatch.setattr(substring_dedup, "_blocks", lambda spans: blocks.append(out := real(spans)) or out)
    rows = [(1, "start " + (passage + " ") * 1000), (2, prose(rng, 30) + " " + (passage + " ") * 1000 + prose(rng, 30)), (3, passage + " x " + passage + " " + prose(rng, 30))]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert found == removed(rows) and found[2][1] >= 60_000
    assert blocks[0].count() < 200


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 70)
    rows = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "one two"), (7, "One  two"), (8, "x" * 5000)]
    for i in range(10, 40):  # near copies of one text, with growing numbers of changes
        w = base.split()
        for _ in range(i % 10):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(40, 70):  # a common passage in different surroundings
        rows.append((i, prose(rng, rng.randrange(0, 60)) + "\n" + passage + " " + prose(rng, rng.randrange(0, 60))))
    rows += [(70, passage + " " + passage), (71, prose(rng, 20000)), (72, "café " * 60), (73, " ".join(passage.split()[3:60])), (74, " ".join(passage.split()[:49]))]
    return rows


def test_words_and_shingles_match_plain_code(texts):
    data = [t.encode() if t is not None else None for _, t in texts]
    w = W.split(data, lower=True)
    assert [[bytes(w.buffer[s:e]) for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])] == [words(t, lower=True) for _, t in texts]
    values, first = W.shingles(w)
    assert [int(b - a) for a, b in zip(first, first[1:])] == [len(shingle_set(t)) for _, t in texts]
    assert W.shingles(W.split([]))[0].size == 0


def test_near_duplicates_match_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in components(texts).items()}


def test_near_duplicates_chain_and_extra_columns(spark):
    rng = random.Random(9)
    steps, text = [], [f"t{i}" for i in range(200)]
    for i in range(12):  # each text is near the one before only
        steps.append((i, " ".join(text), 1, "x"))
        for _ in range(5):
            text[rng.randrange(200)] = f"n{rng.random()}"
    docs = frame(spark, steps, "doc_id long, text string, n long, signature string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c) in components([(s[0], s[1]) for s in steps]).items()}


def test_near_duplicates_repeated_null_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, False), (2, 1, False)], key=str)
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_substring_dedup_matches_brute_force(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == removed(texts)


def test_substring_dedup_on_few_words(spark):
    """A vocabulary so small that windows repeat everywhere, inside documents too."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 200), 2)) for i in range(30)] + [(30 + i, "a " * (40 + 5 * i)) for i in range(8)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), 12, 4).collect()}
    assert got == removed(rows, 12)


def test_substring_dedup_keeps_other_columns_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", 1), (None, text, "de", 2), (2, text + " end", "fr", 3), (2, text + " end", "fr", 3), (3, None, None, 4)]
    out = substring_dedup.remove_repeats(frame(spark, rows, "doc_id long, text string, tag string, start int")).collect()
    got = sorted(((r.doc_id, r.n_removed, r.kept_text, r.more.tag, r.more.start) for r in out), key=str)
    assert got == sorted([(1, 0, text, "en", 1), (None, 0, text, "de", 2), (2, 60, "end", "fr", 3), (2, 60, "end", "fr", 3), (3, 0, None, None, 4)], key=str)
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def thue_morse(n):
    """Two words of n letters that polynomial hashes modulo a power of two do not tell apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_regular_hashes_confuse(spark):
    one, two = thue_morse(2048)
    assert len(set(W.word_hashes(W.split([one.encode(), two.encode()])).tolist())) == 2
    rng = random.Random(12)
    base, other = prose(rng, 60, 10**6), prose(rng, 60, 10**6)
    rows = [(1, f"{base} {one}"), (2, f"{base} {two}"), (3, " ".join([one] * 30)), (4, " ".join([two] * 30)), (5, f"{one} {other}"), (6, f"{two} {other}")]
    rows += [(7, " ".join(one[:1024])), (8, " ".join(two[:1024]))]  # the same pattern over words
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed(rows)
    assert (got[2][1], got[4][1], got[6][1]) == (60, 0, 60)
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert links == components(rows) and links[4][1] == 4


def test_run_hashes_are_those_of_the_words():
    rng = random.Random(7)
    data = [" ".join(rng.choice("ab") for _ in range(400)).encode(), b"x" * 70 + b" yy " + b"x" * 71]
    w = W.split(data)
    hashes, names = W.word_hashes(w), [bytes(w.buffer[i:j]) for i, j in zip(w.start, w.end)]
    assert len(set(hashes.tolist())) == len(set(names))
    runs = W.Runs(hashes)
    for size in (1, 2, 3, 5, 10, 50, 64):
        seen = {}
        for i, h in enumerate(runs.windows(size).tolist()):
            assert seen.setdefault(tuple(names[i : i + size]), h) == h
        assert len(set(seen.values())) == len(seen)
        lo = W.np.arange(len(hashes) - size + 1)
        assert (runs.spans(lo, lo + size) == runs.windows(size)).all()


def test_chance_clusters_do_not_arise(spark):
    """A million random signatures have no coordinate in common, as 32 bits would."""
    values = W.mix(W.np.arange(12_000_000, dtype=W.np.uint64)).reshape(1_000_000, 12)
    lowest = W.mix(values) >> W.np.uint64(8)  # minima of some 300 hashes are small numbers
    posts = W.np.unique(W.mix(lowest + W.np.arange(12, dtype=W.np.uint64) * near_dedup._ODD[0]))
    assert len(posts) == 12_000_000
    docs = frame(spark, [(i, prose(random.Random(i), 30, 10**7)) for i in range(300)])
    assert all(r.component_id == r.doc_id for r in near_dedup.near_duplicates(docs).collect())


def test_substring_dedup_on_a_hot_source(spark):
    """Many documents that repeat different stretches of one text."""
    rng = random.Random(13)
    text = prose(rng, 700, 10**6).split()
    rows = [(0, " ".join(text))] + [(i, " ".join(prose(rng, 5).split() + text[(at := rng.randrange(0, 600)) : at + rng.randrange(40, 300)])) for i in range(1, 60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == removed(rows)


def test_license_rules_in_order(spark):
    head = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"
    rows = [(1, head), (2, "Prose here. All rights reserved."), (3, "Our own licence applies to this."), (4, None), (5, ""), (6, "Released under the MIT License.\nWords.\nLicensed under CC BY-NC 4.0."), (7, "ALL   RIGHTS\tRESERVED!"), (7, "text")]
    got = sorted((r.doc_id, r.licenses, r.status, r.n_unmatched) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == [(1, "Apache-2.0", "identified", 0), (2, "LicenseRef-AllRightsReserved", "identified", 0), (3, "", "partial", 1), (4, "", "none", 0), (5, "", "none", 0), (6, "CC-BY-NC-4.0,MIT", "identified", 0), (7, "", "none", 0), (7, "LicenseRef-AllRightsReserved", "identified", 0)]


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_license_notices_in_full(spark):
    texts = [GPL.format(":", ",", 3), GPL.format(";", ";", 2), MIT, BSD, APACHE, MPL]
    names = ["GPL-3.0-or-later", "GPL-2.0-or-later", "MIT", "BSD-3-Clause", "Apache-2.0", "MPL-2.0"]
    forms = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "/*\n" + "\n".join(" * " + x for x in t.splitlines()) + "\n */", lambda t: t.replace("\n", "\r\n")]
    rows = [(10 * i + k, f(t)) for i, t in enumerate(texts) for k, f in enumerate(forms)]
    rows += [(100, "All rights.\nReserved words."), (101, "All rights\n\nreserved words"), (102, "We note: all rights\nreserved. More.")]
    got = {r.doc_id: (r.licenses, r.status) for r in licenses.scan(frame(spark, rows)).collect()}
    want = {10 * i + k: (n, "identified") for i, n in enumerate(names) for k in range(len(forms))}
    assert got == want | {100: ("", "none"), 101: ("", "none"), 102: ("LicenseRef-AllRightsReserved", "identified")}


ISC = """Copyright (c) 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
HEADS = {
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n": "GPL-3.0-only",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n": "GPL-2.0-only",
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": "LGPL-3.0-only",
    "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n": "AGPL-3.0-only",
    "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n": "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": "MPL-2.0",
    "# SPDX-License-Identifier: BSD-3-Clause\nimport os\n": "BSD-3-Clause",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;\n": "GPL-2.0-or-later",
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file.)": "BSL-1.0",
}


def test_more_licenses_and_names_in_sentences(spark):
    two = BSD.replace("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n", "")
    own = BSD.replace("the copyright holder nor", "Example Widgets (Berlin) and Partners nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "EXAMPLE WIDGETS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "EXAMPLE WIDGETS")
    texts = {ISC: "ISC", LGPL: "LGPL-2.1-or-later", AGPL: "AGPL-3.0-or-later", ZLIB: "Zlib", two: "BSD-2-Clause", own: "BSD-3-Clause"} | HEADS
    rows = list(enumerate(texts)) + [(100 + i, " ".join(t.split())) for i, t in enumerate((LGPL, AGPL, ZLIB, own))]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == dict(enumerate(texts.values())) | {100: "LGPL-2.1-or-later", 101: "AGPL-3.0-or-later", 102: "Zlib", 103: "BSD-3-Clause"}
    assert licenses.scan(frame(spark, [])).collect() == []


def test_license_tables_are_consistent():
    assert all(any(k in f" {s} " for k in licenses.KEYS) for s in licenses.KNOWN)
    assert {i for parts, _ in licenses.ALL_RULES for i in parts} <= set(licenses.KNOWN.values())


def test_license_sql_agrees(spark, texts):
    rows = texts + [(100, "Version 2.0. Released under the MIT License.\nAll rights reserved."), (101, "Licensed under CC BY 4.0! copyright 2020")]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas())
    names = ["doc_id", "n_sentences", "sentence_ids", "licenses", "n_unmatched", "status"]
    want = con.execute(f"select {', '.join(names)} from ({licenses.oracle()}) order by all").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in licenses.scan(frame(spark, rows)).collect()) == want


def test_token_counts_match_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b<|endoftext|>"), (4, "word " * 700), (5, "no break  two   spaces\n\n and 日本語 🙂"), (6, "x" * 3000)]
    rows += [(10 + i, "".join(rng.choice("ab  \n.,é1 ") for _ in range(400))) for i in range(20)]
    library = Tokenizer.from_file(path)
    for size in (1 << 16, 37):  # long texts in parts, too
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(frame(spark, rows), path, part_chars=size, batch_bytes=500).collect()}
        want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
        assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}
    assert token_counts.token_counts(frame(spark, []), path).collect() == []


def mixed(spark, rows):
    return mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect()


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 80)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    out = mixed(spark, rows)
    total = sum(r["size"] for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * total, abs=4)
    for source in ("a", "b", "c", None):
        own = [r for r in out if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == round(own[0].target)
        assert own[0].target <= 2 * own[0].source_size
        assert all(r.taken <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixed(spark, rows[::-1])), key=str)


def test_mixing_sql_agrees_and_odd_tables(spark):
    rows = [(1, None, "a"), (2, "x y", "b"), (3, "x y z", None), (4, "", "b"), (5, "q " * 500, "a")]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows, "doc_id long, text string, source string").toPandas())
    want = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.oracle()}) order by 1").fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixed(spark, rows)) == want
    assert mixed(spark, []) == []
    assert [r.taken for r in mixed(spark, [(1, None, "a"), (2, "", None)])] == [0, 0]
    assert sorted(r["size"] for r in mixed(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])) == [1, 2, 2]
