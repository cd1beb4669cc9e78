import random
import re

import pytest
from llm.data import AWKWARD, docs

from partita.llm import decontaminate as d
from partita.llm import html_extract as h
from partita.llm import license_scan as licences
from partita.llm import pii
from partita.llm.license_scan import license_scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_hand(rows, items, window=13):
    out = []
    for doc, text, *_ in rows:
        said, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            w = min(window, len(p))
            for i in range(len(p) - w + 1) if w else ():
                for j in range(len(said) - w + 1):
                    if said[j : j + w] == p[i : i + w]:
                        hit.update(range(j, j + w))
                        found.add("" if item is None else str(item))
        out.append((doc, len(said), len(hit), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(said)))
    return sorted(out, key=repr)


def contamination(spark, rows, items, **more):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = d.contamination(docs(spark, rows), bench, **more)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got.collect()), key=repr), got


@pytest.mark.parametrize("shard, block", [(1 << 21, 4 << 20), (40, 4 << 20), (1 << 21, 30)])
def test_contamination_equals_brute_force(spark, shard, block):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(6)] + ["É", "x9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 3, 5, 9]))) for k in range(8)] + [(8, None), (9, "W0, w1!w2"), (9, "w5 w5")]
    rows = [(k, rng.choice([", ", " "]).join([say(rng.randrange(40)), "other", say(rng.randrange(9))]), "s", "x") for k in range(40)] + [(99, "w0 w1 w2 w3 w4 w5 w0 w1 w2", "s", "x"), (100, None, "s", "x")]
    got, df = contamination(spark, rows, items, window=4, shard_words=shard, block_bytes=block)
    assert got == contamination_by_hand(rows, items, 4)
    for r in df.collect():
        ends = [x for s in r["spans"] for x in (s["start"], s["end"])]
        assert ends == sorted(ends) and len(set(ends)) == len(ends)


def test_contamination_on_awkward_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog again the"), (2, ""), (None, "one two")]
    assert contamination(spark, AWKWARD, items)[0] == contamination_by_hand(AWKWARD, items)
    assert all(r[2] == 0 for r in contamination(spark, AWKWARD, [])[0]) and contamination(spark, [], items)[0] == []


def test_index_against_scanning():
    rng = random.Random(8)
    import numpy as np

    for _ in range(40):
        text = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 80))])
        index = d.FMIndex(text, 4, sample=rng.choice([1, 3, 16]))
        for width in (1, 2, 5):
            phrases = np.array([[rng.randrange(1, 5) for _ in range(width)] for _ in range(20)])
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(len(text) - width + 1) if (text[i : i + width] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want if b > a else not want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def test_strict_rules_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1.@@-_% é") for _ in range(rng.randrange(16)))
        assert list(pii.emails(text)) == [m.span() for m in EMAIL.finditer(text)], text
        text = "".join(rng.choice("12..3 a") for _ in range(rng.randrange(20)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in IP.finditer(text)], text


def test_base_spans():
    text = "é a.b@c-d.org 10.0.0.256, 10.0.0.255, 4111 1111 1111 1111, 4111111111111112 +1 (212) 555-0100 +12 3 " + "9" * 6000
    found = pii.base_spans(text)
    assert {k: [text[a:b] for a, b in v] for k, v in found.items()} == {"email": ["a.b@c-d.org"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (212) 555-0100"]}


def test_patterns_find_what_the_rules_miss(spark):
    seeds = [(k, f"write to card number {c} please", "s", "x") for k, c in enumerate(["4111111111111111", "5500005555555559", "4012888888881881", "4222222222222220000"[:16], "6011000990139424"])]
    seeds = [r for r in seeds if pii.base_spans(r[1])["card"]]
    rows = [*seeds, (50, "write to card number 4111111111111112 please", "s", "x"), (51, "release 4111111111111112 of it", "s", "x"), (None, None, None, None), (52, "", "s", "x")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[50]["spans"] == ["card:21:37"] and got[50]["base"] == [] and got[51]["spans"] == [] and got[52]["counts"] == [0, 0, 0, 0] and got[None]["spans"] == []
    for r in seeds:
        assert got[r[0]]["spans"] == got[r[0]]["base"] == ["card:21:37"]


def test_personal_data_on_awkward_rows(spark):
    assert pii.find_personal_data(docs(spark)).count() == 11 and pii.find_personal_data(docs(spark, [])).count() == 0
    every = "b@c.de x 1.2.3.4 y 4111111111111111 z +1 212 555 0100"
    got = pii.find_personal_data(docs(spark, [(1, every, "s", "x"), (1, every, "s", "x")])).collect()
    assert len(got) == 2 and got[0]["spans"] == ["email:0:6", "ip:9:16", "card:19:35", "phone:38:53"]


def test_licences(spark):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. More", "s", "x"), (2, "ALL RIGHTS\treserved!\nThis work is licensed under the GNU General Public License, version 3.\n", "s", "x"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. Unknown. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "s", "x"),
        (4, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "s", "x"), (5, "SPDX-License-Identifier: MIT\nReleased under the MIT License.", "s", "x"), (6, None, "s", "x"), (7, "I licensed it", "s", "x"),
    ]
    got = {r["doc_id"]: (r["sentences"], r["licenses"]) for r in license_scan(docs(spark, rows)).collect()}
    assert got[1] == (["apache-notice"], ["Apache-2.0"]) and got[2] == (["reserved", "gpl3-notice"], ["GPL-3.0-only", "all-rights-reserved"])
    assert got[3] == (["mit-grant", "mit-keep"], ["MIT"]) and got[4] == (["mit-keep"], []) and got[5] == (["spdx-mit", "mit-notice"], ["MIT"]) and got[6] == got[7] == ([], [])
    assert license_scan(docs(spark)).count() == 11 and license_scan(docs(spark, [])).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(7)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    for _ in range(2000):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        held = [x for x, k in zip(a, h.lcs_mask(a, b), strict=True) if k]
        left = iter(b)
        assert all(any(x == y for y in left) for x in held) and len(held) == length(a, b)
    a, b = ([rng.randrange(40) for _ in range(n)] for n in (700, 500))
    assert sum(h.lcs_mask(a, b)) == length(a, b)


def test_page_lines():
    page = (
        "<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><header class='site'>Site</header><nav><ul><li>Home</ul></nav><!-- <p>no --><div class=\"cookie-notice\">Agree</div>"
        "<article><header><h1>Head &amp; tail</h1></header><p>One\n two<br>three <b>four</b></p><div class='share-bar'>Share</div><script>var x='</p>';</script><form><p>Mail</p></form>"
        "<aside>Side</aside><table><tr><td>x<td>y</table><section id=comments><p>Nice</section><p>&eacute;nd &co"
    )
    assert h.page_lines(page) == [(x, True) for x in ("Head & tail", "One two three four", "x y", "énd &co")]
    marked = "".join(f"<div {m}><p>x</p></div>" for m in ("id=siteFooter", "class='commentlist'", "class=leftMenu", "role=navigation", "class='article-comments'", "hidden", "class=AdBox"))
    assert h.page_lines(f"<body>{marked}<div class='commentary post-header'>y</div>") == [("y", False)]
    assert h.page_lines("<body><form id=f><p>All of it</p><nav>no</nav></form>") == [("All of it", False)]
    assert h.page_lines("") == [] and h.page_lines("<p>a</p") == [("a", False)] and h.page_lines("a < b & c") == [("a < b & c", False)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "h") for r in rows], "page_id long, url string, html string, key string, part int, host string")


def test_neighbours_are_differenced(spark):
    frame = lambda body: f"<body><div class=c1><p>Our Site</p><p>Home News</p></div><div class=c2>{body}</div><p>Copyright us</p>"
    rows = [(k, f"http://site.org/{'news' if k % 2 else 'blog'}/{k}?x={k}", frame(f"<p>Story {k} begins</p><p>and story {k} ends</p><p>Same words</p>" if k == 3 else f"<p>Story {k} begins</p><p>and story {k} ends</p>")) for k in range(12)]
    rows += [(50, "http://alone.org/a", frame("<p>Only me</p>")), (51, "http://marked.org/a", "<main><p>Same</p></main>"), (52, "http://marked.org/b", "<main><p>Same</p></main>"), (53, None, None), (54, "", ""), (0, *rows[0][1:]), (None, "http://copy.org/1", frame("<p>c</p>")), (61, "http://copy.org/2", frame("<p>c</p>"))]
    got = {}
    for r in h.extract_pages(pages(spark, rows).repartition(5)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for k in range(12):
        assert set(got[k]) == {f"Story {k} begins\nand story {k} ends" + ("\nSame words" if k == 3 else "")}
    assert len(got[0]) == 2 and got[50] == ["Our Site\nHome News\nOnly me\nCopyright us"] and got[51] == got[52] == ["Same"] and got[53] == got[54] == [""]
    assert got[61] == got[None] == ["Our Site\nHome News\nc\nCopyright us"]
    assert h.extract_pages(pages(spark, [])).count() == 0


def test_url_keys():
    assert h.url_key("https://www.X.org:80/a/b.html?q#f") == ("x.org", "/a/b") == h.url_key("http://m.x.org/a/b/") and h.url_key(None) == ("", "")
    assert h.closeness("/a/b/c", "/a/b/d") > h.closeness("/a/b/c", "/a/x/c")



def test_wrappers_and_attribute_values_are_no_frames():
    story = "<p>A long story of the valley.</p>"
    for m in ('style="overflow:hidden"', 'data-id="nav"', "title='class=menu'", 'class="has-sidebar"', "class=no-sidebar", 'class="with-banner"'):
        assert h.page_lines(f"<body><div {m}>{story}</div>") == [("A long story of the valley.", False)], m
    assert h.page_lines('<p>See <a href="/hidden-valley">the valley</a> now</p>') == [("See the valley now", False)]
    assert h.page_lines(f'<div class="sidebar-left"><div class=menu>Home</div><article>{story}</article></div>') == [("A long story of the valley.", True)]
    assert h.page_lines(f"<div id=banner>{story}</div><p>End</p>") == [("A long story of the valley.", False), ("End", False)]
    assert h.page_lines(f"<article>{story}</article><div id=comments><article class=comment><p>{'Nice ' * 50}</p></article></div><div class=related><article>Next</article></div>") == [("A long story of the valley.", True)]
    assert h.page_lines(f"<p>Short.</p><div id=comments>{story}</div>") == [("Short.", False)] and h.page_lines(f"<div hidden>{story}</div><p>x</p>") == [("x", False)]


def test_articles_keep_all_that_only_sounds_like_a_frame():
    words = ("search-results", "share-price", "menu-of-the-day", "commentary", "notice-of-intent", "ad-hoc", "modal-logic", "social-history", "related-work-survey")
    page = "<article>" + "".join(f"<div class='{w}'><p>{w}</p></div>" for w in words) + "<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><noscript><p>plain</p></noscript></article>"
    assert h.page_lines(page) == [(x, True) for x in (*words, "so x=1 holds", "plain")]
    gone = ("ad-slot-2", "cookie-message", "comments-area", "related-articles", "newsletter-form", "share-buttons", "sidebar-right", "article-comments", "page-footer")
    assert h.page_lines("<article><p>a</p>" + "".join(f"<div class='{w}'><p>{w}</p></div>" for w in gone) + "</article><noscript>on!</noscript>") == [("a", True)]


def test_extraction_equals_brute_force(spark):
    """Sites of unmarked pages: every page against the neighbour in path order that shares more of its path, by a table of lengths."""
    rng, rows, want = random.Random(12), [], {}
    for host in range(4):
        frames = [f"frame {host} {k}" for k in range(12)]
        site = []
        for k in range(rng.randrange(2, 9)):
            path = f"/{rng.choice(['a', 'b', 'news'])}/{rng.choice(['x', 'yy'])}/{k}"
            own = [f"own {host} {k} {j}" for j in range(rng.randrange(1, 6))]
            lines = [x for x in frames if rng.random() < 0.8]
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = own
            site.append((path, lines))
        site.sort()
        for k, (path, lines) in enumerate(site):
            near = [site[j] for j in (k - 1, k + 1) if 0 <= j < len(site)]
            score = lambda o: (next((i for i, (x, y) in enumerate(zip(path.split("/"), o[0].split("/"))) if x != y), 9), next(i for i, (x, y) in enumerate(zip(path, o[0])) if x != y))  # noqa: B023, B905, E731
            other = max(near, key=score)[1]
            table = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
            for i in range(len(lines) - 1, -1, -1):
                for j in range(len(other) - 1, -1, -1):
                    table[i][j] = table[i + 1][j + 1] + 1 if lines[i] == other[j] else max(table[i + 1][j], table[i][j + 1])
            kept, i, j = [], 0, 0
            while i < len(lines):
                if j < len(other) and lines[i] == other[j]:
                    i, j = i + 1, j + 1
                elif j < len(other) and table[i][j + 1] >= table[i + 1][j]:
                    j += 1
                else:
                    kept.append(lines[i])
                    i += 1
            want[len(rows)] = "\n".join(kept)
            rows.append((len(rows), f"http://h{host}.org{path}", "<body>" + "".join(f"<p>{x}</p>" for x in lines)))
    got = {r["page_id"]: r["text"] for r in h.extract_pages(pages(spark, rows).repartition(4)).collect()}
    assert got == want and sum("frame" in x for x in want.values()) < len(rows)


def test_heavy_frames_are_deleted_and_copies_skipped(spark):
    frame = "".join(f"<p>Frame line {k}</p>" for k in range(18))
    page = lambda *said: frame + "".join(f"<p>{x}</p>" for x in said)
    rows = [(k, f"http://heavy.org/a/{k}", page(f"First paragraph of {k}", f"Second of {k}")) for k in range(4)]
    rows += [(10, "http://stub.org/a", page(*(f"Long article line {k}" for k in range(82)))), (11, "http://stub.org/b", page("Stub"))]
    same = [f"The copied story goes on and on, part {k}" for k in range(20)]
    rows += [(20 + k, f"http://run.org/p/{k}", page(*same, f"{k}")) for k in range(6)] + [(30, "http://run.org/q/1", page("Another story"))]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(pages(spark, rows).repartition(3)).collect()}
    for k in range(4):
        assert got[k] == f"First paragraph of {k}\nSecond of {k}"
    assert got[10].split("\n") == [f"Long article line {k}" for k in range(82)] and got[11] == "Stub"
    for k in range(6):
        assert got[20 + k].split("\n") == [*same, str(k)]
    assert got[30] == "Another story"


def test_blocks_keep_rows_apart(spark):
    rows = [(None, "one two three four", "s", "x"), (None, "x y z other", "s", "x"), (7, "one two three four", "s", "x"), (7, "a b c d", "s", "x"), (7, "a b c d", "s", "x")]
    items = [(1, "one two"), (2, "y z"), (3, "three four")]
    assert contamination(spark, rows, items, block_bytes=5)[0] == contamination_by_hand(rows, items)


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the Some University nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


LGPL = GPL.replace("General", "Lesser General").replace("version 3", "version 2.1").replace("This program", "This library").replace("this program", "this library")
AGPL = GPL.replace("General", "Affero General")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
BSL = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute"""
EPL = """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0/
 *
 * SPDX-License-Identifier: EPL-2.0"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"""
BSD4 = BSD + """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes software."""
MIT0 = MIT[: MIT.index(", subject to")] + ".\n" + MIT[MIT.index("\nTHE SOFTWARE") :]


def test_stems_leave_no_sentence_out():
    assert all(re.search(licences.STEMS, x) for x in [*licences.SENTENCES.values(), *licences.VARIANTS])
    known = {*licences.SENTENCES, *licences.VARIANTS.values()}
    assert all(i in known for rule, _ in licences.RULES + licences.LATER for i in rule) and not set(licences.SENTENCES.values()) & set(licences.VARIANTS)


def test_more_licences_and_comment_leaders(spark):
    given = [(LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"), (ISC, "ISC"), (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), "0BSD"), (ZLIB, "Zlib"), (BSL, "BSL-1.0"), (EPL, "EPL-2.0"), (UNLICENSE, "Unlicense"), (BSD4, "BSD-4-Clause"), (MIT0, "MIT-0"), (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later"),
             ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0")]
    texts = [(x, [n]) for x, n in given] + [(BSD + "\nAnd for the rest:\n" + BSD + BSD3, ["BSD-2-Clause", "BSD-3-Clause"]), (BSD + BSD3 + "\n" + BSD + BSD3, ["BSD-3-Clause"])]
    for lead in ("", "// ", "# ", " * ", "-- ", "; "):
        led = ["\n".join((lead + x).rstrip() for x in t.split("\n")) for t, _ in texts]
        got = {r["doc_id"]: r["licenses"] for r in license_scan(docs(spark, [(k, t, "s", "x") for k, t in enumerate(led)])).collect()}
        assert [got[k] for k in range(len(texts))] == [n for _, n in texts], lead


def test_licence_texts_as_they_are_published(spark):
    given = [(APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + BSD3, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (MPL, "MPL-2.0"), ("This code is licensed under the MIT license.", "MIT"), ("x\r\nReleased under\r\nthe MIT License\r\ny", "MIT")]
    got = {r["doc_id"]: (r["sentences"], r["licenses"]) for r in license_scan(docs(spark, [(k, t, "s", "x") for k, (t, _) in enumerate(given)])).collect()}
    assert [got[k][1] for k in range(len(given))] == [[x] for _, x in given]
    assert got[0][0] == ["apache-notice", "apache-use", "apache-copy"] and got[1][0] == ["mit-grant", "mit-keep", "as-is"]


def test_contexts_find_other_shapes(spark):
    rows = [(k, f"call me on +1 ({200 + k}) 555-0{k}13 tonight", "s", "x") for k in range(4)] + [(10 + k, f"my mail is joe{k}@site{k}.org now", "s", "x") for k in range(4)]
    rows += [(30, "call me on 0171 555 77 13 tonight", "s", "x"), (31, "my mail is joe at site dot org now", "s", "x"), (32, "it sold 0171 555 77 13 units", "s", "x"), (33, "look at site.org there", "s", "x"), (34, "call me on 4 tonight", "s", "x")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[30] == ["phone:11:25"] and got[31] == ["email:11:30"] and got[32] == got[33] == got[34] == []
    assert len(pii.instances("9 " * 20_000 + "a at b.c " * 2000, pii.base_spans(""))) > 2


def spans_by_hand(rows, threshold=pii.THRESHOLD, rounds=pii.ROUNDS, min_seeds=pii.MIN_SEEDS):
    """The strict rules by plain patterns and loops, the graph by dictionaries."""
    out, hits = [], []
    for doc, text, *_ in rows:
        text = text or ""
        base = {"email": [m.span() for m in EMAIL.finditer(text)], "ip": [], "card": [], "phone": []}
        base["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
            if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                base["card"].append(m.span())
        base["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        out.append((doc, base))
        for seed, a, b in pii.instances(text, base):
            what = pii.coarse(text[a:b]) if seed is None else "number" if seed in ("card", "phone") else seed
            may = {k for k in (("card", "phone") if what == "number" else (what,)) if pii.fits(k, text[a:b])}
            hits.append((len(out) - 1, seed, a, b, text[a:b], pii.contexts(text, a, b, what), may))
    seeds = {(x, seed): 1.0 for _, seed, _, _, x, _, _ in hits if seed}
    patterns = {p for h in hits for p in h[5]}
    named = {(p, k): {h[4] for h in hits if h[1] == k and p in h[5]} for p in patterns for k in pii.KINDS}
    enough = [key for key, xs in named.items() if len(xs) >= min_seeds]
    known, score = dict(seeds), {}
    for _ in range(rounds):
        score = {(p, k): sum(known.get((h[4], k), 0) for h in hits if p in h[5] and k in h[6]) / sum(p in h[5] for h in hits) for p, k in enough}
        known = dict(seeds)
        for (p, k), x in score.items():
            for h in hits:
                if p in h[5] and k in h[6] and score[p, k] > 0:
                    known[h[4], k] = max(known.get((h[4], k), 0), x)
    added = {}
    for row, seed, a, b, _, ps, may in hits:
        best = max(((x, k) for (p, k), x in score.items() if seed is None and p in ps and k in may and x >= threshold), default=None)
        if best:
            added.setdefault(row, []).append((pii.KINDS.index(best[1]), a, b))
    result = []
    for row, (doc, base) in enumerate(out):
        listed = [f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k]]
        every = sorted([(i, a, b) for i, k in enumerate(pii.KINDS) for a, b in base[k]] + added.get(row, []))
        result.append((doc, [len(base[k]) for k in pii.KINDS], listed, [f"{pii.KINDS[i]}:{a}:{b}" for i, a, b in every]))
    return sorted(result, key=repr)


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(21)
    seeds = ["joe{}@site{}.org", "10.0.{}.{}", "+1 212 555 0{}1{}", "4111 1111 1111 1111", "5500005555555559", "4012-8888-8888-1881"]
    other = ["joe{} at site{} dot org", "10[.]0[.]{}[.]{}", "0212 555 0{}1{}", "4111 1111 1111 11{}{}", "999.1.1.{}{}", "{}@{}", "a{}@b{}", "7{}8{}", "@x{}{}", "1.2.3.4.5.6"]
    rows = []
    for k in range(240):
        what = rng.choice(seeds + other).format(rng.randrange(10), rng.randrange(10))
        lead, tail = rng.choice([("mail me at", "please"), ("call", "now"), ("host", "is up"), ("card no", ","), ("", ""), ("x", "é")])
        rows.append((k if k % 9 else None, " ".join(rng.choice(["so", "it", "12", "we 3"]) for _ in range(rng.randrange(4))) + f" {lead} {what} {tail}", "s", "x"))
    got = sorted(((r["doc_id"], list(r["counts"]), list(r["base"]), list(r["spans"])) for r in pii.find_personal_data(docs(spark, rows).repartition(5), threshold=0.3).collect()), key=repr)
    assert got == spans_by_hand(rows, threshold=0.3) and any(r[2] != r[3] for r in got)


def test_recall_of_unseen_identifiers(spark):
    """Of planted identifiers that no strict rule matches, in contexts that seeds share, at least 0.9 are found; nothing else is."""
    rng = random.Random(5)
    place = {"email": [("contact", "directly"), ("mailto", "today"), ("e-mail:", "(office)")], "phone": [("telephone", "anytime"), ("dial", "first"), ("fax", "only")], "card": [("charge card", "exp"), ("visa", "valid"), ("debit", "cvv")], "ip": [("server", "responded"), ("ping", "failed"), ("from", "port")]}
    seed = {"email": "u{}@mail{}.example.org", "phone": "+44 20 79{:02}6 0{:02}8", "card": None, "ip": "192.168.{}.{}"}
    unseen = {"email": ["u{} at mail{} dot example dot org", "u{} [at] mail{}.org", "ü{}@mail{}.de"], "phone": ["020 79{:02} 06{:02}8", "(020) 79{:02}-6{:02}11"], "card": ["4111 1111 2{:02}1 1{:02}2", "41111111{:02}11{:02}13"], "ip": ["192[.]168[.]{}[.]{}", "fe80::1:{}:{}:1"]}
    rows, want = [], {}

    def say(kind, what, planted):
        lead, tail = rng.choice(place[kind])
        text = f"{rng.choice(['well', 'then', 'so'])} {lead} {what} {tail} {rng.choice(['ok', 'bye', 'yes'])}"
        if planted:
            want[len(rows)] = f"{kind}:{text.index(what)}:{text.index(what) + len(what)}"
        rows.append((len(rows), text, "s", "x"))

    for kind in pii.KINDS:
        for k in range(60):
            number = f"4{rng.randrange(10**14):014}"
            card = next(x for x in (f"{number}{c}" for c in range(10)) if pii.luhn(x))
            say(kind, card if kind == "card" else seed[kind].format(k, 99 - k), False)
        for _ in range(25):
            what = rng.choice(unseen[kind]).format(rng.randrange(10, 99), rng.randrange(10, 99))
            if not any(pii.base_spans(what).values()):
                say(kind, what, True)
    rows += [(1000 + k, rng.choice(["sold 12{:02}5 55{:02} units of", "meet at noon {} dot {} ", "part no 41111111{:02}11{:02}13 is", "a 12 {} of 3 {}"]).format(rng.randrange(10, 99), rng.randrange(10, 99)), "s", "x") for k in range(100)]
    got = {r["doc_id"]: set(r["spans"]) - set(r["base"]) for r in pii.find_personal_data(docs(spark, rows)).collect()}
    caught = sum(x in got[k] for k, x in want.items())
    assert len(want) > 80 and caught >= 0.9 * len(want), (caught, len(want), [(rows[k][1], got[k], x) for k, x in want.items() if x not in got[k]][:10])
    assert sum(len(x) for k, x in got.items() if k not in want) == 0


def test_marked_pages_are_differenced_too(spark):
    from partita.llm.html_extract import extract_pages

    pages = [
        (1, "http://a.example/x/1", "<article><p>first story</p><p>said by both</p><p>read our letter</p></article>"),
        (2, "http://a.example/x/2", "<article><p>second story</p><p>said by both</p></article><p>read our letter</p>"),
    ]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "first story\nsaid by both", 2: "second story\nsaid by both"}
