from collections import defaultdict

import pytest

from arbora.llm.licenses import RULES, SENTENCES, scan_licenses
from arbora.llm.unit_dedup import JOINTS, cut, drop_repeated_units, normalise, repeated_units
from conftest import awkward_rows


@pytest.mark.parametrize("unit, least", [("sentence", 20), ("line", 1), ("line", 9)])
def test_repeated_units_against_brute_force(awkward, unit, least):
    rows = sorted((r for r in awkward_rows() if r[0] is not None), key=lambda r: r[0])
    seen, gone = {}, defaultdict(set)
    for i, text, *_ in rows:
        run = []
        for p, (a, b) in [*enumerate(cut(text or "", unit)), (None, (0, 0))]:
            plain = normalise((text or "")[a:b])
            if plain and seen.setdefault(plain, (i, p)) != (i, p):
                run.append((a, b, len(plain.split(" "))))
            elif plain or p is None:
                if sum(n for _, _, n in run) >= least:
                    gone[i] |= {(a, b) for a, b, _ in run}
                run = []
    got = drop_repeated_units(awkward, unit, least).collect()
    assert len(got) == len(awkward_rows()) and any(gone.values())
    texts = {r[0]: r[1] or "" for r in rows if r[0] != 10}
    for r in got:
        if r.doc_id in texts:
            spans = {tuple(map(int, s.split(":"))) for s in r.removed_spans.split(",") if s}
            assert spans == gone[r.doc_id] and r.n_removed == len(spans)
            assert r.removed_words == sum(len(normalise(texts[r.doc_id][a:b]).split(" ")) for a, b in spans)
            whole = cut(texts[r.doc_id], unit)
            assert r.text == JOINTS[unit].join(texts[r.doc_id][a:b] for a, b in whole if (a, b) not in spans)


def test_sentences_fill_the_text():
    for text in ("One. Two!  Three?\nfour 3.5 e.g.x ... \n\n end", "", "\n", ".", " . ! ?", "a.b.c", "é\r\nü. x", "x" * 50_000 + ". y"):
        spans = cut(text, "sentence")
        assert "".join(text[a:b] for a, b in spans) == text
    assert [t.strip() for t in (lambda t: [t[a:b] for a, b in cut(t, "sentence")])("It is 3.5 m. He said so!\nYes")] == [
        "It is 3.5 m.", "He said so!", "Yes"]


def test_a_passage_inside_lines(spark):
    passage = "The first sentence of it has nine words here. And the second one is long enough, too. Then a third sentence ends the passage."
    rows = [(1, "Own words stand before. " + passage + " More of the first text."), (2, "Quite another opening. " + passage + " Another end."),
            (3, "And the second one is long enough, too. Alone it may stay."), (4, passage.upper())]
    got = {r.doc_id: r for r in drop_repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].text == rows[2][1]
    assert got[2].text == "Quite another opening. Another end." and got[2].n_removed == 3
    assert got[4].text == "" and got[4].removed_words == 24


def test_paragraphs(spark):
    one = "first paragraph with quite a few words in it\nand a second line"
    rows = [(1, f"{one}\n\nother"), (2, f"short\n \n{one.upper()}\n\n\nend"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in drop_repeated_units(docs, "paragraph", 8).collect()}
    assert got[1].n_removed == 0 and got[2].text == "short\n\nend" and got[3].text == ""
    a, b = map(int, got[2].removed_spans.split(":"))
    assert rows[1][1][a:b] == one.upper()
    assert [(r.first_id, r.first_place) for r in repeated_units(docs, "paragraph").collect()] == [(1, 0)]


def test_no_rows(nothing):
    assert drop_repeated_units(nothing).count() == 0
    assert scan_licenses(nothing).count() == 0


def test_licences(spark, awkward):
    def quote(*ids):
        return "\n".join(SENTENCES[i].capitalize() + "." for i in ids)

    rows = [(1, "Intro.\n" + quote("mit_title", "mit_grant", "mit_notice", "as_is_mit") + "\nReleased under the MIT License."),
            (2, quote("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")), (3, quote("bsd_grant", "bsd_source", "bsd_binary")),
            (4, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.\n"),
            (5, "The mit license is not a sentence here"), (6, None), (7, quote("bsd_source")),
            (8, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {
        1: "MIT,MIT", 2: "BSD-3-Clause", 3: "BSD-2-Clause", 4: "Apache-2.0,CC-BY-NC-4.0", 5: "", 6: "", 7: "", 8: "GPL-3.0-only"}
    assert got[7].n_unmatched == 1 and got[7].sentence_ids == "bsd_source,"
    assert scan_licenses(awkward).count() == len(awkward_rows())
    assert {i for _, ids in RULES for i in ids} <= set(SENTENCES)


MIT = '''The MIT License (MIT)

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS BE LIABLE FOR ANY CLAIM.'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions.'''
GPL = '''This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.'''
BSD = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
NAMES = '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed, see above."""


def test_wrapped_headers(spark):
    known = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL.format(":", ", ", 3),
             "GPL-2.0-or-later": GPL.format(";", ";", 2), "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + NAMES, "MPL-2.0": MPL}
    leaders = ["", "# ", " * ", "// ", "! ", "-- ", ";; ", "rem ", "dnl ", "C     ", "> "]
    rows, want = [], {}
    for name, text in known.items():
        for lead in leaders:
            for end in ("\n", "\r\n"):
                want[len(rows)] = name
                rows.append((len(rows), "some code;\n/*" + end + end.join(lead + x for x in text.split("\n")) + end + "*/ more"))
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == want
    assert got[0].sentence_ids == "mit_title,mit_grant,mit_notice,as_is_mit,"
    assert all(r.n_unmatched == 0 for i, r in got.items() if want[i] in ("MIT", "Apache-2.0", "MPL-2.0"))


def test_licence_inside_a_sentence(spark):
    rows = [(1, "This project is released under the MIT License."), (2, "word " * 9000 + "all of it licensed under CC BY 4.0 since May"),
            (3, "It is not licensed under the MIT License."), (4, "Ask for the MIT. License it"),
            (5, "This work is licensed under the GNU General Public License, version 3 or later."),
            (6, "Licensed under the Apache License, Version 2.0. The License is long."),
            (7, "unlicensed under the MIT License"), (8, "licensed under the MIT Licenses"),
            (9, "The code is\nlicensed under\nthe MIT License and the data\nlicensed under CC0 1.0")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {
        1: "MIT", 2: "CC-BY-4.0", 3: "", 4: "", 5: "", 6: "Apache-2.0", 7: "", 8: "", 9: "MIT,CC0-1.0"}
    assert got[6].sentence_ids == "apache2_licensed,"


def test_only_native_nodes(spark, awkward):
    plan = scan_licenses(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
