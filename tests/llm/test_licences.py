from pyspark.sql import functions as F

from demandspark.llm import licences

from edge import edge_docs, edge_rows, empty_docs

TEXT = dict(licences.SENTENCES)


def scan(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in licences.scan_licences(df).collect()}


def test_single_sentences_and_case(spark):
    got = scan(spark, "Intro.\nReleased under the MIT License.\nrest", "LICENSED UNDER THE APACHE LICENSE, Version 2.0. And more",
               "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "nothing")
    assert [got[i]["licences"] for i in range(5)] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", ""]
    assert got[0]["sentence_ids"] == "MITNotice" and got[4]["n_known"] == 0


def test_sequences_need_their_order(spark):
    bsd = [TEXT[s] for s in ("BSDRedistribution", "BSDSource", "BSDBinary")]
    got = scan(spark, ". ".join(bsd) + ". ", ". ".join(bsd + [TEXT["BSDEndorse"]]), ". ".join(reversed(bsd)),
               "\nsomething else\n".join(bsd), TEXT["GPLFree"] + ". " + TEXT["GPLHope"] + ". " + TEXT["GPLSee"] + "\n" + TEXT["MITNotice"])
    assert [got[i]["licences"] for i in range(5)] == ["BSD-2-Clause", "BSD-3-Clause", "", "BSD-2-Clause", "GPL-3.0-or-later MIT"]


def test_consumed_parts_do_not_join_their_neighbours(spark):
    parts = ["BSDRedistribution", "ApacheNotice", "BSDSource", "BSDBinary"]
    assert scan(spark, ". ".join(TEXT[p] for p in parts))[0]["licences"] == "Apache-2.0"


def test_edge_rows(spark):
    rows = licences.scan_licences(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    assert all(r["n_known"] == 0 and r["licences"] == "" for r in rows)
    assert licences.scan_licences(empty_docs(spark)).count() == 0
    assert licences.scan_licences(edge_docs(spark).withColumn("text", F.lit("released under the mit license"))
                                  ).filter("licences = 'MIT'").count() == len(edge_rows())


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
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
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
WANTED = [(APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"),
          (MIT, "MIT"), (BSD, "BSD-3-Clause"), (BSD[:BSD.index("3. ")], "BSD-2-Clause"), (MPL, "MPL-2.0"), (ISC, "ISC"),
          (GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
          (GPL.format(";", ";", 2.1).replace("GNU General", "GNU Lesser General").replace("program", "library"),
           "LGPL-2.1-or-later")]


def test_verbatim_wrapped_texts(spark):
    for prefix, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n")):
        got = scan(spark, *["".join(prefix + line + end for line in ["int x", *t.split("\n")]) for t, _ in WANTED])
        assert [got[i]["licences"] for i in range(len(WANTED))] == [name for _, name in WANTED]
    got = scan(spark, *[" ".join(t.removeprefix("Copyright 2020 Someone").split()) for t, _ in WANTED])    # on one line
    assert [got[i]["licences"] for i in range(len(WANTED))] == [name for _, name in WANTED]
    assert got[1]["sentence_ids"] == "GPLFree GPLHope GPLSee GPLReceived"


def test_words_within_other_sentences_are_no_match(spark):
    got = scan(spark, "It is not released under the\nMIT License.", "Released under the\nMIT License or another.")
    assert [got[i]["n_known"] for i in range(2)] == [0, 0]


def test_every_sentence_on_a_line_of_its_own(spark):
    texts = [f"Intro.\n{s}.\nrest" for _, s in licences.SENTENCES]
    got = scan(spark, *texts)
    assert [got[i]["sentence_ids"] for i in range(len(texts))] == [sid for sid, _ in licences.SENTENCES]
