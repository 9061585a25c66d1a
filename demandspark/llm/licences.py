"""Licence scans by sentence rules (operator 8).

Texts are cut into pieces (at sentence ends, ';' and ':' before a blank, and
line ends) and normalised.  A known sentence is found wherever one or more
pieces in a row are its words, so it may be wrapped over lines of any width,
behind comment signs, and may hold ';', 'v. 2.0' or a blank line.  Of known
sentences that begin at the same piece the longest counts, and the next one
begins behind it.  The identifiers of a document, in order, form a sequence
that is matched against ordered licence rules.  A rule consumes what it
matches, so a longer rule stands before those that it contains.  Pieces without
an identifier are left out of the sequence.  Several wordings of a sentence
share its identifier.

Edge cases: null and empty texts have no sentences; every row gives one row;
rows with the same id and text count as one and get the same result; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: identifiers and normalised sentences of public licences --------------------------
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ApacheNotice", "licensed under the apache license version 2 0"),
    ("ApacheNotice", "licensed under the apache license version 2 0 the license"),
    ("ApacheNotice", "the asf licenses this file to you under the apache license version 2 0 the license"),
    ("ApacheNotice", "spdx license identifier apache 2 0"),
    ("ApacheYouMay", "you may not use this file except in compliance with the license"),
    ("ApacheCopyAt", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheCopyAt", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license "
                   "is distributed on an as is basis without warranties or conditions of any kind either express or "
                   "implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITNotice", "released under the mit license"),
    ("MITLicensed", "licensed under the mit license"),
    ("MITLicensed", "spdx license identifier mit"),
    ("MITPerm", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                "associated documentation files the software to deal in the software without restriction including "
                "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                "the following conditions"),
    ("MITNoticeKept", "the above copyright notice and this permission notice shall be included in all copies or "
                      "substantial portions of the software"),
    ("MITNoticeKept", "the above copyright notice and this permission notice including the next paragraph shall be "
                      "included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not "
                "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GPL3Notice", "this work is licensed under the gnu general public license version 3"),
    ("GPLFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 3 of the license "
                "or at your option any later version"),
    ("GPL2Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                 "general public license as published by the free software foundation either version 2 of the license "
                 "or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even "
                "the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("GPLReceived", "you should have received a copy of the gnu general public license along with this program"),
    ("BSDRedistribution", "redistribution and use in source and binary forms with or without modification are "
                          "permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the "
                  "distribution"),
    ("BSDEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission"),
    ("CCBYNC4Notice", "licensed under cc by nc 4 0"),
    ("CCBYNC4Work", "this work is licensed under a creative commons attribution noncommercial 4 0 international "
                    "license"),
    ("CCBY4Work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("MPL2Notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPL2Notice", "spdx license identifier mpl 2 0"),
    ("GPL3OnlyFree", "this program is free software you can redistribute it and or modify it under the terms of the "
                     "gnu general public license as published by the free software foundation version 3 of the license"),
    ("GPL2OnlyFree", "this program is free software you can redistribute it and or modify it under the terms of the "
                     "gnu general public license as published by the free software foundation version 2 of the license"),
    ("GPL3LaterSpdx", "spdx license identifier gpl 3 0 or later"),
    ("GPL2LaterSpdx", "spdx license identifier gpl 2 0 or later"),
    ("GPL3OnlySpdx", "spdx license identifier gpl 3 0 only"),
    ("GPL2OnlySpdx", "spdx license identifier gpl 2 0 only"),
    ("AGPL3Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "affero general public license as published by the free software foundation either version 3 of the "
                  "license or at your option any later version"),
    ("AGPL3Free", "spdx license identifier agpl 3 0 or later"),
    ("AGPLSee", "see the gnu affero general public license for more details"),
    ("AGPLReceived", "you should have received a copy of the gnu affero general public license along with this "
                     "program"),
    ("LGPL21Free", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
                   "lesser general public license as published by the free software foundation either version 2 1 of "
                   "the license or at your option any later version"),
    ("LGPL21Free", "spdx license identifier lgpl 2 1 or later"),
    ("LGPL3Free", "this library is free software you can redistribute it and or modify it under the terms of the gnu "
                  "lesser general public license as published by the free software foundation either version 3 of the "
                  "license or at your option any later version"),
    ("LGPL3Free", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "lesser general public license as published by the free software foundation either version 3 of the "
                  "license or at your option any later version"),
    ("LGPL3Free", "spdx license identifier lgpl 3 0 or later"),
    ("LGPLHope", "this library is distributed in the hope that it will be useful but without any warranty without even "
                 "the implied warranty of merchantability or fitness for a particular purpose"),
    ("LGPLSee", "see the gnu lesser general public license for more details"),
    ("LGPLReceived", "you should have received a copy of the gnu lesser general public license along with this "
                     "library"),
    ("LGPLReceived", "you should have received a copy of the gnu lesser general public license along with this "
                     "program"),
    ("BSD2Spdx", "spdx license identifier bsd 2 clause"),
    ("BSD3Spdx", "spdx license identifier bsd 3 clause"),
    ("ISCPerm", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                "hereby granted provided that the above copyright notice and this permission notice appear in all "
                "copies"),
    ("ISCPerm", "permission to use copy modify and distribute this software for any purpose with or without fee is "
                "hereby granted provided that the above copyright notice and this permission notice appear in all "
                "copies"),
    ("ISCPerm", "spdx license identifier isc"),
    ("ZeroBSDPerm", "permission to use copy modify and or distribute this software for any purpose with or without fee "
                    "is hereby granted"),
    ("ZeroBSDPerm", "spdx license identifier 0bsd"),
    ("ZlibPerm", "permission is granted to anyone to use this software for any purpose including commercial "
                 "applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZlibPerm", "spdx license identifier zlib"),
    ("BoostNotice", "distributed under the boost software license version 1 0"),
    ("BoostNotice", "spdx license identifier bsl 1 0"),
    ("UnlicenseNotice", "this is free and unencumbered software released into the public domain"),
    ("UnlicenseNotice", "spdx license identifier unlicense"),
    ("EPL2Notice", "this program and the accompanying materials are made available under the terms of the eclipse "
                   "public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("EPL2Notice", "spdx license identifier epl 2 0"),
    ("CCBY4Notice", "licensed under cc by 4 0"),
    ("CCBYSA4Notice", "licensed under cc by sa 4 0"),
    ("CCBYSA4Work", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC0Notice", "spdx license identifier cc0 1 0"),
)

#: Licence rules in order: the identifiers must follow each other.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheNotice", "ApacheYouMay", "ApacheCopyAt", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MITPerm", "MITNoticeKept", "MITAsIs")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLSee", "GPLReceived")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLHope", "GPLSee", "GPLReceived")),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLHope", "GPLSee")),
    ("BSD-3-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary")),
    ("GPL-3.0-or-later", ("GPLFree",)),
    ("GPL-2.0-or-later", ("GPL2Free",)),
    ("Apache-2.0", ("ApacheNotice",)),
    ("MIT", ("MITNotice",)),
    ("MIT", ("MITLicensed",)),
    ("GPL-3.0", ("GPL3Notice",)),
    ("CC-BY-NC-4.0", ("CCBYNC4Notice",)),
    ("CC-BY-NC-4.0", ("CCBYNC4Work",)),
    ("CC-BY-4.0", ("CCBY4Work",)),
    ("MPL-2.0", ("MPL2Notice",)),
    ("GPL-3.0-only", ("GPL3OnlyFree",)),
    ("GPL-2.0-only", ("GPL2OnlyFree",)),
    ("GPL-3.0-or-later", ("GPL3LaterSpdx",)),
    ("GPL-2.0-or-later", ("GPL2LaterSpdx",)),
    ("GPL-3.0-only", ("GPL3OnlySpdx",)),
    ("GPL-2.0-only", ("GPL2OnlySpdx",)),
    ("AGPL-3.0-or-later", ("AGPL3Free", "GPLHope", "AGPLSee", "AGPLReceived")),
    ("AGPL-3.0-or-later", ("AGPL3Free",)),
    ("LGPL-2.1-or-later", ("LGPL21Free", "LGPLHope", "LGPLSee", "LGPLReceived")),
    ("LGPL-2.1-or-later", ("LGPL21Free",)),
    ("LGPL-3.0-or-later", ("LGPL3Free", "LGPLHope", "LGPLSee", "LGPLReceived")),
    ("LGPL-3.0-or-later", ("LGPL3Free",)),
    ("BSD-2-Clause", ("BSD2Spdx",)),
    ("BSD-3-Clause", ("BSD3Spdx",)),
    ("ISC", ("ISCPerm",)),
    ("0BSD", ("ZeroBSDPerm",)),
    ("Zlib", ("ZlibPerm",)),
    ("BSL-1.0", ("BoostNotice",)),
    ("Unlicense", ("UnlicenseNotice",)),
    ("EPL-2.0", ("EPL2Notice",)),
    ("CC-BY-4.0", ("CCBY4Notice",)),
    ("CC-BY-SA-4.0", ("CCBYSA4Notice",)),
    ("CC-BY-SA-4.0", ("CCBYSA4Work",)),
    ("CC0-1.0", ("CC0Notice",)),
)
# -----------------------------------------------------------------------------------------------------

BREAK = r"([.!?:;])[ \t\r]+"      # the end of a sentence within a line
OTHER = r"[^a-z0-9\n]+"           # what normalisation turns into one blank


def normalised_pieces(text: Column) -> Column:
    """The normalised pieces of a text, each with a line end before and behind it; pieces without words are dropped."""
    words = F.regexp_replace(F.lower(F.regexp_replace(text, BREAK, "$1\n")), OTHER, " ")
    return F.concat(F.lit("\n"), F.regexp_replace(words, r" ?\n[ \n]*", "\n"), F.lit("\n"))


def known_pattern() -> str:
    """Finds known sentences, the longest first, that begin and end where pieces do; their words may span pieces."""
    longest = sorted((s for _, s in SENTENCES), key=len, reverse=True)
    return r"\n *(" + "|".join(s.replace(" ", r"[ \n]") for s in longest) + r")(?= ?\n)"


def recognised(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; an empty array for a null text."""
    known = F.create_map(*[F.lit(x) for sid, sentence in SENTENCES for x in (sentence, sid)])
    found = F.regexp_extract_all(normalised_pieces(text), F.lit(known_pattern()), 1)
    ids = F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))
    return F.coalesce(ids, F.array().cast("array<string>"))


def matched_rules(sequence: Column) -> Column:
    """The names of the rules that match the sequence '|id||id|...', in rule order, and what is left of it."""
    state = F.struct(F.lit("").alias("found"), sequence.alias("rest"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(ids) + "|").alias("ids"))
                      for name, ids in RULES])
    state = F.aggregate(rules, state, lambda s, r: F.when(
        F.instr(s["rest"], r["ids"]) > 0,
        F.struct(F.concat(s["found"], r["name"], F.lit(" ")).alias("found"),
                 F.replace(s["rest"], r["ids"], F.lit("#")).alias("rest"))).otherwise(s))
    return state


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_known (known sentences), sentence_ids in order, licences (sorted)."""
    out = df.select(F.col(id_col).alias(id_col), recognised(F.col(text_col)).alias("__ids"))
    ids = F.col("__ids")
    sequence = F.array_join(F.transform(ids, lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "")
    names = F.array_sort(F.array_distinct(F.split(F.trim(matched_rules(sequence)["found"]), " ", -1)))
    return out.select(id_col, F.size(ids).alias("n_known"), F.array_join(ids, " ").alias("sentence_ids"),
                      F.array_join(names, " ").alias("licences"))
