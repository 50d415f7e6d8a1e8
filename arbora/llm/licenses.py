"""Licence recognition by sentence rules, in DataFrame functions only.

Lines are joined without their comment leaders, so a sentence may be wrapped and quoted in a source file. The words are
searched for known licence sentences, also inside longer ones but never across the end of a sentence, which yields a
sequence of sentence identifiers. Ordered rules, longer ones first, are matched against that sequence. Everything happens
inside the row: no shuffle, and the two small tables are literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import narrow, register, table

# Identifiers of licence sentences and their normalised words (lower case, letters and digits only,
# single spaces). Versions keep their digits apart: "2.0" is "2 0".
SENTENCES = {
    "mit_released": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_title": "the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 " associated documentation files the software to deal in the software without restriction including"
                 " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
                 " copies of the software and to permit persons to whom the software is furnished to do so subject to"
                 " the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or"
                  " substantial portions of the software",
    "as_is_mit": "the software is provided as is without warranty of any kind express or implied including but not"
                 " limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2_licensed": "licensed under the apache license version 2 0",
    "apache2_licensed_the": "licensed under the apache license version 2 0 the license",
    "apache2_use": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2_as_is": "unless required by applicable law or agreed to in writing software distributed under the license"
                     " is distributed on an as is basis without warranties or conditions of any kind either express or"
                     " implied",
    "gpl3_work": "this work is licensed under the gnu general public license version 3",
    "gpl2_work": "this work is licensed under the gnu general public license version 2",
    "gpl3_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                  " general public license as published by the free software foundation either version 3 of the"
                  " license or at your option any later version",
    "gpl2_later": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                  " general public license as published by the free software foundation either version 2 of the"
                  " license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without"
                    " even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted"
                 " provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and"
                  " the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions"
                  " and the following disclaimer in the documentation and or other materials provided with the"
                  " distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or"
                 " promote products derived from this software without specific prior written permission",
    "cc_by_nc_4": "licensed under cc by nc 4 0",
    "cc_by_nc_sa_4": "licensed under cc by nc sa 4 0",
    "cc_by_nc_nd_4": "licensed under cc by nc nd 4 0",
    "cc_by_sa_4": "licensed under cc by sa 4 0",
    "cc_by_nd_4": "licensed under cc by nd 4 0",
    "cc_by_4": "licensed under cc by 4 0",
    "cc0": "licensed under cc0 1 0",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all_rights": "all rights reserved",
}

# Rules in order; the first that fits at a place of the sequence takes its sentences.
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_notice", "as_is_mit"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is_mit"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache2_licensed_the", "apache2_use", "apache2_copy", "apache2_as_is"]),
    ("Apache-2.0", ["apache2_licensed_the", "apache2_use", "apache2_copy"]),
    ("Apache-2.0", ["apache2_licensed_the"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_warranty"]),
    ("GPL-2.0-or-later", ["gpl2_later", "gpl_warranty"]),
    ("GPL-3.0-or-later", ["gpl3_later"]),
    ("GPL-2.0-or-later", ["gpl2_later"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_licensed"]),
    ("Apache-2.0", ["apache2_licensed"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-2.0-only", ["gpl2_work"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa_4"]),
    ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd_4"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-ND-4.0", ["cc_by_nd_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
]

#: What stands before the text of a line in a source file: signs, or a word that only opens comments.
LEADER = r"(?im)^[^\p{L}\p{N}\n]*(?:(?:rem|dnl|c)(?=[\x20\x09]))?"
#: A sentence ends at a mark followed by white space, unless a digit comes next ("v. 2.0"). A line break or blank line ends
#: none (the Apache header has one before its address), nor do the colons and semicolons inside the GPL's sentences.
STOP = r"[.!?][\"')\]]{0,3}(?=[\x20\x09-\x0D](?![\x20\x09-\x0D]{0,8}[0-9]))"
#: A known sentence denied by the word before it, or widened by the words after it, says something else.
DENIED = r"(?<!\b(?:not|never|nor|longer|isnt|isn t|arent|aren t) )"
WIDENED = r"(?! (?:or|and) (?:later|newer|above|any later|any newer|at your option|greater|higher))"

#: The query's SQL splits like this: at a line break or at a mark followed by white space, so "2.0" stays whole.
END = r"[.;:!?][\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n"
#: The SQL's longest piece: the longest known sentence with room for marks.
LONGEST = 2 * max(map(len, SENTENCES.values()))


def rule_pattern() -> str:
    return "|".join("(?:" + "".join(f"{i}," for i in ids) + ")" for _, ids in RULES)


def sentence_pattern() -> str:
    """Any known sentence, in whole words; of two that begin at one place the longer."""
    return (r"(?<![^ ])" + DENIED + "(?:" + "|".join(sorted(SENTENCES.values(), key=len, reverse=True)) + ")(?![^ ])"
            + WIDENED)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids (in order, each followed by a comma), licenses (in order, comma-joined, repeats kept),
    n_unmatched (known sentences that no rule took).

    A null text counts as empty; repeated rows give repeated results, an empty table none; other columns are not read.
    """
    rows = narrow(docs, id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col].cast("string"), F.lit("")))
    known = _lookup({words: i for i, words in SENTENCES.items()})
    by_rule = _lookup({"".join(f"{i}," for i in ids): name for name, ids in RULES})

    stopped = F.regexp_replace(F.regexp_replace("text", LEADER, " "), STOP, " \x01 ")
    words = F.regexp_replace(F.lower(stopped), "[^\\p{L}\\p{N}\x01]+", " ")
    found = F.transform(F.regexp_extract_all(words, F.lit(sentence_pattern()), F.lit(0)), lambda s: F.element_at(known, s))
    rows = rows.select("id", F.concat_ws("", F.transform(found, lambda i: F.concat(i, F.lit(",")))).alias("ids"))
    taken = F.regexp_extract_all("ids", F.lit(rule_pattern()), F.lit(0))
    commas = F.length(F.regexp_replace("ids", "[^,]", ""))
    rest = F.length(F.regexp_replace(F.regexp_replace("ids", rule_pattern(), ""), "[^,]", ""))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("ids").alias("sentence_ids"),
        F.array_join(F.transform(taken, lambda t: F.element_at(by_rule, t)), ",").alias("licenses"),
        commas.cast("long").alias("n_sentences"), rest.cast("long").alias("n_unmatched"))


def _sql() -> str:
    known = "map {" + ", ".join(f"'{words}': '{i}'" for i, words in SENTENCES.items()) + "}"
    by_rule = "map {" + ", ".join(
        f"'{key}': '{name}'" for key, name in {"".join(f"{i}," for i in ids): n for n, ids in RULES}.items()) + "}"
    return rf"""
    with s as (
      select doc_id, list_filter(list_transform(
               string_split_regex(coalesce(text, ''), '{END}'),
               lambda x: case when length(x) <= {LONGEST}
                         then {known}[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' ')] end),
             lambda i: i is not null) as found
      from documents),
    t as (select doc_id, coalesce(array_to_string(list_transform(found, lambda i: i || ','), ''), '') as ids from s)
    select doc_id, ids as sentence_ids,
           coalesce(array_to_string(list_transform(regexp_extract_all(ids, '{rule_pattern()}'),
                                                   lambda x: {by_rule}[x]), ','), '') as licenses,
           length(regexp_replace(ids, '[^,]', '', 'g')) as n_sentences,
           length(regexp_replace(regexp_replace(ids, '{rule_pattern()}', '', 'g'), '[^,]', '', 'g')) as n_unmatched
    from t"""


@register("op7_license_scan", _sql())
def op7_license_scan(spark, sf_dir):
    """The licences that every document names or quotes."""
    return scan_licenses(table(spark, sf_dir, "documents"))
