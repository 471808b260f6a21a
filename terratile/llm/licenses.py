"""License scan by ordered signature rules, in DataFrame expressions alone.

The words of a text (A-Z lower-cased, runs of digits, a-z and non-ASCII
characters) are joined by blanks.  Rules are regular expressions over that
line; a rule is tried only where a word of the line begins with its keyword.  Every match is an
interval of words, with at least the priority of every interval inside it.
Intervals are taken by priority, then longer first, then by start, then by rule
order; one that lies inside or overlaps an interval kept before it is suppressed
(one that is suppressed suppresses nothing).  The labels of
what is left join the base labels; the score is the highest priority left, in
hundredths, raised to at least 0.5 where only base phrases stand.

One pass over the texts counts the base phrases and keeps the lines that hold a
keyword; only those are tried against the rules they gate.  Intervals are
numbers; window functions cut a text's into runs that overlap, and each run,
mostly of a few, is settled by itself.  No Python runs.

Nulls: a null text is empty: no words, no places, null first and last word,
empty labels, score 0.  Repeated rows and rows without an id are scanned one by
one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terratile.llm.text import word_line
from terratile.storage import stage_table

#: Base phrases and their labels (fixed by the contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, keyword that every match of the name holds, name of the license as a
#: regular expression over words).  Written by hand from the licenses' titles.
LICENSES = [
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero clause", r"bsd zero clause"),
    ("aal", "attribution assurance", r"attribution assurance"),
    ("afl-3.0", "academic free", r"academic free(?: license)?(?: version)? 3 0"),
    ("afl", "academic free", r"academic free"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("apsl-2.0", "apple public", r"apple public source(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2 0"),
    ("artistic", "artistic", r"artistic"),
    ("beerware", "beerware", r"beerware"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model(?: license)?(?: 1 0 0)?"),
    ("bsd-1-clause", "bsd", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd)"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|revised bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("bsl-1.0", "boost", r"boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business source", r"business source(?: license)?(?: 1 1)?"),
    ("bzip2", "bzip2", r"bzip2"),
    ("catosl", "computer associates", r"computer associates trusted open source"),
    ("cc-by-nc-nd", "cc by nc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution(?: license)?(?: version)?(?: 1 0)?"),
    ("cecill-2.1", "cecill", r"cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c"),
    ("cecill", "cecill", r"cecill"),
    ("cpal-1.0", "common public attribution", r"common public attribution(?: license)?(?: version)?(?: 1 0)?"),
    ("cpl-1.0", "common public license", r"common public license(?: version)?(?: 1 0)?"),
    ("ecl-2.0", "educational community", r"educational community(?: license)?(?: version)? ?(?:2 0)?"),
    ("efl-2.0", "eiffel forum", r"eiffel forum(?: license)?"),
    ("epl-1.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public(?: license)?(?: version| v)? ?2 0"),
    ("epl", "eclipse", r"eclipse public"),
    ("edl-1.0", "eclipse", r"eclipse distribution"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?: version| v)? ?1 2"),
    ("eupl", "european union", r"european union public"),
    ("fair", "fair license", r"fair license"),
    ("frameworx", "frameworx", r"frameworx open"),
    ("ftl", "freetype", r"freetype(?: project)?"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation license(?: version)? 1 3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("hpnd", "historical permission", r"historical permission notice"),
    ("icu", "icu", r"icu"),
    ("ijg", "independent jpeg", r"independent jpeg group"),
    ("imatix", "imatix", r"imatix"),
    ("ipa", "ipa font", r"ipa font"),
    ("ipl-1.0", "ibm public", r"ibm public(?: license)?(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"isc"),
    ("jasper-2.0", "jasper", r"jasper(?: license)?(?: version)?(?: 2 0)?"),
    ("json", "json", r"json"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("libpng", "libpng", r"(?:zlib )?libpng"),
    ("libtiff", "libtiff", r"libtiff"),
    ("lpl-1.02", "lucent", r"lucent public(?: license)?"),
    ("lppl-1.3c", "latex project", r"latex project public(?: license)?(?: version)? 1 3c?"),
    ("lppl", "latex project", r"latex project public"),
    ("miros", "miros", r"miros"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("motosoto", "motosoto", r"motosoto"),
    ("mpl-1.0", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("ms-rl", "microsoft", r"microsoft reciprocal"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software)(?: license)?(?: version| v)? ?2?"),
    ("multics", "multics", r"multics"),
    ("nasa-1.3", "nasa open", r"nasa open source(?: agreement)?(?: version)?(?: 1 3)?"),
    ("naumen", "naumen", r"naumen public"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("nethack", "nethack", r"nethack general public"),
    ("nokia", "nokia open", r"nokia open source"),
    ("npl-1.1", "netscape", r"netscape public(?: license)?(?: version)?(?: 1 1)?"),
    ("nposl-3.0", "non profit open", r"non profit open software"),
    ("odbl-1.0", "open database", r"open database(?: license)?(?: 1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution"),
    ("pddl-1.0", "open data commons", r"open data commons public domain"),
    ("oclc-2.0", "oclc research", r"oclc research public"),
    ("ofl-1.1", "open font", r"(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?"),
    ("ogl-3.0", "open government", r"open government licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("ogl", "open government", r"open government"),
    ("openssl", "openssl", r"openssl"),
    ("osl-3.0", "open software license", r"open software license(?: version)?(?: 3 0)?"),
    ("php-3.01", "php", r"php license(?: version)? 3 01"),
    ("php", "php", r"php"),
    ("postgresql", "postgresql", r"postgresql"),
    ("psf-2.0", "python software", r"python software foundation"),
    ("qpl-1.0", "q public", r"q public(?: license)?(?: version)?(?: 1 0)?"),
    ("rpl-1.5", "reciprocal public", r"reciprocal public(?: license)?(?: version)?(?: 1 5)?"),
    ("rpsl-1.0", "realnetworks", r"realnetworks public source"),
    ("ruby", "ruby", r"ruby"),
    ("sgi-b-2.0", "sgi free", r"sgi free software"),
    ("sleepycat", "sleepycat", r"sleepycat"),
    ("spl-1.0", "sun public", r"sun public(?: license)?(?: version)?(?: 1 0)?"),
    ("sspl-1.0", "server side public", r"server side public(?: license)?(?: version| v)? ?1?"),
    ("ucl-1.0", "upstream compatibility", r"upstream compatibility"),
    ("unicode", "unicode", r"unicode(?: inc)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1.0", "universal permissive", r"universal permissive(?: license)?(?: version)?(?: 1 0)?"),
    ("vim", "vim", r"vim"),
    ("vsl-1.0", "vovida", r"vovida software"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice)?"),
    ("watcom-1.0", "watcom", r"(?:sybase )?(?:open )?watcom public"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("x11", "x11", r"x11"),
    ("xnet", "x net", r"x net"),
    ("zlib", "zlib", r"zlib"),
    ("zpl-2.1", "zope", r"zope public(?: license)?(?: version)?(?: 2 1)?"),
]

#: Notices that name no license: (label, keyword, expression, priority).
NOTICES = [
    ("reserved", "rights reserved", r"(?:all|some|no) rights reserved", 60),
    ("copyright", "copyright", r"copyright(?: c)?(?: [12][0-9]{3})+", 40),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated)(?: in)?(?:to| to)? the public domain", 70),
    ("public-domain", "public domain", r"this (?:work|text|software) is in the public domain", 70),
    ("proprietary", "proprietary", r"proprietary and confidential", 60),
    ("proprietary", "permission", r"(?:used|reproduced|reprinted) (?:with|by) permission", 50),
    ("no-redistribution", "redistribut", r"(?:do not|may not be) redistributed?", 60),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 90),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 85),
    ("warranty", "as is", r"provided as is without (?:any )?warranty", 30),
    ("warranty", "as is", r"distributed on an as is basis without warranties", 30),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org", 88),
    ("gpl", "general public", r"under the terms of the gnu general public license as published by the free software foundation", 88),
    ("gpl-2.0-or-later", "any later version", r"version 2 (?:of the license )?or at your option any later version", 84),
    ("gpl-3.0-or-later", "any later version", r"version 3 (?:of the license )?or at your option any later version", 84),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 88),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 80),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 80),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 82),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 84),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 86),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose", 82),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 80),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 80),
    ("bsl-1.0", "machine executable", r"machine executable object code generated by a source language processor", 80),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 88),
    ("wtfpl", "what the fuck", r"do what the fuck you want to(?: public license)?", 80),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want", 80),
    ("json", "good not evil", r"the software shall be used for good not evil", 80),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 80),
    ("php", "php", r"this product includes php software", 80),
    ("vim", "charityware", r"vim is charityware", 80),
    ("x11", "except as contained", r"except as contained in this notice the names? of", 70),
    ("artistic", "artistic control", r"some semblance of artistic control over the development", 75),
    ("agpl-3.0", "computer network", r"users interacting with it remotely through a computer network", 80),
    ("lgpl", "library under", r"redistribute this library under the terms of the gnu", 75),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 86),
    ("cc0-1.0", "waived all", r"waived all copyright and related (?:or|and) neighboring rights", 84),
    ("cc-by", "creative commons", r"licensed under a creative commons attribution", 80),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 75),
    ("mit-0", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 92),
    ("proprietary", "trade secret", r"(?:confidential|trade secret)s? (?:and|or) trade secrets?", 60),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction)(?: or (?:copying|use|distribution|reproduction))? (?:of this file |is )?(?:strictly )?prohibited", 60),
    ("evaluation", "evaluation purposes", r"for evaluation purposes only", 50),
    ("non-commercial", "commercial use", r"(?:not for|non) commercial use", 50),
]

#: How a license's name stands in a notice: (before, after, priority).
FORMS = [
    (r"(?:this (?:work|text|software|document|file|program) is )?(?:dual )?(?:re)?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?", r"(?: public)?(?: licen[cs]e)?(?: version [0-9](?: [0-9])?| v?[0-9] [0-9])?", 95),
    (r"(?:released|distributed|available|published|made available|covered|governed|provided) (?:under|by) (?:the )?(?:terms of )?(?:the )?", r"(?: public)?(?: licen[cs]e)?(?: version [0-9](?: [0-9])?| v?[0-9] [0-9])?", 90),
    (r"(?:spdx licen[cs]e identifier|licen[cs]e) ", r"", 85),
    (r"", r"(?: public)? licen[cs]e(?: version [0-9](?: [0-9])?)?", 75),
]

#: Names that need no word beside them: they mean nothing but the license.
PLAIN = {"cc0", "gplv2", "gplv3", "unlicense", "wtfpl", "cc by", "cc by nc", "cc by nd", "cc by sa", "general public", "lesser general", "library general", "affero", "lgpl", "0bsd", "zero clause"}


#: Words of which each match of a rule holds at least one; texts without any are done.
GATE = """
license licence licensed licenced relicensed relicenced released distributed available published covered governed provided cc cc0 gpl gplv2 gplv3 lgpl general affero unlicense wtfpl 0bsd zero
rights copyright public permission proprietary redistribute redistributed redistribution redistributions warranty warranties version endorse advertising altered origin executable unencumbered fuck
gpl2 gpl3 lgpl2 lgpl3 lgplv2 lgplv3 gplversion lgplversion retain evil openssl php charityware except artistic network library program waived font confidential trade unauthorized evaluation commercial
""".split()

#: Words of which each base phrase holds one.
BASE_WORDS = ["cc", "general", "reserved"]


def signatures() -> list[tuple[str, str, str, int]]:
    """All rules in order: (label, keyword, expression, priority).

    Each license in each form of notice, then names that stand alone, then the
    other notices: some hundreds of expressions.
    """
    rules = [(label, key, f"{a}(?:{name}){b}", rank) for a, b, rank in FORMS for label, key, name in LICENSES]
    rules += [(label, key, f"(?:{name})(?: licen[cs]e)?", 65) for label, key, name in LICENSES if key in PLAIN]
    return [*rules, *NOTICES]


def _places(line: Column, phrase: str) -> Column:
    """How often the words of ``phrase`` stand in a row (line padded by blanks)."""
    gone = F.replace(F.replace(line, F.lit(" "), F.lit("  ")), F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(""))
    doubled = F.length(line) + F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return ((doubled - F.length(gone)) / (len(phrase.replace(" ", "  ")) + 2)).cast("long")


def _blanks(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))


def _first(line: Column, phrase: str) -> Column:
    at = F.instr(line, f" {phrase} ")
    return F.when(at > 0, _blanks(F.substring(line, F.lit(1), at)) - 1)


def _last(line: Column, phrase: str) -> Column:
    after = F.substring_index(line, f" {phrase} ", -1)
    inside = len(phrase.split(" "))
    return F.when(F.instr(line, f" {phrase} ") > 0, _blanks(line) - _blanks(after) - 1 - inside)


def _detections(lines: DataFrame) -> DataFrame:
    """(row_no, start, end, rank, no, label) of each match in (row_no, line, present)."""
    rules = F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in zip(("no", "label", "key", "pattern", "rank"), (no, *rule), strict=True)])
            for no, rule in enumerate(signatures())
        ]
    )
    tried = lines.select("row_no", "line", F.explode(F.filter(rules, lambda r: F.array_contains("present", r["key"]))).alias("rule"))
    # A mark before and after each match cuts the line in pieces: outside, match, outside, ...
    match = F.concat(F.lit("(?<= )("), F.col("rule.pattern"), F.lit(")(?= )"))
    pieces = F.split(F.regexp_replace("line", match, F.lit("\u0001$1\u0001")), "\u0001")
    tried = tried.select("row_no", "rule.no", "rule.label", "rule.rank", F.transform(pieces, _blanks).alias("blanks")).where(F.size("blanks") > 1)
    cut = tried.select("row_no", "no", "label", "rank", F.posexplode("blanks").alias("at", "blanks"))
    before = Window.partitionBy("row_no", "no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.sum("blanks").over(before) - 1).where("at % 2 = 1")
    return placed.select("row_no", "start", (F.col("start") + F.col("blanks") + 1).alias("end"), "rank", "no", "label")


def _survivors(found: DataFrame) -> DataFrame:
    """(row_no, label, rank) of the intervals left when, by priority, each stays that meets none kept before it."""
    order = Window.partitionBy("row_no").orderBy("start", "end", "no")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.withColumn("begins", F.when(F.col("start") < reach, 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(order)).groupBy("row_no", "run")
    item = F.struct((-F.col("rank")).alias("before"), (F.col("start") - F.col("end")).alias("shorter"), "start", "no", "end", "label")
    runs = runs.agg(F.collect_list(item).alias("items"))
    inside = lambda x: lambda y: (x["start"] <= y["start"]) & (y["end"] <= x["end"])
    lifted = F.transform("items", lambda x: x.withField("before", F.array_min(F.transform(F.filter("items", inside(x)), lambda y: y["before"]))))
    runs = runs.withColumn("items", F.when(F.size("items") == 1, F.col("items")).otherwise(F.array_sort(lifted)))
    none = F.slice("items", 1, 0)
    meets = lambda x: lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    kept = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, meets(x)), acc).otherwise(F.array_append(acc, x)))
    return runs.select("row_no", F.explode(F.when(F.size("items") == 1, F.col("items")).otherwise(kept)).alias("i")).select("row_no", "i.start", "i.end", "i.label", (-F.col("i.before")).alias("rank"))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and places of base phrases, labels and score of each row."""
    lines = docs.select("doc_id", word_line(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row_no"))
    lines = lines.withColumns({"line": F.concat(F.lit(" "), "words", F.lit(" ")), "list": F.split("words", " ")})
    has = lambda some: F.arrays_overlap("list", F.array(*map(F.lit, some)))
    lines = lines.select("row_no", "doc_id", "line", F.when(F.col("words") == "", 0).otherwise(F.size("list")).cast("long").alias("n_words"), has(GATE).alias("gated"), has(BASE_WORDS).alias("based"))
    line = F.col("line")
    keys = F.array(*map(F.lit, sorted({key for _, key, _, _ in signatures()})))
    lines = lines.withColumn("present", F.when(F.col("gated"), F.filter(keys, lambda k: F.contains(line, F.concat(F.lit(" "), k)))))
    of = lambda value: F.when(F.col("based"), value)
    base = [(of(F.when(_places(line, p) > 0, F.lit(label))), F.coalesce(of(_places(line, p)), F.lit(0)), of(_first(line, p)), of(_last(line, p))) for p, label in BASE.items()]
    rows = lines.select(
        "row_no",
        "doc_id",
        "n_words",
        sum((b[1] for b in base), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[b[2] for b in base]).cast("long").alias("first_word"),
        F.greatest(*[b[3] for b in base]).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[b[0] for b in base]))).alias("base"),
        F.when(F.size("present") > 0, line).alias("line"),
        "present",
    )
    rows = stage_table(rows, "lines")
    found = _survivors(_detections(rows.where("line is not null").select("row_no", "line", "present")))
    found = found.groupBy("row_no").agg(F.collect_set("label").alias("own"), F.max("rank").alias("rank"))
    out = rows.drop("line", "present").join(found, "row_no", "left")
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", none))))
    score = F.greatest(F.coalesce(F.col("rank") / 100.0, F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
