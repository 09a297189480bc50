"""License detection with ordered signature rules, in DataFrame functions only.

A text is reduced to its words: A-Z lower-cased, every other ASCII character but digits a
separator. Rules are regular expressions over the words joined by single spaces. A rule is tried
only on texts that contain its keyword. Every match is an interval of words; an interval that
lies inside one of a rule of the same or a better priority is suppressed, except that base rules
are always reported. No row is shuffled: all of it happens within the row.

Rules are names of licenses with their versions, hand-written signatures of license texts and
notices, and statements that name no license. All work on a text grows with its length, or with the
power 1.5 of the number of its matches.

Defined results: null counts as empty; no words gives 0 and nulls; repeated rows are each
reported; columns of other names pass through ``scan`` untouched, those named like its own keep
their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import places, scan as running
from .common import ascii_lower, fresh

#: Anything but a word character, in lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # plain text that the words of every match contain, with the spaces around them
    pattern: str  # over words joined by single spaces; never begins or ends within a word
    priority: int  # 0 is best
    weight: float
    base: bool = False


#: The phrases whose places are always counted.
BASE = (
    Rule("cc-by", " cc by ", "cc by", 0, 0.6, True),
    Rule("gpl", " general public license ", "general public license", 0, 0.8, True),
    Rule("reserved", " all rights reserved ", "all rights reserved", 0, 0.5, True),
)

# Fixed values, hand-written: what licenses are called, and their versions.
FAMILIES = {
    "apache": (("apache software license", "apache license"), ("1 0", "1 1", "2 0")),
    "mit": (("mit license", "mit licence", "expat license", "the mit"), ()),
    "gpl": (("gnu general public license", "gpl general public license"), ("1", "2", "3", "2 0", "3 0")),
    "lgpl": (("gnu lesser general public license", "lesser general public license", "library general public license"), ("2", "2 1", "3")),
    "agpl": (("gnu affero general public license", "affero general public license"), ("1", "3")),
    "gpl-short": (("gpl", "gplv2", "gplv3", "lgplv2", "lgplv3", "agplv3", "gnu gpl", "lgpl", "agpl"), ("1", "2", "3", "2 0", "2 1", "3 0")),
    "bsd": (("bsd license", "bsd licence", "bsd style license", "berkeley software distribution license"), ()),
    "bsd-clause": (("bsd", "2 clause", "3 clause", "4 clause", "two clause", "three clause", "four clause"), ()),
    "mpl": (("mozilla public license", "mozilla public licence"), ("1 0", "1 1", "2 0")),
    "epl": (("eclipse public license", "eclipse distribution license"), ("1 0", "2 0")),
    "cddl": (("common development and distribution license",), ("1 0", "1 1")),
    "cpl": (("common public license", "common public attribution license"), ("1 0",)),
    "eupl": (("european union public licence", "european union public license"), ("1 0", "1 1", "1 2")),
    "artistic": (("artistic license", "perl artistic license", "clarified artistic license"), ("1 0", "2 0")),
    "isc": (("isc license", "isc licence", "internet systems consortium license"), ()),
    "zlib": (("zlib license", "zlib libpng license", "zlib acknowledgement license"), ()),
    "boost": (("boost software license", "boost software licence"), ("1 0",)),
    "unlicense": (("the unlicense", "unlicense org"), ()),
    "wtfpl": (("wtfpl", "wtfpl license"), ("1 0", "2")),
    "public-domain": (("in the public domain", "into the public domain", "to the public domain", "public domain dedication", "public domain mark"), ("1 0",)),
    "cc0": (("cc0", "cc0 universal", "creative commons cc0", "creative commons zero"), ("1 0",)),
    "ofl": (("sil open font license", "open font license"), ("1 0", "1 1")),
    "odbl": (("open database license", "open data commons open database license", "open data commons attribution license"), ("1 0",)),
    "gfdl": (("gnu free documentation license", "free documentation license"), ("1 1", "1 2", "1 3")),
    "python": (("python software foundation license", "python license", "psf license"), ("2", "2 0")),
    "postgresql": (("postgresql license", "postgresql licence"), ()),
    "proprietary": (("proprietary and confidential", "proprietary license", "proprietary software"), ()),
    "busl": (("business source license", "business source licence"), ("1 0", "1 1")),
    "sspl": (("server side public license",), ("1", "1 0")),
    "elastic": (("elastic license",), ("1 0", "2 0")),
    "openssl": (("openssl license", "openssl exception", "openssl ssleay license"), ()),
    "w3c": (("w3c software notice", "w3c license", "w3c software license"), ()),
    "ms-pl": (("microsoft public license", "microsoft reciprocal license"), ("1 0",)),
    "nasa": (("nasa open source agreement",), ("1 3",)),
    "afl": (("academic free license",), ("1 1", "2 0", "2 1", "3 0")),
    "osl": (("open software license",), ("1 0", "2 0", "2 1", "3 0")),
    "qpl": (("q public license",), ("1 0",)),
    "ncsa": (("illinois ncsa open source license", "ncsa open source license"), ()),
}
CLAUSES = ("nc", "nd", "sa", "nc nd", "nc sa")
CC_NAMES = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike", "nc nd": "noncommercial noderivatives", "nc sa": "noncommercial sharealike"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Words that lead up to a name; a match takes them in, so the bare name inside is suppressed.
LEADS = ("licensed under", "released under", "distributed under", "available under", "under the terms of", "covered by", "subject to", "governed by", "provided under", "relicensed under")
#: Statements that name no license: a word of theirs, and patterns.
GENERIC = {
    "copyright": (" copyright ", ("copyright [0-9]{4}", "copyright c [0-9]{4}", "c copyright [0-9]{4}", "copyright by", "copyright holders?", "copyright notice")),
    "warranty": (" warrant", ("without warranty of any kind", "without warranties or conditions", "no warranty", "as is without warranty")),
    "disclaimer": (" all warranties ", ("disclaims? all warranties",)),
    "permission": (" permission is ", ("permission is hereby granted", "permission is granted")),
    "redistribution": (" redistribution ", ("redistribution and use in source and binary forms", "not for redistribution")),
    "except": (" this file except ", ("may not use this file except",)),
    "no-use": (" commercial use ", ("not for commercial use", "no commercial use", "non commercial use")),
    "reproduced": (" be reproduced ", ("may not be reproduced",)),
    "spdx": (" spdx ", ("spdx license identifier(?: [a-z0-9]+){1,4}",)),
    "terms": (" terms ", ("terms of use", "terms of service", "terms and conditions")),
}
# Fixed values, hand-written: wording of license texts and notices, with a part of it that must be there. Words that vary are left
# open.
SIGNATURES = (
    ("mit", " free of charge to any person obtaining ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", " free of charge to any person obtaining ", "free of charge to any person obtaining a copy of this software"),
    ("mit", " to deal in the software without ", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", " copies or substantial portions ", "permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", " to deal in the software without ", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", " except as contained in this notice ", "except as contained in this notice the names? of (?:\\w+ ){1,8}shall not be used in advertising"),
    ("bsd", " source and binary forms ", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-clause", " redistributions of source code ", "redistributions of source code must retain the above copyright notice"),
    ("bsd-clause", " redistributions in binary form ", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", " endorse or promote ", "neither the names? of (?:\\w+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote"),
    ("bsd-4-clause", " advertising materials ", "all advertising materials mentioning features or use of this software must display"),
    ("isc", " with or without fee ", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", " with or without fee ", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", " without fee is hereby granted ", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:\\w+ ){0,6}without fee is hereby granted"),
    ("apache-2.0", " apache license ", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", " in compliance with the license ", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", " terms and conditions for use reproduction ", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-1.1", " acknowledgment ", "this product includes software developed by the apache software foundation"),
    ("asf-notice", " contributor license agreements ", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", " redistribute it and or modify ", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", " any later version ", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", " any later version ", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", " free software foundation ", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl", " you should have received ", "you should have received a copy of the gnu general public license"),
    ("lgpl", " you should have received ", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", " you should have received ", "you should have received a copy of the gnu affero general public license"),
    ("lgpl", " redistribute it and or modify ", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", " redistribute it and or modify ", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-text", " verbatim copies ", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-warranty", " implied warranty of merchantability ", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("classpath-exception", " special exception ", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gcc-exception", " runtime library exception ", "gcc runtime library exception"),
    ("mpl-2.0", " source code form ", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", " contents of this file are subject ", "the contents of this file are subject to the mozilla public license"),
    ("mpl-2.0", " incompatible with secondary ", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("cddl", " common development and distribution ", "the contents of this file are subject to the terms of (?:either )?(?:the )?common development and distribution license"),
    ("epl", " accompanying materials ", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2.0", " eclipse org legal epl ", "eclipse org legal epl (?:v20|2 0)"),
    ("eupl", " european commission ", "licensed under the eupl (?:version )?(?:1 [012] )?or as soon they will be approved by the european commission"),
    ("zlib", " express or implied warranty ", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", " altered source versions ", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", " contributing authors ", "the contributing authors and group 42 inc disclaim all warranties"),
    ("ijg", " independent jpeg group ", "this software is based in part on the work of the independent jpeg group"),
    ("bsl-1.0", " boost software license ", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", " machine executable object code ", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", " free and unencumbered software ", "this is free and unencumbered software released into the public domain"),
    ("unlicense", " anyone is free to copy ", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", " extent possible under law ", "to the extent possible under law (?:\\w+ ){1,12}has waived all copyright"),
    ("cc0-1.0", " affirmer ", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("wtfpl", " do what the fuck you want ", "do what the fuck you want to public license"),
    ("wtfpl", " you just do what ", "you just do what the fuck you want to"),
    ("beerware", " beer ware license ", "the beer ware license"),
    ("beerware", " buy me a beer ", "you can buy me a beer in return"),
    ("artistic", " copyright holder maintains ", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic", " same terms as perl ", "under the same terms as perl itself"),
    ("python", " psf license agreement ", "psf license agreement for python"),
    ("python", " python software foundation ", "this license agreement is between the python software foundation"),
    ("openssl", " openssl toolkit ", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", " eric young ", "this product includes cryptographic software written by eric young"),
    ("curl", " curl ", "copyright notice and this permission notice appear in all copies curl"),
    ("postgresql", " postgresql database management ", "postgresql database management system formerly known as postgres"),
    ("unicode", " unicode data files ", "obtaining a copy of the unicode data files and any associated documentation"),
    ("ofl-1.1", " font software ", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", " reserved font name", "with reserved font names?"),
    ("gfdl", " invariant sections ", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", " invariant sections ", "with no invariant sections no front cover texts and no back cover texts"),
    ("cc-by", " attribution ", "creative commons attribution (?:international |unported |generic )?(?:public )?licen[cs]e"),
    ("cc-by-sa", " share your adaptations ", "if you share your adaptations you must (?:\\w+ ){1,12}same license"),
    ("odbl", " open database license ", "made available under the open database license http opendatacommons org"),
    ("busl-1.1", " change license ", "change date (?:\\w+ ){1,8}change license"),
    ("busl-1.1", " non production use ", "the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", " service source code ", "make the service source code available via network download to everyone at no charge"),
    ("elastic-2.0", " hosted or managed service ", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", " commons clause ", "commons clause license condition"),
    ("polyform", " polyform ", "polyform (?:noncommercial|perimeter|shield|strict|small business|free trial) license"),
    ("json", " shall be used for good ", "the software shall be used for good not evil"),
    ("ms-pl", " accompanying software ", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("rpl", " reciprocal public license ", "reciprocal public license"),
    ("ecl", " educational community license ", "educational community license version 2 0"),
    ("vim", " vim license ", "vim license"),
    ("proprietary", " trade secret", "(?:confidential|proprietary) (?:and|or) (?:\\w+ ){0,4}trade secrets?"),
    ("proprietary", " strictly prohibited ", "unauthorized (?:copying|use|distribution|reproduction) (?:\\w+ ){0,10}is strictly prohibited"),
    ("proprietary", " prior written ", "without (?:the )?(?:express )?prior written (?:permission|consent) of"),
    ("proprietary", " nondisclosure agreement ", "license agreement and (?:\\w+ ){0,4}nondisclosure agreement"),
    ("public-domain", " no copyright ", "no copyright is claimed"),
    ("public-domain", " public domain ", "(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", " united states government ", "work of the united states government"),
)
#: Parts of keywords; a text with none of them is not looked at further.
STEMS = (" licen", " reserved ", " cc", " creative commons ", " public domain ", " copyright ", " warrant", " permission is ", " redistribution ", " this file except ", " commercial use ", " be reproduced ", " spdx ", " terms ", " the mit ", "gpl", " bsd ", " clause ", " unlicense ", " wtfpl ", " proprietary ", " openssl ", " agreement ", " notice ", " exception ", " all warranties ", " software ", " copies ", " free of charge ", " source ")


def rules() -> list[Rule]:
    """All rules in order: base, named with version, creative commons, signatures, named, generic."""
    lead = "(?:(?:" + "|".join(LEADS) + ") (?:the |a |an )?)?"
    out = list(BASE)
    for label, (names, versions) in FAMILIES.items():
        for name in names:
            for v in versions:
                out.append(Rule(f"{label}-{v.replace(' ', '.')}", f" {name} ", f"{lead}{name}(?: version| v)? {v}(?: or later| only)?(?! [0-9])", 1, 0.95))
    for clause in CLAUSES:
        for v in CC_VERSIONS:
            label = f"cc-by-{clause.replace(' ', '-')}-{v.replace(' ', '.')}"
            out.append(Rule(label, f" cc by {clause} ", f"{lead}cc by {clause} {v}", 1, 0.95))
            out.append(Rule(label, " creative commons attribution ", f"{lead}creative commons attribution {CC_NAMES[clause]} {v}", 1, 0.95))
        out.append(Rule(f"cc-by-{clause.replace(' ', '-')}", f" cc by {clause} ", f"{lead}cc by {clause}", 2, 0.9))
    for v in CC_VERSIONS:
        out.append(Rule(f"cc-by-{v.replace(' ', '.')}", " cc by ", f"{lead}cc by {v}", 1, 0.95))
    out += [Rule(label, keyword, pattern, 1, 0.9) for label, keyword, pattern in SIGNATURES]
    for label, (names, _) in FAMILIES.items():
        out += [Rule(label, f" {name} ", lead + name, 2, 0.8) for name in names]
    for label, (keyword, patterns) in GENERIC.items():
        out += [Rule(label, keyword, p, 3, 0.3) for p in patterns]
    return out


def words_of(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, " "))


def count_spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, and detections: array<struct<start, end, rule, label, priority, weight, base, kept>>.

    start and end count words from 0, end exclusive; in order of start, longest first.
    """
    table = rules() if table is None else table
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    fields = [f"named_struct('rule', {i}, 'label', {quoted(r.label)}, 'keyword', {quoted(r.keyword)}, 'pattern', {quoted(f' (?:{r.pattern})(?= )')}, 'priority', {r.priority}, 'weight', {r.weight}D, 'base', {r.base})" for i, r in enumerate(table)]
    literal = F.expr(f"array({', '.join(fields)})")  # one expression: building it column by column takes seconds
    stems = sorted({next((s for s in STEMS if s in r.keyword), r.keyword) for r in table})
    own, words, found_as = (fresh(c, docs.columns) for c in ("__line", "n_words", "detections"))
    line = F.col(own)
    gate = reduce(lambda a, b: a | b, [F.contains(line, F.lit(s)) for s in stems])

    def matches(rule: Column) -> Column:
        """Intervals of one rule's matches."""

        def one(x: Column) -> Column:
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), *[rule[c].alias(c) for c in ("rule", "label", "priority", "weight", "base")])

        return F.transform(places(line, rule["pattern"], count_spaces), one)

    tried = F.filter(literal, lambda r: F.contains(line, r["keyword"]))
    found = F.flatten(F.transform(tried, matches))
    # sorted by start, longest first, then by rule: structs compare field by field
    ordered = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), x["rule"].alias("c"), x.alias("x")))), lambda y: y["x"])

    def sweep(far: Column, x: Column) -> Column:
        """far[p]: how far intervals of priority p or better that began before reach."""
        inside = F.element_at(far, x["priority"] + 1) >= x["end"]
        reach = F.transform(far, lambda f, p: F.when(p >= x["priority"], F.greatest(f, x["end"])).otherwise(f))
        return F.struct(reach.alias("state"), x.withField("kept", x["base"] | ~inside).alias("out"))

    levels = max(r.priority for r in table) + 1
    resolved = running(ordered, F.array_repeat(F.lit(-1).cast("long"), levels), sweep, KEPT)
    return (
        docs.withColumn(own, F.concat(F.lit(" "), words_of(F.col(text_col)), F.lit(" ")))
        .withColumn(words, F.when(line == "  ", 0).otherwise(count_spaces(line) - 1).cast("long"))
        .withColumn(found_as, F.when(gate, resolved).otherwise(F.expr(f"cast(array() as array<{KEPT}>)")))
        .drop(own)
    )


INTERVAL = "struct<start:bigint,end:bigint,rule:int,label:string,priority:int,weight:double,base:boolean>"
KEPT = INTERVAL[:-1] + ",kept:boolean>"


def report(scanned: DataFrame, *keys: str) -> DataFrame:
    """The digest of ``scan``: base places, labels of base and of kept detections, a score."""
    n_words, detections = scanned.columns[-2:]
    d = F.col(detections)
    base = F.filter(d, lambda x: x["base"])
    kept = F.filter(d, lambda x: x["kept"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    doubt = F.aggregate(kept, F.lit(1.0), lambda acc, x: acc * (1 - x["weight"]))
    return scanned.select(
        *keys,
        F.col(n_words).alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(kept).alias("labels"),
        F.when(F.size(kept) == 0, 0.0).otherwise(1 - doubt).alias("score"),
    )
