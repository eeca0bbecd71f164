"""License scans: ordered signature rules behind a keyword prefilter, without user functions.

A text's A-Z are lower-cased and its words joined by single spaces. A text without any of the
``GATE`` stems has no detection; in the others, only rules whose keyword occurs are matched.
A detection is the interval of words' characters that a rule matches. Detections are swept
by start, longer ones first, earlier rules first among equals: one that lies inside an
interval already seen is suppressed ("gnu lesser general public license" is no "general
public license" of its own). The sweep keeps the furthest end and the labels found.

The three base phrases are counted at all places and their labels always stay.

Defined cases: a null text is an empty text, without words or labels; rows are neither
dropped nor merged; other columns pass through, results replace columns so named.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.llm.common import apart, together

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Every rule's keyword contains one of these.
GATE = "licen copyright copyleft warrant permission redistribut domain spdx commons gpl eula reserved proprietary confidential trademark patent unlicense wtfpl mozilla acknowledgement evil".split()

#: label ; confidence ; keyword ; pattern over words with single spaces. First rules win ties.
RULES_TEXT = r"""
mit ; 1 ; spdx ; spdx license identifier mit
mit-0 ; 1 ; spdx ; spdx license identifier mit 0
apache ; 1 ; spdx ; spdx license identifier apache( \d){1,2}
gpl ; 1 ; spdx ; spdx license identifier gpl \d( \d)?( only| or later)?
lgpl ; 1 ; spdx ; spdx license identifier lgpl \d( \d)?( only| or later)?
agpl ; 1 ; spdx ; spdx license identifier agpl \d( \d)?( only| or later)?
bsd ; 1 ; spdx ; spdx license identifier bsd \d clause
bsd ; 1 ; spdx ; spdx license identifier 0bsd
mpl ; 1 ; spdx ; spdx license identifier mpl \d \d
isc ; 1 ; spdx ; spdx license identifier isc
zlib ; 1 ; spdx ; spdx license identifier zlib
boost ; 1 ; spdx ; spdx license identifier bsl 1 0
epl ; 1 ; spdx ; spdx license identifier epl \d \d
eupl ; 1 ; spdx ; spdx license identifier eupl \d \d
cddl ; 1 ; spdx ; spdx license identifier cddl \d \d
cc-by ; 1 ; spdx ; spdx license identifier cc by \d \d
cc-by-sa ; 1 ; spdx ; spdx license identifier cc by sa \d \d
cc-by-nc ; 1 ; spdx ; spdx license identifier cc by nc( sa| nd)? \d \d
cc0 ; 1 ; spdx ; spdx license identifier cc0( 1 0)?
unlicense ; 1 ; spdx ; spdx license identifier unlicense
wtfpl ; 1 ; spdx ; spdx license identifier wtfpl
artistic ; 1 ; spdx ; spdx license identifier artistic \d \d
postgresql ; 1 ; spdx ; spdx license identifier postgresql
python ; 1 ; spdx ; spdx license identifier (psf|python) \d( \d)?
ofl ; 1 ; spdx ; spdx license identifier ofl 1 1
agpl ; 1 ; license ; gnu affero general public license( version \d)?( or any later version)?
agpl ; 0.9 ; license ; affero general public license
lgpl ; 1 ; license ; gnu (lesser|library) general public license( version \d( \d)?)?( or any later version)?
lgpl ; 0.9 ; license ; (lesser|library) general public license
gpl-3 ; 1 ; license ; gnu general public license (version|v) ?3( or any later version)?
gpl-2 ; 1 ; license ; gnu general public license (version|v) ?2( or any later version)?
gpl-1 ; 1 ; license ; gnu general public license (version|v) ?1( or any later version)?
gpl ; 1 ; license ; gnu general public license
gpl ; 0.9 ; license ; general public license
gpl ; 0.8 ; license ; gnu public license
gpl ; 0.8 ; licensed ; licensed under (the )?(gnu )?gpl( ?v?\d)?
lgpl ; 0.8 ; licensed ; licensed under (the )?(gnu )?lgpl( ?v?\d)?
agpl ; 0.8 ; licensed ; licensed under (the )?(gnu )?agpl( ?v?\d)?
gpl ; 0.7 ; gpl ; gpl ?v?[123]( 0)?( only| or later)?
lgpl ; 0.7 ; lgpl ; lgpl ?v?[23]( [01])?( only| or later)?
agpl ; 0.7 ; agpl ; agpl ?v?3( 0)?( only| or later)?
gfdl ; 1 ; license ; gnu free documentation license( version 1 \d)?
gpl ; 0.9 ; redistribut ; this program is free software you can redistribute it and or modify it under the terms of
gpl ; 0.9 ; warrant ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
gpl-exception ; 0.9 ; licens ; as a special exception .{0,80} (licensed? under|the license) .{0,40}gpl
classpath-exception ; 1 ; license ; gpl .{0,40}classpath exception|classpath exception .{0,60}license
apache-2 ; 1 ; license ; apache license version 2 0
apache-2 ; 0.9 ; license ; apache (software )?license 2 0
apache-1.1 ; 1 ; license ; apache (software )?license version 1 1
apache-1.0 ; 1 ; license ; apache (software )?license version 1 0
apache ; 0.9 ; license ; apache software license
apache ; 0.9 ; license ; apache license
apache ; 0.8 ; licensed ; licensed under (the )?apache
apache-2 ; 0.9 ; license ; www apache org licenses license 2 0
apache ; 0.8 ; licensed ; licensed to the apache software foundation asf under one or more contributor license agreements
mit-0 ; 1 ; license ; mit no attribution license
mit-modern ; 0.9 ; license ; modern mit license
x11 ; 0.9 ; license ; (mit x11|x11) license
mit ; 1 ; license ; the mit license
mit ; 0.9 ; license ; mit license
mit ; 0.8 ; licensed ; licensed under (the )?(terms of )?(the )?mit
mit ; 0.8 ; license ; license mit
expat ; 0.9 ; license ; expat license
mit ; 1 ; permission ; permission is hereby granted free of charge to any person obtaining a copy of this software
mit ; 0.9 ; permission ; the above copyright notice and this permission notice shall be included in all copies
isc ; 1 ; permission ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc ; 0.9 ; license ; isc license
hpnd ; 0.9 ; permission ; permission to use copy modify and distribute this software and its documentation for any purpose
hpnd ; 0.9 ; license ; historical permission notice and disclaimer( license)?
ntp ; 0.9 ; license ; ntp license
bsd-4 ; 1 ; license ; (4|four) clause bsd license|bsd 4 clause( original)? license
bsd-3 ; 1 ; license ; (3|three) clause bsd license|bsd 3 clause( new| revised)? license
bsd-2 ; 1 ; license ; (2|two) clause bsd license|bsd 2 clause( simplified)? license
bsd-1 ; 1 ; license ; (1|one) clause bsd license|bsd 1 clause license
bsd-0 ; 1 ; license ; (zero|0) clause bsd license|bsd zero clause license
bsd-3 ; 0.9 ; license ; (new|modified|revised) bsd license
bsd-2 ; 0.9 ; license ; (simplified|freebsd) (bsd )?license
bsd-patent ; 1 ; license ; bsd (2 clause )?plus patent license
bsd ; 0.9 ; license ; bsd( style)? license
bsd ; 0.8 ; licensed ; licensed under (the )?bsd
bsd ; 1 ; redistribut ; redistribution and use in source and binary forms with or without modification are permitted
bsd-2 ; 0.8 ; redistribut ; redistributions of source code must retain the above copyright notice
bsd-2 ; 0.8 ; redistribut ; redistributions in binary form must reproduce the above copyright notice
bsd-3 ; 0.9 ; permission ; neither the name of .{0,80} nor the names of its contributors may be used to endorse .{0,80} without specific prior written permission
bsd-4 ; 0.9 ; acknowledgement ; all advertising materials mentioning features or use of this software must display the following acknowledgement
mpl-2 ; 1 ; license ; mozilla public license (version|v) ?2( 0)?
mpl-1.1 ; 1 ; license ; mozilla public license (version|v) ?1 1
mpl-1.0 ; 1 ; license ; mozilla public license (version|v) ?1 0
mpl ; 0.9 ; license ; mozilla public license
mpl ; 0.7 ; mozilla ; mpl ?v?\d( \d)? .{0,20}mozilla|mozilla .{0,20}mpl
npl ; 0.9 ; license ; netscape public license
epl-2 ; 1 ; license ; eclipse public license (version |v ?)?2( 0)?
epl-1 ; 1 ; license ; eclipse public license (version |v ?)?1( 0)?
epl ; 0.9 ; license ; eclipse public license
edl ; 0.9 ; license ; eclipse distribution license( v ?1 0)?
cpl ; 0.9 ; license ; common public license( version 1 0)?
ipl ; 0.9 ; license ; ibm public license( version 1 0)?
cddl ; 1 ; license ; common development and distribution license( version 1 [01])?
cpal ; 1 ; license ; common public attribution license( version 1 0)?
osl ; 0.9 ; license ; open software license( version| v)? ?\d( \d)?
afl ; 0.9 ; license ; academic free license( version| v)? ?\d( \d)?
eupl ; 1 ; licen ; european union public licen[cs]e( version| v)?( 1 \d)?
cecill-b ; 1 ; licen ; cecill b (free software )?licen[cs]e
cecill-c ; 1 ; licen ; cecill c (free software )?licen[cs]e
cecill ; 0.9 ; licen ; cecill (free software )?licen[cs]e
ms-pl ; 1 ; license ; microsoft public license( ms pl)?
ms-rl ; 1 ; license ; microsoft reciprocal license( ms rl)?
ms-lpl ; 0.9 ; license ; microsoft limited public license
ms-eula ; 0.8 ; license ; microsoft software license terms
artistic-2 ; 1 ; license ; artistic license (version )?2( 0)?
artistic-1 ; 1 ; license ; artistic license (version )?1( 0)?
artistic ; 0.9 ; license ; (clarified )?artistic license
perl ; 0.9 ; licen ; same terms as perl( itself)? .{0,40}licen[cs]e|licen[cs]e .{0,60}same terms as perl
python ; 1 ; license ; python software foundation license( version 2)?
python ; 0.9 ; license ; psf license( agreement)?
cnri ; 0.9 ; license ; cnri (open source )?license agreement( for python)?
ruby ; 0.9 ; license ; ruby s? ?license
php ; 1 ; license ; php license( version 3 0?1?)?
zend ; 0.9 ; license ; zend (engine )?license( version 2 0+)?
openssl ; 1 ; license ; openssl license
ssleay ; 0.9 ; license ; (original )?ssleay license
openldap ; 1 ; license ; openldap public license( version 2 \d)?
curl ; 0.9 ; license ; curl license
json ; 0.9 ; license ; json license
json ; 1 ; evil ; the software shall be used for good not evil
vim ; 0.9 ; license ; vim license
postgresql ; 1 ; license ; postgresql license
sqlite-blessing ; 1 ; copyright ; the author disclaims copyright to this source code
zlib ; 1 ; license ; zlib( libpng)? license
libpng ; 0.9 ; license ; libpng license( version 2)?
zlib ; 0.9 ; permission ; permission is granted to anyone to use this software for any purpose including commercial applications
bzip2 ; 0.9 ; license ; bzip2 license
info-zip ; 0.9 ; license ; info zip license
libtiff ; 0.9 ; license ; libtiff license
ijg ; 0.9 ; license ; independent jpeg group license|ijg license
freetype ; 1 ; license ; freetype (project )?license
ftl ; 0.8 ; license ; ftl license
boost ; 1 ; license ; boost software license( version 1 0)?
boost ; 0.8 ; license ; boost license
busl ; 1 ; license ; business source license( 1 1)?
sspl ; 1 ; license ; server side public license( version 1)?
elastic ; 1 ; license ; elastic license( 2 0)?
commons-clause ; 1 ; commons ; commons clause( license)?( condition)?
confluent ; 0.9 ; license ; confluent community license( version 1 0)?
polyform ; 0.9 ; license ; polyform (noncommercial|small business|shield|perimeter|strict|free trial|internal use) license( 1 0 0)?
redis ; 0.9 ; license ; redis source available license( \d( \d)?)?
timescale ; 0.9 ; license ; timescale license
parity ; 0.9 ; license ; parity public license
prosperity ; 0.9 ; license ; prosperity public license
hippocratic ; 1 ; license ; hippocratic license( \d( \d)?)?
upl ; 1 ; license ; universal permissive license( v ?1 0)?
ncsa ; 1 ; license ; (university of illinois )?ncsa open source license
intel ; 0.9 ; license ; intel (open source|simplified software) license
apple ; 1 ; license ; apple public source license( version \d \d)?
nokia ; 0.9 ; license ; nokia open source license
sun ; 0.9 ; license ; sun (public|industry standards source) license
sleepycat ; 1 ; license ; sleepycat (software )?(public )?license
qpl ; 1 ; license ; q public license( version 1 0)?
qt ; 0.8 ; license ; qt (commercial|company) license( agreement)?
w3c ; 1 ; license ; w3c (software|document)( and document)?( notice and)? license
ogc ; 0.8 ; license ; ogc (software|document) license
unicode ; 1 ; license ; unicode (terms of use )?license( agreement)?( v ?3)?
icu ; 1 ; license ; icu license
xfree86 ; 0.9 ; license ; xfree86 license( 1 1)?
sgi ; 0.9 ; license ; sgi free software license b( version \d \d)?
nasa ; 1 ; license ; nasa open source agreement|nasa open source license
lppl ; 1 ; license ; latex project public license( version 1 3c?)?
ofl ; 1 ; license ; sil open font license( version 1 [01])?
ofl ; 0.9 ; license ; open font license
ubuntu-font ; 0.9 ; licen ; ubuntu font licen[cs]e( version 1 0)?
bitstream ; 0.8 ; license|permission ; bitstream vera fonts? (copyright|license)
gust ; 0.9 ; license ; gust font (source )?license
arphic ; 0.9 ; license ; arphic public license
wtfpl ; 1 ; licen|wtfpl ; (do what the fuck you want to|wtfpl) public licen[cs]e
wtfpl ; 0.8 ; wtfpl ; wtfpl
beerware ; 1 ; license ; beer ?ware license
unlicense ; 1 ; domain ; this is free and unencumbered software released into the public domain
unlicense ; 0.8 ; unlicense ; (the )?unlicense
public-domain ; 0.9 ; domain ; (released|dedicated|placed) (in ?to|in) the public domain
public-domain ; 0.8 ; domain ; public domain dedication
public-domain ; 0.6 ; domain ; (is|are) in the public domain
pddl ; 1 ; domain ; open data commons public domain dedication and licen[cs]e
odbl ; 1 ; license ; open database license|odbl license
odc-by ; 1 ; license ; open data commons attribution license
ogl-uk ; 1 ; licen ; open government licen[cs]e( v ?\d( \d)?)?
etalab ; 0.9 ; licen ; etalab open licen[cs]e|licence ouverte( etalab)?
dl-de ; 0.9 ; licen ; data licen[cs]e germany( attribution| zero)?( version 2 0)?
cc0 ; 1 ; commons ; (creative commons )?cc0( 1 0)?( universal)? .{0,30}commons|creative commons (cc0|zero)( 1 0)?( universal)?
cc-by-nc-nd ; 1 ; commons ; creative commons (attribution|by) (non ?commercial|nc) (no deriv(ative)?s?|nd)( works)?( \d \d)?( international| unported| generic)?
cc-by-nc-sa ; 1 ; commons ; creative commons (attribution|by) (non ?commercial|nc) (share ?alike|sa)( \d \d)?( international| unported| generic)?
cc-by-nc ; 1 ; commons ; creative commons (attribution|by) (non ?commercial|nc)( \d \d)?( international| unported| generic)?
cc-by-nd ; 1 ; commons ; creative commons (attribution|by) (no deriv(ative)?s?|nd)( works)?( \d \d)?( international| unported| generic)?
cc-by-sa ; 1 ; commons ; creative commons (attribution|by) (share ?alike|sa)( \d \d)?( international| unported| generic)?
cc-by ; 1 ; commons ; creative commons (attribution|by)( \d \d)?( international| unported| generic)?( license)?
cc ; 0.8 ; commons ; creative commons( license| licence)?
cc ; 0.8 ; commons ; creativecommons org (licenses|publicdomain)( by)?( nc)?( sa| nd)?( \d \d)?
cc-by-nc ; 0.8 ; licen ; cc by nc( sa| nd)?( \d \d)? licen[cs]e
cc-by-sa ; 0.8 ; licen ; cc by sa( \d \d)? licen[cs]e
cc-by ; 0.8 ; licen ; cc by( \d \d)? licen[cs]e
free-art ; 0.9 ; license ; free art license( 1 [23])?
dsl ; 0.9 ; license ; design science license
opl ; 0.9 ; license ; open publication license( v ?1 0)?
gsfdl ; 0.7 ; license ; gnu simpler free documentation license
copyfree ; 0.7 ; license ; copyfree (open innovation )?license
copyleft ; 0.6 ; copyleft ; copyleft (next|license|licence|software)
eula ; 0.9 ; licen ; end user licen[cs]e agreement( eula)?
eula ; 0.7 ; eula ; this eula|eula
proprietary ; 0.9 ; proprietary ; (confidential and proprietary|proprietary and confidential)
proprietary ; 0.8 ; proprietary ; (this|the) software is proprietary
proprietary ; 0.8 ; licens ; proprietary licen[cs]e
proprietary ; 0.8 ; permission ; (may not be|unauthori[sz]ed) (copied|copying|reproduced|reproduction|distributed|distribution) .{0,80} without .{0,40}permission
proprietary ; 0.6 ; reserved ; all rights reserved
commercial ; 0.8 ; licen ; (commercial|enterprise|site|volume) licen[cs]e( agreement)?
evaluation ; 0.8 ; licen ; (evaluation|trial|demo) licen[cs]e( agreement)?
shareware ; 0.7 ; licen ; shareware licen[cs]e
freeware ; 0.7 ; licen ; freeware licen[cs]e
academic ; 0.7 ; licen ; (academic|educational|non commercial research) (use )?licen[cs]e
cla ; 0.8 ; licen ; contributor licen[cs]e agreement
dual ; 0.7 ; licen ; (dual|multi) ?licen[cs]ed
patent-grant ; 0.7 ; patent ; (additional )?grant of patent rights|patent license
trademark ; 0.5 ; trademark ; (registered )?trademarks? of
warranty ; 0.6 ; warrant ; (the software|this software|software) is provided as is without warranty of any kind
warranty ; 0.5 ; warrant ; without warrant(y|ies) (of any kind|or conditions)
warranty ; 0.5 ; warrant ; disclaims? all warrant(y|ies)
copyright ; 0.4 ; copyright ; copyright( c)? (19|20)\d\d( (19|20)\d\d)*
see-license ; 0.5 ; licen ; see (the )?(file )?licen[cs]e( txt| md| file)?( for (details|more information))?
licensed ; 0.4 ; licensed ; licensed under (the )?[^ ]+( [^ ]+)? licen[cs]e
open-source ; 0.4 ; licen ; (open source|free software) licen[cs]e
""".strip()


def rules() -> list[tuple[str, float, str, str]]:
    """(label, confidence, keyword, pattern) in order of priority; a rule with several
    keywords is one row for each."""
    rows = []
    for line in RULES_TEXT.splitlines():
        label, confidence, keywords, pattern = (x.strip() for x in line.split(";"))
        rows += [(label, float(confidence), k, f" (?:{pattern})(?= )") for k in keywords.split("|")]
    return rows


def normalized(text: Column) -> Column:
    """Lower-cased words between single spaces, one space in front and behind."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), SEPARATOR, " ")), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, n_detections
    and score (the highest confidence of a detection)."""
    d = apart(docs, "text").withColumn("_norm", normalized(F.col("text")))
    norm = F.col("_norm")
    gate = F.lit(False)
    for stem in GATE:
        gate = gate | F.contains(norm, F.lit(stem))
    d = d.withColumn("_gated", F.when(gate, norm))
    table = F.array(*(F.struct(F.lit(k).alias("no"), F.lit(x[0]).alias("label"), F.lit(x[1]).alias("confidence"), F.lit(x[2]).alias("keyword"), F.lit(x[3]).alias("pattern")) for k, x in enumerate(rules())))
    d = d.withColumn("_rules", F.when(F.col("_gated").isNotNull(), F.filter(table, lambda r: F.contains(F.col("_gated"), r["keyword"]))))

    def detections(r: Column) -> Column:
        found = F.regexp_extract_all("_gated", r["pattern"], F.lit(0))
        # The pieces between the matches say where these begin.
        steps = F.arrays_zip(F.split("_gated", r["pattern"], -1).alias("gap"), found.alias("match"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,no:int,label:string,confidence:double>>").alias("found"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + F.length(s["gap"])
            stop = start + F.length(s["match"])
            one = F.struct(start.alias("start"), (-stop).alias("stop"), r["no"].alias("no"), r["label"].alias("label"), r["confidence"].alias("confidence"))
            return F.struct(F.coalesce(stop, start).alias("at"), F.when(s["match"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], one)).alias("found"))

        return F.aggregate(steps, zero, step, lambda acc: acc["found"])

    # stop is negative so that the default order puts longer intervals first.
    d = d.withColumn("_found", F.array_sort(F.flatten(F.transform("_rules", detections))))
    none = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"))

    def sweep(acc: Column, x: Column) -> Column:
        stop = -x["stop"]
        return F.when(stop <= acc["end"], acc).otherwise(
            F.struct(stop.alias("end"), F.array_union(acc["labels"], F.array(x["label"])).alias("labels"), (acc["n"] + 1).alias("n"), F.greatest(acc["score"], x["confidence"]).alias("score"))
        )

    d = d.withColumn("_kept", F.when(F.size("_found") > 0, F.aggregate("_found", none, sweep)))
    has = F.lit(False)
    for phrase in BASE:
        has = has | F.contains("_gated", F.lit(f" {phrase} "))
    d = d.withColumn("_words", F.when(has, F.split(F.btrim(F.col("_gated")), " ")))

    def phrase_at(i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            same = F.lit(True)
            for k, word in enumerate(phrase.split()):
                same = same & (F.get("_words", i + k) == word)
            label = F.when(same, name).otherwise(label)
        return F.struct(i.alias("at"), label.alias("label"))

    places = F.filter(F.transform(F.sequence(F.lit(0), F.size("_words") - 1), phrase_at), lambda p: p["label"].isNotNull())
    d = d.withColumn("_base", F.when(F.col("_words").isNotNull(), places))
    base = F.array_sort(F.array_distinct(F.transform("_base", lambda p: p["label"])))
    d = d.withColumn("_base_labels", F.coalesce(base, F.array().cast("array<string>")))
    labels = F.array_sort(F.array_union("_base_labels", F.coalesce(F.col("_kept.labels"), F.array().cast("array<string>"))))
    d = d.withColumns(
        {
            "n_words": F.when(F.length(norm) <= 2, 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1).cast("long"),
            "n_base": F.coalesce(F.size("_base"), F.lit(0)).cast("long"),
            "first_word": F.get("_base", F.lit(0))["at"].cast("long"),
            "last_word": F.element_at("_base", -1)["at"].cast("long"),
            "base_labels": F.array_join("_base_labels", ","),
            "labels": F.array_join(labels, ","),
            "n_detections": F.coalesce(F.col("_kept.n"), F.lit(0).cast("long")),
            "score": F.coalesce(F.col("_kept.score"), F.lit(0.0)),
        }
    )
    return together(d, docs, ("text",), ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_detections", "score"])
