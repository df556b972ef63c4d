"""License scans by ordered signature rules, with DataFrame functions only.

A text is reduced to its words in lower case with one space between them.  Each rule has a
priority, a label, a keyword and a regular expression over such words.  A rule's expression
runs only on texts that hold its keyword.  Every place found is an interval; an interval inside
another of the same or a higher priority is suppressed, the rest are the text's detections.

Four plain phrases are counted besides (the base): their places, first and last word, labels.

Edge cases: a null or empty text has no words and a score of 0; repeated rows are scanned each
for itself; ties (equal intervals) go to the higher priority, then to the first label by name; very long
texts are scanned whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm.common import LOWER_AZ, UPPER_AZ, table

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Hand-written rules, one a line: priority | label | keyword | expression over lower-case words.
HAND_WRITTEN = r"""
2 | apache-2.0 | apache | apache (software )?license,? (version |v )?2( 0)?
2 | apache-1.1 | apache | apache software license (version |v )?1 1
2 | apache-1.0 | apache | apache (software )?license (version |v )?1 0
1 | apache | apache | (licensed under|under the terms of) the apache license
1 | apache | apache | asl 2( 0)?
2 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
2 | mit | mit | (licensed|released|distributed|available) under (the )?(terms of the )?mit license
1 | mit | mit | (the )?mit license( mit)?
1 | mit | expat | expat license
2 | x11 | x consortium | name of the x consortium shall not be used in advertising
1 | x11 | x11 | x11 license
2 | mit-0 | mit | mit no attribution
2 | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 | isc | isc | isc license
2 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
2 | bsd-3-clause | endorse | neither the name of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse
2 | bsd-source | redistribution | redistribution and use in source and binary forms with or without modification are permitted
2 | bsd-2-clause | bsd | (simplified|freebsd|2 clause) bsd license
2 | bsd-3-clause | bsd | (new|modified|revised|3 clause) bsd license
2 | bsd-4-clause | bsd | (original|old|4 clause) bsd license
2 | bsd-2-clause | bsd | bsd 2 clause( license)?
2 | bsd-3-clause | bsd | bsd 3 clause( license)?
1 | bsd | bsd | bsd (style )?license
2 | 0bsd | bsd | (zero clause bsd|bsd zero clause)( license)?
2 | zlib | acknowledg | an acknowledg(e)?ment in the product documentation would be appreciated but is not required
1 | zlib | zlib | zlib( libpng)? license
2 | bsl-1.0 | boost | boost software license( version)?( 1 0)?
2 | mpl-2.0 | mozilla | mozilla public license,? (version |v )?2( 0)?
2 | mpl-1.1 | mozilla | mozilla public license,? (version |v )?1 1
2 | mpl-1.0 | mozilla | mozilla public license,? (version |v )?1 0
1 | mpl | mozilla | mozilla public license
2 | epl-2.0 | eclipse | eclipse public license (version |v )?2( 0)?
2 | epl-1.0 | eclipse | eclipse public license (version |v )?1( 0)?
1 | epl | eclipse | eclipse (public|distribution) license
2 | cddl-1.1 | common development | common development and distribution license( cddl)? (version |v )?1 1
2 | cddl-1.0 | common development | common development and distribution license( cddl)?( version| v)?( 1 0)?
2 | cpl-1.0 | common public | common public license( version)?( 1 0)?
2 | ipl-1.0 | ibm | ibm public license
2 | artistic-2.0 | artistic | artistic license (version |v )?2( 0)?
1 | artistic | artistic | (clarified )?artistic license
2 | psf-2.0 | python | (python software foundation|psf) license( agreement)?( version 2)?
1 | python | python | python license
2 | ruby | ruby | ruby license
2 | php-3.01 | php | php license( version)?( 3 01)?
2 | postgresql | postgresql | postgresql license
2 | openssl | openssl | openssl (toolkit|license)
2 | w3c | w3c | w3c (software|document)( notice and)? license
2 | unicode | unicode | unicode( inc)? license agreement
2 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | unlicense | unlicense | the unlicense
2 | wtfpl | what the | do what the f[a-z]* you want to public license
2 | cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
2 | cc0-1.0 | creative commons | creative commons (zero|public domain dedication)
2 | public-domain | public domain | (released|placed|dedicated) (in)?to the public domain
1 | public-domain | public domain | (is in the )?public domain
2 | ofl-1.1 | sil | sil open font license( version)?( 1 1)?
2 | eupl-1.2 | european union | european union public licen[cs]e( version)?( v)? 1 2
1 | eupl | european union | european union public licen[cs]e
2 | ms-pl | microsoft | microsoft public license( ms pl)?
2 | ms-rl | microsoft | microsoft reciprocal license( ms rl)?
2 | apsl-2.0 | apple | apple public source license( version)?( 2 0)?
2 | qpl-1.0 | q public | q public license( version)?( 1 0)?
2 | ncsa | illinois | university of illinois (ncsa )?open source license
2 | afl-3.0 | academic free | academic free license( version)?( 3 0)?
2 | osl-3.0 | open software | open software license( version)?( 3 0)?
2 | odbl-1.0 | open database | open database license( odbl)?( v)?( 1 0)?
2 | pddl-1.0 | public domain dedication | public domain dedication and license
2 | mulan-psl-2.0 | mulan | mulan psl v2
2 | bsl-1.1 | business source | business source license( 1 1)?
2 | sspl-1.0 | server side | server side public license
2 | elastic-2.0 | elastic | elastic license( 2 0)?
2 | commons-clause | commons clause | commons clause license condition
2 | polyform | polyform | polyform (noncommercial|strict|shield|small business) license
1 | gpl | gnu | gnu gpl
1 | gpl | gpl | (licensed|released|distributed|covered) under the gpl
1 | lgpl | lgpl | (licensed|released|distributed|covered) under the lgpl
1 | gpl | gnu | (under the terms of )?the gnu general public license
1 | copyleft | free software foundation | published by the free software foundation
1 | proprietary | all rights reserved | (copyright [a-z0-9 ]{1,60} )?all rights reserved
1 | proprietary | proprietary | proprietary and confidential
1 | eula | end user | end user licen[cs]e agreement
1 | warranty-disclaimer | warranty | (provided|distributed) as is without warranty of any kind
1 | warranty-disclaimer | warranty | without any warranty without even the implied warranty of
1 | see-license | license | see (the )?licen[cs]e( file)? for (more )?(details|information)
1 | copyright | copyright | copyright c? ?(19|20)[0-9]{2}
"""

# Licenses of the GNU family with their versions; the names of Creative Commons licenses with their versions; identifiers.
GNU = {"gpl": ("general public", "1 2 3"), "lgpl": ("(lesser|library) general public", "2 2.1 3"), "agpl": ("affero general public", "1 3"), "gfdl": ("free documentation", "1.1 1.2 1.3")}
CREATIVE_COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(ative)?s", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(ative)?s"}
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause
BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0
EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.3-only GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND
ICU IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MirOS MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL MS-RL NCSA NTP ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unlicense
UPL-1.0 Vim W3C WTFPL X11 Xnet Zlib ZPL-2.1
"""


def _spoken(name: str) -> str:
    """A name as it stands among words: ``GPL-2.0`` as ``gpl 2 0``."""
    return name.lower().replace("-", " ").replace(".", " ")


def rules() -> list[tuple[int, str, str, str]]:
    """All rules as (priority, label, keyword, expression), the hand-written first."""
    out = []
    for line in HAND_WRITTEN.strip().splitlines():
        priority, label, keyword, expression = (x.strip() for x in line.split(" | "))
        out.append((int(priority), label, keyword, expression.replace(",?", "")))
    for family, (name, versions) in GNU.items():
        for v in versions.split():
            said = _spoken(v) + ("" if "." in v else "( 0)?")
            full = v if "." in v else f"{v}.0"
            stem = rf"gnu {name} license( {family})?( as published by the free software foundation)?( either)? (version |v )?{said}"
            out.append((2, f"{family}-{full}", "gnu", stem))
            out.append((3, f"{family}-{full}-or-later", "gnu", stem + r"( of the license)? or (at your option )?(any )?(later|newer)( version)?"))
            out.append((3, f"{family}-{full}-only", "gnu", stem + " only"))
            out.append((2, f"{family}-{full}", family, rf"{family} ?v? ?{said}"))
    for code, name in CREATIVE_COMMONS.items():
        out.append((1 + code.count("-"), f"cc-{code}", "cc by", f"cc {_spoken(code)}"))
        out.append((1 + code.count("-"), f"cc-{code}", "creative commons", f"creative commons {name}"))
        for v in CC_VERSIONS.split():
            out.append((2 + code.count("-"), f"cc-{code}-{v}", "cc by", f"cc {_spoken(code)} {_spoken(v)}"))
            out.append((2 + code.count("-"), f"cc-{code}-{v}", "creative commons", f"creative commons {name}( {v[0]})? ?(international |unported |license |version )*{_spoken(v)}"))
    out += [(4, name.lower(), "spdx", f"spdx license identifier {_spoken(name)}") for name in IDENTIFIERS.split()]
    return out


def words(text: Column) -> Column:
    """The text's words with one space between them."""
    text = F.coalesce(text, F.lit(""))
    # Only A-Z count as capitals; where all is ASCII the faster function says the same.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER_AZ, LOWER_AZ))
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(padded: Column, n_words: Column) -> dict[str, Column]:
    """Count, first and last word and labels of the base phrases."""
    apart = F.replace(padded, F.lit(" "), F.lit("  "))  # so that neighbours share no space
    has = {p: F.contains(padded, F.lit(f" {p} ")) for p in PHRASES}
    count = {p: (F.length(apart) - F.length(F.replace(apart, F.lit(x := f" {p.replace(' ', '  ')} "), F.lit("")))) / len(x) for p in PHRASES}
    first = [F.when(has[p], _spaces(F.substring_index(padded, f" {p} ", 1))) for p in PHRASES]
    last = [F.when(has[p], n_words - _spaces(F.substring_index(padded, f" {p} ", -1)) - len(p.split())) for p in PHRASES]
    return {
        "n_base": sum((F.when(has[p], count[p]).otherwise(0) for p in PHRASES), F.lit(0)).cast("long"),
        "first_word": F.least(*first).cast("long"),
        "last_word": F.greatest(*last).cast("long"),
        "base": F.array_compact(F.array(*(F.when(has[p], F.lit(label)) for p, label in PHRASES.items()))),
    }


def _places(marked: Column, rule: Column) -> Column:
    """Where a rule matches, from the text with its matches between marks: (start, negative end, negative priority, label)."""
    pieces = F.split(marked, "\x01")
    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast("array<struct<start:int,back:int,rank:int,label:string>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        n = F.length(F.substring_index(piece, "\x02", 1))
        place = F.struct(acc["at"].alias("start"), (-acc["at"] - n).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.array_append(acc["found"], place).alias("found"))

    return F.aggregate(F.slice(pieces, 2, 1 << 30), start, step, lambda acc: acc["found"])


#: Priorities run from 1 to this.
TOP = 4


def _detections(padded: Column) -> Column:
    """Labels and covered characters of the intervals that no other suppresses."""
    groups: dict[str, list[Column]] = {}
    for priority, label, keyword, expression in rules():
        # Each expression is a literal, so that it is compiled once and not for every text.
        marked = F.regexp_replace(padded, F.lit(f"(?<= )(?:{expression})(?= )"), F.lit("\x01$0\x02"))
        groups.setdefault(keyword, []).append(F.struct(F.lit(priority).alias("priority"), F.lit(label).alias("label"), marked.alias("marked")))
    tried = F.flatten(F.array_compact(F.array(*(F.when(F.contains(padded, F.lit(k)), F.array(*found)) for k, found in groups.items()))))
    # Places in order of start, longer ones first: what holds a place comes before it.
    places = F.array_sort(F.flatten(F.transform(F.filter(tried, lambda r: F.contains(r["marked"], F.lit("\x01"))), lambda r: _places(r["marked"], r))))
    start = F.struct(F.array_repeat(F.lit(0), TOP).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def step(acc: Column, m: Column) -> Column:
        end = -m["back"]
        inside = F.exists(F.slice(acc["ends"], -m["rank"], F.lit(TOP)), lambda e: e >= end)
        kept = F.struct(
            F.transform(acc["ends"], lambda e, i: F.when(i == -m["rank"] - 1, F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.array_union(acc["labels"], F.array(m["label"])).alias("labels"),
            (acc["covered"] + F.greatest(F.lit(0), end - F.greatest(acc["reach"], m["start"]))).alias("covered"),
            F.greatest(acc["reach"], end).alias("reach"),
        )
        return F.when(inside, acc).otherwise(kept)

    return F.aggregate(places, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["covered"].alias("covered")))


def scan(docs: DataFrame) -> DataFrame:
    """The license figures of each row of ``docs``; one pass, no shuffle.

    ``score`` is the share of the text's words (by characters) under a detection.
    """
    df = docs.select("doc_id", words(F.col("text")).alias("norm"))
    n_words = F.when(F.col("norm") == "", 0).otherwise(_spaces(F.col("norm")) + 1)
    df = df.select("doc_id", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded"), n_words.cast("long").alias("n_words"))
    base = _base(F.col("padded"), F.col("n_words"))
    keywords = sorted({k for _, _, k, _ in rules()})
    some = F.lit(False)
    for k in keywords:
        some = some | F.contains("padded", F.lit(k))
    df = df.select("doc_id", "n_words", F.length("padded").alias("n"), *(c.alias(k) for k, c in base.items()), F.when(some, _detections(F.col("padded"))).alias("found"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_union("base", F.coalesce("found.labels", none))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.col("found.covered") / F.greatest(F.lit(1), F.col("n") - 2), F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
