"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words with single spaces. Rules are regular
expressions over that, each with a keyword, a label and a priority. Texts without any
keyword are never normalised; a rule runs only on texts with its keyword. Every place of
every rule that runs is an interval; one that lies within another of at least its priority
is suppressed, and the labels of the others are reported with those of the base phrases.
Of rules of one priority that have the same interval, the first in order stands.

Null texts are empty; empty texts have no words, no labels and score 0. Very long texts are
scanned whole, and the sweep over a text's intervals is linear in their number but for their
sort. Every row is judged by its text alone, so repeated rows give repeated results, and an
empty table gives an empty one. Further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, whole

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Families with versions: label, keyword, names, versions.
VERSIONED = [
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e", "1 2 3"),
    ("gpl", "gpl", "(?:gnu )?gpl", "1 2 3"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e", "2 2.1 3"),
    ("lgpl", "library general", "(?:gnu )?library general public licen[sc]e", "2 2.1"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "2 2.1 3"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "1 3"),
    ("agpl", "agpl", "(?:gnu )?agpl", "1 3"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)?(?: licen[sc]e)?", "1 1.1 2"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "1 1.1 2"),
    ("mpl", "mpl", "mpl", "1.1 2"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "1 2"),
    ("cddl", "common development", "common development and distribution licen[sc]e", "1 1.1"),
    ("cpl", "common public", "common public licen[sc]e", "1"),
    ("osl", "open software", "open software licen[sc]e", "1 2 2.1 3"),
    ("afl", "academic free", "academic free licen[sc]e", "1.1 2 2.1 3"),
    ("artistic", "artistic", "artistic licen[sc]e", "1 2"),
    ("eupl", "european union", "european union public licen[sc]e", "1 1.1 1.2"),
    ("eupl", "eupl", "eupl", "1 1.1 1.2"),
    ("bsl", "boost", "boost software licen[sc]e", "1"),
    ("ofl", "open font", "(?:sil )?open font licen[sc]e", "1 1.1"),
    ("upl", "universal permissive", "universal permissive licen[sc]e", "1"),
    ("ms-pl", "microsoft public", "microsoft public licen[sc]e", "1"),
    ("php", "php", "php licen[sc]e", "3 3.01"),
    ("zpl", "zope", "zope public licen[sc]e", "1.1 2 2.1"),
    ("lppl", "latex", "latex project public licen[sc]e", "1 1.1 1.2 1.3"),
    ("ecl", "educational community", "educational community licen[sc]e", "1 2"),
    ("cecill", "cecill", "cecill(?: free software licen[sc]e)?", "1 1.1 2 2.1"),
    ("odbl", "open database", "open database licen[sc]e", "1"),
    ("python", "python", "python(?: software foundation)? licen[sc]e", "2"),
]
#: The clauses of the Creative Commons licenses, in words and in short.
COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative|ative work)s", "by-nc": "attribution non ?commercial",
           "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ative work)s"}
COMMONS_VERSIONS = "1 2 2.5 3 4"
#: Signatures written out: label, keyword, expression. Of equal intervals, the earlier one's stands.
SIGNATURES = [
    ("mit", "mit ", "mit licen[sc]e"),
    ("mit", "mit ", "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]e"),
    ("bsd-2-clause", "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("isc", "isc ", "isc licen[sc]e"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", "unlicense"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", "creative commons zero(?: v?1 0)?"),
    ("public-domain", "public domain", "(?:in|into|to) the public domain"),
    ("apache-2.0", "apache", "licensed under the apache licen[sc]e version 2 0"),
    ("apache", "apache", "apache(?: software)? licen[sc]e"),
    ("gpl", "general public", "gnu general public licen[sc]e"),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "lesser", "gnu lesser general public licen[sc]e"),
    ("agpl", "affero", "gnu affero general public licen[sc]e"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("artistic", "artistic", "artistic licen[sc]e"),
    ("cc-by", "cc", "cc by"),
    ("cc-by-sa", "cc", "cc by sa"),
    ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-nd", "cc", "cc by nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", "cc by nc nd"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("isc", "openbsd", "openbsd licen[sc]e"),
    ("0bsd", "zero clause", "(?:bsd )?zero clause(?: bsd)? licen[sc]e"),
    ("bsd-3-clause-clear", "clear bsd", "(?:bsd 3 clause )?clear bsd licen[sc]e"),
    ("mit-0", "mit no attribution", "mit no attribution licen[sc]e"),
    ("x11", "x11", "x11 licen[sc]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("curl", "curl", "curl licen[sc]e"),
    ("openssl", "openssl", "openssl(?: toolkit)? licen[sc]e"),
    ("openldap", "openldap", "openldap public licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("ruby", "ruby", "ruby licen[sc]e"),
    ("perl", "perl", "(?:same terms as|licen[sc]ed like) perl(?: itself)?"),
    ("vim", "vim", "vim licen[sc]e"),
    ("json", "json", "json licen[sc]e"),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and)? licen[sc]e"),
    ("unicode", "unicode", "unicode(?: inc)? licen[sc]e(?: agreement)?"),
    ("icu", "icu ", "icu licen[sc]e"),
    ("libpng", "libpng", "(?:png reference library|libpng) licen[sc]e"),
    ("libtiff", "libtiff", "libtiff licen[sc]e"),
    ("ijg", "jpeg group", "independent jpeg group licen[sc]e"),
    ("imagemagick", "imagemagick", "imagemagick licen[sc]e"),
    ("ftl", "freetype", "freetype(?: project)? licen[sc]e"),
    ("bzip2", "bzip2", "bzip2(?: and libbzip2)? licen[sc]e"),
    ("info-zip", "info zip", "info zip licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat licen[sc]e"),
    ("tcl", "tcl", "tcl tk licen[sc]e"),
    ("beerware", "beer", "beer ?ware licen[sc]e"),
    ("fair", "fair licen", "fair licen[sc]e"),
    ("ms-rl", "reciprocal", "microsoft reciprocal licen[sc]e"),
    ("rpl", "reciprocal", "reciprocal public licen[sc]e"),
    ("qpl", "q public", "q public licen[sc]e"),
    ("ipl", "ibm public", "ibm public licen[sc]e"),
    ("apsl", "apple public", "apple public source licen[sc]e"),
    ("npl", "netscape", "netscape public licen[sc]e"),
    ("spl", "sun public", "sun public licen[sc]e"),
    ("sissl", "sun industry", "sun industry standards source licen[sc]e"),
    ("nasa", "nasa", "nasa open source agreement(?: licen[sc]e)?"),
    ("cpal", "common public attribution", "common public attribution licen[sc]e"),
    ("rhecos", "ecos", "(?:red hat )?ecos(?: public)? licen[sc]e"),
    ("nokia", "nokia", "nokia open source licen[sc]e"),
    ("intel", "intel", "intel(?: open source| simplified software)? licen[sc]e"),
    ("motosoto", "motosoto", "motosoto open source licen[sc]e"),
    ("watcom", "watcom", "(?:sybase )?open watcom public licen[sc]e"),
    ("sspl", "server side", "server side public licen[sc]e"),
    ("elastic", "elastic", "elastic licen[sc]e"),
    ("busl", "business source", "business source licen[sc]e"),
    ("commons-clause", "commons clause", "commons clause(?: licen[sc]e)?(?: condition)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e"),
    ("parity", "parity", "parity public licen[sc]e"),
    ("blue-oak", "blue oak", "blue oak model licen[sc]e"),
    ("hippocratic", "hippocratic", "hippocratic licen[sc]e"),
    ("mulan-psl", "mulan", "mulan (?:permissive software|psl) licen[sc]e"),
    ("pddl", "dedication", "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e"),
    ("ogl", "open government", "open government licen[sc]e"),
    ("etalab", "etalab", "etalab(?: open)? licen[sc]e"),
    ("cdla", "community data", "community data licen[sc]e agreement"),
    ("openrail", "responsible ai", "responsible ai licen[sc]e"),
    ("llama", "llama", "llama (?:[0-9] )?community licen[sc]e"),
    ("dual", "dual", "dual licen[sc]ed"),
    ("freeware", "freeware", "freeware licen[sc]e"),
    ("evaluation", "evaluation", "(?:trial|evaluation) licen[sc]e"),
    ("eula", "end user", "end user licen[sc]e agreement"),
]
#: Priority: versions over written signatures of names, so that the longer one stands.
EXACT, NAMED = 3, 2


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) of every rule, a few hundred."""
    out = []
    dotted = lambda v: v.replace(".", " ")
    label = lambda v: v if "." in v else f"{v}.0"
    for name, key, rx, versions in VERSIONED:
        for v in versions.split():
            number = f"(?:version |v ?)?{dotted(v)}" + ("" if "." in v else "(?: 0)?")
            for tail, extra in (("-or-later", r"(?: of the licen[sc]e)? or (?:\(?at your option\)? )?(?:any )?later(?: version)?"), ("-only", " only"), ("", "(?! only| or | [0-9])")):
                out.append((f"{name}-{label(v)}{tail}", key, f"{rx} {number}{extra}", EXACT))
    for short, words in COMMONS.items():
        for v in COMMONS_VERSIONS.split():
            number = dotted(v) + ("" if "." in v else "(?: 0)?")
            out.append((f"cc-{short}-{label(v)}", "creative commons", f"creative commons {words}(?: international| unported)? {number}(?! [0-9])", EXACT))
            out.append((f"cc-{short}-{label(v)}", "cc", f"cc {short.replace('-', ' ')} {number}(?! [0-9])", EXACT))
        out.append((f"cc-{short}", "creative commons", f"creative commons {words}", NAMED))
    spaced = lambda x: x.replace("\\(?", "").replace("\\)?", "")  # noqa: E731  words have no brackets
    return [(a, b, spaced(c), d) for a, b, c, d in [*out, *((*s, NAMED) for s in SIGNATURES)]]


#: Stems without which no keyword and no base phrase can occur; CC needs its word by.
STEMS = ("licen", "gpl", "mpl", "apache", "bsd", "cecill", "eupl", "wtfpl", "cc0", "commons", "public domain", "proprietary", "rights reserved", "permission", "redistribut", "unencumbered", "endorse", "mit", "perl", "nasa")


BLOCK = 256  # places gathered at a time


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(whole(text), NOT_WORD), "")).cast("long")


def normalised(text: Column) -> Column:
    """Words with one space before, between and after."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate(whole(text), upper, upper.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def worth_a_look(text: Column) -> Column:
    """Whether any stem occurs, by substring search on every whole text."""
    def seen(low: Column) -> Column:
        out = F.contains(low, F.lit("cc")) & low.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")
        for stem in STEMS:
            # a phrase may be spread over lines, so only the first word of a stem is looked for
            out |= F.contains(low, F.lit(stem.split()[0])) if stem not in ("mit", "public domain", "rights reserved") else F.lit(False)
        spread = r"public[\x00-\x2F\x3A-\x60\x7B-\x7F]+domain|rights[\x00-\x2F\x3A-\x60\x7B-\x7F]+reserved"
        return out | ((F.contains(low, F.lit("public")) | F.contains(low, F.lit("rights"))) & low.rlike(spread))

    return let(F.lower(whole(text)), seen)


def detections(s: Column) -> Column:
    """(start, -end, -priority, rule number, label) of all places of the rules whose keyword s has.

    Places of a rule are gathered in blocks, as appending to an array copies it: a match costs
    BLOCK / 2 copied references at most, however many there are.
    """
    table = rules()
    keys = F.array(*[F.lit(k) for k in dict.fromkeys(r[1] for r in table)])
    as_rows = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("key"), F.lit(f"(?<= )(?:{c})(?= )").alias("rx"), F.lit(d).alias("priority"), F.lit(i).alias("rule")) for i, (a, b, c, d) in enumerate(table)])

    def places(r: Column) -> Column:
        def walk(parts: Column, found: Column) -> Column:
            kind = "struct<start:int,neg_end:int,neg_priority:int,rule:int,label:string>"
            count = F.size(parts) - 1

            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.char_length(F.get(parts, i))
                end = start + F.char_length(F.get(found, i))
                one = F.struct(start.alias("start"), (-end).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["rule"].alias("rule"), r["label"].alias("label"))
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

            def block(acc: Column, k: Column) -> Column:
                run = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, count) - 1)
                own = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step)
                return let(own, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], F.array(b["out"])).alias("out")))

            blocks = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
            return F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"]))

        # both bound, or each step would search the text again
        return let(F.split(s, r["rx"]), lambda parts: let(F.regexp_extract_all(s, r["rx"], F.lit(0)), lambda found: walk(parts, found)))

    live = let(F.filter(keys, lambda k: F.contains(s, k)), lambda on: F.filter(as_rows, lambda r: F.array_contains(on, r["key"]) & F.rlike(s, r["rx"])))
    return F.flatten(F.transform(live, places))


def surviving(found: Column) -> Column:
    """Labels and best priority of the intervals that no other one contains."""
    def step(acc: Column, x: Column) -> Column:
        end, high = -x["neg_end"], x["neg_priority"] == -EXACT
        hidden = (acc["exact"] >= end) | (~high & (acc["named"] >= end))
        return F.struct(
            F.when(high, F.greatest(acc["exact"], end)).otherwise(acc["exact"]).alias("exact"),
            F.when(high, acc["named"]).otherwise(F.greatest(acc["named"], end)).alias("named"),
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(hidden, acc["best"]).otherwise(F.greatest(acc["best"], -x["neg_priority"])).alias("best"),
        )

    start = F.struct(F.lit(-1).alias("exact"), F.lit(-1).alias("named"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))
    return F.aggregate(F.sort_array(found), start, step)


def scanned(docs: DataFrame) -> DataFrame:
    """docs with a last column, the struct of counts, labels and score."""
    s, hit, name = fresh(docs, "s_"), fresh(docs, "hit_"), fresh(docs, "licenses_")
    phrases = f"(?<= )(?:{'|'.join(BASE)})(?= )"
    spaces = lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) - 1).cast("long")
    col = F.col(s)
    n_base = (F.size(F.split(col, phrases)) - 1).cast("long")
    first = spaces(F.regexp_extract(col, f"(?s)^(.*?){phrases}", 1))
    last = spaces(F.regexp_extract(col, f"(?s)^(.*){phrases}", 1))
    base = F.filter(F.array(*[F.when(F.contains(col, F.lit(f" {p} ")), F.lit(v)) for p, v in BASE.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    row = lambda found: F.struct(found["n_base"].alias("n_base"), found["first"].alias("first_word"), found["last"].alias("last_word"), F.array_join(F.array_sort(found["base"]), ",").alias("base_labels"),
                                 F.array_join(F.array_sort(F.array_union(found["base"], found["own"]["labels"])), ",").alias("labels"),
                                 F.when(found["own"]["best"] == EXACT, 1.0).when(found["own"]["best"] == NAMED, 0.8).when(found["n_base"] > 0, 0.6).otherwise(0.0).alias("score"))
    full = F.struct(n_base.alias("n_base"), F.when(n_base > 0, first).alias("first"), F.when(n_base > 0, last).alias("last"), base.alias("base"), surviving(detections(col)).alias("own"))
    empty = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    out = docs.withColumn(s, F.when(worth_a_look(F.col("text")), normalised(F.col("text"))))
    out = out.withColumn(hit, F.when(col.isNotNull(), let(full, row)).otherwise(empty))
    return out.withColumn(name, F.struct(n_words(F.col("text")).alias("n_words"), F.col(hit).alias("found"))).drop(s, hit)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Base places and labels of every document."""
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "licenses_.n_words", "licenses_.found.*")
