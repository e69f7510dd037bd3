"""Licence scans by sentence rules, with DataFrame functions.

A text is cut into sentences, each brought to a plain form, and known licence sentences get their identifiers; the rest
are gaps. A text's sequence of identifiers is matched against rules, in order: a rule names a licence and a sequence of
identifiers, which later rules no longer see. Whole licences come before their single sentences, so that a full text is
reported once and not as its parts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a text says under which licence something is, whatever that is; and what may stand after the licence's name.
UNDER = "(.* )?(licensed|released|distributed|redistributed|available|shared|published|provided|offered|covered|dedicated|placed) (under|by|to|in|into) (a |an |the )?(terms of )?(a |an |the )?"
AFTER = "( .*)?"
GPL = "(gnu )?(general public licen[sc]e|gpl)"
V = "[ -]*(version |v)?"

# Identifier, pattern of a plain sentence (lower case; letters, digits, dot, plus and hyphen; single spaces).
SENTENCES = (
    ("mitgrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*to deal in the software without restriction.*"),
    ("mitnotice", "the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("asis", "the software is provided as is without warranty of any kind express or implied.*"),
    ("noliable", "in no event shall the (authors|copyright|author|regents).* be liable .*"),
    ("bsdgrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsdsource", "(1\\.? |- )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsdbinary", "(2\\.? |- )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation .*"),
    ("bsdname", "(3\\.? |- )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdasis", "this software is provided by .* as is and any express or implied warranties.* are disclaimed"),
    ("iscgrant", "permission to use copy modify and/?or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache2grant", f"{UNDER}apache (software )?(public )?licen[sc]e[ -]*(version |v)?2(\\.0)?( the license)?{AFTER}|{UNDER}apache[ -]2(\\.0)?{AFTER}"),
    ("apache2use", "you may not use this file except in compliance with the license"),
    ("apache2copy", "you may obtain a copy of the license at.*"),
    ("apache2asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("gplgrant", "(.* )?is free software you can redistribute it and/?or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version [23] of the license or at your option any later version"),
    ("agplonly", "(.* )?under the terms of the gnu affero general public licen[sc]e (version 3 )?as published by the free software foundation.*"),
    ("gpl3only", "(.* )?under the terms of the gnu general public licen[sc]e (version 3 as published by the free software foundation|as published by the free software foundation (either )?version 3 of the license)( only)?( .*)?"),
    ("gpl2only", "(.* )?under the terms of the gnu general public licen[sc]e (version 2 as published by the free software foundation|as published by the free software foundation (either )?version 2 of the license)( only)?( .*)?"),
    ("gpllater", f"{UNDER}{GPL}{V}[23](\\.0)? or (at your option )?(any )?(later|newer|higher).*"),
    ("gpl3ref", f"{UNDER}{GPL}{V}3(\\.0)?{AFTER}"),
    ("gpl2ref", f"{UNDER}{GPL}{V}2(\\.0)?{AFTER}"),
    ("gplhope", "this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("lgplref", f"{UNDER}(gnu )?(lesser general public licen[sc]e|library general public licen[sc]e|lgpl).*"),
    ("agplref", f"{UNDER}(gnu )?(affero general public licen[sc]e|agpl).*"),
    ("mplref", "this source code form is subject to the terms of the mozilla public license v\\. ?2\\.0"),
    ("mitref", f"{UNDER}(mit|expat|mit/x11)( open source| style)?( licen[sc]e)?{AFTER}"),
    ("bsdref", f"{UNDER}(2-clause |3-clause |two-clause |three-clause |simplified |new |modified |revised )?bsd([ -][23]-clause)?( licen[sc]e)?{AFTER}"),
    ("ccbyncsa", f"{UNDER}(cc[ -]by-nc-sa|creative commons attribution[ -]noncommercial-sharealike)([ -][0-9.]+)?{AFTER}"),
    ("ccbyncnd", f"{UNDER}(cc[ -]by-nc-nd|creative commons attribution[ -]noncommercial-noderiv[a-z]*)([ -][0-9.]+)?{AFTER}"),
    ("ccbync", f"{UNDER}(cc[ -]by-nc|creative commons attribution[ -]noncommercial)([ -][0-9.]+)?{AFTER}"),
    ("ccbysa", f"{UNDER}(cc[ -]by-sa|creative commons attribution[ -]sharealike)([ -][0-9.]+)?{AFTER}"),
    ("ccbynd", f"{UNDER}(cc[ -]by-nd|creative commons attribution[ -]noderiv[a-z]*)([ -][0-9.]+)?{AFTER}"),
    ("ccby", f"{UNDER}(cc[ -]by|creative commons attribution)([ -][0-9.]+)?{AFTER}"),
    ("cc0", f"{UNDER}(cc0|public domain|creative commons zero){AFTER}"),
    ("zlibgrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions.*"),
    ("zlibasis", "this software is provided as-is without any express or implied warranty.*"),
    ("zlibref", f"{UNDER}(zlib|zlib/libpng|libpng)( licen[sc]e)?{AFTER}"),
    ("boostgrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("boosttitle", "boost software license version 1\\.0.*"),
    ("boostref", f"{UNDER}boost software licen[sc]e{AFTER}"),
    ("eplref", f"{UNDER}eclipse (public|distribution) licen[sc]e{AFTER}"),
    ("epltitle", "eclipse public license v ?[12]\\.0"),
    ("mplname", f"{UNDER}(mozilla public licen[sc]e|mpl){AFTER}"),
    ("iscref", f"{UNDER}isc licen[sc]e{AFTER}"),
    ("mittitle", "(the )?(mit|expat) licen[sc]e( mit)?"),
    ("isctitle", "(the )?isc licen[sc]e( isc)?"),
    ("bsdtitle", "(the )?(bsd [23]-clause|[23]-clause bsd|new bsd|modified bsd|simplified bsd) licen[sc]e"),
    ("apache2body", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable (copyright|patent) license.*"),
    ("gplbody", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agplbody", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("spdx", "spdx-license-identifier .+"),
    ("gnutitle", "gnu general public license"),
    ("lgpltitle", "gnu (lesser|library) general public license"),
    ("agpltitle", "gnu affero general public license"),
    ("gpl3date", "version 3 29 june 2007"),
    ("gpl2date", "version 2 june 1991"),
    ("lgpl21date", "version 2\\.1 february 1999"),
    ("agpl3date", "version 3 19 november 2007"),
    ("gnuverbatim", "(.* )?everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("apachetitle", "apache license"),
    ("apache2date", "version 2\\.0 january 2004"),
    ("apache2terms", "terms and conditions for use reproduction and distribution"),
    ("mpl2title", "mozilla public license version 2\\.0"),
    ("ccbysatitle", "(creative commons )?attribution-sharealike [0-9.]+ (international|unported)( public license)?"),
    ("ccbytitle", "(creative commons )?attribution [0-9.]+ (international|unported)( public license)?"),
    ("cc0title", "(creative commons )?cc0 1\\.0 universal"),
    ("rights", "(copyright .*|c .*)?all rights reserved( .*)?"),
    ("copyright", "copyright (c )?[0-9][0-9][0-9][0-9].*"),
)

# Licence, sequence of identifiers (a regular expression over "id "), in order.
RULES = (
    ("MIT", "(mittitle )?(copyright |rights )*mitgrant mitnotice asis (noliable )?"),
    ("ISC", "(isctitle )?(copyright |rights )*iscgrant (asis )?(noliable )?"),
    ("BSD-3-Clause", "(bsdtitle )?(copyright |rights )*bsdgrant bsdsource bsdbinary bsdname (bsdasis )?(noliable )?"),
    ("BSD-2-Clause", "(bsdtitle )?(copyright |rights )*bsdgrant bsdsource bsdbinary (bsdasis )?(noliable )?"),
    ("GPL-3.0", "gnutitle gpl3date (copyright |rights )*gnuverbatim "),
    ("GPL-2.0", "gnutitle gpl2date (copyright |rights )*gnuverbatim "),
    ("LGPL", "lgpltitle (gpl3date |lgpl21date |gpl2date )(copyright |rights )*gnuverbatim "),
    ("AGPL", "agpltitle agpl3date (copyright |rights )*gnuverbatim "),
    ("Apache-2.0", "apachetitle apache2date (apache2terms )?(apache2body )*"),
    ("Zlib", "(zlibasis )?(noliable )?zlibgrant "),
    ("BSL-1.0", "(boosttitle )?boostgrant (asis )?(noliable )?"),
    ("MPL-2.0", "mpl2title (mplref )*"),
    ("CC-BY-SA", "(ccbysatitle )+"),
    ("CC-BY", "(ccbytitle )+"),
    ("public-domain", "(cc0title )+"),
    ("Apache-2.0", "apache2grant (apache2use )?(apache2copy )?(apache2asis )?"),
    ("GPL-or-later", "gplgrant (gplhope )?"),
    ("GPL-3.0", "gpl3only (gplhope )?"),
    ("GPL-2.0", "gpl2only (gplhope )?"),
    ("MIT-part", "mitgrant (mitnotice )?"),
    ("BSD-part", "bsdgrant (bsdsource )?(bsdbinary )?"),
    ("AGPL", "(agplref |agplonly |agplbody )"),
    ("GPL-or-later", "gpllater "),
    ("LGPL", "lgplref "),
    ("GPL-3.0", "(gpl3ref |gplbody )"),
    ("GPL-2.0", "gpl2ref "),
    ("MPL-2.0", "(mplref |mplname )"),
    ("MIT", "(mitref |mittitle )"),
    ("ISC", "(iscref |isctitle )"),
    ("Zlib", "zlibref "),
    ("BSL-1.0", "(boostref |boosttitle )"),
    ("EPL", "(eplref |epltitle )"),
    ("Apache-2.0", "apache2body "),
    ("BSD", "(bsdref |bsdtitle )"),
    ("CC-BY-NC-SA", "ccbyncsa "),
    ("CC-BY-NC-ND", "ccbyncnd "),
    ("CC-BY-NC", "ccbync "),
    ("CC-BY-SA", "ccbysa "),
    ("CC-BY-ND", "ccbynd "),
    ("CC-BY", "ccby "),
    ("public-domain", "(cc0 |unlicense )"),
    ("SPDX-tag", "spdx "),
    ("all-rights-reserved", "rights "),
)

#: Further forms of some sentences, as published.
MORE = {
    "mplref": "this source code form is subject to the terms of the mozilla public license v 2\\.0",
    "lgplref": "this (library|program) is free software you can redistribute it and/?or modify it under the terms of the gnu (lesser|library) general public licen[sc]e as published by .*",
    "agplref": "this program is free software you can redistribute it and/?or modify it under the terms of the gnu affero general public licen[sc]e as published by .*",
}

#: Sentences end at a mark and white space or a line's end, and at blank lines.
BREAK = r"[.!?;]+[\x20\t\r]*\n|[.!?;]+[\x20\t]+|\n[\x20\t\r]*\n|:[\x20\t\r]*\n"
LINE = r"\n"

#: Marks that end no sentence, between the parts of a GNU notice and after "v.": (pattern, what stays between the parts).
GAP = r"[\x20\t\n\r\f#*/;:]"
JOINED = (
    (rf"(?i)(free{GAP}+software){GAP}+(you{GAP}+can{GAP}+redistribute)", " "),
    (rf"(?i)(software{GAP}+foundation){GAP}+(either{GAP}+version)", " "),
    (rf"(?i)(\bv\.){GAP}+([0-9])", ""),
)


def let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def plain(sentence: Column) -> Column:
    s = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+/-]+", " ")
    s = F.regexp_replace(s, r"[./+-]+( |$)", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def forms() -> list[tuple[str, str]]:
    return [(name, f"{pattern}|{MORE[name]}" if name in MORE else pattern) for name, pattern in SENTENCES]


def needed(pattern) -> set[str]:
    """Runs of letters and digits of which every match of a parsed pattern has one; empty if there is no such set."""
    choices, run = [], ""
    for op, value in [*pattern, (None, None)]:
        name = str(op)
        if name == "LITERAL" and chr(value).isalnum():
            run += chr(value)
            continue
        choices, run = [*choices, {run}], ""
        if name == "SUBPATTERN":
            choices.append(needed(value[-1]))
        elif name == "BRANCH":
            branches = [needed(b) for b in value[1]]
            choices.append(set().union(*branches) if all(branches) else set())
        elif name == "MAX_REPEAT" and value[0] > 0:
            choices.append(needed(value[2]))
    best = max(choices, key=lambda words: min(map(len, words), default=0))
    return best if all(best) else set()


def first_test() -> str:
    """A pattern of words without one of which a lower-case text has none of the known sentences, however its lines are
    wrapped: a word is whole in the text, as only what is between words changes in its plain form."""
    words: set[str] = set()
    for name, pattern in forms():
        of_form = needed(re._parser.parse(pattern))
        if not of_form:
            raise ValueError(f"no word is in all of {name}")
        words |= of_form
    return "|".join(sorted(w for w in words if not any(v != w and v in w for v in words)))


FIRST = first_test()


def hinted(text: Column) -> Column:
    return F.lower(text).rlike(FIRST)


def known(sentence: Column) -> Column:
    """The identifier of a sentence, or empty."""

    def looked_up(s: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, pattern in forms():
            out = out.when(s.rlike(f"^({pattern})$"), name)
        return out.otherwise("")

    return F.when(hinted(sentence), let(plain(sentence), looked_up)).otherwise("")


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order. Of an unknown sentence each line is looked up by itself."""
    lines = lambda s: F.transform(F.split(s, LINE, -1), lambda x: known(x))
    for pattern, between in JOINED:
        text = F.regexp_replace(text, pattern, f"$1{between}$2")
    each = F.transform(F.split(text, BREAK, -1), lambda s: F.when(hinted(s), let(known(s), lambda k: F.when(k != "", F.array(k)).otherwise(lines(s)))).otherwise(F.array(F.lit(""))))
    return F.filter(F.flatten(each), lambda k: k != "")


def marked_rules() -> list[tuple[str, str]]:
    return [(name, re.sub(r"([a-z0-9]+) ", r"<\1>", rule)) for name, rule in RULES]


def reported(sequence: Column) -> Column:
    """Licences that the rules find in ``<id><id>...``; what a rule has used is hidden from later ones by a bar."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rule")) for n, r in marked_rules()])

    def step(state: Column, r: Column) -> Column:
        found = F.regexp_count(state.rest, r.rule) > 0
        return F.struct(
            F.regexp_replace(state.rest, r.rule, F.lit("|")).alias("rest"),
            F.when(found & ~F.array_contains(state.found, r["name"]), F.concat(state.found, F.array(r["name"]))).otherwise(state.found).alias("found"),
        )

    start = F.struct(sequence.alias("rest"), F.lit([]).cast("array<string>").alias("found"))
    return F.aggregate(rules, start, step, lambda s: s.found)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, sentences, n_known`` for every row of ``docs``.

    ``licenses`` lists what the rules report, in the order of the rules, comma-joined, each once; ``sentences`` the
    identifiers in order, blank-joined; ``n_known`` their number. Null and empty texts, and texts without a known
    sentence, give empty strings and 0. Whole texts are cut. Rows that repeat come out each. An empty table gives no
    rows. Other columns of ``docs`` play no part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit([]).cast("array<string>")
    found = docs.select("doc_id", F.when(hinted(text), identifiers(text)).otherwise(none).alias("ids"))
    sequence = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    return found.select(
        "doc_id",
        F.when(F.size("ids") > 0, F.array_join(reported(sequence), ",")).otherwise("").alias("licenses"),
        F.array_join("ids", " ").alias("sentences"),
        F.size("ids").cast("long").alias("n_known"),
    )


def duckdb_sql() -> str:
    """The same in DuckDB's SQL, from the same tables of sentences and rules."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    plain_sql = lambda s: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9.+/-]+', ' ', 'g'), '[./+-]+( |$)', ' ', 'g'), ' +', ' ', 'g'))"
    cases = " ".join(f"WHEN regexp_matches(p, {q(f'^({pattern})$')}) THEN {q(name)}" for name, pattern in forms())
    hint = lambda s: f"regexp_matches(lower({s}), {q(FIRST)})"
    joined = "text"
    for pattern, between in JOINED:
        joined = f"regexp_replace({joined}, {q(pattern)}, {q(rf'\1{between}\2')}, 'g')"
    rest, founds, at = [], [], "seq"
    for n, (name, rule) in enumerate(marked_rules()):
        rest.append((f"r{n}", f"regexp_replace({at}, {q(rule)}, '|', 'g')"))
        founds.append(f"CASE WHEN regexp_matches({at}, {q(rule)}) THEN {q(name)} END")
        at = f"r{n}"
    chain = "s0 AS (SELECT row, seq, sentences, n_known FROM joined)"
    for n, (name, expression) in enumerate(rest):
        chain += f",\ns{n + 1} AS (SELECT *, {expression} AS {name} FROM s{n})"
    names = list(dict.fromkeys(name for name, _ in RULES))
    first = {name: [f for (m, _), f in zip(RULES, founds, strict=True) if m == name] for name in names}
    listed = ", ".join(f"coalesce({', '.join(first[name])})" if len(first[name]) > 1 else first[name][0] for name in names)
    return f"""
WITH numbered AS (
  SELECT *, row_number() OVER () AS row FROM documents),
cut AS (
  SELECT doc_id, row, unnest(string_split_regex(t, {q(BREAK)})) AS s, generate_subscripts(string_split_regex(t, {q(BREAK)}), 1) AS i
  FROM (SELECT doc_id, row, {joined} AS t FROM numbered WHERE {hint('text')})),
whole AS (
  SELECT *, CASE WHEN {hint('s')} THEN CASE {cases} ELSE '' END ELSE '' END AS k
  FROM (SELECT *, {plain_sql('s')} AS p FROM cut)),
lines AS (
  SELECT row, i, unnest(string_split_regex(s, '\\n')) AS s, generate_subscripts(string_split_regex(s, '\\n'), 1) AS j FROM whole WHERE k = ''),
single AS (
  SELECT row, i, j, CASE WHEN {hint('s')} THEN CASE {cases} ELSE '' END ELSE '' END AS k
  FROM (SELECT *, {plain_sql('s')} AS p FROM lines)),
ids AS (
  SELECT row, i, 0 AS j, k FROM whole WHERE k <> '' UNION ALL SELECT row, i, j, k FROM single WHERE k <> ''),
joined AS (
  SELECT row, '<' || string_agg(k, '><' ORDER BY i, j) || '>' AS seq, string_agg(k, ' ' ORDER BY i, j) AS sentences, count(*) AS n_known
  FROM ids GROUP BY row),
{chain}
SELECT d.doc_id, coalesce(array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ','), '') AS licenses,
       coalesce(sentences, '') AS sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known
FROM numbered d LEFT JOIN s{len(rest)} USING (row)
"""
