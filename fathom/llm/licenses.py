"""License scans: sentences, known license sentences, ordered rules over their ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.common import ascii_lower, let, text_or_empty

#: A line's start with what marks a comment there, and what ends a sentence.
LINE_START = r"\r?\n[\x20\t]*(?:(?:/?\*+/?|//+|#+|;+|--+|%+|<!--|>+)(?:[\x20\t]+|(?=\r?\n)))?"
SENTENCE_END = r"""(?<=[.!?])(?<!\b[vV]\.)["')\]*]*[\x20\t\n\r]+|\n\n+"""
#: Every known sentence holds one of these, and one that holds a word of MENTION is reported if unknown.
HINT = r"(?i)licen[sc]|copyright|redistribut|permission|warrant|as\sis|public\sdomain|rights\sreserved|creative\scommons|\bcc[\x20-]by|\bcc0|free\ssoftware|the\sname|in\sno\sevent|unlicense|\b[al]?gpl|\beupl|\bcddl|\bofl\b|unencumbered|misrepresented|plainly\smarked|this\s(?:notice|work)|anyone\sis\sfree"
MENTION = r"licen[sc]|copyright|rights reserved"
SPDX = r"(?i:SPDX-License-Identifier):\x20?(\(?[A-Za-z0-9.+-]*[A-Za-z0-9+]\)?(?:\x20(?:AND|OR|WITH)\x20\(?[A-Za-z0-9.+-]*[A-Za-z0-9+]\)?)*)"

#: A name counts at the start of a sentence, as titles stand, or behind words that grant.
GRANT = r"(?:^\W*(?:the )?|\b(?:under|terms of|subject to|according to|governed by|covered by)\b.{0,100}?|\blicen[sc]e: ?)"
#: What takes a grant back, up to a "but" or the next comma: "not licensed under the ...".
NEGATED = r"\b(?:not|never|no longer|isn't|aren't|neither)\b(?:\W+\w+){0,3}?\W+(?:under|covered by|governed by|subject to)\b[^,;]*?(?=\bbut\b|[,;]|(?![^\n]))"
#: A sentence in which the names that stand beside each other are alternatives, whatever joins them.
CHOICE = r"\b(?:dual|tri|multi)[ -]?licen[sc]|\bat your (?:option|choice)\b|\byour choice\b|\beither\b"
_LATER = r".*?(?:any later version|or later|or newer|[0-9]\+)"
_GNU = {
    "agpl": r"\b(?:(?:gnu )?affero general public licen[sc]e|agpl)",
    "lgpl": r"\b(?:(?:gnu )?(?:lesser|library) general public licen[sc]e|lgpl)",
    "gpl": r"(?<!affero )(?<!lesser )(?<!library )\b(?:(?:gnu )?general public licen[sc]e|gpl)",
}
_GNU_VERSIONS = {"agpl": ["1", "3"], "lgpl": ["2.1", "2", "3"], "gpl": ["1", "2", "3"]}


def _gnu(name: str) -> list[tuple[str, str]]:
    """Versions with and without later ones, then the name alone; pointers to a license come last but one."""
    known = []
    for v in _GNU_VERSIONS[name]:
        number = v.replace(".", r"\.") if "." in v else rf"{v}(?:\.0)?(?!\.?[0-9])"
        exact = rf"{GRANT}{_GNU[name]}(?:.{{0,100}}?\b(?:version|v\.?) ?|[ -]?v?){number}"
        known += [(f"{name}-{v}-later", exact + _LATER), (f"{name}-{v}", exact)]
    return [*known, (f"{name}-see", rf"(?:received a copy of the|see the) {_GNU[name]}|{_GNU[name]}.{{0,40}}for more details"), (name, GRANT + _GNU[name])]


def _creative() -> list[tuple[str, str]]:
    """Creative Commons by abbreviation or by name, with a version or without."""
    words = {"by": "attribution", "nc": "non-?commercial", "sa": "share-?alike", "nd": "no-?deriv(?:ative)?s?(?: works)?"}
    known = []
    for kind in ("by-nc-sa", "by-nc-nd", "by-nc", "by-sa", "by-nd", "by"):
        parts = kind.split("-")
        long, short = "[ -]{1,3}".join(words[p] for p in parts), "[ -]".join(parts)
        name = rf"{GRANT}(?:an? )?(?:\bcc[ -]{short}|\bcreative commons,? {long})\b(?:[ -]licen[sc]e)?"
        known += [(f"cc-{kind}-{v}", rf"{name}(?: \w+){{0,2}}?[ ,-]*(?:version |v\.? ?)?{v.replace('.', chr(92) + '.')}") for v in ("4.0", "3.0", "2.5", "2.0", "1.0")]
        known.append((f"cc-{kind}", name))
    return known


#: (id, what a license is called, its versions). Licenses known by name alone.
_NAMED = [
    ("ofl", r"(?:sil )?open font licen[sc]e", ["1.1", "1.0"]),
    ("eupl", r"(?:european union public licen[sc]e|eupl)", ["1.2", "1.1", "1.0"]),
    ("cddl", r"(?:common development and distribution licen[sc]e(?: \(cddl\))?|cddl)", ["1.1", "1.0"]),
    ("artistic", r"artistic licen[sc]e", ["2.0", "1.0"]),
    ("psf", r"(?:python software foundation|psf) licen[sc]e", ["2.0", "2"]),
    ("afl", r"academic free licen[sc]e", ["3.0", "2.1"]),
    ("osl", r"open software licen[sc]e", ["3.0", "2.1"]),
    ("ms-pl", r"microsoft public licen[sc]e", []),
]
#: Known sentences by their normalised text: lower case, letters and digits only, single spaces.
EXACT = {
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this work is free": "wtfpl-free",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
}


#: Groups of (id, pattern over a lower-case sentence with single spaces). In a group the first that
#: is found counts; a sentence can give one id of each group, in the order in which they end in it.
SENTENCES: list[list[tuple[str, str]]] = [
    [("mit-title", GRANT + r"\b(?:mit|expat)[ -]licen[sc]e")],
    [("apache-2", GRANT + r"\bapache[ -]licen[sc]e,? ?(?:\(?version |v\.? ?|-)?2(?:\.0)?(?![.]?[0-9])"), ("apache-1.1", GRANT + r"\bapache(?: software)? licen[sc]e,? ?(?:version |v)?1\.1"), ("apache", GRANT + r"\bapache[ -]licen[sc]e")],
    [("apache-comply", r"may not use this (?:file|work|software) except in compliance with the licen[sc]e")],
    [("apache-copy", r"may obtain a copy of the licen[sc]e at")],
    [("apache-basis", r"unless required by applicable law or agreed to in writing.*without warranties or conditions")],
    [("apache-see", r"see the licen[sc]e for the specific language governing")],
    _gnu("agpl"),
    _gnu("lgpl"),
    _gnu("gpl"),
    [("hope", r"distributed in the hope that it will be useful, but without any warranty")],
    _creative(),
    [("cc0", rf"{GRANT}(?:\bcc0\b|creative commons zero)")],
    [("mpl-2", GRANT + r"\bmozilla public licen[sc]e,? ?(?:version |v\.? ?)?2(?:\.0)?"), ("mpl-1.1", GRANT + r"\bmozilla public licen[sc]e,? ?(?:version |v\.? ?)?1\.1"), ("mpl", GRANT + r"\bmozilla public licen[sc]e")],
    [("epl-2", GRANT + r"\beclipse public licen[sc]e,? ?(?:- ?)?(?:version |v\.? ?)?2(?:\.0)?"), ("epl-1", GRANT + r"\beclipse public licen[sc]e,? ?(?:- ?)?(?:version |v\.? ?)?1(?:\.0)?"), ("epl", GRANT + r"\beclipse public licen[sc]e")],
    [("bsd-3-title", GRANT + r"\b(?:bsd[ -]3[ -]clause|(?:3|three)[ -]clause bsd|(?:new|revised|modified) bsd)"), ("bsd-2-title", GRANT + r"\b(?:bsd[ -]2[ -]clause|(?:2|two)[ -]clause bsd|simplified bsd|freebsd licen[sc]e)"), ("bsd-title", GRANT + r"\bbsd[ -](?:style )?licen[sc]e")],
    [("isc-title", GRANT + r"\bisc licen[sc]e")],
    [(f"{i}-{v}", GRANT + rf"\b{name}(?:[ ,-]+(?:version |v\.? ?)?| ?v\.? ?){v.replace('.', chr(92) + '.')}") for i, name, versions in _NAMED for v in versions] + [(i, GRANT + rf"\b{name}") for i, name, _ in _NAMED],
    [("classpath-exception", r"\bclasspath exception"), ("gcc-exception", r"\bgcc runtime library exception")],
    [("boost", GRANT + r"\bboost software licen[sc]e")],
    [("zlib", GRANT + r"\bzlib(?:/libpng)? licen[sc]e")],
    [("wtfpl", GRANT + r"\bdo what the f\S+ you want to public licen[sc]e")],
    [("unlicense", r"this is free and unencumbered software released into the public domain|" + GRANT + r"\bthe unlicense"), ("public-domain", r"(?:released|placed|dedicated|is|are|put) (?:\w+ )?(?:into|in|to|under) the public domain")],
    [("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy")],
    [("mit-notice", r"the above copyright notice and this permission notice.{0,60}shall be included in all copies")],
    [("isc-grant", r"permission to use, copy, modify,? (?:and/or|and|or) distribute this software for any purpose with or without fee is hereby granted, provided that"), ("0bsd-grant", r"permission to use, copy, modify,? (?:and/or|and|or) distribute this software for any purpose with or without fee is hereby granted")],
    [("bsd-use", r"redistribution and use in source and binary forms, with or without modification, are permitted")],
    [("bsd-source", r"redistributions? of source code must retain the (?:above )?copyright notice")],
    [("bsd-binary", r"redistributions? in binary form must reproduce the (?:above )?copyright notice")],
    [("bsd-ads", r"all advertising materials mentioning features or use of this software.*acknowledge?ment|redistribut.*advertising materials")],
    [("bsd-name", r"(?:neither the names? of .*|the names? of .* (?:may|must) not )be used to endorse or promote products|neither the names? of .*endorse or promote products")],
    [("as-is", r"(?:software|program|work|file|library) is provided .{0,80}\"?as is\b")],
    [("no-liability", r"in no event shall .*(?:liable|liability)")],
    [("rights", r"all rights reserved")],
    [("copyright", r"\bcopyright (?:\(c\)|©|[0-9]{4})")],
]


_END = r"(?:<(?:as-is|no-liability|rights|copyright)>)*"
_BSD = r"(?:<bsd-use>)(?:<copyright>)*<bsd-source>(?:<copyright>)*<bsd-binary>"


_SHORT = {"ofl", "eupl", "cddl", "psf", "afl", "osl", "ms-pl"}
_SPELT = {"artistic": "Artistic"}


def _rules() -> list[tuple[str, str]]:
    gnu = []
    for name in ("agpl", "lgpl", "gpl"):
        rest = rf"(?:<hope>|<(?:{name}|gpl)-see>)*"
        spdx = lambda v: v if "." in v else f"{v}.0"
        for v in _GNU_VERSIONS[name]:
            gnu += [(f"{name.upper()}-{spdx(v)}-or-later", f"<{name}-{v}-later>{rest}"), (f"{name.upper()}-{spdx(v)}-only", f"<{name}-{v}>{rest}")]
        gnu += [(name.upper(), f"<{name}(?:-see)?>{rest}")]
    creative = [(i.upper(), f"<{i}>") for i, _ in _creative()]
    apache = r"(?:<apache-comply>|<apache-copy>|<apache-basis>|<apache-see>|<as-is>)*"
    return [
        ("BSD-4-Clause", rf"(?:<bsd-title>)?{_BSD}<bsd-ads><bsd-name>{_END}"),
        ("BSD-3-Clause", rf"(?:<bsd(?:-3)?-title>{_END})?{_BSD}<bsd-name>{_END}"),
        ("BSD-2-Clause", rf"(?:<bsd(?:-2)?-title>{_END})?{_BSD}{_END}"),
        ("BSD-3-Clause", "<bsd-3-title>"),
        ("BSD-2-Clause", "<bsd-2-title>"),
        ("BSD", "<bsd-title>"),
        ("MIT", rf"(?:<mit-title>(?:<rights>|<copyright>)*)?<mit-grant>(?:<mit-notice>)?{_END}"),
        ("MIT", "<mit-title>"),
        ("ISC", rf"(?:<isc-title>(?:<rights>|<copyright>)*)?<isc-grant>{_END}"),
        ("ISC", "<isc-title>"),
        ("0BSD", rf"<0bsd-grant>{_END}"),
        ("Apache-2.0", f"<apache-2>{apache}"),
        ("Apache-1.1", "<apache-1.1>"),
        ("Apache-2.0", f"<apache-comply><apache-copy>{apache}"),
        ("Apache", "<apache>"),
        *gnu,
        *creative,
        ("CC0-1.0", "<cc0>"),
        ("MPL-2.0", "<mpl-2>"),
        ("MPL-1.1", "<mpl-1.1>"),
        ("MPL", "<mpl>"),
        ("EPL-2.0", "<epl-2>"),
        ("EPL-1.0", "<epl-1>"),
        ("EPL", "<epl>"),
        *[(f"{i.upper() if i in _SHORT else _SPELT[i]}-{v if '.' in v else v + '.0'}", f"<{i}-{v}>") for i, _, versions in _NAMED for v in versions],
        *[(i.upper() if i in _SHORT else _SPELT[i], f"<{i}>") for i, _, _ in _NAMED],
        ("Classpath-exception-2.0", "<classpath-exception>"),
        ("GCC-exception-3.1", "<gcc-exception>"),
        ("BSL-1.0", "<boost>"),
        ("Zlib", "<zlib>(?:<as-is>|<no-liability>|<zlib-(?:grant|origin|altered|notice)>)*"),
        ("Zlib", "(?:<no-liability>)?(?:<zlib-grant>)?(?:<as-is>|<no-liability>)*<zlib-origin><zlib-altered><zlib-notice>"),
        ("WTFPL", "<wtfpl>"),
        ("Unlicense", "<unlicense>(?:<as-is>|<no-liability>|<unlicense-free>)*"),
        ("Public-Domain", "<public-domain>"),
    ]


#: (license, pattern over the ids of a text, each as <id>), tried in this order at each place.
RULES = _rules()


#: Ids that name a license; where two stand in one sentence, what is between them joins them.
NAMING = r"<(?:mit-title|apache(?:-2|-1\.1)?|(?:a|l)?gpl(?!-see)[^>]*|cc[-0][^>]*|[me]pl[^>]*|bsd(?:-[23])?-title|isc-title|boost|zlib|wtfpl|unlicense|public-domain|(?:ofl|eupl|cddl|artistic|psf|afl|osl|ms-pl)[^>]*)>"
_FOUND = "struct<ids:array<string>,told:string>"


def _ids(sentence: Column) -> Column:
    """(ids, told): ids of the known sentences that a sentence holds, in the order in which they end;
    ``unknown`` if it only mentions a license. ``told`` has them as <id>, and <OR> or <AND> between names."""

    def end(s: Column, pattern: str) -> Column:
        return F.length(F.regexp_extract(s, rf"\A((?s:.*?)(?:{pattern}))", 1))

    def of(s: Column) -> Column:
        def place(k: tuple[str, str], g: int) -> Column:
            return F.struct(end(s, k[1]).alias("end"), F.lit(g).alias("g"), F.lit(k[0]).alias("id"))

        groups = [reduce(lambda at, k: at.when(s.rlike(k[1]), place(k, g)), group[1:], F.when(s.rlike(group[0][1]), place(group[0], g))) for g, group in enumerate(SENTENCES)]  # noqa: B023
        known = F.create_map(*[F.lit(x) for pair in EXACT.items() for x in pair])
        whole = F.try_element_at(known, F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
        groups.append(F.when(whole.isNotNull(), F.struct(F.length(s).alias("end"), F.lit(len(SENTENCES)).alias("g"), whole.alias("id"))))
        return F.sort_array(F.filter(F.array(*groups), lambda x: x.isNotNull()))

    def tell(s: Column, placed: Column) -> Column:
        either = s.rlike(CHOICE)

        def one(x: Column, i: Column) -> Column:
            named = F.concat(F.lit("<"), x["id"], F.lit(">"))
            before = F.get(placed, i - 1)
            gap = F.substring(s, before["end"] + 1, x["end"] - before["end"])
            joint = F.regexp_extract(gap, r"\b(and|or)\b", 1)
            both = named.rlike(NAMING) & F.concat(F.lit("<"), before["id"], F.lit(">")).rlike(NAMING) & (joint != "")
            op = F.when((joint == "or") | either, "<OR>").otherwise("<AND>")
            return F.concat(F.when((i > 0) & both, op).otherwise(""), named)

        return F.array_join(F.transform(placed, one), "")

    plain = F.btrim(F.regexp_replace(sentence, r"[\x20\t\n\x0b\x0c\r]+", " "))
    tagged = F.transform(F.regexp_extract_all(plain, F.lit(SPDX), F.lit(1)), lambda x: F.concat(F.lit("spdx:"), x))
    low = ascii_lower(plain)
    found = let(F.regexp_replace(low, NEGATED, " "), lambda s: let(of(s), lambda x: F.struct(F.transform(x, lambda y: y["id"]).alias("ids"), tell(s, x).alias("told"))))

    def whole(t: Column, f: Column) -> Column:
        ids = F.concat(t, f["ids"])
        told = F.concat(F.array_join(F.transform(t, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""), f["told"])
        mention = F.when(low.rlike(MENTION), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(F.size(ids) > 0, ids).otherwise(mention).alias("ids"), told.alias("told")).cast(_FOUND)

    return let(tagged, lambda t: let(found, lambda f: whole(t, f)))


def _names(told: Column) -> Column:
    """Names of the rules that match the ids from left to right, and OR and AND, in order."""
    every = "|".join(f"(?:{p})" for p in ["<spdx:[^>]*>", "<OR>", "<AND>", *(p for _, p in RULES)])

    def name(m: Column) -> Column:
        first = F.when(m.startswith("<spdx:"), F.substring(m, F.lit(7), F.length(m) - 7)).when(m.isin("<OR>", "<AND>"), F.regexp_replace(m, "[<>]", ""))
        return reduce(lambda at, r: at.when(m.rlike(rf"\A(?:{r[1]})\z"), r[0]), RULES, first)

    return F.transform(F.regexp_extract_all(told, F.lit(every), F.lit(0)), name)


def _expression(names: Column) -> Column:
    """Names that a sentence joins, as one; exceptions behind their license; each such part once."""
    text = F.array_join(names, ";")
    text = F.regexp_replace(text, ";(OR|AND);", " $1 ")
    text = F.regexp_replace(text, ";((?:Classpath|GCC)-exception-[0-9.]+)", " WITH $1")
    return F.array_join(F.array_distinct(F.filter(F.split(text, ";"), lambda x: ~x.isin("", "OR", "AND"))), ", ")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_sentences, found, licenses, expression) of each row of ``docs``.

    A text is cut into sentences behind full stops and at blank lines, once marks of comments are
    gone; lines of one paragraph are one flow, so a wrapped sentence is one. ``found`` has (i, ids)
    of each sentence, counted from 0, that holds known license sentences or mentions a license
    (``unknown``). ``licenses`` are the names whose rules match the ids of the whole text in order:
    at each place the first of ``RULES`` that fits takes its ids. Unknown sentences stand in no
    rule's way; an SPDX line gives its expression. A grant that is denied ("not under the ...") counts
    as not said. A sentence is known by its normalised text (``EXACT``) or by a pattern. ``expression``
    has the names with OR and AND as their sentence joins them, and WITH before an exception.

    All of it is arrays within the row: no shuffle, no Python. Null and empty texts have no
    sentences. Rows are independent: repeated rows give the same twice, an empty table an empty one.
    """
    flow = F.regexp_replace(F.concat(F.lit("\n"), text_or_empty(text)), LINE_START, "\n")
    pieces = F.filter(F.split(flow, SENTENCE_END, -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))

    def scan(s: Column) -> Column:
        placed = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("s"))), lambda x: x["s"].rlike(HINT))
        held = F.transform(placed, lambda x: let(_ids(x["s"]), lambda y: F.struct(x["i"].alias("i"), y["ids"].alias("ids"), y["told"].alias("told"))))
        held = F.filter(held, lambda x: F.size(x["ids"]) > 0)
        return let(held, lambda f: F.struct(F.size(s).cast("long").alias("n"), F.transform(f, lambda x: F.struct(x["i"].alias("i"), x["ids"].alias("ids"))).alias("found"), _names(F.array_join(F.transform(f, lambda x: x["told"]), "")).alias("names")))

    found = docs.select(F.col(id_col), let(pieces, scan).alias("x"))
    licenses = F.array_distinct(F.filter("x.names", lambda n: ~n.isin("OR", "AND")))
    return found.select(id_col, F.col("x.n").alias("n_sentences"), "x.found", licenses.alias("licenses"), _expression(F.col("x.names")).alias("expression"))


def license_reports(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """How many sentences are known or only mention a license, their ids by place, and the licenses, as text."""
    found = scan_licenses(docs, id_col, text)
    unknown = F.size(F.filter("found", lambda x: F.array_contains(x["ids"], "unknown")))
    ids = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["i"].cast("string"), F.array_join(x["ids"], "+"))), ",")
    return found.select(id_col, "n_sentences", (F.size("found") - unknown).cast("long").alias("n_known"), unknown.cast("long").alias("n_unknown"), ids.alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "expression")
