"""op10: licence scans by sentence rules, with DataFrame functions only.

Texts are split to sentences (at line ends and after . ; : ! ? before white space), sentences are normalised (A-Z to lower case,
runs of other characters than letters and digits to one space), and normalised sentences that are known become
identifiers. A sentence that a line end cuts (no sentence end before it, and words in the next line) is also tried with the
lines that follow it, so hard-wrapped texts are found; blank lines end sentences. A known sentence that ends in a star may be followed by more words.
A document's identifiers in order are then matched against ordered rules: a rule holds where its
identifiers follow each other with no other known sentence between, and are not part of a match of a longer rule of another licence.

Result: a row per document and licence found: doc_id, license_id, n_matches, first_sentence, last_sentence (places of the
first and last sentence of its matches, from 0). Null and empty texts have no sentences and no rows; rows without a doc_id take no part. Copies of one row
(same doc_id and text) count once; rows with one doc_id and different texts have results of their own. Very long texts are read whole. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Normalised sentences of public licences, by identifier. A final star: any end. Of several that hold the first counts.
SENTENCES = {
    "mit_ref": "released under the mit license",
    "mit_ref2": "licensed under the mit license *",
    "mit_title": "the mit license mit",
    "mit_title2": "mit license",
    "mit_title3": "the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software *",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind *",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted *",
    "isc_grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted *",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties *",
    "isc_title": "isc license *",
    "apache_ref": "licensed under the apache license version 2 0 *",
    "apache_title": "apache license version 2 0 january 2004 *",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at *",
    "apache_dist": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis *",
    "gpl3_ref": "this work is licensed under the gnu general public license version 3 0 *",
    "gpl3_plain": "this work is licensed under the gnu general public license version 3",
    "gpl3_title": "gnu general public license version 3 29 june 2007 *",
    "gpl2_title": "gnu general public license version 2 june 1991 *",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007 *",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999 *",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007 *",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license *",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license *",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license *",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license *",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license *",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license *",
    "gpl_free": "this program is free software",
    "lgpl_free": "this library is free software",
    "gpl_hope": "this program is distributed in the hope that it will be useful *",
    "lgpl_hope": "this library is distributed in the hope that it will be useful *",
    "ccbync_ref": "licensed under cc by nc 4 0 *",
    "ccby_ref": "licensed under cc by 4 0 *",
    "ccbysa_ref": "licensed under cc by sa 4 0 *",
    "ccby_long": "this work is licensed under a creative commons attribution 4 0 international license *",
    "ccbync_long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license *",
    "ccbysa_long": "this work is licensed under a creative commons attribution sharealike 4 0 international license *",
    "cc0_title": "cc0 1 0 universal *",
    "cc0_waive": "to the extent possible under law the author has waived all copyright *",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice *",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice *",
    "bsd_names": "neither the name of *",
    "mpl_ref": "this source code form is subject to the terms of the mozilla public license v *",
    "mpl_title": "mozilla public license version 2 0 *",
    "epl_ref": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 *",
    "epl_ref2": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 *",
    "epl_title": "eclipse public license v 2 0 *",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost_title": "boost software license version 1 0 17th august 2003 *",
    "boost_ref": "distributed under the boost software license version 1 0 *",
    "zlib_warranty": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose *",
    "spdx": "spdx license identifier",
    "id_mit": "mit",
    "id_apache": "apache 2 0",
    "id_gpl3": "gpl 3 0 only",
    "id_gpl3_later": "gpl 3 0 or later",
    "id_gpl2": "gpl 2 0 only",
    "id_gpl2_later": "gpl 2 0 or later",
    "id_lgpl3": "lgpl 3 0 or later",
    "id_agpl3": "agpl 3 0 or later",
    "id_bsd2": "bsd 2 clause",
    "id_bsd3": "bsd 3 clause",
    "id_isc": "isc",
    "id_mpl": "mpl 2 0",
    "id_epl": "epl 2 0",
    "id_boost": "bsl 1 0",
    "id_unlicense": "unlicense",
    "id_cc0": "cc0 1 0",
    "id_gpl3_short": "gpl 3 0",
    "id_gpl2_short": "gpl 2 0",
    "id_gpl2_note": "gpl 2 0 with linux syscall note",
    "id_gpl2_only_note": "gpl 2 0 only with linux syscall note",
    "id_gpl2_later_note": "gpl 2 0 or later with linux syscall note",
    "id_lgpl3_only": "lgpl 3 0 only",
    "id_lgpl3_short": "lgpl 3 0",
    "id_lgpl21_later": "lgpl 2 1 or later",
    "id_lgpl21_only": "lgpl 2 1 only",
    "id_lgpl21_short": "lgpl 2 1",
    "id_lgpl20_later": "lgpl 2 0 or later",
    "id_lgpl20_only": "lgpl 2 0 only",
    "id_agpl3_only": "agpl 3 0 only",
    "id_agpl3_short": "agpl 3 0",
    "id_artistic2": "artistic 2 0",
    "id_artistic1": "artistic 1 0 perl",
    "id_zlib": "zlib",
    "id_0bsd": "0bsd",
    "id_wtfpl": "wtfpl",
    "id_ccby": "cc by 4 0",
    "id_ccbysa": "cc by sa 4 0",
    "id_ccbync": "cc by nc 4 0",
    "id_ms_pl": "ms pl",
    "id_postgresql": "postgresql",
    "id_ofl": "ofl 1 1",
    "id_eupl": "eupl 1 2",
    "id_mit_or_apache": "mit or apache 2 0",
    "id_apache_or_mit": "apache 2 0 or mit",
    "id_apache_llvm": "apache 2 0 with llvm exception",
    "id_gpl2_or_mit": "gpl 2 0 or mit",
    "id_gpl2_only_or_mit": "gpl 2 0 only or mit",
    "id_gpl2_or_bsd3": "gpl 2 0 or bsd 3 clause",
    "id_gpl2_or_bsd2": "gpl 2 0 or bsd 2 clause",
    "artistic2_title": "the artistic license 2 0 *",
    "artistic2_title2": "artistic license 2 0 *",
    "perl_terms": "you can redistribute it and or modify it under the same terms as perl itself *",
    "artistic2_terms": "you can redistribute it and or modify it under the terms of the artistic license 2 0 *",
    "wtfpl_title": "do what the fuck you want to public license *",
    "ofl_ref": "this font software is licensed under the sil open font license version 1 1 *",
    "ofl_title": "sil open font license version 1 1 *",
    "bsd0_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "eupl_ref": "licensed under the eupl version 1 2 *",
    "postgresql_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted *",
    "ms_pl_title": "microsoft public license ms pl *",
    "cddl_title": "common development and distribution license cddl version 1 0 *",
    "psf_title": "python software foundation license version 2 *",
    "beer": "as long as you retain this notice you can do whatever you want with this stuff *",
}

#: Rules, each a licence and its sentences in order.
RULES = [
    ("MIT", ["mit_ref"]), ("MIT", ["mit_ref2"]), ("MIT", ["mit_grant", "mit_notice"]), ("MIT", ["mit_title", "mit_grant"]), ("MIT", ["mit_title2", "mit_grant"]), ("MIT", ["mit_title3", "mit_grant"]), ("MIT", ["spdx", "id_mit"]),
    ("ISC", ["isc_grant", "isc_as_is"]), ("ISC", ["isc_grant2", "isc_as_is"]), ("ISC", ["isc_title", "isc_grant"]), ("ISC", ["isc_title", "isc_grant2"]), ("ISC", ["spdx", "id_isc"]),
    ("Apache-2.0", ["apache_ref"]), ("Apache-2.0", ["apache_title"]), ("Apache-2.0", ["apache_use", "apache_copy", "apache_dist"]), ("Apache-2.0", ["spdx", "id_apache"]),
    ("GPL-3.0", ["gpl3_ref"]), ("GPL-3.0", ["gpl3_plain"]), ("GPL-3.0", ["gpl3_title"]), ("GPL-3.0", ["gpl3_terms"]), ("GPL-3.0", ["spdx", "id_gpl3"]), ("GPL-3.0", ["spdx", "id_gpl3_later"]),
    ("GPL-2.0", ["gpl2_title"]), ("GPL-2.0", ["gpl2_terms"]), ("GPL-2.0", ["spdx", "id_gpl2"]), ("GPL-2.0", ["spdx", "id_gpl2_later"]), ("GPL", ["gpl_free", "gpl_terms"]), ("GPL", ["gpl_terms", "gpl_hope"]),
    ("LGPL-3.0", ["lgpl3_title"]), ("LGPL-3.0", ["lgpl3_terms"]), ("LGPL-3.0", ["spdx", "id_lgpl3"]), ("LGPL-2.1", ["lgpl21_title"]), ("LGPL-2.1", ["lgpl21_terms"]),
    ("AGPL-3.0", ["agpl3_title"]), ("AGPL-3.0", ["agpl3_terms"]), ("AGPL-3.0", ["spdx", "id_agpl3"]),
    ("CC-BY-NC-4.0", ["ccbync_ref"]), ("CC-BY-4.0", ["ccby_ref"]), ("CC-BY-SA-4.0", ["ccbysa_ref"]), ("CC-BY-4.0", ["ccby_long"]), ("CC-BY-NC-4.0", ["ccbync_long"]), ("CC-BY-SA-4.0", ["ccbysa_long"]),
    ("CC0-1.0", ["cc0_title"]), ("CC0-1.0", ["cc0_waive"]), ("CC0-1.0", ["spdx", "id_cc0"]),
    ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary"]), ("BSD-3-Clause", ["bsd_source", "bsd_binary", "bsd_names"]), ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_names"]), ("BSD-2-Clause", ["spdx", "id_bsd2"]), ("BSD-3-Clause", ["spdx", "id_bsd3"]),
    ("MPL-2.0", ["mpl_ref"]), ("MPL-2.0", ["mpl_title"]), ("MPL-2.0", ["spdx", "id_mpl"]),
    ("EPL-2.0", ["epl_ref"]), ("EPL-2.0", ["epl_ref2"]), ("EPL-2.0", ["epl_title"]), ("EPL-2.0", ["spdx", "id_epl"]),
    ("Unlicense", ["unlicense"]), ("Unlicense", ["spdx", "id_unlicense"]), ("BSL-1.0", ["boost_title"]), ("BSL-1.0", ["boost_ref"]), ("BSL-1.0", ["spdx", "id_boost"]), ("Zlib", ["zlib_warranty", "zlib_grant"]), ("Zlib", ["spdx", "id_zlib"]),
    ("GPL-3.0", ["spdx", "id_gpl3_short"]), ("GPL-2.0", ["spdx", "id_gpl2_short"]), ("GPL-2.0", ["spdx", "id_gpl2_note"]), ("GPL-2.0", ["spdx", "id_gpl2_only_note"]), ("GPL-2.0", ["spdx", "id_gpl2_later_note"]),
    ("LGPL-3.0", ["spdx", "id_lgpl3_only"]), ("LGPL-3.0", ["spdx", "id_lgpl3_short"]), ("LGPL-2.1", ["spdx", "id_lgpl21_later"]), ("LGPL-2.1", ["spdx", "id_lgpl21_only"]), ("LGPL-2.1", ["spdx", "id_lgpl21_short"]), ("LGPL-2.0", ["spdx", "id_lgpl20_later"]), ("LGPL-2.0", ["spdx", "id_lgpl20_only"]),
    ("AGPL-3.0", ["spdx", "id_agpl3_only"]), ("AGPL-3.0", ["spdx", "id_agpl3_short"]), ("Artistic-2.0", ["spdx", "id_artistic2"]), ("Artistic-1.0-Perl", ["spdx", "id_artistic1"]), ("0BSD", ["spdx", "id_0bsd"]), ("WTFPL", ["spdx", "id_wtfpl"]),
    ("CC-BY-4.0", ["spdx", "id_ccby"]), ("CC-BY-SA-4.0", ["spdx", "id_ccbysa"]), ("CC-BY-NC-4.0", ["spdx", "id_ccbync"]), ("MS-PL", ["spdx", "id_ms_pl"]), ("PostgreSQL", ["spdx", "id_postgresql"]), ("OFL-1.1", ["spdx", "id_ofl"]), ("EUPL-1.2", ["spdx", "id_eupl"]),
    ("MIT", ["spdx", "id_mit_or_apache"]), ("Apache-2.0", ["spdx", "id_mit_or_apache"]), ("MIT", ["spdx", "id_apache_or_mit"]), ("Apache-2.0", ["spdx", "id_apache_or_mit"]), ("Apache-2.0", ["spdx", "id_apache_llvm"]),
    ("GPL-2.0", ["spdx", "id_gpl2_or_mit"]), ("MIT", ["spdx", "id_gpl2_or_mit"]), ("GPL-2.0", ["spdx", "id_gpl2_only_or_mit"]), ("MIT", ["spdx", "id_gpl2_only_or_mit"]), ("GPL-2.0", ["spdx", "id_gpl2_or_bsd3"]), ("BSD-3-Clause", ["spdx", "id_gpl2_or_bsd3"]), ("GPL-2.0", ["spdx", "id_gpl2_or_bsd2"]), ("BSD-2-Clause", ["spdx", "id_gpl2_or_bsd2"]),
    ("Artistic-2.0", ["artistic2_title"]), ("Artistic-2.0", ["artistic2_title2"]), ("Artistic-1.0-Perl", ["perl_terms"]), ("Artistic-2.0", ["artistic2_terms"]), ("WTFPL", ["wtfpl_title"]), ("OFL-1.1", ["ofl_ref"]), ("OFL-1.1", ["ofl_title"]), ("0BSD", ["bsd0_grant", "isc_as_is"]),
    ("EUPL-1.2", ["eupl_ref"]), ("PostgreSQL", ["postgresql_grant"]), ("MS-PL", ["ms_pl_title"]), ("CDDL-1.0", ["cddl_title"]), ("PSF-2.0", ["psf_title"]), ("Beerware", ["beer"]),
]
#: Of each rule, the longer rules of other licences that hold its sentences, and at which place: where one of these matches, the shorter does not count.
WITHIN = [[(b, o) for lb, b in RULES if lb != la and len(b) > len(a) for o in range(len(b) - len(a) + 1) if b[o : o + len(a)] == a] for la, a in RULES]


def _hint(sentence: str) -> str:
    """A word that texts with a sentence hold (one word: a line may end after each)."""
    return "licens" if "licens" in sentence else max(sentence.split(), key=len)


#: One of these is in every text in which a rule holds; first words, without which no sentence is known.
_HINTS = sorted({min((_hint(SENTENCES[i]) for i in ids), key=lambda h: (h != "licens", -len(h))) for _, ids in RULES})
_FIRST = "^[^a-z0-9]*(" + "|".join(sorted({s.split()[0] for s in SENTENCES.values()})) + ")([^a-z0-9]|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[\n\r]+|[.;:!?]+[ \t]+"
#: A line end inside a sentence: after no sentence end, and before a line with words. The next line is marked, and a sentence may go on through
#: as many marked lines as a known one has words.
WRAP, MARK, CUT, LINES = r"(?<![.;:!?\r\n])(\r\n|\n|\r)(?![^a-z0-9\n\r]*(?:[\n\r]|$))", "\x01", "\x02", max(len(s.split()) for s in SENTENCES.values())


def _body(sentence: str) -> str:
    """Pattern of a normalised sentence whose lines are joined by marks; it may end at each."""
    words = f"[ {MARK}]+".join(sentence.removesuffix("*").split())
    return f"^[ {MARK}]*{words}" + (f"(?:[ {MARK}]|$)" if sentence.endswith("*") else f"(?: *{MARK}| *$)")


_NAMES = list(SENTENCES)


def _by_length(starred: bool) -> dict[int, dict[str, int]]:
    """Places of the sentences that end in a star, or not, by their number of words."""
    out: dict[int, dict[str, int]] = {}
    for i, s in enumerate(SENTENCES.values()):
        if s.endswith("*") == starred:
            words = s.removesuffix("*").split()
            out.setdefault(len(words), {}).setdefault(" ".join(words), i)
    return out


def _place(table: dict[str, int], sentence):
    """The place of a sentence in a small constant map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), sentence)


def _first(places: list):
    """The identifier at the smallest place that is not null."""
    return F.try_element_at(F.array(*[F.lit(n) for n in _NAMES]), F.array_min(F.array(*places)) + 1)


def known(col):
    """The identifier of a normalised sentence, or null: lookups of the whole, and of as many first words as known beginnings have."""
    whole = {s: i for table in _by_length(False).values() for s, i in table.items()}
    return _first([_place(whole, col), *[_place(table, F.substring_index(col, " ", n)) for n, table in _by_length(True).items()]])


def known_wrapped(col):
    """The same of a sentence whose lines are joined by marks, at each of which it may end."""
    words = F.trim(F.regexp_replace(col, f"[ {MARK}]+", " "))
    begins = [_place(table, F.substring_index(words, " ", n)) for n, table in _by_length(True).items()]
    ends = [F.when(col.rlike(f"^[ {MARK}]*(?:[a-z0-9]+[ {MARK}]+){{{n - 1}}}[a-z0-9]+(?: *{MARK}| *$)"), _place(table, F.substring_index(words, " ", n))) for n, table in _by_length(False).items()]
    return _first(begins + ends)


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("v"), F.translate(F.col(text), _UPPER + MARK + CUT, _LOWER + ",,").alias("low"))
    hint = F.lit(False)
    for h in _HINTS:
        hint = hint | F.col("low").contains(h)
    parts = docs.where(hint).select("doc_id", "v", F.split(F.regexp_replace("low", WRAP, f"$1{MARK}"), SPLIT).alias("p"))
    # each piece as it is, and with the marked lines after it
    lines = parts.select("doc_id", "v", "p", F.posexplode("p").alias("n", "s")).where(F.col("s").rlike(_FIRST)).select("doc_id", "v", "n", "s", F.array_join(F.slice("p", F.col("n") + 1, LINES), CUT).alias("t"))
    joined = F.regexp_replace(F.regexp_extract("t", f"^[^{CUT}]*(?:{CUT}{MARK}[^{CUT}]*)*", 0), f"[^a-z0-9{MARK}]+", " ")
    one = F.trim(F.regexp_replace("s", "[^a-z0-9]+", " "))
    goes_on = F.col("t").contains(CUT + MARK)
    named = lines.select("doc_id", "v", "n", F.coalesce(known(one), F.when(goes_on, known_wrapped(joined))).alias("k")).where("k is not null").distinct()
    seq = named.groupBy("doc_id", "v").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("a"))
    texts = lambda ids: F.array(*[F.lit(x) for x in ids])
    longer = lambda w: F.array(*[F.struct(texts(b).alias("ids"), F.lit(o).alias("o")) for b, o in w]) if w else F.array().cast("array<struct<ids:array<string>,o:int>>")
    rules = F.array(*[F.struct(F.lit(r).alias("license_id"), texts(ids).alias("ids"), longer(w).alias("longer")) for (r, ids), w in zip(RULES, WITHIN, strict=True)])
    ends = seq.select("doc_id", "v", "a", F.transform("a", lambda x: x["k"]).alias("ks"), F.explode(rules).alias("r")).select("doc_id", "v", "a", "ks", "r.license_id", "r.ids", "r.longer", F.size("r.ids").alias("m"))
    # from place i on the rule's sentences, and no longer rule's around them
    inside = lambda i: F.exists("longer", lambda w: (i > w["o"]) & (F.slice("ks", F.greatest(i - w["o"], F.lit(1)), F.size(w["ids"])) == w["ids"]))
    at = F.filter(F.sequence(F.lit(1), F.size("a") - F.col("m") + 1), lambda i: (F.slice("ks", i, F.col("m")) == F.col("ids")) & ~inside(i))
    hits = ends.where("size(a) >= m").select("doc_id", "v", "license_id", "a", "m", F.explode(at).alias("i"))
    return (
        hits.select("doc_id", "v", "license_id", F.element_at("a", F.col("i"))["n"].alias("f"), F.element_at("a", F.col("i") + F.col("m") - 1)["n"].alias("l"))
        .groupBy("doc_id", "v", "license_id")
        .agg(F.count(F.lit(1)).alias("n_matches"), F.min("f").cast("long").alias("first_sentence"), F.max("l").cast("long").alias("last_sentence"))
        .drop("v")
    )


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL without look-around: lines are marked in two passes, as a line of one character is the end of one match and the start of the next."""
    case = " ".join(f"WHEN {f"starts_with(s || ' ', '{s[:-1].rstrip()} ')" if s.endswith('*') else f"s = '{s}'"} THEN '{k}'" for k, s in SENTENCES.items())
    wrapped = " ".join(f"WHEN regexp_matches(j, '{_body(s)}') THEN '{k}'" for k, s in SENTENCES.items())
    longer = lambda w: "[" + ", ".join(f"{{'ids': {b!r}, 'o': {o}}}" for b, o in w) + "]::STRUCT(ids VARCHAR[], o INT)[]"
    rules = " UNION ALL ".join(f"SELECT '{r}' AS license_id, {ids!r} AS ids, {longer(w)} AS longer" for (r, ids), w in zip(RULES, WITHIN, strict=True))
    mark = f"'(^|[^.;:!?\\r\\n])(\\r\\n|\\n|\\r)([^a-z0-9\\n\\r{MARK}]*[a-z0-9])', '\\1\\2{MARK}\\3', 'g'"
    return f"""
    WITH low AS (SELECT DISTINCT doc_id, text, translate(text, '{_UPPER + MARK + CUT}', '{_LOWER},,') AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    parts AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(regexp_replace(t, {mark}), {mark}), '{SPLIT}') AS p FROM low),
    one AS (SELECT doc_id, text, p, unnest(range(len(p))) AS n FROM parts),
    begun AS (SELECT doc_id, text, n, p[n + 1] AS raw, array_to_string(p[n + 1 : n + {LINES}], '{CUT}') AS t FROM one WHERE regexp_matches(p[n + 1], '{_FIRST}')),
    norm AS (SELECT doc_id, text, n, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s, contains(t, '{CUT}{MARK}') AS more,
     regexp_replace(regexp_extract(t, '^[^{CUT}]*(?:{CUT}{MARK}[^{CUT}]*)*', 0), '[^a-z0-9{MARK}]+', ' ', 'g') AS j FROM begun),
    named AS (SELECT doc_id, text, n, coalesce(CASE {case} END, CASE WHEN more THEN CASE {wrapped} END END) AS k FROM norm),
    seq AS (SELECT doc_id, text, list(k ORDER BY n) AS ks, list(n ORDER BY n) AS ns FROM named WHERE k IS NOT NULL GROUP BY doc_id, text),
    rules AS ({rules}),
    hits AS (SELECT doc_id, text, license_id, ns[i] AS f, ns[i + len(ids) - 1] AS l FROM seq, rules, unnest(range(1, len(ks) - len(ids) + 2)) AS u(i) WHERE ks[i : i + len(ids) - 1] = ids
     AND len(list_filter(longer, lambda w: i > w.o AND ks[i - w.o : i - w.o + len(w.ids) - 1] = w.ids)) = 0)
    SELECT doc_id, license_id, count(*) AS n_matches, min(f)::BIGINT AS first_sentence, max(l)::BIGINT AS last_sentence FROM hits GROUP BY doc_id, text, license_id
    """


SQL = {"op10_license_sentences": _sql()}
