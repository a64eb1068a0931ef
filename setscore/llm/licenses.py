"""Licence scan by ordered signature rules.

Hand-written signatures of licence bodies, file notices, "or later" grants and abbreviations stand beside
rules that a table of licences gives by five templates (identifier tag, grant, name, address, header). Every rule has
a priority and a confidence. Identifier expressions (``SPDX-License-Identifier: A OR B``, ``license = "A"``)
give a label for each identifier that is known. A rule runs only on texts that hold its keyword;
one Aho-Corasick pass finds all keywords of a text, both with every run of other characters than letters
and digits as one blank, so that wrapped and commented names count. Detections are taken by priority, then length;
one that overlaps what is already taken, or lies within it, is suppressed.

Base labels are places of three fixed word phrases; they always stay, beside the rules' labels.
Documents are read once, one text at a time, and nothing is shuffled. Quantifiers of the rules are
bounded, so long texts cost their length.

A null text is empty and has no words, labels or places. Repeated rows each give their own row.
Other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setscore.llm.common import ALNUM_WORD, ASCII_LOWER, append_column, free_name, table, texts_of

# The base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Label, keyword, name and address of each licence. In names a blank stands for up to
# four characters that aren't letters or digits; LIC for either spelling of licence; V for a word
# before a version number.
LICENSES = [
    ("agpl-3.0", "affero", "(?:gnu )?affero general public LIC(?: V ?3(?:.0)?)?", "gnu.org/licenses/agpl"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public LIC V ?2.1", "gnu.org/licenses/old-licenses/lgpl-2.1"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public LIC(?: V ?3(?:.0)?)?", "gnu.org/licenses/lgpl"),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public LIC(?: V ?2(?:.0)?)?", "gnu.org/licenses/old-licenses/lgpl-2.0"),
    ("gpl-3.0", "general public", "(?:gnu )?general public LIC V ?3(?:.0)?", "gnu.org/licenses/gpl"),
    ("gpl-2.0", "general public", "(?:gnu )?general public LIC V ?2(?:.0)?", "gnu.org/licenses/old-licenses/gpl-2.0"),
    ("gpl", "general public", "gnu general public LIC", "gnu.org/copyleft/gpl"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation LIC(?: V ?1.3)?", "gnu.org/licenses/fdl"),
    ("apache-2", "apache", "apache(?: software)? LIC(?: V)? ?2(?:.0)?", "apache.org/licenses/license-2.0"),
    ("apache-1.1", "apache", "apache(?: software)? LIC(?: V)? ?1.1", "apache.org/licenses/license-1.1"),
    ("mit", "mit", "(?:the )?mit LIC", "opensource.org/licenses/mit"),
    ("mit-0", "mit", "mit no attribution(?: LIC)?", "opensource.org/licenses/mit-0"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause) bsd LIC", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause) bsd LIC", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", "(?:original|old|4 clause) bsd LIC", "opensource.org/licenses/bsd-4-clause"),
    ("0bsd", "bsd", "(?:zero clause|free public) bsd LIC", "opensource.org/licenses/0bsd"),
    ("isc", "isc", "isc LIC", "opensource.org/licenses/isc"),
    ("mpl-2.0", "mozilla", "mozilla public LIC(?: V)? ?2(?:.0)?", "mozilla.org/mpl/2.0"),
    ("mpl-1.1", "mozilla", "mozilla public LIC(?: V)? ?1.1", "mozilla.org/mpl/1.1"),
    ("epl-2.0", "eclipse", "eclipse public LIC(?: V)? ?2(?:.0)?", "eclipse.org/legal/epl-2.0"),
    ("epl-1.0", "eclipse", "eclipse public LIC(?: V)? ?1(?:.0)?", "eclipse.org/legal/epl-v10"),
    ("cddl-1.1", "development and distribution", "common development and distribution LIC(?: V)? ?1.1", "opensource.org/licenses/cddl-1.1"),
    ("cddl-1.0", "development and distribution", "common development and distribution LIC(?: V ?1.0)?", "opensource.org/licenses/cddl-1.0"),
    ("cpl-1.0", "common public", "common public LIC(?: V ?1.0)?", "opensource.org/licenses/cpl1.0"),
    ("ipl-1.0", "ibm", "ibm public LIC(?: V ?1.0)?", "opensource.org/licenses/ibmpl"),
    ("artistic-2.0", "artistic", "artistic LIC(?: V)? ?2(?:.0)?", "opensource.org/licenses/artistic-2.0"),
    ("artistic-1.0", "artistic", "artistic LIC(?: V ?1.0)?", "opensource.org/licenses/artistic-1.0"),
    ("bsl-1.0", "boost", "boost software LIC(?: V ?1.0)?", "boost.org/license_1_0"),
    ("busl-1.1", "business source", "business source LIC(?: V? ?1.1)?", "mariadb.com/bsl11"),
    ("sspl-1.0", "server side", "server side public LIC(?: V? ?1(?:.0)?)?", "mongodb.com/licensing/server-side-public-license"),
    ("elastic-2.0", "elastic", "elastic LIC(?: V)? ?2(?:.0)?", "elastic.co/licensing/elastic-license"),
    ("unlicense", "unlicense", "the unlicense", "unlicense.org"),
    ("wtfpl", "what the fuck", "do what the fuck you want to public LIC", "wtfpl.net"),
    ("zlib", "zlib", "zlib(?: libpng)? LIC", "opensource.org/licenses/zlib"),
    ("libpng", "libpng", "libpng LIC(?: V ?2)?", "libpng.org/pub/png/src/libpng-license"),
    ("x11", "x11", "x11 LIC", "xfree86.org/3.3.6/copyright2"),
    ("postgresql", "postgresql", "postgresql LIC", "postgresql.org/about/licence"),
    ("python-2.0", "python", "python software foundation LIC(?: V ?2)?", "docs.python.org/license"),
    ("php-3.01", "php", "php LIC(?: V ?3.01)?", "php.net/license/3_01"),
    ("ruby", "ruby", "ruby LIC", "ruby-lang.org/en/about/license"),
    ("openssl", "openssl", "openssl LIC", "openssl.org/source/license"),
    ("curl", "curl", "curl LIC", "curl.se/docs/copyright"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source LIC", "opensource.org/licenses/ncsa"),
    ("ofl-1.1", "open font", "(?:sil )?open font LIC(?: V ?1.1)?", "scripts.sil.org/ofl"),
    ("eupl-1.2", "european union", "european union public LIC(?: V? ?1.2)?", "joinup.ec.europa.eu/software/page/eupl"),
    ("cecill-2.1", "cecill", "cecill(?: free software LIC)?(?: agreement)?(?: V? ?2.1)?", "cecill.info/licences"),
    ("mulan-2.0", "mulan", "mulan(?: psl| permissive software LIC) ?V? ?2", "license.coscl.org.cn/mulanpsl2"),
    ("upl-1.0", "universal permissive", "universal permissive LIC(?: V ?1.0)?", "oss.oracle.com/licenses/upl"),
    ("odbl-1.0", "open database", "open database LIC(?: V? ?1.0)?", "opendatacommons.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons", "open data commons attribution LIC(?: V? ?1.0)?", "opendatacommons.org/licenses/by"),
    ("pddl-1.0", "public domain dedication", "public domain dedication and LIC", "opendatacommons.org/licenses/pddl"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1.0)?(?: universal)?", "creativecommons.org/publicdomain/zero"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4].0)?", "creativecommons.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4].0)?", "creativecommons.org/licenses/by-nc-sa"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4].0)?", "creativecommons.org/licenses/by-nc"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4].0)?", "creativecommons.org/licenses/by-nd"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4].0)?", "creativecommons.org/licenses/by-sa"),
    ("cc-by", "cc", "cc by [1-4].0", "creativecommons.org/licenses/by"),
    ("cc-by", "cc", "cc by LIC", "creativecommons.org/licenses/by"),
    ("cc-by", "cc", "cc-by", "creativecommons.org/licenses/by"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4].0)?", "creativecommons.org/licenses/by-sa/"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4].0)?", "creativecommons.org/licenses/by/"),
    ("openrail-m", "rail", "(?:creativeml |bigscience )?openrail(?: m| plus plus m)?", "bigscience.huggingface.co/blog/the-bigscience-rail-license"),
    ("openrail-m", "open rail", "open rail(?: plus plus)? m", "bigscience.huggingface.co/blog/the-bigscience-rail-license"),
    ("openrail-m", "open rail", "open rail LIC", "bigscience.huggingface.co/blog/the-bigscience-rail-license"),
    ("proprietary", "all rights reserved", "all rights reserved", "www.copyright.gov"),
]
# Rule templates with NAME, LABEL and URL to fill in, the keyword (None: the
# licence's own), priority and confidence.
TEMPLATES = [
    ("tag", "spdx licen[cs]e identifier ?LABEL(?: or later| only)?", "spdx", 5, 1.0),
    ("grant", "(?:licen[cs]ed|distributed|released|available|provided) (?:to you )?under (?:the )?(?:terms of )?(?:the )?NAME", None, 4, 0.95),
    ("address", "(?:https?://)?(?:www\\.)?URL", None, 3, 0.9),
    ("header", "licen[cs]e ?(?:is )?(?:the )?NAME", None, 2, 0.85),
    ("name", "NAME", None, 1, 0.75),
]
# Signatures of bodies (whole licences) and notices (in files), with label, keyword and text.
# Blanks stand for up to twelve other characters, ~ for up to 160 words; LIC and V as above.
BODIES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("ncsa", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this LIC"),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "permission to use", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("postgresql", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met~ neither the names?~ may be used to endorse or promote products"),
    ("bsd-4-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met~ all advertising materials mentioning features or use of this software must display"),
    ("unlicense", "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "the name is changed", "changing it is allowed as long as the name is changed"),
    ("zlib", "held liable for any damages", "in no event will the authors? be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose"),
    ("apache-2", "january 2004", "apache LIC V 2.0 january 2004"),
    ("apache-2", "contributor hereby grants", "subject to the terms and conditions of this LIC each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LIC"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "intended to guarantee", "the gnu general public LIC is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "free copyleft", "the gnu general public LIC is a free copyleft LIC for software and other kinds of works"),
    ("agpl-3.0", "free copyleft", "the gnu affero general public LIC is a free copyleft LIC for software and other kinds of works"),
    ("lgpl-2.1", "lesser general", "this LIC the lesser general public LIC applies to some specially designated software packages"),
    ("lgpl-2.0", "library general", "this LIC the library general public LIC applies to some specially designated free software foundation software"),
    ("lgpl-3.0", "lesser general", "this V of the gnu lesser general public LIC incorporates the terms and conditions of V 3 of the gnu general public LIC"),
    ("gfdl-1.3", "useful document free", "the purpose of this LIC is to make a manual textbook or other functional and useful document free"),
    ("mpl-2.0", "incompatible with secondary", "each contributor hereby grants you a world wide royalty free non exclusive LIC~ incompatible with secondary licenses"),
    ("epl-2.0", "eclipse", "the accompanying program is provided under the terms of this eclipse public LIC"),
    ("sspl-1.0", "as a service", "if you make the functionality of the program or a modified V available to third parties as a service"),
    ("elastic-2.0", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("busl-1.1", "business source", "the business source LIC this document or the LIC is not an open source LIC"),
    ("cc0-1.0", "associated", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "extent possible under law", "to the extent possible under law~ has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "open font", "the goals of the open font LIC ofl are to stimulate worldwide development of collaborative font projects"),
    ("python-2.0", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide LIC"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("php-3.01", "php", "this product includes php(?: software)? freely available from"),
    ("ms-pl", "accept this", "this LIC governs use of the accompanying software if you use the software you accept this LIC"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("beerware", "retain this notice", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("artistic-2.0", "free software package", "this LIC establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ecl-2.0", "educational community", "educational community LIC V 2.0 april 2007"),
    ("afl-3.0", "academic free", "licensed under the academic free LIC V 3.0"),
    ("osl-3.0", "open software", "licensed under the open software LIC V 3.0"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
]
NOTICES = [
    ("apache-2", "except in compliance", "licensed under the apache LIC V 2.0 the LIC you may not use this file except in compliance with the LIC"),
    ("gpl-2.0-or-later", "any later version", "gnu general public LIC as published by the free software foundation either V 2(?:.0)? of the LIC or at your option any later V"),
    ("gpl-3.0-or-later", "any later version", "gnu general public LIC as published by the free software foundation either V 3(?:.0)? of the LIC or at your option any later V"),
    ("lgpl-2.0-or-later", "any later version", "gnu library general public LIC as published by the free software foundation either V 2(?:.0)? of the LIC or at your option any later V"),
    ("lgpl-2.1-or-later", "any later version", "gnu lesser general public LIC as published by the free software foundation either V 2.1 of the LIC or at your option any later V"),
    ("lgpl-3.0-or-later", "any later version", "gnu lesser general public LIC as published by the free software foundation either V 3(?:.0)? of the LIC or at your option any later V"),
    ("agpl-3.0-or-later", "any later version", "gnu affero general public LIC as published by the free software foundation either V 3(?:.0)? of the LIC or at your option any later V"),
    ("gpl-2.0", "free software foundation", "gnu general public LIC(?: as published by the free software foundation)? V 2(?:.0)?(?: only)? as published by the free software foundation"),
    ("gpl-2.0", "free software foundation", "gnu general public LIC as published by the free software foundation V 2(?:.0)? of the LIC"),
    ("gpl-3.0", "free software foundation", "gnu general public LIC as published by the free software foundation V 3(?:.0)? of the LIC"),
    ("gfdl-1.3-or-later", "any later version", "gnu free documentation LIC V 1.3 or any later V published by the free software foundation"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public LIC V 2.0"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public LIC V 1.1"),
    ("epl-2.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public LIC(?: V)? 2.0"),
    ("epl-1.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public LIC(?: V)? 1.0"),
    ("cddl-1.0", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution LIC"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font LIC V 1.1"),
    ("bsd-3-clause", "bsd style", "governed by a bsd style LIC that can be found in the LIC file"),
    ("mit", "mit style", "governed by an mit style LIC that can be found in the LIC file"),
    ("cc-by", "cc by", "(?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:a |the )?cc by(?! (?:nc|nd|sa))"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4].0)?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4].0)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4].0)?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4].0)?"),
    ("public-domain", "public domain", "(?:is|are|been)(?: hereby)? (?:released into|placed in|dedicated to|in) the public domain"),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|document|work|website) may be reproduced"),
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)~ is strictly prohibited"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary (?:information|property|material) of"),
]
# Names with a later version, and abbreviations.
LATER = [
    ("gpl-2.0-or-later", "general public", "(?:gnu )?general public LIC V ?2(?:.0)? or (?:any )?(?:later|newer)"),
    ("gpl-3.0-or-later", "general public", "(?:gnu )?general public LIC V ?3(?:.0)? or (?:any )?(?:later|newer)"),
    ("lgpl-2.1-or-later", "lesser general", "(?:gnu )?lesser general public LIC V ?2.1 or (?:any )?(?:later|newer)"),
    ("lgpl-3.0-or-later", "lesser general", "(?:gnu )?lesser general public LIC V ?3(?:.0)? or (?:any )?(?:later|newer)"),
    ("agpl-3.0-or-later", "affero", "(?:gnu )?affero general public LIC V ?3(?:.0)? or (?:any )?(?:later|newer)"),
    ("gpl-2.0-or-later", "gpl", "gpl ?V? ?2(?:.0)?(?:\\+| or (?:any )?(?:later|newer))"),
    ("gpl-3.0-or-later", "gpl", "gpl ?V? ?3(?:.0)?(?:\\+| or (?:any )?(?:later|newer))"),
    ("lgpl-2.1-or-later", "lgpl", "lgpl ?V? ?2.1(?:\\+| or (?:any )?(?:later|newer))"),
    ("lgpl-3.0-or-later", "lgpl", "lgpl ?V? ?3(?:.0)?(?:\\+| or (?:any )?(?:later|newer))"),
    ("agpl-3.0-or-later", "agpl", "agpl ?V? ?3(?:.0)?(?:\\+| or (?:any )?(?:later|newer))"),
]
SHORT = [
    ("gpl-2.0", "gpl", "gpl ?V? ?2(?:.0)?"), ("gpl-3.0", "gpl", "gpl ?V? ?3(?:.0)?"),
    ("lgpl-2.1", "lgpl", "lgpl ?V? ?2.1"), ("lgpl-3.0", "lgpl", "lgpl ?V? ?3(?:.0)?"),
    ("agpl-3.0", "agpl", "agpl ?V? ?3(?:.0)?"), ("apache-2", "asl", "asl ?V? ?2.0"),
    ("mit", "mit licensed", "mit licensed"), ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause"), ("llama-community", "community", "llama [234](?:.[1-3])? community LIC"),
]
# (rule, keyword and text of its signatures, priority, confidence)
SIGNATURES = [("body", BODIES, 7, 0.98), ("notice", NOTICES, 6, 0.97), ("later", LATER, 4, 0.95), ("short", SHORT, 1, 0.75)]
# What precedes an expression of identifiers, by keyword.
EXPRESSIONS = [("spdx", r"spdx[^a-z0-9]{1,4}licen[cs]e[^a-z0-9]{1,4}identifier[^a-z0-9(]{1,4}"),
               ("license", r"license[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"'\[]{0,2}"), ("licence", r"licence[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"'\[]{0,2}")]
_ID = r"[a-z0-9](?:[a-z0-9.-]{0,38}[a-z0-9])?\+?"
_IDS = rf"\(?{_ID}(?:[ \t)]{{1,4}}(?:or|and|with)[ \t(]{{1,4}}{_ID}){{0,12}}"
_one_id = re.compile(rf"(with[ \t(]{{1,4}})?({_ID})")
BASE_CONFIDENCE = 0.9
_GAP = "[^a-z0-9]{1,4}"
_WIDE = "[^a-z0-9]{1,12}"
_WORDS = "(?:[^a-z0-9]{1,12}[a-z0-9]+){0,160}?"
_blank = re.compile("[^a-z0-9]+")

PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("rule", T.StringType()),
                      T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
                      + [T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
                         T.StructField("score", T.DoubleType()), T.StructField("places", T.ArrayType(PLACE))])
_ARROW = pa.struct([(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
                   + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                      ("places", pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def _regex(text: str, gap: str) -> str:
    """The regular expression of a name or signature."""
    text = re.sub(r"(?<=\d)\.(?=\d|\[)|(?<=\?:)\.", r"\.", text).replace("LIC", "licen[cs]e").replace("~", _WORDS.replace(" ", ""))
    return re.sub(r"\bV\b", "(?:version|ver|v)", text).replace(" ?", f"(?:{gap})?").replace(" ", gap)


def rules() -> list[tuple[str | None, str, str, re.Pattern, int, float]]:
    """(label, kind, keyword, pattern, priority, confidence) of every rule, highest priority first; no label: the
    pattern is of an expression, whose first group holds the identifiers."""
    whole = lambda p: re.compile(f"(?<![a-z0-9]){p}(?![a-z0-9])")
    out = []
    for kind, template, keyword, priority, confidence in TEMPLATES:
        for label, own, name, url in LICENSES:
            word = _blank.sub(" ", keyword or (url.split("/")[0] if kind == "address" else own))
            text = template.replace("NAME", name).replace("LABEL", label.replace("-", " "))
            out.append((label, kind, word, whole(_regex(text, _GAP).replace("URL", re.escape(url))), priority, confidence))
    for kind, signatures, priority, confidence in SIGNATURES:
        out += [(label, kind, word, whole(_regex(text, _WIDE)), priority, confidence) for label, word, text in signatures]
    out += [(None, "expression", word, re.compile(f"(?<![a-z0-9]){before}({_IDS})"), 8, 1.0) for word, before in EXPRESSIONS]
    return sorted(dict.fromkeys(out), key=lambda r: -r[4])


def known_labels() -> dict[str, str]:
    """The label of every identifier that an expression may name."""
    labels = {x[0] for x in LICENSES} | {x[0] for _, s, *_ in SIGNATURES for x in s}
    out = {x: x for x in labels} | {"apache-2.0": "apache-2", "psf-2.0": "python-2.0", "gpl-2.0+": "gpl-2.0-or-later", "mulanpsl-2.0": "mulan-2.0", "x11": "x11"}
    for x in labels:
        if "gpl" in x or "gfdl" in x:
            base = x.removesuffix("-or-later")
            out |= {f"{base}-only": base if base in labels else x, f"{base}-or-later": f"{base}-or-later", f"{base}+": f"{base}-or-later"}
        if x.startswith("cc-by"):
            out |= {f"{x}-{v}": x for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
    return out


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.known = known_labels()
        self.keywords = ahocorasick.Automaton()
        for word in {r[2] for r in self.rules}:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()
        self.word = re.compile(ALNUM_WORD)
        self.phrases = [(p.split(), label) for p, label in PHRASES]

    def base(self, words: list[str]) -> list[tuple[int, str]]:
        """(first word, label) of every base place."""
        out = []
        for phrase, label in self.phrases:
            rare, at = phrase[-1], 0
            while True:
                try:
                    at = words.index(rare, at)
                except ValueError:
                    break
                first = at - len(phrase) + 1
                if first >= 0 and words[first:at + 1] == phrase:
                    out.append((first, label))
                at += 1
        return out

    def detections(self, text: str, prefilter: bool = True) -> list[tuple[int, int, str, str, float]]:
        """(start, end, label, rule, confidence) by start, overlaps resolved; ``text`` is lower-cased.
        Without ``prefilter`` all rules run."""
        present = {word for _, word in self.keywords.iter(_blank.sub(" ", text))} if prefilter else {r[2] for r in self.rules}
        if not present:
            return []
        found = []
        for k, (label, _, word, pattern, priority, _) in enumerate(self.rules):
            if word in present:
                for m in pattern.finditer(text):
                    found += [(-priority, a - b, a, b, k, x) for a, b, x in ([(*m.span(), label)] if label else self.identifiers(m))]
        kept: list[tuple[int, int, int, str]] = []          # disjoint, by start
        for _, _, start, end, k, label in sorted(found):
            i = bisect(kept, (start, end, k, label))
            if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or end <= kept[i][0]):
                kept.insert(i, (start, end, k, label))
        return [(a, b, x, f"{x}/{self.rules[k][1]}", self.rules[k][5]) for a, b, k, x in kept]

    def identifiers(self, m: re.Match) -> list[tuple[int, int, str]]:
        """(start, end, label) of an expression's known identifiers; the first one's place begins with the expression."""
        out = []
        for one in _one_id.finditer(m[1]):
            label = None if one[1] else self.known.get(one[2])
            if label:
                start = m.start() if not out else m.start(1) + one.start(2)
                out.append((start, m.start(1) + one.end(2), label))
        return out

    def scan(self, text: str) -> dict:
        low = text.translate(ASCII_LOWER)
        words = self.word.findall(low)
        base = self.base(words)
        found = self.detections(low)
        base_labels = {label for _, label in base}
        return {"n_words": len(words), "n_base": len(base), "first_word": min(base)[0] if base else None,
                "last_word": max(base)[0] if base else None, "base_labels": sorted(base_labels),
                "labels": sorted(base_labels | {d[2] for d in found}),
                "score": max([BASE_CONFIDENCE] * bool(base) + [d[4] for d in found], default=0.0),
                "places": [{"label": d[2], "rule": d[3], "start": d[0], "end": d[1]} for d in found]}


def license_scan(docs: DataFrame, name: str = "license") -> DataFrame:
    """``docs`` with a RESULT column ``name`` (or name_1, ... if docs has that): base places and labels, and the
    rules' detections (code points)."""
    name = free_name(docs, name)
    made: list[Scanner] = []

    def run(column):
        if not made:                 # once per task
            made.append(Scanner())
        return pa.array([made[0].scan(t) for t in texts_of(column)], type=_ARROW)

    return append_column(docs, name, RESULT, "text", run)


def op4_ordered_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), name="r")
    r = F.col("r")
    return found.select("doc_id", *[r[f].alias(f) for f in ("n_words", "n_base", "first_word", "last_word")],
                        F.array_join(r["base_labels"], ",").alias("base_labels"), F.array_join(r["labels"], ",").alias("labels"),
                        r["score"].alias("score"), F.size(r["places"]).cast("long").alias("n_places"))


QUERIES = {"op4_ordered_signatures": op4_ordered_signatures}
