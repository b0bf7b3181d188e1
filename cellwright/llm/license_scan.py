"""Licence scans: identifier tags and notice phrases by one Aho-Corasick pass, tags parsed by a shunting yard.

A text's words are its maximal runs of ``a-z0-9`` and code points from 0x80, A-Z lower-cased. Phrases are matched as
consecutive words. The same automaton finds identifier tags, ``SPDX-License-Identifier`` in words; what follows a tag's colon
on its line is an expression of identifiers, ``AND``, ``OR``, ``WITH`` and parentheses. Identifiers count if they are listed
(IDENTIFIERS and EXCEPTIONS, an optional ``+`` behind) or begin with ``LicenseRef-``; every one in a well-formed expression
becomes a label, and the expression is evaluated against the set of permissive licences.

A label's confidence is that of its strongest sign: a tag 1, a licence's own notice 0.9, its name 0.6, words that may mean
no licence 0.3. A text's score is the probability that one sign at least is right: 1 - product of (1 - confidence) over labels.

Defined cases: a null text counts as empty; texts without words have no places, null first and last words and score 0;
any length is read whole; repeated rows give repeated results; an ill-formed expression gives the labels of its longest
well-formed start, one that begins with an identifier not listed gives none; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellwright.llm.common import LOWER, doc_texts, table, text_runs

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICE, NAME, HINT = 0.9, 0.6, 0.3
#: Phrases of the method's own: label and confidence.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": ("mit", NOTICE),
    "the software is provided as is without warranty of any kind express or implied": ("mit", NOTICE),
    "the above copyright notice and this permission notice shall be included": ("mit", NOTICE),
    "licensed under the apache": ("apache", NOTICE),
    "you may not use this file except in compliance with the license": ("apache", NOTICE),
    "http www apache org licenses license 2 0": ("apache", NOTICE),
    "redistribution and use in source and binary forms": ("bsd", NOTICE),
    "redistributions of source code must retain the above copyright notice": ("bsd", NOTICE),
    "bsd license": ("bsd", NAME),
    "you can redistribute it and or modify it under the terms of the gnu general public license": ("gpl", NOTICE),
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": ("lgpl", NOTICE),
    "gnu lesser general public license": ("lgpl", NAME),
    "gnu library general public license": ("lgpl", NAME),
    "gnu affero general public license": ("agpl", NAME),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", NOTICE),
    "mozilla public license": ("mpl", NAME),
    "creative commons attribution": ("cc-by", NAME),
    "creativecommons org licenses by": ("cc-by", NOTICE),
    "creativecommons org publicdomain zero": ("cc0", NOTICE),
    "eclipse public license": ("epl", NAME),
    "boost software license": ("bsl", NAME),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", NOTICE),
    "isc license": ("isc", NAME),
    "this is free and unencumbered software released into the public domain": ("unlicense", NOTICE),
    "released into the public domain": ("public-domain", NAME),
    "public domain": ("public-domain", HINT),
    "all rights reserved": ("all-rights-reserved", HINT),
}
#: Licence identifiers of the SPDX list that corpora meet, and its exceptions, lower-cased.
IDENTIFIERS = set("""
0bsd afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0
artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear
bsd-3-clause-lbnl bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0
cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1
cecill-2.0 cecill-2.1 cecill-b cecill-c cpl-1.0 curl ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.2-only
gfdl-1.2-or-later gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0
gpl-3.0-only gpl-3.0-or-later hpnd icu ijg intel ipl-1.0 isc lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng libpng-2.0 libtiff lpl-1.02 lppl-1.3c mit mit-0 mit-advertising
mit-feh mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd
odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 oldap-2.8 openssl osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0
rpl-1.5 ruby sgi-b-2.0 sleepycat spl-1.0 sspl-1.0 tcl tcp-wrappers unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim vsl-1.0
w3c watcom-1.0 wtfpl x11 xnet zend-2.0 zlib zlib-acknowledgement zpl-2.0 zpl-2.1
""".split())  # fmt: skip
EXCEPTIONS = set("""
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0
gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception openssl-exception openvpn-openssl-exception
qt-gpl-exception-1.0 qt-lgpl-exception-1.1 universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())  # fmt: skip
TAG = "spdx license identifier"
PERMISSIVE = {"mit", "apache-2.0", "apache", "bsd-2-clause", "bsd-3-clause", "bsd", "isc", "cc-by", "cc-by-4.0", "cc0-1.0", "cc0", "unlicense", "zlib", "bsl-1.0", "bsl", "public-domain", "0bsd", "mit-0", "x11", "ncsa", "postgresql", "upl-1.0", "wtfpl"}

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER_BYTES = LOWER.tobytes()
_TO_WORDS = bytes(LOWER[i] if WORD[LOWER[i]] else 0x20 for i in range(256))
#: What stands between the last word of a tag and its expression.
_COLON = re.compile(rb"[ \t]*:[ \t]*")
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+\-]+)")
_RANK = {"or": 1, "and": 2, "with": 3}


def is_listed(identifier: str, exception: bool) -> bool:
    if exception:
        return identifier in EXCEPTIONS
    return identifier.removesuffix("+") in IDENTIFIERS or identifier.startswith("licenseref-") and len(identifier) > 11


def parse_expression(text: str) -> tuple[list[str], bool | None]:
    """(identifiers, whether permissive licences alone satisfy it) of the longest well-formed start; ([], None) if there is none."""
    output: list[tuple] = []  # postfix
    operators: list[str] = []
    depth, want_operand, best = 0, True, None
    at = 0
    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        low = token.lower()
        if want_operand:
            if token == "(":
                operators.append("(")
                depth += 1
            elif token == ")" or low in _RANK:
                break
            elif not is_listed(low, bool(operators) and operators[-1] == "with"):
                break
            else:
                output.append(("id", low))
                want_operand = False
        elif token == ")":
            if not depth:
                break
            while operators[-1] != "(":
                output.append(("op", operators.pop()))
            operators.pop()
            depth -= 1
        elif low in _RANK:
            while operators and operators[-1] != "(" and _RANK[operators[-1]] >= _RANK[low]:
                output.append(("op", operators.pop()))
            operators.append(low)
            want_operand = True
        else:
            break
        if not want_operand and not depth:
            best = output + [("op", x) for x in reversed(operators)]
    if best is None:
        return [], None
    stack: list[tuple[bool, list[str]]] = []
    for kind, x in best:
        if kind == "id":
            stack.append((x.removesuffix("+") in PERMISSIVE, [x]))
            continue
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if x == "with":  # the right side is an exception to the left licence
            stack.append((a, [f"{names_a[0]} with {names_b[0]}", *names_a]))
        else:
            stack.append((a and b if x == "and" else a or b, names_a + names_b))
    return stack[0][1], stack[0][0]


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase, label, NAME, True))
    for phrase, (label, confidence) in NOTICE_PHRASES.items():
        a.add_word(f" {phrase} ", (phrase, label, confidence, False))
    a.add_word(f" {TAG} ", (TAG, None, 1.0, False))
    a.make_automaton()
    return a


def scan_text(raw: bytes, automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, whether permissive licences satisfy all tags) of one text."""
    words = raw.translate(_TO_WORDS).split()
    flat = " " + b" ".join(words).decode("latin-1") + " "
    base, labels, places, tags = set(), {}, [], []
    for end, (phrase, label, confidence, is_base) in automaton.iter(flat):
        if label is None:
            tags.append(flat.count(" ", 0, end))  # words up to the tag's end
            continue
        labels[label] = max(confidence, labels.get(label, 0.0))
        if is_base:
            base.add(label)
            places.append(end - len(phrase) - 1)
    permissive = None
    if tags:
        ends = [m.end() for m in _WORDS.finditer(raw.translate(LOWER_BYTES))]
        for number in tags:
            if colon := _COLON.match(raw, ends[number - 1]):
                line = re.split(rb"[\r\n]", raw[colon.end() :], maxsplit=1)[0]
                names, ok = parse_expression(line.decode("utf-8", "replace"))
                labels.update(dict.fromkeys(names, 1.0))
                if names:
                    permissive = ok if permissive is None else permissive and bool(ok)
    # words before a place: the blanks before it
    first = flat.count(" ", 0, min(places)) if places else None
    last = flat.count(" ", 0, max(places)) if places else None
    score = 1.0 - math.prod(1.0 - labels[k] for k in sorted(labels))
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive; one scan, no shuffle."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = []
            for _, _, data, offsets in text_runs(batch.column("text")):
                raw = data.tobytes()
                out += [scan_text(raw[a:b], automaton) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return doc_texts(docs).mapInArrow(scan, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
