"""Licence notices and identifier tags in whole texts.

An Aho-Corasick automaton over the words of a text (single spaces between and around them) finds every place of every
phrase in one pass, notice phrases and the words of identifier tags alike. Where a tag is found, its licence expression is
cut from the text and read by a shunting-yard parser: ``or`` binds weaker than ``and``, ``with`` ties an exception to a
licence, parentheses group. The expression gives its licences as labels and is evaluated against the allowed licences:
true if one side of an ``or``, both sides of an ``and``, are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text, text_bytes

#: The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of this scanner (their words in lower case), with label and strength of evidence.
NOTICES = {
    "apache license": ("apache", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd license": ("bsd", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by 4 0": ("cc-by-4.0", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by sa 4 0": ("cc-by-sa-4.0", 0.9),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nc 4 0": ("cc-by-nc-4.0", 0.9),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.5),
    "isc license": ("isc", 0.8),
    "eclipse public license": ("epl", 0.8),
}
TAG = "spdx license identifier"
TAG_AT = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.I)
BASE_STRENGTH = {"cc-by": 0.7, "gpl": 0.7, "reserved": 0.6}
#: Licences that an expression may rest on, by default.
ALLOWED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"})

#: Names that a tag may hold: licences of one text by name, families with their versions, own references, exceptions.
KNOWN = ("mit mit-0 isc zlib libpng unlicense wtfpl ncsa curl x11 0bsd ruby vim icu ftl hpnd json beerware postgresql openssl php-3.01 python-2.0 psf-2.0 "
         "bsl-1.0 ms-pl ms-rl qpl-1.0 sleepycat upl-1.0 w3c zpl-2.1 blueoak-1.0.0").split()
FAMILIES = re.compile(
    r"(?:apache|artistic|afl|osl|apsl|cpl|epl|ecl|mpl|cddl|cpal|cecill|eupl|ofl|odbl|pddl|lppl|mulanpsl|gpl|lgpl|agpl|gfdl)-\d+(?:\.\d+)*(?:-[a-z])?(?:-only|-or-later)?\+?"
    r"|bsd-\d-clause(?:-[a-z]+)*|cc0-\d\.\d|cc-by(?:-nc)?(?:-sa|-nd)?-\d\.\d(?:-[a-z]{2,4})?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.+-]*-exception(?:-\d+(?:\.\d+)*)?(?:-[a-z0-9.]+)*|additionref-[a-z0-9.-]+")

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


def known_name(word: str) -> bool:
    """Whether a lower-case word names a licence; any other word of prose does not."""
    return word in KNOWN or FAMILIES.fullmatch(word) is not None


def parse_expression(text: str, known: Callable[[str], bool] = known_name) -> list[str] | None:
    """The longest leading licence expression in postfix order (lower case), None if there is none or it is broken.

    The expression ends before the first word that cannot continue it: what stands for a licence must be ``known``, what
    follows ``with`` must be an exception's name.
    """
    out: list[str] = []
    stack: list[str] = []
    want_name, depth, done = True, 0, None
    for m in _TOKEN.finditer(text.lower()):
        t = m.group()
        if want_name:
            after_with = bool(stack) and stack[-1] == "with"
            if t == "(" and not after_with:
                stack.append(t)
                depth += 1
            elif not (EXCEPTION.fullmatch(t) if after_with else known(t)):
                return done
            else:
                out.append(t)
                want_name = False
        elif t == ")":
            if not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif t in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
            want_name = True
        else:
            break
        if not want_name and not depth:
            done = out + stack[::-1]
    return done


def licences_of(postfix: list[str]) -> list[str]:
    """Licences of an expression; an exception goes with its licence."""
    stack: list[list[str]] = []
    for t in postfix:
        if t in _BINDING:
            b, a = stack.pop(), stack.pop()
            stack.append([f"{x}-with-{y}" for x in a for y in b] if t == "with" else a + b)
        else:
            stack.append([t])
    return stack[0]


def permitted(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> bool:
    """Value of an expression where allowed licences are true; an exception takes nothing from its licence."""
    stack: list[bool] = []
    for t in postfix:
        if t in _BINDING:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            stack.append(t in allowed)
    return stack[0]


@lru_cache(4)
def automaton(phrases: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def _fold() -> bytes:
    """Bytes to bytes: A-Z in lower case, all that parts words a space."""
    table = bytearray(b" " * 256)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)):
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


FOLD = _fold()


def scan(texts: pa.Array, base: dict, notices: dict, allowed: frozenset[str]) -> dict[str, pa.Array]:
    """Columns of what was found in each text."""
    # a phrase has ASCII words only, so each byte of the other words may be read as one character
    find = automaton((*base, *notices, TAG))
    offsets, data = text_bytes(texts)
    raw = data.tobytes().translate(FOLD)
    folded = np.frombuffer(raw, np.uint8)
    word = folded != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    begins[inner] = word[inner]
    counted = np.concatenate(([0], np.cumsum(begins)))
    n = len(texts)
    n_words = counted[offsets[1:]] - counted[offsets[:-1]]
    n_base, first, last, n_tags = np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros(n, np.int64)
    base_labels, labels, spans, score = [""] * n, [""] * n, [[] for _ in range(n)], np.zeros(n)
    expressions, permit = [None] * n, [None] * n
    length = {p: p.count(" ") + 1 for p in (*base, *notices, TAG)}
    for i in range(n):
        line = " " + b" ".join(raw[offsets[i]:offsets[i + 1]].split()).decode("latin-1") + " "
        hits = [(end, p) for end, p in find.iter(line)]
        if not hits:
            continue
        # a phrase's word number is how many spaces stand before its first one
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        places = np.searchsorted(spaces, [end - len(p) - 1 for end, p in hits]).tolist()
        b_found, found, miss, tagged = set(), set(), 1.0, False
        for (_, p), at in zip(hits, places):
            if p == TAG:
                tagged = True
                continue
            spans[i].append((p, at, at + length[p]))
            if p in base:
                n_base[i] += 1
                first[i] = at if first[i] is None else min(first[i], at)
                last[i] = at if last[i] is None else max(last[i], at)
                b_found.add(base[p])
                strength = BASE_STRENGTH.get(base[p], 0.5)
            else:
                strength = notices[p][1]
                found.add(notices[p][0])
            miss = min(miss, 1 - strength)
        if tagged:
            parsed = [e for e in (parse_expression(m.group(1)) for m in TAG_AT.finditer(texts[i].as_py())) if e]
            if parsed:
                miss, n_tags[i] = 0.0, len(parsed)
                expressions[i] = [" ".join(e) for e in parsed]
                permit[i] = all(permitted(e, allowed) for e in parsed)
                found.update(x for e in parsed for x in licences_of(e))
        base_labels[i] = ",".join(sorted(b_found))
        labels[i] = ",".join(sorted(b_found | found))
        score[i] = 1 - miss
    kind = pa.list_(pa.struct([("phrase", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
    return {"n_words": pa.array(n_words), "n_base": pa.array(n_base), "first_word": pa.array(first, pa.int64()), "last_word": pa.array(last, pa.int64()),
            "base_labels": pa.array(base_labels), "labels": pa.array(labels), "score": pa.array(score), "n_tags": pa.array(n_tags), "permitted": pa.array(permit, pa.bool_()),
            "expressions": pa.array(expressions, pa.list_(pa.string())),
            "spans": pa.array([[{"phrase": p, "first": a, "end": b} for p, a, b in s] for s in spans], kind)}


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", base: dict = BASE, notices: dict = NOTICES,
                 allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, permitted, expressions, spans.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of any characters beyond ASCII. first_word and
    last_word are the smallest and the largest start of a base phrase. score is the strongest evidence found: 1 for a tag
    with a readable expression, else the phrase's strength, 0 for none. permitted is null without a readable tag, else
    whether all expressions hold. A null or empty text has no words and no finds. Every row is scanned, repeated ones too;
    texts of any length whole, in time linear in their length; an empty table gives no rows; other columns are not read, so
    their names may clash. One scan, no shuffle.
    """
    made = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
            ("labels", pa.string()), ("score", pa.float64()), ("n_tags", pa.int64()), ("permitted", pa.bool_()), ("expressions", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("phrase", pa.string()), ("first", pa.int64()), ("end", pa.int64())])))]
    kinds = (f"id {docs.schema[id].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
             "labels string, score double, n_tags bigint, permitted boolean, expressions array<string>, spans array<struct<phrase:string,first:bigint,end:bigint>>")
    read = docs.select(docs[id].alias("id"), docs[text].cast("string").alias("text"))
    out = read.mapInArrow(per_text(lambda t: scan(t, base, notices, allowed), "text", ["id"], made), kinds)
    return out.withColumnRenamed("id", id)
