"""Skeletons of names: equal for names that a reader can take for each other.

A name is decomposed, each of its characters replaced by its prototype (a relation joined by character), and the result decomposed
again. The relation has three sources: pairs that are stated below, compatibility forms of letters and digits (full width, styled
mathematical letters, ligatures, Roman numerals ...) that Unicode's own decompositions give, and a file that the policy may
name, in the format of the Unicode security data (code points ; code points ; kind # comment).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters and the letters that they look like, after lower-casing, by script.
LOOK_ALIKES = {
    # ASCII
    "0": "o", "1": "l", "|": "l", "m": "rn", "w": "vv",
    # Latin
    "ı": "i", "ɩ": "i", "ɪ": "i", "ɑ": "a", "ɡ": "g", "ƍ": "g", "ᶃ": "g", "ƒ": "f", "ſ": "f", "ʋ": "u", "ƽ": "s", "ǀ": "l", "ʏ": "y", "ỿ": "y", "ᶌ": "v", "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴜ": "u", "ᴠ": "v", "ᴡ": "vv", "ᴢ": "z",
    "ꬵ": "f", "ꭇ": "r", "ꭈ": "r", "ꭎ": "u", "ꭒ": "u", "ꭚ": "y", "æ": "ae", "œ": "oe", "ĳ": "ij",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j", "ϱ": "p",
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ё": "ë", "һ": "h", "і": "i", "ї": "ï", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "ѵ": "v", "ԝ": "vv", "х": "x", "у": "y", "ү": "y", "ӕ": "ae",
    # Armenian
    "ց": "g", "հ": "h", "յ": "j", "ռ": "n", "ո": "n", "օ": "o", "զ": "q", "ս": "u",
    # Hebrew and Arabic
    "ו": "l", "ן": "l", "ס": "o", "ا": "l", "ه": "o", "ە": "o", "٥": "o", "۵": "o",
    # scripts of India and beyond
    "०": "o", "০": "o", "੦": "o", "૦": "o", "ଠ": "o", "୦": "o", "௦": "o", "౦": "o", "೦": "o", "ഠ": "o", "൦": "o", "๐": "o", "໐": "o", "ဝ": "o", "၀": "o", "ყ": "y", "ዐ": "o",
    # Coptic, Cherokee, Deseret, Osage
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "ꭵ": "i", "ꮁ": "r", "ꮃ": "vv", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c", "𐐬": "o", "𐐽": "c", "𐓪": "o", "𐓶": "u",
}


def decomposed(text: str) -> str:
    return unicodedata.normalize("NFD", text)


@lru_cache(maxsize=1)
def derived() -> dict[str, str]:
    """Characters outside ASCII whose compatibility decomposition is letters and digits of ASCII."""
    found = {}
    for code in range(0x80, 0x110000):
        if unicodedata.decomposition(chr(code)).startswith("<"):
            plain = unicodedata.normalize("NFKD", chr(code)).lower()
            if plain.isascii() and plain.isalnum():
                found[chr(code)] = plain
    return found


def parse_line(line: str) -> tuple[str, str] | None:
    """(character, prototype) of a line of the file; None for blank lines and comments. Other lines raise."""
    fields = line.split("#")[0].lstrip("﻿").split(";")
    if len(fields) == 1 and not fields[0].strip():
        return None
    source, target = ("".join(chr(int(x, 16)) for x in field.split()) for field in fields[:2])
    if not source or not target:
        raise ValueError(f"not a pair of code points: {line}")
    return source, target


def closed(pairs: dict[str, str]) -> dict[str, str]:
    """The relation of lower-case single characters with prototypes that have no other prototype. A point never comes from elsewhere: labels stay
    labels. Of a circle the characters stay what they are where it closes."""
    pairs = {decomposed(k.lower()): decomposed(v.lower()) for k, v in pairs.items()}
    pairs = {k: v for k, v in pairs.items() if len(k) == 1 and k != v and "." not in v}
    for start in list(pairs):
        seen, text = {start}, pairs[start]
        while any(c in pairs and c not in seen for c in text):
            more = {c for c in text if c in pairs and c not in seen}
            text = "".join(pairs[c] if c in more else c for c in text)
            seen |= more
        pairs[start] = decomposed(text)
    return pairs


def relation(spark: SparkSession, path: str = "") -> dict[str, str]:
    """Each character's prototype: the stated and derived pairs, and those of the file at ``path``, which come first where they differ.

    There are no more pairs than characters, whatever the file.
    """
    pairs = derived() | LOOK_ALIKES
    if path:
        lines = (r.value for r in spark.read.text(path).collect())  # the characters of Unicode at most
        pairs |= {k: v for k, v in filter(None, map(parse_line, lines)) if k.lower() == k}
    return closed(pairs)


def skeleton(name: str, pairs: dict[str, str]) -> str:
    """The skeleton of one name; of many by ``skeletons``."""
    return decomposed("".join(pairs.get(c, c) for c in decomposed(name.lower())))


def _decomposed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else decomposed(t) for t in texts.to_pylist()], pa.string())


def skeletons(names: DataFrame, pairs: DataFrame, name: str = "name") -> DataFrame:
    """(name, skeleton) of the distinct names, lower-cased, by the relation ``pairs`` (character, prototype); null names are left out."""
    to_nfd = F.arrow_udf(_decomposed, "string")
    rows = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct()
    letters = rows.select("name", F.posexplode(F.split(to_nfd(F.lower("name")), "")).alias("at", "character"))
    met = letters.join(F.broadcast(pairs), "character", "left")  # a row for each character at most
    spelled = met.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("prototype", "character").alias("c")))).alias("cs"))
    return spelled.select("name", to_nfd(F.array_join(F.transform("cs", lambda x: x["c"]), "")).alias("skeleton"))


def skeleton_parts(name: Column, skeleton: Column, suffixes) -> Column:
    """An array of (suffix, its skeleton), the longest first: a skeleton's parent domains are those of the name."""
    return F.arrays_zip(suffixes(name).alias("suffix"), suffixes(skeleton).alias("skeleton"))
