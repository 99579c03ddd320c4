"""License scans with a positional rare-token index (DataFrame functions only).

1. Document frequencies of all licence words over the whole corpus.
2. The index holds, for each template, its highest-IDF words with their places: the rarest
   one of a base phrase (which must stand whole); of a notice the rarest one of its mandatory
   key phrase, beside the three rarest of all its words.
3. A file's rare licence words are looked up; a word at p that stands at q in a template
   proposes the start p - q.  At each proposed start the template's words are intersected
   with the file's by relative position, and the mandatory key phrase must stand whole.

A base phrase that occurs holds its own rarest word, and a notice that matches holds its key
phrase whole, so every place of either is found, whatever the rest of the corpus holds.

Defined results: null text is empty, gives 0 words, no place, score 0; rows with the same
id are separate files; an empty table gives an empty result; columns besides id and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Fixed values: (label, words of the public notice, mandatory key phrase).
NOTICES = (
    ("agpl-notice", "gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                   "public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify"),
    ("lgpl-notice", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                   "documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
ANCHORS = 3                 # index words per notice, besides the rarest of its key phrase
MIN_MATCH = 0.8             # share of a notice's words that stand at their places

# Words end at ASCII signs and controls: everything below 0x80 that is no digit or letter.
_SIGNS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CAPITALS, _SMALL = (bytes(range(c, c + 26)).decode() for c in (0x41, 0x61))


def _words(text_col: str):
    """Words of the text with A-Z folded: one character map, then a split at single spaces, which
    costs a fraction of a regular expression and folds no other letter."""
    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), _SIGNS + _CAPITALS, " " * len(_SIGNS) + _SMALL)
    return F.array_remove(F.split(plain, " "), "")


def _templates():
    """(label, words, offset of the key phrase, key words, is a base phrase)."""
    out = [(label, phrase.split(), 0, phrase.split(), True) for phrase, label in BASE]
    for label, notice, key in NOTICES:
        words, key = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        out.append((label, words, at, key, False))
    return out


def document_frequency(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many files each word stands; at most one row per word of the templates comes back."""
    seen = F.array_distinct(F.filter(_words(text_col), lambda w: w.isin(vocabulary)))
    return dict(map(tuple, docs.select(F.explode(seen).alias("w")).groupBy("w").count().collect()))


def rare_token_index(templates, df: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Rare word -> [(template, place of the word in it)]."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _, key, base) in enumerate(templates):
        rarest = lambda ws, n: sorted(set(ws), key=lambda w: (df.get(w, 0), w))[:n]
        rare = rarest(words, 1 if base else ANCHORS) + rarest(key, 1)
        for q, w in enumerate(words):
            if w in rare:
                index.setdefault(w, []).append((t, q))
    return index


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per file: id, n_words, matches array<struct<label, base, first, score>>."""
    templates = _templates()
    index = rare_token_index(templates, document_frequency(docs, text_col, sorted({w for t in templates for w in t[1]})))
    strings = lambda ws: F.array(*[F.lit(w) for w in ws])
    post = F.create_map(*[x for w, places in index.items() for x in
                          (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in places]))])
    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), strings(words).alias("words"),
                               F.lit(at).alias("at"), strings(key).alias("key")) for label, words, at, key, base in templates])
    words = F.col("words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _words(text_col).alias("words"))
    rows = rows.select("id", "words", F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(index)), i)), lambda i: i.isNotNull()).alias("hits"))
    # start of the template in the file, with the template's number in the low bits
    starts = F.flatten(F.transform("hits", lambda p: F.transform(F.element_at(post, F.get(words, p)), lambda x: (p - x["q"]).cast("long") * 64 + x["t"])))
    rows = rows.select("id", "words", F.array_distinct(starts).alias("starts"))

    def verified(code):
        t = F.get(known, F.pmod(code, F.lit(64)).cast("int"))
        first = F.floor(code / 64).cast("int")
        places = F.sequence(F.lit(0), F.size(t["words"]) - 1)
        same = F.size(F.filter(places, lambda j: (first + j >= 0) & (F.get(words, F.greatest(first + j, F.lit(0))) == F.get(t["words"], j))))
        key = (first + t["at"] >= 0) & (F.slice(words, F.greatest(first + t["at"], F.lit(0)) + 1, F.size(t["key"])) == t["key"])
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), first.alias("first"),
                        F.when(key, same / F.size(t["words"])).otherwise(F.lit(0.0)).alias("score"))
    found = F.filter(F.transform("starts", verified), lambda m: m["score"] >= F.when(m["base"], F.lit(1.0)).otherwise(F.lit(MIN_MATCH)))
    return rows.select("id", F.size("words").cast("long").alias("n_words"), found.alias("matches"))
