"""License scans by a positional index of rare licence words, in DataFrame functions only.

One pass counts, over all files, in how many each word of the licence templates occurs. The second pass takes each file's own
licence words in the order of their IDF; for every template the ``LOOKUPS`` rarest of its words that the file holds are looked up: each place
of one votes for the start of the template (its place minus the word's place in the template), and at every such start the
postings are intersected by relative position: the IDF of the lookup words that stand where the template has them, as a share of the
IDF of the template's own ``LOOKUPS`` rarest words. A start counts if the share reaches ``LEAST_SHARE`` and the template's mandatory key
phrase stands there word by word. Base phrases are templates whose key is the whole phrase and whose rarest word is always looked up,
so they are found exactly, every place of them.

Scale: a scan without any shuffle besides the count of at most a few hundred words; the index is a literal of that
size. Files without a lookup word cost one array overlap test.

Edge cases: null texts count as empty; empty texts have zero words and no labels; repeated rows get equal rows;
long texts are handled in place, linear in their words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKUPS = 8
LEAST_SHARE = 0.6
#: ASCII characters that separate words.
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = (("the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: The base phrases of the query op4_license_scan.
CONTRACT = (("under the mit license", "mit"), *BASE[1:])
#: Label, words of the licence's notice, mandatory key phrase (part of the notice).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "the mit license", "the mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license version 3", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)


@dataclass
class Template:
    label: str
    words: list[str]
    key_at: int
    key: list[str]
    base: bool
    lookups: list[tuple[str, int, float]]  # distinct words, rarest first, with place and IDF
    mass: float  # IDF of the rarest LOOKUPS of them


def words_column(text: str | Column = "text") -> Column:
    """Words of a text: A-Z lower-cased, split at ASCII characters other than letters and digits.

    lower() changes other letters too; only two of them become ASCII ones, so these are put out of its way, and no
    licence word has another."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.replace(F.replace(c, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    bare = F.btrim(F.lower(c), F.lit(SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPLIT))


def vocabulary() -> list[str]:
    return sorted({w for t, _ in BASE for w in t.split()} | {w for _, t, _ in TEMPLATES for w in t.split()})


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many files each licence word occurs, and the number of files."""
    vocab = vocabulary()
    found = docs.select(words_column().alias("w")).select(F.array_distinct(F.filter("w", lambda x: x.isin(vocab))).alias("w"))
    rows = found.select(F.explode(F.concat(F.col("w"), F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.w: r.n for r in rows}
    return counts, counts.pop("", 0)


def idfs(counts: dict[str, int], files: int) -> dict[str, float]:
    return {w: math.log((files + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary()}


def index(counts: dict[str, int], files: int, phrases: tuple[tuple[str, str], ...] = BASE) -> list[Template]:
    """Templates with their lookup words by IDF; phrases: base phrases and their labels, of words that BASE and TEMPLATES hold."""
    idf = idfs(counts, files)
    out = []
    for label, text, key, base in [(b, t, t, True) for t, b in phrases] + [(b, t, k, False) for b, t, k in TEMPLATES]:
        words, phrase = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        places = sorted({w: i for i, w in reversed(list(enumerate(words)))}.items(), key=lambda p: (-idf[p[0]], p[1]))[: 1 if base else None]
        out.append(Template(label, words, at, phrase, base, [(w, i, idf[w]) for w, i in places], sum(idf[w] for w, _ in places[:LOOKUPS])))
    return out


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every file; matches lists
    (label, base, start, share) of each verified start; phrases as for index()."""
    counts, files = document_frequencies(docs)
    templates, idf = index(counts, files, phrases), idfs(counts, files)
    kind = "array<struct<label:string,base:boolean,start:int,share:double>>"
    rare = sorted({w for t in templates for w, _, _ in t.lookups} | {w for t in templates for w in t.key}, key=lambda w: (-idf[w], w))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_column().alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(rare))
    none = F.array().cast("array<struct<i:int,w:string>>")
    # the file's licence words, rarest first
    src = src.withColumn("own", F.array_intersect(F.array(*map(F.lit, rare)), F.col("words")))
    # a template can stand only where the rarest word of its key does
    sure = {id(t): max(t.key, key=lambda w: (idf[w], w)) for t in templates}
    src = src.withColumn("places", F.when(F.arrays_overlap("own", F.array(*map(F.lit, sorted(set(sure.values()))))), places).otherwise(none))

    def starts(t: Template) -> Column:
        """Verified starts of one template: [(label, base, start, share)]."""
        known = F.create_map(*(F.lit(x) for w, i, _ in t.lookups for x in (w, i)))
        value = F.create_map(*(F.lit(x) for w, _, idf in t.lookups for x in (w, idf)))
        looked = F.slice(F.filter("own", lambda w: w.isin([w for w, _, _ in t.lookups])), 1, LOOKUPS)

        def stands(s: Column, i: Column | int, w: Column | str) -> Column:
            return F.coalesce(F.get("words", s + i) == w, F.lit(False))

        def whole(s: Column) -> Column:
            ok = s + t.key_at >= 0
            for i, w in enumerate(t.key):
                ok = ok & stands(s, t.key_at + i, w)
            return ok

        def share(s: Column) -> Column:
            total = F.aggregate(looked, F.lit(0.0), lambda sum, w: sum + F.when(stands(s, known[w], w), value[w]).otherwise(0.0))
            return F.least(total / t.mass, F.lit(1.0))

        seen = F.filter("places", lambda x: F.array_contains(looked, x["w"]))
        voted = F.filter(F.array_distinct(F.transform(seen, lambda x: x["i"] - known[x["w"]])), whole)
        found = F.transform(voted, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"), share(s).alias("share")))
        return F.when(F.array_contains("own", sure[id(t)]), found).otherwise(F.array().cast(kind))

    found = F.filter(F.concat(*map(starts, templates)), lambda x: x["base"] | (x["share"] >= LEAST_SHARE))
    src = src.withColumn("matches", F.when(F.size("places") > 0, found).otherwise(F.array().cast(kind)))
    base = F.filter("matches", lambda x: x["base"])
    src = src.select("doc_id", F.size("words").cast("long").alias("n_words"), "matches", base.alias("based"))
    at = F.transform("based", lambda x: x["start"].cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    score = F.when(F.size("based") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)))
    return src.select("doc_id", "n_words", F.size("based").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names("based").alias("base_labels"), names("matches").alias("labels"), score.alias("score"), "matches")


def base_phrases(docs: DataFrame) -> DataFrame:
    """The columns of scan() that the base phrases alone decide."""
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _base_sql() -> str:
    hits = []
    for phrase, label in BASE:
        stands = " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        hits.append(f"list_transform(list_filter(range(len(words)), lambda i: {stands}), lambda i: {{'at': i, 'label': '{label}'}})")
    return f"""
with split as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_SPLIT}'), lambda w: w <> '') as words from documents),
found as (select doc_id, len(words) as n_words, list_concat(list_concat({hits[0]}, {hits[1]}), {hits[2]}) as hits from split)
select doc_id, n_words, len(hits) as n_base, list_min(list_transform(hits, lambda h: h.at)) as first_word, list_max(list_transform(hits, lambda h: h.at)) as last_word,
    array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ',') as base_labels
from found"""


#: DuckDB SQL for base_phrases.
BASE_SQL = _base_sql()
