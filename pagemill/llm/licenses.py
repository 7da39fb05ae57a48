"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor
directory inheritance by path joins.

Texts are bags of words weighed by term frequency and by inverse document frequency over the templates (a word of
no template weighs as one of a single template). A whole file is compared with full licence texts; one that is
``file_least`` similar to a text or more carries the licence of the most similar one. Of all other files every line, every
sentence and every window of up to ``UNITS`` consecutive ones is compared with one-sentence and header templates, and
the text carries the licence of the largest cosine, if that is ``least`` or more. A text that states a version or a kind
of GNU licence other than the template's doesn't match it. A window of such a cosine must hold one of the template's
heavy words, since the others weigh too little together, and enough of the template's words to reach it; windows that
don't are passed over, which changes no result.

A file is a licence file if it matches a full text, if its name says so (LICENSE, COPYING, …) or if windows that carry a
licence (of those that overlap, the most similar) hold ``share`` of its words or more. A directory has the licence most of its licence files carry (ties: the smallest name); a file
without an own licence inherits that of its nearest ancestor directory that has one. Directories, not
files, are joined with their ancestors, so the joins grow with the directories; they are plain joins, which
adaptive execution splits where one directory holds a third of all files.

Defined results: null and empty texts carry no licence; a null path lies in no directory; ties of the cosine go
to the licence that sorts first, ties of windows to the first; repeated rows are rows of their own; an empty
table gives an empty result; extra columns pass through and lose to the added names.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, prepare

LEAST, SHARE = 0.75, 0.5
FILE_LEAST = 0.9  # long licence texts are up to 0.89 similar to those of other families
UNITS = 8  # lines or sentences of a header
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE_NAME = r"(?i)^(un)?licen[cs]es?([.-].*)?$|^copying([.-].*)?$|^copyright([.-].*)?$"

SENTENCE = re.compile(r"(?<=[.!?])\s+")
# a stated version, after one of these words or as a part of a short name (GPLv2, CC-BY-4.0)
STATED = {"version", "v", "license", "licence", "gpl", "lgpl", "agpl", "mpl", "apache", "by", "by-sa", "by-nc", "cc0"}
NUMBER = re.compile(r"v?(\d{1,2})(?:\.(\d{1,2}))?(?:\.0)?")
SHORT = re.compile(r"(?:gpl|mpl|apache|by|by-sa|by-nc|cc0)-?v?(\d{1,2})(?:\.(\d{1,2}))?")
# words that are frequent in texts of any kind: they are the last to be looked for
COMMON = set("a and any are by conditions following for form forms free in is it may mit not of or person program public purpose released "
             "source terms that the this to under use version with without work you".split())

# full texts in license_texts; AGPL-3.0 is GPL-3.0 under its own name
TEXTS = """Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0
MIT MPL-1.1 MPL-2.0 Unlicense""".split()

GNU = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} License as published by "
       "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")

# fixed values: usual statements of public licences
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", GNU.format(":", "Affero General Public", "3")),
    ("GPL-2.0", GNU.format(";", "General Public", "2")),
    ("GPL-3.0", GNU.format(":", "General Public", "3")),
    ("LGPL-2.0", GNU.format(";", "Library General Public", "2")),
    ("LGPL-2.1", GNU.format(";", "Lesser General Public", "2.1")),
    ("LGPL-3.0", GNU.format(":", "Lesser General Public", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def full_texts() -> list[tuple[str, str]]:
    texts = {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in TEXTS}
    texts["AGPL-3.0"] = re.sub(r"(?i)\b(gnu)(\s+)(general public)", r"\1\2Affero \3", texts["GPL-3.0"])
    return sorted(texts.items())


def versions(words: list[str]) -> set[tuple[str, str]]:
    """Versions that a text states."""
    found = set()
    for before, w in zip(["", *words], words, strict=False):
        m = SHORT.search(w) or (NUMBER.fullmatch(w) if before in STATED or w.startswith("v") else None)
        if m:
            found.add((m[1], m[2] or "0"))
    return found


def agrees(name: str, words: list[str], after: list[str]) -> bool:
    """Whether a text states no other version, and no other kind of GNU licence, than a licence's."""
    gnu = "GPL" in name
    if gnu:
        kind = "LGPL" if {"lesser", "lgpl"} & set(words) or ("library", "general") in zip(words, words[1:], strict=False) else "AGPL" if {"affero", "agpl"} & set(words) else "GPL"
        if not name.startswith(kind):
            return False
    own = re.search(r"-(\d+)\.(\d+)$", name)
    stated = versions(words) or (versions(after) if gnu else set())
    return not own or not stated or own.groups() in stated


class Vectors:
    """Template vectors and their words' weights."""

    def __init__(self, templates: list[tuple[str, str]]):
        bags = [(name, Counter(WORD.findall(text.lower()))) for name, text in sorted(templates)]
        found = Counter(w for _, bag in bags for w in bag)
        self.idf = {w: log((1 + len(bags)) / (1 + n)) + 1 for w, n in found.items()}
        self.other = log((1 + len(bags)) / 2) + 1
        self.vectors = []
        for name, bag in bags:
            vector = {w: n * self.idf[w] for w, n in bag.items()}
            norm = sqrt(sum(x * x for x in vector.values()))
            self.vectors.append((name, {w: x / norm for w, x in vector.items()}))

    def reachable(self, words, least: float) -> list[tuple[str, dict[str, float]]]:
        """The templates to which a text of these words, or a part of it, can be similar."""
        return [(name, t) for name, t in self.vectors if sum(x * x for w, x in t.items() if w in words) >= least * least - 1e-9]

    def similar(self, bag: Counter, vectors, least: float) -> list[tuple[float, str]]:
        """(cosine, licence) of the templates that are similar enough, the most similar first."""
        inside = {w: n * self.idf[w] for w, n in bag.items() if w in self.idf}
        known = sum(x * x for x in inside.values())
        norm = known + sum(n * n for w, n in bag.items() if w not in inside) * self.other**2
        if not known or known < least * least * norm - 1e-9:  # the words of no template weigh too much
            return []
        norm, found, get = sqrt(norm), {}, inside.get
        for name, t in vectors:
            cosine = sum(x * get(w, 0.0) for w, x in t.items()) / norm
            if cosine >= least and cosine > found.get(name, 0) + 1e-12:
                found[name] = cosine
        return sorted(((c, name) for name, c in found.items()), key=lambda f: (-round(f[0], 12), f[1]))


class Matcher:
    """Compares texts with header templates and with full licence texts."""

    def __init__(self, templates: list[tuple[str, str]], least: float, texts: list[tuple[str, str]] = (), file_least: float = FILE_LEAST):
        self.headers, self.files = Vectors(templates), Vectors(texts) if texts else None
        self.least, self.file_least = least, file_least
        heavy: set[str] = set()
        for _, vector in self.headers.vectors:
            rest = 1.0
            for w, x in sorted(vector.items(), key=lambda p: (p[0] in COMMON, -p[1], p[0])):
                if rest < least * least - 1e-9:  # the words left can't reach the cosine
                    break
                heavy.add(w)
                rest -= x * x
        self.heavy = re.compile("|".join(map(re.escape, sorted(heavy, key=len, reverse=True)))) if heavy else re.compile(r"(?!)")

    def scan(self, text: str | None) -> tuple[str | None, float | None, float]:
        """(licence, its cosine, share of the words in windows that carry a licence)."""
        nothing = None, None, 0.0
        if not text:
            return nothing
        low = text.lower()
        bag = Counter(WORD.findall(low))
        if self.files and (found := self.files.similar(bag, self.files.vectors, self.file_least)):
            return found[0][1], found[0][0], 1.0
        if not self.headers.reachable(bag, self.least) or not self.heavy.search(low):
            return nothing
        best, taken, carried = None, set(), 0
        units, windows = self.windows(low)
        for cosine, first, to, name in sorted(windows, key=lambda f: (-round(f[0], 12), f[1], f[2])):
            best = best or (name, cosine)
            if taken.isdisjoint(range(first, to)):
                taken.update(range(first, to))
                carried += sum(len(u.split()) for u in units[first:to])
        return (*best, carried / max(1, sum(map(len, map(str.split, low.split("\n")))))) if best else nothing

    def windows(self, low: str) -> tuple[list[str], list[tuple[float, int, int, str]]]:
        """The lines and sentences of a lower-cased text, and (cosine, first, end, licence) of the windows that carry one."""
        units, lines = [], []
        for line in low.split("\n"):
            first = len(units)
            units += [u for u in SENTENCE.split(line) if WORD.search(u)]
            if len(units) - first > UNITS:
                lines.append((first, len(units)))
        hot = [i for i, u in enumerate(units) if self.heavy.search(u)]
        words: dict[int, list[str]] = {}

        def of(i: int) -> list[str]:
            if i not in words:
                words[i] = WORD.findall(units[i])
            return words[i]

        found = []

        def compare(bag: Counter, vectors, first: int, to: int) -> None:
            similar = self.headers.similar(bag, vectors, self.least)
            if similar:
                inside = [w for i in range(first, to) for w in of(i)]
                after = [w for i in range(to, min(len(units), to + 3)) for w in of(i)]
                for cosine, name in similar:
                    if agrees(name, inside, after):
                        found.append((cosine, first, to, name))
                        break

        for first in sorted({i for h in hot for i in range(max(0, h - UNITS + 1), h + 1)}):
            end = min(len(units), first + UNITS)
            vectors = self.headers.reachable({w for i in range(first, end) for w in of(i)}, self.least)
            bag: Counter = Counter()
            for i in range(first, end if vectors else first):
                bag.update(of(i))
                compare(bag, vectors, first, i + 1)
        for first, to in lines:
            compare(Counter(w for i in range(first, to) for w in of(i)), self.headers.vectors, first, to)
        return units, found


def directory(path):
    """The directory of a path column; the root is an empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def ancestors(folder):
    """A directory itself and all above it, the root last, as rows ``(depth, folder)``."""
    parts = F.split(folder, "/")
    deep = F.when(folder == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), deep), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("folder")))


def scan_licenses(files: DataFrame, *, path: str = "path", text: str = "text", templates=None, least: float = LEAST, share: float = SHARE,
                  texts=None, file_least: float = FILE_LEAST) -> DataFrame:
    """``files`` without texts, with ``license``, ``cosine`` (own licences), ``found`` (``header``, ``file``,
    ``inherited`` or ``none``) and ``folder`` (where an inherited one is from). ``templates`` (headers) and ``texts``
    (whole files) are pairs of a licence and a text; with own templates there are only own texts."""
    prepare(files.sparkSession)
    fields = ("license", "cosine", "found", "folder")
    whole = list(texts) if texts is not None else full_texts() if templates is None else []
    matcher = Matcher(list(templates if templates is not None else TEMPLATES), least, whole, file_least)
    rows = files.select(*[c for c in files.columns if c not in (*fields, text)], F.col(path).alias("__path"), F.col(text).alias("__text"))

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            names, cosines, shares = zip(*(matcher.scan(t.as_py()) for t in batch.column(k)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(names, pa.string()), pa.array(cosines, pa.float64()), pa.array(shares, pa.float64())],
                                             names=[*batch.schema.names[:k], "license", "cosine", "__share"])

    schema = rows.drop("__text").schema.add("license", "string").add("cosine", "double").add("__share", "double")
    name = F.regexp_extract(F.col("__path"), "([^/]*)$", 1)
    is_file = F.col("license").isNotNull() & ((F.col("__share") >= share) | F.coalesce(F.rlike(name, F.lit(FILE_NAME)), F.lit(False)))
    own = cut(rows.mapInArrow(lean(run), schema).withColumn("__file", is_file).withColumn("__folder", directory(F.col("__path"))).drop("__share", "__path"))

    counts = own.where(F.col("__file") & F.col("__folder").isNotNull()).groupBy("__folder", "license").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("__folder").orderBy(F.desc("n"), "license"))
    licensed = counts.withColumn("r", first).where("r = 1").select(F.col("__folder").alias("at"), F.col("license").alias("__from"))
    folders = own.where(F.col("license").isNull() & F.col("__folder").isNotNull()).groupBy("__folder").agg(F.count("*").alias("n"))
    above = folders.select("__folder", F.explode(ancestors(F.col("__folder"))).alias("a")).select("__folder", F.col("a.depth").alias("depth"), F.col("a.folder").alias("at"))
    nearest = above.join(licensed, "at").groupBy("__folder").agg(F.max(F.struct("depth", "at", "__from")).alias("a"))
    nearest = nearest.select(F.col("__folder").alias("__below"), F.col("a.at").alias("__at"), F.col("a.__from").alias("__from"))
    joined = own.join(nearest, F.col("license").isNull() & (F.col("__folder") == F.col("__below")), "left")
    found = F.when(F.col("license").isNotNull(), F.when(F.col("__file"), "file").otherwise("header")).when(F.col("__from").isNotNull(), "inherited").otherwise("none")
    kept = [c for c in own.columns if c not in fields and not c.startswith("__")]
    return joined.select(*kept, F.coalesce("license", "__from").alias("license"), "cosine", found.alias("found"), F.col("__at").alias("folder"))
