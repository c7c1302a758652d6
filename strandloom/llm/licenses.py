"""License scan: fixed phrases, and templates found through a positional index of rare words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import scan

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # after bytes.lower(): [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on UTF-8

# Phrases of the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, words of a customary notice, and the key phrases it must hold.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction including without limitation")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache 2 0 license", ("apache 2 0 license",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3")),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0", ("waived all copyright",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
)


class Index:
    """Postings of the words of all templates, word -> (template, positions), and their IDF among the templates."""

    def __init__(self, templates=TEMPLATES):
        self.words = [t.encode().split() for _, t, _ in templates]
        self.labels = [label for label, _, _ in templates]
        self.keys = [[p.encode().split() for p in keys] for _, _, keys in templates]
        self.posting: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            at = defaultdict(list)
            for k, w in enumerate(words):
                at[w].append(k)
            for w, ks in at.items():
                self.posting[w].append((t, ks))
        self.idf = {w: math.log(len(templates) / len(found)) for w, found in self.posting.items()}
        #: A text without any of these can hold no key phrase.
        self.hints = sorted({max(keys[0], key=len) for keys in self.keys})

    def candidates(self, words: list[bytes], take: int, reach: list[int]) -> Iterator[tuple[int, int, int]]:
        """(template, least, greatest start) where at least half of the looked-up words agree on a start.

        The licence words of the file are looked up from the highest IDF down, until each
        template has met ``take`` of them; a posting votes for the start it implies, and votes
        within ``reach`` of each other agree.
        """
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in self.posting:
                places[w].append(p)
        met = [0] * len(self.words)
        votes: list[list[tuple[int, int]]] = [[] for _ in self.words]
        for n, w in enumerate(sorted(places, key=lambda w: (-self.idf[w], w))):
            for t, ks in self.posting[w]:
                if met[t] < take:
                    met[t] += 1
                    votes[t] += [(p - k, n) for p in places[w] for k in ks]
        for t, found in enumerate(votes):
            need = min(take, len(set(self.words[t]))) / 2
            if met[t] < need:
                continue
            found.sort()
            held, lo, last = Counter(), 0, None
            for hi, (start, n) in enumerate(found):
                held[n] += 1
                while start - found[lo][0] > reach[t]:
                    held[found[lo][1]] -= 1
                    if not held[found[lo][1]]:
                        del held[found[lo][1]]
                    lo += 1
                if len(held) >= need:
                    if last is not None and found[lo][0] <= last[1]:
                        last = last[0], start
                    else:
                        if last is not None:
                            yield t, *last
                        last = found[lo][0], start
            if last is not None:
                yield t, *last

    def find(self, words: list[bytes], min_score: float, slack: int, take: int) -> dict[str, float]:
        """Labels whose template stands somewhere in the words, with the best share of its words met in order."""
        reach = [max(slack, math.ceil((1 - min_score) * len(own))) for own in self.words]
        found: dict[str, float] = {}
        for t, lo, hi in self.candidates(words, take, reach):
            own, label = self.words[t], self.labels[t]
            if found.get(label, 0) >= 1:
                continue
            # Many agreeing starts in a row are tried piece by piece, so that no window outgrows the template.
            for start in range(lo, hi + 1, reach[t] + 1):
                near = words[max(0, start - reach[t]) : max(0, min(start + reach[t], hi) + len(own) + reach[t])]
                if in_order(near, self.keys[t]):
                    score = common_in_order(own, near) / len(own)
                    if score >= min_score:
                        found[label] = max(found.get(label, 0.0), score)
        return found


def in_order(words: list[bytes], phrases: list[list[bytes]]) -> bool:
    """Whether all phrases stand whole, each after the one before."""
    at = 0
    for phrase in phrases:
        k = len(phrase)
        at = next((i + k for i in range(at, len(words) - k + 1) if words[i] == phrase[0] and words[i : i + k] == phrase), -1)
        if at < 0:
            return False
    return True


def common_in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    where: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def scan_licenses(docs: DataFrame, min_score: float = 0.8, slack: int = 3, take: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the licences that its whole text names.

    Base labels come from fixed phrases.  The method looks up the licence words of a text from
    the highest IDF down, ``take`` for each template, intersects the postings by relative
    position, and keeps a template where its mandatory key phrases stand in order and at least
    ``min_score`` of its words are met in order (longest common subsequence), with as many words
    put in between as may be missing, or ``slack``.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    ``score`` is the best share of a template, 1 with a base label, else 0.  A null or empty
    text has no words, null places and empty labels.  Repeated rows give repeated rows, an
    empty table none; other columns are ignored.
    """
    index = Index()
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def judge(text: str) -> tuple:
        low = text.encode("utf-8", "surrogatepass").lower()
        words = WORDS.findall(low)
        starts, base, found = [], set(), {}
        if any(h in low for h in index.hints) or b"license" in low or b"cc" in low:
            for phrase, label in phrases:
                k = len(phrase)
                if at := [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + k] == phrase]:
                    starts += at
                    base.add(label)
            found = index.find(words, min_score, slack, take)
        score = 1.0 if base else max(found.values(), default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(judge(t or "") for t in batch.column(1).to_pylist()))) or [()] * 7
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema).withColumnRenamed("_id", id_col)
