"""License notices by templates with optional and replaceable regions, run as token automata over words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .words import words

#: Phrases whose every place counts, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Templates: plain words are mandatory, [[...]] is optional (and may hold either other mark), {{a-b}} stands for a to b
#: words of any kind. A template begins with two mandatory words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "[[the software]] to deal in the software without restriction [[including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software]]"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license]]"),
    ("cc-by-nc", "licensed under [[the]] [[a]] [[creative commons {{0-4}}]] cc by nc [[4 0]] [[3 0]] [[license]]"),
    ("cc-by", "licensed under [[the]] [[a]] [[creative commons {{0-4}}]] cc by 4 0 [[license]]"),
    ("gpl-3", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or any later version]]"),
    ("gpl-2", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or any later version]]"),
    ("lgpl-3", "licensed under the [[terms of the]] gnu lesser general public license version 3 [[or any later version]]"),
    ("agpl-3", "licensed under the [[terms of the]] gnu affero general public license version 3 [[or any later version]]"),
    ("gpl-3", "modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 3 [[of the license]] "
              "[[or at your option any later version]]"),
    ("gpl-2", "modify it under the terms of the gnu general public license as published by the free software foundation [[either]] version 2 [[of the license]] "
              "[[or at your option any later version]]"),
    ("lgpl-3", "modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version 3 [[of the license]] "
               "[[or at your option any later version]]"),
    ("lgpl-2-1", "modify it under the terms of the gnu lesser general public license as published by the free software foundation [[either]] version 2 1 [[of the license]] "
                 "[[or at your option any later version]]"),
    ("agpl-3", "modify it under the terms of the gnu affero general public license as published by the free software foundation [[either]] version 3 [[of the license]] "
               "[[or at your option any later version]]"),
    ("cc-by", "licensed under [[the]] [[a]] creative commons attribution 4 0 international [[public]] license"),
    ("cc-by-sa", "licensed under [[the]] [[a]] creative commons attribution sharealike 4 0 international [[public]] license"),
    ("cc-by-nc", "licensed under [[the]] [[a]] creative commons attribution noncommercial 4 0 international [[public]] license"),
    ("cc0", "creative commons cc0 1 0 universal [[public domain dedication]]"),
    # Whole texts, down to the disclaimer.
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] "
                 "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
                 "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
                 "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
                 "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
                 "fitness for a particular purpose and noninfringement in no event shall {{1-12}} be liable for any claim damages or other liability whether in an "
                 "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
                   "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                   "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                   "documentation and or other materials provided with the distribution this software is provided by {{1-12}} as is and any express or implied warranties "
                   "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
                   "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
                   "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
                   "documentation and or other materials provided with the distribution [[3]] neither the name of {{1-12}} nor the names of its contributors may be used to "
                   "endorse or promote products derived from this software without specific prior written permission this software is provided by {{1-12}} as is "
                   "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will [[the authors]] {{0-12}} be held liable for any damages "
             "arising from the use of this software"),
)


class Automaton:
    """A template as states 0..n: state k waits for word k (None: any word); ``skips`` are its moves without a word."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.words: list[bytes | None] = []
        self.skips: dict[int, set[int]] = {}
        self.mandatory = [0]
        opened: list[int] = []
        for token in markup.replace("[[", " [[ ").replace("]]", " ]] ").replace("{{", " {{").replace("}}", "}} ").split():
            if token == "[[":
                opened.append(len(self.words))
            elif token == "]]":
                self.skips.setdefault(opened.pop(), set()).add(len(self.words))
            elif token.startswith("{{"):
                low, high = map(int, token[2:-2].split("-"))
                start = len(self.words)
                for k in range(high):
                    if k >= low:
                        self.skips.setdefault(start + k, set()).add(start + high)
                    self._word(None, False)
            else:
                self._word(token.encode(), not opened)
        self.end = len(self.words)
        self.anchor = b"%b %b" % (self.words[0], self.words[1])

    def _word(self, word: bytes | None, mandatory: bool) -> None:
        self.words.append(word)
        self.mandatory.append(self.mandatory[-1] + mandatory)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for k in self.skips.get(todo.pop(), ()):
                if k not in states:
                    states.add(k)
                    todo.append(k)
        return states

    def run(self, text: list[bytes]) -> tuple[int | None, float]:
        """Words of the longest accepted prefix of ``text`` (None: not accepted), and the largest share of the mandatory
        words that came in order."""
        states, accepted, best = self._closed({0}), None, 0
        for n, word in enumerate([*text, None]):
            best = max(best, *(self.mandatory[k] for k in states))
            if self.end in states:
                accepted = n
            if word is None:
                break
            states = self._closed({k + 1 for k in states if k < self.end and self.words[k] in (None, word)})
            if not states:
                break
        return accepted, best / self.mandatory[-1]


AUTOMATA = tuple(Automaton(label, markup) for label, markup in TEMPLATES)
ANCHORS: dict[bytes, list[Automaton]] = {}
for _a in AUTOMATA:
    ANCHORS.setdefault(_a.anchor, []).append(_a)
BASE = tuple((b" %b " % p.encode(), label) for p, label in PHRASES)


def places(joined: bytes, phrase: bytes):
    """Word numbers at which a phrase (with a space at both ends) stands in the words joined, with a space at both ends."""
    at, word, seen = joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        yield word
        at = joined.find(phrase, at + 1)


def scan(text: bytes) -> dict:
    """What a text has: words, base places, labels, accepted templates with their words, score."""
    w = words(text)
    joined = b" %b " % b" ".join(w)
    n_base, first, last, base, matches, score = 0, None, None, set(), [], 0.0
    for phrase, label in BASE:
        for k in places(joined, phrase):
            n_base += 1
            first = k if first is None else min(first, k)
            last = k if last is None else max(last, k)
            base.add(label)
            score = max(score, 0.5)
    for anchor, automata in ANCHORS.items():
        for k in places(joined, b" %b " % anchor):
            for a in automata:
                accepted, share = a.run(w[k:k + a.end])
                score = max(score, share)
                if accepted is not None:
                    matches.append({"label": a.label, "start": k, "end": k + accepted})
    return {"n_words": len(w), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": sorted(base),
            "labels": sorted(base | {m["label"] for m in matches}), "matches": sorted(matches, key=lambda m: (m["start"], m["label"])), "score": score}


SCHEMA = ("struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: array<string>, labels: array<string>, "
          "matches: array<struct<label: string, start: bigint, end: bigint>>, score: double>")
ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                   ("labels", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("score", pa.float64())])


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``license``: words, places of the base phrases, labels, accepted templates
    (label, first word, word after the last), score.

    A template is accepted where its mandatory words stand in order with nothing between them but its own regions. The
    score is the largest share of a template's mandatory words found from one of its beginnings on, 0.5 at least with a
    base place, 1 with an accepted template, else 0. Null and empty texts have no words, no labels and score 0; repeated
    rows stay; an empty table gives an empty result. A column named license is replaced. Rows are not shuffled.
    """
    own = [c for c in docs.columns if c != "license"]
    schema = docs.select(F.struct(*own).alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        for batch in rows_of(batches):
            found = [scan(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array(found, ARROW)], ["row", "license"])

    return (docs.select(F.struct(*own).alias("row"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(run, f"row {schema}, license {SCHEMA}").select("row.*", "license"))
