"""License scan with a positional index of rare licence words.

A template is a notice with its mandatory key phrases. Its words are known by number; a word's postings say at which
places of which key phrases it stands. Over all documents each licence word's document frequency is counted. In a file
the words are looked up from the rarest on: an occurrence of a phrase's rarest word proposes one start for the phrase,
the postings of its next rarer words keep or drop the start by relative position, and what is left stands word by word.
A template is there where its first key phrase stands and every other one stands in its place by the template, up to
``slack`` words off. How much of the notice surrounds it is its share: words of the template found at their place.

The frequencies order the lookups only. What is gathered from the corpus is bounded by the templates' words; places
stay with their documents.

Defined results: null text counts as empty and has no words; a text shorter than a phrase does not hold it; overlapping
places count each. Rows that repeat a doc_id or have none are rows of their own. Without templates nothing is found.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, cut, use_only
from .spans import Words, crc32_spans, pieces


@dataclass(frozen=True)
class Template:
    """A notice; its key phrases (by default the whole notice) stand in its text in this order."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()

    def words(self) -> list[bytes]:
        return split(self.text)

    def keys(self) -> list[tuple[int, list[bytes]]]:
        """Place and words of each key phrase."""
        words, at, out = self.words(), 0, []
        for phrase in map(split, self.phrases or (self.text,)):
            if not phrase:
                raise ValueError(f"{self.label}: a key phrase without words")
            at = next((i for i in range(at, len(words)) if words[i : i + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"{self.label}: {b' '.join(phrase).decode()} does not stand in the notice in this order")
            out.append((at, phrase))
        return out


def split(text: str) -> list[bytes]:
    return [p.word(i) for p in pieces([text.encode()]) for i in range(len(p.start))[p.fresh()]]


# fixed values: the three base phrases, then notices by which licences are usually named
BASE = (
    Template("cc-by", "cc by"),
    Template("gpl", "general public license"),
    Template("reserved", "all rights reserved"),
)
NOTICES = (
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    Template("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "released into the public domain")),
)


class Index:
    """Numbers of the templates' words, and the words of texts by number."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.vocabulary = sorted({w for t in templates for w in t.words()})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [np.array([number[w] for w in t.words()], np.int32) for t in templates]
        self.keys = [[(at, np.array([number[w] for w in phrase], np.int32)) for at, phrase in t.keys()] for t in templates]
        sizes = np.array([len(w) for w in self.vocabulary], np.int64)
        joined = np.frombuffer(b" ".join(self.vocabulary), np.uint8)
        sums = crc32_spans(joined, np.cumsum(sizes + 1) - sizes - 1, sizes) if len(sizes) else np.empty(0, np.uint32)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]
        #: Lengths with first bytes that some word has.
        self.seen = np.zeros((max(sizes, default=0) + 1, 256), bool)
        for w in self.vocabulary:
            self.seen[len(w), w[0]] = True

    def numbers(self, words: Words) -> np.ndarray:
        """Number of each word, -1 for words of no template; checksums propose, bytes decide."""
        out = np.full(len(words.start), -1, np.int32)
        maybe = np.nonzero(words.length < len(self.seen))[0]
        maybe = maybe[self.seen[words.length[maybe], words.buffer[words.start[maybe]]]]
        if not len(maybe):
            return out
        sums = crc32_spans(words.buffer, words.start[maybe], words.length[maybe])
        at = np.searchsorted(self.sums, sums)
        ok = at < len(self.sums)
        maybe, sums, at = maybe[ok], sums[ok], at[ok]
        last = np.searchsorted(self.sums, sums, "right")
        while len(maybe):  # once, unless two words of the templates have one checksum
            ok = at < last
            maybe, at, last = maybe[ok], at[ok], last[ok]
            number = self.order[at]
            turn = np.argsort(number, kind="stable")
            edges = np.searchsorted(number[turn], np.arange(len(self.vocabulary) + 1))
            for k in np.nonzero(np.diff(edges))[0]:
                here, word = maybe[turn[edges[k] : edges[k + 1]]], np.frombuffer(self.vocabulary[k], np.uint8)
                here = here[words.length[here] == len(word)]
                out[here[(words.buffer[words.start[here][:, None] + np.arange(len(word))] == word).all(1)]] = k
            at = at + 1
        return out

    def sequence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of ``texts``, one after another, and where each text ends."""
        parts, n = [], np.zeros(len(texts), np.int64)
        for words in pieces(texts):
            new = words.fresh()
            parts.append(self.numbers(words)[new])
            n += np.bincount(words.row[new], minlength=len(texts))
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.cumsum(n)


class Lookup:
    """Places of each licence word in a run of texts, and of phrases by relative position."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, frequency: np.ndarray):
        self.ids, self.ends, self.frequency = ids, ends, frequency
        at = np.nonzero(ids >= 0)[0]
        turn = np.argsort(ids[at], kind="stable")
        self.at, self.edges = at[turn], np.searchsorted(ids[at][turn], np.arange(len(frequency) + 1))

    def places(self, phrase: np.ndarray) -> np.ndarray:
        """All starts of the phrase, in order."""
        rarest = sorted(range(len(phrase)), key=lambda j: (self.frequency[phrase[j]], -j))
        first = rarest[0]
        start = self.at[self.edges[phrase[first]] : self.edges[phrase[first] + 1]] - first
        text = np.searchsorted(self.ends, start + first, "right")
        start = start[(start >= self.begin(text)) & (start + len(phrase) <= self.ends[text])]
        for j in rarest[1:]:
            start = start[self.ids[start + j] == phrase[j]]
        return start

    def begin(self, text: np.ndarray) -> np.ndarray:
        return np.where(text > 0, self.ends[text - 1], 0)

    def stands(self, keys: list[tuple[int, np.ndarray]], slack: int) -> np.ndarray:
        """Starts of the first key phrase with all others in their places, up to ``slack`` words off."""
        head, start = keys[0][0], self.places(keys[0][1])
        for at, phrase in keys[1:]:
            if not len(start):
                break
            found = self.places(phrase)
            text = np.searchsorted(self.ends, start, "right")
            low = np.maximum(start + at - head - slack, self.begin(text))
            high = np.minimum(start + at - head + slack + 1, self.ends[text])
            start = start[np.searchsorted(found, low) < np.searchsorted(found, high)]
        return start

    def share(self, words: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Share of a template's words that stand in their place where the template begins at ``start`` + its head."""
        text = np.searchsorted(self.ends, start[1], "right")
        low, high = self.begin(text), self.ends[text]
        n = np.zeros(len(text), np.int64)
        for j, w in enumerate(words):
            at = start[0] + j
            n += (at >= low) & (at < high) & (self.ids[np.clip(at, 0, len(self.ids) - 1)] == w)
        return n / len(words)


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """In how many documents each licence word stands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        n = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches(it):
            texts = as_bytes(batch.column("text"))
            for a, b in cut(batch, texts):
                ids, ends = index.sequence(texts[a:b])
                at = np.nonzero(ids >= 0)[0]
                once = np.unique(np.searchsorted(ends, at, "right") * len(n) + ids[at])
                n += np.bincount(once % len(n), minlength=len(n)) if len(once) else 0
        some = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["word", "n"])

    out = np.zeros(len(index.vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))


def licenses(docs: DataFrame, templates: list[Template] = BASE + NOTICES, slack: int = 8) -> DataFrame:
    """One row per document: doc_id, n_words and found, all places of all templates in order.

    A place has the template's label and number, start (the word where its first key phrase begins), words (of that
    phrase) and share.
    """
    index = Index(list(templates))
    frequency = frequencies(docs, index)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only(None)
        for batch in batches(it):
            texts = as_bytes(batch.column("text"))
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in texts]
            for a, b in cut(batch, texts):
                ids, ends = index.sequence(texts[a:b])
                begin = np.concatenate([[0], ends[:-1]])
                n_words[a:b] = ends - begin
                look = Lookup(ids, ends, frequency)
                for t, (template, words, keys) in enumerate(zip(index.templates, index.words, index.keys)):
                    start = look.stands(keys, slack)
                    text = np.searchsorted(ends, start, "right")
                    share = look.share(words, np.stack([start - keys[0][0], start]))
                    for row, at, s in zip(text.tolist(), (start - begin[text]).tolist(), share.tolist()):
                        found[a + row].append({"label": template.label, "template": t, "start": at, "words": len(keys[0][1]), "share": s})
            for one in found:
                one.sort(key=lambda x: (x["start"], x["template"]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words), pa.array(found, _FOUND)], ["doc_id", "n_words", "found"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_words long, found array<struct<label: string, template: int, start: long, words: long, share: double>>")


def labelled(docs: DataFrame, base: list[Template] = BASE, notices: list[Template] = NOTICES, slack: int = 8) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share, 0 without a place)."""
    rows = licenses(docs, [*base, *notices], slack)
    old = F.filter("found", lambda x: x["template"] < len(base))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    start = F.transform(old, lambda p: p["start"])
    return rows.select(
        "doc_id", "n_words", F.size(old).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        names(old).alias("base_labels"), names(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
