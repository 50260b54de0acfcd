"""License scan: exact containment join of text blocks with license templates.

A block is a line, a window of a long line, or a window of the words of the whole text, as notices are often wrapped over
lines. A template matches a block that holds at least the threshold share of its distinct tokens. Tokens are ordered by how many documents of the whole corpus hold them, rarest first. To reach an overlap
of k, a block must hold one of the first n - k + 1 tokens of a template of n (prefix filter), at least k template tokens
(length filter), and from the first hit on k tokens must be left in both, in that order (positional filter); what is left is
counted exactly.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import map_rows, utf8

# Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Opening sentences of common license notices, with labels.
TEMPLATES = {
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license version 2 1",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights-reserved": "copyright all rights reserved no part of this publication may be reproduced",
}
# Templates and their tokens go to every task; more than this many need a join of tables instead.
MOST_TEMPLATES = 10_000

_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 10 if b == 10 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-case A-Z; runs of digits, a-z and anything beyond ASCII."""
    return text.translate(_WORD).split()


def base_places(tokens: list[bytes], phrases: list[tuple[bytes, str]]) -> tuple[list[int], set[str]]:
    """Word positions at which a phrase begins, over all phrases, and the labels found."""
    joined, places, labels = b" " + b" ".join(tokens) + b" ", [], set()
    for phrase, label in phrases:
        at, word, seen = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            places.append(word)
            labels.add(label)
            at = joined.find(phrase, at + 1)
    return places, labels


def _windows(tokens: list[bytes], window: int, start: int):
    step = window // 2
    for at in range(0, max(1, len(tokens) - step), step):
        yield start + at, tokens[at : at + window]


def placed_blocks(text: bytes, window: int):
    """(position of the first word, tokens) of each block: lines, windows of `window` words, half overlapping, in place of a
    longer line, then such windows over all words of a text of several lines."""
    every, lines = [], 0
    for line in text.translate(_WORD).split(b"\n"):
        if tokens := line.split():
            yield from _windows(tokens, window, len(every)) if len(tokens) > window else [(len(every), tokens)]
            every += tokens
            lines += 1
    if lines > 1:
        yield from _windows(every, window, 0)


def blocks(text: bytes, window: int):
    """Token lists of the blocks."""
    return (tokens for _, tokens in placed_blocks(text, window))


def places(tokens: list[bytes], held: set[bytes], start: int) -> list[tuple[int, int]]:
    """The least ranges of words (first, end) that hold all of `held`."""
    last: dict[bytes, int] = {}
    out: list[tuple[int, int]] = []
    for i, token in enumerate(tokens):
        if token in held:
            last[token] = i
            if len(last) == len(held) and (not out or min(last.values()) + start > out[-1][0]):
                out.append((min(last.values()) + start, i + 1 + start))
    return out


class Places:
    """Where the templates of one text match, by template and matched tokens, with the containment reached there."""

    def __init__(self):
        self.found: dict[tuple[int, frozenset], tuple[float, set[tuple[int, int]]]] = {}

    def add(self, t: int, share: float, held: frozenset, where: list[tuple[int, int]]) -> None:
        self.found.setdefault((t, held), (share, set()))[1].update(where)

    def labelled(self, sets: list[list[bytes]]) -> set[int]:
        """The templates but those whose every match has its tokens inside a better match of another template: all of them
        among its tokens, and at least half of the range of words in such ranges."""
        rank = {key: (share, len(sets[key[0]]), key[0]) for key, (share, _) in self.found.items()}
        kept: set[int] = set()
        for (t, held), (_, where) in self.found.items():
            if t in kept:
                continue
            better = [key for key in self.found if key[0] != t and held <= key[1] and rank[key] > rank[t, held]]
            over = {i for key in better for a, b in self.found[key][1] for i in range(a, b)}
            if any(2 * sum(i in over for i in range(a, b)) < b - a for a, b in where):
                kept.add(t)
        return kept


class Index:
    """Templates as tokens in global order, and an inverted index over their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float):
        self.order = lambda x: (counts.get(x, 0), x)
        self.sets, self.labels, self.need, self.prefix = [], [], [], {}
        for label, text in sorted(templates.items()):
            tokens = sorted(set(words(text.encode())), key=self.order)
            if not tokens:
                continue
            need, t = max(1, ceil(threshold * len(tokens) - 1e-9)), len(self.sets)
            self.sets.append(tokens)
            self.labels.append(label)
            self.need.append(need)
            for position, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((t, position))
        self.known = set(self.prefix)
        self.rank = {x: k for k, x in enumerate(sorted({x for tokens in self.sets for x in tokens}, key=self.order))}

    def candidates(self, held: list[bytes]) -> tuple[dict[int, int], int]:
        """Templates that a block with the template tokens `held` (in global order) may match, each with the position of its first
        token that the block has; and how many the length and positional filters have ruled out.

        That first hit is the first common token of both lists, so they share no more than what is left in the shorter one.
        """
        first: dict[int, tuple[int, int]] = {}
        for j, token in enumerate(held):
            for t, position in self.prefix.get(token, ()):
                first.setdefault(t, (position, j))
        left = {t: position for t, (position, j) in first.items() if min(len(self.sets[t]) - position, len(held) - j) >= self.need[t]}
        return left, len(first) - len(left)

    def matches(self, tokens: list[bytes]) -> dict[int, float]:
        """Containment of each template that the block reaches the threshold of."""
        if self.known.isdisjoint(tokens):
            return {}
        block, found = set(tokens), {}
        left, _ = self.candidates(sorted(block.intersection(self.rank), key=self.rank.get))
        for t, position in left.items():
            overlap = sum(x in block for x in self.sets[t][position:])
            if overlap >= self.need[t]:
                found[t] = overlap / len(self.sets[t])
        return found


def token_counts(docs: DataFrame, templates: dict[str, str], text_col: str) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template token; as many rows as the templates have tokens."""
    vocabulary = {w for t in templates.values() for w in words(t.encode())}

    def count(columns):
        seen: dict[bytes, int] = {}
        for text in columns[0]:
            for w in vocabulary.intersection(words(text)):
                seen[w] = seen.get(w, 0) + 1
        return [list(seen), list(seen.values())]

    parts = map_rows(docs.select(utf8(text_col).alias("text")), count, "token binary, n long")
    return {bytes(r["token"]): r["n"] for r in parts.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    `matches` holds (label, containment, block) of each template that a block reaches, with its best block's number.
    Labels are those of base phrases and of every template in `matches`, save one whose matched tokens all lie inside those of
    another template that matches better (larger containment, then longer): "gnu general public" is not also labelled as the
    Affero notice that it nearly contains. The score is the best containment, 1
    where a base phrase stands. Null and empty texts give zero counts, empty labels and score 0. Other columns are ignored.
    """
    templates, base = templates or TEMPLATES, BASE if base is None else base
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} are sent to tasks")
    index = Index(templates, token_counts(docs, templates, text_col), threshold)
    window = max(32, 2 * max((len(words(t.encode())) for t in templates.values()), default=16))
    phrases = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in base.items()]

    def scan(columns):
        out = [[] for _ in range(9)]
        for key, text in zip(*columns):
            tokens = words(text)
            at, found = base_places(tokens, phrases)
            best: dict[int, tuple[float, int]] = {}
            every, where = set(found), Places()
            if not index.known.isdisjoint(tokens):
                for k, (start, block) in enumerate(placed_blocks(text, window)):
                    for t, share in index.matches(block).items():
                        if share > best.get(t, (0.0, 0))[0]:
                            best[t] = (share, k)
                        held = frozenset(index.sets[t]).intersection(block)
                        where.add(t, share, held, places(block, held, start))
                every.update(index.labels[t] for t in where.labelled(index.sets))
            matches = [{"label": index.labels[t], "containment": s, "block": k} for t, (s, k) in sorted(best.items())]
            score = 1.0 if at else max((s for s, _ in best.values()), default=0.0)
            row = (key, len(tokens), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)), ",".join(sorted(every)), score, matches)
            for column, value in zip(out, row):
                column.append(value)
        return out

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,containment:double,block:int>>"
    return map_rows(docs.select(id_col, utf8(text_col).alias("_text")), scan, schema)
