"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, between, chunked, mix, prefix, texts_of, utf8
from .decontaminate import TABLE

SHINGLE, CONTAINMENT = 5, 0.8
#: MinHash values of a window, each a band of its own: a window of Jaccard similarity s shares a
#: band with the template with probability 1 - (1 - s)**BANDS.
BANDS = 128

# License notices in their usual words.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "apache-2.0-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted"
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "mit-line": "Released under the MIT License",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def template_words(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    """Shingles of k words; of fewer words, all of them as one."""
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def window_of(n_words: int) -> tuple[int, int]:
    """(width, step) in words of the windows for a template: every stretch of its length lies in one."""
    step = max(2, n_words // 4)
    return n_words + step, step


class Index:
    """Templates by window size, with the band table of each."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        rng = np.random.default_rng(7)
        self.a = rng.integers(1, 1 << 62, BANDS, dtype=np.int64).view(U64) * U64(2) + U64(1)
        self.groups: dict[tuple[int, int], list[tuple[str, set[bytes]]]] = {}
        every: set[bytes] = set()
        for name, text in sorted(templates.items()):
            words = template_words(text)
            if len(words) < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            grams = set(shingles(words))
            every |= grams
            self.groups.setdefault(window_of(len(words)), []).append((name, grams))
        self.known = np.sort(self.gram_hash(sorted(every)))
        self.bands = {
            size: self._table([self.gram_hash(sorted(g)) for _, g in group]) for size, group in self.groups.items()
        }

    @staticmethod
    def gram_hash(grams: list[bytes]) -> np.ndarray:
        w = Words(grams)
        return between(prefix(w.hashes(), 1), w.first[:-1], w.first[1:], 1)

    def signature(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """MinHash of the groups of hashes that begin at ``first``."""
        return np.stack([np.minimum.reduceat(mix(h * a), first) for a in self.a], axis=1)

    def _table(self, sets: list[np.ndarray]) -> list[dict[int, list[int]]]:
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        sig = self.signature(np.concatenate(sets), first)
        tables: list[dict[int, list[int]]] = [{} for _ in range(BANDS)]
        for t, row in enumerate(sig.tolist()):
            for table, value in zip(tables, row, strict=True):
                table.setdefault(value, []).append(t)
        return tables

    def search(self, w: Words) -> Iterator[tuple[int, str, int, int, float]]:
        """(document, template, first word, end word, containment) for windows that hold a template."""
        if len(w) < SHINGLE:
            return
        at = np.arange(len(w) - SHINGLE + 1)
        h = between(prefix(w.hashes(), 1), at, at + SHINGLE, 1)
        inside = w.doc[at] == w.doc[at + SHINGLE - 1]
        slot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        # a window without any shingle of any template has similarity 0 to all and shares no band
        seen = np.flatnonzero(inside & (self.known[slot] == h))
        if not len(seen):
            return
        doc = w.doc[seen]
        pos = seen - w.first[doc]
        for (width, step), group in self.groups.items():
            wanted = set()
            span = width - SHINGLE
            for d, p in zip(doc.tolist(), pos.tolist(), strict=True):
                for k in range(max(0, -(-(p - span) // step)), p // step + 1):
                    wanted.add((d, k * step))
            windows = sorted(wanted)
            for i in range(0, len(windows), 512):
                yield from self._verify(w, h, windows[i : i + 512], width, group, self.bands[width, step])

    def _verify(self, w: Words, h: np.ndarray, windows, width: int, group, tables):
        lo = np.array([w.first[d] + s for d, s in windows])
        hi = np.minimum(lo + width, np.array([w.first[d + 1] for d, _ in windows])) - SHINGLE + 1
        n = hi - lo
        first = np.cumsum(n) - n
        idx = np.repeat(lo - first, n) + np.arange(n.sum())
        sig = self.signature(h[idx], first)
        for (d, s), row, a, b in zip(windows, sig.tolist(), lo.tolist(), hi.tolist(), strict=True):
            found = {t for table, value in zip(tables, row, strict=True) for t in table.get(value, ())}
            if not found:
                continue
            here = [w.buf[w.start[i] : w.end[i + SHINGLE - 1]] for i in range(a, b)]
            for t in sorted(found):
                name, grams = group[t]
                hit = [i for i, g in enumerate(here) if g in grams]
                share = len({here[i] for i in hit}) / len(grams)
                if share >= self.containment:
                    yield d, name, s + hit[0], s + hit[-1] + SHINGLE, share


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the document's columns, or those of ``keep``) and ``_found``: license, start and end word, share.

    A template is found where a window holds at least 0.8 of its five-word shingles; windows that
    find the same stretch give it once, with the largest share. Null and empty texts hold none.
    Words are lower-cased runs of letters and digits.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                best: list[dict] = [{} for _ in range(part.num_rows)]
                for d, name, s, e, share in index.value.search(Words(utf8(part.column("_text")), TABLE)):
                    best[d][name, s, e] = max(share, best[d].get((name, s, e), 0.0))
                found = [[{"license": n, "start": s, "end": e, "share": x} for (n, s, e), x in sorted(b.items())] for b in best]
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, kind)], names=["_row", "_found"])

    rows = texts_of(docs, text_col, keep=keep)
    kind = "array<struct<license:string,start:bigint,end:bigint,share:double>>"
    return rows.mapInArrow(run, rows.select("_row", F.array().cast(kind).alias("_found")).schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, how many licenses a document names, and which (sorted, comma-joined)."""
    names = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["license"])))
    return scan(docs, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
    )
