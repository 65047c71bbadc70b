"""BPE encoding by a priority queue of merge ranks over linked symbols, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, texts_of, tidy

# Letters and numbers to the regex module that Unicode 16, the vocabulary pattern's version, doesn't have.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NOT_YET = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in LATER.split()) + "]")
# Lower-case forms that Unicode 16 and 17 added.
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
HAS_NEW_LOWER = re.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")
#: Pieces between white space, and their words, whose encodings a worker remembers in each generation.
REMEMBERED = 200_000
#: Documents decoded at once.
DECODE_ROWS = 128
# What counts as white space to the vocabulary's normaliser.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
# Characters that str.split() takes as white space though the normaliser doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def load(path: str) -> dict:
    """What encoding needs of a tokenizer file with a word-end BPE model."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    if model["type"] != "BPE" or whole["decoder"] is not None or model["end_of_word_suffix"] is None:
        raise ValueError(f"{path}: not a BPE vocabulary with word ends and no decoder")
    pattern = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]],
        "suffix": model["end_of_word_suffix"],
        "pattern": pattern,
        "special": {t["content"]: t["id"] for t in whole["added_tokens"]},
    }


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec(dict):
    """Encodes and decodes; as a mapping, from a white-space-free piece to its ids."""

    def __init__(self, spec: dict):
        super().__init__()
        self.vocab: dict[str, int] = spec["vocab"]
        self.suffix: str = spec["suffix"]
        self.special: dict[str, int] = spec["special"]
        self.shift = max(self.vocab.values()).bit_length()
        #: rank of a pair of ids packed in one int, and the id that the pair of a rank becomes
        self.rank = {self.vocab[a] << self.shift | self.vocab[b]: r for r, (a, b) in enumerate(spec["merges"])}
        self.made = [self.vocab[a + b] for a, b in spec["merges"]]
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.older: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(spec["pattern"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = dict((i, t) for t, i in chain(self.vocab.items(), self.special.items()))

    def merge(self, word: str) -> list[int]:
        """Token ids of one word of the split pattern.

        Symbols are a doubly linked list; a queue holds rank and place of the pairs that can merge.
        An entry whose pair has changed since is stale and skipped.
        """
        raw = word.encode()
        n = len(raw)
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        if n == 1:
            return sym
        rank, made, shift = self.rank.get, self.made, self.shift
        place = 14 if n < 1 << 14 else n.bit_length()  # bits of a queue entry that hold the place
        queue = [r << place | i for i in range(n - 1) if (r := rank(sym[i] << shift | sym[i + 1])) is not None]
        if not queue:
            return sym
        heapify(queue)
        left, right, at = list(range(-1, n - 1)), list(range(1, n + 1)), (1 << place) - 1
        while queue:
            entry = heappop(queue)
            i = entry & at
            r = entry >> place
            j = right[i]
            if j >= n or sym[i] < 0 or rank(sym[i] << shift | sym[j]) != r:
                continue
            a = sym[i] = made[r]
            sym[j] = -1
            j = right[i] = right[j]
            if j < n:
                left[j] = i
                if (r := rank(a << shift | sym[j])) is not None:
                    heappush(queue, r << place | i)
            j = left[i]
            if j >= 0 and (r := rank(sym[j] << shift | a)) is not None:
                heappush(queue, r << place | j)
        return [s for s in sym if s >= 0]

    def forget(self) -> None:
        self.older = {}
        self.clear()

    def split(self, piece: str) -> list[str]:
        """The words that the pattern finds in a piece; for the two most usual kinds without it."""
        if piece.isalpha():
            return [piece]
        if piece[-1] < "\x80" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        if NOT_YET.search(piece):
            return [piece[m.start() : m.end()] for m in self.words.finditer(NOT_YET.sub("\x01", piece))]
        return self.words.findall(piece)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        """Pieces and words of late are remembered in two generations, so that frequent ones stay."""
        ids = self.older.get(piece)
        if ids is None:
            words = self.split(piece)
            if len(words) == 1:
                ids = tuple(self.merge(words[0]))
            else:
                ids = tuple(i for w in words for i in self[w])
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if HAS_NEW_LOWER.search(text):
            text = text.translate(NEW_LOWER)
        # one character at a time: a final sigma is no special case
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        text = self.normal(text)
        return [x for x in SPACE.split(text) if x] if ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        if self.cut is None or "<" not in text:
            return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))
        ids: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            ids += [self.special[part]] if k % 2 else chain.from_iterable(map(self.__getitem__, self.pieces(part)))
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_codecs: dict[int, Codec] = {}


def _codec(spec: Broadcast) -> Codec:
    """One codec a worker process, kept between tasks."""
    value = spec.value
    key = hash((len(value["merges"]), value["pattern"], value["merges"][-1] if value["merges"] else None))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(value)
    return _codecs[key]


def share(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary for all executors; its size is that of the file, whatever the corpus."""
    return spark.sparkContext.broadcast(load(path or default_path()))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the document's columns, or those of ``keep``) and ``_ids``, the token ids of its whole text.

    Null and empty texts have no tokens. No special tokens are added; their strings inside a text
    become their ids, as the library does. With ``decoded``, the text decoded from the ids follows.
    There is no shuffle, and a worker keeps one chunk of documents in memory.
    """
    spec = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                rows = [codec.encode(t) if t else [] for t in part.column("_text").to_pylist()]
                size = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows))
                flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(size.sum()))
                first = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(first), pa.array(flat))
                out = {"_row": part.column("_row"), "_ids": ids}
                if decoded:
                    out["_decoded"] = pa.array(map(codec.decode, rows), pa.string())
                yield pa.RecordBatch.from_pydict(out)
        codec.forget()  # the worker may do other work next

    rows = texts_of(docs, text_col, keep=keep)
    schema = rows.select("_row", F.array().cast("array<int>").alias("_ids"), *[F.lit("").alias("_decoded")] * decoded).schema
    return rows.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``_row``, ``_ids`` and ``_decoded``: the vocabulary's strings of the ids, joined by blanks."""
    spec = share(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                texts = [codec.decode(ids) for ids in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["_row", "_ids", "_decoded"])

    schema = tokens.select("_row", "_ids", F.lit("").alias("_decoded")).schema
    return tokens.select("_row", "_ids").mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass over the documents."""
    return encode(docs, text_col, path, decoded=True, keep=keep)


def digests(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``_row`` with token count and hashes of ids and decoded text."""
    both = round_trip(docs, path=path, keep=keep)
    return both.select(
        "_row",
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One digest row a document; see the query ``op7_bpe``."""
    return digests(docs, path, ["doc_id"]).select("_row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
