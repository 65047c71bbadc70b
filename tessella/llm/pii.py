"""Personal data: fixed patterns, and a semi-Markov random field that adds spans they miss."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, texts_of

#: The fixed patterns' kinds, and after them the one that only the field finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# The contract's patterns, written so that no text takes quadratic time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: An entity has at most so many pieces, and a piece so many characters.
MAX_PIECES, MAX_PIECE = 17, 40
PIECE = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Pieces around a digit, an at sign or a spelt-out one that are looked at together.
REACH = 8
TRIGGER = re.compile(r"[0-9]{2}|[0-9][A-Za-z]{1,8}[0-9]|@|[(\[{](?:at|dot)[)\]}]|\b(?:at|dot)\b[^\n]{1,40}\bdot\b", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; leftmost and non-overlapping for each kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# Whole-span features: what a stretch looks like as a whole, for each kind.
AT = r"\s*(?:@|[(\[{]\s*at\s*[)\]}]|\s+at\s+)\s*"
DOT = r"\s*(?:\.|[(\[{]\s*dot\s*[)\]}]|\s+dot\s+)\s*"
SHAPES = {
    "email_words": re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I),
    "email_tld": re.compile(rf".*{DOT}[A-Za-z]{{2,6}}", re.I | re.S),
    "email_spelt": re.compile(r".*(?:@|[(\[{]\s*at\s*[)\]}]|\sat\s).*(?:[(\[{]\s*dot\s*[)\]}]|\sdot\s).*", re.I | re.S),
    "ip_defanged": re.compile(r"[0-9]{1,3}(?:\s*(?:\[\.\]|\(\.\)|[(\[{]\s*dot\s*[)\]}])\s*[0-9]{1,3}){3}", re.I),
    "card_groups": re.compile(r"[0-9]{4}([./_:|])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}"),
    "phone_3_3_4": re.compile(r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}"),
    "phone_00": re.compile(r"00[1-9][0-9]{0,2}[ .-][0-9 ().-]+"),
    "hex": re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}"),
    "key_prefix": re.compile(r"(?:sk|pk|rk)[-_].+|gh[a-z]_.+|glpat-.+|xox[a-z]-.+|A[A-Z]IA[A-Z0-9]+|eyJ.+"),
    "uuid": re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I),
}
#: A stretch that a secret may be, and what may stand around one.
KEY = re.compile(r"[A-Za-z0-9_+/=.!#$%&*~-]+")
ASSIGNED = re.compile(r"(?:=|:|=>|\bis)\s*[\"'`]?$")
#: More of a domain.
MORE = re.compile(r"\s*(?:[(\[{]\s*dot\s*[)\]}]|\s+dot\s+)\s*[A-Za-z0-9]|\.[A-Za-z0-9]", re.I)
CUE = {
    "phone": re.compile(r"(?:phone|tel|telephone|call|mobile|fax|cell|telefon|tél)\W{0,3}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit)\W{0,3}(?:no|number)?\W{0,3}$", re.I),
    "email": re.compile(r"(?:e-?mail|mail|contact|write to)\W{0,3}$", re.I),
    "ip": re.compile(r"(?:ip|host|address|server)\W{0,3}$", re.I),
    "secret": re.compile(r"(?:token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|passw(?:or)?d|pwd|passwort|credential|bearer|auth)s?[\"']?(?:\s+is)?[\s=:>\"'`]{0,5}$", re.I),
}
#: Words of sentences, which addresses that are spelt out seldom hold.
PLAIN = frozenset("the of and a an in is as to for der die das und la le les de et el los que y".split())
#: What is written before digests that open no door.
DIGEST_CUE = re.compile(r"(?:commit|sha-?1|sha-?256|md5|checksum|digest|hash|revision|uuid|etag|build)\W{0,4}$", re.I)


def features(text: str, lo: int, hi: int, kind: str) -> list[str]:
    s = text[lo:hi]
    d = _digits(s)
    out = ["entity", f"digits{min(len(d), 20) // 2}"]
    out += [n for n, shape in SHAPES.items() if shape.fullmatch(s)]
    if len(d) >= 14:
        out.append("luhn" if luhn(d) else "no_luhn")
    if CUE[kind].search(text[max(0, lo - 24) : lo]):
        out.append("cue")
    if (lo and text[lo - 1].isalnum()) or (hi < len(text) and text[hi].isalnum()):
        out.append("cut_word")
    if lo and text[lo - 1] in "+.-/_#" or hi < len(text) and text[hi] in "-/_" and hi + 1 < len(text) and text[hi + 1].isalnum():
        out.append("cut_number")
    if MORE.match(text, hi):
        out.append("cut_domain")
    if d and not any(c.isalpha() for c in s):
        out.append("numeric")
    if s.isdigit():
        out.append("bare")
    if kind == "email" and not PLAIN.isdisjoint(re.split(r"[^a-z]+", s.lower())):
        out.append("plain_words")
    if kind == "secret":
        out.append(f"turns{min(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)), 9) // 3}")
        out.append(f"length{min(len(s), 48) // 8}")
        before = text[max(0, lo - 16) : lo]
        if ASSIGNED.search(before):
            out.append("assigned")
        if DIGEST_CUE.search(before):
            out.append("digest")
        if lo and hi < len(text) and text[lo - 1] == text[hi] and text[hi] in "\"'`":
            out.append("quoted")
        if (lo and KEY.fullmatch(text[lo - 1])) or (hi < len(text) and KEY.fullmatch(text[hi]) and text[hi] not in ".!"):
            out.append("cut_key")
    return [f"{kind}|{f}" for f in out]


def gates(text: str, lo: int, hi: int) -> Iterator[int]:
    """Kinds that a stretch can be at all; the others have probability 0."""
    s = text[lo:hi]
    n = sum("0" <= c <= "9" for c in s)
    if hi - lo >= 6 and s[0].isalnum() and s[-1].isalnum():
        low = s.lower()
        if "@" in s or "at" in low and ("dot" in low or "." in s):
            yield 0
        if 4 <= n <= 12 and s[0].isdigit() and ("." in s or "dot" in low):
            yield 1
        if 14 <= n <= 19 and s[0].isdigit():
            yield 2
    if hi - lo >= 10 and n >= 2 and s[0].isalnum() and s.isascii() and KEY.fullmatch(s) and sum(c.isalpha() for c in s) >= 2:
        yield 4
    if 10 <= n <= 15 and hi - lo <= 24 and (s[0].isdigit() or s[0] == "(") and s[-1].isdigit():
        yield 3


class Field:
    """Segments a run of pieces into entities (kind, pieces) and single pieces outside.

    The weight of a segmentation is the sum of its entities' feature weights. Sums and maxima over
    all segmentations are exact, by dynamic programming over the pieces with entities of at most
    ``MAX_PIECES`` pieces.
    """

    def __init__(self):
        self.weight: dict[str, float] = {}

    def candidates(self, text: str, pieces: list[tuple[int, int]]) -> list[list[tuple[int, int, list[str]]]]:
        """For each end piece: (first piece, kind, features)."""
        out: list[list[tuple[int, int, list[str]]]] = [[] for _ in pieces]
        for j in range(len(pieces)):
            for i in range(max(0, j - MAX_PIECES + 1), j + 1):
                lo, hi = pieces[i][0], pieces[j][1]
                if hi - lo > 3 * MAX_PIECE:
                    continue
                for k in gates(text, lo, hi):
                    out[j].append((i, k, features(text, lo, hi, KINDS[k])))
        return out

    def score(self, f: list[str]) -> float:
        return sum(self.weight.get(x, 0.0) for x in f)

    def best(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first piece, last piece, kind) of the segmentation of largest weight."""
        top, back = [0.0], []
        for j, ends in enumerate(self.candidates(text, pieces)):
            value, how = top[j], None
            for i, k, f in ends:
                if (v := top[i] + self.score(f)) > value:
                    value, how = v, (i, j, k)
            top.append(value)
            back.append(how)
        out, j = [], len(pieces)
        while j > 0:
            how = back[j - 1]
            if how:
                out.append(how)
                j = how[0]
            else:
                j -= 1
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.25, decay: float = 2e-3) -> None:
        """Gradient ascent on the log-likelihood of the examples' segmentations (forward and backward sums)."""
        ready = []
        for text, gold in examples:
            pieces = pieces_of(text, 0, len(text))
            want = {(lo, hi, k) for lo, hi, k in gold}
            ready.append((pieces, self.candidates(text, pieces), want))
        for _ in range(rounds):
            for pieces, ends, want in ready:
                n = len(pieces)
                alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                alpha[0] = beta[n] = 0.0
                scores = [[self.score(f) for _, _, f in e] for e in ends]
                for j in range(n):
                    alpha[j + 1] = np.logaddexp.reduce([alpha[j], *(alpha[i] + s for (i, _, _), s in zip(ends[j], scores[j], strict=True))])
                for j in range(n, 0, -1):
                    beta[j - 1] = np.logaddexp(beta[j - 1], beta[j])
                    for (i, _, _), s in zip(ends[j - 1], scores[j - 1], strict=True):
                        beta[i] = np.logaddexp(beta[i], s + beta[j])
                for j in range(n):
                    for (i, k, f), s in zip(ends[j], scores[j], strict=True):
                        p = float(np.exp(alpha[i] + s + beta[j + 1] - alpha[n]))
                        gold = (pieces[i][0], pieces[j][1], k) in want
                        if gold or p > 1e-4:
                            for x in f:
                                w = self.weight.get(x, 0.0)
                                self.weight[x] = w + rate * (gold - p) - decay * w


def pieces_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    out = []
    for m in PIECE.finditer(text, lo, hi):
        # an over-long piece is cut: no entity is that long
        out += [(i, min(i + MAX_PIECE, m.end())) for i in range(m.start(), m.end(), MAX_PIECE)]
    return out


def made_examples(n: int = 1200, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with entities in forms that the fixed patterns miss, and numbers that are none."""
    r = random.Random(seed)
    filler = "the order of a ref with on total from version page item and see for at is table in dot line".split()

    plain = sorted(PLAIN)

    def num(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def card():
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def word(lo=3, hi=9):
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(lo, hi)))

    def email():
        at = r.choice([" (at) ", " [at] ", "(at)", " at ", "[at]", " @ "])
        dot = r.choice([" (dot) ", " [dot] ", "(dot)", " dot ", "[dot]"]) if at != " @ " else r.choice([".", " dot "])
        host = word() + (dot + word() if r.random() < 0.3 else "")
        return word() + at + host + dot + r.choice(["com", "org", "net", "de", "info"])

    def ip():
        return r.choice(["[.]", "(.)", "[dot]", " (dot) "]).join(str(r.randint(1, 255)) for _ in range(4))

    def phone():
        return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0049 {num(3)} {num(7)}"])

    def grouped():
        c, sep = card(), r.choice("./_:|")
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    def some(letters, lo, hi):
        return "".join(r.choice(letters) for _ in range(r.randint(lo, hi)))

    def code():
        small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        body = r.choice([some("0123456789abcdef", 32, 64), some(small + large + "0123456789", 16, 44), some(small + "0123456789", 12, 40), some(large + "0123456789", 16, 32)])
        while sum(c.isdigit() for c in body) < 2 or sum(c.isalpha() for c in body) < 2:
            body = some(small + "0123456789", 14, 40)
        return body

    def secret():
        return r.choice(["", "", "", "sk-", "ghp_", "xoxb-", "AKIA"]) + code()

    def secret_cue():
        name = r.choice(["token", "secret", "api_key", "API key", "password", "access_key", "SECRET_KEY", "TOKEN", "auth token", "pwd"])
        return name + r.choice([" = ", "=", ": ", ":", " is ", " => "]) + r.choice(['"', "'", "", "`"])

    def no_luhn(c):
        return c[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)

    def none():
        return r.choice([
            num(16), no_luhn(card()), num(10), num(12), num(20), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}",
            f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
            f"{num(3)}.{num(3)},{num(2)}", f"{word()} at {word()} dot", f"{word()} at {r.choice(plain)} dot {r.choice(plain)} {word()}", f"{word()} at {word()} and. {word()} in {word()}", f"at the {word()}. {word()}", num(40), f"{num(5)}-{num(5)}",
            ".".join(no_luhn(card())[i : i + 4] for i in range(0, 16, 4)), f"{num(3)} {num(3)} {num(4)}", f"@{word()}", f"{num(4)} {num(4)} {num(4)} {num(4)}",
            f"{num(8)}a{num(6)}", f"commit {some('0123456789abcdef', 40, 40)}", f"sha256: {some('0123456789abcdef', 64, 64)}", f"md5 {some('0123456789abcdef', 32, 32)}",
            f"{word()}-{num(4)}-{word()}.html", f"{word()}_{num(2)}_{word()}", f"the token {word()}", f"password of {word()} {num(2)}", f"{word()}{num(2)}.{word()}{num(3)}.{word()}",
            f"uuid {some('0123456789abcdef', 8, 8)}-{num(4)}-{num(4)}-{num(4)}-{some('0123456789abcdef', 12, 12)}", f"{some('ABCDEFGHJKLMNPQRSTUVWXYZ', 2, 3)}-{num(4)}-{num(4)}", f"{word()} at {word()} {num(2)}. {word()}", f"{num(3)}-{num(4)}", f"{num(2)}-{num(3)}-{num(3)}-{num(4)}",
        ])

    makers = [(email, 0), (ip, 1), (grouped, 2), (phone, 3), (secret, 4)]
    cues = {0: "email ", 1: "host ", 2: "card ", 3: "phone "}
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(r.choice(filler) for _ in range(r.randint(1, 5))) + " "
            if r.random() < 0.5:
                make, k = r.choice(makers)
                before = (secret_cue() if k == 4 else cues[k]) if k == 4 or r.random() < 0.4 else ""
                text += before
                lo = len(text)
                text += make()
                gold.append((lo, len(text), k))
                text += before[-1] if before[-1:] in ('"', "'", "`") else ""
            else:
                text += none()
            text += r.choice([" ", ", ", ". "])
        out.append((text + r.choice(filler), gold))
    return out


@cache
def trained() -> Field:
    field = Field()
    field.learn(made_examples())
    return field


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the field's entities that touch no fixed span."""
    out: list[tuple[int, int, int]] = []
    busy = sorted((lo, hi) for lo, _, hi in base)
    region: tuple[int, int] | None = None
    spots = (m.span() for m in TRIGGER.finditer(text))
    # stretches of text around the triggers, merged where they meet
    reach = REACH * 6
    merged: list[tuple[int, int]] = []
    for lo, hi in spots:
        lo, hi = max(0, lo - reach), min(len(text), hi + reach)
        if region and lo <= region[1]:
            region = (region[0], max(hi, region[1]))
        else:
            if region:
                merged.append(region)
            region = (lo, hi)
    if region:
        merged.append(region)
    for lo, hi in merged:
        start = lo
        while lo and start - lo < MAX_PIECE and text[lo - 1].isalnum() and text[lo].isalnum():
            lo -= 1  # not inside a word
        # fixed spans part the region
        cuts = [(a, b) for a, b in busy if a < hi and b > lo]
        at = lo
        for a, b in [*cuts, (hi, hi)]:
            if a > at:
                pieces = pieces_of(text, at, a)
                out += [(pieces[i][0], k, pieces[j][1]) for i, j, k in field.best(text, pieces)]
            at = max(at, b)
    return out


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the document's columns, or those of ``keep``) and ``_spans``: kind, start, end, base.

    Positions count code points, the end is exclusive. The fixed patterns' spans (base) always
    stand; the field adds spans elsewhere. Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    any_at_all = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")

    def spans(text: str | None, field: Field) -> list[dict]:
        if not text or not any_at_all.search(text):
            return []
        base = base_spans(text)
        rows = [(lo, k, hi, True) for lo, k, hi in base] + [(lo, k, hi, False) for lo, k, hi in added_spans(text, base, field)]
        return [{"kind": KINDS[k], "start": lo, "end": hi, "base": b} for lo, k, hi, b in sorted(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            for part in chunked(batch, batch.schema.get_field_index("_text")):
                found = [spans(t, field) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, kind)], names=["_row", "_spans"])

    rows = texts_of(docs, text_col, keep=keep)
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return rows.mapInArrow(run, rows.select("_row", F.array().cast(kind).alias("_spans")).schema)


def report(docs: DataFrame) -> DataFrame:
    """One row a document; see the query ``op9_pii``."""
    base = F.filter("_spans", lambda x: x["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(spans, kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs, keep=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        *[count(base, k) for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
        count(F.col("_spans"), "secret"),
        F.size("_spans").cast("long").alias("n_spans"),
    )
