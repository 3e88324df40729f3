"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent from a small labelled table and decoded by Viterbi in numpy
batches. A word's shape is a small code, so its emission scores are table lookups. A word whose score
for ``O`` exceeds all others by more than any two transitions can bring back is ``O`` on every best
path; the chain is cut there, exactly, and only the pieces between are decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.textbytes import as_bytes, slices, words
from loomspark.storage import bounded_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", "email", "ip", "card", "phone", "id")

#: The labelled table: words of one kind stand in ``<kind words>``. Rows repeat with other digits.
LABELLED = (
    "please call <phone +1 (743) 555-3824> before noon", "phone <phone (743) 555-3824> or write", "tel. <phone 743-555-3824> office hours",
    "ring <phone +44 20 7946 0958> today", "my mobile is <phone 0171 234 56 78> thanks", "fax <phone 555-0133> only", "dial <phone (020) 7946 0958> now", "his cell <phone 646-555-0187> rang", "sms to <phone 303.555.0199> please", "hotline <phone 1-800-555-0100> is free",
    "write to <email ann.lee@mail.example.com> soon", "mail <email bob_23@example.org,> please", "forward to <email admin@localhost> now", "user <email root@mailhost> wrote", "contact <email joe@host> internally", "send it to <email x.y@sub.example.net.>",
    "host <ip 192.168.10.24> is down", "from <ip 10.0.0.7> to <ip 172.16.254.1> it went", "server <ip 227.5.221.1:8080> answered", "address <ip 10.1.2.3> is taken", "the router <ip 192.0.2.44> replied", "traffic of <ip 8.8.8.8,> was cut", "login from <ip 100.64.20.9>",
    "card <card 4325 4048 9316 7225> expires", "paid with <card 4325404893167225> yesterday", "visa <card 5500-0000-0000-0004,> thanks", "amex <card 3782 822463 10005> declined",
    "ssn <id 123-45-6789> on file", "her number <id 987-65-4321> was", "social security <id 078-05-1120.> end", "passport <id X12345678> issued", "iban <id DE89370400440532013000> owner", "tax id <id 12-3456789> given",
    "in 1998 there were 25 of them", "it cost 1,250.00 or so", "version 3.11.2 was out", "page 12 of 300", "on 2021-03-04 at 10:30 we met", "the ratio 16:9 held", "about 100 people came in 7 days",
    "Was the That of onhe and ERTION!! HASH!!", "onatly### of%%% the&&& edat$$$ in***", "a | b | cell | 12 | x", "the the the the", "see http://example.com/en/728 for more", "follow @someone there",
    "https://a.example.org/x?page=2 is a page", "built 2019.10 with r5.2xlarge", "room B12 on floor 3", "order no. 4711 shipped", "item 20240101 was 5-10 units", "it was 1-0 then 2-1 (half)", "score 12-3 in 1984-85",
    "v1.2.3.4.5 is wrong", "lat 52.5200 lon 13.4050 there", "pi is 3.14159265 roughly", "he said so (twice) and left.", "sum 123456 total 7890", "id est and token = x", "call me later , ok ?", "0 1 2 3 4 5 6 7 8 9",
)
COPIES, STEPS, DECAY = 12, 150, 0.02

# --- word shapes -------------------------------------------------------------------------------
_DIGIT_LEVELS = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 8, 9, 10, 10, 10, 10, 10, 10, 11])
#: (name, number of levels) of the parts of a shape code.
PARTS = (("digits", 12), ("at", 2), ("dots", 4), ("hyphens", 3), ("brackets", 2), ("plus", 2), ("letters", 4), ("other", 2))
CODES = int(np.prod([n for _, n in PARTS]))


def shape_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape code of each word, from counts of kinds of bytes."""
    if not len(start):
        return np.zeros(0, np.int32)
    cuts = np.empty(2 * len(start), np.int64)
    cuts[0::2], cuts[1::2] = start, end
    if cuts[-1] == len(data):
        cuts = cuts[:-1]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), cuts)[0::2]

    lower, upper = ((data >= 97) & (data < 123)) | (data >= 0xC0), (data >= 65) & (data < 91)
    digit = (data >= 48) & (data < 58)
    known = lower | upper | digit | (data >= 0x80) | np.isin(data, np.frombuffer(b"@.-()+,'!?\"", np.uint8))
    n_lower, n_upper = count(lower), count(upper)
    levels = (
        _DIGIT_LEVELS[np.minimum(count(digit), 19)], count(data == 64) > 0, np.minimum(count(data == 46), 3), np.minimum(count(data == 45), 2), count((data == 40) | (data == 41)) > 0,
        data[start] == 43, np.where(n_lower + n_upper == 0, 0, np.where(n_upper == 0, 1, np.where(n_lower == 0, 2, 3))), count(~known) > 0,
    )
    code = np.zeros(len(start), np.int32)
    for (_, n), level in zip(PARTS, levels, strict=True):
        code = code * n + level.astype(np.int32)
    return code


@lru_cache(1)
def _indicators() -> np.ndarray:
    """[CODES, features]: one column for each level of each part, and for pairs of digits with letters and hyphens."""
    sizes = [n for _, n in PARTS]
    level = np.stack(np.unravel_index(np.arange(CODES), sizes), 1)
    columns = [np.eye(n, dtype=np.float32)[level[:, i]] for i, n in enumerate(sizes)]
    for i, j in ((0, 6), (0, 3), (0, 2)):
        columns.append(np.eye(sizes[i] * sizes[j], dtype=np.float32)[level[:, i] * sizes[j] + level[:, j]])
    return np.hstack(columns)


# --- the field ---------------------------------------------------------------------------------
def labelled_rows() -> list[tuple[str, list[str]]]:
    """(text, tag of each word): LABELLED with fresh digits, COPIES times."""
    rng = np.random.default_rng(7)
    rows = []
    for copy in range(COPIES):
        for line in LABELLED:
            tags: list[str] = []
            plain = []
            for piece in re.split(r"(<\w+ [^>]*>)", line):
                kind, body = ("O", piece) if not piece.startswith("<") else (piece[1:].split(" ", 1)[0], piece.split(" ", 1)[1][:-1])
                for w in body.split():
                    fresh = "[0-9]{1,3}(?=[.:,]|$)" if kind == "ip" else "[0-9]"
                    plain.append(w if not copy else re.sub(fresh, lambda m, most=256 if kind == "ip" else 10: str(rng.integers(1, most)), w))
                    tags.append(kind)
            rows.append((" ".join(plain), tags))
    return rows


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Field:
    """Emission tables for a word's own shape, the one before and the one after, and transitions."""

    def __init__(self) -> None:
        f, t = _indicators().shape[1], len(TAGS)
        self.weights = np.zeros((3, f, t))
        self.edge = np.zeros(t)
        self.trans = np.zeros((t, t))
        self.tables = np.zeros((3, CODES, t), np.float32)

    def finish(self) -> Field:
        self.tables = np.stack([_indicators() @ w for w in self.weights]).astype(np.float32)
        self.sure = 2 * float(self.trans.max() - self.trans.min()) + float(abs(self.edge).max()) * 2
        return self

    def emissions(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[words, tags]; first: index of each text's first word, and the number of words."""
        out = self.tables[0][code]
        if len(code) > 1:
            before, after = self.tables[1][code[:-1]], self.tables[2][code[1:]]
            inner = np.ones(len(code) - 1, bool)
            cut = first[(first > 0) & (first < len(code))]
            inner[cut - 1] = False
            out[1:][inner] += before[inner]
            out[:-1][inner] += after[inner]
        return out

    def decode(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tag of each word."""
        n, t = emission.shape
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        open_ = emission[:, 0] - emission[:, 1:].max(1) <= self.sure
        starts_text = np.zeros(n + 1, bool)
        starts_text[first] = True
        begin = np.flatnonzero(open_ & (np.append(True, ~open_[:-1]) | starts_text[:-1]))
        if not len(begin):
            return tags
        stop = np.flatnonzero(open_ & (np.append(~open_[1:], True) | starts_text[1:])) + 1
        length = stop - begin
        for size in np.unique(2 ** np.ceil(np.log2(length)).astype(int)):
            group = np.flatnonzero((length <= size) & (length > size // 2))
            step = max(1, (1 << 20) // int(size * t * t))
            for k in range(0, len(group), step):
                self._viterbi(emission, tags, begin[group[k : k + step]], length[group[k : k + step]], int(size), starts_text)
        return tags

    def _viterbi(self, emission: np.ndarray, tags: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int, starts_text: np.ndarray) -> None:
        at = np.minimum(begin[:, None] + np.arange(size), len(emission) - 1)
        e = emission[at]
        head, tail = starts_text[begin], starts_text[begin + length]  # else the neighbour is O
        score = e[:, 0] + np.where(head[:, None], self.edge, self.trans[0])
        last = np.where(tail[:, None], 0, self.trans[:, 0])
        back = np.zeros((len(begin), size, len(TAGS)), np.int8)
        final = np.where((length == 1)[:, None], score + last, -np.inf)
        for i in range(1, size):
            paths = score[:, :, None] + self.trans
            back[:, i] = paths.argmax(1)
            score = paths.max(1) + e[:, i]
            final = np.where((length == i + 1)[:, None], score + last, final)
        tag, rows = final.argmax(1), np.arange(len(begin))
        for i in range(size - 1, -1, -1):
            live = length > i
            tags[begin[live] + i] = tag[live]
            tag = np.where(live, back[rows, i, tag], tag)


def train(rows: list[tuple[str, list[str]]] | None = None, steps: int = STEPS) -> Field:
    """Maximum conditional likelihood with weight decay, by Adam steps on the whole table."""
    rows = labelled_rows() if rows is None else rows
    field, ind = Field(), _indicators()
    data, off = as_bytes(pa.array([r[0] for r in rows]))
    start, end, first = words(data, off)
    code = shape_codes(data, start, end)
    n = np.diff(first)
    size = int(n.max())
    gold = np.zeros((len(rows), size), int)
    for i, (_, tags) in enumerate(rows):
        gold[i, : len(tags)] = [TAGS.index(x) for x in tags]
    mask = np.arange(size) < n[:, None]
    at = np.minimum(first[:-1, None] + np.arange(size), len(code) - 1)
    own = ind[code]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    x = [own, before, after]
    hot = np.eye(len(TAGS))
    params = [field.weights, field.edge, field.trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        e = sum(f @ w for f, w in zip(x, field.weights, strict=True))[at]
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0] + field.edge
        for i in range(1, size):
            a[:, i] = np.where(mask[:, i, None], _logsumexp(a[:, i - 1, :, None] + field.trans, 1) + e[:, i], a[:, i - 1])
        b = np.zeros_like(e)
        for i in range(size - 2, -1, -1):
            b[:, i] = np.where(mask[:, i + 1, None], _logsumexp(field.trans + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = _logsumexp(a[:, -1], 1)
        node = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        diff = (hot[gold] * mask[:, :, None] - node)[mask]
        pair = np.exp(a[:, :-1, :, None] + field.trans + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.einsum("nit,niu,ni->tu", hot[gold[:, :-1]], hot[gold[:, 1:]], mask[:, 1:].astype(float))
        grads = [np.stack([f.T @ diff for f in x]), (hot[gold[:, 0]] - node[:, 0]).sum(0), seen - pair.sum((0, 1))]
        for p, g, mm, vv in zip(params, grads, m, v, strict=True):
            g = g - DECAY * len(rows) / 100 * p
            mm[...], vv[...] = 0.9 * mm + 0.1 * g, 0.99 * vv + 0.01 * g * g
            p += 0.15 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    return field.finish()


# --- fixed patterns ----------------------------------------------------------------------------
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that fails from the first digit of a run fails from the others: none is tried there.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns in linear time, sorted."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append((s, 0, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_TRIM = b".,;:!?\"'"
#: Least number of digits of a span that the field adds, by tag.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 14, "phone": 7, "id": 8}


def _field_spans(field: Field, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, first byte, end byte, tag) of runs of one tag, trimmed."""
    start, end, first = words(data, off)
    code = shape_codes(data, start, end)
    tags = field.decode(field.emissions(code, first), first)
    found = np.flatnonzero(tags)
    if not len(found):
        return []
    text = np.searchsorted(first, found, "right") - 1
    new = np.append(True, (np.diff(found) > 1) | (tags[found][1:] != tags[found][:-1]) | (text[1:] != text[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(found)) - 1
    out = []
    for h, t in zip(heads, tails, strict=True):
        a, b = int(start[found[h]]), int(end[found[t]])
        while b > a and data[b - 1] in _TRIM:
            b -= 1
        while a < b and data[a] in _TRIM:
            a += 1
        piece, tag = data[a:b], int(tags[found[h]])
        n_digits = int(((piece >= 48) & (piece < 58)).sum())
        lettered = bool((((piece | 32) >= 97) & ((piece | 32) < 123)).any())
        if n_digits >= LEAST_DIGITS[TAGS[tag]] and not (lettered and TAGS[tag] in ("ip", "card", "phone")) and (tag != 1 or b"@" in piece.tobytes()[1:-1]):
            out.append((int(text[h]), a, b, tag))
    return out


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, base and spans: array<struct<kind, start, end>> by start, then kind.

    base: matches of the fixed patterns. spans: those and the field's, named ``crf_`` and the tag, where
    they overlap no base span. Offsets are code points, end exclusive. Null text counts as empty and has
    no spans. Rows are judged alone. No rows in, no rows out.
    """
    field = field or train()
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(*as_bytes(batch.column(1))):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                base = [base_spans(t) for t in texts]
                every = [[(s, k, e, KINDS[k]) for s, k, e in b] for b in base]
                places: dict[int, np.ndarray] = {}
                for d, a, b, tag in _field_spans(field, data, off):
                    if d not in places:  # code points before each byte, and how far the base spans before it reach
                        places = {d: np.append(0, np.cumsum((data[off[d] : off[d + 1]] & 0xC0) != 0x80))}
                        starts, reach = [x[0] for x in base[d]], list(accumulate((x[2] for x in base[d]), max))
                    s, e = int(places[d][a - off[d]]), int(places[d][b - off[d]])
                    before = bisect_left(starts, e)
                    if not before or reach[before - 1] <= s:
                        every[d].append((s, len(KINDS) + tag, e, f"crf_{TAGS[tag]}"))
                rows = lambda found: pa.array([[{"kind": x[3], "start": x[0], "end": x[2]} for x in sorted(f)] for f in found], span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows([[x for x in f if x[1] < len(KINDS)] for f in every]), rows(every)], names=["id", "base", "spans"])

    bounded_batches(docs.sparkSession)
    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(find, f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)
