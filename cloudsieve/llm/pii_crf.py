"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field labels white-space separated words as outside, email, ip, card or phone. Its features are the shape of a word
and the shape classes of its neighbours. It is trained on a small labelled table made from marked sentences, and
decoded by Viterbi in numpy batches. Its spans are kept where a plain check of the found text agrees.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, text_of, without

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Sentences of the labelled table, and passes of gradient ascent over it.
SENTENCES = 600
PASSES = 12
#: Bytes of text that are labelled together.
CHUNK = 1 << 21

# ---- fixed patterns -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive runs, and no start inside a run of digits: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass their check, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- word shapes ----------------------------------------------------------------------------------------------------

_TABLE = bytearray(range(256))
for _i in range(256):
    _c = chr(_i)
    _TABLE[_i] = ord("A") if "A" <= _c <= "Z" else ord("a") if "a" <= _c <= "z" or _i >= 128 else \
        ord("0") if "0" <= _c <= "9" else 32 if 9 <= _i <= 13 else _i
_TABLE = bytes(_TABLE)
_EDGE = b"!\"#$%&'*,.:;<=>?\\^_`{|}~/"
_RUN = re.compile(rb"0+|[Aa]+")
_BORDER = b"\x00"
CLASSES = ("border", "plain", "plus", "area", "short", "group", "long", "split", "dotted", "at", "bracket", "mixed")


def _class(core: bytes) -> str:
    digits = core.count(b"0")
    letters = core.count(b"a") + core.count(b"A")
    if core == _BORDER:
        return "border"
    if core in (b"[aa]", b"(aa)", b"[aaa]", b"(aaa)", b"[AA]", b"(AA)", b"[AAA]", b"(AAA)"):
        return "bracket"
    if b"@" in core:
        return "at"
    if letters:
        return "mixed" if digits or b"=" in core else "plain"
    if not digits:
        return "plain"
    if core.startswith(b"+"):
        return "plus"
    if core.startswith(b"(") and core.endswith(b")"):
        return "area"
    if core.count(b".") >= 3:
        return "dotted"
    if b"-" in core or b"." in core or b"/" in core:
        return "split"
    return "short" if digits <= 2 else "group" if digits <= 4 else "long"


@lru_cache(maxsize=1 << 16)
def features(shape: bytes) -> tuple[tuple[str, ...], str]:
    """Feature names of a word with this raw shape, and its class."""
    core = shape.strip(_EDGE) or shape
    kind = _class(core)
    digits = core.count(b"0")
    if kind == "plain":
        return ("class plain",), kind
    short = _RUN.sub(lambda m: m.group()[:1] if m.group()[:1] != b"0" else b"0" * min(len(m.group()), 5), core)[:24].decode("latin-1")
    bucket = next(n for n in (0, 2, 3, 4, 6, 12, 19, 10**9) if digits <= n)
    return ("class " + kind, "shape " + short, f"digits {bucket}", f"dots {min(core.count(b'.'), 4)}",
            f"hyphens {min(core.count(b'-'), 4)}", f"letters {kind == 'mixed'}"), kind


# ---- labelled table -------------------------------------------------------------------------------------------------

#: Marked sentences: w is a filler word, other names are slots; a slot named like a kind carries its label.
SENTENCE_FORMS = (
    "w w w email w w", "w email", "w w, email. w w", "w w phone w w", "w w w phone, w", "phone w w", "w w w", "w w w w w w w",
    "w card w w", "w w w card", "w card, w w", "w ip w w w", "w w w ip", "w ip. w w", "w w hex w w", "w key w w", "w w pass w",
    "w w version. w w", "w w date w", "w w time w w", "w price w w", "w w year w w w", "w count w w", "w w handle w", "w long w w",
    "w list w w", "w formula w w", "w w range w", "w section w w", "w email w phone w", "w ip w card w", "w phone w email",
)
FILLERS = ("the", "and", "there", "onthe", "Erst", "keit", "une", "êau", "ciónes", "house", "WORD", "then,", "it.", "von", "queue***", "re%%%", "so###", "or!!")


def _slot(kind: str, r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(("anna", "j.doe", "max", "li.wei", "that", "rée", "Kim"))
    host = lambda: r.choice(("mail", "example", "post", "uni-web"))
    a, b, c, d = (digits(n) for n in (3, 3, 4, 2))
    choices = {
        "email": [f"{name()}.{d}@{host()}{digits(1)}.example.com", f"{name()}@{host()}.org", f"{name()} [at] {host()} [dot] com",
                  f"{name()} (at) {host()} (dot) net"],
        "phone": [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{d} {a} {c}{d}", f"+{d}-{a}-{b}-{c}", f"{a}.{b}.{c}"],
        "card": [digits(16), f"{c} {digits(4)} {digits(4)} {digits(4)}", f"{c}-{digits(4)}-{digits(4)}-{digits(4)}",
                 digits(15), f"{c}.{digits(4)}.{digits(4)}.{digits(4)}"],
        "ip": [".".join(str(r.randint(0, 255)) for _ in range(4))],
        "hex": ["token = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\""],
        "key": ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))],
        "pass": ["password=" + "".join(r.choice("0123456789abcdef") for _ in range(18))],
        "version": [f"Version {digits(1)}.{digits(1)}", f"version {digits(1)}", f"v{digits(1)}.{digits(2)}.{digits(1)}"],
        "date": [f"20{d}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}.0{digits(1)}.20{d}", f"{digits(1)}/{digits(1)}/20{d}"],
        "time": [f"1{digits(1)}:{d}", f"1{digits(1)}:{d}:{digits(2)}"], "price": [f"${digits(2)}.{d}", f"{digits(3)},{digits(3)}", f"{d}%"],
        "year": [f"19{d}", f"20{d}"], "count": [digits(1), digits(2), digits(3), digits(4), digits(6)], "handle": [f"@{name()}", "@home"],
        "long": [digits(8), digits(10), digits(22)], "list": [f"{digits(1)}. w", f"({digits(1)}) w"],
        "formula": [f"{digits(1)} + {digits(2)} = {digits(2)}", f"{d} - {digits(1)}"], "range": [f"{c}-{digits(4)}", f"{d}-{digits(2)}"],
        "section": [f"{digits(1)}.{digits(1)}.{digits(1)}", f"§{d}"],
    }
    return r.choice(choices[kind])


def labelled_table(n: int = SENTENCES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Sentences with a label index per word, by rule from the marked forms; the same at every call."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words, labels = [], []
        for item in SENTENCE_FORMS[i % len(SENTENCE_FORMS)].split():
            kind = item.rstrip(",.")
            if kind == "w":
                found, label = [r.choice(FILLERS)], 0
            else:
                found = [r.choice(FILLERS) if x == "w" else x for x in _slot(kind, r).split()]
                label = LABELS.index(kind) if kind in KINDS else 0
                found[-1] += item[len(kind):] or r.choice(("", "", "", "***", ",", "%%%"))
            words += found
            labels += [label] * len(found)
        out.append((" ".join(words), labels))
    return out


# ---- the field ------------------------------------------------------------------------------------------------------

def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[str, list[int]]], passes: int = PASSES, seed: int = 3) -> dict:
    """Weights by stochastic gradient ascent on the conditional likelihood (forward-backward), as plain arrays."""
    names: dict[str, int] = {}
    data = []
    for text, labels in table:
        found = [features(w) for w in text.encode().translate(_TABLE).split()]
        rows = [[names.setdefault(f, len(names)) for f in x[0]] for x in found]
        kinds = [0, *[CLASSES.index(x[1]) for x in found], 0]
        data.append((rows, kinds[:-2], kinds[2:], labels))
    k, c = len(LABELS), len(CLASSES)
    w, before, after, step = np.zeros((len(names), k)), np.zeros((c, k)), np.zeros((c, k)), np.zeros((k, k))
    r = random.Random(seed)
    for turn in range(passes):
        r.shuffle(data)
        rate = 0.3 / (1 + 0.3 * turn)
        for rows, left, right, labels in data:
            n = len(labels)
            e = np.array([w[x].sum(0) for x in rows]) + before[left] + after[right]
            alpha, beta = np.empty((n, k)), np.zeros((n, k))
            alpha[0] = e[0] + step[0]  # borders count as outside
            for t in range(1, n):
                alpha[t] = e[t] + _logsum(alpha[t - 1][:, None] + step, 0)
            beta[-1] = step[:, 0]
            for t in range(n - 2, -1, -1):
                beta[t] = _logsum(step + e[t + 1] + beta[t + 1], 1)
            total = _logsum(alpha[-1] + beta[-1], 0)
            slope = -np.exp(alpha + beta - total)
            slope[np.arange(n), labels] += 1
            pair = np.zeros((k, k))
            for t in range(1, n):
                pair -= np.exp(alpha[t - 1][:, None] + step + e[t] + beta[t] - total)
            np.add.at(pair, (labels[:-1], labels[1:]), 1)
            for t, x in enumerate(rows):
                w[x] += rate * slope[t]
            np.add.at(before, left, rate * slope)
            np.add.at(after, right, rate * slope)
            step += rate * pair
            w *= 1 - rate * 1e-4
    return {"names": names, "words": w, "before": before, "after": after, "step": step}


@lru_cache(maxsize=1)
def trained() -> dict:
    return train(labelled_table())


class _Shapes(dict):
    """Raw shape -> row of the score tables, filled as shapes occur."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.scores, self.kinds = [], []

    def __missing__(self, shape: bytes) -> int:
        found, kind = features(shape)
        rows = [self.model["names"][f] for f in found if f in self.model["names"]]
        self.scores.append(self.model["words"][rows].sum(0))
        self.kinds.append(CLASSES.index(kind))
        self[shape] = len(self.scores) - 1
        return self[shape]


def viterbi(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once: ``scores`` holds them one after the other; borders are outside."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    back = np.zeros((len(scores), scores.shape[1]), np.int8)
    best = np.empty(len(scores), np.int8)
    value = scores[starts] + step[0]
    active = order
    for t in range(1, longest):
        active = active[sizes[active] > t]
        trial = value[active][:, :, None] + step
        back[starts[active] + t] = trial.argmax(1)
        value[active] = trial.max(1) + scores[starts[active] + t]
    label = (value + step[:, 0]).argmax(1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        active = order[sizes[order] > t]
        at = starts[active] + t
        best[at] = label[active]
        label[active] = back[at, label[active]]
    return best


def label_words(buffer: bytes, shapes: _Shapes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Places (in bytes) and labels of the words of ``buffer`` that the field does not leave outside."""
    model = shapes.model
    shaped = buffer.translate(_TABLE)
    words = shaped.split()
    ids = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    if not len(ids):
        return np.empty((0, 3), np.int64), np.empty(0, np.int8), shaped
    scores, kinds = np.array(shapes.scores, np.float64), np.array(shapes.kinds)
    kind = kinds[ids]
    border = CLASSES.index("border")
    e = scores[ids] + model["before"][np.append(border, kind[:-1])] + model["after"][np.append(kind[1:], border)]
    e[kind == border, 1:] = -1e9
    step = model["step"]
    # outside is best whatever the neighbours' labels are if it leads by more than transitions can make up for
    gain = max(float((step[:, y][:, None] + step[y] - step[:, 0][:, None] - step[0]).max()) for y in range(1, len(LABELS)))
    open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= max(gain, 0.0))
    if not len(open_):
        return np.empty((0, 3), np.int64), np.empty(0, np.int8), shaped
    cuts = np.append(0, np.flatnonzero(np.diff(open_) > 1) + 1)
    labels = viterbi(e[open_], np.diff(np.append(cuts, len(open_))), step)
    hit = labels > 0
    at = open_[hit]
    solid = np.frombuffer(shaped, np.uint8) != 32
    starts = np.flatnonzero(solid & ~np.append(False, solid[:-1]))[at]
    return np.stack([at, starts, starts + np.array([len(words[i]) for i in at], np.int64)], 1), labels[hit], shaped


_OBFUSCATED = re.compile(r"\S+\s+[\[(][Aa][Tt][\])]\s+\S+(?:\s+[\[(][Dd][Oo][Tt][\])]\s+\S+)+")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")


def agrees(kind: str, found: str) -> bool:
    """Whether the text of a span that the field proposes can be data of this kind."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == "email":
        return bool(_OBFUSCATED.fullmatch(found))
    if kind == "phone":
        return bool(_LOCAL_PHONE.fullmatch(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./-]", found)
    parts = found.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and _part(p) for p in parts)


def _chunks(text: bytes):
    """(offset, bytes): a long text is cut inside plain prose, one word of it in both parts."""
    at = 0
    while len(text) - at > CHUNK:
        m = re.compile(rb"[a-z]{2,}\s+([a-z]{2,})\s+[a-z]{2,}").search(text, at + CHUNK)
        if not m:
            break
        yield at, text[at:m.end(1)]
        at = m.start(1)
    yield at, text[at:]


def _code_points(text: bytes) -> np.ndarray:
    """Places where a code point of UTF-8 text begins."""
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


class _Taken:
    """Which places of a text the base spans and the field's spans so far cover; the field's come in ascending order."""

    def __init__(self, base: list[tuple[str, int, int]]):
        inside = sorted((s, e) for _, s, e in base)
        self.starts = [s for s, _ in inside]
        self.ends = np.maximum.accumulate([e for _, e in inside]).tolist() if inside else []
        self.last = 0

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return start >= self.last and not (before and self.ends[before - 1] > start)


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], shapes: _Shapes) -> list[list[tuple[str, int, int]]]:
    """Spans that the field adds to each text: contiguous words of one label that touch no base span and agree."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: dict[int, _Taken] = {}
    group, size = [], 0

    def flush():
        if not group:
            return
        buffer = b"\n\x00\n".join(part for _, _, part in group)
        places, labels, _ = label_words(buffer, shapes)
        if not len(labels):
            return
        first = np.cumsum([0, *[len(part) + 3 for _, _, part in group]])
        owner = np.searchsorted(first, places[:, 1], "right") - 1
        points = _code_points(buffer)
        breaks = np.flatnonzero((np.diff(places[:, 0]) > 1) | (np.diff(labels) != 0) | (np.diff(owner) != 0)) + 1
        for rows in np.split(np.arange(len(labels)), breaks):
            i, lead, part = group[owner[rows[0]]]
            base = int(first[owner[rows[0]]])
            start, end = int(places[rows[0], 1]) - base, int(places[rows[-1], 2]) - base
            raw = part[start:end]
            found = raw.strip(_EDGE).decode("utf-8", "surrogatepass")
            kind = LABELS[labels[rows[0]]]
            if not found or not agrees(kind, found):
                continue
            start += len(raw) - len(raw.lstrip(_EDGE))
            at = lead + int(np.searchsorted(points, base + start) - np.searchsorted(points, base))
            span = (kind, at, at + len(found))
            if i not in taken:
                taken[i] = _Taken(bases[i])
            if taken[i].free(span[1], span[2]):
                taken[i].last = span[2]
                out[i].append(span)
    for i, text in enumerate(texts):
        whole, seen, lead = text.encode("utf-8", "surrogatepass"), 0, 0
        for offset, part in _chunks(whole):
            lead += len(_code_points(whole[seen:offset]))
            seen = offset
            if size + len(part) > CHUNK and group:
                flush()
                group, size = [], 0
            group.append((i, lead, part.replace(_BORDER, b"\x01")))
            size += len(part)
    flush()
    return out


def _span_batches(shared):
    def run(batches):
        shapes = _Shapes(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            bases = [base_spans(t) for t in texts]
            rows = [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=lambda s: (KINDS.index(s[0]), s[1]))
                    for b, a in zip(bases, added_spans(texts, bases, shapes))]
            found = pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "spans"])
    return run


def find(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base), code points, end exclusive, by kind, then start.

    ``base`` spans are the fixed patterns' matches and are all there; the others come from the field, lie outside of
    them and agree with a plain check of their kind. Null texts count as empty and have no spans. No shuffle; whole
    texts are labelled, long ones in parts of two megabytes that share a plain word. Repeated rows get equal spans; an
    empty table gives no rows. An input column ``spans`` is replaced, all others pass through.
    """
    docs = without(docs, ["spans"])
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    text, = fresh(docs, "_whole_text")
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema),
                        "spans array<struct<kind: string, start: long, end: long, base: boolean>>"])
    return docs.withColumn(text, text_of(text_col)).mapInArrow(_span_batches(shared), schema)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of :func:`find`: base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col(quoted(id_col)),
        *[F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
