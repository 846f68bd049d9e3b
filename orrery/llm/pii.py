"""Personal data by candidate gradient boosting.

Base spans follow fixed formats and always stay. Generators with high recall propose further, overlapping
spans (e-mail addresses written out, telephone numbers without a plus sign, addresses of the sixth version, in
full or with a double colon, with or without brackets and port, cards in odd groups); boosted trees score each proposal by its format and its context; those
whose calibrated probability reaches the threshold of their kind are added, the most probable first, if they
overlap nothing chosen before. Thresholds come from held-out proposals: the lowest with the precision asked for.

The trees are fitted on made-up personal data and look-alikes (dates, versions, prices, order numbers) set
into lines of a sample of at most ``SAMPLE`` documents, the first by a hash of their id, of each of them ``CHARS``
characters of its first line. ``measured`` gives precision and recall on such data made anew with another seed.
Every whole text is searched.

Defined cases: null text counts as empty; no candidates give zero counts, the empty base list's hash and an
empty span list; rows repeat as they come; an empty table gives an empty one; a corpus without text trains
on the made-up contexts alone.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orrery.llm.batches import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents whose lines lend the training set its contexts, and the precision that thresholds aim at.
SAMPLE, CHARS, PRECISION = 400, 400, 0.98

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match takes whole runs of digits, so it starts at the start of one
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile("[^0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed formats, leftmost and non-overlapping in each kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 16 <= len(d := _OTHER.sub("", m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 8 <= len(_OTHER.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Proposals. Each pattern runs in time linear in the text: repeats are bounded and starts anchored.
_PROPOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}:[0-9A-Fa-f:]{0,39}:)(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?::{2})?(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4,6}){2,3}(?:[\x20./_-]{1,3}[0-9]{1,5})?(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])"),
}
_AT = re.compile(r"\(at\)|\[at\]|\{at\}|\sat\s", re.I)
#: Words near a span that speak for its kind.
_CUES = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "master", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "whatsapp", "sms", "anruf", "appel"),
}
_AGAINST = ("version", "date", "page", "order", "invoice", "isbn", "total", "price", "serial", "chapter", "€", "$", "#", "no.")


def proposals(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *m.span()) for m in _PROPOSE["email"].finditer(text)] if _AT.search(text) and ("dot" in text or "." in text) else []
    if _DIGIT.search(text):
        found += [(k, *m.span()) for k in KINDS[1:] if k != "ip" or ":" in text for m in _PROPOSE[k].finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and words of its context."""
    s, before, after = text[start:end], text[max(0, start - 30) : start].lower(), text[end : end + 15].lower()
    groups, digits = re.findall("[0-9]+", s), _OTHER.sub("", s)
    lengths = [len(g) for g in groups] or [0]
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(lengths), min(lengths), lengths[0], lengths[-1],
        len(set(digits)), s.count("-"), s.count("."), s.count("/"), s.count("("), s.count(":"), s.count("::"), float(s[:4] in ("fe80", "2001", "2a00", "2600")), float(":" in s and bool(re.search("[a-f]", s, re.I))),
        float(bool(digits) and luhn(digits)), float(bool(re.search(r"[(\[{](at|dot)[)\]}]", s, re.I))), float(bool(re.search(r"\bdot\b", s, re.I))),
        float(lengths[:1] == [4] and groups[0][:2] in ("19", "20")), float(lengths[-1] == 4 and groups[-1][:2] in ("19", "20") if groups else 0),
        float(any(c in before for c in _CUES[kind])), float(any(c in before for c in _AGAINST)), float(after[:1].isalnum() or before[-1:].isalnum()), float(after[:1] in "%€$"  if after else 0),
    ]


def _made_up(lines: list[str], seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): spans that a generator proposes, those of personal data labelled 1."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))

    h = lambda: f"{r.randrange(1 << 16):x}"

    def card() -> str:
        body = d(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(c: str, sep: str) -> str:
        return sep.join(c[k : k + 4] for k in range(0, 16, 4))

    good = {
        "email": lambda: r.choice([f"{w()}(at){w()}.{w()[:3]}", f"{w()} [at] {w()} [dot] {w()[:3]}", f"{w()}.{w()} (at) {w()}.{w()[:3]}", f"{w()} at {w()} dot {w()[:3]}"]),
        "ip": lambda: r.choice([":".join(h() for _ in range(8)), f"fe80::{h()}", f"2001:{h()}::{h()}:{h()}", f"2001:{h()}:{h()}::{h()}", f"2001:db8::{h()}:{h()}:{h()}"]),
        "card": lambda: grouped(card(), r.choice([".", "/", "_", "  ", " - "])),
        "phone": lambda: r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)}/{d(4)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}"]),
    }
    bad = {
        "email": lambda: r.choice([f"{w()} at {w()}. {w()}", f"{w()} at {w()}.{w()}", f"look at {w()}. {w()}"]),
        "ip": lambda: r.choice([f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}:{d(1)}:{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"a::{w()[:1]}", f"{d(1)}::{d(1)}"]),
        "card": lambda: r.choice([grouped(d(16), r.choice(["-", " ", "/"])), f"{d(4)}-{d(4)}-{d(4)}"]),
        "phone": lambda: r.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"{d(2)} {d(3)}", f"{d(3)}-{d(2)}", f"{d(2)}.{d(2)}", f"978-{d(1)}{d(2)}-{d(5)}-{d(2)}", f"{d(4)}-{d(4)}", f"20{d(2)}-20{d(2)}"]),
    }
    no_cue = {"email": ["", "e-mail", "contact"], "ip": ["", "host", "server"], "card": ["", "card", "visa"], "phone": ["", "tel", "call", "phone:"]}
    lines = [x for x in lines if x.strip()] or ["some words of a line", "and others of the next one"]
    out = []
    for k in range(4000):
        kind, label = KINDS[k % 4], k // 4 % 2
        words = r.choice(lines).split()[:40]
        at = r.randint(0, len(words))
        cue = r.choice(no_cue[kind]) if label else r.choice(["", "", "date", "version", "order", "page", *no_cue[kind][1:]])
        head = " ".join([*words[:at], *([cue] if cue else [])])
        span = (good if label else bad)[kind]()
        text = " ".join(x for x in (head, span, *words[at:]) if x)
        start = len(head) + bool(head)
        for kind_, a, b in proposals(text):
            if a < start + len(span) and b > start:
                out.append((text, kind_, a, b, int(label and kind_ == kind and abs(a - start) + abs(b - start - len(span)) <= 1)))
    return out


def train(documents: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE, precision: float = PRECISION) -> dict:
    """The trees, their calibration, and a threshold for each kind (over 1: the kind gets no additions)."""
    import numpy as np

    from orrery.llm.boosting import fit, probability

    lines = [r[0] for r in documents.select(F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, CHARS), F.xxhash64(key).alias("h"), F.xxhash64(text).alias("t")).orderBy("h", "t").limit(sample).collect() if r[0]]
    made = _made_up(lines)
    x, y = np.array([features(*m[:4]) for m in made]), np.array([m[4] for m in made], float)
    model = fit(x, y)
    hx, hy = model.pop("held")
    p, model["thresholds"] = probability(model, hx), {}
    for k, kind in enumerate(KINDS):
        own, ok = sorted(zip(p[hx[:, 0] == k], hy[hx[:, 0] == k]), reverse=True), 2.0
        for n in range(1, len(own) + 1):
            if (n == len(own) or own[n][0] < own[n - 1][0]) and sum(v for _, v in own[:n]) >= precision * n:
                ok = float(own[n - 1][0])
        model["thresholds"][kind] = ok if ok > 1 else max(ok, 0.5)
    return model


def added_spans(text: str, base: list[tuple[str, int, int]], model: dict) -> list[tuple[str, int, int]]:
    import numpy as np

    from orrery.llm.boosting import probability

    found = proposals(text)
    if not found:
        return []
    starts, ends = [], []  # merged, so both ascend: what is taken

    def take(a: int, b: int) -> None:
        lo, hi = bisect_left(ends, a), bisect_right(starts, b)
        a, b = min([a, *starts[lo : lo + 1]]) if lo < hi else a, max([b, *ends[hi - 1 : hi]]) if lo < hi else b
        starts[lo:hi], ends[lo:hi] = [a], [b]

    for _, a, b in base:
        take(a, b)
    out = []
    for p, kind, a, b in sorted(((p, *s) for p, s in zip(probability(model, np.array([features(text, *s) for s in found])).tolist(), found)), key=lambda v: (-v[0], v[2], v[1])):
        free = bisect_right(ends, a) >= bisect_left(starts, b)  # what ends after a starts at b or later
        if p >= model["thresholds"][kind] and free:
            out.append((kind, a, b))
            take(a, b)
    return out


def measured(model: dict, lines: list[str], seed: int = 70) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind's additions on personal data and look-alikes that training didn't see."""
    counts = {k: [0, 0, 0] for k in KINDS}
    for text, kind, at, end, label in {m[:1] + m[1:] for m in _made_up(lines, seed)}:
        hit = (kind, at, end) in added_spans(text, [], model)
        counts[kind] = [counts[kind][0] + (hit and label), counts[kind][1] + hit, counts[kind][2] + label]
    return {k: (good / max(1, all_), good / max(1, true)) for k, (good, all_, true) in counts.items()}


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(df: DataFrame, model: dict, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with ``base`` and ``added``: arrays of (kind, start, end) in code points, end exclusive."""
    left = [f for f in df.schema if f.name not in ("base", "added") and (keep_text or f.name != text)]
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, text):
            base, added = [], []
            for t in x.column(text).to_pylist():
                base.append(b := base_spans(t or ""))
                added.append(added_spans(t or "", b, model))
            arrays = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in v] for v in spans], arrow) for spans in (base, added)]
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in left), *arrays], names=[*(f.name for f in left), "base", "added"])

    return df.mapInArrow(run, T.StructType([*left, T.StructField("base", SPAN), T.StructField("added", SPAN)]))


def redact(df: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """df, as find() returns it, with the chosen spans replaced by their kind in brackets; of overlapping spans the first wins."""
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["e"]).alias("at"), F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("text")))
    return df.withColumn(out, F.aggregate(order, none, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text)))))
