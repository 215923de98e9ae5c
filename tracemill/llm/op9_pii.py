"""Personal data: fixed patterns, and more spans by boosted trees over candidates.

Base spans come from four patterns with their checks (parts of an IP address, Luhn, number of digits). A base match
that fails its check is dropped whole, so a number that stands beside another one is lost, and written-out forms are
never met. High-recall generators therefore propose looser spans, which may overlap: mail addresses with "(at)" or
"[at]", dotted numbers with marked dots, and every stretch of groups of digits whose number of digits fits a kind.
Boosted trees score them by format (digits, groups, separators, checks) and context (signs and words beside them),
and a threshold per kind, calibrated on held-out documents, selects which to add. Base spans always stay.

The trees are trained here on a bounded sample: TRAIN_DOCS doc_ids of smallest hash among texts with a digit or @ and
at most TRAIN_CHARS characters, one row each, and MOST_A_DOC examples (smallest hashes) of each. No example is a base
span as it stands. Positives: base spans rewritten in their place (``rewritten``), and candidates that the base rule
takes when they stand alone. Negatives: look-alikes put in the place of base spans (``lookalikes``: versions, dates,
keys, part numbers) and all other candidates outside of base spans. Documents are split by a hash of doc_id: two of
three train, the third calibrates. A kind with fewer than LEAST_HELD held-out positives, or none of whose scores
reaches PRECISION, adds nothing.

Null and empty texts have no spans; very long texts are searched whole; rows with equal doc_ids each give a row;
other columns are left out (``redacted_documents`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, only, slices, table, text_bytes

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 3000
TRAIN_CHARS = 20_000
MOST_A_DOC = 40
LEAST_HELD = 20
PRECISION = 0.99
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(dot\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])")
_NUMBERS = re.compile(r"[0-9]+(?:[ ().\-/]{1,3}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_HINTS = (re.compile(r"card|visa|credit|karte|tarjeta|carte", re.I), re.compile(r"phone|tel|call|fax|mobil", re.I), re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|addr", re.I), re.compile(r"token|key|secret|version|licen[sc]e|isbn|\bid\b|\bno\b", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Matches of the mail pattern. Without an @ ahead there is none, and one starts at the run of signs before its @."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def addresses(text: str):
    """Matches of the IP pattern. Every stretch of digits with single dots is met once; in it each four numbers in turn are a
    match, as the leftmost search takes them. A long run of digits without dots costs no more than its length."""
    for m in _DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            parts, at = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                yield at, end, four
                at = end + 1


def _marked(text: str, spans) -> bytearray:
    """A byte for each character, 1 inside of the spans; a find() in a slice of it tells whether a span is met."""
    marks = bytearray(len(text))
    for a, _, b in spans:
        marks[a:b] = b"\x01" * (b - a)
    return marks


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rule, by start, then kind. Matches that fail their check are dropped."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for start, end, parts in addresses(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((start, 1, end))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the high-recall generators; they may overlap."""
    out = []
    if "@" in text or "(at)" in text.lower() or "[at]" in text.lower():
        out += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in _LOOSE_IP.finditer(text)]
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            n = 0
            for x, b in groups[i:]:
                n += b - x
                if n > 19:
                    break
                if n >= 12:
                    out.append((a, 2, b))
                if 7 <= n <= 15:
                    lead = a
                    while lead and text[lead - 1] in "(+" and a - lead < 2:
                        lead -= 1
                    out.append((lead, 3, b))
    return out


N_FEATURES = 29


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    d = digits_of(s)
    before, after = text[max(0, start - 30) : start], text[end : end + 10]
    parts = [int(p) for p in re.findall("[0-9]+", s)[:5]] if kind == 1 else []
    sizes = [len(g) for g in _GROUP.findall(s)[:6]]
    return [
        kind, len(s), len(d), s.count(" "), s.count("-"), s.count("."), s.count("("), s.startswith("+"), "@" in s, "at)" in s.lower() or "at]" in s.lower(),
        luhn(d) if d else 0, len(parts) == 4 and max(parts) <= 255, len(re.split(r"[.)\] ]", s)[-1]), before[-1:].isalnum(), after[:1].isalnum() or after[:1] == "_",
        s.count("/"), *[bool(h.search(before)) for h in _HINTS],
        len(sizes), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, max(sizes, default=0), min(sizes, default=0), before[-1:] in ("-", ".", "/", "+", "(") and before[-1:] != "",
        after[:1] in ("-", "/") or after[:1] == "." and after[1:2].isdigit(), before[-2:-1].isdigit(),
    ]


def _put(text: str, a: int, b: int, new: str, kind: int, inside: tuple[int, int] | None = None) -> list[float]:
    """Features of ``new`` (or of a part of it) in the place of text[a:b]."""
    lo, hi = inside or (0, len(new))
    return features(text[:a] + new + text[b:], a + lo, kind, a + hi)


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> list[list[float]]:
    """Features of base spans written in ways that the base rule misses, in their place."""
    out = []
    for a, kind, b in spans:
        s = text[a:b]
        d = digits_of(s)
        if kind == 0:
            for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", ".")):
                user, host = s.split("@", 1)
                out.append(_put(text, a, b, user + at + host.replace(".", dot), 0))
                short = ".".join(host.rsplit(".", 2)[-2:])  # a plain name at a short host
                out.append(_put(text, a, b, (re.sub("[^A-Za-z]", "", user) or user) + at + short.replace(".", dot), 0))
        elif kind == 1:
            for dot in ("[.]", " . ", "(dot)"):
                out.append(_put(text, a, b, s.replace(".", dot), 1))
        elif kind == 2:
            for sep in (".", "/", " - "):
                out.append(_put(text, a, b, sep.join(d[i : i + 4] for i in range(0, len(d), 4)), 2))
            out.append(_put(text, a, b, f"{d} {d[:7]}", 2, (0, len(d))))
        else:
            cut = (len(d) - 10, len(d) - 7, len(d) - 4)
            parts = [d[x:y] for x, y in zip((0, *cut), (*cut, len(d)), strict=True) if y > x >= 0]
            for new in ("-".join(parts), ".".join(parts), "+" + "/".join(parts), f"({parts[-3]}) {parts[-2]}-{parts[-1]}" if len(parts) > 2 else "-".join(parts)):
                out.append(_put(text, a, b, new, 3))
            out.append(_put(text, a, b, f"{s} {d}{d[:7]}", 3, (0, len(s))))
    return out


def lookalikes(text: str, spans: list[tuple[int, int, int]]) -> list[list[float]]:
    """Features of strings that look alike and are no personal data, in the place of base spans."""
    out = []
    for a, kind, b in spans:
        d = (digits_of(text[a:b]) or "4821930") * 5
        long, key = 7 + sum(map(int, d[:5])) % 9, 12 + sum(map(int, d[:5])) % 8
        out += [_put(text, a, b, f"a{d[:long]}c", 3, (1, long + 1)), _put(text, a, b, f"x{d[:key]}f", 2, (1, key + 1))]
        if kind == 0:
            out.append(_put(text, a, b, f"{d[:2]} [at] {d[2]}.{d[3]}", 0))
        elif kind == 1:
            out += [_put(text, a, b, f"{d[0]}.{d[1]}.{d[2]}.{d[3]}.{d[4]}", 1, (0, 7)), _put(text, a, b, f"{d[:3]}.9{d[3:5]}.{d[5]}.{d[6]}", 1)]
        elif kind == 2:
            wrong = next(w for w in (d[:15] + str(k) for k in range(10)) if not luhn(w))
            out += [_put(text, a, b, wrong, 2), _put(text, a, b, f"ISBN 978-{d[0]}-{d[1:5]}-{d[5:9]}-{d[9]}", 2, (5, 22))]
        else:
            day = f"20{d[:2]}-0{d[2]}-1{d[3]} 1{d[4]}"
            out += [_put(text, a, b, day, 3), _put(text, a, b, f"{day[:10]}", 3), _put(text, a, b, f"no {d[:9]}", 3, (3, 12)), _put(text, a, b, f"{d[:7]}", 3)]
    return out


def examples(text: str) -> list[tuple[list[float], bool]]:
    """Training examples of a text, none of them a base span as it stands."""
    base = base_spans(text)

    def alone(a: int, k: int, b: int) -> bool:
        apart = not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum() and text[b : b + 1] != "_"
        return apart and (0, k, b - a) in base_spans(text[a:b])

    met = _marked(text, base)
    free = [c for c in candidates(text) if met.find(1, c[0], c[2]) < 0]
    return [(features(text, *c), alone(*c)) for c in free] + [(f, True) for f in rewritten(text, base)] + [(f, False) for f in lookalikes(text, base)]


def grow_tree(x: np.ndarray, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], depth: int, ridge: float = 1.0):
    """A regression tree on gradients, from histograms: nested (feature, limit, left, right) or a leaf's value.

    ``codes``: for every feature, how many of its ``edges`` lie below each value.
    """
    g, h = grad.sum(), hess.sum()
    best = (1e-6, None)
    if depth:
        for f, cuts in enumerate(edges):
            gl = np.cumsum(np.bincount(codes[:, f], grad, len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[:, f], hess, len(cuts) + 1))[:-1]
            gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
            gain[np.minimum(hl, h - hl) < 1] = 0
            i = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[i] > best[0]:
                best = (float(gain[i]), (f, i))
    if best[1] is None:
        return float(g / (h + ridge))
    f, i = best[1]
    left = codes[:, f] <= i
    return f, float(edges[f][i]), *[grow_tree(x[p], codes[p], grad[p], hess[p], edges, depth - 1) for p in (left, ~left)]


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, c, low, high = tree
    left = x[:, f] <= c
    out = np.empty(len(x))
    out[left], out[~left] = tree_values(low, x[left]), tree_values(high, x[~left])
    return out


class Boosted:
    def __init__(self, trees: list, base: float, limits: list[float], rate: float = 0.3):
        self.trees, self.base, self.limits, self.rate = trees, base, limits, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((tree_values(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 40, depth: int = 4, precision: float = PRECISION) -> Boosted:
    """Logistic boosting on the rows that are not ``held``; on those, each kind's threshold is the least score from
    which on the share of positives is ``precision`` (a kind with too few positives there adds nothing)."""
    a = ~held
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 0.97, 24))) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    share = np.clip(y[a].mean() if a.any() else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted([], float(np.log(share / (1 - share))), [np.inf] * len(KINDS))
    score = np.full(a.sum(), model.base)
    for _ in range(rounds if a.any() else 0):
        p = 1 / (1 + np.exp(-score))
        t = grow_tree(x[a], codes[a], y[a] - p, p * (1 - p), edges, depth)
        model.trees.append(t)
        score += model.rate * tree_values(t, x[a])
    s = model.score(x[held])
    for k in range(len(KINDS)):
        own = x[held][:, 0] == k
        if y[held][own].sum() >= LEAST_HELD:
            order = np.argsort(-s[own], kind="stable")
            ranked, truth = s[own][order], y[held][own][order]
            last = np.append(ranked[1:] != ranked[:-1], True)
            good = np.flatnonzero(last & (np.cumsum(truth) >= precision * np.arange(1, len(truth) + 1)))
            if len(good):
                model.limits[k] = max(float(ranked[good[-1]]), 0.0)
    return model


def added_spans(text: str, base: list[tuple[int, int, int]], model: Boosted | None) -> list[tuple[int, int, int]]:
    """Selected candidates that overlap no base span, the best first where they overlap each other."""
    if model is None:
        return []
    met = _marked(text, base)
    free = [c for c in candidates(text) if met.find(1, c[0], c[2]) < 0]
    if not free:
        return []
    s = np.concatenate([model.score(np.array([features(text, *c) for c in free[i : i + 20_000]], float)) for i in range(0, len(free), 20_000)])
    out = []
    for i in sorted(range(len(free)), key=lambda i: (-s[i], free[i])):
        start, kind, end = free[i]
        if s[i] >= model.limits[kind] and met.find(1, start, end) < 0:
            met[start:end] = b"\x01" * (end - start)
            out.append(free[i])
    return out


_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), ord("@")]] = True


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a digit or an @, or "(at)" or "[at]"; others hold no base span and no candidate."""
    at = np.zeros(len(data), bool)
    if len(data) > 3:
        low = data | 32
        at[:-3] = ((data[:-3] == 40) | (data[:-3] == 91)) & (low[1:-2] == 97) & (low[2:-1] == 116)
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_HOT[data] | at, out=total[1:])
    return np.diff(total[offsets]) > 0


def train(docs: DataFrame, sample: int = TRAIN_DOCS) -> Boosted | None:
    """Trees from examples of at most ``sample`` documents; None where both kinds of example are not met."""
    docs = only(docs, "doc_id", "text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS) & F.col("doc_id").isNotNull())
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = sorted(((np.array(f, "<f4").tobytes(), y) for f, y in examples(v.as_py())), key=lambda r: (hashlib.blake2b(r[0], digest_size=8).digest(), r))[:MOST_A_DOC]
                if rows:
                    yield pa.record_batch([pa.array([i] * len(rows)), pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows])], ["doc_id", "x", "y"])

    # One text a doc_id, however often it is repeated, so at most sample * MOST_A_DOC examples reach the driver.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(run, "doc_id long, x binary, y boolean").withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0).orderBy("doc_id", "x", "y").collect()
    if len({r["y"] for r in got}) < 2:
        return None
    return boost(np.array([np.frombuffer(r["x"], "<f4") for r in got], float), np.array([float(r["y"]) for r in got]), np.array([r["held"] for r in got]))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """Every row: doc_id, numbers of base spans by kind, base_sha256, spans (base and added), n_added."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, 8_000_000):
                own = _suspects(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                counts, sha, spans, more = np.zeros((hi - lo, 4), np.int64), [none] * (hi - lo), [""] * (hi - lo), np.zeros(hi - lo, np.int64)
                for i in np.flatnonzero(own).tolist():
                    text = b.column(1)[lo + i].as_py()
                    base = base_spans(text)
                    for _, k, _ in base:
                        counts[i, k] += 1
                    if base:
                        sha[i] = hashlib.sha256(written(base).encode()).hexdigest()
                    added = added_spans(text, base, model)
                    spans[i], more[i] = written(sorted(base + added)), len(added)
                yield batch(schema, b.column(0).slice(lo, hi - lo), *counts.T, sha, spans, more)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span as [KIND]; overlapping spans become one, named by the first."""
    out, pos, last = [], 0, -1
    for a, k, b in sorted(spans):
        if a < last:
            last = max(last, b)
            pos = max(pos, last)
            continue
        out += [text[pos:a], f"[{KINDS[k].upper()}]"]
        pos = last = b
    return "".join(out) + text[pos:]


def redacted_documents(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """docs with personal data replaced in ``text`` (and ``n_chars`` following it); rows without any are unchanged."""
    at, sizes = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hidden(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(b.column(at))
        new = {}
        for i in np.flatnonzero(_suspects(data, offsets)).tolist():
            text = b.column(at)[i].as_py()
            base = base_spans(text)
            spans = base + added_spans(text, base, model)
            if spans:
                new[i] = redact(text, spans)
        if not new:
            return b
        texts = [new.get(i, v) for i, v in enumerate(b.column(at).to_pylist())]
        b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
        if sizes is None:
            return b
        lengths = [len(new[i]) if i in new else v for i, v in enumerate(b.column(sizes).to_pylist())]
        return b.set_column(sizes, b.schema.field(sizes), pa.array(lengths, b.schema.field(sizes).type))

    def run(batches):
        for b in batches:
            _, offsets = text_bytes(b.column(at))
            for lo, hi in slices(offsets, 2_000_000):
                yield hidden(b.slice(lo, hi - lo))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train(docs))
