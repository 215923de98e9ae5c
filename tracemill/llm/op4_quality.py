"""Quality rules with line sequence labelling.

A linear-chain conditional random field labels every line of a text as content or boilerplate from features of the
line (length, signs, digits, capitals, repeats, marks at its end, whether it is the first or last one); Viterbi
decoding finds the best labels, and the share of visible characters in content lines decides whether the text stays.

The field is trained here, on whole line sequences of a bounded sample: TRAIN_DOCS doc_ids of ``labels`` with the
smallest hashes, one row each; rows of more than TRAIN_LINES lines are not drawn. Line labels come from signals and
the documents' labels only bound them (``line_labels``): a line that stands between different lines in
REPEATS places of the sample is boilerplate; in a document of label 0 so are lines of signs, shouting or repeated words, and all of its lines where none
stands out; any other line is content. So most documents hold both kinds, and the field learns how they follow.
Without labels of both kinds the rules stand alone.

A document stays if its content share reaches SHARE. Statistics cover whole texts, however long; null and empty texts
fail the base rule; rows with equal doc_ids each give a row; other columns are left out (``good_documents`` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, only, slices, table, text_bytes
from .op2_token_counts import words_of
from .wordhash import hash_words, mix

TRAIN_DOCS = 1500
TRAIN_LINES = 128
REPEATS = 3
SHARE = 0.5
MIN_WORDS = 50


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags in each [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOLS, _DIGITS, _UPPER, _ENDS, _BLANK = _table(b"#*$%&|<>"), _table(b"0123456789"), _table(bytes(range(65, 91))), _table(b".!?:;"), _table(b"\t\n\x0b\x0c\r ")
_SHOUT = _table(b"!")
N_FEATURES = 13
#: Columns of the features that ``line_labels`` reads.
_WORDLESS, _SIGN, _CAPITAL, _LOUD, _REPEATED = 1, 4, 6, 7, 9


def measure(data: np.ndarray, offsets: np.ndarray):
    """Base statistics of every text and features of every line.

    Returns a dict of arrays by document (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the line
    features, the visible characters of every line, and for each document the number of lines before it.
    """
    n = len(offsets) - 1
    starts, sizes, first = words_of(data, offsets)
    hashes = hash_words(data, starts, sizes)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    repeated = np.zeros(len(starts), bool)
    if len(starts) > 2:
        whole = owner[2:] == owner[:-2]
        tri = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1] * np.uint64(5) + mix(hashes[2:] + owner[2:].astype(np.uint64))))
        at = np.flatnonzero(whole)
        keys = tri[at]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    repeats = np.append(0, np.cumsum(repeated))
    lead = ((data & 0xC0) != 0x80) & ~_BLANK[data]
    stats = {"n_words": n_words, "word_chars": _sums(lead, offsets), "n_symbols": _sums(_SYMBOLS[data], offsets), "n_repeat_words": np.diff(repeats[first])}

    ends = np.flatnonzero(data == 10)
    # Lines start at every text and after every line end; an empty last line counts too.
    at = np.concatenate([offsets[:-1], ends + 1])
    whose = np.concatenate([np.arange(n), np.searchsorted(offsets, ends, "right") - 1])
    order = np.lexsort((at, whose))
    at, whose = at[order], whose[order]
    stop = np.empty(len(at), np.int64)
    if len(at):
        last = np.append(whose[1:] != whose[:-1], True)
        stop[:-1] = at[1:] - 1
        stop[last] = offsets[whose[last] + 1]
    raw = data.tobytes()
    dup, seen, doc = np.zeros(len(at), bool), set(), -1
    for i, (a, b, d) in enumerate(zip(at.tolist(), stop.tolist(), whose.tolist(), strict=True)):
        if d != doc:
            seen, doc = set(), d
        line = raw[a:b]
        if line in seen:
            dup[i] = True
        else:
            seen.add(line)
    pair = np.stack([at, stop], 1).ravel()

    def per_line(flags):
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[pair[1::2]] - total[pair[::2]]

    visible = per_line(lead)
    w0, w1 = np.searchsorted(starts, at), np.searchsorted(starts, stop)
    words = w1 - w0
    dup &= words > 0
    stats["n_dup_lines"] = np.bincount(whose[dup], minlength=n)
    rep = (repeats[w1] - repeats[w0]) / np.maximum(words, 1)
    tail = np.zeros(len(at), bool)
    some = stop > at
    tail[some] = _ENDS[data[stop[some] - 1]]
    v = np.maximum(visible, 1)
    alone = np.bincount(whose, minlength=n)[whose] == 1
    x = np.stack([
        np.ones(len(at)), words == 0, np.log1p(words) / 3, words < 4, np.minimum(per_line(_SYMBOLS[data]) / np.maximum(words, 1), 1), per_line(_DIGITS[data]) / v,
        per_line(_UPPER[data]) / v, per_line(_SHOUT[data]) / np.maximum(words, 1), dup, rep, tail,
        np.append(True, whose[1:] != whose[:-1])[: len(at)] & ~alone, np.append(whose[1:] != whose[:-1], True)[: len(at)] & ~alone,
    ], 1).astype(np.float64)
    return stats, x, visible, np.searchsorted(whose, np.arange(n + 1))


def _steps(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """First lines of the sequences, the longest one first, and how many of them have a k-th line, for each k."""
    sizes = np.diff(first)
    by_size = np.argsort(-sizes, kind="stable")
    left = sizes[by_size]
    return first[:-1][by_size], np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right").tolist()


def likelihood(x: np.ndarray, first: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Conditional log-likelihood of line labels ``y`` and its gradient, by forward-backward in log space."""
    t, e = w[-4:].reshape(2, 2), np.stack([np.zeros(len(x)), x @ w[:-4]], 1)
    at, live = _steps(first)
    a, b = e.copy(), np.zeros_like(e)
    for k in range(1, len(live)):
        line = at[: live[k]] + k
        a[line] += np.logaddexp(a[line - 1, :1] + t[0], a[line - 1, 1:] + t[1])
    for k in range(len(live) - 1, 0, -1):
        line = at[: live[k]] + k
        c = b[line] + e[line]
        b[line - 1] = np.logaddexp(t[:, 0] + c[:, :1], t[:, 1] + c[:, 1:])
    sizes = np.diff(first)
    ends = first[1:][sizes > 0] - 1
    whole = np.logaddexp(a[ends, 0], a[ends, 1])
    z = np.repeat(whole, sizes[sizes > 0])
    inner = np.ones(len(x), bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    both = np.exp(a[i, :, None] + t + (e + b)[i + 1, None, :] - z[i, None, None]).sum(0).ravel()
    seen = np.bincount(y[i] * 2 + y[i + 1], minlength=4)
    g = np.concatenate([x.T @ (y - np.exp(a[:, 1] + b[:, 1] - z)), seen - both])
    return float(e[np.arange(len(x)), y].sum() + seen @ w[-4:] - whole.sum()), g


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the field from line labels: one row for the lines' features (content against boilerplate), then four
    transitions. Gradient ascent (Adam) on the conditional log-likelihood."""
    w, m, s = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        g = likelihood(x, first, y, w)[1] / max(1, len(x)) - ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w


def line_labels(x: np.ndarray, first: np.ndarray, names: np.ndarray, good: np.ndarray) -> np.ndarray:
    """1 for content and 0 for boilerplate, for every line of documents with labels ``good``; ``names`` are the lines' hashes."""
    doc = np.repeat(np.arange(len(good)), np.diff(first))
    names = names.astype(np.uint64)
    edge = np.append(doc[1:] != doc[:-1], True)
    before = np.where(np.append(True, edge[:-1])[: len(doc)], 0, np.append(names[:1], names[:-1])[: len(doc)])
    after = np.where(edge[: len(doc)], 0, np.append(names[1:], names[:1])[: len(doc)])
    # Places count by their neighbours, so that copies of a whole text are one place of its lines.
    lines, spread = np.unique(np.unique(np.stack([names, before, after], 1), axis=0)[:, 0], return_counts=True)
    shared = np.isin(names, lines[spread >= REPEATS]) & (x[:, _WORDLESS] == 0)
    odd = (x[:, _SIGN] >= 0.3) | (x[:, _CAPITAL] >= 0.6) | (x[:, _LOUD] >= 0.5) | (x[:, _REPEATED] >= 0.5)
    any_odd = np.bincount(doc[odd], minlength=len(good)) > 0
    return np.where(shared | (good[doc] == 0) & (odd | ~any_odd[doc]), 0, 1)


def viterbi(x: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """1 for content and 0 for boilerplate, for every line, by the best sequence of each document."""
    t, e = w[-4:].reshape(2, 2), x @ w[:-4]
    out = np.zeros(len(x), np.int8)
    at, live = _steps(first)
    from_one = np.zeros((len(x), 2), bool)
    score = np.zeros((len(at), 2))
    for k, n in enumerate(live):
        line = at[:n] + k
        if k:
            via = score[:n, :, None] + t
            from_one[line] = via[:, 1] > via[:, 0]
            score[:n] = via.max(1)
        score[:n, 1] += e[line]
    label = (score[:, 1] > score[:, 0]).astype(np.int8)
    for k in range(len(live) - 1, -1, -1):
        n = live[k]
        line = at[:n] + k
        out[line] = label[:n]
        label[:n] = from_one[line, label[:n]]
    return out


def verdicts(data: np.ndarray, offsets: np.ndarray, w: np.ndarray | None, share: float = SHARE):
    stats, x, visible, first = measure(data, offsets)
    n_words, n_repeat = stats["n_words"], stats["n_repeat_words"]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
    label = np.ones(len(x), np.int8) if w is None else viterbi(x, first, w)
    content, total = (np.append(0, np.cumsum(v))[first] for v in (visible * label, visible))
    stats["n_lines"], stats["n_content_lines"] = np.diff(first), np.diff(np.append(0, np.cumsum(label, dtype=np.int64))[first])
    return stats, failed, ~failed & (np.diff(content) >= share * np.diff(total))


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> np.ndarray | None:
    """Fit the field on at most ``sample`` labelled documents; None where the labels are not of both kinds."""
    known = only(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    chosen = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def lines(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            raw = data.tobytes()
            for lo, hi in slices(offsets, 1_500_000):
                base = int(offsets[lo])
                _, x, _, first = measure(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                few = np.flatnonzero(np.diff(first) <= TRAIN_LINES)
                parts = [x[first[i] : first[i + 1]].astype("<f4").tobytes() for i in few]
                names = [b"".join(hashlib.blake2b(line, digest_size=8).digest() for line in raw[offsets[lo + i] : offsets[lo + i + 1]].split(b"\n")) for i in few]
                keep = pa.array(few)
                yield pa.record_batch([b.column(1).slice(lo, hi - lo).take(keep), b.column(2).slice(lo, hi - lo).take(keep), pa.array(parts, pa.binary()), pa.array(names, pa.binary())], ["doc_id", "y", "x", "names"])

    # One row a doc_id, however often it is repeated, so at most ``sample`` rows reach the driver.
    got = rows.select("text", "doc_id", "y").mapInArrow(lines, "doc_id long, y int, x binary, names binary").groupBy("doc_id").agg(F.min(F.struct("y", "x", "names")).alias("r")).orderBy("doc_id").select("r.*").collect()
    if len({r["y"] for r in got}) < 2:
        return None
    xs = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in got]
    x, first = np.concatenate(xs).astype(np.float64), np.append(0, np.cumsum([len(p) for p in xs]))
    names = np.frombuffer(b"".join(bytes(r["names"]) for r in got), "<u8")
    return fit(x, first, line_labels(x, first, names, np.array([r["y"] for r in got])))


def quality(docs: DataFrame, w: np.ndarray | None, share: float = SHARE) -> DataFrame:
    """Statistics and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_content_lines."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in names], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_content_lines", pa.int64())])

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets, 1_500_000):
                stats, failed, kept = verdicts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], w, share)
                yield batch(schema, b.column(0).slice(lo, hi - lo), *[stats[n] for n in names], failed, kept, stats["n_lines"], stats["n_content_lines"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, n_lines long, n_content_lines long")


def good_documents(docs: DataFrame, w: np.ndarray | None, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(place))
            for lo, hi in slices(offsets, 1_500_000):
                _, _, kept = verdicts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], w, share)
                yield b.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
