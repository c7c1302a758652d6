"""Quality rules: text counts, and line labelling by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import WORD, scan, smallest_hashed, stage

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ODD = "#*$%&|<>{}[]_=~^\\@/+"
DIGITS = "0123456789"
#: Words that navigation, notices and footers use; a hint among others, in four languages.
CHROME = re.compile(r"\b(?:cookies?|copyright|login|log in|sign (?:in|up)|subscribe|newsletter|menu|home|click here|read more|privacy|terms of|all rights reserved|share|impressum|datenschutz|mentions légales|aviso legal)\b|©", re.I)

FEATURES = (
    "bias", "words_1_2", "words_3_5", "words_16_on", "odd_10", "odd_50", "shout", "upper_50", "ends_sentence", "seen_before", "few_distinct", "digits_20", "short_chrome", "long_words", "pipes",
    "first_line", "last_line", "only_line", "words_6_12", "after_short", "before_short",
)
#: Lines of one chain of the fit; a longer text gives several chains.
CHAIN = 256
#: What a line's weak label allows: boilerplate alone, content alone, or either.
BOILERPLATE, CONTENT, EITHER = 1, 2, 3


@dataclass(frozen=True)
class LineModel:
    """Weights of the field: ``emit[feature, label]`` and ``move[label, next label]``; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray


def repeat_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == n:
        return 0
    a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    if len(ids) < 1 << 15:
        k = a[:-3] << 45 | a[1:-2] << 30 | a[2:-1] << 15 | a[3:]
    else:
        two = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
        k = two[:-2] * n + two[2:]
    four = np.unique(k, return_inverse=True)[1]
    eight = four[:-4] * n + four[4:]
    order = np.argsort(eight, kind="stable")
    s = eight[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    at = order[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_features(lines: list[list[str]], raw: list[str]) -> np.ndarray:
    """Binary features of each non-blank line of a text: its words, its raw form and its place."""
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    seen: set[str] = set()
    last = len(lines) - 1
    for i, (words, line) in enumerate(zip(lines, raw)):
        n, size = len(words), max(len(line), 1)
        odd = sum(map(line.count, ODD)) / n
        out[i] = (
            1, n <= 2, 3 <= n <= 5, n >= 16, odd > 0.1, odd > 0.5, line.count("!!") / n > 0.1, sum(map(str.isupper, words)) > 0.5 * n,
            line.rstrip()[-1:] in ".!?…\"”»" and odd <= 0.1, line in seen, n >= 8 and len(set(words)) < 0.5 * n,
            sum(map(line.count, DIGITS)) > 0.2 * size, n <= 12 and bool(CHROME.search(line)), size > 14 * n, line.count("|") > 0.1 * n,
            i == 0, i == last, last == 0, 6 <= n <= 12, i > 0 and len(lines[i - 1]) <= 12, i < last and len(lines[i + 1]) <= 12,
        )
        seen.add(line)
    return out


def split_lines(text: str) -> tuple[list[list[str]], list[str]]:
    """The lines that hold a word, as words and raw."""
    found = [(w, line) for line in text.split("\n") if (w := WORDS.findall(line))]
    return [w for w, _ in found], [line for _, line in found]


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best label sequence for emission scores of two labels; ties go to content."""
    if not len(scores):
        return []
    b, c = scores[0]
    bb, bc, cb, cc = move[0, 0], move[0, 1], move[1, 0], move[1, 1]
    back = []
    for eb, ec in scores[1:].tolist():
        from_b, from_c = b + bb > c + cb, b + bc > c + cc
        back.append((0 if from_b else 1, 0 if from_c else 1))
        b, c = (b + bb if from_b else c + cb) + eb, (b + bc if from_c else c + cc) + ec
    labels = [0 if b > c else 1]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def weak_labels(features: np.ndarray, lines: list[str], quality: int, shared: frozenset[int]) -> np.ndarray:
    """What each line of a labelled text may be.

    A line that other texts hold between other lines is boilerplate.  Of the others, a sentence
    of six words or more without odd signs is content in a good text and open in a poor one;
    what is no such sentence is open in a good text and boilerplate in a poor one.
    """
    import xxhash

    f = dict(zip(FEATURES, features.T > 0))
    plain = f["ends_sentence"] & ~(f["words_1_2"] | f["words_3_5"] | f["upper_50"] | f["shout"] | f["few_distinct"])
    out = np.where(plain, CONTENT if quality == 1 else EITHER, EITHER if quality == 1 else BOILERPLATE)
    met = np.array([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) in shared for line in lines], bool)
    return np.where(met, BOILERPLATE, out) if len(lines) else out


def sums(score: np.ndarray, move: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z of every chain, the marginals of labels and of neighbouring labels, by the forward-backward algorithm."""
    steps = score.shape[1]
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[:, 0] = score[:, 0]
    for k in range(1, steps):
        both = alpha[:, k - 1, :, None] + move
        alpha[:, k] = np.where(live[:, k, None], score[:, k] + np.logaddexp(both[:, 0], both[:, 1]), alpha[:, k - 1])
    for k in range(steps - 2, -1, -1):
        both = move + (score[:, k + 1] + beta[:, k + 1])[:, None, :]
        beta[:, k] = np.where(live[:, k + 1, None], np.logaddexp(both[..., 0], both[..., 1]), 0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.exp(alpha + beta - z[:, None, None]) * live[..., None]
    pairs = live[:, 1:] & live[:, :-1]
    two = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (score + beta)[:, 1:, None, :] - z[:, None, None, None], 0)) * pairs[..., None, None]
    return z, one, two


def likelihood(emit: np.ndarray, move: np.ndarray, batches: list[tuple[np.ndarray, ...]], l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log likelihood of what the weak labels allow, and its gradients.

    It is log Z over the allowed label sequences less log Z over all, so open lines are summed out.
    """
    value = -0.5 * l2 * ((emit**2).sum() + (move**2).sum())
    d_emit, d_move = -l2 * emit, -l2 * move
    for x, closed, live, weight in batches:
        score = x @ emit
        z, one, two = sums(score, move, live)
        z_in, one_in, two_in = sums(score + closed, move, live)
        value += float(weight @ (z_in - z))
        d_emit = d_emit + np.einsum("i,itf,itl->fl", weight, x, one_in - one, optimize=True)
        d_move = d_move + np.einsum("i,itab->ab", weight, two_in - two)
    return value, d_emit, d_move


def padded(chains: list[tuple[np.ndarray, np.ndarray, float]]) -> list[tuple[np.ndarray, ...]]:
    """Chains of like lengths in arrays: features, penalties of what is not allowed, live lines, weights."""
    chains = sorted((c for c in chains if len(c[0])), key=lambda c: len(c[0]))
    out = []
    while chains:
        steps = 2 * len(chains[0][0])
        n = max(1, sum(len(c[0]) <= steps for c in chains))
        part, chains = chains[:n], chains[n:]
        steps = len(part[-1][0])
        x, closed, live = np.zeros((n, steps, len(FEATURES))), np.zeros((n, steps, 2)), np.zeros((n, steps), bool)
        for i, (f, may, _) in enumerate(part):
            x[i, : len(f)], live[i, : len(f)] = f, True
            closed[i, : len(f), 0], closed[i, : len(f), 1] = np.where(may & BOILERPLATE, 0, -1e9), np.where(may & CONTENT, 0, -1e9)
        out.append((x, closed, live, np.array([w for *_, w in part])))
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 100, rate: float = 0.1, l2: float = 1e-3) -> LineModel:
    """Gradient ascent on ``likelihood``; ``texts`` holds features, what is allowed, and the quality of each text.

    Both qualities weigh alike, however rare one is, and so do the texts of one quality.
    """
    texts = [t for t in texts if len(t[0])]
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    if not texts:
        emit[0, 1] = 1.0
        return LineModel(emit, move)
    many = {y: sum(t[2] == y for t in texts) for y in {t[2] for t in texts}}
    chains = [(f[k : k + CHAIN], may[k : k + CHAIN], 0.5 / many[y] / len(f)) for f, may, y in texts for k in range(0, len(f), CHAIN)]
    batches = padded(chains)
    first, second = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for t in range(1, rounds + 1):
        _, *grads = likelihood(emit, move, batches, l2)
        for k, (w, g) in enumerate(zip((emit, move), grads)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w += rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return LineModel(emit, move)


def shared_lines(texts: DataFrame, of: DataFrame) -> DataFrame:
    """``_line`` (hash), of the lines of ``of._text``, that stand in ``texts._text`` in three or more contexts
    (line before and line after), and in at least half as many contexts as places.

    So a line that copies of one text share is none.  Counts cover all of ``texts``.
    """

    def lines(df: DataFrame) -> Column:
        return F.transform(F.filter(F.split(F.coalesce("_text", F.lit("")), "\n"), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))

    wanted = stage(of.select(F.explode(lines(of)).alias("_line")).distinct(), "sample-lines")
    own = texts.select(lines(texts).alias("_l"))
    none = F.array(F.lit(None).cast("long"))
    before = F.when(F.size("_l") > 0, F.concat(none, F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0)))))
    after = F.when(F.size("_l") > 0, F.concat(F.slice("_l", 2, F.size("_l")), none))
    met = own.select(F.explode(F.arrays_zip("_l", before.alias("b"), after.alias("a"))).alias("_x")).select(F.col("_x._l").alias("_line"), F.xxhash64("_x.b", "_x.a").alias("_near"))
    met = met.join(wanted, "_line", "left_semi").groupBy("_line", "_near").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("_line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_nears")).filter("_nears >= 3 and 2 * _nears >= n").select("_line")


def train_line_model(docs: DataFrame, labels: DataFrame, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Fit the field on the whole texts of at most ``sample`` labelled ids (those with the smallest hashes).

    ``labels`` has ``id_col`` and ``quality``, 1 for good; an id labelled more than once has its
    least label, and of rows that share an id the least text counts.  Lines are labelled weakly
    (``weak_labels``), by the counts of ``shared_lines`` over all of ``docs``.  The driver receives
    one integer for each line of the sample.  Without any labelled text, all lines count as content.
    """
    y = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_y"))
    # The sample is drawn from the labels alone, and only its texts are fetched.
    y = smallest_hashed(y, sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = stage(texts.join(F.broadcast(y), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")), "line-sample")
    shared = frozenset(r[0] & ((1 << 64) - 1) for r in shared_lines(texts, found).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 1 << np.arange(len(FEATURES))
        for batch in batches:
            rows = []
            for text, quality in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, raw = split_lines(text or "")
                f = line_features(words, raw)
                rows.append(((f > 0) @ bits << 2 | weak_labels(f, raw, quality, shared)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["_y", "lines"])

    rows = scan(found.select("_text", "_y"), run, "_y int, lines array<long>").collect()
    held = []
    for r in sorted(rows):
        code = np.array(r["lines"], np.int64)
        held.append(((code[:, None] >> (2 + np.arange(len(FEATURES))) & 1).astype(float), code & 3, r["_y"]))
    return fit(held)


def judge(text: str, model: LineModel, min_share: float) -> tuple[int, int, int, int, int, bool, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content share, kept."""
    lines, raw = split_lines(text)
    words = [w for line in lines for w in line]
    n = len(words)
    repeats = repeat_words(words)
    dup = len(raw) - len(set(raw))
    failed = n < 20 or 100 * repeats > 30 * n
    labels = viterbi(line_features(lines, raw) @ model.emit, model.move)
    content = sum(len(line) for line, k in zip(lines, labels) if k)
    share = content / n if n else 0.0
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeats, failed, share, not failed and share >= min_share


def rate_documents(docs: DataFrame, model: LineModel, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts over its whole text and the verdict.

    Viterbi decoding labels each line content or boilerplate; a text is kept if it does
    not fail the base rules (under 20 words, or over 30 % of words in repeated 8-word
    windows) and at least ``min_share`` of its words stand in content lines.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share``.  A null text counts as empty: zeros, failed, not
    kept.  Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(judge(t or "", model, min_share) for t in batch.column(1).to_pylist()))) or [()] * 8
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    out = scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, schema)
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def drop_low_quality(docs: DataFrame, model: LineModel, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text ``rate_documents`` would keep, all columns unchanged, in one scan.

    A null, empty or blank text goes.  Repeated rows stay or go together, an empty table gives no
    rows, and columns of any name pass through.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(t or "", model, min_share)[-1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return scan(docs, run, docs.schema)
