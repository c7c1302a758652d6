"""Secret scan: fixed patterns, and guess-cost segmentation of values in a credential context."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import scan

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run is the match of [0-9a-f]+, so the length test can be part of it

KEYWORD = r"(?:pass(?:word|wd|phrase|code)|\bpwd|\bpass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|\bauth(?:orization)?)"
#: A name that announces a credential, then blanks and : or = or "is", then the value.  A name of
#: any length is read once, from its start, and nothing is given back, so the time is linear.
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9_-])(?:(?!{KEYWORD})[A-Za-z0-9_-])*+{KEYWORD}[A-Za-z0-9_-]*+"""
    r"""["'`]?[\x20\t]*+(?::=|=>|[:=]|\bis\b)[\x20\t]*+(?:(?:basic|bearer)[\x20\t]+)?["'`]?([^\s"'`,;<>()\[\]{}]+)""",
    re.I | re.A,
)
#: Lower-cased texts without any of these hold no context; a cheap first test.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

# Common passwords and placeholder words, most common first.
COMMON = """password qwerty admin welcome letmein login abc monkey dragon master hello freedom whatever
trustno shadow sunshine princess football baseball superman batman iloveyou love secret access flower hottie
starwars michael jordan jennifer hunter killer soccer george andrew charlie thomas robert daniel jessica
summer winter spring autumn monday friday orange purple yellow silver golden diamond ginger pepper cheese
cookie banana chocolate computer internet server network system database default changeme change test testing
example sample demo guest user root administrator public private temp temporary token key value string none
null true false empty placeholder your enter here insert todo redacted hidden masked removed unknown
company office account manager service client""".split()  # fmt: skip
SHORTEST_WORD = 3
#: Signs that stand for letters; two readings, as "1" is either.
LEET = [str.maketrans("04317@$5!", f"oae{one}tassi") for one in "li"]
# The keys of an English keyboard, row by row, plain and shifted; a row starts half a key right of the one above.
KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", " ASDFGHJKL:\"", " ZXCVBNM<>?")
UNSHIFT = str.maketrans("".join(SHIFTED), "".join(KEYS))
PLACE = {c: (x, y) for y, row in enumerate(KEYS) for x, c in enumerate(row) if c != " "}
SIDES = ((-1, 0), (0, -1), (1, -1), (1, 0), (0, 1), (-1, 1))
N_KEYS, N_SIDES = len(PLACE), sum((x + dx, y + dy) in set(PLACE.values()) for x, y in PLACE.values() for dx, dy in SIDES) / len(PLACE)
YEAR, MONTH, DAY = r"(?:19|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
#: Dates: year first or last, with one separator throughout, or in digits of fixed width without.
DATE = re.compile(
    rf"{YEAR}([-/._]){MONTH}\1{DAY}|{DAY}([-/._]){MONTH}\2(?:{YEAR}|\d\d)|{MONTH}([-/._]){DAY}\3(?:{YEAR}|\d\d)"
    rf"|{YEAR}(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9])|(?:3[01]|[12]\d|0[1-9])(?:1[0-2]|0[1-9])(?:{YEAR}|\d\d)|(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9])(?:{YEAR}|\d\d)"
)
LONGEST_DATE = 10

#: log10 of the guesses of one brute-forced character, by its class.
DIGIT, LETTER, OTHER = 1.0, math.log10(26), math.log10(33)
#: log10 of the guesses of a date, of a separated one, of a year, and of one more segment or doubling.
A_DATE, A_SEPARATED_DATE, A_YEAR, SEGMENT = math.log10(365 * 100), math.log10(365 * 100 * 4), 2.0, math.log10(2)


def ranked_words(path: str | None = None) -> dict[str, int]:
    """Rank of each dictionary word: ``COMMON``, then the words of a tokenizer file in its order of merges.

    ``path`` names a BPE vocabulary in JSON that marks words and ends of words by ``</w>``; a missing one is an
    error, since a poorer dictionary would take common words for secrets.
    """
    words = list(COMMON)
    if path:
        import json

        try:
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
        except FileNotFoundError as e:
            raise ValueError(f"no vocabulary at {path}: name one by the parameter vocabulary, or None for the short list of common words") from e
        words += [w[:-4] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(w for w in words if len(w) >= SHORTEST_WORD and w.isalpha()))}


RANK = ranked_words()
#: A public tokenizer file; its whole words in order of merges are the dictionary of every scan, unless another is named.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
# What stands before the name of a variable in common languages and shells.
HOLDERS = "process env environ os config conf cfg settings self this request req args opts options params props secrets vault var vars local data ctx context app module".split()
#: A reference to a variable is no secret, whatever its name: $NAME, ${NAME}, %NAME%, process.env.NAME, config.name.
REFERENCE = re.compile(rf"\$\{{?[A-Za-z_][A-Za-z0-9_.:-]*\}}?|%[A-Za-z_][A-Za-z0-9_]*%|\{{\{{.*|(?:{'|'.join(HOLDERS)})(?:\??\.[A-Za-z_][A-Za-z0-9_]*)+", re.A)


def char_cost(c: str) -> float:
    return DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER


def capitals(part: str) -> float:
    """log10 of the ways to place the capitals of a word; one bit for the customary ways."""
    up = sum(map(str.isupper, part))
    if not up:
        return 0.0
    down = sum(map(str.islower, part))
    if not down or up == 1 and (part[0].isupper() or part[-1].isupper()):
        return SEGMENT
    return math.log10(sum(math.comb(up + down, k) for k in range(1, min(up, down) + 1)))


def word_cost(part: str, low: str, ranks: dict[str, int], spellings: list[str] | None = None) -> float | None:
    """Of a word, as it stands, reversed, or with signs for letters; null if it is none."""
    best = math.inf
    if rank := ranks.get(low):
        best = math.log10(rank)
    if rank := ranks.get(low[::-1]):
        best = min(best, math.log10(rank) + SEGMENT)
    for spelled in spellings if spellings is not None else [low.translate(t) for t in LEET]:
        if spelled != low and (rank := ranks.get(spelled)):
            best = min(best, math.log10(rank) + SEGMENT * len({a for a, b in zip(low, spelled) if a != b}))
    return None if best == math.inf else best + capitals(part)


def date_cost(part: str) -> float | None:
    if len(part) == 4:
        return A_YEAR if part.isascii() and part.isdigit() and part[:2] in ("19", "20") else None
    if not 6 <= len(part) <= LONGEST_DATE or not DATE.fullmatch(part):
        return None
    return A_DATE if part.isdigit() else A_SEPARATED_DATE


def walk_steps(a: str, b: str) -> tuple[int, int] | None:
    """The step from one key to a neighbouring one; null if they are no neighbours."""
    p, q = PLACE.get(a), PLACE.get(b)
    if p is None or q is None:
        return None
    step = q[0] - p[0], q[1] - p[1]
    return step if step in SIDES else None


def walk_cost(length: int, turns: int, shifted: bool) -> float:
    return math.log10(N_KEYS * length) + turns * math.log10(N_SIDES) + (SEGMENT if shifted else 0)


def repeats_from(low: str, i: int) -> list[tuple[int, int]]:
    """(block length, times) of the blocks that stand at ``i`` twice or more in a row and are no repeats
    themselves, each as often as it follows itself."""
    found: list[tuple[int, int]] = []
    n = len(low)
    at = low.find(low[i], i + 1, i + (n - i) // 2 + 1)
    while at >= 0:
        p = at - i
        if low[at : at + p] == low[i:at] and not any(p % q == 0 and q * times >= p for q, times in found):
            times, block = 2, low[i:at]
            while low.startswith(block, i + p * times):
                times += 1
            found.append((p, times))
        at = low.find(low[i], at + 1, i + (n - i) // 2 + 1)
    return found


def guess_cost(value: str, ranks: dict[str, int] = RANK, bound: float = math.inf, longest: int | None = None, known: dict | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for an empty value.

    Segments are words of ``ranks`` (as they stand, reversed, or with signs for letters), dates
    and years, walks of three or more neighbouring keys, blocks repeated as often as they follow
    themselves or once less, and spans of brute-forced characters; each costs one doubling
    besides.  A cost of ``bound`` or more is given as some number not below it, so that a long
    value costs only what its cheap beginnings do.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    keys = value.translate(UNSHIFT).lower()
    if len(keys) != n:
        keys = low
    longest = max(map(len, ranks), default=0) if longest is None else longest
    known = {} if known is None else known
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    best[0] = 0.0
    furthest = 0  # the last position reached below the bound
    spelled = [x for x in (low.translate(t) for t in LEET) if x != low]
    letters = low.translate(LEET[0])

    def reach(end: int, cost: float) -> None:
        nonlocal furthest
        if cost < best[end]:
            best[end] = cost
            if cost < bound and end > furthest:
                furthest = end

    for i in range(n):
        if i > furthest:
            return math.inf
        if best[i] >= bound:
            continue
        start = best[i] + SEGMENT
        brute[i + 1] = min(brute[i], start) + char_cost(low[i])
        reach(i + 1, brute[i + 1])
        for end in range(i + 1, min(i + longest, n) + 1):
            if not letters[end - 1].isalpha():
                break
            cost = word_cost(value[i:end], low[i:end], ranks, [x[i:end] for x in spelled]) if end - i >= SHORTEST_WORD else None
            if cost is not None:
                reach(end, start + cost)
        if low[i].isdigit():
            for end in range(i + 4, min(i + LONGEST_DATE, n) + 1):
                cost = date_cost(low[i:end])
                if cost is not None:
                    reach(end, start + cost)
        turns, last, shifted, end = 0, None, value[i] != keys[i], i + 1
        while end < n and (step := walk_steps(keys[end - 1], keys[end])):
            turns, last, shifted, end = turns + (step != last), step, shifted or value[end] != keys[end], end + 1
            if end - i >= 3:
                cost = start + walk_cost(end - i, turns, shifted)
                if cost >= bound:
                    break
                reach(end, cost)
        for p, times in repeats_from(low, i):
            block = value[i : i + p]
            if block not in known:
                known[block] = guess_cost(block, ranks, bound, longest, known)
            for k in (times, times - 1):
                if k >= 2:
                    reach(i + p * k, start + known[block] + math.log10(k))
    return best[n]


def find_spans(text: str, min_cost: float = 9.0, min_len: int = 6, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of a text, by start, then by kind as listed in ``KINDS``."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".!?:")
            if len(value) >= min_len and not REFERENCE.fullmatch(value) and guess_cost(value, ranks, min_cost) >= min_cost:
                found.append((m.start(1), m.start(1) + len(value), 3))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, min_cost: float = 9.0, vocabulary: str | None = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with counts and spans of secrets, over the whole text.

    Kinds: ``assign``, ``access`` and ``hex`` are fixed patterns; ``guess`` is a value in a
    credential context of which the cheapest segmentation into words, dates, repeats,
    keyboard walks and brute-forced characters needs at least ``10 ** min_cost`` guesses;
    ``vocabulary`` names a tokenizer file on the driver for the words (``ranked_words``).  A value that
    refers to a variable is none.

    Returns ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_guess``; spans are
    ``kind:start:end`` in code points, end exclusive.  A null text counts as empty: zero
    counts and no spans.  Repeated rows give repeated rows, an empty table none; other
    columns are ignored.
    """

    ranks = ranked_words(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_spans(text or "", min_cost, ranks=ranks)
                base = [x for x in spans if x[2] != "guess"]
                count = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), count[3]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = scan(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
    return out.withColumnRenamed("_id", id_col)


def redact(text: str | None, mark: str = "[SECRET]", min_cost: float = 9.0, ranks: dict[str, int] = RANK) -> str | None:
    """The text with every secret, and what overlaps it, replaced by ``mark``; a null stays null."""
    if not text:
        return text
    out, at = [], 0
    spans = find_spans(text, min_cost, ranks=ranks)
    i = 0
    while i < len(spans):
        start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", min_cost: float = 9.0, vocabulary: str | None = VOCABULARY, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in its text column; every row and column is kept.

    ``length_col``, if present, becomes the code points of the new text where it changed.  Null and
    empty texts stay as they are, repeated rows are changed each, an empty table gives no rows, and
    columns of any name pass through.
    """
    names = docs.columns
    at = names.index(text_col)
    ranks = ranked_words(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t, mark, min_cost, ranks) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if length_col in names:
                k = names.index(length_col)
                kept = batch.column(k).to_pylist()
                cols[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, kept)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return scan(docs, run, docs.schema)
