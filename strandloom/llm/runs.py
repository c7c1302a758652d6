"""Periodic runs of words: one grammar over many texts, runs at its boundaries, their places in every text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandloom.llm.common import WORD, scan

#: Words of the texts that share one grammar; a longer text has one of its own.
GROUP_WORDS = 1 << 18
#: Pairs of places that are compared in one go.
PAIRS = 1 << 20
#: Words compared one by one before hashes are.
NEAR = 8
#: Two primes and bases of the hashes that compare stretches of words.
HASHES = ((2147483647, 1000003), (2147483629, 69069))

Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Grammar:
    """Symbols below ``terminals`` are words, the others stand for two symbols each.

    ``length`` and ``first`` hold for all symbols how many words one spells and where it does so
    first; ``left`` and ``right`` hold the two parts of each nonterminal, which are older than it.
    """

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    first: np.ndarray
    roots: np.ndarray


def _frequent(seq: np.ndarray, live: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The places of pairs to replace, and the pair's number at each; None when no pair repeats.

    Of pairs that overlap, the more frequent is replaced, as Re-Pair would do first; of a pair
    that overlaps itself every second one.  So one round replaces many pairs.  ``live`` marks places
    whose pair may repeat: one that does not repeat never will, so it is not counted again.
    """
    place = np.flatnonzero(live)
    pair, which, count = np.unique(seq[place] * symbols + seq[place + 1], return_inverse=True, return_counts=True)
    rank = np.empty(len(pair), np.int64)
    rank[np.lexsort((pair, count))] = np.arange(len(pair))
    rank[count < 2] = -1
    live[place[rank[which] < 0]] = False
    # Stretches of neighbours with one pair: a a a a holds the pair (a, a) three times.
    here = rank[which]
    new = np.r_[True, (here[1:] != here[:-1]) | (place[1:] != place[:-1] + 1)][: len(here)]
    start = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    top, first, last = here[start], place[start], place[np.r_[start[1:], len(here)][: len(start)] - 1]
    before = np.r_[-1, np.where(first[1:] == last[:-1] + 1, top[:-1], -1)][: len(top)]
    after = np.r_[np.where(first[1:] == last[:-1] + 1, top[1:], -1), -1][-len(top) :] if len(top) else top
    wins = (top >= 0) & (top > before) & (top > after)
    chosen = wins[stretch] & ((place - first[stretch]) % 2 == 0)
    many = np.bincount(which[chosen], minlength=len(pair)) >= 2
    chosen &= many[which]
    return (place[chosen], which[chosen]) if chosen.any() else None


def build_grammar(words: np.ndarray, text: np.ndarray) -> Grammar:
    """Re-Pair over the word numbers of several texts (``text``: the text of each word, from 0, none empty).

    Rounds replace repeated pairs by new symbols until none repeats; what is left of each text
    is paired up in a balanced way, so every text is one symbol.
    """
    terminals = int(words.max()) + 1
    first = np.empty(terminals, np.int64)
    first[words[::-1]] = np.arange(len(words))[::-1]
    lefts, rights, lengths, firsts = [], [], [np.ones(terminals, np.int64)], [first]
    seq, at, span, own = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64), text
    symbols, live = terminals, np.r_[own[1:] == own[:-1], False]
    while len(seq) > own[-1] + 1:
        found = _frequent(seq, live, symbols) if live.any() else None
        if found is None:
            live[:] = False
            same = own[1:] == own[:-1]
            start = np.flatnonzero(np.r_[True, ~same])
            place = np.arange(len(seq)) - start[own]
            chosen = np.flatnonzero((place[:-1] % 2 == 0) & same)
            number = np.arange(len(chosen))
        else:
            chosen, number = found
        _, once, number = np.unique(number, return_index=True, return_inverse=True)
        lead = chosen[once]
        lefts.append(seq[lead])
        rights.append(seq[lead + 1])
        lengths.append(span[lead] + span[lead + 1])
        firsts.append(at[lead])
        seq[chosen] = symbols + number
        span[chosen] += span[chosen + 1]
        symbols += len(lead)
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        if found is not None:
            live[chosen] = live[chosen - (chosen > 0)] = True
        seq, at, span, own, live = seq[keep], at[keep], span[keep], own[keep], live[keep]
        live &= np.r_[own[1:] == own[:-1], False]
    none = [np.empty(0, np.int64)]
    return Grammar(terminals, np.concatenate(lefts or none), np.concatenate(rights or none), np.concatenate(lengths), np.concatenate(firsts), seq)


class Matcher:
    """How far two places of a sequence of words agree."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.sums, self.powers = words, [], []
        value = words.astype(np.uint64) + np.uint64(1)
        for p, base in HASHES:
            power = np.ones(len(words) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):  # doubling: the next stretch is the one before, times base ** done
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * np.uint64(step) % np.uint64(p)
                done, step = done + more, step * step % p
            self.powers.append(power)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(value * power[:-1] % np.uint64(p), dtype=np.uint64)])

    def equal(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        """Whether the ``n`` words from each of ``x`` are those from ``y``, where x < y."""
        out = np.ones(len(x), bool)
        for (p, _), sums, powers in zip(HASHES, self.sums, self.powers):
            mod = np.uint64(p)
            out &= (sums[x + n] - sums[x]) % mod * powers[y - x] % mod == (sums[y + n] - sums[y]) % mod
        return out

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from ``x`` and ``y`` on, ``most`` at most; with ``step`` -1 how many before them."""
        n = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        for k in range(NEAR):
            at = k if step > 0 else -k - 1
            live = live[self.words[x[live] + at] == self.words[y[live] + at]]
            n[live] += 1
            live = live[most[live] > n[live]]
            if not len(live):
                return n
        for bit in range(int(most[live].max()).bit_length() - 1, -1, -1):
            fits = live[n[live] + (1 << bit) <= most[live]]
            from_ = n[fits] if step > 0 else -n[fits] - (1 << bit)
            n[fits[self.equal(x[fits] + from_, y[fits] + from_, 1 << bit)]] += 1 << bit
        return n


def _slices(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose counts sum to ``PAIRS`` at most, or of one."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi


def boundary_runs(words: np.ndarray, g: Grammar, least: int) -> Spans:
    """``symbol, start, end, period`` of the runs that cross the boundary of each nonterminal's two parts, inside it.

    A run of length 2 q or more holds q words before or after the boundary, so the last word
    before it or the first one after it stands again q further inside: only these places are
    compared, and by how far they agree on both sides.
    """
    node = np.flatnonzero(g.length >= least)
    node = node[node >= g.terminals]
    lo, hi = g.first[node], g.first[node] + g.length[node]
    cut, half = lo + g.length[g.left[node - g.terminals]], g.length[node] // 2
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    spots = words[order].astype(np.int64) * n + order
    match = Matcher(words)
    out: list[tuple[np.ndarray, ...]] = []
    for after in (True, False):
        anchor = cut - 1 if after else cut
        if after:
            begin, end = rank[anchor] + 1, np.searchsorted(spots, words[anchor] * n + np.minimum(hi - 1, anchor + half), "right")
        else:
            begin, end = np.searchsorted(spots, words[anchor] * n + np.maximum(lo, anchor - half), "left"), rank[anchor]
        count = np.maximum(end - begin, 0)
        for a, b in _slices(count):
            c = count[a:b]
            k = np.repeat(np.arange(a, b), c)
            other = order[np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c) + begin[k]]
            x, y = (anchor[k], other) if after else (other, anchor[k])
            q = y - x
            right = 1 + match.common(x + 1, y + 1, hi[k] - 1 - y, 1)
            need = np.maximum(least - q, q)
            sure = right + (x - lo[k]) >= need  # else even a match to the symbol's start is too short
            k, x, y, q, right, need = k[sure], x[sure], y[sure], q[sure], right[sure], need[sure]
            left = match.common(x, y, x - lo[k], -1)
            good = left + right >= need
            out.append((node[k[good]], (x - left)[good] - lo[k[good]], (y + right)[good] - lo[k[good]], q[good]))
    symbol, start, end, period = (np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64),) * 4
    by = np.lexsort((period, end, start, symbol))
    symbol, start, end, period = symbol[by], start[by], end[by], period[by]
    # A stretch has its periods' multiples too: the least one counts.
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return symbol[new], start[new], end[new], period[new]


def text_runs(g: Grammar, begin: np.ndarray, runs: Spans) -> Spans:
    """``text, start, end, period`` of all runs of all texts, by text, start and period.

    Walks down from the texts' symbols to those that hold runs, level by level, and keeps of
    the stretches of one period that lie in each other the longest.
    """
    symbol, start, end, period = runs
    lo = np.searchsorted(symbol, np.arange(len(g.length)))
    hi = np.searchsorted(symbol, np.arange(len(g.length)), "right")
    holds = hi > lo
    inner = np.arange(g.terminals, len(g.length))
    while True:
        more = inner[~holds[inner] & (holds[g.left[inner - g.terminals]] | holds[g.right[inner - g.terminals]])]
        if not len(more):
            break
        holds[more] = True
    text = np.flatnonzero(holds[g.roots])
    at, frontier, out = begin[text], g.roots[text], []
    while len(frontier):
        n = hi[frontier] - lo[frontier]
        k = np.repeat(lo[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append((np.repeat(text, n), np.repeat(at, n) + start[k], np.repeat(at, n) + end[k], period[k]))
        nonterminal = frontier >= g.terminals
        text, at, frontier = text[nonterminal], at[nonterminal], frontier[nonterminal]
        left, right = g.left[frontier - g.terminals], g.right[frontier - g.terminals]
        text, at, frontier = np.r_[text, text], np.r_[at, at + g.length[left]], np.r_[left, right]
        text, at, frontier = text[holds[frontier]], at[holds[frontier]], frontier[holds[frontier]]
    if not out:
        return (np.empty(0, np.int64),) * 4
    text, start, end, period = (np.concatenate(v) for v in zip(*out))
    by = np.lexsort((-end, start, period, text))
    text, start, end, period = text[by], start[by], end[by], period[by]
    group = np.cumsum(np.r_[True, (text[1:] != text[:-1]) | (period[1:] != period[:-1])])
    reach = group * (int(end.max()) + 1) + end
    keep = np.r_[True, reach[1:] > np.maximum.accumulate(reach)[:-1]]
    text, start, end, period = text[keep], start[keep], end[keep], period[keep]
    by = np.lexsort((period, start, text))
    return text[by], start[by] - begin[text[by]], end[by] - begin[text[by]], period[by]


def runs_of(texts: list[list[str]], least: int) -> list[list[tuple[int, int, int]]]:
    """Of each text's words the (start, length, period) of all runs."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    held = [i for i, words in enumerate(texts) if len(words) >= least]
    if not held:
        return out
    size = np.array([len(texts[i]) for i in held])
    words, _ = pd.factorize(np.array([w for i in held for w in texts[i]], dtype=object))
    g = build_grammar(words, np.repeat(np.arange(len(held)), size))
    for t, s, e, q in zip(*(v.tolist() for v in text_runs(g, np.cumsum(size) - size, boundary_runs(words, g, least)))):
        out[held[t]].append((s, e - s, q))
    return out


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by single spaces."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join(np.array(words, dtype=object)[np.cumsum(change[:-1]) == 0].tolist())


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs, collapsed``: all periodic runs of every text, and the text without their repeats.

    ``runs`` lists ``start`` (word number), ``length`` and ``period`` by start, then period: the
    stretches of ``least`` words or more, and of two periods or more, whose words one smallest
    period apart are equal and that no neighbouring word extends.  ``collapsed`` leaves out words
    that stand in a run after its first period.  Texts that reach a task together share a grammar; the
    result does not depend on which do.  Nothing is shuffled.

    A null, empty or blank text has no words, no runs and an empty text.  Repeated rows are given
    each, ids may be null, an empty table gives no rows, and other columns are ignored.
    """
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([docs.schema[id_col], StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    pattern, kind = re.compile(WORD), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[list[str]]]]:
        texts, held, lo = [], 0, 0
        for i, text in enumerate(batch.column(1)):
            words = pattern.findall(text.as_py() or "")
            if texts and held + len(words) > GROUP_WORDS:
                yield batch.column(0).slice(lo, i - lo), texts
                texts, held, lo = [], 0, i
            texts.append(words)
            held += len(words)
        if texts:
            yield batch.column(0).slice(lo), texts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in groups(batch):
                runs = runs_of(texts, least)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
                cut = [collapse(words, own) for words, own in zip(texts, runs)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, kind), pa.array(cut, pa.string())], ["c0", "c1", "c2", "c3"])

    return scan(docs.select(F.col(id_col), F.col(text_col).cast("string")), find, schema)
