"""Periodic runs of words, after Kolpakov and Kucherov, and texts without the repeats.

A run is a maximal stretch [a, b) whose words q apart are equal, q being the
smallest such distance.  The words of a stretch are factorised by Lempel and Ziv:
each factor is the longest stretch that also begins earlier, as told by a suffix
automaton's first occurrences, or a new word.  Runs that touch a factor's start
are found by Main's algorithm: for every period, how far it holds to both sides of
that place, from Z functions.  A run that lies strictly inside a factor is a copy
of one inside the factor's earlier occurrence.

Before that, a text is cut down to the stretches that can hold a run: a run of at
least `least` words, three periods or more, is covered by windows of
w = least - least // 3 words, each of which occurs again a period away.  So only
windows whose hash occurs twice in the text are kept, joined where they overlap.
Equal windows have equal hashes, so no run is lost, and each lies in one stretch.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.llm import common

#: Least words of a run, and periods that it has at least.
LEAST, TIMES = 24, 3
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class Automaton:
    """Suffix automaton of a sequence of non-negative integers; each state knows where its strings first end.

    Most states have one way on, which two flat arrays hold; other ways are in a
    dictionary of the state.  It takes some 40 bytes a state, of which there are
    at most two a word.
    """

    def __init__(self, word: list[int]):
        #: Length of the longest string, suffix link, first end; first way on and the others.
        length, link, end = array("i", [0]), array("i", [-1]), array("i", [-1])
        sign, to = array("i", [-1]), array("i", [-1])
        more: dict[int, dict[int, int]] = {}
        last = 0
        for i, c in enumerate(word):
            now = len(length)
            length.append(i + 1), link.append(0), end.append(i), sign.append(-1), to.append(-1)
            p = last
            while p != -1:
                if sign[p] == -1:
                    sign[p], to[p] = c, now
                elif sign[p] == c:
                    q = to[p]
                    break
                else:
                    ways = more.get(p)
                    if ways is None:
                        more[p] = {c: now}
                    elif c in ways:
                        q = ways[c]
                        break
                    else:
                        ways[c] = now
                p = link[p]
            if p != -1:
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1), link.append(link[q]), end.append(end[q]), sign.append(sign[q]), to.append(to[q])
                    if q in more:
                        more[twin] = dict(more[q])
                    while p != -1:
                        if sign[p] == c:
                            if to[p] != q:
                                break
                            to[p] = twin
                        else:
                            ways = more.get(p)
                            if ways is None or ways.get(c) != q:
                                break
                            ways[c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        self.sign, self.to, self.more, self.end = sign, to, more, end

    def factors(self, word: list[int]) -> list[tuple[int, int]]:
        """(start, distance back to an earlier occurrence, 0 for a new word) of each Lempel-Ziv factor; occurrences may overlap."""
        sign, to, more, end = self.sign, self.to, self.more, self.end
        out, i, n = [], 0, len(word)
        while i < n:
            state, at, back = 0, i, 0
            while at < n:
                c = word[at]
                if sign[state] == c:
                    then = to[state]
                else:
                    then = more[state][c]
                first = end[then] - (at - i)  # where the longer string first starts
                if first >= i:
                    break
                state, at, back = then, at + 1, i - first
            out.append((i, back))
            i = max(at, i + 1)
        return out


def z_function(s: list[int], upto: int) -> list[int]:
    """For places 1 to upto - 1, how many items from there on equal the first ones; place 0 has the whole length."""
    n = len(s)
    z = [0] * max(1, min(upto, n))
    z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _touching(word: list[int], x: int, before: int, after: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch place x and end at most `after` later; `before`: length of the factor that ends at x."""
    n = len(word)
    # A run that ends in the factor after x starts less than a period before the factor before x.
    most = (before + after - 1) // (times - 1)
    reach = min(x, before + most + 1)
    left, right = word[x - reach : x], word[x : x + after]
    back = left[::-1]
    short = min(most, reach)
    forward = z_function([*right, -1, *left[reach - short :], *right], after + 1 + short) if right else None
    behind = z_function(back, short + 1)
    found = []
    for q in range(1, short + 1):
        lp = min(forward[after + 1 + short - q], after) if right else 0
        ls = behind[q] if q < len(behind) else 0
        if q + lp + ls >= max(least, times * q):
            found.append((x - q - ls, x + lp, q))
    if right:
        ahead = z_function(right, most + 1)
        both = z_function([*back, -1, *right[: min(most, after)][::-1], *back], reach + 1 + min(most, after))
        for q in range(1, min(most, after) + 1):
            lp = ahead[q] if q < after else 0
            ls = min(both[reach + 1 + min(most, after) - q], reach)
            if q + lp + ls >= max(least, times * q):
                found.append((x - ls, x + q + lp, q))
    for a, b, q in found:
        # Stretches that go on are found, whole, at a later factor's start.
        if (b == n or word[b] != word[b - q]) and (a == 0 or word[a - 1] != word[a - 1 + q]):
            yield a, b, q


def runs(word: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(word) < least:
        return []
    factors = Automaton(word).factors(word)
    n = len(word)
    bounds = [f[0] for f in factors] + [n, n]
    period: dict[tuple[int, int], int] = {}
    at: dict[int, set[int]] = {}
    starts: list[int] = []

    def keep(a: int, b: int, q: int) -> None:
        known = period.get((a, b))
        if known is None:
            if a not in at:
                at[a] = set()
                insort(starts, a)
            at[a].add(b)
        period[a, b] = q if known is None else min(q, known)

    # A run takes part of two factors and less than a period: at most a third of itself more.
    enough = least - least // times
    for i in range(len(factors) + 1):
        x, size = bounds[i], bounds[i + 1] - bounds[i]
        before = x - bounds[i - 1] if i else 0
        if i and before + size > enough:
            for a, b, q in _touching(word, x, before, size, least, times):
                keep(a, b, q)
        if i < len(factors) and (back := factors[i][1]):
            # The earlier occurrence may reach into the factor itself: copies are met again further on.
            k = bisect_left(starts, x - back + 1)
            while k < len(starts) and starts[k] + least < x - back + size:
                a = starts[k]
                for b in [b for b in at[a] if b < x - back + size]:
                    keep(a + back, b + back, period[a, b])
                k += 1
    return sorted((a, b - a, q) for (a, b), q in period.items())


def stretches(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run, from one hash a word."""
    width = least - least // times
    n = len(hashes) - width + 1
    if len(hashes) < least:
        return []
    # A window's hash from those of its powers of two.
    h, have, out = hashes, 1, None
    taken = 0
    while taken < width:
        if width & have:
            part = h[taken : taken + n]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(29))) * _ODD[1] + part
            taken += have
        if have * 2 <= width:
            h = (h[:-have] ^ (h[:-have] >> np.uint64(31))) * _ODD[0] + h[have:]
        have *= 2
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    again = np.zeros(n + 1, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    where = np.flatnonzero(again)
    cuts = np.flatnonzero(np.diff(where) > width)
    a = where[np.concatenate([[0], cuts + 1])]
    b = where[np.concatenate([cuts, [len(where) - 1]])] + width
    return [(s, e) for s, e in zip(a.tolist(), b.tolist()) if e - s >= least]


def text_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words."""
    if len(words) < least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    found = []
    for a, b in stretches(hashes, least, times):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words[a:b]]
        found += [(a + s, n, q) for s, n, q in runs(ids, least, times)]
    return sorted((s, n, q) for s, n, q in found)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run, its first period stays, unless another run drops it."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for s, n, q in found:
        gone[s + q] += 1
        gone[s + n] -= 1
    dropped = np.cumsum(gone)[:-1] > 0
    return [w for w, d in zip(words, dropped.tolist()) if not d]


def find_runs(df: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The kept columns with n_words, runs (start, length, period by start, then period) and collapsed (the words that no run repeats, joined by one space) of every row's whole text.

    A run has `least` words and `times` (3 or more) periods at least; no
    neighbouring word extends it.  Words lie between ASCII white space.  Null,
    empty and blank texts have no words, no runs and an empty collapsed text; an
    empty table gives no rows; repeated rows and ids stay as they are; no other
    column is looked at.  Rows are worked on one by one, in slices of bounded
    bytes; a text's stretches that occur twice take some 150 bytes a word.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    common.small_batches(df.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    rows = common.spread(df.select(text_col, *keep))
    out = T.StructType([*(common.field(df, c) for c in keep), T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.text_slices(whole, 0):
                counts, lists, texts = [], [], []
                for text in part.column(0).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    found = text_runs(words, least, times)
                    counts.append(len(words))
                    lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(collapsed(words, found)))
                made = [pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=out.names)

    return rows.mapInArrow(common.releasing(work), out)


def strongest(found: str) -> Column:
    """Of a column of runs, the one with the greatest length / period, compared exactly; then the smallest start, then period; null if there is none."""
    def better(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (a > b) | ((a == b) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))

    start = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(found, start, lambda best, x: F.when(best.isNull() | better(x, best), x).otherwise(best))
