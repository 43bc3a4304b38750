"""Small vectorised helpers over Arrow batches, for what interpreted array expressions do many times slower.

They take texts where they lie (no shuffle), hold one batch at a time, and can't stand inside a lambda of another expression.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["proseline"])

WINDOW = 30
#: Characters that are looked at together; a longer text is looked at alone.
SLICE = 1_000_000
#: Java's white space (Python's has four control characters more).
JAVA_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Signs that are word characters in Python and none in Java.
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "No")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def find_literals(low: Column, literals: tuple[str, ...]) -> Column:
    """Which of the literals stand in a (lowered) text, as an array of their places in the list; one pass, however many there are."""

    def run(texts: pd.Series) -> pd.Series:
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, s in enumerate(literals):
            found.add_word(s, k)
        found.make_automaton()
        return pd.Series([sorted({k for _, k in found.iter(t)}) if t else [] for t in texts])

    return F.pandas_udf(run, "array<int>")(low)


def slices(texts: pd.Series) -> Iterator[list[str]]:
    """The texts (null: empty) in their order, by stretches of at most ``SLICE`` characters, so that what is made of a batch is never held whole."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def word_echoes(text: Column) -> Column:
    """words: number of runs between white space; thrice: whether one word can stand three times in a row; starts: whether three sentences in a row
    can begin with the same word. The last two are false only if Java's patterns for that have no match, whatever the case."""

    def run(texts: pd.Series) -> pd.DataFrame:
        head, out = re.compile(f"\\s+([^\\W{NUMERALS}]*)"), []
        for t in texts:
            t = (t or "").replace("İ", "i").upper().casefold()  # what Java takes for one letter is one
            w = t.split()
            thrice = any(a.endswith(b) and c.startswith(b) for a, b, c in zip(w, w[1:], w[2:]))
            parts = re.split("[.!?]", t)
            keys = [m and m[1] for m in map(head.match, parts)]
            again = (k for k in range(len(parts) - 2) if keys[k + 1] is not None and keys[k + 1] == keys[k + 2])
            starts = any(parts[k].lstrip().startswith(keys[k + 1]) or "\n" + keys[k + 1] in parts[k] for k in again)
            out.append((len(w), thrice, starts))
        return pd.DataFrame(out, columns=["words", "thrice", "starts"])

    return F.pandas_udf(run, "words int, thrice boolean, starts boolean")(text)


def sentences_of(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split("[.!?]+", text)) if s]


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[len(s.split()) for s in sentences_of(t)] if t else [] for t in texts])

    return F.pandas_udf(run, "array<int>")(text)


def closed_lengths(text: Column, short: int) -> Column:
    """words: of the text; k: of each stretch between sentence ends that white space or the text's end follows; short: those stretches of at most
    ``short`` words."""

    def run(texts: pd.Series) -> pd.DataFrame:
        end, out = re.compile(f"[.!?][\"'”’)\\]]*(?:{JAVA_SPACE}|$)"), []
        for t in texts:
            closed = [s for s in map(str.strip, end.split(t or "")) if s]
            k = [len(s.split()) for s in closed]
            out.append((len((t or "").split()), k, [s for s, n in zip(closed, k, strict=True) if n <= short]))
        return pd.DataFrame(out, columns=["words", "k", "short"])

    return F.pandas_udf(run, "words int, k array<int>, short array<string>")(text)


def word_kinds(text: Column) -> Column:
    """n: lowered runs of word characters; kinds: distinct ones; chars: their characters in all."""

    def run(texts: pd.Series) -> pd.DataFrame:
        import regex

        plain, every, out = re.compile(r"\w+", re.ASCII), regex.compile(r"\w+"), []  # as in Java, marks are word characters
        for t in texts:
            t = (t or "").lower()
            w = (plain if t.isascii() else every).findall(t)
            out.append((len(w), len(set(w)), sum(map(len, w))))
        return pd.DataFrame(out, columns=["n", "kinds", "chars"])

    return F.pandas_udf(run, "n int, kinds int, chars long")(text)


def prose_counts(text: Column, verbs: tuple[str, ...], stopwords: tuple[str, ...]) -> Column:
    """sentences: words of each; starts: how often each first word occurs, in the words' order; letters: runs of ASCII letters; spike: the most
    frequent one that has more than three letters and is no stop word; telling: sentences with one of the verbs; spoken: with speech; paragraphs:
    sentences of each paragraph (1 at least)."""
    stop = set(stopwords)

    def run(texts: pd.Series) -> pd.DataFrame:
        first = re.compile("[\"']?[ \\t\\n\\x0b\\f\\r]*([a-zA-Z]+)")
        verb = re.compile(f"(?<![a-zA-Z])(?:{'|'.join(verbs)})(?![a-zA-Z])")
        letters, marks = re.compile("[a-z]+"), re.compile("[\"“”'‘’]")
        quoted, said = re.compile('["“”]'), re.compile("['‘’].*said", re.I)
        blank, out = re.compile(f"\n{JAVA_SPACE}*\n"), []
        for t in texts:
            t = t or ""
            low = t.lower()
            s, w = sentences_of(t), letters.findall(low)
            starts = Counter(m[1].lower() for m in map(first.match, s) if m)
            counts = Counter(w)
            telling = sum(verb.search(x.lower()) is not None for x in s) if any(v in low for v in verbs) else 0
            spoken = sum((quoted.search(x) or said.search(x)) is not None for x in s) if marks.search(t) else 0
            blocks = [p for p in map(str.strip, blank.split(t)) if p] or [t]
            paragraphs = [max(1, len(sentences_of(p))) for p in blocks] if len(blocks) > 1 else [max(1, len(s))]
            spike = max((n for x, n in counts.items() if len(x) > 3 and x not in stop), default=0)
            out.append(([len(x.split()) for x in s], [starts[x] for x in sorted(starts)], len(w), spike, telling, spoken, paragraphs))
        return pd.DataFrame(out, columns=["sentences", "starts", "letters", "spike", "telling", "spoken", "paragraphs"])

    return F.pandas_udf(run, "sentences array<int>, starts array<int>, letters int, spike int, telling int, spoken int, paragraphs array<int>")(text)


def hashes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the text of each."""
    size = [len(w) for w in words]
    h = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, sum(size)).view(np.uint64) * _MIX
    return h ^ (h >> np.uint64(32)), np.repeat(np.arange(len(words)), size)


def grams(h: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie in one text, and the text of each."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _MIX
        out ^= out >> np.uint64(29)
    inside = own[:m] == own[n - 1 : n - 1 + m]
    return out[inside], own[:m][inside]


def text_bits(own: np.ndarray) -> np.uint64:
    """How many bits below the text's number a key has for the hash (50 in batches of 10,000 texts)."""
    return np.uint64(64 - max(1, int(own[-1]).bit_length())) if len(own) else np.uint64(63)


def text_keys(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One key to sort by: the text in the upper bits, what is left of the hash below."""
    bits = text_bits(own)
    return (own.astype(np.uint64) << bits) | (h >> (np.uint64(64) - bits))


def group_sizes(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct hash of a text occurs, and the text of each."""
    key = np.sort(text_keys(h, own))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.diff(np.append(first, len(key))), (key[first] >> text_bits(own)).astype(np.int64)


def repetition_rates(text: Column) -> Column:
    """tok, bi, tri: share of word n-grams that are distinct ones which recur; run: of words that repeat the one before; seq: of
    windows of 30 words that are not distinct (texts of 60 words or more); dup: of sentences that repeat another; enough: two words or more."""

    def part(texts: list[str]) -> pd.DataFrame:
        h, own = hashes([t.split() for t in texts])
        k = len(texts)
        n = np.bincount(own, minlength=k)
        share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)

        def recurring(size: int) -> np.ndarray:
            sizes, of = group_sizes(*grams(h, own, size))
            return np.bincount(of[sizes > 1], minlength=k)

        same = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        windows, of = grams(h, own, WINDOW)
        distinct = np.bincount(group_sizes(windows, of)[1], minlength=k)
        total = np.bincount(of, minlength=k)
        parts = ([" ".join(s.split()) for s in re.split("[.!?]+", t.lower()) if s and not s.isspace()] for t in texts)
        return pd.DataFrame({
            "tok": np.where(n > 1, share(recurring(1), n), 0.0),
            "bi": share(recurring(2), n - 1),
            "tri": share(recurring(3), n - 2),
            "run": share(np.bincount(own[1:][same], minlength=k), n - 1),
            "seq": np.where(n >= 2 * WINDOW, share(total - distinct, total), 0.0),
            "dup": [1 - len(set(p)) / len(p) if len(p) > 1 else 0.0 for p in parts],
            "enough": n > 1,
        })

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.concat(list(map(part, slices(texts))) or [part([])], ignore_index=True)

    return F.pandas_udf(run, "tok double, bi double, tri double, run double, seq double, dup double, enough boolean")(text)


def phrases(words: list[str], at: np.ndarray, sizes: range, least: int, stop: set[str]) -> list[tuple[int, int, int]]:
    """(n, count, first place) of the runs that repeated_phrases tells of. at: places where a recurring shortest run may begin, in order.

    Runs are numbered size by size, each from the run that is one word shorter, at places where both shorter ones recur. Inside a longer run of
    as many places a run is covered; as every one of its places then lies in the longer one, its first place tells. What else covers is a run that
    holds it within its words (the first one's end and the last one's beginning); only runs with the same words between are tried."""
    number: dict[str, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    content = np.concatenate([[0], np.cumsum([x not in stop for x in words])])
    at = at[at + sizes[0] <= len(w)]
    ids = w[at]
    for k in range(1, sizes[0]):
        ids = np.unique(ids * len(number) + w[at + k], return_inverse=True)[1]
    of, rows = {}, []
    for n in sizes:
        if n > sizes[0]:
            next_to = np.zeros(len(w) + 1, bool)
            next_to[at] = True
            keep = next_to[at + 1] & (at + n <= len(w))
            at, ids = at[keep], ids[keep]
            ids = np.unique(ids * len(number) + w[at + n - 1], return_inverse=True)[1]
        counts = np.bincount(ids)
        keep = counts[ids] >= least if len(ids) else np.zeros(0, bool)
        at, ids = at[keep], ids[keep]
        place = np.full(len(w), -1)
        place[at] = ids
        of[n] = place, counts
        first = np.unique(ids, return_index=True)[1]
        rows.append(np.stack([np.full(len(first), n), counts[ids[first]], at[first]], 1).reshape(-1, 3))
    every = np.concatenate(rows)
    n, count, first = every[(content[every[:, 2] + every[:, 0]] > content[every[:, 2]])].T
    covered = np.zeros(len(n), bool)
    for size in sizes:
        mine = np.flatnonzero(n == size)
        for longer in range(size + 1, sizes[-1] + 1):
            place, counts = of[longer]
            for back in range(longer - size + 1):
                q = first[mine] - back
                r = np.where(q >= 0, place[q], -1)
                covered[mine] |= (r >= 0) & (np.append(counts, -1)[r] >= count[mine])
    for size in sizes:
        _cover_within(words, w, len(number), n, count, first, covered, size)
    order = np.lexsort((first, -count, -n))
    return [(int(n[k]), int(count[k]), int(first[k])) for k in order.tolist() if not covered[k]]


def _cover_within(words: list[str], w: np.ndarray, base: int, n: np.ndarray, count: np.ndarray, first: np.ndarray, covered: np.ndarray, size: int) -> None:
    """Marks the runs of one size that a run of that size or more holds, not word by word: their first word ends one of its words, their last
    word begins another, and the words between are the same."""
    asked = np.flatnonzero((n == size) & ~covered)
    holders = [(k, np.flatnonzero(n == k)) for k in np.unique(n[n >= size]).tolist()]
    row = np.concatenate([[], *[np.repeat(r, k - size + 1) for k, r in holders]]).astype(np.int64)
    begin = np.concatenate([[], *[(first[r][:, None] + np.arange(k - size + 1)).reshape(-1) for k, r in holders]]).astype(np.int64)
    if not len(asked) or not len(row):
        return
    middle, theirs = w[first[asked] + 1], w[begin + 1]
    for k in range(2, size - 1):  # the words between, numbered alike on both sides; what no run asked has drops out
        middle, theirs = middle * base + w[first[asked] + k], theirs * base + w[begin + k]
        kinds, middle = np.unique(middle, return_inverse=True)
        spot = np.minimum(np.searchsorted(kinds, theirs), len(kinds) - 1)
        keep = kinds[spot] == theirs
        row, begin, theirs = row[keep], begin[keep], spot[keep]
    groups: dict[int, dict[str, dict[str, int]]] = {}
    for r, m in zip(asked.tolist(), middle.tolist(), strict=True):
        groups.setdefault(m, {}).setdefault(words[first[r]], {})[words[first[r] + size - 1]] = r
    alone = np.bincount(middle) == 1
    only = np.zeros(len(alone), np.int64)
    only[middle] = first[asked]
    # where a group is one run, and that run itself stands here, there is nothing to find
    here = alone[theirs] & (w[begin] == w[only[theirs]]) & (w[begin + size - 1] == w[only[theirs] + size - 1])
    for r, b, m in zip(row[~here].tolist(), begin[~here].tolist(), theirs[~here].tolist(), strict=True):
        a, z = words[b], words[b + size - 1]
        for head in _among(groups[m], a, str.endswith, lambda x, k: x[k:]):
            for tail in _among(groups[m][head], z, str.startswith, lambda x, k: x[: len(x) - k]):
                k = groups[m][head][tail]
                if k != r and count[r] >= count[k] and (n[r] > size or first[r] < first[k]):
                    covered[k] = True


def _among(known: dict, word: str, test, piece) -> list[str]:
    """The strings of known that the word ends or begins with; as many steps as the smaller of both needs."""
    if len(known) <= len(word):
        return [x for x in known if test(word, x)]
    return [x for x in (piece(word, k) for k in range(len(word))) if x in known]


def repeated_phrases(low: Column, sizes: range, least: int, stopwords: tuple[str, ...]) -> Column:
    """array of (phrase, count, n): runs of n words (without outer punctuation, not stop words alone) that stand in a (lowered) text ``least``
    times or more, longest first, without those that a longer or earlier one covers."""

    stop = set(stopwords)

    def part(texts: list[str]) -> list[list[dict]]:
        word = re.compile(r"\w(?:\S*\w)?")
        words = [word.findall(t) for t in texts]
        h, own = grams(*hashes(words), sizes[0])
        begin = np.searchsorted(own, np.arange(len(words) + 1))
        key = text_keys(h, own)
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        often = order[np.bincount(group, minlength=1)[group] >= least] if len(h) else order
        often.sort()
        out = [[] for _ in words]
        for k in np.unique(own[often]).tolist():
            mine = often[np.searchsorted(often, begin[k]) : np.searchsorted(often, begin[k + 1])]
            found = phrases(words[k], mine - begin[k], sizes, least, stop)
            out[k] = [{"phrase": " ".join(words[k][p : p + n]), "count": c, "n": n} for n, c, p in found]
        return out

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(chain.from_iterable(map(part, slices(texts)))), dtype=object)

    return F.pandas_udf(run, "array<struct<phrase:string,count:int,n:int>>")(low)
