"""Toxicity scores of texts restored by a noisy-channel decoder.

A character language model over all documents decodes whole texts: each is a
lattice of readings (look-alike signs, repeated letters, and blanks or separators
that are dropped or are word edges), and the Viterbi path is the restored text.
Fragments of original and restored words are then scored by weights learnt from
labelled documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, partial
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tabulon.llm.common import Memo, words_of, written

#: Most labelled documents to learn from; beyond, a hash of the id chooses.
MAX_TRAIN = 30_000
#: Most fragments that get a weight.
MAX_FEATURES = 50_000
#: Fragments of words, word ends included.
GRAMS = (4, 5, 6)
#: Longest word that is a fragment itself, and longest text whose reading is kept; longer ones are decoded anew.
MAX_WHOLE = 64
#: Fragments that a task counts before it sends them on.
MAX_COUNTED = 200_000
#: Words whose weights a task keeps, and words of some texts that are weighed together.
MAX_WEIGHED, GROUP_WORDS = 100_000, 20_000

# Signs that stand for letters.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
RUNS = re.compile(r"(.)\1+")
EDGES = ".,;:?!\"'()[]{}<>*#%&|-_=~/\\«»“”‘’¿¡…"
SEPARATORS = re.escape("".join(c for c in EDGES if c not in LOOKS)) + r"\s"
#: What has readings of its own: a run of blanks and separators, or of one other sign.
ELEMENTS = re.compile(rf"[{SEPARATORS}]+|(.)\1*", re.S).finditer
GAP = re.compile(rf"[{SEPARATORS}]+").fullmatch
#: Two letters or more fix the state of the decoder; what lies between two such stretches is decoded by itself.
STRETCHES = re.compile(r"([^\W\d_]{2,})").split
#: Letters of a word that differ from their neighbours have one reading; two and more fix the state of the decoder.
FIXED = re.compile(r"((?:([^\W\d_])(?!\2)(?<!\2\2)){2,})").split
#: Pieces of one or two signs may also be one word whatever the language model says.
SHORT_PIECES = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2})+(?!\S)").findall

#: The letters that the language model tells apart; all others are one.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíìîïñóòôöœßúùûü"
SIZE = len(LETTERS) + 2
EDGE, OTHER = 0, SIZE - 1
INDEX = {c: k + 1 for k, c in enumerate(LETTERS)}
CODES = Memo(lambda c: INDEX.get(c) or (OTHER if c.isalpha() else EDGE))


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every character: its code, and whether stretches hold it."""
    every = "".join(map(chr, range(0x110000)))
    codes, letter = np.zeros(len(every), "int8"), np.zeros(len(every), bool)
    for match in re.finditer(r"[^\W\d_]", every):
        letter[match.start()] = True
        codes[match.start()] = CODES[match[0]]
    return codes, letter


def letter_codes() -> np.ndarray:
    """Code of every character of the basic plane; white space is a word edge."""
    table = np.full(0x10000, OTHER, "int32")
    for c, k in INDEX.items():
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = k
    table[[0x20, *range(9, 14)]] = EDGE
    return table


def trigram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of the letter triples of all texts, an array of bounded size; each task
    sums its own texts before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, total = letter_codes(), np.zeros(SIZE**3, "int64")
        for batch in batches:
            for text in batch["text"]:
                if not text:
                    continue
                points = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
                codes = table[np.minimum(points, 0xFFFF)]
                total += np.bincount((codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    found = df.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[found["code"].to_numpy("int64")] = found["n"].to_numpy("float64")
    return out


def with_runs(words: list[str]) -> list[int]:
    """The numbers of the words, none of them empty, that hold a letter twice in a row."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    twice = np.flatnonzero(points[1:] == points[:-1])
    ends = np.cumsum([len(x) + 1 for x in words])
    return np.unique(np.searchsorted(ends, twice, "right")).tolist()


class ShortMemo(Memo):
    """A memo that keeps no text, or middle one of three, beyond ``MAX_WHOLE`` characters:
    with the number of entries this bounds its bytes."""

    def __missing__(self, key):
        text = key if isinstance(key, str) else key[1]
        return super().__missing__(key) if len(text) <= MAX_WHOLE else self.make(key)


@dataclass
class Model:
    """Language model, document counts of fragments (toxic, clean) and calibration."""

    lm: np.ndarray  # log probability of a letter after two others
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    sizes: tuple[int, int] = (0, 0)
    bias: float = -10.0
    slopes: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self.table = np.asarray(self.lm)
        self.lm = self.table.tolist()  # single items are looked up
        self.between, self.edges = ShortMemo(self.gap, 100_000), ShortMemo(lambda text: self.lattice(text)[0], 5_000)
        self.elements = ShortMemo(lambda text: [(x, [CODES[c] for c in x], cost) for x, cost in self.readings(text)[0]], 5_000)
        self.found, self.joined = ShortMemo(self.forms, 20_000), ShortMemo(self.join, 20_000)
        # the weights as such, and as seen by a clean or toxic document that is itself in the counts
        odds = cache(self.odds)
        self.weights = {own: {g: w for g, n in self.counts.items() if (w := odds(*n, own))} for own in (None, 0, 1)}
        found = list(dict.fromkeys(chain.from_iterable(self.weights.values())))
        #: Fragments with a weight, with runs put to one letter.
        self.single = {RUNS.sub(r"\1", g) for g in found}
        self.lengths = sorted({len(g) for g in self.single if len(g) <= max(GRAMS)})
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, g in enumerate(found):
            self.search.add_word(g, k)
        self.search.make_automaton()
        self.width, self.arrays = np.array([len(g) for g in found], "int64"), {}
        for own, weights in self.weights.items():
            self.arrays[own] = np.array([weights.get(g, 0.0) for g in found], "float64")
        self.cores = {own: ShortMemo(partial(self.core_weight, weights=self.weights[own]), 50_000) for own in self.weights}
        self.memos = {own: ShortMemo(partial(self.word_weight, cores=self.cores[own]), MAX_WEIGHED) for own in self.weights}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "weights", "cores", "memos", "single", "lengths", "search", "width", "arrays", "between", "edges", "elements", "found", "joined")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        """Drop the memos at the end of a task: they refer to the model, which else stays in the
        worker with all that it has kept until Python looks for cycles. Not to be used afterwards."""
        for name in ("cores", "memos", "between", "edges", "elements", "found", "joined"):
            del self.__dict__[name]

    def readings(self, word: str) -> list[list[tuple[str, float]]]:
        """The lattice of a text: what each sign, run of equal signs, or run of blanks and
        separators may stand for, with its cost. A blank is a word edge."""
        out = []
        for match in ELEMENTS(word):
            c, n = match[1], len(match[0])
            if c is None:
                blank = any(map(str.isspace, match[0]))
                options = [(" ", 0.0 if blank else 0.5), ("", 2.0 if match[0].isspace() or not blank else 3.0)]
            elif c in LOOKS:
                options = [(x * k, 1.0 + 0.5 * (k != n)) for x in LOOKS[c] for k in ((1,) if n == 1 else (1, 2))]
                options += [("", 3.0 * n), (" ", 2.0)]
            elif c.isalpha():
                options = [(c * k, 0.5 * (k != n)) for k in ((1,) if n == 1 else (1, 2))]
            else:
                options = [("", 6.0 * n), (" ", 1.0)]
            out.append(options)
        return out

    def lattice(self, text: str) -> list[list[tuple[str, list[int], float]]]:
        """The readings with the codes of their letters."""
        return [self.elements[match[0]] for match in ELEMENTS(text)]

    def decode(self, text: str, before: str = "", after: str = "") -> str:
        """The most probable reading of a text between given letters: Viterbi over the
        lattice, states being the last two letters. Without letters there is a word edge."""
        lm, lattice, end = self.lm, self.lattice(text), after or "\0"
        paths = {tuple(map(CODES.__getitem__, before)) or (EDGE, EDGE): (0.0, None)}
        for options in [*lattice, [(end, [CODES[c] for c in end], 0.0)]]:
            ahead: dict = {}
            for (a, b), (cost, path) in paths.items():
                for letters, codes, penalty in options:
                    x, y, total = a, b, cost + penalty
                    for z in codes:
                        if z or y:  # an edge after an edge is the same edge
                            total -= lm[x][y][z]
                            x, y = y, z
                    if (x, y) not in ahead or total < ahead[x, y][0]:
                        ahead[x, y] = (total, (path, letters) if letters else path)
            paths = ahead
        out, path = [], min(paths.values(), key=lambda p: p[0])[1]
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))[: -len(end)]

    def gap(self, key: tuple[str, str, str]) -> str:
        """As ``decode`` of the middle one of three; where that is one run of blanks and
        separators between letters, its two readings are compared at once."""
        before, text, after = key
        if not (before and after and GAP(text)):
            return self.decode(text, before, after)
        (edge, _, kept), (_, _, dropped) = self.edges[text]
        lm, (a, b), (c, d) = self.lm, map(CODES.__getitem__, before), map(CODES.__getitem__, after)
        kept -= lm[a][b][EDGE] + lm[b][EDGE][c] + lm[EDGE][c][d]
        return edge if kept <= dropped - lm[a][b][c] - lm[b][c][d] else ""

    def restore(self, word: str) -> str:
        """The most probable reading of a word, or of several with blanks between them; what
        lies between stretches of letters with one reading is decoded by itself."""
        parts = FIXED(word)
        return self.joined_up(parts[::3], parts[1::3]).strip(" ")

    def joined_up(self, gaps: list[str], letters: list[str]) -> str:
        """The text of letters and of the readings of the gaps before, between and after them."""
        keys = zip(gaps, ["", *[x[-2:] for x in letters]], [*[x[:2] for x in letters], ""])
        read = self.between
        gaps = [read[before, gap, after] for gap, before, after in keys]
        return "".join([x for pair in zip(gaps, letters) for x in pair]) + gaps[-1]

    def restored(self, text: str) -> str:
        """The most probable reading of a whole text. Two letters are all that the next one
        depends on, so that texts between stretches of letters are decoded one by one."""
        text = text.lower()
        if not text:
            return text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes, letter = kinds()
        inside = letter[points]
        inside &= np.append(inside[1:], False) | np.append(False, inside[:-1])
        # single blanks between stretches, as in ``gap``
        blank = np.flatnonzero((points[1:-1] == 0x20) & inside[:-2] & inside[2:]) + 1
        lm, (a, b, c, d) = self.table, (codes[points[blank + k]] for k in (-2, -1, 1, 2))
        kept = 0.0 - (lm[a, b, EDGE] + lm[b, EDGE, c] + lm[EDGE, c, d])
        blank = blank[kept <= 2.0 - lm[a, b, c] - lm[b, c, d]]
        inside[blank] = True
        border = np.flatnonzero(np.diff(inside, prepend=True, append=True)).tolist()
        gaps = list(zip(border[::2], border[1::2]))
        read, out, last = self.between, [], 0
        for start, end in gaps:
            out += text[last:start], read[text[max(0, start - 2) : start], text[start:end], text[end : end + 2]]
            last = end
        return "".join(out) + text[last:]

    def disguised(self, word: str) -> bool:
        """Whether the lattice has more than one path worth decoding."""
        if len(word) < 3:
            return False
        if word.isalpha():
            return RUNS.search(word) is not None
        return any(map(str.isalpha, word))

    def odds(self, toxic: int, clean: int, own: int | None) -> float:
        """Log odds of a fragment of so many documents, less for rare ones; without the document's own count if it has a label."""
        toxic, clean = max(0, toxic - (own == 1)), max(0, clean - (own == 0))
        odds = math.log((toxic + 0.5) / (self.sizes[0] + 1)) - math.log((clean + 0.5) / (self.sizes[1] + 1))
        return max(0.0, odds) * toxic / (toxic + 1)

    def word_weight(self, word: str, cores: Memo) -> float:
        """The weight of a word without the signs around it, or of its restored form."""
        low = word.lower()
        core = low.strip(EDGES)
        if core.isalpha() and not (RUNS.search(core) and self.may_weigh(core)):
            return cores[core]
        return max(map(cores.__getitem__, self.found[word]))

    def weigh(self, words: set[str], own: int | None) -> dict[str, float]:
        """Make the weights of all ``words`` known to the memo, and return those that it does not
        keep. New ones are weighed together, as by ``word_weight``."""
        known = self.memos[own]
        new = words.difference(known)
        if len(known) + len(new) > known.most:
            known.clear()
            new = words
        weights, names, cores = dict.fromkeys(new, 0.0), list(new), self.cores[own]
        stripped = [low.strip(EDGES) for low in "\n".join(names).lower().split("\n")] if names else []
        plain = [core.isalpha() for core in stripped]
        lines, words_of_lines = list(compress(stripped, plain)), list(compress(names, plain))
        several = [word for word, alpha in zip(names, plain) if not alpha]
        for k in with_runs(lines):
            if self.may_weigh(lines[k]):
                several.append(words_of_lines[k])
        for word in several:
            for form in self.found[word]:
                if form.isalpha():
                    lines.append(form)
                    words_of_lines.append(word)
                elif w := cores[form]:
                    weights[word] = max(weights[word], w)
        for k, w in self.core_weights(lines, own):
            word = words_of_lines[k]
            if w > weights[word]:
                weights[word] = w
        long = {w: weights.pop(w) for w in names if len(w) > MAX_WHOLE}
        known.update(weights)
        return long

    def core_weights(self, lines: list[str], own: int | None) -> list[tuple[int, float]]:
        """``core_weight`` of each line of letters that has one, with its number, by one search for all fragments."""
        weights = self.weights[own]
        if not (lines and weights):
            return []
        marked = "^" + "$\n^".join(lines) + "$"
        hits = np.fromiter(chain.from_iterable(self.search.iter(marked)), "int64").reshape(-1, 2)
        end, fragment = hits[:, 0], hits[:, 1]
        w = self.arrays[own][fragment]
        if not w.all():
            end, fragment, w = (x[w > 0] for x in (end, fragment, w))
        if not len(end):
            return []
        starts = np.cumsum([0, *[len(x) + 3 for x in lines]])
        at = np.searchsorted(starts, end, "right") - 1
        first = np.flatnonzero(np.diff(at, prepend=-1))
        top, line = np.maximum.reduceat(w, first), at[first]
        strong = 2 * w >= np.repeat(top, np.diff(first, append=len(at)))
        end = end[strong] + 1
        depth = np.bincount(end - self.width[fragment[strong]], minlength=starts[-1]) - np.bincount(end, minlength=starts[-1])
        covered = np.add.reduceat(np.cumsum(depth) > 0, starts[:-1], dtype="int64")[line]
        return [(k, t * (c / (len(lines[k]) + 2)) ** 2) for k, t, c in zip(line.tolist(), top.tolist(), covered.tolist())]

    def largest(self, words: Iterable[str], own: int | None, k: int) -> list[float]:
        """The largest word weights, at most ``k``, without zeros."""
        words = set(words)
        return self.largest_known(words, own, k, self.weigh(words, own))

    def largest_known(self, words: set[str], own: int | None, k: int, long: dict[str, float]) -> list[float]:
        get = self.memos[own].get
        found = [w for w in map(get, words) if w]
        if long:
            found += [w for x in long.keys() & words if (w := long[x])]
        return heapq.nlargest(k, found)

    def may_weigh(self, word: str) -> bool:
        """Whether any reading of letters has a fragment with a weight: with runs put to one
        letter, a reading's fragments are among those of the word."""
        marked = RUNS.sub(r"\1", f"^{word}$")
        for n in self.lengths:
            if not self.single.isdisjoint([marked[i : i + n] for i in range(len(marked) - n + 1)]):
                return True
        return marked in self.single

    def core_weight(self, form: str, weights: dict[str, float]) -> float:
        """The largest weight of a fragment, by the square of the share of the word that
        fragments of at least half that weight cover."""
        marked = f"^{form}$"
        size, get = len(marked), weights.get
        if weights.keys().isdisjoint([marked, *[marked[i : i + n] for n in GRAMS for i in range(size - n + 1)]]):
            return 0.0
        found = [(w, i, n) for n in GRAMS for i in range(size - n + 1) if (w := get(marked[i : i + n]))]
        if size <= MAX_WHOLE and (w := get(marked)):
            found.append((w, 0, size))
        if not found:
            return 0.0
        top, covered = max(found)[0], set()
        for w, at, n in found:
            if 2 * w >= top:
                covered.update(range(at, at + n))
        return top * (len(covered) / size) ** 2

    def forms(self, word: str) -> set[str]:
        """A word as it is and as restored, without the signs around it."""
        low = word.lower()
        core = low.strip(EDGES)
        found = {core}
        if not core.isalpha() or RUNS.search(core):
            for x in {core, low}:
                if self.disguised(x):
                    found.update(self.restore(x).split(" "))
        return found

    def fragments(self, word: str) -> set[str]:
        out = set()
        for form in self.forms(word):
            marked = f"^{form}$"
            out.update([marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)])
            if form and len(marked) <= MAX_WHOLE:
                out.add(marked)
        return out

    def words(self, text: str) -> set[str]:
        """Distinct words, and those of the restored text that are none of their forms."""
        found = set(words_of(text))
        decoded = set(self.restored(text).split())
        for run in SHORT_PIECES(text):
            decoded.update(self.joined[run])
        known = found - decoded
        decoded -= found
        for w in known:
            core = w.lower().strip(EDGES)
            decoded.discard(core)
            if not core.isalpha():
                decoded.difference_update(self.found[w])
        return found | decoded

    def join(self, run: str) -> set[str]:
        """Words that short pieces make when all the blanks between them are dropped."""
        return set(self.restore("".join(run.lower().split())).split())

    def evidence(self, text: str | None, own: int | None = None) -> tuple[float, ...]:
        """The largest word weight, the second, the sum of the next six, and the log of the number of words."""
        return next(self.evidences([text], [own]))

    def evidences(self, texts: Iterable[str | None], owns: Iterable[int | None]) -> Iterator[tuple[float, ...]]:
        """The evidence of each text in order; the words of some texts are weighed together."""
        group, size = [], 0
        for text, own in zip(texts, owns):
            words = self.words(text) if text else set()
            group.append((words, own))
            size += len(words)
            if size >= GROUP_WORDS:
                yield from self.weighed(group)
                group, size = [], 0
        yield from self.weighed(group)

    def weighed(self, group: list[tuple[set[str], int | None]]) -> Iterator[tuple[float, ...]]:
        long = {own: self.weigh(set().union(*[words for words, o in group if o == own]), own) for own in {own for _, own in group}}
        for words, own in group:
            top = [*self.largest_known(words, own, 8, long[own]), 0.0, 0.0]
            yield top[0], top[1], sum(top[2:]), math.log1p(len(words))

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        for evidence in self.evidences(texts, repeat(None)):
            total = self.bias + sum(a * b for a, b in zip(self.slopes, evidence))
            yield 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))

    def score(self, text: str | None) -> float:
        return next(self.scores([text]))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third letter, trigrams backed by bigrams and letters."""
    three = counts.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
    return np.log((three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Bias and slopes by Newton's method; a small ridge keeps separable data finite."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(id_col: Column, modulus: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Language model of all ``docs``; weights and calibration from labelled ones only.

    Rows whose id has remainder 0 are never read for their label. At most
    ``MAX_TRAIN`` labelled documents are used. They also calibrate the score, each
    without its own part in the counts. Null labels and ids are ignored; of
    several labels of one id the largest holds. Without labels of both kinds every score is the share
    of toxic labels (0 without any).
    """
    model = Model(language_model(trigram_counts(docs, text_col)))
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND __id IS NOT NULL")
    known = known.where(remainder(F.col("__id")) != 0).groupBy("__id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.pmod(F.xxhash64(F.lit(9), F.col("__id").cast("string")), F.lit(1 << 30))
    n = known.count()
    if n > MAX_TRAIN:
        known = known.where(order < int((1 << 30) * MAX_TRAIN / n))
    train = docs.select(F.col(f"`{id_col}`").alias("__key"), F.col(f"`{text_col}`").alias("text")).join(known, F.col("__key") == F.col("__id")).select("text", "toxic")
    train = written(train, "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: defaultdict[str, int] = defaultdict()
        ids.default_factory = ids.__len__  # a new fragment gets the next number
        of_word = ShortMemo(lambda word: np.array(list(map(ids.__getitem__, model.fragments(word))), "int32"), 20_000)
        tally, size = np.zeros((2, 2 * MAX_COUNTED), "int64"), [0, 0]

        def counted() -> pd.DataFrame:
            n = len(ids)
            out = pd.DataFrame({"fragment": [*ids, ""], "toxic": [*tally[1, :n].tolist(), size[1]], "clean": [*tally[0, :n].tolist(), size[0]]})
            ids.clear(), of_word.clear()
            tally[:], size[:] = 0, [0, 0]
            return out

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                size[toxic] += 1
                parts = [of_word[word] for word in model.words(text or "")]
                if len(ids) > tally.shape[1]:
                    tally = np.pad(tally, ((0, 0), (0, len(ids))))
                if parts:
                    held = np.zeros(len(ids), bool)  # each fragment counts once a document
                    held[np.concatenate(parts)] = True
                    tally[toxic, : len(ids)] += held
                if len(ids) > MAX_COUNTED:
                    yield counted()
        yield counted()
        model.forget()

    sums = train.mapInPandas(count, "fragment string, toxic long, clean long").groupBy("fragment").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = written(sums.where("fragment = '' OR toxic >= 2"), "fragments")
    sizes = sums.where("fragment = ''").first()
    toxic_n, clean_n = (sizes["toxic"], sizes["clean"]) if sizes else (0, 0)
    p = toxic_n / (toxic_n + clean_n) if toxic_n + clean_n else 0.0
    model.bias = math.log(p / (1 - p)) if 0 < p < 1 else 500.0 if p else -500.0
    if not 0 < p < 1:
        return model
    # the surplus of toxic documents in standard deviations puts the surest fragments first
    expected = (F.col("toxic") + F.col("clean")) * p
    surplus = (F.col("toxic") - expected) / F.sqrt(expected * (1 - p) + 0.25)
    best = sums.where("fragment <> ''").withColumn("z", surplus).where("z > 2").orderBy(F.desc("z"), "fragment").limit(MAX_FEATURES).collect()
    model.counts, model.sizes = {r["fragment"]: (r["toxic"], r["clean"]) for r in best}, (toxic_n, clean_n)
    model.__post_init__()

    @pandas_udf("array<double>")
    def evidence(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, own in batches:
            yield pd.Series(list(map(list, model.evidences(texts, own))))
        model.forget()

    held = train.select("toxic", evidence("text", "toxic").alias("e")).toPandas()
    w = logistic(np.array(held["e"].tolist(), "float64"), held["toxic"].to_numpy("float64"))
    model.bias, model.slopes = float(w[0]), tuple(map(float, w[1:]))
    return model


def toxic_score(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of a text column; a null text counts as empty. Texts are read whole."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.scores(texts)), dtype="float64")
        model.forget()

    return score(text)
