"""Score documents for abusive, hateful or sexually explicit language by weak supervision.

1. Texts are brought to a plain form: width, case, invisible and look-alike characters, markup, signs within a word,
   stretched letters, digits for letters, pinyin for characters. They are cut into sentences and clauses, and read
   in windows of two neighbouring clauses, whatever their length.
2. Lexicon and pattern voters (``abuse_words``) each vote abusive, harmless or nothing on every window. An automaton
   finds the words of all classes; a voter is a rule over the classes found, such as a group of people with contempt.
3. A generative label model is fitted on the counts of vote patterns of all windows: expectation
   maximisation estimates the voters' accuracies, conditional correlations between voters then
   discount those that repeat each other, and the posterior of each pattern is taken again.
4. A linear classifier on hashed character and word n-grams and on the votes is trained on the posteriors of a
   sample of windows, at most ``SAMPLE`` with and twice as many without an abusive vote, each weighted
   by the inverse of its share, so that a score does not depend on the size of the corpus.
5. The score of a document is that of its worst window.

A batch is one array of characters: cutting, hashing and scoring are array operations over all its texts.
Batches are bounded by bytes, and nothing of a text is kept beyond its batch. Patterns are counted over all
documents, and in the same pass the sample is drawn by hashes; only the classifier sees a sample.
Null and blank texts score 0. Repeated rows are scored each on their own. Very long texts are scored as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spread, table
from ..sources.tables import cut
from .abuse_words import BIT, CLASSES, INSULTS_EN, INSULTS_ZH, LEET, PINYIN, POSITIVE, SEXUAL_EN, SEXUAL_ZH, SIGNS, VOTERS, WRITINGS, votes_of
from .bpe import chunks
from .lookalikes import CYRILLIC, GREEK, INVISIBLE_PATTERN

#: Most sampled windows with an abusive vote (twice as many without), size of the hashed feature space, most distinct vote patterns, score of a found document.
SAMPLE, DIMENSIONS, MOST_PATTERNS, FOUND_FROM = 30_000, 1 << 17, 50_000, 0.5
#: Sum of the weights in training, to which its decay is relative; bytes of text in one batch of arrays.
TOTAL, BATCH_BYTES = 60_000, 1_000_000

_HAN = "一-鿿"
#: Texts without these characters need neither be freed of invisible ones nor of letters that look like Latin ones.
_ODD = re.compile(f"{INVISIBLE_PATTERN.pattern[:-1]}Ͱ-ӿԀ-ԯ𝚨-𝟋]")
_TWINS = str.maketrans(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1])
_MARKUP = re.compile(r"</?[a-z][^<>]*>|&[a-z]+;|&#\d+;")
#: Spaces between longer runs of characters part sentences; signs and spaces between single ones are disguise or habit.
_WIDE_GAP = re.compile(rf"(?=\s)(?:(?<=[{_HAN}]\S{{3}})\s+(?=\S{{4}})|(?<=\S{{4}})\s+(?=[{_HAN}]\S{{3}}))")
_GAPS = re.compile(rf"(?<=[{_HAN}])[ \t.*_/|+^#~·-]{{1,4}}(?=[{_HAN}])")
#: Follows a word that was written in disguise.
MARK = "\ue000"


def _latin_pattern(word: str) -> str:
    """A word with stretched letters, digits and signs for letters, masked inner letters, or signs between letters."""
    letters = []
    for i, c in enumerate(word):
        inner = 0 < i < len(word) - 1
        letters.append("[" + re.escape(LEET.get(c, c) + ("*#" if inner else "")) + "]+")
    return r"(?<![a-z0-9])" + r"[\s._*-]{0,2}".join(letters) + r"(?:e?s)?(?![a-z0-9])"


_LATIN_WORDS = [(re.compile(_latin_pattern(w)), w) for w in INSULTS_EN + SEXUAL_EN]
_ANY_LATIN = re.compile("|".join(p.pattern for p, _ in _LATIN_WORDS))
#: Latin words that may be in disguise: signs or digits within, three equal letters, single letters in a row.
_SUSPECT = re.compile(r"(?=[a-z@$!0-9])(?:[a-z@$!0-9][*#@$!+_0-9]+[a-z@$*#]|[a-z$@][.-][a-z$@][.-]|([a-z])\1\1|(?<![a-z])[a-z] [a-z] [a-z](?![a-z])|[@$][a-z]{2})")


def _variants() -> dict[str, str]:
    """Writings of Chinese words over two lines or with one character in pinyin or by its first letter, of Latin words with a space within."""
    out = dict(WRITINGS)
    for w in INSULTS_ZH + SEXUAL_ZH:
        for i, c in enumerate(w):
            if i:
                out.setdefault(w[:i] + "\n" + w[i:], w)
            if c in PINYIN:
                out.setdefault(w[:i] + PINYIN[c] + w[i + 1 :], w)
                out.setdefault(w[:i] + PINYIN[c][0] + w[i + 1 :], w)
    return out | {f"{w[:i]} {w[i:]}": w for w in INSULTS_EN + SEXUAL_EN for i in range(1, len(w))}


def _quick(name: str, word: str) -> bool:
    """Whether a word is found by the hash of its pair of characters, or of the whole Latin word: those of trade, which are frequent."""
    return name == "trade_en" and word.isalpha() or name == "trade_zh" and len(word) == 2


@lru_cache(1)
def _automata() -> tuple:
    """The automaton of disguised writings, and that of the words of all classes."""
    import ahocorasick

    written, classes = ahocorasick.Automaton(), ahocorasick.Automaton()
    for form, word in _variants().items():
        written.add_word(form, (len(form), word))
    masks: dict[str, int] = {MARK: BIT["disguised"]}
    for name, words in CLASSES.items():
        for w in words:
            if w and not _quick(name, w):
                masks[w] = masks.get(w, 0) | BIT[name]
    for w, mask in masks.items():
        classes.add_word(w, (len(w), mask, w[0].isascii() and w[0].isalnum(), w[-1].isascii() and w[-1].isalnum()))
    written.make_automaton()
    classes.make_automaton()
    return written, classes


def _alnum(s: str, i: int) -> bool:
    return 0 <= i < len(s) and s[i].isascii() and s[i].isalnum()


def _revealed(s: str) -> str:
    """The text with disguised words in their usual writing, each followed by MARK."""
    spots, upto = [], 0
    for end, (size, word) in _automata()[0].iter(s):
        a, b = end - size + 1, end + 1
        short = size == 2 and s[a].isascii()  # one letter and one character are read so if the letter is stretched
        while a > upto and s[a].isascii() and s[a - 1] == s[a]:
            a, short = a - 1, False
        if short and s[a:b] not in WRITINGS or a < upto or s[a].isascii() and _alnum(s, a - 1) or s[end].isascii() and (_alnum(s, b) or b + 1 < len(s) and s[b] in " -" and s[b + 1].isdigit()):
            continue
        spots.append((a, b, word))
        upto = b
    if spots:
        out, at = [], 0
        for a, b, word in spots:
            out += [s[at:a], word, MARK]
            at = b
        s = "".join([*out, s[at:]])
    if _SUSPECT.search(s) and _ANY_LATIN.search(s):
        for pattern, word in _LATIN_WORDS:
            s = pattern.sub(lambda m, w=word: m.group() if m.group() in (w, w + "s", w + "es") else w + MARK, s)
    return s


def plain(text: str | None) -> str:
    """The plain form of a whole text."""
    if not text:
        return ""
    if _ODD.search(text):
        s = unicodedata.normalize("NFKC", INVISIBLE_PATTERN.sub("", text)).casefold().translate(_TWINS)
    else:
        s = unicodedata.normalize("NFKC", text).casefold()
    if "<" in s or "&" in s:
        s = _MARKUP.sub(" ", s)
    s = _GAPS.sub("", _WIDE_GAP.sub("\n", s))
    return _revealed(s)


def _table(*kinds: tuple[int, str]) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for bit, chars in kinds:
        out[[ord(c) for c in chars]] |= bit
    return out


HAN, LATIN, END, CLAUSE, SPACE, DIGIT = 1, 2, 4, 8, 16, 32
_KINDS = _table((END, "。!?;\n\r~"), (CLAUSE, ",、:"), (SPACE, " \t\n\r"), (LATIN, "abcdefghijklmnopqrstuvwxyz'"), (DIGIT, "0123456789"))
_KINDS[0x4E00:0xA000] |= HAN
_RANDOM = np.random.default_rng(11).integers(1, 2**63, 70, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_hashes(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the characters from each start to its stop, in order of the starts."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = stop - start
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    offset = np.arange(int(size.sum())) - np.repeat(first, size)
    at = np.repeat(start, size) + offset
    return _mix(np.add.reduceat(_mix(code[at] + _RANDOM[4]) * _RANDOM[6 + offset % 64], first))


@lru_cache(1)
def _trade_keys() -> tuple[np.ndarray, np.ndarray]:
    pairs = [ord(w[0]) << 21 | ord(w[1]) for w in CLASSES["trade_zh"] if _quick("trade_zh", w)]
    words = [w + end for w in CLASSES["trade_en"] if _quick("trade_en", w) for end in ("", "s", "es")]
    sizes = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.array(pairs, np.uint64), _word_hashes(code, np.cumsum(sizes) - sizes, np.cumsum(sizes))


class Windows(NamedTuple):
    """The windows of a batch of texts: the text of each, and its first and last clause (the same for a lone one)."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Of the features of all clauses: the clause, the bucket, and the hash; in order of the clause.
    clause: np.ndarray
    bucket: np.ndarray
    hash: np.ndarray
    #: Of each clause the classes found.
    mask: np.ndarray

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the features of each window, from values of the features."""
        own = np.bincount(self.clause, values, len(self.mask))
        return own[self.first] + np.where(self.last > self.first, own[self.last], 0)

    def sizes(self) -> np.ndarray:
        return self.sums(np.ones(len(self.clause)))

    def votes(self) -> np.ndarray:
        """The vote pattern of each window."""
        masks, at = np.unique(self.mask[self.first] | self.mask[self.last], return_inverse=True)
        return np.array([_votes(int(m)) for m in masks], np.int64)[at]


_votes = lru_cache(100_000)(votes_of)


def windows(texts: list[str | None]) -> Windows:
    """Cut texts into windows with their features and classes."""
    forms = [plain(t) for t in texts]
    joined = "\n".join(forms) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KINDS[np.minimum(cp, 0xFFFF)]
    after = np.append(kind[1:], np.uint8(SPACE))
    dot = cp == ord(".")
    end = (kind & END > 0) | dot & ((after & SPACE > 0) | np.append(dot[1:], False) | np.append(False, dot[:-1]))
    cut = end | (kind & CLAUSE > 0) & (after & DIGIT == 0)
    clause_at, sentence_at = np.cumsum(cut) - cut, np.cumsum(end) - end
    n = int(clause_at[-1]) + 1

    han, han_next = kind & HAN > 0, after & HAN > 0
    code = cp.astype(np.uint64)
    pair = np.flatnonzero(han & han_next)
    triple = pair[:-1][np.diff(pair) == 1] if len(pair) else pair
    alone = np.flatnonzero(han & ~han_next & ~np.append(False, han[:-1]))
    latin = kind & LATIN > 0
    start = np.flatnonzero(latin & ~np.append(False, latin[:-1]))
    stop = np.flatnonzero(latin & ~np.append(latin[1:], False)) + 1
    word = _word_hashes(code, start, stop)
    near = np.flatnonzero(clause_at[start[1:]] == clause_at[start[:-1]]) if len(start) > 1 else np.array([], np.int64)
    at = np.concatenate([pair, triple, alone, start, start[near]])
    grams = np.concatenate([
        code[pair] * _RANDOM[0] + code[pair + 1] * _RANDOM[1], code[triple] * _RANDOM[0] + code[triple + 1] * _RANDOM[1] + code[triple + 2] * _RANDOM[2] + _RANDOM[3],
        code[alone] * _RANDOM[5], word, word[near] * _RANDOM[0] + word[near + 1] * _RANDOM[1],
    ])
    order = np.argsort(clause_at[at], kind="stable")
    clause, hashed = clause_at[at][order], _mix(grams[order])

    mask = np.zeros(n, np.int64)
    for where, bits in _found(joined):
        mask[clause_at[where]] |= bits
    pair_keys, word_keys = _trade_keys()
    mask[clause_at[pair[np.isin(code[pair] << np.uint64(21) | code[pair + 1], pair_keys)]]] |= BIT["trade_zh"]
    mask[clause_at[start[np.isin(word, word_keys)]]] |= BIT["trade_en"]
    used = np.flatnonzero((np.bincount(clause, minlength=n) > 0) | (mask > 0))
    first_at = np.searchsorted(clause_at, used)
    sentence = sentence_at[first_at]
    same = np.flatnonzero(sentence[1:] == sentence[:-1])
    has_next, has_before = np.zeros(len(used), bool), np.zeros(len(used), bool)
    has_next[same], has_before[same + 1] = True, True
    lone = np.flatnonzero(~has_next & ~has_before)
    first, last = np.concatenate([used[same], used[lone]]), np.concatenate([used[same + 1], used[lone]])
    offsets = np.cumsum([0] + [len(f) + 1 for f in forms])
    text = np.searchsorted(offsets, first_at[np.concatenate([same, lone])], "right") - 1
    return Windows(text, first, last, clause, (hashed >> np.uint64(40)).astype(np.int64) % DIMENSIONS, hashed, mask)


def _found(s: str) -> list[tuple[int, int]]:
    """Place and classes of each word found; a word within a harmless compound does not count."""
    hits, compounds = [], []
    for end, (size, mask, left, right) in _automata()[1].iter(s):
        a = end - size + 1
        if left and _alnum(s, a - 1):
            continue
        if right and _alnum(s, end + 1):
            b = end + (2 if s[end + 1] == "s" else 3 if s.startswith("es", end + 1) else 0)
            if b == end or _alnum(s, b):
                continue
        hits.append((a, end, mask))
        if mask & BIT["compound"]:
            compounds.append((a, end))
    if compounds:
        covered = {i for a, b in compounds for i in range(a, b + 1)}
        spans = set(compounds)
        hits = [(a, b, m) for a, b, m in hits if a not in covered or b not in covered or (a, b) in spans]
    return [(a, m) for a, _, m in hits]


SIGN = np.array(SIGNS)
NAMES = VOTERS
#: Pseudo-votes by which a voter is at first taken to be right nine times in ten; bounds of the accuracies;
#: share of its weight that a vote for harmless keeps beside one for abusive, as a harmless clause says little about its neighbour.
PSEUDO, LEAST_ACCURACY, MOST_ACCURACY, BESIDE = 20.0, 0.55, 0.99, 0.3


class LabelModel:
    """A generative model of votes: each voter is right with its own accuracy whatever the label, and abstains at random.

    Fitted on the counts of vote patterns by expectation maximisation. Between voters that agree more than
    their accuracies explain, the conditional correlation discounts votes in the same pattern.
    """

    def __init__(self, patterns: dict[int, int], rounds: int = 40):
        bits = np.array(list(patterns), np.int64)
        self.x = (bits[:, None] >> np.arange(len(NAMES))) & 1
        self.n = np.array(list(patterns.values()), float)
        self.correlation = np.zeros((len(NAMES), len(NAMES)))
        self.accuracy = np.full(len(NAMES), 0.9)
        self.prior = 0.01
        for turn in range(2):  # accuracies; then correlations, and accuracies again with discounted votes
            for _ in range(rounds):
                post = self.posterior(self.x)
                right = np.where(SIGN > 0, (self.n * post) @ self.x, (self.n * (1 - post)) @ self.x)
                self.accuracy = np.clip((right + 0.9 * PSEUDO) / (self.n @ self.x + PSEUDO), LEAST_ACCURACY, MOST_ACCURACY)
                voted = self.x.any(axis=1)
                self.prior = float(np.clip((self.n * post)[voted].sum() / self.n.sum(), 1e-4, 0.3))
            if not turn:
                found = np.abs(self._correlations(post))
                self.correlation = np.where(found > 0.1, found, 0)
        self.by_bits = dict(zip(bits.tolist(), self.posterior(self.x).tolist(), strict=True))

    def _correlations(self, post: np.ndarray) -> np.ndarray:
        w = self.n * post
        centred = (self.x - w @ self.x / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None]
        cov = centred.T @ centred / max(w.sum(), 1e-9)
        scale = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        out = cov / scale[:, None] / scale[None, :]
        np.fill_diagonal(out, 0)
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """The probability of an abusive sentence; without any vote that is the share of abusive sentences."""
        weight = SIGN * np.log(self.accuracy / (1 - self.accuracy))
        beside = np.where((SIGN < 0)[None, :] & x[:, SIGN > 0].any(axis=1)[:, None], BESIDE, 1.0)
        logit = (x * weight * beside / (1 + x @ self.correlation)).sum(axis=1)
        return np.where(x.any(axis=1), 1 / (1 + np.exp(-logit)), self.prior)

    def accuracies(self) -> dict[str, float]:
        return {n: round(float(a), 4) for n, a, used in zip(NAMES, self.accuracy, self.n @ self.x, strict=True) if used}


def _rules(bits: np.ndarray) -> np.ndarray:
    """Vote patterns as rows of 0 and 1."""
    return ((bits[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


def train(rows: list[tuple[np.ndarray, int, float, float]], steps: int = 200, rate: float = 1.0, decay: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on (n-grams, votes, soft label, weight) by adaptive gradient steps over whole batches.

    The votes are features beside the n-grams, so that words which no sampled window has count as far as they
    belong to a class. Weights are brought to a sum of ``TOTAL``, so that ``decay`` means the same for any number of rows.
    """
    sizes = np.array([max(1, len(f)) for f, *_ in rows])
    flat = np.concatenate([f if len(f) else np.array([0]) for f, *_ in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    votes = _rules(np.array([r[1] for r in rows], np.int64))
    label, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    weight = weight * (TOTAL / weight.sum())
    scale = 1 / np.sqrt(sizes)
    w, b, seen, seen_b = np.zeros(DIMENSIONS + len(VOTERS)), 0.0, np.full(DIMENSIONS + len(VOTERS), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(of, w[flat], len(rows)) * scale + votes @ w[DIMENSIONS:] + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        grad = np.concatenate([np.bincount(flat, (error * scale)[of], DIMENSIONS), error @ votes]) + np.where(np.arange(len(w)) < DIMENSIONS, decay, 1e-2) * w
        seen += grad * grad
        seen_b += error.sum() ** 2
        w -= rate * grad / np.sqrt(seen)
        b -= rate * error.sum() / np.sqrt(seen_b)
    return w.astype(np.float32), float(b)


class Sample:
    """The windows of a task with the smallest hashes, of those with and without an abusive vote, at most ``most`` of each kind.

    All windows of the task whose hash is below ``below`` are in it.
    """

    def __init__(self, most: dict[bool, int]):
        self.most, self.below = most, {True: 1.0, False: 1.0}
        self.rows: dict[bool, list[tuple[float, int, np.ndarray]]] = {True: [], False: []}

    def add(self, own: Windows, bits: np.ndarray, drawn: np.ndarray) -> None:
        hot = bits & POSITIVE > 0
        starts = np.searchsorted(own.clause, np.arange(len(own.mask) + 1))
        buckets = own.bucket.astype(np.int32)
        for kind in (True, False):
            rows, most = self.rows[kind], self.most[kind]
            new = np.flatnonzero((hot == kind) & (drawn < self.below[kind]))
            whole = np.concatenate([np.array([r[0] for r in rows]), drawn[new]])
            if len(whole) > most:  # features are only taken of windows that stay
                self.below[kind] = float(np.partition(whole, most)[most])
                rows[:] = [r for r in rows if r[0] < self.below[kind]]
                new = new[drawn[new] < self.below[kind]]
            for i, d, v, a, b in zip(new.tolist(), drawn[new].tolist(), bits[new].tolist(), own.first[new].tolist(), own.last[new].tolist(), strict=True):
                grams = buckets[starts[a] : starts[a + 1]]
                rows.append((d, v, grams if a == b else np.concatenate([grams, buckets[starts[b] : starts[b + 1]]])))


READ = "kind string, bits long, n long, drawn double, grams array<int>"


def read_windows(texts: DataFrame, sample: int) -> DataFrame:
    """One pass over the texts: rows ``pattern`` (bits, n), ``window`` (bits, drawn, grams) and ``below`` (bits, drawn) of each task.

    A task keeps twice its share of the sample. The least ``below`` of all tasks is a share of the hashes of
    which every window of the corpus is there, whatever task has more than others.
    """
    tasks = max(1, texts.rdd.getNumPartitions())
    most = {True: 500 + 2 * sample // tasks, False: 1000 + 4 * sample // tasks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kept = Counter(), Sample(most)
        for batch in batches:
            for part, rows in chunks(batch, 1, BATCH_BYTES):
                own = windows(rows)
                bits = own.votes()
                values, n = np.unique(bits, return_counts=True)
                count.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
                content = np.zeros(len(own.mask), np.uint64)
                np.add.at(content, own.clause, own.hash)
                keys = np.array([(k or 0) & (2**63 - 1) for k in part.column(0).to_pylist()], np.uint64)
                # the content of a window is hashed with the row's key, as rows may share a key
                drawn = _mix(_mix(content[own.first] * _RANDOM[0] + content[own.last] * _RANDOM[1]) + keys[own.text] * _RANDOM[2]) / 2.0**64
                kept.add(own, bits, drawn)
        out = [("pattern", b, n, None, None) for b, n in count.items()]
        for kind in (True, False):
            out.append(("below", POSITIVE if kind else 0, None, kept.below[kind], None))
            out += [("window", b, None, d, g) for d, b, g in kept.rows[kind]]
        columns = zip(*out, strict=True)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    return cut(texts.mapInArrow(run, READ))


def pattern_counts(read: DataFrame) -> dict[int, int]:
    """How many windows of all documents have each pattern of votes; patterns are few, and their number is checked."""
    rows = read.filter("kind = 'pattern'").groupBy("bits").agg(F.sum("n").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError("too many vote patterns for the label model")
    return {r.bits: r.n for r in rows}


def sample_windows(read: DataFrame, sample: int) -> list[tuple[np.ndarray, int, float]]:
    """(features, votes, weight) of ``sample`` windows with an abusive vote, and twice as many without, or of all if there are fewer.

    Windows of equal features and votes are one row; its weight is their number over the share of the hashes they
    are from, which estimates that of all such windows.
    """
    below = {r.hot: r.below for r in read.filter("kind = 'below'").groupBy((F.col("bits") != 0).alias("hot")).agg(F.min("drawn").alias("below")).collect()}
    rows = read.filter("kind = 'window'").withColumn("hot", F.col("bits").bitwiseAND(POSITIVE) != 0)
    out: list[tuple[np.ndarray, int, float]] = []
    for hot, most in ((True, sample), (False, 2 * sample)):
        least = below.get(hot, 1.0)
        found = rows.filter(F.col("hot") == F.lit(hot)).filter((F.col("drawn") < least) | F.lit(least >= 1.0)).select("drawn", "bits", "grams").orderBy("drawn").limit(most + 1).collect()
        share = found[most].drawn if len(found) > most else least
        same = Counter((r.bits, tuple(sorted(r.grams))) for r in found[:most])
        out += [(np.array(g, np.int64), b, n / share) for (b, g), n in sorted(same.items())]
    return out


def fit(documents: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel | None, np.ndarray, float]:
    texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL"))
    read = read_windows(texts, sample)
    patterns = pattern_counts(read)
    if not patterns:
        return None, np.zeros(DIMENSIONS + len(VOTERS), np.float32), -30.0
    model = LabelModel(patterns)
    rows = sample_windows(read, sample)
    labels = [model.by_bits.get(b, 0.0) for _, b, _ in rows]
    hot = max(1.0, sum(y * n for y, (_, _, n) in zip(labels, rows, strict=True)))
    balance = max(1.0, (sum(n for _, _, n in rows) - hot) / hot) ** 0.5
    w, b = train([(f, bits, y, n * (balance if y > 0.5 else 1.0)) for (f, bits, n), y in zip(rows, labels, strict=True)])
    return model, w, b


def scored(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, source, score) of each document. The weights, of fixed size, are sent to each executor once."""
    sent = documents.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            for part, texts in chunks(batch, 2, BATCH_BYTES):
                own = windows(texts)
                size = own.sizes()
                patterns, at = np.unique(own.votes(), return_inverse=True)
                z = own.sums(w[own.bucket]) / np.sqrt(np.maximum(size, 1)) + (_rules(patterns) @ w[DIMENSIONS:])[at] + b
                worst = np.full(len(texts), -700.0)
                np.maximum.at(worst, own.text, z)
                score = np.where(worst > -700.0, 1 / (1 + np.exp(-np.clip(worst, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64())], names=["doc_id", "source", "score"])

    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).mapInArrow(run, "doc_id long, source string, score double")


def _documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "source", "text")


def p10_scores(spark, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return scored(documents, *fit(documents)[1:])


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter(F.col("score") >= FOUND_FROM).select("doc_id").distinct()


def p10_rates(spark, sf_dir: str) -> DataFrame:
    """Per source: documents, found ones and their share."""
    return p10_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= FOUND_FROM).alias("found"), F.avg((F.col("score") >= FOUND_FROM).cast("double")).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
