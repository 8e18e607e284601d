"""Language of whole texts by piece probabilities per language, summed over all segmentations of each word.

A word is a run of letters and marks on them, with a marker before it, lower-cased. Its probability in a language is the sum, over all
ways to cut it into pieces of a fixed public vocabulary, of the product of the pieces' probabilities; a forward pass
gives the sum, and with a backward pass the pieces' expected counts, from which the probabilities are learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.pieces import MARK
from sluice.llm.text import PART, PieceTable, groups, parts, short_batches, text_column

#: Longer runs of letters are cut every so many letters.
LONGEST = 48
#: Factor a letter, so that products of small probabilities stay in range; taken out of the logarithm again.
_LIFT = 300.0
#: Expected counts are added up as whole numbers of this part, so that sums do not depend on their order.
_UNIT = 1 << 16

_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_piece = regex.compile(r"[\p{L}\p{M}]+")
#: The same runs in texts without characters from U+0300 on, where marks begin.
_near_letters = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x300) if regex.match(r"\p{L}", chr(c))) + "]+")
_far = re.compile("[\u0300-\U0010ffff]")


def letter_words(text: str) -> list[str]:
    """Runs of letters (and marks on them) of a text, lower-cased, cut every ``LONGEST`` letters."""
    low = text.lower()
    found = (_letters if _far.search(low) else _near_letters).findall(low)
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i:i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def word_counts(text: str) -> Counter:
    """Words of a whole text and how often they occur; a long text is taken in parts."""
    if len(text) <= PART:
        return Counter(letter_words(text))
    out: Counter = Counter()
    for part in parts(text):
        out.update(letter_words(part))
    return out


def has_letter(text: str) -> bool:
    return _letters.search(text) is not None


class Trie:
    """Finds all pieces in a text, for all of its places at once: a step down for each letter, by a table of (node, letter)."""

    def __init__(self, ids: dict[str, int]):
        letters = sorted(set("".join(ids)))
        self.letter = np.zeros(ord(letters[-1]) + 2, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters, self.longest = len(letters) + 1, max(map(len, ids))
        number, child = {c: i for i, c in enumerate(letters, 1)}, {}
        piece = [-1]
        for name, i in ids.items():
            node = 0
            for c in name:
                key = node * self.letters + number[c]
                if key not in child:
                    child[key] = len(piece)
                    piece.append(-1)
                node = child[key]
            piece[node] = i
        self.piece = np.array(piece)
        self.bits = max(4, (8 * len(child)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys, nodes = np.array(list(child)), np.array(list(child.values()))
        at = self._slot(keys)
        while len(keys):  # those that find their slot free take it, one each; the others try the next
            free = np.flatnonzero(self.keys[at] < 0)
            taken = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[taken]], self.child[at[taken]] = keys[taken], nodes[taken]
            left = np.delete(np.arange(len(keys)), taken)
            keys, nodes, at = keys[left], nodes[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _down(self, keys: np.ndarray) -> np.ndarray:
        """Child of each (node, letter), 0 where there is none."""
        slot, out = self._slot(keys), np.zeros(len(keys), np.int64)
        held = self.keys[slot]
        same = held == keys
        out[same] = self.child[slot[same]]
        rest = np.flatnonzero(~same & (held >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.child[slot[rest[same]]]
            rest = rest[~same & (held >= 0)]
        return out

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of its last letter, id) of each piece that occurs."""
        letter = np.append(self.letter[np.minimum(codes, len(self.letter) - 1)], np.zeros(self.longest, np.int64))
        at, node, ends, ids = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], []
        for depth in range(self.longest):
            here = letter[at + depth]
            some = here > 0
            at, node = at[some], self._down(node[some] * self.letters + here[some])
            some = node > 0
            at, node = at[some], node[some]
            piece = self.piece[node]
            hit = piece >= 0
            ends.append(at[hit] + depth)
            ids.append(piece[hit])
        return np.concatenate(ends), np.concatenate(ids)


class Vocabulary:
    """Pieces a word can be cut into, and the byte pieces that stand for characters no piece has."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.ids = {names[i]: i for i in plain if names[i] == MARK or _piece.fullmatch(names[i].removeprefix(MARK))}
        self.of_byte = {int(names[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.letters = np.array([len(n) for n in names])
        self.longest = max(map(len, self.ids))
        self.characters = np.array([ord(n) for n in self.ids if len(n) == 1], np.uint32)
        self.trie = Trie(self.ids)
        #: Before anything is learned a piece is as likely as its rank among all says; ids stand in order of rank.
        rank = np.zeros(self.size)
        used = sorted([*self.ids.values(), *self.of_byte.values()])
        rank[used] = 1 / (10 + np.arange(len(used)))
        self.start = rank / rank.sum()


@dataclass
class Lattice:
    """All pieces that occur in some words, by the place where they end and their length."""

    words: int
    length: np.ndarray  # letters and marker of each word
    steps: list[tuple[int, int, np.ndarray, np.ndarray]]  # end, length, words, piece ids
    known: np.ndarray  # [word, place]: the character there is a piece of its own
    bytes_of: list[tuple[int, list[int]]]  # word and byte pieces of each character that is not


def lattice(words: list[str], vocabulary: Vocabulary) -> Lattice:
    """All words are searched at once, joined by line ends, which no piece holds."""
    length = np.array([len(w) + 1 for w in words], np.int64)
    width, joined = int(length.max(initial=1)), "".join(f"{MARK}{w}\n" for w in words)
    begin = np.cumsum(length + 1) - length - 1
    word = np.repeat(np.arange(len(words)), length + 1)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    last, piece = vocabulary.trie.find(codes)
    of = word[last]
    end, size = last - begin[of] + 1, vocabulary.letters[piece]
    place = (end * (vocabulary.longest + 1) + size).astype(np.uint16)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=0))
    steps = [(int(end[some[0]]), int(size[some[0]]), of[some], piece[some]) for some in np.split(order, cuts)[1:]]
    known, strange = np.ones((len(words), width), bool), []
    for at in np.flatnonzero(~(np.isin(codes, vocabulary.characters) | (codes == 10))):
        w = int(word[at])
        known[w, at - begin[w]] = False
        strange.append((w, [vocabulary.of_byte[b] for b in joined[at].encode()]))
    return Lattice(len(words), length, steps, known, strange)


def _forward(cut: Lattice, p: np.ndarray) -> np.ndarray:
    """[place, word, language]: lifted probability of all ways to write what is before the place.

    A character without a piece counts 1 here; its bytes are added in the logarithm.
    """
    width = cut.known.shape[1]
    alpha = np.zeros((width + 1, cut.words, p.shape[1]))
    alpha[0] = 1
    k = 0
    for end in range(1, width + 1):
        strange = ~cut.known[:, end - 1]
        if strange.any():
            alpha[end, strange] = alpha[end - 1, strange]
        while k < len(cut.steps) and cut.steps[k][0] == end:
            _, size, words, pieces = cut.steps[k]
            alpha[end, words] += alpha[end - size, words] * p[pieces] * _LIFT ** size
            k += 1
    return alpha


def log_probabilities(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """[word, language]: logarithm of the sum over all segmentations; ``p`` is [piece, language]."""
    if not words:
        return np.zeros((0, p.shape[1]))
    cut = lattice(words, vocabulary)
    alpha = _forward(cut, p)
    lifted = cut.length - np.bincount(np.array([w for w, _ in cut.bytes_of], np.int64), minlength=cut.words)
    out = np.log(alpha[cut.length, np.arange(cut.words)]) - np.log(_LIFT) * lifted[:, None]
    for w, pieces in cut.bytes_of:
        out[w] += np.log(p[pieces]).sum(axis=0)
    return out


def expected_counts(words: list[str], times: np.ndarray, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """[piece, language]: how often each piece is expected in words that occur ``times`` [word, language].

    ``p`` has a column for each language, or one for all.
    """
    out = np.zeros((len(p), times.shape[1]))
    if not words:
        return out
    cut = lattice(words, vocabulary)
    alpha = _forward(cut, p)
    beta = np.zeros_like(alpha)
    beta[cut.length, np.arange(cut.words)] = 1
    share = times / alpha[cut.length, np.arange(cut.words)]
    for begin in range(cut.known.shape[1] - 1, -1, -1):
        strange = ~cut.known[:, begin]
        if strange.any():
            beta[begin, strange] = beta[begin + 1, strange]
        for end, size, some, pieces in (s for s in cut.steps if s[0] - s[1] == begin):
            beta[begin, some] += beta[end, some] * p[pieces] * _LIFT ** size
    for end, size, some, pieces in cut.steps:
        flow = alpha[end - size, some] * p[pieces] * _LIFT ** size * beta[end, some] * share[some]
        for c in range(out.shape[1]):
            out[:, c] += np.bincount(pieces, flow[:, c], len(out))
    for w, pieces in cut.bytes_of:
        for piece in pieces:
            out[piece] += times[w]
    return out


def _of_like_length(words: list[str], many: int = 4096) -> Iterator[list[str]]:
    """Words by length, in lists whose words times longest word is bounded."""
    words = sorted(words, key=len)
    at = 0
    while at < len(words):
        step = many
        while step > 64 and step * (len(words[min(at + step, len(words)) - 1]) + 2) > 16 * many:
            step //= 2
        yield words[at:at + step]
        at += step


@dataclass
class LanguageModel:
    path: str  # of the vocabulary
    languages: list[str]
    p: np.ndarray  # [piece, language]
    prior: np.ndarray

    def table(self) -> PieceTable:
        vocabulary = _vocabulary(self.path)

        def compute(words: list[str]) -> Iterator[bytes]:
            return (row.tobytes() for row in log_probabilities(words, vocabulary, self.p))

        return PieceTable(compute, batch_bytes=1 << 15)

    def predict(self, texts: list[str | None], table: PieceTable) -> tuple[list[str], list[float]]:
        """The likeliest language of each text (ties: the first by name) and its probability among all."""
        counted = [word_counts(t or "") for t in texts]
        known = table.learn([list(c) for c in counted]).__getitem__
        names, scores = [], []
        for words in counted:
            if not words or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            logs = np.frombuffer(b"".join(map(known, words)), np.float64).reshape(len(words), -1)
            whole = np.fromiter(words.values(), np.float64, len(words)) @ logs + np.log(self.prior)
            best = int(whole.argmax())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(whole - whole[best]).sum()))
        return names, scores


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def held_out(doc_id: Column) -> Column:
    """Rows that learning must not see: crc32 of the id as text has remainder 2 by 4. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, vocabulary: str, rounds: int = 1, floor: float = 0.02, text: str = "text",
                  key: str = "doc_id", lang: str = "lang") -> LanguageModel:
    """Piece probabilities of each language from the whole texts of all rows that are not held out and name a language.

    Each of the ``rounds`` is one pass over all these texts: every task adds up the expected counts of the pieces,
    language by language, and hands over one row for each piece and language it met. So what is shuffled and what
    reaches the driver is bounded by vocabulary times languages, while the counts cover the corpus. ``floor`` is the
    share given to the probabilities before learning, so that no piece is impossible. Names of languages are taken
    as they are; without any row there is none. The prior is a language's share of these rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.where(~held_out(docs[key]) & docs[lang].isNotNull()).select(text_column(docs, text).alias("text"), docs[lang].cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    words = _vocabulary(vocabulary)
    prior = np.array([sizes[n] for n in names], float) / max(1, sum(sizes.values()))
    p = words.start[:, None]
    for _ in range(rounds if names else 0):
        counts = np.zeros((len(p), len(names)))
        for r in _counted(rows, vocabulary, names, p).collect():
            counts[r["piece"], r["language"]] = r["n"] / _UNIT
        total = counts.sum(axis=0)
        learned = np.divide(counts, total, out=np.repeat(words.start[:, None], len(names), axis=1), where=total > 0)
        p = (1 - floor) * learned + floor * words.start[:, None]
    return LanguageModel(vocabulary, names, np.broadcast_to(p, (len(p), len(names))), prior)


def _counted(rows: DataFrame, path: str, names: list[str], p: np.ndarray) -> DataFrame:
    place = {n: i for i, n in enumerate(names)}

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, total = _vocabulary(path), np.zeros((len(p), len(names)))
        times: dict[str, np.ndarray] = {}

        def settle() -> None:
            for some in _of_like_length(list(times)):
                total[:] += expected_counts(some, np.array([times[w] for w in some]).reshape(len(some), -1), vocabulary, p)
            times.clear()

        for batch in batches:
            for some in groups(list(batch["text"])):
                langs = [place[n] for n in batch["lang"][:len(some)]]
                batch = batch.iloc[len(some):]
                for text, language in zip(some, langs):
                    for word, n in word_counts(text).items():
                        row = times.get(word)
                        if row is None:
                            row = times[word] = np.zeros(len(names))
                        row[language] += n
                if len(times) > 200_000:
                    settle()
        settle()
        piece, language = np.nonzero(total)
        n = np.rint(total[piece, language] * _UNIT).astype(np.int64)
        yield pd.DataFrame({"piece": piece.astype(np.int32), "language": language.astype(np.int32), "n": n})

    return rows.mapInPandas(expected, "piece int, language int, n long").groupBy("piece", "language").agg(F.sum("n").alias("n"))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, a learned language or ``und`` where the text is null or has no letter, and its score.

    The score is the probability of lang_pred given the whole text and the learned priors, 0 for ``und``. Equal texts
    get equal answers. Columns named like the new ones are replaced. One pass, no shuffle; the model travels with
    the tasks (vocabulary times languages numbers). Each distinct word is summed over its segmentations once per worker
    as long as the table of words has room.
    """
    short_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = broadcast.value
        table = known.table()
        for texts in batches:
            rows = [known.predict(some, table) for some in groups(list(texts))]
            yield pd.DataFrame({"lang_pred": [n for r in rows for n in r[0]], "score": [s for r in rows for s in r[1]]})

    held = max(docs.columns, key=len) + "_made"
    made = docs.withColumn(held, predicted(text_column(docs, text)))
    return made.withColumns({n: F.col(f"`{held}`.{n}") for n in ("lang_pred", "score")}).drop(held)
