"""Toxicity by noisy-channel deobfuscation.

1. A character model (trigrams over letters and word ends) is counted over all documents in Spark.
2. Stretches that look disguised (digits or signs beside letters, letters set apart, letters doubled) become a
   lattice: what each character may stand for, may have been put in for, or repeats. Viterbi's algorithm picks
   the likeliest plain reading under the channel's costs and the character model.
3. The restored text is scored: its words and word beginnings that mark toxic text in the labelled rows raise
   the score, each by how surely it marks it.

The marks are learned from at most ``sample`` labelled rows (30,000; the smallest by hash of the id), never from
held-out rows (crc32 of the id as text, remainder 0 by 5), in at most ``rounds`` rounds over the ``most`` words found
most often in toxic rows; words of less than three letters, and those of less than five toxic rows, are no marks.
Labels, language, source and id are no inputs of a score. The words of the sampled rows are decoded once and kept.

Defined results: null and empty texts hold no word and score the base rate of texts without marks; a text's
score depends on its words alone, so repeated rows get equal scores; texts are read whole; where no labelled row is
toxic (an empty table of labels too) every score is 0; rows without a label are scored all the same; other
columns stay; a document labelled twice counts as toxic if any of its labels says so.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import discard, keep, slices

# What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
APART = " .-_*~/"
A = 28  # symbols of the character model: word end, 26 letters, any other letter
_OTHER = 27
_CODE = {chr(97 + i): i + 1 for i in range(26)}
_SIGNS = re.escape("".join(c for c in LEET if not c.isdigit()))
_UNIT = re.escape("".join(c for c in LEET if not c.isdigit() and c not in APART))
#: Disguised stretches: letters or signs set apart; letters with signs or digits anywhere within a token; a doubled letter.
_SET_APART = re.compile(rf"(?<![^\W_])(?<![{_UNIT}])(?:(?:[^\W_]|[{_UNIT}])[{re.escape(APART)}]{{1,2}}){{3,}}(?:[^\W_]|[{_UNIT}])(?![^\W_]|[{_UNIT}])")
_SIGNED = re.compile(rf"(?<![^\W_])(?<![{_SIGNS}])(?=[0-9{_SIGNS}]*+[^\W\d_])(?=[^\W\d_]*+[0-9{_SIGNS}])(?:[^\W_]|[{_SIGNS}])++")
_HAS_SIGN = re.compile(rf"(?<!\S)[^\s0-9{_SIGNS}]*+[0-9{_SIGNS}]\S*+")
_DOUBLED, _RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1+")
_WORDS = re.compile(r"[^\W\d_]+")
_LEAST, _PREFIX = 3, (4, 5, 6)
_ENDS = "".join(c for c in LEET if not c.isdigit())
_SLICE = 1 << 20  # bytes of texts that are handled at once
_MEMO = 20 << 20  # bytes that a memo holds, about


# ---------------------------------------------------------------- character model

_BYTES = np.zeros(256, np.uint8)
for _c, _i in _CODE.items():
    _BYTES[ord(_c)] = _BYTES[ord(_c.upper())] = _i
_BYTES[128:] = _OTHER


def trigrams(data: bytes) -> np.ndarray:
    """Counts of three symbols in a row; runs of anything but letters are one word end."""
    code = _BYTES[np.frombuffer(b"  " + data + b" ", np.uint8)].astype(np.int32)
    keep = np.ones(len(code), bool)
    keep[2:] = (code[2:] > 0) | (code[1:-1] > 0)
    code = code[keep]
    return np.bincount((code[:-2] * A + code[1:-1]) * A + code[2:], minlength=A**3)


def count_trigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts: at most 28 ** 3 rows, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for batch in slices(batches, text, _SLICE):
            total += trigrams("  ".join(t or "" for t in batch.column(text).to_pylist()).encode("utf-8", "surrogatepass"))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gram", "n"])

    return df.select(text).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(df: DataFrame, text: str = "text") -> bytes:
    """-log probabilities (float32) of the third symbol after two, interpolated with shorter contexts."""
    n3 = np.zeros((A, A, A))
    for row in count_trigrams(df, text).collect():
        n3[row.gram // (A * A), row.gram // A % A, row.gram % A] = row.n
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1)) + 1
    p1 = n1 / n1.sum()
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    p3 = (n3 + 20 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 20)
    return (-np.log(p3)).astype(np.float32).tobytes()


# ---------------------------------------------------------------- decoding


@functools.lru_cache(maxsize=4096)
def readings(c: str) -> list[tuple[str, float]]:
    """What an observed character may mean, with the channel's cost: a letter, a word end (#), or nothing."""
    if c.isalpha():
        return [(c, 0.0)]
    out = [(x, 1.0 + 0.7 * (len(LEET[c]) > 2)) for x in LEET.get(c, "")]
    if c in APART:
        out += [("", 0.5), ("#", 1.0)]
    return out + [("", 7.0), ("#", 5.0)] * (c not in APART)


class Memo(dict):
    """A dictionary that is emptied when what it holds grows beyond _MEMO bytes."""

    size = 0

    def put(self, key: str, value, n: int) -> None:
        if self.size > _MEMO:
            self.clear()
            self.size = 0
        self[key] = value
        self.size += len(key) + n + 200  # with what objects and their table take


class Decoder:
    """Viterbi's algorithm over the lattice of one stretch; states are the last two symbols read."""

    def __init__(self, model: bytes) -> None:
        self.cost = np.frombuffer(model, np.float32).reshape(A, A, A).tolist()
        self.memo = Memo()

    def __call__(self, stretch: str) -> str:
        found = self.memo.get(stretch)
        if found is None:
            found = self.decode(stretch)
            self.memo.put(stretch, found, len(found))
        return found

    def decode(self, stretch: str) -> str:
        """The likeliest plain reading, words parted by spaces."""
        text = stretch.lower()
        code = {c: _CODE.get(c, _OTHER) for c in text} | _CODE | {"#": 0}
        cost_of = self.cost
        # state: (before last, last) -> (cost, linked list of what was read)
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("#", "#"): (0.0, None)}
        for c in text:
            if len(states) == 1 and c.isalpha():  # one state and one reading, unless the letter repeats
                ((a, b), (cost, read)) = next(iter(states.items()))
                if c != b:
                    states = {(b, c): (cost + cost_of[code[a]][code[b]][code[c]], (read, c))}
                    continue
            states = self._step(states, c, readings(c), code)
        states = self._step(states, "", [("#", 0.0)], code)
        _, link = min(states.values(), key=lambda x: x[0])
        out = []
        while link:
            link, symbol = link
            out.append(" " if symbol == "#" else symbol)
        return "".join(reversed(out)).strip()

    def _step(self, states: dict, c: str, ways: list[tuple[str, float]], code: dict[str, int]) -> dict:
        """All states after one more character; of two symbols of 28 each, all are kept."""
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (cost, read) in states.items():
            row = self.cost[code[a]][code[b]]
            for symbol, price in [*ways, ("", 0.6)] if c == b else ways:
                if symbol == "" or (symbol == "#" and b == "#"):
                    state, total, link = (a, b), cost + price, read
                else:
                    state, total, link = (b, symbol), cost + price + row[code[symbol]], (read, symbol)
                if state not in new or total < new[state][0]:
                    new[state] = (total, link)
        return new


def restore(text: str, decode) -> list[str]:
    """Plain readings of the disguised stretches of a text in lower case, words with doubled letters apart."""
    out = []
    for m in (*_SET_APART.finditer(text), *(m for token in _HAS_SIGN.findall(text) for m in _SIGNED.finditer(token))):
        out.append(decode(m[0]))
        bare = m[0].strip(_ENDS)  # signs at the ends may be marks of the sentence
        if bare != m[0] and not bare.isalpha():
            out.append(decode(bare))
    return out


def drawn_out(word: str, decode) -> list[str]:
    """Plain readings of a word with doubled letters: the likeliest, and that with one letter of each run."""
    return [decode(word), _RUN.sub(r"\1", word)] if _DOUBLED.search(word) else []


# ---------------------------------------------------------------- marks


def features(words: set[str]) -> set[str]:
    """Words of three letters or more, and their beginnings (with a hyphen)."""
    long = {w for w in words if len(w) >= _LEAST}
    return long | {w[:k] + "-" for w in long for k in _PREFIX if len(w) > k}


class Reader:
    """The words of a text, plain and restored. ``of`` says what is wanted of words; it is asked once for each distinct one.

    ``worth`` says by a word with one letter of each run whether any reading of its drawn-out letters can matter.
    """

    def __init__(self, decode, of=frozenset, worth=lambda bare: True) -> None:
        self.decode, self.of, self.worth, self.memo = decode, of, worth, Memo()

    def __call__(self, text: str | None) -> set:
        low = (text or "").lower()
        found: set = set()
        get = self.memo.get
        for word in set(_WORDS.findall(low)):
            got = get(word)
            if got is None:
                words = {word}
                if _DOUBLED.search(word) and self.worth(_RUN.sub(r"\1", word)):
                    words.update(*(x.split() for x in drawn_out(word, self.decode)))
                got = self.of(words)
                self.memo.put(word, got, sum(map(len, got)))
            if got:
                found |= got
        for plain in restore(low, self.decode):
            found |= self.of(frozenset(plain.split()))
        return found


@functools.lru_cache(maxsize=1)
def _decoder(model: bytes) -> Decoder:
    return Decoder(model)


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 5 == 0, F.lit(False))


def decoded(df: DataFrame, model: bytes) -> DataFrame:
    """(toxic, words) of the rows (toxic, text), words plain and restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(_decoder(model))
        for batch in slices(batches, "text", _SLICE):
            words = pa.array([sorted(read(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), words], ["toxic", "words"])

    return df.select("toxic", "text").mapInArrow(run, "toxic int, words array<string>")


def counted(rows: DataFrame, marks: dict[str, float], only: frozenset | None, least: int, most: int) -> dict[str, int]:
    """In how many rows without any of the marks each feature (of ``only``) is found; of those in ``least`` rows or more the ``most`` frequent."""
    whole, starts = _lookup(tuple(sorted(marks.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["f", "n"])
        for batch in batches:
            for words in batch.column("words"):
                words = words.as_py()
                if _names(words, whole, starts):
                    continue
                found = features(set(words))
                for f in found if only is None else found & only:
                    total[f] = total.get(f, 0) + 1
                if len(total) > 100_000:
                    yield batch_of()
                    total.clear()
        yield batch_of()

    got = rows.select("words").mapInArrow(run, "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r.f: r.n for r in got.orderBy(F.desc("n"), "f").limit(most).collect()}


def without(rows: DataFrame, marks: dict[str, float]) -> DataFrame:
    """The rows whose words hold no mark."""
    whole, starts = _lookup(tuple(sorted(marks.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not _names(words.as_py(), whole, starts) for words in batch.column("words")], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def learn(df: DataFrame, labels: DataFrame, model: bytes, ident: str = "doc_id", text: str = "text", sample: int = 30_000, most: int = 20_000, rounds: int = 8, rare: int = 10) -> tuple[dict[str, float], float]:
    """(how surely each mark means toxic, how likely a text without marks is toxic), from the sampled labelled rows."""
    known = labels.filter(~held_out(F.col(ident)) & F.col("toxic").isNotNull()).groupBy(ident).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(ident), ident).limit(sample)  # bounded: fit for a broadcast
    chosen = chosen.select(F.col(ident).alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
    rows = df.select(F.col(ident).alias("__row"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__row") == F.col("__id"))
    once = rows.groupBy("text").agg(F.max("__toxic").alias("toxic"))
    rows = keep(decoded(once.repartition(spark_parts(df)), model), "words")
    n0, n1 = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n1:
        return {}, 0.0
    # what frequent marks explain is set aside before rarer ones are sought, or the other words of a few
    # toxic texts (and of their near copies) would pass for marks
    marks: dict[str, float] = {}
    toxic_rows, plain = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    for _ in range(rounds):
        n_left = without(toxic_rows, marks).count()
        if n_left < max(rare, n1 // 50):
            break
        toxic = counted(toxic_rows, marks, None, max(5, n_left // 50), most)
        clean = counted(plain, {}, frozenset(toxic), 1, most)
        new = {f: sure for f, n in toxic.items() if (sure := _sure(n, clean.get(f, 0))) > 0.6}
        # a beginning is told by its words: it is a mark only where it marks half as many texts again as any of those
        for f in [f for f in new if f.endswith("-")]:
            if toxic[f] <= 1.5 * max((toxic[g] for g in new if g != f and g.startswith(f[:-1])), default=0):
                del new[f]
        # of marks that come together, the one found most often; the others must show themselves in what is left
        top = max((toxic[f] for f in new), default=0)
        new = {f: sure for f, sure in new.items() if toxic[f] >= top / 3}
        if not new:
            break
        marks |= new
    n0, n1 = without(rows, marks).agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    discard(rows)
    return marks, (n1 + 0.5) / (n0 + n1 + 1)


def spark_parts(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def _sure(n: int, other: int, z2: float = 4.0) -> float:
    """How surely a mark of n toxic and ``other`` texts means toxic: the lower end of Wilson's interval, at two deviations."""
    total, p = n + other, n / (n + other)
    return (p + z2 / 2 / total - math.sqrt(z2 * (p * (1 - p) + z2 / 4 / total) / total)) / (1 + z2 / total)


# ---------------------------------------------------------------- scores

_NOTHING: frozenset = frozenset()

@functools.lru_cache(maxsize=2)
def _lookup(marks: tuple[tuple[str, float], ...]) -> tuple[dict[str, float], list[tuple[int, dict[str, float]]]]:
    whole = {f: s for f, s in marks if not f.endswith("-")}
    starts = [(k, {f[:-1]: s for f, s in marks if f.endswith("-") and len(f) == k + 1}) for k in _PREFIX]
    return whole, [(k, d) for k, d in starts if d]


def _worth(marks: tuple[tuple[str, float], ...]):
    """Whether a word, given with one letter of each run, can have a reading that is a mark: marks with their runs cut
    down are compared, for a reading differs from the word in the lengths of its runs alone."""
    bare = {_RUN.sub(r"\1", f.removesuffix("-")): f.endswith("-") for f, _ in sorted(marks, key=lambda m: m[0].endswith("-"))}
    starts = {f for f, start in bare.items() if start}
    lengths = sorted({len(f) for f in starts})
    return lambda word: word in bare or any(word[:k] in starts for k in lengths)


def _names(words: Iterable[str], whole: dict[str, float], starts: list[tuple[int, dict[str, float]]]) -> set[str]:
    """The surest mark of each word that has any."""
    hit: set[str] = set()
    for w in words:
        sure, name = whole.get(w, 0.0), w
        for k, known in starts:
            s = known.get(w[:k], 0.0) if len(w) > k else 0.0
            if s > sure:
                sure, name = s, w[:k]
        if sure:
            hit.add(name)
    return hit


def _score(hit: set[str], whole: dict[str, float], starts: list[tuple[int, dict[str, float]]], base: float) -> float:
    """1 less the product of what each distinct mark leaves open."""
    open_ = 1.0
    for name in sorted(hit):
        open_ *= 1 - max(whole.get(name, 0.0), *(d.get(name, 0.0) for _, d in starts), 0.0)
    return 1 - open_ if hit else base


def scored(df: DataFrame, marks: dict[str, float], base: float, model: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """df with the column ``out``."""
    fixed = tuple(sorted(marks.items()))
    others = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, starts = _lookup(fixed)
        read = Reader(_decoder(model), lambda words: _names(words, whole, starts) or _NOTHING, _worth(fixed))
        for batch in slices(batches, text, _SLICE):
            values = pa.array([_score(read(t), whole, starts, base) for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], values], [*others, out])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.DoubleType())]))


def fit(documents: DataFrame, labels: DataFrame, **options) -> tuple[dict[str, float], float, bytes]:
    """Character model and marks, for ``scored``."""
    model = character_model(documents)
    marks, base = learn(documents, labels, model, **options)
    return marks, base, model
