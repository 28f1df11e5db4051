"""Spelling variants: words that differ in one code point, found by search in two-way suffix indexes.

A word is cut into halves. Whatever differs from it in one place leaves one half whole, so the word is searched twice: its left
half exactly and then, to the right, the other with one error; and its right half exactly and then, to the left, the other.
The index of a set of words is that of the text in which a delimiter stands between them, forwards and backwards: an interval of
sorted suffixes for what has been read so far, kept in both directions at once, so that reading may turn round between the
halves. All searches of a set go forward together, one code point a step, as arrays of intervals.

No task holds the vocabulary. A word is filed under the beginnings and the ends that half of such a word can be, and searched
only where its own half is filed. What shares a hash of that half makes a shard; a half that very many words share is filed in
several shards of bounded size, and words that search it visit each of them. Every shard tells, per searched word, the number of
variants and the commonest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize, release

RUN = r"[A-Za-zÀ-ÿ]+"
DELETES = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2
# Words filed in one shard, about; a half that more words share has several shards.
SHARD_WORDS = 20_000
# Words that a shard searches together.
QUERIES = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# ---- Suffix index ---------------------------------------------------------------------------------------------------------


class Wavelet:
    """A sequence of small numbers: how often one occurs before a place, how many smaller ones a stretch has, which ones it has."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.counts = bits, [], []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int64))
            self.counts.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of `value` before `low` and before `high`, and of smaller values between them."""
        start, less = np.zeros_like(low), np.zeros_like(low)
        for level, (zeros, count) in enumerate(zip(self.zeros, self.counts)):
            one = (value >> (self.bits - 1 - level) & 1).astype(bool)
            a, b, s = zeros[low], zeros[high], zeros[start]
            less += np.where(one, b - a, 0)
            low, high, start = np.where(one, count + low - a, a), np.where(one, count + high - b, b), np.where(one, count + start - s, s)
        return low - start, high - start, less

    def distinct(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every different value of each stretch: the stretch, the value, its number before and up to the end."""
        which, value, start = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros_like(low)
        for zeros, count in zip(self.zeros, self.counts):
            a, b, s = zeros[low], zeros[high], zeros[start]
            left, right = b > a, (high - low) > (b - a)
            which = np.concatenate([which[left], which[right]])
            value = np.concatenate([2 * value[left], 2 * value[right] + 1])
            start = np.concatenate([s[left], (count + start - s)[right]])
            low, high = np.concatenate([a[left], (count + low - a)[right]]), np.concatenate([b[left], (count + high - b)[right]])
        return which, value, low - start, high - start


class _Side:
    """Sorted suffixes of sorted distinct words, a delimiter (0, below all letters) before each."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, bits: int):
        count = len(lengths)
        begins = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(len(codes) + count, np.int64)
        letters = np.ones(len(text), bool)
        letters[begins] = False
        text[letters] = codes
        # Suffixes end at the next delimiter; delimiters stand in the order of the words behind them.
        rank = np.where(letters, text + count, 0)
        rank[begins] = np.arange(count)
        base = len(text) + count + (1 << bits)
        reach = np.append(np.arange(1, len(text)), 0)
        while True:
            key = rank * base + np.where(letters, rank[reach], 0)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
            if rank[order[-1]] == len(text) - 1:
                break
            reach = reach[reach]
        self.owner = np.repeat(np.arange(count), lengths + 1)[order]
        self.wavelet = Wavelet(text[order - 1], bits)  # what stands before each suffix; before the first, the last
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])


def _coded(words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers from 1 on, 0 for one that is not among `letters`; and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
    return np.where(letters[at] == points, at + 1, 0), np.array([len(w) for w in words], np.int64)


class TwoWayIndex:
    """Index of distinct words, at least one."""

    def __init__(self, words: list[str]):
        self.letters = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"))
        bits = len(self.letters).bit_length()
        self.sides, self.orders = [], []
        for directed in (words, [w[::-1] for w in words]):
            order = sorted(range(len(words)), key=directed.__getitem__)
            self.sides.append(_Side(*_coded([directed[i] for i in order], self.letters), bits))
            self.orders.append(np.array(order))
        self.size = sum(map(len, words)) + len(words)

    def whole(self, count: int) -> list[np.ndarray]:
        """Intervals of the empty string: (low, high) forwards, low backwards."""
        return [np.zeros(count, np.int64), np.full(count, self.size), np.zeros(count, np.int64)]

    def extend(self, state: list[np.ndarray], value: np.ndarray, right: bool) -> list[np.ndarray]:
        """Intervals after one more code point at the right or the left end; `high` is `low` where there is none."""
        low, high, other = state
        if right:  # the suffixes of the backward text grow at their front
            low, high, other = other, other + high - low, low
        side = self.sides[1 if right else 0]
        before, upto, less = side.wavelet.rank(value, low, high)
        low, high, other = side.begins[value] + before, side.begins[value] + upto, other + less
        return [other, other + high - low, low] if right else [low, high, other]

    def branches(self, state: list[np.ndarray], right: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Every code point that can come next: which state, the code point, the intervals after it (only of the direction read)."""
        low, high, other = state
        if right:
            low, high, other = other, other + high - low, low
        side = self.sides[1 if right else 0]
        which, value, before, upto = side.wavelet.distinct(low, high)
        low, high = side.begins[value] + before, side.begins[value] + upto
        # Reading goes on in this direction, so that the other interval is no longer needed; its width is.
        other = np.zeros_like(low)
        return which, value, [other, other + high - low, low] if right else [low, high, other]

    def words(self, state: list[np.ndarray], right: bool) -> np.ndarray:
        """The one word of each state that has read from delimiter to delimiter, `right` the direction read last."""
        side, low = (1, state[2]) if right else (0, state[0])
        owner = self.sides[side].owner[low]
        return self.orders[side][owner]


def one_error(index: TwoWayIndex, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (query, word of the index) that differ in one code point; the error lies to the right of the left half, or else to
    the left of the right half."""
    codes, lengths = _coded(queries, index.letters)
    begins, count = np.cumsum(lengths) - lengths, len(queries)
    half = lengths // 2
    kept = half if right else lengths - half  # length of the half that is read exactly, delimiter aside
    state, query = index.whole(count), np.arange(count)
    # The exact half from the middle outwards, then its delimiter; reading turns round after it.
    for step in range(int(kept.max(initial=0)) + 1):
        place = begins[query] + (half[query] - 1 - step if right else half[query] + step)
        inside = step < kept[query]
        value = np.where(inside, codes[np.where(inside, place, 0)], 0)
        going = step <= kept[query]
        known = ~inside | (value > 0)
        moved = index.extend(state, value, not right)
        state = [np.where(going, new, old) for new, old in zip(moved, state)]
        alive = (state[1] > state[0]) & (known | ~going)
        query, state = query[alive], [x[alive] for x in state]
    rest = lengths - kept
    found_query, found_word = [], []
    exact = (query, np.zeros(len(query), np.int64), state)
    wrong = (query[:0], np.zeros(0, np.int64), [x[:0] for x in state])

    def letter(query: np.ndarray, done: np.ndarray) -> np.ndarray:
        """The letter of the other half after `done` of them, -1 behind the last."""
        place = begins[query] + (half[query] + done if right else half[query] - 1 - done)
        inside = done < rest[query]
        return np.where(inside, codes[np.where(inside, place, 0)], -1)

    while len(exact[0]) or len(wrong[0]):
        query, done, state = exact
        # One error, here: a letter of the query left out, another in its place, or one more.
        left = done < rest[query]
        more = [(query[left], done[left] + 1, [x[left] for x in state])]
        which, value, moved = index.branches(state, right)
        real = value > 0
        which, value, moved = which[real], value[real], [x[real] for x in moved]
        own = letter(query[which], done[which])
        other = (value != own) & (own >= 0)
        more.append((query[which][other], done[which][other] + 1, [x[other] for x in moved]))
        more.append((query[which], done[which], moved))
        same = value == own
        next_exact = (query[which][same], done[which][same] + 1, [x[same] for x in moved])
        # What has had its error reads on exactly; at the end of the query a delimiter has to follow.
        query, done, state = wrong
        own = letter(query, done)
        ended = own < 0
        closed = index.extend([x[ended] for x in state], np.zeros(int(ended.sum()), np.int64), right)
        hit = closed[1] > closed[0]
        found_query.append(query[ended][hit])
        found_word.append(index.words([x[hit] for x in closed], right))
        going = own > 0
        moved = index.extend([x[going] for x in state], own[going], right)
        alive = moved[1] > moved[0]
        more.append((query[going][alive], done[going][alive] + 1, [x[alive] for x in moved]))
        wrong = (
            np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more]),
            [np.concatenate([m[2][k] for m in more]) for k in range(3)],
        )
        exact = next_exact
    if not found_query:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = index.size
    pairs = np.unique(np.concatenate(found_query) * words + np.concatenate(found_word))
    return pairs // words, pairs % words


# ---- Vocabulary and shards ------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(word, n)`: the words of all texts, one code point of some deleted, with their counts; counted before the shuffle."""
    lowered = F.translate(F.col(text), _UPPER, _UPPER.lower())
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run")
    )
    drawn = F.crc32(F.concat("key", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", drawn).select(F.when(F.col("h") % DELETES == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _pieces(lengths: list[Column]) -> tuple[Column, Column]:
    """Distinct left and right halves that words of these lengths have, as far as `word` has them too."""
    left = F.array_distinct(F.array(*[F.floor(x / 2).cast("int") for x in lengths]))
    right = F.array_distinct(F.array(*[F.ceil(x / 2).cast("int") for x in lengths]))
    begin = F.transform(left, lambda k: F.substring("word", F.lit(1), k))
    end = F.transform(right, lambda k: F.substring("word", F.length("word") - k + 1, k))
    return begin, end


def _by_piece(words: DataFrame, lengths: list[Column]) -> DataFrame:
    """A row for every word and piece: `(word, n, right, piece)`; `right` where a left half is alike and reading goes on to the right."""
    begin, end = _pieces(lengths)
    tagged = F.concat(
        F.transform(begin, lambda p: F.struct(F.lit(True).alias("right"), p.alias("piece"))),
        F.transform(end, lambda p: F.struct(F.lit(False).alias("right"), p.alias("piece"))),
    )
    return words.select("word", "n", F.explode(tagged).alias("p")).select("word", "n", "p.*")


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Per word searched in a shard: number of its variants there and the commonest."""
    filed, asked = rows[rows["filed"]], rows[~rows["filed"]]
    parts = []
    known = filed.drop_duplicates("word")
    if len(known) and len(asked):
        words, counts = known["word"].tolist(), known["n"].to_numpy()
        index = TwoWayIndex(words)
        for right, part in asked.groupby("right"):
            own = part["word"].tolist()
            for at in range(0, len(own), QUERIES):
                queries = own[at : at + QUERIES]
                query, word = one_error(index, queries, bool(right))
                pairs = pd.DataFrame({"word": [queries[i] for i in query], "form": [words[i] for i in word], "form_n": counts[word]})
                if not right:  # what begins alike as well has been found from the left
                    new = [not f.startswith(w[: len(w) // 2]) for w, f in zip(pairs["word"], pairs["form"])]
                    pairs = pairs[np.array(new, bool)]
                pairs = pairs.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
                firsts = pairs.drop_duplicates("word").set_index("word")
                firsts["n_near"] = pairs.groupby("word").size()
                parts.append(firsts.reset_index())
    columns = ["word", "n_near", "form_n", "form"]
    if not parts:
        return pd.DataFrame({c: pd.Series(dtype="object") for c in columns})
    # Plain objects: strings in several Arrow chunks cannot be sent back.
    return pd.concat(parts)[columns].astype({"word": object, "form": object})


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Distinct `words(word, n)` -> `(word, n_near, form_n, form)` for words that have variants: their number and the commonest.

    A piece that more than `shard_words` words share is filed in several parts, and its searches too; each part of the one meets each
    of the other. That is quadratic in the number of such parts, with bounded tasks, and happens only to pieces that common.
    """
    words = materialize(words, "vocabulary")
    length = F.length("word")
    filed = _by_piece(words, [length - 1, length, length + 1]).where(F.length("piece") >= LEAST_LENGTH // 2)
    asked = _by_piece(words, [length])
    shards = max(1, -(-4 * words.count() // shard_words))
    crowded = filed.groupBy("right", "piece").agg(F.count("*").alias("c")).where(F.col("c") > shard_words)
    crowded = materialize(crowded.select("right", "piece", F.ceil(F.col("c") / shard_words).cast("int").alias("parts")), "crowded")
    whole = F.pmod(F.xxhash64("right", "piece"), F.lit(shards)).cast("string")
    part = F.pmod(F.xxhash64("word"), F.col("parts").cast("long"))

    def placed(rows: DataFrame, is_filed: bool) -> DataFrame:
        """Rows with their shards: one, or one for every part of the other side."""
        rows = rows.join(crowded, ["right", "piece"], "left")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("other")
        rows = rows.select("word", "n", "right", "piece", "parts", part.alias("own"), other)
        two = [F.col("own"), F.col("other")] if is_filed else [F.col("other"), F.col("own")]
        split = F.concat_ws(":", F.col("right").cast("string"), F.col("piece"), *[x.cast("string") for x in two])
        return rows.select("word", "n", "right", F.lit(is_filed).alias("filed"), F.when(F.col("parts").isNull(), whole).otherwise(split).alias("shard"))

    both = placed(filed, True).unionByName(placed(asked, False))
    found = both.groupBy("shard").applyInPandas(_search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    near = materialize(near.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form"), "near-words")
    release(crowded)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """`forms(word, form)`, without cycles -> `(word, root)`: where the forms lead to. The way left halves with every round."""
    current = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        release(current)
        current = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return current
        # The next round stores its own table; this one stays until the driver ends.


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words of all texts with their commonest variant: `(word, form, root, n, n_near, form_n)`.

    Null and empty texts have no words; a null key counts as empty where code points are deleted; repeated rows count repeatedly. Equal
    counts go to the smaller word by code points. Other columns of `docs` are not read. No words, no rows.
    """
    words = materialize(vocabulary(docs, key, text), "words")
    near = near_words(words, shard_words).withColumn("near_n", F.col("form_n")).drop("form_n")
    joined = words.join(near, "word", "left")
    fits = F.col("near_n") >= TIMES * F.col("n")
    joined = materialize(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")
    ), "variants")
    ends = roots(joined.where("form IS NOT NULL").select("word", "form"))
    out = joined.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
