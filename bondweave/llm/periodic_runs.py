"""Periodic runs of words: Lyndon roots from a stack scanned right to left, under an order and its reverse.

Every run has its smallest period's Lyndon rotation as a root under one of two opposite orders of the words, and
the longest Lyndon word that starts at a place ends where the next smaller suffix begins. A stack scanned from
right to left finds all of these; suffixes are compared, and roots extended to both sides, by the length of their
common part, which a binary search over rolling hashes finds and a look at the words themselves confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, let

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Words compared one by one before hashes are asked.
NEAR = 8

Run = tuple[int, int, int]  # start, length, period
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class CommonParts:
    """How far two places of one sequence of small integers agree, forwards and backwards.

    Hashes can only claim too much, never too little, so what they claim is compared word by word before it counts.
    What has been compared at a distance is kept, so a scan that moves left compares only what is new.
    """

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.sums = self.powers = None
        self.known: dict[int, tuple[int, int]] = {}  # distance: (place, how far it agrees from there)

    def _same(self, i: int, j: int, length: int) -> bool:
        if self.sums is None:
            base = np.full(self.n + 1, 0x9E3779B97F4A7C15, np.uint64)
            base[0] = 1
            self.powers = np.cumprod(base)
            each = (np.asarray(self.words, np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            each = (each ^ (each >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * self.powers[:-1])])
        at, power = self.sums.item, self.powers.item(j - i)
        return ((at(i + length) - at(i)) * power - (at(j + length) - at(j))) & 0xFFFFFFFFFFFFFFFF == 0

    def _first_difference(self, i: int, j: int, length: int) -> int:
        """Of two stretches of ``length`` words: the first place at which they differ, or ``length``."""
        w = self.words
        for k in range(0, length, 1024):
            a, b = w[i + k : i + min(k + 1024, length)], w[j + k : j + min(k + 1024, length)]
            if a != b:
                return k + next(x for x in range(len(a)) if a[x] != b[x])
        return length

    def ahead(self, i: int, j: int) -> int:
        """Number of equal words from places i < j on."""
        w, n = self.words, self.n
        for k in range(min(NEAR, n - j)):
            if w[i + k] != w[j + k]:
                return k
        if n - j <= NEAR:
            return n - j
        place, length = self.known.get(j - i, (-1, 0))
        if place <= i < place + length:
            return place + length - i
        if i < place:
            gap = place - i
            same = self._first_difference(i, j, gap)
            found = gap + length if same == gap else same
        else:
            low, high = NEAR, n - j
            while low < high:
                mid = (low + high + 1) // 2
                if self._same(i, j, mid):
                    low = mid
                else:
                    high = mid - 1
            found = self._first_difference(i, j, low)
        self.known[j - i] = (i, found)
        return found

    def behind(self, i: int, j: int) -> int:
        """Number of equal words that end just before places i < j."""
        w = self.words
        for k in range(1, min(NEAR, i) + 1):
            if w[i - k] != w[j - k]:
                return k - 1
        if i <= NEAR:
            return i
        low, high = NEAR, i
        while low < high:
            mid = (low + high + 1) // 2
            if self._same(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        while (same := self._first_difference(i - low, j - low, low)) < low:  # a false claim: go on behind the difference
            low -= same + 1
        return low


def next_smaller(words: list[int], parts: CommonParts) -> list[int]:
    """For each place the next one whose suffix is smaller; a suffix that starts another one is the smaller of the two."""
    n = len(words)
    after = [n] * n
    ahead = parts.ahead
    for i in range(n - 2, -1, -1):
        a, j = words[i], i + 1
        while j < n:
            b = words[j]
            if a > b:
                break
            if a == b:
                k = ahead(i, j)
                if j + k == n or words[i + k] > words[j + k]:
                    break
            j = after[j]
        after[i] = j
    return after


def find_runs(words: list[int], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> list[Run]:
    """(start, length, period) of all maximal stretches of smallest period q and of ``max(min_length, min_exponent * q)`` words or more, sorted by start, then period.

    ``words`` are integers from 0; ``min_exponent`` is 2 or more, as a run is defined.
    """
    n = len(words)
    if n < max(min_length, min_exponent):
        return []
    parts, found = CommonParts(words), set()
    array = np.asarray(words)
    for ordered in (words, [-w for w in words]):
        after = np.asarray(next_smaller(ordered, parts))
        place = np.arange(n)
        period = after - place
        # The first root of a run so long lies in its first period: its first word follows at each further period, its last at all but one.
        place = place[place + (min_exponent - 1) * period < n]
        for times in range(1, min_exponent):
            place = place[array[place] == array[place + times * period[place]]]
        for times in range(1, min_exponent - 1):
            place = place[array[place + period[place] - 1] == array[place + (times + 1) * period[place] - 1]]
        inside: dict[int, tuple[int, int]] = {}
        for i, q in zip(place.tolist(), period[place].tolist()):
            start, end = inside.get(q, (0, 0))
            if start <= i and i + q <= end:
                continue  # another root of the same run
            start, end = i - parts.behind(i, i + q), i + q + parts.ahead(i, i + q)
            inside[q] = (start, end)
            if end - start >= max(min_length, min_exponent * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def runs_of_texts(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, runs, collapsed) for each row of ``docs``.

    ``runs`` has (start, length, period) in words, sorted by start, then period; ``collapsed`` is the text's words, joined
    by one space, without those that a run contains after its first period. Words are what stands between ASCII white
    space. Null and empty texts have no words, no runs and an empty ``collapsed``; null and repeated ids and repeated
    rows stay rows of their own; other columns of ``docs`` are not read. Texts may be of any length: each is worked on
    alone, in time n log n and memory in proportion to its length. Nothing is shuffled. An empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()  # bytes split at the six ASCII white-space characters
                number: dict[bytes, int] = {}
                found = find_runs([number.setdefault(w, len(number)) for w in words], min_exponent, min_length)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(without_repeats(words, found)).decode())
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    out = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string(f"n_words bigint, runs {RUNS}, collapsed string").fields])
    return narrow.mapInArrow(scan, out).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end in the words of every tenth text, by the checksum of its id; texts without a word and null ids stay as they are.

    With h the checksum, g = h / 10 and n words, word i >= a = g % n becomes word a + (i - a) % p with p = 1 + (n - a) / (3 + g % 8).
    """
    checksum = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " "))

    text = F.col(text_col)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return docs.withColumn(text_col, F.when((checksum % 10 == 0) & text.rlike(WORD), let(words, planted)).otherwise(text))


def runs_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: least start, then period; none: nulls) and hashes of all runs and of the collapsed text."""
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.when(F.size("runs") > 0, longest)
    d = found.withColumn("_best", best)
    return d.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        (-F.col("_best.n")).alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(-1000 * F.col("_best.n") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
