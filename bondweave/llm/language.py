"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import least_by_hash, materialize, shared_dir

ORDER = 4
#: Bits of a symbol: BITS fold the letters of late scripts, WHOLE keep every letter of Unicode apart.
BITS, WHOLE = 12, 16
#: Training documents set aside for calibration, at most; they are not counted.
MAX_CALIBRATION = 2_000
#: Share of the texts of its own language, as measured on the rows set aside, that a model rejects.
REJECTED = 0.01
#: Entries that a task holds before it combines them, and symbols that are scored at once.
HELD, CHUNK = 4_000_000, 1 << 20
#: The arrays are stored and read in pieces of about so many bytes; a worker keeps so many of them in memory.
PIECE_BYTES, HELD_PIECES = 2 << 20, 64

_SPACE = 1
_letters: dict[int, np.ndarray] = {}


def _letter_table(bits: int = BITS) -> np.ndarray:
    """Symbol of each code point: letters are themselves or fold to 12 bits, all else is a space.

    Folded, alphabets below U+0C00 keep their letters apart; of what comes later, kana, hangul, ideographs and all
    others fold within ranges of their own, so that scripts are never mixed.
    """
    if bits not in (BITS, WHOLE):
        raise ValueError(f"symbols have {BITS} or {WHOLE} bits")
    if bits not in _letters:
        cp = np.arange(0x110000)
        isalpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        if bits == WHOLE:
            _letters[bits] = np.where(isalpha, cp, _SPACE).astype(np.uint32)
            return _letters[bits]
        kana = (cp >= 0x3040) & (cp <= 0x30FF)
        hangul = (cp >= 0xAC00) & (cp <= 0xD7A3)
        ideograph = (cp >= 0x3400) & (cp <= 0x9FFF) | (cp >= 0xF900) & (cp <= 0xFAFF) | (cp >= 0x20000) & (cp <= 0x3FFFF)
        folded = np.select([cp < 3072, kana, hangul, ideograph], [cp, 3072 + cp % 192, 3264 + cp % 192, 3456 + cp % 448], 3904 + cp % 192)
        _letters[bits] = np.where(isalpha, folded, _SPACE).astype(np.uint16)
    return _letters[bits]


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Packed 4-grams of the lower-cased text, one for each symbol and its three predecessors; runs of other than letters are one space.

    Of WHOLE bits, a letter is one symbol, and one beyond U+FFFF two, as in UTF-16: no two texts of letters share their symbols.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letter_table(bits)[codes]
    space = s == _SPACE
    if space.any():
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] = not space[0]
        s = s[keep]
    if not len(s) or (len(s) == 1 and s[0] == _SPACE):
        return np.zeros(0, np.uint64)
    late = s > 0xFFFF
    if late.any():
        s = np.repeat(s, 1 + late)
        first = np.flatnonzero(np.repeat(late, 1 + late))[::2]
        rest = s[first] - 0x10000
        s[first], s[first + 1] = 0xD800 + (rest >> 10), 0xDC00 + (rest & 0x3FF)
    padded = np.concatenate((np.full(ORDER - 1, _SPACE, np.uint64), s.astype(np.uint64)))
    out = padded[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out |= padded[ORDER - 1 - k : len(padded) - k] << np.uint64(bits * k)
    return out


def _mask(order: int, bits: int = BITS) -> np.uint64:
    return np.uint64((1 << (bits * order)) - 1)


#: Odd factors by the bits of a half; a product with a half stays below 2^63.
_ODD = {24: 0x9E3779, 32: 0x1E3779B1}


def spread(g: np.ndarray | Column, bits: int = BITS) -> np.ndarray | Column:
    """A hash of 4-grams (48 or 64 bits), one to one: two rounds in which each half changes the other. The same in numpy and in Spark."""
    column, half = isinstance(g, Column), ORDER * bits // 2
    mask, odd, shift = (1 << half) - 1, _ODD[half], half // 2
    low = (lambda v: v.bitwiseAND(F.lit(mask))) if column else (lambda v: v & mask)
    right = F.shiftrightunsigned if column else (lambda v, n: v >> n)
    left = F.shiftleft if column else (lambda v, n: v << n)
    xor = (lambda a, b: a.bitwiseXOR(b)) if column else (lambda a, b: a ^ b)
    hi, lo = right(g, half), low(g)
    hi = xor(hi, low(right(lo * odd, shift)))
    lo = xor(lo, low(right(hi * odd, shift)))
    return left(hi, half) + lo


class Arrays:
    """The model's sorted hash arrays, one of each kind: row groups of Parquet files in the shared folder.

    Each is known by the range of its keys and read from there when one of its keys is asked for; HELD_PIECES of them
    stay in memory. So neither a worker's memory nor its disk grows with the model.
    """

    def __init__(self, files: tuple[str, ...]):
        self.pieces: dict[int, list[tuple[int, int, pq.ParquetFile, int]]] = {}
        for name in files:
            store, path = fs.FileSystem.from_uri(name)
            file = pq.ParquetFile(store.open_input_file(path))
            of_kind = self.pieces.setdefault(int(path.rsplit("kind=", 1)[1].split("/")[0]), [])
            for i in range(file.num_row_groups):
                keys = file.metadata.row_group(i).column(0).statistics
                of_kind.append((keys.min, keys.max, file, i))
        for of_kind in self.pieces.values():
            of_kind.sort(key=lambda p: p[:2])
        self.starts = {kind: np.array([p[0] for p in of_kind], np.int64) for kind, of_kind in self.pieces.items()}
        self.held: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _piece(self, kind: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        at = kind, number
        if at not in self.held:
            _, _, file, group = self.pieces[kind][number]
            table = file.read_row_group(group, use_threads=False)
            keys = table.column("key").to_numpy()
            self.held[at] = keys, np.asarray(table.column("values").combine_chunks().flatten()).reshape(len(keys), -1)
            if len(self.held) > HELD_PIECES:
                self.held.popitem(last=False)
        self.held.move_to_end(at)
        return self.held[at]

    def find(self, kind: int, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of ``keys`` (any order) in the array of a kind, and which of them are there."""
        values, hit = np.zeros((len(keys), width), np.float32), np.zeros(len(keys), bool)
        if kind not in self.starts:
            return values, hit
        order = np.argsort(keys)
        wanted = keys[order]
        piece = np.searchsorted(self.starts[kind], wanted, "right") - 1
        edges = np.flatnonzero(np.diff(piece, prepend=-2)).tolist() + [len(wanted)]
        for low, high in zip(edges, edges[1:]):
            if piece[low] < 0:
                continue
            have, rows = self._piece(kind, int(piece[low]))
            at = np.minimum(np.searchsorted(have, wanted[low:high]), len(have) - 1)
            found = have[at] == wanted[low:high]
            hit[order[low:high]] = found
            values[order[low:high][found]] = rows[at[found]]
        return values, hit


#: The arrays that this process has open, by the names of their files.
_open: dict[tuple[str, ...], Arrays] = {}


@dataclass
class Model:
    """What a worker needs to read the arrays. They hold, for every n-gram that occurs in any language, log2 of
    its interpolated probability in each, and for every context log2 of the weight that it leaves to the shorter one.
    Probabilities of order k are kind k, weights of contexts of k symbols kind ORDER + k."""

    langs: list[str]
    files: tuple[str, ...] = ()
    unknown: np.ndarray | None = None
    temperature: float = 1.0
    worst: dict[str, float] = field(default_factory=dict)
    bits: int = BITS

    def _find(self, kind: int, grams_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.files not in _open:
            _open[self.files] = Arrays(self.files)
        return _open[self.files].find(kind, spread(grams_, self.bits).view(np.int64), len(self.langs))

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """One row of log2 probabilities by language for each packed n-gram: what is stored, or else back-off."""
        if order == 0:
            return np.broadcast_to(self.unknown, (len(keys), len(self.langs)))
        out, hit = self._find(order, keys)
        miss = ~hit
        if miss.any():
            rest = keys[miss]
            low = self.log_probs(rest & _mask(order - 1, self.bits), order - 1)
            if order > 1:
                weight, known = self._find(ORDER + order - 1, rest >> np.uint64(self.bits))
                low = low + np.where(known[:, None], weight, 0)
            out[miss] = low
        return out

    def entropies(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per symbol of each text under each language, and its number of symbols (0: no letter).

        N-grams of many texts are looked up together, each once; those of a long text in parts of CHUNK.
        """
        texts = list(texts)
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []
        size = 0

        def settle() -> None:
            keys, where = np.unique(np.concatenate([g for _, g in waiting]), return_inverse=True)
            starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
            sums = np.add.reduceat(self.log_probs(keys)[where], starts, axis=0, dtype=np.float64)
            np.add.at(total, [i for i, _ in waiting], sums)
            waiting.clear()

        for i, text in enumerate(texts):
            g = grams(text, self.bits) if text else np.zeros(0, np.uint64)
            n[i] = len(g)
            for k in range(0, len(g), CHUNK):
                waiting.append((i, g[k : k + CHUNK]))
                size += len(waiting[-1][1])
                if size >= CHUNK:
                    settle()
                    size = 0
        if waiting:
            settle()
        return -total / np.maximum(1, n)[:, None], n

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each. Null texts and those without a letter are ``und``."""
        texts = list(texts)
        if not self.langs:
            return [("und", 0.0, None, True)] * len(texts)
        out = []
        for h, n in zip(*self.entropies(texts)):
            best = int(h.argmin())
            limit = self.worst.get(self.langs[best], np.inf)
            out.append((self.langs[best], float(_posterior(h, n, self.temperature)[best]), float(h[best]), bool(h[best] > limit)) if n else ("und", 0.0, None, True))
        return out


def _posterior(h: np.ndarray, n: int, temperature: float) -> np.ndarray:
    z = -temperature * np.sqrt(n) * (h - h.min())
    e = np.exp(z)
    return e / e.sum()


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text, and so is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """4-gram counts by language, combined within the task as far as HELD entries reach."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def combined() -> Iterator[pd.DataFrame]:
        for lang, pieces in parts.items():
            keys, where = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in pieces])).astype(np.int64)
            for i in range(0, len(keys), 50_000):
                yield pd.DataFrame({"lang": lang, "g": keys[i : i + 50_000].view(np.int64), "n": n[i : i + 50_000]})
        parts.clear()

    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            waiting: list[np.ndarray] = []
            size = 0
            for t in [*texts, None]:
                if t is not None:
                    waiting.append(grams(t, bits))
                    size += len(waiting[-1])
                if waiting and (t is None or size > 500_000):
                    keys, n = np.unique(np.concatenate(waiting), return_counts=True)
                    parts.setdefault(lang, []).append((keys, n))
                    held, waiting, size = held + len(keys), [], 0
        if held > HELD:
            yield from combined()
            held = 0
    yield from combined()


def _by_lang(df: DataFrame, key: str, values: tuple[str, ...], langs: list[str]) -> DataFrame:
    """One row for each key, with an array by language for each of ``values`` (0 where a language has none)."""
    numbers = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    rows = df.select(key, F.struct(numbers[F.col("lang")].alias("i"), F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("v")).alias("e"))
    wide = rows.groupBy(key).agg(F.map_from_entries(F.collect_list("e")).alias("m"))  # as many entries as languages, at most
    every = F.sequence(F.lit(0), F.lit(len(langs) - 1))

    def of(value: str) -> Column:
        return F.transform(every, lambda i: F.coalesce(F.element_at("m", i)[value], F.lit(0.0))).alias(value)

    return wide.select(key, *map(of, values))


def _log2_sum(seen: Column, power: Column) -> Column:
    """log2(seen + 2^power), element by element."""
    return F.zip_with(seen, power, lambda a, b: F.log2(a + F.pow(F.lit(2.0), b)))


def _store(tables: list[DataFrame], spark) -> tuple[str, ...]:
    """Write all entries as one sorted table of (kind, key, values) to the shared folder, where every executor reads what it needs."""
    both = reduce(DataFrame.unionByName, tables)
    sorted_ = both.select("kind", "key", F.col("values").cast("array<float>").alias("values")).repartitionByRange("kind", "key").sortWithinPartitions("kind", "key")
    path = f"{shared_dir(spark)}/language-model-{uuid.uuid4().hex}"
    sorted_.write.option("parquet.block.size", PIECE_BYTES).option("parquet.enable.dictionary", "false").partitionBy("kind").parquet(path)
    return tuple(sorted(spark.read.parquet(path).inputFiles()))


def fit(docs: DataFrame, max_calibration: int = MAX_CALIBRATION, seed: int = 3, bits: int = BITS) -> Model:
    """Models of all languages in ``lang`` of the documents that are not held out, from text and lang alone.

    The counts cover all training texts: tasks count, Spark sums. Raw counts are needed for the highest
    order only; those of a lower order are the numbers of distinct predecessors (continuation counts),
    taken from the next order by grouping. Discounts come from the counts of ones and twos. Every n-gram
    and every context that occurs is kept, so the model grows with the corpus; it is put together by joins
    on n-grams and stays in the shared folder as sorted arrays. A suffix or context of one n-gram is that of
    as many as there are letters at most, so no join key is hot. With ``bits`` WHOLE no letters fold.
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    picked = least_by_hash(materialize(train.where(aside).select("doc_id").distinct(), "set-aside"), ["doc_id"], max_calibration, seed).collect()
    small = F.broadcast(spark.createDataFrame([tuple(r) for r in picked], T.StructType([T.StructField("doc_id", id_type)])))  # max_calibration ids at most
    counted = train.join(small, "doc_id", "left_anti").select("lang", "text").mapInPandas(lambda batches: _count(batches, bits), "lang string, g long, n long")
    levels = {ORDER: materialize(counted.groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << (bits * k)) - 1)).alias("g")
        levels[k] = materialize(levels[k + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")), "grams")
    langs, discount, total, types = _sums(levels)
    if not langs:
        return Model([])
    uniform = np.maximum(discount[1] * types / total, 1e-6) / (1 << bits)
    model = Model(langs, unknown=np.log2(uniform).astype(np.float32), bits=bits)
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    wide = _by_lang(levels[1], "g", ("n",), langs)
    share = F.zip_with(F.zip_with("n", array(discount[1]), lambda n, d: F.greatest(n - d, F.lit(0.0))), array(total), lambda a, t: a / t)
    probs = {1: materialize(wide.select("g", _log2_sum(share, array(np.log2(uniform))).alias("p")), "probabilities")}
    entries = []
    for k in range(2, ORDER + 1):
        ctx = F.shiftrightunsigned("g", bits)
        by_context = levels[k].groupBy("lang", ctx.alias("ctx")).agg(F.sum("n").alias("sums"), F.count(F.lit(1)).alias("kinds"))
        contexts = _by_lang(by_context, "ctx", ("sums", "kinds"), langs)
        left = F.zip_with(F.zip_with("kinds", array(discount[k]), lambda x, d: x * d), "sums", lambda x, s: F.when(s > 0, F.log2(x / s)).otherwise(0.0))
        contexts = materialize(contexts.select("ctx", "sums", left.alias("weight")), "contexts")
        entries.append(contexts.select(F.lit(ORDER + k - 1).alias("kind"), spread(F.col("ctx"), bits).alias("key"), F.col("weight").alias("values")))
        rows = _by_lang(levels[k], "g", ("n",), langs).select("g", "n", ctx.alias("ctx"), F.col("g").bitwiseAND(F.lit((1 << (bits * (k - 1))) - 1)).alias("low"))
        rows = rows.join(contexts, "ctx").join(probs[k - 1].select(F.col("g").alias("low"), F.col("p").alias("lower")), "low")
        above = F.zip_with("n", array(discount[k]), lambda n, d: F.greatest(n - d, F.lit(0.0)))
        seen = F.zip_with(above, "sums", lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
        probs[k] = materialize(rows.select("g", _log2_sum(seen, F.zip_with("weight", "lower", lambda w, p: w + p)).alias("p")), "probabilities")
    entries += [p.select(F.lit(k).alias("kind"), spread(F.col("g"), bits).alias("key"), F.col("p").alias("values")) for k, p in probs.items()]
    model.files = _store(entries, spark)
    if not picked:
        return model

    def entropies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, n = model.entropies(pdf["text"])
            yield pd.DataFrame({"lang": pdf["lang"].to_numpy(), "h": list(h), "n": n})

    # Texts are scored where they are; of an id with many rows no more numbers come back than of others.
    scored = train.select("doc_id", "lang", "text").join(small, "doc_id").select("lang", "text").mapInPandas(entropies, "lang string, h array<double>, n long")
    return _calibrate(model, least_by_hash(materialize(scored, "calibration"), ["lang", "h", "n"], max_calibration, seed).toPandas())


def _sums(levels: dict[int, DataFrame]) -> tuple[list[str], dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Languages, their discounts by order, and the sum and number of their counts of single symbols."""
    ones = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("k"), "lang", "n") for k, d in levels.items()])
    rows = ones.groupBy("k", "lang").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).collect()
    langs = sorted({r["lang"] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    discount = {k: np.full(len(langs), 0.5) for k in levels}
    total, types = np.ones(len(langs)), np.zeros(len(langs))
    for r in rows:
        i = number[r["lang"]]
        if r["a"] + r["b"]:
            discount[r["k"]][i] = min(0.95, max(0.05, r["a"] / (r["a"] + 2 * r["b"])))
        if r["k"] == 1:
            total[i], types[i] = r["total"], r["types"]
    return langs, discount, total, types


def _calibrate(model: Model, rows: pd.DataFrame) -> Model:
    """The temperature that makes scores most likely on the rows set aside, and each language's limit on the
    cross-entropy, which REJECTED of its rows exceed."""
    seen = [(model.langs.index(lang), np.asarray(h), n) for lang, h, n in zip(rows["lang"], rows["h"], rows["n"]) if n and lang in model.langs]
    if not seen:
        return model

    def loss(t: float) -> float:
        return -sum(np.log(max(_posterior(h, n, t)[i], 1e-12)) for i, h, n in seen)

    model.temperature = min((0.1, 0.2, 0.5, 1.0, 2.0, 3.0, 5.0), key=lambda t: (round(loss(t) / len(seen), 6), t))
    for i, lang in enumerate(model.langs):
        own = [h[i] for j, h, n in seen if j == i]
        if own:
            model.worst[lang] = float(np.quantile(own, 1 - REJECTED, method="higher"))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) of every whole text.

    The language with the lowest cross-entropy per symbol; the score is its calibrated share among the
    languages. ``rejected`` marks texts whose cross-entropy exceeds that of all but REJECTED of the
    calibration texts of the language found. Null texts and those without a letter are ``und`` with score 0,
    as is everything if no language was learned. Texts may be of any length. Rows are judged one by one, so
    repeated rows and null ids need nothing special; other columns are not read, whatever their names.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(model.predict(pdf["text"]), columns=["lang_pred", "score", "cross_entropy", "rejected"])
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), found], axis=1)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(judge, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
