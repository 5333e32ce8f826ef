import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bondweave.llm import language
from bondweave.llm._common import least_by_hash

ALPHABETS = {"aa": "the of and ing er on at in re".split(), "bb": "lo que de la ción es ar ña".split(), "cc": "sch der und ung ich ßt ei zu".split()}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(ALPHABETS))
        words = ["".join(rnd.choices(ALPHABETS[lang], k=rnd.randint(1, 4))) for _ in range(rnd.randint(5, 80))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600)
    odd = [(9000, None, "aa"), (9001, "", None), (9002, " 123 !?\n", "bb"), (9003, "the " * 60_000, None), (None, "lo que de la", "bb"), (7, rows[7][1], None), (9004, "日本語のテキスト", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "0.5 AS score")
    got = language.identify(df, language.fit(df)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [(i, lang) for i, _, lang in rows if by[i].held_out]
    assert np.mean([by[i].lang_pred == lang for i, lang in held]) > 0.99
    assert all(0 <= r.score <= 1 and r.lang_pred in {*ALPHABETS, "und"} for r in got)
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred == "aa"
    assert by[9004].rejected and not by[held[0][0]].rejected


def test_held_out_rows_teach_nothing(spark):
    """Labels of held-out documents, and lang of any document under prediction, change nothing."""
    rows = corpus(200)
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(lied, schema)
    f = lambda d: sorted(map(str, language.identify(d, language.fit(d)).collect()))
    assert f(a) == f(b)


def test_model_is_interpolated_kneser_ney(spark):
    """Against a plain dictionary version over the same texts; probabilities sum to one."""
    texts = ["abra kadabra abra", "barbara rabarber", "kabara"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")

    original = language.held_out
    try:
        language.held_out = lambda c: c < -1
        model = language.fit(df, max_calibration=0)
    finally:
        language.held_out = original
    grams = [int(g) for t in texts for g in language.grams(t)]
    count = {4: {}}
    for g in grams:
        count[4][g] = count[4].get(g, 0) + 1
    for k in (3, 2, 1):
        count[k] = {}
        for g in count[k + 1]:
            h = g & ((1 << 12 * k) - 1)
            count[k][h] = count[k].get(h, 0) + 1

    def discount(k):
        a, b = (sum(1 for c in count[k].values() if c == n) for n in (1, 2))
        return min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5

    def p(g, k):
        if k == 0:
            return max(discount(1) * len(count[1]) / sum(count[1].values()), 1e-6) / 4096
        own = [(h, c) for h, c in count[k].items() if h >> 12 == g >> 12]
        total, d = sum(c for _, c in own), discount(k)
        lower = p(g & ((1 << 12 * (k - 1)) - 1), k - 1)
        if k == 1:
            return max(count[1].get(g, 0) - d, 0) / total + lower
        return lower if not total else max(count[k].get(g, 0) - d, 0) / total + d * len(own) / total * lower

    tried = sorted({*grams, *(g & ~0xFFF | ord("z") for g in grams), 0x123456789ABC})
    got = model.log_probs(np.array(tried, np.uint64))[:, 0]
    assert np.allclose(got, [np.log2(p(g, 4)) for g in tried], atol=1e-4)
    context = grams[5] & ~0xFFF
    everything = model.log_probs(np.array([context | s for s in range(4096)], np.uint64))[:, 0]
    assert abs(np.exp2(everything.astype(float)).sum() - 1) < 1e-3


def test_all_entries_are_kept_in_pieces(spark, monkeypatch):
    """Every n-gram of the training texts is in the arrays, in few pieces or many, with few of them in memory."""
    rows = corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, max_calibration=0)
    train = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    wanted = np.unique(np.concatenate([language.grams(t) for t in train]))
    for k in range(1, 5):
        keys = np.unique(wanted & language._mask(k))
        assert model._find(k, keys)[1].all() and not model._find(k, keys + np.uint64(3071 << 12 * (k - 1))).__getitem__(1).all()
    whole = model.log_probs(wanted)
    monkeypatch.setattr(language, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(language, "HELD_PIECES", 2)
    monkeypatch.setattr(language, "CHUNK", 1000)
    cut = language.fit(df, max_calibration=0)
    assert np.allclose(cut.log_probs(wanted), whole)
    assert np.allclose(cut.entropies(train)[0], model.entropies(train)[0]) and len(language._open[cut.files].held) <= 2
    got = language.identify(df, model).toPandas().merge(df.toPandas(), on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.99


def test_text_ids(spark):
    df = spark.createDataFrame([(f"d{i}", t, lang) for i, t, lang in corpus(60)], "doc_id string, text string, lang string")
    got = language.identify(df, language.fit(df)).collect()
    assert {r.doc_id for r in got} == {f"d{i}" for i in range(60)}


def test_spread_is_one_to_one_and_the_same_in_spark(spark):
    g = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 20_000))
    h = language.spread(g)
    assert len(np.unique(h)) == len(g) and h.min() >= 0 and h.max() < 1 << 48
    df = spark.createDataFrame([(int(x),) for x in g[:200]], "g long")
    assert [r[0] for r in df.select(language.spread(F.col("g"))).collect()] == h[:200].tolist()


def test_scripts_are_not_mixed():
    table = language._letter_table()
    kinds = {name: {int(table[ord(c)]) for c in text} for name, text in {"kana": "あいうアイウ", "hangul": "가나다한국", "ideographs": "日本語中文", "others": "กขคაბგ"}.items()}
    assert all(not (a & b) for x, a in kinds.items() for y, b in kinds.items() if x < y)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(df, language.fit(df)).collect()] == ["und"]
    assert language.identify(df.limit(0), language.fit(df.limit(0))).collect() == []


def test_whole_letters_stay_apart():
    """Of WHOLE bits, grams give the text's symbols back, whatever its script."""
    text = "дом 日本語 𠀀𪚥 ขค aß"
    got = "".join(chr(int(g) & 0xFFFF) for g in language.grams(text, language.WHOLE))
    assert got.encode("utf-16-le", "surrogatepass").decode("utf-16-le") == text.replace(" ", "\x01")
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha() and c == c.lower()]
    last = {tuple(language.grams(c, language.WHOLE).tolist()) for c in letters}
    assert len(last) == len(letters) > 100_000


def test_whole_spread_is_one_to_one_and_the_same_in_spark(spark):
    g = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 20_000, dtype=np.uint64))
    h = language.spread(g, language.WHOLE).view(np.int64)
    assert len(np.unique(h)) == len(g)
    df = spark.createDataFrame([(int(x),) for x in g[:200].view(np.int64)], "g long")
    assert [r[0] for r in df.select(language.spread(F.col("g"), language.WHOLE)).collect()] == h[:200].tolist()


def test_whole_models_tell_scripts_of_many_letters(spark):
    """Two languages of ideographs that the folded symbols mix, since their letters agree modulo 448; probabilities sum to one."""
    rnd = random.Random(5)
    first = [chr(0x4E00 + 448 * i) for i in range(20)]
    rows = [(i, "".join(rnd.choices(first if i % 2 else [chr(ord(c) + 448 * 20) for c in first], k=40)), "ab"[i % 2]) for i in range(200)]
    rows += [(1000 + i, "".join(rnd.choices(["𠀀", "𠀁", "𪚥", "日"], k=30)), "c") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, bits=language.WHOLE)
    got = language.identify(df, model).toPandas().merge(df.toPandas(), on="doc_id")
    assert (got.lang_pred == got.lang).all()
    context = language.grams(rows[1][1], language.WHOLE)[10] & np.uint64(~0xFFFF & (1 << 64) - 1)
    everything = model.log_probs(context | np.arange(1 << 16, dtype=np.uint64))
    assert np.allclose(np.exp2(everything.astype(float)).sum(axis=0), 1, atol=1e-3)


def test_least_by_hash_is_the_start_of_the_order(spark):
    df = spark.range(5000).selectExpr("id % 4000 AS id", "id AS other")
    for limit in (0, 7, 300, 6000):
        plain = df.orderBy(F.xxhash64(F.lit(3), "id", "other"), "id", "other").limit(limit)
        got = least_by_hash(df, ["id", "other"], limit, 3)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in plain.collect()]
    assert least_by_hash(df.limit(0), ["id"], 5, 3).count() == 0
    equal = spark.range(1000).selectExpr("1 AS id")
    assert least_by_hash(equal, ["id"], 5, 3).count() == 5
