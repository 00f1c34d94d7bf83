"""Tokens, packing, personal data, classifiers, languages, chats."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from imgrel.llm import bpe, chat, langid, packing, pii, quality

PATH = bpe.default_path()
LIBRARY, OWN, FAST = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH, cache=100), packing.FastIds(PATH)
TEXTS = ["", " ", "  ", "a  b", "a \n b", "<|endoftext|>x <|endoftext|>", "\x1c\x1d a", "it's  they'll\n\n\nzz \t", "éa\xa0 b 12 3½", "😀😀 😀", "a\x85 b", " a ", "aaaa" * 3000]
ODD = [(1, None), (2, ""), (3, " \n "), (4, "word"), (5, "x y " * 30_000), (6, "same text"), (6, "same text"), (None, "no id"), (8, "<|endoftext|>"), (9, "123 !!! ???")]


def docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, "zz", 5, [1], 0.5) for i, t in rows], "doc_id long, text string, lang string, label int, ids array<int>, score double"
    )


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet=" \n\tab'st\xa0é1!.", max_size=60))
def test_both_encoders_give_the_library_s_ids(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(OWN.encode(text)) == ids == FAST(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", TEXTS)
def test_chosen_texts(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(OWN.encode(text)) == ids == FAST(text)


def test_round_trip_of_odd_rows(spark):
    rows = bpe.round_trip(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    texts = dict(ODD)
    for r in rows:
        assert r.n_tokens == len(LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    both = bpe.decode_ids(bpe.encode_texts(docs(spark, ODD)))
    assert both.columns == ["doc_id", "text", "lang", "label", "score", "ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in both.collect())
    assert bpe.round_trip(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts, group", [(1, 64), (7, 2)])
def test_packing_keeps_every_token_once(spark, parts, group):
    rng = random.Random(0)
    rows = ODD[:6] + ODD[7:] + [(100 + k, " ".join(rng.choice(["the", "of", "zx1", "é"]) for _ in range(rng.randint(0, 900)))) for k in range(150)]
    pieces = packing.pack(docs(spark, rows).repartition(parts), length=256, most_open=5, group=group).toPandas()
    for i, text in rows:
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = pieces[pieces["doc_id"].isna() if i is None else pieces["doc_id"] == i].sort_values("start")
        assert b"".join(own["ids"].map(bytes)) == ids.tobytes()
        assert (own["start"] == own["length"].cumsum() - own["length"]).all() and set(own["doc_tokens"]) == {len(ids)}
    ordered = pieces.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    sizes = pieces.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 256 and (256 - sizes).sum() / (256 * len(sizes)) < 0.1


def test_packing_of_an_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def masked(spark, texts):
    rows = [(k, t, 99) for k, t in enumerate(texts)]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, n_pseudonyms int"), "a key")
    return [(r.text, r.n_pseudonyms) for r in out.orderBy("doc_id").collect()]


def test_pseudonyms_keep_their_format(spark):
    texts = ["a 4041894974608795, b", "4041 8949 7460 8795", "4041894974608796", "55.63.178.142", "+1 (988) 555-2485", "988-555-2485", "x.42@mail.example.com",
             "2020-02-29", "29.02.2020", "2021-02-29", "123-45-6789", "000-45-6789", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000"]
    found = masked(spark, texts)
    same = {"4041894974608796", "2021-02-29", "000-45-6789", "DE88370400440532013000"}
    for old, (new, n) in zip(texts, found):
        assert (n == 0 and new == old) if old in same else (n == 1 and new != old)
        if "." not in old or "@" in old:
            assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", new)) == re.sub("[a-z]", "a", re.sub("[0-9]", "9", old))
    assert luhn(found[0][0]) and re.sub(r"\D", "", found[0][0]) == re.sub(r"\D", "", found[1][0])
    assert re.sub(r"\D", "", found[4][0])[1:] == re.sub(r"\D", "", found[5][0])
    y, m, d = found[7][0].split("-")
    assert found[8][0] == f"{d}.{m}.{y}" and all(0 <= int(x) < 256 for x in found[3][0].split("."))


def test_pseudonyms_of_odd_rows(spark):
    found = masked(spark, [None, "", "no numbers", "5 and 12345", "x 1.2.3 y", "4041894974608795 " * 20_000])
    assert found[:5] == [(None, 0), ("", 0), ("no numbers", 0), ("5 and 12345", 0), ("x 1.2.3 y", 0)]
    assert found[5][1] == 20_000 and len(set(found[5][0].split())) == 1
    out = pii.pseudonymize(docs(spark, []), "a key")
    assert out.count() == 0 and out.columns[-1] == "n_pseudonyms"


def test_ibans_end_where_their_country_says(spark):
    def iban(country, body):
        code = int("".join(str(int(c, 36)) for c in body + country + "00"))
        return f"{country}{98 - code % 97:02d}{body}"

    rng = random.Random(5)
    made = [iban(c, "".join(rng.choices("0123456789", k=n - 4))) for n, codes in pii.IBAN_SIGNS.items() for c in codes.split()]
    made += ["BE68539007547034", "ES9121000418450200051332", "AT611904300234573201", "DE89370400440532013000", "GB82WEST12345698765432"]
    after = ["", " IN", " A", " 2024", " 2024-01-02", " 100 EUR", " 12.50", " USD 7", " B2B", "\nABC"]
    forms = [(" ".join(x[k : k + 4] for k in range(0, len(x), 4)) if spaced else x, tail) for x in made for tail in after for spaced in (0, 1)]
    rows = [(k, f"PAY {x}{tail}") for k, (x, tail) in enumerate(forms)]
    rows.append((-1, "BE68 5390 0754 7035 IN"))
    found = {r.doc_id: r for r in pii.pseudonymize(docs(spark, rows), "a key").collect()}
    assert found[-1].text == rows[-1][1]
    for k, (x, tail) in enumerate(forms):
        new = found[k].text[4 : 4 + len(x)]
        assert new != x and new[:2] == x[:2] and [c == " " for c in new] == [c == " " for c in x], (x, tail)
        bare = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
        assert tail == " 2024-01-02" or found[k].text[4 + len(x) :] == tail


def test_permutations_are_one_to_one(spark):
    for bounds in ((32, 32), (7, 13), (1, 9), pii.DATE_BOUNDS):
        n = bounds[0] * bounds[1]
        numbers = spark.range(n).select(pii.permute_number(F.col("id"), bounds, "t", "key").alias("v"))
        assert {r.v for r in numbers.collect()} == set(range(n))
    three = F.lpad(F.col("id").cast("string"), 3, "0")
    texts = spark.range(1000).select(pii.permute_text(three, "t", "key").alias("v"))
    assert len({r.v for r in texts.collect()}) == 1000
    other = spark.range(1000).select(pii.permute_text(three, "t", "other key").alias("v"))
    assert [r.v for r in other.collect()] != [r.v for r in texts.collect()]


def test_the_key_is_the_session_s_own(spark):
    drawn = pii.session_key(spark)
    assert len(drawn) == 64 and pii.session_key(spark) == drawn
    spark.conf.set(pii.SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.SETTING)


def test_classifier_learns_junk_and_keeps_clean_texts(spark, sf_dir):
    found = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    rows = found.merge(labels, on="doc_id")
    rows = rows[rows["held_out"]]
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95 and rows[rows["quality"] == 1]["predicted"].mean() > 0.98
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]).all()
    assert found["score"].between(0, 1).all()


def test_classifier_on_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (77, 0)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = quality.train(docs(spark, ODD), some)
        scored = quality.score(docs(spark, ODD), model)
        assert scored.count() == len(ODD) and all(0 <= r.quality_score <= 1 for r in scored.collect())
        assert quality.score(docs(spark, []), model).count() == 0
    assert quality.good(docs(spark, ODD), labels).columns == docs(spark, ODD).columns


def test_scores_depend_on_words(spark):
    """A mashed text scores below its original, and so do most shuffled ones."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, shapes, rng = quality.train(table, labels), quality.Shapes(), random.Random(1)
    texts = [r.text for r in table.join(labels, "doc_id").where("quality = 1").orderBy("doc_id").select("text").collect()]
    mashed, shuffled = [], []
    for text in (t for t in texts if len((t or "").split()) >= 30):
        words, score = text.split(), model.score(shapes.features(text))
        rng.shuffle(words)
        mashed.append(model.score(shapes.features(re.sub("[A-Za-z]", lambda m: rng.choice("abcdefghijklmnopqrstuvwxyz"), text))) < score)
        shuffled.append(model.score(shapes.features(" ".join(words))) < score)
    assert np.mean(mashed) > 0.95 and np.mean(shuffled) > 0.8


def slow_features(text, bits=quality.BITS):
    """The indicators again, n-gram by n-gram over the whole text."""
    full, raw = (1 << 64) - 1, (text or "").encode()

    def place(gram, kind):
        x = (gram + kind * 0xD1B54A32D192ED03) * 0x9E3779B97F4A7C15 & full
        return ((x ^ x >> 29) * 0x9E3779B97F4A7C15 & full) >> (64 - bits)

    def shape(word):
        signs = [b"a" if c >= 128 or 97 <= c <= 122 else b"A" if 65 <= c <= 90 else b"0" if 48 <= c <= 57 else bytes([c]) for c in word]
        return b"".join(s for k, s in enumerate(signs) if not (k and s == signs[k - 1] and s in (b"a", b"A", b"0")))

    words, out = raw.split(), set()
    shapes = [b"\x00same" if k and w == words[k - 1] else shape(w) for k, w in enumerate(words)]
    for tokens, orders, kind in ((shapes, 4, 10), ([w.lower() for w in words], 2, 20)):
        ids = [zlib.crc32(t) + 1 for t in tokens]
        for n in range(1, orders + 1):
            for k in range(len(ids) - n + 1):
                gram = 0
                for x in ids[k : k + n]:
                    gram = gram * 0x100000001B3 + x & full
                out.add(place(gram, kind + n))
    low = raw.lower()
    out |= {place(int.from_bytes(low[k : k + 4]), 0) for k in range(len(low) - 3)}
    return sorted(out)


def test_features_are_brute_force(spark, monkeypatch):
    texts = [t for _, t in ODD] + TEXTS + ["One two TWO two 22 3a! " * 40, "é" * 90 + " \n\n b"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for piece in (1 << 20, 64):  # in one piece and in many
        monkeypatch.setattr(quality, "PIECE", piece)
        for text in texts:
            if len(text or "") < 50_000:
                assert quality.Shapes().features(text).tolist() == slow_features(text), (piece, text and text[:50])


def test_fit_is_bounded_by_indicators(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = docs(spark, [(k, "good words here" if k % 2 else "!!! ###") for k in range(40)])
    all_rows, few, none = (quality.train(rows, labels, max_features=n) for n in (10**6, 200, 0))
    assert all_rows.weights.any() and few.weights.any() and not none.weights.any()


def test_a_repeated_id_gives_one_row(spark):
    """However often a labelled doc_id stands in the table, the fit gets one row of it."""
    rows = [(1, f"one of many texts {k}") for k in range(3000)] + [(2, "bad ### text"), (3, "good text"), (3, "good text"), (4, None), (4, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4)], "doc_id long, quality int")
    seen = []

    def fit(features, positive, bits):
        seen.append((len(features), sum(map(len, features))))
        return real(features, positive, bits)

    real, quality.fit = quality.fit, fit
    try:
        one = quality.train(docs(spark, rows), labels)
        again = quality.train(docs(spark, rows[::-1]).repartition(3), labels)
        quality.train(docs(spark, rows), labels, max_features=100)
    finally:
        quality.fit = real
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    assert seen[0] == seen[1] and seen[0][0] == len(kept) and seen[2][1] <= 100
    assert (one.weights == again.weights).all()


def slow_scores(rows, positive, size, cost=1.0, epochs=20):
    """The fit again in plain Python: ratios of log counts, then one dual variable at a time; returns the scores of the rows."""
    counts = {c: {} for c in (0, 1)}
    for features, label in zip(rows, positive):
        for f in features:
            counts[int(label)][f] = counts[int(label)].get(f, 0) + 1
    total = {c: size + sum(counts[c].values()) for c in (0, 1)}
    ratio = lambda f: math.log(((counts[1].get(f, 0) + 1) / total[1]) / ((counts[0].get(f, 0) + 1) / total[0]))
    values = []
    for features in rows:
        x = [ratio(f) for f in features]
        length = math.sqrt(sum(v * v for v in x) + 1)
        values.append([float(np.float32(v / length)) for v in x])  # the fit keeps them in single precision
    most = [cost * 0.5 * len(rows) / sum(p == q for q in positive) for p in positive]
    alpha, weights, bias = [0.0] * len(rows), {}, 0.0
    order, active = np.random.default_rng(7), list(range(len(rows)))
    for epoch in range(epochs):
        active = list(range(len(rows))) if epoch % 5 == 0 else active
        largest, moved = 0.0, []
        for k in order.permutation(np.array(active, np.int64)):
            sign = 1 if positive[k] else -1
            margin = sum(weights.get(f, 0.0) * v for f, v in zip(rows[k], values[k])) + bias
            new = min(max(alpha[k] - (sign * margin - 1) / (sum(v * v for v in values[k]) + 1), 0.0), most[k])
            step = (new - alpha[k]) * sign
            if step:
                for f, v in zip(rows[k], values[k]):
                    weights[f] = weights.get(f, 0.0) + step * v
                bias, alpha[k], largest = bias + step, new, max(largest, abs(step))
                moved.append(k)
        active = moved
        if largest < 1e-3 and epoch % 5 == 0:
            break
    margins = [sum(weights.get(f, 0.0) * v for f, v in zip(x, y)) + bias for x, y in zip(rows, values)]
    return [1 / (1 + math.exp(-2 * m)) for m in margins]


def test_scores_are_those_of_plain_python(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = table.join(labels, "doc_id").where(~quality.held_out(F.col("doc_id"), 5, 0)).orderBy("doc_id").select("text", "quality").collect()
    rows = [r for r in rows if len(r.text or "") < 3000]
    shapes = quality.Shapes()
    features, positive = [shapes.features(r.text) for r in rows], [r.quality == 1 for r in rows]
    model = quality.fit(features, np.array(positive))
    assert len(set(positive)) == 2
    want = slow_scores([f.tolist() for f in features], positive, 1 << quality.BITS)
    assert np.allclose([model.score(f) for f in features], want, atol=1e-3)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8) + 40 * (k % 2)) for k in range(60)]
    positive = np.array([k % 2 == 1 for k in range(60)])
    model = quality.fit(rows, positive)
    assert all((model.score(r) > 0.5) == p for r, p in zip(rows, positive))


def test_languages_held_out(spark):
    found = langid.op4_langid(spark, "/root/testdata/sf0.01").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    rows = found.merge(known, on="doc_id")
    rows = rows[rows["held_out"] & rows["lang"].notna()]
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97


def test_languages_of_odd_rows(spark):
    learned = langid.prototypes(docs(spark, [(1, "the cat and the dog"), (2, None)]))
    assert set(learned) == {"zz"}
    found = {r.doc_id: r for r in langid.identify(docs(spark, ODD), learned).collect()}
    assert len(found) == len({i for i, _ in ODD})
    assert [found[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and found[4].lang_pred == "zz"
    assert all(r.lang_pred == "und" for r in langid.identify(docs(spark, ODD), {}).collect())
    assert langid.identify(docs(spark, []), learned).count() == 0


def test_bound_vectors_are_rolled_products():
    grams, _ = langid.gram_counts("Ab c")
    vectors = {tuple(g >> 21 * k & 0x1FFFFF for k in (2, 1, 0)): v for g, v in zip(grams.tolist(), langid.gram_vectors(grams))}
    a, b = (langid.letter_vector(ord(c)) for c in "ab")
    gap = langid.letter_vector(0)
    assert len(grams) == 4 and (vectors[0, ord("a"), ord("b")] == np.roll(gap, 2) * np.roll(a, 1) * b).all()


def slow_counts(text):
    """Trigrams again, sign by sign."""
    signs = [0]
    for c in (text or "").lower():
        code = ord(c) if c.isalpha() else 0
        if code or signs[-1]:
            signs.append(code)
    if signs[-1]:
        signs.append(0)
    out = {}
    for k in range(len(signs) - 2):
        key = signs[k] << 42 | signs[k + 1] << 21 | signs[k + 2]
        out[key] = out.get(key, 0) + 1
    return out if any(signs) else {}


def test_identification_is_brute_force(spark):
    rng, alphabet = random.Random(4), "ab é1 \n中Ω"
    texts = [None, "", "1 2", "ab", " a ", "Straße 12 ÄÖ"] + ["".join(rng.choices(alphabet, k=n)) for n in (1, 2, 3, 63, 64, 65, 500)]
    for text in texts:
        for piece in (1 << 20, 64, 3, 1):
            grams, counts = langid.gram_counts(text, piece)
            assert dict(zip(grams.tolist(), counts.tolist())) == slow_counts(text), (text, piece)
    learn = [("aa", "ab ab é"), ("bb", "中中 Ω"), ("aa", "b é é"), (None, "x"), ("bb", None)]
    learned = langid.prototypes(spark.createDataFrame([(lang, t) for lang, t in learn], "lang string, text string"))

    def vector(key):
        letters = [langid.letter_vector(key >> 21 * k & 0x1FFFFF) for k in (0, 1, 2)]
        return np.roll(letters[2], 2) * np.roll(letters[1], 1) * letters[0]

    def profile(text):
        return sum((n * vector(k).astype(float) for k, n in slow_counts(text).items()), np.zeros(langid.SIZE))

    for lang in ("aa", "bb"):
        want = sum(profile(t) / sum(slow_counts(t).values()) for x, t in learn if x == lang and t)
        assert np.allclose(learned[lang], want, atol=1e-4)
    found = {r.doc_id: r for r in langid.identify(docs(spark, list(enumerate(texts))), learned).collect()}
    for k, text in enumerate(texts):
        own = profile(text)
        if not own.any():
            assert found[k].lang_pred == "und"
            continue
        near = {x: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for x, v in learned.items()}
        assert abs(found[k].score - max(0, max(near.values()))) < 1e-4 and near[found[k].lang_pred] > max(near.values()) - 1e-4


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string")


def test_chats_collapse_to_the_longest(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 2)):
        rows += [(conv, k, *t) for k, t in enumerate(full[:n])]
    rows[-1] = (5, 1, "assistant", "other")
    rows += [(6, 0, "user", None), (7, 0, "user", ""), (7, 1, None, "z"), (8, 0, "user", "q"), (8, 0, "user", "q"), (None, 0, "user", "n"), (9, 0, "user", "y" * 300_000)]
    found = {r.conv_id: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert set(found) == {3, 5, 6, 7, 8, None, 9}
    assert found[3].n_copies == 2 and found[3].n_turns == 3 and found[8].n_turns == 1
    assert found[5].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert found[6].text == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_chats_without_an_id_are_single_turns(spark):
    rows = [(None, 0, "user", "n"), (None, 3, "user", "n"), (None, 0, None, ""), (None, None, None, None), (5, 1, "user", "p"), (6, 0, "user", "p"), (6, 1, "a", "b"), (None, 0, "user", "p")]
    found = sorted(((r.conv_id, r.n_turns, r.n_copies, r.text) for r in chat.format_chats(turns(spark, rows)).collect()), key=str)
    one = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert found == sorted([(6, 2, 1, one("user", "p") + one("a", "b")), (None, 1, 2, one("user", "n")), (None, 1, 1, one("", "")), (None, 1, 1, one("", ""))], key=str)


def test_a_very_long_conversation(spark):
    columns = ["doc_id % 2 AS conv_id", "doc_id AS turn", "'user' AS role", "CAST(doc_id AS STRING) AS text"]
    both = spark.range(60_000).withColumnRenamed("id", "doc_id").selectExpr(*columns)
    start = both.where("conv_id = 0 AND turn < 20000").withColumn("conv_id", F.lit(7).cast("long"))
    found = {r.conv_id: r.n_turns for r in chat.format_chats(both.unionByName(start)).select("conv_id", "n_turns").collect()}
    assert found == {0: 30_000, 1: 30_000}
