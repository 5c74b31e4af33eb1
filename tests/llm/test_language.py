import numpy as np
import pytest

from tastemill.llm import language

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and runs through the thick wood with them",
           "de": "der schnelle braune fuchs springt über den faulen hund und läuft durch den dichten wald",
           "fr": "le renard brun et rapide saute par dessus le chien paresseux et court à travers la forêt"}


def rows(n=120):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n):
        lang = sorted(SAMPLES)[i % 3]
        out.append((i, " ".join(rng.choice(SAMPLES[lang].split(), 12)), lang, "s", 0))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 30])
def test_codewords_are_distinct(n):
    codes = language.codewords(n)
    assert codes.shape[0] == n and len({tuple(c) for c in codes}) == n
    assert len({tuple(c) for c in codes.T}) == codes.shape[1] and (n < 3 or (np.abs(codes.sum(axis=0)) < n).all())


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["ab", None, "", "Ünï 12 ab", "漢字", "ab" * 9000, "12 !"]
    x, n = language.features(texts)
    assert n.tolist() == [2, 0, 0, 5, 2, 18000, 0]
    for k, text in enumerate(texts):
        assert np.allclose(language.features([text])[0][0], x[k])


def test_predicts_held_out_rows(spark):
    extra = [(500, None, "en", None, None), (501, "12 ++", None, None, None), (502, "", "fr", None, None),
             (None, "der hund läuft durch den wald", None, None, None), (503, "the dog", None, None, 1), (503, "the dog", None, None, 1)]
    df = spark.createDataFrame(rows() + extra, SCHEMA)
    got = language.identify(df, language.learn(df), ("doc_id", "lang")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 126 and all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (500, 501, 502))
    assert by_id[None].lang_pred == "de" and by_id[503].lang_pred == "en"
    unseen = {r.doc_id for r in df.where(language.held_out()).collect()}
    assert 20 < len(unseen) < 60
    assert np.mean([r.lang_pred == r.lang for r in got if r.doc_id in unseen and r.lang and r.doc_id < 500]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_or_one_language_to_learn(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identify(unlabelled, language.learn(unlabelled)).collect()} == {"und"}
    one = df.where("lang = 'en'")
    assert {(r.lang_pred, r.score) for r in language.identify(one, language.learn(one)).collect()} == {("en", 1.0)}
    empty = df.limit(0)
    assert language.identify(empty, language.learn(empty)).count() == 0


def plain_grams(text):
    """Counts of two and three letters by their bucket, letter by letter."""
    table, codes = language._letters(), []
    for c in f" {text} ":
        code = int(table[ord(c)])
        if code or not codes or codes[-1]:
            codes.append(code)
    mask, counts = 2 ** 32 - 1, np.zeros(language.FEATURES)
    for i in range(len(codes)):
        for size in (2, 3):
            gram = codes[i:i + size]
            if len(gram) < size or not (gram[0] or gram[1]):
                continue
            mixed = [g * 0x9E3779B1 & mask for g in gram]
            value = mixed[0] + (mixed[1] ^ mixed[1] >> 15) * 0x85EBCA6B & mask
            if size == 3:
                value = value + (mixed[2] ^ mixed[2] >> 13) * 0xC2B2AE35 & mask
            value ^= value >> 16
            counts[(value * 0x27D4EB2F & mask) >> 20] += 1
    return counts


def test_same_as_deciding_text_by_text(spark):
    """The nearest codeword by adding up the losses of all bits for every language, and ambiguity by the lead."""
    df = spark.createDataFrame(rows(), SCHEMA)
    model = language.learn(df)
    texts = [*(r[1] for r in rows(40)), "the hund", "x", "et", "", "12 !", "über the forêt", "  the   fox  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(frame, model).collect()}
    for k, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        x = np.sqrt(plain_grams(text))
        x /= np.linalg.norm(x)
        losses = []
        for code in model.codes:
            loss = 0.0
            for bit, sign in enumerate(code):
                margin = sum(x[f] * model.weights[f, bit] for f in np.flatnonzero(x)) + model.weights[-1, bit]
                loss += model.trust[bit] * np.log1p(np.exp(-sign * margin))
            losses.append(loss)
        p = np.exp(min(losses) - np.array(losses))
        p /= p.sum()
        order = np.argsort(-p)
        assert got[k].lang_pred == model.languages[order[0]] and abs(got[k].score - p[order[0]]) < 1e-4
        lead = p[order[0]] - p[order[1]]
        assert abs(lead - language.AMBIGUOUS_GAP) < 1e-3 or got[k].ambiguous == (lead < language.AMBIGUOUS_GAP)


def test_sample_is_the_same_in_any_partitioning(spark):
    many = [(i, f"{r[1]} {i}", r[2], None, i) for i, r in enumerate(rows() * 20)] + [(7, "hot row", "en", "x", 1)] * 900
    df = spark.createDataFrame(many, SCHEMA)
    drawn = []
    for parts in (1, 3, 16):
        found = language.training_rows(df.repartition(parts, "text"), 90).select("lang", "place", "doc_id", "h", "at0").collect()
        drawn.append(sorted((r.lang, r.place, r.doc_id, r.h, bytes(r.at0)) for r in found))
    assert drawn[0] == drawn[1] == drawn[2]
    assert [sum(r[0] == lang for r in drawn[0]) for lang in sorted(SAMPLES)] == [30, 30, 30]


def test_sample_bound_has_no_grain():
    """Of any number of rows the bound lets about as many through, also where 2**20 times as many are simulated."""
    for n in (1000, 10 ** 9, 10 ** 9 << 20, 10 ** 15 << 10):
        share = (language.hash_bound(750, n) + (1 << 63)) / (1 << 64)
        assert share == 1 if n <= 1540 else abs(share * n - 1540) < 1
    assert language.hash_bound(750, 10 ** 9 << 20) > -(1 << 63)


def test_languages_are_bounded(spark):
    df = spark.createDataFrame([*rows(), *((1000 + i, f"dirty label {i}", f"label{i}", None, 0) for i in range(50))], SCHEMA)
    assert language.learn(df, most=3).languages == sorted(SAMPLES)


def test_long_text_in_the_sample(spark):
    df = spark.createDataFrame([*rows(30), (900, "le renard " * 200_000, "fr", None, 1), (903, "", "fr", None, 1)], SCHEMA)
    sent = language.training_rows(df)
    assert max(len(r.at0) + len(r.x0) for r in sent.collect()) <= 6 * language.FEATURES
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.learn(df)).collect()}
    assert got[900] == "fr" and got[903] == "und"
