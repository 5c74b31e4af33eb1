import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tastemill.llm import jaccard, language, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, root int, id long"


def corpus():
    rng = np.random.default_rng(8)
    words = {"en": "the of and with this that from have which would there".split(),
             "de": "der die das und nicht über schön größe mit auch wird".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang], 30)), lang, "s"))
    rows += [(200 + k, rows[k][1] + " more", "en", None) for k in range(0, 10, 2)]  # near copies
    rows += [(300, None, None, None), (301, "12 34 !!", "en", "s"), (302, "", None, "s"), (303, rows[3][1], "de", "s"),
             (5, rows[5][1], "de", "again"), (304, "the mail of jo@x.org and of +1 (555) 010-9999 there", "en", "s"),
             (None, "das und nicht über", "de", None)]
    return [(i, t, lang, s, None if t is None else len(t), "x", 1, 2) for i, t, lang, s in rows]


def test_stages(spark, folder):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    names = docs.columns
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    kept = cp.language_id(spark, docs, folder)
    assert kept.columns == names
    gone = rows - {(r.doc_id, r.text) for r in kept.collect()}
    assert {i for i, _ in gone} == {300, 301, 302}
    unique = cp.ngram_jaccard_join(spark, kept, folder)
    assert unique.columns == names
    got = sorted(unique.collect(), key=str)
    first = {}
    for r in jaccard.similarity_classes(kept).collect():
        first.setdefault(r.class_id, r.class_id)
    assert sorted((r.doc_id for r in got), key=str) == sorted(first, key=str)
    assert not {200, 202, 204, 206, 208, 303} & {r.doc_id for r in got} and len(got) == 120 + 2
    masked = cp.mask_pii(spark, unique, folder)
    assert masked.columns == names
    after = {r.doc_id: r for r in masked.collect()}
    assert after[304].text == "the mail of [EMAIL] and of [PHONE] there" and after[304].n_chars == len(after[304].text)
    assert all(after[r.doc_id].text == r.text for r in got if r.doc_id != 304)
    packed = cp.pack(spark, masked, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text).ids) + 1 for r in after.values())
    assert sum(r.length for r in packed) == want


def test_run_and_empty_table(spark, folder):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    docs.write.parquet(f"{folder}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/b/documents.parquet")
    ran = cp.run(spark, f"{folder}/a")
    assert ran.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in ran.collect()} == {*range(120), 304, None}
    assert cp.run(spark, f"{folder}/b").count() == 0
    assert language.learn(docs.limit(0)) is None and pii.redact(docs.limit(0)).count() == 0
