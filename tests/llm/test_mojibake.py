import random

import pytest

from quillspark.llm.mojibake import Restorer, _some_sentences, garbled_documents, learn_languages, restored_text

CLEAN = {
    "en": ["The résumé scan service costs ₹{} and isn’t offered on weekends.", "“Keep the slip,” says the notice at the desk, “until it’s closed.”", "The room is kept at {} °C ± 1 °C…", "The café desk opens at {} a.m. – except on Mondays.", "Plain words about {} forms."],
    "fr": ["Le dépôt à terme n’est pas disponible avant l’âge de {} ans.", "Les frais s’élèvent à {} € et sont prélevés dès la première échéance.", "Âge minimal : {} ans ; l’élève doit présenter un reçu."],
    "hi": ["शाखा कार्यालय सुबह {} बजे से खुला रहता है।", "पते के प्रमाण के बिना छात्रवृत्ति नहीं दिया जाएगा, {} बार।"],
}
SCHEMA = "doc_id bigint, text string, lang string, restored string, garbled boolean"


def _corpus():
    return [(t.format(n), lang) for lang, some in CLEAN.items() for t in some for n in range(10, 60)]


def _garble(text, wrong, right="utf-8"):
    return text.encode(right).decode(wrong, "replace" if wrong != "latin-1" else "strict")


@pytest.fixture(scope="module")
def restorer():
    return Restorer(learn_languages(_corpus()))


def test_clean_text_is_left_alone(restorer):
    for text, lang in _corpus():
        assert restorer.document(text, lang) == (text, False)


@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437", "cp850", "koi8_r", "iso8859_2"])
def test_utf8_read_wrongly_is_restored(restorer, wrong):
    for lang in CLEAN:
        text = CLEAN[lang][0].format(77)
        try:
            bad = text.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        assert restorer.document(bad, lang) == (text, True)


def test_twice_wrong_and_partly_wrong(restorer):
    text = CLEAN["en"][0].format(77)
    assert restorer.document(_garble(_garble(text, "latin-1"), "latin-1"), "en") == (text, True)
    mixed = "The room is kept at 21 °C ± 1 Â°C…"
    assert restorer.document(mixed, "en") == (mixed.replace("Â", ""), True)
    assert restorer.document("The caf� desk", "en") == ("The caf� desk", True)


def test_another_single_byte_encoding(restorer):
    text = CLEAN["fr"][0].format(44)
    assert restorer.document(_garble(text, "mac_roman", "cp1252"), "fr") == (text, True)


def test_frame_cases(spark):
    rng = random.Random(2)
    rows = [(i, t, lang, "x", None) for i, (t, lang) in enumerate(_corpus())]
    bad = rows[3][1].encode().decode("latin-1") if not rows[3][1].isascii() else rows[0][1].encode().decode("latin-1")
    n = len(rows)
    rows += [(n, bad, "en", "x", None), (n, bad, "en", "x", None), (n + 1, bad, None, "x", None), (n + 2, None, "en", "x", None), (n + 3, "", "en", "x", None), (n + 4, CLEAN["en"][0].format(12) * 3000, "en", "x", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in garbled_documents(df).collect()) == [n, n, n + 1]
    assert {r.restored for r in restored_text(df).filter("garbled").collect()} == {bad.encode("latin-1").decode()}
    assert garbled_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sample_is_bounded_in_bytes():
    long = " ".join(f"Le dépôt numéro {i} est fermé." for i in range(5000))
    some = _some_sentences(long, 2000)
    assert 1500 < len(some.encode()) <= 2000 and "numéro 4" in some and _some_sentences("déjà vu", 2000) == "déjà vu"
    # a sentence too long for the dictionary leaves room for the others
    learned = learn_languages([("é" * 300_000 + ". Le dépôt est fermé. Le dépôt est ici. La clé.", "fr")], 1000)["fr"]
    assert "dépôt".encode() in learned.dictionary


def test_every_document_counts(spark):
    from quillspark.llm.mojibake import learned_languages

    # 6,000 documents with three sentences beyond ASCII each, and one with one: a share of 2 % is more than 360 of them
    tails = ["œ"] * 361 + ["ø"] * 360 + ["é"] * 5279
    rows = [(i, f"Dépôt numéro {i}. Le café est fermé. Voilà {c} {i}.\nPlain {i}.", "fr") for i, c in enumerate(tails)] + [(8999, "Le café est fermé. Non.", "fr"), (9000, "Only plain words. Again.", "en"), (9001, "no label é", None), (9002, None, "en")]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    learned = learned_languages(texts, "text", "lang", 4000)
    assert set(learned) == {"fr", "en"} and learned["fr"].alphabet == frozenset("éôàœ")
    assert learned["en"].alphabet == frozenset() and b"Only plain words. " in learned["en"].dictionary
    # the sentence of the most documents is the cheapest to refer to, none is in the dictionary twice, and it is filled
    assert learned["fr"].dictionary.endswith("Le café est fermé. ".encode()) and learned["fr"].dictionary.count("Le café".encode()) == 1 and 3900 < len(learned["fr"].dictionary) <= 4000
    assert learned_languages(texts.limit(0), "text", "lang") == {}


def test_learning_by_spark_is_learning_in_memory(spark):
    from quillspark.llm.mojibake import learned_languages

    garbled = [(t.encode().decode("latin-1"), lang) for t, lang in _corpus()[:9]]
    rows = [*_corpus(), *garbled, ("One. Two!  “Drei” zwei?\n\n  \nvier… fünf", "de"), ("A lost � one. Kept à.", "fr")]
    there = learned_languages(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    here = learn_languages(rows)
    assert there.keys() == here.keys()
    for lang in here:
        assert there[lang].alphabet == here[lang].alphabet and sorted(there[lang].dictionary) == sorted(here[lang].dictionary)
