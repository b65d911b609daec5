import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.unify import LOOKALIKES, WITHIN_WORDS, disguised_values, equal_looking, is_disguised, plain_text, unify_values

SCHEMA = "id bigint, original_query string, normalized_query string, value string, field string"


def test_forms_of_one_text_meet():
    forms = ["café loan", "café loan", "ｃａｆé　ｌｏａｎ", "café lоan", "c​afé loan", "𝖼𝖺𝖿é 𝗅𝗈𝖺𝗇"]
    assert {plain_text(f) for f in forms} == {"café loan"}
    assert [is_disguised(f) for f in forms] == [False] + [True] * 5


def test_true_words_of_other_scripts_stay():
    for text in ("the 'Радуга' tariff", "Ωμέγα plan", "ऋण कार्ड कब मिलेगा?", "கடன் அட்டை", "account-ல transfer", "Señal\npack"):
        assert plain_text(text) == text and not is_disguised(text)


def test_probes_of_many_scripts():
    for odd, plain in (("Ꭲicket", "Ticket"), ("ⲟpen", "open"), ("ꓐank", "Bank"), ("Ьank", "bank"), ("ωeb", "web"), ("ѵan", "van"), ("Ꮪave", "Save"), ("тown", "town"), ("ɑccount", "account"), ("ոame", "name"), ("pаcкet", "packet"), ("ɡoʟd", "gold")):
        assert plain_text(f"my {odd} here") == f"my {plain} here" and is_disguised(odd)
    for true in ("тест", "loanக்கு", "東京タワー駅", "한국어와漢字", "yarın", "5 µm", "naïve", "тон", "Straße", "the word мир here"):
        assert plain_text(true) == true and not is_disguised(true), true
    assert sum(map(len, [*LOOKALIKES.values(), *WITHIN_WORDS.values()])) <= 200


def test_borrowed_letters_go_to_the_words_script():
    assert plain_text("the 'Рaдугa' tariff") == "the 'Радуга' tariff"
    assert plain_text("lоаn іѕ") == "loan is"
    assert plain_text("plan С2") == "plan C2"
    assert plain_text("re‑use eﬃcient") == "re-use efficient"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_plain_form_is_a_fixed_point(text):
    once = plain_text(text)
    assert plain_text(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_frame_cases(spark):
    rows = [(1, None, "", "x", "y"), (2, "lоan", "loan", "x", "y"), (2, "lоan", "loan", "x", "y"), (3, "a" * 200_000 + "​", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.id, r.field) for r in disguised_values(df, "id", ["original_query", "normalized_query"]).collect())
    assert found == [(2, "original_query"), (2, "original_query"), (3, "original_query")]
    assert unify_values(df, "id", ["original_query", "normalized_query"]).count() == 6
    groups = {r.plain: (r.n_values, r.n_spellings) for r in equal_looking(df.filter("id < 3"), "id", ["original_query", "normalized_query"]).collect()}
    assert groups == {"": (1, 1), "loan": (4, 2)}
    empty = spark.createDataFrame([], SCHEMA)
    assert disguised_values(empty, "id", ["original_query"]).count() == 0
